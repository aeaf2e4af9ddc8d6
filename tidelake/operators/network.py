"""Communities of a weighted network by label propagation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import topics
from .pairs import give_back, pack_edges, sorted_rows, unpack_edges
from .scratch import apart, discard, join_hot, new_path, numbered, written

ROUNDS = 20
#: Occurrences of the nodes of a cell, about, and cells of each half at least and at most; edges that are sorted at once, about; sums in a table.
CELL, LEAST_CELLS, MOST_CELLS, EDGES, SUMS = 150_000, 4, 150, 1 << 20, 1 << 23


def half(node: Column) -> Column:
    """0 or 1, at random but fixed for a node: the halves of a network take turns."""
    return F.when(F.substring(F.md5(node.cast("string")), 1, 1) < "8", 0).otherwise(1)


def communities(edges: DataFrame, max_rounds: int = ROUNDS) -> DataFrame:
    """node, community, degree of every node of edges (a, b, weight), as a written table.

    A node starts as a community of its own. In each round one half of the nodes
    takes the label for which the weights of its edges add up to most; of equal
    sums its own label wins, then the least. It ends when neither half changes, or
    after max_rounds. Halves in turn, and one's own label first, keep two nodes from
    trading labels for ever. Repeated edges add up, loops, null ends and edges
    without a positive weight are left out; no edges give no rows.

    Nodes are numbered in their order, so rounds work on whole numbers, and edges are
    stored by the half of their node, so a round reads those of one half. Labels
    reach the edges of a hub by broadcast, and sums are formed by (node, label)
    before they meet at a node, so no task gets all neighbours of a hub.
    """
    ends = edges.where("a != b AND weight > 0")
    named = written(ends.select(F.col("a").alias("node"), F.col("b").alias("to"), "weight"), "ends")
    seen = written(named.select("node").union(named.select("to")).groupBy("node").agg(F.count(F.lit(1)).alias("size")), "nodes")
    nodes = numbered(seen, "number", "node").withColumn("half", half(F.col("node")))
    own = lambda key, number, *more: nodes.select(F.col("node").alias(key), F.col("number").alias(number), "size", *more)
    met = join_hot(named, own("node", "a"), "node", "size").drop("size")
    met = written(met.groupBy("a", "to").agg(F.sum("weight").alias("weight")), "met")
    met = join_hot(met, own("to", "b"), "to", "size").select("a", "b", "weight")
    sides = nodes.select(F.col("number").alias("node"), "half", "size")
    both = written(met.union(met.select("b", "a", "weight")).toDF("node", "from", "weight").groupBy("node", "from").agg(F.sum("weight").alias("weight")), "both")
    both = join_hot(both, sides, "node", "size").select("node", "from", "weight", "half")
    path = new_path(edges.sparkSession, "edges")
    both.write.partitionBy("half").parquet(path)
    both = edges.sparkSession.read.schema("node int, from int, weight " + dict(both.dtypes)["weight"] + ", half int").parquet(path)
    state = written(both.groupBy("node").agg(F.count(F.lit(1)).alias("degree")).select("node", F.col("node").alias("community"), "degree"), "labels")
    quiet = 0
    for i in range(max_rounds):
        facts = state.select(F.col("node").alias("from"), F.col("community").alias("label"), "degree")
        turn = both.where(F.col("half") == i % 2).drop("half")
        sums = join_hot(turn, facts, "from", "degree").groupBy("node", "label").agg(F.sum("weight").alias("s"))
        best = sums.join(state, "node").groupBy("node").agg(F.min(F.struct((-F.col("s")).alias("s"), (F.col("label") != F.col("community")).alias("other"), "label")).alias("x"))
        moved = state.join(best.select("node", F.col("x.label").alias("label")), "node", "left")
        new = written(moved.select("node", F.coalesce("label", "community").alias("community"), "degree", (F.coalesce("label", "community") != F.col("community")).alias("moved")), "labels")
        discard(state)
        state = new.select("node", "community", "degree")
        quiet = 0 if new.where("moved").limit(1).count() else quiet + 1
        if quiet == 2:
            break
    name = lambda c: nodes.select(F.col("number").alias(c), F.col("node").alias(f"_{c}"))
    return written(state.join(name("node"), "node").join(name("community"), "community").select(F.col("_node").alias("node"), F.col("_community").alias("community"), "degree"), "communities")


def _cells(halves: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes' numbers in an order where each half, and in it each cell, is a range; and where the cells begin, those of half 0 first, with the end. n: how often a node occurs, to which its edges are about in proportion."""
    order, starts = np.argsort(halves, kind="stable"), []
    cells = min(max(LEAST_CELLS, int(n.sum()) // 2 // CELL), MOST_CELLS)
    weight = 0.2 / len(n) + 0.8 * n / n.sum()
    for h in (0, 1):
        first = int(np.searchsorted(halves[order], h))
        w = weight[order[halves[order] == h]]
        at = np.searchsorted(np.cumsum(w), np.arange(cells) * (w.sum() / cells), "right") if len(w) else np.zeros(cells, int)
        starts += [first, *(first + at[1:])]
    place = np.empty(len(n), np.int32)
    place[order] = np.arange(len(n), dtype=np.int32)
    return place, np.array([*starts, len(n)], np.int64)


def _edges(first: np.ndarray, least: topics.Least, places, starts: np.ndarray):
    """cell, edges: the pairs of the squares from both ends, packed; a node is its place in the cell, the other one its rank."""
    schema = pa.schema([("cell", pa.int32()), ("edges", pa.binary())])

    def packed(node, other, weight):
        node, other, weight = sorted_rows([places.value[node], other, weight], [len(places.value), first[-1], least.docs])
        cuts = np.searchsorted(node, starts)
        cells = np.flatnonzero(np.diff(cuts))
        for c in cells:
            own = slice(cuts[c], cuts[c + 1])
            yield c, pack_edges(node[own] - starts[c], other[own], weight[own])

    def flushed(parts, g, h):
        x, y, both = (np.concatenate(c) for c in zip(*parts, strict=True))
        x, y = x + first[g], y + first[h]
        for rows in (packed(x, y, both), packed(y, x, both)):
            yield from (pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([e], pa.binary())], schema=schema) for c, e in rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, h, _, _, pairs in topics.squares_of(batches, first, least):
            parts, size = [], 0
            for x, y, both, _ in pairs:
                parts.append((x, y, both))
                size += len(x)
                if size > EDGES:
                    yield from flushed(parts, g, h)
                    parts, size = [], 0
            if size:
                yield from flushed(parts, g, h)

    return run


def _best(node: np.ndarray, label: np.ndarray, weight: np.ndarray, own: np.ndarray, labels: int, most: int) -> np.ndarray:
    """The label of each node for which its weights add up to most, its own first, then the least; -1 for a node without edges. own: the nodes' labels."""
    k, new = len(own), np.full(len(own), -1, np.int64)
    if k * labels <= min(SUMS, 4 * len(node)):
        sums = np.bincount(node * labels + label, weight, k * labels).reshape(k, labels)
        best = sums.max(1)
        found = np.where(sums[np.arange(k), own] == best, own, sums.argmax(1))
        return np.where(best > 0, found, new)
    if not len(node):
        return new
    node, label, weight = sorted_rows([node, label, weight], [k, labels, most])
    cuts = np.flatnonzero((np.diff(node, prepend=-1) != 0) | (np.diff(label, prepend=-1) != 0))
    sums, node, label = np.add.reduceat(weight, cuts), node[cuts], label[cuts]
    firsts = np.flatnonzero(np.diff(node, prepend=-1))
    top = sums == np.repeat(np.maximum.reduceat(sums, firsts), np.diff(firsts, append=len(node)))
    node, label = node[top], label[top]
    least = np.flatnonzero(np.diff(node, prepend=-1))
    new[node[least]] = label[least]
    mine = label == own[node]
    new[node[mine]] = label[mine]
    return new


def _turn(state, ranks, starts: np.ndarray, most: int):
    """places and labels, packed, of the nodes of a cell that have edges. state: the labels of all nodes by rank, from 0 without gaps, and how many there are; ranks: by place."""
    schema = pa.schema([("cell", pa.int32()), ("places", pa.binary()), ("labels", pa.binary())])

    def done(cell: int, edges: list) -> pa.RecordBatch:
        labels, number = state.value
        own = labels[ranks.value[starts[cell] : starts[cell + 1]]]
        new = np.full(len(own), -1, np.int64)
        each = sum(np.bincount(node, minlength=len(own)) for node, _, _ in edges)
        parts = np.flatnonzero(np.diff((np.cumsum(each) - each) // EDGES, prepend=-1))
        for lo, hi in zip(parts, [*parts[1:], len(own)], strict=True):  # nodes with about so many edges
            cut = [(slice(*np.searchsorted(e[0], (lo, hi))), e) for e in edges]
            node, label, weight = (np.concatenate([e[c][at] for at, e in cut]).astype(np.int64) for c in range(3))
            new[lo:hi] = _best(node - lo, label, weight, own[lo:hi], number, most)
        places = np.flatnonzero(new >= 0)
        return pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), *(pa.array([a.astype(np.int32).tobytes()], pa.binary()) for a in (places + starts[cell], new[places]))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, edges = None, []
        for b in batches:
            for cell, packed in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if edges and cell != now:
                    yield done(now, edges)
                    edges = []
                    give_back()
                now = cell
                node, other, weight = unpack_edges(memoryview(packed.as_buffer()))
                edges.append((node, state.value[0][other], weight))
        if edges:
            yield done(now, edges)
            edges = []
            give_back()

    return run


def communities_of_topics(found: topics.Held, max_rounds: int = ROUNDS) -> DataFrame:
    """``communities`` of the pairs of topics as edges, weighted by the documents they share: node, community.

    Edges are numbers from the start, packed by their nodes' cells (ranges of the
    nodes of one half) as the pairs are counted, and are written once, from both
    ends, less than two bytes each as a rule. In a round a task has all edges of a
    cell and adds up its nodes' labels, so no edge and no sum is exchanged; labels
    are an array of whole numbers that the driver sends out.
    """
    spark = found.kept.sparkSession
    if len(found.first) == 1:
        return found.kept.select(F.col("topic").alias("node"), F.col("topic").alias("community")).limit(0)
    named = numbered(found.kept, "number", "topic")
    by_rank = named.select("rank", "number", half(F.col("topic")).alias("half"), "n").toArrow().sort_by("rank")
    number, halves, n = (by_rank.column(c).to_numpy() for c in ("number", "half", "n"))
    place, starts = _cells(halves, n)
    send, path = spark.sparkContext.broadcast, new_path(spark, "edges")
    ranks = np.argsort(place).astype(np.int32)
    sent = send(place), send(ranks)
    found.squares().mapInArrow(_edges(found.first, found.least, sent[0], starts), "cell int, edges binary").write.partitionBy("cell").parquet(path)
    edges, cells = spark.read.schema("edges binary, cell int").parquet(path), (len(starts) - 1) // 2

    def turn(h: int, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of the nodes of a half that have edges, and their labels."""
        left, codes = np.unique(labels, return_inverse=True)
        state = send((codes.astype(np.int32), len(left)))
        met = apart([edges.where(F.col("cell") == c).coalesce(1).select("cell", "edges") for c in range(h * cells, (h + 1) * cells)], edges.where("cell < 0").select("cell", "edges"))
        rows = met.mapInArrow(_turn(state, sent[1], starts, found.least.docs), "cell int, places binary, labels binary").collect()
        state.unpersist()
        at, to = (np.concatenate([np.zeros(0, np.int32), *(np.frombuffer(r[c], np.int32) for r in rows)]) for c in ("places", "labels"))
        return ranks[at], left[to]

    labels, seen, quiet = number.copy(), np.zeros(len(number), bool), 0
    for i in range(max(2, max_rounds)):
        at, to = turn(i % 2, labels)
        seen[at] = True
        if i < max_rounds:
            moved = (labels[at] != to).any()
            labels[at] = to
            quiet = 0 if moved else quiet + 1
            if quiet == 2:
                break
    labels = send(np.where(seen, labels, -1).astype(np.int32))
    topic = named.schema["topic"].dataType

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(labels.value[b.column(1).to_numpy()], pa.int32())], names=["node", "number"])

    to = named.select("topic", "rank").mapInArrow(known, f"node {topic.simpleString()}, number int").where("number >= 0")
    return to.join(named.select("number", F.col("topic").alias("community")), "number").select("node", "community")


def modularity(edges: DataFrame, labels: DataFrame) -> float:
    """How much more weight lies within communities than chance would put there: below 1, 0 for one community."""
    end = lambda c: labels.select(F.col("node").alias(c), F.col("community").alias(f"c{c}"))
    met = edges.where("a != b AND weight > 0").join(end("a"), "a").join(end("b"), "b")
    inside = met.agg(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0)).alias("x"), F.sum("weight").alias("w")).first()
    if not inside.w:
        return 0.0
    strength = met.select(F.col("ca").alias("c"), "weight").union(met.select("cb", "weight")).groupBy("c").agg(F.sum("weight").alias("s"))
    return float(inside.x / inside.w - strength.agg(F.sum((F.col("s") / (2 * inside.w)) ** 2)).first()[0])
