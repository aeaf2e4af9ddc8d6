"""N-gram Jaccard join by rare-first prefix filtering.

1. One pass gives each document's shingle-set size and digest, and counts all
   shingles into a sketch of fixed size, which tells those of extreme frequency.
2. Every other shingle is sent, packed, to the block of shingles it belongs to and
   counted there exactly. Only shingles of several documents are sent back. A
   document whose prefix, rarest shingles first, holds none of them has no partner;
   of the others the shared shingles are kept, by which alone they are compared.
3. Documents that meet at a prefix shingle are paired under the length and
   positional filters. Shingles of up to ``GROUP`` documents give all their pairs.
   The documents of more frequent ones are tied to a few pivots, then to the closest
   documents of other components, and only what is still in different components is
   paired out, in cells of bounded size whose tasks apply the suffix filter: a group
   of near copies costs about its size, and no link is lost.
4. Pairs pass the suffix filter (counts by hash range bound the intersection from
   above) and are verified, each pair once.
5. Components of the verified links.

Shingles are compared by 64-bit hashes. One of extreme frequency, whatever its
share, is cut into cells of bounded size in which every pair still meets.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce
from typing import Any, Tuple  # noqa: UP035  (Spark reads the group key's hint by this spelling)

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing
from .base import bound_batches, discard, give_back, join_groups, materialise, shuffle_partitions
from .components import components

WORDS = 5
#: Similarity of at least NUM / DEN.
NUM, DEN = 3, 4
SKETCH_BITS, CHUNK_BITS = 20, 16
#: Documents of a shingle that are paired at once; pivots of a larger group; close documents that each one is held against before all are.
GROUP, PIVOTS, CLOSEST = 16, 8, 4
#: Parts of a large group in which its pivots are looked for.
PARTS = 64
#: Documents of one cell of a shingle of extreme frequency, and of one cell of pairing out.
CELL, SQUARE = 200_000, 1000
#: Shingles of a block; shingles and documents that a task sends out at once.
BLOCK, FLUSH, DOCS = 750_000, 1_000_000, 1 << 16
BINS = 64
_U = np.uint64


def _sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    for _, _, data, offsets in hashing.utf8_slices(column):
        h, _, _, rows = hashing.words(data, offsets)
        yield from hashing.shingles(h, rows, words)


def _least_overlap(total):
    """The least intersection of two sets of that total size that are similar enough."""
    return -(-NUM * total // (NUM + DEN))


def _survey(words: int):
    """Documents' sizes and digests, and one partition's sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
        names = ["doc_id", "n", "d1", "d2", "chunk", "part", "counts"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        for batch in batches:
            n, d1, d2, gathered, held = [], [], [], [], 0

            def add():
                if gathered:
                    np.add(sketch, np.bincount((np.concatenate(gathered) >> _U(64 - SKETCH_BITS)).astype(np.int64), minlength=len(sketch)).astype(np.uint32), out=sketch)
                gathered.clear()

            for x in _sets(batch.column(1), words):
                digest = np.frombuffer(xxhash.xxh3_128_digest(x.tobytes()), np.int64)
                n.append(len(x))
                d1.append(int(digest[0]))
                d2.append(int(digest[1]))
                gathered.append(x)
                held += len(x)
                if held > 500_000:
                    add()
                    held = 0
            add()
            rest = [pa.nulls(len(n), t) for t in types[4:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), *rest], names)
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        chunks = [(i, zlib.compress(c.tobytes(), 1)) for i, c in enumerate(sketch.reshape(-1, 1 << CHUNK_BITS)) if c.any()]
        if chunks:
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(chunks), t) for t in types[:4]), pa.array([i for i, _ in chunks], pa.int32()), pa.array([part] * len(chunks), pa.int32()), pa.array([c for _, c in chunks])], names)

    return run


def _added(key: Tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(1 << CHUNK_BITS, np.uint32)
    for c in pdf["counts"]:
        x = np.frombuffer(zlib.decompress(c), np.uint32)
        total = np.where(total > np.uint32(0xFFFFFFFF) - x, np.uint32(0xFFFFFFFF), total + x)
    return pd.DataFrame({"chunk": [key[0]], "part": [key[1]], "counts": [zlib.compress(total.tobytes(), 1)]})


def _sketch(parts: DataFrame, n: int) -> np.ndarray:
    """The sum of all partitions' sketches, added sixteen at a time; 4 MB whatever the input."""
    while n > 1:
        parts = parts.withColumn("part", F.floor(F.col("part") / 16).cast("int")).groupBy("chunk", "part").applyInPandas(_added, "chunk int, part int, counts binary")
        n = -(-n // 16)
    out = np.zeros((1 << SKETCH_BITS - CHUNK_BITS, 1 << CHUNK_BITS), np.uint32)
    for row in parts.collect():
        out[row.chunk] = np.frombuffer(zlib.decompress(row.counts), np.uint32)
    return out.reshape(-1)


#: What a payload holds: documents (id, digest, size), shingles to be counted, shingles with their counts.
_HEAD, _SENT, _COUNTED = 0, 1, 2


def _pack(kind: int, *columns: np.ndarray) -> bytes:
    """Columns of one length, by significance of their bytes, which compresses better."""
    planes = b"".join(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes() for x in columns)
    return bytes([kind]) + zstandard.compress(planes, 1)


def _unpack(b: bytes, *kinds) -> list[np.ndarray]:
    planes, at, out = np.frombuffer(zstandard.decompress(b[1:]), np.uint8), 0, []
    n = len(planes) // sum(np.dtype(k).itemsize for k in kinds)
    for k in kinds:
        size = np.dtype(k).itemsize
        out.append(np.ascontiguousarray(planes[at : at + n * size].reshape(size, n).T).view(k).reshape(n))
        at += n * size
    return out


_HEAD_TYPES, _SENT_TYPES, _COUNTED_TYPES = (np.int64, np.int64, np.int32), (np.uint64, np.uint16), (np.uint64, np.uint16, np.uint32)


def _steps(sorted_tokens: np.ndarray) -> np.ndarray:
    return np.diff(sorted_tokens, prepend=_U(0))


def _sent(words: int, sketch, blocks: int, hot: int):
    """Shingles by block, with the places of their documents in the flush. Of equal sets in a flush one is sent, for the least id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        frequency = sketch.value
        part = TaskContext.get().partitionId() << 24
        heads: dict[bytes, list] = {}
        sets: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal part, held
            token = np.concatenate(sets)
            place = np.repeat(np.arange(len(sets), dtype=np.uint16), [len(x) for x in sets])
            head = np.array(list(heads.values()), np.int64)
            out = [(part % blocks, _pack(_HEAD, head[:, 0].copy(), head[:, 1].copy(), head[:, 2].astype(np.int32)))]
            count = frequency[(token >> _U(64 - SKETCH_BITS)).astype(np.int64)]
            if (extreme := count > hot).any():
                order = np.argsort(token[extreme], kind="stable")
                out.append((part % blocks, _pack(_COUNTED, _steps(token[extreme][order]), place[extreme][order], count[extreme][order])))
                token, place = token[~extreme], place[~extreme]
            block = ((token >> _U(24)) % _U(blocks)).astype(np.int64)
            order = np.lexsort((token, block))
            token, place, block = token[order], place[order], block[order]
            bounds = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1], [True]))) if len(token) else np.zeros(1, np.int64)
            out += [(int(block[a]), _pack(_SENT, _steps(token[a:b]), place[a:b])) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            batch = pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([part] * len(out), pa.int64()), pa.array([x[1] for x in out], pa.binary())], ["block", "part", "payload"])
            heads.clear()
            sets.clear()
            part, held = part + 1, 0
            return batch

        for batch in batches:
            for doc, x in zip(batch.column(0).to_pylist(), _sets(batch.column(1), words), strict=True):
                if not len(x) or doc is None:
                    continue
                digest = xxhash.xxh3_128_digest(x.tobytes())
                if digest in heads:
                    heads[digest][0] = min(heads[digest][0], doc)
                    continue
                heads[digest] = [doc, int(np.frombuffer(digest, np.int64)[0]), len(x)]
                sets.append(x)
                held += len(x)
                if held > FLUSH or len(sets) == DOCS:
                    yield flush()
        if sets:
            yield flush()
        give_back()

    return run


def _counted(pdf: pd.DataFrame) -> pd.DataFrame:
    """The shingles of one block that several documents hold, with their counts, back to the flushes they came from."""
    passed = [p[0] != _SENT for p in pdf["payload"]]
    own = pdf[[not x for x in passed]]
    out = [pdf.loc[passed, ["part", "payload"]]]
    if len(own):
        columns = [_unpack(p, *_SENT_TYPES) for p in own["payload"]]
        token = np.concatenate([np.cumsum(steps, dtype=np.uint64) for steps, _ in columns])
        place = np.concatenate([x for _, x in columns])
        which = np.repeat(np.arange(len(columns)), [len(x) for _, x in columns])
        order = np.argsort(token, kind="stable")  # rows of one flush stay together, in the order of their shingles
        first = np.flatnonzero(np.concatenate(([True], token[order][1:] != token[order][:-1])))
        size = np.diff(np.append(first, len(order)))
        count = np.repeat(size, size).astype(np.uint32)
        order, count = order[count > 1], count[count > 1]
        again = np.argsort(which[order], kind="stable")
        order, count = order[again], count[again]
        bounds = np.flatnonzero(np.concatenate(([True], which[order][1:] != which[order][:-1], [True]))) if len(order) else np.zeros(1, np.int64)
        parts = own["part"].to_numpy()
        rows = [(parts[which[order[a]]], _pack(_COUNTED, _steps(token[order[a:b]]), place[order[a:b]], count[a:b])) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        out.append(pd.DataFrame(rows, columns=["part", "payload"]))
    return pd.concat(out)


_LIVE = "a long, digest long, n int, token long, count long, pos int, tokens binary, bins binary"


def _chosen(hot: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Of one flush the documents with a shared shingle in their prefix (tokens, bins), and those shingles (token, count, pos)."""
        head = next(_unpack(p, *_HEAD_TYPES) for p in pdf["payload"] if p[0] == _HEAD)
        doc, digest, n = head
        columns = [_unpack(p, *_COUNTED_TYPES) for p in pdf["payload"] if p[0] == _COUNTED]
        token = np.concatenate([np.zeros(0, np.uint64), *(np.cumsum(x[0], dtype=np.uint64) for x in columns)])
        place = np.concatenate([np.zeros(0, np.uint16), *(x[1] for x in columns)]).astype(np.int64)
        count = np.concatenate([np.zeros(0, np.uint32), *(x[2] for x in columns)])
        shared = np.bincount(place, minlength=len(doc))
        prefix = n - -(-NUM * n // DEN) + 1
        keep = (n - shared < prefix)[place]
        token, place, count = token[keep], place[keep], count[keep]
        order = np.lexsort((token, count, place))
        token, place, count = token[order], place[order], count[order]
        edges = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1], [True]))) if len(place) else np.zeros(1, np.int64)
        first, ends = edges[:-1], edges[1:]
        pos = np.arange(len(place)) - np.repeat(first, ends - first) + (n - shared)[place]  # shingles of no other document come first
        live = place[first]
        bins = [np.minimum(np.bincount((token[a:b] >> _U(58)).astype(np.int64), minlength=BINS), 65535).astype(np.uint16).tobytes() for a, b in zip(first.tolist(), ends.tolist(), strict=True)]
        docs = pd.DataFrame({"a": doc[live], "digest": digest[live], "n": n[live], "tokens": [token[a:b].tobytes() for a, b in zip(first.tolist(), ends.tolist(), strict=True)], "bins": bins}, columns=["a", "digest", "n", "token", "count", "pos", "tokens", "bins"])
        use = pos < prefix[place]
        token, place, count, pos = token[use], place[use], count[use].astype(np.int64), pos[use]
        if (count > hot).any():
            token, place, count, pos = _in_cells(token, place, count, pos, hot, digest)
        entries = pd.DataFrame({"a": doc[place], "digest": digest[place], "n": n[place], "token": token.view(np.int64), "count": count, "pos": pos}, columns=docs.columns)
        kinds = {"token": "Int64", "count": "Int64", "pos": "Int64"}
        return pd.concat([docs.astype(kinds), entries.astype(kinds)]) if len(docs) and len(entries) else (entries if len(entries) else docs).astype(kinds)

    return run


def _in_cells(token: np.ndarray, place: np.ndarray, count: np.ndarray, pos: np.ndarray, hot: int, digest: np.ndarray) -> tuple[np.ndarray, ...]:
    """Shingles of extreme frequency as one token for each cell of the document's row and column in a triangle of cells: any two documents share one."""
    plain = count <= hot
    tokens, places, counts, positions = [token[plain]], [place[plain]], [count[plain]], [pos[plain]]
    for t, d, c, p in zip(token[~plain], place[~plain].tolist(), (-(-count[~plain] // hot)).tolist(), pos[~plain].tolist(), strict=True):
        own = int(digest[d]) % c
        other = np.arange(c)
        cell = np.minimum(own, other) * c + np.maximum(own, other) + 1
        tokens.append(hashing.finalise(t + cell.astype(_U) * _U(0x9E3779B97F4A7C15)))
        places.append(np.full(c, d))
        counts.append(np.full(c, hot))
        positions.append(np.full(c, p))
    return tuple(map(np.concatenate, (tokens, places, counts, positions)))


def _allowed(na, pa_, nb, pb) -> np.ndarray:
    """The length and positional filters at a common shingle."""
    shorter, longer = np.minimum(na, nb), np.maximum(na, nb)
    return (DEN * shorter >= NUM * longer) & (np.minimum(na - pa_, nb - pb) >= _least_overlap(na + nb))


def _pairs(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    x = np.stack([np.maximum(a, b), np.minimum(a, b)], 1)
    x = np.unique(x[x[:, 0] != x[:, 1]], axis=0) if len(x) else x
    return pd.DataFrame({"a": x[:, 0], "b": x[:, 1]})


def _meet(pdf: pd.DataFrame) -> pd.DataFrame:
    """All allowed pairs of the shingles of a block, of up to GROUP documents each."""
    token, doc, digest, n, pos = (pdf[c].to_numpy() for c in ("token", "a", "digest", "n", "pos"))
    order = np.lexsort((doc, digest, token))
    token, doc, digest, n, pos = (x[order] for x in (token, doc, digest, n, pos))
    keep = np.concatenate(([True], (token[1:] != token[:-1]) | (digest[1:] != digest[:-1])))  # equal sets: the least id stands for all
    token, doc, n, pos = (x[keep] for x in (token, doc, n, pos))
    found = [np.zeros((2, 0), np.int64)]
    for d in range(1, len(token)):
        i = np.flatnonzero(token[:-d] == token[d:])
        if not len(i):
            break
        i = i[_allowed(n[i], pos[i], n[i + d], pos[i + d])]
        found.append(np.stack([doc[i], doc[i + d]]))
    return _pairs(*np.concatenate(found, axis=1))


def _bounded(na, nb, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The suffix filter: whether the intersection, bounded from above by counts in hash ranges, may be large enough."""
    least = np.minimum(a, b)
    return (least.sum(1, dtype=np.int64) >= _least_overlap(na + nb)) | (least == 65535).any(1)


def _best(a: np.ndarray, b: np.ndarray, closeness: np.ndarray, most: int) -> np.ndarray:
    """Whether a pair is one of the closest of either of its sides."""
    ok = np.zeros(len(a), bool)
    for x in (a, b):
        order = np.lexsort((-closeness, x))
        first = np.flatnonzero(np.concatenate(([True], x[order][1:] != x[order][:-1])))
        rank = np.arange(len(x)) - np.repeat(first, np.diff(np.append(first, len(x))))
        ok[order] |= rank < most
    return ok


def _all_pairs(most: int | None):
    """Allowed pairs of some squares of large groups between different components, of two sides or within one: each document's closest ones, or all."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        known = pdf["bins"].notna()
        docs = pdf[known].sort_values("a")
        ids, first = np.unique(docs["a"].to_numpy(np.int64), return_index=True)
        sizes = np.minimum.reduceat(docs["n"].to_numpy(np.int64), first)  # of sets that share an id, what lets every pair of theirs pass
        bins = np.maximum.reduceat(np.frombuffer(b"".join(docs["bins"]), np.uint16).reshape(-1, BINS), first)
        pdf = pdf[~known]
        _, square = np.unique(np.stack([pdf[c].to_numpy(np.int64) for c in ("token", "row", "column")]), axis=1, return_inverse=True)
        doc, comp, n, pos, side, cross = (pdf[c].to_numpy() for c in ("a", "component", "n", "pos", "side", "cross"))
        order = np.lexsort((n, square))
        square, doc, comp, n, pos, side, cross = (x[order] for x in (square, doc, comp, n, pos, side, cross))
        at = np.searchsorted(ids, doc)

        def passed(pairs: list[np.ndarray]) -> np.ndarray:
            x = np.unique(np.concatenate(pairs))
            cut = [(y, y // len(ids), y % len(ids)) for y in np.array_split(x, 1 + (len(x) >> 16))]
            return np.concatenate([y[_bounded(sizes[a], sizes[b], bins[a], bins[b])] for y, a, b in cut])

        out, held = [np.zeros(0, np.int64)], 0  # pairs as the places of their documents in one number
        i = np.arange(len(doc))
        for d in range(1, len(doc)):
            i = i[: np.searchsorted(i, len(doc) - d)]
            i = i[(square[i] == square[i + d]) & (n[i] * DEN >= NUM * n[i + d])]  # sorted by size: what is further off is longer yet
            if not len(i):
                break
            ok = i[(comp[i] != comp[i + d]) & ((side[i] != side[i + d]) | ~cross[i]) & _allowed(n[i], pos[i], n[i + d], pos[i + d])]
            out.append(np.maximum(at[ok], at[ok + d]) * len(ids) + np.minimum(at[ok], at[ok + d]))
            held += len(ok)
            if held > SQUARE * SQUARE:
                out, held = [passed(out)], 0
        found = passed(out)
        a, b = found // len(ids), found % len(ids)
        if most is not None and len(found):
            parts = np.array_split(np.arange(len(a)), 1 + (len(a) >> 16))
            common = np.concatenate([np.minimum(bins[a[x]], bins[b[x]]).sum(1, dtype=np.int64) for x in parts])
            best = _best(a, b, common / (sizes[a] + sizes[b]), most)
            a, b = a[best], b[best]
        return _pairs(ids[a], ids[b])

    return run


def _suffix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose intersection, bounded from above by their counts in hash ranges, may be large enough."""
    for batch in batches:
        if not batch.num_rows:
            continue
        na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, BINS) for c in ("bins_a", "bins_b"))
        yield batch.filter(pa.array(_bounded(na, nb, a, b))).select(["a", "b"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that are similar by their sizes and shared shingles."""
    for batch in batches:
        ok = []
        for na, nb, x, y in zip(batch.column("na").to_pylist(), batch.column("nb").to_pylist(), batch.column("tokens_a"), batch.column("tokens_b"), strict=True):
            x, y = (np.frombuffer(t.as_buffer(), np.uint64) for t in (x, y))
            common = int(np.isin(x, y, assume_unique=True).sum())
            ok.append(common > 0 and DEN * common >= NUM * (na + nb - common))
        yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _links(pairs: DataFrame, live: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar. Shingles travel for pairs that pass the suffix filter only."""

    def side(name: str, *columns: str) -> DataFrame:
        return live.select(F.col("a").alias(name), F.col("n").alias(f"n{name}"), *(F.col(c).alias(f"{c}_{name}") for c in columns))

    near = pairs.join(side("a", "bins"), "a").join(side("b", "bins"), "b").select("a", "b", "na", "nb", "bins_a", "bins_b").mapInArrow(_suffix, "a long, b long")
    return near.join(side("b", "tokens"), "b").join(side("a", "tokens"), "a").select("a", "b", "na", "nb", "tokens_a", "tokens_b").mapInArrow(_verify, "a long, b long").distinct()


def _merge(links: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is not None:
        links = links.union(labels.select(F.col("node").alias("a"), F.col("component").alias("b")))
    return components(links)


def _pivot_pairs(spots: DataFrame, labels: DataFrame, pivots: int) -> DataFrame:
    """Members of large groups paired with some of their group, where components differ and sizes allow it.

    Pivots are those of least hash under several seeds, found by minima of parts of
    a group, so that no group is gathered; as groups of near copies share most
    members, they share most pivots.
    """
    own = _lettered(spots, labels)
    names = [f"p{s}" for s in range(pivots)]
    seeds = [F.min(F.struct(F.xxhash64(F.col("a"), F.lit(s)).alias("rank"), F.col("a").alias("p"), F.col("component").alias("pc"), F.col("n").alias("pn"))).alias(x) for s, x in enumerate(names)]
    parts = own.groupBy("token", F.pmod(F.xxhash64("a"), F.lit(PARTS)).alias("part")).agg(*seeds, F.min("component").alias("low"), F.max("component").alias("high"))
    chosen = parts.groupBy("token").agg(*(F.min(x).alias(x) for x in names), F.min("low").alias("low"), F.max("high").alias("high")).where("low != high")
    chosen = materialise(chosen.select("token", F.array_distinct(F.transform(F.array(*names), lambda x: x.dropFields("rank"))).alias("pivots")), "pivots")
    near = f"filter(pivots, x -> x.pc != component AND {DEN} * least(n, x.pn) >= {NUM} * greatest(n, x.pn))"
    met = own.join(chosen, "token").select("a", F.explode(F.expr(near)).alias("x")).select("a", "x.p")
    return met.select(F.greatest("a", "p").alias("a"), F.least("a", "p").alias("b")).where("a != b").distinct()


def _lettered(members: DataFrame, labels: DataFrame) -> DataFrame:
    return members.join(labels.withColumnRenamed("node", "a"), "a", "left").withColumn("component", F.coalesce("component", "a"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The members of large groups among a batch's documents, those of one shingle and component in one row."""
    kind = pa.struct([("a", pa.int64()), ("n", pa.int64()), ("pos", pa.int32())])
    for batch in batches:
        spots = batch.column("spots")
        row = np.repeat(np.arange(len(spots)), spots.value_lengths().to_numpy())
        if not len(row):
            continue
        token, pos = (spots.flatten().field(i).to_numpy() for i in (0, 1))
        doc, n, component = (batch.column(c).to_numpy()[row] for c in ("a", "n", "component"))
        order = np.lexsort((component, token))
        token, component = token[order], component[order]
        first = np.flatnonzero(np.concatenate(([True], (token[1:] != token[:-1]) | (component[1:] != component[:-1]))))
        members = pa.StructArray.from_arrays([pa.array(x[order], f.type) for x, f in zip((doc, n, pos), kind, strict=True)], fields=list(kind))
        yield pa.RecordBatch.from_arrays([pa.array(token[first]), pa.array(component[first]), pa.ListArray.from_arrays(pa.array([*first, len(order)], pa.int32()), members)], ["token", "component", "members"])


def _square_pairs(members: DataFrame, live: DataFrame, labels: DataFrame, most: int | None) -> DataFrame:
    """Allowed pairs of large groups between different components, by squares of at most about 2 * SQUARE members; for each document and block the ``most`` closest, or all.

    Labels are joined to documents, and documents of one component lie side by side
    when their shingles are gathered, so a group that is all in one component, as
    most are by then, is a few rows, and its members are not dealt out. Pairs pass the suffix filter before they leave their task, so that of a group
    only those are formed that are similar or nearly so.
    """
    near = _lettered(members, labels).select("a", "n", "spots", "component").repartitionByRange("component", "a").sortWithinPartitions("component", "a")
    runs = materialise(near.mapInArrow(_runs, "token long, component long, members array<struct<a: long, n: long, pos: int>>"), "runs")
    cells = runs.groupBy("token").agg(F.sum(F.size("members")).alias("size"), F.min("component").alias("low"), F.max("component").alias("high")).where("low != high")
    cells = materialise(cells.select("token", "size", F.ceil(F.col("size") / SQUARE).cast("int").alias("cells")), "cells")
    own = runs.join(cells.drop("size"), "token").select("token", "component", "cells", F.inline("members"))
    own = own.withColumn("side", F.pmod(F.xxhash64("a"), F.col("cells")).cast("int"))
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    own = own.select("token", "a", "n", "pos", "component", "side", F.least("side", "other").alias("row"), F.greatest("side", "other").alias("column"))
    own = own.withColumn("cross", F.col("row") != F.col("column"))
    rows = cells.agg(F.coalesce(F.sum(F.col("size") * F.col("cells")), F.lit(0))).first()[0]
    own = own.withColumn("block", F.pmod(F.xxhash64("token", "row", "column"), F.lit(max(1, rows // (20 * SQUARE)))))
    docs = own.select("block", "a").distinct().join(live.select("a", "n", "bins"), "a")
    columns = ["block", "a", "n", "bins", "token", "pos", "component", "side", "row", "column", "cross"]
    both = own.withColumn("bins", F.lit(None).cast("binary")).select(columns).union(docs.select(*columns[:4], *(F.lit(0).cast(own.schema[c].dataType) for c in columns[4:])))
    return both.groupBy("block").applyInPandas(_all_pairs(most), "a long, b long").distinct()


def _tie_groups(members: DataFrame, live: DataFrame, pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """labels, merged by all links between members (a, n, largest, other, spots of token and pos) of large groups. Pairs that were verified before are left out.

    Pivots tie what is much alike. Then each document is held against its closest ones
    of other components, and at last whatever is still apart is paired out. For the
    pivots each document stands in two of its groups only, its largest and a random
    one; that only decides how much is tied before the rest is paired out in all groups.
    """
    spots = materialise(members.select("a", "n", F.explode(F.array_distinct(F.array("largest", "other"))).alias("token")), "spots")
    seen = [pairs]
    for more in (lambda: _pivot_pairs(spots, labels, PIVOTS), lambda: _square_pairs(members, live, labels, CLOSEST), lambda: _square_pairs(members, live, labels, None)):
        seen.append(materialise(more().join(reduce(DataFrame.union, seen), ["a", "b"], "left_anti"), "more"))
        found = materialise(_links(seen[-1], live), "links")
        if found.limit(1).count():
            merged = _merge(found, labels)
            discard(labels)
            labels = merged
        discard(found)
    for x in [*seen[1:], spots]:
        discard(x)
    return labels


def similarity_components(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id of every row, for shingles of that many words and a similarity of NUM / DEN or more.

    Texts without words, empty and null ones have no shingles and are linked with
    nothing. Rows that share an id are one node. Rows without an id are linked
    with nothing and have no component. Other columns are ignored; an empty
    table gives no rows.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    survey = materialise(source.mapInArrow(_survey(words), "doc_id long, n long, d1 long, d2 long, chunk int, part int, counts binary"), "survey")
    thin = survey.where("n is not null").select("doc_id", "n", "d1", "d2")
    parts = survey.where("chunk is not null").select("chunk", "part", "counts")
    n_parts = (parts.agg(F.max("part")).first()[0] or 0) + 1
    total = thin.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    sketch = spark.sparkContext.broadcast(_sketch(parts, n_parts))
    blocks = max(shuffle_partitions(spark), -(-total // BLOCK))
    hot = CELL + 4 * (total >> SKETCH_BITS)
    counted = source.mapInArrow(_sent(words, sketch, blocks, hot), "block int, part long, payload binary").groupBy("block").applyInPandas(_counted, "part long, payload binary")
    chosen = materialise(counted.groupBy("part").applyInPandas(_chosen(hot), _LIVE), "live")
    sketch.destroy()
    live = chosen.where("tokens is not null").select("a", "n", "tokens", "bins")
    entries = chosen.where("token is not null").select("token", "a", "digest", "n", "pos", "count")
    block = F.pmod(F.col("token"), F.lit(max(shuffle_partitions(spark), -(-total // 4 // BLOCK)))).alias("block")
    pairs = materialise(entries.where(F.col("count") <= GROUP).groupBy(block).applyInPandas(_meet, "a long, b long").distinct(), "pairs")
    labels = _merge(_links(pairs, live), None)
    members = entries.where(F.col("count") > GROUP).groupBy("token", "count", "digest").agg(F.min(F.struct("a", "n", "pos")).alias("x"))
    members = members.select("token", "count", "x.*").groupBy("a", "n").agg(F.max_by("token", F.struct("count", "token")).alias("largest"), F.max_by("token", F.xxhash64("token")).alias("other"), F.collect_list(F.struct("token", "pos")).alias("spots"))
    members = materialise(members, "members")
    labels = _tie_groups(members, live, pairs, labels)
    linked = F.coalesce((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.lit(False))
    classes = materialise(thin.where(linked).groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("rows")), "classes")
    placed = join_groups(thin.where(linked), classes, ["d1", "d2"], "rows").select("doc_id", "n", "rep")
    placed = placed.union(thin.where(~linked).select("doc_id", "n", F.lit(None).cast("long")))
    shared = placed.where("rep is not null").groupBy("doc_id").agg(F.min("rep").alias("x"), F.max("rep").alias("y")).where("x != y").select("doc_id")
    if shared.limit(1).count():
        ties = placed.join(shared, "doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
        tied = _merge(ties.where("b is not null"), labels)
        discard(labels)
        labels = tied
    named = placed.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    out = materialise(named.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id")), "similar")
    for x in (survey, chosen, pairs, members, labels, classes):
        discard(x)
    return out
