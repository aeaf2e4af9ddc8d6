"""Near-dedup by b-bit MinHash.

1. One pass over the texts gives each document's shingle-set size, digest and
   minima under independent hashes. Of each minimum its low bits are kept, packed;
   every few whole minima make the key of one band.
2. Equal sets are one class. Classes that share a band key are candidates. Their
   similarity is estimated from the packed signatures by a count of equal low bits,
   corrected for chance collisions; what is below any estimate that a similar pair
   may have is dropped.
3. In a first step only a few bands are used, and a bucket's members are held against
   one pivot, its least id. Each member's best candidate is confirmed on the full
   shingle sets. That ties most of a family of near copies at the cost of its size.
4. Of all bands, the buckets are then taken up whose members are still in different
   components. In each of them the members outside its largest component are held
   against all others, in cells of bounded size: under the same estimate, and then by
   bitmaps of the full sets, whose differing bits bound the sets' difference from
   below. What passes is confirmed: each one's best candidate first, then what is
   still apart. So every pair that shares a band is in one component or has been
   held against the other.
5. Components of the confirmed links.

Bands and the least estimate are chosen by the chance (``MISS``) that a pair of just
the similarity asked for is lost at either; more similar pairs are lost yet more
rarely. Sets are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, comb, log

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .base import bound_batches, discard, join_groups, materialise
from .components import components

WORDS = 4
#: Similarity of at least NUM / DEN.
NUM, DEN = 4, 5
#: Chance that a pair of just that similarity shares no band, or has too low an estimate.
MISS = 1e-8
#: Minima of a band; low bits kept of each minimum.
ROWS, BITS = 4, 4
BANDS = 4 * ceil(log(MISS) / log(1 - (NUM / DEN) ** ROWS) / 4)
MINIMA = BANDS * ROWS
#: Bands of the first step; members of one side of a cell; words of the bitmap of ids.
FIRST, SIDE, BITMAP = 6, 1000, 1 << 20
#: Bits of the bitmap of a set.
BITS_OF_SET = 4096
_U = np.uint64
_RNG = np.random.default_rng(4711)
_TIMES = _RNG.integers(0, 1 << 63, (MINIMA, 1), dtype=np.uint64) * _U(2) + _U(1)
_PLUS = _RNG.integers(0, 1 << 63, (MINIMA, 1), dtype=np.uint64)
_MIX = _RNG.integers(0, 1 << 63, (1, ROWS), dtype=np.uint64) * _U(2) + _U(1)
_CHANCE = 2.0**-BITS
_NIBBLES = _U(0x1111111111111111)


def likeness(equal):
    """The similarity that so many equal low parts of MINIMA speak for, less what chance makes equal."""
    return (equal / MINIMA - _CHANCE) / (1 - _CHANCE)


def least_likeness() -> float:
    """The estimate that a pair of similarity NUM / DEN is below with a chance of at most MISS."""
    p, below, equal = _CHANCE + (1 - _CHANCE) * NUM / DEN, 0.0, 0
    while True:
        below += comb(MINIMA, equal) * p**equal * (1 - p) ** (MINIMA - equal)
        if below > MISS:
            return likeness(equal)
        equal += 1


_LEAST = least_likeness() - 1e-12


def _sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    for _, _, data, offsets in hashing.utf8_slices(column):
        h, _, _, rows = hashing.words(data, offsets)
        yield from hashing.shingles(h, rows, words)


def minima(x: np.ndarray) -> np.ndarray:
    """The least value of the set under each hash."""
    out = np.full(MINIMA, ~_U(0))
    for at in range(0, len(x), 512):
        np.minimum(out, (x[at : at + 512] * _TIMES + _PLUS).min(1), out=out)
    return out


def signature(least: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The packed low bits, and the key of each band."""
    low = (least & _U(15)).astype(np.uint8)
    bands = hashing.finalise((least.reshape(BANDS, ROWS) * _MIX).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _MIX[0, 0])
    return (low[0::2] | low[1::2] << 4).tobytes(), bands.view(np.int64)


def equal_parts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many of the parts that are packed into rows of words are equal."""
    x = a ^ b
    x |= x >> _U(2)
    x |= x >> _U(1)
    return MINIMA - np.bitwise_count(x & _NIBBLES).sum(1, dtype=np.int64)


def _words_of(packed: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(packed), np.uint64).reshape(len(packed), -1)


def _survey(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, d1, d2, sig, bands = [], [], [], [], []
            for x in _sets(batch.column(1), words):
                digest = np.frombuffer(xxhash.xxh3_128_digest(x.tobytes()), np.int64)
                packed, keys = signature(minima(x)) if len(x) else (None, None)
                n.append(len(x))
                d1.append(int(digest[0]))
                d2.append(int(digest[1]))
                sig.append(packed)
                bands.append(keys)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "n", "d1", "d2", "sig", "bands"])

    return run


def _estimated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b, likeness of the pairs (a, b, na, nb, sig_a, sig_b) that may be similar by their sizes and signatures."""
    for batch in batches:
        na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
        batch = batch.filter(pa.array(DEN * np.minimum(na, nb) >= NUM * np.maximum(na, nb)))
        if batch.num_rows:
            found = likeness(equal_parts(*(_words_of(batch.column(c).to_pylist()) for c in ("sig_a", "sig_b"))))
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found)], ["a", "b", "likeness"])
            yield out.filter(pa.array(found >= _LEAST))


def _confirmed(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            ok = []
            for i, (b, x) in enumerate(zip(batch.column(1).to_pylist(), _sets(batch.column(2), words), strict=True)):
                text = batch.column(3)[i].as_py()
                if (b, text) != last:  # members of one pivot follow each other
                    last, own = (b, text), next(_sets(pa.array([text], pa.string()), words))
                common = len(np.intersect1d(x, own, assume_unique=True))
                ok.append(common > 0 and DEN * common >= NUM * (len(x) + len(own) - common))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _marked(rows: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """The rows whose column falls on a marked bit of a bitmap of fixed size: those of the wanted values, and few others as long as there are few of these.

    It goes before a join, so that little else is shuffled; a broadcast of BITMAP
    rows at most.
    """
    place, bit = F.expr(f"pmod(xxhash64(`{column}`), {BITMAP}L)"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(`{column}`) div {BITMAP}L, 64) as int))")
    words = wanted.select(place.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    met = rows.withColumn("word", place).join(F.broadcast(words), "word")
    return met.where(F.col("bits").bitwiseAND(bit) != 0).select(rows.columns)


def confirm(pairs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets are similar. Of the texts (id, text) those of the pairs are shuffled."""
    own = _marked(texts, pairs.select(F.explode(F.array("a", "b")).alias("id")), "id")
    met = pairs.join(own.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    met = met.join(own.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    return met.select("a", "b", "text_a", "text_b").mapInArrow(_confirmed(words), "a long, b long")


def _merged(links: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return components(links)
    out = components(links.select("a", "b").union(labels.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    discard(labels)
    return out


def _lettered(rows: DataFrame, labels: DataFrame, column: str, name: str) -> DataFrame:
    return rows.join(labels.select(F.col("node").alias(column), F.col("component").alias(name)), column, "left").withColumn(name, F.coalesce(name, column))


def _best(candidates: DataFrame) -> DataFrame:
    return materialise(candidates.groupBy("a").agg(F.max_by("b", F.struct("likeness", -F.col("b"))).alias("b")), "best")


def _pivot_links(classes: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """Confirmed links (a, b) of each class with the best of the pivots that it meets in the first bands."""
    entries = classes.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sig_a"), F.explode(F.slice("bands", 1, FIRST)).alias("key"))
    buckets = entries.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("a", "na", "sig_a")).alias("p")).where("size > 1")
    buckets = materialise(buckets.select("key", "size", F.col("p.a").alias("b"), F.col("p.na").alias("nb"), F.col("p.sig_a").alias("sig_b")), "buckets")
    met = join_groups(_marked(entries, buckets, "key"), buckets, ["key"], "size").where("a != b").select("a", "b", "na", "nb", "sig_a", "sig_b")
    best = _best(met.mapInArrow(_estimated, "a long, b long, likeness double"))
    links = materialise(confirm(best, texts, words), "links")
    discard(buckets)
    discard(best)
    return links


def _bitmaps(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = []
            for x in _sets(batch.column(1), words):
                bits = np.zeros(BITS_OF_SET, np.uint8)
                bits[(x % _U(BITS_OF_SET)).astype(np.int64)] = 1
                maps.append(np.packbits(bits).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(maps, pa.binary())], ["a", "map"])

    return run


def _may_match(x: np.ndarray, y: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Whether the bits in which two bitmaps differ, at most as many as the sets' elements do, leave room for a similarity of NUM / DEN."""
    return np.bitwise_count(x ^ y).sum(1, dtype=np.int64) * (DEN + NUM) <= total * (DEN - NUM)


def _across(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of some cells of open buckets, the pairs of an outsider and a member of another component that may be similar."""
    _, cell = np.unique(np.stack([pdf[c].to_numpy(np.int64) for c in ("key", "row", "column")]), axis=1, return_inverse=True)
    order = np.lexsort((pdf["outside"].to_numpy(), cell))
    cell = cell[order]
    doc, comp, n, outside = (pdf[c].to_numpy()[order] for c in ("a", "comp", "n", "outside"))
    sig, maps = (_words_of(pdf[c].tolist())[order] for c in ("sig", "map"))
    out = [pd.DataFrame({"a": [], "b": [], "likeness": []}).astype({"a": "int64", "b": "int64"})]
    ends = np.flatnonzero(np.concatenate((cell[1:] != cell[:-1], [True]))) + 1
    for first, end in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
        middle = first + int(np.searchsorted(outside[first:end], True))
        for at in range(middle, end, 256):
            x = np.arange(at, min(at + 256, end))
            fits = (comp[x][:, None] != comp[first:middle]) & (DEN * np.minimum(n[x][:, None], n[first:middle]) >= NUM * np.maximum(n[x][:, None], n[first:middle]))
            i, j = np.nonzero(fits)
            i, j = x[i], j + first
            for part in range(0, len(i), 1 << 14):
                p, q = i[part : part + (1 << 14)], j[part : part + (1 << 14)]
                found = likeness(equal_parts(sig[p], sig[q]))
                p, q, found = p[found >= _LEAST], q[found >= _LEAST], found[found >= _LEAST]
                ok = _may_match(maps[p], maps[q], n[p] + n[q])
                out.append(pd.DataFrame({"a": np.maximum(doc[p], doc[q])[ok], "b": np.minimum(doc[p], doc[q])[ok], "likeness": found[ok]}))
    return pd.concat(out).drop_duplicates()


def _pairs_apart(classes: DataFrame, labels: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """Every pair of classes of different components that shares a band and may be similar, in cells of SIDE outsiders and SIDE members."""
    own = materialise(_lettered(classes.select(F.col("rep").alias("a"), "n", "sig", "bands"), labels, "a", "comp"), "lettered")
    keys = own.select("comp", F.explode("bands").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low != high")
    keys = materialise(keys.select("key", "size"), "open")
    entries = own.select("a", "n", "comp", "sig", F.explode("bands").alias("key"))
    spots = materialise(join_groups(_marked(entries, keys, "key"), keys, ["key"], "size"), "spots")
    parts = spots.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(F.sum("c").alias("size"), F.max(F.struct("c", "comp")).alias("x"))
    deal = lambda c: F.ceil(c / SIDE).cast("int")
    sizes = parts.select("key", "size", F.col("x.comp").alias("largest"), deal(F.col("size")).alias("columns"), deal(F.col("size") - F.col("x.c")).alias("rows"))
    sizes = materialise(sizes, "cells")
    maps = _marked(texts, spots.select(F.col("a").alias("id")), "id").mapInArrow(_bitmaps(words), "a long, map binary")
    met = join_groups(spots.drop("size"), sizes, ["key"], "size").withColumn("spot", F.xxhash64("a"))
    met = materialise(met.join(maps, "a"), "met")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    mine = lambda c: F.pmod("spot", F.col(c)).cast("int")
    members = met.select("key", "a", "n", "comp", "sig", "map", F.lit(False).alias("outside"), every("rows").alias("row"), mine("columns").alias("column"))
    outsiders = met.where("comp != largest").select("key", "a", "n", "comp", "sig", "map", F.lit(True).alias("outside"), mine("rows").alias("row"), every("columns").alias("column"))
    total = sizes.agg(F.coalesce(F.sum(F.col("size") * F.col("rows")), F.lit(0))).first()[0]
    block = F.pmod(F.xxhash64("key", "row", "column"), F.lit(max(1, total // (10 * SIDE)))).alias("block")
    found = materialise(members.union(outsiders).groupBy(block).applyInPandas(_across, "a long, b long, likeness double").distinct(), "across")
    for x in (own, keys, spots, sizes, met):
        discard(x)
    return found


def _settle(candidates: DataFrame, labels: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """labels, merged by all similar candidates (a, b, likeness): each one's best first, then those that are still apart."""
    best = _best(candidates)
    links = materialise(confirm(best, texts, words), "links")
    labels = _merged(links, labels)
    rest = candidates.select("a", "b").join(best, ["a", "b"], "left_anti")
    rest = _lettered(_lettered(rest, labels, "a", "ca"), labels, "b", "cb").where("ca != cb").select("a", "b")
    rest = materialise(rest, "rest")
    if rest.limit(1).count():
        more = materialise(confirm(rest, texts, words), "links")
        labels = _merged(more, labels)
        discard(more)
    for x in (best, links, rest):
        discard(x)
    return labels


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row, for shingles of that many words and a similarity of NUM / DEN or more.

    Texts without words, empty and null ones have no shingles and are linked with
    nothing. Rows that share an id are one node. Rows without an id are linked
    with nothing, have no component and stay (kept). Other columns are ignored; an
    empty table gives no rows.
    """
    bound_batches(docs.sparkSession)
    source = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    survey = materialise(source.mapInArrow(_survey(words), "doc_id long, n long, d1 long, d2 long, sig binary, bands array<long>"), "minima")
    linked = F.coalesce((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.lit(False))
    classes = survey.where(linked).groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "n", "sig", "bands")).alias("x"), F.count(F.lit(1)).alias("rows"))
    classes = materialise(classes.select("d1", "d2", "rows", F.col("x.doc_id").alias("rep"), "x.n", "x.sig", "x.bands"), "classes")
    links = _pivot_links(classes, source, words)
    labels = _merged(links, None)
    across = _pairs_apart(classes, labels, source, words)
    if across.limit(1).count():
        labels = _settle(across, labels, source, words)
    thin = survey.select("doc_id", "n", "d1", "d2")
    placed = join_groups(thin.where(linked), classes.select("d1", "d2", "rep", "rows"), ["d1", "d2"], "rows").select("doc_id", "n", "rep")
    placed = placed.union(thin.where(~linked).select("doc_id", "n", F.lit(None).cast("long")))
    shared = placed.where("rep is not null").groupBy("doc_id").agg(F.min("rep").alias("x"), F.max("rep").alias("y")).where("x != y").select("doc_id")
    if shared.limit(1).count():  # ids of several classes
        labels = _merged(placed.where("rep is not null").join(shared, "doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")), labels)
    named = placed.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    out = named.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    out = materialise(out, "near")
    for x in (survey, classes, links, across, labels):
        discard(x)
    return out
