"""Token-id output in training order.

Texts are encoded once, in short pieces that begin at spaces, ended by an end id and cut into sequences of fixed length.
A sequence's number is its partition's and its place there; a keyed Feistel
permutation with cycle-walking moves the numbers about their whole range, a
bijection that needs no sort, no table and no count made beforehand. Ranges of
permuted numbers are shards: each is written in that order as a file of fixed
stride, and the shards' sizes, added up, give every sequence its global slot. So a
reader finds any slot by the index of shards and arithmetic, reads on sequentially
and can resume anywhere. A shard depends on its range alone and is put in place by
a rename, so tasks may be run again.
"""

from __future__ import annotations

import hashlib
import uuid
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import bound_batches, materialise, scratch_root

LENGTH, SHARD = 256, 1 << 16
KEY, ROUNDS = 0x5DEECE66D1CE4E5B, 4
END, PAD = 2, 0
#: The model's sign for a space; characters of a piece of text, to the next space.
MARK, PIECE = "▁", 128
#: Numbers that each partition has for its sequences.
EACH = 1 << 32
#: Bytes of sequences gathered in a task before they are sent out.
HELD = 16 << 20


def permute(x: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """Slots of the numbers x < n: a balanced Feistel network on the least even number of bits, walked until below n."""
    half = max(1, -(-max(1, (n - 1).bit_length()) // 2))
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = np.frombuffer(hashlib.blake2b(key.to_bytes(16, "little"), digest_size=8 * ROUNDS).digest(), np.uint64)

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> shift, v & mask
        for k in keys:
            f = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f >> np.uint64(32)) & mask)
        return (left << shift) | right

    out = once(np.asarray(x, np.uint64))
    while len(outside := np.flatnonzero(out >= np.uint64(n))):
        out[outside] = once(out[outside])
    return out


_models: dict = {}


def _library(model: bytes):
    """One library object for each model and worker process."""
    import sentencepiece

    key = hashlib.sha256(model).digest()
    if key not in _models:
        _models.clear()
        _models[key] = sentencepiece.SentencePieceProcessor(model_proto=model)
        if _models[key].vocab_size() > 1 << 16:
            raise ValueError("ids are written as 16 bits")
    return _models[key]


def _apart(library) -> bool:
    """Whether the library leaves texts as they are and no piece of the model joins a character to a space behind it.

    Nothing is then merged across a space behind a character, and the library puts a
    space before each text: what follows such a space is encoded by itself, without it.
    """
    odd = "  a  b\u00a0\uff43e\u0301 \u0301\t\n "
    ids = library.encode(odd)
    if library.decode(ids) != odd or "".join(map(library.id_to_piece, library.encode(" a  b "))) != f"{MARK * 2}a{MARK * 2}b{MARK}":
        return False
    return not any(MARK in library.id_to_piece(i).lstrip(MARK) for i in range(library.vocab_size()))


def _pieces(text: str) -> list[str]:
    """The text cut at spaces that stand behind a character and before another one, further spaces aside; these spaces are left out."""
    out, first, end = [], 0, len(text.rstrip(" "))
    at = text.find(" ", PIECE, end)
    while at > 0:
        if text[at - 1] in (" ", MARK):
            at = text.find(" ", at + 1, end)
        else:
            out.append(text[first:at])
            first = at + 1
            at = text.find(" ", first + PIECE, end)
    out.append(text[first:])
    return out


def _tokens(library, apart: bool, texts: list[str | None]) -> Iterator[np.ndarray]:
    """Ids of texts with the end id, as the library gives them. Its time grows faster than a text, so pieces take less."""
    cut = [_pieces(t or "") if apart else [t or ""] for t in texts]
    ids = library.encode(list(chain.from_iterable(cut)), num_threads=1)
    at = 0
    for c in cut:
        own = array("H", chain.from_iterable(ids[at : at + len(c)]))
        own.append(END)
        at += len(c)
        yield np.frombuffer(own, np.uint16)


def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def _sequences(model: bytes, length: int, parts: int, width: int, key: int):
    names = ["shard", "n", "slots", "docs", "known", "sizes", "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() * EACH
        docs, known, sizes, rows, held = [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal number
            data = np.concatenate(rows)
            n = len(data)
            slots = permute(np.arange(number, number + n, dtype=np.uint64), parts * EACH, key).astype(np.int64)
            number += n
            where = slots // width
            order = np.argsort(slots)
            bounds = np.flatnonzero(np.concatenate(([True], where[order][1:] != where[order][:-1], [True])))
            doc, given, size = np.array(docs, np.int64), np.array(known, bool), np.array(sizes, np.int32)
            out = [(int(where[order[a]]), int(b - a), *(x[order[a:b]].tobytes() for x in (slots, doc, given, size)), _planes(data[order[a:b]].reshape(-1))) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            for x in (docs, known, sizes, rows):
                x.clear()
            types = [pa.int64(), pa.int64(), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

        library = _library(model)
        apart = _apart(library)
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                for doc, t in zip(part.column(0).to_pylist(), _tokens(library, apart, part.column(1).to_pylist()), strict=True):
                    n = -(-len(t) // length)
                    cut = np.full(n * length, PAD, np.uint16)
                    cut[: len(t)] = t
                    rows.append(cut.reshape(n, length))
                    docs += [doc or 0] * n
                    known += [doc is not None] * n
                    sizes += [length] * (n - 1) + [len(t) - (n - 1) * length]
                    held += n * length * 2
                if held > HELD:
                    yield flush()
                    held = 0
        if rows:
            yield flush()

    return run


def write_training_order(docs: DataFrame, model_path: str, out: str | None = None, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH, shard: int = SHARD, key: int = KEY) -> DataFrame:
    """Write shards of about that many sequences below out (a URI all executors share; by default in the scratch folder), with their index, and return shard, place, slot, doc_id, n_tokens, path, stride of every sequence.

    The order is the same whenever the table falls into the same partitions. A null
    or empty text is a sequence with the end id alone; a null id is returned as
    null, a negative one as it is. Rows are kept one to one, equal ids included;
    other columns are ignored; an empty table writes no shard.
    """
    with open(model_path, "rb") as f:
        model = f.read()
    spark = docs.sparkSession
    out = out or f"{scratch_root(spark)}/order-{uuid.uuid4().hex}"
    bound_batches(spark)
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    guess = source.agg(F.count(F.lit(1)) + F.coalesce(F.sum(F.octet_length("text")), F.lit(0)) / (4 * length)).first()[0]  # only sizes the shards
    parts = max(1, source.rdd.getNumPartitions())
    width = -(-parts * EACH // max(1, -(-int(guess) // shard)))
    stride = length * 2

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs

        slots, doc, known, size = (np.frombuffer(b"".join(pdf[c]), t) for c, t in (("slots", np.int64), ("docs", np.int64), ("known", bool), ("sizes", np.int32)))
        data = np.concatenate([np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(2, -1).T).view(np.uint16).reshape(-1, length) for b in pdf["data"]])
        number = int(pdf["shard"].iloc[0])
        order = np.argsort(slots)
        if (np.diff(slots[order]) < 1).any():
            raise RuntimeError(f"shard {number} holds a sequence twice")
        name = f"shard-{number:08d}.bin"
        files, folder = fs.FileSystem.from_uri(out)
        files.create_dir(folder, recursive=True)
        with files.open_output_stream(draft := f"{folder}/.{name}.{uuid.uuid4().hex}") as f:
            for i in range(0, len(order), 4096):
                f.write(data[order[i : i + 4096]].tobytes())
        files.move(draft, f"{folder}/{name}")
        return pd.DataFrame({"shard": number, "place": np.arange(len(order)), "doc_id": pd.Series(doc[order], dtype="Int64").where(known[order]), "n_tokens": size[order].astype(np.int64), "path": f"{out}/{name}"})

    blocks = source.mapInArrow(_sequences(model, length, parts, width, key), "shard long, n long, slots binary, docs binary, known binary, sizes binary, data binary")
    written = materialise(blocks.groupBy("shard").applyInPandas(write, "shard long, place long, doc_id long, n_tokens long, path string"), "order")
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    index = written.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.first("path").alias("path"))  # a row a shard
    index.select("shard", "n", F.coalesce(before, F.lit(0)).alias("first"), "path").write.mode("overwrite").parquet(f"{out}/index")
    firsts = spark.read.schema("shard long, n long, first long, path string").parquet(f"{out}/index").select("shard", "first")
    slot = (F.col("first") + F.col("place")).alias("slot")
    return written.join(firsts, "shard").select("shard", "place", slot, "doc_id", "n_tokens", "path", F.lit(stride).alias("stride"))


def read_slots(out: str, first: int, n: int, length: int = LENGTH) -> np.ndarray:
    """The sequences of slots first..first+n-1, read from their shards by offset."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    files, folder = fs.FileSystem.from_uri(out)
    rows = pq.read_table(f"{folder}/index", filesystem=files).sort_by("first").to_pylist()
    parts = []
    for row in rows:
        at, end = max(first, row["first"]), min(first + n, row["first"] + row["n"])
        if at < end:
            with files.open_input_file(f"{folder}/{row['path'].rpartition('/')[2]}") as f:
                f.seek((at - row["first"]) * length * 2)
                parts.append(np.frombuffer(f.read((end - at) * length * 2), np.uint16).reshape(-1, length))
    return np.concatenate(parts) if parts else np.zeros((0, length), np.uint16)
