"""SentencePiece BPE encoding and decoding by a merge-type prefix table.

Every prefix of a text has one encoding, hence one last token. The table stores
that token for each prefix: an automaton lists the pieces that end at a
position, and a piece T is the prefix's last token exactly if it is compatible
with U, the last token of the prefix before T, that is if the text U+T alone
encodes to [U, T]. (A boundary is crossed by no merge in the whole text if and
only if it is crossed by none in U+T: merges inside U, inside T and across the
boundary come in the same order in both, since the library always merges the
best pair, leftmost on ties.) The ids are then read off backwards.

Two adjacent characters that stand together in no piece are never merged, so a
text falls into short segments there; the encodings of frequent words are kept
in a bounded table of two generations.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import bound_batches, give_back

SPACE = "▁"
#: Entries of a generation of kept words and of pair tests; longer words are not kept.
WORDS, PAIRS, LONGEST = 300_000, 400_000, 48
_RUNS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


class _Generations(dict):
    """A mapping that computes what it lacks and forgets what was not asked for in two generations."""

    def __init__(self, make, limit: int, longest: int | None = None):
        super().__init__()
        self.make, self.limit, self.longest, self.old = make, limit, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if self.longest is None or len(key) <= self.longest:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class Encoder:
    """Encodes and decodes as the sentencepiece library does, without begin or end ids, for a BPE model of identity normalisation with byte fallback and a dummy prefix."""

    def __init__(self, model: bytes):
        import ahocorasick
        import sentencepiece

        vocabulary = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.score, self.ids, self.byte_ids, self.pieces = {}, {}, {}, []
        self.joined: set[tuple[str, str]] = set()
        automaton = ahocorasick.Automaton()
        for i in range(vocabulary.get_piece_size()):
            piece = vocabulary.id_to_piece(i)
            self.pieces.append(piece)
            if vocabulary.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
            elif not (vocabulary.is_control(i) or vocabulary.is_unknown(i)):
                self.score[piece], self.ids[piece] = vocabulary.get_score(i), i
                self.joined.update(zip(piece, piece[1:], strict=False))
                automaton.add_word(piece, (piece, len(piece)))
        if len(self.byte_ids) != 256:
            raise ValueError("the model has no byte fallback")
        self.id_bytes = {i: b for b, i in self.byte_ids.items()}
        automaton.make_automaton()
        self.automaton = automaton
        self.compatible = _Generations(self._compatible, PAIRS)
        self.segment = _Generations(self._segment, WORDS, LONGEST)
        self.word = _Generations(self._word, WORDS, LONGEST)

    def forget(self) -> None:
        """Empty the tables of frequent words and of pair tests, which a worker process would else hold while it does other things."""
        for table in (self.segment, self.word, self.compatible):
            table.clear()
            table.old = {}
        give_back()

    def _merged(self, text: str) -> list[str]:
        """The merge loop itself; only pairs of pieces come here."""
        symbols, score = list(text), self.score
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                s = score.get(symbols[i] + symbols[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def _compatible(self, pair: tuple[str, str]) -> bool:
        u, t = pair
        return self._merged(u + t) == ([u, t] if u else [t])

    def _segment(self, text: str) -> tuple[list[int], str, str]:
        """(ids, the same in decimal with commas, decoded text) of a run of characters whose neighbours all stand together in some piece."""
        n, compatible = len(text), self.compatible
        last: list[str | None] = [None] * (n + 1)
        last[0] = ""
        at = 0
        for end, (piece, size) in self.automaton.iter(text):
            while at < end:  # no piece was accepted at these ends: the character stands alone
                at += 1
                if last[at] is None:
                    last[at] = text[at - 1]
            if last[end + 1] is None and compatible[last[end + 1 - size], piece]:
                last[end + 1] = piece
        for i in range(at + 1, n + 1):
            if last[i] is None:
                last[i] = text[i - 1]
        out: list[int] = []
        while n:
            piece = last[n]
            n -= len(piece)
            i = self.ids.get(piece)
            if i is None:
                out.extend(self.byte_ids[b] for b in reversed(piece.encode("utf-8", "surrogatepass")))
            else:
                out.append(i)
        out.reverse()
        return out, "".join([f"{i}," for i in out]), self.text_of(out)

    def _segments(self, word: str) -> list[tuple[list[int], str, str]]:
        cut = [i for i, pair in enumerate(zip(word, word[1:], strict=False), 1) if pair not in self.joined]
        if not cut:
            return [self.segment[word]]
        return [self.segment[word[a:b]] for a, b in zip([0, *cut], [*cut, len(word)], strict=True)]

    def _word(self, word: str) -> tuple[str, str, int]:
        found = self._segments(word)
        return "".join([x[1] for x in found]), "".join([x[2] for x in found]), sum([len(x[0]) for x in found])

    def text_of(self, ids: list[int]) -> str:
        """The pieces' text, space marks as spaces; runs of byte pieces are read as UTF-8."""
        out, run = [], bytearray()
        for i in ids:
            if (b := self.id_bytes.get(i)) is not None:
                run.append(b)
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            out.append(self.pieces[i].replace(SPACE, " "))
        if run:
            out.append(run.decode("utf-8", "replace"))
        return "".join(out)

    def _words(self, text: str) -> list[str]:
        """Runs of marks with what follows; before a mark and after other characters nothing is ever merged."""
        return _RUNS.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def encode(self, text: str) -> list[int]:
        return [i for w in self._words(text) for x in self._segments(w) for i in x[0]]

    def decode(self, ids: list[int]) -> str:
        text = self.text_of(ids)
        return text[1:] if text.startswith(" ") else text

    def digest(self, text: str) -> tuple[int, str, str]:
        """(number of ids, the ids in decimal joined by commas, the decoded text)."""
        kept = list(map(self.word.__getitem__, self._words(text)))
        ids, decoded, sizes = ("".join([x[0] for x in kept]), "".join([x[1] for x in kept]), sum([x[2] for x in kept])) if kept else ("", "", 0)
        return sizes, ids[:-1], decoded[1:] if decoded.startswith(" ") else decoded


_encoders: dict[str, Encoder] = {}


def encoder(model: bytes) -> Encoder:
    """One encoder for each model and worker process."""
    give_back()  # what other tasks left
    key = hashlib.sha256(model).hexdigest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(model)
    return _encoders[key]


def read_model(path: str) -> bytes:
    """The model file, read once on the driver; its size does not depend on the data."""
    with open(path, "rb") as f:
        return f.read()


def encode_documents(docs: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and ids (array<int>) of every row; null counts as empty and gives no ids. Rows are kept one to one."""
    bound_batches(docs.sparkSession)
    model = read_model(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(model)
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part = batch.slice(start, 128)
                ids = [e.encode(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])
        e.forget()

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, model_path: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """doc_id and text of every row of ids; null and empty lists give an empty text."""
    model = read_model(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(model)
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part = batch.slice(start, 128)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([e.decode(x or []) for x in part.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select(F.col(id_column).cast("long").alias("doc_id"), F.col(ids_column).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def encoded_with_digests(docs: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, ids (array<int>), n_tokens, ids_sha256, decoded_sha256 of every row, in one pass without a shuffle; null counts as empty."""
    bound_batches(docs.sparkSession)
    model = read_model(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(model)
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part = batch.slice(start, 128)
                found = [e.digest(t or "") for t in part.column(1).to_pylist()]
                sha = [[hashlib.sha256(x[k].encode("utf-8", "surrogatepass")).hexdigest() for x in found] for k in (1, 2)]
                sizes = [x[0] for x in found]
                flat = np.fromstring(",".join([x[1] for x in found if x[0]]), np.int32, sep=",")
                ids = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids, pa.array(sizes, pa.int64()), *map(pa.array, sha)], ["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"])
        e.forget()

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoding_digests(docs: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode and decode every whole text in one pass, without a shuffle."""
    bound_batches(docs.sparkSession)
    model = read_model(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(model)
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part = batch.slice(start, 128)
                found = [e.digest(t or "") for t in part.column(1).to_pylist()]
                sha = [[hashlib.sha256(x[k].encode("utf-8", "surrogatepass")).hexdigest() for x in found] for k in (1, 2)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x[0] for x in found], pa.int64()), *map(pa.array, sha)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        e.forget()

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
