"""Lists of numbers packed by document, and the pairs of numbers that enough lists share."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

#: Elements that are counted at once, and occurrences of topics that are looked at together, about.
BLOCK, SPAN = 1 << 21, 1 << 19
#: Least elements for which a topic is counted in an array of its own.
OWN = 1000
_ZSTD = pa.Codec("zstd", 1)


def give_back() -> None:
    """Give freed memory back to the system: a worker waits for its next task with it otherwise."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def pack(values: np.ndarray) -> bytes:
    """Whole numbers, compressed by planes of their bytes."""
    planes = np.ascontiguousarray(values, "<i4").view(np.uint8).reshape(-1, 4).T
    return len(values).to_bytes(8, "little") + _ZSTD.compress(planes.tobytes(), asbytes=True)


def unpack(packed: memoryview) -> np.ndarray:
    n = int.from_bytes(packed[:8], "little")
    planes = np.frombuffer(_ZSTD.decompress(packed[8:], 4 * n, asbytes=True), np.uint8).reshape(4, n) if n else np.zeros((4, 0), np.uint8)
    return np.ascontiguousarray(planes.T).view("<i4").ravel()


def steps(sizes: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The values of ascending lists less the one before in the list."""
    out = np.diff(values, prepend=0).astype(np.int32)
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    out[starts] = values[starts]
    return out


def summed(sizes: np.ndarray, out: np.ndarray) -> np.ndarray:
    """The values that ``steps`` was given."""
    total = np.cumsum(out, dtype=np.int64)
    before = np.concatenate([[0], total])[np.cumsum(sizes) - sizes]
    return (total - np.repeat(before, sizes)).astype(np.int32)


def packed_documents(codes, first: np.ndarray, most: int):
    """A row for every ``most`` documents: how many, and for each group of numbers the sizes and steps of the documents' lists. Numbers are places among the codes."""
    schema = pa.schema([("docs", pa.int32()), *((f"p{g}", pa.binary()) for g in range(len(first) - 1))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = pd.Index(codes.value)
        for b in batches:
            offsets = b.column(0).offsets.to_numpy()
            number = index.get_indexer(b.column(0).values.to_numpy()[offsets[0] : offsets[-1]])
            doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[number >= 0]
            key = np.sort(doc << 32 | number[number >= 0])
            rows = []
            for start in range(0, len(offsets) - 1, most):
                docs = min(most, len(offsets) - 1 - start)
                own = key[slice(*np.searchsorted(key, [start << 32, (start + docs) << 32]))]
                doc, number = (own >> 32) - start, own & 0xFFFFFFFF
                group = np.searchsorted(first, number, "right") - 1
                row = [docs]
                for g in range(len(first) - 1):
                    sizes = np.bincount(doc[group == g], minlength=docs)
                    row.append(pack(np.concatenate([sizes, steps(sizes, number[group == g] - first[g])])))
                rows.append(row)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


class Square:
    """The documents' lists of two groups of numbers, x and y, as far as a document has both."""

    def __init__(self, same: bool):
        self.same, self.docs, self.x, self.doc, self.sizes, self.y = same, 0, [], [], [], []

    def add(self, docs: int, x: memoryview, y: memoryview) -> None:
        x, y = unpack(x), unpack(y)
        nx, ny = x[:docs].astype(np.int64), y[:docs].astype(np.int64)
        x, y = summed(nx, x[docs:]), summed(ny, y[docs:])
        use = nx > 1 if self.same else (nx > 0) & (ny > 0)
        number = self.docs + np.cumsum(use) - 1
        self.x.append(x[np.repeat(use, nx)])
        self.doc.append(np.repeat(number[use], nx[use]).astype(np.int32))
        self.y.append(y[np.repeat(use, ny)])
        self.sizes.append(ny[use])
        self.docs += int(use.sum())

    def pairs(self, width: int, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """x, y, documents of the pairs that least[x] documents or more share; of the same group those with x < y. y is below width."""
        if not self.docs:
            return
        key = np.concatenate(self.x, dtype=np.int64)
        self.x = []
        key <<= 32
        key |= np.concatenate(self.doc)
        self.doc = []
        key.sort()
        sizes, data = np.concatenate(self.sizes), np.concatenate(self.y)
        self.y = self.sizes = []
        offsets = np.concatenate([[0], np.cumsum(4 * sizes)])
        lists = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        at = 0
        while at < len(key):
            till = int(np.searchsorted(key, (key[min(at + SPAN, len(key)) - 1] >> 32) + 1 << 32))
            yield from self._counted((key[at:till] >> 32).astype(np.int32), (key[at:till] & 0xFFFFFFFF).astype(np.int32), lists, sizes, width, least)
            at = till

        del key, lists, data, offsets
        give_back()

    def _counted(self, xs, docs, lists, sizes, width, least):
        cuts = np.flatnonzero(np.diff(xs, prepend=-1))
        runs = np.diff(cuts, append=len(xs))
        enough = runs >= least[xs[cuts]]
        work = np.add.reduceat(sizes[docs], cuts)
        alone = work >= max(width // 4, OWN)
        for which, count in ((enough & alone, self._alone), (enough & ~alone, self._together)):
            if which.any():
                use = np.repeat(which, runs)
                yield from count(xs[use], docs[use], lists, sizes, width, least)

    @staticmethod
    def _taken(lists: pa.LargeBinaryArray, docs: np.ndarray) -> np.ndarray:
        found = lists.take(pa.array(docs)).buffers()
        return np.frombuffer(found[2], np.int32, np.frombuffer(found[1], np.int64, len(docs) + 1)[-1] // 4)

    def _alone(self, xs, docs, lists, sizes, width, least):
        ends = np.cumsum(sizes[docs])
        block = (ends - 1) // BLOCK
        cuts = np.flatnonzero(np.diff(xs, prepend=-1))
        new = np.zeros(len(xs), bool)
        new[cuts] = True
        parts = np.flatnonzero(new | (np.diff(block, prepend=-1) != 0))
        counts, values, start, now = None, None, 0, -1
        for lo, hi in zip(parts.tolist(), [*parts[1:].tolist(), len(xs)], strict=True):
            if block[lo] != now:
                now = block[lo]
                values = self._taken(lists, docs[lo : np.searchsorted(block, now, "right")])
                start = ends[lo] - sizes[docs[lo]]
            one = np.bincount(values[ends[lo] - sizes[docs[lo]] - start : ends[hi - 1] - start], minlength=width)
            counts = one if new[lo] else counts + one
            if hi == len(xs) or new[hi]:
                x = xs[lo]
                if self.same:
                    counts[: x + 1] = 0
                found = np.flatnonzero(counts >= least[x])
                if len(found):
                    yield np.full(len(found), x, np.int32), found.astype(np.int32), counts[found]

    def _together(self, xs, docs, lists, sizes, width, least):
        bits = max(1, int(width - 1).bit_length())
        cuts = np.flatnonzero(np.diff(xs, prepend=-1))
        work = np.cumsum(np.add.reduceat(sizes[docs], cuts))
        most = 1 << (32 - bits)
        at, ends = 0, np.append(cuts[1:], len(xs))
        while at < len(cuts):
            till = int(np.searchsorted(work, (work[at - 1] if at else 0) + BLOCK, "right"))
            till = min(max(till, at + 1), at + most, len(cuts))
            lo, hi = cuts[at], ends[till - 1]
            place = np.repeat(np.arange(till - at, dtype=np.uint32), ends[at:till] - cuts[at:till])
            key = np.repeat(place << np.uint32(bits), sizes[docs[lo:hi]])
            key |= self._taken(lists, docs[lo:hi]).view(np.uint32)
            key.sort()
            own = xs[cuts[at:till]]
            m = max(1, int(least[own].min()))
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            n = np.diff(starts, append=len(key))
            starts, n = starts[n >= m], n[n >= m]
            x, y = own[(key[starts] >> np.uint32(bits)).astype(np.int64)], (key[starts] & np.uint32((1 << bits) - 1)).astype(np.int32)
            use = n >= least[x]
            if self.same:
                use &= y > x
            if use.any():
                yield x[use], y[use], n[use]
            at = till


def sorted_rows(columns: list[np.ndarray], most: list[int]) -> list[np.ndarray]:
    """Columns of whole numbers from 0 to ``most``, as int64, their rows in order; sorted as one number where it has room for all."""
    bits = [max(1, int(m).bit_length()) for m in most]
    if sum(bits) > 63:
        order = np.lexsort(columns[::-1])
        return [c[order].astype(np.int64) for c in columns]
    key = columns[0].astype(np.int64)
    for c, b in zip(columns[1:], bits[1:], strict=True):
        key <<= b
        key |= c
    key.sort()
    out = []
    for b in bits[:0:-1]:
        out.append(key & ((1 << b) - 1))
        key >>= b
    return [key, *out[::-1]]


def pack_edges(node: np.ndarray, other: np.ndarray, weight: np.ndarray) -> bytes:
    """Edges in order of node and other."""
    cuts = np.flatnonzero(np.diff(node, prepend=-1))
    sizes = np.diff(cuts, append=len(node))
    return pack(np.concatenate([[len(cuts)], np.diff(node[cuts], prepend=0), sizes, steps(sizes, other), weight]))


def unpack_edges(packed: memoryview) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a = unpack(packed)
    k, m = a[0], (len(a) - 1 - 2 * a[0]) // 2
    sizes = a[1 + k : 1 + 2 * k].astype(np.int64)
    return np.repeat(np.cumsum(a[1 : 1 + k], dtype=np.int32), sizes), summed(sizes, a[1 + 2 * k : 1 + 2 * k + m]), a[1 + 2 * k + m :]
