"""NumPy views of Arrow text batches, shared by the operators of this subpackage.

A *slice* is a run of rows whose UTF-8 bytes lie in one buffer. Slices hold at most
about ``max_bytes`` of text. A longer document is a slice of its own; what needs many
times its bytes (hashes, suffixes) walks it in pieces, so that only a few byte masks and
the words' offsets grow with the longest document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space of the contracts: space and \t \n \v \f \r. Fixed values.
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

SLICE_BYTES = 512 << 10
#: Text of a long document that is hashed at once.
PIECE_BYTES = 512 << 10

_U = np.uint64


def byte_mask(members) -> np.ndarray:
    """A 256-entry truth table over byte values."""
    table = np.zeros(256, dtype=bool)
    table[list(members)] = True
    return table


IS_SPACE = byte_mask(SPACE_BYTES)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words (the public splitmix64 constants)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = _U(base), _U(pow(base, -1, 1 << 64))
        self._up = self._down = np.ones(1, dtype=_U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._up) < n:
            size = max(n, 2 * len(self._up))
            for name, base in (("_up", self.base), ("_down", self.inverse)):
                steps = np.full(size, base, dtype=_U)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))
        return self._up[:n], self._down[:n]


#: Two independent rolling hashes; both together give 128 bits.
POWERS = (Powers(0x9E3779B97F4A7C15), Powers(0xD1342543DE82EF95))
_BYTE_CODES = tuple(mix64(np.arange(256, dtype=_U) + _U(seed)) for seed in (0x5851F42D, 0x14057B7E))


@dataclass
class Rolling:
    """Prefix sums from which the hash of any span comes in constant time."""

    prefix: np.ndarray
    down: np.ndarray

    @classmethod
    def over(cls, codes: np.ndarray, which: int = 0) -> Rolling:
        up, down = POWERS[which].upto(len(codes) + 1)
        prefix = np.zeros(len(codes) + 1, dtype=_U)
        np.cumsum(codes * up[: len(codes)], out=prefix[1:])
        return cls(prefix, down)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the spans [start, end); equal content, equal hash."""
        return mix64((self.prefix[end] - self.prefix[start]) * self.down[start])

    def windows(self, length: int) -> np.ndarray:
        """Hashes of all windows of this length, by start."""
        n = len(self.prefix) - length
        if n <= 0:
            return np.zeros(0, dtype=_U)
        return mix64((self.prefix[length:] - self.prefix[:n]) * self.down[:n])


@dataclass
class Slice:
    """Rows [first, first + n) of a batch: their bytes and byte offsets."""

    first: int
    data: np.ndarray
    off: np.ndarray

    @property
    def n(self) -> int:
        return len(self.off) - 1

    def rolling(self, which: int = 0) -> Rolling:
        return Rolling.over(_BYTE_CODES[which][self.data], which)

    def text(self, row: int) -> str:
        return self.data[self.off[row] : self.off[row + 1]].tobytes().decode("utf-8", "replace")

    def raw(self, row: int) -> bytes:
        return self.data[self.off[row] : self.off[row + 1]].tobytes()

    def words(self) -> Words:
        """Maximal runs of bytes outside SPACE_BYTES, not crossing rows."""
        full = ~IS_SPACE[self.data]
        start, end = runs(full, self.off)
        return Words(start, end, np.searchsorted(start, self.off))

    def span_codes(self, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
        """Hashes of ascending disjoint byte spans, some pieces of the text at a time."""
        out = np.empty(len(start), dtype=_U)
        lo = 0
        while lo < len(start):
            hi = max(lo + 1, int(np.searchsorted(end, start[lo] + PIECE_BYTES, side="right")))
            a, b = int(start[lo]), int(end[hi - 1])
            out[lo:hi] = Rolling.over(_BYTE_CODES[which][self.data[a:b]], which).spans(start[lo:hi] - a, end[lo:hi] - a)
            lo = hi
        return out

    def pieces(self, width: int) -> Iterator[tuple[Slice, int]]:
        """(piece, offset): the slice itself, or the parts of a long row that share ``width`` - 1
        bytes with the next, so that every window of that width lies in exactly one."""
        if self.n > 1 or len(self.data) <= 2 * PIECE_BYTES:
            yield self, 0
            return
        for lo in range(0, max(1, len(self.data) - width + 1), PIECE_BYTES):
            data = self.data[lo : lo + PIECE_BYTES + width - 1]
            yield Slice(self.first, data, np.array([0, len(data)])), lo


@dataclass
class Words:
    """Byte spans of the words of a slice; the words of row r are [row[r], row[r + 1])."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.row)

    def owner(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.row) - 1), self.counts())

    def room(self, length: int) -> np.ndarray:
        """Which words start a window of this many words inside their row."""
        last = np.repeat(self.row[1:], self.counts()) - length
        return np.arange(len(self.start)) <= last


def runs(mask: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal true runs of mask, cut at row borders."""
    n = len(mask)
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = mask[:-1]
    borders = off[:-1][off[:-1] < n]
    before[borders] = False
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = mask[1:]
    borders = off[1:][off[1:] > 0]
    after[borders - 1] = False
    return np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1


def merged(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """The distinct positions (0 to most) of two arrays, ascending."""
    marks = np.zeros(most + 1, dtype=bool)
    marks[a] = True
    marks[b] = True
    return np.flatnonzero(marks)


def slices(batch: pa.RecordBatch, column: str = "text", max_bytes: int = SLICE_BYTES) -> Iterator[Slice]:
    """The rows of a batch as slices, in order; null texts are empty."""
    col = batch.column(batch.schema.get_field_index(column))
    if col.null_count:
        col = pc.fill_null(col.cast(pa.string()) if pa.types.is_null(col.type) else col, "")
    n = len(col)
    if not n:
        return
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, values = col.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(values, dtype=np.uint8) if values is not None else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + max_bytes, side="right")) - 1)
        hi = min(hi, n)
        yield Slice(lo, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        lo = hi


def window_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, by start, by doubling."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    best, have = values, 1
    while 2 * have <= width:
        best = np.minimum(best[: len(best) - have], best[have:])
        have *= 2
    return np.minimum(best[:n], best[width - have : width - have + n])


def code_points(data: np.ndarray) -> np.ndarray:
    """Number of code points before each byte position (length n + 1)."""
    out = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out

