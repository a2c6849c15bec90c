"""Array helpers for texts inside Spark tasks.

A batch of texts is one byte array with row offsets, as Arrow stores it; everything here is
vectorised over the whole batch, so no Python code runs per word.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import xxhash

#: Odd multipliers of the polynomial and of the finaliser.
POLY = 0x9E3779B97F4A7C15
MIX_1 = 0xBF58476D1CE4E5B9
MIX_2 = 0x94D049BB133111EB

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_libc: list = []


def release() -> None:
    """Give memory that was freed back to the system: Python workers live through many tasks."""
    if not _libc:
        _libc.append(getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0))
    _libc[0](0)


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_2)
    return x ^ (x >> np.uint64(31))


#: Powers that a worker keeps; those of longer texts are made anew.
KEPT_POWERS = 1 << 20


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """POLY**i and its inverse modulo 2**64 for i below n."""

    def made(base: int, size: int) -> np.ndarray:
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        return np.multiply.accumulate(steps, out=steps)

    bases = POLY, pow(POLY, -1, 1 << 64)
    if n > KEPT_POWERS:
        return made(bases[0], n), made(bases[1], n)
    if len(_powers[0]) < n:
        _powers[:] = [made(b, KEPT_POWERS) for b in bases]
    return _powers[0][:n], _powers[1][:n]


#: Longest range whose polynomial hash stands for it: modulo 2**64, regular ranges of a thousand bytes can collide.
LONGEST = 64


class Spans:
    """Hashes of any byte range of a batch in constant time, from one prefix polynomial.

    They address tables and cut texts; whoever takes equal hashes of long ranges for equal ranges has to
    compare the ranges (``names`` is for that).
    """

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.sums = np.empty(len(data) + 1, np.uint64)
        self.sums[0] = 0
        self.sums[1:] = data
        self.sums[1:] += np.uint64(1)
        self.sums[1:] *= up[:-1]
        np.cumsum(self.sums[1:], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def windows(self, width: int) -> np.ndarray:
        """Of every range of one width, by start."""
        n = len(self.sums) - width
        if n <= 0:
            return np.empty(0, np.uint64)
        return mix((self.sums[width:] - self.sums[:n]) * self.down[:n])


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string or binary column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offs[0] : offs[-1]] if len(offs) else raw[:0], offs - offs[0] if len(offs) else np.zeros(1, np.int64)


def slices(batch: pa.RecordBatch, column: str, most: int = 3_000_000):
    """Parts of a batch whose texts have about ``most`` bytes together (one longer text is a part)."""
    _, offs = buffers(batch.column(column))
    at, n = 0, batch.num_rows
    while at < n:
        to = int(np.searchsorted(offs, offs[at] + most, "right")) - 1
        to = min(n, max(at + 1, to))
        yield batch.slice(at, to - at)
        at = to


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each run of bytes that are not ASCII white space; runs end with their row."""
    ink = ~SPACE[data]
    before, after = np.zeros(len(data) + 1, bool), np.zeros(len(data) + 1, bool)
    before[1:] = ink
    before[offs] = False
    after[:-1] = ink
    after[offs] = False
    start = np.flatnonzero(ink & ~before[:-1])
    end = np.flatnonzero(ink & ~after[1:]) + 1
    row = np.repeat(np.arange(len(offs) - 1), np.diff(np.searchsorted(start, offs)))
    return start, end, row


def row_counts(row: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(row, minlength=n).astype(np.int64)


def names(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each range that tells ranges of any length apart."""
    out = Spans(data)(start, end)
    for k in np.flatnonzero(end - start > LONGEST).tolist():
        out[k] = xxhash.xxh3_64_intdigest(data[start[k] : end[k]].tobytes())
    return out


def shingles(data: np.ndarray, offs: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each run of ``size`` consecutive words, ASCII letters in lower case.

    A text of fewer words has one shingle of all of them, and an empty one has none.
    """
    low = LOWER[data]
    start, end, row = words(low, offs)
    if not len(start):
        return row, np.empty(0, np.uint64)
    word = names(low, start, end)
    n = row_counts(row, len(offs) - 1)
    first = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=first[1:])
    left = first[row + 1] - np.arange(len(row))  # words of the row from here on
    got = word.copy()
    for k in range(1, min(size, len(word))):
        more = np.zeros_like(word)
        more[:-k] = word[k:]
        got = np.where(left > k, mix(got * np.uint64(POLY) + more), got)
    keep = (left >= size) | (np.arange(len(row)) == first[row])
    return row[keep], got[keep]


def elements(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, value, occurrences) of the distinct values of each row, sorted by row, then value."""
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    return row[at], value[at], np.diff(np.append(at, len(row)))


def pack_bits(values: np.ndarray, bits: int) -> np.ndarray:
    """Rows of small integers as rows of bytes, ``bits`` each, most significant first."""
    out = (values[..., None] >> np.arange(bits - 1, -1, -1).astype(values.dtype)) & 1
    return np.packbits(out.reshape(len(values), -1).astype(np.uint8), axis=1)


class Numbered:
    """The numbers of distinct 64-bit keys, by open addressing."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys.astype(np.int64)
        self.bits = max(4, (3 * len(keys)).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        number = np.arange(len(keys), dtype=np.int32)
        home = self._home(self.keys)
        while len(number):
            free = self.slots[home] < 0
            self.slots[home[free]] = number[free]
            left = self.slots[home] != number
            home, number = (home[left] + 1) & (len(self.slots) - 1), number[left]

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(POLY)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where there is none."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        home = self._home(keys)
        number = self.slots[home]
        off = np.flatnonzero((number >= 0) & (self.keys[number] != keys))
        while len(off):
            home[off] = (home[off] + 1) & (len(self.slots) - 1)
            number[off] = self.slots[home[off]]
            off = off[(number[off] >= 0) & (self.keys[number[off]] != keys[off])]
        return number
