"""Token ids of whole texts by the ``tokenizers`` library, one library call per new word.

The two vocabularies used here pre-split a text so that no token crosses the place where white
space begins, nor, inside a run of plain letters, digits or signs, the place where one kind ends.
So a batch is cut there (vectorised), each unit is looked up in the worker's table, and only units
that the worker has not met go through the library. The table is addressed by a hash, but a unit counts
as known only if all its characters are those of the table's; units whose hash is taken by another
unit are kept by their text. A run that holds an apostrophe, a
bar (special tokens are written with bars) or any character for which normalisation or classes could
reach across a cut is never cut inside. Tests compare the ids with those of whole texts.
"""

from __future__ import annotations

import os
import unicodedata

import numpy as np
import pyarrow as pa

from lodestone.llm import textkit as tk

#: Characters from here on may compose or change case across units.
PLAIN = 0x300
#: Units, and characters of units, that a worker remembers before it starts anew.
MOST_UNITS = 1_500_000
MOST_CHARS = 32_000_000
#: Slots of the table at first, as a power of two; it grows with the units of one batch.
SLOT_BITS = 22


def _kinds() -> np.ndarray:
    """0 white space, 1 letter, 2 digit, 3 sign, 4 not to be cut near."""
    out = np.full(PLAIN + 1, 3, np.uint8)
    for c in range(PLAIN):
        major = unicodedata.category(chr(c))[0]
        out[c] = {"L": 1, "N": 2}.get(major, 3)
    out[[9, 10, 11, 12, 13, 32]] = 0
    out[[0x27, 0x7C, 0x85, 0xA0, 0x130, 0x1C, 0x1D, 0x1E, 0x1F, PLAIN]] = 4
    return out


KINDS = _kinds()


class Grown:
    """An array that more values are appended to."""

    def __init__(self, kind):
        self.held, self.n = np.empty(1024, kind), 0

    def add(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.held):
            wider = np.empty(2 * (self.n + len(more)), self.held.dtype)
            wider[: self.n] = self.held[: self.n]
            self.held = wider
        self.held[self.n : self.n + len(more)] = more
        self.n += len(more)

    def __len__(self) -> int:
        return self.n


class Encoder:
    """``keep_space``: tokens carry the white space before them (else white space has no token)."""

    def __init__(self, path: str, keep_space: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.keep_space = Tokenizer.from_file(path), keep_space
        self._forget()

    def _forget(self) -> None:
        self.keys = Grown(np.uint64)  # of each unit
        self.ids, self.id_starts = Grown(np.uint32), Grown(np.int64)
        self.chars, self.char_starts = Grown(np.uint32), Grown(np.int64)
        self.id_starts.add(np.zeros(1, np.int64))
        self.char_starts.add(np.zeros(1, np.int64))
        self.others: dict[str, int] = {}  # units whose key is another unit's
        self._resize(SLOT_BITS)

    def _resize(self, bits: int) -> None:
        """Open addressing by the top bits of a key."""
        self.bits = bits
        self.slots = np.full(1 << bits, -1, np.int32)
        unit = np.arange(len(self.keys), dtype=np.int32)
        if self.others:
            unit = np.setdiff1d(unit, np.fromiter(self.others.values(), np.int32))
        self._place(self.keys.held[unit], unit)

    def units(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(characters, start, end, units of each row) of a batch."""
        text = data.tobytes().decode("utf-8")
        chars = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        if len(chars) == len(data):
            rows = offs
        else:
            first = np.empty(len(data) + 1, np.int64)
            first[0] = 0
            np.cumsum((data & 0xC0) != 0x80, out=first[1:])
            rows = first[offs]
        kind = KINDS[np.minimum(chars, PLAIN)]
        edge = np.zeros(len(chars) + 1, bool)
        edge[rows] = True
        blank = kind == 0
        open_ = np.ones(len(chars), bool)
        open_[1:] = blank[:-1]
        run = (blank != open_) & blank if self.keep_space else blank != open_  # where white space starts, or any run
        run[rows[:-1][rows[:-1] < len(chars)]] = True
        start_run = np.flatnonzero(run)
        edge[:-1] |= run
        if len(start_run):
            whole = np.logical_or.reduceat(kind == 4, start_run)
            run_of = np.cumsum(run) - 1
            change = np.zeros(len(chars), bool)
            change[1:] = (kind[1:] != kind[:-1]) & ~blank[:-1] & ~blank[1:]
            edge[:-1] |= change & ~whole[run_of]
        at = np.flatnonzero(edge)
        start, end = at[:-1], at[1:]
        if not self.keep_space and len(start):
            ink = ~blank[start]
            start, end = start[ink], end[ink]
        return chars, start, end, np.diff(np.searchsorted(start, rows))

    def _home(self, key: np.ndarray) -> np.ndarray:
        return (key >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, key: np.ndarray) -> np.ndarray:
        """The unit of each key, -1 where there is none."""
        home = self._home(key)
        unit, known = self.slots[home], self.keys.held
        off = np.flatnonzero((unit >= 0) & (known[unit] != key))
        while len(off):
            home[off] = (home[off] + 1) & (len(self.slots) - 1)
            unit[off] = self.slots[home[off]]
            off = off[(unit[off] >= 0) & (known[unit[off]] != key[off])]
        return unit

    def _place(self, key: np.ndarray, unit: np.ndarray) -> None:
        home = self._home(key)
        while len(unit):
            free = self.slots[home] < 0
            self.slots[home[free]] = unit[free]
            left = self.slots[home] != unit
            home, unit = (home[left] + 1) & (len(self.slots) - 1), unit[left]

    def _differ(self, chars: np.ndarray, start: np.ndarray, end: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """The numbers of the ranges that don't have their unit's characters."""
        first = self.char_starts.held[unit]
        size = end - start
        wrong = self.char_starts.held[unit + 1] - first != size
        size = np.where(wrong, 0, size)
        upto = np.cumsum(size)
        inside = np.arange(upto[-1]) - np.repeat(upto - size, size)
        other = np.flatnonzero(chars[inside + np.repeat(start, size)] != self.chars.held[inside + np.repeat(first, size)])
        wrong[np.searchsorted(upto, other, "right")] = True
        return np.flatnonzero(wrong)

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets of each row's ids)."""
        n = len(offs) - 1
        if not len(data):
            return np.empty(0, np.uint32), np.zeros(n + 1, np.int64)
        chars, start, end, per_row = self.units(data, offs)
        if not len(start):
            return np.empty(0, np.uint32), np.zeros(n + 1, np.int64)
        key = tk.Spans(chars)(start, end) ^ tk.mix((end - start).astype(np.uint64))
        unit = self.find(key)
        missing = np.flatnonzero(unit < 0)
        if len(missing):
            unit = self._learn(chars, start, end, key, unit, missing)
        wrong = self._differ(chars, start, end, unit)
        if len(wrong):
            unit[wrong] = self._by_text(chars, start[wrong], end[wrong], key[wrong])
        first = self.id_starts.held[unit]
        size = self.id_starts.held[unit + 1] - first
        upto = np.cumsum(size)
        places = np.arange(upto[-1]) - np.repeat(upto - size - first, size)
        rows = np.zeros(n + 1, np.int64)
        rows[1:] = np.append(0, upto)[np.cumsum(per_row)]
        return self.ids.held[places], rows

    def _add(self, chars: np.ndarray, start: np.ndarray, end: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Encodes units by the library and keeps them; their numbers."""
        known = len(self.keys)
        raw = [chars[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        texts = [x.tobytes().decode("utf-32-le") for x in raw]
        for k in range(0, len(texts), 2000):
            ids = [e.ids for e in self.tokenizer.encode_batch(texts[k : k + 2000], add_special_tokens=False)]
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            self.id_starts.add(len(self.ids) + np.cumsum(size))
            self.ids.add(np.fromiter((x for i in ids for x in i), np.uint32, int(size.sum())))
        self.char_starts.add(len(self.chars) + np.cumsum(end - start))
        self.chars.add(np.concatenate(raw))
        self.keys.add(key)
        return np.arange(known, len(self.keys), dtype=np.int32)

    def _learn(self, chars, start, end, key, unit, missing) -> np.ndarray:
        n_chars = int((end - start)[missing].sum())
        if len(self.keys) and (len(self.keys) + len(missing) > MOST_UNITS or len(self.chars) + n_chars > MOST_CHARS):
            self._forget()
            missing = np.arange(len(key))
        new, first, back = np.unique(key[missing], return_index=True, return_inverse=True)
        at = missing[first]
        added = self._add(chars, start[at], end[at], new)
        bits = max(self.bits, (2 * len(self.keys)).bit_length())
        if bits > self.bits:
            self._resize(bits)
        else:
            self._place(new, added)
        unit[missing] = added[back]
        return unit

    def _by_text(self, chars, start, end, key) -> np.ndarray:
        """The numbers of units that share their key with another unit."""
        texts = [chars[a:b].tobytes().decode("utf-32-le") for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        fresh = {t: k for k, t in enumerate(texts) if t not in self.others}
        if fresh:
            at = np.fromiter(fresh.values(), np.int64)
            self.others |= dict(zip(fresh, self._add(chars, start[at], end[at], key[at]).tolist(), strict=True))
        return np.array([self.others[t] for t in texts], np.int32)


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, keep_space: bool) -> Encoder:
    """The worker's encoder of a vocabulary; its table lives as long as the worker."""
    if (path, keep_space) not in _encoders:
        _encoders[path, keep_space] = Encoder(path, keep_space)
    return _encoders[path, keep_space]


def encode_batches(batches, path: str, keep_space: bool, end_id: int, text: str = "text"):
    """(batch, ids, offsets) with ``end_id`` after each text's ids."""
    enc = encoder(path, keep_space)
    for whole in batches:
        for part in tk.slices(whole, text, 2_000_000):
            ids, offs = enc.encode(*tk.buffers(part.column(text)))
            rows = np.arange(len(offs))
            out = np.full(len(ids) + len(offs) - 1, end_id, np.uint32)
            out[np.arange(len(ids)) + np.repeat(rows[:-1], np.diff(offs))] = ids
            yield part, out, offs + rows


