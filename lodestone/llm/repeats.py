"""Repeated passages by prefix-free parsing: every byte under a 100-byte string that also starts earlier.

Parsing. A rolling hash runs over every 32 bytes. Each 100-byte window of a text is triggered by the
least of its 69 hashes (the leftmost, on ties), which depends on the window's bytes alone, so equal
windows have equal triggers at equal offsets wherever they stand. Consecutive windows with the same
trigger place are a phrase: the bytes from the first window's start to the last one's end. The
parse of the corpus is its phrases in order of document and place; the dictionary is its distinct
phrases, named by 96 bits of the SHA-256 of their bytes (the rolling hash only cuts and deals: it never
decides that phrases are equal). Every window lies in one phrase, so two windows are equal only if their
phrases have the same trigger, and share the 34 bytes before or after it.

Order. The corpus order of 100-byte suffixes comes from two suffix arrays. ``parse_suffixes`` is that of the
parse: phrases by trigger, name and place; a window ends within its phrase, so the order to the depth of
one phrase decides, and of equal phrases all but the first are repeated whole. ``dictionary_suffixes`` is
that of the dictionary: the windows of its strings sorted by content, equal ones under one rank.
``corpus_order`` combines them: suffixes by rank, and within a rank by the place of their string's first
occurrence in the parse, whose first is the only one that isn't repeated. Both arrays are kept by
trigger, as suffixes of different triggers are never equal, and the dictionary's is not made for triggers with
one string, whose suffixes have no equals in other strings, nor in their own, where each has its trigger at
another offset.

Scale. Phrases are dealt to tasks by trigger hash as packed arrays, about 28 bytes for 35 bytes of
text; each task first settles repeats inside its own part of the corpus, so a passage that stands in
a third of all texts reaches a reducer once from each task. A task packs for at most ``LEVEL`` parts; where there
are more, packed rows go to groups of parts first and are dealt again inside them (``Dealing``), so
their number grows with the parts times ``LEVEL`` and not with the square of the parts. A trigger that one
task finds in more phrases than its share of ``hot`` is hot: its phrases go on by (trigger, side) instead, twice if
they have both sides, as phrases without a side in common share no window; a mark in their place makes the
trigger's part send all others on in the same way, so an unmarked trigger has at most ``hot`` phrases, or one a task,
and a line that many texts have between text of their own is dealt by what stands beside it. A side with more than
its share is hot in turn: its phrases are asked for as single windows, dealt by their own hash, and a
mark makes all others of the side go so too; of equal windows in about 8 MB a task sends the earliest only and
notes the others. Strings are compared by whole triggers or sides, of about ``OPENED`` bytes at a time. Texts are
shuffled once to meet their notes, and only those with shared triggers a second time.

Defined results: null text is empty; texts are compared as UTF-8 bytes; rows that repeat a
``doc_id`` are ordered by a hash of their text, and rows equal in both are judged as if each were
alone among its equals; an empty table gives no rows; in ``remove`` a character whose bytes are
removed in part goes altogether, and further columns are kept, whatever their names.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import textkit as tk
from lodestone.llm.common import partitions, prepare
from lodestone.session import materialize

LENGTH = 100
TRIGGER = 32
#: Distinct phrases of one trigger, or of one of its sides, that are compared in one task.
HOT = 4096
#: What a task asks for by window at once is a side with more than hot / ASKED of its phrases, or its share, if that is more.
ASKED = 64
#: Bytes of strings that are compared at once, beyond those of one trigger or side.
OPENED = 48 << 20
#: Phrases that a task holds before it sends them on.
HELD = 1 << 20
#: Parts that a task packs rows for.
LEVEL = 1024
NO_ID = np.iinfo(np.int64).min

#: A window of 100 bytes has its 32 trigger bytes and SIDE more on their left or on their right.
SIDE = (LENGTH - TRIGGER) // 2
#: Hashes of keys travel with 48 bits; packing drops the empty bytes.
BITS_48 = np.uint64((1 << 48) - 1)
#: Packed notes. key: trigger hash; name, name_low: of a phrase's bytes; left, right: hashes of the trigger with SIDE
#: bytes on that side, 0 if no window of the phrase has them; at: its start; ahead, more: bytes from there to the trigger
#: and to the last window's start.
PHRASES = (("key", "<u8"), ("name", "<u8"), ("name_low", "<u4"), ("left", "<u2"), ("right", "<u2"), ("doc", "<i8"), ("tie", "<i4"), ("at", "<u4"), ("ahead", "u1"), ("more", "u1"))
#: kind 0: bytes from start to end are repeated. Others: the phrase there is asked for.
REPEATED, BY_TRIGGER, BY_WINDOW, BY_LEFT, BY_RIGHT = range(5)
NOTES = (("doc", "<i8"), ("tie", "<i4"), ("start", "<u4"), ("end", "<u4"), ("ahead", "u1"), ("kind", "u1"))
STRINGS = (("key", "<u8"), ("doc", "<i8"), ("tie", "<i4"), ("at", "<u4"), ("more", "u1"))

Columns = dict[str, np.ndarray]


_codecs: list = []


def pack(kinds, columns: Columns, tail: bytes = b"") -> bytes:
    if not _codecs:
        _codecs.append(zstandard.ZstdCompressor(level=1))
    n = len(columns[kinds[0][0]])
    raw = [np.int64(n).tobytes()]
    for name, kind in kinds:
        x = np.ascontiguousarray(columns[name], kind)
        raw.append(x.view(np.uint8).reshape(n, x.itemsize).T.tobytes())
    return _codecs[0].compress(b"".join(raw) + tail)


def unpack(kinds, payload: bytes) -> tuple[Columns, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(payload), np.uint8)
    n, at, out = int(raw[:8].view("<i8")[0]), 8, {}
    for name, kind in kinds:
        size = np.dtype(kind).itemsize
        out[name] = np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(kind).reshape(n)
        at += n * size
    return out, raw[at:]


def gather(kinds, payloads) -> Columns:
    parts = [unpack(kinds, p)[0] for p in payloads]
    return {name: np.concatenate([p[name] for p in parts]) if parts else np.empty(0, kind) for name, kind in kinds}


def take(columns: Columns, at: np.ndarray) -> Columns:
    return {k: v[at] for k, v in columns.items()}


@dataclass(frozen=True)
class Dealing:
    """The parts that keys are dealt to: ``groups`` of ``each`` consecutive parts."""

    groups: int
    each: int

    @classmethod
    def of(cls, parts: int, level: int = LEVEL) -> Dealing:
        groups = min(parts, level)
        return cls(groups, -(-parts // groups))

    @property
    def parts(self) -> int:
        return self.groups * self.each

    def part(self, keys: np.ndarray) -> np.ndarray:
        return (tk.mix(keys) % np.uint64(self.parts)).astype(np.int64)

    def first(self, keys: np.ndarray) -> np.ndarray:
        """Where keys go first: the part, if groups are single parts, else any one of the part's group, the same for these keys."""
        part = self.part(keys)
        if self.each == 1 or not len(keys):
            return part
        return part // self.each * self.each + int(tk.mix(keys[:1])[0] >> np.uint64(32)) % self.each


def name_phrases(data: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """96 bits of the SHA-256 of each range."""
    raw = memoryview(data.tobytes())
    digests = b"".join([hashlib.sha256(raw[a:b]).digest()[:12] for a, b in zip(at.tolist(), end.tolist(), strict=True)])
    words = np.frombuffer(digests, "<u4").reshape(-1, 3)
    return words[:, 0].astype(np.uint64) | (words[:, 1].astype(np.uint64) << np.uint64(32)), words[:, 2].copy()


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over each ``width`` consecutive values."""
    have, out = 1, x
    while 2 * have <= width:
        out = pick(out[:-have], out[have:])
        have *= 2
    return pick(out[: len(out) - (width - have)], out[width - have :]) if width > have else out


def _side(spans: tk.Spans, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 16-bit name of each range, not 0."""
    return 1 + spans(start, end) % np.uint64(65535)


def parse(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, Columns, tk.Spans]:
    """(row, phrases without doc and tie) of a batch of texts; ``at`` counts from the batch's start."""
    spans = tk.Spans(data)
    width = LENGTH - TRIGGER + 1
    n_windows = len(data) - LENGTH + 1
    nothing = {k: np.empty(0, kind) for k, kind in PHRASES if k not in ("doc", "tie")}
    if n_windows <= 0:
        return np.empty(0, np.int64), nothing, spans
    x = spans.windows(TRIGGER)
    least = _sliding(x, width, np.minimum)
    valid = np.zeros(len(data) + 1, np.int32)
    whole = np.flatnonzero(np.diff(offs) >= LENGTH)
    np.add.at(valid, offs[whole], 1)
    np.add.at(valid, offs[whole + 1] - LENGTH + 1, -1)
    ok = np.cumsum(valid)[:n_windows] > 0
    least_ok = np.where(ok, least, np.uint64(0))
    most = _sliding(np.concatenate([np.zeros(width - 1, np.uint64), least_ok, np.zeros(width - 1, np.uint64)]), width, np.maximum)
    spot = np.flatnonzero(x == most[: len(x)])  # places that trigger some window
    start = np.flatnonzero(ok)
    if not len(start):
        return np.empty(0, np.int64), nothing, spans
    nth = np.cumsum(np.bincount(spot, minlength=len(x)))[start] - (x[start] == most[start])  # first such place from the start on
    want = least[start]
    off = np.flatnonzero(x[spot[nth]] != want)
    while len(off):
        nth[off] += 1
        off = off[x[spot[nth[off]]] != want[off]]
    owner = spot[nth]
    new = np.ones(len(start), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    at, place, more = start[first], owner[first], start[last] - start[first]
    name, name_low = name_phrases(data, at, at + more + LENGTH)
    row = np.searchsorted(offs, at, "right") - 1
    ahead = place - at
    left = np.where(ahead >= SIDE, _side(spans, np.maximum(place - SIDE, 0), place + TRIGGER), np.uint64(0))
    right = np.where(ahead - more <= SIDE, _side(spans, place, np.minimum(place + TRIGGER + SIDE, len(data))), np.uint64(0))
    return row, {"key": x[place] & BITS_48, "name": name, "name_low": name_low, "left": left, "right": right, "at": at, "ahead": ahead, "more": more}, spans


def parse_suffixes(c: Columns) -> tuple[Columns, np.ndarray]:
    """The suffix array of a part of the parse, to the depth of a phrase: phrases by trigger, name and place; which are the first of their equals."""
    c = take(c, np.lexsort((c["at"], c["tie"], c["doc"], c["name_low"], c["name"], c["key"])))
    first = np.ones(len(c["key"]), bool)
    first[1:] = False
    for k in ("key", "name", "name_low"):
        first[1:] |= c[k][1:] != c[k][:-1]
    # equals of the same row, as repeated rows have them, are not repeats of each other
    again = np.zeros(len(first), bool)
    again[1:] = ~first[1:] & (c["at"][1:] == c["at"][:-1]) & (c["doc"][1:] == c["doc"][:-1]) & (c["tie"][1:] == c["tie"][:-1])
    keep = ~again
    return take(c, np.flatnonzero(keep)), first[keep]


def _repeated(c: Columns) -> Columns:
    return {"doc": c["doc"], "tie": c["tie"], "start": c["at"], "end": c["at"].astype(np.int64) + c["more"] + LENGTH, "ahead": np.zeros(len(c["doc"]), np.uint8), "kind": np.zeros(len(c["doc"]), np.uint8)}


def _asked(c: Columns, kind) -> Columns:
    return {"doc": c["doc"], "tie": c["tie"], "start": c["at"], "end": c["at"].astype(np.int64) + c["more"] + LENGTH, "ahead": c["ahead"], "kind": np.broadcast_to(kind, len(c["doc"]))}


def _counts(keys: np.ndarray) -> np.ndarray:
    """How often each key is there."""
    _, at, n = np.unique(keys, return_inverse=True, return_counts=True)
    return n[at]


def _alike(c: Columns) -> np.ndarray:
    """For each phrase, how many have its trigger and a side of it; phrases that share a window share a side."""
    n = np.zeros(len(c["key"]), np.int64)
    for side in ("left", "right"):
        n = np.maximum(n, np.where(c[side] > 0, _counts((c["key"] << np.uint64(16)) | c[side].astype(np.uint64)), 0))
    return n


def _marks(keys: np.ndarray) -> Columns:
    """Rows among the phrases that say that a trigger or side is hot: those without both sides, of which a phrase has one."""
    return {name: keys if name == "key" else np.zeros(len(keys), kind) for name, kind in PHRASES}


def _is_mark(c: Columns) -> np.ndarray:
    return (c["left"] == 0) & (c["right"] == 0)


def side_key(key: np.ndarray, side: np.ndarray) -> np.ndarray:
    return tk.mix((key << np.uint64(16)) | side.astype(np.uint64)) & BITS_48


def _sides(c: Columns) -> Columns:
    """Phrases under the keys of their sides: of the two columns of sides, the one meant is 1 and the other 0."""
    out = []
    for side, other in (("left", "right"), ("right", "left")):
        own = take(c, np.flatnonzero(c[side] > 0))
        out.append(own | {"key": side_key(own["key"], own[side]), side: np.ones(len(own["key"]), np.uint16), other: np.zeros(len(own["key"]), np.uint16)})
    return _merge(out, PHRASES)


PACKED = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("payload", pa.binary())])
PACKED_SQL = "kind int, part int, payload binary"
#: What packed rows hold: phrases by trigger, notes, strings with their bytes, or phrases by side.
TO_PHRASES, TO_TEXTS, STRING, TO_SIDES = range(4)
#: Bytes of strings that are sent at once, and asked phrases of a text that are taken at once.
SENT_BYTES = 8_000_000
PIECE = 512
#: Packed bytes that are dealt again at once.
AGAIN_BYTES = 8 << 20


def _dealt(kind: int, kinds, c: Columns, where: np.ndarray, bodies: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None):
    """One packed row for each part of ``where`` that gets anything; ``bodies`` are (bytes, start, size) of each row's string."""
    order = np.argsort(where, kind="stable")
    edge = np.append(np.flatnonzero(np.append(True, where[order][1:] != where[order][:-1])), len(order)) if len(order) else np.zeros(1, np.int64)
    for k in range(0, len(edge) - 1, 64):
        own, payload = [], []
        for lo, hi in zip(edge[k : k + 64].tolist(), edge[k + 1 : k + 65].tolist(), strict=False):
            at, body = order[lo:hi], b""
            if bodies is not None:
                data, start, size = bodies[0], bodies[1][at], bodies[2][at]
                body = data[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())].tobytes()
            own.append(int(where[at[0]]))
            payload.append(pack(kinds, take(c, at), body))
        yield pa.RecordBatch.from_arrays([pa.array([kind] * len(own), pa.int32()), pa.array(own, pa.int32()), pa.array(payload, pa.binary())], schema=PACKED)


def _deal_again(dealing: Dealing):
    """Packed rows of a group of parts, dealt to the parts."""

    def flush(kind: int, held: list[bytes]):
        if kind == STRING:
            c, data, begin, size = _opened(held)
            yield from _dealt(kind, STRINGS, c, dealing.part(c["key"]), (data, begin, size))
        else:
            kinds, by = (NOTES, "doc") if kind == TO_TEXTS else (PHRASES, "key")
            c = gather(kinds, held)
            yield from _dealt(kind, kinds, c, dealing.part(c[by].view(np.uint64)))

    def run(batches):
        held: dict[int, list[bytes]] = {}
        size: dict[int, int] = {}
        for b in batches:
            for kind, payload in zip(b.column("kind").to_pylist(), b.column("payload").to_pylist(), strict=True):
                held.setdefault(kind, []).append(payload)
                size[kind] = size.get(kind, 0) + len(payload)
                if size[kind] > AGAIN_BYTES:
                    yield from flush(kind, held.pop(kind))
                    size[kind] = 0
        for kind, payloads in held.items():
            yield from flush(kind, payloads)

    return run


def _merge(batches: list[Columns], kinds) -> Columns:
    return {name: np.concatenate([np.asarray(b[name]).astype(kind) for b in batches]) for name, kind in kinds}


def _ids(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return part.column("doc").fill_null(NO_ID).to_numpy(zero_copy_only=False), part.column("tie").to_numpy(zero_copy_only=False)


def _parse_task(dealing: Dealing, share: int, side_share: int):
    def run(batches):
        held: list[Columns] = []
        count = 0

        def flush():
            c, first = parse_suffixes(_merge(held, PHRASES))
            again = _repeated(take(c, np.flatnonzero(~first)))
            c = take(c, np.flatnonzero(first))
            c = take(c, np.lexsort((c["at"], c["tie"], c["doc"])))
            hot = _counts(c["key"]) > share
            if hot.any():
                marks = _marks(np.unique(c["key"][hot]))
                sides, c = _sides(take(c, np.flatnonzero(hot))), _merge([take(c, np.flatnonzero(~hot)), marks], PHRASES)
                hot = _counts(sides["key"]) > side_share
                again = _merge([again, _asked(take(sides, np.flatnonzero(hot)), BY_WINDOW)], NOTES)
                sides = _merge([take(sides, np.flatnonzero(~hot)), _marks(np.unique(sides["key"][hot]))], PHRASES)
                yield from _dealt(TO_SIDES, PHRASES, sides, dealing.first(sides["key"]))
            yield from _dealt(TO_PHRASES, PHRASES, c, dealing.first(c["key"]))
            yield from _dealt(TO_TEXTS, NOTES, again, dealing.first(again["doc"].view(np.uint64)))

        for whole in batches:
            for part in tk.slices(whole, "text", 1_000_000):
                data, offs = tk.buffers(part.column("text"))
                row, c, _ = parse(data, offs)
                doc, tie = _ids(part)
                c = c | {"doc": doc[row], "tie": tie[row], "at": c["at"] - offs[row]}
                held.append({name: c[name].astype(kind) for name, kind in PHRASES})
                count += len(row)
                if count >= HELD:
                    yield from flush()
                    held, count = [], 0
        if count:
            yield from flush()
        held = []
        tk.release()

    return run


def _by_part(batches, columns: tuple[str, ...]):
    """(part, rows of the columns) of each part of a task; its rows are next to each other."""
    current, rows = None, []
    for b in batches:
        for part, *row in zip(b.column("part").to_pylist(), *[b.column(c).to_pylist() for c in columns], strict=True):
            if part != current and rows:
                yield current, rows
                rows = []
            current = part
            rows.append(row)
    if rows:
        yield current, rows


def _packed(kind: int, part: int, payloads: list[bytes]) -> pa.RecordBatch:
    n = len(payloads)
    return pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.int32()), pa.array([part] * n, pa.int32()), pa.array(payloads, pa.binary())], schema=PACKED)


def _meet_task(dealing: Dealing, hot: int, wanted: int):
    """Equal phrases: notes of repeats, requests for the phrases whose triggers have several, and phrases of hot triggers by side.

    What the parse has made for texts and sides passes through, so the parse is shuffled and not written. Of what comes
    out only the kind ``wanted`` is sent on.
    """

    def run(batches):
        for part, rows in _by_part(batches, ("kind", "payload")):
            if passing := [p for k, p in rows if k == wanted]:
                yield _packed(wanted, part, passing)
            phrases = [p for kind, p in rows if kind == TO_PHRASES]
            if not phrases:
                continue
            c, first = parse_suffixes(gather(PHRASES, phrases))
            notes = [_repeated(take(c, np.flatnonzero(~first)))]
            c = take(c, np.flatnonzero(first))
            mark = _is_mark(c)
            by_side = (_counts(c["key"]) > hot) | np.isin(c["key"], c["key"][mark])
            if wanted == TO_SIDES:
                sides = _sides(take(c, np.flatnonzero(by_side & ~mark)))
                yield from _dealt(TO_SIDES, PHRASES, sides, dealing.first(sides["key"]))
                continue
            c = take(c, np.flatnonzero(~by_side))
            notes = _merge([*notes, _asked(take(c, np.flatnonzero(_alike(c) > 1)), BY_TRIGGER)], NOTES)
            yield from _dealt(TO_TEXTS, NOTES, notes, dealing.first(notes["doc"].view(np.uint64)))
        tk.release()

    return run


def _sides_task(dealing: Dealing, hot: int):
    """The same for phrases by side: notes of repeats, and requests for those that share a side."""

    def run(batches):
        for _, rows in _by_part(batches, ("payload",)):
            c, first = parse_suffixes(gather(PHRASES, [r[0] for r in rows]))
            again = _repeated(take(c, np.flatnonzero(~first)))
            c = take(c, np.flatnonzero(first))
            mark, n = _is_mark(c), _counts(c["key"])
            by_window = (n > hot) | np.isin(c["key"], c["key"][mark])
            asked = np.flatnonzero(~mark & (by_window | (n > 1)))
            kind = np.where(by_window[asked], BY_WINDOW, np.where(c["left"][asked] > 0, BY_LEFT, BY_RIGHT))
            notes = _merge([again, _asked(take(c, asked), kind)], NOTES)
            yield from _dealt(TO_TEXTS, NOTES, notes, dealing.first(notes["doc"].view(np.uint64)))
        tk.release()

    return run


def union(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs that the intervals cover."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.append(True, start[1:] > end[:-1])
    last = np.append(np.flatnonzero(new)[1:], len(start)) - 1
    return start[new], end[last]


def cut(text: bytes, start: np.ndarray, end: np.ndarray) -> bytes:
    at, kept = 0, []
    for a, b in zip(start.tolist(), end.tolist(), strict=True):
        kept.append(text[at:a])
        at = b
    return b"".join([*kept, text[at:]])


RESULT = ("kind", "part", "doc", "tie", "row", "text", "payload", "n_bytes", "n_removed", "n_spans", "kept_sha256")
RESULT_TYPES = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), None, pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string())
#: What a row of a result is, besides strings: a settled text, one that waits for its strings, or a note.
DONE, OPEN, NOTE = 0, 1, 3


def _result(n: int, row_type: pa.DataType, **columns) -> pa.RecordBatch:
    arrays = []
    for name, kind in zip(RESULT, RESULT_TYPES, strict=True):
        x = columns.get(name)
        arrays.append(pa.nulls(n, kind or row_type) if x is None else x if isinstance(x, pa.Array) else pa.array(x, kind))
    return pa.RecordBatch.from_arrays(arrays, names=list(RESULT))


class _Notes:
    """The notes of one part, by document."""

    def __init__(self, payloads):
        c = gather(NOTES, payloads)
        self.c = take(c, np.lexsort((c["start"], c["tie"], c["doc"])))
        new = np.ones(len(c["doc"]), bool)
        new[1:] = (self.c["doc"][1:] != self.c["doc"][:-1]) | (self.c["tie"][1:] != self.c["tie"][:-1])
        at = np.flatnonzero(new)
        to = np.append(at, len(new))[1:]
        self.places = {(d, t): (a, b) for d, t, a, b in zip(self.c["doc"][at].tolist(), self.c["tie"][at].tolist(), at.tolist(), to.tolist(), strict=True)}

    def of(self, doc: int, tie: int) -> Columns:
        a, b = self.places.get((doc, tie), (0, 0))
        return {k: v[a:b] for k, v in self.c.items()}


def _distinct(asked: Columns) -> Columns:
    """Requests of one text, once each: a phrase can be asked for by window for both of its sides."""
    _, at = np.unique((asked["start"].astype(np.int64) << 3) | asked["kind"], return_index=True)
    return take(asked, at)


def _strings(raw: bytes, asked: Columns, spans: tk.Spans | None = None) -> tuple[Columns, bytes]:
    """The phrases that are asked for under the hash of their trigger or side, or their windows under their own hashes."""
    spans, asked = spans or tk.Spans(np.frombuffer(raw, np.uint8)), _distinct(asked)
    at, end = asked["start"].astype(np.int64), asked["end"].astype(np.int64)
    place = at + asked["ahead"]
    key = spans(place, place + TRIGGER) & BITS_48
    for kind, a, b in ((BY_LEFT, -SIDE, TRIGGER), (BY_RIGHT, 0, TRIGGER + SIDE)):
        own = asked["kind"] == kind
        key[own] = side_key(key[own], _side(spans, place[own] + a, place[own] + b))
    more = end - at - LENGTH
    single = asked["kind"] == BY_WINDOW
    if single.any():
        n = more[single] + 1
        starts = np.repeat(at[single] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        at, more = np.concatenate([at[~single], starts]), np.concatenate([more[~single], np.zeros(len(starts), np.int64)])
        key = np.concatenate([key[~single], spans(starts, starts + LENGTH) & BITS_48])
    body = b"".join(raw[a : a + m + LENGTH] for a, m in zip(at.tolist(), more.tolist(), strict=True))
    n = len(at)
    return {"key": key, "doc": np.full(n, asked["doc"][0]), "tie": np.full(n, asked["tie"][0]), "at": at, "more": more}, body


def _later(c: Columns, data: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Which strings are single windows that stand earlier among the strings."""
    single = np.flatnonzero(c["more"] == 0)
    own = single[np.lexsort((c["at"][single], c["tie"][single], c["doc"][single], c["key"][single]))]
    out = np.zeros(len(c["more"]), bool)
    if len(own) > 1:
        body = np.lib.stride_tricks.sliding_window_view(data, LENGTH)[begin[own]]
        same = np.append(False, (c["key"][own][1:] == c["key"][own][:-1]) & (body[1:] == body[:-1]).all(1))
        head = own[np.maximum.accumulate(np.where(~same, np.arange(len(own)), 0))]
        # a window doesn't repeat itself, which repeated rows would make it seem to
        out[own] = same & ((c["doc"][own] != c["doc"][head]) | (c["tie"][own] != c["tie"][head]) | (c["at"][own] != c["at"][head]))
    return out


def _opened(payloads: list[bytes], least: int = 0, most: int = int(BITS_48)) -> tuple[Columns, np.ndarray, np.ndarray, np.ndarray]:
    """(strings, their bytes, where each begins, its size) of packed rows, of keys from ``least`` to ``most``."""
    heads, bodies = [], []
    for p in payloads:
        c, data = unpack(STRINGS, p)
        own = (c["key"] >= np.uint64(least)) & (c["key"] <= np.uint64(most))
        if not own.all():
            data = data[np.repeat(own, c["more"].astype(np.int64) + LENGTH)]
            c = take(c, np.flatnonzero(own))
        heads.append(c)
        bodies.append(data)
    c = {name: np.concatenate([h[name] for h in heads]) for name, _ in STRINGS}
    size = c["more"].astype(np.int64) + LENGTH
    return c, np.concatenate(bodies), np.cumsum(size) - size, size


def _send(strings: list[tuple[Columns, bytes]], row_type: pa.DataType, dealing: Dealing):
    c = _merge([x[0] for x in strings], STRINGS)
    data = np.frombuffer(b"".join(x[1] for x in strings), np.uint8)
    size = c["more"].astype(np.int64) + LENGTH
    begin = np.cumsum(size) - size
    later = _later(c, data, begin)
    rows = []
    if later.any():
        notes = _repeated(take(c, np.flatnonzero(later)))
        rows += [(NOTE, b) for b in _dealt(TO_TEXTS, NOTES, notes, dealing.first(notes["doc"].view(np.uint64)))]
        kept = np.flatnonzero(~later)
        c, size, begin = take(c, kept), size[kept], begin[kept]
    rows += [(STRING, b) for b in _dealt(STRING, STRINGS, c, dealing.first(c["key"]), (data, begin, size))]
    for kind, b in rows:
        yield _result(b.num_rows, row_type, kind=[kind] * b.num_rows, part=b.column("part"), payload=b.column("payload"))


def _settle(texts: pa.RecordBatch, notes: _Notes, part: int, whole_text: bool, strings: _Held, row_type: pa.DataType):
    """Texts of which nothing is asked are done; of the others the strings are taken and they stay open."""
    doc, tie = _ids(texts)
    raw = [x.encode() if x else b"" for x in texts.column("text").to_pylist()]
    earlier = texts.column("payload").to_pylist()
    done: tuple[list, ...] = ([], [], [], [], [], [])
    open_: tuple[list, ...] = ([], [])
    for k, (d, t) in enumerate(zip(doc.tolist(), tie.tolist(), strict=True)):
        c = notes.of(d, t)
        again = c["kind"] == REPEATED
        start, end = c["start"][again].astype(np.int64), c["end"][again].astype(np.int64)
        if earlier[k] is not None:
            known = np.frombuffer(earlier[k], "<i8").reshape(2, -1)
            start, end = np.concatenate([start, known[0]]), np.concatenate([end, known[1]])
        start, end = union(start, end)
        if again.all():
            kept = cut(raw[k], start, end) if len(start) else raw[k]
            left = kept.decode("utf-8", "ignore") if whole_text else None
            for column, x in zip(done, (k, left, len(raw[k]), len(raw[k]) - len(kept), len(start), hashlib.sha256(kept).hexdigest()), strict=True):
                column.append(x)
        else:
            asked, spans = _distinct(take(c, np.flatnonzero(~again))), tk.Spans(np.frombuffer(raw[k], np.uint8))
            for at in range(0, len(asked["start"]), PIECE):  # a window of each byte may be asked for, a hundred times the text
                yield from strings.add(_strings(raw[k], take(asked, np.arange(at, min(at + PIECE, len(asked["start"])))), spans))
            open_[0].append(k)
            open_[1].append(np.stack([start, end]).astype("<i8").tobytes())
    for kind, (rows, *more) in ((DONE, done), (OPEN, open_)):
        if rows:
            at = pa.array(rows)
            own = {"kind": [kind] * len(at), "part": [part] * len(at)} | {c: texts.column(c).take(at) for c in ("doc", "tie", "row")}
            own |= dict(zip(("text", "n_bytes", "n_removed", "n_spans", "kept_sha256"), more, strict=True)) if kind == DONE else {"text": texts.column("text").take(at), "payload": more[0]}
            yield _result(len(at), row_type, **own)


class _Held:
    """Strings that a task holds until there are enough to send."""

    def __init__(self, row_type: pa.DataType, dealing: Dealing):
        self.row_type, self.dealing = row_type, dealing
        self.strings: list[tuple[Columns, bytes]] = []
        self.size = 0

    def add(self, more: tuple[Columns, bytes]):
        self.strings.append(more)
        self.size += len(more[1])
        if self.size > SENT_BYTES:
            yield from self.flush()

    def flush(self):
        held, self.strings, self.size = self.strings, [], 0
        if held:
            yield from _send(held, self.row_type, self.dealing)


def _text_task(dealing: Dealing, whole_text: bool):
    """Texts meet the notes of their part, which come before them."""

    def run(batches):
        notes, payloads, current = None, [], None
        strings, row_type = None, None
        for whole in batches:
            row_type = whole.schema.field("row").type
            strings = strings or _Held(row_type, dealing)
            for b in tk.slices(whole, "text", 2_000_000):
                part_of = b.column("part").to_numpy(zero_copy_only=False)
                edge = np.flatnonzero(np.append(True, part_of[1:] != part_of[:-1])).tolist()
                for lo, hi in zip(edge, [*edge[1:], b.num_rows], strict=True):
                    own, part = b.slice(lo, hi - lo), int(part_of[lo])
                    if part != current:
                        current, payloads, notes = part, [], None
                    is_note = own.column("kind").to_numpy(zero_copy_only=False) == 0
                    payloads += own.column("payload").filter(pa.array(is_note)).to_pylist()
                    texts = own.filter(pa.array(~is_note))
                    if texts.num_rows:
                        if notes is None:
                            notes, payloads = _Notes(payloads), []
                        yield from _settle(texts, notes, part, whole_text, strings, row_type)
        if strings:
            yield from strings.flush()
        tk.release()

    return run


def _sort_task(dealing: Dealing):
    """Orders the window suffixes of the dictionary strings of each part; notes of those that are repeated."""

    def sent(notes: list[Columns]):
        c = _merge(notes, NOTES)
        yield from _dealt(TO_TEXTS, NOTES, c, dealing.first(c["doc"].view(np.uint64)))

    def run(batches):
        notes: list[Columns] = []
        held = 0
        for _, rows in _by_part(batches, ("payload",)):
            for c, data, begin in _in_turn([r[0] for r in rows]):
                order = np.lexsort((c["at"], c["tie"], c["doc"], c["key"]))
                windows = np.cumsum(c["more"][order].astype(np.int64) + 1)
                key = c["key"][order]
                at = 0
                while at < len(order):  # whole keys at a time
                    to = int(np.searchsorted(windows, (windows[at - 1] if at else 0) + 150_000, "right"))
                    to = int(np.searchsorted(key, key[max(to, at + 1) - 1], "right"))
                    own = order[at:to]
                    notes.append(corpus_order(take(c, own), data, begin[own]))
                    held += len(notes[-1]["doc"])
                    if held >= HELD:
                        yield from sent(notes)
                        notes, held = [], 0
                    at = to
        if held:
            yield from sent(notes)
        tk.release()

    return run


def _in_turn(payloads: list[bytes]):
    """(strings, their bytes, where each begins) of a part, by ranges of keys of about OPENED bytes."""
    if sum(zstandard.frame_content_size(p) for p in payloads) <= OPENED:
        yield _opened(payloads)[:3]
        return
    heads = gather(STRINGS, payloads)
    order = np.argsort(heads["key"])
    key, size = heads["key"][order], np.cumsum(heads["more"][order].astype(np.int64) + LENGTH)
    del heads, order
    at = 0
    while at < len(key):
        to = int(np.searchsorted(size, (size[at - 1] if at else 0) + OPENED, "right"))
        to = int(np.searchsorted(key, key[max(to, at + 1) - 1], "right"))
        yield _opened(payloads, int(key[at]), int(key[to - 1]))[:3]
        at = to


def dictionary_suffixes(data: np.ndarray, begin: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffix array of strings that begin at ``begin`` and have ``n`` windows each: (string, offset, rank), equal windows under one rank."""
    string = np.repeat(np.arange(len(n)), n)
    offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    suffix = np.lib.stride_tricks.sliding_window_view(data, LENGTH)[begin[string] + offset]
    order = np.argsort(np.ascontiguousarray(suffix).view(f"V{LENGTH}").reshape(-1), kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = (suffix[order[1:]] != suffix[order[:-1]]).any(1)
    return string[order], offset[order], np.cumsum(new) - 1


def corpus_order(c: Columns, data: np.ndarray, begin: np.ndarray) -> Columns:
    """Notes of the windows of dictionary strings that stand earlier: by rank in the dictionary, then by place in the parse, all but the first of a rank."""
    string, offset, rank = dictionary_suffixes(data, begin, c["more"].astype(np.int64) + 1)
    d, t, p = c["doc"][string], c["tie"][string], c["at"].astype(np.int64)[string] + offset
    order = np.lexsort((p, t, d, rank))
    d, t, p, rank = d[order], t[order], p[order], rank[order]
    same = np.append(False, rank[1:] == rank[:-1]) if len(rank) else np.zeros(0, bool)
    # a window doesn't repeat itself, which repeated rows would make it seem to
    head = np.maximum.accumulate(np.where(~same, np.arange(len(rank)), 0))
    same &= (d != d[head]) | (t != t[head]) | (p != p[head])
    d, t, p = d[same], t[same], p[same]
    zero = np.zeros(len(d), np.uint8)
    return {"doc": d, "tie": t, "start": p, "end": p + LENGTH, "ahead": zero, "kind": zero}


def removal(docs: DataFrame, whole_text: bool, hot: int = HOT, level: int = LEVEL) -> DataFrame:
    """(row, text, n_bytes, n_removed, n_spans, kept_sha256) of each row of ``docs``.

    ``row`` has the columns other than the text; ``text`` is what is left, if ``whole_text``.
    """
    prepare(docs.sparkSession)
    dealing = Dealing.of(partitions(docs), level)
    held_at = F.pandas_udf(lambda doc: pd.Series(dealing.part(doc.fillna(NO_ID).to_numpy(np.int64).view(np.uint64)).astype(np.int32)), "int")
    text = F.coalesce(docs["text"], F.lit(""))
    others = F.struct(*[docs[c] for c in docs.columns if c != "text"])
    texts = docs.select(docs["doc_id"].cast("long").alias("doc"), F.hash(text).alias("tie"), others.alias("row"), text.alias("text"))
    row_sql = texts.schema["row"].dataType.simpleString()
    result_sql = f"kind int, part int, doc long, tie int, row {row_sql}, text string, payload binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    def to_parts(df: DataFrame) -> DataFrame:
        return df.repartitionById(dealing.parts, F.col("part"))

    def dealt(packed: DataFrame) -> DataFrame:
        """Packed rows in parts of their own or, where groups have several, in their group's, dealt again."""
        if dealing.each == 1:
            return packed
        return to_parts(packed.select("kind", "part", "payload")).mapInArrow(_deal_again(dealing), PACKED_SQL)

    def with_notes(bodies: DataFrame, notes: DataFrame, name: str) -> DataFrame:
        nulls = [F.lit(None).cast(k).alias(c) for c, k in (("doc", "long"), ("tie", "int"), ("row", row_sql), ("text", "string"))]
        blank = dealt(notes.select(F.lit(TO_TEXTS).alias("kind"), "part", "payload")).select(F.lit(0).alias("kind"), "part", *nulls, "payload")
        both = bodies.select(F.lit(1).alias("kind"), "part", "doc", "tie", "row", "text", "payload").unionByName(blank)
        both = to_parts(both).sortWithinPartitions("part", "kind")
        return materialize(both.mapInArrow(_text_task(dealing, whole_text), result_sql), name, "zstd")

    share = max(1, hot // max(1, docs.rdd.getNumPartitions()))
    parsed = dealt(texts.select("doc", "tie", "text").mapInArrow(_parse_task(dealing, share, max(share, hot // ASKED)), PACKED_SQL))
    # one exchange that both ways read: phrases by side are few, and notes needn't be shuffled with them
    met = to_parts(parsed).sortWithinPartitions("part")
    notes, sides = (met.mapInArrow(_meet_task(dealing, hot, kind), PACKED_SQL) for kind in (TO_TEXTS, TO_SIDES))
    of_sides = to_parts(dealt(sides).select("part", "payload")).sortWithinPartitions("part").mapInArrow(_sides_task(dealing, hot), PACKED_SQL)
    notes = notes.unionByName(of_sides).select("part", "payload")
    first = with_notes(texts.withColumn("part", held_at("doc")).withColumn("payload", F.lit(None).cast("binary")), notes, "texts")
    strings = dealt(first.where(F.col("kind") == STRING).select("kind", "part", "payload"))
    again = to_parts(strings.select("part", "payload")).sortWithinPartitions("part").mapInArrow(_sort_task(dealing), PACKED_SQL)
    later = first.where(F.col("kind") == NOTE).select("part", "payload")
    second = with_notes(first.where(F.col("kind") == OPEN), again.select("part", "payload").unionByName(later), "open")
    return first.where(F.col("kind") == DONE).unionByName(second.where(F.col("kind") == DONE)).select("row", "text", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def query(docs: DataFrame) -> DataFrame:
    """The contract's digest."""
    got = removal(docs.select("doc_id", "text"), False)
    return got.select(F.col("row.doc_id").cast("long").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def remove(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated passages cut out of each text; no row is dropped."""
    got = removal(docs, True)
    return got.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
