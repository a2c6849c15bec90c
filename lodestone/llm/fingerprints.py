"""Document fingerprints by one-permutation MinHash with optimal densification.

The hashes of a text's shingles (five words) are dealt once into ``BINS`` bins by their top bits;
each bin keeps its least hash. An empty bin takes the value of a filled one that it finds by its own
hash sequence of (bin, attempt), the same for all texts, so equal bins stay equal with the right
probability. Only the ``BITS`` low-order bits of a bin are stored. Two fingerprints that agree in a
share m of the bins have the likeness (m - c) / (1 - c) with c = 2**-BITS, the chance agreement of
unequal bins, cut to [0, 1].

Defined results: null text is empty; an empty text has no shingles and a fingerprint of zeros with
likeness 1 to itself and 0 to any other; texts of fewer than five words have one shingle of all
their words; rows that repeat a ``doc_id`` follow each other by the hash of their text; the next
document of the last row is the first, of a single row itself; further columns are left out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import textkit as tk
from lodestone.llm.common import batch, partitions, prepare, range_bounds, range_of

BINS = 256
BITS = 4
SHINGLE = 5
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _detours(attempts: int = 64) -> np.ndarray:
    """The bin that each empty bin asks at each attempt."""
    bins = np.arange(BINS, dtype=np.uint64)
    return np.stack([(tk.mix(bins * np.uint64(attempts) + np.uint64(k + 1)) % np.uint64(BINS)).astype(np.int64) for k in range(attempts)])


DETOURS = _detours()


def sketch(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows x BINS low-order bits, whether a row has shingles)."""
    n = len(offs) - 1
    row, value = tk.shingles(data, offs, SHINGLE)
    cell = row * BINS + (value >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    bins = np.full(n * BINS, NONE, np.uint64)
    order = np.lexsort((value, cell))
    cell, value = cell[order], value[order]
    first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.empty(0, np.int64)
    bins[cell[first]] = value[first]
    bins = bins.reshape(n, BINS)
    some = (bins != NONE).any(1)
    filled = bins.copy()
    for detour in DETOURS:
        empty = filled == NONE
        empty[~some] = False
        if not empty.any():
            break
        r, b = np.nonzero(empty)
        filled[r, b] = bins[r, detour[b]]
    for r in np.flatnonzero((filled == NONE).any(1) & some):  # 64 detours all led to empty bins
        ring = np.flatnonzero(bins[r] != NONE)
        b = np.flatnonzero(filled[r] == NONE)
        filled[r, b] = bins[r, ring[np.searchsorted(ring, b) % len(ring)]]
    filled[~some] = 0
    low = (tk.mix(filled) & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    low[~some] = 0
    return low, some


def likeness(a: np.ndarray, some_a: np.ndarray, b: np.ndarray, some_b: np.ndarray) -> np.ndarray:
    chance = 2.0**-BITS
    got = np.clip(((a == b).mean(1) - chance) / (1 - chance), 0.0, 1.0)
    return np.where(some_a & some_b, got, (some_a == some_b).astype(np.float64))


def to_hex(low: np.ndarray) -> list[str]:
    return [x.tobytes().hex() for x in tk.pack_bits(low, BITS)]


def fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a column ``fingerprint``."""
    prepare(docs.sparkSession)
    names = docs.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def add(batches):
        for whole in batches:
            for part in tk.slices(whole, text):
                low, _ = sketch(*tk.buffers(part.column(text)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(to_hex(low), pa.string())], names=[*names, "fingerprint"])

    return docs.mapInArrow(add, f"{kinds}, fingerprint string")


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, ahead, range) sorted inside ranges of ids, so that a row's next document is the next row.

    The first document of each range is also sent, marked ``ahead``, to the end of the range before
    (of the first range: to the last). The texts are shuffled once.
    """
    parts = partitions(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    bounds = range_bounds(rows, "doc_id", parts)
    ranged = rows.withColumn("range", range_of(bounds, F.col("doc_id"))).withColumn("tie", F.xxhash64("text"))
    first = ranged.groupBy("range").agg(F.min(F.struct("doc_id", "tie")).alias("first")).collect()  # one row of ids a range
    starts = sorted((r["range"], r["first"]["doc_id"], r["first"]["tie"]) for r in first)
    spark = docs.sparkSession
    sent = [(r, d, t, starts[k - 1][0]) for k, (r, d, t) in enumerate(starts)]
    to = spark.createDataFrame(sent, "range int, doc_id long, tie long, to int") if sent else spark.createDataFrame([], "range int, doc_id long, tie long, to int")
    heads = ranged.alias("a").join(F.broadcast(to).alias("b"), (F.col("a.range") == F.col("b.range")) & F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.tie") == F.col("b.tie")))
    heads = heads.select("a.doc_id", "a.text", F.col("b.to").alias("range"), "a.tie", F.lit(True).alias("ahead")).dropDuplicates(["range"])
    both = ranged.withColumn("ahead", F.lit(False)).unionByName(heads)
    return both.repartitionByRange(parts, "range").sortWithinPartitions("range", "ahead", "doc_id", "tie").select("doc_id", "text", "ahead", "range")


def query(docs: DataFrame) -> DataFrame:
    """The contract's digest."""
    prepare(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def pairs(batches):
        held = None
        for whole in batches:
            for part in tk.slices(whole, "text", 1_500_000):
                rows = pa.Table.from_batches([part]) if held is None else pa.concat_tables([held, pa.Table.from_batches([part])])
                held = rows.slice(rows.num_rows - 1, 1)
                if rows.num_rows > 1:
                    yield from digest(rows.combine_chunks().to_batches()[0])

    def digest(rows):
        """Of all rows but the last, which is only a next document here; a row sent ahead ends its range."""
        ids, texts = rows.column("doc_id").take(pa.array(np.arange(rows.num_rows - 1))), rows.column("text").to_pylist()
        own = ~rows.column("ahead").to_numpy(zero_copy_only=False)[:-1]
        edited = [a[: len(a) - len(a) // 2] + b[: len(a) // 2] for a, b in zip(texts, texts[1:], strict=False)]
        low, some = sketch(*tk.buffers(rows.column("text")))
        changed, some_changed = sketch(*tk.buffers(pa.array(edited, pa.large_string())))
        out = batch(
            schema, doc_id=ids, n_chars=[len(x) for x in texts[:-1]], edited_sha256=[hashlib.sha256(x.encode()).hexdigest() for x in edited],
            fingerprint=to_hex(low[:-1]), edited_fingerprint=to_hex(changed), near_edited=likeness(low[:-1], some[:-1], changed, some_changed), near_next=likeness(low[:-1], some[:-1], low[1:], some[1:]),
        )
        yield out.filter(pa.array(own))

    return with_next(docs).mapInArrow(pairs, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
