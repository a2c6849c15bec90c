"""Token-id files with keyed access through minimal perfect hashing.

A store is two Parquet tables. ``shards``: a row holds the raw ids of some consecutive documents in
ascending ``doc_id`` order (little-endian, 16 bits if all ids of the vocabulary fit, else 32), where
each document's ids start, and whose they are. ``index``: a row is a bucket of document keys, by their
hash: a minimal perfect hash from key to slot, and for each slot a stored 32-bit fingerprint of the key,
the number of its shard, its place there, and how many rows have its ``doc_id``. A key is looked up with
a constant number of array reads: its bucket, a bit and a rank in each level of the hash (1.6 levels on
average; ranks are kept for every 512 bits), one slot, and two offsets of the shard. Of keys that aren't
there the fingerprint refuses all but 2**-32, and the shard's own key the rest.

The hash is built in levels: keys that are alone in their cell of a bit array stay there, the
others go to the next level; a slot is the number of set bits before the cell.

Scale. Texts are shuffled once, by range of (``doc_id``, text hash), so a ``doc_id`` that many rows share is
split. Index and shards meet requests by bucket and by shard number in ordinary shuffles, and requests
stream past the one bucket or shard that a task holds. The driver sees one row for each range.

Defined results: null text is empty and has the end id only; rows that repeat a ``doc_id`` are keyed
by id and occurrence, in the order of the texts' hashes; a null ``doc_id`` sorts first (and counts as
-2**63, which is no other key); an empty table gives an empty store; further columns are left out.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import textkit as tk
from lodestone.llm.common import batch, partitions, prepare
from lodestone.llm.tokens import encode_batches
from lodestone.session import working_path

#: Ids in a shard, about, and keys in a bucket of the index, about.
SHARD_IDS = 1 << 18
BUCKET_KEYS = 1 << 14
NO_ID = np.iinfo(np.int64).min
SHARD = pa.schema([("range", pa.int32()), ("shard", pa.int32()), ("start", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("last_occurrence", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("width", pa.int32()), ("docs", pa.binary()), ("offsets", pa.binary()), ("payload", pa.binary())])
SHARD_SQL = "range int, shard int, start long, n_docs long, n_ids long, last_occurrence long, first_id long, last_id long, width int, docs binary, offsets binary, payload binary"
INDEX = pa.schema([("bucket", pa.int64()), ("seed", pa.int32()), ("levels", pa.binary()), ("slots", pa.binary())])
INDEX_SQL = "bucket long, seed int, levels binary, slots binary"
KEYS_SQL = "bucket long, doc_id long, occurrence long"
PLACES_SQL = "bucket long, doc_id long, occurrence long, range int, shard int, place int"
#: One slot of the index.
SLOT = np.dtype([("print", "<u4"), ("range", "<i4"), ("shard", "<i4"), ("place", "<i4"), ("copies", "<i8")])


def key_hash(doc_id: np.ndarray, occurrence: np.ndarray, seed: int = 0) -> np.ndarray:
    return tk.mix(tk.mix(doc_id.astype(np.int64).view(np.uint64) + np.uint64(seed)) + occurrence.astype(np.uint64) * np.uint64(tk.POLY))


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit hashes, read from its bytes as they are stored.

    A level is (number of cells, bits in 64-bit words, set bits before each block of eight words).
    """

    BLOCK = 8  # words
    MOST_LEVELS = 64

    def __init__(self, levels: list[tuple[int, np.ndarray, np.ndarray]]):
        self.levels = levels

    @staticmethod
    def cells(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (tk.mix(keys + np.uint64((level + 1) * tk.MIX_1 & (1 << 64) - 1)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        if len(np.unique(keys)) < len(keys):
            raise ValueError("keys repeat")
        levels, left, before = [], keys, 0
        while len(left):
            if len(levels) == cls.MOST_LEVELS:
                raise ValueError("keys can't be told apart")
            size = max(8, 2 * len(left))
            cell = cls.cells(left, len(levels), size)
            alone = np.bincount(cell, minlength=size) == 1
            bits = np.zeros(-(-size // (64 * cls.BLOCK)) * 64 * cls.BLOCK, bool)
            bits[:size] = alone
            counts = bits.reshape(-1, 64 * cls.BLOCK).sum(1)
            levels.append((size, np.packbits(bits, bitorder="little").view("<u8"), (before + np.cumsum(counts) - counts).astype("<u4")))
            before += int(counts.sum())
            left = left[~alone[cell]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; of a key that wasn't built in, any slot or -1."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for k, (size, words, before) in enumerate(self.levels):
            cell = self.cells(keys[left], k, size)
            bit = (cell & 63).astype(np.uint64)
            hit = (words[cell >> 6] >> bit) & np.uint64(1) > 0
            at, own = cell[hit] >> 6, (np.uint64(1) << bit[hit]) - np.uint64(1)
            block = at // self.BLOCK
            near = words[(block * self.BLOCK)[:, None] + np.arange(self.BLOCK)]
            inside = np.arange(self.BLOCK) - (at % self.BLOCK)[:, None]
            near = np.where(inside < 0, near, np.where(inside == 0, near & own[:, None], np.uint64(0)))
            out[left[hit]] = before[block] + np.bitwise_count(near).sum(1)
            left = left[~hit]
        return out

    def to_bytes(self) -> bytes:
        sizes = np.array([len(self.levels), *(size for size, _, _ in self.levels)], "<i8")
        return sizes.tobytes() + b"".join(words.tobytes() + before.tobytes() for _, words, before in self.levels)

    @classmethod
    def from_bytes(cls, raw: bytes) -> PerfectHash:
        n = int(np.frombuffer(raw, "<i8", 1)[0])
        at, levels = 8 * (n + 1), []
        for size in np.frombuffer(raw, "<i8", n, 8).tolist():
            blocks = -(-size // (64 * cls.BLOCK))
            words = np.frombuffer(raw, "<u8", blocks * cls.BLOCK, at)
            at += words.nbytes
            levels.append((size, words, np.frombuffer(raw, "<u4", blocks, at)))
            at += 4 * blocks
        return cls(levels)


def id_width(vocabulary: str, end_id: int) -> int:
    """Bytes that hold every id of the vocabulary and the end id."""
    from tokenizers import Tokenizer

    most = max([end_id, *Tokenizer.from_file(vocabulary).get_vocab().values()])
    return 2 if most < 1 << 16 else 4


def _shard(where: int, nth: int, start: int, width: int, docs: list[int], ids: list[np.ndarray], last: int) -> pa.RecordBatch:
    offsets = np.cumsum([0, *map(len, ids)])
    payload = np.concatenate(ids).astype(f"<u{width}").tobytes()
    return batch(SHARD, range=[where], shard=[nth], start=[start], n_docs=[len(docs)], n_ids=[int(offsets[-1])], last_occurrence=[last], first_id=[docs[0]], last_id=[docs[-1]], width=[width], docs=[np.array(docs, "<i8").tobytes()], offsets=[offsets.astype("<i8").tobytes()], payload=[payload])


def _write_shards(docs: DataFrame, path: str, vocabulary: str, end_id: int, shard_ids: int) -> None:
    parts, width = partitions(docs), id_width(vocabulary, end_id)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    ordered = texts.repartitionByRange(parts, "doc_id", "h").sortWithinPartitions("doc_id", "h")

    def shards(batches):
        where = TaskContext.get().partitionId()  # ranges are numbered in their order
        nth, start, docs_, ids_, held = 0, 0, [], [], 0
        last, occurrence = None, -1
        for part, ids, offs in encode_batches(batches, vocabulary, False, end_id):
            doc_id = part.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
            for k, d in enumerate(doc_id.tolist()):
                if held >= shard_ids:
                    yield _shard(where, nth, start, width, docs_, ids_, occurrence)
                    nth, start, docs_, ids_, held = nth + 1, start + held, [], [], 0
                last, occurrence = d, occurrence + 1 if d == last else 0
                docs_.append(d)
                ids_.append(ids[offs[k] : offs[k + 1]])
                held += len(ids_[-1])
        if docs_:
            yield _shard(where, nth, start, width, docs_, ids_, occurrence)

    ordered.mapInArrow(shards, SHARD_SQL).write.option("compression", "zstd").parquet(f"{path}/shards")


@dataclass
class Ranges:
    """What the driver knows of a store: for each range the ids before it and the rows of its first id before it."""

    starts: dict[int, int]
    copies: dict[int, tuple[int, int]]
    n_docs: int

    @property
    def bits(self) -> int:
        """Of a key's hash, that number its bucket."""
        return max(0, (self.n_docs // BUCKET_KEYS).bit_length())


def _shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHARD_SQL).parquet(f"{path}/shards")


def _ranges(spark: SparkSession, path: str) -> Ranges:
    ends = _shards(spark, path).groupBy("range").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_ids").alias("n_ids"), F.min_by("first_id", "shard").alias("first_id"), F.max_by(F.struct("last_id", "last_occurrence"), "shard").alias("last"))
    starts, copies, n_docs, ids = {}, {}, 0, 0
    before = (None, -1)  # the last id so far, and which of its rows came last
    for r in sorted(ends.collect(), key=lambda r: r["range"]):
        starts[r["range"]] = ids
        same = before[1] + 1 if r["first_id"] == before[0] else 0
        copies[r["range"]] = (r["first_id"], same)
        last, nth = r["last"]
        before = (last, nth + (same if last == r["first_id"] else 0))
        n_docs, ids = n_docs + r["n_docs"], ids + r["n_ids"]
    return Ranges(starts, copies, n_docs)


def _buckets(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


def _places(spark: SparkSession, path: str, ranges: Ranges) -> DataFrame:
    """(bucket, doc_id, occurrence, range, shard, place) of every row of the shards; reads the shards' keys only."""
    schema = pa.schema([("bucket", pa.int64()), ("doc_id", pa.int64()), ("occurrence", pa.int64()), ("range", pa.int32()), ("shard", pa.int32()), ("place", pa.int32())])

    def places(batches):
        for b in batches:
            for row in b.to_pylist():
                doc_id = np.frombuffer(row["docs"], "<i8")
                n = len(doc_id)
                first = np.flatnonzero(np.append(True, doc_id[1:] != doc_id[:-1]))
                occurrence = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
                # ids go on over the ends of shards and ranges
                tail = doc_id == row["last_id"]
                occurrence[tail] = row["last_occurrence"] + 1 - tail.sum() + np.arange(tail.sum())
                shared, before = ranges.copies[row["range"]]
                occurrence[doc_id == shared] += before
                yield batch(schema, bucket=_buckets(key_hash(doc_id, occurrence), ranges.bits), doc_id=doc_id, occurrence=occurrence, range=np.full(n, row["range"], np.int32), shard=np.full(n, row["shard"], np.int32), place=np.arange(n, dtype=np.int32))

    return _shards(spark, path).select("range", "shard", "last_id", "last_occurrence", "docs").mapInArrow(places, PLACES_SQL)


def _write_index(spark: SparkSession, path: str) -> None:
    ranges = _ranges(spark, path)
    places = _places(spark, path, ranges)
    repeated = places.where("occurrence > 0").groupBy("doc_id").agg((F.max("occurrence") + 1).alias("copies")).withColumn("occurrence", F.lit(0).cast("long"))
    places = places.join(repeated, ["doc_id", "occurrence"], "left").withColumn("copies", F.coalesce("copies", F.lit(1)))

    def bucket_rows(batches):
        for key, cols in _by_key(batches, ("bucket",), ("doc_id", "occurrence", "range", "shard", "place", "copies")):
            for seed in range(8):  # two of the keys may have equal hashes
                hashes = key_hash(cols["doc_id"], cols["occurrence"], seed)
                try:
                    perfect = PerfectHash.build(hashes)
                    break
                except ValueError:
                    if seed == 7:
                        raise
            slot = perfect.slots(hashes)
            table = np.zeros(len(hashes), SLOT)
            table["print"][slot] = (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            for name in ("range", "shard", "place", "copies"):
                table[name][slot] = cols[name]
            yield batch(INDEX, bucket=[key[0]], seed=[seed], levels=[perfect.to_bytes()], slots=[table.tobytes()])

    parts = max(1, min(1 << ranges.bits, partitions(places)))
    dealt = places.repartition(parts, "bucket").sortWithinPartitions("bucket").select("bucket", "doc_id", "occurrence", "range", "shard", "place", "copies")
    dealt.mapInArrow(bucket_rows, INDEX_SQL).write.option("compression", "zstd").parquet(f"{path}/index")


def _by_key(batches, key: tuple[str, ...], columns: tuple[str, ...]):
    """(key, arrays) of each run of rows with equal keys."""
    current, held = None, []

    def whole():
        return {c: np.concatenate([h[c] for h in held]) for c in columns}

    for b in batches:
        keys = np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in key])
        edge = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(0))) if b.num_rows else np.empty(0, np.int64)
        for lo, hi in zip(edge.tolist(), [*edge.tolist()[1:], b.num_rows], strict=True) if len(edge) else ():
            own = tuple(keys[:, lo].tolist())
            if own != current and held:
                yield current, whole()
                held = []
            current = own
            held.append({c: b.column(c).slice(lo, hi - lo).to_numpy(zero_copy_only=False) for c in columns})
    if held:
        yield current, whole()


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int = 1, shard_ids: int = SHARD_IDS) -> None:
    """Encode every text and write the store to ``path``; the texts are shuffled once, by range."""
    prepare(docs.sparkSession)
    _write_shards(docs, path, vocabulary, end_id, shard_ids)
    _write_index(docs.sparkSession, path)


def _meet(holders: DataFrame, requests: DataFrame, keys: tuple[str, ...], answer, answer_sql: str, parts: int) -> DataFrame:
    """``answer(holder, arrays)`` for the requests of each holder, a row that comes before them and is held alone."""
    hold, ask = [c for c in holders.columns if c not in keys], [c for c in requests.columns if c not in keys]
    left = holders.select(*keys, F.lit(0).alias("_turn"), *hold, *[F.lit(None).cast(requests.schema[c].dataType).alias(c) for c in ask])
    right = requests.select(*keys, F.lit(1).alias("_turn"), *[F.lit(None).cast(holders.schema[c].dataType).alias(c) for c in hold], *ask)
    both = left.unionByName(right).repartition(parts, *keys).sortWithinPartitions(*keys, "_turn")

    def run(batches):
        holder, at = None, None
        for b in batches:
            turn = b.column("_turn").to_numpy(zero_copy_only=False)
            where = np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in keys])
            edge = np.flatnonzero(np.append(True, (turn[1:] != turn[:-1]) | (turn[1:] == 0) | (where[:, 1:] != where[:, :-1]).any(0))) if b.num_rows else np.empty(0, np.int64)
            for lo, hi in zip(edge.tolist(), [*edge.tolist()[1:], b.num_rows], strict=True) if len(edge) else ():
                key = tuple(where[:, lo].tolist())
                if turn[lo] == 0:
                    holder, at = b.slice(lo, 1).select([*keys, *hold]).to_pylist()[0], key
                elif key == at:
                    yield answer(holder, {c: b.column(c).slice(lo, hi - lo).to_numpy(zero_copy_only=False) for c in ask})

    return both.mapInArrow(run, answer_sql)


def _located(spark: SparkSession, path: str, keys: DataFrame, parts: int) -> DataFrame:
    """(range, shard, place, doc_id, copies) of the (bucket, doc_id, occurrence) that the index knows."""
    schema = pa.schema([("range", pa.int32()), ("shard", pa.int32()), ("place", pa.int32()), ("doc_id", pa.int64()), ("copies", pa.int64())])

    def find(row: dict, asked: dict) -> pa.RecordBatch:
        hashes = key_hash(asked["doc_id"], asked["occurrence"], row["seed"])
        slot = PerfectHash.from_bytes(row["levels"]).slots(hashes)
        got = np.frombuffer(row["slots"], SLOT)[slot]
        ok = (slot >= 0) & (got["print"] == (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        return batch(schema, doc_id=asked["doc_id"][ok], **{c: got[c][ok] for c in ("range", "shard", "place", "copies")})

    index = spark.read.schema(INDEX_SQL).parquet(f"{path}/index")
    return _meet(index, keys, ("bucket",), find, "range int, shard int, place int, doc_id long, copies long", parts)


def _fetched(spark: SparkSession, path: str, located: DataFrame, ranges: Ranges, schema: pa.Schema, columns, sql: str, parts: int) -> DataFrame:
    """``columns(starts, ids)`` of each located document, read from its shard's payload."""

    def fetch(row: dict, asked: dict) -> pa.RecordBatch:
        offsets, docs = np.frombuffer(row["offsets"], "<i8"), np.frombuffer(row["docs"], "<i8")
        payload = np.frombuffer(row["payload"], f"<u{row['width']}")
        place = asked["place"][docs[asked["place"]] == asked["doc_id"]]
        doc_id = docs[place]
        starts = ranges.starts[row["range"]] + row["start"] + offsets[place]
        ids = [payload[a:b] for a, b in zip(offsets[place].tolist(), offsets[place + 1].tolist(), strict=True)]
        return batch(schema, doc_id=pa.array(doc_id, mask=doc_id == NO_ID), **columns(starts, ids))

    shards = _shards(spark, path).select("range", "shard", "start", "width", "docs", "offsets", "payload")
    return _meet(shards, located.select("range", "shard", "place", "doc_id"), ("range", "shard"), fetch, sql, parts)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every key, each read through the index."""
    prepare(spark)
    ranges = _ranges(spark, path)
    parts = partitions(_shards(spark, path))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def digest(starts, ids):
        return {"start": starts, "n_tokens": [len(x) for x in ids], "ids_crc32": [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]}

    located = _located(spark, path, _places(spark, path, ranges).select("bucket", "doc_id", "occurrence"), parts)
    return _fetched(spark, path, located, ranges, schema, digest, "doc_id long, start long, n_tokens long, ids_crc32 long", parts)


def lookup(keys: DataFrame, path: str) -> DataFrame:
    """(doc_id, start, ids) of every document whose id is among the ``doc_id`` of ``keys``, null for null.

    A document of several rows is returned with each; ids that the store lacks give no row, and ids that
    ``keys`` repeats are looked up once.
    """
    spark = keys.sparkSession
    prepare(spark)
    ranges = _ranges(spark, path)
    parts = partitions(keys)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.list_(pa.int32()))])

    @F.pandas_udf("long")
    def bucket(doc_id: pd.Series, occurrence: pd.Series) -> pd.Series:
        return pd.Series(_buckets(key_hash(doc_id.to_numpy(np.int64), occurrence.to_numpy(np.int64)), ranges.bits))

    def keyed(df: DataFrame) -> DataFrame:
        return df.select(bucket("doc_id", "occurrence").alias("bucket"), "doc_id", "occurrence")

    wanted = keys.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.lit(0).cast("long").alias("occurrence")).distinct()
    first = _located(spark, path, keyed(wanted), parts)
    more = first.where("copies > 1").select("doc_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies") - 1)).alias("occurrence"))
    located = first.unionByName(_located(spark, path, keyed(more), parts))
    return _fetched(spark, path, located, ranges, schema, lambda starts, ids: {"start": starts, "ids": [x.astype(np.int32) for x in ids]}, "doc_id long, start long, ids array<int>", parts)


def query(docs: DataFrame, vocabulary: str) -> DataFrame:
    """The contract's digest: write a store in the shared folder and read every document back from it."""
    spark = docs.sparkSession
    path = working_path(spark, "tokens")
    write(docs, path, vocabulary)
    return read(spark, path)
