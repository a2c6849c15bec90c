"""Near-duplicate documents by consistent weighted sampling over TF-IDF shingles.

1. A five-word shingle of d among n documents has the inverse frequency 1 + ln((n + 1) / (d + 1)), at most
   1 + ln(CEILING). So only shingles of more than one document in CEILING need their exact count, and there are
   never more of them than CEILING times the shingles of an average document, however large the corpus is.
   A sketch of 2**20 cells tells which shingles can be so frequent, and these are counted exactly, over all rows.
   The ceiling bounds how much less the common shingles of a large group of near copies weigh than what is new
   in each (README has figures); below it, nothing is approximate.
2. Each distinct text is sampled by improved consistent weighted sampling: hash k keeps the shingle
   with the least a = c / exp(r (t - b + 1)), t = floor(ln w / r + b), under weights w = tf x idf.
   64 samples make 16 bands of 4; texts that agree in a band are candidates. Texts of similarity
   0.8 agree in some band with probability 1 - 2e-4, 0.9 with 1 - 7e-8.
3. Candidates are verified by weighted Jaccard similarity, sum of minima over sum of maxima, and
   texts that are linked, directly or through others, are one class, named by its least ``doc_id``.

Copies: equal texts are one class before any sampling, so a text of thousands of copies is sampled
and compared once. Bands in which the same set of texts meets are compared once. Sets of more than
``BLOCK`` texts are split into blocks. First each block is compared in itself, together with the ``HUBS`` texts that all
blocks of the set share, which finds most classes with one row for each text. Then texts that are not in one
class yet are compared between blocks: a class of at least ``BLOCK`` texts has blocks of its own, which are
not compared with each other, and every other pair of blocks is, in a task of its own. So no group has to fit
into one task, no candidate pair is left out but those in one class already, and n near copies cost about n rows
instead of n * n / BLOCK; a task returns a spanning forest of its links, not all pairs.

Defined results: null text is empty; empty texts are copies of each other; texts of fewer than five
words have one shingle of all their words; rows that repeat a ``doc_id`` are in the class of their
texts, and a ``doc_id`` with several texts gets a row for each; a null ``doc_id`` names a class only
if all its ids are null; classes are told apart by ``class_root``, the least digest of their texts, as unrelated
texts may have null or equal ids; an empty table gives no rows; ``keep_one`` keeps all columns.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm import textkit as tk
from lodestone.llm.common import batch, partitions, prepare
from lodestone.session import materialize

SIMILARITY = 0.8
BANDS, ROWS = 16, 4
SAMPLES = BANDS * ROWS
#: Shingles of fewer than one document in so many weigh alike.
CEILING = 64
CELL_BITS = 20
#: Tasks that add up each piece of the sketch before one task adds these.
LANES = 32
#: The sketch travels in pieces of so many cells.
PIECE = 1 << 14
#: Rows of sampling variates; a shingle uses the row of its hash.
VARIATE_BITS = 14
BLOCK = 128
HUBS = 4


def _cell(value: np.ndarray) -> np.ndarray:
    return (value >> np.uint64(64 - CELL_BITS)).astype(np.int64)


@dataclass
class Frequencies:
    """Documents that have each frequent shingle, of ``n_docs``; ``values`` are sorted."""

    n_docs: int
    values: np.ndarray
    counts: np.ndarray

    def inverse(self, value: np.ndarray) -> np.ndarray:
        """The inverse frequency of each shingle."""
        out = np.full(len(value), 1 + np.log(CEILING), np.float32)
        if len(self.values) and len(value):
            at = np.minimum(np.searchsorted(self.values, value), len(self.values) - 1)
            known = self.values[at] == value
            out[known] = 1 + np.log(np.minimum((self.n_docs + 1) / (self.counts[at[known]] + 1), CEILING))
        return out


def _sketch(docs: DataFrame) -> tuple[np.ndarray, int]:
    """(documents with a shingle in each cell, number of documents), over all rows."""
    schema = pa.schema([("piece", pa.int32()), ("lane", pa.int32()), ("n_docs", pa.int64()), ("counts", pa.binary())])
    kinds = "piece int, lane int, n_docs long, counts binary"

    def count(batches):
        n, docs_ = np.zeros(1 << CELL_BITS, np.int64), 0
        for whole in batches:
            for part in tk.slices(whole, "text", 1_000_000):
                _, value, _ = tk.elements(*tk.shingles(*tk.buffers(part.column("text"))))
                n += np.bincount(_cell(value), minlength=1 << CELL_BITS)
                docs_ += part.num_rows
        if docs_:
            lane = TaskContext.get().partitionId() % LANES
            for k, x in enumerate(n.reshape(-1, PIECE)):
                yield batch(schema, piece=[k], lane=[lane], n_docs=[docs_ if k == 0 else 0], counts=[zstandard.compress(x.tobytes(), 1)])

    def add(batches):
        sums: dict[tuple[int, int], list] = {}
        for b in batches:
            for k, lane, d, raw in zip(*(b.column(c).to_pylist() for c in schema.names), strict=True):
                own = sums.setdefault((k, lane), [0, np.zeros(PIECE, np.int64)])
                own[0] += d
                own[1] += np.frombuffer(zstandard.decompress(raw), np.int64)
        for (k, _), (d, x) in sums.items():
            yield batch(schema, piece=[k], lane=[0], n_docs=[d], counts=[zstandard.compress(x.tobytes(), 1)])

    summed = docs.select("text").mapInArrow(count, kinds).repartition("piece", "lane").mapInArrow(add, kinds).repartition("piece").mapInArrow(add, kinds)
    found = np.zeros((1 << CELL_BITS) // PIECE * PIECE, np.int64).reshape(-1, PIECE)
    n = 0
    for r in summed.toLocalIterator():  # one piece of the sketch each, 8 MB together
        found[r["piece"]] = np.frombuffer(zstandard.decompress(r["counts"]), np.int64)
        n += r["n_docs"]
    return found.reshape(-1), n


def frequencies(docs: DataFrame) -> Frequencies:
    """The exact counts of all shingles that more than one document in CEILING has."""
    prepare(docs.sparkSession)
    cells, n = _sketch(docs)
    least = (n + 1) / CEILING - 1  # more documents than this
    near = cells > least
    wanted = docs.sparkSession.sparkContext.broadcast(np.packbits(near))
    schema = pa.schema([("value", pa.int64()), ("n", pa.int64())])

    def count(batches):
        open_ = np.unpackbits(wanted.value).astype(bool)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush():
            value, at = np.unique(np.concatenate([v for v, _ in held]), return_inverse=True)
            total = np.bincount(at, weights=np.concatenate([k for _, k in held])).astype(np.int64)
            for k in range(0, len(value), 100_000):
                yield batch(schema, value=value[k : k + 100_000].view(np.int64), n=total[k : k + 100_000])

        for whole in batches:
            for part in tk.slices(whole, "text", 1_000_000):
                _, value, _ = tk.elements(*tk.shingles(*tk.buffers(part.column("text"))))
                own, k = np.unique(value[open_[_cell(value)]], return_counts=True)
                held.append((own, k))
                size += len(own)
                if size > 500_000:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()

    if not near.any():
        return Frequencies(n, np.empty(0, np.uint64), np.empty(0, np.int64))
    counted = docs.select("text").mapInArrow(count, "value long, n long").groupBy("value").agg(F.sum("n").alias("n")).where(F.col("n") > least)
    found = counted.toPandas()  # at most CEILING times the shingles of an average document
    value, k = found["value"].to_numpy(np.int64).view(np.uint64), found["n"].to_numpy(np.int64)
    order = np.argsort(value)
    return Frequencies(n, value[order], k[order])


def _variates() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r and ln c of Gamma(2, 1) variates and uniform b, a row of SAMPLES for each row number."""
    n = 1 << VARIATE_BITS
    state = tk.mix(np.arange(5 * n * SAMPLES, dtype=np.uint64) + np.uint64(tk.POLY))
    u = ((state >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)
    u = u.reshape(5, n, SAMPLES)
    r = -np.log(u[0] * u[1])
    c = -np.log(u[2] * u[3])
    return r.astype(np.float32), np.log(c).astype(np.float32), u[4].astype(np.float32)


_tables: list = []


def signatures(row: np.ndarray, value: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """n x SAMPLES 32-bit samples; elements are sorted by row, each of positive weight. Rows without any have zeros."""
    if not _tables:
        _tables.append(_variates())
    r_all, c_all, b_all = _tables[0]
    out = np.zeros((n, SAMPLES), np.uint32)
    if not len(row):
        return out
    line = (tk.mix(value) & np.uint64((1 << VARIATE_BITS) - 1)).astype(np.int64)
    log_w = np.log(weight.astype(np.float32))
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    # whole rows at a time, of some thousand elements together
    at = 0
    while at < len(first):
        to = int(np.searchsorted(first, first[at] + 4096, "right"))
        to = max(at + 1, min(to, len(first)))
        a, b = int(first[at]), int(first[to]) if to < len(first) else len(row)
        own = line[a:b]
        r, shift = r_all[own], b_all[own]
        t = np.floor(log_w[a:b, None] / r + shift)
        rank = c_all[own] - r * (t - shift + 1)
        starts = first[at:to] - a
        least = np.minimum.reduceat(rank, starts, axis=0)
        sizes = np.diff(np.append(starts, b - a))
        hit_e, hit_k = np.nonzero(rank == np.repeat(least, sizes, axis=0))
        sample = tk.mix(value[a:b][hit_e] + t[hit_e, hit_k].astype(np.int64).view(np.uint64) * np.uint64(tk.POLY))
        out[row[a:b][hit_e], hit_k] = (sample >> np.uint64(32)).astype(np.uint32)
        at = to
    return out


def weighted(column, idf: Frequencies) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, times, inverse frequency) of the distinct shingles of each text."""
    row, value, times = tk.elements(*tk.shingles(*tk.buffers(column)))
    return row, value, times, idf.inverse(value)


def _signed(docs: DataFrame, idf) -> DataFrame:
    """(doc_id, copy, signature) of every row; ``copy`` is a digest of the text."""
    schema = pa.schema([("doc_id", pa.int64()), ("copy", pa.string()), ("signature", pa.binary())])

    def sign(batches):
        for whole in batches:
            for part in tk.slices(whole, "text", 1_000_000):
                row, value, times, own = weighted(part.column("text"), idf.value)
                sig = signatures(row, value, times * own, part.num_rows)
                bands = sig.reshape(-1, BANDS, ROWS).astype(np.uint64)
                key = np.zeros(bands.shape[:2], np.uint64)
                for k in range(ROWS):
                    key = tk.mix(key * np.uint64(tk.POLY) + bands[:, :, k] + np.uint64(1))
                empty = np.bincount(row, minlength=part.num_rows) == 0
                raw = [None if e else x.tobytes() for e, x in zip(empty.tolist(), key, strict=True)]
                yield batch(schema, doc_id=part.column("doc_id"), copy=part.column("copy"), signature=raw)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("copy"), "text")
    return texts.mapInArrow(sign, "doc_id long, copy string, signature binary")


def _meetings(representatives: DataFrame) -> DataFrame:
    """(meeting, copy, h, n): the texts that agree in a band, each set of texts once."""
    band = F.explode(F.array(*[F.struct(F.lit(k).alias("band"), F.substring("signature", 8 * k + 1, 8).alias("key")) for k in range(BANDS)])).alias("b")
    met = representatives.where(F.col("signature").isNotNull()).select("copy", F.xxhash64("copy").alias("h"), band)
    met = met.select("copy", "h", F.xxhash64("b.band", "b.key").alias("meeting"))
    sets = met.groupBy("meeting").agg(F.count("*").alias("n"), F.bit_xor("h").alias("x"), F.min("h").alias("low"), F.max("h").alias("high")).where("n > 1")
    once = sets.groupBy("n", "x", "low", "high").agg(F.min("meeting").alias("meeting")).select("meeting", "n")
    return met.join(once, "meeting").select("meeting", "copy", "h", "n")


def _blocks(n: Column | str) -> Column:
    return F.ceil((F.col(n) if isinstance(n, str) else n) / BLOCK).cast("int")


def _in_blocks(met: DataFrame) -> DataFrame:
    """(meeting, i, j, copy): each text in its block, and the hubs of a meeting in every block of it."""
    own = F.pmod(F.xxhash64("h", F.lit(5)), _blocks("n")).cast("int")
    alone = met.select("meeting", "copy", own.alias("i"))
    # the least of a few hashes of the texts, found by aggregates and not by a window over the meeting
    large = met.where(F.col("n") > BLOCK)
    picks = [F.min(F.struct(F.xxhash64("h", F.lit(100 + k)).alias("by"), "copy"))["copy"].alias(f"c{k}") for k in range(HUBS)]
    hubs = large.groupBy("meeting").agg(F.max("n").alias("n"), *picks)
    hubs = hubs.select("meeting", "n", F.explode(F.array_distinct(F.array(*[f"c{k}" for k in range(HUBS)]))).alias("copy"))
    hubs = hubs.select("meeting", "copy", F.explode(F.sequence(F.lit(0), _blocks("n") - 1)).alias("i"))
    return alone.unionByName(hubs).select("meeting", "i", F.col("i").alias("j"), "copy")


def _between_blocks(met: DataFrame, roots: DataFrame) -> DataFrame:
    """(meeting, i, j, copy): texts of large meetings for every pair of blocks that isn't of one class."""
    large = met.where(F.col("n") > BLOCK).join(roots, "copy", "left").withColumn("root", F.coalesce("root", "copy"))
    sizes = large.groupBy("meeting", "root").agg(F.count("*").alias("k"))
    several = sizes.groupBy("meeting").agg(F.count("*").alias("classes"), F.sum(F.when(F.col("k") < BLOCK, F.col("k")).otherwise(0)).alias("rest")).where("classes > 1")
    sizes = sizes.join(several.select("meeting", "rest"), "meeting")
    pure = F.col("k") >= BLOCK
    sizes = sizes.select("meeting", "root", F.when(pure, F.col("root")).otherwise("").alias("of"), _blocks(F.when(pure, F.col("k")).otherwise(F.col("rest"))).alias("m"))
    every = sizes.select("meeting", "of", "m").distinct().select("meeting", "of", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("nth"))
    every = every.select("meeting", F.col("of").alias("of_b"), F.xxhash64("of", "nth").alias("b"))
    placed = large.join(sizes, ["meeting", "root"]).select("meeting", "copy", "of", F.xxhash64("of", F.pmod(F.xxhash64("h", F.lit(7)), F.col("m")).cast("int")).alias("a"))
    pairs = placed.join(every, "meeting").where((F.col("of") != F.col("of_b")) | (F.col("of") == ""))
    return pairs.select("meeting", F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"), "copy")


def _verify(rows: DataFrame, idf, least: float) -> DataFrame:
    """(a, b) links among the texts of each group; the rows of a group are next to each other."""
    schema = pa.schema([("a", pa.string()), ("b", pa.string())])

    def links(batches):
        held: list[tuple] = []
        current = None
        for whole in batches:
            for part in tk.slices(whole, "text", 2_000_000):
                row, value, times, own = weighted(part.column("text"), idf.value)
                at = np.searchsorted(row, np.arange(part.num_rows + 1))
                keys = list(zip(*(part.column(c).to_pylist() for c in ("meeting", "i", "j")), strict=True))
                names = part.column("copy").to_pylist()
                for k, key in enumerate(keys):
                    if key != current:
                        yield from compare(held)
                        held, current = [], key
                    if held and held[-1][0] == names[k]:  # a row that is repeated
                        continue
                    s = slice(at[k], at[k + 1])
                    held.append((names[k], value[s], times[s], own[s]))
        yield from compare(held)

    def compare(group):
        if len(group) < 2:
            return
        found = similar_pairs([g[1:] for g in group], least)
        names = [g[0] for g in group]
        if found:
            yield batch(schema, a=[names[i] for i, _ in found], b=[names[j] for _, j in found])

    return rows.mapInArrow(links, "a string, b string")


def similar_pairs(texts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], least: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of at least that weighted Jaccard similarity."""
    n = len(texts)
    # w = times x idf: an element that occurs k times is k elements of weight idf, and minima are intersections
    value, weight, owner = [], [], []
    for k, (v, times, idf) in enumerate(texts):
        turn = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        value.append(np.where(turn == 0, np.repeat(v, times), tk.mix(np.repeat(v, times) + turn.astype(np.uint64) * np.uint64(tk.POLY))))
        weight.append(np.repeat(idf, times))
        owner.append(np.full(len(turn), k))
    value, weight, owner = np.concatenate(value), np.concatenate(weight).astype(np.float32), np.concatenate(owner)
    total = np.bincount(owner, weights=weight, minlength=n)
    kinds, first, at, count = np.unique(value, return_index=True, return_inverse=True, return_counts=True)
    both = np.zeros((n, n), np.float64)
    shared = np.flatnonzero(count > 1)
    number = np.full(len(kinds), -1)
    number[shared] = np.arange(len(shared))
    column = number[at]
    for k in range(0, len(shared), 16384):
        here = (column >= k) & (column < k + 16384)
        has = np.zeros((n, min(16384, len(shared) - k)), np.float32)
        has[owner[here], column[here] - k] = 1
        both += (has * weight[first[shared[k : k + 16384]]]) @ has.T
    union = total[:, None] + total[None, :] - both
    linked = both >= least * union - 1e-6 * union
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    forest = []
    for i, j in zip(*np.nonzero(np.triu(linked, 1)), strict=True):
        a, b = find(int(i)), find(int(j))
        if a != b:
            root[b] = a
            forest.append((int(i), int(j)))
    return forest


def components(links: DataFrame) -> DataFrame:
    """(copy, root): the least name that each linked text reaches. Labels halve their distance each round."""
    both = materialize(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = materialize(both.groupBy(F.col("a").alias("copy")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("copy", "b"), "b").groupBy("a").agg(F.min("root").alias("near"))
        closer = labels.join(near, labels["copy"] == near["a"]).select("copy", "root", F.least("root", "near").alias("new"))
        jump = labels.select(F.col("copy").alias("new"), F.col("root").alias("far"))
        nearer = closer.join(jump, "new", "left").select("copy", F.col("root").alias("old"), F.least("new", F.coalesce("far", "new")).alias("root"))
        nearer = materialize(nearer, "labels")
        labels = nearer.select("copy", "root")
        if nearer.where(F.col("old") != F.col("root")).isEmpty():
            return labels


def classes(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(doc_id, copy, root, class_id, class_size) of each row: ``root``, the least digest of the class's texts, tells classes apart whose ``class_id`` is null or equal."""
    spark = docs.sparkSession
    prepare(spark)
    idf = spark.sparkContext.broadcast(frequencies(docs))
    signed = materialize(_signed(docs, idf), "signatures")
    texts = materialize(signed.groupBy("copy").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n"), F.max("signature").alias("signature")), "texts")
    met = materialize(_meetings(texts), "meetings")

    # one row of docs for each text that meets another, by id or, for texts whose ids are all null, by digest
    needed = met.select("copy").distinct().join(texts.select("copy", "least_id"), "copy")
    digest = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    bodies = docs.select(F.col("doc_id").cast("long").alias("least_id"), "text")
    by_id = needed.join(bodies, "least_id").where(digest == F.col("copy")).select("copy", "text")
    nameless = bodies.where(F.col("least_id").isNull()).select(digest.alias("copy"), "text")
    by_text = nameless.join(needed.where(F.col("least_id").isNull()).select("copy"), "copy", "left_semi").dropDuplicates(["copy"])
    bodies = materialize(by_id.unionByName(by_text), "bodies", "zstd")
    parts = partitions(docs)

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        grouped = pairs.join(bodies, "copy").select("meeting", "i", "j", "copy", "text").repartition(parts, "meeting", "i", "j").sortWithinPartitions("meeting", "i", "j", "copy")
        return materialize(_verify(grouped, idf, least), name)

    links = verified(_in_blocks(met), "links-in")
    between = _between_blocks(met, components(links)) if not met.where(F.col("n") > BLOCK).isEmpty() else None
    if between is not None:
        links = links.unionByName(verified(between, "links-between"))
    roots = components(links)

    linked = texts.join(roots, "copy", "left").withColumn("root", F.coalesce("root", "copy"))
    whole = linked.groupBy("root").agg(F.min("least_id").alias("class_id"), F.sum("n").alias("class_size"))
    named = linked.join(whole, "root").select("copy", "root", "class_id", "class_size")
    return signed.select("doc_id", "copy").join(named, "copy").select("doc_id", "copy", "root", "class_id", "class_size")


def query(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, class_size, class_root) of each row of ``docs``; ``class_root`` tells classes apart of equal or null ``class_id``."""
    return classes(docs).select("doc_id", "class_id", "class_size", F.col("root").alias("class_root"))


def keep_one(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The row of ``docs`` with the least ``doc_id`` of each class, one of those without an id if all are."""
    found = classes(docs, least)
    stays = found.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("root").agg(F.min("class_id").alias("class_id"), F.min("copy").alias("copy"))
    names = docs.columns
    rows = docs.select(F.struct(*[docs[c] for c in names]).alias("row"), F.col("doc_id").cast("long").alias("id"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("copy"))
    kept = rows.alias("a").join(stays.alias("b"), (F.col("a.copy") == F.col("b.copy")) & F.col("a.id").eqNullSafe(F.col("b.class_id")), "left_semi")
    one = kept.withColumn("nth", F.row_number().over(Window.partitionBy("id", "copy").orderBy("id"))).where("nth = 1")
    return one.select("row.*")
