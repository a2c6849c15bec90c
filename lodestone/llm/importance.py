"""Resampling documents towards a target distribution by hashed n-gram features.

Method. Each task runs DuckDB over slices of its texts: SQL unnests the words of a text, windows of
``lag`` make its runs of 1 to ``n`` words, and a registered function takes the CRC-32 of each distinct run, whose
remainder is the run's bucket. What comes out are bucket counts, of each document and of all the task's
documents together; Spark spills both to Parquet in the shared folder. Spark then merges the totals, the
gain of each bucket follows from those of the documents and of the target, and the documents are scored
from their spilled counts, so texts are read once. A Gumbel variate from the id's hash turns the highest
scores into a draw without replacement.

Scale. The totals are at most ``buckets`` rows a task, summed by bucket with partial sums; gains are
``buckets`` numbers, a parameter, and so the only thing that is sent to all tasks. A document's counts are at
most ``buckets`` numbers, however long its text is; long texts go through DuckDB in pieces. Ranks come
from one range sort, whose partitions are numbered by the counts of those before them; rows equal
in score and id are spread by their place, so a hot id can't fill one partition.

Defined results: a null or empty text has no words, weight 0 and no rank; a null id is hashed as
no digits and comes after all ids of its score; repeated rows are documents of their own; an empty
table gives no rows; with an empty target every gain is as the formula says with T = 0.
"""

from __future__ import annotations

import hashlib
import math
import re
import string
import zlib

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import textkit as tk
from lodestone.llm.common import prepare
from lodestone.session import materialize

BUCKETS = 10_000
LEAST_WORDS = 20
SEED = 2024
#: Fixed value: a word is a run of lower-case ASCII letters, digits and characters beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SEPARATOR = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
_TO_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
#: Bytes of texts in one SQL query, and characters of a piece of a long text.
SLICE = 2_000_000
#: The row of a result that holds how many words a text has.
WORDS = -1

COUNTS = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("bucket", pa.list_(pa.int32())), ("n", pa.list_(pa.int64()))])
COUNTS_SQL = "kind int, doc_id long, n_words long, bucket array<int>, n array<long>"
DOCUMENT, TOTAL = 0, 1


def _crc(runs: pa.Array) -> pa.Array:
    return pa.array([zlib.crc32(x.encode()) for x in runs.to_pylist()], pa.int64())


def counting_sql(n: int, buckets: int) -> str:
    """(row, bucket, n) of table texts (piece, row, skip, text): runs that end after the piece's first ``skip`` words."""
    runs = ["SELECT row, word AS run FROM word WHERE pos > skip"]
    for k in range(2, n + 1):
        parts = [f"lag(word, {j}) OVER (PARTITION BY piece ORDER BY pos)" for j in range(k - 1, 0, -1)]
        runs.append(f"SELECT row, run FROM (SELECT row, pos, skip, {' || chr(32) || '.join([*parts, 'word'])} AS run FROM word) WHERE run IS NOT NULL AND pos > skip")
    return f"""
        WITH split AS (
            SELECT piece, row, skip, regexp_extract_all(translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{WORD}') AS words FROM texts
        ), word AS MATERIALIZED (
            SELECT piece, row, skip, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM split
        ), counted AS MATERIALIZED (
            SELECT row, run, count(*) AS n FROM ({" UNION ALL ".join(runs)}) GROUP BY row, run
        ), named AS (
            SELECT run, crc_of(run) % {buckets} AS bucket FROM (SELECT DISTINCT run FROM counted)
        )
        SELECT row, bucket, CAST(sum(n) AS BIGINT) AS n FROM counted JOIN named USING (run) GROUP BY row, bucket
        UNION ALL SELECT row, {WORDS}, count(*) FROM word WHERE pos > skip GROUP BY row
        ORDER BY row, bucket"""


class Counter:
    """Bucket counts of texts by DuckDB, in one process and within bounded memory."""

    def __init__(self, n: int, buckets: int):
        self.n, self.sql = n, counting_sql(n, buckets)
        self.con = duckdb.connect(config={"threads": "1", "memory_limit": "400MB", "temp_directory": ""})
        self.con.create_function("crc_of", _crc, ["VARCHAR"], "BIGINT", type="arrow")

    def pieces(self, texts: list[str | None]) -> dict[str, list]:
        """Texts, long ones cut between words; a later piece begins with the n - 1 words before it, which are skipped."""
        out: dict[str, list] = {"row": [], "skip": [], "text": []}
        for row, text in enumerate(texts):
            at, before = 0, []
            while text and at < len(text):
                cut = _SEPARATOR.search(text, at + SLICE)
                to = cut.start() if cut else len(text)
                body = text[at:to]
                for column, x in zip(out.values(), (row, len(before), " ".join([*before, body])), strict=True):
                    column.append(x)
                if self.n > 1 and to < len(text):
                    before = (before + re.findall(WORD, body.translate(_TO_LOWER)))[1 - self.n :]
                at = to
        return out

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, bucket, n) by row and bucket; bucket WORDS counts the words."""
        parts = self.pieces(texts)
        if not parts["row"]:
            return (np.empty(0, np.int64),) * 3
        self.con.register("texts", pa.table({"piece": range(len(parts["row"]))} | parts))
        got = self.con.sql(self.sql).to_arrow_table()
        self.con.unregister("texts")
        return tuple(got.column(c).to_numpy().astype(np.int64) for c in ("row", "bucket", "n"))


def _count_task(n: int, buckets: int, by_document: bool):
    def run(batches):
        counter, totals = None, np.zeros(buckets, np.int64)
        for whole in batches:
            for part in tk.slices(whole, "text", SLICE):
                counter = counter or Counter(n, buckets)
                row, bucket, times = counter(part.column("text").to_pylist())
                is_run = bucket != WORDS
                words = np.zeros(part.num_rows, np.int64)
                words[row[~is_run]] = times[~is_run]
                row, bucket, times = row[is_run], bucket[is_run], times[is_run]
                np.add.at(totals, bucket, times)
                if by_document:
                    offs = pa.array(np.searchsorted(row, np.arange(part.num_rows + 1)), pa.int32())
                    lists = [pa.ListArray.from_arrays(offs, pa.array(x, kind)) for x, kind in ((bucket, pa.int32()), (times, pa.int64()))]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(part.num_rows, DOCUMENT), pa.int32()), part.column("doc_id"), pa.array(words), *lists], schema=COUNTS)
        held = np.flatnonzero(totals)
        if len(held):
            yield pa.RecordBatch.from_arrays([pa.array([TOTAL], pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([held], pa.list_(pa.int32())), pa.array([totals[held]], pa.list_(pa.int64()))], schema=COUNTS)

    return run


def counts(texts: DataFrame, n: int, buckets: int, by_document: bool, name: str) -> DataFrame:
    """Spilled bucket counts of (doc_id, text): a row for each document, and one of totals for each task."""
    return materialize(texts.mapInArrow(_count_task(n, buckets, by_document), COUNTS_SQL), name, "zstd")


def totals(spilled: DataFrame, buckets: int) -> np.ndarray:
    """The merged counts of all tasks, by bucket."""
    each = spilled.where(F.col("kind") == TOTAL).select(F.explode(F.arrays_zip("bucket", "n")).alias("x"))
    merged = each.groupBy(F.col("x.bucket").alias("bucket")).agg(F.sum("x.n").alias("n")).collect()  # at most ``buckets`` rows
    out = np.zeros(buckets, np.int64)
    for r in merged:
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What one occurrence of each bucket adds to a document's weight, in thousandths."""
    of_source, of_target = (float(x.sum() + len(x)) for x in (source, target))
    return np.array([math.floor(1000 * math.log((t + 1.0) * of_source / ((s + 1.0) * of_target))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def luck(doc_id: int | None, seed: int) -> int:
    """The Gumbel variate of an id, in thousandths."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


SCORED = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64()), ("score", pa.int64())])
SCORED_SQL = "doc_id long, n_words long, n_features long, weight long, score long"


def _score_task(gain: np.ndarray, seed: int):
    def run(batches):
        for b in batches:
            bucket, times = b.column("bucket"), b.column("n")
            row = np.repeat(np.arange(b.num_rows), np.diff(bucket.offsets.to_numpy()))
            at, times = bucket.flatten().to_numpy(), times.flatten().to_numpy()
            weight, features = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            np.add.at(weight, row, gain[at] * times)
            np.add.at(features, row, times)
            variate = np.array([luck(x, seed) for x in b.column("doc_id").to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_words"), pa.array(features), pa.array(weight), pa.array(weight + variate)], schema=SCORED)

    return run


def ranked(scored: DataFrame, least_words: int, percent: int) -> DataFrame:
    """``scored`` with the rank of the drawn rows: ``percent`` of those with enough words, by score and id."""
    sorts = scored.withColumn("_able", F.col("n_words") >= least_words).withColumn("_at", F.monotonically_increasing_id())
    sorts = sorts.orderBy(F.col("_able").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("weight").desc(), "_at")
    placed = materialize(sorts.withColumn("_part", F.spark_partition_id()).withColumn("_nth", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).drop("_at"), "ranked")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("rows"), F.count_if("_able").alias("able")).collect()  # a row for each partition of the sort
    drawn = sum(r["able"] for r in sizes) * percent // 100
    before, at = {}, 0
    for r in sorted(sizes, key=lambda r: r["_part"]):
        before[r["_part"]] = at
        at += r["rows"]
    spark = scored.sparkSession
    starts = F.broadcast(spark.createDataFrame(list(before.items()), "_part int, _before long"))
    rank = F.col("_before") + F.col("_nth") + 1
    return placed.join(starts, "_part").withColumn("rank", F.when(rank <= drawn, rank)).drop("_part", "_nth", "_before", "_able")


def resample(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = 10, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of ``docs``, drawn towards the texts of ``target``."""
    prepare(docs.sparkSession)
    spilled = counts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), n, buckets, True, "counts")
    wanted = counts(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), n, buckets, False, "target-counts")
    gain = gains(totals(spilled, buckets), totals(wanted, buckets))
    of_documents = spilled.where(F.col("kind") == DOCUMENT).select("doc_id", "n_words", "bucket", "n")
    return ranked(of_documents.mapInArrow(_score_task(gain, seed), SCORED_SQL), least_words, percent)


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's digest."""
    return resample(docs, benchmark).select("doc_id", "n_features", "weight", "score", "rank")


#: The bytes of a hexadecimal string in DuckDB.
_HEX = "list_transform(range(0, len(h) // 2), lambda i: (instr('0123456789ABCDEF', h[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', h[2 * i + 2]) - 1)"

#: The contract in SQL; CRC-32 is its table of 256 steps, folded over a word's bytes.
ORACLE = rf"""
WITH RECURSIVE step(i, c, k) AS (
    SELECT i, i, 0 FROM range(0, 256) t(i)
    UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END, k + 1 FROM step WHERE k < 8
), crc_table AS (
    SELECT list(c ORDER BY i) AS t FROM step WHERE k = 8
), word AS (
    SELECT 'd' AS side, rid, unnest(ws) AS word FROM (SELECT rowid AS rid, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{WORD}') AS ws FROM (SELECT row_number() OVER () AS rowid, * FROM documents))
    UNION ALL
    SELECT 'b', 0, unnest(ws) FROM (SELECT regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{WORD}') AS ws FROM benchmark)
), bytes AS (
    SELECT word, {_HEX} AS b FROM (SELECT word, hex(word) AS h FROM (SELECT DISTINCT word FROM word))
), bucket AS (
    SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(b, lambda x: x::BIGINT)), lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])), 4294967295::BIGINT) % {BUCKETS} AS bucket FROM bytes, crc_table
), counted AS (
    SELECT side, rid, bucket, count(*) AS n FROM word JOIN bucket USING (word) GROUP BY ALL
), total AS (
    SELECT k AS bucket, coalesce(s, 0) AS s, coalesce(t, 0) AS t FROM range(0, {BUCKETS}) r(k)
    LEFT JOIN (SELECT bucket, sum(n) FILTER (side = 'd') AS s, sum(n) FILTER (side = 'b') AS t FROM counted GROUP BY bucket) x ON x.bucket = k
), gain AS (
    SELECT bucket, CAST(floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + {BUCKETS})::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + {BUCKETS})::DOUBLE))) AS BIGINT) AS gain FROM total
), weighed AS (
    SELECT rid, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM counted JOIN gain USING (bucket) WHERE side = 'd' GROUP BY rid
), scored AS (
    SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score
    FROM (SELECT row_number() OVER () AS rid, doc_id, list_reduce(list_transform(range(1, 9), lambda i: (instr('0123456789abcdef', sha256('{SEED}:' || doc_id)[i]) - 1)::BIGINT), lambda a, x: a * 16 + x)::DOUBLE AS h FROM documents) d
    LEFT JOIN weighed USING (rid)
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id) AS r, count(*) OVER (PARTITION BY n_features >= {LEAST_WORDS}) AS total FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {LEAST_WORDS} AND r <= 10 * total // 100 THEN r END AS rank FROM placed"""
