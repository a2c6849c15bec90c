"""Queries of section W."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.operators import evaluation, relations
from lodestone.operators import ranking as W
from lodestone.plans.registry import query
from lodestone.sources import entities as E


@query("scenes", "SELECT scene_id, heat, row_number() OVER (ORDER BY heat DESC, scene_id) AS rank FROM scenes")
def w01_ranks(spark, sf):
    return evaluation.ranked(E.scenes(spark, sf), F.desc("heat"), F.asc("scene_id")).select("scene_id", "heat", "rank")


@query("memories", "SELECT memory_id FROM (SELECT memory_id, row_number() OVER (PARTITION BY content ORDER BY priority DESC, memory_id) AS n FROM memories) WHERE n = 1")
def w02_first_of_content(spark, sf):
    return W.first_of_content(E.memories(spark, sf), F.struct(-F.col("priority"), "memory_id")).select("memory_id")


def dedup_sql(rows: str) -> str:
    """Common table expressions: ``kept`` are the rows (section, rank, memory_id, content, …) that a walk in their order keeps.

    The walk carries what it has kept, so it is a recursion over the rows' numbers.
    """
    return f"""numbered AS (SELECT *, regexp_replace(substr(coalesce(content, ''), 1, 50), '[。！？!?.,，；; ]+$', '') AS prefix, row_number() OVER (ORDER BY section, rank) AS k FROM ({rows})),
    walk AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS ids, CAST([] AS VARCHAR[]) AS prefixes, false AS stays UNION ALL SELECT k, CASE WHEN ok THEN list_append(ids, memory_id) ELSE ids END, CASE WHEN ok THEN list_append(prefixes, prefix) ELSE prefixes END, ok
      FROM (SELECT n.k, ids, prefixes, memory_id, prefix, NOT list_contains(ids, memory_id) AND NOT list_contains(prefixes, prefix) AS ok FROM walk w JOIN numbered n ON n.k = w.k + 1)),
    kept AS (SELECT n.* FROM numbered n JOIN walk USING (k) WHERE stays)"""


TAGGED = "SELECT dimension_id AS section, row_number() OVER (PARTITION BY dimension_id ORDER BY priority DESC, memory_id) AS rank, memory_id, content FROM memories JOIN memory_tags USING (memory_id)"


@query("memories memory_tags", f"WITH RECURSIVE {dedup_sql(f'SELECT * FROM ({TAGGED}) WHERE rank <= 50')} SELECT section, rank, memory_id FROM kept")
def w03_sequential_dedup(spark, sf):
    rows = relations.top_per_group(E.memories(spark, sf).join(E.memory_tags(spark, sf), "memory_id"), "dimension_id", [F.desc("priority"), F.asc("memory_id")], 50)
    rank = F.row_number().over(Window.partitionBy("dimension_id").orderBy(F.desc("priority"), "memory_id"))
    rows = rows.select(F.lit("full").alias("mode"), F.col("dimension_id").alias("section"), rank.alias("rank"), "memory_id", "content")
    return W.sequential_dedup(rows).select("section", "rank", "memory_id")


@query("scene_memories memories", "SELECT scene_id, memory_id, n FROM (SELECT scene_id, memory_id, row_number() OVER (PARTITION BY scene_id ORDER BY priority DESC, memory_id) AS n FROM scene_memories JOIN memories USING (memory_id)) WHERE n <= 3")
def w04_top_per_group(spark, sf):
    joined = E.scene_memories(spark, sf).join(E.memories(spark, sf).select("memory_id", "priority"), "memory_id")
    return evaluation.ranked(joined, F.desc("priority"), F.asc("memory_id"), by="scene_id").where("rank <= 3").select("scene_id", "memory_id", F.col("rank").alias("n"))


@query("raw_files", "SELECT session_key, file_id FROM (SELECT *, row_number() OVER (PARTITION BY session_key ORDER BY started_at DESC, file_id DESC) AS n FROM raw_files) WHERE n = 1")
def w05_latest_per_session(spark, sf):
    return E.raw_files(spark, sf).groupBy("session_key").agg(F.max_by("file_id", F.struct("started_at", "file_id")).alias("file_id"))


@query("signal_events", "SELECT event_id, type FROM signal_events ORDER BY ts DESC, event_id DESC LIMIT 1")
def w06_latest_event(spark, sf):
    return E.signal_events(spark, sf).orderBy(F.desc("ts"), F.desc("event_id")).limit(1).select("event_id", "type")


@query("signal_events", "SELECT event_id, coalesce(ts - lag(ts) OVER (PARTITION BY type, source ORDER BY ts, event_id) <= INTERVAL 1800 SECOND, false) AS suppress_hint FROM signal_events")
def w07_suppression(spark, sf):
    return W.suppressed(E.signal_events(spark, sf)).select("event_id", "suppress_hint")


@query("signal_events", "SELECT type, source, CAST(epoch_us(max(ts)) AS BIGINT) AS last_us FROM signal_events GROUP BY 1, 2")
def w08_last_per_key(spark, sf):
    return E.signal_events(spark, sf).groupBy("type", "source").agg(F.unix_micros(F.max("ts").cast("timestamp")).alias("last_us"))


@query("memories", "SELECT memory_id, superseded_by FROM (SELECT memory_id, row_number() OVER w AS n, first_value(memory_id) OVER w AS superseded_by FROM memories WINDOW w AS (PARTITION BY content ORDER BY updated_at DESC, created_at DESC, memory_id)) WHERE n > 1")
def w09_keepers(spark, sf):
    return W.keepers(E.memories(spark, sf)).select("memory_id", "superseded_by")


@query("messages", "SELECT file_id, seq, CAST(greatest(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER w - CASE WHEN first_value(role) OVER w = 'user' THEN 1 ELSE 0 END, 0) AS INT) AS turn FROM messages WINDOW w AS (PARTITION BY file_id ORDER BY seq ROWS UNBOUNDED PRECEDING)")
def w10_turns(spark, sf):
    return W.turns(E.messages(spark, sf)).select("file_id", "seq", "turn")


def chunks_sql(most: int, least: int) -> str:
    """Chunks of whole turns by a recursion over turns, too large ones split by a recursion over messages."""
    return f"""
    WITH RECURSIVE m AS (SELECT *, 13 + length(CAST(seq AS VARCHAR)) + length(role) + length(content) AS size, row_number() OVER w AS k, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER w - CASE WHEN first_value(role) OVER w = 'user' THEN 1 ELSE 0 END AS turn
      FROM messages WHERE file_id IN (SELECT file_id FROM messages WHERE role = 'user') WINDOW w AS (PARTITION BY file_id ORDER BY seq)),
    t AS (SELECT file_id, turn, sum(size) AS size, row_number() OVER (PARTITION BY file_id ORDER BY turn) AS k FROM m GROUP BY 1, 2),
    c AS (SELECT file_id, turn, k, 0 AS chunk, size AS held FROM t WHERE k = 1 UNION ALL
      SELECT t.file_id, t.turn, t.k, c.chunk + (c.held >= {least} AND c.held + t.size > {most})::INT, CASE WHEN c.held >= {least} AND c.held + t.size > {most} THEN t.size ELSE c.held + t.size END FROM c JOIN t ON t.file_id = c.file_id AND t.k = c.k + 1),
    g AS (SELECT m.file_id, seq, length(content) AS n, chunk, sum(m.size) OVER (PARTITION BY m.file_id, chunk) AS total, row_number() OVER (PARTITION BY m.file_id, chunk ORDER BY seq) AS k FROM m JOIN c ON c.file_id = m.file_id AND c.turn = m.turn),
    p AS (SELECT file_id, chunk, seq, k, 0 AS part, n AS held, n AS last FROM g WHERE k = 1 UNION ALL
      SELECT g.file_id, g.chunk, g.seq, g.k, p.part + (g.total > 1.5 * {most} AND p.held + g.n > {most})::INT, CASE WHEN p.held + g.n > {most} THEN p.last ELSE p.held END + g.n, g.n FROM p JOIN g ON g.file_id = p.file_id AND g.chunk = p.chunk AND g.k = p.k + 1),
    o AS (SELECT file_id, chunk, part, seq FROM p UNION SELECT a.file_id, a.chunk, b.part, a.seq FROM p a JOIN p b ON a.file_id = b.file_id AND a.chunk = b.chunk AND b.k = a.k + 1 AND b.part > a.part),
    alone AS (SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY seq) - 1 AS k, seq FROM messages WHERE file_id NOT IN (SELECT file_id FROM messages WHERE role = 'user'))
    SELECT file_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY chunk, part) - 1 AS INT) AS chunk, seqs FROM (SELECT file_id, chunk, part, string_agg(seq, ',' ORDER BY seq) AS seqs FROM o GROUP BY 1, 2, 3)
    UNION ALL SELECT file_id, CAST(k // 20 AS INT), string_agg(seq, ',' ORDER BY seq) FROM alone GROUP BY 1, 2"""


@query("messages", chunks_sql(2000, 1000))
def w11_chunks(spark, sf):
    return W.chunks(E.messages(spark, sf), 2000, 1000)


@query("messages", chunks_sql(400, 200))
def w12_oversized_split(spark, sf):
    return W.chunks(E.messages(spark, sf), 400, 200)


@query()
def w13_text_chunks(spark, sf):
    text = F.concat(F.lit("# t "), F.when(F.col("role") == "system", "tool").otherwise(F.col("role")), F.lit("\n"), F.col("content"), F.lit("\n"))
    whole = E.messages(spark, sf).groupBy("file_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("seq", text.alias("t"))))["t"], "").alias("text"))
    return whole.select("file_id", F.posexplode(W.chunked("text")).alias("chunk", "text"))


@query("messages", """WITH RECURSIVE m AS (SELECT file_id, seq, length(content) AS cost, row_number() OVER (PARTITION BY file_id ORDER BY seq) AS k FROM messages),
    r AS (SELECT *, 0 AS batch, cost AS used FROM m WHERE k = 1 UNION ALL
      SELECT m.*, r.batch + (r.used > 0 AND r.used + m.cost > 1000)::INT, CASE WHEN r.used > 0 AND r.used + m.cost > 1000 THEN 0 ELSE r.used END + m.cost FROM r JOIN m ON m.file_id = r.file_id AND m.k = r.k + 1)
    SELECT file_id, seq, cost, batch FROM r""")  # fmt: skip
def w14_budget_batches(spark, sf):
    cost = E.messages(spark, sf).select("file_id", "seq", F.length("content").alias("cost"))
    return W.batches(cost, "file_id", "seq", "cost", 1000)


@query("memories", "SELECT memory_id, CAST(floor((row_number() OVER (PARTITION BY memory_type ORDER BY memory_id) - 1) / 20) AS INT) AS batch FROM memories")
def w15_fixed_batches(spark, sf):
    return W.fixed_batches(E.memories(spark, sf), "memory_type", F.col("memory_id"), 20).select("memory_id", "batch")


@query("messages", """SELECT file_id, CAST(k // 20 AS INT) AS chunk, string_agg(seq, ',' ORDER BY seq) AS seqs FROM (SELECT CAST(CAST(file_id AS INT) // 8 AS VARCHAR) AS file_id, 100 * (CAST(file_id AS INT) % 8) + seq AS seq,
    row_number() OVER (PARTITION BY CAST(file_id AS INT) // 8 ORDER BY CAST(file_id AS INT) % 8, seq) - 1 AS k FROM messages WHERE role <> 'user') GROUP BY 1, 2""")  # fmt: skip
def w16_fallback_groups(spark, sf):
    """Files without user messages, made of eight conversations each, so that they need several chunks."""
    k = F.col("file_id").cast("int")
    m = E.messages(spark, sf).where("role <> 'user'").select(F.floor(k / 8).cast("string").alias("file_id"), (100 * (k % 8) + F.col("seq")).cast("int").alias("seq"), "role", "content")
    return W.chunks(m)


@query()
def w17_rate_limit(spark, sf):
    """Admission depends on what was admitted before, so no SQL; tests compare it with a loop."""
    return W.rate_limited(E.signal_events(spark, sf).select("event_id", "source", "ts"), "source", 3, 86400.0).select("event_id", "admitted")


@query("memories", "SELECT content_key, CAST(max(updated_at) AS VARCHAR) AS updated_at, CAST(max(occurred_at) AS VARCHAR) AS occurred_at FROM (SELECT *, sha256(content) AS content_key FROM memories) GROUP BY 1")
def w18_merged_times(spark, sf):
    grouped = E.memories(spark, sf).groupBy(F.sha2("content", 256).alias("content_key"))
    return grouped.agg(F.max("updated_at").cast("string").alias("updated_at"), F.max("occurred_at").cast("string").alias("occurred_at"))
