"""Queries of section A."""

from pyspark.sql import functions as F

from lodestone.operators import relations as J
from lodestone.operators import statistics as A
from lodestone.operators import vectors as V
from lodestone.plans.registry import query
from lodestone.sources import entities as E
from lodestone.sources.entities import AS_OF


@query("memories", "SELECT count(*) AS memories, count(*) FILTER (status <> 'active') AS inactive FROM memories")
def a01_table_counts(spark, sf):
    return E.memories(spark, sf).agg(F.count("*").alias("memories"), F.count_if(F.col("status") != "active").alias("inactive"))


@query("raw_files", "SELECT count(*) AS total, count(*) FILTER (status = 'new') AS new, count(*) FILTER (status = 'refined') AS refined, count(*) FILTER (status = 'error') AS error, count(*) FILTER (status = 'archived') AS archived, CAST(max(refined_at) AS VARCHAR) AS last_refined_at FROM raw_files")
def a02_file_summary(spark, sf):
    return A.file_summary(E.raw_files(spark, sf)).withColumn("last_refined_at", F.col("last_refined_at").cast("string"))


@query("dimensions memory_tags", "SELECT id, count(memory_id) AS n, rank() OVER (ORDER BY count(memory_id) DESC, id) AS place FROM dimensions LEFT JOIN memory_tags ON dimension_id = id GROUP BY id")
def a03_dimension_distribution(spark, sf):
    from pyspark.sql import Window

    counts = J.counts_with_zero(E.dimensions(spark), E.memory_tags(spark, sf))
    return counts.withColumn("place", F.rank().over(Window.orderBy(F.desc("n"), "id")))  # one row for each dimension


@query("raw_files", "SELECT agent_id, CAST(max(coalesce(ended_at, started_at)) AS VARCHAR) AS last_seen FROM raw_files GROUP BY 1")
def a04_agent_last_seen(spark, sf):
    return A.last_seen(E.raw_files(spark, sf)).withColumn("last_seen", F.col("last_seen").cast("string"))


COSTS = "count(*) AS runs, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'error') AS errors, CAST(sum(coalesce(memories_count, 0)) AS BIGINT) AS memories, CAST(sum(coalesce(total_tokens, 0)) AS BIGINT) AS tokens"


@query("refine_runs", f"SELECT CAST(date_trunc('week', started_at) AS DATE) AS period, stage, {COSTS} FROM refine_runs GROUP BY 1, 2")
def a05_cost_by_week(spark, sf):
    return A.cost_by_period(E.refine_runs(spark, sf), "weekly")


@query("refine_runs", f"SELECT CAST(date_trunc('month', started_at) AS DATE) AS period, stage, {COSTS} FROM refine_runs GROUP BY 1, 2")
def a05_cost_by_month(spark, sf):
    return A.cost_by_period(E.refine_runs(spark, sf), "monthly")


@query("refine_runs", f"SELECT {COSTS} FROM refine_runs")
def a06_grand_total(spark, sf):
    return A.grand_total(A.cost_by_period(E.refine_runs(spark, sf), "daily"))


@query("memory_vectors", "SELECT count(*) AS vectors, count(DISTINCT dims) AS kinds FROM memory_vectors")
def a07_vector_rows(spark, sf):
    return E.memory_vectors(spark, sf).agg(F.count("*").alias("vectors"), F.count_distinct("dims").alias("kinds"))


@query("refine_runs", "SELECT version, variant, count(*) AS runs, count(*) FILTER (status = 'error') AS errors, CAST(sum(coalesce(memories_count, 0)) AS BIGINT) AS memories, CAST(sum(CASE WHEN run_id % 2 = 0 THEN coalesce(memories_count, 0) ELSE 0 END) AS BIGINT) AS stored, CAST(sum(CASE WHEN run_id % 2 = 1 THEN coalesce(memories_count, 0) ELSE 0 END) AS BIGINT) AS skipped FROM refine_runs WHERE stage = 'l1' GROUP BY 1, 2")
def a08_run_summary(spark, sf):
    kind = F.when(F.col("run_id") % 2 == 0, "store").otherwise("skip")
    runs = E.refine_runs(spark, sf).withColumn("action_counts", F.create_map(kind, F.coalesce("memories_count", F.lit(0))))
    got = A.run_summary(runs, "l1")
    return got.select("version", "variant", "runs", "errors", "memories", F.coalesce(F.element_at("actions", "store"), F.lit(0)).alias("stored"), F.coalesce(F.element_at("actions", "skip"), F.lit(0)).alias("skipped"))


@query("memories", "SELECT split_part(prompt_version, ':', 2) AS version, count(*) AS memories, round(avg(priority), 2) AS avg_priority FROM memories GROUP BY 1")
def a09_memories_by_version(spark, sf):
    return A.memories_by_version(E.memories(spark, sf), "l1")


@query("memories", "SELECT status, count(*) AS total FROM memories WHERE priority >= 30 GROUP BY 1")
def a10_filtered_total(spark, sf):
    return E.memories(spark, sf).where("priority >= 30").groupBy("status").agg(F.count("*").alias("total"))


@query("scenes", "SELECT status, count(*) AS n FROM scenes GROUP BY 1")
def a11_scene_counts(spark, sf):
    return E.scenes(spark, sf).groupBy("status").agg(F.count("*").alias("n"))


@query("scenes", "SELECT count(*) AS n, CASE WHEN count(*) >= 50 THEN 'red' WHEN count(*) >= 20 THEN 'orange' WHEN count(*) >= 5 THEN 'yellow' ELSE 'ok' END AS alarm FROM scenes WHERE status = 'active'")
def a12_scene_alarm(spark, sf):
    n = E.scenes(spark, sf).where("status = 'active'").agg(F.count("*").alias("n"))
    return n.withColumn("alarm", A.scene_alarm(F.col("n"), 5, 20, 50))


@query("scene_memories", "SELECT scene_id, count(*) AS n FROM scene_memories GROUP BY 1")
def a13_memories_per_scene(spark, sf):
    return E.scene_memories(spark, sf).groupBy("scene_id").agg(F.count("*").alias("n"))


@query("memories memory_tags", "SELECT CAST(CAST(created_at AS DATE) AS VARCHAR) AS day, count(*) AS n FROM memories JOIN memory_tags USING (memory_id) WHERE dimension_id = 'focus' AND status = 'active' GROUP BY 1 HAVING count(*) >= 2")
def a14_overwork_days(spark, sf):
    focus = J.tagged(E.memories(spark, sf).where("status = 'active'"), E.memory_tags(spark, sf), ["focus"])
    return focus.groupBy(F.to_date("created_at").cast("string").alias("day")).agg(F.count("*").alias("n")).where("n >= 2")


@query("memories", "SELECT sha256(content) AS digest, count(*) AS n, min(memory_id) AS first_id FROM memories GROUP BY content HAVING count(*) > 1")
def a15_duplicate_groups(spark, sf):
    return A.duplicates(E.memories(spark, sf))


@query("raw_files", "SELECT session_key, CAST(max(started_at) AS VARCHAR) AS at FROM raw_files GROUP BY 1 ORDER BY max(started_at) DESC, session_key LIMIT 9")
def a16_recent_sessions(spark, sf):
    return A.recent_sessions(E.raw_files(spark, sf), 9).withColumn("at", F.col("at").cast("string"))


@query("signal_events", "SELECT type, count(*) AS n FROM signal_events WHERE ts <= TIMESTAMP '2024-01-15 00:00:00' GROUP BY 1")
def a17_events_before(spark, sf):
    return E.signal_events(spark, sf).where("ts <= timestamp_ntz'2024-01-15 00:00:00'").groupBy("type").agg(F.count("*").alias("n"))


@query("refine_runs", "SELECT coalesce(CAST(sum(total_tokens) AS BIGINT), 0) AS tokens FROM refine_runs WHERE started_at >= TIMESTAMP '1997-01-01 00:00:00'")
def a18_tokens_since(spark, sf):
    return E.refine_runs(spark, sf).where("started_at >= timestamp_ntz'1997-01-01 00:00:00'").agg(F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("tokens"))


@query("scenes memories", "SELECT (SELECT count(*) FROM scenes WHERE updated_at >= TIMESTAMP '2024-02-10 00:00:00') AS new_scenes, (SELECT count(*) FROM scenes) AS scenes, (SELECT count(*) FROM memories) AS memories")
def a19_pool_totals(spark, sf):
    scenes = E.scenes(spark, sf).agg(F.count_if(F.expr("updated_at >= timestamp_ntz'2024-02-10 00:00:00'")).alias("new_scenes"), F.count("*").alias("scenes"))
    return scenes.crossJoin(E.memories(spark, sf).agg(F.count("*").alias("memories")))  # one row each


@query("raw_files", "SELECT count(*) AS queued, CAST(min(started_at) AS VARCHAR) AS oldest FROM raw_files WHERE status = 'new'")
def a20_queue_depth(spark, sf):
    return E.raw_files(spark, sf).where("status = 'new'").agg(F.count("*").alias("queued"), F.min("started_at").cast("string").alias("oldest"))


@query("signal_events", "SELECT type AS action, count(*) AS n FROM signal_events GROUP BY 1")
def a21_action_histogram(spark, sf):
    return A.histogram(E.signal_events(spark, sf), F.col("type"), "action")


PROGRESS = """SELECT count(*) FILTER (refined_at >= TIMESTAMP '2024-03-15 00:00:00' - INTERVAL 24 HOUR) AS refined, max(last_seq) FILTER (refined_at >= TIMESTAMP '2024-03-15 00:00:00' - INTERVAL 24 HOUR) AS max_seq,
    CAST(date_diff('second', max(refined_at), TIMESTAMP '2024-03-15 00:00:00') AS BIGINT) AS age_sec, date_diff('second', max(refined_at), TIMESTAMP '2024-03-15 00:00:00') > 86400 AS stalled FROM raw_files"""


@query("raw_files", PROGRESS)
def a22_progress(spark, sf):
    return A.progress(E.raw_files(spark, sf), AS_OF)


@query("raw_files", f"SELECT age_sec, CASE WHEN stalled THEN 'stalled' ELSE 'running' END AS state FROM ({PROGRESS})")
def a23_stall(spark, sf):
    return A.progress(E.raw_files(spark, sf), AS_OF).select("age_sec", F.when(F.col("stalled"), "stalled").otherwise("running").alias("state"))


@query("raw_files memories memory_vectors", f"SELECT p.refined, p.stalled, m.memories, v.vectors FROM ({PROGRESS}) p, (SELECT count(*) AS memories FROM memories) m, (SELECT count(*) AS vectors FROM memory_vectors) v")
def a24_heartbeat(spark, sf):
    parts = [A.progress(E.raw_files(spark, sf), AS_OF).select("refined", "stalled"), E.memories(spark, sf).agg(F.count("*").alias("memories")), E.memory_vectors(spark, sf).agg(F.count("*").alias("vectors"))]
    return parts[0].crossJoin(parts[1]).crossJoin(parts[2])  # one row each


@query("scenes", "SELECT CASE WHEN heat >= 60 THEN 'hot' WHEN heat >= 40 THEN 'warm' ELSE 'cold' END AS bucket, count(*) AS n FROM scenes GROUP BY 1")
def a25_heat_buckets(spark, sf):
    heat = F.when(F.col("heat") >= 60, "hot").when(F.col("heat") >= 40, "warm").otherwise("cold")
    return A.histogram(E.scenes(spark, sf), heat)


@query("memory_vectors", "SELECT CAST(floor(list_cosine_similarity(a.embedding, b.embedding) * 10 + 1e-9) AS INT) AS bin, count(*) AS n FROM memory_vectors a JOIN memory_vectors b ON a.memory_id < b.memory_id WHERE list_cosine_similarity(a.embedding, b.embedding) >= 0.2 GROUP BY 1")
def a26_similarity_bins(spark, sf):
    return V.similarity_bins(E.memory_vectors(spark, sf), 0.2)


CASES = "SELECT *, CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END AS tp, CASE WHEN quality = 0 AND toxic = 0 THEN 1 ELSE 0 END AS fp, CASE WHEN quality = 1 AND toxic = 1 THEN 1 ELSE 0 END AS fn FROM labels"
SCORES = "tp, fp, fn, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / ((tp / (tp + fp)) + (tp / (tp + fn))) AS f1"
SUMS = "CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn"


def _cases(spark, sf):
    rows = E.table(spark, sf, "labels")
    return rows.selectExpr("doc_id", "int(quality = 1 AND toxic = 0) AS tp", "int(quality = 0 AND toxic = 0) AS fp", "int(quality = 1 AND toxic = 1) AS fn")


@query("", f"SELECT {SCORES} FROM (SELECT {SUMS} FROM ({CASES}))")
def a27_micro_f1(spark, sf):
    return A.f1(_cases(spark, sf))


@query("memory_tags", f"SELECT dimension_id, {SCORES} FROM (SELECT dimension_id, {SUMS} FROM ({CASES}) JOIN memory_tags ON memory_id = CAST(doc_id AS VARCHAR) GROUP BY 1) WHERE tp > 0")
def a28_f1_by_dimension(spark, sf):
    tagged = _cases(spark, sf).withColumn("memory_id", F.col("doc_id").cast("string")).join(E.memory_tags(spark, sf), "memory_id")
    return A.f1(tagged, "dimension_id").where("tp > 0")


@query("memories", "SELECT avg(CASE WHEN priority % 2 = 0 THEN 1.0 ELSE 0.0 END) AS strict_rate, avg(CASE WHEN memory_type = 'persona' THEN 1.0 ELSE 0.0 END) AS accuracy, avg(abs(priority - 50)) AS mae FROM memories")
def a29_match_rates(spark, sf):
    hit = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return E.memories(spark, sf).agg(hit(F.col("priority") % 2 == 0).alias("strict_rate"), hit(F.col("memory_type") == "persona").alias("accuracy"), F.avg(F.abs(F.col("priority") - 50)).alias("mae"))


@query("memory_tags", """
    WITH e AS (SELECT dimension_id AS section, memory_id AS item FROM memory_tags WHERE CAST(memory_id AS INT) % 3 <> 0), f AS (SELECT dimension_id AS section, memory_id AS item FROM memory_tags WHERE CAST(memory_id AS INT) % 5 <> 0),
    n AS (SELECT count(*) FILTER (e.item IS NOT NULL AND f.item IS NOT NULL) AS hit, count(e.item) AS expected, count(f.item) AS found FROM e FULL JOIN f ON e.section = f.section AND e.item = f.item)
    SELECT hit / expected AS hit_rate, (found - hit) / found AS wrong_rate, (expected - hit) / expected AS miss_rate FROM n""")  # fmt: skip
def a30_section_rates(spark, sf):
    items = E.memory_tags(spark, sf).select(F.col("dimension_id").alias("section"), F.col("memory_id").alias("item"))
    return A.section_rates(items.where("int(item) % 3 <> 0"), items.where("int(item) % 5 <> 0"))


@query("", "SELECT count(DISTINCT b.item_id) / (SELECT count(*) FROM benchmark) AS coverage, count(DISTINCT d.doc_id) AS documents FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def a31_reference_coverage(spark, sf):
    from lodestone.operators import evaluation

    pairs = evaluation.containments(E.table(spark, sf, "benchmark"), E.table(spark, sf, "documents"))
    n = E.table(spark, sf, "benchmark").agg(F.count("*").alias("n"))
    return pairs.agg(F.count_distinct("item_id").alias("hit"), F.count_distinct("doc_id").alias("documents")).crossJoin(n).select((F.col("hit") / F.col("n")).alias("coverage"), "documents")


@query("memory_tags", "SELECT avg(n) AS mean, median(n) AS median, CAST(max(n) AS BIGINT) AS most FROM (SELECT dimension_id, count(*) AS n FROM memory_tags GROUP BY 1)")
def a32_recall_diagnostics(spark, sf):
    n = E.memory_tags(spark, sf).groupBy("dimension_id").agg(F.count("*").alias("n"))
    return n.agg(F.avg("n").alias("mean"), F.median("n").alias("median"), F.max("n").alias("most"))


@query("memories", "SELECT max(m) - min(m) AS spread FROM (SELECT ttl_days, avg(priority) AS m FROM memories GROUP BY 1)")
def a33_sensitivity(spark, sf):
    return E.memories(spark, sf).groupBy("ttl_days").agg(F.avg("priority").alias("m")).agg((F.max("m") - F.min("m")).alias("spread"))


@query("", f"SELECT CASE WHEN f1 >= 0.75 THEN 'green' WHEN f1 >= 0.6 THEN 'yellow' ELSE 'red' END AS light FROM (SELECT {SCORES} FROM (SELECT {SUMS} FROM ({CASES})))")
def a34_gate_light(spark, sf):
    return A.f1(_cases(spark, sf)).select(A.gate_light(F.col("f1"), 0.75, 0.6).alias("light"))


@query("memory_tags", "SELECT count(*) AS total, count(*) FILTER (dimension_id IN ('focus', 'goals')) AS hits, 1 - count(*) FILTER (dimension_id IN ('focus', 'goals')) / count(*) AS drop_rate FROM memory_tags")
def a35_normalisation_stats(spark, sf):
    hit = F.count_if(F.col("dimension_id").isin("focus", "goals"))
    return E.memory_tags(spark, sf).agg(F.count("*").alias("total"), hit.alias("hits"), (1 - hit / F.count("*")).alias("drop_rate"))


@query("messages", "SELECT count(*) AS messages, CAST(sum(length(content)) AS BIGINT) AS chars FROM messages WHERE role <> 'system'")
def a36_prune_stats(spark, sf):
    return E.messages(spark, sf).where("role <> 'system'").agg(F.count("*").alias("messages"), F.sum(F.length("content")).alias("chars"))


@query("memories raw_files dimensions memory_tags", "SELECT (SELECT count(*) FROM memories) AS memories, (SELECT count(*) FROM raw_files WHERE status = 'error') AS failed_files, (SELECT string_agg(concat(id, '=', n), ',' ORDER BY id) FROM (SELECT id, count(memory_id) AS n FROM dimensions LEFT JOIN memory_tags ON dimension_id = id GROUP BY id)) AS dimensions")
def a37_stats_page(spark, sf):
    counts = J.counts_with_zero(E.dimensions(spark), E.memory_tags(spark, sf))
    shown = counts.agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "id", F.col("n").cast("string")))), ",").alias("dimensions"))
    files = E.raw_files(spark, sf).agg(F.count_if(F.col("status") == "error").alias("failed_files"))
    return E.memories(spark, sf).agg(F.count("*").alias("memories")).crossJoin(files).crossJoin(shown)  # one row each


@query("refine_runs", "SELECT stage, count(*) FILTER (status = 'running') AS running, max_by(run_id, (started_at, run_id)) FILTER (status = 'error') AS last_failure FROM refine_runs GROUP BY 1".replace("max_by(run_id, (started_at, run_id))", "max_by(run_id, row(started_at, run_id))"))
def a38_refine_status(spark, sf):
    failed = F.max(F.when(F.col("status") == "error", F.struct("started_at", "run_id")))["run_id"]
    return E.refine_runs(spark, sf).groupBy("stage").agg(F.count_if(F.col("status") == "running").alias("running"), failed.alias("last_failure"))


@query("memories", """
    WITH a AS (SELECT memory_type AS metric, avg(priority) AS a FROM memories WHERE status = 'active' GROUP BY 1), b AS (SELECT memory_type AS metric, avg(priority) AS b FROM memories GROUP BY 1)
    SELECT metric, a, b, b - a AS change FROM a FULL JOIN b USING (metric)""")
def a39_metric_changes(spark, sf):
    mean = lambda df: df.groupBy(F.col("memory_type").alias("metric")).agg(F.avg("priority").alias("value"))
    return A.metric_changes(mean(E.memories(spark, sf).where("status = 'active'")), mean(E.memories(spark, sf)))


@query("memory_tags", "SELECT dimension_id, 30 * count(*) AS tokens FROM memory_tags GROUP BY 1")
def a40_token_estimate(spark, sf):
    return E.memory_tags(spark, sf).groupBy("dimension_id").agg((30 * F.count("*")).alias("tokens"))
