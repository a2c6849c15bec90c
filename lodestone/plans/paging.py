"""Queries of sections O and U."""

from pyspark.sql import functions as F

from lodestone.operators import evaluation
from lodestone.operators import paging as O
from lodestone.operators import relations as J
from lodestone.operators import vectors as V
from lodestone.plans.registry import query
from lodestone.sources import entities as E

MEMORY_SORTS = ("updated_at", "created_at", "priority")


@query("memories", "SELECT memory_id, priority FROM memories WHERE status = 'active' ORDER BY priority DESC, memory_id DESC LIMIT 20 OFFSET 20")
def o01_memory_page(spark, sf):
    return O.page(E.memories(spark, sf).where("status = 'active'"), "priority", MEMORY_SORTS, "memory_id", number=2, limit=20).select("memory_id", "priority")


@query("scenes", "SELECT scene_id, heat FROM scenes WHERE status = 'active' ORDER BY heat DESC, scene_id DESC LIMIT 5")
def o02_scene_page(spark, sf):
    return O.page(E.scenes(spark, sf).where("status = 'active'"), "heat", ("heat", "updated_at"), "scene_id", limit=5).select("scene_id", "heat")


@query("raw_files", "SELECT file_id, agent_id FROM raw_files ORDER BY started_at DESC, file_id DESC LIMIT 10")
def o03_file_page(spark, sf):
    return O.page(E.raw_files(spark, sf), "started_at", ("started_at",), "file_id", limit=10).select("file_id", "agent_id")


@query("refine_runs", "SELECT run_id, stage FROM refine_runs WHERE stage = 'l2' ORDER BY started_at DESC, run_id DESC LIMIT 25 OFFSET 50")
def o04_run_page(spark, sf):
    return O.page(E.refine_runs(spark, sf).where("stage = 'l2'"), "started_at", ("started_at",), "run_id", number=3, limit=25).select("run_id", "stage")


@query("wiki_pages", "SELECT page_id, category FROM wiki_pages WHERE category = 'note' ORDER BY updated_at, page_id LIMIT 10")
def o05_idea_page(spark, sf):
    return O.page(E.wiki_pages(spark, sf).where("category = 'note'"), "updated_at", ("updated_at",), "page_id", order="asc", limit=10).select("page_id", "category")


@query("", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15")
def o06_demand_page(spark, sf):
    return O.page(E.table(spark, sf, "orders"), "o_totalprice", ("o_totalprice",), "o_orderkey", limit=15, key_order="asc").select("o_orderkey", "o_totalprice")


@query("raw_files", "SELECT file_id, CAST(ended_at AS VARCHAR) AS ended_at FROM raw_files ORDER BY raw_files.ended_at DESC NULLS LAST, file_id LIMIT 40")
def o07_nulls_last(spark, sf):
    found = O.page(E.raw_files(spark, sf), "ended_at", ("ended_at",), "file_id", limit=40, key_order="asc", nulls_last=True)
    return found.select("file_id", F.col("ended_at").cast("string").alias("ended_at"))


@query("raw_files", "SELECT file_id FROM raw_files WHERE status = 'new' ORDER BY coalesce(refined_at, started_at), file_id LIMIT 10")
def o08_work_queue(spark, sf):
    waiting = E.raw_files(spark, sf).where("status = 'new'").withColumn("since", F.coalesce("refined_at", "started_at"))
    return O.page(waiting, "since", ("since",), "file_id", order="asc", limit=10).select("file_id")


@query("scenes", "SELECT scene_id FROM scenes WHERE status = 'active' ORDER BY updated_at DESC, scene_id DESC LIMIT 8")
def o09_active_scenes(spark, sf):
    return O.page(E.scenes(spark, sf).where("status = 'active'"), "updated_at", ("updated_at",), "scene_id", limit=8).select("scene_id")


@query("wiki_pages", "SELECT page_id, title FROM wiki_pages ORDER BY updated_at DESC, page_id LIMIT 10 OFFSET 10")
def o10_wiki_page(spark, sf):
    return O.page(E.wiki_pages(spark, sf), "updated_at", ("updated_at",), "page_id", number=2, limit=10, key_order="asc").select("page_id", "title")


@query("refine_runs", "SELECT run_id FROM refine_runs WHERE status = 'error' ORDER BY started_at DESC, run_id DESC LIMIT 50")
def o11_task_list(spark, sf):
    return O.page(E.refine_runs(spark, sf).where("status = 'error'"), "started_at", ("started_at",), "run_id").select("run_id")


@query("wiki_links", "SELECT source_id, target_id, confidence FROM wiki_links WHERE source_id = '6' OR target_id = '6' ORDER BY confidence DESC")
def o12_links_of_page(spark, sf):
    return E.wiki_links(spark, sf).where("source_id = '6' OR target_id = '6'").orderBy(F.desc("confidence"), "source_id", "target_id").select("source_id", "target_id", "confidence")


@query("memories memory_tags", "SELECT memory_id FROM memories WHERE memory_id IN (SELECT memory_id FROM memory_tags WHERE dimension_id IN ('focus', 'status')) ORDER BY updated_at DESC, memory_id DESC LIMIT 10")
def o13_default_sort(spark, sf):
    velocity = {d[0]: d[2] for d in E.DIMENSIONS}
    sort = O.default_sort([velocity["focus"], velocity["status"]])
    return O.page(J.tagged(E.memories(spark, sf), E.memory_tags(spark, sf), ["focus", "status"]), sort, MEMORY_SORTS, "memory_id", limit=10).select("memory_id")


TOP = "SELECT v.memory_id, greatest(0, least(1, list_cosine_similarity(v.embedding, q.e))) AS s FROM memory_vectors v, (SELECT embedding AS e FROM memory_vectors WHERE memory_id = '3') q"


@query("memory_vectors", f"SELECT memory_id, round(s, 9) AS similarity FROM ({TOP}) ORDER BY s DESC, memory_id LIMIT 10")
def o14_nearest(spark, sf):
    vectors = E.memory_vectors(spark, sf)
    return V.nearest(vectors, V.vector_of(vectors, "3"), 10).select("memory_id", F.round("similarity", 9).alias("similarity"))


@query("memory_vectors memories", f"""
    WITH a AS (SELECT memory_id FROM ({TOP}) ORDER BY s DESC, memory_id LIMIT 30), b AS (SELECT memory_id FROM memories ORDER BY priority DESC, memory_id LIMIT 20)
    SELECT memory_id, min(part) AS part FROM (SELECT memory_id, 0 AS part FROM a UNION ALL SELECT memory_id, 1 FROM b) GROUP BY 1""")  # fmt: skip
def o15_prescreen(spark, sf):
    vectors = E.memory_vectors(spark, sf)
    near = V.nearest(vectors, V.vector_of(vectors, "3"), 30).select("memory_id")
    hot = E.memories(spark, sf).orderBy(F.desc("priority"), "memory_id").limit(20).select("memory_id")
    return O.first_seen("memory_id", near, hot)


@query("memories", "SELECT count(*) FILTER (n <= 20) AS count, count(*) AS total, 1 AS page, 20 AS \"limit\" FROM (SELECT row_number() OVER (ORDER BY priority DESC, memory_id DESC) AS n FROM memories WHERE status = 'active')")
def o16_envelope(spark, sf):
    rows = E.memories(spark, sf).where("status = 'active'")
    items = O.page(rows, "priority", MEMORY_SORTS, "memory_id", limit=20).select("memory_id", "priority")
    return O.envelope(items, rows, 1, 20).select("count", "total", "page", "limit")


@query("signal_events", "SELECT event_id FROM signal_events WHERE type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 50")
def o17_newest_signals(spark, sf):
    return O.page(E.signal_events(spark, sf).where(F.col("type").startswith("error")), "ts", ("ts",), "event_id").select("event_id")


@query("", "SELECT o_orderkey FROM orders WHERE o_custkey = 11 ORDER BY o_orderdate, o_orderkey")
def o18_demands_by_origin(spark, sf):
    return E.table(spark, sf, "orders").where("o_custkey = 11").orderBy("o_orderdate", "o_orderkey").select("o_orderkey")


@query("dimensions", "SELECT id, display_name FROM dimensions ORDER BY id")
def o19_dimensions(spark, sf):
    return E.dimensions(spark).orderBy("id").select("id", "display_name")


@query("memories", "SELECT memory_id FROM memories WHERE agent_tag = 'agent2' ORDER BY created_at, memory_id")
def o20_chronological(spark, sf):
    return E.memories(spark, sf).where("agent_tag = 'agent2'").orderBy("created_at", "memory_id").select("memory_id")


@query("memories scenes wiki_pages", "SELECT memory_id AS id, priority, CAST(NULL AS BIGINT) AS heat, 0 AS part FROM memories UNION ALL SELECT scene_id, NULL, heat, 1 FROM scenes UNION ALL SELECT page_id, NULL, NULL, 2 FROM wiki_pages")
def u01_union_of_scopes(spark, sf):
    parts = E.memories(spark, sf).select(F.col("memory_id").alias("id"), "priority"), E.scenes(spark, sf).select(F.col("scene_id").alias("id"), "heat"), E.wiki_pages(spark, sf).select(F.col("page_id").alias("id"))
    return O.union_in_order(*parts).select("id", "priority", "heat", "part")


@query("memory_tags memories", "SELECT memory_id, min(part) AS part FROM (SELECT memory_id, 0 AS part FROM memory_tags WHERE dimension_id = 'goals' UNION ALL SELECT memory_id, 1 FROM memories WHERE priority > 90) GROUP BY 1")
def u02_ordered_union(spark, sf):
    return O.first_seen("memory_id", E.memory_tags(spark, sf).where("dimension_id = 'goals'").select("memory_id"), E.memories(spark, sf).where("priority > 90").select("memory_id"))


@query("memory_tags", "SELECT dimension_id, memory_id, min(part) AS part FROM (SELECT dimension_id, memory_id, 0 AS part FROM memory_tags WHERE CAST(memory_id AS INT) % 2 = 0 UNION ALL SELECT dimension_id, memory_id, 1 FROM memory_tags WHERE CAST(memory_id AS INT) % 3 = 0) GROUP BY 1, 2")
def u03_pool_merge(spark, sf):
    tags = E.memory_tags(spark, sf)
    return O.first_seen("memory_id", tags.where("int(memory_id) % 2 = 0"), tags.where("int(memory_id) % 3 = 0"), by="dimension_id").select("dimension_id", "memory_id", "part")


@query("memory_tags", "SELECT CAST(memory_id AS INT) % 10 AS g, string_agg(DISTINCT dimension_id, ',' ORDER BY dimension_id) AS routes FROM memory_tags GROUP BY 1")
def u04_distinct_routes(spark, sf):
    return E.memory_tags(spark, sf).groupBy((F.col("memory_id").cast("int") % 10).alias("g")).agg(F.array_join(F.sort_array(F.collect_set("dimension_id")), ",").alias("routes"))


@query("wiki_pages", "SELECT page_id, len(list_intersect(tags, ['t1', 't2', 'page'])) AS tp, len(list_filter(list_distinct(tags), lambda x: NOT list_contains(['t1', 't2', 'page'], x))) AS fp FROM wiki_pages")
def u05_set_difference(spark, sf):
    truth = F.array(*map(F.lit, ("t1", "t2", "page")))
    return E.wiki_pages(spark, sf).select("page_id", F.size(F.array_intersect("tags", truth)).cast("long").alias("tp"), F.size(F.array_except("tags", truth)).cast("long").alias("fp"))


@query("memories", "SELECT coalesce(a.memory_id, b.memory_id) AS name, CASE WHEN a.memory_id IS NULL THEN 'added' WHEN b.memory_id IS NULL THEN 'removed' ELSE 'changed' END AS change FROM (SELECT * FROM memories WHERE priority < 80) a FULL JOIN (SELECT * FROM memories WHERE priority > 20) b USING (memory_id) WHERE a.memory_id IS NULL OR b.memory_id IS NULL OR a.ttl_days = 7")
def u06_snapshot_changes(spark, sf):
    m = E.memories(spark, sf)
    before = m.where("priority < 80").select(F.col("memory_id").alias("name"), F.sha2("content", 256).alias("digest"))
    after = m.where("priority > 20").select(F.col("memory_id").alias("name"), F.sha2(F.concat("content", F.when(F.col("ttl_days") == 7, "!").otherwise("")), 256).alias("digest"))
    return O.snapshot_changes(before, after)


@query("", "SELECT text AS query, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM benchmark GROUP BY 1")
def u07_relevant_ids(spark, sf):
    rows = E.table(spark, sf, "benchmark").select(F.col("text").alias("query"), F.col("item_id").cast("string").alias("id"))
    return evaluation.relevant_ids(rows).select("query", F.array_join("ids", ",").alias("ids"))


@query("memories", "SELECT memory_id FROM (SELECT memory_id, row_number() OVER (PARTITION BY trim(content) ORDER BY memory_id) AS n FROM memories) WHERE n = 1")
def u08_distinct_contents(spark, sf):
    return O.distinct_contents(E.memories(spark, sf), "memory_id").select("memory_id")


@query("", "SELECT * FROM (VALUES (0, 'a', 9), (1, 'b', 2), (2, 'c', 3)) AS t(place, title, \"limit\")")
def u09_merged_sections(spark, sf):
    rows = O.merged_sections([{"title": "a", "limit": 1}, {"title": "b", "limit": 2}], [{"title": "c", "limit": 3}, {"title": "a", "limit": 9}])
    return spark.createDataFrame([(k, r["title"], r["limit"]) for k, r in enumerate(rows)], "place int, title string, limit int")


@query("", "SELECT k, n FROM (VALUES (10), (30), (60)) AS a(k), (VALUES (5), (10)) AS b(n)")
def u10_parameter_grid(spark, sf):
    k, n = spark.createDataFrame([(10,), (30,), (60,)], "k int"), spark.createDataFrame([(5,), (10,)], "n int")
    return k.crossJoin(n)  # a few rows each
