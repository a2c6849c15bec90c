"""Queries of section D."""

from pyspark.sql import functions as F

from lodestone.operators import relations
from lodestone.operators import state as D
from lodestone.plans.registry import query
from lodestone.sources import entities as E
from lodestone.sources.entities import AS_OF


@query("dimensions", "SELECT id, CASE id WHEN 'focus' THEN 'Focus' ELSE display_name END AS display_name, true AS active FROM dimensions UNION ALL SELECT 'new', 'New', true")
def d01_upsert_dimension(spark, sf):
    stored = E.dimensions(spark).select("id", "display_name", F.lit(True).alias("active"))
    return D.upsert(stored, spark.createDataFrame([("focus", "Focus", False), ("new", "New", True)], "id string, display_name string, active boolean"), ["id"], keep=["active"])


@query("memories", "SELECT memory_id, status FROM memories UNION ALL SELECT concat('n', memory_id), 'active' FROM memories WHERE priority > 95")
def d02_insert_memories(spark, sf):
    memories = E.memories(spark, sf).select("memory_id", "status")
    new = E.memories(spark, sf).where("priority > 95").select(F.concat(F.lit("n"), "memory_id").alias("memory_id"), F.lit("active").alias("status"))
    return D.created_once(memories, new, "memory_id")


@query("memories", "SELECT memory_id, CASE WHEN priority < 10 THEN 'rejected' WHEN priority > 90 AND status = 'rejected' THEN 'active' ELSE status END AS status FROM memories")
def d03_reject_and_restore(spark, sf):
    m = E.memories(spark, sf)
    actions = m.where("priority < 10 OR priority > 90").select("memory_id", F.when(F.col("priority") < 10, "low").alias("reason"))
    return D.rejected(m, actions, AS_OF).select("memory_id", "status")


@query("memory_vectors", "SELECT memory_id, CASE WHEN CAST(memory_id AS INT) % 3 = 0 THEN 1 ELSE 64 END AS dims FROM memory_vectors")
def d04_replace_vectors(spark, sf):
    v = E.memory_vectors(spark, sf)
    return D.replaced(v, v.where("int(memory_id) % 3 = 0").withColumn("dims", F.lit(1)), "memory_id").select("memory_id", "dims")


@query("memories", f"SELECT memory_id, CASE WHEN memory_type = 'persona' THEN 'new' ELSE sha256(content) END AS content, CAST(CASE WHEN memory_type = 'persona' THEN TIMESTAMP '{AS_OF}' ELSE updated_at END AS VARCHAR) AS updated_at FROM memories")
def d05_update_content(spark, sf):
    m = E.memories(spark, sf).withColumn("content", F.sha2("content", 256))
    done = D.updated_content(m, m.where("memory_type = 'persona'").select("memory_id", F.lit("new").alias("content")), AS_OF)
    return done.select("memory_id", "content", F.col("updated_at").cast("string").alias("updated_at"))


@query("memories memory_tags", "SELECT (SELECT count(*) FROM memories WHERE priority <> 50) AS memories, (SELECT count(*) FROM memory_tags WHERE memory_id NOT IN (SELECT memory_id FROM memories WHERE priority = 50)) AS tags, (SELECT count(*) FROM memories WHERE priority = 50) AS archived")
def d06_archive(spark, sf):
    m = E.memories(spark, sf)
    rest, tags, archive = D.archived(m, E.memory_tags(spark, sf), m.where("priority = 50").select("memory_id", F.lit("0").alias("superseded_by")), AS_OF)
    return rest.agg(F.count("*").alias("memories")).crossJoin(tags.agg(F.count("*").alias("tags"))).crossJoin(archive.agg(F.count("*").alias("archived")))  # one row each


@query("memory_tags", "SELECT memory_id, count(*) + 1 AS recall_count FROM memory_tags GROUP BY 1")
def d07_recall_counters(spark, sf):
    tags = E.memory_tags(spark, sf)
    at = F.lit(AS_OF).cast("timestamp_ntz")
    stats = tags.select("memory_id").distinct().select("memory_id", F.lit(1).cast("long").alias("recall_count"), at.alias("last_injected_at"))
    return D.counted(stats, tags.select("memory_id", at.alias("at"))).select("memory_id", "recall_count")


@query("dimensions", "SELECT id, coalesce(CASE WHEN id = 'status' THEN 14 END, ttl_days) AS ttl_days FROM dimensions")
def d08_update_fields(spark, sf):
    return D.upsert(E.dimensions(spark).select("id", "ttl_days"), spark.createDataFrame([("status", 14), ("goals", None)], "id string, ttl_days int"), ["id"])


NEW = """n AS (SELECT concat('n', memory_id) AS new_id, CASE CAST(memory_id AS INT) % 3 WHEN 0 THEN content WHEN 1 THEN concat(substr(content, 1, 20), '!!', memory_id) ELSE concat(memory_id, ' all new') END AS content FROM memories WHERE priority >= 60),
    d AS (SELECT n.*, (SELECT min(memory_id) FROM memories m WHERE m.content = n.content) AS same, (SELECT min(memory_id) FROM memories m WHERE substr(m.content, 1, 20) = substr(n.content, 1, 20)) AS near FROM n)"""


def _decisions(spark, sf):
    m = E.memories(spark, sf)
    k = F.col("memory_id").cast("int") % 3
    text = F.when(k == 0, F.col("content")).when(k == 1, F.concat(F.substring("content", 1, 20), F.lit("!!"), F.col("memory_id"))).otherwise(F.concat(F.col("memory_id"), F.lit(" all new")))
    new = m.where("priority >= 60").select(F.concat(F.lit("n"), "memory_id").alias("memory_id"), text.alias("content"), "priority")
    return m, D.rule_decisions(new, m)


@query("memories", f"WITH {NEW} SELECT new_id, CASE WHEN same IS NOT NULL THEN 'skip' WHEN near IS NOT NULL THEN 'update' ELSE 'store' END AS action, CASE WHEN same IS NULL THEN near END AS old_id FROM d")
def d09_decisions(spark, sf):
    return _decisions(spark, sf)[1].select("new_id", "action", "old_id")


@query("memories", f"WITH {NEW} SELECT memory_id FROM memories WHERE memory_id NOT IN (SELECT near FROM d WHERE same IS NULL AND near IS NOT NULL) UNION ALL SELECT new_id FROM d WHERE same IS NULL")
def d09_resolved_state(spark, sf):
    return D.resolved(*_decisions(spark, sf), AS_OF)[0].select("memory_id")


@query("memories memory_sources", "SELECT n.memory_id FROM memories n WHERE n.status = 'expired' AND NOT EXISTS (SELECT 1 FROM memories o WHERE o.status = 'active' AND trim(o.content) = trim(n.content))")
def d10_direct_store(spark, sf):
    from lodestone.operators import selection as P

    rows = E.memories(spark, sf).withColumn("source_ref", F.lit("f:0"))
    return P.new_only(rows.where("status = 'expired'"), rows).select("memory_id")


@query("scenes", """SELECT scene_id, CASE scene_id WHEN '1' THEN heat + 1 WHEN '3' THEN heat + (SELECT heat FROM scenes WHERE scene_id = '2') ELSE heat END AS heat, CASE scene_id WHEN '2' THEN 'archived' ELSE status END AS status FROM scenes
    UNION ALL SELECT 'x', 1, 'active'""")
def d11_scene_actions(spark, sf):
    actions = spark.createDataFrame([("1", "update", None, None), ("2", "merge", None, "3"), ("x", "create", "new", None)], "scene_id string, action string, title string, into string")
    return D.scenes_after(E.scenes(spark, sf), actions, AS_OF)[0].select("scene_id", "heat", "status")


@query("scenes", "SELECT scene_id, heat FROM scenes WHERE scene_id IN ('1', '2', '3')")
def d12_scene_versions(spark, sf):
    actions = spark.createDataFrame([("1", "update", None, None), ("2", "merge", None, "3"), ("x", "create", "new", None)], "scene_id string, action string, title string, into string")
    return D.scenes_after(E.scenes(spark, sf), actions, AS_OF)[1].select("scene_id", "heat")


@query("raw_files", "SELECT file_id, CAST(CASE WHEN status = 'new' THEN last_seq ELSE last_refined_seq END AS INT) AS last_refined_seq, CASE WHEN status = 'new' THEN 'refined' ELSE status END AS status FROM raw_files")
def d13_advance_cursors(spark, sf):
    files = E.raw_files(spark, sf).select("file_id", "last_refined_seq", "status")
    done = E.raw_files(spark, sf).where("status = 'new'").select("file_id", F.col("last_seq").alias("last_refined_seq"), F.lit("refined").alias("status"))
    return D.upsert(files, done, ["file_id"])


@query("wiki_pages", "SELECT page_id, CASE WHEN category = 'note' AND status = 'active' THEN 'promoted' WHEN category = 'skill' THEN 'deleted' ELSE status END AS status FROM wiki_pages")
def d14_idea_states(spark, sf):
    ideas = E.wiki_pages(spark, sf)
    change = F.when((F.col("category") == "note") & (F.col("status") == "active"), "promoted").when(F.col("category") == "skill", "deleted")
    return D.upsert(ideas.select("page_id", "status"), ideas.select("page_id", change.alias("status")).where("status IS NOT NULL"), ["page_id"])


@query("", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE o_orderstatus END AS status FROM orders WHERE o_totalprice >= 1000")
def d15_demand_patch(spark, sf):
    orders = E.table(spark, sf, "orders")
    state = orders.select("o_orderkey", F.col("o_orderstatus").alias("status"), "o_totalprice")
    patched = D.upsert(state.drop("o_totalprice"), state.where("status = 'F'").select("o_orderkey", F.lit("done").alias("status")), ["o_orderkey"])
    return patched.join(state.where("o_totalprice < 1000").select("o_orderkey"), "o_orderkey", "left_anti")


@query("", "SELECT CAST(p_partkey AS BIGINT) AS id, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE 'x' END AS brand, p_name AS name FROM part")
def d16_project_upsert(spark, sf):
    parts = E.table(spark, sf, "part").select(F.col("p_partkey").cast("long").alias("id"), F.col("p_brand").alias("brand"), F.col("p_name").alias("name"))
    return D.upsert(parts, parts.select("id", F.when(F.col("id") % 2 == 1, "x").alias("brand"), F.lit(None).cast("string").alias("name")), ["id"])


@query("wiki_pages", "SELECT page_id, CASE WHEN status <> 'active' OR n > 1 THEN 'superseded' ELSE 'active' END AS status FROM (SELECT page_id, status, row_number() OVER (PARTITION BY title, category, status ORDER BY updated_at DESC, page_id DESC) AS n FROM wiki_pages)")
def d17_supersede_pages(spark, sf):
    return D.pages_superseded(E.wiki_pages(spark, sf)).select("page_id", "status")


@query("wiki_pages", "SELECT page_id, concat(title, chr(10), '<!-- ', substr(sha256('e1'), 1, 12), ' -->', chr(10), 'e1') AS content FROM wiki_pages")
def d18_append_once(spark, sf):
    pages = E.wiki_pages(spark, sf).select("page_id", F.col("title").alias("content"))
    entries = pages.select("page_id", F.lit("e1").alias("entry"))
    return D.appended_once(D.appended_once(pages, entries), entries.union(entries))


@query("wiki_pages", "SELECT page_id, lead(page_id) OVER (PARTITION BY category ORDER BY updated_at DESC, page_id DESC) AS supersedes FROM wiki_pages WHERE status = 'active' QUALIFY row_number() OVER (PARTITION BY category ORDER BY updated_at DESC, page_id DESC) = 1")
def d19_supersedes(spark, sf):
    same = E.wiki_pages(spark, sf).withColumn("title", F.lit("one"))
    return D.pages_superseded(same).where("supersedes IS NOT NULL").select("page_id", "supersedes")


@query("wiki_links", "SELECT source_id, target_id, rel_type, max(confidence) AS confidence FROM wiki_links WHERE rel_type = 'similar' GROUP BY ALL")
def d20_checked_links(spark, sf):
    return D.checked_links(E.wiki_links(spark, sf), spark.createDataFrame([("similar",), ("extends",)], "rel_type string"))


@query("", "SELECT user_id AS run_id, max_by(event_type, row(ts, event_id)) AS status FROM events GROUP BY 1")
def d21_latest_run(spark, sf):
    log = E.table(spark, sf, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("status"), "ts", "event_id")
    return D.latest(log, ["run_id"], F.desc("ts"), F.desc("event_id")).select("run_id", "status")


@query("refine_runs", "SELECT run_id, CASE WHEN status = 'running' THEN 'error' ELSE status END AS status, CASE WHEN status = 'running' THEN 'interrupted' END AS error FROM refine_runs")
def d22_recover_tasks(spark, sf):
    return D.recovered_tasks(E.refine_runs(spark, sf)).select("run_id", "status", "error")


@query("raw_files", "SELECT session_key, min(file_id) AS first_file FROM raw_files GROUP BY 1")
def d23_create_once(spark, sf):
    runs = E.raw_files(spark, sf).groupBy("session_key").agg(F.min("file_id").alias("first_file"))
    return D.created_once(runs, runs.withColumn("first_file", F.lit("other")), "session_key")


@query("raw_files", f"SELECT file_id, CASE WHEN status = 'refined' AND refined_at < TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY THEN 'archived' ELSE status END AS status FROM raw_files")
def d24_archive_files(spark, sf):
    return D.old_files_archived(E.raw_files(spark, sf), AS_OF, 7).select("file_id", "status")


@query("refine_runs", "SELECT CAST(CAST(started_at AS DATE) AS VARCHAR) AS day, max(run_id) AS run_id FROM refine_runs GROUP BY 1")
def d25_daily_report(spark, sf):
    log = E.refine_runs(spark, sf).withColumn("day", F.to_date("started_at").cast("string"))
    return D.latest(log, ["day"], F.desc("run_id")).select("day", "run_id")


@query("memories", "SELECT count(DISTINCT content) AS memories, count(*) - count(DISTINCT content) AS archived FROM memories")
def d26_remove_duplicates(spark, sf):
    rest, _, archive = D.without_duplicates(E.memories(spark, sf), E.memory_tags(spark, sf), AS_OF)
    return rest.agg(F.count("*").alias("memories")).crossJoin(archive.agg(F.count("*").alias("archived")))  # one row each


@query("memories memory_tags", "SELECT memory_id AS idea_id FROM memories WHERE memory_id IN (SELECT memory_id FROM memory_tags WHERE dimension_id = 'ideas') OR priority > 98")
def d27_migrate_ideas(spark, sf):
    m = E.memories(spark, sf)
    tagged = relations.tagged(m, E.memory_tags(spark, sf), ["ideas"]).select(F.col("memory_id").alias("idea_id"))
    return D.created_once(m.where("priority > 98").select(F.col("memory_id").alias("idea_id")), tagged, "idea_id")


@query("memory_sources", "SELECT DISTINCT memory_id, source_ref FROM memory_sources")
def d28_distinct_sources(spark, sf):
    s = E.memory_sources(spark, sf).select("memory_id", "source_ref")
    return s.union(s).dropDuplicates(["memory_id", "source_ref"])


@query("raw_files", "SELECT CAST(CAST(concat('0x', substr(sha256(agent_id), 1, 16)) AS UBIGINT) % 100 AS INT) < 30 AS a, count(*) AS n FROM raw_files GROUP BY 1")
def d30_ab_split(spark, sf):
    from lodestone.functions import text as T

    return E.raw_files(spark, sf).groupBy((T.variant("agent_id", 0.3) == "a").alias("a")).agg(F.count("*").alias("n"))


SETTINGS = """SELECT CASE o_orderkey % 4 WHEN 0 THEN 'l1' WHEN 1 THEN 'l15' WHEN 2 THEN 'l2' ELSE 'tier0' END AS name, o_orderdate AS moment, o_orderkey AS seq,
    CASE o_custkey % 3 WHEN 0 THEN 'split' WHEN 1 THEN 'unsplit' ELSE 'activate' END AS action, concat('v', o_orderkey) AS version, concat('w', o_orderkey) AS other, 0.3 AS share
    FROM orders WHERE o_orderkey % 23 = 0"""
RUNS = """SELECT CASE o_orderkey % 4 WHEN 0 THEN 'l1' WHEN 1 THEN 'l15' WHEN 2 THEN 'l2' ELSE 'tier0' END AS name, CAST(o_orderkey AS {text}) AS key, o_orderdate AS moment,
    CASE WHEN o_orderkey % 17 = 0 THEN 'pinned' END AS override FROM orders"""


@query("", f"""WITH log AS ({SETTINGS}), runs AS ({RUNS.format(text="VARCHAR")}), seen AS (
    SELECT key, override, arg_max(version, seq_at) FILTER (action = 'activate') AS active, arg_max(action, seq_at) FILTER (action <> 'activate') AS ab,
      arg_max(version, seq_at) FILTER (action <> 'activate') AS a, arg_max(other, seq_at) FILTER (action <> 'activate') AS b
    FROM runs LEFT JOIN (SELECT *, (moment, seq) AS seq_at FROM log) l ON l.name = runs.name AND l.moment <= runs.moment GROUP BY 1, 2)
    SELECT key, CASE WHEN override IS NOT NULL THEN override WHEN ab = 'split' THEN CASE WHEN CAST(concat('0x', substr(sha256(key), 1, 16)) AS UBIGINT) % 100 < 30 THEN a ELSE b END ELSE active END AS version FROM seen""")
def d30_version_of_runs(spark, sf):
    """Each order is a run, and some are changes of the settings: which version did each run use?"""
    from lodestone.operators import versions

    orders = E.table(spark, sf, "orders")
    runs, log = (spark.sql(text.replace("FROM orders", "FROM {orders}"), orders=orders).withColumnRenamed("moment", "at") for text in (RUNS.format(text="STRING"), SETTINGS))
    return versions.versions_at(runs, log).select("key", "version")


@query("dimensions", "SELECT id, display_name, true AS active FROM dimensions")
def d31_registry_import(spark, sf):
    from lodestone.sources import stores

    read = E.dimensions(spark).select("id", "display_name")
    stored = read.where("id < 'h'").withColumn("active", F.lit(True))
    return stores.imported_registry(stored, read).select("id", "display_name", "active")


@query("memories", f"SELECT memory_id, CASE WHEN status = 'active' AND ttl_days IS NOT NULL AND updated_at <= TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY * ttl_days THEN 'expired' ELSE status END AS status FROM memories")
def p04_mark_expired(spark, sf):
    return D.expired_marked(E.memories(spark, sf), AS_OF).select("memory_id", "status")
