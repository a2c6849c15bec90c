"""Queries of section P: projections, filters and predicates."""

from pyspark.sql import functions as F

from lodestone.operators import selection as P
from lodestone.plans.registry import query
from lodestone.sources import entities as E
from lodestone.sources.entities import AS_OF

LIVE = f"(ttl_days IS NULL OR updated_at > TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY * ttl_days)"


@query("memories", "SELECT memory_id, status FROM memories WHERE status IN ('active', 'expired')")
def p01_status_in(spark, sf):
    return E.memories(spark, sf).where(P.status_in(["active", "expired"])).select("memory_id", "status")


@query("memories", "SELECT memory_id, status FROM memories WHERE status <> 'rejected'")
def p02_visible(spark, sf):
    return E.memories(spark, sf).where(P.visible()).select("memory_id", "status")


@query("memories", f"SELECT memory_id, ttl_days FROM memories WHERE {LIVE}")
def p03_ttl_live(spark, sf):
    return E.memories(spark, sf).where(P.live(AS_OF)).select("memory_id", "ttl_days")


@query("memories", f"SELECT memory_id, ttl_days FROM memories WHERE status = 'active' AND NOT {LIVE}")
def p04_ttl_expired(spark, sf):
    return E.memories(spark, sf).where(P.expired(AS_OF)).select("memory_id", "ttl_days")


@query("memories", f"SELECT memory_id FROM memories WHERE updated_at > TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY")
def p05_time_window(spark, sf):
    return E.memories(spark, sf).where(P.in_window("updated_at > 2w", AS_OF)).select("memory_id")


@query("memories", "SELECT memory_id FROM memories WHERE created_at BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-02-10 12:00:00'")
def p06_since_until(spark, sf):
    return E.memories(spark, sf).where(P.between("created_at", "2024-01-10 00:00:00", "2024-02-10 12:00:00", ["created_at", "updated_at"])).select("memory_id")


@query("scenes", "SELECT scene_id FROM scenes WHERE updated_at >= TIMESTAMP '2024-02-05 00:00:00'")
def p07_time_fallback(spark, sf):
    return E.scenes(spark, sf).where(P.between("heat", "2024-02-05 00:00:00", None, ["created_at", "updated_at"])).select("scene_id")


@query("memories", "SELECT memory_id FROM memories WHERE contains(lower(content), 'the and')")
def p08_contains(spark, sf):
    return E.memories(spark, sf).where(P.holds_text("content", "The And")).select("memory_id")


@query("", "SELECT doc_id FROM documents WHERE contains(lower(text), '%%%') OR contains(lower(source), '_')")
def p09_literal_wildcards(spark, sf):
    docs = E.table(spark, sf, "documents")
    return docs.where(P.holds_text("text", "%%%") | P.holds_text("source", "_")).select("doc_id")


@query("raw_files", "SELECT file_id, CAST(coalesce(ended_at, started_at) AS VARCHAR) AS at FROM raw_files WHERE contains(file_id, '7') OR contains(session_key, '7') OR contains(agent_id, '7') OR contains(status, '7') ORDER BY coalesce(ended_at, started_at) DESC, file_id DESC")
def p10_session_metadata(spark, sf):
    found = E.raw_files(spark, sf).where(P.any_column_holds(["file_id", "session_key", "agent_id", "status"], "7"))
    at = F.coalesce("ended_at", "started_at")
    return found.orderBy(at.desc(), F.desc("file_id")).select("file_id", at.cast("string").alias("at"))


@query("memories", "SELECT memory_id FROM memories WHERE (contains(lower(content), 'that') OR contains(lower(content), 'worthless')) AND status <> 'rejected'")
def p11_any_term(spark, sf):
    return E.memories(spark, sf).where(P.any_term("content", "that worthless x") & P.visible()).select("memory_id")


IDEA_FLAG = "CASE page_id % 3 WHEN 0 THEN 'x' WHEN 1 THEN '' ELSE NULL END"


@query("", f"SELECT page_id, 'set' AS kind FROM pages WHERE {IDEA_FLAG} <> '' UNION ALL SELECT page_id, 'unset' FROM pages WHERE {IDEA_FLAG} IS NULL OR {IDEA_FLAG} = ''")
def p12_flag_states(spark, sf):
    ideas = E.table(spark, sf, "pages").select("page_id", F.expr(IDEA_FLAG).alias("custom_flag"))
    with_flag = ideas.where(P.flag_set("custom_flag", True)).select("page_id", F.lit("set").alias("kind"))
    return with_flag.unionByName(ideas.where(P.flag_set("custom_flag", False)).select("page_id", F.lit("unset").alias("kind")))


@query("", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_custkey = 7 AND o_orderdate >= TIMESTAMP '1995-01-01 00:00:00'")
def p13_demand_filter(spark, sf):
    demands = E.table(spark, sf, "orders").withColumnsRenamed({"o_orderstatus": "status", "o_orderdate": "created_at"})
    return demands.where(P.conditions(P.status_in(["O", "P"]), F.col("o_custkey") == 7, P.between("created_at", "1995-01-01 00:00:00", None, ["created_at"]))).select("o_orderkey")


@query("", "SELECT p_partkey FROM part WHERE (contains(lower(p_name), '1') OR contains(CAST(p_partkey AS VARCHAR), '1')) AND p_size = 10")
def p14_project_filter(spark, sf):
    parts = E.table(spark, sf, "part").withColumn("id", F.col("p_partkey").cast("string"))
    return parts.where(P.conditions(P.any_column_holds(["p_name", "id"], "1"), F.col("p_size") == 10)).select("p_partkey")


@query("memories", "SELECT memory_id, priority FROM (SELECT memory_id, priority FROM memories ORDER BY updated_at DESC, memory_id LIMIT 50) WHERE priority >= 60")
def p15_filter_after_limit(spark, sf):
    return P.limit_then_filter(E.memories(spark, sf), [F.desc("updated_at"), F.asc("memory_id")], 50, F.col("priority") >= 60).select("memory_id", "priority")


@query("memories", "SELECT memory_id, CAST(NULL AS VARCHAR) AS reject_reason FROM memories")
def p16_optional_columns(spark, sf):
    return P.with_columns(E.memories(spark, sf), {"memory_id": "string", "reject_reason": "string"})


@query("wiki_pages", "SELECT page_id, url, title, category, status FROM wiki_pages")
def p17_light_projection(spark, sf):
    return P.without(E.wiki_pages(spark, sf), "html", "tags", "updated_at")


@query("wiki_pages", "SELECT page_id FROM wiki_pages WHERE NOT list_contains(tags, 'skill')")
def p18_no_skill_pages(spark, sf):
    return E.wiki_pages(spark, sf).where(P.not_skill()).select("page_id")


@query("memories", "SELECT memory_id FROM memories WHERE status IN ('active', 'expired') ORDER BY memory_id LIMIT 20 OFFSET 20")
def p19_checked_arguments(spark, sf):
    page, limit = P.parse_page("2"), P.parse_limit("20")
    return E.memories(spark, sf).where(P.status_in(P.parse_status_list("active,expired"))).orderBy("memory_id").offset((page - 1) * limit).limit(limit).select("memory_id")


@query("messages raw_files", "SELECT m.file_id, m.seq FROM messages m JOIN raw_files r ON m.file_id = r.file_id WHERE m.seq > r.last_refined_seq")
def p20_after_cursor(spark, sf):
    return P.after_cursor(E.messages(spark, sf), E.raw_files(spark, sf)).select("file_id", "seq")


CUT = "CASE WHEN length(content) <= 200 THEN content ELSE concat(substr(content, 1, 200), chr(10), '...[截断 ', length(content) - 200, ' 字符]') END"


@query("messages", f"SELECT file_id, seq, {CUT} AS content FROM messages WHERE role <> 'system' AND NOT (starts_with(ltrim(content), '[PRIOR CONTEXT]') OR starts_with(ltrim(content), 'MEDIA:'))")
def p21_prune_messages(spark, sf):
    said = E.messages(spark, sf).withColumn("role", F.when(F.col("role") == "system", "tool").otherwise(F.col("role")))
    return P.prune(said, most_chars=200).select("file_id", "seq", "content")


@query("memories", "SELECT memory_id FROM memories WHERE contains(lower(content), 'loser')")
def p22_mentions(spark, sf):
    return E.memories(spark, sf).where(P.holds_text("content", "LOSER")).select("memory_id")


MOOD, TECHNICAL = ["pathetic", "stupid", "trash"], ["mail1", "http"]


@query("memories memory_tags", """
    SELECT memory_id FROM (SELECT m.* FROM memories m JOIN memory_tags t USING (memory_id) WHERE t.dimension_id = 'status' AND m.status = 'active' ORDER BY m.updated_at DESC, memory_id LIMIT 50)
    WHERE (contains(content, 'pathetic') OR contains(content, 'stupid') OR contains(content, 'trash')) AND NOT contains(content, 'mail1') AND NOT contains(content, 'http')""")  # fmt: skip
def p23_low_mood(spark, sf):
    tagged = E.memory_tags(spark, sf).where("dimension_id = 'status'")
    recent = E.memories(spark, sf).where("status = 'active'").join(tagged, "memory_id", "left_semi").orderBy(F.desc("updated_at"), "memory_id").limit(50)
    has = [F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.col("content"), w)) for words in (MOOD, TECHNICAL)]
    return recent.where(has[0] & ~has[1]).select("memory_id")


@query("memories memory_tags", f"SELECT memory_id, CAST(updated_at AS VARCHAR) AS updated_at FROM memories m WHERE status = 'active' AND updated_at < TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AND EXISTS (SELECT 1 FROM memory_tags t WHERE t.memory_id = m.memory_id AND dimension_id = 'goals') ORDER BY m.updated_at, memory_id LIMIT 20")
def p24_stale_goals(spark, sf):
    goals = E.memory_tags(spark, sf).where("dimension_id = 'goals'")
    old = E.memories(spark, sf).where((F.col("status") == "active") & (F.col("updated_at") < P.moment("2024-03-08 00:00:00"))).join(goals, "memory_id", "left_semi")
    return old.orderBy("updated_at", "memory_id").limit(20).select("memory_id", F.col("updated_at").cast("string").alias("updated_at"))


@query("memories memory_sources", """
    SELECT n.memory_id FROM memories n JOIN memory_sources s USING (memory_id) WHERE n.status = 'rejected' AND NOT EXISTS (
      SELECT 1 FROM memories o JOIN memory_sources r ON o.memory_id = r.memory_id WHERE o.status = 'active' AND r.source_ref = s.source_ref AND trim(o.content) = trim(n.content))""")
def p25_idempotent_insert(spark, sf):
    rows = E.memories(spark, sf).join(E.memory_sources(spark, sf).select("memory_id", "source_ref"), "memory_id")
    return P.new_only(rows.where("status = 'rejected'"), rows).select("memory_id")


@query("wiki_pages", "SELECT page_id, CASE WHEN category NOT IN ('guide', 'note') THEN 'type' WHEN trim(title) = '' THEN 'required' WHEN length(html) > 2000 THEN 'too_long' END AS reason FROM wiki_pages")
def p26_gate(spark, sf):
    return E.wiki_pages(spark, sf).select("page_id", P.gate(F.col("category"), F.col("title"), F.col("html"), ["guide", "note"], 2000).alias("reason"))


@query("memories", "SELECT memory_id, array_to_string(list_filter([CASE WHEN trim(content) = '' THEN 'non_empty' END, CASE WHEN length(content) < 500 THEN 'min_length' END, CASE WHEN length(content) > 4000 THEN 'max_length' END], lambda x: x IS NOT NULL), ',') AS failed FROM memories")
def p27_quality_rules(spark, sf):
    return E.memories(spark, sf).select("memory_id", F.array_join(P.quality_rules(F.col("content"), 500, 4000), ",").alias("failed"))


@query("", "SELECT event_id FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN concat('[', props, ']') WHEN 2 THEN replace(props, ':', ': \"x') ELSE replace(props, '\"k\"', '\"other\"') END AS p FROM events) WHERE NOT coalesce(CASE WHEN json_valid(p) THEN json_type(p) = 'OBJECT' AND json_type(p, '$.k') IN ('BIGINT', 'UBIGINT') END, false)")
def p28_schema_errors(spark, sf):
    """Events whose properties, some of them spoilt here, have no whole number ``k``."""
    k = F.col("event_id") % 4
    spoilt = F.when(k == 0, F.col("props")).when(k == 1, F.concat(F.lit("["), "props", F.lit("]"))).when(k == 2, F.replace("props", F.lit(":"), F.lit(': "x'))).otherwise(F.replace("props", F.lit('"k"'), F.lit('"other"')))
    rows = E.table(spark, sf, "events").select("event_id", spoilt.alias("p"))
    got = F.from_json("p", "k long, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return rows.select("event_id", got.alias("g"), F.startswith(F.trim("p"), F.lit("{")).alias("object")).where(~F.coalesce(F.col("object") & F.col("g.k").isNotNull() & F.col("g._bad").isNull(), F.lit(False))).select("event_id")


@query("", "SELECT p_partkey FROM part WHERE NOT (starts_with(p_type, 'ECONOMY') OR starts_with(p_type, 'SMALL'))")
def p29_model_list(spark, sf):
    denied = spark.createDataFrame([("ECONOMY",), ("SMALL",)], "prefix string")
    return P.allowed_models(E.table(spark, sf, "part").withColumn("model", F.col("p_type")), denied).select("p_partkey")


@query("", "SELECT * FROM (VALUES ('bad', 'dimension nowhere'), ('bad', 'limit 99')) AS t(template, error)")
def p30_template_errors(spark, sf):
    good = {"sections": [{"query": {"dimensions": ["focus"], "limit": 5}}]}
    bad = {"sections": [{"query": {"dimensions": ["focus", "nowhere"], "limit": 99}}]}
    rows = [(n, e) for n, t in (("good", good), ("bad", bad)) for e in P.template_errors(t, E.DIMENSION_IDS)]
    return spark.createDataFrame(rows, "template string, error string")
