"""Queries of sections G, S and X."""

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import statistics as A
from lodestone.operators import surfaces as G
from lodestone.plans.ranking import dedup_sql
from lodestone.plans.registry import query
from lodestone.session import working_path
from lodestone.sources import entities as E
from lodestone.sources import stores as S
from lodestone.sources.entities import AS_OF
from lodestone.sources.versions import VersionStore

VELOCITY = {d[0]: d[2] for d in E.DIMENSIONS}
LIVE = f"status <> 'rejected' AND (ttl_days IS NULL OR updated_at > TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY * ttl_days)"
LABEL = f"date_diff('second', updated_at, TIMESTAMP '{AS_OF}')"
DAYS_AGO = f"CASE WHEN {LABEL} < 0 THEN NULL WHEN {LABEL} < 60 THEN '刚刚' WHEN {LABEL} < 3600 THEN concat({LABEL} // 60, '分钟前') WHEN {LABEL} < 86400 THEN concat({LABEL} // 3600, '小时前') WHEN {LABEL} < 2592000 THEN concat({LABEL} // 86400, '天前') END"


def _section(spark, sf, dims, **more):
    return G.section(E.memories(spark, sf), E.memory_tags(spark, sf), dims, VELOCITY, AS_OF, **more)


@query("memories memory_tags", f"""SELECT memory_id, priority, {DAYS_AGO} AS relative_time FROM (SELECT * FROM memories WHERE {LIVE} AND memory_id IN (SELECT memory_id FROM memory_tags WHERE dimension_id IN ('status', 'focus'))
    ORDER BY updated_at DESC, memory_id LIMIT 20) WHERE priority >= 20""")
def g01_section_query(spark, sf):
    from lodestone.functions import text as T

    found = _section(spark, sf, ["status", "focus"], match="any", limit=20, priority_min=20)
    return found.select("memory_id", "priority", T.relative_time("updated_at", AS_OF).alias("relative_time"))


@query("memories memory_tags", f"SELECT memory_id FROM memories WHERE {LIVE} AND updated_at > TIMESTAMP '{AS_OF}' - INTERVAL 60 DAY AND memory_id IN (SELECT memory_id FROM memory_tags WHERE dimension_id IN ('identity', 'values') GROUP BY 1 HAVING count(*) = 2) ORDER BY priority DESC, memory_id LIMIT 50")
def g01_section_all_dimensions(spark, sf):
    return _section(spark, sf, ["identity", "values"], window="updated_at > 60d", limit=50).select("memory_id")


def _blocks(spark, sf):
    return G.blocks([("now", _section(spark, sf, ["status", "focus"], match="any", limit=20)), ("who", _section(spark, sf, ["identity", "focus"], match="any", limit=20))], AS_OF)


def _limited(section: int, dims: str, order: str) -> str:
    found = f"SELECT * FROM memories WHERE {LIVE} AND memory_id IN (SELECT memory_id FROM memory_tags WHERE dimension_id IN ({dims})) ORDER BY {order} DESC, memory_id LIMIT 20"
    return f"SELECT {section} AS section, row_number() OVER (ORDER BY updated_at DESC, memory_id) AS rank, memory_id, content, {DAYS_AGO} AS relative_time FROM ({found})"


BLOCKS = f"""WITH RECURSIVE {dedup_sql(_limited(0, "'status', 'focus'", "updated_at") + " UNION ALL " + _limited(1, "'identity', 'focus'", "priority"))}"""


@query("memories memory_tags", f"{BLOCKS} SELECT section, rank, memory_id, relative_time FROM kept")
def g02_blocks(spark, sf):
    return _blocks(spark, sf).select("section", "rank", "memory_id", "relative_time")


@query("memories memory_tags", f"{BLOCKS} SELECT 2 AS queries, count(*) * 30 AS tokens_est FROM kept")
def g03_inject_stats(spark, sf):
    return G.block_stats(_blocks(spark, sf), 2)


TEMPLATES = {
    "base": "{name: base, memory_types: [status, focus, identity, skills], token_budget: 2000, sections: [{title: now, query: {dimensions: [status], limit: 3}}, {title: who, query: {dimensions: [identity, skills], match: any, priority_min: 30, limit: 12}}]}",
    "mine": "{name: mine, extends: base, sections: [{title: now, query: {dimensions: [status, focus], match: any, limit: 20}}, {title: best, query: {dimensions: [skills], sort: priority, limit: 9}}]}",
}


def _section_sql(title: str, dims: str, order: str, limit: int, least: int = 0) -> str:
    found = f"SELECT * FROM memories WHERE {LIVE} AND memory_id IN (SELECT memory_id FROM memory_tags WHERE dimension_id IN ({dims})) ORDER BY {order} DESC, memory_id LIMIT {limit}"
    return f"SELECT '{title}' AS section, memory_id FROM ({found}) WHERE priority >= {least}"


@query("memories memory_tags", " UNION ALL ".join((_section_sql("now", "'status', 'focus'", "updated_at", 20), _section_sql("who", "'identity', 'skills'", "priority", 12, 30), _section_sql("best", "'skills'", "priority", 9))))
def g04_template(spark, sf):
    """A template that extends another, read, checked, and run section by section."""
    template = G.load_template(TEMPLATES, "mine", E.DIMENSION_IDS)
    sections = G.template_sections(E.memories(spark, sf), E.memory_tags(spark, sf), template, VELOCITY, AS_OF)
    parts = [rows.select(F.lit(title).alias("section"), "memory_id") for title, rows in sections]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


NODES = """s AS (SELECT scene_id, (SELECT count(*) FROM scene_memories m WHERE m.scene_id = x.scene_id) AS size FROM scenes x WHERE status = 'active' ORDER BY heat DESC, scene_id LIMIT 200),
    p AS (SELECT page_id FROM wiki_pages WHERE status = 'active' ORDER BY updated_at DESC, page_id LIMIT 200), m AS (SELECT memory_id FROM memories WHERE status = 'active' ORDER BY priority DESC, memory_id LIMIT 3000),
    nodes AS (SELECT concat('s', scene_id) AS id, 'scene' AS kind, size FROM s UNION ALL SELECT concat('w', page_id), 'wiki', 1 FROM p UNION ALL SELECT concat('m', memory_id), 'memory', 1 FROM m)"""


def _graph(spark, sf):
    return G.graph(E.scenes(spark, sf), E.wiki_pages(spark, sf), E.memories(spark, sf), E.scene_memories(spark, sf), E.wiki_links(spark, sf))


@query("scenes scene_memories wiki_pages memories", f"WITH {NODES} SELECT id, kind, size FROM nodes")
def g05_graph_nodes(spark, sf):
    return _graph(spark, sf)[0]


@query("scenes scene_memories wiki_pages memories wiki_links", f"""WITH {NODES}, e AS (SELECT concat('s', scene_id) AS source_id, concat('m', memory_id) AS target_id, 'contains' AS rel_type FROM scene_memories
    UNION ALL SELECT DISTINCT concat('w', source_id), concat('w', target_id), rel_type FROM wiki_links) SELECT * FROM e WHERE source_id IN (SELECT id FROM nodes) AND target_id IN (SELECT id FROM nodes)""")
def g05_graph_links(spark, sf):
    return _graph(spark, sf)[1]


@query("memories memory_tags", f"{BLOCKS} SELECT string_agg(concat('- ', substr(content, 1, 80)), chr(10) ORDER BY section, rank) AS profile FROM kept")
def g06_role_profile(spark, sf):
    return G.profile_text(_blocks(spark, sf))


@query("", """
    SELECT item_id, unnest(CASE item_id % 6
        WHEN 0 THEN [] WHEN 1 THEN ['$.data.name: missing', '$.more: unknown'] WHEN 2 THEN ['$.data.age: unknown', '$.data.description: missing', '$.data.scenario: wrong kind']
        WHEN 3 THEN ['$.data.extensions.care.often: unknown'] WHEN 4 THEN ['$.data: wrong kind'] ELSE ['$: wrong kind'] END) AS fault FROM benchmark""")
def f42_role_errors(spark, sf):
    """A role card is made of each item, most of them with some fault."""
    k, text = F.col("item_id") % 6, F.to_json(F.struct("text"))
    said = F.substr(text, F.lit(9), F.length(text) - 9)  # the text as JSON has it
    data = (
        F.when(k == 1, F.concat(F.lit('{"name": " ", "description": '), said, F.lit("}")))
        .when(k == 2, F.concat(F.lit('{"name": '), said, F.lit(', "scenario": 5, "age": 3, "first_mes": null}')))
        .when(k == 4, F.lit("[1]"))
        .otherwise(F.concat(F.lit('{"name": "n", "description": '), said, F.lit(', "character_book": {"a": 1}, "extensions": {"other": 1, "care": {"'), F.when(k == 3, "often").otherwise("frequency"), F.lit('": 2}}}')))
    )
    card = F.when(k == 5, said).otherwise(F.concat(F.lit("{"), F.when(k == 1, '"more": 1, ').otherwise('"spec": "v2", '), F.lit('"data": '), data, F.lit("}")))
    return E.table(spark, sf, "benchmark").select("item_id", F.explode(G.schema_faults(card, G.ROLE_CARD)).alias("fault"))


@query("memories memory_tags memory_sources", "SELECT memory_id, status, (SELECT string_agg(dimension_id, ',' ORDER BY dimension_id) FROM memory_tags t WHERE t.memory_id = m.memory_id) AS dimensions, (SELECT min(source_ref) FROM memory_sources s WHERE s.memory_id = m.memory_id) AS sources FROM memories m WHERE memory_id = '17'")
def g07_memory_detail(spark, sf):
    one = G.detail(E.memories(spark, sf), E.memory_tags(spark, sf), E.memory_sources(spark, sf), "17")
    return one.select("memory_id", "status", F.array_join("dimensions", ",").alias("dimensions"), F.array_join("sources", ",").alias("sources"))


@query("raw_files memory_vectors memories", f"SELECT (SELECT count(*) FROM memory_vectors) AS vectors, (SELECT count(*) FROM memories) AS memories, (SELECT date_diff('second', max(refined_at), TIMESTAMP '{AS_OF}') FROM raw_files) AS age_sec")
def g08_health(spark, sf):
    vectors, rows = E.memory_vectors(spark, sf).agg(F.count("*").alias("vectors")), E.memories(spark, sf).agg(F.count("*").alias("memories"))
    return vectors.crossJoin(rows).crossJoin(A.progress(E.raw_files(spark, sf), AS_OF).select("age_sec"))  # one row each


def _folder(spark, name):
    return working_path(spark, name)


@query("memories memory_tags", "SELECT 'memories' AS entity, count(*) AS n FROM memories UNION ALL SELECT 'memory_tags', count(*) FROM memory_tags UNION ALL SELECT 'none', 0")
def s01_open_store(spark, sf):
    folder = _folder(spark, "store")
    written = {"memories": E.memories(spark, sf), "memory_tags": E.memory_tags(spark, sf)}
    S.snapshot(written, folder, "v1")
    schemas = {n: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) for n, df in written.items()} | {"none": "id string"}
    opened = S.open_store(spark, f"{folder}/v1", schemas)
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(n).alias("entity"), "n") for n, df in opened.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("memories", "SELECT memory_id, priority FROM memories WHERE memory_id = '42'")
def s02_row_by_key(spark, sf):
    return S.row_of(E.memories(spark, sf), "memory_id", "42").select("memory_id", "priority")


def _sessions(spark, sf):
    """Messages with times, some of them from tools."""
    tool = (F.col("role") == "assistant") & (F.col("seq") % 3 == 0)
    said = E.messages(spark, sf).withColumns({"role": F.when(tool, "tool").otherwise(F.col("role")), "tool_name": F.when(tool & (F.col("seq") % 2 == 0), "sh")})
    return said.withColumn("timestamp", F.concat(F.lit("2024-03-01T00:00:"), F.lpad("seq", 2, "0"), F.lit("Z")))


TOOL = "role = 'assistant' AND seq % 3 = 0"
PARSED = f"""SELECT file_id, seq, concat('2024-03-01T00:00:', lpad(CAST(seq AS VARCHAR), 2, '0'), 'Z') AS timestamp, CASE WHEN {TOOL} THEN 'tool' ELSE role END AS role,
    regexp_replace(regexp_replace(content, '^\n+', ''), '\n+$', '') AS content, CASE WHEN {TOOL} AND seq % 2 = 0 THEN 'sh' END AS tool_name FROM messages"""


@query("messages", PARSED)
def s03_session_files(spark, sf):
    """A round trip: messages are written as session files and parsed again, every role and tool as it was."""
    folder = _folder(spark, "sessions")
    S.session_text(_sessions(spark, sf)).select("text").repartition(8).write.text(folder, lineSep="\u0001\n")
    files = spark.read.option("lineSep", "\u0001\n").text(folder).where(S.session_fault("value").isNull())
    return files.select(S.front_matter("value", "file_id").alias("file_id"), F.inline(S.parse_session("value")))


@query("messages", PARSED)
def s04_parse_body(spark, sf):
    """Blocks alone, as they are appended to a file."""
    blocks = _sessions(spark, sf).select("file_id", "seq", S.message_block(F.lit(False)).alias("block"))
    bodies = blocks.groupBy("file_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("seq", "block")))["block"], "").alias("text"))
    return bodies.select("file_id", F.inline(S.parse_body("text")))


@query("messages", "SELECT source_type, count(*) AS n FROM messages, (VALUES ('session'), ('upload')) AS t(source_type) GROUP BY 1")
def s05_write_and_append(spark, sf):
    """Messages of two kinds are written as files, each session's in its kind's folder."""
    folder = _folder(spark, "l0")
    for kind in ("session", "upload"):
        S.write_sessions(E.messages(spark, sf).withColumn("timestamp", F.lit("2024-03-01T00:00:00Z")), folder, f"all-{kind}", kind)
    kinds = S.read_sessions(spark, folder).groupBy("folder").agg(F.count("*").alias("n"))
    return kinds.select(F.when(F.col("folder") == "sessions", "session").when(F.col("folder") == "uploads", "upload").alias("source_type"), "n")


@query("messages", PARSED.replace("AS tool_name FROM", "AS tool_name, CASE CAST(file_id AS BIGINT) % 3 WHEN 0 THEN 'sessions' WHEN 1 THEN 'uploads' ELSE 'external' END AS folder FROM"))
def s06_append_messages(spark, sf):
    """Files are written with their first two messages, and the rest is appended, twice under one name."""
    folder, kind = _folder(spark, "l0"), F.array(F.lit("session"), F.lit("upload"), F.lit("external"))[(F.col("file_id").cast("long") % 3).cast("int")]
    said = _sessions(spark, sf).withColumn("source_type", kind)
    for name, part in (("first", said.where("seq <= 2")), ("rest", said.where("seq > 2")), ("rest", said.where("seq > 2"))):
        S.write_sessions(part, folder, name)
    return S.read_sessions(spark, folder).drop("session_key")


@query("messages", """SELECT file_id, CASE CAST(file_id AS INT) % 5 WHEN 0 THEN 'no front matter' WHEN 1 THEN 'front matter isn''t closed' WHEN 2 THEN 'no file_id or session_key'
    WHEN 3 THEN 'unknown format_version' END AS fault FROM messages GROUP BY 1""")
def s08_session_fault(spark, sf):
    k, text = F.col("file_id").cast("int") % 5, F.col("text")
    broken = F.when(k == 0, F.substring(text, 5, 1 << 30)).when(k == 1, F.substring(text, 1, 40)).when(k == 2, F.replace(text, F.lit("session_key"), F.lit("key"))).when(k == 3, F.replace(text, F.lit("format_version: 1"), F.lit("format_version: 2"))).otherwise(text)
    return S.session_text(_sessions(spark, sf)).select("file_id", S.session_fault(broken).alias("fault"))


@query("", "SELECT kind, fault, count(*) AS n FROM (SELECT 'url' AS kind, NULL AS fault FROM pages UNION ALL SELECT 'file', CASE WHEN item_id % 2 = 0 THEN NULL ELSE 'unsupported pdf' END FROM benchmark UNION ALL SELECT 'text', NULL FROM benchmark) GROUP BY 1, 2")
def s09_ingest(spark, sf):
    items = E.table(spark, sf, "benchmark")
    sources = E.table(spark, sf, "pages").select(F.col("url").alias("source"), F.col("html").alias("body"))
    files = items.select(F.concat(F.lit("/a/"), F.col("item_id").cast("string"), F.when(F.col("item_id") % 2 == 0, ".md").otherwise(".pdf")).alias("source"), F.col("text").alias("body"))
    texts = items.select(F.concat(F.lit("note\n"), F.col("text")).alias("source"), F.col("text").alias("body"))
    return S.ingest(sources.unionByName(files).unionByName(texts)).groupBy("kind", "fault").agg(F.count("*").alias("n"))


def _logs(spark, sf):
    """Compressed logs of all conversations, some of them of tests, with an event of no message and a broken line in each."""
    folder = _folder(spark, "logs")
    part = F.array(F.struct(F.lit("text").alias("type"), F.col("content").alias("text")), F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text")))
    kind = F.when(F.col("role") == "system", "tool_result").otherwise(F.col("role"))
    event = F.to_json(F.struct(F.col("seq").cast("long").alias("ms"), kind.alias("type"), part.alias("content")))
    own = E.messages(spark, sf).groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("seq", event.alias("e"))))["e"].alias("events"))
    workspace = F.when(F.col("file_id").cast("long") % 5 == 0, "x-cli-test").otherwise("home")
    S.write_logs(own.select(workspace.alias("workspace"), F.col("file_id").alias("session"), F.concat(F.array(F.lit('{"type": "turn/begin"}'), F.lit("{broken")), "events").alias("events")), folder)
    return S.read_logs(spark, folder)


@query("messages", "SELECT file_id AS session, seq AS ms, CASE role WHEN 'system' THEN 'tool' ELSE role END AS role, content FROM messages WHERE content <> '' AND CAST(file_id AS BIGINT) % 5 <> 0")
def s12_event_log(spark, sf):
    """Logs are written, found, read and flattened."""
    return S.event_messages(S.logged_events(_logs(spark, sf)))


@query("messages", "SELECT 'home' AS workspace, file_id AS session, count(*) + 2 AS n FROM messages WHERE CAST(file_id AS BIGINT) % 5 <> 0 GROUP BY 2")
def s14_discovered_logs(spark, sf):
    return _logs(spark, sf).groupBy("workspace", "session").agg(F.count("event").alias("n"))


@query("raw_files", "SELECT file_id FROM raw_files WHERE CAST(file_id AS INT) % 3 = 0 ORDER BY 1")
def s15_not_imported(spark, sf):
    k = F.col("file_id").cast("int") % 3
    sessions = E.raw_files(spark, sf).select("file_id", F.concat(F.lit("d"), "file_id").alias("dir_key"), F.concat(F.lit("m"), "file_id").alias("ms_key"))
    existing = E.raw_files(spark, sf).where(k != 0).select(F.concat(F.when(k == 1, "d").otherwise("m"), "file_id").alias("session_key"))
    return S.not_imported(sessions, existing).select("file_id").orderBy("file_id")


@query("messages raw_files", """SELECT session_key, agent_id, count(*) AS n, sum(length(content)) AS chars FROM messages JOIN raw_files USING (file_id)
    WHERE role <> 'system' AND trim(content) <> '' GROUP BY 1, 2""")
def s16_foreign_sessions(spark, sf):
    """Sessions and messages lie in other programs' SQLite files, several of each."""
    folder = _folder(spark, "foreign")
    S.write_foreign(E.raw_files(spark, sf).select(F.col("file_id").alias("id"), F.unix_timestamp("started_at").cast("double").alias("started_at"), "session_key", "agent_id").repartition(3, "id"), f"{folder}/sessions", "sessions")
    said = E.messages(spark, sf).select(F.col("seq").cast("long").alias("id"), F.col("file_id").alias("session_id"), "role", "content", F.lit(0.0).alias("timestamp"))
    S.write_foreign(said.repartition(5, "session_id"), f"{folder}/messages", "messages")
    sessions = S.read_foreign(spark, f"{folder}/sessions", "sessions", "id string, started_at double, session_key string, agent_id string")
    messages = S.read_foreign(spark, f"{folder}/messages", "messages", "id long, session_id string, role string, content string, timestamp double").where(F.col("role").isin("user", "assistant"))
    found = S.foreign_messages(sessions.select("id", "started_at"), messages)
    return found.join(sessions.select(F.col("id").alias("file_id"), "session_key", "agent_id"), "file_id").groupBy("session_key", "agent_id").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("chars"))


FILES = """SELECT 'd' || doc_id || '.md' AS name, CASE WHEN {changed} THEN concat(text, '!') ELSE text END AS text FROM documents WHERE text IS NOT NULL"""


def _file_versions(spark, sf):
    """Two snapshots, the second with what changed since, an archive of old files, and a restored first version."""
    store = VersionStore(spark, _folder(spark, "versions"))
    docs = E.table(spark, sf, "documents").where("text IS NOT NULL")
    old = F.when(F.col("doc_id") % 4 == 0, F.lit("2023-10-01")).otherwise(F.lit("2024-03-01")).cast("timestamp_ntz")
    changed = F.col("doc_id") % 10 == 1
    one = docs.select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".md")).alias("name"), F.encode("text", "UTF-8").alias("content"), old.alias("modified"), changed.alias("changed"))
    two = one.withColumn("content", F.when(F.col("changed"), F.concat("content", F.encode(F.lit("!"), "UTF-8"))).otherwise(F.col("content")))
    two = two.withColumn("modified", F.when(F.col("changed"), F.lit("2024-03-14").cast("timestamp_ntz")).otherwise(F.col("modified")))
    store.snapshot(one, "v1")
    store.snapshot(two, "v2", since="2024-03-10 00:00:00")
    store.archive("v3", AS_OF)
    store.restore("v1", store.files(), "safe")
    return store


@query("", f"""WITH one AS ({FILES.format(changed="false")}), two AS ({FILES.format(changed="doc_id % 10 = 1")}), v3 AS (SELECT * FROM two WHERE NOT (CAST(substr(name, 2, length(name) - 4) AS BIGINT) % 4 = 0 AND CAST(substr(name, 2, length(name) - 4) AS BIGINT) % 10 <> 1))
    SELECT v AS version, name, sha256(text) AS digest FROM (SELECT 'v1' AS v, * FROM one UNION ALL SELECT 'v2', * FROM two UNION ALL SELECT 'v3', * FROM v3 UNION ALL SELECT 'safe', * FROM v3 UNION ALL SELECT 'live', * FROM one)""")
def s21_file_versions(spark, sf):
    """Each version's files, read back, and those of the live one."""
    store = _file_versions(spark, sf)
    parts = [store.files(v).select(F.lit(v or "live").alias("version"), "name", F.sha2("content", 256).alias("digest")) for v in ("v1", "v2", "v3", "safe", None)]
    return functools.reduce(DataFrame.unionByName, parts)


@query("", "SELECT count(*) AS objects, count(DISTINCT text) AS contents, sum(octet_length(encode(text))) AS bytes FROM (SELECT DISTINCT text FROM (SELECT text FROM documents WHERE text IS NOT NULL UNION ALL SELECT concat(text, '!') FROM documents WHERE text IS NOT NULL AND doc_id % 10 = 1))")
def s21_stored_once(spark, sf):
    """What several versions hold, or several files, is stored once."""
    stored = spark.read.parquet(f"{_file_versions(spark, sf).path}/objects")
    return stored.agg(F.count("*").alias("objects"), F.count_distinct("digest").alias("contents"), F.sum(F.octet_length("content")).alias("bytes"))


@query("", "SELECT 'd' || doc_id || '.md' AS name FROM documents WHERE text IS NOT NULL AND doc_id % 4 = 0 AND doc_id % 10 <> 1")
def s24_archived_files(spark, sf):
    return _file_versions(spark, sf).archived().select("name")


CASES = """
cases:
  - {case_id: c1, difficulty: easy, conversation: "hi", expected_l1: [{content: "a", dimensions: [focus, goals]}, {content: "b"}]}
  - {case_id: c2, difficulty: hard, conversation: "ho", expected_l1: [{content: "c", dimensions: [ideas]}]}
"""


@query("", "SELECT * FROM (VALUES ('c1', 'a', 2), ('c1', 'b', 0), ('c2', 'c', 1)) AS t(case_id, content, dims)")
def s17_evaluation_cases(spark, sf):
    return S.load_cases(spark, CASES).select("case_id", F.inline("expected_l1")).select("case_id", "content", F.size("dimensions").alias("dims"))


@query("", "SELECT * FROM (VALUES ('similar', '相似'), ('extends', '扩展')) AS t(id, display_name)")
def s18_registry(spark, sf):
    return S.load_registry(spark, "relations: [{id: similar, display_name: 相似}, {id: extends, display_name: 扩展}]", "relations", ["id", "display_name"])


@query("dimensions", "SELECT id, id <> 'focus' AS active FROM dimensions")
def s19_import_registry(spark, sf):
    read = E.dimensions(spark).select("id", "display_name")
    stored = read.where("id IN ('focus', 'goals')").withColumn("active", F.col("id") != "focus")
    return S.imported_registry(stored, S.imported_registry(stored, read).drop("active")).select("id", "active")


@query("memories memory_vectors", "SELECT memory_id, memory_id IN (SELECT memory_id FROM memory_vectors WHERE CAST(memory_id AS INT) % 2 = 0) AS cached FROM memories")
def s20_cache(spark, sf):
    m = E.memories(spark, sf).withColumn("content", F.concat_ws("|", "memory_id", "content"))
    cache = m.join(E.memory_vectors(spark, sf), "memory_id").where("int(memory_id) % 2 = 0").select(F.sha2("content", 256).alias("content_key"), F.lit("m").alias("model"), "embedding", "dims")
    return S.cached_vectors(m, cache, "m", 64).select("memory_id", F.col("embedding").isNotNull().alias("cached"))


@query("memories", "SELECT memory_id, status FROM memories")
def s21_snapshot_restore(spark, sf):
    folder = _folder(spark, "snapshot")
    S.snapshot({"memories": E.memories(spark, sf).select("memory_id", "status")}, folder, "v1")
    return spark.read.parquet(f"{folder}/v1/memories")


@query("", "SELECT concat('s', lpad(CAST(i AS VARCHAR), 3, '0')) AS name FROM range(0, 30) t(i) WHERE i % 3 = 2 OR (i % 3 = 0 AND i >= 9) OR (i % 3 = 1 AND i >= 22)")
def s22_rotation(spark, sf):
    names = spark.range(30).select(F.concat(F.lit("s"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("name"), F.element_at(F.array(F.lit("full"), F.lit("monthly"), F.lit("daily")), (F.col("id") % 3 + 1).cast("int")).alias("class"))
    return S.kept_snapshots(names).select("name")


@query("raw_files", f"SELECT file_id FROM raw_files WHERE started_at < TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY")
def s24_cold_files(spark, sf):
    return S.cold_files(E.raw_files(spark, sf), AS_OF, 7).select("file_id")


@query("memories", "SELECT concat('# r', chr(10), chr(10), '| metric | value |', chr(10), '|---|---|', chr(10), '| memories | ', count(*), ' |') AS report FROM memories")
def s26_report(spark, sf):
    rows = E.memories(spark, sf).agg(F.lit("memories").alias("metric"), F.count("*").alias("value")).collect()  # one row a metric
    return spark.createDataFrame([(S.report_text([r.asDict() for r in rows], "r"),)], "report string")


@query("wiki_pages", "SELECT page_id, concat('<h1>', title, '</h1>') AS html FROM wiki_pages")
def s27_html_export(spark, sf):
    return E.wiki_pages(spark, sf).select("page_id", F.concat(F.lit("<h1>"), F.col("title"), F.lit("</h1>")).alias("html"))


@query("wiki_pages", r"""
    WITH texts AS (SELECT *, concat('# ', title, chr(10), CASE WHEN CAST(page_id AS INT) % 2 = 0 THEN concat('  ```html"', chr(10), html, chr(10), '```', chr(10), '### a & b', chr(10)) ELSE html END, CASE WHEN CAST(page_id AS INT) % 5 = 0 THEN concat(chr(10), '``` ', chr(10), '# open') ELSE '' END) AS content FROM wiki_pages),
    lines AS (SELECT page_id, unnest(string_split(regexp_replace(content, '\n$', ''), chr(10))) AS line, generate_subscripts(string_split(regexp_replace(content, '\n$', ''), chr(10)), 1) AS pos FROM texts),
    marked AS (SELECT *, starts_with(trim(line), '```') AS fence, replace(replace(replace(replace(replace(line, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#x27;') AS safe FROM lines),
    blocks AS (SELECT *, CAST(sum(CASE WHEN fence THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos) AS BIGINT) AS block FROM marked),
    parts AS (
      SELECT page_id, block, concat('<pre><code class="language-', trim(substr(trim(any_value(safe) FILTER (fence)), 4)), '">', coalesce(string_agg(safe, chr(10) ORDER BY pos) FILTER (NOT fence), ''), '</code></pre>') AS part FROM blocks WHERE block % 2 = 1 GROUP BY 1, 2
      UNION ALL
      SELECT page_id, block, coalesce(string_agg(CASE WHEN starts_with(line, '### ') THEN concat('<h3>', substr(safe, 5), '</h3>') WHEN starts_with(line, '## ') THEN concat('<h2>', substr(safe, 4), '</h2>') WHEN starts_with(line, '# ') THEN concat('<h1>', substr(safe, 3), '</h1>') WHEN trim(line) = '' THEN '<p></p>' ELSE concat('<p>', safe, '</p>') END, '' ORDER BY pos) FILTER (NOT fence), '') FROM blocks WHERE block % 2 = 0 GROUP BY 1, 2)
    SELECT page_id, string_agg(part, '' ORDER BY block) AS html FROM parts GROUP BY 1""")  # fmt: skip
def s27_rendered(spark, sf):
    """Pages whose source is their content, in a block of code or as it is, some with a block that is never closed."""
    k = F.col("page_id").cast("int")
    block = F.concat(F.lit('  ```html"\n'), "html", F.lit("\n```\n### a & b\n"))
    content = F.concat(F.lit("# "), "title", F.lit("\n"), F.when(k % 2 == 0, block).otherwise(F.col("html")), F.when(k % 5 == 0, "\n``` \n# open").otherwise(""))
    return E.wiki_pages(spark, sf).select("page_id", G.rendered(content).alias("html"))


@query("scenes", "SELECT scene_id, heat FROM scenes ORDER BY heat DESC, updated_at DESC")
def s28_export_scenes(spark, sf):
    folder = _folder(spark, "scenes")
    E.scenes(spark, sf).orderBy(F.desc("heat"), F.desc("updated_at")).select("scene_id", "heat").write.json(folder)
    return spark.read.schema("scene_id string, heat long").json(folder)


@query("wiki_pages", "SELECT count(*) AS pages, count(DISTINCT source_type) AS kinds FROM (SELECT 'url' AS source_type FROM wiki_pages)")
def s29_page_sink(spark, sf):
    got = S.ingest(E.wiki_pages(spark, sf).select(F.col("url").alias("source"), F.col("html").alias("body")))
    return S.to_page(got).agg(F.count("*").alias("pages"), F.count_distinct("source_type").alias("kinds"))


@query("memories", "SELECT memory_id FROM memories")
def s30_move_missing(spark, sf):
    m = E.memories(spark, sf).select("memory_id")
    once = S.move_missing(m, m.where("int(memory_id) % 2 = 0"), "memory_id")
    return S.move_missing(m, once, "memory_id")


@query("memories", "SELECT memory_id, length(content) >= 500 AND NOT contains(content, '%%%') AS ok FROM memories")
def x01_custom_rule(spark, sf):
    """A rule that a user registers by name and calls in SQL."""
    spark.udf.register("no_marks", lambda s: "%%%" not in (s or ""), "boolean")
    E.memories(spark, sf).createOrReplaceTempView("lodestone_memories")
    return spark.sql("SELECT memory_id, length(content) >= 500 AND no_marks(content) AS ok FROM lodestone_memories")


@query("memories", "SELECT memory_id, CASE WHEN CAST(memory_id AS INT) % 2 = 0 THEN length(content) ELSE 2 * length(content) END AS first, CAST(memory_id AS INT) % 2 = 0 AS was_cached FROM memories")
def x02_embedding_cache_hook(spark, sf):
    """A producer fills what the cache lacks; here vectors of a text's length, twice that if newly produced."""
    m = E.memories(spark, sf).select("memory_id", "content")
    cache = m.where("int(memory_id) % 2 = 0").select(F.sha2(F.concat_ws("|", "memory_id", "content"), 256).alias("content_key"), F.lit("m").alias("model"), F.array(F.length("content").cast("float")).alias("embedding"), F.lit(1).alias("dims"))
    texts = m.withColumn("size", F.length("content")).withColumn("content", F.concat_ws("|", "memory_id", "content"))
    filled, _ = S.filled_vectors(texts, cache, "m", 1, lambda s: s.map(lambda t: [2.0 * (len(t) - t.index("|") - 1)]))
    return filled.select("memory_id", F.col("embedding")[0].cast("long").alias("first"), "was_cached")
