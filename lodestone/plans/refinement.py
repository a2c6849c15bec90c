"""Queries of section L."""

import json

import pandas as pd
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import aggregation, evolution, ranking, selection, summaries
from lodestone.operators import refinement as L
from lodestone.operators import state as D
from lodestone.plans.registry import query
from lodestone.session import working_path
from lodestone.sources import entities as E
from lodestone.sources.entities import AS_OF
from lodestone.sources.table_set import TableSet

DYNAMIC = [d[0] for d in E.DIMENSIONS if d[2] == "dynamic"]


def echo(prompts: pd.Series) -> pd.Series:
    """A stand-in for a model: one item with the prompt's length and first words."""
    first = prompts.str.len().astype(str) + ":" + prompts.str.replace('"', "", regex=False).str.replace("\n", " ", regex=False).str.slice(0, 30)
    return '```json\n[{"content": "' + first + '", "memory_type": "fact", "priority": 150, "dimensions": ["focus"], "source_message_ids": [1, 2]}, {"content": " "}]\n```'


def _items(spark, sf):
    said = F.sort_array(F.collect_list(F.struct("seq", "content")))["content"]  # a conversation
    prompts = E.messages(spark, sf).groupBy("file_id").agg(F.array_join(said, "\n").alias("prompt"))
    return L.extracted(L.answers(prompts, echo), DYNAMIC)


FIRST = "trim(concat(length(prompt), ':', substr(replace(replace(prompt, '\"', ''), chr(10), ' '), 1, 30)))"
PROMPTS = "(SELECT file_id, string_agg(content, chr(10) ORDER BY seq) AS prompt FROM messages GROUP BY 1)"


@query("messages", f"SELECT file_id, {FIRST} AS content, 'episodic' AS memory_type, 100 AS priority, 'dynamic' AS time_velocity FROM {PROMPTS}")
def l01_extract(spark, sf):
    return _items(spark, sf).select("file_id", "content", "memory_type", "priority", "time_velocity")


@query("messages", "SELECT file_id, concat(file_id, ':1') AS source_ref, CAST(least(max(seq), 2) AS INT) AS occurred_at FROM messages GROUP BY 1")
def l02_occurred(spark, sf):
    return L.occurred(_items(spark, sf), E.messages(spark, sf).withColumn("timestamp", F.col("seq"))).select("file_id", "source_ref", "occurred_at")


@query("messages raw_files", "SELECT file_id, count(*) AS n FROM messages JOIN raw_files USING (file_id) WHERE seq > last_refined_seq AND status <> 'archived' GROUP BY 1")
def l03_batch(spark, sf):
    files = E.raw_files(spark, sf).where("status <> 'archived'").withColumn("changed", F.lit(False))
    return L.to_refine(E.messages(spark, sf), files).groupBy("file_id").agg(F.count("*").alias("n"))


@query("messages memories", f"SELECT count(DISTINCT {FIRST}) AS stored FROM {PROMPTS} WHERE {FIRST} NOT IN (SELECT content FROM memories)")
def l04_persist(spark, sf):
    items = _items(spark, sf).select(F.concat_ws("#", F.lit("n"), "file_id").alias("memory_id"), "content", "priority")
    once = ranking.first_of_content(items, F.col("memory_id"))
    stored = D.rule_decisions(once, E.memories(spark, sf), 10_000).where("action = 'store'")
    return stored.agg(F.count("*").alias("stored"))


@query("memories", "SELECT memory_id, CAST(floor((row_number() OVER (PARTITION BY memory_type ORDER BY memory_id) - 1) / 7) AS INT) AS batch FROM memories")
def l06_scene_batches(spark, sf):
    return L.scene_batches(E.memories(spark, sf), "memory_type", 7).select("memory_id", "batch")


@query("raw_files", "SELECT file_id, CASE WHEN status = 'error' THEN 'pinned' WHEN CAST(concat('0x', substr(sha256(file_id), 1, 16)) AS UBIGINT) % 100 < 20 THEN 'a' ELSE 'b' END AS version FROM raw_files")
def l09_prompt_version(spark, sf):
    pinned = F.when(F.col("status") == "error", "pinned")
    return E.raw_files(spark, sf).select("file_id", L.chosen_version(pinned, T.bucket("file_id"), 0.2, F.lit("v1")).alias("version"))


@query("memories", "SELECT memory_id FROM (SELECT * FROM memories ORDER BY updated_at DESC, memory_id LIMIT 100) WHERE priority >= 70")
def l10_summary_basis(spark, sf):
    return L.summary_basis(E.memories(spark, sf), 70, 100).select("memory_id")


def _profile_model(prompts: pd.Series) -> pd.Series:
    """A stand-in for a model: the prompt's length and first letters, and no answer where every third letter count ends."""
    n = prompts.str.len()
    return (n.astype(str) + ":" + prompts.str.slice(0, 60)).where(n % 3 != 0, None)


@query("memories memory_tags", """
    WITH moments(asked, most) AS (VALUES (TIMESTAMP '2024-03-12 00:00:00', 20), (TIMESTAMP '2024-03-14 00:00:00', 20), (TIMESTAMP '2024-03-15 00:00:00', 10)),
    ranked AS (SELECT asked, most, agent_tag AS owner, priority, content, row_number() OVER (PARTITION BY asked, agent_tag ORDER BY updated_at DESC, memory_id) AS n FROM memories, moments
      WHERE status <> 'rejected' AND (ttl_days IS NULL OR updated_at > asked - INTERVAL 1 DAY * ttl_days) AND memory_id IN (SELECT memory_id FROM memory_tags WHERE dimension_id IN ('identity', 'family', 'social', 'values'))),
    chosen AS (SELECT asked, owner, content, n FROM ranked WHERE n <= most AND priority >= 70),
    lines AS (SELECT asked, owner, string_agg(concat('- ', coalesce(content, '')), chr(10) ORDER BY n) AS lines FROM chosen GROUP BY 1, 2),
    prompts AS (SELECT asked, owner, concat('Who is this?', chr(10), coalesce(lines, '（暂无静态维度高优先级记忆）')) AS prompt FROM (SELECT DISTINCT agent_tag AS owner FROM memories) CROSS JOIN moments LEFT JOIN lines USING (asked, owner) WHERE most = 20),
    stored AS (SELECT owner, max(asked) AS asked, arg_max(concat(length(prompt), ':', substr(prompt, 1, 60)), asked) AS summary FROM prompts WHERE length(prompt) % 3 <> 0 GROUP BY 1),
    held AS (SELECT * FROM stored WHERE asked >= TIMESTAMP '2024-03-13 00:00:00')
    SELECT owner, 'summary' AS kind, 0 AS nth, summary AS text FROM held
    UNION ALL SELECT owner, 'static', CAST(row_number() OVER (PARTITION BY owner ORDER BY n) AS INT), content FROM chosen WHERE asked = TIMESTAMP '2024-03-15 00:00:00' AND owner NOT IN (SELECT owner FROM held)""")  # fmt: skip
def l10_profiles(spark, sf):
    memories, tags = E.memories(spark, sf).withColumnRenamed("agent_tag", "owner"), E.memory_tags(spark, sf)
    store = TableSet(spark, working_path(spark, "profiles"))
    for day in ("2024-03-12", "2024-03-14"):
        summaries.refresh(store, day, memories, tags, "Who is this?\n{{memories}}", _profile_model, f"{day} 00:00:00")
    return summaries.served(store.read("summaries", summaries.SUMMARIES), memories, tags, AS_OF)


@query("messages raw_files", "SELECT file_id, count(*) AS rounds FROM messages WHERE role = 'user' AND file_id NOT IN (SELECT file_id FROM raw_files WHERE status = 'archived') GROUP BY 1 HAVING count(*) >= 3")
def l11_sessions_to_evolve(spark, sf):
    done = E.raw_files(spark, sf).where("status = 'archived'").select("file_id")
    return L.rounds(E.messages(spark, sf), 3).join(done, "file_id", "left_anti")


@query("wiki_pages", "SELECT count(*) AS pages FROM wiki_pages WHERE trim(title) <> ''")
def l12_ingest_extract_validate(spark, sf):
    from lodestone.sources import stores

    got = stores.ingest(E.wiki_pages(spark, sf).select(F.col("url").alias("source"), F.col("html").alias("body")))
    failed = selection.quality_rules(F.col("content"), 10, 1_000_000)
    return got.where((F.size(failed) == 0) & (F.trim("title") != "")).agg(F.count("*").alias("pages"))


@query("messages", f"SELECT CAST(count(*) AS BIGINT) AS items, CAST(sum(CASE WHEN CAST(file_id AS INT) % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS hard FROM {PROMPTS}")
def l13_mock_model(spark, sf):
    items = _items(spark, sf)
    return items.agg(F.count("*").alias("items"), F.sum(F.when(F.col("file_id").cast("int") % 3 == 0, 1).otherwise(0)).alias("hard"))


@query("memories", f"SELECT CAST(TIMESTAMP '{AS_OF}' AS VARCHAR) AS at, count(*) AS memories FROM memories WHERE status = 'active'")
def l05_finalise(spark, sf):
    return E.memories(spark, sf).where("status = 'active'").agg(F.count("*").alias("memories")).select(F.lit(AS_OF).alias("at"), "memories")


def curator(prompts: pd.Series) -> pd.Series:
    """A stand-in for a model that keeps one scene a title, which the first memory's length gives; without it, it merges what there is, or creates."""

    def decide(prompt: str) -> str:
        known = json.JSONDecoder().raw_decode(prompt)[0]
        first, scenes = known["memories"][0], known["scenes"]
        size = len(first["content"])
        if size % 17 == 0:
            return "I can't."
        title = f"t{size % 3}"
        hit = [s for s in scenes if s["title"] == title]
        if hit:
            action = {"action": "update", "target_scene_id": hit[0]["scene_id"], "merged_content": hit[0]["content"] + " " + first["memory_id"]}
        else:
            action = {"action": "create", "merged_content": f"# {title}\n{first['memory_id']}"}
            if len(scenes) > 1:
                action |= {"action": "merge", "merged_from": [s["scene_id"] for s in scenes], "memory_ids": [first["memory_id"]]}
        return "Here it is:\n```json\n" + json.dumps([action]) + "\n```"

    return pd.Series([decide(p) for p in prompts])


def spread(contents: pd.Series) -> pd.Series:
    """A stand-in for an embedding."""
    return pd.Series([[float(len(c)), float(c.count("t")), 1.0] for c in contents])


def _aggregated(spark, sf):
    """Twelve memories a file, two a batch, and a scene that each file begins with."""
    memories = E.memories(spark, sf).selectExpr("concat('f', int(memory_id) div 12) AS file_id", "memory_id", "content")
    scenes = memories.select("file_id").distinct().selectExpr("file_id", "concat('s', file_id) AS scene_id", "concat('t', length(file_id) % 3) AS title", "'old' AS content", "5L AS heat", "'active' AS status", "timestamp_ntz'2024-01-01 00:00:00' AS updated_at")
    return memories, aggregation.aggregate(memories, scenes, curator, AS_OF, 2, spread)


AGGREGATED = """
    WITH RECURSIVE placed AS (SELECT concat('f', CAST(memory_id AS INT) // 12) AS file_id, memory_id, content, row_number() OVER (PARTITION BY CAST(memory_id AS INT) // 12 ORDER BY memory_id) - 1 AS place FROM memories),
    batches AS (SELECT file_id, place // 2 AS batch, min(memory_id) AS head, arg_min(length(coalesce(content, '')), memory_id) AS size, count(*) AS n FROM placed GROUP BY 1, 2),
    steps AS (
      SELECT DISTINCT file_id, CAST(-1 AS BIGINT) AS batch, [{'title': concat('t', length(file_id) % 3), 'content': 'old', 'heat': CAST(5 AS BIGINT), 'status': 'active', 'memories': CAST(0 AS BIGINT)}] AS scenes, '' AS outcome FROM batches
      UNION ALL
      SELECT s.file_id, b.batch,
        CASE WHEN size % 17 = 0 THEN scenes
          WHEN len(list_filter(scenes, lambda x: x.status = 'active' AND x.title = concat('t', size % 3))) > 0
            THEN list_transform(scenes, lambda x: CASE WHEN x.status = 'active' AND x.title = concat('t', size % 3) THEN {'title': x.title, 'content': concat(x.content, ' ', head), 'heat': x.heat + 1, 'status': x.status, 'memories': x.memories + n} ELSE x END)
          WHEN len(list_filter(scenes, lambda x: x.status = 'active')) > 1
            THEN list_append(list_transform(scenes, lambda x: {'title': x.title, 'content': x.content, 'heat': x.heat, 'status': 'archived', 'memories': x.memories}),
              {'title': concat('t', size % 3), 'content': concat('# t', size % 3, chr(10), head), 'heat': CAST(1 + list_sum(list_transform(list_filter(scenes, lambda x: x.status = 'active'), lambda x: x.heat)) AS BIGINT), 'status': 'active', 'memories': CAST(1 AS BIGINT)})
          ELSE list_append(scenes, {'title': concat('t', size % 3), 'content': concat('# t', size % 3, chr(10), head), 'heat': CAST(1 AS BIGINT), 'status': 'active', 'memories': n}) END,
        CASE WHEN size % 17 = 0 THEN 'failed' WHEN len(list_filter(scenes, lambda x: x.status = 'active' AND x.title = concat('t', size % 3))) > 0 THEN 'updated' WHEN len(list_filter(scenes, lambda x: x.status = 'active')) > 1 THEN 'merged' ELSE 'created' END
      FROM steps s JOIN batches b ON b.file_id = s.file_id AND b.batch = s.batch + 1)
"""


@query("memories", AGGREGATED.strip() + """
    SELECT file_id, x.title AS title, x.content AS content, x.heat AS heat, x.status AS status, x.memories AS memories
    FROM (SELECT file_id, unnest(scenes) AS x FROM (SELECT * FROM steps QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY batch DESC) = 1))""")  # fmt: skip
def l06_aggregated(spark, sf):
    done = _aggregated(spark, sf)[1]
    held = done.links.groupBy("file_id", "scene_id").agg(F.count("*").alias("memories"))
    return done.scenes.join(held, ["file_id", "scene_id"], "left").select("file_id", "title", "content", "heat", "status", F.coalesce("memories", F.lit(0)).alias("memories"))


@query("memories", AGGREGATED.strip() + """
    SELECT file_id, 'l2' AS source, CAST(count(*) FILTER (outcome = 'created') AS BIGINT) AS created, CAST(count(*) FILTER (outcome = 'updated') AS BIGINT) AS updated, CAST(count(*) FILTER (outcome = 'merged') AS BIGINT) AS merged, CAST(count(*) FILTER (outcome = 'failed') AS BIGINT) AS failed, CAST(NULL AS BIGINT) AS memories,
      (SELECT CASE WHEN count(*) >= 200 THEN 'red' WHEN count(*) >= 180 THEN 'orange' WHEN count(*) >= 150 THEN 'yellow' ELSE 'ok' END FROM (SELECT unnest(scenes) AS x FROM (SELECT * FROM steps QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY batch DESC) = 1)) WHERE x.status = 'active') AS level
    FROM steps WHERE batch >= 0 GROUP BY file_id
    UNION ALL SELECT file_id, 'refine', NULL, NULL, NULL, NULL, count(*), 'ok' FROM placed GROUP BY file_id""")  # fmt: skip
def l05_finalised(spark, sf):
    memories, done = _aggregated(spark, sf)
    events, alarm = aggregation.finalised(done, memories, AS_OF)
    size = lambda name: F.json_array_length(F.get_json_object("payload", f"$.{name}")).cast("long").alias(name)
    number = lambda name: F.get_json_object("payload", f"$.{name}").cast("long")
    level = F.when(F.col("source") == "l2", F.col("level")).otherwise("ok")
    return events.crossJoin(F.broadcast(alarm)).select("file_id", "source", size("created"), size("updated"), size("merged"), number("failed").alias("failed"), number("memories_count").alias("memories"), level.alias("level"))  # one row of alarm


def teacher(prompts: pd.Series) -> pd.Series:
    """A stand-in for a model: the length of a session says what it teaches, if anything."""

    def lessons(prompt: str) -> str | None:
        n = len(prompt)
        if n % 13 == 0:
            return None
        if n % 11 == 0:
            return "Nothing to learn."
        good = {"type": "append", "category": "guide", "title": f"topic {n % 7}", "entry": f" lesson {n % 50} "}
        return json.dumps([good | {"title": " "}] if n % 5 == 0 else [good, good | {"type": "drop"}])

    return pd.Series([lessons(p) for p in prompts], dtype="object")


def _evolved(spark, sf):
    """A turn over all sessions, asked for twice, on pages whose titles are four of seven topics."""
    store = TableSet(spark, working_path(spark, "evolution"))
    pages = E.wiki_pages(spark, sf).selectExpr("page_id", "concat('topic ', int(page_id) % 4) AS title", "'guide' AS category", "concat('page ', page_id, ' \n') AS content", "tags", "'' AS description", "'a' AS author", "status", "updated_at")
    store.commit("start", pages=pages)
    texts = E.messages(spark, sf).groupBy("file_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("seq", "content")))["content"], "\n").alias("content"), F.count("*").alias("blocks"))  # a conversation
    files = E.raw_files(spark, sf).select("session_key", "file_id", "started_at")
    for _ in range(2):
        evolution.evolve_once(store, "turn", files, texts, teacher, AS_OF, limit=None, least=3)
    return store


EVOLVED = """
    WITH latest AS (SELECT session_key, file_id, started_at FROM raw_files QUALIFY row_number() OVER (PARTITION BY session_key ORDER BY started_at DESC, file_id DESC) = 1),
    sizes AS (SELECT file_id, least(length(string_agg(content, chr(10) ORDER BY seq)), 6000) AS size, count(*) AS blocks FROM messages GROUP BY 1),
    pages0 AS (SELECT page_id, concat('topic ', CAST(page_id AS INT) % 4) AS title, concat('page ', page_id, ' ', chr(10)) AS content, status, updated_at FROM wiki_pages),
    homes AS (SELECT title, arg_max(page_id, (updated_at, page_id)) AS page_id FROM pages0 WHERE status = 'active' GROUP BY 1),
    outcomes AS (SELECT *, concat('topic ', size % 7) AS title, concat('lesson ', size % 50) AS body,
      CASE WHEN blocks < 3 THEN 'skipped' WHEN size % 13 = 0 THEN 'error' WHEN size % 11 = 0 THEN 'noop' WHEN size % 5 = 0 THEN 'rejected' ELSE 'good' END AS kind FROM latest JOIN sizes USING (file_id)),
    good AS (SELECT o.*, row_number() OVER (PARTITION BY title ORDER BY started_at DESC, file_id) AS nth, h.page_id AS known FROM outcomes o LEFT JOIN homes h USING (title) WHERE kind = 'good'),
    placed AS (SELECT *, coalesce(known, concat('page-', substr(sha256(concat(title, chr(10), 'guide', chr(10), first_value(body) OVER (PARTITION BY title ORDER BY nth))), 1, 16))) AS home, CASE WHEN known IS NULL AND nth = 1 THEN 'created' ELSE 'appended' END AS action FROM good)
"""


@query("messages raw_files wiki_pages", EVOLVED.strip() + """
    SELECT o.session_key, CASE o.kind WHEN 'good' THEN 'done' WHEN 'noop' THEN 'done' ELSE o.kind END AS status, CASE o.kind WHEN 'good' THEN p.action WHEN 'skipped' THEN 'skipped' WHEN 'noop' THEN 'noop' END AS action, p.home AS page_id,
      CASE o.kind WHEN 'error' THEN 'no answer' WHEN 'rejected' THEN 'required' END AS error FROM outcomes o LEFT JOIN placed p USING (session_key)""")  # fmt: skip
def l11_evolution_runs(spark, sf):
    return _evolved(spark, sf).read("runs", evolution.RUNS)


@query("messages raw_files wiki_pages", EVOLVED.strip() + """
    , blocks AS (SELECT home, string_agg(block, '' ORDER BY nth) AS more FROM (SELECT home, body, min(nth) AS nth, arg_min(concat(chr(10), chr(10), '> 来源: evolve:', session_key, ' | hash: ', substr(sha256(body), 1, 8), chr(10), body), nth) AS block FROM placed WHERE action = 'appended' GROUP BY 1, 2) GROUP BY 1)
    SELECT page_id, title, CASE WHEN more IS NULL THEN content ELSE concat(rtrim(content, ' ' || chr(10)), more) END AS content FROM (SELECT page_id, title, content FROM pages0 UNION ALL SELECT home, title, body FROM placed WHERE action = 'created') LEFT JOIN blocks ON home = page_id""")  # fmt: skip
def l11_evolution_pages(spark, sf):
    return _evolved(spark, sf).read("pages", evolution.PAGES).select("page_id", "title", "content")
