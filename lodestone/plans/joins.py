"""Queries of section J."""

from pyspark.sql import functions as F

from lodestone.operators import relations as J
from lodestone.operators import vectors as V
from lodestone.plans.registry import query
from lodestone.sources import entities as E


@query("memories memory_tags", "SELECT memory_id, priority FROM memories WHERE memory_id IN (SELECT memory_id FROM memory_tags WHERE dimension_id IN ('focus', 'status'))")
def j01_match_any(spark, sf):
    return J.tagged(E.memories(spark, sf), E.memory_tags(spark, sf), ["focus", "status"]).select("memory_id", "priority")


@query("memories memory_tags", "SELECT m.memory_id FROM memories m JOIN memory_tags t USING (memory_id) WHERE dimension_id IN ('identity', 'values') GROUP BY 1 HAVING count(DISTINCT dimension_id) = 2")
def j02_relational_division(spark, sf):
    return J.tagged(E.memories(spark, sf), E.memory_tags(spark, sf), ["identity", "values"], "all").select("memory_id")


@query("memories memory_tags", "SELECT memory_id FROM memories m WHERE status = 'active' AND EXISTS (SELECT 1 FROM memory_tags t WHERE t.memory_id = m.memory_id AND dimension_id = 'social') AND EXISTS (SELECT 1 FROM memory_tags t WHERE t.memory_id = m.memory_id AND dimension_id = 'ideas')")
def j03_exists_each(spark, sf):
    tags, out = E.memory_tags(spark, sf), E.memories(spark, sf).where("status = 'active'")
    for d in ("social", "ideas"):
        out = out.join(tags.where(F.col("dimension_id") == d), "memory_id", "left_semi")
    return out.select("memory_id")


@query("memory_sources raw_files", "SELECT memory_id, file_id, msg_id, session_key FROM (SELECT memory_id, split_part(source_ref, ':', 1) AS file_id, split_part(source_ref, ':', 2) AS msg_id FROM memory_sources) LEFT JOIN (SELECT file_id, session_key FROM raw_files) USING (file_id)")
def j04_lineage(spark, sf):
    return J.lineage(E.memory_sources(spark, sf), E.raw_files(spark, sf)).select("memory_id", "file_id", "msg_id", "session_key")


SIM = "greatest(0, least(1, list_cosine_similarity(v.embedding, q.e)))"


@query("memory_vectors memories", f"SELECT v.memory_id, m.status, round({SIM}, 9) AS similarity FROM memory_vectors v JOIN memories m USING (memory_id), (SELECT embedding AS e FROM memory_vectors WHERE memory_id = '3') q WHERE m.status <> 'rejected'")
def j05_vector_scan(spark, sf):
    vectors, query_ = E.memory_vectors(spark, sf), V.vector_of(E.memory_vectors(spark, sf), "3")
    found = V.similarities(vectors.join(E.memories(spark, sf).where("status <> 'rejected'"), "memory_id"), query_)
    return found.select("memory_id", "status", F.round("similarity", 9).alias("similarity"))


@query("memory_vectors scenes", f"SELECT v.memory_id AS scene_id, s.title, round({SIM}, 9) AS similarity FROM memory_vectors v JOIN scenes s ON s.scene_id = v.memory_id, (SELECT embedding AS e FROM memory_vectors WHERE memory_id = '3') q WHERE s.status = 'active'")
def j06_scene_vectors(spark, sf):
    vectors = E.memory_vectors(spark, sf)
    scenes = E.scenes(spark, sf).where("status = 'active'").withColumn("memory_id", F.col("scene_id"))
    return V.similarities(vectors.join(scenes, "memory_id"), V.vector_of(vectors, "3")).select("scene_id", "title", F.round("similarity", 9).alias("similarity"))


@query("memories", r"SELECT memory_id, term, count(*) AS tf FROM (SELECT memory_id, unnest(regexp_split_to_array(lower(content), '[^\p{L}\p{N}]+')) AS term FROM memories WHERE status <> 'rejected') WHERE term IN ('stupid', 'clown') GROUP BY ALL")
def j07_postings_join(spark, sf):
    from lodestone.operators import fulltext

    found = fulltext.postings(E.memories(spark, sf), "memory_id", "content").where(F.col("term").isin("stupid", "clown"))
    return found.join(E.memories(spark, sf).where("status <> 'rejected'").select("memory_id"), "memory_id", "left_semi").select("memory_id", "term", "tf")


@query("memories memory_vectors", "SELECT memory_id FROM memories WHERE memory_id NOT IN (SELECT memory_id FROM memory_vectors) ORDER BY memory_id")
def j08_missing_vectors(spark, sf):
    return J.missing_vectors(E.memories(spark, sf), E.memory_vectors(spark, sf)).select("memory_id").orderBy("memory_id")


@query("dimensions memory_tags", "SELECT id, count(memory_id) AS n FROM dimensions LEFT JOIN memory_tags ON dimension_id = id GROUP BY id")
def j09_counts_with_zero(spark, sf):
    return J.counts_with_zero(E.dimensions(spark), E.memory_tags(spark, sf))


@query("scene_memories memories", "SELECT scene_id, memory_id FROM (SELECT scene_id, memory_id, row_number() OVER (PARTITION BY scene_id ORDER BY updated_at DESC, memory_id) AS n FROM scene_memories JOIN memories USING (memory_id)) WHERE n <= 5")
def j10_related_memories(spark, sf):
    joined = E.scene_memories(spark, sf).join(E.memories(spark, sf).select("memory_id", "updated_at"), "memory_id")
    return J.top_per_group(joined, "scene_id", [F.desc("updated_at"), F.asc("memory_id")], 5).select("scene_id", "memory_id")


@query("scenes scene_memories", "SELECT scene_id, heat, (SELECT count(*) FROM scene_memories m WHERE m.scene_id = s.scene_id) AS memories_count FROM scenes s")
def j11_count_per_scene(spark, sf):
    return J.with_count(E.scenes(spark, sf), E.scene_memories(spark, sf), "scene_id", "memories_count").select("scene_id", "heat", "memories_count")


@query("memories memory_tags", "SELECT memory_id FROM memories WHERE (contains(lower(content), 'idiot') OR contains(lower(content), 'scum')) AND memory_id IN (SELECT memory_id FROM memory_tags WHERE dimension_id IN ('focus', 'skills')) AND status <> 'rejected'")
def j12_like_with_tags(spark, sf):
    from lodestone.operators import selection as P

    hit = E.memories(spark, sf).where(P.any_term("content", "idiot scum") & P.visible())
    return J.tagged(hit, E.memory_tags(spark, sf), ["focus", "skills"]).select("memory_id")


@query("memories memory_tags", "SELECT memory_id, (SELECT string_agg(dimension_id, ',' ORDER BY dimension_id) FROM memory_tags t WHERE t.memory_id = m.memory_id) AS dimensions FROM memories m")
def j13_tags_by_memory(spark, sf):
    return J.with_tags(E.memories(spark, sf), E.memory_tags(spark, sf)).select("memory_id", F.array_join("dimensions", ",").alias("dimensions"))


@query("memory_sources", "SELECT source_ref AS memory_id, min_by(memory_id, seq) AS source_ref FROM memory_sources GROUP BY ALL")
def j14_first_source(spark, sf):
    flipped = E.memory_sources(spark, sf).select(F.col("source_ref").alias("memory_id"), F.col("memory_id").alias("source_ref"), "seq")
    return J.first_source(flipped)


@query("memory_vectors memory_tags", "SELECT memory_id FROM memory_vectors v WHERE (SELECT count(DISTINCT dimension_id) FROM memory_tags t WHERE t.memory_id = v.memory_id AND dimension_id IN ('family', 'environment')) = 2")
def j15_set_containment(spark, sf):
    found = J.with_tags(E.memory_vectors(spark, sf), E.memory_tags(spark, sf))
    return found.where(J.tag_condition(["family", "environment"], "all")).select("memory_id")


@query("memory_sources raw_files", "SELECT count(*) AS dangling, min(source_ref) AS first_ref FROM memory_sources WHERE split_part(source_ref, ':', 1) NOT IN (SELECT file_id FROM raw_files)")
def j16_integrity(spark, sf):
    return J.dangling(E.memory_sources(spark, sf), E.raw_files(spark, sf)).agg(F.count("*").alias("dangling"), F.min("source_ref").alias("first_ref"))


@query("memories memory_tags", """
    WITH fresh AS (SELECT memory_id, split_part(content, ' ', 1) AS subject FROM memories WHERE updated_at >= TIMESTAMP '2024-03-28 00:00:00')
    SELECT o.memory_id AS old_id, min(f.memory_id) AS new_id FROM fresh f JOIN memory_tags a ON a.memory_id = f.memory_id JOIN memory_tags b ON b.dimension_id = a.dimension_id
    JOIN memories o ON o.memory_id = b.memory_id WHERE o.memory_id NOT IN (SELECT memory_id FROM fresh) AND contains(lower(o.content), lower(subject)) GROUP BY 1""")  # fmt: skip
def j17_supersession(spark, sf):
    memories = E.memories(spark, sf)
    fresh = memories.where("updated_at >= timestamp_ntz'2024-03-28 00:00:00'").select("memory_id", F.split_part("content", F.lit(" "), F.lit(1)).alias("subject"))
    return J.superseded(fresh, memories, E.memory_tags(spark, sf))


@query("memories memory_tags", """
    SELECT new_id, old_id FROM (SELECT new_id, old_id, row_number() OVER (PARTITION BY new_id ORDER BY priority DESC, old_id) AS n FROM (
      SELECT DISTINCT a.memory_id AS new_id, b.memory_id AS old_id, m.priority FROM memory_tags a JOIN memory_tags b USING (dimension_id) JOIN memories m ON m.memory_id = b.memory_id WHERE a.memory_id <> b.memory_id)) WHERE n <= 10""")  # fmt: skip
def j18_candidates(spark, sf):
    memories = E.memories(spark, sf)
    return J.candidates(memories, memories, E.memory_tags(spark, sf), 10).select("new_id", "old_id")


PAGE_TEXT = "regexp_replace(html, '<[^>]*>', ' ', 'g')"


@query("wiki_pages", f"""
    WITH t AS (SELECT title, min(page_id) AS target_id FROM wiki_pages WHERE length(title) >= 4 GROUP BY title)
    SELECT page_id AS source_id, target_id FROM wiki_pages JOIN t ON contains(lower({PAGE_TEXT}), lower(t.title)) WHERE page_id <> target_id""")  # fmt: skip
def j19_titles_mentioned(spark, sf):
    pages = E.wiki_pages(spark, sf).select("page_id", "title", F.regexp_replace("html", "<[^>]*>", " ").alias("content"))
    return J.titles_mentioned(pages)


@query("wiki_pages", """
    WITH e AS (SELECT DISTINCT page_id, unnest(tags) AS tag FROM wiki_pages), r AS (SELECT tag FROM e GROUP BY tag HAVING count(*) <= 25)
    SELECT DISTINCT a.page_id AS a, b.page_id AS b FROM e a JOIN e b USING (tag) JOIN r USING (tag) WHERE a.page_id < b.page_id""")
def j20_shared_tags(spark, sf):
    return J.pages_sharing_tags(E.wiki_pages(spark, sf), 25)


@query("memory_vectors", "SELECT a.memory_id AS a, b.memory_id AS b FROM memory_vectors a JOIN memory_vectors b ON a.memory_id < b.memory_id WHERE list_cosine_similarity(a.embedding, b.embedding) >= 0.3")
def j21_similar_pairs(spark, sf):
    return V.similar_pairs(E.memory_vectors(spark, sf), 0.3).select("a", "b")


@query("wiki_links wiki_pages", "SELECT source_id, target_id, rel_type FROM wiki_links WHERE source_id IN (SELECT page_id FROM wiki_pages WHERE status = 'active') AND target_id IN (SELECT page_id FROM wiki_pages WHERE status = 'active')")
def j22_links_between_nodes(spark, sf):
    nodes = E.wiki_pages(spark, sf).where("status = 'active'").select(F.col("page_id").alias("id"))
    return J.links_between(E.wiki_links(spark, sf), nodes).select("source_id", "target_id", "rel_type")


@query("memories", """
    WITH RECURSIVE archive AS (SELECT memory_id, CAST(CAST(memory_id AS BIGINT) // 2 AS VARCHAR) AS superseded_by FROM memories WHERE memory_id <> '0'),
    chain AS (SELECT memory_id, superseded_by FROM archive WHERE superseded_by = '3' UNION ALL SELECT a.memory_id, a.superseded_by FROM archive a JOIN chain c ON a.superseded_by = c.memory_id)
    SELECT memory_id, superseded_by FROM chain""")  # fmt: skip
def j23_archive_chain(spark, sf):
    archive = E.memories(spark, sf).where("memory_id <> '0'").selectExpr("memory_id", "cast(cast(memory_id as bigint) div 2 as string) AS superseded_by", "updated_at AS archived_at")
    return J.archive_chain(archive, "3").select("memory_id", "superseded_by")


@query("signal_events", """
    SELECT s.subscriber_id, e.event_id FROM signal_events e JOIN (VALUES ('a', TIMESTAMP '2024-01-30 00:00:00', 100), ('b', TIMESTAMP '2024-01-29 12:00:00', 0)) AS s(subscriber_id, last_ts, last_id)
    ON e.ts > s.last_ts OR (e.ts = s.last_ts AND e.event_id > s.last_id)""")
def j24_after_cursor(spark, sf):
    cursors = spark.createDataFrame([("a", "2024-01-30 00:00:00", 100), ("b", "2024-01-29 12:00:00", 0)], "subscriber_id string, last_ts string, last_id long")
    return J.after(E.signal_events(spark, sf), cursors.withColumn("last_ts", F.col("last_ts").cast("timestamp_ntz"))).select("subscriber_id", "event_id")


@query("refine_runs memories", """
    WITH m AS (SELECT split_part(prompt_version, ':', 2) AS version, count(*) AS memories, round(avg(priority), 2) AS avg_priority FROM memories WHERE starts_with(prompt_version, 'l1:') GROUP BY 1)
    SELECT r.version, r.runs, m.memories, m.avg_priority FROM (SELECT version, count(*) AS runs FROM refine_runs WHERE stage = 'l1' GROUP BY 1) r LEFT JOIN m USING (version)""")
def j27_runs_with_memory_stats(spark, sf):
    from lodestone.operators import statistics as A

    runs = E.refine_runs(spark, sf).where("stage = 'l1'").groupBy("version").agg(F.count("*").alias("runs"))
    return runs.join(A.memories_by_version(E.memories(spark, sf), "l1"), "version", "left").select("version", "runs", "memories", "avg_priority")


@query("raw_files", "SELECT file_id, session_key FROM raw_files WHERE session_key IN (SELECT session_key FROM raw_files GROUP BY 1 HAVING count(DISTINCT CAST(file_id AS BIGINT) % 2) > 1)")
def j28_both_key_forms(spark, sf):
    files = E.raw_files(spark, sf).withColumn("form", F.col("file_id").cast("long") % 2)
    return J.both_forms(files).select("file_id", "session_key")


@query("raw_files", "SELECT a.agent_id, CAST(s.at AS VARCHAR) AS last_seen FROM (SELECT concat('agent', i) AS agent_id FROM range(0, 8) t(i)) a LEFT JOIN (SELECT agent_id, max(coalesce(ended_at, started_at)) AS at FROM raw_files GROUP BY 1) s USING (agent_id)")
def j29_agents_last_seen(spark, sf):
    from lodestone.operators import statistics as A

    agents = spark.range(8).select(F.concat(F.lit("agent"), F.col("id").cast("string")).alias("agent_id"))
    return agents.join(A.last_seen(E.raw_files(spark, sf)), "agent_id", "left").select("agent_id", F.col("last_seen").cast("string").alias("last_seen"))
