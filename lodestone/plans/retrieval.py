"""Queries of section V and the search entry points."""

from pyspark.sql import functions as F

from lodestone.operators import evaluation, fulltext, relations
from lodestone.operators import paging as O
from lodestone.operators import retrieval as R
from lodestone.operators import selection as P
from lodestone.operators import vectors as V
from lodestone.plans.registry import query
from lodestone.session import materialize
from lodestone.sources import entities as E

TERMS = ("stupid", "clown")
TOKENS = r"list_filter(regexp_split_to_array(strip_accents(lower(content)), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
SHOWN = "SELECT * FROM memories WHERE status <> 'rejected'"


def bm25_sql(rows: str, key: str = "memory_id", tokens: str = TOKENS, terms=TERMS) -> str:
    """(key, score) as a subquery."""
    listed = ", ".join(f"'{t}'" for t in terms)
    return f"""(WITH c AS (SELECT {key} AS k, {tokens} AS tokens FROM ({rows})), n AS (SELECT count(*) AS n_docs, avg(len(tokens)) AS avg_size FROM c),
        p AS (SELECT k, len(tokens) AS size, t, len(list_filter(tokens, lambda x: x = t)) AS tf FROM c, (SELECT unnest([{listed}]) AS t)),
        d AS (SELECT t, count(*) FILTER (tf > 0) AS df FROM p GROUP BY t)
        SELECT k AS {key}, -sum(CASE WHEN ln((n_docs - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_docs - df + 0.5) / (df + 0.5)) END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / avg_size))) AS score
        FROM p JOIN d USING (t), n GROUP BY k HAVING max(tf) > 0)"""


SIM = "(SELECT v.memory_id, greatest(0, least(1, list_cosine_similarity(v.embedding, q.e))) AS similarity FROM memory_vectors v, (SELECT embedding AS e FROM memory_vectors WHERE memory_id = '3') q)"


def _similar(spark, sf):
    vectors = E.memory_vectors(spark, sf)
    return R.similarities(vectors, V.vector_of(vectors, "3"))


@query("memories", rf"SELECT term, CAST(count(DISTINCT memory_id) AS BIGINT) AS df, count(*) AS cf FROM (SELECT memory_id, unnest({TOKENS}) AS term FROM memories) GROUP BY 1")
def v01_index(spark, sf):
    index = fulltext.postings(E.memories(spark, sf), "memory_id", "content")
    return index.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query("memories", rf"SELECT term, count(*) AS cf FROM (SELECT unnest({TOKENS}) AS term FROM (SELECT memory_id, CASE WHEN memory_type = 'persona' THEN 'changed text' ELSE content END AS content FROM memories)) GROUP BY 1")
def v02_updated_index(spark, sf):
    memories = E.memories(spark, sf)
    changed = memories.where("memory_type = 'persona'").withColumn("content", F.lit("changed text"))
    return fulltext.updated(fulltext.postings(memories, "memory_id", "content"), changed, "memory_id", "content").groupBy("term").agg(F.sum("tf").alias("cf"))


@query("memories", f"SELECT memory_id, round(score, 9) AS score FROM {bm25_sql(SHOWN)} ORDER BY round(score, 9), memory_id LIMIT 20")
def v03_bm25(spark, sf):
    scores = fulltext.bm25(E.memories(spark, sf).where(P.visible()), "memory_id", "stupid clown", "content").withColumn("score", F.round("score", 9))
    return fulltext.best(scores, "memory_id", 20)


TAGGED = f"SELECT * FROM ({SHOWN}) WHERE memory_id IN (SELECT memory_id FROM memory_tags WHERE dimension_id IN ('focus', 'skills', 'values'))"


@query("memories memory_tags", f"SELECT memory_id, round(score, 9) AS score FROM {bm25_sql(TAGGED)}")
def v04_bm25_with_tags(spark, sf):
    tagged = relations.tagged(E.memories(spark, sf).where(P.visible()), E.memory_tags(spark, sf), ["focus", "skills", "values"])
    return fulltext.bm25(tagged, "memory_id", "stupid clown", "content").withColumn("score", F.round("score", 9))


@query("memory_vectors", f"SELECT memory_id, round(similarity, 9) AS similarity FROM {SIM} ORDER BY round(similarity, 9) DESC, memory_id LIMIT 10")
def v05_cosine_top_k(spark, sf):
    return V.nearest(_similar_rows(spark, sf), V.vector_of(E.memory_vectors(spark, sf), "3"), 10).select("memory_id", F.round("similarity", 9).alias("similarity"))


def _similar_rows(spark, sf):
    return E.memory_vectors(spark, sf)


@query("memory_vectors", f"SELECT count(*) AS n, round(sum(similarity), 6) AS total FROM {SIM} WHERE CAST(memory_id AS INT) % 5 <> 0")
def v06_cosine_checks(spark, sf):
    """Vectors without length and of another size are left out."""
    bad = F.when(F.col("memory_id").cast("int") % 10 == 0, F.transform("embedding", lambda x: x * 0)).when(F.col("memory_id").cast("int") % 5 == 0, F.slice("embedding", 1, 32)).otherwise(F.col("embedding"))
    vectors = E.memory_vectors(spark, sf)
    found = V.similarities(vectors.withColumn("embedding", bad), V.vector_of(vectors, "3"))
    return found.agg(F.count("*").alias("n"), F.round(F.sum("similarity"), 6).alias("total"))


@query("memory_vectors scenes", f"SELECT scene_id, round(similarity, 9) AS similarity FROM {SIM} JOIN scenes ON scene_id = memory_id WHERE status = 'active' ORDER BY round(similarity, 9) DESC, scene_id LIMIT 5")
def v07_scene_top_k(spark, sf):
    scenes = E.scenes(spark, sf).where("status = 'active'").select("scene_id")
    found = _similar(spark, sf).withColumn("similarity", F.round("similarity", 9)).join(scenes, F.col("memory_id") == F.col("scene_id"))
    return found.orderBy(F.desc("similarity"), "scene_id").limit(5).select("scene_id", "similarity")


def routes_sql(k: int, rows: str = SHOWN) -> str:
    return f"""b AS (SELECT memory_id, row_number() OVER (ORDER BY score, memory_id) - 1 AS place FROM (SELECT * FROM {bm25_sql(rows)} ORDER BY score, memory_id LIMIT {k})),
        v AS (SELECT memory_id, row_number() OVER (ORDER BY similarity DESC, memory_id) - 1 AS place FROM (SELECT * FROM {SIM} WHERE memory_id IN (SELECT memory_id FROM ({SHOWN})) ORDER BY similarity DESC, memory_id LIMIT {k}))"""


FUSED = "SELECT memory_id, sum(1.0 / (place + {c} + 1)) AS rrf, min(place) FILTER (r = 'b') AS pb, min(place) FILTER (r = 'v') AS pv FROM (SELECT *, 'b' AS r FROM b UNION ALL SELECT *, 'v' AS r FROM v) GROUP BY 1"


def _routes(spark, sf, k):
    shown = E.memories(spark, sf).where(P.visible())
    near = _similar(spark, sf).join(shown.select("memory_id"), "memory_id", "left_semi")
    return {"bm25": R.text_route(shown, "memory_id", "stupid clown", k, "content"), "vector": R.vector_route(near, "memory_id", k)}


@query("memories memory_vectors", f"WITH {routes_sql(20)} SELECT memory_id, round(rrf, 9) AS rrf, pb IS NOT NULL AS in_text, pv IS NOT NULL AS in_vector FROM ({FUSED.format(c=60)})")
def v08_rrf(spark, sf):
    fused = R.fuse(_routes(spark, sf, 20), "memory_id")
    return fused.select("memory_id", F.round("rrf", 9).alias("rrf"), F.col("_bm25").isNotNull().alias("in_text"), F.col("_vector").isNotNull().alias("in_vector"))


@query("memories", "SELECT memory_id, 0.0 AS score, row_number() OVER (ORDER BY memory_id) - 1 AS place FROM (SELECT memory_id FROM memories WHERE contains(lower(content), 'upid') ORDER BY memory_id LIMIT 20)")
def v09_fallback_route(spark, sf):
    return R.text_route(E.memories(spark, sf), "memory_id", "upid", 30, "content").select("memory_id", "score", F.col("place").cast("long").alias("place"))


@query("memories memory_vectors memory_tags memory_sources", f"""
    WITH {routes_sql(10)}, f AS ({FUSED.format(c=60)}), o AS (SELECT f.*, content, row_number() OVER (PARTITION BY content ORDER BY rrf DESC, coalesce(pb, 1073741824), coalesce(pv, 1073741824), memory_id) AS n FROM f JOIN memories USING (memory_id))
    SELECT memory_id, rank, (SELECT string_agg(dimension_id, ',' ORDER BY dimension_id) FROM memory_tags t WHERE t.memory_id = x.memory_id) AS dimensions, (SELECT min(source_ref) FROM memory_sources s WHERE s.memory_id = x.memory_id) AS sources
    FROM (SELECT memory_id, row_number() OVER (ORDER BY rrf DESC, coalesce(pb, 1073741824), coalesce(pv, 1073741824), memory_id) AS rank FROM o WHERE n = 1) x WHERE rank <= 10""")  # fmt: skip
def v10_memory_search(spark, sf):
    memories, tags = E.memories(spark, sf), E.memory_tags(spark, sf)
    found = R.search(memories, tags, E.memory_sources(spark, sf), E.raw_files(spark, sf), _similar(spark, sf), "stupid clown")
    return found.select("memory_id", "rank", F.array_join("dimensions", ",").alias("dimensions"), F.array_join("sources", ",").alias("sources"))


SCENE_TEXT = "SELECT s.scene_id, s.heat, concat(s.title, ' ', m.content) AS content FROM scenes s JOIN memories m ON m.memory_id = s.scene_id WHERE s.status = 'active'"


@query("scenes memories", "SELECT scene_id, round(score, 9) AS score FROM " + bm25_sql(SCENE_TEXT, "scene_id", terms=("the", "and")) + " ORDER BY round(score, 9), scene_id LIMIT 5")
def v11_scene_search(spark, sf):
    scenes = E.scenes(spark, sf).join(E.memories(spark, sf).select(F.col("memory_id").alias("scene_id"), "content"), "scene_id").where("status = 'active'")
    scores = fulltext.bm25(scenes, "scene_id", "the and", "title", "content").withColumn("score", F.round("score", 9))
    return fulltext.best(scores, "scene_id", 5)


PAGE_ROWS = "SELECT page_id, concat(title, ' ', url) AS content FROM wiki_pages WHERE status = 'active' AND NOT list_contains(tags, 'skill')"


@query("wiki_pages", "SELECT page_id, round(score, 9) AS score FROM " + bm25_sql(PAGE_ROWS, "page_id", terms=("the", "es")) + " ORDER BY round(score, 9), page_id LIMIT 1000")
def v12_wiki_search(spark, sf):
    pages = E.wiki_pages(spark, sf).withColumn("content", F.col("url"))
    return R.search_wiki(pages, "the es", 1000).select("page_id", F.round("score", 9).alias("score"))


@query("raw_files messages", "SELECT f.file_id, substr(trim(m.content), 1, 50) AS snippet FROM (SELECT * FROM raw_files WHERE contains(session_key, '1') OR contains(agent_id, '1') ORDER BY coalesce(ended_at, started_at) DESC, file_id DESC LIMIT 10) f LEFT JOIN messages m ON m.file_id = f.file_id AND m.seq = 1")
def v13_session_search(spark, sf):
    hit = E.raw_files(spark, sf).where(P.any_column_holds(["session_key", "agent_id"], "1")).withColumn("at", F.coalesce("ended_at", "started_at"))
    first = E.messages(spark, sf).where("seq = 1").select("file_id", F.substring(F.trim("content"), 1, 50).alias("snippet"))
    return hit.orderBy(F.desc("at"), F.desc("file_id")).limit(10).join(first, "file_id", "left").select("file_id", "snippet")


@query("memories wiki_pages raw_files", f"""
    SELECT id, part FROM (SELECT memory_id AS id, 0 AS part FROM {bm25_sql(SHOWN)} ORDER BY round(score, 9), memory_id LIMIT 5) UNION ALL
    SELECT * FROM (SELECT page_id AS id, 1 AS part FROM {bm25_sql(PAGE_ROWS, "page_id", terms=("the", "es"))} ORDER BY round(score, 9), page_id LIMIT 5) UNION ALL
    SELECT * FROM (SELECT file_id AS id, 2 AS part FROM raw_files WHERE contains(agent_id, '3') ORDER BY file_id LIMIT 5)""")  # fmt: skip
def v14_scopes(spark, sf):
    rounded = lambda df: df.withColumn("score", F.round("score", 9))
    memory = fulltext.best(rounded(fulltext.bm25(E.memories(spark, sf).where(P.visible()), "memory_id", "stupid clown", "content")), "memory_id", 5)
    pages = E.wiki_pages(spark, sf).where(P.not_skill() & (F.col("status") == "active")).select("page_id", "title", "url")
    wiki = fulltext.best(rounded(fulltext.bm25(pages, "page_id", "the es", "title", "url")), "page_id", 5)
    files = E.raw_files(spark, sf).where(P.any_column_holds(["agent_id"], "3")).orderBy("file_id").limit(5)
    return O.union_in_order(memory.selectExpr("memory_id AS id"), wiki.selectExpr("page_id AS id"), files.selectExpr("file_id AS id"))


@query("memories memory_vectors", "SELECT count(*) AS cached FROM memories JOIN memory_vectors USING (memory_id) WHERE dims = 64")
def v15_embedding_cache(spark, sf):
    """Vectors come from a producer that is passed in; here from a table keyed by content hash and model."""
    from lodestone.sources import stores

    cache = E.memories(spark, sf).join(E.memory_vectors(spark, sf), "memory_id").select(F.sha2("content", 256).alias("content_key"), F.lit("m").alias("model"), "embedding", "dims").dropDuplicates(["content_key", "model"])
    both = E.memories(spark, sf).join(E.memory_vectors(spark, sf).select("memory_id"), "memory_id", "left_semi")
    return stores.cached_vectors(both, cache, "m", 64).where("embedding IS NOT NULL").agg(F.count("*").alias("cached"))


@query("memory_tags memory_vectors memories", f"""
    WITH v AS (SELECT memory_id FROM {SIM} ORDER BY similarity DESC, memory_id LIMIT 50), d AS (SELECT memory_id FROM memories WHERE memory_id IN (SELECT memory_id FROM memory_tags WHERE dimension_id = 'values') ORDER BY priority DESC, memory_id LIMIT 50)
    SELECT memory_id, min(part) AS part FROM (SELECT memory_id, 0 AS part FROM v UNION ALL SELECT memory_id, 1 FROM d) GROUP BY 1""")  # fmt: skip
def v17_memory_prescreen(spark, sf):
    near = _similar(spark, sf).orderBy(F.desc("similarity"), "memory_id").limit(50).select("memory_id")
    same = relations.tagged(E.memories(spark, sf), E.memory_tags(spark, sf), ["values"]).orderBy(F.desc("priority"), "memory_id").limit(50).select("memory_id")
    return O.first_seen("memory_id", near, same)


@query("scenes memory_vectors", f"""
    WITH v AS (SELECT memory_id AS scene_id FROM {SIM} WHERE memory_id IN (SELECT scene_id FROM scenes WHERE status = 'active') ORDER BY similarity DESC, memory_id LIMIT 3), h AS (SELECT scene_id FROM scenes WHERE status = 'active' ORDER BY heat DESC, scene_id LIMIT 4)
    SELECT scene_id, min(part) AS part FROM (SELECT scene_id, 0 AS part FROM v UNION ALL SELECT scene_id, 1 FROM h) GROUP BY 1""")  # fmt: skip
def v18_scene_prescreen(spark, sf):
    active = E.scenes(spark, sf).where("status = 'active'")
    near = _similar(spark, sf).join(active.select(F.col("scene_id").alias("memory_id")), "memory_id", "left_semi").orderBy(F.desc("similarity"), "memory_id").limit(3).select(F.col("memory_id").alias("scene_id"))
    return O.first_seen("scene_id", near, active.orderBy(F.desc("heat"), "scene_id").limit(4).select("scene_id"))


RANKED = "SELECT CAST(dimension_id AS VARCHAR) AS query, memory_id AS id, row_number() OVER (PARTITION BY dimension_id ORDER BY priority DESC, memory_id) AS rank FROM memory_tags JOIN memories USING (memory_id)"
RELEVANT = "SELECT dimension_id AS query, memory_id AS id FROM memory_tags WHERE CAST(memory_id AS INT) % 4 = 0 AND dimension_id <> 'ideas'"


def _rankings(spark, sf):
    joined = E.memory_tags(spark, sf).join(E.memories(spark, sf).select("memory_id", "priority"), "memory_id").withColumnsRenamed({"dimension_id": "query", "memory_id": "id"})
    relevant = E.memory_tags(spark, sf).where("int(memory_id) % 4 = 0 AND dimension_id <> 'ideas'").selectExpr("dimension_id AS query", "memory_id AS id")
    return evaluation.ranked(joined, F.desc("priority"), F.asc("id"), by="query"), relevant


NDCG = f"""r AS ({RANKED}), g AS ({RELEVANT}), d AS (SELECT query, sum(1 / log2(rank + 1)) AS dcg FROM r JOIN g USING (query, id) WHERE rank <= 10 GROUP BY 1),
    i AS (SELECT query, (SELECT sum(1 / log2(k + 1)) FROM range(1, 11) t(k) WHERE k <= n) AS ideal FROM (SELECT query, count(DISTINCT id) AS n FROM g GROUP BY 1)),
    q AS (SELECT DISTINCT query FROM r UNION SELECT DISTINCT query FROM g)"""


@query("memories memory_tags", f"WITH {NDCG} SELECT query, round(CASE WHEN ideal IS NULL THEN 1 ELSE coalesce(dcg, 0) / ideal END, 4) AS ndcg FROM q LEFT JOIN i USING (query) LEFT JOIN d USING (query)")
def v19_ndcg(spark, sf):
    return evaluation.ndcg(*_rankings(spark, sf))


GRID = (5, 10, 30, 60, 90)
IDEAL = "(SELECT sum(1 / log2(i + 1)) FROM range(1, 11) t(i) WHERE i <= (SELECT count(*) FROM memories WHERE priority >= 50))"
POINTS = " UNION ALL ".join(
    f"""SELECT {c} AS k, round((SELECT coalesce(sum(1 / log2(rank + 1)), 0) FROM (SELECT memory_id, row_number() OVER (ORDER BY rrf DESC, pb NULLS LAST, pv NULLS LAST, memory_id) AS rank FROM ({FUSED.format(c=c)}))
    WHERE rank <= 10 AND memory_id IN (SELECT memory_id FROM memories WHERE priority >= 50)) / {IDEAL}, 4) AS mean"""
    for c in GRID
)


@query("memories memory_vectors", f"WITH {routes_sql(30)} {POINTS}")
def v20_fusion_grid(spark, sf):
    """The mean NDCG of fused rankings for each constant of fusion."""
    routes = {name: materialize(route, "route") for name, route in _routes(spark, sf, 30).items()}  # 30 rows each, fused once for each constant
    relevant = E.memories(spark, sf).where("priority >= 50").select(F.lit("q").alias("query"), F.col("memory_id").alias("id"))

    def rankings(c: int):
        fused = R.fuse(routes, "memory_id", c)
        order = [F.desc("rrf"), F.col("_bm25").asc_nulls_last(), F.col("_vector").asc_nulls_last(), F.asc("memory_id")]
        return evaluation.ranked(fused, *order).select(F.lit("q").alias("query"), F.col("memory_id").alias("id"), "rank")

    return evaluation.best_constant(rankings, relevant, GRID)


@query("memories memory_tags", f"""
    WITH qs AS (SELECT DISTINCT dimension_id AS query FROM memory_tags), r AS (SELECT * FROM ({RANKED}) WHERE query <> 'focus'), g AS ({RELEVANT}), h AS (SELECT query, count(*) AS hits, sum(1 / log2(rank + 1)) AS dcg FROM r JOIN g USING (query, id) WHERE rank <= 20 GROUP BY 1),
    n AS (SELECT query, n, (SELECT sum(1 / log2(k + 1)) FROM range(1, 21) t(k) WHERE k <= n) AS ideal FROM (SELECT query, count(*) AS n FROM g GROUP BY 1))
    SELECT query, round(CASE WHEN n IS NULL THEN 1 ELSE coalesce(dcg, 0) / ideal END, 4) AS ndcg, round(CASE WHEN n IS NULL THEN 1 ELSE coalesce(hits, 0) / n END, 4) AS recall FROM qs LEFT JOIN n USING (query) LEFT JOIN h USING (query)""")  # fmt: skip
def x03_query_function(spark, sf):
    """A search that is passed in: the memories of a dimension by priority, and nothing for one of them."""
    rankings, relevant = _rankings(spark, sf)

    def search(queries):
        return rankings.join(queries.where("query <> 'focus'"), "query", "left_semi")

    return evaluation.evaluated(search, rankings, relevant, 20)


@query("memories memory_tags", f"WITH {NDCG}, s AS (SELECT round(CASE WHEN ideal IS NULL THEN 1 ELSE coalesce(dcg, 0) / ideal END, 4) AS ndcg FROM q LEFT JOIN i USING (query) LEFT JOIN d USING (query)) SELECT CASE WHEN count(*) = 0 THEN 'no_queries' WHEN max(ndcg) - min(ndcg) < 1e-6 THEN 'no_discrimination' ELSE 'discriminates' END AS conclusion FROM s")
def v21_diagnosis(spark, sf):
    scores = evaluation.ndcg(*_rankings(spark, sf)).agg(F.count("*").alias("n"), (F.max("ndcg") - F.min("ndcg")).alias("spread"))
    return scores.select(evaluation.diagnosis(F.col("n"), F.col("spread"), F.lit(10.0)).alias("conclusion"))


@query("", "SELECT DISTINCT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def v22_ground_truth(spark, sf):
    return evaluation.containments(E.table(spark, sf, "benchmark"), E.table(spark, sf, "documents"))


@query("memories memory_vectors", "SELECT CASE WHEN n = 0 THEN 'no_vectors' WHEN n < total THEN 'partial' ELSE 'full' END AS banner FROM (SELECT (SELECT count(*) FROM memories) AS total, (SELECT count(*) FROM memory_vectors WHERE memory_id IN (SELECT memory_id FROM memories)) AS n)")
def v23_vector_banner(spark, sf):
    covered = E.memories(spark, sf).select("memory_id").join(E.memory_vectors(spark, sf).selectExpr("memory_id", "1 AS has"), "memory_id", "left").agg(F.count("*").alias("total"), F.count("has").alias("n"))
    return covered.select(evaluation.vector_banner(F.col("total"), F.col("n")).alias("banner"))


@query("memory_vectors", "SELECT a.memory_id AS a, b.memory_id AS b FROM memory_vectors a JOIN memory_vectors b ON a.memory_id < b.memory_id WHERE list_cosine_similarity(a.embedding, b.embedding) >= 0.4")
def v24_near_duplicate_scenes(spark, sf):
    return V.similar_pairs(E.memory_vectors(spark, sf), 0.4).select("a", "b")


@query("memories memory_vectors", """SELECT memory_id FROM memories WHERE status = 'active' AND memory_id NOT IN (SELECT memory_id FROM memory_vectors) ORDER BY memory_id""")
def s31_vector_backfill(spark, sf):
    return relations.missing_vectors(E.memories(spark, sf).where("status = 'active'"), E.memory_vectors(spark, sf)).select("memory_id")
