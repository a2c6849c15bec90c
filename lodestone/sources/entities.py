"""The agent-memory entities, derived from the driver's tables, in Spark and as SQL for the oracles.

Every entity is a plain DataFrame with a fixed schema; ``SQL`` holds the same derivations as common
table expressions, and ``with_sql`` puts the ones that a query needs before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import table

#: "Now" of the time-dependent queries.
AS_OF = "2024-03-15 00:00:00"
EVENTS_AS_OF = "2024-01-31 00:00:00"

#: The dimension vocabulary in its order: id, display name, velocity, days to live.
DIMENSIONS = [
    ("identity", "身份", "static", None),
    ("family", "家庭", "static", None),
    ("social", "社交", "static", None),
    ("values", "价值观", "static", None),
    ("skills", "能力", "static", None),
    ("tech_stack", "技术栈", "static", None),
    ("preferences", "偏好", "static", None),
    ("habits", "习惯", "static", None),
    ("environment", "环境", "static", None),
    ("style", "风格", "static", None),
    ("focus", "关注", "dynamic", 30),
    ("goals", "目标", "dynamic", 90),
    ("status", "状态", "dynamic", 7),
    ("ideas", "想法", "dynamic", None),
]
DIMENSION_IDS = [d[0] for d in DIMENSIONS]


def _ids_sql(index: str) -> str:
    return "CASE " + index + "".join(f" WHEN {k} THEN '{d}'" for k, d in enumerate(DIMENSION_IDS)) + " END"


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One memory of each document."""
    when = "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(doc_id % 90 as int), 0, 0, (doc_id * 7919) % 86400)"
    return table(spark, sf_dir, "documents").selectExpr(
        "cast(doc_id as string) AS memory_id", "text AS content",
        "CASE doc_id % 3 WHEN 0 THEN 'persona' WHEN 1 THEN 'episodic' ELSE 'instruction' END AS memory_type",
        "cast((doc_id * 37) % 101 AS int) AS priority",
        "CASE doc_id % 2 WHEN 0 THEN 'static' ELSE 'dynamic' END AS time_velocity",
        "CASE doc_id % 4 WHEN 0 THEN cast(NULL AS int) WHEN 1 THEN 7 WHEN 2 THEN 30 ELSE 90 END AS ttl_days",
        "CASE doc_id % 10 WHEN 0 THEN 'rejected' WHEN 1 THEN 'expired' ELSE 'active' END AS status",
        f"{when} - make_dt_interval(cast(doc_id % 20 as int)) AS created_at", f"{when} AS updated_at", f"{when} - make_dt_interval(0, cast(doc_id % 5 as int)) AS occurred_at",
        "concat('agent', doc_id % 5) AS agent_tag", "concat('l1:v', doc_id % 3) AS prompt_version",
    )


def memory_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(memory_id, dimension_id): one or two dimensions of each memory."""
    both = "explode(array_distinct(array(doc_id % 14, (doc_id * 5 + 3) % 14)))"
    return table(spark, sf_dir, "documents").selectExpr("cast(doc_id as string) AS memory_id", f"{both} AS k").selectExpr("memory_id", f"{_ids_sql('k')} AS dimension_id")


def memory_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr("cast(doc_id as string) AS memory_id", "concat(doc_id % 100, ':', doc_id % 8) AS source_ref", "'session' AS source_type", "doc_id AS seq")


def memory_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").selectExpr("cast(vec_id as string) AS memory_id", "embedding", "size(embedding) AS dims")


def dimensions(spark: SparkSession, sf_dir: str = "") -> DataFrame:
    return spark.createDataFrame(DIMENSIONS, "id string, display_name string, time_velocity string, ttl_days int")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr("cast(conv_id as string) AS file_id", "cast(turn + 1 as int) AS seq", "role", "text AS content")


def raw_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One session file of each conversation."""
    grouped = table(spark, sf_dir, "conversations").groupBy("conv_id").agg((F.max("turn") + 1).cast("int").alias("last_seq"), F.sum(F.length("text")).alias("size"))
    start = "timestamp_ntz'2024-03-01 00:00:00' + make_dt_interval(cast(conv_id % 14 as int), cast(conv_id % 24 as int))"
    return grouped.selectExpr(
        "cast(conv_id as string) AS file_id", "concat('s', cast(conv_id div 2 as string)) AS session_key", "concat('agent', conv_id % 6) AS agent_id", "last_seq",
        "cast(conv_id % 4 as int) AS last_refined_seq", "CASE conv_id % 4 WHEN 0 THEN 'new' WHEN 1 THEN 'refined' WHEN 2 THEN 'error' ELSE 'archived' END AS status",
        f"{start} AS started_at", f"CASE WHEN conv_id % 3 = 0 THEN NULL ELSE {start} + make_dt_interval(0, 1) END AS ended_at",
        f"CASE WHEN conv_id % 4 = 0 THEN NULL ELSE {start} + make_dt_interval(0, 2) END AS refined_at", "size",
    )


def signal_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("event_id", "event_type AS type", "concat('u', user_id) AS source", "props AS payload", "ts", "value")


def refine_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run of each order; its tokens are the order's quantities."""
    tokens = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").cast("long").alias("total_tokens"), F.count("*").alias("memories_count"))
    runs = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "o_orderkey AS run_id", "CASE o_orderkey % 4 WHEN 0 THEN 'l1' WHEN 1 THEN 'l15' WHEN 2 THEN 'l2' ELSE 'tier0' END AS stage",
        "concat('v', o_orderkey % 3) AS version", "CASE WHEN o_orderkey % 5 = 0 THEN 'b' ELSE 'a' END AS variant",
        "CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'O' THEN 'error' ELSE 'running' END AS status", "o_orderdate AS started_at",
    )
    return runs.join(tokens, "o_orderkey", "left").drop("o_orderkey")


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scene of each label of the embeddings; heat is its number of vectors."""
    grouped = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("heat"), F.max("vec_id").alias("last_id"))
    return grouped.selectExpr(
        "cast(label as string) AS scene_id", "concat('scene ', label) AS title", "heat", "CASE WHEN label % 7 = 6 THEN 'archived' ELSE 'active' END AS status",
        "timestamp_ntz'2024-02-01 00:00:00' + make_dt_interval(cast(last_id % 40 as int), 0, 0, last_id) AS updated_at",
    )


def scene_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").selectExpr("cast(label as string) AS scene_id", "cast(vec_id as string) AS memory_id")


def wiki_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page of each web page; its tags are parts of its address."""
    return table(spark, sf_dir, "pages").selectExpr(
        "cast(page_id as string) AS page_id", "url", "html", r"regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title",
        "CASE page_id % 3 WHEN 0 THEN 'guide' WHEN 1 THEN 'note' ELSE 'skill' END AS category",
        "array(concat('t', page_id % 7), concat('t', page_id % 11), CASE WHEN page_id % 9 = 0 THEN 'skill' ELSE 'page' END) AS tags",
        "CASE WHEN page_id % 8 = 7 THEN 'superseded' ELSE 'active' END AS status",
        "timestamp_ntz'2024-02-01 00:00:00' + make_dt_interval(cast(page_id % 30 as int), 0, 0, page_id) AS updated_at",
    )


def wiki_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some links between pages, with repeats and ends that are no pages."""
    return table(spark, sf_dir, "pages").selectExpr("page_id", "explode(array(page_id + 1, page_id * 3, page_id * 3)) AS to").selectExpr(
        "cast(page_id as string) AS source_id", "cast(to as string) AS target_id", "CASE to % 2 WHEN 0 THEN 'similar' ELSE 'references' END AS rel_type", "cast((to % 10) / 10.0 as double) AS confidence",
    )


_WHEN = "TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 DAY * (doc_id % 90) + INTERVAL 1 SECOND * ((doc_id * 7919) % 86400)"
_START = "TIMESTAMP '2024-03-01 00:00:00' + INTERVAL 1 DAY * (conv_id % 14) + INTERVAL 1 HOUR * (conv_id % 24)"
_DIMENSION_ROWS = ", ".join(f"('{i}', '{n}', '{v}', {'NULL' if t is None else t})" for i, n, v, t in DIMENSIONS)

SQL = {
    "memories": f"""SELECT CAST(doc_id AS VARCHAR) AS memory_id, text AS content,
        CASE doc_id % 3 WHEN 0 THEN 'persona' WHEN 1 THEN 'episodic' ELSE 'instruction' END AS memory_type,
        CAST((doc_id * 37) % 101 AS INT) AS priority, CASE doc_id % 2 WHEN 0 THEN 'static' ELSE 'dynamic' END AS time_velocity,
        CAST(CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 7 WHEN 2 THEN 30 ELSE 90 END AS INT) AS ttl_days,
        CASE doc_id % 10 WHEN 0 THEN 'rejected' WHEN 1 THEN 'expired' ELSE 'active' END AS status,
        {_WHEN} - INTERVAL 1 DAY * (doc_id % 20) AS created_at, {_WHEN} AS updated_at, {_WHEN} - INTERVAL 1 HOUR * (doc_id % 5) AS occurred_at,
        concat('agent', doc_id % 5) AS agent_tag, concat('l1:v', doc_id % 3) AS prompt_version FROM documents""",
    "memory_tags": f"""SELECT memory_id, {_ids_sql("k")} AS dimension_id FROM (
        SELECT CAST(doc_id AS VARCHAR) AS memory_id, doc_id % 14 AS k FROM documents UNION SELECT CAST(doc_id AS VARCHAR), (doc_id * 5 + 3) % 14 FROM documents)""",
    "memory_sources": "SELECT CAST(doc_id AS VARCHAR) AS memory_id, concat(doc_id % 100, ':', doc_id % 8) AS source_ref, 'session' AS source_type, doc_id AS seq FROM documents",
    "memory_vectors": "SELECT CAST(vec_id AS VARCHAR) AS memory_id, CAST(embedding AS DOUBLE[]) AS embedding, len(embedding) AS dims FROM embeddings",
    "dimensions": f"SELECT * FROM (VALUES {_DIMENSION_ROWS}) AS t(id, display_name, time_velocity, ttl_days)",
    "messages": "SELECT CAST(conv_id AS VARCHAR) AS file_id, CAST(turn + 1 AS INT) AS seq, role, text AS content FROM conversations",
    "raw_files": f"""SELECT CAST(conv_id AS VARCHAR) AS file_id, concat('s', conv_id // 2) AS session_key, concat('agent', conv_id % 6) AS agent_id, last_seq,
        CAST(conv_id % 4 AS INT) AS last_refined_seq, CASE conv_id % 4 WHEN 0 THEN 'new' WHEN 1 THEN 'refined' WHEN 2 THEN 'error' ELSE 'archived' END AS status,
        {_START} AS started_at, CASE WHEN conv_id % 3 = 0 THEN NULL ELSE {_START} + INTERVAL 1 HOUR END AS ended_at,
        CASE WHEN conv_id % 4 = 0 THEN NULL ELSE {_START} + INTERVAL 2 HOUR END AS refined_at, size
        FROM (SELECT conv_id, CAST(max(turn) + 1 AS INT) AS last_seq, CAST(sum(length(text)) AS BIGINT) AS size FROM conversations GROUP BY conv_id)""",
    "signal_events": "SELECT event_id, event_type AS type, concat('u', user_id) AS source, props AS payload, ts, value FROM events",
    "refine_runs": """SELECT o_orderkey AS run_id, CASE o_orderkey % 4 WHEN 0 THEN 'l1' WHEN 1 THEN 'l15' WHEN 2 THEN 'l2' ELSE 'tier0' END AS stage,
        concat('v', o_orderkey % 3) AS version, CASE WHEN o_orderkey % 5 = 0 THEN 'b' ELSE 'a' END AS variant,
        CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'O' THEN 'error' ELSE 'running' END AS status, o_orderdate AS started_at, total_tokens, memories_count
        FROM orders LEFT JOIN (SELECT l_orderkey, CAST(sum(l_quantity) AS BIGINT) AS total_tokens, count(*) AS memories_count FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey""",
    "scenes": """SELECT CAST(label AS VARCHAR) AS scene_id, concat('scene ', label) AS title, heat, CASE WHEN label % 7 = 6 THEN 'archived' ELSE 'active' END AS status,
        TIMESTAMP '2024-02-01 00:00:00' + INTERVAL 1 DAY * (last_id % 40) + INTERVAL 1 SECOND * last_id AS updated_at
        FROM (SELECT label, count(*) AS heat, max(vec_id) AS last_id FROM embeddings GROUP BY label)""",
    "scene_memories": "SELECT CAST(label AS VARCHAR) AS scene_id, CAST(vec_id AS VARCHAR) AS memory_id FROM embeddings",
    "wiki_pages": r"""SELECT CAST(page_id AS VARCHAR) AS page_id, url, html, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title,
        CASE page_id % 3 WHEN 0 THEN 'guide' WHEN 1 THEN 'note' ELSE 'skill' END AS category,
        [concat('t', page_id % 7), concat('t', page_id % 11), CASE WHEN page_id % 9 = 0 THEN 'skill' ELSE 'page' END] AS tags,
        CASE WHEN page_id % 8 = 7 THEN 'superseded' ELSE 'active' END AS status,
        TIMESTAMP '2024-02-01 00:00:00' + INTERVAL 1 DAY * (page_id % 30) + INTERVAL 1 SECOND * page_id AS updated_at FROM pages""",
    "wiki_links": """SELECT CAST(page_id AS VARCHAR) AS source_id, CAST(dest AS VARCHAR) AS target_id, CASE dest % 2 WHEN 0 THEN 'similar' ELSE 'references' END AS rel_type, CAST((dest % 10) / 10.0 AS DOUBLE) AS confidence
        FROM (SELECT page_id, unnest([page_id + 1, page_id * 3, page_id * 3]) AS dest FROM pages)""",
}


def with_sql(names: str, query: str) -> str:
    """``query`` after the derivations of the entities in ``names``."""
    head, body = "WITH ", " " + query
    for start in ("WITH RECURSIVE ", "WITH "):
        if query.startswith(start):
            head, body = start, ", " + query[len(start) :]
            break
    return head + ", ".join(f"{n} AS ({SQL[n]})" for n in names.split()) + body
