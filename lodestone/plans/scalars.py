"""Queries of section F."""

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import fulltext, relations
from lodestone.plans.registry import query
from lodestone.sources import entities as E
from lodestone.sources.entities import AS_OF


@query("memories", r"SELECT memory_id, CAST(len(list_filter(regexp_split_to_array(lower(content), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS INT) AS n FROM memories")
def f01_word_tokens(spark, sf):
    return E.memories(spark, sf).select("memory_id", F.size(fulltext.words("content")).alias("n"))


@query("", r"""SELECT item_id, string_agg(g, ' ' ORDER BY p, i) AS grams FROM (SELECT item_id, p, unnest(range(1, greatest(length(w), 2))) AS i, w, substr(w, i, 2) AS g FROM (
    SELECT item_id, generate_subscripts(l, 1) AS p, unnest(l) AS w FROM (SELECT item_id, list_filter(regexp_split_to_array(trim(text), '\s+'), lambda x: x <> '') AS l FROM benchmark))) GROUP BY 1""")
def f02_bigrams(spark, sf):
    return E.table(spark, sf, "benchmark").select("item_id", F.array_join(fulltext.bigrams("text"), " ").alias("grams"))


@query("", "SELECT 'words-v2' AS segmenter")
def f03_segmenter(spark, sf):
    return spark.createDataFrame([(fulltext.SEGMENTER,)], "segmenter string")


@query("", "SELECT unnest(['the', 'and', 'x1', 'grosse', 'uber']) AS term")
def f04_query_terms(spark, sf):
    return spark.createDataFrame([(t,) for t in fulltext.query_terms("The AND, x1 the! grosse über ÜBER")], "term string")


@query("", r"""SELECT p_partkey, CASE WHEN q <> p_name THEN q ELSE p_name END AS query FROM (SELECT *, CASE WHEN regexp_matches(r, '\bred\b', 'i') OR NOT regexp_matches(r, '\bpink\b', 'i') THEN r ELSE regexp_replace(r, '\b(pink)\b', '\1 red', 'gi') END AS q
    FROM (SELECT *, CASE WHEN regexp_matches(p_name, '\bblue\b', 'i') THEN p_name ELSE regexp_replace(p_name, '\b(navy|azure)\b', '\1 blue', 'gi') END AS r FROM (
    SELECT p_partkey, concat(p_name, CASE p_partkey % 4 WHEN 0 THEN ' Navy' WHEN 1 THEN ' navyblue' WHEN 2 THEN ' PINK' ELSE ' azure' END) AS p_name FROM part)))""")
def f05_alias_terms(spark, sf):
    word = F.element_at(F.array(F.lit(" Navy"), F.lit(" navyblue"), F.lit(" PINK"), F.lit(" azure")), (F.col("p_partkey") % 4 + 1).cast("int"))
    return E.table(spark, sf, "part").select("p_partkey", T.with_canonical_terms(F.concat("p_name", word), {"navy": "blue", "azure": "blue", "pink": "red"}).alias("query"))


@query("memories", r"SELECT memory_id, trim(regexp_replace(content, '\s+', ' ', 'g')) AS content FROM memories")
def f06_collapse(spark, sf):
    return E.memories(spark, sf).select("memory_id", T.collapsed("content").alias("content"))


@query("messages", r"SELECT file_id, seq, substr(trim(regexp_replace(content, '\s+', ' ', 'g')), 1, 200) AS snippet FROM messages")
def f07_snippet(spark, sf):
    return E.messages(spark, sf).select("file_id", "seq", T.snippet(F.concat(F.lit("---\nid: 1\n---"), F.col("content"))).alias("snippet"))


@query("memories", "SELECT memory_id, CASE WHEN length(content) <= 300 THEN content ELSE concat(substr(content, 1, 300), chr(10), '...[截断 ', length(content) - 300, ' 字符]') END AS content FROM memories")
def f08_truncate(spark, sf):
    return E.memories(spark, sf).select("memory_id", T.truncated(F.col("content"), 300).alias("content"))


@query("", r"SELECT doc_id, regexp_replace(text, '(sk-|ark-|ghp_)[A-Za-z0-9-]{12,}', '<REDACTED>', 'g') AS text FROM documents")
def f09_redact(spark, sf):
    return E.table(spark, sf, "documents").select("doc_id", T.redacted("text", (*T.SECRET_PREFIXES, "ghp_")).alias("text"))


@query("", "SELECT p_partkey, lower(trim(p_name)) AS name FROM part")
def f10_normalise(spark, sf):
    wide = F.translate("p_name", "abcdefghijklmnopqrstuvwxyz ", "ａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ　")
    return E.table(spark, sf, "part").select("p_partkey", T.normalised(wide).alias("name"))


@query("", "SELECT * FROM (VALUES ('身份', 'identity', 'alias'), ('FOCUS', 'focus', 'alias'), ('tech stak', 'tech_stack', 'fuzzy'), ('家人', 'family', 'alias'), ('zzz', NULL, 'drop')) AS t(label, id, kind)")
def f11_dimension_of(spark, sf):
    rows = spark.createDataFrame([(x,) for x in ("身份", "FOCUS", "tech stak", "家人", "zzz")], "label string")
    found = T.dimension_of("label", [(d[0], d[1]) for d in E.DIMENSIONS], [("家人", "family"), ("tech stack", "tech_stack")])
    return rows.withColumn("f", found).select("label", "f.id", "f.kind")


@query()
def f12_content_similarity(spark, sf):
    """SQL has no such similarity; tests compare it with difflib. A case is four turns of a conversation, each of which is to be found again among them."""
    from lodestone.operators import evaluation

    case = F.shiftleft(F.col("conv_id").cast("long"), 32) + F.floor(F.col("turn") / 4)
    pairs = E.table(spark, sf, "conversations").select(case.alias("case_id"), F.col("turn").cast("long").alias("predicted"), F.col("text").alias("pred_text"))
    truth = pairs.select("case_id", F.col("predicted").alias("truth"), F.col("pred_text").alias("true_text"))
    return evaluation.greedy_matches(pairs.join(truth, "case_id"), 0.6)


LABEL = f"date_diff('second', updated_at, TIMESTAMP '{AS_OF}')"


@query("memories", f"SELECT memory_id, CASE WHEN s < 0 THEN NULL WHEN s < 60 THEN '刚刚' WHEN s < 3600 THEN concat(s // 60, '分钟前') WHEN s < 86400 THEN concat(s // 3600, '小时前') WHEN s < 2592000 THEN concat(s // 86400, '天前') END AS label FROM (SELECT memory_id, {LABEL} AS s FROM memories)")
def f13_relative_time(spark, sf):
    return E.memories(spark, sf).select("memory_id", T.relative_time("updated_at", AS_OF).alias("label"))


@query("memories", "SELECT memory_id, regexp_replace(substr(content, 1, 50), '[。！？!?.,，；; ]+$', '') AS prefix FROM memories")
def f14_prefix_key(spark, sf):
    from lodestone.operators import ranking

    return E.memories(spark, sf).select("memory_id", ranking.prefix_key("content").alias("prefix"))


@query("memories memory_tags dimensions", "SELECT m.memory_id, coalesce(m.ttl_days, (SELECT min_by(d.ttl_days, t.dimension_id) FROM memory_tags t JOIN dimensions d ON d.id = t.dimension_id WHERE t.memory_id = m.memory_id AND d.ttl_days IS NOT NULL)) AS ttl_days FROM memories m")
def f15_backfilled_ttl(spark, sf):
    rows = relations.with_tags(E.memories(spark, sf), E.memory_tags(spark, sf))
    return rows.select("memory_id", T.backfilled_ttl(F.col("ttl_days"), F.col("dimensions"), {d[0]: d[3] for d in E.DIMENSIONS}).alias("ttl_days"))


@query("raw_files", f"SELECT agent_id, date_diff('second', max(refined_at), TIMESTAMP '{AS_OF}') AS age_sec FROM raw_files GROUP BY 1")
def f16_watermark_age(spark, sf):
    return E.raw_files(spark, sf).groupBy("agent_id").agg(F.max("refined_at").alias("last")).select("agent_id", T.watermark_age(F.col("last"), AS_OF).alias("age_sec"))


@query("memories memory_tags", "SELECT dimension_id, CAST(max(occurred_at) AS VARCHAR) AS occurred_at FROM memories JOIN memory_tags USING (memory_id) GROUP BY 1")
def f17_occurred_at(spark, sf):
    return E.memories(spark, sf).join(E.memory_tags(spark, sf), "memory_id").groupBy("dimension_id").agg(F.max("occurred_at").cast("string").alias("occurred_at"))


@query("messages", "SELECT file_id, concat(file_id, ':', min(seq)) AS source_ref FROM messages WHERE role = 'assistant' GROUP BY 1")
def f18_source_ref(spark, sf):
    seqs = E.messages(spark, sf).where("role = 'assistant'").groupBy("file_id").agg(F.sort_array(F.collect_list("seq")).alias("seqs"))
    return seqs.select("file_id", T.source_ref(F.col("file_id"), F.col("seqs")).alias("source_ref"))


@query("memory_sources", "SELECT memory_id, split_part(source_ref, ':', 1) AS file_id, split_part(source_ref, ':', 2) AS msg_id FROM memory_sources")
def f19_split_ref(spark, sf):
    return E.memory_sources(spark, sf).select("memory_id", F.split_part("source_ref", F.lit(":"), F.lit(1)).alias("file_id"), F.split_part("source_ref", F.lit(":"), F.lit(2)).alias("msg_id"))


@query("", "SELECT event_id, CAST(props->>'k' AS BIGINT) AS k FROM events")
def f20_json_array(spark, sf):
    answer = F.concat(F.lit("Sure:\n```json\n["), F.col("props"), F.lit("]\n```\n"))
    return E.table(spark, sf, "events").select("event_id", F.try_element_at(T.json_array(answer, "struct<k:bigint>"), F.lit(1))["k"].alias("k"))


@query("", "SELECT event_id, CAST(props->>'k' AS BIGINT) AS k FROM events")
def f21_repaired_json(spark, sf):
    broken = F.regexp_replace("props", r"\}$", ",}")
    return E.table(spark, sf, "events").select("event_id", F.get_json_object(T.repaired_json(broken), "$.k").cast("long").alias("k"))


@query("", "SELECT item_id, concat(text, ', ] {\\q ') AS t, item_id + 1 AS n FROM benchmark")
def f21_repaired_texts(spark, sf):
    """Texts that look like structure, with lone backslashes, in objects without commas and with too many."""
    text = F.to_json(F.struct(F.concat("text", F.lit(", ] {")).alias("t")))
    broken = F.concat(F.lit("[["), F.col("item_id").cast("string"), F.lit(" "), (F.col("item_id") + 1).cast("string"), F.lit(",,] "), F.substr(text, F.lit(1), F.length(text) - 2), F.lit('\\q ",}\n,]'))
    good = T.repaired_json(broken)
    return E.table(spark, sf, "benchmark").select("item_id", F.get_json_object(good, "$[1].t").alias("t"), F.get_json_object(good, "$[0][1]").cast("long").alias("n"))


@query("", "SELECT event_id, CAST(props->>'k' AS BIGINT) AS k FROM events")
def f22_json_object(spark, sf):
    return E.table(spark, sf, "events").select("event_id", T.json_object(F.concat(F.lit("answer: "), F.col("props")), "k:bigint")["k"].alias("k"))


@query("", """SELECT event_id, concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), concat('5', substr(h, 14, 3)), concat(substr('89ab', (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1), substr(h, 18, 3)), substr(h, 21, 12)) AS uuid
    FROM (SELECT event_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(concat(event_type, ':', event_id))) AS h FROM events)""")
def f23_uuid5(spark, sf):
    return E.table(spark, sf, "events").select("event_id", T.uuid5(F.concat_ws(":", "event_type", F.col("event_id").cast("string"))).alias("uuid"))


@query("memories", "SELECT memory_id, sha256(content) AS digest FROM memories")
def f24_content_hash(spark, sf):
    return E.memories(spark, sf).select("memory_id", T.content_hash("content").alias("digest"))


@query("raw_files", "SELECT file_id, CAST(CAST(concat('0x', substr(sha256(file_id), 1, 16)) AS UBIGINT) % 100 AS INT) AS bucket FROM raw_files")
def f25_ab_bucket(spark, sf):
    return E.raw_files(spark, sf).select("file_id", T.bucket("file_id").alias("bucket"))


@query("wiki_pages", r"""SELECT page_id, concat(CASE WHEN b = '' THEN 'page' ELSE b END, '-', substr(sha256(concat(title, '|', url)), 1, 8)) AS slug FROM (
    SELECT *, substr(regexp_replace(regexp_replace(lower(trim(title)), '[^\p{L}\p{M}\p{N}_-]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 64) AS b FROM wiki_pages)""")
def f26_page_slug(spark, sf):
    return E.wiki_pages(spark, sf).select("page_id", T.page_id(F.col("title"), F.col("url")).alias("slug"))


@query()
def f27_markdown(spark, sf):
    """Entities and nested tags are beyond SQL; tests compare it with expected texts."""
    return E.wiki_pages(spark, sf).select("page_id", T.to_markdown("html").alias("markdown"))


@query("wiki_pages", "SELECT page_id, trim(title) AS heading FROM wiki_pages")
def f28_heading(spark, sf):
    return E.wiki_pages(spark, sf).select("page_id", T.heading(F.concat(F.lit("x\n# "), F.col("title"), F.lit("\ny")), F.lit("none")).alias("heading"))


@query("messages", "SELECT file_id, CAST(ceil((sum(length(content)) + 120 * count(*) + 160) / 2.0) AS BIGINT) AS tokens FROM messages GROUP BY 1")
def f29_group_tokens(spark, sf):
    return E.messages(spark, sf).groupBy("file_id").agg(T.group_tokens(F.sum(F.length("content")), F.count("*")).alias("tokens"))


@query("", "SELECT 6334 AS budget, 4.0 AS third_delay, 30.0 AS late_delay")
def f30_budget_and_backoff(spark, sf):
    n = spark.range(1).select(F.lit(T.batch_budget(8192, 1202)).alias("budget"))
    return n.withColumns({"third_delay": T.backoff(F.lit(3), 1.0, 30.0), "late_delay": T.backoff(F.lit(9), 1.0, 30.0)})


@query("", "SELECT event_id, strftime(TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 SECOND * event_id, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events")
def f32_millis_to_iso(spark, sf):
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor((F.lit(1704067200) + F.col("event_id")) / 86400).cast("int"))
    s = (F.lit(1704067200) + F.col("event_id")) % 86400
    clock = F.format_string("T%02d:%02d:%02dZ", F.floor(s / 3600).cast("int"), F.floor(s % 3600 / 60).cast("int"), (s % 60).cast("int"))
    return E.table(spark, sf, "events").select("event_id", F.concat(F.date_format(day, "yyyy-MM-dd"), clock).alias("iso"))


@query("wiki_pages", "SELECT page_id, array_to_string(tags, ',') AS tags FROM wiki_pages")
def f33_double_encoded_tags(spark, sf):
    once = F.to_json("tags")
    twice = F.concat(F.lit('"'), F.replace(once, F.lit('"'), F.lit('\\"')), F.lit('"'))
    text = F.when(F.col("page_id").cast("int") % 2 == 0, once).otherwise(twice)
    return E.wiki_pages(spark, sf).select("page_id", F.array_join(T.tag_list(text), ",").alias("tags"))


@query("", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '[{\"ts\":\"1\",\"text\":\"old\"},{\"ts\":\"2\",\"text\":\"new\"}]' ELSE '[{\"ts\":\"2\",\"text\":\"new\"}]' END AS notes FROM pages")
def f34_notes(spark, sf):
    known = F.when(F.col("page_id") % 2 == 0, '[{"ts":"1","text":"old"}]').otherwise("not json")
    return E.table(spark, sf, "pages").select("page_id", T.with_note(known, "2", "new").alias("notes"))


@query("memories", "SELECT memory_id, concat('superseded by 7: ', substr(content, 1, 100), CASE WHEN length(content) > 100 THEN '…' ELSE '' END) AS reason FROM memories")
def f35_reject_reason(spark, sf):
    return E.memories(spark, sf).select("memory_id", T.reject_reason(F.col("content"), F.lit("7")).alias("reason"))


@query("", "SELECT item_id, list_filter(list_distinct(string_split(text, ' ')), lambda x: length(x) >= 2)[1] IS NOT NULL AS some, CAST(len(list_filter(list_distinct(string_split(text, ' ')), lambda x: length(x) >= 2)) AS INT) AS n FROM benchmark")
def f36_subjects(spark, sf):
    names = T.subjects(F.split("text", " "))
    return E.table(spark, sf, "benchmark").select("item_id", (F.size(names) > 0).alias("some"), F.size(names).alias("n"))


@query("memories memory_tags", "SELECT memory_id, max(CASE WHEN dimension_id IN ('focus', 'goals', 'status', 'ideas') THEN 'dynamic' ELSE 'a' END) = 'dynamic' AS dynamic, min(least(100, priority * 2)) AS priority FROM memories JOIN memory_tags USING (memory_id) GROUP BY 1")
def f37_item_defaults(spark, sf):
    rows = relations.with_tags(E.memories(spark, sf), E.memory_tags(spark, sf))
    dynamic = T.velocity(F.col("dimensions"), [d[0] for d in E.DIMENSIONS if d[2] == "dynamic"]) == "dynamic"
    return rows.select("memory_id", dynamic.alias("dynamic"), T.clamped_priority(F.col("priority") * 2).alias("priority"))


@query("dimensions", "SELECT concat('Dimensions:', chr(10), string_agg(concat('- ', id, ' ', display_name), chr(10) ORDER BY id)) AS prompt FROM dimensions")
def f38_prompt(spark, sf):
    lines = "\n".join(f"- {d[0]} {d[1]}" for d in sorted(E.DIMENSIONS))
    return spark.createDataFrame([(T.render("Dimensions:\n{{dimensions}}", {"dimensions": lines}),)], "prompt string")


@query("messages", "SELECT file_id, string_agg(concat('[msg#', seq, '] - ', role, ':', chr(10), '  ', content, chr(10)), '' ORDER BY seq) AS conversation FROM messages GROUP BY 1")
def f39_conversation(spark, sf):
    shown = T.shown_message(F.col("seq"), F.lit("-"), F.col("role"), F.col("content"))
    grouped = E.messages(spark, sf).groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("seq", shown.alias("t"))))["t"].alias("t"))
    return grouped.select("file_id", F.array_join("t", "").alias("conversation"))


@query("messages", "SELECT file_id, seq, trim(content) AS query FROM messages")
def f40_query_text(spark, sf):
    from lodestone.operators import evaluation

    shown = E.messages(spark, sf).withColumn("text", F.concat(F.lit("[msg#"), F.col("seq").cast("string"), F.lit("] user:\n"), F.col("content")))
    return evaluation.query_texts(shown).select("file_id", "seq", F.trim(F.ltrim(F.regexp_replace("query", r"\A\n", ""))).alias("query"))


@query("messages", "SELECT concat(file_id, '#', seq) AS memory_id, CAST(seq AS INT) AS place FROM messages")
def f41_case_memory_id(spark, sf):
    made = E.messages(spark, sf).select(T.memory_id(F.col("file_id"), F.col("seq")).alias("memory_id"))
    return made.withColumn("place", F.regexp_extract("memory_id", r"#(\d+)$", 1).cast("int"))


@query("messages", "SELECT file_id, coalesce(concat('dsh-', min(seq) FILTER (role = 'user')), file_id) AS session_key FROM messages GROUP BY 1")
def f45_handoff_key(spark, sf):
    first = F.min(F.when(F.col("role") == "user", F.col("seq")))
    return E.messages(spark, sf).groupBy("file_id").agg(F.coalesce(F.concat(F.lit("dsh-"), first.cast("string")), F.first("file_id")).alias("session_key"))


@query("memories", "SELECT memory_id, strftime(updated_at, '%Y-%m-%dT%H:%M:%SZ') AS at FROM memories")
def f46_utc_text(spark, sf):
    return E.memories(spark, sf).select("memory_id", T.utc_text(F.col("updated_at")).alias("at"))
