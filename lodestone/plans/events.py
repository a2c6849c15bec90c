"""Queries of section T."""

from pyspark.sql import functions as F

from lodestone.operators import state as D
from lodestone.plans.registry import query
from lodestone.session import working_path
from lodestone.sources import entities as E
from lodestone.sources.entities import AS_OF, EVENTS_AS_OF
from lodestone.streaming import signals as S
from lodestone.streaming.cursor import dealt_with, past_cursor

HINT = "SELECT event_id, coalesce(ts - lag(ts) OVER (PARTITION BY type, source ORDER BY ts, event_id) <= INTERVAL 1800 SECOND, false) AS suppress_hint FROM signal_events"


def _stream(spark, sf):
    return S.events_stream(spark, f"{sf}/events.parquet")


@query("signal_events", HINT)
def t01_suppression_stream(spark, sf):
    return S.drained(S.with_suppression(_stream(spark, sf)), "suppression")


@query("signal_events", "SELECT event_id, type FROM signal_events")
def t02_unique_stream(spark, sf):
    """Every third event comes three times."""
    times = F.sequence(F.lit(1), F.when(F.col("event_id") % 3 == 0, 3).otherwise(1))
    again = _stream(spark, sf).withColumn("_time", F.explode(times)).drop("_time")
    return S.drained(S.unique_events(again).select("event_id", "type"), "unique")


CURSORS = [("a", "2024-01-10 00:00:00", 100), ("b", "2024-01-29 12:00:00", 0), ("c", "2024-12-01 00:00:00", 5)]


def _cursors(spark):
    return spark.createDataFrame(CURSORS, "subscriber_id string, last_ts string, last_id long").withColumn("last_ts", F.col("last_ts").cast("timestamp_ntz"))


PULL = """WITH c(subscriber_id, last_ts, last_id) AS (VALUES ('a', TIMESTAMP '2024-01-10 00:00:00', 100), ('b', TIMESTAMP '2024-01-29 12:00:00', 0), ('c', TIMESTAMP '2024-12-01 00:00:00', 5)),
    p AS (SELECT * FROM (SELECT subscriber_id, event_id, ts, row_number() OVER (PARTITION BY subscriber_id ORDER BY ts, event_id) AS n FROM signal_events JOIN c ON ts > last_ts OR (ts = last_ts AND event_id > last_id)) WHERE n <= 50)"""


@query("signal_events", PULL + " SELECT subscriber_id, event_id FROM p")
def t03_pull(spark, sf):
    return S.pulled(E.signal_events(spark, sf), _cursors(spark), 50)[0].select("subscriber_id", "event_id")


@query("signal_events", PULL + " SELECT subscriber_id, coalesce(max_by(p.event_id, row(ts, p.event_id)), any_value(last_id)) AS last_id FROM c LEFT JOIN p USING (subscriber_id) GROUP BY 1")
def t03_next_cursor(spark, sf):
    return S.pulled(E.signal_events(spark, sf), _cursors(spark), 50)[1].select("subscriber_id", "last_id")


@query("signal_events", "SELECT event_id, source FROM signal_events WHERE type = 'error' AND ts > TIMESTAMP '2024-01-20 00:00:00' ORDER BY ts, event_id LIMIT 100")
def t04_list_since(spark, sf):
    return S.since(E.signal_events(spark, sf), "2024-01-20 00:00:00", kind="error").select("event_id", "source")


@query("signal_events", "SELECT CAST(event_id AS VARCHAR) AS event_id, type, 1 AS n FROM signal_events WHERE ts >= TIMESTAMP '2024-01-30 20:00:00' UNION ALL SELECT '_summary', '_summary', count(*) FROM signal_events WHERE ts < TIMESTAMP '2024-01-30 20:00:00'")
def t05_replay(spark, sf):
    return S.replay(E.signal_events(spark, sf), EVENTS_AS_OF, 4)


@query("signal_events", "SELECT CAST(date_trunc('day', ts) AS DATE) AS day, type, count(*) AS n FROM signal_events GROUP BY 1, 2")
def t06_windowed_stream(spark, sf):
    """Counts of windows that the watermark closed, and of those still open, from the last update of each."""
    counts = S.drained(S.windowed_counts(_stream(spark, sf), width="1 day"), "windows", "update")
    return counts.groupBy(F.to_date("start").alias("day"), "type").agg(F.max("n").alias("n"))


@query("signal_events", "SELECT event_id, type AS event_type, value, CAST((row_number() OVER (ORDER BY ts, event_id) - 1) // 1000 AS INTEGER) AS batch FROM signal_events")
def t06_events_past_cursor(spark, sf):
    """All events by batches of a thousand; the stream is stopped after three and goes on from its cursor, with what is left in one trigger."""
    events, base = f"{sf}/events.parquet", working_path(spark, "cursor")
    dealt_with(past_cursor(spark, events, 1000), base, 3)
    return dealt_with(past_cursor(spark, events, 1000, ahead=True), base, size=1000).select("event_id", "event_type", "value", "batch")


@query("signal_events", """SELECT event_id FROM signal_events WHERE (ts, event_id) > (SELECT (ts, event_id) FROM signal_events WHERE event_id = 77)""")
def t07_last_event_id(spark, sf):
    """A stream that begins after the event whose id a subscriber names."""
    one = E.signal_events(spark, sf).where("event_id = 77").select(F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).first()
    return dealt_with(past_cursor(spark, f"{sf}/events.parquet", after=(one["us"], 77), ahead=True), size=5000).select("event_id")


@query("signal_events", "SELECT event_id AS last_id, CAST(epoch_us(ts) AS BIGINT) AS last_us FROM signal_events WHERE event_id = 77")
def t07_cursor_of_event(spark, sf):
    return S.cursor_of(E.signal_events(spark, sf), 77).select("last_id", F.unix_micros(F.col("last_ts").cast("timestamp")).alias("last_us"))


@query("signal_events", "SELECT event_id % 200 AS event_id, min_by(source, row(ts, source)) AS agent_id FROM signal_events GROUP BY 1")
def t08_first_claim(spark, sf):
    claims = E.signal_events(spark, sf).select((F.col("event_id") % 200).alias("event_id"), F.col("source").alias("agent_id"), F.col("ts").alias("claimed_at"))
    return S.claimed(claims).select("event_id", "agent_id")


@query("signal_events", "SELECT event_id % 300 AS event_id, source AS agent_id, max_by(type, row(ts, type)) AS status FROM signal_events GROUP BY 1, 2")
def t09_receipts(spark, sf):
    acks = E.signal_events(spark, sf).select((F.col("event_id") % 300).alias("event_id"), F.col("source").alias("agent_id"), F.col("type").alias("status"), "ts")
    return D.latest(acks, ["event_id", "agent_id"], F.desc("ts"), F.desc("status")).select("event_id", "agent_id", "status")


@query("signal_events", f"SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'before' WHEN type = 'click' THEN 'now' END AS state FROM signal_events")
def t10_consume_all(spark, sf):
    before = F.when(F.col("event_id") % 5 == 0, F.col("ts"))
    done = S.consumed(E.signal_events(spark, sf), before, "me", EVENTS_AS_OF, "click")
    return done.select("event_id", F.when(F.col("consumed_by").isNotNull(), "now").when(F.col("consumed_at").isNotNull(), "before").alias("state"))


@query("signal_events", f"SELECT event_id FROM signal_events WHERE NOT (starts_with(type, 'error') AND ts < TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 7 DAY) AND NOT (starts_with(type, 'click') AND ts < TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 14 DAY)")
def t11_purge(spark, sf):
    return S.purged(E.signal_events(spark, sf), EVENTS_AS_OF, {"error": 7, "click": 14}).select("event_id")


@query("memories memory_tags", f"""
    WITH a AS (SELECT * FROM memories JOIN memory_tags USING (memory_id) WHERE status = 'active')
    SELECT * FROM (SELECT 'care_todo_due' AS type, memory_id AS key FROM a WHERE dimension_id = 'goals' AND updated_at < TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY ORDER BY updated_at, memory_id LIMIT 20)
    UNION ALL SELECT 'care_mood', memory_id FROM (SELECT * FROM a WHERE dimension_id = 'status' ORDER BY updated_at DESC, memory_id LIMIT 50) WHERE contains(content, 'the') AND NOT contains(content, '%%%')
    UNION ALL SELECT 'care_overwork', '2024-03-15' FROM (SELECT count(*) AS n FROM a WHERE dimension_id = 'focus' AND CAST(created_at AS DATE) = DATE '2024-03-15') WHERE n >= 1
    UNION ALL SELECT 'care_daily', '2024-03-15'""")  # fmt: skip
def t13_care_scan(spark, sf):
    return S.care_events(E.memories(spark, sf), E.memory_tags(spark, sf), AS_OF, ["the"], ["%%%"], busy=1).select("type", "key")


@query("signal_events", "SELECT source AS subscriber_id, max_by(event_id, row(ts, event_id)) AS last_id FROM signal_events GROUP BY 1")
def t14_subscribers(spark, sf):
    moved = E.signal_events(spark, sf).select(F.col("source").alias("subscriber_id"), F.col("event_id").alias("last_id"), "ts")
    return D.latest(moved, ["subscriber_id"], F.desc("ts"), F.desc("last_id")).select("subscriber_id", "last_id")


@query("messages raw_files", "SELECT file_id, count(*) AS fresh, max(seq) AS next_cursor FROM messages JOIN raw_files USING (file_id) WHERE seq > CASE WHEN CAST(file_id AS INT) % 5 = 0 THEN 0 ELSE last_refined_seq END GROUP BY 1")
def t17_incremental_refine(spark, sf):
    """A changed content hash replays a file from its start."""
    from lodestone.operators import refinement as L

    files = E.raw_files(spark, sf).withColumn("changed", F.col("file_id").cast("int") % 5 == 0)
    fresh = L.to_refine(E.messages(spark, sf), files)
    return fresh.groupBy("file_id").agg(F.count("*").alias("fresh"), F.max("seq").alias("next_cursor"))


@query("messages raw_files", "SELECT file_id, count(*) AS items, max(seq) AS last_refined_seq FROM messages JOIN raw_files USING (file_id) WHERE seq > last_refined_seq GROUP BY 1")
def t18_refine_on_append(spark, sf):
    """Messages are appended in several files, some of them twice; each is refined once, from its file's cursor on."""
    from lodestone.operators import refinement as L
    from lodestone.plans.refinement import DYNAMIC, echo
    from lodestone.session import working_path

    folder, m = working_path(spark, "appended"), E.messages(spark, sf)
    for part in (m.where("seq <= 2"), m.where("seq > 1 AND seq <= 5"), m.where("seq > 5")):
        part.coalesce(1).write.mode("append").parquet(folder)
    stream = S.messages_stream(spark, folder, "file_id string, seq int, role string, content string", 1)

    def refine(fresh):
        return L.extracted(L.answers(fresh.select("file_id", F.concat_ws(" ", F.lit("said:"), "content").alias("prompt")), echo), DYNAMIC)

    done = S.refined_on_append(stream, "refine", E.raw_files(spark, sf).select("file_id", "last_refined_seq"), refine)
    return done.groupBy("file_id").agg(F.sum("items").alias("items"), F.max("last_refined_seq").alias("last_refined_seq"))


@query()
def t19_token_bucket(spark, sf):
    """A wait depends on the waits before, so no SQL; tests compare it with a loop."""
    return S.throttled(E.signal_events(spark, sf).select("event_id", "source", "ts"), "source", 1 / 36000, 2.0)


@query("messages", "SELECT file_id, seq FROM messages WHERE seq <= 2 UNION ALL SELECT file_id, seq FROM messages WHERE seq > 2")
def t21_append_once(spark, sf):
    m = E.messages(spark, sf).select("file_id", "seq", F.concat_ws(":", "file_id", F.col("seq").cast("string")).alias("key"))
    return D.created_once(m.where("seq <= 2"), m, "key").select("file_id", "seq")
