"""Signals: a batch form over tables and a Structured Streaming form of each stateful operator."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestone.functions.text import uuid5
from lodestone.operators.selection import moment
from lodestone.session import working_path

DAYS = {"anomaly": 30, "heartbeat": 7, "care": 7}


def since(events: DataFrame, ts: str | None = None, after_id: int | None = None, kind: str | None = None, limit: int = 100) -> DataFrame:
    """T-04, T-12. Events past a composite (time, id) cursor, oldest first."""
    out = events
    if ts is not None:
        past = F.col("ts") > moment(ts)
        out = out.where(past if after_id is None else past | ((F.col("ts") == moment(ts)) & (F.col("event_id") > after_id)))
    if kind is not None:
        out = out.where(F.col("type") == kind)
    return out.orderBy("ts", "event_id").limit(limit)


def pulled(events: DataFrame, cursors: DataFrame, limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """T-03. (events of each subscriber, its next cursor): the predicate comes before the limit.

    The cursor is a result to be stored once the events have been dealt with, so nothing is lost. Of days after a
    cursor's own, a subscriber meets the first ``limit`` events each, and only of as many days as it takes to have
    ``limit`` events, so what is joined grows with the subscribers and not with what lies ahead of them. The days
    and their sizes are one row, sent to all tasks.
    """
    from lodestone.operators.relations import top_per_group

    order = [F.asc("ts"), F.asc("event_id")]
    dated = events.where("ts IS NOT NULL").withColumn("_day", F.to_date("ts"))
    sizes = dated.groupBy("_day").agg(F.count("*").alias("n")).agg(F.sort_array(F.collect_list(F.struct("_day", "n"))).alias("_days"))
    own = F.to_date("last_ts")
    ahead = F.when(own.isNull(), F.col("_days")).otherwise(F.filter("_days", lambda d: d["_day"] > own))
    # the days ahead that begin before ``limit`` events of other days ahead have passed
    taken = F.aggregate(
        ahead,
        F.struct(F.lit(0).cast("long").alias("n"), F.array().cast("array<date>").alias("days")),
        lambda a, d: F.struct((a["n"] + d["n"]).alias("n"), F.when(a["n"] < limit, F.concat(a["days"], F.array(d["_day"]))).otherwise(a["days"]).alias("days")),
        lambda a: a["days"],
    )
    asked = cursors.select("subscriber_id", "last_ts", "last_id").crossJoin(F.broadcast(sizes))
    later = asked.select("subscriber_id", F.explode(taken).alias("_day"))
    firsts = top_per_group(dated, "_day", order, limit).join(later, "_day")
    past = (F.col("ts") > F.col("last_ts")) | ((F.col("ts") == F.col("last_ts")) & (F.col("event_id") > F.col("last_id")))
    same_day = dated.join(asked.select("subscriber_id", "last_ts", "last_id", own.alias("_day")), "_day").where(past)
    columns = [*events.columns, "subscriber_id"]
    found = top_per_group(firsts.select(*columns).unionByName(same_day.select(*columns)), "subscriber_id", order, limit)
    moved = found.groupBy("subscriber_id").agg(F.max(F.struct("ts", "event_id")).alias("last"))
    kept = cursors.join(moved, "subscriber_id", "left")
    return found, kept.select("subscriber_id", F.coalesce("last.ts", "last_ts").alias("last_ts"), F.coalesce("last.event_id", "last_id").alias("last_id"))


def replay(events: DataFrame, as_of: str, hours: int = 1) -> DataFrame:
    """T-05. The last hours' events, and one summary row of what is older."""
    start = moment(as_of) - F.make_dt_interval(hours=F.lit(hours))
    recent = events.where(F.col("ts") >= start).select(F.col("event_id").cast("string").alias("event_id"), "type", F.lit(1).cast("long").alias("n"))
    older = events.where(F.col("ts") < start).agg(F.count("*").alias("n")).where("n > 0")
    return recent.unionByName(older.select(F.lit("_summary").alias("event_id"), F.lit("_summary").alias("type"), "n"))


def cursor_of(events: DataFrame, event_id: int) -> DataFrame:
    """T-07. The (time, id) cursor that an event id stands for."""
    return events.where(F.col("event_id") == event_id).select(F.col("ts").alias("last_ts"), F.col("event_id").alias("last_id"))


def claimed(claims: DataFrame) -> DataFrame:
    """T-08. The first claimer of each event has it."""
    return claims.groupBy("event_id").agg(F.min(F.struct("claimed_at", "agent_id")).alias("c")).select("event_id", F.col("c.agent_id").alias("agent_id"), F.col("c.claimed_at").alias("claimed_at"))


def consumed(events: DataFrame, consumed_before: Column, by: str, as_of: str, kind: str | None = None) -> DataFrame:
    """T-10. All open events, of one kind or any, are consumed; what was consumed before stays."""
    wanted = F.lit(True) if kind is None else F.col("type") == kind
    at = F.when(consumed_before.isNotNull(), consumed_before).when(wanted, moment(as_of))
    return events.withColumn("consumed_at", at).withColumn("consumed_by", F.when(consumed_before.isNull() & wanted, by))


def purged(events: DataFrame, as_of: str, days: dict[str, int]) -> DataFrame:
    """T-11. Events within the time to live of their kind; other kinds stay."""
    out = events
    for kind, n in days.items():
        out = out.where(~(F.col("type").startswith(kind) & (F.col("ts") < moment(as_of) - F.make_dt_interval(F.lit(n)))))
    return out


def care_events(memories: DataFrame, tags: DataFrame, as_of: str, moods: list[str], technical: list[str], busy: int = 5, stale_days: int = 7) -> DataFrame:
    """T-13. (event_id, type, key) of the four derivations; equal keys give equal ids, so scans repeat safely."""
    active = memories.where("status = 'active'").join(tags, "memory_id")
    goals = active.where((F.col("dimension_id") == "goals") & (F.col("updated_at") < moment(as_of) - F.make_dt_interval(F.lit(stale_days)))).orderBy("updated_at", "memory_id").limit(20)
    recent = active.where("dimension_id = 'status'").orderBy(F.desc("updated_at"), "memory_id").limit(50)
    has = [F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.col("content"), w)) for words in (moods, technical)]
    day = as_of[:10]
    focus = active.where((F.col("dimension_id") == "focus") & (F.to_date("created_at") == F.lit(day).cast("date"))).agg(F.count("*").alias("n")).where(F.col("n") >= busy)
    daily = memories.sparkSession.createDataFrame([("care_daily", day)], "type string, key string")
    parts = [goals.select(F.lit("care_todo_due").alias("type"), F.col("memory_id").alias("key")), recent.where(has[0] & ~has[1]).select(F.lit("care_mood").alias("type"), F.col("memory_id").alias("key")), focus.select(F.lit("care_overwork").alias("type"), F.lit(day).alias("key")), daily]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("event_id", uuid5(F.concat_ws(":", "type", "key")))


def events_stream(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """T-06. A stream of the events in a folder; new files are new events."""
    schema = spark.read.parquet(path).schema
    glob = f"{path[:-1]}[{path[-1]}]"  # a pattern may stand for a file, a plain path only for a folder
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(glob)
    return rows.select("event_id", F.col("event_type").alias("type"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("source"), F.col("ts").cast("timestamp").alias("ts"), "value")


def drained(stream: DataFrame, name: str, mode: str = "append", each: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """T-15, T-16. Run a stream over all there is and return what it wrote; ``each`` turns a batch into what is written.

    A batch that is repeated after a failure replaces what it wrote before.
    """
    spark = stream.sparkSession
    base = working_path(spark, f"stream-{name}")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)

    def keep(batch: DataFrame, n: int) -> None:
        (batch if each is None else each(batch, n)).write.mode("overwrite").parquet(f"{base}/out/batch={n}")

    writer.foreachBatch(keep).start().awaitTermination()
    return spark.read.parquet(f"{base}/out").drop("batch")


def windowed_counts(stream: DataFrame, late: str = "1 day", width: str = "1 hour") -> DataFrame:
    """A-14 as a stream: counts of each type in windows, late events up to a bound included."""
    counted = stream.withWatermark("ts", late).groupBy(F.window("ts", width), "type").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), "type", "n")


def unique_events(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """T-02 as a stream."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def kept_times(times: list[int], width: int) -> list[int]:
    """Those of sorted times that tell for any later time whether one of them is at most ``width`` before it: two a width."""
    out: list[int] = []
    for t in times:
        while len(out) > 1 and t - out[-2] <= width:
            out.pop()
        out.append(t)
    return out


def with_suppression(stream: DataFrame, seconds: int = 1800, late: str = "1 day", buckets: int = 1024) -> DataFrame:
    """T-01 as a stream: whether an event follows one of its type and source within the time, across batches.

    An event is judged by what has come by then, in order of time within a batch. One that comes late is judged by
    the events before its own time, and doesn't change hints that were given; later than ``late`` behind the
    latest it is left out by the watermark. A key's state is a few times, and goes when the watermark has passed them.
    Keys share the state of their bucket, as there may be as many keys as events and a call for each would take most of the time.
    """
    width = seconds * 1_000_000
    key = ["type", "source"]

    def mark(bucket: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames), ignore_index=True)
        timed = rows["ts"].notna().to_numpy()
        fresh = rows[timed].assign(us=rows["ts"][timed].astype("datetime64[us]").astype("int64"), fresh=True)
        if state.exists:
            types, sources, times = state.get
            known = pd.DataFrame({"type": list(types), "source": list(sources), "us": list(times)})
            every = pd.concat([known.assign(event_id=0, fresh=False), fresh[[*key, "us", "event_id", "fresh"]]], ignore_index=True)
        else:
            every = fresh
        every = every.assign(key=every.groupby(key, dropna=False, sort=False).ngroup()).sort_values(["key", "us", "fresh", "event_id"])  # what is known before what comes
        own, us, new = every["key"].to_numpy(), every["us"].to_numpy(), every["fresh"].to_numpy(dtype=bool)
        hints = np.zeros(len(every), bool)
        hints[1:] = (own[1:] == own[:-1]) & (us[1:] - us[:-1] <= width)
        passed = state.getCurrentWatermarkMs()
        held = np.flatnonzero(us + width >= passed * 1000)
        kept: list[int] = []
        for part in np.split(held, np.flatnonzero(np.diff(own[held])) + 1):
            kept.extend(part if len(part) < 3 else part[np.searchsorted(us[part], kept_times(us[part].tolist(), width))])
        if kept:
            left = every.iloc[kept]
            plain = lambda c: [None if pd.isna(x) else x for x in left[c]]
            state.update((plain("type"), plain("source"), left["us"].tolist()))
            state.setTimeoutTimestamp(max(int(left["us"].max()) // 1000 + seconds * 1000, passed) + 1)
        elif state.exists:
            state.remove()
        yield pd.concat([pd.DataFrame({"event_id": every["event_id"].to_numpy()[new], "suppress_hint": hints[new]}), pd.DataFrame({"event_id": rows["event_id"].to_numpy()[~timed], "suppress_hint": False})])

    keyed = stream.withWatermark("ts", late).withColumn("_bucket", F.pmod(F.xxhash64(*key), F.lit(buckets))).groupBy("_bucket")
    return keyed.applyInPandasWithState(mark, "event_id long, suppress_hint boolean", "types array<string>, sources array<string>, times array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def messages_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 64) -> DataFrame:
    """T-18. A stream of the messages that are appended to a folder of Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def refined_on_append(stream: DataFrame, name: str, cursors: DataFrame, refine: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """T-18. (file_id, items, last_refined_seq) of each batch: ``refine`` gets the messages past their file's cursor.

    Cursors start from ``cursors`` (file_id, last_refined_seq) and move with the batches that were written, so a
    message that comes again is not refined again.
    """
    spark = stream.sparkSession
    folder = working_path(spark, f"cursors-{name}")
    shape = "file_id string, last_refined_seq int"
    cursors.select("file_id", F.col("last_refined_seq").cast("int").alias("last_refined_seq")).write.parquet(f"{folder}/batch=-1")

    def each(batch: DataFrame, n: int) -> DataFrame:
        before = spark.read.schema(f"{shape}, batch int").parquet(folder).where(F.col("batch") < n)
        known = before.groupBy("file_id").agg(F.max("last_refined_seq").alias("last_refined_seq"))
        fresh = batch.join(known, "file_id", "left").where(F.col("seq") > F.coalesce("last_refined_seq", F.lit(0))).drop("last_refined_seq").dropDuplicates(["file_id", "seq"])
        moved = fresh.groupBy("file_id").agg(F.max("seq").cast("int").alias("last_refined_seq"))
        items = refine(fresh).groupBy("file_id").agg(F.count("*").alias("items"))
        done = moved.join(items, "file_id", "left").select("file_id", F.coalesce("items", F.lit(0)).alias("items"), "last_refined_seq")
        done.select("file_id", "last_refined_seq").write.mode("overwrite").parquet(f"{folder}/batch={n}")
        return done

    return drained(stream, name, each=each)


def tokens_left(times: list[float], rate: float, burst: float) -> list[float]:
    """T-19. The wait of each request at a token bucket, in order of arrival."""
    held, at, waits = burst, None, []
    for t in times:
        now = t if at is None else max(t, at)
        held = burst if at is None else min(burst, held + (now - at) * rate)
        wait = 0.0 if held >= 1 else (1 - held) / rate
        held = held - 1 if held >= 1 else 0.0
        at = now + wait
        waits.append(at - t)
    return waits


def throttled(requests: DataFrame, key: str, rate: float, burst: float) -> DataFrame:
    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "event_id"])
        return pd.DataFrame({"event_id": pdf["event_id"], "wait": tokens_left([x.timestamp() for x in pdf["ts"]], rate, burst)})

    return requests.groupBy(key).applyInPandas(walk, "event_id long, wait double")
