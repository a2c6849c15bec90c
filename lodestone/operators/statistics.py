"""Aggregations over memories, files, runs and evaluation results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.selection import moment


def file_summary(files: DataFrame) -> DataFrame:
    """A-02."""
    by = [F.count_if(F.col("status") == s).alias(s) for s in ("new", "refined", "error", "archived")]
    return files.agg(F.count("*").alias("total"), *by, F.max("refined_at").alias("last_refined_at"))


def last_seen(files: DataFrame) -> DataFrame:
    """A-04. Blank agents are left out."""
    named = files.where(F.trim("agent_id") != "")
    return named.groupBy("agent_id").agg(F.max(F.coalesce("ended_at", "started_at")).alias("last_seen"))


def cost_by_period(runs: DataFrame, period: str = "weekly") -> DataFrame:
    """A-05. Runs, failures, memories and tokens of each period and stage; weeks start on Monday."""
    unit = {"daily": "day", "weekly": "week", "monthly": "month"}[period]
    at = F.date_trunc(unit, "started_at").cast("date").alias("period")
    return runs.groupBy(at, "stage").agg(
        F.count("*").alias("runs"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "error").alias("errors"),
        F.sum(F.coalesce("memories_count", F.lit(0))).alias("memories"), F.sum(F.coalesce("total_tokens", F.lit(0))).alias("tokens"),
    )


def grand_total(costs: DataFrame) -> DataFrame:
    """A-06."""
    return costs.agg(*[F.sum(c).alias(c) for c in ("runs", "ok", "errors", "memories", "tokens")])


def run_summary(runs: DataFrame, stage: str) -> DataFrame:
    """A-08. Each version and variant with its runs, errors and merged histogram of actions."""
    own = runs.where(F.col("stage") == stage)
    totals = own.groupBy("version", "variant").agg(F.count("*").alias("runs"), F.count_if(F.col("status") == "error").alias("errors"), F.sum(F.coalesce("memories_count", F.lit(0))).alias("memories"))
    actions = own.select("version", "variant", F.explode("action_counts").alias("action", "n")).groupBy("version", "variant", "action").agg(F.sum("n").alias("n"))
    merged = actions.groupBy("version", "variant").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("action", "n")))).alias("actions"))
    return totals.join(merged, ["version", "variant"], "left")


def memories_by_version(memories: DataFrame, stage: str) -> DataFrame:
    """A-09."""
    own = memories.where(F.col("prompt_version").startswith(f"{stage}:"))
    return own.groupBy(F.split_part("prompt_version", F.lit(":"), F.lit(2)).alias("version")).agg(F.count("*").alias("memories"), F.round(F.avg("priority"), 2).alias("avg_priority"))


def scene_alarm(n: Column, yellow: int, orange: int, red: int) -> Column:
    """A-12."""
    return F.when(n >= red, "red").when(n >= orange, "orange").when(n >= yellow, "yellow").otherwise("ok")


def duplicates(memories: DataFrame) -> DataFrame:
    """A-15. Contents that several memories have; grouped by a digest, so no content is shuffled whole."""
    return memories.groupBy(F.sha2("content", 256).alias("digest")).agg(F.count("*").alias("n"), F.min("memory_id").alias("first_id")).where("n > 1")


def recent_sessions(files: DataFrame, k: int) -> DataFrame:
    """A-16."""
    return files.groupBy("session_key").agg(F.max("started_at").alias("at")).orderBy(F.desc("at"), "session_key").limit(k)


def progress(files: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """A-22, A-23, F-16. Refined files and furthest place in the last hours; whether refinement stands still."""
    recent = F.col("refined_at") >= moment(as_of) - F.make_dt_interval(hours=F.lit(hours))
    age = F.unix_timestamp(moment(as_of).cast("timestamp")) - F.unix_timestamp(F.max("refined_at").cast("timestamp"))
    out = files.agg(F.count_if(recent).alias("refined"), F.max(F.when(recent, F.col("last_seq"))).alias("max_seq"), age.alias("age_sec"))
    return out.withColumn("stalled", F.coalesce(F.col("age_sec") > hours * 3600, F.lit(True)))


def histogram(df: DataFrame, bucket: Column, name: str = "bucket") -> DataFrame:
    """A-21, A-25, A-26."""
    return df.groupBy(bucket.alias(name)).agg(F.count("*").alias("n"))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def f1(df: DataFrame, *by: str) -> DataFrame:
    """A-27, A-28. Precision, recall and F1 from summed tp, fp and fn; 0 where nothing is counted."""
    sums = (df.groupBy(*by) if by else df).agg(*[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("tp", "fp", "fn")])
    out = sums.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def section_rates(expected: DataFrame, found: DataFrame) -> DataFrame:
    """A-30. Hit, wrong-entry and miss rates of (section, item) pairs."""
    both = expected.select("section", "item", F.lit(1).alias("e")).join(found.select("section", "item", F.lit(1).alias("f")), ["section", "item"], "full")
    n = both.agg(F.count_if(F.col("e").isNotNull() & F.col("f").isNotNull()).alias("hit"), F.count("e").alias("expected"), F.count("f").alias("found"))
    return n.select(ratio(F.col("hit"), F.col("expected")).alias("hit_rate"), ratio(F.col("found") - F.col("hit"), F.col("found")).alias("wrong_rate"), ratio(F.col("expected") - F.col("hit"), F.col("expected")).alias("miss_rate"))


def metric_changes(a: DataFrame, b: DataFrame) -> DataFrame:
    """A-39. (metric, a, b, change) of two sets of metrics; one that either lacks has no change."""
    return a.withColumnRenamed("value", "a").join(b.withColumnRenamed("value", "b"), "metric", "full").withColumn("change", F.col("b") - F.col("a"))


def gate_light(value: Column, green: float, yellow: float) -> Column:
    """A-34."""
    return F.when(value >= green, "green").when(value >= yellow, "yellow").otherwise("red")
