"""Which version of a prompt was active at a moment: runs as of a log of settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import bucket

#: What a setting changes: the active version, or whether runs are split between two.
ACTIVATE, SPLIT, UNSPLIT = "activate", "split", "unsplit"


def _latest(value: Column) -> Column:
    """The last value that isn't null, by time and number."""
    return F.max(F.when(value.isNotNull(), F.struct("at", "seq", value.alias("v"))))["v"]


def versions_at(runs: DataFrame, log: DataFrame) -> DataFrame:
    """D-30, L-09. ``runs`` (name, key, at, override, …) with the ``version`` that each one used.

    ``log`` has (name, at, seq, action, version, other, share): a version is made active, or runs are split between
    ``version``, for a share of them by their key's hash, and ``other``, until the split ends. Of settings of one moment the
    greatest ``seq`` counts, and it counts for runs of that moment. A run's own ``override`` comes first, then a split,
    then the active version; without any it is null. Null names and moments have no settings.

    No run meets more than one setting of a kind: both are sorted together by name and day, and each day
    begins with what the days before left, so no name, however many runs it has, is one group.
    """
    split = F.when(F.col("action") == SPLIT, F.struct(F.col("version").alias("a"), F.col("other").alias("b"), F.col("share").cast("double").alias("share")))
    none = F.when(F.col("action") == UNSPLIT, F.struct(F.lit(None).cast("string").alias("a"), F.lit(None).cast("string").alias("b"), F.lit(0.0).alias("share")))
    changes = log.where("name IS NOT NULL AND at IS NOT NULL").select("name", "at", F.col("seq").cast("long").alias("seq"), F.when(F.col("action") == ACTIVATE, F.col("version")).alias("active"), F.coalesce(split, none).alias("split"))
    changes = changes.withColumn("day", F.to_date("at"))
    left = changes.groupBy("name", "day").agg(_latest(F.col("active")).alias("active"), _latest(F.col("split")).alias("split"))
    dated = runs.withColumn("_day", F.to_date("at"))
    days = dated.where("name IS NOT NULL AND at IS NOT NULL").select("name", F.col("_day").alias("day")).distinct()
    before = Window.partitionBy("name").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    begins = left.join(days, ["name", "day"], "full").select("name", "day", F.last("active", True).over(before).alias("active"), F.last("split", True).over(before).alias("split"))
    held = F.struct(*[F.col(c) for c in runs.columns])
    nothing = {c: F.lit(None).cast(changes.schema[c].dataType) for c in ("at", "seq", "active", "split")}
    rows = [
        begins.select("name", "day", nothing["at"].alias("at"), F.lit(0).alias("_kind"), nothing["seq"].alias("seq"), "active", "split"),
        changes.select("name", "day", "at", F.lit(1).alias("_kind"), "seq", "active", "split"),
        dated.select("name", F.col("_day").alias("day"), F.col("at").cast(changes.schema["at"].dataType).alias("at"), F.lit(2).alias("_kind"), nothing["seq"].alias("seq"), nothing["active"].alias("active"), nothing["split"].alias("split"), held.alias("_run")),
    ]
    both = rows[0].unionByName(rows[1]).unionByName(rows[2], allowMissingColumns=True)
    # a day's first row is what was left before it; then by time, settings before runs
    w = Window.partitionBy("name", "day").orderBy(F.col("_kind") > 0, "at", "_kind", "seq").rowsBetween(Window.unboundedPreceding, 0)
    known = both.select("_kind", "_run", F.last("active", True).over(w).alias("_active"), F.last("split", True).over(w).alias("_split"), (F.col("name").isNotNull() & F.col("at").isNotNull()).alias("_known")).where("_kind = 2")
    share = F.when(F.col("_known"), F.col("_split.share"))
    side = F.when(share > 0, F.when(bucket(F.col("_run.key").cast("string")) < share * 100, F.col("_split.a")).otherwise(F.col("_split.b")))
    return known.select("_run.*", F.coalesce("_run.override", side, F.when(F.col("_known"), F.col("_active"))).alias("version"))
