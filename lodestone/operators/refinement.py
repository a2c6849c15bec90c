"""From session messages to memories and scenes; what a model says is an input."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import clamped_priority, json_array, velocity
from lodestone.session import small_batches

ITEM = "struct<content:string,memory_type:string,priority:int,dimensions:array<string>,source_message_ids:array<int>>"
TYPES = ("persona", "episodic", "instruction")

#: A model: texts in, answers out, a batch at a time.
Model = Callable[[pd.Series], pd.Series]


def answers(prompts: DataFrame, model: Model, prompt: str = "prompt") -> DataFrame:
    """L-01, L-07, V-15. ``prompts`` with the model's answer; the model is called inside tasks, by batches."""

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(answer=model(f[prompt]))

    small_batches(prompts.sparkSession)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in prompts.schema)
    return prompts.mapInPandas(ask, f"{kinds}, answer string")


def extracted(answered: DataFrame, dynamic: list[str]) -> DataFrame:
    """L-02, F-37. Items of the answers with checked and defaulted fields; items without content go."""
    items = answered.select("file_id", F.posexplode(json_array("answer", ITEM)).alias("place", "item")).select("file_id", "place", "item.*")
    kind = F.when(F.col("memory_type").isin(*TYPES), F.col("memory_type")).otherwise("episodic")
    dims = F.coalesce("dimensions", F.array().cast("array<string>"))
    good = items.where(F.coalesce(F.trim("content") != "", F.lit(False)))
    return good.select("file_id", "place", F.trim("content").alias("content"), kind.alias("memory_type"), clamped_priority(F.col("priority")).alias("priority"), dims.alias("dimensions"), velocity(dims, dynamic).alias("time_velocity"), "source_message_ids")


def to_refine(messages: DataFrame, files: DataFrame) -> DataFrame:
    """T-17, L-03. Messages past their file's cursor, all of a file that ``changed``."""
    start = F.when(F.col("changed"), 0).otherwise(F.coalesce("last_refined_seq", F.lit(0)))
    return messages.join(files.select("file_id", start.alias("_start")), "file_id").where(F.col("seq") > F.col("_start")).drop("_start")


def occurred(items: DataFrame, messages: DataFrame, time: str = "timestamp") -> DataFrame:
    """F-17, F-18. Items with the last time of their source messages and a reference to the first."""
    ids = items.select("file_id", "place", F.explode("source_message_ids").alias("seq")).join(messages.select("file_id", "seq", F.col(time).alias("_at")), ["file_id", "seq"])
    last = ids.groupBy("file_id", "place").agg(F.max("_at").alias("occurred_at"))
    first = F.coalesce(F.try_element_at("source_message_ids", F.lit(1)), F.lit(0)).cast("string")
    return items.join(last, ["file_id", "place"], "left").withColumn("source_ref", F.concat_ws(":", "file_id", first))


def scene_batches(memories: DataFrame, by: str, size: int) -> DataFrame:
    """L-06, W-15."""
    n = F.row_number().over(Window.partitionBy(by).orderBy("memory_id"))
    return memories.withColumn("batch", F.floor((n - 1) / size).cast("int"))


def chosen_version(override: Column, bucket: Column, split: float, active: Column) -> Column:
    """L-09. The override, else the variant of a split that is on, else the active version."""
    return F.coalesce(override, F.when(F.lit(split) > 0, F.when(bucket < split * 100, "a").otherwise("b")), active)


def summary_basis(memories: DataFrame, least: int, k: int) -> DataFrame:
    """L-10. The k newest memories, of which those of high priority count: the limit comes first."""
    return memories.orderBy(F.desc("updated_at"), "memory_id").limit(k).where(F.col("priority") >= least)


def rounds(messages: DataFrame, least: int = 5) -> DataFrame:
    """L-11, A-16. Sessions of at least so many user turns."""
    return messages.where("role = 'user'").groupBy("file_id").agg(F.count("*").alias("rounds")).where(F.col("rounds") >= least)
