"""Bounded labelled samples and helpers for the classifiers of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import crc_of_id


#: Partitions of the bounded sample while a model is fit: so few that each step of an optimiser is one stage.
FIT_PARTITIONS = 4


def held_out() -> Column:
    """The contract's fold: crc32 of the id as text is divisible by 5."""
    return F.coalesce(crc_of_id() % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """(text, label, weight) of about ``per_class`` labelled documents of each class, outside the fold.

    Labels other than 0 and 1 are left out; of several labels of a document the greatest counts, once. Which
    documents are taken depends on a hash of their ids only. The weight of a class is the number
    of labelled documents that each taken one stands for. Only the labels taken are sent to all tasks,
    so their number is bounded by ``per_class``.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out())
    usable = usable.groupBy("doc_id").agg(F.max(label).cast("int").alias("label")).withColumn("u", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)))
    sizes = {r["label"]: r["n"] for r in usable.groupBy("label").agg(F.count("*").alias("n")).collect()}
    rate = F.lit(1.0)
    for k, n in sizes.items():
        rate = F.when(F.col("label") == k, F.lit(min(1.0, per_class / n))).otherwise(rate)
    taken = usable.where(F.col("u") < rate * float(1 << 30)).select("doc_id", "label", (1 / rate).alias("weight"))
    return docs.select("doc_id", "text").join(F.broadcast(taken), "doc_id").select("text", "label", "weight")
