"""Sorted pages and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page(df: DataFrame, sort: str, allowed: Sequence[str], key: str, order: str = "desc", number: int = 1, limit: int = 50, key_order: str = "", nulls_last: bool = False) -> DataFrame:
    """O-01 … O-12. A page in the order of a whitelisted column, ties by key; a top-k in Spark, not a full sort."""
    if sort not in allowed:
        raise ValueError(f"sort must be one of {', '.join(allowed)}")
    names = {"asc": "asc", "desc": "desc"}
    first = getattr(F.col(sort), names[order] + ("_nulls_last" if nulls_last else ""))()
    second = getattr(F.col(key), names[key_order or order])()
    return df.orderBy(first, second).offset((number - 1) * limit).limit(limit)


def envelope(items: DataFrame, all_rows: DataFrame, number: int, limit: int) -> DataFrame:
    """O-16. One row: the page's items, how many there are, and the total."""
    shown = items.agg(F.collect_list(F.struct("*")).alias("items"), F.count("*").alias("count"))
    return shown.crossJoin(all_rows.agg(F.count("*").alias("total"))).withColumns({"page": F.lit(number), "limit": F.lit(limit)})  # one row each


def default_sort(velocities: Sequence[str | None]) -> str:
    """O-13. The last update if all dimensions of a section are dynamic, else priority."""
    return "updated_at" if velocities and all(v == "dynamic" for v in velocities) else "priority"


def union_in_order(*parts: DataFrame) -> DataFrame:
    """U-01. All rows with the number of their part; columns that a part lacks are null."""
    out = parts[0].withColumn("part", F.lit(0))
    for k, p in enumerate(parts[1:], 1):
        out = out.unionByName(p.withColumn("part", F.lit(k)), allowMissingColumns=True)
    return out


def first_seen(key: str, *parts: DataFrame, order: Column | None = None, by: str | None = None) -> DataFrame:
    """U-02, U-03, V-17, V-18. Rows of all parts, each key once, from the first part that has it."""
    rows = union_in_order(*parts)
    keys = [by, key] if by else [key]
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("part", *([order] if order is not None else []))))
    return ranked.where("_n = 1").drop("_n")


def snapshot_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """U-06. (name, change): added, removed or changed, by content hash."""
    both = before.withColumnRenamed("digest", "old").join(after.withColumnRenamed("digest", "new"), "name", "full")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return both.select("name", change.alias("change")).where("change IS NOT NULL")


def distinct_contents(memories: DataFrame, *order: str) -> DataFrame:
    """U-08. One row of each trimmed content, the first in order."""
    w = Window.partitionBy(F.sha2(F.trim("content"), 256)).orderBy(*order)
    return memories.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def merged_sections(base: Sequence[dict], own: Sequence[dict]) -> list[dict]:
    """U-09. A template's sections over those it extends: the same title replaces in place, new ones follow."""
    by_title = {s["title"]: s for s in own}
    kept = [by_title.pop(s["title"], s) for s in base]
    return kept + [s for s in own if s["title"] in by_title]
