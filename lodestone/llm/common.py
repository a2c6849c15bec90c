"""What the operators of this subpackage share."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import small_batches

def prepare(spark: SparkSession) -> None:
    """Session settings that the operators rely on."""
    small_batches(spark)


def crc_of_id(doc_id: str = "doc_id") -> Column:
    """crc32 of the id's decimal digits."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary"))


def partitions(df: DataFrame, least: int = 1) -> int:
    """Partitions for a shuffle of all texts of ``df``: at least twice those it is read in."""
    n = df.rdd.getNumPartitions()
    return max(least, 2 * n, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def range_bounds(df: DataFrame, key: str, parts: int) -> list[int]:
    """Values that cut a numeric column into about equal ranges; reads that column only."""
    if parts < 2:
        return []
    got = df.select(F.col(key).cast("double").alias("k")).approxQuantile("k", [i / parts for i in range(1, parts)], 0.2 / parts)
    return sorted({int(x) for x in got})


def range_of(bounds: list[int], key: Column) -> Column:
    """The range that a value lies in; nulls lie in the first."""
    at = np.array(bounds, np.float64)

    @F.pandas_udf("int")
    def bucket(v: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(at, v.fillna(-np.inf).to_numpy(np.float64), "right").astype(np.int32))

    return bucket(key.cast("double"))


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type) for f in schema], schema=schema)
