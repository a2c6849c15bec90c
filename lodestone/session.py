"""Session construction and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


#: Paths that each application wrote to its shared folder, and folders of local applications that name none.
_WRITTEN: dict[str, list[str]] = {}
_FOLDERS: dict[str, str] = {}


def local_session(cores: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A UTC session for tests and the benchmark; clusters bring their own."""
    os.environ.setdefault("PYSPARK_PYTHON", os.environ.get("PYSPARK_PYTHON", "python"))
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("LODESTONE_DRIVER_MEMORY", "6g"))
        .getOrCreate()
    )


#: Python workers live through many stages: large arrays that they free go back to the system at once.
WORKER_ENVIRONMENT = {"MALLOC_MMAP_THRESHOLD_": "4194304", "MALLOC_TRIM_THRESHOLD_": "16777216", "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def ship(spark: SparkSession) -> None:
    """Let Python workers started from another folder import this package, and keep them small."""
    env = spark.sparkContext.environment
    for name, value in WORKER_ENVIRONMENT.items():
        env.setdefault(name, value)
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


#: Rows and bytes of one Arrow batch: texts are long, and a worker holds a batch in several forms at once.
BATCH_ROWS, BATCH_BYTES = 500, 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Session settings of operators that send texts to Python: a worker's memory doesn't grow with its partition."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a local master gets a new temporary folder, as driver and executors are one process
    there; on a cluster only its own setting can name a folder that all of them see.
    """
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    context = spark.sparkContext
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _FOLDERS:
        _FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="lodestone-")
    return _FOLDERS[context.applicationId]


def working_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; ``clean`` removes it."""
    path = f"{shared_dir(spark)}/lodestone-{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clean(spark: SparkSession) -> int:
    """Remove what this application wrote to the shared folder, when no result that reads it is needed any more."""
    context = spark.sparkContext
    paths = _WRITTEN.pop(context.applicationId, [])
    for path in paths:
        where = context._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)
    return len(paths)


def materialize(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts lineage so that a lost executor costs no recomputation of what came before. The files stay
    until ``clean``, as results that read them are computed later.
    """
    spark = df.sparkSession
    path = working_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
