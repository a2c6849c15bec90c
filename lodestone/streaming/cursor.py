"""A stream of events past a cursor: the offset is the (time, id) of the last event that was dealt with."""

from __future__ import annotations

import datetime
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

from lodestone.session import working_path
from lodestone.sources.session_files import Folder

#: Events of one batch.
BATCH = 100
#: Before all events.
BEGIN = {"us": -(1 << 62), "id": -(1 << 62)}
EPOCH = datetime.datetime(1970, 1, 1)
#: Rows that a task reads at once, and tasks of a trigger at most.
SLICE = 1 << 16
TASKS = 240


def _after(us: pa.Array, own: pa.Array, cursor: dict) -> pa.Array:
    past = pc.or_kleene(pc.greater(us, cursor["us"]), pc.and_kleene(pc.equal(us, cursor["us"]), pc.greater(own, cursor["id"])))
    return pc.and_(past, pc.and_(us.is_valid(), own.is_valid()))


def _micros(ts: pa.Array) -> pa.Array:
    return ts.cast(pa.timestamp("us")).cast(pa.int64())


class CursorReader(SimpleDataSourceStreamReader):
    """Row groups are read in order of their least time, as far as the batch needs: of a log in order of time, one or two."""

    def __init__(self, path: str, batch: int, after: dict):
        self.path, self.batch, self.after = path, batch, after
        self.held: tuple[tuple, pa.Table] | None = None  # the row group that was read last

    def initialOffset(self) -> dict:  # noqa: N802
        return self.after

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        found = self._past(start, None)
        end = start if not found.num_rows else {"us": found.column("_us")[-1].as_py(), "id": found.column("event_id")[-1].as_py()}
        return self._rows(found), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        return self._rows(self._past(start, end))

    def _rows(self, found: pa.Table) -> Iterator[tuple]:
        return iter(list(zip(*(c.to_pylist() for c in found.drop_columns("_us").columns), strict=True)))

    def _groups(self) -> list[tuple[int, int, str, int]]:
        """(least time, greatest time, file, number) of each row group; without statistics it can hold any time."""
        folder, out = Folder(self.path), []
        for name in folder.files("") if not self.path.endswith(".parquet") or folder.fs.get_file_info(folder.root).type == folder.kinds.Directory else [""]:
            place = folder.at(name) if name else folder.root
            if not place.endswith(".parquet"):
                continue
            meta = pq.read_metadata(place, filesystem=folder.fs)
            at = meta.schema.names.index("ts")
            for k in range(meta.num_row_groups):
                of = meta.row_group(k).column(at).statistics
                low, high = ((x - EPOCH) // datetime.timedelta(microseconds=1) for x in (of.min, of.max)) if of and of.has_min_max else (BEGIN["us"], -BEGIN["us"])
                out.append((low, high, place, k))
        return sorted(out)

    def _table(self, place: str, k: int) -> pa.Table:
        if self.held is None or self.held[0] != (place, k):
            with Folder(self.path).fs.open_input_file(place) as f:
                t = pq.ParquetFile(f).read_row_group(k)
            self.held = (place, k), t.append_column("_us", _micros(t.column("ts")))
        return self.held[1]

    def _past(self, start: dict, end: dict | None) -> pa.Table:
        """The events after ``start``: up to ``end``, or the next of a batch."""

        def after(t: pa.Table, cursor: dict) -> pa.ChunkedArray:
            return _after(t.column("_us"), t.column("event_id"), cursor)

        found: pa.Table | None = None
        for low, high, place, k in self._groups():
            if high < start["us"]:
                continue
            if end and low > end["us"] or not end and found is not None and found.num_rows == self.batch and low > found.column("_us")[-1].as_py():
                break
            t = self._table(place, k)
            t = t.filter(after(t, start) if end is None else pc.and_kleene(after(t, start), pc.invert(after(t, end))))
            found = (t if found is None else pa.concat_tables([found, t])).sort_by([("_us", "ascending"), ("event_id", "ascending")])
            found = found if end else found.slice(0, self.batch)
        return found if found is not None else pa.table({"_us": pa.array([], pa.int64()), "event_id": pa.array([], pa.int64())})


@dataclass
class RowGroups(InputPartition):
    """Of some row groups (file, number), the events after ``start`` and up to ``end``."""

    groups: list[tuple[str, int]]
    start: dict
    end: dict


class AheadReader(DataSourceStreamReader):
    """All events there are past the cursor in one trigger: each row group is read by a task, and the driver sees offsets only."""

    def __init__(self, path: str, after: dict):
        self.path, self.after = path, after

    def initialOffset(self) -> dict:  # noqa: N802
        return self.after

    def _slices(self, place: str, k: int, columns: list[str] | None = None) -> Iterator[pa.RecordBatch]:
        with Folder(self.path).fs.open_input_file(place) as f:
            yield from pq.ParquetFile(f).iter_batches(SLICE, row_groups=[k], columns=columns)

    def latestOffset(self) -> dict:  # noqa: N802
        """The last event: only row groups that may hold its time are looked into."""
        last = (self.after["us"], self.after["id"])
        for _, high, place, k in sorted(CursorReader(self.path, 1, self.after)._groups(), key=lambda g: -g[1]):
            if high < last[0]:
                break
            for b in self._slices(place, k, ["ts", "event_id"]):
                us, own = _micros(b.column("ts")), b.column("event_id")
                past = _after(us, own, {"us": last[0], "id": last[1]})
                us, own = us.filter(past), own.filter(past)
                if len(us):
                    most = pc.max(us).as_py()
                    last = (most, pc.max(own.filter(pc.equal(us, most))).as_py())
        return {"us": last[0], "id": last[1]}

    def partitions(self, start: dict, end: dict) -> list[RowGroups]:
        held = [(place, k) for low, high, place, k in CursorReader(self.path, 1, start)._groups() if high >= start["us"] and low <= end["us"]]
        each = -(-len(held) // TASKS) or 1
        return [RowGroups(held[k : k + each], start, end) for k in range(0, len(held), each)]

    def read(self, partition: RowGroups) -> Iterator[pa.RecordBatch]:
        for place, k in partition.groups:
            for b in self._slices(place, k):
                us, own = _micros(b.column("ts")), b.column("event_id")
                yield b.filter(pc.and_(_after(us, own, partition.start), pc.invert(pc.coalesce(_after(us, own, partition.end), False))))


class EventsPastCursor(DataSource):
    """``format("events_past_cursor")`` as a stream: option ``path`` of Parquet events with event_id and ts.

    Each batch has the next ``batch`` events by (ts, event_id), and an event comes in exactly one batch, over restarts
    as well: the offset that the query keeps is the cursor. A new query begins after the event that ``after_us`` and
    ``after_id`` name, or with the first. Events without a time or an id have no place in the order and are
    left out. No batch is larger than its limit, so it may pass through the driver, as this kind of source has it.

    A trigger costs some tenths of a second whatever it holds, so a long log takes hours by such batches. With the option ``ahead``
    a trigger has all events past the cursor, read by tasks, and ``dealt_with`` cuts them into batches. The offsets are
    the same, so a query may be stopped with one way of reading and go on with the other.
    """

    @classmethod
    def name(cls) -> str:
        return "events_past_cursor"

    def schema(self) -> StructType:
        return from_arrow_schema(pq.read_schema(CursorReader(self.options["path"], 1, BEGIN)._groups()[0][2]), prefer_timestamp_ntz=True)

    def _start(self) -> dict:
        return {k: int(self.options.get(f"after_{k}", v)) for k, v in BEGIN.items()}

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return AheadReader(self.options["path"], self._start()) if self.options.get("ahead") == "true" else super().streamReader(schema)

    def simpleStreamReader(self, schema: StructType) -> CursorReader:  # noqa: N802
        return CursorReader(self.options["path"], int(self.options.get("batch", BATCH)), self._start())


def past_cursor(spark: SparkSession, path: str, batch: int = BATCH, after: tuple[int, int] | None = None, ahead: bool = False) -> DataFrame:
    """T-06, T-07. The stream of events after ``after``, a time in microseconds and an id; ``ahead`` takes all there are in a trigger."""
    spark.dataSource.register(EventsPastCursor)
    reader = spark.readStream.format(EventsPastCursor.name()).option("batch", batch).option("ahead", ahead)
    for name, value in zip(("after_us", "after_id"), after or (), strict=False):
        reader = reader.option(name, value)
    return reader.load(path)


def numbered(rows: DataFrame, size: int, first: int, path: str) -> DataFrame:
    """``rows`` with their ``batch``, ``size`` each by (ts, event_id), from ``first`` on; ranges in order are written to ``path``.

    A row's place is its place in its range after the rows of the ranges before it, so no task holds more than a range.
    """
    spark = rows.sparkSession
    ordered = rows.repartitionByRange("ts", "event_id").sortWithinPartitions("ts", "event_id")
    ordered.withColumn("_row", F.monotonically_increasing_id()).write.mode("overwrite").parquet(path)
    held = spark.read.parquet(path).withColumn("_part", F.shiftright("_row", 33))
    starts, total = [], 0
    for r in sorted(held.groupBy("_part").agg(F.count("*").alias("n")).collect()):  # a row a range
        starts.append((r["_part"], total))
        total += r["n"]
    placed = held.join(F.broadcast(spark.createDataFrame(starts, "_part long, _start long")), "_part")
    place = F.col("_start") + F.col("_row").bitwiseAND((1 << 33) - 1)
    return placed.withColumn("batch", (F.floor(place / size) + first).cast("int")).select(*rows.columns, "batch")


def dealt_with(stream: DataFrame, base: str | None = None, batches: int | None = None, size: int | None = None) -> DataFrame:
    """The stream's events with the numbers of their batches, until no event is left or ``batches`` triggers have been; ``base`` goes on where it was.

    A trigger is a batch, or with ``size`` as many batches of so many events as it takes.
    """
    spark = stream.sparkSession
    base = base or working_path(spark, "cursor")

    def keep(batch: DataFrame, n: int) -> None:
        if batches is not None and n >= batches:
            raise StopIteration  # the batch isn't committed, and comes again
        if size:
            before = spark.read.parquet(f"{base}/out").where(F.col("trigger") < n).agg(F.max("batch")).first()[0] if n else None
            batch = numbered(batch, size, 0 if before is None else before + 1, f"{base}/ordered/trigger={n}")
        else:
            batch = batch.withColumn("batch", F.lit(n))
        batch.write.mode("overwrite").parquet(f"{base}/out/trigger={n}")

    query = stream.writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(processingTime="0 seconds").foreachBatch(keep).start()
    try:
        query.processAllAvailable()
    except Exception as e:
        if "StopIteration" not in str(e):
            raise
    finally:
        query.stop()
    return spark.read.parquet(f"{base}/out").drop("trigger")
