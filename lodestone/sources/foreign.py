"""Stores that other programs keep: compressed event logs and SQLite files, read in partitions without the driver."""

from __future__ import annotations

import posixpath
import sqlite3
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import datasource as ds
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import Row, StructType

from lodestone.sources.session_files import Folder

#: Fixed value: the name of a session's log, in a folder of the session, in a folder of its workspace.
LOG_NAME = "session.jsonl.zstd"
#: Bytes of compressed logs that one task reads, beyond those of one file, and lines that it hands on at once.
LOG_BYTES, LOG_LINES = 32 << 20, 2000
#: Rows of an SQLite table that one task reads.
SQLITE_ROWS = 200_000


@dataclass
class Logs(InputPartition):
    names: list[str]


def log_lines(read: Iterable[bytes]) -> Iterator[tuple[str | None, str | None]]:
    """(line, fault) of a zstd stream of any number of frames; at most one fault, at the end, after all whole lines before it."""
    held, frame, open_ = b"", None, False
    try:
        for chunk in read:
            while chunk:
                if frame is None or frame.eof:
                    frame = zstandard.ZstdDecompressor().decompressobj()
                *whole, held = (held + frame.decompress(chunk)).split(b"\n")
                yield from ((x.decode("utf-8", "replace"), None) for x in whole if x.strip())
                chunk = frame.unused_data if frame.eof else b""
                open_ = not frame.eof
    except zstandard.ZstdError:
        yield None, "damaged"
        return
    if open_:
        yield None, "truncated"
    elif held.strip():
        yield held.decode("utf-8", "replace"), None


class LogReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path, schema

    def partitions(self) -> list[Logs]:
        """Files in lots of about LOG_BYTES."""
        folder, lots, size = Folder(self.path), [], LOG_BYTES
        for name in sorted(x for x in folder.files("") if posixpath.basename(x) == LOG_NAME):
            own = folder.fs.get_file_info(folder.at(name)).size
            if size + own > LOG_BYTES:
                lots.append(Logs([]))
                size = 0
            lots[-1].names.append(name)
            size += own
        return lots

    def read(self, partition: Logs) -> Iterator[pa.RecordBatch]:
        folder, schema = Folder(self.path), to_arrow_schema(self.schema)
        for name in partition.names:
            *_, workspace, session = ("", *posixpath.dirname(name).split("/"))[-2:]
            rows: list[tuple] = []
            with folder.fs.open_input_file(folder.at(name)) as f:
                for nth, (line, fault) in enumerate(log_lines(iter(lambda f=f: f.read(1 << 16), b""))):
                    rows.append((workspace, session, nth, line, fault))
                    if len(rows) == LOG_LINES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


@dataclass
class Written(WriterCommitMessage):
    """What a task has made under a temporary name, and the names that it gets."""

    moves: dict[str, str]


class _Renaming(DataSourceWriter):
    """Files get their names when the whole write has succeeded; until then readers don't see them."""

    path: str

    def commit(self, messages: list[Written | None]) -> None:
        folder = Folder(self.path)
        for m in messages:
            for made, name in m.moves.items() if m else ():
                folder.move(made, name)

    def abort(self, messages: list[Written | None]) -> None:
        folder = Folder(self.path)
        for m in messages:
            for made in m.moves if m else ():
                folder.fs.delete_file(folder.at(made))


class LogWriter(_Renaming):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[Row]) -> Written:
        folder, moves = Folder(self.path), {}
        for r in iterator:
            made = f"_{uuid.uuid4().hex}"
            folder.write(made, zstandard.compress("".join(f"{x}\n" for x in r["events"]).encode()))
            moves[made] = f"{r['workspace']}/{r['session']}/{LOG_NAME}"
        return Written(moves)


class EventLogs(DataSource):
    """``format("event_logs")``: the lines of all logs under a path, in order of their number; written from arrays of events.

    A log that ends early or is damaged gives its whole lines and a row with a ``fault`` and no event.
    """

    @classmethod
    def name(cls) -> str:
        return "event_logs"

    def schema(self) -> str:
        return "workspace string, session string, line long, event string, fault string"

    def reader(self, schema: StructType) -> LogReader:
        return LogReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> LogWriter:
        return LogWriter(self.options["path"])


@dataclass
class Range(InputPartition):
    name: str
    low: int
    high: int


_COMPARED = {ds.EqualTo: "=", ds.GreaterThan: ">", ds.GreaterThanOrEqual: ">=", ds.LessThan: "<", ds.LessThanOrEqual: "<="}
_CASTS = {"string": "TEXT", "int": "INTEGER", "bigint": "INTEGER", "double": "REAL", "binary": "BLOB"}


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class SqliteReader(DataSourceReader):
    def __init__(self, path: str, table: str, schema: StructType):
        self.path, self.table, self.columns = path, table, schema
        self.where: list[str] = []
        self.values: list = []

    def _own(self, name: str) -> str:
        return f"CAST({_quoted(name)} AS {_CASTS[self.columns[name].dataType.simpleString()]})"

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:  # noqa: N802
        """Comparisons of a column with plain values, as the cast values that Spark would see; others stay Spark's."""
        for f in filters:
            at = getattr(f, "attribute", ())
            plain = len(at) == 1 and at[0] in self.columns.names
            if plain and type(f) in _COMPARED and isinstance(f.value, str | int | float) and not isinstance(f.value, bool):
                self.where.append(f"{self._own(at[0])} {_COMPARED[type(f)]} ?")
                self.values.append(f.value)
            elif plain and isinstance(f, ds.In) and all(isinstance(v, str | int | float) for v in f.value):
                self.where.append(f"{self._own(at[0])} IN ({', '.join('?' * len(f.value))})")
                self.values += f.value
            elif plain and isinstance(f, ds.IsNull | ds.IsNotNull):
                self.where.append(f"{_quoted(at[0])} IS {'NOT ' * isinstance(f, ds.IsNotNull)}NULL")
            else:
                yield f

    def _open(self, name: str) -> sqlite3.Connection:
        folder = Folder(self.path)
        if folder.fs.type_name != "local":
            raise ValueError("SQLite files have to lie on a mounted file system")
        return sqlite3.connect(f"file:{folder.at(name)}?mode=ro", uri=True)

    def partitions(self) -> list[Range]:
        """Ranges of row ids, found from each file's index of them."""
        out = []
        for name in sorted(x for x in Folder(self.path).files("") if x.endswith(".db") and not posixpath.basename(x).startswith("_")):
            with self._open(name) as con:
                low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
            if low is not None:
                out += [Range(name, at, min(at + SQLITE_ROWS - 1, high)) for at in range(low, high + 1, SQLITE_ROWS)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(self.columns)
        where = " AND ".join(["rowid BETWEEN ? AND ?", *self.where])
        con = self._open(partition.name)
        con.text_factory = lambda raw: raw.decode("utf-8", "replace")
        rows = con.execute(f"SELECT {', '.join(self._own(n) for n in self.columns.names)} FROM {_quoted(self.table)} WHERE {where}", [partition.low, partition.high, *self.values])
        while lot := rows.fetchmany(5000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*lot, strict=True), schema.types, strict=True)], schema=schema)
        con.close()


class SqliteWriter(_Renaming):
    def __init__(self, path: str, table: str, schema: StructType):
        self.path, self.table, self.columns = path, table, schema

    def write(self, iterator: Iterator[Row]) -> Written:
        folder, made = Folder(self.path), f"_{uuid.uuid4().hex}.db"
        folder.fs.create_dir(folder.root, recursive=True)
        con = sqlite3.connect(folder.at(made))
        kinds = ", ".join(f"{_quoted(f.name)} {_CASTS[f.dataType.simpleString()]}" for f in self.columns)
        con.execute(f"CREATE TABLE {_quoted(self.table)} ({kinds})")
        con.executemany(f"INSERT INTO {_quoted(self.table)} VALUES ({', '.join('?' * len(self.columns))})", map(tuple, iterator))
        con.commit()
        con.close()
        return Written({made: made[1:]})


class SqliteRows(DataSource):
    """``format("sqlite_rows")``: option ``table``; the table's rows in all ``*.db`` files under a path, under a given schema.

    Values that SQLite holds under another type are cast by it. A write makes one file a task.
    """

    @classmethod
    def name(cls) -> str:
        return "sqlite_rows"

    def reader(self, schema: StructType) -> SqliteReader:
        return SqliteReader(self.options["path"], self.options["table"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> SqliteWriter:
        return SqliteWriter(self.options["path"], self.options["table"], schema)
