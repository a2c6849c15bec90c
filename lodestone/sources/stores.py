"""Stores as versioned Parquet snapshots, session files, and other sources and sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.text import html_title, to_markdown
from lodestone.session import small_batches
from lodestone.sources.foreign import EventLogs, SqliteRows
from lodestone.sources.session_files import SessionFiles

#: Fixed values of session files: the version of their format, a message's head, and the line that names a tool.
FORMAT_VERSION = 1
MESSAGE_HEAD = r"(?mdU)^#{1,2}\s+(\S+)\s+(user|assistant|tool|system)\s*$"
TOOL_LINE = r"(?dU)\A\*\*tool\*\*:\s*(\S+)"
FRONT = r"(?sd)\A---[ \t\r]*\n(.*?\n)??[ \t]*---[ \t\r]*(?:\n|\z)"


def open_store(spark: SparkSession, folder: str, tables: dict[str, str]) -> dict[str, DataFrame]:
    """S-01. Each table of a store with its fixed schema, empty if it hasn't been written."""
    out = {}
    for name, schema in tables.items():
        try:
            out[name] = spark.read.schema(schema).parquet(f"{folder}/{name}")
            out[name].schema  # noqa: B018
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            out[name] = spark.createDataFrame([], schema)
    return out


def row_of(df: DataFrame, key: str, value: str) -> DataFrame:
    """S-02."""
    return df.where(F.col(key) == value)


def parse_body(text: Column | str) -> Column:
    """S-04. array<struct<seq, timestamp, role, content, tool_name>> of messages: each begins at a head, with one # or two.

    What stands before the first head is no message. A tool's first line may name it. Contents lose
    the empty lines around them and nothing else.
    """
    text = F.col(text) if isinstance(text, str) else text
    heads = F.regexp_extract_all(text, F.lit(MESSAGE_HEAD), F.lit(0))
    parts = F.slice(F.split(text, MESSAGE_HEAD), 2, F.greatest(F.size(heads), F.lit(0)))

    def bare(part: Column) -> Column:
        return F.regexp_replace(part, r"\A\n+|\n+\z", "")

    def message(part: Column, i: Column) -> Column:
        head, said = F.element_at(heads, i + 1), bare(part)
        role = F.regexp_extract(head, MESSAGE_HEAD, 2)
        tool = F.when(role == "tool", F.nullif(F.regexp_extract(said, TOOL_LINE, 1), F.lit("")))
        rest = F.when(F.contains(said, F.lit("\n")), bare(F.regexp_replace(said, r"\A[^\n]*\n", ""))).otherwise("")
        return F.struct((i + 1).cast("int").alias("seq"), F.regexp_extract(head, MESSAGE_HEAD, 1).alias("timestamp"), role.alias("role"), F.when(tool.isNull(), said).otherwise(rest).alias("content"), tool.alias("tool_name"))

    return F.transform(parts, message)


def parse_session(text: Column | str) -> Column:
    """S-03. The messages of a session file's text, after its front matter."""
    return parse_body(F.regexp_replace(text, FRONT, ""))


def front_matter(text: Column | str, name: str) -> Column:
    """A field of the front matter without quotes, null if it isn't there."""
    found = F.regexp_extract(F.regexp_extract(text, FRONT, 1), rf"(?md)^{name}:[ \t]*(.*?)[ \t\r]*$", 1)
    return F.nullif(F.regexp_replace(found, r"^'(.*)'$|^\"(.*)\"$", "$1$2"), F.lit(""))


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """S-03, S-14. (file_id, session_key, folder, seq, timestamp, role, content, tool_name) of a folder of session files.

    Files that ``session_fault`` finds fault with are left out, and so are names that begin with _ or a dot.
    """
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md").select("value", F.element_at(F.split("_metadata.file_path", "/"), -2).alias("folder"))
    files = files.where(session_fault("value").isNull())
    return files.select(front_matter("value", "file_id").alias("file_id"), front_matter("value", "session_key").alias("session_key"), "folder", F.inline(parse_session("value")))


def message_block(first: Column) -> Column:
    """S-06. A message as a block; the first of a file has one #. Null content is empty."""
    content = F.coalesce("content", F.lit(""))
    tool = F.when(F.col("tool_name").isNotNull() & (F.col("role") == "tool"), F.concat(F.lit("**tool**: "), "tool_name", F.lit("\n\n"))).otherwise("")
    end = F.when((content == "") | F.endswith(content, F.lit("\n\n")), "").when(F.endswith(content, F.lit("\n")), "\n").otherwise("\n\n")
    return F.concat(F.when(first, "# ").otherwise("## "), "timestamp", F.lit(" "), "role", F.lit("\n"), tool, content, end)


def session_parts(messages: DataFrame) -> DataFrame:
    """(file_id, source_type, head, first, blocks): the front matter of each session, and its messages as text.

    ``blocks`` are to be appended to a file; a new file has ``first`` instead, whose first message has one #.
    ``session_key``, ``tool_name``, ``source_type`` and ``started_at`` are taken where ``messages`` has them and not null;
    messages without a ``file_id`` belong to no file and are left out.
    """
    messages = messages.where("file_id IS NOT NULL")
    for name, other in (("tool_name", F.lit(None).cast("string")), ("session_key", F.col("file_id")), ("source_type", F.lit("session")), ("started_at", F.col("timestamp"))):
        if name not in messages.columns:
            messages = messages.withColumn(name, other)
    blocks = messages.withColumn("block", F.struct("seq", message_block(F.lit(False)).alias("text"), message_block(F.lit(True)).alias("first")))
    files = blocks.groupBy("file_id", "source_type").agg(F.sort_array(F.collect_list("block")).alias("b"), F.coalesce(F.min("session_key"), "file_id").alias("key"), F.coalesce(F.min("started_at").cast("string"), F.lit("")).alias("at"))
    files = files.withColumn("source_type", F.coalesce("source_type", F.lit("session")))
    head = F.concat(F.lit(f"---\nformat_version: {FORMAT_VERSION}\nfile_id: '"), "file_id", F.lit("'\nsession_key: '"), "key", F.lit("'\nsource_type: "), "source_type", F.lit("\nstarted_at: '"), "at", F.lit("'\n---\n"))
    blocks = F.array_join("b.text", "")
    first = F.concat(F.col("b")[0]["first"], F.substr(blocks, F.length(F.col("b")[0]["text"]) + 1))
    return files.select("file_id", "source_type", head.alias("head"), first.alias("first"), blocks.alias("blocks"))


def session_text(messages: DataFrame) -> DataFrame:
    """S-05. (file_id, text): each session's messages as a file."""
    return session_parts(messages).select("file_id", F.concat("head", "first").alias("text"))


def write_sessions(messages: DataFrame, path: str, batch: str, source_type: str | None = None) -> None:
    """S-05 … S-07. Messages into session files, one a session, in the folder of its kind of source; files that exist grow.

    All files of a batch change or none, and a ``batch`` that has been written before changes nothing
    (``session_files``).
    """
    parts = session_parts(messages.withColumn("source_type", F.lit(source_type)) if source_type else messages)
    messages.sparkSession.dataSource.register(SessionFiles)
    parts.write.format(SessionFiles.name()).mode("append").option("batch", batch).save(path)


def session_fault(text: Column | str) -> Column:
    """S-08. Why a session file can't be used, null if it can."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    version = F.try_to_number(front_matter(text, "format_version"), F.lit("999999"))
    return (
        F.when(~text.rlike(r"(?d)\A---[ \t\r]*(\n|\z)"), "no front matter")
        .when(~text.rlike(FRONT), "front matter isn't closed")
        .when(front_matter(text, "file_id").isNull() | front_matter(text, "session_key").isNull(), "no file_id or session_key")
        .when(F.coalesce(version != FORMAT_VERSION, F.lit(True)), "unknown format_version")
    )


def ingest(sources: DataFrame) -> DataFrame:
    """S-09 … S-11. (source, kind, title, content, fault): text, file or web page by the look of the source.

    ``body`` is what was read at the source: nothing is fetched here.
    """
    small_batches(sources.sparkSession)
    web = F.col("source").rlike("^https?://")
    suffix = F.lower(F.regexp_extract("source", r"\.([A-Za-z0-9]+)$", 1))
    file = ~web & F.col("source").rlike(r"^[^\n]+\.[A-Za-z0-9]{1,8}$")
    kind = F.when(web, "url").when(file, "file").otherwise("text")
    fault = F.when(file & ~suffix.isin("md", "txt"), F.concat(F.lit("unsupported "), suffix)).when(F.coalesce(F.trim("body") == "", F.lit(True)), "empty")
    content = F.when(web, to_markdown("body")).otherwise(F.col("body"))
    return sources.select("source", kind.alias("kind"), F.when(web, html_title("body")).alias("title"), F.when(fault.isNull(), content).alias("content"), fault.alias("fault"))


#: Fixed value: names of workspaces that tests leave behind.
TEST_WORKSPACE = "Temp|cli-test"
EVENT = "ms long, type string, content array<struct<type:string,text:string>>"


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """S-12, S-14. (workspace, session, line, event, fault) of the event logs under a path, without test workspaces."""
    spark.dataSource.register(EventLogs)
    return spark.read.format(EventLogs.name()).load(path).where(~F.col("workspace").rlike(TEST_WORKSPACE))


def write_logs(logs: DataFrame, path: str) -> None:
    """Logs of (workspace, session, events), one file each."""
    logs.sparkSession.dataSource.register(EventLogs)
    logs.select("workspace", "session", "events").write.format(EventLogs.name()).mode("append").save(path)


def logged_events(lines: DataFrame) -> DataFrame:
    """(session, ms, type, content) of a log's lines; lines that are no JSON object, and faults, are left out."""
    return lines.where("event IS NOT NULL").select("session", F.from_json("event", EVENT).alias("e")).select("session", "e.*").where("type IS NOT NULL")


def read_foreign(spark: SparkSession, path: str, table: str, schema: str) -> DataFrame:
    """S-16. A table of the SQLite files under a path; simple filters are made there."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteRows)
    return spark.read.format(SqliteRows.name()).schema(schema).option("table", table).load(path)


def write_foreign(df: DataFrame, path: str, table: str) -> None:
    df.sparkSession.dataSource.register(SqliteRows)
    df.write.format(SqliteRows.name()).option("table", table).mode("append").save(path)


def foreign_messages(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """S-16. (file_id, seq, timestamp, role, content): another store's messages as ours.

    ``sessions`` have id and started_at, ``messages`` id, session_id, role, content and timestamp, in seconds. Blank
    messages are left out, and so are those of unknown sessions; a missing time is the session's.
    """
    at = F.coalesce(F.nullif(messages["timestamp"], F.lit(0.0)), sessions["started_at"])
    said = messages.where(F.trim("content") != "").join(sessions, messages["session_id"] == sessions["id"]).select(sessions["id"].alias("file_id"), messages["id"].alias("_id"), F.date_format(F.timestamp_seconds(at), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), "role", "content")
    return said.withColumn("seq", F.row_number().over(Window.partitionBy("file_id").orderBy("_id"))).drop("_id")


def event_messages(events: DataFrame) -> DataFrame:
    """S-13. Messages from an event log: user and assistant text parts and tool results."""
    texts = F.filter("content", lambda c: c["type"] == "text")
    said = F.array_join(F.transform(texts, lambda c: c["text"]), "\n")
    role = F.when(F.col("type") == "user", "user").when(F.col("type") == "assistant", "assistant").when(F.col("type") == "tool_result", "tool")
    return events.select("session", "ms", role.alias("role"), said.alias("content")).where((F.col("role").isNotNull()) & (F.col("content") != ""))


def not_imported(sessions: DataFrame, existing: DataFrame) -> DataFrame:
    """S-15. Sessions that neither form of the key is known of."""
    known = existing.select("session_key").distinct()
    return sessions.join(known, sessions["dir_key"] == known["session_key"], "left_anti").join(known, sessions["ms_key"] == known["session_key"], "left_anti")


def load_cases(spark: SparkSession, text: str) -> DataFrame:
    """S-17. Evaluation cases from YAML; a case without id, conversation or expectations is refused."""
    rows = []
    for case in yaml.safe_load(text)["cases"]:
        missing = [k for k in ("case_id", "conversation", "expected_l1") if not case.get(k)]
        if missing:
            raise ValueError(f"case {case.get('case_id')}: no {', '.join(missing)}")
        rows.append((case["case_id"], case.get("difficulty"), case["conversation"], [(x["content"], x.get("dimensions", [])) for x in case["expected_l1"]]))
    return spark.createDataFrame(rows, "case_id string, difficulty string, conversation string, expected_l1 array<struct<content:string,dimensions:array<string>>>")


def load_registry(spark: SparkSession, text: str, name: str, columns: Sequence[str]) -> DataFrame:
    """S-18. Rows of a registry in YAML."""
    rows = [[None if r.get(c) is None else str(r[c]) for c in columns] for r in yaml.safe_load(text)[name]]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns))


def imported_registry(stored: DataFrame, read: DataFrame) -> DataFrame:
    """S-19, D-01. The registry as read; ids that are stored keep whether they are active."""
    active = stored.select("id", F.col("active").alias("_active"))
    fresh = read.join(active, "id", "left").withColumn("active", F.coalesce("_active", F.lit(True))).drop("_active")
    return fresh.unionByName(stored.join(read, "id", "left_anti"), allowMissingColumns=True)


def cached_vectors(texts: DataFrame, cache: DataFrame, model: str, dims: int) -> DataFrame:
    """S-20. ``texts`` with their cached vectors, null where there is none of that model and size."""
    own = cache.where((F.col("model") == model) & (F.col("dims") == dims)).select("content_key", "embedding")
    return texts.withColumn("content_key", F.sha2("content", 256)).join(own, "content_key", "left").drop("content_key")


def filled_vectors(texts: DataFrame, cache: DataFrame, model: str, dims: int, producer: Callable[[pd.Series], pd.Series]) -> tuple[DataFrame, DataFrame]:
    """X-02. (texts with vectors and ``was_cached``, rows for the cache): ``producer`` is asked for what the cache lacks.

    It gets batches of distinct texts inside tasks and returns their vectors. The rows are a result to be
    stored; until they are, asking again produces them again.
    """
    found = cached_vectors(texts, cache, model, dims)
    wanted = found.where("embedding IS NULL AND content IS NOT NULL").select("content").distinct()

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(embedding=producer(f["content"]))

    made = wanted.mapInPandas(ask, "content string, embedding array<float>").select(F.sha2("content", 256).alias("content_key"), F.lit(model).alias("model"), "embedding", F.lit(dims).alias("dims"))
    missing = found.where("embedding IS NULL").drop("embedding").withColumn("content_key", F.sha2("content", 256))
    new = missing.join(made.select("content_key", "embedding"), "content_key", "left").drop("content_key").withColumn("was_cached", F.lit(False))
    return found.where("embedding IS NOT NULL").withColumn("was_cached", F.lit(True)).unionByName(new), made


def snapshot(tables: dict[str, DataFrame], folder: str, version: str) -> None:
    """S-21, S-25. A version of a store; readers name the version they want."""
    for name, df in tables.items():
        df.write.mode("errorifexists").option("compression", "zstd").parquet(f"{folder}/{version}/{name}")


def kept_snapshots(names: DataFrame, full: int = 7, monthly: int = 3) -> DataFrame:
    """S-22. The latest snapshots of each class."""
    w = Window.partitionBy("class").orderBy(F.desc("name"))
    most = F.when(F.col("class") == "full", full).when(F.col("class") == "monthly", monthly)
    return names.withColumn("_n", F.row_number().over(w)).where(most.isNull() | (F.col("_n") <= most)).drop("_n")


def cold_files(files: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """S-24."""
    return files.where(F.col("started_at") < F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days)))


def move_missing(source: DataFrame, target: DataFrame, *keys: str) -> DataFrame:
    """S-30. The target with the source's rows whose key it lacks; moving twice changes nothing."""
    return target.unionByName(source.dropDuplicates(list(keys)).join(target, list(keys), "left_anti").select(*target.columns))


def report_text(rows: Sequence[dict], title: str) -> str:
    """S-26. A small table of metrics as Markdown."""
    return "\n".join([f"# {title}", "", "| metric | value |", "|---|---|", *[f"| {r['metric']} | {r['value']} |" for r in rows]])


def to_page(result: DataFrame) -> DataFrame:
    """S-29. Ingested texts as wiki pages."""
    from lodestone.functions.text import page_id

    return result.where("fault IS NULL").select(page_id(F.col("title"), F.col("content")).alias("page_id"), F.coalesce("title", F.lit("untitled")).alias("title"), "content", F.col("kind").alias("source_type"))
