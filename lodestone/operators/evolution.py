"""Pages that grow by what sessions teach: choose sessions, ask a model, check its entries, and commit pages and runs as one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import json_array
from lodestone.operators.refinement import Model, answers
from lodestone.operators.selection import gate, moment
from lodestone.session import materialize
from lodestone.sources.table_set import TableSet

ENTRY = "struct<type:string,category:string,title:string,entry:string>"
PAGES = "page_id string, title string, category string, content string, tags array<string>, description string, author string, status string, updated_at timestamp_ntz"
RUNS = "session_key string, status string, action string, page_id string, error string"
#: What an entry may be, and the line before what is appended.
TYPES = ("append", "create")
MARK = "\n\n> 来源: evolve:%s | hash: %s\n%s"


def to_evolve(files: DataFrame, runs: DataFrame, limit: int | None) -> DataFrame:
    """A-16, L-11. (session_key, file_id, turn) of the latest file of up to ``limit`` of the newest sessions without a run.

    ``files`` has session_key, file_id and started_at. Three times ``limit`` sessions are looked at, nameless ones among them;
    without a limit all are.
    """
    latest = files.groupBy("session_key").agg(F.max(F.struct("started_at", "file_id")).alias("_last"))
    first = lambda rows, n: rows if n is None else rows.orderBy(F.desc("_last"), F.desc("session_key")).limit(n)
    newest = first(latest, limit and 3 * limit)
    fresh = first(newest.where("session_key <> ''").join(runs.select("session_key"), "session_key", "left_anti"), limit)
    order = F.struct((-F.unix_micros(F.col("_last.started_at").cast("timestamp"))).alias("at"), F.col("_last.file_id").alias("file_id"), "session_key")
    return fresh.select("session_key", F.col("_last.file_id").alias("file_id"), order.alias("turn"))


def checked_entries(answered: DataFrame) -> DataFrame:
    """P-26. (session_key, turn, place, category, title, body, reason): the entries of answers, with what is wrong with each."""
    rows = answered.select("session_key", "turn", F.posexplode(json_array("answer", ENTRY)).alias("place", "e")).where("e IS NOT NULL")
    filled = [F.coalesce(F.trim(f"e.{c}") != "", F.lit(False)) for c in ("category", "title", "entry")]
    reason = gate(F.col("e.type"), F.when(filled[0] & filled[1] & filled[2], "all"), F.col("e.entry"), TYPES)
    return rows.select("session_key", "turn", "place", *[F.trim(f"e.{c}").alias(n) for c, n in (("category", "category"), ("title", "title"), ("entry", "body"))], reason.alias("reason"))


def pages_after(pages: DataFrame, entries: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """D-18, D-19. (pages, placed) after good entries, by their order: placed has the page and action of each entry.

    An entry goes to the newest active page of its category and title, at its end and behind a line with its origin and hash; a
    page that has the hash already stays as it is. If there is no such page, the first entry becomes one, and those that
    follow are appended to it. A page without a status is active; its null content is empty.
    """
    order = F.struct("turn", "place")
    key = ["category", "title"]
    active = pages.where("coalesce(status, 'active') = 'active'").select(*key, "page_id", "updated_at")
    known = active.join(entries.select(*key).distinct(), key, "left_semi").groupBy(*key).agg(F.max_by("page_id", F.struct("updated_at", "page_id")).alias("_known"))
    firsts = entries.groupBy(*key).agg(F.min(F.struct("turn", "place", "body", "session_key")).alias("_first"))
    new_id = F.concat(F.lit("page-"), F.substring(F.sha2(F.concat_ws("\n", "title", "category", "_first.body"), 256), 1, 16))
    homes = firsts.join(known, key, "left").withColumn("page_id", F.coalesce("_known", new_id))
    creates = F.col("_known").isNull() & (F.col("turn") == F.col("_first.turn")) & (F.col("place") == F.col("_first.place"))
    placed = entries.join(homes, key).select("session_key", "turn", "place", "page_id", "body", F.when(creates, "created").otherwise("appended").alias("action"))

    author = F.concat(F.lit("evolve:"), F.col("_first.session_key"))
    body = F.col("_first.body")
    made = homes.where("_known IS NULL").select("page_id", *key, body.alias("content"), F.array(F.lit("skill"), F.lit("evolved")).alias("tags"), F.substring(body, 1, 100).alias("description"), author.alias("author"), F.lit("active").alias("status"), moment(as_of).alias("updated_at"))
    every = pages.unionByName(made, allowMissingColumns=True)
    digest = F.substring(F.sha2("body", 256), 1, 8)
    block = F.format_string(MARK, "session_key", digest, "body")
    blocks = placed.where("action = 'appended'").groupBy("page_id", digest.alias("_hash")).agg(F.min(F.struct(order.alias("order"), block.alias("block"))).alias("b"))
    held = F.contains(F.coalesce("content", F.lit("")), F.concat(F.lit("hash: "), "_hash"))
    fresh = every.select("page_id", "content").join(blocks, "page_id").where(~held)
    more = fresh.groupBy("page_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("b")), lambda b: b["block"]), "").alias("_more"))
    grown = F.col("_more").isNotNull()
    content = F.when(grown, F.concat(F.regexp_replace(F.coalesce("content", F.lit("")), r"(?U)\s+\z", ""), "_more")).otherwise(F.col("content"))
    out = every.join(more, "page_id", "left").withColumn("content", content).withColumn("updated_at", F.when(grown, moment(as_of)).otherwise(F.col("updated_at"))).drop("_more")
    return out, placed.drop("body")


def evolve(files: DataFrame, texts: DataFrame, pages: DataFrame, runs: DataFrame, model: Model, as_of: str, limit: int | None = 5, least: int = 5, longest: int = 6000) -> tuple[DataFrame, DataFrame]:
    """L-11. (pages, new runs) after a turn of self-evolution.

    ``files`` has session_key, file_id and started_at, ``texts`` file_id, content and its number of ``blocks``. A session of under
    ``least`` blocks, or without a text, is skipped and the model isn't asked; it gets the first ``longest`` letters of others.
    A run is done with the action and page of its last good entry, rejected with the first reason if no entry is good, done
    with ``noop`` if there is none, and an error if the model gives no answer. The answers are kept, so nothing is asked twice.
    """
    chosen = to_evolve(files, runs, limit).join(texts, "file_id", "left")
    enough = F.coalesce(F.col("blocks") >= least, F.lit(False)) & F.col("content").isNotNull()
    asked = chosen.select("session_key", "turn", enough.alias("enough"), F.substring("content", 1, longest).alias("prompt"))
    kept = materialize(asked.where("NOT enough").withColumn("answer", F.lit(None).cast("string")).unionByName(answers(asked.where("enough"), model)).drop("prompt"), "evolution")
    entries = materialize(checked_entries(kept.where("enough")), "evolution-entries")
    after, placed = pages_after(pages, entries.where("reason IS NULL").drop("reason"), as_of)
    last = placed.groupBy("session_key").agg(F.max_by(F.struct("action", "page_id"), "place").alias("_last"))
    refused = entries.where("reason IS NOT NULL").groupBy("session_key").agg(F.min_by("reason", "place").alias("_reason"))
    both = kept.join(last, "session_key", "left").join(refused, "session_key", "left")

    def by_case(skipped: str | None, silent: str | None, good: Column, bad: Column, none: str | None) -> Column:
        cases = F.when(~F.col("enough"), F.lit(skipped)).when(F.col("answer").isNull(), F.lit(silent))
        return cases.when(F.col("_last").isNotNull(), good).when(F.col("_reason").isNotNull(), bad).otherwise(F.lit(none))

    null = F.lit(None).cast("string")
    status = by_case("skipped", "error", F.lit("done"), F.lit("rejected"), "done")
    action = by_case("skipped", None, F.col("_last.action"), null, "noop")
    error = by_case(None, "no answer", null, F.col("_reason"), None)
    return after, both.select("session_key", status.alias("status"), action.alias("action"), F.col("_last.page_id").alias("page_id"), error.alias("error"))


def evolve_once(store: TableSet, version: str, files: DataFrame, texts: DataFrame, model: Model, as_of: str, **options: int | None) -> bool:
    """A turn over the store's pages and runs, committed as one under a name; false, and nothing asked, if that name has been."""
    if store.committed(version):
        return store.commit(version)
    runs = store.read("runs", RUNS)
    pages, new = evolve(files, texts, store.read("pages", PAGES), runs, model, as_of, **options)
    return store.commit(version, pages=pages, runs=runs.unionByName(new))
