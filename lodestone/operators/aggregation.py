"""Scenes from memories: batches in which what one batch decides is known to the next.

Each group (a session file, an agent) has scenes of its own. Its memories come in batches, and batch n + 1 sees the scenes that
batch n left, so there are as many rounds as the largest group has batches. A round takes the nth batch of all
groups at once; groups without one are left out, as their state is final. Every round's answers and results are written
to the shared folder before they are used: a model is asked once for each batch, whatever is computed again.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import repaired_json
from lodestone.operators import paging
from lodestone.operators.refinement import Model, answers, scene_batches
from lodestone.operators.selection import moment
from lodestone.operators.statistics import scene_alarm
from lodestone.operators.vectors import cosine
from lodestone.session import materialize, small_batches, working_path

ACTIONS = "array<struct<action:string,target_scene_id:string,merged_content:string,merged_from:array<string>,memory_ids:array<string>>>"
KINDS = ("update", "merge", "create")
STATE = "file_id string, scene_id string, title string, content string, heat long, status string, updated_at timestamp_ntz, vector array<double>"
OUTCOMES = "file_id string, place int, outcome string, scene_id string, memory_ids array<string>, before string, title string, content string, heat long"
ANSWERS = f"file_id string, ids array<string>, answer string, actions {ACTIONS}, turn int"
BAD = "actions IS NULL AND answer IS NOT NULL"
AGAIN = "\n\nThe last answer was no JSON array of actions. Answer with the array alone."


class Aggregated(NamedTuple):
    """What the batches left: the last state of all scenes, their former contents, their memories, and a row for each batch."""

    scenes: DataFrame
    versions: DataFrame
    links: DataFrame
    outcomes: DataFrame
    runs: DataFrame


def parsed_actions(answer: Column | str) -> Column:
    """The actions of an answer, after mending if need be; null unless all of them are sound."""
    text = F.regexp_extract(answer, r"(?s)(\[.*\])", 1)
    found = F.coalesce(F.from_json(text, ACTIONS), F.from_json(repaired_json(text), ACTIONS))
    sound = lambda a: F.coalesce(a["action"].isin(*KINDS) & (a["merged_content"] != ""), F.lit(False))
    return F.when(F.forall(found, sound), found)


def _embedded(scenes: DataFrame, embed: Model | None) -> DataFrame:
    """Scenes with vectors; only those that have none are sent to ``embed``."""
    if embed is None:
        return scenes

    def fill(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(vector=embed(f["content"].fillna("")))

    return scenes.where("vector IS NOT NULL").unionByName(scenes.where("vector IS NULL").mapInPandas(fill, scenes.schema))


def _count(actions: str, kind: str) -> Column:
    return F.coalesce(F.size(F.filter(actions, lambda a: a["action"] == kind)), F.lit(0))


def _first(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows of each file, with their rank."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("file_id").orderBy(*order))).where(F.col("rank") <= k)


def candidates(scenes: DataFrame, batch: DataFrame, embed: Model, vector_top: int = 30, heat_top: int = 20) -> DataFrame:
    """V-18. The active scenes of each file that a batch is shown: the nearest to its text first, then the warmest."""
    active = scenes.where("status = 'active'")
    said = F.array_join(F.transform("memories", lambda m: m["content"]), "\n")
    ids = F.array_join(F.transform("memories", lambda m: m["memory_id"]), " ")
    texts = batch.select("file_id", F.when(F.trim(said) == "", ids).otherwise(said).alias("content"), F.lit(None).cast("array<double>").alias("vector"))
    asked = _embedded(texts, embed).select("file_id", F.col("vector").alias("_asked"))
    near = _first(active.join(asked, "file_id").withColumn("_like", cosine("vector", "_asked")), vector_top, F.desc("_like"), F.asc("scene_id"))
    warm = _first(active, heat_top, F.desc("heat"), F.asc("scene_id"))
    shown = ["file_id", "scene_id", "title", "content", "rank"]
    return paging.first_seen("scene_id", near.select(*shown), warm.select(*shown), by="file_id")


class Answers:
    """The answers of all turns, written as they come; one without sound actions is asked for once more, and null is no answer."""

    def __init__(self, prompts: DataFrame, model: Model, path: str):
        self.spark, self.model, self.path = prompts.sparkSession, model, path
        self.kinds: set[str] = set()

    def _write(self, prompts: DataFrame, kind: str, turn: int) -> None:
        asked = answers(prompts, self.model).withColumn("actions", parsed_actions("answer")).drop("prompt")
        asked.write.option("compression", "zstd").parquet(f"{self.path}/{kind}/turn={turn}")
        self.kinds.add(kind)

    def _read(self, kind: str) -> DataFrame:
        if kind not in self.kinds:
            return self.spark.createDataFrame([], ANSWERS)
        return self.spark.read.schema(ANSWERS).parquet(f"{self.path}/{kind}")

    def ask(self, prompts: DataFrame, turn: int) -> DataFrame:
        self._write(prompts, "first", turn)
        wrong = self._read("first").where(F.col("turn") == turn).where(BAD)
        if not wrong.isEmpty():
            again = prompts.join(wrong.select("file_id"), "file_id", "left_semi")
            self._write(again.withColumn("prompt", F.concat("prompt", F.lit(AGAIN))), "second", turn)
        return self.all().where(F.col("turn") == turn)

    def all(self) -> DataFrame:
        """(file_id, ids, answer, actions, turn)."""
        return self._read("first").where(f"NOT ({BAD})").unionByName(self._read("second"))


def decisions_made(scenes: DataFrame, actions: DataFrame, turn: int) -> DataFrame:
    """D-11. What comes of the ``actions`` (file_id, place, a, ids) of one batch of each file, in their order.

    An update sets the content and warms by one; a merge archives its sources and makes a scene of their heat and one
    more; a merge of nothing creates. An update of a scene that isn't active, or not any more because an earlier action of the
    batch merged it, does nothing, and a source counts in the first merge that names it. An outcome has what its scene
    held ``before``. New ids follow from file, turn and place, so a repeated round makes the same ones.
    """
    key = ["file_id", "scene_id"]
    active = scenes.where("status = 'active'").select(*key, F.col("content").alias("_old"), F.col("heat").alias("_heat"))
    merges = (F.col("a.action") == "merge") & (F.coalesce(F.size("a.merged_from"), F.lit(0)) > 0)
    sources = F.when(F.col("a.action") == "update", F.array("a.target_scene_id")).when(merges, F.array_distinct("a.merged_from"))
    touches = actions.select("file_id", "place", F.explode(sources).alias("scene_id"), F.when(F.col("a.action") == "update", F.col("a.merged_content")).alias("content"), "ids", (F.col("a.action") == "update").alias("_update"))
    w = Window.partitionBy(*key)
    past = w.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    seen = touches.join(active, key).withColumn("_gone", F.min(F.when(~F.col("_update"), F.col("place"))).over(w)).where("place <= _gone OR _gone IS NULL")
    seen = seen.withColumn("before", F.coalesce(F.last("content", True).over(past), "_old")).withColumn("heat", F.col("_heat") + F.coalesce(F.count_if(F.col("_update")).over(past), F.lit(0)))
    none = F.array().cast("array<string>")
    touched = seen.select("file_id", "place", F.when(F.col("_update"), "updated").otherwise("archived").alias("outcome"), "scene_id", F.when(F.col("_update"), F.col("ids")).otherwise(none).alias("memory_ids"), "before", F.lit(None).cast("string").alias("title"), "content", "heat")

    made = actions.where("a.action <> 'update'").select("file_id", "place", F.col("a.merged_content").alias("content"), merges.alias("_merged"), "ids")
    warmth = seen.where("NOT _update").groupBy("file_id", "place").agg(F.sum("heat").alias("_sum"))
    scene_id = F.substring(F.sha2(F.concat_ws("|", "file_id", F.lit(turn).cast("string"), F.col("place").cast("string")), 256), 1, 32)
    heading = F.trim(F.regexp_extract("content", r"(?m)^[^\S\n]*#[^\S\n]+(.*)$", 1))
    named = F.concat(F.when(F.col("_merged"), "merged_").otherwise("scene_"), F.substring("scene_id", 1, 8))
    born = made.join(warmth, ["file_id", "place"], "left").withColumn("scene_id", scene_id).select(
        "file_id", "place", F.when(F.col("_merged"), "merged").otherwise("created").alias("outcome"), "scene_id", F.col("ids").alias("memory_ids"), F.lit(None).cast("string").alias("before"),
        F.when(heading != "", heading).otherwise(named).alias("title"), "content", (F.coalesce("_sum", F.lit(0)) + 1).alias("heat"),
    )
    return touched.unionByName(born)


def applied(scenes: DataFrame, outcomes: DataFrame, as_of: str) -> DataFrame:
    """The scenes after the outcomes of a batch; those whose content is new have no vector."""
    key, now, null = ["file_id", "scene_id"], moment(as_of), F.lit(None).cast("array<double>").alias("vector")
    updated = F.col("outcome") == "updated"
    changes = outcomes.where("outcome IN ('updated', 'archived')").groupBy(*key).agg(F.count_if(updated).alias("_more"), F.max_by(F.when(updated, F.col("content")), F.when(updated, F.col("place"))).alias("_new"), F.bool_or(~updated).alias("_gone"))
    after = scenes.join(changes, key, "left").select(
        *key, "title", F.coalesce("_new", "content").alias("content"), (F.col("heat") + F.coalesce("_more", F.lit(0))).alias("heat"), F.when(F.col("_gone"), "archived").otherwise(F.col("status")).alias("status"),
        F.when(F.col("_gone").isNotNull(), now).otherwise(F.col("updated_at")).alias("updated_at"), F.when(F.col("_new").isNull(), F.col("vector")).alias("vector"),
    )
    born = outcomes.where("outcome IN ('created', 'merged')").select(*key, "title", "content", "heat", F.lit("active").alias("status"), now.alias("updated_at"), null)
    return after.unionByName(born)


def aggregate(memories: DataFrame, scenes: DataFrame, model: Model, as_of: str, size: int, embed: Model | None = None, vector_top: int = 30, heat_top: int = 20, newest: int = 50) -> Aggregated:
    """L-06. The scenes of each file after all its memories (file_id, memory_id, content), ``size`` at a time.

    The model gets JSON of the batch's memories and of scenes: with ``embed`` those of ``candidates`` before each batch, without
    it the ``newest`` ones of the start. Its answer is an array of actions. A batch that is twice
    answered wrongly changes nothing, its run is an error, and the file goes on; a null answer (no model) ends the file's turns. An
    action without memory_ids is about the whole batch. Memories of no file are those of the file ``unknown``; null contents are
    empty, and repeated memory ids of a file count once. Files without memories keep their scenes.
    """
    spark = memories.sparkSession
    small_batches(spark)
    given = scenes.select(F.coalesce("file_id", F.lit("unknown")).alias("file_id"), "scene_id", "title", "content", F.col("heat").cast("long").alias("heat"), "status", "updated_at", F.lit(None).cast("array<double>").alias("vector"))
    rows = memories.where("memory_id IS NOT NULL").select(F.coalesce("file_id", F.lit("unknown")).alias("file_id"), "memory_id", F.coalesce("content", F.lit("")).alias("content"))
    rows = rows.repartition("file_id").groupBy("file_id", "memory_id").agg(F.min("content").alias("content"))  # one shuffle, also for the window
    batches = materialize(scene_batches(rows, "file_id", size), "scene-batches", "zstd")
    turns = batches.groupBy("file_id").agg((F.max("batch") + 1).alias("turns"))
    state = materialize(_embedded(given, embed), "scenes")
    start = state
    listing = None if embed else _first(start.where("status = 'active'"), newest, F.desc("updated_at"), F.asc("scene_id")).select("file_id", "scene_id", "title", "content", "rank", F.lit(0).alias("part"))
    path = working_path(spark, "scene-rounds")
    said = Answers(batches, model, path)
    last_turn = -1
    for turn in range(batches.agg(F.coalesce(F.max("batch") + 1, F.lit(0))).first()[0]):
        live = state.join(turns.where(F.col("turns") > turn), "file_id", "left_semi")
        batch = batches.where(F.col("batch") == turn).groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("memory_id", "content"))).alias("memories"))
        silent = said.all().where((F.col("turn") < turn) & F.col("answer").isNull())
        asked = batch.join(silent, "file_id", "left_anti")
        found = listing if embed is None else candidates(live, asked, embed, vector_top, heat_top)
        lists = found.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("part", "rank", "scene_id", "title", "content"))).alias("_found"))
        shown = F.transform(F.coalesce("_found", F.array()), lambda s: F.struct(s["scene_id"].alias("scene_id"), s["title"].alias("title"), s["content"].alias("content")))
        prompts = asked.join(lists, "file_id", "left").select("file_id", F.transform("memories", lambda m: m["memory_id"]).alias("ids"), F.to_json(F.struct("memories", shown.alias("scenes"))).alias("prompt"))
        answered = said.ask(prompts, turn)
        named = F.filter(F.coalesce("a.memory_ids", F.array().cast("array<string>")), lambda m: F.coalesce(m != "", F.lit(False)))
        actions = answered.select("file_id", "ids", F.posexplode("actions").alias("place", "a")).select("file_id", "place", "a", F.when(F.size(named) > 0, named).otherwise(F.col("ids")).alias("ids"))
        decisions_made(live, actions, turn).write.parquet(f"{path}/outcomes/turn={turn}")
        outcomes = spark.read.schema(OUTCOMES).parquet(f"{path}/outcomes/turn={turn}")
        _embedded(applied(live, outcomes, as_of), embed).write.parquet(f"{path}/scenes/turn={turn}")
        state = spark.read.schema(STATE).parquet(f"{path}/scenes/turn={turn}")
        last_turn = turn

    def written(part: str, schema: str) -> DataFrame:
        if last_turn < 0:
            return spark.createDataFrame([], f"{schema}, turn int")
        return spark.read.schema(f"{schema}, turn int").parquet(f"{path}/{part}")

    last = written("scenes", STATE).join(turns, "file_id").where("turn = turns - 1")
    untouched = start.join(turns, "file_id", "left_anti")
    outcomes = written("outcomes", OUTCOMES)
    links = outcomes.select("file_id", "scene_id", F.explode("memory_ids").alias("memory_id")).distinct()
    reason = F.when(F.col("outcome") == "updated", "update").when(F.col("outcome") == "archived", "merge")
    versions = outcomes.where(reason.isNotNull()).select("file_id", "scene_id", F.col("before").alias("content"), reason.alias("reason"), moment(as_of).alias("version_at"))
    status = F.when(F.col("answer").isNull(), "unavailable").when(F.col("actions").isNull(), "error").otherwise("ok")
    runs = said.all().select("file_id", status.alias("status"), *[_count("actions", kind).alias(kind) for kind in KINDS], F.col("turn").alias("batch"))
    return Aggregated(last.select(*untouched.columns).unionByName(untouched).drop("vector"), versions, links, outcomes.select("file_id", "turn", "place", "outcome", "scene_id"), runs)


def finalised(done: Aggregated, memories: DataFrame, as_of: str, yellow: int = 150, orange: int = 180, red: int = 200) -> tuple[DataFrame, DataFrame]:
    """L-05. (events, alarm) after an aggregation: for each file what became of its scenes and how many memories it has, and the level that the number of active scenes calls for."""
    kinds = ("created", "updated", "merged", "archived")
    lists = done.outcomes.groupBy("file_id").agg(*[F.transform(F.sort_array(F.collect_list(F.when(F.col("outcome") == k, F.struct("turn", "place", "scene_id")))), lambda s: s["scene_id"]).alias(k) for k in kinds])
    failed = done.runs.groupBy("file_id").agg(F.count_if(F.col("status") != "ok").alias("failed"))
    scenes = failed.join(lists, "file_id", "left").select("file_id", F.lit("l2").alias("source"), F.to_json(F.struct("file_id", *[F.coalesce(k, F.array().cast("array<string>")).alias(k) for k in kinds], "failed")).alias("payload"))
    counts = memories.groupBy(F.coalesce("file_id", F.lit("unknown")).alias("file_id")).agg(F.count_distinct("memory_id").alias("memories_count"))
    refined = counts.select("file_id", F.lit("refine").alias("source"), F.to_json(F.struct("file_id", "memories_count")).alias("payload"))
    events = scenes.unionByName(refined).select(F.lit("memory_updated").alias("type"), "source", "file_id", "payload", moment(as_of).alias("ts"))
    active = done.scenes.agg(F.count_if(F.col("status") == "active").alias("scenes"))
    return events, active.withColumn("level", scene_alarm(F.col("scenes"), yellow, orange, red))
