"""Profile summaries: a model's words for each owner's memories, kept for a time, and plain memories where there are none.

Defined results: a null owner is an owner of its own; a null status is active and a null time to live has no end; null content is
an empty line; an owner without memories that count is asked about with ``NOTHING``; an answer that is null or blank is
an error, and the summary from before stays. Repeated memories each have a place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.refinement import Model, answers
from lodestone.operators.relations import top_per_group
from lodestone.operators.selection import moment
from lodestone.session import materialize
from lodestone.sources.table_set import TableSet

SUMMARIES = "owner string, summary string, generated_at timestamp_ntz"
RUNS = "owner string, status string, at timestamp_ntz"
#: Dimensions that a profile is made of, how many memories are looked at, the priority that counts, hours of validity.
STATIC = ("identity", "family", "social", "values")
ASKED, SHOWN, LEAST, HOURS = 20, 10, 70, 48
NOTHING = "（暂无静态维度高优先级记忆）"
PLACE = "{{memories}}"


def basis(memories: DataFrame, tags: DataFrame, as_of: str, most: int, least: int = LEAST) -> DataFrame:
    """(owner, place, memory_id, content): an owner's ``most`` newest living memories of static dimensions, of which those of high priority stay.

    ``memories`` has owner, memory_id, content, priority, status, ttl_days and updated_at. Each task keeps ``most`` rows an
    owner before the shuffle, so an owner of any size costs no task more than that.
    """
    alive = F.col("ttl_days").isNull() | (F.col("updated_at") > moment(as_of) - F.make_dt_interval(F.col("ttl_days")))
    kept = memories.where(alive & (F.coalesce("status", F.lit("active")) != "rejected"))
    kept = kept.select("owner", "memory_id", "content", "priority", "updated_at").join(tags.where(F.col("dimension_id").isin(*STATIC)).select("memory_id"), "memory_id", "left_semi")
    newest = top_per_group(kept, "owner", [F.desc("updated_at"), F.asc("memory_id"), F.asc("content"), F.asc("priority")], most)
    place = F.struct((-F.unix_micros(F.col("updated_at").cast("timestamp"))).alias("age"), "memory_id", "content", "priority").alias("place")
    return newest.where(F.col("priority") >= least).select("owner", place, "memory_id", "content")


def prompts(memories: DataFrame, tags: DataFrame, template: str, as_of: str) -> DataFrame:
    """(owner, prompt) of every owner: the template with a line for each memory that counts."""
    line = F.concat(F.lit("- "), F.coalesce("content", F.lit("")))
    lines = basis(memories, tags, as_of, ASKED).groupBy("owner").agg(F.sort_array(F.collect_list(F.struct("place", line.alias("line"))))["line"].alias("lines"))
    owners, b = memories.select("owner").distinct().alias("a"), lines.alias("b")
    text = F.coalesce(F.array_join("b.lines", "\n"), F.lit(NOTHING))
    return owners.join(b, F.col("a.owner").eqNullSafe(F.col("b.owner")), "left").select("a.owner", F.replace(F.lit(template), F.lit(PLACE), text).alias("prompt"))


def refresh(store: TableSet, version: str, memories: DataFrame, tags: DataFrame, template: str, model: Model, as_of: str) -> bool:
    """L-10. Ask about every owner, and commit summaries and runs as one; a version that was committed asks nothing."""
    if store.committed(version):
        return store.commit(version)
    answered = materialize(answers(prompts(memories, tags, template, as_of), model).drop("prompt"), "summaries")
    good = F.coalesce(F.trim("answer") != "", F.lit(False))
    new = answered.where(good).select("owner", F.col("answer").alias("summary"), moment(as_of).alias("generated_at"))
    a, b = store.read("summaries", SUMMARIES).alias("a"), new.select("owner").alias("b")
    before = a.join(b, F.col("a.owner").eqNullSafe(F.col("b.owner")), "left_anti")
    runs = answered.select("owner", F.when(good, "ok").otherwise("error").alias("status"), moment(as_of).alias("at"))
    return store.commit(version, summaries=before.unionByName(new), runs=store.read("runs", RUNS).unionByName(runs))


def valid(stored: DataFrame, as_of: str, hours: int = HOURS) -> DataFrame:
    """Summaries that are not over ``hours`` old; what lacks its words or its time is none."""
    fresh = F.col("generated_at") >= moment(as_of) - F.make_dt_interval(F.lit(0), F.lit(hours))
    return stored.where(fresh & F.coalesce(F.col("summary") != "", F.lit(False)))


def served(stored: DataFrame, memories: DataFrame, tags: DataFrame, as_of: str) -> DataFrame:
    """(owner, kind, nth, text) of every owner: its valid summary, or its newest memories that count, by place from 1."""
    held = valid(stored, as_of)
    lacking = memories.alias("a").join(held.alias("b"), F.col("a.owner").eqNullSafe(F.col("b.owner")), "left_anti")
    plain = basis(lacking, tags, as_of, SHOWN).groupBy("owner").agg(F.sort_array(F.collect_list(F.struct("place", "content")))["content"].alias("texts"))
    plain = plain.select("owner", F.lit("static").alias("kind"), F.posexplode("texts").alias("nth", "text")).withColumn("nth", F.col("nth") + 1)
    return plain.unionByName(held.select("owner", F.lit("summary").alias("kind"), F.lit(0).alias("nth"), F.col("summary").alias("text")))
