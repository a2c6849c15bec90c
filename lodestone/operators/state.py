"""State transitions: a new state from an old one and actions, never in place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators import ranking
from lodestone.operators.selection import expired, moment


def upsert(state: DataFrame, changes: DataFrame, key: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """D-01, D-08, D-16. Rows of ``changes`` over those of ``state``; null changes, and ``keep``, leave the old value."""
    a, b = state.alias("a"), changes.dropDuplicates(list(key)).alias("b")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s

    def column(c: str) -> Column:
        old = F.col(f"a.{c}")
        if c not in changes.columns:
            return old.alias(c)
        new = F.col(f"b.{c}")
        return (F.coalesce(old, new) if c in keep or c in key else F.coalesce(new, old)).alias(c)

    return a.join(b, condition, "full").select(*[column(c) for c in state.columns])


def replaced(state: DataFrame, rows: DataFrame, *key: str) -> DataFrame:
    """D-04, V-16."""
    return state.join(rows.select(*key).distinct(), list(key), "left_anti").unionByName(rows.select(*state.columns))


def latest(rows: DataFrame, key: Sequence[str], *order: Column) -> DataFrame:
    """D-21, D-22, D-25, T-09, T-14. The last row of each key in an append-only log."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def rejected(memories: DataFrame, actions: DataFrame, as_of: str) -> DataFrame:
    """D-03. Apply (memory_id, reason): a reason rejects, none restores what was rejected."""
    a = actions.dropDuplicates(["memory_id"]).withColumn("_acted", F.lit(True))
    both = memories.join(a, "memory_id", "left")
    reject, restore = F.col("_acted") & F.col("reason").isNotNull(), F.col("_acted") & F.col("reason").isNull() & (F.col("status") == "rejected")
    out = both.withColumn("rejected_at", F.when(reject, moment(as_of)))
    return out.withColumn("status", F.when(reject, "rejected").when(restore, "active").otherwise(F.col("status"))).drop("_acted").withColumnRenamed("reason", "reject_reason")


def updated_content(memories: DataFrame, changes: DataFrame, as_of: str, bump: bool = True) -> DataFrame:
    """D-05."""
    new = changes.select("memory_id", F.col("content").alias("_content"))
    both = memories.join(new, "memory_id", "left")
    at = F.when(F.col("_content").isNotNull(), moment(as_of)).otherwise(F.col("updated_at")) if bump else F.col("updated_at")
    return both.withColumn("updated_at", at).withColumn("content", F.coalesce("_content", "content")).drop("_content")


def archived(memories: DataFrame, tags: DataFrame, moves: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """D-06. (memories, tags, archive) after (memory_id, superseded_by) are moved with their children."""
    gone = moves.dropDuplicates(["memory_id"])
    archive = memories.join(gone, "memory_id").withColumn("archived_at", moment(as_of))
    return memories.join(gone, "memory_id", "left_anti"), tags.join(gone, "memory_id", "left_anti"), archive


def counted(stats: DataFrame, hits: DataFrame) -> DataFrame:
    """D-07. Recall counters after some injections (memory_id, at)."""
    more = hits.groupBy("memory_id").agg(F.count("*").alias("recall_count"), F.max("at").alias("last_injected_at"))
    return stats.unionByName(more).groupBy("memory_id").agg(F.sum("recall_count").alias("recall_count"), F.max("last_injected_at").alias("last_injected_at"))


def resolved(memories: DataFrame, decisions: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """D-09, L-04. (memories, archive) after decisions about new memories.

    ``decisions`` has new_id, content, priority, action and old_id: ``store`` adds, ``skip`` doesn't,
    ``update`` and ``merge`` add and archive the old one. Decisions are keyed by the new memory, not by
    its place in a batch, and report just what was archived.
    """
    added = decisions.where(F.col("action").isin("store", "update", "merge"))
    replaced_ids = added.where("old_id IS NOT NULL").groupBy(F.col("old_id").alias("memory_id")).agg(F.min("new_id").alias("superseded_by"))
    archive = memories.join(replaced_ids, "memory_id").withColumn("archived_at", moment(as_of))
    # what a merge replaces may be newer than the merge itself
    newest = memories.join(added.where("action = 'merge'").select(F.col("old_id").alias("memory_id"), "new_id"), "memory_id").groupBy("new_id").agg(F.max("occurred_at").alias("occurred_at"))
    fresh = added.join(newest, "new_id", "left").select(F.col("new_id").alias("memory_id"), "content", "priority", F.lit("active").alias("status"), moment(as_of).alias("updated_at"), "occurred_at")
    kept = memories.join(replaced_ids, "memory_id", "left_anti").select(*fresh.columns)
    return kept.unionByName(fresh), archive


def rule_decisions(new: DataFrame, memories: DataFrame, prefix: int = 20) -> DataFrame:
    """Decisions without a model: equal content is skipped, an equal beginning updates, all else is stored."""
    same = memories.groupBy(F.sha2("content", 256).alias("_key")).agg(F.min("memory_id").alias("_same"))
    begin = memories.groupBy(F.substring("content", 1, prefix).alias("_begin")).agg(F.min("memory_id").alias("_near"))
    both = new.withColumn("_key", F.sha2("content", 256)).withColumn("_begin", F.substring("content", 1, prefix)).join(same, "_key", "left").join(begin, "_begin", "left")
    action = F.when(F.col("_same").isNotNull(), "skip").when(F.col("_near").isNotNull(), "update").otherwise("store")
    return both.select(F.col("memory_id").alias("new_id"), "content", "priority", action.alias("action"), F.when(action == "update", F.col("_near")).alias("old_id"))


def scenes_after(scenes: DataFrame, actions: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """D-11, D-12. (scenes, versions) after updates, merges and creations.

    ``actions`` has scene_id, action, title and into: an update warms a scene by one, a merge archives it
    and adds its heat to the scene it goes into, a creation starts at heat 1. Touched scenes leave a version.
    """
    a = actions.groupBy("scene_id").agg(F.count_if(F.col("action") == "update").alias("_up"), F.max(F.when(F.col("action") == "merge", F.col("into"))).alias("_into"))
    gained = scenes.join(actions.where("action = 'merge'").select("scene_id", "into"), "scene_id").groupBy(F.col("into").alias("scene_id")).agg(F.sum("heat").alias("_heat"))
    both = scenes.join(a, "scene_id", "left").join(gained, "scene_id", "left")
    touched = (F.coalesce("_up", F.lit(0)) > 0) | F.col("_into").isNotNull() | F.col("_heat").isNotNull()
    versions = both.where(touched).select("scene_id", "title", "heat", moment(as_of).alias("version_at"))
    after = both.withColumn("heat", F.col("heat") + F.coalesce("_up", F.lit(0)) + F.coalesce("_heat", F.lit(0))).withColumn("status", F.when(F.col("_into").isNotNull(), "archived").otherwise(F.col("status"))).withColumn("updated_at", F.when(touched, moment(as_of)).otherwise(F.col("updated_at")))
    made = actions.where("action = 'create'").select("scene_id", "title", F.lit(1).cast("long").alias("heat"), F.lit("active").alias("status"), moment(as_of).alias("updated_at"))
    return after.select(*made.columns).unionByName(made.join(scenes, "scene_id", "left_anti")), versions


def expired_marked(memories: DataFrame, as_of: str) -> DataFrame:
    """P-04's action."""
    return memories.withColumn("status", F.when(expired(as_of), "expired").otherwise(F.col("status")))


def old_files_archived(files: DataFrame, as_of: str, days: int) -> DataFrame:
    """D-24."""
    old = (F.col("status") == "refined") & (F.col("refined_at") < moment(as_of) - F.make_dt_interval(F.lit(days)))
    return files.withColumn("status", F.when(old, "archived").otherwise(F.col("status")))


def appended_once(pages: DataFrame, entries: DataFrame) -> DataFrame:
    """D-18. Page contents with entries appended, each marked by its hash and never twice; null content is empty."""
    pages = pages.withColumn("content", F.coalesce("content", F.lit("")))
    mark = F.concat(F.lit("<!-- "), F.substring(F.sha2("entry", 256), 1, 12), F.lit(" -->"))
    new = entries.select("page_id", mark.alias("mark"), F.concat(F.lit("\n"), mark, F.lit("\n"), F.col("entry")).alias("block")).dropDuplicates(["page_id", "mark"])
    fresh = pages.select("page_id", "content").join(new, "page_id").where(~F.contains("content", "mark"))
    blocks = fresh.groupBy("page_id").agg(F.array_join(F.sort_array(F.collect_list("block")), "").alias("_more"))
    return pages.join(blocks, "page_id", "left").withColumn("content", F.concat("content", F.coalesce("_more", F.lit("")))).drop("_more")


def pages_superseded(pages: DataFrame) -> DataFrame:
    """D-17, D-19. Of active pages of one title and category only the newest stays active, and names the one before.

    A page without a status is active, and is written so.
    """
    pages = pages.withColumn("status", F.coalesce("status", F.lit("active")))
    w = Window.partitionBy("title", "category").orderBy(F.desc("updated_at"), F.desc("page_id"))
    active = pages.where("status = 'active'").withColumn("_n", F.row_number().over(w)).withColumn("supersedes", F.when(F.col("_n") == 1, F.lead("page_id").over(w)))
    done = active.withColumn("status", F.when(F.col("_n") == 1, "active").otherwise("superseded")).drop("_n")
    return done.unionByName(pages.where("status <> 'active'").withColumn("supersedes", F.lit(None).cast("string")))


def checked_links(links: DataFrame, kinds: DataFrame) -> DataFrame:
    """D-20. Links of known kinds, each once; the highest confidence counts."""
    return links.join(kinds, "rel_type", "left_semi").groupBy("source_id", "target_id", "rel_type").agg(F.max("confidence").alias("confidence"))


def recovered_tasks(tasks: DataFrame) -> DataFrame:
    """D-22. What ran when the process ended has failed."""
    return tasks.withColumn("error", F.when(F.col("status") == "running", "interrupted")).withColumn("status", F.when(F.col("status") == "running", "error").otherwise(F.col("status")))


def created_once(state: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """D-10, D-13, D-23, T-21."""
    return state.unionByName(rows.dropDuplicates([key]).join(state.select(key), key, "left_anti").select(*state.columns))


def without_duplicates(memories: DataFrame, tags: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """D-26."""
    return archived(memories, tags, ranking.keepers(memories).select("memory_id", "superseded_by"), as_of)
