"""Joins over memories, tags, lineage, scenes and pages."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators import containment
from lodestone.operators.containment import mentions
from lodestone.session import materialize


def tagged(memories: DataFrame, tags: DataFrame, dimensions: Sequence[str], match: str = "any") -> DataFrame:
    """J-01, J-02, J-03. Memories with any or all of the dimensions; semi-joins, so rows never multiply."""
    wanted = sorted(set(dimensions))
    found = tags.where(F.col("dimension_id").isin(wanted))
    if match == "all":
        found = found.groupBy("memory_id").agg(F.countDistinct("dimension_id").alias("n")).where(F.col("n") == len(wanted))
    return memories.join(found.select("memory_id"), "memory_id", "left_semi")


def lineage(sources: DataFrame, files: DataFrame) -> DataFrame:
    """J-04, F-19. Each source reference with the session file it points to, null if there is none."""
    parts = sources.withColumn("file_id", F.split_part("source_ref", F.lit(":"), F.lit(1))).withColumn("msg_id", F.split_part("source_ref", F.lit(":"), F.lit(2)))
    return parts.join(files.select("file_id", "session_key", "agent_id"), "file_id", "left")


def missing_vectors(memories: DataFrame, vectors: DataFrame) -> DataFrame:
    """J-08, S-31."""
    return memories.join(vectors.select("memory_id"), "memory_id", "left_anti")


def counts_with_zero(registry: DataFrame, tags: DataFrame) -> DataFrame:
    """J-09, A-03. Memories of each dimension, zero if it has none."""
    n = tags.groupBy(F.col("dimension_id").alias("id")).agg(F.count("*").alias("n"))
    return registry.join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


def top_per_group(df: DataFrame, group: str | Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """J-10, W-04, W-05. Spark keeps the k best rows of a group within each task before it shuffles them."""
    keys = [group] if isinstance(group, str) else list(group)
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= k).drop("_rank")


def with_count(parents: DataFrame, children: DataFrame, key: str, name: str) -> DataFrame:
    """J-11, A-13."""
    n = children.groupBy(key).agg(F.count("*").alias(name))
    return parents.join(n, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def with_tags(memories: DataFrame, tags: DataFrame) -> DataFrame:
    """J-13. The dimensions of each memory as a sorted array, empty if it has none."""
    lists = tags.groupBy("memory_id").agg(F.sort_array(F.collect_set("dimension_id")).alias("dimensions"))
    return memories.join(lists, "memory_id", "left").withColumn("dimensions", F.coalesce("dimensions", F.array().cast("array<string>")))


def first_source(sources: DataFrame) -> DataFrame:
    """J-14. The first reference of each memory in order of insertion."""
    return sources.groupBy("memory_id").agg(F.min_by("source_ref", "seq").alias("source_ref"))


def tag_condition(dimensions: Sequence[str], match: str, column: str = "dimensions") -> Column:
    """J-15. On an array of dimensions."""
    wanted = F.array(*map(F.lit, dimensions))
    return F.arrays_overlap(column, wanted) if match == "any" else F.size(F.array_except(wanted, column)) == 0


def dangling(sources: DataFrame, files: DataFrame) -> DataFrame:
    """J-16. References to files that don't exist."""
    return sources.withColumn("file_id", F.split_part("source_ref", F.lit(":"), F.lit(1))).join(files.select("file_id"), "file_id", "left_anti")


def _first_in_all(subjects: DataFrame) -> DataFrame:
    """The ``subjects`` (dimension_id, needle, rank) that hold no other one of their dimension with a lesser rank."""
    names = materialize(subjects.select("needle").distinct(), "needles")
    few = names.limit(containment.FEW + 1).count() <= containment.FEW
    inside = containment.within_tokens(names.select(F.col("needle").alias("token"), F.lit(1).alias("n")), names.select(F.col("needle").alias("part")), few).where("part <> token")
    other = subjects.select(F.col("needle").alias("part"), "dimension_id", F.col("rank").alias("_other"))
    held = inside.join(other, "part").groupBy(F.col("token").alias("needle"), "dimension_id").agg(F.min("_other").alias("_other"))
    return subjects.join(held, ["needle", "dimension_id"], "left").where("_other IS NULL OR rank < _other").drop("_other")


def superseded(new: DataFrame, old: DataFrame, tags: DataFrame) -> DataFrame:
    """J-17. (old_id, new_id): old memories that share a dimension with a new one and mention its subject.

    A subject of one token (no white space, or nothing else) is in a text if it is in one of the text's tokens. So the least new
    id of each token and dimension is worked out on the vocabulary, and a text meets only its own tokens: its rows don't grow
    with the subjects that it holds. A subject of several tokens is looked for by its rarest one, and ``contains`` decides.
    The empty subject is in every text; null subjects and contents are in none and hold none. None of the new ones is superseded.

    The distinct subjects are written first, as their kinds and their number decide which joins there are. They are written in the
    order of their new ids and numbered so, and the least number stands for the least id until the end. A subject that holds another of
    its dimension with a lesser number is left out: wherever it is, the other one is too, and comes first.
    """
    fresh = new.select(F.col("memory_id").alias("new_id"), F.lower("subject").alias("needle")).where("needle IS NOT NULL")
    least = fresh.join(tags.withColumnRenamed("memory_id", "new_id"), "new_id").groupBy("dimension_id", "needle").agg(F.min("new_id").alias("new_id"))
    blank = F.col("needle").rlike(r"\A\s+\z")
    kind = F.when(F.col("needle") == "", "empty").when(blank | ~F.col("needle").rlike(r"\s"), "one").otherwise("several")
    least = materialize(least.withColumn("kind", kind).orderBy("new_id").withColumn("rank", F.monotonically_increasing_id()), "subjects")
    least = materialize(_first_in_all(least), "first-subjects")
    counts = {r["kind"]: r for r in least.groupBy("kind").agg(F.countDistinct("needle").alias("n"), F.max(blank).alias("blank"), F.max(F.size(F.split("needle", r"\s+"))).alias("parts")).collect()}
    blanks = "one" in counts and counts["one"]["blank"]

    def few(of: str) -> bool:
        return counts[of]["n"] * (2 * counts[of]["parts"] + 1) <= containment.FEW

    texts = old.where("content IS NOT NULL").select(F.col("memory_id").alias("old_id"), F.lower("content").alias("text"))
    dims = tags.join(new.select("memory_id"), "memory_id", "left_anti").groupBy(F.col("memory_id").alias("old_id")).agg(F.collect_set("dimension_id").alias("dims"))
    held = texts.join(dims, "old_id").select("old_id", "dims", F.explode(containment.tokens("text", blanks)).alias("token"))
    known = texts.select(F.explode(containment.tokens("text", blanks)).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    known = materialize(known, "vocabulary") if "several" in counts else known  # both kinds of subjects, and its counts, read it

    found = []
    if "one" in counts:
        subjects = least.where("kind = 'one'").select(F.col("needle").alias("part"), "dimension_id", "rank")
        # dealt by token before each hit gets its dimensions: both aggregates then take place where the token is
        hits = containment.within_tokens(known, subjects, few("one")).repartition("token")
        of_token = hits.join(F.broadcast(subjects) if few("one") else subjects, "part").groupBy("token", "dimension_id").agg(F.min("rank").alias("rank"))
        of_token = of_token.groupBy("token").agg(F.map_from_entries(F.collect_list(F.struct("dimension_id", "rank"))).alias("of"))
        found.append(held.join(of_token, "token").select("old_id", F.array_min(F.transform("dims", lambda d: F.element_at("of", d))).alias("rank")))
    if "several" in counts:
        subjects = least.where("kind = 'several'").drop("kind")
        near = held.join(containment.rarest_tokens(subjects.select("needle").distinct(), known, few("several"), blanks), "token")
        said = near.select("old_id", "needle", "dims").dropDuplicates(["old_id", "needle"]).join(texts, "old_id").where(F.contains("text", "needle"))
        found.append(said.select("old_id", "needle", F.explode("dims").alias("dimension_id")).join(subjects, ["needle", "dimension_id"]).select("old_id", "rank"))
    if "empty" in counts:
        everywhere = texts.join(dims, "old_id").select("old_id", F.explode("dims").alias("dimension_id"))
        found.append(everywhere.join(least.where("kind = 'empty'"), "dimension_id").select("old_id", "rank"))
    if not found:
        return texts.select("old_id", F.col("old_id").alias("new_id")).limit(0)
    first = reduce(DataFrame.unionByName, found).where("rank IS NOT NULL").groupBy("old_id").agg(F.min("rank").alias("rank"))
    return first.join(least.select("rank", "new_id"), "rank").select("old_id", "new_id")


def candidates(new: DataFrame, old: DataFrame, tags: DataFrame, k: int = 50) -> DataFrame:
    """J-18. For each new memory the k old ones of highest priority that share a dimension with it.

    A memory's old partners are the best of its dimensions, so only the k best of each dimension are
    paired: no dimension, however large, is joined in full.
    """
    a = new.select(F.col("memory_id").alias("new_id")).join(tags.withColumnRenamed("memory_id", "new_id"), "new_id")
    b = old.select(F.col("memory_id").alias("old_id"), "priority").join(tags.withColumnRenamed("memory_id", "old_id"), "old_id")
    best = top_per_group(b, "dimension_id", [F.desc("priority"), F.asc("old_id")], k + 1)
    pairs = a.join(best, "dimension_id").where("new_id <> old_id").select("new_id", "old_id", "priority").distinct()
    return top_per_group(pairs, "new_id", [F.desc("priority"), F.asc("old_id")], k)


def titles_mentioned(pages: DataFrame, shortest: int = 4) -> DataFrame:
    """J-19. (source_id, target_id): pages whose text has another page's title, whatever the case.

    No page is compared with all titles (``mentions``). A title counts for its first page. Titles are written
    once, as they are read for each step.
    """
    titles = pages.where(F.length("title") >= shortest).groupBy("title").agg(F.min("page_id").alias("target_id")).withColumn("needle", F.lower("title"))
    titles = materialize(titles, "titles")
    texts = pages.select(F.col("page_id").alias("text_id"), F.lower("content").alias("text"))
    found = mentions(texts, titles.select("needle")).join(titles, "needle").where("text_id <> target_id")
    return found.select(F.col("text_id").alias("source_id"), "target_id")


def pages_sharing_tags(pages: DataFrame, most: int = 15) -> DataFrame:
    """J-20. (a, b) pairs of pages with a common tag that no more than ``most`` pages have."""
    each = pages.select("page_id", F.explode(F.array_distinct("tags")).alias("tag"))
    rare = each.groupBy("tag").agg(F.count("*").alias("n")).where(F.col("n") <= most).select("tag")
    rare = each.join(rare, "tag", "left_semi")
    a, b = rare.withColumnRenamed("page_id", "a"), rare.withColumnRenamed("page_id", "b")
    return a.join(b, "tag").where("a < b").select("a", "b").distinct()


def links_between(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """J-22. Links whose two ends are nodes."""
    ids = nodes.select("id")
    return links.join(ids, links["source_id"] == ids["id"], "left_semi").join(ids, links["target_id"] == ids["id"], "left_semi")


def archive_chain(archive: DataFrame, start: str) -> DataFrame:
    """J-23. What a memory superseded, directly or through others, oldest first.

    Pointer doubling: every round each row looks twice as far along its chain, so chains of n links take about log2 n
    rounds of one equi-join each. Rows whose chain has met ``start`` or has ended look no further; a cycle
    that never meets it ends with the rounds. ``memory_id`` is the archive's key; rows without one are left out.
    """
    met = F.coalesce(F.col("superseded_by") == start, F.lit(False))
    ahead = archive.where("memory_id IS NOT NULL").select("memory_id", F.when(~met, F.col("superseded_by")).alias("to"), met.alias("met"))
    ahead = materialize(ahead, "chain")
    for _ in range(ahead.count().bit_length() + 1):
        looking = F.col("to").isNotNull()
        if ahead.where(looking).isEmpty():
            break
        beyond = ahead.select(F.col("memory_id").alias("to"), F.col("to").alias("_to"), F.col("met").alias("_met"))
        further = ahead.where(looking).join(beyond, "to", "left").select("memory_id", F.col("_to").alias("to"), F.coalesce("_met", F.lit(False)).alias("met"))
        ahead = materialize(further.unionByName(ahead.where(~looking)), "chain")
    return archive.join(ahead.where("met").select("memory_id"), "memory_id", "left_semi").orderBy("archived_at", "memory_id")


def after(events: DataFrame, cursors: DataFrame) -> DataFrame:
    """J-24. (subscriber_id, event…): events past each subscriber's (time, id) cursor.

    A cursor stands for every day from its own to the last event's, so both sides meet by day and no event
    is compared with subscribers who don't get it, but for those of its own day.
    """
    span = events.agg(F.min(F.to_date("ts")).alias("_lo"), F.max(F.to_date("ts")).alias("_hi"))  # one row
    since = F.greatest(F.coalesce(F.to_date("last_ts"), F.col("_lo")), F.col("_lo"))
    days = cursors.select("subscriber_id", "last_ts", "last_id").crossJoin(F.broadcast(span)).withColumn("_since", since).where("_since <= _hi")
    days = days.withColumn("_day", F.explode(F.sequence("_since", "_hi"))).drop("_since", "_lo", "_hi")
    past = F.col("last_ts").isNull() | (F.col("ts") > F.col("last_ts")) | ((F.col("ts") == F.col("last_ts")) & (F.col("event_id") > F.col("last_id")))
    return events.withColumn("_day", F.to_date("ts")).join(days, "_day").where(past).drop("last_ts", "last_id", "_day")


def both_forms(files: DataFrame) -> DataFrame:
    """J-28. Sessions that were imported under both forms of their key."""
    forms = files.groupBy("session_key").agg(F.count_distinct("form").alias("n")).where("n > 1")
    return files.join(forms, "session_key", "left_semi")
