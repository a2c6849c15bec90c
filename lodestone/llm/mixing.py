"""Mixing sources to target weights by weighted fair queueing.

Every source shuffles its documents (by a hash of id and text) and repeats the shuffled queue as
often as its target needs. A document's virtual finish time is its source's cumulative size up to
and with it, divided by the source's target. The mix takes documents in the order of finish times,
over all sources, until the budget is used up.

No source and no order is gathered in one task: a source's cumulative sizes come from its totals
over 4096 hash ranges plus a running sum inside each range, and the cut in the global order from
totals over 4096 ranges of finish time plus a running sum inside the one range where the budget
ends. Only per-source figures come to the driver.

Defined results: null text has size 0 and takes nothing; a null source is a source of its own,
sorted last; sources of size 0 have target 0; repeated rows are documents of their own and share a
place in the order; ties in the shuffle fall to the smaller id; further columns are kept by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import prepare
from lodestone.session import materialize

WEIGHTS = (5.0, 2.0, 1.0)
MOST_REPEATS = 3
RANGES = 4096


def word_count(text: Column) -> Column:
    """Runs of characters that are not ASCII white space; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, most_repeats: int = MOST_REPEATS) -> dict[str | None, float]:
    """Each source's share of all sizes by weight, none over ``most_repeats`` times its own size.

    What a capped source can't take is shared again among the others by weight, until none is above.
    """
    ordered = sorted(sizes, key=lambda x: (x[0] is None, (x[0] or "").encode("utf-32-be")))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(ordered)}
    size = dict(ordered)
    budget, out, free = float(sum(size.values())), {}, list(size)
    while free:
        unit = max(budget, 0.0) / sum(weight[s] for s in free)
        over = [s for s in free if unit * weight[s] > most_repeats * size[s]]
        if not over:
            return out | {s: unit * weight[s] for s in free}
        for s in over:
            out[s] = float(most_repeats * size[s])
            budget -= out[s]
            free.remove(s)
    return out


def plan(docs: DataFrame, size: Column, weights=WEIGHTS, most_repeats: int = MOST_REPEATS, seed: int = 7) -> DataFrame:
    """A row (doc_id, source, key, size, source_size, target, copies) of each row of ``docs``.

    ``key`` hashes id and text; it is the shuffled order of a source.
    """
    spark = docs.sparkSession
    prepare(spark)
    sized = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", shuffle_key(seed).alias("key"), size.alias("size")), "sizes")
    per_source = [(r["source"], r["n"] or 0) for r in sized.groupBy("source").agg(F.sum("size").alias("n")).collect()]
    goal = targets(per_source, weights, most_repeats)
    total = sum(n for _, n in per_source)
    about = spark.createDataFrame([(s, n, goal[s]) for s, n in per_source], "source string, source_size long, target double")

    same_source = F.col("a.source").eqNullSafe(F.col("b.source"))
    sized = sized.withColumn("part", F.shiftright("key", 52).cast("int"))  # RANGES parts in the order of the key
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sized.groupBy("source", "part").agg(F.sum("size").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy("source", "part").orderBy("key", "doc_id", "size")
    lined = sized.withColumn("nth", F.row_number().over(inside))
    lined = lined.withColumn("upto", F.sum("size").over(inside.orderBy("key", "doc_id", "size", "nth").rowsBetween(Window.unboundedPreceding, 0)))
    lined = lined.alias("a").join(starts.alias("b"), same_source & (F.col("a.part") == F.col("b.part"))).select("a.*", "base")
    lined = lined.alias("a").join(F.broadcast(about).alias("b"), same_source).select("a.*", "source_size", "target")
    lined = materialize(lined.withColumn("upto", F.col("upto") + F.col("base")).drop("base"), "queues")

    def finish(turn: int | Column) -> Column:
        return (F.col("upto") + F.lit(turn) * F.col("source_size")) / F.col("target")

    def place(turn: int | Column) -> Column:
        return F.struct(finish(turn).alias("finish"), "key", "doc_id", "nth", F.lit(turn).cast("int").alias("turn"))

    # finish times up to 1 make up the targets, but for the last document of each source
    slot = F.least(F.floor(F.col("place.finish") * (RANGES // 2)), F.lit(RANGES)).cast("int")
    copies = lined.where("size > 0 and target > 0").select("size", F.explode(F.array(*[place(t) for t in range(most_repeats)])).alias("place")).withColumn("slot", slot)
    used, cut = 0, None
    for n_slot, n in sorted((r["slot"], r["n"]) for r in copies.groupBy("slot").agg(F.sum("size").alias("n")).collect()):
        if used + n > total:
            cut = n_slot
            break
        used += n
    runs = F.col("size") > 0
    if cut is None:
        taken = [F.lit(1)] * most_repeats
    else:
        upto = Window.partitionBy("slot").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
        last = copies.where(F.col("slot") == cut).withColumn("sum", F.sum("size").over(upto)).where(F.col("sum") <= total - used).agg(F.max("place").alias("place")).first()["place"]
        edge = F.lit(cut / (RANGES // 2))
        if last is None:
            taken = [(finish(t) < edge).cast("int") for t in range(most_repeats)]
        else:
            at = F.struct(*[F.lit(last[c]).cast(k).alias(c) for c, k in (("finish", "double"), ("key", "long"), ("doc_id", "long"), ("nth", "int"), ("turn", "int"))])
            taken = [((finish(t) < edge) | (place(t) <= at)).cast("int") for t in range(most_repeats)]
    copies_of = F.when(runs & (F.col("target") > 0), sum(taken[1:], taken[0])).otherwise(0)
    return lined.select("doc_id", "source", "key", "size", "source_size", "target", copies_of.alias("copies"))


def shuffle_key(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), F.coalesce(F.col("text"), F.lit("")))


def query(docs: DataFrame) -> DataFrame:
    """The contract's digest: (doc_id, size, source_size, target, taken) of each row of ``docs``."""
    got = plan(docs, word_count(F.col("text")))
    return got.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, size: Column | None = None, weights=WEIGHTS, most_repeats: int = MOST_REPEATS, seed: int = 7) -> DataFrame:
    """``docs`` with each row as often as the mix takes it (0 to ``most_repeats`` times)."""
    got = plan(docs, word_count(F.col("text")) if size is None else size, weights, most_repeats, seed)
    # rows that repeat id, source and text share their copies evenly
    shares = got.groupBy("doc_id", "source", "key").agg(F.sum("copies").alias("n"), F.count("*").alias("m")).where("n > 0")
    names = docs.columns
    rows = docs.select(F.struct(*[docs[c] for c in names]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "source", shuffle_key(seed).alias("key"))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "source", "key").orderBy("key")))
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.key") == F.col("b.key")) & F.col("a.source").eqNullSafe(F.col("b.source"))
    own = F.floor((F.col("n") - F.col("nth") + F.col("m")) / F.col("m")).cast("int")
    kept = rows.alias("a").join(shares.alias("b"), same).select("row", own.alias("own")).where("own > 0")
    return kept.withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("own")))).select("row.*")
