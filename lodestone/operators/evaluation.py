"""Evaluation of retrieval and extraction."""

from __future__ import annotations

import difflib
import heapq
from collections.abc import Callable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.containment import mentions
from lodestone.session import materialize


def containments(items: DataFrame, docs: DataFrame, item: str = "item_id", doc: str = "doc_id") -> DataFrame:
    """(item_id, doc_id): documents whose text contains an item's text; no item meets every document (``mentions``)."""
    found = mentions(docs.select(F.col(doc).alias("text_id"), "text"), items.select(F.col("text").alias("needle")))
    return found.join(items.select(item, F.col("text").alias("needle")), "needle").select(item, F.col("text_id").alias(doc))


def _normalised(k: int) -> Column:
    """``dcg`` over the best that ``n`` relevant ids can give."""
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return F.round(F.when(F.col("n").isNull(), 1.0).otherwise(F.coalesce("dcg", F.lit(0.0)) / ideal), 4)


def ndcg(rankings: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """V-19. (query, ndcg) of rankings (query, id, rank from 1) against (query, id); 1 with nothing relevant."""
    hits = rankings.where(F.col("rank") <= k).join(relevant, ["query", "id"]).groupBy("query").agg(F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    n = relevant.groupBy("query").agg(F.count_distinct("id").alias("n"))
    queries = rankings.select("query").union(relevant.select("query")).distinct()
    both = queries.join(n, "query", "left").join(hits, "query", "left")
    return both.select("query", _normalised(k).alias("ndcg"))


def evaluated(query_fn: Callable[[DataFrame], DataFrame], queries: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """X-03. (query, ndcg, recall) of any search that is passed in.

    ``query_fn`` turns distinct (query) rows into rankings (query, id, rank from 1); it may be any
    DataFrame program. Recall is the share of the relevant ids among the k best, 1 with nothing relevant.
    """
    asked = queries.select("query").distinct()
    rankings, wanted = query_fn(asked), relevant.join(asked, "query", "left_semi").select("query", "id").distinct()
    hits = rankings.where(F.col("rank") <= k).join(wanted, ["query", "id"]).groupBy("query").agg(F.count("*").alias("hits"))
    n = wanted.groupBy("query").agg(F.count("*").alias("n"))
    recall = asked.join(n, "query", "left").join(hits, "query", "left").select("query", F.round(F.when(F.col("n").isNull(), 1.0).otherwise(F.coalesce("hits", F.lit(0)) / F.col("n")), 4).alias("recall"))
    return recall.join(ndcg(rankings, wanted, k), "query", "left").select("query", F.coalesce("ndcg", F.when(F.col("recall") == 1, 1.0).otherwise(0.0)).alias("ndcg"), "recall")


def best_constant(rankings_of, relevant: DataFrame, grid: Sequence[int], k: int = 10) -> DataFrame:
    """V-20, U-10. (k, mean ndcg) of each constant of fusion, the best first, ties to the smaller.

    The first ``k`` of each ranking are written once, and what is relevant is read for all constants together.
    """
    top = reduce(DataFrame.unionByName, [rankings_of(c).where(F.col("rank") <= k).select(F.lit(c).alias("k"), "query", "id", "rank") for c in grid])
    top = materialize(top, "rankings")
    hits = top.join(relevant, ["query", "id"]).groupBy("k", "query").agg(F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    n = relevant.groupBy("query").agg(F.count_distinct("id").alias("n"))
    constants = top.sparkSession.createDataFrame([(c,) for c in grid], "k int")
    queries = top.select("k", "query").union(n.select("query").crossJoin(F.broadcast(constants)).select("k", "query")).distinct()
    scores = queries.join(n, "query", "left").join(hits, ["k", "query"], "left").select("k", _normalised(k).alias("ndcg"))
    return constants.join(scores, "k", "left").groupBy("k").agg(F.avg("ndcg").alias("mean")).orderBy(F.desc("mean"), "k")


def diagnosis(n_queries: Column, spread: Column, recall: Column) -> Column:
    """V-21."""
    return F.when(n_queries == 0, "no_queries").when(recall == 0, "no_recall").when(recall <= 1, "too_few_candidates").when(spread < 1e-6, "no_discrimination").otherwise("discriminates")


def vector_banner(total: Column, vectors: Column) -> Column:
    """V-23."""
    return F.when(vectors == 0, "no_vectors").when(vectors < total, "partial").otherwise("full")


def similarity(a: str, b: str) -> float:
    """F-12. Ratcliff and Obershelp's ratio of the stripped texts."""
    a, b = a.strip(), b.strip()
    return 1.0 if a == b else difflib.SequenceMatcher(None, a, b).ratio() if a and b else 0.0


def _matched(predicted: Sequence, pred_texts: Sequence[str], truth: Sequence, true_texts: Sequence[str], least: float) -> list[tuple[int, float]]:
    """(row, similarity) of the pairs that are taken, the most similar first, ties by ``predicted``, ``truth`` and row.

    A pair stands at a bound of its similarity, first that of the lengths, then that of the letters, and is worked out only when it comes
    to the front and neither of its sides is taken: no pair that could be taken before it is left behind. Texts that are equal are at 1 from the start.
    """
    a, b = [x.strip() for x in pred_texts], [x.strip() for x in true_texts]
    last = lambda x: (x is None or x != x, 0 if x is None or x != x else x)
    heap = []
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        bound = 1.0 if x == y else 2.0 * min(len(x), len(y)) / (len(x) + len(y))
        if bound >= least:
            heap.append((-bound, last(predicted[k]), last(truth[k]), k, EXACT if x == y or not x or not y else 0))
    heapq.heapify(heap)
    used_p, used_t, taken = set(), set(), []
    matcher = difflib.SequenceMatcher(None)
    while heap:
        bound, p, t, k, level = heapq.heappop(heap)
        if p in used_p or t in used_t:
            continue
        if level == EXACT:
            taken.append((k, -bound))
            used_p.update(() if p[0] else (p,))  # null ids are no one's
            used_t.update(() if t[0] else (t,))
            continue
        if matcher.b is not b[k]:
            matcher.set_seq2(b[k])
        matcher.set_seq1(a[k])
        tighter = matcher.ratio() if level else matcher.quick_ratio()
        if tighter >= least:
            heapq.heappush(heap, (-tighter, p, t, k, level + 1))
    return taken


#: The level of a similarity that is no bound any more.
EXACT = 2


def greedy_matches(pairs: DataFrame, least: float = 0.5) -> DataFrame:
    """J-26. (case_id, predicted, truth, similarity): one-to-one, the most similar first.

    ``pairs`` has case_id, predicted, pred_text, truth, true_text: what a case predicts and expects,
    a few rows each.
    """

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        sides = [pdf[c].tolist() for c in ("predicted", "truth")]
        texts = [[x or "" for x in pdf[c]] for c in ("pred_text", "true_text")]
        taken = _matched(sides[0], texts[0], sides[1], texts[1], least)
        rows = pdf.iloc[[k for k, _ in taken]].assign(similarity=[s for _, s in taken])
        return rows[["case_id", "predicted", "truth", "similarity"]]

    return pairs.groupBy("case_id").applyInPandas(match, "case_id long, predicted long, truth long, similarity double")


def jaccard(a: Column | str, b: Column | str) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def query_texts(items: DataFrame, text: str = "text") -> DataFrame:
    """V-22, F-40. Queries from conversations: message headers are cut off."""
    return items.withColumn("query", F.trim(F.regexp_replace(text, r"(?m)^\[msg#\d+\][^\n]*:", "")))


def relevant_ids(queries: DataFrame) -> DataFrame:
    """U-07. The distinct relevant ids of equal query texts."""
    return queries.groupBy("query").agg(F.sort_array(F.collect_set("id")).alias("ids"))


def ranked(scores: DataFrame, *order: Column, by: str | None = None) -> DataFrame:
    """W-01. Ranks 1, 2, 3… (of each ``by``)."""
    window = Window.partitionBy(by).orderBy(*order) if by else Window.orderBy(*order)
    return scores.withColumn("rank", F.row_number().over(window))

