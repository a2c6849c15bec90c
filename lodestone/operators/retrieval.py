"""Hybrid search: routes, fusion, content deduplication, provenance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators import evaluation, fulltext, ranking, relations, vectors
from lodestone.operators.selection import any_term, visible
from lodestone.session import materialize


def text_route(docs: DataFrame, key: str, query: str, k: int, *texts: str) -> DataFrame:
    """(key, place from 0, score): the k best by BM25, or where that finds nothing the first k that hold a term."""
    best = materialize(fulltext.best(fulltext.bm25(docs, key, query, *texts), key, k), "text-route")  # k rows, which are read more than once
    if best.isEmpty():
        best = docs.where(any_term(texts[0], query)).select(key, F.lit(0.0).alias("score")).orderBy(key).limit(min(k, 20))
    return _placed(best, F.col("score"), key)


def vector_route(found: DataFrame, key: str, k: int) -> DataFrame:
    """(key, place, score) of the k most similar."""
    return _placed(found.orderBy(F.desc("similarity"), key).limit(k).select(key, F.col("similarity").alias("score")), F.desc("score"), key)


def _placed(top: DataFrame, order: Column, key: str) -> DataFrame:
    return top.withColumn("place", F.row_number().over(Window.orderBy(order, key)) - 1)  # k rows


def fuse(routes: dict[str, DataFrame], key: str, constant: int = 60) -> DataFrame:
    """V-08, J-25. Reciprocal rank fusion: (key, rrf, routes), the best first, ties in the order of the routes."""
    names = list(routes)
    union = None
    for n in names:
        part = routes[n].select(key, F.lit(n).alias("route"), "place")
        union = part if union is None else union.unionByName(part)
    places = [F.min(F.when(F.col("route") == n, F.col("place"))).alias(f"_{n}") for n in names]
    fused = union.groupBy(key).agg(F.sum(1 / (F.col("place") + constant + 1)).alias("rrf"), F.sort_array(F.collect_set("route")).alias("routes"), *places)
    return fused.orderBy(F.desc("rrf"), *[F.col(f"_{n}").asc_nulls_last() for n in names], key)


def search(memories: DataFrame, tags: DataFrame, sources: DataFrame, files: DataFrame, found: DataFrame | None, query: str, dimensions: Sequence[str] = (), match: str = "any", k: int = 10, constant: int = 60) -> DataFrame:
    """V-10. Memories by fused rank, one of each content, with rank, dimensions and source files.

    ``found`` are vector similarities (memory_id, similarity) or None. The dimension filter narrows the
    text route before it is cut to k and the vector route after, as the routes are defined.
    """
    shown = memories.where(visible())
    texts = relations.tagged(shown, tags, dimensions, match) if dimensions else shown
    routes = {"bm25": text_route(texts, "memory_id", query, k, "content")}
    if found is not None:
        near = vector_route(found.join(shown.select("memory_id"), "memory_id", "left_semi"), "memory_id", k)
        routes["vector"] = relations.tagged(near, tags, dimensions, match) if dimensions else near
    fused = fuse(routes, "memory_id", constant)
    ranked = fused.join(shown.select("memory_id", "content", "priority"), "memory_id")
    order = F.struct(-F.col("rrf"), *[F.coalesce(f"_{n}", F.lit(1 << 30)) for n in routes], "memory_id")
    once = ranking.first_of_content(ranked.withColumn("_order", order), F.col("_order")).orderBy("_order").limit(k)
    top = evaluation.ranked(once, F.col("_order")).drop("_order", *[f"_{n}" for n in routes])  # k rows
    with_tags = relations.with_tags(top, tags)
    trace = relations.lineage(sources.join(top.select("memory_id"), "memory_id", "left_semi"), files)
    trace = trace.groupBy("memory_id").agg(F.sort_array(F.collect_set("source_ref")).alias("sources"))
    return with_tags.join(trace, "memory_id", "left").orderBy("rank")


def search_scenes(scenes: DataFrame, texts: Sequence[str], query: str, found: DataFrame | None, k: int = 10) -> DataFrame:
    """V-11. Active scenes by fused rank; hotter scenes first among equal text scores."""
    active = scenes.where("status = 'active'")
    scored = fulltext.bm25(active, "scene_id", query, *texts).join(active.select("scene_id", "heat"), "scene_id")
    best = scored.orderBy("score", F.desc("heat"), "scene_id").limit(k)
    place = F.row_number().over(Window.orderBy("score", F.desc("heat"), "scene_id")) - 1  # k rows
    routes = {"bm25": best.withColumn("place", place).select("scene_id", "place", "score")}
    if found is not None:
        routes["vector"] = vector_route(found.join(active.select("scene_id"), "scene_id", "left_semi"), "scene_id", k)
    return fuse(routes, "scene_id").limit(k).join(active.select("scene_id", "title", "heat"), "scene_id")


def search_wiki(pages: DataFrame, query: str, k: int = 10, skills: bool = False) -> DataFrame:
    """V-12. Active pages by BM25 over title and content, with a snippet."""
    active = pages.where("status = 'active'")
    if not skills:
        active = active.where(F.coalesce(~F.array_contains("tags", "skill"), F.lit(True)))
    top = fulltext.best(fulltext.bm25(active, "page_id", query, "title", "content"), "page_id", k)
    return top.join(active.select("page_id", "title", F.substring("content", 1, 200).alias("snippet")), "page_id")


def similarities(memory_vectors: DataFrame, query: DataFrame) -> DataFrame:
    return vectors.similarities(memory_vectors, query).select("memory_id", "similarity")
