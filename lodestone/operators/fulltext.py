"""Full-text search: tokens, postings and BM25 as DataFrame operations."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEGMENTER = "words-v2"
WORD_BREAK = r"[^\p{L}\p{N}\p{Co}]+"
K1, B = 1.2, 0.75


def _marked() -> dict[str, str]:
    """Latin letters with marks by the letter without them, and the combining marks by nothing."""
    out = {}
    for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]):
        base, *marks = unicodedata.normalize("NFD", c)
        if marks and base.isascii() and all(map(unicodedata.combining, marks)):
            out[c] = base
    return out | {chr(c): "" for c in range(0x300, 0x370)}


MARKED = _marked()


def folded(text: Column) -> Column:
    """In lower case and without marks, as full-text search compares words; ASCII has none."""
    low = F.lower(text)
    plain = F.translate(low, "".join(MARKED), "".join(MARKED.values()))  # what has no counterpart goes, and the marks are last
    return F.when(F.octet_length(low) == F.char_length(low), low).otherwise(plain)


def words(text: Column | str) -> Column:
    """Lower-case runs of letters and digits, without marks."""
    return F.array_remove(F.split(folded(F.col(text) if isinstance(text, str) else text), WORD_BREAK), "")


def bigrams(text: Column | str) -> Column:
    """F-01, F-02. Two-character pieces of each part between white space; a single character stays."""
    parts = F.filter(F.split(F.trim(text), r"\s+"), lambda p: p != "")
    cut = F.transform(parts, lambda p: F.when(F.length(p) < 2, F.array(p)).otherwise(F.transform(F.sequence(F.lit(1), F.length(p) - 1), lambda i: F.substring(p, i, F.lit(2)))))
    return F.flatten(cut)


def query_terms(query: str) -> list[str]:
    """F-04. The distinct terms of a query, in order."""
    plain = query.lower().translate({ord(k): v for k, v in MARKED.items()})
    return list(dict.fromkeys(t for t in re.split(r"[\W_]+", plain) if t))


#: Parts that the texts of one partition are dealt to, at least, before their tokens are counted.
PER_READ = 8


def postings(docs: DataFrame, key: str, *texts: str) -> DataFrame:
    """V-01. (term, key, tf, size): size is the number of tokens over all text columns.

    Documents are dealt by key and size, as one string of tokens each, before their tokens are counted, so that no row a token is shuffled.
    """
    spark = docs.sparkSession
    # a number, as small texts make many rows, and one that keeps a task's counts in memory
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), PER_READ * docs.rdd.getNumPartitions())
    each = docs.select(key, words(F.concat_ws(" ", *texts)).alias("tokens")).select(key, F.size("tokens").alias("size"), F.array_join("tokens", " ").alias("said"))
    dealt = each.repartition(parts, key, "size").select(key, "size", F.explode(F.split("said", " ")).alias("term")).where("term <> ''")
    return dealt.groupBy("term", key, "size").agg(F.count("*").alias("tf"))


def updated(index: DataFrame, changed: DataFrame, key: str, *texts: str) -> DataFrame:
    """V-02. The postings after some documents changed."""
    return index.join(changed.select(key).distinct(), key, "left_anti").unionByName(postings(changed, key, *texts))


def bm25(docs: DataFrame, key: str, query: str, *texts: str) -> DataFrame:
    """V-03. (key, score): negative, the best first when ascending, as FTS5's bm25() gives it.

    The query's few terms are literals, so one pass over the texts counts each term in each document
    (no postings are shuffled) and one more aggregate gives the collection's figures.
    """
    terms = query_terms(query)
    if not terms:
        return docs.select(key, F.lit(0.0).alias("score")).where(F.lit(False))
    tokens = words(F.concat_ws(" ", *texts))
    counted = docs.select(key, tokens.alias("tokens")).select(key, F.size("tokens").alias("size"), *[_times(t).alias(f"tf{k}") for k, t in enumerate(terms)])
    total = counted.agg(F.count("*").alias("n_docs"), F.avg("size").alias("avg_size"), *[F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in range(len(terms))])
    hits = counted.where(F.greatest(*[F.col(f"tf{k}") for k in range(len(terms))], F.lit(0)) > 0).crossJoin(F.broadcast(total))

    def part(k: int) -> Column:
        df, tf = F.col(f"df{k}"), F.col(f"tf{k}")
        idf = F.ln((F.col("n_docs") - df + 0.5) / (df + 0.5))
        idf = F.when(idf <= 0, 1e-6).otherwise(idf)
        return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("size") / F.col("avg_size")))

    return hits.select(key, (-sum((part(k) for k in range(1, len(terms))), part(0))).alias("score"))


def _times(term: str) -> Column:
    return F.size(F.filter("tokens", lambda x: x == term))


def best(scores: DataFrame, key: str, k: int, *ties: Column) -> DataFrame:
    return scores.orderBy("score", *ties, key).limit(k)


def terms_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(key, F.explode(words(text)).alias("term"))


def scores_of(index: DataFrame, key: str, terms: Sequence[str], n_docs: int, avg_size: float) -> DataFrame:
    """BM25 from a stored index, which suits repeated queries over few terms."""
    found = index.where(F.col("term").isin(list(terms)))
    df = F.broadcast(found.groupBy("term").agg(F.count("*").alias("df")))
    idf = F.ln((n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(idf <= 0, 1e-6).otherwise(idf)
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / avg_size))
    return found.join(df, "term").groupBy(key).agg((-F.sum(weight)).alias("score"))
