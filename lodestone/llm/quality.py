"""A quality classifier as a sparse ensemble of rules.

Statistics of a text (lengths, shares of kinds of characters, repetition of words, lines and
shingles) feed a random forest of shallow trees. Every path in a tree is a rule: a conjunction of
bounds on statistics. A logistic regression with an L1 penalty weighs the rules and leaves most out,
and what remains is compiled into one Spark column expression over the statistics columns.

Defined results: null text is empty; an empty text has statistics of 0; without labels of both
classes every score is the share of good labels (0.5 without any); repeated rows score alike; further
columns are left out.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import textkit as tk
from lodestone.llm.common import batch, prepare
from lodestone.llm.labelled import FIT_PARTITIONS, held_out, sample
from lodestone.session import materialize

STATISTICS = ("n_bytes", "n_words", "word_length", "upper", "digit", "point", "mark", "bar", "blank", "wide", "line_length", "same_lines", "same_words", "same_shingles", "short_words")

#: Fixed sets of bytes for the shares.
KINDS = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "point": b".,;:!?", "mark": b"#$%&*+<=>@^_~/\\", "bar": b"|{}[]()"}

#: A conjunction: the bounds (low, high] of some statistics.
Rule = tuple[tuple[str, float, float], ...]


@dataclass
class RuleModel:
    intercept: float
    rules: list[tuple[Rule, float]]


def statistics(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    n = len(offs) - 1
    size = np.diff(offs)

    def total(mask: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.int64)
        np.cumsum(mask, out=sums[1:])
        return sums[offs[1:]] - sums[offs[:-1]]

    def share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
        return part / np.maximum(whole, 1)

    start, end, row = tk.words(data, offs)
    n_words = np.bincount(row, minlength=n)
    out = {"n_bytes": size.astype(float), "n_words": n_words.astype(float)}
    out["word_length"] = share(np.bincount(row, weights=end - start, minlength=n), n_words)
    for kind, members in KINDS.items():
        table = np.zeros(256, bool)
        table[list(members)] = True
        out[kind] = share(total(table[data]), size)
    out["blank"] = share(total(tk.SPACE[data]), size)
    out["wide"] = share(total(data >= 128), size)
    line_end = data == 10
    n_lines = total(line_end) + (size > 0)
    out["line_length"] = share(size, n_lines)

    def repeated(rows: np.ndarray, values: np.ndarray) -> np.ndarray:
        r, _, k = tk.elements(rows, values)
        return 1 - share(np.bincount(r, minlength=n), np.bincount(r, weights=k, minlength=n)) - (np.bincount(rows, minlength=n) == 0)

    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    edge[1:] |= line_end
    at = np.flatnonzero(edge)
    spans = tk.Spans(data)
    line_row = np.searchsorted(offs, at[:-1], "right") - 1
    out["same_lines"] = repeated(line_row, spans(at[:-1], at[1:]))
    out["same_words"] = repeated(row, spans(start, end))
    out["same_shingles"] = repeated(*tk.shingles(data, offs))
    out["short_words"] = share(np.bincount(row, weights=end - start == 1, minlength=n), n_words)
    return out


def with_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The ``keep`` columns and the statistics of the text."""
    prepare(docs.sparkSession)
    kept = docs.select(*keep, "text")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "text" or "text" in keep)

    def add(batches):
        for whole in batches:
            for part in tk.slices(whole, "text", 2_000_000):
                found = statistics(*tk.buffers(part.column("text")))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], *[pa.array(found[s], pa.float64()) for s in STATISTICS]], names=[*keep, *STATISTICS])

    return kept.mapInArrow(add, ", ".join(x for x in (kinds, *[f"{s} double" for s in STATISTICS]) if x))


def tree_rules(text: str) -> set[Rule]:
    """The rules of a tree in Spark's printed form: one for each path from the root to a node."""
    found: set[Rule] = set()
    path: list[tuple[int, str, bool, float]] = []
    for line in text.splitlines():
        if m := re.match(r"(\s*)(?:If|Else) \(feature (\d+) (<=|>) ([-+.\dEe]+|Infinity)\)", line):
            depth = len(m[1])
            path = [x for x in path if x[0] < depth]
            path.append((depth, STATISTICS[int(m[2])], m[3] == "<=", float(m[4])))
            bounds: dict[str, tuple[float, float]] = {}
            for _, name, below, cut in path:
                low, high = bounds.get(name, (-math.inf, math.inf))
                bounds[name] = (low, min(high, cut)) if below else (max(low, cut), high)
            found.add(tuple((k, *v) for k, v in sorted(bounds.items())))
    return found


def holds(rule: Rule) -> Column:
    out = F.lit(True)
    for name, low, high in rule:
        if low > -math.inf:
            out = out & (F.col(name) > low)
        if high < math.inf:
            out = out & (F.col(name) <= high)
    return out


def compiled(model: RuleModel) -> Column:
    """The score as an expression over the statistics columns."""
    total = F.lit(model.intercept)
    for rule, weight in model.rules:
        total = total + F.when(holds(rule), F.lit(weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-total))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 8000, trees: int = 24, depth: int = 3, penalty: float = 5e-4) -> RuleModel:
    """Learn from a sample of at most about ``per_class`` labelled texts of each class outside the fold."""
    prepare(docs.sparkSession)
    train = materialize(with_statistics(sample(docs, labels, "quality", per_class), ["label", "weight"]), "quality")
    size = {r["label"]: r["w"] for r in train.groupBy("label").agg(F.sum("weight").alias("w")).collect()}
    if len(size) < 2:
        return RuleModel(0.0 if not size else 30.0 if 1 in size else -30.0, [])
    rows = VectorAssembler(inputCols=list(STATISTICS), outputCol="features").transform(train.repartition(FIT_PARTITIONS))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, featureSubsetStrategy="onethird", minInstancesPerNode=10, weightCol="weight", seed=11).fit(rows)
    rules = sorted(set().union(*(tree_rules(t.toDebugString) for t in forest.trees)))
    if not rules:
        return RuleModel(math.log(size[1] / size[0]), [])
    marked = train.select("label", "weight", F.array(*[holds(r).cast("double") for r in rules]).alias("held"))
    marked = marked.select("label", "weight", array_to_vector("held").alias("features")).repartition(FIT_PARTITIONS).cache()
    lasso = LogisticRegression(maxIter=80, regParam=penalty, elasticNetParam=1.0, standardization=False, weightCol="weight").fit(marked)
    marked.unpersist()
    weights = lasso.coefficients.toArray()
    return RuleModel(float(lasso.intercept), [(r, float(w)) for r, w in zip(rules, weights, strict=True) if w])


def score(docs: DataFrame, model: RuleModel) -> DataFrame:
    """(doc_id, score) of every text."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return with_statistics(ids, ["doc_id"]).select("doc_id", compiled(model).alias("score"))


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's digest."""
    got = score(docs, fit(docs, labels))
    return got.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
