"""Toxicity by a character n-gram linear classifier with naive Bayes log-count ratios.

Features are the distinct character 3-, 4- and 5-grams of a text in lower case, hashed into 2**20
cells. Over the labelled sample each cell gets its naive Bayes log-count ratio r (smoothed document
frequencies in toxic over other texts); the cells that separate the classes best are kept, a text's
vector is r where it has the cell and 0 elsewhere, and a logistic regression is fit on it. The sample
is bounded by ``per_class``; scoring covers every text from end to end.

Defined results: null text is empty; an empty text gets the score of the intercept; without labels
of both classes every score is the share of toxic labels (0 without any); repeated rows score alike;
further columns are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import textkit as tk
from lodestone.llm.common import batch, prepare
from lodestone.llm.labelled import FIT_PARTITIONS, held_out, sample
from lodestone.session import materialize

GRAMS = (3, 4, 5)
CELL_BITS = 20


def _fold() -> np.ndarray:
    out = np.arange(0x600, dtype=np.uint32)
    for c in range(len(out)):
        low = chr(c).lower()
        if len(low) == 1:
            out[c] = ord(low)
    return out


FOLD = _fold()


@dataclass
class NgramModel:
    weights: np.ndarray  # of each cell: regression weight times log-count ratio
    intercept: float


def cells(column, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """(row, cell) of the distinct cells of each text, only the ``wanted`` ones if given; the number of rows."""
    data, offs = tk.buffers(column)
    chars = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    if len(chars) != len(data):
        first = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=first[1:])
        offs = first[offs]
    chars = np.where(chars < len(FOLD), FOLD[np.minimum(chars, len(FOLD) - 1)], chars)
    spans, keys = tk.Spans(chars), []
    ends = np.repeat(offs[1:], np.diff(offs))
    for n in GRAMS:
        cell = (spans.windows(n) + np.uint64(n)) * np.uint64(tk.POLY) >> np.uint64(64 - CELL_BITS)
        ok = np.arange(n, len(cell) + n) <= ends[: len(cell)]
        if wanted is not None:
            ok &= wanted[cell]
        at = np.flatnonzero(ok)
        row = np.searchsorted(offs, at, "right") - 1
        keys.append((row << CELL_BITS) + cell[at].astype(np.int64))
    keys = np.unique(np.concatenate(keys))
    return keys >> CELL_BITS, keys & ((1 << CELL_BITS) - 1), len(offs) - 1


def _frequencies(batches):
    """(cell, toxic, other): in how many texts of each class a cell is, over one task."""
    n = np.zeros((2, 1 << CELL_BITS), np.int32)
    for whole in batches:
        for part in tk.slices(whole, "text", 1_000_000):
            row, cell, _ = cells(part.column("text"))
            label = part.column("label").to_numpy(zero_copy_only=False)[row]
            for k in (0, 1):
                n[k] += np.bincount(cell[label == k], minlength=1 << CELL_BITS).astype(np.int32)
    schema = pa.schema([("cell", pa.int32()), ("toxic", pa.int64()), ("other", pa.int64())])
    found = np.flatnonzero(n.any(0))
    for k in range(0, len(found), 100_000):
        at = found[k : k + 100_000]
        yield batch(schema, cell=at.astype(np.int32), toxic=n[1][at].astype(np.int64), other=n[0][at].astype(np.int64))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 6000, features: int = 4096, least_texts: int = 4) -> NgramModel:
    """Learn from a sample of at most about ``per_class`` labelled texts of each class outside the fold."""
    spark = docs.sparkSession
    prepare(spark)
    train = materialize(sample(docs, labels, "toxic", per_class), "toxic")
    size = {r["label"]: (r["n"], r["w"]) for r in train.groupBy("label").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).collect()}
    if len(size) < 2:
        share = 0.0 if 1 not in size else 1.0
        return NgramModel(np.zeros(1 << CELL_BITS, np.float32), 30.0 if share else -30.0)
    counts = train.mapInArrow(_frequencies, "cell int, toxic long, other long").groupBy("cell").agg(F.sum("toxic").alias("p"), F.sum("other").alias("q"))
    p, q = F.col("p") / size[1][0], F.col("q") / size[0][0]
    both = (F.col("p") + F.col("q")) / (size[1][0] + size[0][0])
    ratio = F.log((F.col("p") + 1) / (size[1][0] + 2)) - F.log((F.col("q") + 1) / (size[0][0] + 2))
    separates = F.abs(p - q) / F.sqrt(both * (1.0001 - both))
    chosen = counts.where(F.col("p") + F.col("q") >= least_texts).select("cell", ratio.alias("r"), separates.alias("s"))
    chosen = chosen.orderBy(F.desc("s"), "cell").limit(features).select("cell", "r").toPandas()
    cell, r = chosen["cell"].to_numpy(), chosen["r"].to_numpy()
    if not len(cell):
        odds = size[1][1] / size[0][1]
        return NgramModel(np.zeros(1 << CELL_BITS, np.float32), float(np.log(odds)))
    place = np.full(1 << CELL_BITS, -1, np.int32)
    place[cell] = np.arange(len(cell))

    def vectors(batches):
        schema = pa.schema([("label", pa.int32()), ("weight", pa.float64()), ("has", pa.list_(pa.int32()))])
        for whole in batches:
            for part in tk.slices(whole, "text", 1_000_000):
                row, c, n = cells(part.column("text"), place >= 0)
                order = np.lexsort((place[c], row))
                has = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32)), pa.array(place[c][order]))
                yield batch(schema, label=part.column("label"), weight=part.column("weight"), has=has)

    data = train.mapInArrow(vectors, "label int, weight double, has array<int>").withColumn("has", F.col("has").cast("array<string>"))
    marks = CountVectorizerModel.from_vocabulary([str(k) for k in range(len(r))], "has", "marks", binary=True).transform(data)
    scaled = ElementwiseProduct(scalingVec=Vectors.dense(r), inputCol="marks", outputCol="features").transform(marks)
    data = scaled.select("label", "weight", "features").repartition(FIT_PARTITIONS).cache()
    model = LogisticRegression(maxIter=60, regParam=2e-4, standardization=False, weightCol="weight").fit(data)
    data.unpersist()
    weights = np.zeros(1 << CELL_BITS, np.float32)
    weights[cell] = model.coefficients.toArray() * r
    return NgramModel(weights, float(model.intercept))


def score(docs: DataFrame, model: NgramModel) -> DataFrame:
    """(doc_id, score) of every text."""
    prepare(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def scores(batches):
        m = held.value
        wanted = m.weights != 0
        for whole in batches:
            for part in tk.slices(whole, "text", 1_500_000):
                row, cell, n = cells(part.column("text"), wanted)
                total = m.intercept + np.bincount(row, weights=m.weights[cell], minlength=n)
                yield batch(schema, doc_id=part.column("doc_id"), score=1 / (1 + np.exp(-np.clip(total, -50, 50))))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scores, "doc_id long, score double")


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's digest."""
    got = score(docs, fit(docs, labels))
    return got.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
