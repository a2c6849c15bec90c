"""The trained models and the mix against plain versions of them."""

import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import labelled, mixing, quality, toxicity
from lodestone.llm import textkit as tk


def cell_of(gram):
    """The cell of a character n-gram, by the hash of the gram alone."""
    chars = np.array([ord(c) for c in gram], np.uint32)
    value = tk.Spans(chars)(np.array([0]), np.array([len(gram)])) + np.uint64(len(gram))
    return int((value * np.uint64(tk.POLY) >> np.uint64(64 - toxicity.CELL_BITS))[0])


def cells_of(text):
    low = "".join(c.lower() if len(c.lower()) == 1 and ord(c) < 0x600 else c for c in text)
    return {cell_of(low[i : i + n]) for n in (3, 4, 5) for i in range(len(low) - n + 1)}


@pytest.fixture(scope="module")
def small(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.substring("text", 1, 300).alias("text"), "lang", "source")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    return docs, labels


def test_toxicity_is_the_regression_on_scaled_ratios(small):
    """Log-count ratios by sets of n-grams, and the regression by Newton's method."""
    docs, labels = small
    features, least = 60, 3
    model = toxicity.fit(docs, labels, features=features, least_texts=least)
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    rows = [(text[r["doc_id"]], r["toxic"]) for r in labels.collect() if r["doc_id"] in text and zlib.crc32(str(r["doc_id"]).encode()) % 5]
    has = [cells_of(t) for t, _ in rows]
    y = np.array([t for _, t in rows])
    size = [int((y == k).sum()) for k in (0, 1)]
    assert min(size) > 0
    q, p = ({}, {})
    for own, label in zip(has, y.tolist(), strict=True):
        for c in own:
            (p if label else q)[c] = (p if label else q).get(c, 0) + 1
    ratio, rank = {}, []
    for c in p.keys() | q.keys():
        a, b = p.get(c, 0), q.get(c, 0)
        if a + b >= least:
            ratio[c] = np.log((a + 1) / (size[1] + 2)) - np.log((b + 1) / (size[0] + 2))
            both = (a + b) / len(y)
            rank.append((-abs(a / size[1] - b / size[0]) / np.sqrt(both * (1.0001 - both)), c))
    rank.sort()
    edge = rank[features - 1][0]
    got = set(np.flatnonzero(model.weights).tolist())
    assert got <= {c for s, c in rank if s <= edge + 1e-9} and got >= {c for s, c in rank if s < edge - 1e-9} - {c for c in ratio if abs(ratio[c]) < 1e-9}
    order = sorted(got)
    x = np.array([[ratio[c] * (c in own) for c in order] for own in has])
    w, b = np.zeros(len(order)), 0.0
    for _ in range(100):  # Newton's method with the same penalty on the weights
        s = 1 / (1 + np.exp(-(x @ w + b)))
        z = np.hstack([x, np.ones((len(y), 1))])
        gradient = z.T @ (s - y) / len(y) + 2e-4 * np.append(w, 0)
        hessian = (z * (s * (1 - s) / len(y))[:, None]).T @ z + np.diag([*[2e-4] * len(order), 1e-12])
        step = np.linalg.solve(hessian, gradient)
        w, b = w - step[:-1], b - step[-1]
    loss = lambda w, b: np.mean(np.log1p(np.exp(-(2 * y - 1) * (x @ w + b)))) + 1e-4 * (w @ w)
    mine = np.array([model.weights[c] / ratio[c] for c in order])
    assert loss(mine, model.intercept) <= loss(w, b) + 1e-3
    scored = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    for i, t in text.items():
        total = model.intercept + sum(float(model.weights[c]) for c in cells_of(t))
        assert scored[i] == pytest.approx(1 / (1 + np.exp(-total)), abs=1e-5)


def plain_statistics(text):
    """The statistics of a text by plain Python."""
    raw = text.encode()
    words = re.findall(rb"[^\t\n\x0b\x0c\r ]+", raw)
    lines = re.findall(rb"[^\n]*\n|[^\n]+\Z", raw)
    low = [w.lower() for w in words]
    shingles = [tuple(low[i : i + 5]) for i in range(max(1, len(low) - 4))] if low else []
    share = lambda a, b: a / max(b, 1)
    again = lambda x: 1 - len(set(x)) / len(x) if x else 0.0
    out = {"n_bytes": len(raw), "n_words": len(words), "word_length": share(sum(map(len, words)), len(words)), "blank": share(sum(c in b"\t\n\x0b\x0c\r " for c in raw), len(raw)), "wide": share(sum(c > 127 for c in raw), len(raw))}
    out |= {k: share(sum(c in members for c in raw), len(raw)) for k, members in quality.KINDS.items()}
    n_lines = raw.count(b"\n") + (len(raw) > 0)
    return out | {"line_length": share(len(raw), n_lines), "same_lines": again(lines), "same_words": again(words), "same_shingles": again(shingles), "short_words": share(sum(len(w) == 1 for w in words), len(words))}


def test_quality_statistics_equal_plain_ones(small):
    docs, _ = small
    texts = ["", " ", "\n\n", "a\nb\na\n", "A b c d e f A b c d e f", "ÄÖ ß|{}", *[r["text"] for r in docs.limit(60).collect()]]
    got = quality.statistics(*tk.buffers(pa.array(texts)))
    for k, t in enumerate(texts):
        assert {s: got[s][k] for s in quality.STATISTICS} == {s: pytest.approx(v, abs=1e-9) for s, v in plain_statistics(t).items()}, t


def test_quality_rules_equal_a_loop(small):
    """The fitted model's score is that of its rules, evaluated text by text."""
    docs, labels = small
    model = quality.fit(docs, labels, trees=6, depth=2)
    assert model.rules
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    for r in docs.collect():
        stats = plain_statistics(r["text"] or "")
        total = model.intercept + sum(w for rule, w in model.rules if all(low < stats[name] <= high for name, low, high in rule))
        assert got[r["doc_id"]] == pytest.approx(1 / (1 + np.exp(-total)), abs=1e-9)


def test_contradicting_labels_count_once(spark, small):
    docs, _ = small
    labels = spark.createDataFrame([(1, 0), (1, 1), (1, 1), (2, 0), (2, 0), (3, None), (None, 1)], "doc_id long, toxic int")
    got = labelled.sample(docs, labels, "toxic", 100).select("label").collect()
    assert sorted(r["label"] for r in got) == [k for i, k in ((2, 0), (1, 1)) if zlib.crc32(str(i).encode()) % 5]


def queueing(rows, targets, total, repeats=3):
    """Weighted fair queueing by one loop: (source, key, doc_id) rows with sizes; how often each is taken."""
    finish, upto, sizes = [], {}, {}
    for source, _, _, size in rows:
        sizes[source] = sizes.get(source, 0) + size
    for k, (source, key, doc_id, size) in sorted(enumerate(rows), key=lambda x: (str(x[1][0]), x[1][1], x[1][2])):
        upto[source] = upto.get(source, 0) + size
        if size and targets[source]:
            finish += [((upto[source] + t * sizes[source]) / targets[source], key, doc_id, t, k, size) for t in range(repeats)]
    taken = [0] * len(rows)
    for _, _, _, _, k, size in sorted(finish):
        if total < size:
            break
        total -= size
        taken[k] += 1
    return taken


@pytest.mark.parametrize("sources", [1, 2, 5])
def test_mix_equals_one_queue(small, sources):
    docs, _ = small
    docs = docs.withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").when(F.col("doc_id") % sources == 1, None).otherwise(F.concat(F.lit("s"), (F.col("doc_id") % sources).cast("string"))))
    sized = docs.select("doc_id", "source", mixing.shuffle_key(7).alias("key"), mixing.word_count(F.col("text")).alias("size")).collect()
    rows = [(r["source"], r["key"], r["doc_id"], r["size"]) for r in sized]
    sizes = {}
    for source, _, _, size in rows:
        sizes[source] = sizes.get(source, 0) + size
    goal = mixing.targets(list(sizes.items()))
    want = queueing(rows, goal, sum(sizes.values()))
    got = {r["doc_id"]: r["taken"] for r in mixing.query(docs).collect()}
    assert got == {doc_id: n * size for (_, _, doc_id, size), n in zip(rows, want, strict=True)}
