"""Edge cases and sequential operators against plain loops."""

import collections
import datetime
import difflib
import hashlib
import itertools
import json
import math
import os
import random
import re
import sqlite3
import subprocess
import sys
import time
import unicodedata
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from lodestone import session
from lodestone.functions import text as T
from lodestone.operators import containment, evaluation, fulltext, ranking, refinement, relations, retrieval, selection, surfaces, vectors, versions
from lodestone.operators import paging as O
from lodestone.operators import state as D
from lodestone.sources import foreign, session_files, stores
from lodestone.sources.versions import VersionStore
from lodestone.streaming import cursor, signals

AS_OF = "2024-03-15 00:00:00"


def ids(df, column="memory_id"):
    return sorted(r[column] for r in df.collect())


@pytest.fixture(scope="module")
def memories(spark):
    rows = [("1", "alpha beta", "active", None, "2023-01-01 00:00:00", 10), ("2", "beta", "active", 7, "2024-03-08 00:00:00", 20), ("3", None, "active", 7, "2024-03-08 00:00:01", 20), ("4", "gamma", "rejected", None, "2024-03-20 00:00:00", 99), ("5", "beta", "expired", 30, "2024-03-01 00:00:00", 5)]
    df = spark.createDataFrame(rows, "memory_id string, content string, status string, ttl_days int, at string, priority int")
    return df.withColumn("updated_at", F.col("at").cast("timestamp_ntz")).withColumn("created_at", F.col("updated_at"))


def test_ttl_boundary_is_expired(memories):
    assert ids(memories.where(selection.live(AS_OF))) == ["1", "3", "4", "5"]
    assert ids(memories.where(selection.expired(AS_OF))) == ["2"]


def test_empty_status_list_is_no_filter(memories):
    assert memories.where(selection.status_in([])).count() == 5


def test_time_window():
    assert selection.window_start("updated_at > 1m", AS_OF) == "2024-02-14 00:00:00"
    with pytest.raises(ValueError, match="time window"):
        selection.window_start("updated_at > 1y", AS_OF)


def test_literal_text_and_nulls(spark):
    df = spark.createDataFrame([(1, "100%"), (2, "a_b"), (3, None), (4, "axb")], "k int, s string")
    assert ids(df.where(selection.holds_text("s", "%")), "k") == [1]
    assert ids(df.where(selection.holds_text("s", "A_B")), "k") == [2]


def test_match_all_and_any(spark, memories):
    tags = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "a"), ("2", "a")], "memory_id string, dimension_id string")
    assert ids(relations.tagged(memories, tags, ["a", "b"], "all")) == ["1"]
    assert ids(relations.tagged(memories, tags, ["a", "b", "a"])) == ["1", "2"]
    assert ids(relations.tagged(memories, tags, [])) == []


@pytest.mark.parametrize(("raw", "ok"), [("3", 3), (None, 50), ("", 50)])
def test_limits(raw, ok):
    assert selection.parse_limit(raw) == ok


@pytest.mark.parametrize("raw", ["0", "201", "x"])
def test_bad_limits(raw):
    with pytest.raises(ValueError, match="limit"):
        selection.parse_limit(raw)


@pytest.mark.parametrize("query", ["stupid clown the", "größe año está", "AÑO esta über"])
def test_bm25_equals_fts5(spark, sf, query):
    """Over texts of all languages: words are compared without case and marks."""
    more = [(1_000_001, "Año nuevo, esta GRÖSSE Größe groesse über ubér", None, None, 0), (1_000_002, "año n\u0303 u\u0308ber ÉSTÁ", None, None, 0)]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema))
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE g USING fts5(text)")
    con.executemany("INSERT INTO g(rowid, text) VALUES (?, ?)", [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    wanted = " OR ".join(f'"{t}"' for t in query.split())
    want = dict(con.execute("SELECT rowid, bm25(g) FROM g WHERE g MATCH ?", (wanted,)))
    got = {r["doc_id"]: r["score"] for r in fulltext.bm25(docs, "doc_id", query, "text").collect()}
    assert got.keys() == want.keys() and want
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_stored_index_gives_the_same_scores(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    index = fulltext.postings(docs, "doc_id", "text")
    size = docs.agg(F.count("*").alias("n"), F.avg(F.size(fulltext.words("text"))).alias("a")).first()
    a = {r["doc_id"]: round(r["score"], 9) for r in fulltext.scores_of(index, "doc_id", ["stupid", "clown"], size["n"], size["a"]).collect()}
    assert a == {r["doc_id"]: round(r["score"], 9) for r in fulltext.bm25(docs, "doc_id", "stupid clown", "text").collect()}


def test_postings_are_counted_where_their_texts_are_dealt_to(spark):
    """Repeated keys, null keys and texts, marks, and no shuffle of a row a token."""
    rows = [("a", "É e\u0301 e", "x"), ("a", "e e e", "y"), ("a", None, "e x"), ("b", "  ", None), ("c", "", ""), (None, "one one", "два"), (None, "one", "две дома"), ("d", "İi K", "x_y")]
    docs = spark.createDataFrame(rows, "key string, title string, body string")
    want = {}
    for key, *texts in rows:
        plain = "".join(fulltext.MARKED.get(c, c) for c in " ".join(t for t in texts if t is not None).lower())
        found = [t for t in re.split(r"[\W_]+", plain) if t]
        for t in found:
            want[t, key, len(found)] = want.get((t, key, len(found)), 0) + 1
    got = fulltext.postings(docs, "key", "title", "body")
    assert got.columns == ["term", "key", "size", "tf"]
    assert {(r["term"], r["key"], r["size"]): r["tf"] for r in got.collect()} == want and got.count() == len(want)
    changed = docs.where("key = 'a'").limit(1).select("key", F.lit("new").alias("title"), F.lit(None).cast("string").alias("body"))
    after = {(r["term"], r["key"], r["size"]): r["tf"] for r in fulltext.updated(got, changed, "key", "title", "body").collect()}
    assert after == {k: n for k, n in want.items() if k[1] != "a"} | {("new", "a", 1): 1}
    assert "hashpartitioning(term" not in got._jdf.queryExecution().executedPlan().toString()


def test_empty_query_finds_nothing(spark, memories):
    assert fulltext.bm25(memories, "memory_id", " ?", "content").count() == 0


def test_bigrams(spark):
    got = spark.createDataFrame([("中文字 a bc",), ("",), (None,)], "t string").select(fulltext.bigrams("t").alias("g")).collect()
    assert [r["g"] for r in got] == [["中文", "文字", "a", "bc"], [], None]


def test_cosine_skips_zero_and_other_sizes(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", [1.0]), ("d", [-1.0, 0.0])], "memory_id string, embedding array<float>")
    found = {r["memory_id"]: r["similarity"] for r in vectors.similarities(v, vectors.vector_of(v, "a")).collect()}
    assert found == {"a": 1.0, "d": 0.0}


def test_similar_pairs_over_blocks(spark):
    v = spark.createDataFrame([(str(k), [float(k % 3), float(k % 5), 1.0]) for k in range(40)], "memory_id string, embedding array<float>")
    pairs = lambda n: sorted((r["a"], r["b"]) for r in vectors.similar_pairs(v, 0.9, n).collect())
    assert pairs(7) == pairs(1000) != []


@pytest.mark.parametrize(("pivots", "least"), [(256, 0.9), (7, 0.9), (7, 0.2), (40, 0.995)])
def test_similar_pairs_equal_all_pairs(spark, monkeypatch, pivots, least):
    """Clusters of vectors, some of another size, some without length."""
    monkeypatch.setattr(vectors, "PIVOTS", pivots)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(9, 16))
    rows = [(f"v{k:03}", (centres[k % 9] + rng.normal(size=16) * 0.25).tolist()) for k in range(300)] + [(f"s{k}", rng.normal(size=3).tolist()) for k in range(20)] + [("z", [0.0] * 16), ("y", [0.0] * 3)]
    x = {i: np.float32(v).astype(float) for i, v in rows}
    want = sorted((a, b) for a, b in itertools.combinations(sorted(x), 2) if len(x[a]) == len(x[b]) and x[a].any() and x[b].any() and x[a] @ x[b] / np.linalg.norm(x[a]) / np.linalg.norm(x[b]) >= least)
    got = vectors.similar_pairs(spark.createDataFrame(rows, "memory_id string, embedding array<float>"), least, 20).collect()
    assert sorted((r["a"], r["b"]) for r in got) == want and want


def test_vectors_that_are_not_finite_hide_no_pairs(spark):
    rng = np.random.default_rng(5)
    rows = [(str(k), (rng.normal(size=4) * 0.1 + 1).tolist()) for k in range(12)]
    odd = [(f"n{k}", [float("nan" if k % 2 else "inf"), 1.0, 1.0, 1.0]) for k in range(60)]  # so one would be a pivot
    got = vectors.similar_pairs(spark.createDataFrame(rows + odd, "memory_id string, embedding array<float>"), 0.5)
    assert sorted((r["a"], r["b"]) for r in got.collect()) == sorted(itertools.combinations(sorted(r[0] for r in rows), 2))


def test_products_in_single_precision_lose_no_pair():
    """Vectors whose similarity is the threshold, or one step of a double away from it."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(700, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sims = np.einsum("ij,kj->ik", x[:40], x)
    for least in (sims[3, 90], np.nextafter(sims[3, 90], 2)):
        want = {(i, j) for i, j in zip(*np.nonzero(sims >= least), strict=True)}
        assert {(i, j) for a, b, _ in vectors.passing(x[:40], x, least) for i, j in zip(a, b, strict=True)} == want
    alone = [(i, j) for a, b, _ in vectors.passing(x, None, 0.3) for i, j in zip(a, b, strict=True)]
    assert sorted(alone) == sorted(zip(*np.nonzero(np.triu(np.einsum("ij,kj->ik", x, x) >= 0.3, 1)), strict=True))


def test_repeated_vector_ids_are_no_pair(spark):
    rows = [("a", [1.0, 0.1]), ("a", [1.0, 0.2]), ("b", [1.0, 0.3]), (None, [1.0, 0.4])]
    got = vectors.similar_pairs(spark.createDataFrame(rows, "memory_id string, embedding array<float>"), 0.5).collect()
    assert sorted((r["a"], r["b"]) for r in got) == [("a", "b"), ("a", "b")]


@pytest.mark.parametrize("dense", [1, 10**9])
def test_dense_and_sparse_tiles_agree(monkeypatch, dense):
    monkeypatch.setattr(vectors, "DENSE", dense)
    x = np.random.default_rng(7).normal(size=(600, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found = {(i, j): s for a, b, sim in vectors.passing(x, None, 0.2) for i, j, s in zip(a.tolist(), b.tolist(), sim.tolist(), strict=True)}
    want = np.triu(x @ x.T, 1)
    assert sorted(found) == sorted(zip(*(k.tolist() for k in np.nonzero(want >= 0.2)), strict=True))
    assert all(abs(s - want[k]) < 1e-12 for k, s in found.items())


def test_vectors_travel_by_packed_rows():
    own = pa.RecordBatch.from_pydict({"memory_id": [str(k) for k in range(2500)], "embedding": pa.array([[float(k), 1.0] if k % 5 else [1.0] for k in range(2500)], pa.list_(pa.float32())), "own": [7] * 2500})
    got = [r for b in vectors._packed(iter([own])) for r in b.to_pylist()]
    assert [(r["length"], len(r["ids"])) for r in got] == [(1, 500), (2, 1024), (2, 976)]
    ids = [i for r in got for i in r["ids"]]
    assert sorted(ids, key=int) == [str(k) for k in range(2500)]
    back = np.frombuffer(got[2]["components"], np.float32).reshape(-1, 2)
    assert back[:, 0].tolist() == [float(i) for i in got[2]["ids"]]


def test_far_neighbourhoods_are_not_compared():
    pivots = np.eye(4)
    assert vectors.comparable(pivots, {0: 0.1, 1: 0.1, 3: 1.2, -1: 0.0}, np.cos(0.3)) == [(0, 0), (0, 3), (1, 1), (1, 3), (3, 0), (3, 1), (3, 3), (-1, -1)]


def test_fusion_ties_keep_the_first_route(spark):
    a = spark.createDataFrame([("x", 0), ("y", 1)], "id string, place int")
    b = spark.createDataFrame([("z", 0), ("w", 1)], "id string, place int")
    fused = retrieval.fuse({"one": a, "two": b}, "id").collect()
    assert [r["id"] for r in fused] == ["x", "z", "y", "w"]
    assert fused[0]["rrf"] == pytest.approx(1 / 61)


def test_sequential_dedup_registers_only_what_stays(spark):
    rows = [("t", 0, 1, "1", "same text"), ("t", 0, 2, "2", "same text!"), ("t", 1, 1, "2", "other"), ("t", 1, 2, "1", "new"), ("t", 2, 1, "3", "new")]
    df = spark.createDataFrame(rows, "mode string, section int, rank int, memory_id string, content string")
    assert sorted((r["section"], r["memory_id"]) for r in ranking.sequential_dedup(df).collect()) == [(0, "1"), (1, "2"), (2, "3")]


def test_chunks_keep_whole_turns():
    rows = [(k + 1, "", "user" if k % 2 == 0 else "assistant", "x" * 400) for k in range(20)]
    found = ranking.chunk_turns(rows, 2000, 1000)
    assert [k for c in found for k in c] == list(range(20))
    assert all(rows[c[0]][2] == "user" for c in found)
    assert ranking.chunk_turns([(1, "", "tool", "x")] * 45, 2000) == [list(range(20)), list(range(20, 40)), list(range(40, 45))]


def test_one_long_message_is_its_own_chunk():
    assert ranking.chunk_turns([(1, "", "user", "x" * 99_999)], 2000) == [[0]]


def test_text_chunks_cover_the_text():
    text = "".join(f"# t{k} user\n{'y' * 700}\n" for k in range(40))
    found = ranking.chunk_text(text, 3000, 800)
    assert found[0] == text[: len(found[0])]
    assert text.endswith(found[-1])
    assert all(c.startswith("# t") and len(c) <= 3000 for c in found)
    assert ranking.chunk_text("z" * 25, 10, 2) == ["z" * 10, "z" * 10, "z" * 5]


def test_rate_limit_ignores_refused():
    assert ranking.admitted([0, 1, 2, 61, 62], 2, 60) == [True, True, False, True, True]


def test_budget_batches():
    assert ranking.budget_batches([5, 5, 1, 20, 1], 10) == [0, 0, 1, 2, 3]


def test_token_bucket():
    assert signals.tokens_left([0.0, 0.0, 0.0, 10.0], 0.5, 1.0) == [0.0, 2.0, 4.0, 0.0]


def test_ndcg_without_relevant_is_one(spark):
    ranks = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("r", "c", 1)], "query string, id string, rank int")
    relevant = spark.createDataFrame([("q", "b")], "query string, id string")
    assert {r["query"]: r["ndcg"] for r in evaluation.ndcg(ranks, relevant).collect()} == {"q": 0.6309, "r": 1.0}


def test_greedy_matches(spark):
    a, b = ["the cat sat", "dogs run"], ["dogs ran", "the cat sits"]
    rows = [(1, i, x, j, y) for i, x in enumerate(a) for j, y in enumerate(b)]
    df = spark.createDataFrame(rows, "case_id long, predicted long, pred_text string, truth long, true_text string")
    got = {(r["predicted"], r["truth"]): r["similarity"] for r in evaluation.greedy_matches(df).collect()}
    assert got == {(0, 1): pytest.approx(difflib.SequenceMatcher(None, a[0], b[1]).ratio()), (1, 0): pytest.approx(difflib.SequenceMatcher(None, a[1], b[0]).ratio())}


def test_greedy_matches_work_out_only_what_may_be_taken(spark, monkeypatch):
    rng = random.Random(8)
    text = lambda: rng.choice(["", " ", "".join(rng.choice("abc ") for _ in range(rng.randrange(12)))])
    for least in (0.0, 0.5, 0.8):
        p, t = [text() for _ in range(9)], [text() for _ in range(9)]
        rows = [(i, x, j, y) for i, x in enumerate(p) for j, y in enumerate(t)]
        used_p, used_t, want = set(), set(), []
        for s, i, j in sorted(((evaluation.similarity(x, y), i, j) for i, x, j, y in rows), key=lambda r: (-r[0], r[1], r[2])):
            if s >= least and i not in used_p and j not in used_t:
                used_p.add(i)
                used_t.add(j)
                want.append((i, j, s))
        rng.shuffle(rows)
        taken = evaluation._matched([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows], least)
        assert [(rows[k][0], rows[k][2], s) for k, s in taken] == want
    ratio, worked_out = difflib.SequenceMatcher.ratio, []
    monkeypatch.setattr(difflib.SequenceMatcher, "ratio", lambda self: worked_out.append(1) or ratio(self))
    turns = ["one two three", "one two four", "another"]
    assert len(evaluation._matched([0, 0, 0, 1, 1, 1, 2, 2, 2], [x for x in turns for _ in turns], [0, 1, 2] * 3, turns * 3, 0.1)) == 3
    assert not worked_out  # each turn meets itself, so nothing else can be taken


def test_content_similarity_of_whole_texts_by_case(spark, sf):
    from lodestone.plans import registry

    cases = {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        cases.setdefault((r["conv_id"] << 32) + r["turn"] // 4, []).append((r["turn"], r["text"] or ""))
    expected = set()
    for case, items in cases.items():
        sims = [(evaluation.similarity(a, b), p, t) for p, a in items for t, b in items]
        used_p, used_t = set(), set()
        for s, p, t in sorted((x for x in sims if x[0] >= 0.6), key=lambda x: (-x[0], x[1], x[2])):
            if p not in used_p and t not in used_t:
                used_p.add(p)
                used_t.add(t)
                expected.add((case, p, t, s))
    assert len(cases) > 10 and max(len(x) for items in cases.values() for _, x in items) > 60
    assert {tuple(r) for r in registry.queries()["f12_content_similarity"](spark, sf).collect()} == expected


def test_uuid5(spark):
    names = ["care:1", "", "é"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(T.uuid5(F.col("n")).alias("u")).collect()
    assert [r["u"] for r in got] == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]


def test_normal_form(spark):
    got = spark.createDataFrame([("　Ｔｅｃｈ ",), (None,)], "n string").select(T.normalised("n").alias("u")).collect()
    assert [r["u"] for r in got] == [unicodedata.normalize("NFKC", "　Ｔｅｃｈ ").strip().lower(), ""]


@pytest.mark.parametrize(("raw", "good"), [('{"a": 1,}', '{"a": 1}'), ('{"a": "x\ty"}', '{"a": "x\\ty"}'), ("nothing", None), ("", None), ('{"a": "\\q"}', '{"a": "\\\\q"}')])
def test_json_repair(raw, good):
    assert T.repair_json(raw) == good


def test_markdown():
    page = "<html><head><title>T &amp; U</title><script>x()</script></head><body><h2>A <b>b</b></h2><p>one</p><p>two &lt;</p><ul><li><a href='/x'>L</a></li></ul></body></html>"
    assert T.markdown(page) == "T & U\n## A b\n\none\n\ntwo <\n\n- [L](/x)"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""), ("plain &amp; simple", "plain & simple"), ("<h1>A<br>b</h1>c", "# Ab\nc"), ("<h2><a href='/x'>in</a> heading</h2>", "## in heading"), ("<a>no target</a>", "no target"), ("<a href=/y> <b>B</b> </a>", "[B](/y)"),
        ("a<style>p{}</style><noscript><p>n</p></noscript>b", "ab"), ("<ul><li>one<li>two</ul>", "- one\n- two"), ("<table><tr><td>1</td></tr></table>2", "1\n\n2"), ("<h3>never ends", "never ends"), ("x<p></p><p></p><p></p>y", "x\n\ny"), ("<H1>Up</H1>", "# Up"),
    ],
)
def test_markdown_of_small_pages(page, want):
    assert T.markdown(page) == want


def test_page_title():
    assert T.page_title("<title> A &lt; B </title><title>other</title>") == "A < B"
    assert T.page_title("<p>none</p>") is None


def test_double_encoded_tags(spark):
    rows = [('["a","b"]',), ('"[\\"a\\"]"',), ("x",), (None,)]
    assert [r["t"] for r in spark.createDataFrame(rows, "s string").select(T.tag_list("s").alias("t")).collect()] == [["a", "b"], ["a"], [], []]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("key sk-aaaaaaaaaaaaaaaaaaaa and ark-0123456789-ab.", "key <REDACTED> and <REDACTED>."),
        ("API_KEY=sk-short, token = abc123, api_key: name", "API_KEY=sk-short, token = abc123, api_key: name"),
        ("own_0123456789abcdef", "own_0123456789abcdef"),
    ],
)
def test_secrets(spark, text, want):
    assert spark.createDataFrame([(text,)], "s string").select(T.redacted("s").alias("s")).first()["s"] == want


def test_secrets_of_an_installation(spark):
    df = spark.createDataFrame([("own_0123456789abcdef sk-012345678901",)], "s string")
    assert df.select(T.redacted("s", (*T.SECRET_PREFIXES, "own_")).alias("s")).first()["s"] == "<REDACTED> <REDACTED>"


def test_relative_time_of_the_future_is_null(spark):
    df = spark.createDataFrame([("2024-03-15 00:00:01",), ("2024-03-14 23:59:30",), ("2024-02-14 00:00:00",)], "s string").select(F.col("s").cast("timestamp_ntz").alias("t"))
    assert [r["l"] for r in df.select(T.relative_time("t", AS_OF).alias("l")).collect()] == [None, "刚刚", None]


def test_upsert_keeps_and_adds(spark):
    old = spark.createDataFrame([("a", 1, True), ("b", 2, True)], "id string, n int, active boolean")
    new = spark.createDataFrame([("a", None, False), ("c", 3, None)], "id string, n int, active boolean")
    got = sorted((r["id"], r["n"], r["active"]) for r in D.upsert(old, new, ["id"], keep=["active"]).collect())
    assert got == [("a", 1, True), ("b", 2, True), ("c", 3, None)]


def test_append_once_is_idempotent(spark):
    pages = spark.createDataFrame([("p", "x")], "page_id string, content string")
    entry = spark.createDataFrame([("p", "e"), ("p", "e"), ("q", "e")], "page_id string, entry string")
    once = D.appended_once(pages, entry)
    assert D.appended_once(once, entry).first()["content"] == once.first()["content"]


def test_page_rejects_unknown_sort(memories):
    with pytest.raises(ValueError, match="sort"):
        O.page(memories, "content", ("priority",), "memory_id")


SESSION = """---
format_version: 1
file_id: 6f1a
session_key: 'agent:main'
agent_id: null
started_at: '2024-03-01T00:00:00Z'
---
# 2024-03-01T00:00:00Z user
hello
# 1 line in it

## 2024-03-01T00:00:01Z system

  indented, and kept

## 2024-03-01T00:00:02Z tool
**tool**: sh

out 1

out 2

## 2024-03-01T00:00:03Z tool
no name here

## 2024-03-01T00:00:04Z assistant
"""


def test_session_parse(spark):
    body = SESSION.split("---\n", 2)[2]
    row = spark.createDataFrame([(SESSION, body)], "v string, b string").select(stores.parse_session("v").alias("m"), stores.parse_body("b").alias("b"), stores.front_matter("v", "session_key").alias("k"), stores.session_fault("v").alias("f")).first()
    assert row["k"] == "agent:main" and row["f"] is None
    want = [
        (1, "2024-03-01T00:00:00Z", "user", "hello\n# 1 line in it", None),
        (2, "2024-03-01T00:00:01Z", "system", "  indented, and kept", None),
        (3, "2024-03-01T00:00:02Z", "tool", "out 1\n\nout 2", "sh"),
        (4, "2024-03-01T00:00:03Z", "tool", "no name here", None),
        (5, "2024-03-01T00:00:04Z", "assistant", "", None),
    ]
    for messages in (row["m"], row["b"]):
        assert [(m["seq"], m["timestamp"], m["role"], m["content"], m["tool_name"]) for m in messages] == want


@pytest.mark.parametrize(
    ("text", "fault"),
    [
        (None, "no front matter"), ("", "no front matter"), ("# 2024 user\nhi\n", "no front matter"), ("---\nfile_id: a\n", "front matter isn't closed"), ("---", "front matter isn't closed"),
        ("---\nfile_id: a\nformat_version: 1\n---\n", "no file_id or session_key"), ("---\nsession_key: a\nformat_version: 1\n---\n", "no file_id or session_key"),
        ("---\nfile_id: a\nsession_key: b\n---\n", "unknown format_version"), ("---\nfile_id: a\nsession_key: b\nformat_version: 2\n---\n", "unknown format_version"), ("---\nfile_id: a\nsession_key: b\nformat_version: x\n---\n", "unknown format_version"),
        ("---\nfile_id: a\nsession_key: b\nformat_version: 1\n---\n", None),
    ],
)
def test_session_faults(spark, text, fault):
    assert spark.createDataFrame([(text,)], "v string").select(stores.session_fault("v").alias("f")).first()["f"] == fault


def test_session_folder(spark, tmp_path):
    (tmp_path / "sessions").mkdir()
    (tmp_path / "sessions" / "6f1a.md").write_text(SESSION)
    (tmp_path / "broken.md").write_text("# 2024 user\nhi\n")
    got = stores.read_sessions(spark, str(tmp_path)).collect()
    assert {(r["file_id"], r["session_key"]) for r in got} == {("6f1a", "agent:main")} and len(got) == 5


def test_session_files_are_read_as_written(spark):
    rows = [("a", 1, "t1", "user", "x\n\n", None), ("a", 2, "t2", "tool", "  y", "sh"), ("a", 3, "t3", "system", "", None)]
    said = spark.createDataFrame(rows, "file_id string, seq int, timestamp string, role string, content string, tool_name string")
    text = stores.session_text(said)
    assert text.select(stores.session_fault("text").alias("f")).first()["f"] is None
    got = text.select(F.inline(stores.parse_session("text"))).collect()
    assert [(r["seq"], r["timestamp"], r["role"], r["content"], r["tool_name"]) for r in got] == [(1, "t1", "user", "x", None), (2, "t2", "tool", "  y", "sh"), (3, "t3", "system", "", None)]


def test_subjects_that_hold_an_earlier_one_are_left_out(spark):
    rows = [("d", "a", 5), ("d", "ab", 3), ("d", "cab", 4), ("d", "b", 9), ("d", "xa y", 6), ("d", "", 0), ("e", "ab", 7), ("e", "a", 8), ("e", "zz", 1)]
    got = relations._first_in_all(spark.createDataFrame(rows, "dimension_id string, needle string, rank long"))
    assert {(r["dimension_id"], r["needle"]) for r in got.collect()} == {("d", ""), ("d", "a"), ("d", "ab"), ("d", "b"), ("e", "ab"), ("e", "a"), ("e", "zz")}


@pytest.mark.parametrize("few", [0, 10_000])
def test_supersession_equals_a_nested_loop(spark, monkeypatch, few):
    monkeypatch.setattr(containment, "FEW", few)
    rng = random.Random(4)
    letters = ["a", "b", "ab", "É", "ß", "...", "\n", "\t", " ", " ", "x y", "🙂🙂", "the", "other", "%_"]
    text = lambda n: "".join(rng.choice(letters) for _ in range(rng.randrange(n)))
    old = [(f"o{i}", None if i % 17 == 0 else text(30)) for i in range(80)] + [("long", "z" * 50_000 + "ab"), ("n0", "a subject"), (None, "a")]
    new = [(f"n{i}", s) for i, s in enumerate(["", " ", "\n", None, "a", "ab", "AB", "É", "é\n", "the other", "other the", "a b", "x  y", "nowhere", "a nowhere", "🙂", "...", "%", " a", "a "] + [text(4) for _ in range(20)])]
    dims = [(m, d) for m, _ in [*old, *new] for d in {f"d{rng.randrange(6)}" for _ in range(3)} if m != "o5"]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    fresh = frame(new, "memory_id string, subject string")
    tags = frame([*dims, *dims[:30]], "memory_id string, dimension_id string")

    def brute(new):
        ids, out = {m for m, _ in new}, {}
        for o, content in old:
            hit = [n for n, s in new if None not in (o, content, s) and o not in ids and s.lower() in content.lower() and {d for m, d in dims if m == n} & {d for m, d in dims if m == o}]
            out |= {o: min(hit)} if hit else {}
        return out

    got = relations.superseded(fresh, frame([*old, *old[:9]], "memory_id string, content string"), tags).collect()
    assert len(got) == len({r["old_id"] for r in got}) > 40
    assert {r["old_id"]: r["new_id"] for r in got} == brute(new)
    some = [(m, s) for m, s in new if s in ("ab", "the other")]
    got = relations.superseded(frame(some, "memory_id string, subject string"), frame(old, "memory_id string, content string"), tags).collect()
    assert {r["old_id"]: r["new_id"] for r in got} == brute(some)
    none = relations.superseded(fresh.where("subject IS NULL"), frame(old, "memory_id string, content string"), tags)
    assert none.collect() == [] and none.columns == ["old_id", "new_id"]


def test_mentions_equal_a_nested_loop(spark):
    rng = random.Random(3)
    parts = ["ab", "abc", "b", "cab", "é", "世界", "-", "--", "?!", " ", "  ", ".", "x1"]
    some = lambda n: "".join(rng.choice(parts) for _ in range(n))
    texts = [(k, some(rng.randint(0, 30))) for k in range(150)] + [(200, None), (201, "")]
    needles = {some(rng.randint(1, 4)) for _ in range(40)} | {t[a : a + n] for _, t in texts[:150] for a, n in [(rng.randint(0, 9), rng.randint(0, 25))]} | {"", "zzz", "ab ab ab ab ab ab", "?", " "}
    got = containment.mentions(spark.createDataFrame(texts, "text_id int, text string"), spark.createDataFrame([(n,) for n in [*needles, *needles]] + [(None,)], "needle string"))
    want = sorted((i, n) for i, t in texts if t is not None for n in needles if n in t)
    assert sorted(map(tuple, got.collect())) == want
    none = spark.createDataFrame([], "needle string")
    assert containment.mentions(spark.createDataFrame(texts, "text_id int, text string"), none).count() == 0


def test_runs_of_titles_are_looked_for_by_their_rarest(spark):
    n = 40
    texts = spark.createDataFrame([(k, f"so xp commonword q{k} zz, of the in a b{k} yes, xl middle r{k % 7}") for k in range(n)], "text_id int, text string")
    needles = [f"p commonword q{k} z" for k in range(n)] + [f"of the in a b{k} y" for k in range(n)] + [f"l middle r{k}" for k in range(7)]
    df = spark.createDataFrame([(x,) for x in needles], "needle string")
    want = {(k, x) for k in range(n) for x in (f"p commonword q{k} z", f"of the in a b{k} y", f"l middle r{k % 7}")}
    assert {tuple(r) for r in containment.mentions(texts, df).collect()} == want
    near = containment._by_runs(texts, df.where("needle NOT LIKE 'l %'").withColumn("w", containment._words("needle")), [4, 5])
    assert near.count() == 2 * n  # a needle meets the texts of its rarest run, not those of its first


@pytest.mark.parametrize("sent", [0, 1 << 20])
def test_what_no_string_asks_for_is_not_shuffled(spark, monkeypatch, sent):
    rng = random.Random(6)
    vocabulary = [f"{a}{b}{c}" for a in "qwrtz" for b in "aeiou" for c in "bcdfghkl"]
    texts = [(k, " ".join(rng.choice(vocabulary) for _ in range(400))) for k in range(150)]
    cut = lambda k, n: " ".join(texts[k][1].split(" ")[3 : 3 + n])[1:-1]
    needles = sorted({cut(k, n) for k in range(60) for n in (3, 4, 5, 7, 9)} | {cut(k, 2) for k in range(5)} | {"aq", "zz z", ". "})
    monkeypatch.setattr(containment, "SENT", sent)
    for name in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        spark.conf.set(name, -1)  # as if no side were small
    try:
        store, doubles = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
        stages = lambda: [(x.stageId(), x.shuffleWriteRecords()) for found in [store.stageList(None, False, False, doubles, None)] for x in map(found.apply, range(found.size()))]
        last = max((i for i, _ in stages()), default=-1)
        got = containment.mentions(spark.createDataFrame(texts, "text_id int, text string").repartition(4).persist(), spark.createDataFrame([(n,) for n in needles], "needle string"))
        assert sorted(map(tuple, got.collect())) == sorted((k, n) for k, t in texts for n in needles if n in t)
        shuffled = sum(n for i, n in stages() if i > last)
    finally:
        for name in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
            spark.conf.unset(name)
    assert shuffled < 150 * 400 / 2  # of 60 000 words, and nearly as many runs of each kind


def test_events_after_cursors(spark):
    events = spark.createDataFrame([(k, f"2024-01-{1 + k // 5:02} 0{k % 5}:00:00") for k in range(40)], "event_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    rows = [("none", None, None), ("early", "2020-01-01 00:00:00", 5), ("mid", "2024-01-03 02:00:00", 11), ("tie", "2024-01-03 02:00:00", 12), ("late", "2024-02-01 00:00:00", 0), ("last", "2024-01-08 04:00:00", 39)]
    cursors = spark.createDataFrame(rows, "subscriber_id string, last_ts string, last_id long").withColumn("last_ts", F.col("last_ts").cast("timestamp_ntz"))
    got = sorted((r["subscriber_id"], r["event_id"]) for r in relations.after(events, cursors).collect())
    assert got == sorted([("none", k) for k in range(40)] + [("early", k) for k in range(40)] + [("mid", k) for k in range(12, 40)] + [("tie", k) for k in range(13, 40)])
    assert relations.after(events.where("false"), cursors).count() == 0


def test_denied_models(spark):
    models = spark.createDataFrame([("gpt-x", 1), ("gpt-x", 2), ("abc", 3), (None, 4), ("", 5)], "model string, n int")
    denied = lambda *p: spark.createDataFrame([(x,) for x in p], "prefix string")
    assert sorted(r["n"] for r in selection.allowed_models(models, denied("gpt-", "abcd", None)).collect()) == [3, 4, 5]
    assert sorted(r["n"] for r in selection.allowed_models(models, denied("")).collect()) == [4]


def test_templates():
    good = {"base": "{name: base, memory_types: [a, b], token_budget: 900, sections: [{title: x, query: {dimensions: [a], limit: 3}}]}", "own": "{name: own, extends: base, sections: [{title: y, query: {dimensions: [b]}}, {title: x, query: {dimensions: [a, b], limit: 4}}]}"}
    got = surfaces.load_template(good, "own", ["a", "b"])
    assert [(s["title"], s["query"].get("limit")) for s in got["sections"]] == [("x", 4), ("y", None)]
    assert got["name"] == "own" and got["token_budget"] == 900 and got["memory_types"] == ["a", "b"]
    for text, reason in (
        ("{name: other}", "calls itself"), ("{name: t, extends: none}", "isn't"), ("{name: t, extends: own}", "extends another"), ("{name: t, memory_types: [a]}", "no sections"),
        ("{name: t, memory_types: [c], sections: [{title: x, query: {dimensions: [c], limit: 1}}]}", "memory_types c"), ("{name: t, memory_types: [a], sections: [{title: x, query: {dimensions: [b], limit: 1}}]}", "dimension b"),
        ("{name: t, extends: base, token_budget: 50}", "token_budget"), ("{name: t, extends: base, sections: [{title: x, query: {dimensions: [a], limit: 51}}]}", "limit 51"), ("{name: t, extends: base, sections: [{title: x, query: {dimensions: [a], match: some}}]}", "match some"),
        ("{name: t, extends: base, sections: [{title: x, query: {dimensions: [a], sort: size}}]}", "sort size"), ("{name: t, extends: base, sections: [{title: x, query: {dimensions: [a], priority_min: 101}}]}", "priority_min 101"),
    ):
        with pytest.raises(ValueError, match=reason):
            surfaces.load_template(good | {"t": text}, "t", ["a", "b"])


def test_blocks_of_vectors_grow_and_bins_need_no_pairs(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 6))
    df = spark.createDataFrame([(str(k), [float(c) for c in v]) for k, v in enumerate(x)], "memory_id string, embedding array<float>")
    unit = x.astype(np.float32).astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    sims = (unit @ unit.T)[np.triu_indices(600, 1)]
    want = collections.Counter(np.floor(sims[sims >= 0.2] * 10 + 1e-9).astype(int).tolist())
    monkeypatch.setattr(vectors, "AT_ONCE", 1000)
    for blocks in (2, 64):
        monkeypatch.setattr(vectors, "BLOCKS", blocks)
        assert {r["bin"]: r["n"] for r in vectors.similarity_bins(df, 0.2).collect()} == want
        assert vectors.similar_pairs(df, 0.7).count() == (sims >= 0.7).sum()


def test_texts_reach_models_by_small_batches(spark):
    for key in ("maxRecordsPerBatch", "maxBytesPerBatch"):
        spark.conf.unset(f"spark.sql.execution.arrow.{key}")
    prompts = spark.range(1200).coalesce(1).selectExpr("id", "'x' AS prompt")
    got = refinement.answers(prompts, lambda p: p.map(lambda _, n=len(p): str(n))).select(F.col("answer").cast("int").alias("n"))
    assert got.count() == 1200 and got.agg(F.max("n")).first()[0] <= 500
    for key in ("maxRecordsPerBatch", "maxBytesPerBatch"):
        spark.conf.unset(f"spark.sql.execution.arrow.{key}")
    stores.ingest(spark.createDataFrame([("https://a", "<p>b</p>")], "source string, body string"))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 500


def test_constants_of_fusion_share_what_is_relevant(spark):
    seen = spark.sparkContext.accumulator(0)

    def note(x):
        seen.add(1)
        return x

    note_udf = F.udf(note, "string").asNondeterministic()
    relevant = spark.createDataFrame([("q", "a"), ("q", "c"), ("r", "b")], "query string, id string").select("query", note_udf("id").alias("id"))
    rankings = lambda c: spark.createDataFrame([("q", x, n + 1) for n, x in enumerate("abc" if c == 1 else "bca")] + [("s", "z", 1)], "query string, id string, rank int")
    got = [tuple(r) for r in evaluation.best_constant(rankings, relevant, (1, 2, 3, 4)).collect()]
    first = lambda *ranks: round(sum(1 / math.log2(r + 1) for r in ranks) / (1 + 1 / math.log2(3)), 4)
    assert [k for k, _ in got] == [1, 2, 3, 4]
    assert got[0][1] == pytest.approx((first(1, 3) + 0 + 1) / 3) and got[1][1] == pytest.approx((first(2, 3) + 0 + 1) / 3)
    assert seen.value <= 6  # twice, whatever the number of constants


def test_suppression_of_many_keys_shares_few_states(spark, tmp_path):
    """Keys of one state, null ones among them, don't see each other over batches."""
    rng, want, last = random.Random(3), {}, {}
    (tmp_path / "in").mkdir()
    for n in range(3):
        rows = sorted((n * 4000 + rng.randrange(4000), n * 1000 + k, rng.choice(["a", "b", None]), rng.choice([1, 2, None, *range(3, 40)])) for k in range(200))
        for t, k, kind, user in rows:
            want[k] = (kind, user) in last and t - last[kind, user] <= 1800
            last[kind, user] = t
        at = [datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=t) for t, *_ in rows]
        users = pa.array([u for *_, u in rows], pa.int64())
        pq.write_table(pa.table({"event_id": [k for _, k, *_ in rows], "event_type": [x[2] for x in rows], "user_id": users, "ts": pa.array(at, pa.timestamp("us")), "value": [0.0] * 200}), tmp_path / "in" / f"{n}.parquet")
        os.utime(tmp_path / "in" / f"{n}.parquet", (1_700_000_000 + n, 1_700_000_000 + n))
    stream = signals.with_suppression(signals.events_stream(spark, str(tmp_path / "in"), 1), buckets=2)
    assert {r["event_id"]: r["suppress_hint"] for r in signals.drained(stream, "shared").collect()} == want


def test_kept_times_answer_alike():
    rng = random.Random(5)
    for _ in range(50):
        times = sorted(rng.randint(0, 200) for _ in range(rng.randint(1, 40)))
        kept = signals.kept_times(times, 20)
        assert set(kept) <= set(times) and len(kept) <= 2 * (200 // 20 + 1)
        for t in range(230):
            near = lambda ts, t=t: any(0 <= t - x <= 20 for x in ts)
            assert near(kept) == near(times)


def test_suppression_over_batches(spark, tmp_path):
    """Several files, each a batch, with events that come late."""
    rng = random.Random(7)
    start, rows = datetime.datetime(2024, 1, 1), []
    for k in range(240):
        at = start + datetime.timedelta(minutes=10 * k - (rng.randint(0, 300) if rng.random() < 0.3 else 0))
        rows.append((k, rng.choice("ab"), rng.randint(0, 1), at, 1.0))
    for n in range(6):
        part = spark.createDataFrame(rows[40 * n : 40 * n + 40], "event_id long, event_type string, user_id long, ts timestamp, value double")
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    got = {r["event_id"]: r["suppress_hint"] for r in signals.drained(signals.with_suppression(signals.events_stream(spark, str(tmp_path / "in"), 1)), "test").collect()}
    want, known = {}, {}
    for n in range(6):
        for i, kind, user, at, _ in sorted(rows[40 * n : 40 * n + 40], key=lambda r: (r[3], r[0])):
            before = known.setdefault((kind, user), [])
            want[i] = any(datetime.timedelta(0) <= at - t <= datetime.timedelta(seconds=1800) for t in before)
            before.append(at)
    assert got == want and any(want.values())


def test_unique_events_over_batches(spark, tmp_path):
    for n in range(3):
        rows = [(k, "a", 1, datetime.datetime(2024, 1, 1, n), 1.0) for k in range(5 * n, 5 * n + 10)]
        spark.createDataFrame([*rows, rows[0]], "event_id long, event_type string, user_id long, ts timestamp, value double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = signals.drained(signals.unique_events(signals.events_stream(spark, str(tmp_path / "in"), 1)).select("event_id"), "unique-test")
    assert sorted(r["event_id"] for r in got.collect()) == list(range(20))


def test_evaluation_of_a_search(spark):
    relevant = spark.createDataFrame([("q", "a"), ("q", "b"), ("r", "c"), ("r", "c")], "query string, id string")
    queries = spark.createDataFrame([("q",), ("r",), ("s",), ("q",)], "query string")
    found = lambda q: q.where("query = 'q'").select("query", F.lit("b").alias("id"), F.lit(2).alias("rank"))
    got = {r["query"]: (r["ndcg"], r["recall"]) for r in evaluation.evaluated(found, queries, relevant).collect()}
    assert got == {"q": (round((1 / math.log2(3)) / (1 + 1 / math.log2(3)), 4), 0.5), "r": (0.0, 0.0), "s": (1.0, 1.0)}


def test_shared_folder_needs_its_setting_on_a_cluster(spark, monkeypatch):
    class Session:
        conf = type("Conf", (), {"get": staticmethod(lambda name, default: None)})
        sparkContext = type("Context", (), {"master": "spark://host:7077", "applicationId": "x"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Session)
    folder = session.shared_dir(spark)
    kept = session.materialize(spark.range(3), "kept")
    assert kept.count() == 3 and session.shared_dir(spark) == folder


def test_clean_removes_what_was_written(monkeypatch, spark, tmp_path):
    monkeypatch.setattr(session, "_WRITTEN", {})
    monkeypatch.setitem(session._FOLDERS, spark.sparkContext.applicationId, str(tmp_path))
    monkeypatch.setattr(session, "shared_dir", lambda s: str(tmp_path))
    session.materialize(spark.range(3), "gone")
    assert len(list(tmp_path.iterdir())) == 1
    assert session.clean(spark) == 1 and not list(tmp_path.iterdir()) and session.clean(spark) == 0


def test_null_contents_are_no_duplicates(spark):
    df = spark.createDataFrame([("a", None, 1), ("b", None, 2), ("c", "x", 1), ("d", "x", 2)], "memory_id string, content string, at int").withColumns({"updated_at": F.col("at"), "created_at": F.col("at")})
    assert [(r["memory_id"], r["superseded_by"]) for r in ranking.keepers(df).collect()] == [("c", "d")]


def test_empty_inputs(spark, memories):
    none = memories.where("false")
    assert ranking.keepers(none).count() == 0
    assert O.distinct_contents(none, "memory_id").count() == 0
    assert D.rule_decisions(none, memories).count() == 0
    assert vectors.similar_pairs(spark.createDataFrame([], "memory_id string, embedding array<float>"), 0.5).count() == 0


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("run  Daemon now", "run Daemon gateway now"), ("daemonize  it", "daemonize  it"), ("gateway daemon", "gateway daemon"), ("daemon-1 daemon", "daemon gateway-1 daemon gateway"),
        ("the old proxy", "the old proxy gateway"), ("proxy daemon", "proxy daemon gateway"), ("c++ code", "c++ cpp$1 code"), ("x", "x y z"), (None, None), ("", ""),
    ],
)
def test_alias_terms(spark, query, want):
    aliases = {"daemon": "gateway", "OLD  proxy": "gateway", "c++": "cpp$1", "x": "y", "y": "z", "": "q", "q": " "}
    assert spark.createDataFrame([(query,)], "q string").select(T.with_canonical_terms("q", aliases).alias("q")).first()["q"] == want


# session files


def _said(spark, rows):
    return spark.createDataFrame([(f, n, f"2024-01-01T00:00:{n:02d}Z", role, text, kind) for f, n, role, text, kind in rows], "file_id string, seq int, timestamp string, role string, content string, source_type string")


def _files(path):
    return {p.relative_to(path).as_posix(): p.read_text() for p in path.rglob("*.md") if "_batches" not in p.parts}


def test_session_files_grow_by_whole_batches_once(spark, tmp_path):
    one = _said(spark, [("a", 1, "user", "hi", "session"), ("b/..", 1, "user", "é\n\n# not a head", "upload"), ("c", 1, "tool", "", "other"), (None, 1, "user", "lost", "session")])
    more = _said(spark, [("a", 2, "assistant", "ho", "session"), ("d", 1, "user", None, "external")])
    path = str(tmp_path / "l0")
    stores.write_sessions(one, path, "1")
    assert set(_files(tmp_path / "l0")) == {"sessions/a.md", "uploads/b%2F...md", "sessions/c.md"}
    for _ in range(2):
        stores.write_sessions(more, path, "2")
    got = sorted((r["file_id"], r["folder"], r["seq"], r["role"], r["content"]) for r in stores.read_sessions(spark, path).collect())
    assert got == [("a", "sessions", 1, "user", "hi"), ("a", "sessions", 2, "assistant", "ho"), ("b/..", "uploads", 1, "user", "é\n\n# not a head"), ("c", "sessions", 1, "tool", ""), ("d", "external", 1, "user", "")]
    left = [p for p in (tmp_path / "l0" / "_batches").rglob("*.md")]
    assert left == []


def test_aborted_batch_leaves_files_as_they_were(spark, tmp_path):
    path = str(tmp_path / "l0")
    stores.write_sessions(_said(spark, [("a", 1, "user", "hi", "session")]), path, "1")
    before = _files(tmp_path / "l0")
    bad = _said(spark, [("a", 2, "user", "ho", "session"), ("b", 1, "user", "x", "session")]).withColumn("content", F.when(F.col("file_id") == "b", F.raise_error(F.lit("lost"))).otherwise(F.col("content")))
    with pytest.raises(Exception, match="lost"):
        stores.write_sessions(bad, path, "2")
    assert _files(tmp_path / "l0") == before


def test_batch_that_ends_between_its_moves_is_finished_and_not_repeated(tmp_path, monkeypatch):
    path = str(tmp_path)
    row = lambda f, text: {"file_id": f, "source_type": "session", "head": "H", "first": text, "blocks": text}
    first = session_files.SessionWriter(path, "1")
    first.commit([first.write(iter([row("a", "1"), row("b", "1")]))])
    again = session_files.SessionWriter(path, "2")
    staged = again.write(iter([row("a", "2"), row("b", "2")]))
    move, moved = session_files.Folder.move, []

    def breaks(self, name, to):
        if len(moved) == 2:  # the list and one file
            raise OSError("driver lost")
        moved.append(to)
        move(self, name, to)

    monkeypatch.setattr(session_files.Folder, "move", breaks)
    with pytest.raises(OSError, match="driver lost"):
        again.commit([staged])
    monkeypatch.setattr(session_files.Folder, "move", move)
    assert sorted(_files(tmp_path).values()) == ["H1", "H12"]
    for _ in range(2):
        retry = session_files.SessionWriter(path, "2")
        retry.commit([retry.write(iter([row("a", "2"), row("b", "2")]))])
        assert _files(tmp_path) == {"sessions/a.md": "H12", "sessions/b.md": "H12"}


# chains, repair, chunks, cards


@pytest.mark.parametrize("n", [1, 5, 3000])
def test_archive_chain_of_any_length(spark, n):
    rows = [(str(k), str(k - 1), k) for k in range(1, n + 1)] + [("x", "y", 0), ("y", "x", 0), ("z", None, 0), (None, "0", 0), ("p", "q", 0)]
    archive = spark.createDataFrame(rows, "memory_id string, superseded_by string, archived_at int")
    assert [r["memory_id"] for r in relations.archive_chain(archive, "0").collect()] == [str(k) for k in range(1, n + 1)]
    assert sorted(r["memory_id"] for r in relations.archive_chain(archive, "x").collect()) == ["x", "y"]
    assert relations.archive_chain(archive.where("false"), "0").count() == 0


@pytest.mark.parametrize(("raw", "good"), [('{"a": "b, ] c",}', '{"a": "b, ] c"}'), ('[{"a":1} {"a":2}]', '[{"a": 1}, {"a": 2}]'), ('{"a":1 "b":[1 2,,3,] , "c":{"d":null,}}', '{"a": 1, "b": [1, 2, 3], "c": {"d": null}}'), ('{"a": "b\nc" "d": -1.5e3}', '{"a": "b\\nc", "d": -1500.0}'), ('{"k": "say \\"hi\\", ok"}', '{"k": "say \\"hi\\", ok"}'), ('{"a": "\\u00e9 \\u12"}', '{"a": "é \\\\u12"}'), ('\x00{"a":\x011}', '{"a": 1}'), ('{"a": "open', None), ("[" * 100_000, None)])
def test_json_repair_knows_strings(raw, good):
    assert T.repair_json(raw) == good


@settings(max_examples=200, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(), lambda x: st.lists(x) | st.dictionaries(st.text(), x), max_leaves=12))
def test_json_repair_leaves_right_json(value):
    assert json.loads(T.repair_json(json.dumps(value, indent=1))) == value
    assert json.loads(T.repair_json(json.dumps(value, ensure_ascii=False))) == value


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.integers(0, 60)), max_size=12), st.integers(5, 80), st.integers(0, 40))
def test_text_chunks_end_at_heads_and_lose_nothing(parts, most, overlap):
    text = "".join(("# t user\n" if head else "") + "y" * n + "\n" for head, n in parts)
    found, at, starts = ranking.chunk_text(text, most, overlap), 0, {m.start() for m in ranking.HEADER.finditer(text)}
    covered = 0
    for k, c in enumerate(found):
        at = text.index(c, at) if k == 0 else next(a for a in range(at + 1, covered + 1) if text.startswith(c, a) and (a == covered or a in starts))
        assert at <= covered
        assert covered - at <= overlap or covered - at <= most
        covered = at + len(c)
        assert len(c) <= most or at in starts
    assert covered == len(text)


def test_schema_faults(spark):
    cards = [None, "", "no json", "[]", "{}", '{"data": {"name": "n", "description": "d"}}', '{"data": {"name": 3, "description": " ", "extensions": []}}', '{"data": null, "a": 1, "b": 2}', '{"data": {"name": "n", "description": "d", "extensions": {"x": 1, "care": {"frequency": null, "z": 1}}}}']
    df = spark.createDataFrame(list(enumerate(cards)), "k int, card string")
    got = {r["k"]: r["f"] for r in df.select("k", surfaces.schema_faults("card", surfaces.ROLE_CARD).alias("f")).collect()}
    no = ["$: wrong kind"]
    assert [got[k] for k in range(9)] == [no, no, no, no, ["$.data: missing"], [], ["$.data.description: missing", "$.data.extensions: wrong kind", "$.data.name: wrong kind"], ["$.a: unknown", "$.b: unknown", "$.data: missing"], ["$.data.extensions.care.z: unknown"]]


def test_pages_without_status_are_active(spark):
    pages = spark.createDataFrame([("a", "t", "c", None, "2024-01-01", None), ("b", "t", "c", "active", "2024-01-02", "x"), ("d", "t", "c", "deleted", "2024-01-03", "x")], "page_id string, title string, category string, status string, updated_at string, content string")
    assert {(r["page_id"], r["status"], r["supersedes"]) for r in D.pages_superseded(pages).collect()} == {("a", "superseded", None), ("b", "active", "a"), ("d", "deleted", None)}
    entries = spark.createDataFrame([("a", "new")], "page_id string, entry string")
    once = D.appended_once(pages, entries)
    assert [r["content"].count("new") for r in D.appended_once(once, entries).where("page_id = 'a'").collect()] == [1]


def test_entry_without_optional_modules():
    code = "import sys; sys.modules['public_tokenizers'] = None; import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries())"
    out = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parent.parent, capture_output=True, text=True, timeout=120)
    assert int(out.stdout.split()[0]) > 300 and out.stdout.split()[1] == "False", out.stderr


# other programs' stores


def _log(folder, workspace, session, raw):
    at = folder / workspace / session / "session.jsonl.zstd"
    at.parent.mkdir(parents=True)
    at.write_bytes(raw)


def test_logs_that_others_wrote(spark, tmp_path):
    events = ['{"type": "user", "ms": 1, "content": [{"type": "text", "text": "é"}]}', "no json", '{"type": "turn/end"}', '{"type": "assistant", "ms": 2, "content": []}']
    one = zstandard.compress("\n".join(events[:2]).encode() + b"\n") + zstandard.compress("\n".join(events[2:]).encode())  # two frames, no end of line
    large = "".join(f'{{"type": "user", "ms": {k}, "content": [{{"type": "text", "text": "{random.Random(k).random()}"}}]}}\n' for k in range(5000)).encode()
    _log(tmp_path, "home", "a", one)
    _log(tmp_path, "home", "cut", zstandard.compress(large)[:-2000])
    _log(tmp_path, "home", "bad", b"no zstd at all")
    _log(tmp_path, "home", "empty", b"")
    _log(tmp_path, "Temp-x", "b", one)
    (tmp_path / "home" / "a" / "other.txt").write_text("x")
    lines = stores.read_logs(spark, str(tmp_path)).cache()
    assert [r["event"] for r in lines.where("session = 'a'").orderBy("line").collect()] == events
    faults = {r["session"]: r["fault"] for r in lines.where("fault IS NOT NULL").collect()}
    assert faults == {"cut": "truncated", "bad": "damaged"}
    whole = [r["event"] for r in lines.where("session = 'cut' AND event IS NOT NULL").orderBy("line").collect()]
    assert 0 < len(whole) < 5000 and whole == large.decode().split("\n")[: len(whole)]
    assert {r["session"] for r in lines.collect()} == {"a", "cut", "bad"}
    assert [(r["role"], r["content"]) for r in stores.event_messages(stores.logged_events(lines.where("session = 'a'"))).collect()] == [("user", "é")]


def test_sqlite_rows_by_ranges_and_filters(spark, tmp_path, monkeypatch):
    for k in range(2):
        con = sqlite3.connect(tmp_path / f"s{k}.db")
        con.execute("CREATE TABLE m (id INTEGER, who, said)")
        con.executemany("INSERT INTO m VALUES (?, ?, ?)", [(n, "u" if n % 3 else None, f"t{n}" if n % 2 else n) for n in range(k * 50, k * 50 + 50)])
        con.execute("DELETE FROM m WHERE id % 7 = 0")
        con.commit()
        con.close()
    want = [(n, "u" if n % 3 else None, f"t{n}" if n % 2 else str(n)) for n in range(100) if n % 7]
    df = stores.read_foreign(spark, str(tmp_path), "m", "id long, who string, said string")
    assert sorted(map(tuple, df.collect())) == want
    got = df.where("id >= 20 AND who IS NOT NULL AND said IN ('t23', '26', '4') AND id % 2 = 1")
    assert list(map(tuple, got.collect())) == [(23, "u", "t23")]
    reader = foreign.SqliteReader(str(tmp_path), "m", df.schema)
    monkeypatch.setattr(foreign, "SQLITE_ROWS", 20)
    parts = reader.partitions()
    assert len(parts) == 6
    assert list(reader.pushFilters([ds.GreaterThan(("id",), 60), ds.StringContains(("said",), "t")])) == [ds.StringContains(("said",), "t")]
    assert sorted(x["id"] for p in parts for b in reader.read(p) for x in b.to_pylist()) == [n for n, *_ in want if n > 60]


def test_foreign_messages(spark):
    sessions = spark.createDataFrame([("a", 60.0), ("b", None)], "id string, started_at double")
    messages = spark.createDataFrame([(5, "a", "user", "late", 120.0), (2, "a", "user", " ", 1.0), (1, "a", "user", "first", None), (1, "b", "tool", "x", 0.0), (1, "none", "user", "lost", 1.0), (2, "b", "user", None, 1.0)], "id long, session_id string, role string, content string, timestamp double")
    got = sorted(tuple(r[c] for c in ("file_id", "seq", "timestamp", "content")) for r in stores.foreign_messages(sessions, messages).collect())
    assert got == [("a", 1, "1970-01-01T00:01:00Z", "first"), ("a", 2, "1970-01-01T00:02:00Z", "late"), ("b", 1, None, "x")]


# events past a cursor


def _events(path, rows):
    at = [None if us is None else datetime.datetime(2024, 1, 1) + datetime.timedelta(microseconds=us) for us, _ in rows]
    pq.write_table(pa.table({"event_id": pa.array([i for _, i in rows], pa.int64()), "ts": pa.array(at, pa.timestamp("us")), "batch_": [str(i) for _, i in rows]}), path, row_group_size=4)


def test_cursor_stream_deals_each_event_once_in_order(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.randrange(12), k) for k in range(40)] + [(None, 90), (5, None)]
    rng.shuffle(rows)
    folder, base = tmp_path / "events", str(tmp_path / "base")
    folder.mkdir()
    for k in range(3):
        _events(folder / f"{k}.parquet", rows[k::3])
    want = [i for us, i in sorted(r for r in rows if None not in r)]

    def dealt():
        got = spark.read.parquet(f"{base}/out").collect()
        assert max(collections.Counter(r["batch"] for r in got).values()) <= 7
        return [r["event_id"] for r in sorted(got, key=lambda r: (r["batch"], r["ts"], r["event_id"]))]

    cursor.dealt_with(cursor.past_cursor(spark, str(folder), 7), base, 2)
    assert dealt() == want[:14]
    cursor.dealt_with(cursor.past_cursor(spark, str(folder), 7), base)
    assert dealt() == want
    _events(folder / "later.parquet", [(20, 200), (13, 201)])
    cursor.dealt_with(cursor.past_cursor(spark, str(folder), 7), base)
    assert dealt() == [*want, 201, 200]


def test_cursor_deals_a_long_log_in_few_triggers(spark, tmp_path):
    rng = random.Random(7)
    rows = [(rng.randrange(60), k) for k in range(150)] + [(None, 990), (5, None)]
    rng.shuffle(rows)
    folder, base = tmp_path / "events", str(tmp_path / "base")
    folder.mkdir()
    for k in range(3):
        _events(folder / f"{k}.parquet", rows[k::3])
    want = [i for _, i in sorted(r for r in rows if None not in r)]
    cursor.dealt_with(cursor.past_cursor(spark, str(folder), 7), base, 2)
    got = cursor.dealt_with(cursor.past_cursor(spark, str(folder), ahead=True), base, size=7).collect()
    assert {r["event_id"]: r["batch"] for r in got} == {i: k // 7 for k, i in enumerate(want)} and len(got) == len(want)
    assert len(list((tmp_path / "base" / "out").glob("trigger=*"))) <= 4  # one was begun and not committed, and comes again
    _events(folder / "later.parquet", [(400, 2000), (399, 2001), (400, 1999)])
    got = cursor.dealt_with(cursor.past_cursor(spark, str(folder), ahead=True), base, size=2).collect()
    assert sorted((r["batch"], r["event_id"]) for r in got)[-3:] == [(22, 1999), (22, 2001), (23, 2000)] and len(got) == 153


def test_cursor_reads_few_row_groups(tmp_path, monkeypatch):
    _events(tmp_path / "e.parquet", [(k, k) for k in range(400)])
    reader, read = cursor.CursorReader(str(tmp_path), 10, cursor.BEGIN), []
    table = reader._table
    monkeypatch.setattr(reader, "_table", lambda place, k: (read.append(k), table(place, k))[1])
    at = {"us": (datetime.datetime(2024, 1, 1) - cursor.EPOCH) // datetime.timedelta(microseconds=1) + 201, "id": 201}
    rows, end = reader.read(at)
    assert [r[0] for r in rows] == list(range(202, 212)) and end["id"] == 211
    assert read == [50, 51, 52]
    assert [r[0] for r in reader.readBetweenOffsets(at, end)] == list(range(202, 212))
    assert reader.read(end | {"us": end["us"] + 10**9})[1]["us"] == end["us"] + 10**9


def test_versions_as_of_each_run(spark):
    rng = random.Random(2)
    moment = lambda k: None if k is None else f"2024-01-{1 + k // 24:02d} {k % 24:02d}:00:00"
    log = [(rng.choice(["p", "q", None]), rng.choice([None, *range(0, 300)]), n, rng.choice(["activate", "split", "unsplit", "publish"]), f"v{n}", f"w{n}", 0.5) for n in range(80)]
    runs = [(rng.choice(["p", "q", "r", None]), f"k{n}", rng.choice([None, *range(0, 320)]), "own" if n % 9 == 0 else None) for n in range(300)]
    want = {}
    for name, key, at, override in runs:
        active = split = None
        for x in sorted((x for x in log if x[1] is not None), key=lambda x: x[1:3]):
            if name is not None and at is not None and x[0] == name and x[1] <= at:
                active = x[4] if x[3] == "activate" else active
                split = x[4:7] if x[3] == "split" else None if x[3] == "unsplit" else split
        side = split and (split[0] if int(hashlib.sha256(key.encode()).hexdigest()[:16], 16) % 100 < 50 else split[1])
        want[key] = override or side or active
    log_df = spark.createDataFrame([(a, moment(b), *x) for a, b, *x in log], "name string, t string, seq int, action string, version string, other string, share double").withColumn("at", F.col("t").cast("timestamp_ntz"))
    runs_df = spark.createDataFrame([(a, k, moment(b), o) for a, k, b, o in runs], "name string, key string, t string, override string").withColumn("at", F.col("t").cast("timestamp_ntz")).withColumn("active", F.lit("clash"))
    got = versions.versions_at(runs_df, log_df)
    assert got.columns == [*runs_df.columns, "version"]
    assert {r["key"]: r["version"] for r in got.collect()} == want
    assert versions.versions_at(runs_df, log_df.where("false")).where("version <> 'own'").count() == 0


# versions of files


def test_versions_of_files(spark, tmp_path):
    def files(**held):
        rows = [(n, None if t is None else t.encode(), d) for n, (t, d) in held.items()]
        return spark.createDataFrame(rows, "name string, content binary, d string").select("name", "content", F.col("d").cast("timestamp_ntz").alias("modified"))

    def read(version=None):
        return {r["name"]: bytes(r["content"]).decode() for r in store.files(version).collect()}

    store = VersionStore(spark, str(tmp_path / "s"))
    assert store.current() is None and read() == {}
    store.snapshot(files(a=("x", "2024-01-01"), b=("x", "2024-03-01"), c=(None, None), gone=("g", "2024-01-01")), "1")
    store.snapshot(files(a=("unseen", "2024-01-01"), b=("y", "2024-03-02"), c=(None, None), d=("late", "2024-01-01")), "2", since="2024-03-02 00:00:00")
    assert read("1") == {"a": "x", "b": "x", "c": "", "gone": "g"}
    assert read() == {"a": "x", "b": "y", "c": "", "d": "late"}  # a wasn't modified, d is new whatever its time
    store.snapshot(files(a=("x", "2024-01-01"), b=("y", "2024-03-02"), c=(None, None), d=("late", "2024-01-01")), "2")  # again
    assert read("2") == read() and spark.read.parquet(f"{store.path}/objects").groupBy("digest").count().where("count > 1").count() == 0
    store.archive("3", "2024-03-15 00:00:00", 30)
    assert read() == {"b": "y", "c": ""} and ids(store.archived(), "name") == ["a", "d"]
    with pytest.raises(ValueError, match="no version"):
        store.restore("9", store.files(), "safe")
    store.restore("1", files(z=("new", "2024-03-15")), "safe")
    assert read() == read("1") and read("safe") == {"z": "new"} and store.current() == "1"


@pytest.mark.parametrize("limit", [1, 4, 100])
def test_pulled_equals_a_loop(spark, limit):
    rng = random.Random(limit)
    moment = lambda h: None if h is None else datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)
    events = [(k, moment(rng.choice([None, *range(0, 240, 3)]))) for k in range(120)]
    cursors = [(f"s{k}", moment(rng.choice([None, *range(-30, 300, 3)])), rng.randrange(120)) for k in range(25)]
    want = {}
    for name, ts, last in cursors:
        past = sorted((t, i) for i, t in events if t is not None and (ts is None or (t, i) > (ts, last)))[:limit]
        want[name] = [i for _, i in past], *((past[-1][0], past[-1][1]) if past else (ts, last))
    e = spark.createDataFrame(events, "event_id long, ts timestamp_ntz").withColumn("_days", F.lit(1))
    c = spark.createDataFrame(cursors, "subscriber_id string, last_ts timestamp_ntz, last_id long")
    found, moved = signals.pulled(e, c, limit)
    got = {name: [] for name, *_ in cursors}
    for r in found.orderBy("ts", "event_id").collect():
        got[r["subscriber_id"]].append(r["event_id"])
    assert got == {k: v[0] for k, v in want.items()}
    assert {r["subscriber_id"]: (r["last_ts"], r["last_id"]) for r in moved.collect()} == {k: v[1:] for k, v in want.items()}
    assert signals.pulled(e.where("false"), c, limit)[0].count() == 0
