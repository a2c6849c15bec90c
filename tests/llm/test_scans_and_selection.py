"""Secrets, importance resampling and clustering against SQL and brute force."""

import hashlib
import math
import os
import random
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import clustering, importance, secrets
from lodestone.llm.queries import ORACLES, QUERIES

SCHEMA = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf, duck, name):
    got = QUERIES[name](spark, sf)
    want = duck.sql(ORACLES[name])
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr) == sorted((tuple(r[k] for k in at) for r in want.fetchall()), key=repr)


# secrets


def plain_base(text):
    """The contract's kinds by the patterns as they stand there."""
    out = []
    for nth, (pattern, group, least) in enumerate(((r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8), (r"AKIA[A-Z0-9]+", 0, 16), (r"[0-9a-f]+", 0, 32))):
        out += [(m.start(), nth, m.end()) for m in re.finditer(pattern, text) if len(m.group(group)) >= least]
    return [(("assign", "access", "hex")[k], a, b) for a, k, b in sorted(out)]


PIECES = ["password", "PassWD", "secret", "token", "api_key", "APIKEY", " = ", ":", '"', "'", " ", "AKIA", "ABCD1234EFGH", "0123456789abcdef", "deadbeef", "x", "é", "\n", "=", "K", "ſecret", "{", "}", "key", "hunter2!", "+", "name", "(", "[", "]", ")", "<", ">", "</", "--", "://", "@", "\\", "`", '"""', "$"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=40).map("".join))
def test_base_spans_are_those_of_the_patterns(text):
    got = secrets.spans(text)
    assert [s[:3] for s in got if s.kind != "literal"] == plain_base(text)
    assert all(0 <= s.start < s.end <= len(text) for s in got)
    assert "".join(t.text for t in secrets.tokens(text)) == re.sub(r"[ \t\r\f\v]+", "", text) or '"' in text or "'" in text or "`" in text


FOUND = {
    'KEY = "Zx9-qq81LmPw"\nclient_secret = KEY': {"Zx9-qq81LmPw"},
    'a = "abc"\nb = a + "9f8A7b6C"\napi_key: b': {"9f8A7b6C"},
    'one = "Qq77!rt56Zz"\ntwo = one\nthree = two\nlogin(password=three)': {"Qq77!rt56Zz"},
    '{"user": "bob", "passwd": "c0rrect horse!"}': {"c0rrect horse!"},
    'conn = "postgres://bob:S3cr3tPw99@host/db"': {"S3cr3tPw99"},
    "export DB_PASS=Qwerty!234#x": {"Qwerty!234#x"},
    "<password>Tr0ub4dor&3</password>": {"Tr0ub4dor&3"},
    "Authorization: Bearer abcDEF123456.xyz": {"abcDEF123456.xyz"},
    "curl --api-key Zq12Zq34Ww77 http://x": {"Zq12Zq34Ww77"},
    'password: str = "Zz!!88aaPPq"': {"Zz!!88aaPPq"},
    "config[\"auth_token\"] = 'tok_9a8b7c6d5e'": {"tok_9a8b7c6d5e"},
    "const apiKey: string = `a8F3kk29zQ`;": {"a8F3kk29zQ"},
    'pw = decode("QWxhZGRpbjpv")\npassword = f"{pw}"': {"QWxhZGRpbjpv"},
    "'aws_secret_access_key' => 'wJalrXUtnFEMI/K7MDENG'": {"wJalrXUtnFEMI/K7MDENG"},
    'token += "8s7df6A8sd7f"': {"8s7df6A8sd7f"},
}
CLEAN = ['token_count = "a8F3kk29zQ12"', 'public_key = "a8F3kk29zQ12"', 'password = getenv("MY_SECRET_NAME9")', 'pass: "your_password_1"', "secret: ${VAULT_VALUE_1}", "don't say the password: it's fine", "the key: to success is work", 'name = "a8F3kk29zQ12"\nlabel = name', "<secret></secret>", "password:", "= = ="]


@pytest.mark.parametrize("text", FOUND)
def test_literals_of_sensitive_targets(text):
    got = [s for s in secrets.spans(text) if s.kind == "literal"]
    assert {text[s.start : s.end] for s in got} == FOUND[text]


@pytest.mark.parametrize("text", CLEAN)
def test_other_literals_are_left_alone(text):
    assert [s for s in secrets.spans(text) if s.kind == "literal"] == []


def test_literal_in_a_base_span_is_that_ones():
    assert [s.kind for s in secrets.spans('password = "hunter2hunter2"')] == ["assign"]


@pytest.mark.parametrize("piece", ["password=", "'", '"\\', "a-", "<a>", "a::", "token (", "key = a + ", 'password="""', "a://b:", "key:f(", "a = a + a\n", "b = a\n", "secret `"])
def test_time_is_in_proportion(piece):
    def took(n):
        began = time.process_time()
        secrets.spans("key " + piece * (n // len(piece)))
        return time.process_time() - began

    assert took(400_000) < 12 * max(took(100_000), 0.05)


def test_secret_query_on_odd_rows(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "tok\u00e9n 🎉 api_key: 12345678", "fr"), (3, "tok\u00e9n 🎉 api_key: 12345678", "fr"), (None, "secret = a1b2c3d4", None), (7, "word " * 200_000 + "password='Zz!!88aaPPq'", "en")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("spans_", F.lit(1)).withColumn("kind", F.lit("k"))
    got = sorted((r.asDict() for r in secrets.query(df).collect()), key=lambda r: (r["doc_id"] or 0, r["spans"]))
    assert [r["doc_id"] for r in got] == [None, 1, 2, 3, 3, 7]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for r in got:
        text = next(t or "" for i, t, _ in rows if i == r["doc_id"])
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in plain_base(text))
        assert r["base_sha256"] == sha(base)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(base.count(k) for k in ("assign", "access", "hex"))
    assert got[-1]["spans"] == "literal:1000010:1000021"
    assert secrets.query(df.where("false")).count() == 0
    clean = {r["doc_id"]: r for r in secrets.redact(df).collect()}
    assert clean[3]["text"] == "tok\u00e9n 🎉 [assign]" and clean[1]["text"] is None and clean[7]["text"].endswith("password='[literal]'")
    assert clean[3].asDict().keys() == set(df.columns)


# importance resampling


def plain_resample(texts, target, n, buckets, least, percent, seed):
    word = re.compile(importance.WORD)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def runs(text):
        w = word.findall((text or "").translate(lower))
        return len(w), Counter(zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1))

    docs = [(i, *runs(t)) for i, t in texts]
    s, t = Counter(), Counter()
    for _, _, c in docs:
        s.update(c)
    for x in target:
        t.update(runs(x)[1])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    rows = []
    for i, words, c in docs:
        weight = sum(gain[b] * k for b, k in c.items())
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, words, c.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], math.inf if r[0] is None else r[0], -r[3]))
    for k, r in enumerate(able[: len(able) * percent // 100]):
        r[5] = k + 1
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("n", [1, 3])
def test_resampling_equals_plain_counting(spark, monkeypatch, n):
    monkeypatch.setattr(importance, "SLICE", 300)  # long texts are cut
    rng = random.Random(n)
    words = ["Alpha", "beta", "ΓΔ", "d9", "é", "ZZ", "x_y", "naïve"] + [f"w{k}" for k in range(60)]
    text = lambda k: "".join(rng.choice(words) + rng.choice([" ", ", ", "\n", "\x00", "_"]) for _ in range(k))
    texts = [(k, text(rng.randint(0, 60))) for k in range(150)] + [(None, None), (200, ""), (201, text(900)), (7, "same words here"), (7, "same words here"), *[(None, "lone text " * 12)] * 40]
    target = [text(30), None, "", "Alpha beta"]
    docs = spark.createDataFrame([(i, t, "en") for i, t in texts], SCHEMA).withColumns({"bucket": F.lit(1), "n": F.lit(2), "_able": F.lit(3)}).repartition(5)
    got = importance.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), n=n, buckets=97, least_words=20, percent=25, seed=5)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_resample(texts, target, n, 97, 20, 25, 5)


def test_resampling_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame([(1, "a b", "en")], SCHEMA)
    assert importance.query(none, some).count() == 0
    assert importance.query(some, none).collect()[0]["rank"] is None


# clustering


def plain_lloyd(rows, k, rounds, seed):
    use = [(i, [math.floor(256 * float(np.float64(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    use.sort(key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in use[:k]]
    x = np.array([v for _, v in use])

    def near():
        d = ((x[:, None] - np.array(centroids)[None]) ** 2).sum(2)
        return d.argmin(1), d.min(1)

    for _ in range(rounds):
        own = near()[0]
        for c in range(len(centroids)):
            if (own == c).any():
                centroids[c] = [int(s) // int((own == c).sum()) for s in x[own == c].sum(0)]
    own, d = near()
    return sorted(((i, int(c), int(z)) for (i, _), c, z in zip(use, own, d, strict=True)), key=repr)


@pytest.mark.parametrize("block", [3, 64])
def test_clusters_equal_plain_lloyd(spark, block):
    rng = np.random.default_rng(block)
    middle = rng.normal(size=(7, 64)) * 3
    rows = [(k, (middle[k % 7] + rng.normal(size=64) * rng.choice([0.0, 0.01, 0.5])).tolist()) for k in range(300)]
    rows += [(1000 + k, [1.0] * 64) for k in range(150)]  # a very common vector
    rows += [(5, rows[5][1]), (None, [0.5] * 64), (2000, None), (2001, [1.0] * 63), (2002, [1.0] * 63 + [None]), (2003, [math.nan] * 64), (2004, [math.inf] * 64), (2005, [1e9] + [0.0] * 63), (2006, [-0.001] * 64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"x": F.lit(1), "cluster": F.lit(2), "ids": F.lit(3)}).repartition(4)
    got, centroids = clustering.cluster(df, k=12, rounds=4, seed=9, block=block)
    assert len(centroids) == 12
    assert sorted(map(tuple, got.collect()), key=repr) == plain_lloyd([r for r in rows if r[0] != 2005], 12, 4, 9)


def test_cover_tree_has_its_nets():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.integers(-500, 500, (200, 5)), np.ones((50, 5), np.int64)])
    tree = clustering.CoverTree.of(x, 1)
    nodes, y = tree.nodes, x[tree.order].astype(float)
    assert sorted(tree.order.tolist()) == list(range(250))
    for n in nodes:
        inside = np.linalg.norm(y[n["lo"] : n["hi"]] - y[n["center"]], axis=1)
        assert inside.max() <= n["radius"] + 1e-9
        kids = nodes[n["child"] : n["child"] + n["children"]] if n["children"] else []
        if len(kids):
            assert kids[0]["lo"] == n["lo"] and kids[-1]["hi"] == n["hi"] and kids[0]["center"] == n["center"]
            apart = [np.linalg.norm(y[a["center"]] - y[b["center"]]) for i, a in enumerate(kids) for b in kids[:i]]
            reach = max(np.linalg.norm(y[k["center"]] - y[n["center"]]) for k in kids)
            assert min(apart) > reach / 4  # separation 2**i, children within 2**(i + 1)


def test_trees_prune_pairs_that_are_far_apart():
    rng = np.random.default_rng(1)
    centroids = rng.integers(-100_000, 100_000, (40, 64))
    x = centroids[rng.integers(0, 40, 2000)] + rng.integers(-50, 50, (2000, 64))
    tree = clustering.CoverTree.of(x, 8)
    number, distance, compared = clustering.nearest(x[tree.order], tree.nodes, centroids, clustering.CoverTree.of(centroids, 1))
    d = ((x[tree.order][:, None] - centroids[None]) ** 2).sum(2)
    assert (number == d.argmin(1)).all() and (distance == d.min(1)).all()
    assert compared < 0.2 * 2000 * 40


def test_clustering_few_and_none(spark):
    df = spark.createDataFrame([(1, [1.0] * 64), (2, [2.0] * 64), (3, [3.0] * 5)], "vec_id long, embedding array<double>")
    assert sorted((r["vec_id"], r["distance"]) for r in clustering.query(df).collect()) == [(1, 0), (2, 0)]
    assert clustering.query(df.where("false")).count() == 0
