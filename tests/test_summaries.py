"""Profile summaries: choice of memories, expiry, answers that fail, repeated commits."""

import datetime

import pandas as pd

from lodestone.operators import summaries as S
from lodestone.sources.table_set import TableSet

SCHEMA = "owner string, memory_id string, content string, priority int, status string, ttl_days int, updated_at timestamp_ntz"
DAY = datetime.timedelta(days=1)
NOW = datetime.datetime(2024, 3, 15)


def _memories(spark):
    rows = [("a", f"a{i:02}", f"text {i}", 70 + i % 2 * -1, "active", None, NOW - i * DAY) for i in range(30)]
    rows += [("a", "gone", "ended", 99, "active", 7, NOW - 7 * DAY), ("a", "no", "rejected", 99, "rejected", None, NOW), ("a", "other", "not static", 99, "active", None, NOW)]
    rows += [("b", "b1", None, 90, None, 7, NOW - 6 * DAY), ("b", "b1", None, 90, None, 7, NOW - 6 * DAY), (None, "n", "nobody's", 80, "active", None, NOW), ("c", "c1", "low", 1, "active", None, NOW), (None, None, None, None, None, None, None)]
    tags = [(r[1], "focus" if r[1] == "other" else "family") for r in rows] + [("a00", "values"), (None, "family")]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(tags, "memory_id string, dimension_id string")


def test_prompts_and_fallback(spark):
    memories, tags = _memories(spark)
    got = {r["owner"]: r["prompt"] for r in S.prompts(memories, tags, "<{{memories}}>", "2024-03-15 00:00:00").collect()}
    assert got == {"a": "<" + "\n".join(f"- text {i}" for i in range(0, 20, 2)) + ">", "b": "<- \n- >", None: "<- nobody's>", "c": f"<{S.NOTHING}>"}
    none = spark.createDataFrame([], S.SUMMARIES)
    shown = sorted((str(r["owner"]), r["kind"], r["nth"], r["text"]) for r in S.served(none, memories, tags, "2024-03-15 00:00:00").collect())
    want = [("a", "static", k + 1, f"text {i}") for k, i in enumerate(range(0, 10, 2))]
    assert shown == [("None", "static", 1, "nobody's"), *want, ("b", "static", 1, None), ("b", "static", 2, None)]
    assert S.served(none, memories.limit(0), tags, "2024-03-15 00:00:00").count() == 0


def test_summaries_expire_and_failures_keep_the_one_before(spark, tmp_path):
    memories, tags = _memories(spark)
    store = TableSet(spark, f"file://{tmp_path}/profiles")

    def all_well(prompts: pd.Series) -> pd.Series:
        return "first " + prompts.str.slice(0, 8)

    def only_a(prompts: pd.Series) -> pd.Series:
        return pd.Series(["second" if "text" in p else " " if "nobody" in p else None for p in prompts])

    def never(prompts: pd.Series) -> pd.Series:
        raise AssertionError("asked again")

    assert S.refresh(store, "1", memories, tags, "{{memories}}", all_well, "2024-03-13 00:00:00")
    assert S.refresh(store, "2", memories, tags, "{{memories}}", only_a, "2024-03-14 12:00:00")
    assert not S.refresh(store, "2", memories, tags, "{{memories}}", never, "2024-03-14 12:00:00")
    stored = store.read("summaries", S.SUMMARIES)
    assert {r["owner"]: r["summary"] for r in stored.collect()} == {"a": "second", "b": "first - \n- ", None: "first - nobody", "c": "first " + S.NOTHING[:8]}
    runs = sorted((str(r["owner"]), r["status"]) for r in store.read("runs", S.RUNS).collect())
    assert runs == [("None", "error"), ("None", "ok"), ("a", "ok"), ("a", "ok"), ("b", "error"), ("b", "ok"), ("c", "error"), ("c", "ok")]
    owners = lambda as_of: sorted(str(r["owner"]) for r in S.valid(stored, as_of).collect())
    assert owners("2024-03-15 00:00:00") == ["None", "a", "b", "c"]  # 48 hours exactly are not over
    assert owners("2024-03-15 00:00:01") == ["a"]
    kinds = {(str(r["owner"]), r["kind"]) for r in S.served(stored, memories, tags, "2024-03-15 00:00:01").collect()}
    assert kinds == {("a", "summary"), ("b", "static"), ("None", "static")}
    odd = spark.createDataFrame([("x", "", NOW), ("y", "words", None), ("z", None, NOW)], S.SUMMARIES)
    assert S.valid(odd, "2024-03-15 00:00:00").count() == 0
