"""Scenes that depend on earlier batches, pages as documents, and knowledge gained from sessions."""

import hashlib
import html
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestone.operators import aggregation, evolution, surfaces
from lodestone.sources.table_set import TableSet

AS_OF = "2024-03-15 00:00:00"
SCENES = "file_id string, scene_id string, title string, content string, heat long, status string, updated_at timestamp_ntz"


def act(action, content, **more):
    return {"action": action, "merged_content": content} | more


def state(done):
    return sorted((r["file_id"], r["title"], r["content"], r["heat"], r["status"]) for r in done.scenes.collect())


def memories(spark, *rows):
    return spark.createDataFrame(list(rows), "file_id string, memory_id string, content string")


def test_actions_of_one_batch_apply_in_order(spark):
    scenes = spark.createDataFrame([("f", "a", "A", "a0", 3, "active", None), ("f", "b", "B", "b0", 4, "active", None), ("f", "c", "C", "c0", 9, "archived", None), ("g", "a", "other", "g0", 1, "active", None)], SCENES)
    answer = [
        act("update", "a1", target_scene_id="a"), act("update", "a2", target_scene_id="a", memory_ids=["1", ""]), act("merge", "# M \nab", merged_from=["a", "b", "b", "c", "no"]),
        act("update", "late", target_scene_id="a"), act("merge", "again", merged_from=["a"]), act("merge", "alone"), act("update", "x", target_scene_id="c"),
    ]
    done = aggregation.aggregate(memories(spark, ("f", "1", "x"), ("f", "2", None), ("f", "2", None)), scenes, lambda p: pd.Series([json.dumps(answer)] * len(p)), AS_OF, 5)
    got = [s if not s[1].startswith(("merged_", "scene_")) else (s[0], s[1].split("_")[0], *s[2:]) for s in state(done)]
    assert sorted(got) == [("f", "A", "a2", 5, "archived"), ("f", "B", "b0", 4, "archived"), ("f", "C", "c0", 9, "archived"), ("f", "M", "# M \nab", 10, "active"), ("f", "merged", "again", 1, "active"), ("f", "scene", "alone", 1, "active"), ("g", "other", "g0", 1, "active")]
    assert sorted((r["scene_id"], r["content"], r["reason"]) for r in done.versions.collect()) == [("a", "a0", "update"), ("a", "a1", "update"), ("a", "a2", "merge"), ("b", "b0", "merge")]
    assert sorted((r["scene_id"], r["memory_id"]) for r in done.links.where("scene_id = 'a'").collect()) == [("a", "1"), ("a", "2")]
    assert [(r["status"], r["update"], r["merge"], r["create"]) for r in done.runs.collect()] == [("ok", 4, 3, 0)]


def test_batches_see_what_earlier_ones_made_and_failures_are_contained(spark):
    def model(prompts):
        out = []
        for p in prompts:
            known = json.JSONDecoder().raw_decode(p)[0]
            first = known["memories"][0]
            if first["content"] == "bad":
                out.append("[]x" if "no JSON array" in p and first["memory_id"] == "3" else '[{"action": "drop", "merged_content": "x"}]')
            elif first["content"] == "none":
                out.append(None)
            else:
                out.append(json.dumps([{"action": "create", "merged_content": f"# {len(known['scenes'])}"}]))
        return pd.Series(out)

    rows = [("f", "1", "x"), ("f", "2", "bad"), ("f", "3", "bad"), ("f", "4", "x"), (None, "5", "x"), (None, "6", "none"), (None, "7", "x")]
    done = aggregation.aggregate(memories(spark, *rows), spark.createDataFrame([], SCENES), model, AS_OF, 1, lambda c: pd.Series([[1.0, 0.0]] * len(c)), vector_top=1, heat_top=1)
    assert [s[:2] for s in state(done)] == [("f", "0"), ("f", "1"), ("unknown", "0")]
    runs = sorted((r["file_id"], r["batch"], r["status"]) for r in done.runs.collect())
    assert runs == [("f", 0, "ok"), ("f", 1, "error"), ("f", 2, "ok"), ("f", 3, "ok"), ("unknown", 0, "ok"), ("unknown", 1, "unavailable")]
    events, alarm = aggregation.finalised(done, memories(spark, *rows), AS_OF, yellow=3)
    l2 = {r["file_id"]: json.loads(r["payload"]) for r in events.where("source = 'l2'").collect()}
    assert {k: (len(v["created"]), v["failed"]) for k, v in l2.items()} == {"f": (2, 1), "unknown": (1, 1)}
    assert alarm.first()["level"] == "yellow"


def test_candidates_are_nearest_then_warmest(spark):
    vector = [("f", "a", 1.0, 0.0, 1), ("f", "b", 0.0, 1.0, 9), ("f", "c", 0.5, 0.5, 5), ("g", "d", 1.0, 0.0, 1)]
    scenes = spark.createDataFrame([(f, s, s, s, h, "active", None, [x, y]) for f, s, x, y, h in vector] + [("f", "z", "z", "z", 99, "archived", None, [1.0, 0.0])], aggregation.STATE)
    batch = spark.createDataFrame([("f", [("1", "q")])], "file_id string, memories array<struct<memory_id:string,content:string>>")
    found = aggregation.candidates(scenes, batch, lambda c: pd.Series([[1.0, 0.1]] * len(c)), 2, 2)
    assert [r["scene_id"] for r in found.where("file_id = 'f'").orderBy("part", "rank").collect()] == ["a", "c", "b"]


@pytest.mark.parametrize("embed", [None, lambda c: pd.Series([[1.0]] * len(c))])
def test_no_memories(spark, embed):
    scenes = spark.createDataFrame([("f", "a", "A", "a0", 3, "active", None)], SCENES)
    done = aggregation.aggregate(memories(spark), scenes, lambda p: p, AS_OF, 5, embed)
    assert state(done) == [("f", "A", "a0", 3, "active")]
    assert [x.count() for x in done[1:]] == [0, 0, 0, 0]
    assert aggregation.finalised(done, memories(spark), AS_OF)[0].where(F.col("source") == "l2").count() == 0


def plain_page(text):
    """What a page has to look like, line by line."""
    out, code = [], None
    for raw in (text or "").splitlines():
        if raw.strip().startswith("```"):
            if code is None:
                code = [raw.strip()[3:].strip()]
            else:
                out.append(code)
                code = None
        elif code is not None:
            code.append(raw)
        else:
            level = next((n for n in (1, 2, 3) if raw.startswith("#" * n + " ")), 0)
            safe = html.escape(raw)
            out.append("<p></p>" if not raw.strip() else f"<h{level}>{safe[level + 1 :]}</h{level}>" if level else f"<p>{safe}</p>")
    if code is not None:
        out.append(code)
    show = lambda c: f'<pre><code class="language-{html.escape(c[0])}">' + html.escape("\n".join(c[1:])) + "</code></pre>"
    return "".join(x if isinstance(x, str) else show(x) for x in out)


def test_pages_as_documents(spark):
    texts = [
        None, "", "\n", "a", "a\n", "a\n\n", "# <b> & 'q' \"d\"", "#no", "#### four", "  # no", "```", "```\n```", "```py\n\n```", "x\n ```a\"b\n# <c>\n```end\ny\r\nz\rw", "```\n```\n```\n```x",
        "a\n```\nb\n\n", " \t\n\u3000\nx\x0cy\u2028z", "a``` b\n```c```\nd", "中文\n## 标题\n```\n" + "line\n" * 2000 + "```\n" * 501,
    ]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", surfaces.rendered("t").alias("h"))
    assert [r["h"] for r in rows.orderBy("i").collect()] == [plain_page(t) for t in texts]
    page = spark.createDataFrame([("<t>", "# x", None, ["a&b", None], None)], "t string, c string, k string, g array<string>, u string")
    out = page.select(surfaces.page_document(*[F.col(c) for c in page.columns]).alias("d")).first()["d"]
    assert "<title>&lt;t&gt;</title>" in out and "<li>a&amp;b</li><li></li>" in out and "<main><h1>x</h1></main>" in out


def test_tables_commit_together_and_once(spark, tmp_path):
    store, rows = TableSet(spark, str(tmp_path)), lambda *x: spark.createDataFrame([(v,) for v in x], "v int")
    read = lambda name, version=None: sorted(r["v"] for r in store.read(name, "v int", version).collect())
    assert read("a") == [] and store.current() is None
    assert store.commit("one", a=rows(1), b=rows(2))
    rows(9).write.parquet(str(tmp_path / "tables/a/version=two"))  # a commit that ended early
    assert (read("a"), read("b")) == ([1], [2])
    assert store.commit("two", a=rows(3))
    assert (read("a"), read("b"), read("a", "one")) == ([3], [2], [1])
    assert not store.commit("one", a=rows(7)) and store.current() == "two"
    store._point_to("one")  # as if the second commit had ended before its last step
    assert not store.commit("two", a=rows(7)) and read("a") == [3]


def test_evolution_by_turns(spark, tmp_path):
    day = lambda n: f"2024-01-{n:02d} 00:00:00"
    files = spark.createDataFrame([("s1", "1", day(9)), ("s1", "1b", day(1)), ("s2", "2", day(8)), ("s3", "3", day(7)), ("s4", "4", day(6)), ("s5", "5", day(5)), ("", "6", day(10)), (None, "7", day(11)), ("s8", "8", day(3))], "session_key string, file_id string, at string")
    files = files.select("session_key", "file_id", F.col("at").cast("timestamp_ntz").alias("started_at"))
    entry = lambda title, body, **more: {"type": "append", "category": "c", "title": title, "entry": body} | more
    said = {
        "1": json.dumps([entry("new", "one"), entry("old", " seen "), entry("old", "fresh")]), "2": json.dumps([entry("new", "two"), entry("new", "two"), entry("x", "y" * 201)]),
        "3": json.dumps([entry(" ", "z"), entry("x", "y", type="edit")]), "4": "none", "8": None,
    }
    texts = spark.createDataFrame([(k, v, 9) for k, v in said.items()] + [("5", "short", 1)], "file_id string, content string, blocks int")
    pages = spark.createDataFrame([("p", "old", "c", "text \n hash: " + "__", "active", day(1)), ("q", "old", "c", "older", None, day(2)), ("r", "new", "c", "gone", "superseded", day(3))], "page_id string, title string, category string, content string, status string, at string")
    known = hashlib.sha256(b"seen").hexdigest()[:8]
    pages = pages.select("page_id", "title", "category", F.replace("content", F.lit("__"), F.lit(known)).alias("content"), F.lit(None).cast("array<string>").alias("tags"), F.lit("").alias("description"), F.lit("").alias("author"), "status", F.when(F.col("page_id") == "p", F.lit(day(20))).otherwise(F.col("at")).cast("timestamp_ntz").alias("updated_at"))
    store = TableSet(spark, str(tmp_path))
    store.commit("start", pages=pages)
    for _ in range(2):
        evolution.evolve_once(store, "turn 1", files, texts, lambda p: p, AS_OF, limit=4)
    assert sorted((r["session_key"], r["status"], r["action"], r["error"]) for r in store.read("runs", evolution.RUNS).collect()) == [("s1", "done", "appended", None), ("s2", "done", "appended", None), ("s3", "rejected", None, "required"), ("s4", "done", "noop", None)]
    got = {r["title"] + (r["page_id"] if r["page_id"] in "pqr" else ""): r["content"] for r in store.read("pages", evolution.PAGES).collect()}
    mark = lambda s, body: evolution.MARK % (s, hashlib.sha256(body.encode()).hexdigest()[:8], body)
    assert got == {"oldp": f"text \n hash: {known}" + mark("s1", "fresh"), "oldq": "older", "newr": "gone", "new": "one" + mark("s2", "two")}
    evolution.evolve_once(store, "turn 2", files, texts, lambda p: p, AS_OF, limit=4)
    assert sorted((r["session_key"], r["status"]) for r in store.read("runs", evolution.RUNS).where("session_key IN ('s5', 's8')").collect()) == [("s5", "skipped"), ("s8", "skipped")]
    evolution.evolve_once(store, "turn 3", files, texts, lambda p: p, AS_OF, limit=4)
    assert store.read("runs", evolution.RUNS).count() == 6
