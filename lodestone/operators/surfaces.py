"""Injection, graph, care and health surfaces."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import yaml
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import relative_time
from lodestone.operators import paging, ranking, relations, selection


def section(memories: DataFrame, tags: DataFrame, dimensions: Sequence[str], velocities: dict[str, str], as_of: str, match: str = "all", ttl: bool = True, window: str | None = None, priority_min: int = 0, sort: str | None = None, limit: int = 10) -> DataFrame:
    """G-01. One section of a template: the filter on priority comes after the limit."""
    shown = memories.where(selection.visible())
    if ttl:
        shown = shown.where(selection.live(as_of))
    if window:
        shown = shown.where(selection.in_window(window, as_of))
    order = sort or paging.default_sort([velocities.get(d) for d in dimensions])
    found = relations.tagged(shown, tags, dimensions, match)
    return selection.limit_then_filter(found, [F.desc(order), F.asc("memory_id")], limit, F.col("priority") >= priority_min)


def load_template(texts: Mapping[str, str], name: str, dimensions: Sequence[str], default_budget: int = 700) -> dict:
    """G-04. A template in YAML over the one that it extends, checked.

    ``texts`` holds the YAML of each template by name. A template may extend one that extends none; its
    sections replace those of the same title and follow them otherwise.
    """
    own = yaml.safe_load(texts[name])
    if own.get("name") != name:
        raise ValueError(f"template {name} calls itself {own.get('name')}")
    if base_name := own.get("extends"):
        if base_name not in texts:
            raise ValueError(f"template {name} extends {base_name}, which there isn't")
        base = yaml.safe_load(texts[base_name])
        if base.get("extends"):
            raise ValueError(f"template {name} extends {base_name}, which extends another")
        own = base | {k: v for k, v in own.items() if v is not None} | {"sections": paging.merged_sections(base.get("sections") or [], own.get("sections") or [])}
    own.setdefault("token_budget", default_budget)
    if not own.get("memory_types") or not own.get("sections"):
        raise ValueError(f"template {name} has no memory_types or no sections")
    if found := selection.template_errors(own, dimensions):
        raise ValueError(f"template {name}: {', '.join(found)}")
    return own


def template_sections(memories: DataFrame, tags: DataFrame, template: dict, velocities: dict[str, str], as_of: str) -> list[tuple[str, DataFrame]]:
    """G-03, G-04. (title, rows) of each section of a template, as its query says."""
    out = []
    for s in template["sections"]:
        q = s["query"]
        rows = section(memories, tags, q["dimensions"], velocities, as_of, q.get("match", "all"), True, q.get("time_window"), int(q.get("priority_min", 0)), q.get("sort"), int(q.get("limit", 10)))
        out.append((s["title"], rows))
    return out


def blocks(sections: Sequence[tuple[str, DataFrame]], as_of: str, order: str = "updated_at") -> DataFrame:
    """G-02, W-03. (section, title, rank, memory_id, content, relative_time) of all sections, without repeats."""
    parts = None
    for k, (title, rows) in enumerate(sections):
        rank = F.row_number().over(Window.orderBy(F.desc(order), "memory_id"))  # at most a section's limit
        part = rows.select(F.lit("t").alias("mode"), F.lit(k).alias("section"), F.lit(title).alias("title"), rank.alias("rank"), "memory_id", "content", relative_time("updated_at", as_of).alias("relative_time"))
        parts = part if parts is None else parts.unionByName(part)
    return ranking.sequential_dedup(parts).drop("mode")


def block_stats(items: DataFrame, n_sections: int, per_item: int = 30) -> DataFrame:
    """A-40."""
    return items.agg(F.lit(n_sections).alias("queries"), (F.count("*") * per_item).alias("tokens_est"))


def graph(scenes: DataFrame, pages: DataFrame, memories: DataFrame, scene_memories: DataFrame, links: DataFrame, limits: tuple[int, int, int] = (200, 200, 3000)) -> tuple[DataFrame, DataFrame]:
    """G-05. (nodes, links): active scenes, pages and memories up to their limits, and links between them."""
    s = relations.with_count(scenes.where("status = 'active'"), scene_memories, "scene_id", "size").orderBy(F.desc("heat"), "scene_id").limit(limits[0])
    p = pages.where("status = 'active' OR status IS NULL").orderBy(F.desc("updated_at"), "page_id").limit(limits[1])
    m = memories.where("status = 'active'").orderBy(F.desc("priority"), "memory_id").limit(limits[2])
    nodes = s.select(F.concat(F.lit("s"), "scene_id").alias("id"), F.lit("scene").alias("kind"), "size")
    nodes = nodes.unionByName(p.select(F.concat(F.lit("w"), "page_id").alias("id"), F.lit("wiki").alias("kind"), F.lit(1).cast("long").alias("size")))
    nodes = nodes.unionByName(m.select(F.concat(F.lit("m"), "memory_id").alias("id"), F.lit("memory").alias("kind"), F.lit(1).cast("long").alias("size")))
    edges = scene_memories.select(F.concat(F.lit("s"), "scene_id").alias("source_id"), F.concat(F.lit("m"), "memory_id").alias("target_id"), F.lit("contains").alias("rel_type"))
    edges = edges.unionByName(links.select(F.concat(F.lit("w"), "source_id").alias("source_id"), F.concat(F.lit("w"), "target_id").alias("target_id"), "rel_type").distinct())
    return nodes, relations.links_between(edges, nodes)


def detail(memories: DataFrame, tags: DataFrame, sources: DataFrame, memory_id: str) -> DataFrame:
    """G-07, S-02."""
    one = relations.with_tags(memories.where(F.col("memory_id") == memory_id), tags.where(F.col("memory_id") == memory_id))
    refs = sources.where(F.col("memory_id") == memory_id).groupBy("memory_id").agg(F.sort_array(F.collect_set("source_ref")).alias("sources"))
    return one.join(refs, "memory_id", "left")


def profile_text(items: DataFrame) -> DataFrame:
    """G-06. A role's profile: its items' contents as lines, by section and rank."""
    line = F.struct("section", "rank", F.concat(F.lit("- "), F.substring("content", 1, 80)).alias("line"))
    return items.agg(F.array_join(F.sort_array(F.collect_list(line))["line"], "\n").alias("profile"))  # a template's items


TEXT, OBJECT, LIST, ANY = "STRING", "OBJECT", "ARRAY", ""
#: What each object of a role card may hold, by its path: the kinds of a field, and ! if it must be there.
ROLE_CARD = {
    "$": {"spec": (ANY,), "spec_version": (ANY,), "data": (OBJECT, "!")},
    "$.data": {
        "name": (TEXT, "!"), "description": (TEXT, "!"), "personality": (TEXT, OBJECT, LIST), "scenario": (TEXT, OBJECT, LIST), "first_mes": (TEXT, OBJECT, LIST), "mes_example": (TEXT, OBJECT, LIST),
        "system_prompt": (TEXT, OBJECT, LIST), "post_history_instructions": (TEXT, OBJECT, LIST), "character_book": (TEXT, OBJECT, LIST), "extensions": (OBJECT,),
    },
    "$.data.extensions": {"care": (OBJECT,), "*": (ANY,)},
    "$.data.extensions.care": {"greeting_templates": (ANY,), "trigger_rules": (ANY,), "frequency": (ANY,)},
}


def _unknown(path: str) -> Callable[[Column], Column]:
    return lambda key: F.concat(F.lit(f"{path}."), key, F.lit(": unknown"))


def schema_faults(text: Column | str, schema: dict[str, dict[str, tuple[str, ...]]]) -> Column:
    """F-42, P-28. Sorted faults of JSON objects under a declared schema of fields by the path of their object.

    ``path: unknown``, ``path: missing`` or ``path: wrong kind``. A field that must be there may be neither null nor a
    blank text; null counts as any kind elsewhere. An object that isn't there has no faults inside. Text that is no
    JSON object has the fault ``$: wrong kind``. Everything is a column expression.
    """
    text = F.col(text) if isinstance(text, str) else text
    value = F.try_parse_json(text)
    found = [F.when(F.coalesce(F.json_object_keys(text).isNull(), F.lit(True)), F.array(F.lit("$: wrong kind")))]
    for path, fields in schema.items():
        keys = F.json_object_keys(F.get_json_object(text, path))
        if "*" not in fields:
            known = F.array(*[F.lit(k) for k in fields])
            found.append(F.transform(F.array_except(keys, known), _unknown(path)))
        for name, rules in fields.items():
            at, kinds = f"{path}.{name}", [k for k in rules if k != "!"]
            own = F.try_variant_get(value, at, "variant")
            kind = F.coalesce(F.schema_of_variant(own), F.lit("VOID"))
            blank = (kind == "VOID") | ((kind == TEXT) & (F.trim(F.try_variant_get(value, at, "string")) == ""))
            wrong = (kind != "VOID") & ~F.lit(ANY in kinds)
            for k in kinds:
                wrong &= ~kind.startswith(k)
            fault = F.when(wrong, F.lit(f"{at}: wrong kind"))
            if "!" in rules:
                fault = F.when(blank & keys.isNotNull(), F.lit(f"{at}: missing")).otherwise(fault)
            if name != "*":
                found.append(F.array(fault))
    return F.array_sort(F.array_compact(F.flatten(F.array(*[F.coalesce(x, F.array().cast("array<string>")) for x in found]))))


#: What ends a line, and a line that begins or ends a block of code.
LINE_END = r"\r\n|[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
FENCE = r"(?U)\n[^\S\n]*```([^\n]*)"


def escaped(text: Column | str) -> Column:
    """Text as HTML, in elements and in quoted attributes."""
    out = F.col(text) if isinstance(text, str) else text
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(mark), F.lit(name))
    return out


def rendered(text: Column | str) -> Column:
    """S-27. Markdown as HTML: blocks of code, headings of three levels, and a paragraph for each other line; null is empty.

    A text that is split at its fences is outside and inside of code by turns, so the parity of a part says what it is, whatever
    lines are in it; a last block without its closing fence is code too. Linear, without a shuffle.
    """
    text = F.col(text) if isinstance(text, str) else text
    lines = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), LINE_END, "\n"), r"\n\z", "")
    whole = F.when(F.coalesce(text, F.lit("")) == "", "").otherwise(F.concat(F.lit("\n"), lines))
    languages = F.transform(F.regexp_extract_all(whole, F.lit(FENCE), F.lit(1)), lambda x: escaped(F.regexp_replace(x, r"(?U)^\s+|\s+$", "")))

    def line(raw: Column) -> Column:
        safe = escaped(raw)
        out = F.when(F.regexp_like(raw, F.lit(r"(?U)^\s*$")), "<p></p>")
        for level in (1, 2, 3):
            tag = f"h{level}"
            out = out.when(F.startswith(raw, F.lit("#" * level + " ")), F.concat(F.lit(f"<{tag}>"), F.substring(safe, level + 2, 2**31 - 1), F.lit(f"</{tag}>")))
        return out.otherwise(F.concat(F.lit("<p>"), safe, F.lit("</p>")))

    def part(piece: Column, place: Column) -> Column:
        body, language = piece["0"], piece["1"]
        inner = F.substring(body, 2, 2**31 - 1)
        code = F.concat(F.lit('<pre><code class="language-'), language, F.lit('">'), escaped(inner), F.lit("</code></pre>"))
        return F.when(place % 2 == 1, code).when(body == "", "").otherwise(F.array_join(F.transform(F.split(inner, "\n"), line), ""))

    pieces = F.arrays_zip(F.split(whole, FENCE), F.concat(F.array(F.lit("")), languages))
    return F.array_join(F.transform(pieces, part), "")


def page_document(title: Column, content: Column, category: Column, tags: Column, updated_at: Column) -> Column:
    """S-27. A page as a document of its own; nulls are empty."""
    none = F.lit("")
    labels = F.array_join(F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.concat(F.lit("<li>"), escaped(F.coalesce(t, none)), F.lit("</li>"))), "")
    name = escaped(F.coalesce(title, none))
    return F.concat(
        F.lit('<!DOCTYPE html>\n<html><head><meta charset="utf-8"><title>'), name, F.lit("</title></head>\n<body><header><h1>"), name,
        F.lit("</h1><dl><dt>category</dt><dd>"), escaped(F.coalesce(category, none)), F.lit("</dd><dt>updated</dt><dd>"), escaped(F.coalesce(updated_at.cast("string"), none)),
        F.lit("</dd></dl><ul>"), labels, F.lit("</ul></header>\n<main>"), rendered(content), F.lit("</main></body></html>"),
    )
