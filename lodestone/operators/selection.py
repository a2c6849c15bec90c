"""Projections, filters and predicates over memories, files, pages and messages."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNITS = {"d": timedelta(days=1), "h": timedelta(hours=1), "w": timedelta(weeks=1), "m": timedelta(days=30)}

#: Openings of messages that a platform injects.
INJECTED = ("[PRIOR CONTEXT]", "[ASYNC DELEGATION]", "MEDIA:")
CUT_NOTE = "\n...[截断 {} 字符]"


def moment(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


def status_in(statuses: Sequence[str], column: str = "status") -> Column:
    """P-01. An empty list is no filter."""
    return F.col(column).isin(list(statuses)) if statuses else F.lit(True)


def visible() -> Column:
    """P-02. Everything that isn't rejected; expired rows are."""
    return F.col("status") != "rejected"


def live(as_of: str) -> Column:
    """P-03. No time to live, or updated after ``as_of`` less that time."""
    return F.col("ttl_days").isNull() | (F.col("updated_at") > moment(as_of) - F.make_dt_interval(F.col("ttl_days")))


def expired(as_of: str) -> Column:
    """P-04. Active rows past their time to live; the boundary itself is past."""
    return (F.col("status") == "active") & F.col("ttl_days").isNotNull() & (F.col("updated_at") <= moment(as_of) - F.make_dt_interval(F.col("ttl_days")))


def window_start(window: str, as_of: str) -> str:
    """P-05. The moment that ``updated_at > 30d`` means, seen from ``as_of``."""
    m = re.fullmatch(r"updated_at\s*>\s*(\d+)([dhwm])", window.strip(), re.IGNORECASE)
    if not m:
        raise ValueError(f"time window {window!r}")
    return str(datetime.fromisoformat(as_of) - int(m[1]) * UNITS[m[2].lower()])


def in_window(window: str, as_of: str) -> Column:
    return F.col("updated_at") > moment(window_start(window, as_of))


def between(sort: str, since: str | None, until: str | None, temporal: Iterable[str], fallback: str = "updated_at") -> Column:
    """P-06, P-07. A closed interval on the sort column, or on ``fallback`` if that isn't a time."""
    column = F.col(sort if sort in set(temporal) else fallback)
    out = F.lit(True)
    if since:
        out = out & (column >= moment(since))
    if until:
        out = out & (column <= moment(until))
    return out


def holds_text(column: Column | str, text: str) -> Column:
    """P-08, P-09, P-22. Contains the text literally, whatever the case."""
    return F.contains(F.lower(F.col(column) if isinstance(column, str) else column), F.lit(text.lower()))


def any_column_holds(columns: Sequence[str], text: str) -> Column:
    """P-10. Null columns hold nothing."""
    return reduce(Column.__or__, (F.coalesce(holds_text(c, text), F.lit(False)) for c in columns))


def any_term(column: str, query: str, most: int = 8, shortest: int = 2) -> Column:
    """P-11. Holds one of the first ``most`` terms of at least ``shortest`` characters."""
    terms = [t for t in query.split() if len(t) >= shortest][:most]
    return reduce(Column.__or__, (holds_text(column, t) for t in terms)) if terms else F.lit(False)


def flag_set(column: str, wanted: bool | None) -> Column:
    """P-12. Set (not null, not empty), unset, or no filter."""
    has = F.col(column).isNotNull() & (F.col(column) != "")
    return F.lit(True) if wanted is None else has if wanted else ~has


def conditions(*parts: Column | None) -> Column:
    """P-13, P-14. One predicate that a page and its total share."""
    return reduce(Column.__and__, (p for p in parts if p is not None), F.lit(True))


def limit_then_filter(df: DataFrame, order: Sequence[Column], limit: int, keep: Column) -> DataFrame:
    """P-15. The filter sees only the first rows: fewer than ``limit`` may be left."""
    return df.orderBy(*order).limit(limit).where(keep)


def with_columns(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """P-16. The wanted columns; those that ``df`` lacks are null."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(k).alias(c) for c, k in wanted.items()])


def without(df: DataFrame, *heavy: str) -> DataFrame:
    """P-17."""
    return df.drop(*heavy)


def not_skill(tags: str = "tags") -> Column:
    """P-18. Pages without tags stay."""
    return F.coalesce(~F.array_contains(tags, "skill"), F.lit(True))


# P-19: arguments are checked before anything is planned


def parse_page(raw: object) -> int:
    return _whole(raw, "page", 1, None, 1)


def parse_limit(raw: object, default: int = 50, most: int = 200) -> int:
    return _whole(raw, "limit", 1, most, default)


def _whole(raw: object, name: str, least: int, most: int | None, default: int) -> int:
    if raw is None or raw == "":
        return default
    try:
        n = int(str(raw))
    except ValueError:
        raise ValueError(f"{name} must be a whole number") from None
    if n < least or most is not None and n > most:
        raise ValueError(f"{name} is out of range")
    return n


def parse_choice(raw: str | None, allowed: Sequence[str], name: str, default: str | None = None) -> str | None:
    if not raw:
        return default
    if raw not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(allowed)}")
    return raw


def parse_status_list(raw: str | None, allowed: Sequence[str] = ("active", "rejected", "expired"), default: Sequence[str] = ("active",)) -> list[str]:
    if not raw:
        return list(default)
    if raw == "all":
        return []
    return [parse_choice(x.strip(), allowed, "status") or "" for x in raw.split(",") if x.strip()]


def parse_bool(raw: object, name: str, default: bool = False) -> bool:
    if raw is None or raw == "":
        return default
    known = {"1": True, "true": True, "yes": True, "0": False, "false": False, "no": False}
    if str(raw).lower() not in known:
        raise ValueError(f"{name} must be true or false")
    return known[str(raw).lower()]


def parse_timestamp(raw: str | None, name: str) -> str | None:
    if not raw:
        return None
    try:
        return str(datetime.fromisoformat(raw.replace("Z", "")))
    except ValueError:
        raise ValueError(f"{name} must be an ISO-8601 time") from None


def after_cursor(messages: DataFrame, cursors: DataFrame) -> DataFrame:
    """P-20. Messages past their file's cursor; files without one start at the beginning."""
    found = messages.join(cursors.select("file_id", "last_refined_seq"), "file_id", "left")
    return found.where(F.col("seq") > F.coalesce("last_refined_seq", F.lit(0))).drop("last_refined_seq")


def cut_text(text: Column, limit: int) -> Column:
    """F-08. The first ``limit`` characters and a note of how many went."""
    left = F.length(text) - limit
    return F.when(F.lit(limit <= 0) | (left <= 0), text).otherwise(F.concat(F.substring(text, 1, limit), F.lit("\n...[截断 "), left.cast("string"), F.lit(" 字符]")))


def prune(messages: DataFrame, tool_output: str = "drop", most_chars: int = 4000, tool_chars: int = 300, injected: Sequence[str] = INJECTED) -> DataFrame:
    """P-21. Drop what the platform injects, empty or cut tool output, cut long messages.

    A tool message is dropped with its output unless it names its tool.
    """
    text = F.coalesce("content", F.lit(""))
    spoken = F.col("role").isin("user", "assistant")
    opens = reduce(Column.__or__, (F.ltrim(text).startswith(p) for p in injected), F.lit(False))
    tool = F.col("role") == "tool"
    kept = messages.where(~(spoken & opens))
    if tool_output == "drop":
        named = F.coalesce(F.col("tool_name") != "", F.lit(False)) if "tool_name" in messages.columns else F.lit(False)
        kept, of_tool = kept.where(~tool | named), F.lit("")
    else:
        of_tool = cut_text(text, tool_chars) if tool_output == "truncate" else text
    return kept.withColumn("content", F.when(tool, of_tool).otherwise(cut_text(text, most_chars) if most_chars > 0 else text))


def new_only(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """P-25. Rows whose source and trimmed content no active row has."""
    known = stored.where("status = 'active'").select("source_ref", F.trim("content").alias("_text")).distinct()
    return rows.withColumn("_text", F.trim("content")).join(known, ["source_ref", "_text"], "left_anti").drop("_text")


def gate(kind: Column, required: Column, text: Column, kinds: Sequence[str], longest: int = 200) -> Column:
    """P-26. Why an entry is refused, null if it isn't."""
    return F.when(~F.coalesce(kind.isin(list(kinds)), F.lit(False)), "type").when(F.coalesce(F.trim(required) == "", F.lit(True)), "required").when(F.length(text) > longest, "too_long")


def quality_rules(text: Column, shortest: int = 1, longest: int = 4000) -> Column:
    """P-27. The names of the rules that a text fails."""
    rules = [("non_empty", F.trim(text) != ""), ("min_length", F.length(text) >= shortest), ("max_length", F.length(text) <= longest)]
    failed = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules])
    return F.array_compact(failed)


def matches_type(value: object, expected: str) -> bool:
    """P-28. A bool counts as int too, but an int isn't a bool."""
    kinds = {"str": str, "int": int, "float": (int, float), "bool": bool, "list": list, "dict": dict}
    return isinstance(value, kinds.get(expected, object))


def schema_errors(data: dict, schema: dict[str, str]) -> list[str]:
    return [k for k, t in schema.items() if k not in data or not matches_type(data[k], t)]


def allowed_models(models: DataFrame, denied: DataFrame) -> DataFrame:
    """P-29. Models whose name starts with no denied prefix; a name meets the prefixes by its own beginnings."""
    names = models.select("model").where("model IS NOT NULL").distinct()
    starts = F.transform(F.sequence(F.lit(0), F.length("model")), lambda n: F.substring("model", F.lit(1), n))
    hit = names.select("model", F.explode(starts).alias("prefix")).join(denied.select("prefix"), "prefix", "left_semi")
    return models.join(hit.select("model").distinct(), "model", "left_anti")


#: Fixed value: tokens that an item of a section counts for.
ITEM_TOKENS = 30
SORTS = ("updated_at", "priority", "created_at", "occurred_at")


def template_errors(template: dict, dimensions: Iterable[str]) -> list[str]:
    """P-30. What is wrong with a template: dimensions, limits, order, match and the token budget of its sections."""
    known, out, total = set(dimensions), [], 0
    own = template.get("memory_types")
    out += [f"memory_types {d}" for d in own or [] if d not in known]
    for section in template.get("sections", []):
        q = section.get("query", {})
        out += [f"dimension {d}" for d in q.get("dimensions", []) if d not in known or (own is not None and d not in own)]
        limit = int(q.get("limit", 10))
        total += limit
        if not 1 <= limit <= 50:
            out.append(f"limit {limit}")
        if q.get("match", "all") not in ("all", "any"):
            out.append(f"match {q['match']}")
        if q.get("sort") and q["sort"] not in SORTS:
            out.append(f"sort {q['sort']}")
        if not 0 <= int(q.get("priority_min", 0)) <= 100:
            out.append(f"priority_min {q['priority_min']}")
    budget = template.get("token_budget")
    if budget is not None and (int(budget) <= 0 or total * ITEM_TOKENS > int(budget)):
        out.append("token_budget")
    return out
