"""Scalar functions over texts, times, ids and JSON, as column expressions where Spark has them."""

from __future__ import annotations

import difflib
import json
import math
import re
import unicodedata
from collections.abc import Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.operators.selection import cut_text, moment

#: How keys begin that are redacted, and what follows at least.
SECRET_PREFIXES = ("sk-", "ark-")
SECRET_BODY = "[A-Za-z0-9-]{12,}"
REDACTED = "<REDACTED>"
#: Fixed value: the namespace of deterministic event ids.
NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


def with_canonical_terms(query: Column | str, aliases: dict[str, str]) -> Column:
    """F-05. Queries with the canonical term after each old one that they use; others as they were.

    Aliases take their turns in order, on whole words whatever their case. One whose canonical term the
    query has by then adds nothing, so a term comes from the first alias that is there.
    """
    query = F.col(query) if isinstance(query, str) else query
    rules = []
    for old, new in aliases.items():
        old, new = " ".join(old.lower().split()), " ".join(new.lower().split())
        if old and new:
            put = "$0 " + re.sub(r"([$\\])", r"\\\1", new)
            rules.append(F.struct(F.lit(_whole_word(old)).alias("old"), F.lit(_whole_word(new)).alias("new"), F.lit(put).alias("put")))
    if not rules:
        return query
    start = collapsed(query)
    text = F.aggregate(F.array(*rules), start, lambda t, r: F.when(F.rlike(t, r["new"]), t).otherwise(F.regexp_replace(t, r["old"], r["put"])))
    return F.when(text != start, text).otherwise(query)


def _whole_word(term: str) -> str:
    return rf"(?iu)(?<![0-9A-Za-z_]){re.escape(term)}(?![0-9A-Za-z_])"


def collapsed(text: Column | str) -> Column:
    """F-06."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def snippet(text: Column | str, n: int = 200) -> Column:
    """F-07. The start of a file's text after its front matter."""
    body = F.regexp_replace(text, r"(?s)\A---.*?\n---", "")
    return F.substring(collapsed(body), 1, n)


truncated = cut_text


def redacted(text: Column | str, prefixes: Sequence[str] = SECRET_PREFIXES) -> Column:
    """F-09. Keys with one of the prefixes are blanked; names of keys and short placeholders stay.

    An installation adds the prefixes of its own keys.
    """
    return F.regexp_replace(text, f"(?:{'|'.join(map(re.escape, prefixes))}){SECRET_BODY}", REDACTED)


def pre_normalised(name: str | None) -> str:
    return unicodedata.normalize("NFKC", name).strip().lower() if name else ""


def normalised(name: Column | str) -> Column:
    """F-10. Compatibility form, stripped, lower case."""
    return F.pandas_udf(lambda s: s.map(pre_normalised), "string")(name)


def dimension_of(name: Column | str, ids: Sequence[tuple[str, str]], aliases: Sequence[tuple[str, str]], least: float = 0.85) -> Column:
    """F-11. struct(id, kind, score) of a free label: an id, an alias or a display name, else the most similar.

    ``ids`` are (id, display name), ``aliases`` (alias, id); labels under ``least`` are dropped.
    """
    known = {i: i for i, _ in ids}
    exact = {pre_normalised(a): i for a, i in reversed(aliases)}
    shown = {pre_normalised(n): i for i, n in reversed(ids)}
    options = [(pre_normalised(n), i) for i, n in ids] + [(pre_normalised(a), i) for a, i in aliases]

    def find(raw: str | None) -> tuple[str | None, str, float | None]:
        name = pre_normalised(raw)
        for table in (known, exact, shown):
            if name and name in table:
                return table[name], "alias", 1.0
        best, score = None, 0.0
        for text, i in options if name else ():
            s = difflib.SequenceMatcher(None, name, text).ratio()
            if s > score:
                best, score = i, s
        return (best, "fuzzy", score) if score >= least else (None, "drop", None)

    def each(names: pd.Series) -> pd.DataFrame:
        seen = {n: find(n) for n in names.unique()}
        return pd.DataFrame([seen[n] for n in names], columns=["id", "kind", "score"])

    return F.pandas_udf(each, "id string, kind string, score double")(name)


def relative_time(column: Column | str, as_of: str) -> Column:
    """F-13. 刚刚, minutes, hours, days; null from 30 days on and for the future."""
    column = F.col(column) if isinstance(column, str) else column
    s = F.unix_timestamp(moment(as_of).cast("timestamp")) - F.unix_timestamp(column.cast("timestamp"))

    def label(n: int, unit: str) -> Column:
        return F.concat(F.floor(s / n).cast("string"), F.lit(unit))

    return F.when(s < 0, None).when(s < 60, "刚刚").when(s < 3600, label(60, "分钟前")).when(s < 86400, label(3600, "小时前")).when(s < 30 * 86400, label(86400, "天前"))


def backfilled_ttl(ttl: Column, dims: Column, days: dict[str, int | None]) -> Column:
    """F-15. The row's own days to live, or those of its first dimension that has any."""
    known = F.create_map(*[F.lit(x) for k, v in days.items() if v is not None for x in (k, v)])
    own = F.filter(F.transform(dims, lambda d: F.element_at(known, d)), lambda x: x.isNotNull())
    return F.coalesce(ttl, F.try_element_at(own, F.lit(1)))


def watermark_age(last: Column, as_of: str) -> Column:
    """F-16."""
    return F.unix_timestamp(moment(as_of).cast("timestamp")) - F.unix_timestamp(last.cast("timestamp"))


def source_ref(file_id: Column, seqs: Column) -> Column:
    """F-18."""
    return F.concat_ws(":", file_id, F.coalesce(F.try_element_at(seqs, F.lit(1)), F.lit(0)).cast("string"))


def json_array(text: Column | str, element: str) -> Column:
    """F-20, L-02. The array in a model's answer, from a fenced block or the outermost brackets; empty if there is none."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\[.*?\])\s*```", 1)
    bare = F.regexp_extract(text, r"(?s)(\[.*\])", 1)
    return F.coalesce(F.from_json(F.when(fenced != "", fenced).otherwise(bare), f"array<{element}>"), F.array().cast(f"array<{element}>"))


def json_object(text: Column | str, fields: str) -> Column:
    """F-22."""
    return F.from_json(F.regexp_extract(text, r"(?s)(\{.*\})", 1), f"struct<{fields}>")


#: What nearly right JSON is made of: strings, structure, and other values.
_JSON_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*+"|[{}\[\]:,]|[^\s"{}\[\]:,\x00-\x1f]+', re.DOTALL)
_JSON_FAULT = re.compile(r'\\(u[0-9a-fA-F]{4}|["\\/bfnrt])|\\|[\x00-\x1f]')


def _sound_string(token: str) -> str:
    """A string with its lone backslashes and control characters escaped."""
    return _JSON_FAULT.sub(lambda m: m[0] if m[1] else "\\\\" if m[0] == "\\" else json.dumps(m[0])[1:-1], token)


def repair_json(text: str | None) -> str | None:
    """F-21. A parseable form of nearly right JSON, null if there is none.

    One pass over its tokens, so what stands inside a string is text, whatever it looks like: lone backslashes and
    control characters are escaped there. Outside, a comma is set between values that have none, is left out
    before a closing bracket, and control characters go.
    """
    out: list[str] = []
    complete = False  # a value ends here, and another would need a comma
    for m in _JSON_TOKEN.finditer(text or ""):
        token = m[0]
        if token in "}]":
            complete = True
        elif token == ",":
            continue
        elif token == ":":
            complete = False
        else:
            if complete:
                out.append(",")
            complete = token not in "{["
            token = _sound_string(token) if token[0] == '"' else token
        out.append(token)
    try:
        return json.dumps(json.loads("".join(out)), ensure_ascii=False)
    except (ValueError, RecursionError):
        return None


def repaired_json(text: Column | str) -> Column:
    return F.pandas_udf(lambda s: pd.Series([repair_json(x) for x in s]), "string")(text)


def uuid5(name: Column, namespace: str = NAMESPACE) -> Column:
    """F-23, T-02. The name-based id, version 5, in a namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    nibble = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int")
    variant = F.lower(F.hex((nibble.bitwiseAND(3) + 8).cast("long")))
    parts = [F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12)]
    return F.concat_ws("-", *parts)


def content_hash(text: Column | str) -> Column:
    """F-24, S-20."""
    return F.sha2(text, 256)


def bucket(key: Column | str) -> Column:
    """F-25. 0 to 99: the first 8 bytes of the key's SHA-256, as a number, modulo 100."""
    first = F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return (first % 100).cast("int")


def variant(key: Column | str, split: float) -> Column:
    return F.when(bucket(key) < split * 100, "a").otherwise("b")


def page_id(title: Column, content: Column) -> Column:
    """F-26. A slug of the title and eight digits of a hash."""
    base = F.regexp_replace(F.lower(F.trim(F.coalesce(title, F.lit("untitled")))), r"[^\p{L}\p{M}\p{N}_-]+", "-")
    base = F.substring(F.regexp_replace(base, r"^-+|-+$", ""), 1, 64)
    digest = F.substring(F.sha2(F.concat(F.coalesce(title, F.lit("None")), F.lit("|"), content), 256), 1, 8)
    return F.concat(F.when(base == "", "page").otherwise(base), F.lit("-"), digest)


class _Page(HTMLParser):
    """Collects a page's visible text. Headings, links and titles are gathered on a stack until they end."""

    UNSEEN = frozenset({"script", "style", "noscript"})
    HEADINGS = frozenset({"h1", "h2", "h3", "h4", "h5", "h6"})
    BREAKS_BEFORE = frozenset({"p", "div", "br", "tr", "blockquote", "pre"})
    BREAKS_AFTER = frozenset({"p", "div", "li", "tr", "blockquote", "pre", "table"})

    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self.unseen, self.title, self.text = 0, None, []
        self.open: list[tuple[str, str | None, list[str]]] = []  # tag, target of a link, its text so far
        self.feed(page)
        self.close()
        while self.open:  # what never ends is plain text
            self._say("".join(self.open.pop()[2]))

    def _say(self, text: str) -> None:
        if not self.unseen:
            (self.open[-1][2] if self.open else self.text).append(text)

    def _in_heading(self) -> bool:
        return any(tag in self.HEADINGS for tag, _, _ in self.open)

    def handle_data(self, data: str) -> None:
        self._say(data)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        target = dict(attrs).get("href") if tag == "a" else None
        if tag in self.UNSEEN:
            self.unseen += 1
        elif tag == "title" or tag in self.HEADINGS or target:
            self.open.append((tag, target, []))
        elif not self._in_heading() and tag == "li":
            self._say("\n- ")
        elif not self._in_heading() and tag in self.BREAKS_BEFORE:
            self._say("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in self.UNSEEN:
            self.unseen = max(0, self.unseen - 1)
        elif any(t == tag for t, _, _ in self.open):
            while True:
                name, target, parts = self.open.pop()
                inner = "".join(parts)
                if name != tag:
                    self._say(inner)
                    continue
                break
            if tag == "title":
                self.title = inner.strip() if self.title is None else self.title
                self._say(inner)
            elif tag == "a":
                self._say(inner if self._in_heading() else f"[{inner.strip()}]({target})")
            else:
                self._say(f"\n{'#' * int(tag[1])} {inner.strip()}\n")
        elif not self._in_heading() and tag in self.BREAKS_AFTER:
            self._say("\n")

    def markdown(self) -> str:
        """Lines without trailing blanks, never two empty ones in a row."""
        lines: list[str] = []
        for line in map(str.rstrip, "".join(self.text).splitlines()):
            if line or (lines and lines[-1]):
                lines.append(line)
        return "\n".join(lines).strip()


def markdown(page: str | None) -> str:
    """F-27. Headings, links, list items and blocks of a page as Markdown; scripts and styles go."""
    return _Page(page or "").markdown()


def page_title(page: str | None) -> str | None:
    return _Page(page or "").title


def to_markdown(page: Column | str) -> Column:
    return F.pandas_udf(lambda s: pd.Series([markdown(x) for x in s], dtype=object), "string")(page)


def html_title(page: Column | str) -> Column:
    return F.pandas_udf(lambda s: pd.Series([page_title(x) for x in s], dtype=object), "string")(page)


def heading(text: Column | str, fallback: Column) -> Column:
    """F-28."""
    found = F.regexp_extract(text, r"(?m)^\s*# (.+)$", 1)
    return F.when(found != "", F.trim(found)).otherwise(fallback)


def group_tokens(chars: Column, candidates: Column, chars_per_token: float = 2.0) -> Column:
    """F-29."""
    return F.ceil((chars + 120 * candidates + 160) / chars_per_token)


def batch_budget(window: int, reserved: int) -> int:
    """F-30."""
    return int(window - reserved - math.ceil(window * 0.08))


def backoff(attempt: Column, base: float, most: float, retry_after: Column | None = None) -> Column:
    """F-31, without the random part."""
    delay = F.least(F.lit(base) * F.pow(F.lit(2.0), attempt - 1), F.lit(most))
    return delay if retry_after is None else F.greatest(delay, F.coalesce(retry_after, F.lit(0.0)))


def millis_to_iso(ms: Column) -> Column:
    """F-32, in a session whose time zone is UTC."""
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def tag_list(text: Column | str) -> Column:
    """F-33. Tags in JSON, perhaps encoded twice; anything else is an empty list."""
    once = F.from_json(text, "array<string>")
    inner = F.from_json(F.element_at(F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>"), 1), "array<string>")
    return F.coalesce(once, inner, F.array().cast("array<string>"))


NOTE = "array<struct<ts:string,text:string>>"


def with_note(notes: Column | str, ts: str, text: str) -> Column:
    """F-34. Notes in JSON with one more; what isn't a list is an empty one."""
    known = F.coalesce(F.from_json(notes, NOTE), F.array().cast(NOTE))
    return F.to_json(F.concat(known, F.array(F.struct(F.lit(ts).alias("ts"), F.lit(text).alias("text")))))


def reject_reason(content: Column, new_id: Column) -> Column:
    """F-35."""
    return F.concat(F.lit("superseded by "), new_id, F.lit(": "), F.substring(content, 1, 100), F.when(F.length(content) > 100, "…").otherwise(""))


def subjects(names: Column) -> Column:
    """F-36."""
    return F.array_distinct(F.filter(F.transform(names, lambda n: F.trim(n)), lambda n: F.length(n) >= 2))


def velocity(dims: Column, dynamic: Sequence[str]) -> Column:
    """F-37. Dynamic if any dimension is."""
    return F.when(F.exists(dims, lambda d: d.isin(list(dynamic))), "dynamic").otherwise("static")


def clamped_priority(raw: Column) -> Column:
    return F.coalesce(F.greatest(F.lit(0), F.least(F.lit(100), raw.cast("int"))), F.lit(50))


def shown_message(seq: Column, ts: Column, role: Column, content: Column) -> Column:
    """F-39."""
    return F.concat(F.lit("[msg#"), seq.cast("string"), F.lit("] "), ts, F.lit(" "), role, F.lit(":\n  "), content, F.lit("\n"))


def memory_id(case_id: Column, index: Column) -> Column:
    """F-41."""
    return F.concat_ws("#", case_id, index.cast("string"))


def utc_text(ts: Column) -> Column:
    """F-46. Fixed width, with Z."""
    return F.concat(F.replace(F.substring(ts.cast("string"), 1, 19), F.lit(" "), F.lit("T")), F.lit("Z"))


def render(template: str, values: dict[str, str]) -> str:
    """F-38, F-42, F-44. Fill {{name}} places."""
    return re.sub(r"\{\{(\w+)\}\}", lambda m: values.get(m[1], m[0]), template)
