"""Secrets in texts, by patterns and by lexing assignments.

Method. Three kinds of spans come from patterns (``BASE``); they are kept as they are. The fourth, ``literal``, comes
from a lexer of what source and configuration files share: names, quoted strings, bare values and operators. It
pairs each target (``name = ``, ``name: type = ``, ``"key": ``, ``key => ``, ``name["key"] = ``, ``<key>``,
``--key value``, ``user:value@host``) with the literals of its value: strings, joined or interpolated ones, arguments
of calls, bare words. A name that was assigned before passes its literals on to the names it is assigned to, so a
constant is judged by every target that it reaches. The words of a target say how sensitive it is, the
characters of a literal how much it looks like a secret; a literal is reported if the product reaches
``threshold`` for one of its targets, unless it lies in a span of another kind.

Scale. One pass over the texts, without a shuffle; each text is lexed alone, and only if it has a sensitive
stem at all, without which no target can be sensitive. Each assignment is one node with its literals and the
earlier nodes that it takes over, and sensitivity runs back along these once, so the time is in proportion
to the text, however long its words, lines and chains of names are.

Defined results: null text is empty and has no spans; places are code points, ends exclusive; spans are
ordered by start, kind as listed in ``KINDS``, and end; repeated rows give repeated results; an empty table gives no
rows; further columns are kept by ``scan``, whatever their names.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import textkit as tk
from lodestone.llm.common import prepare

KINDS = ("assign", "access", "hex", "literal")
#: The patterns of the base kinds, and the least characters of the group named.
BASE = (
    ("assign", re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A | re.I), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]{32,}"), 0, 32),  # a run of fewer holds no longer one
)
THRESHOLD = 0.5

#: How sensitive a word of a name is, and words that turn the thing into something about it if they end the name.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "passcode": 1.0, "pwd": 1.0, "pass": 0.8, "secret": 1.0, "secrets": 1.0, "token": 1.0, "tokens": 0.8, "apikey": 1.0, "credential": 1.0, "credentials": 1.0, "creds": 1.0, "bearer": 1.0, "authorization": 0.9, "auth": 0.7, "signature": 0.6, "salt": 0.6, "key": 0.3}
KEY_OF = {"api", "access", "private", "secret", "encryption", "signing", "auth", "account", "master", "client", "storage", "service", "shared", "app", "license"}
ABOUT = {"count", "length", "len", "limit", "max", "min", "size", "type", "name", "names", "url", "uri", "path", "file", "field", "label", "id", "hint", "policy", "pattern", "regex", "expires", "expiry", "expiration", "ttl", "age", "prompt", "help", "message", "format", "header", "env", "var", "version", "algorithm", "enabled", "required", "index", "usage", "total"}
#: What every sensitive name holds, in lower case, and what addresses hold.
STEMS = ("://", "pass", "pwd", "secret", "token", "key", "cred", "bearer", "auth", "signature", "salt")
#: Literals that stand for a secret without being one.
STAND_IN = re.compile(r"(?i)change.?me|example|sample|dummy|placeholder|redacted|your[_-]|insert|todo|test(ing)?$|x{4,}|\*{3,}|\.{3}|<.*>|\{\{.*\}\}|^\$|^%\w+%$|^(null|none|nil|true|false|undefined|default|password|secret|string|str|required|optional)$")
#: Calls whose argument is the name of a secret that is kept elsewhere.
LOOK_UP = re.compile(r"(?i)(env|environ|getenv|get|getproperty|get_secret|getsecret|lookup|read|open|input|prompt|getpass|print|log|format)$")
SCHEMES = {"bearer", "basic", "token"}

#: The user and password of an address.
USER = r"[A-Za-z][\w+.-]{0,30}://[^\s/:@\"']{0,200}:(?P<held>[^\s/@\"']{1,500})@"
_USER = re.compile(USER)
_TOKENS = re.compile(
    r"(?P<blank>[ \t\r\f\v]+)"
    rf"|(?P<user>{USER})"
    r"|(?P<flag>--[A-Za-z][\w-]*(?=[ \t]+[^\s-]))"
    r"|(?P<tag><(?P<of>[A-Za-z][\w.:-]*)>[ \t]*(?P<inner>[^<>\n]*)</)"
    r"|(?P<name>[^\W\d][\w$]*(?:(?:\.|-(?!-)|::|->)[^\W\d][\w$]*)*)"
    r"|(?P<bare>[\w/.@%-][\w+/.@%-]*)"
    r"|(?P<quote>\"\"\"|(?<!\w)'|\"|`)"
    r"|(?P<op>:=|=>|\+=|[=!<>]=|.)",
    re.S,
)
#: From a quote on, the rest of a string in its line.
_REST = {"'": re.compile(r"(?:[^'\\\n]|\\[^\n])*+'"), '"': re.compile(r'(?:[^"\\\n]|\\[^\n])*+"'), "`": re.compile(r"[^`\n]*+`")}
_BARE = re.compile(r"[^\s\"'`,;<>(){}\[\]?&]+")
_BLANK = re.compile(r"[ \t]*")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_INNER = re.compile(r"\$?\{\s*([^\W\d]\w*)\s*\}|\$([^\W\d]\w*)")
_LAST = re.compile(r"[\w$]*\Z")
ASSIGNS = {"=", ":", ":=", "=>", "+="}
#: Tokens of the arguments of one call, and characters of a quoted name: longer ones are neither.
CALL, QUOTED = 64, 200


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    name: str
    score: float


class Token(NamedTuple):
    kind: str
    start: int
    end: int
    text: str


def base_spans(text: str) -> list[Span]:
    """Leftmost matches of each pattern that don't overlap, less those that are too short."""
    low = text.lower()
    out = []
    for kind, pattern, group, least in BASE:
        if kind == "assign" and not any(x in low for x in ("passw", "secret", "token", "api")):
            continue
        out += [Span(kind, *m.span(), m.group(1) if kind == "assign" else "", 1.0) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return out


def sensitivity(name: str) -> float:
    """How sensitive what a name holds is, from 0 to 1."""
    words = [w.lower() for w in _PART.findall(name)]
    if not words or words[-1] in ABOUT or "public" in words:
        return 0.0
    of_key = any(w == "key" and words[i - 1] in KEY_OF for i, w in enumerate(words) if i)
    return max(1.0 if of_key else 0.0, max(SENSITIVE.get(w, 0.0) for w in words))


def plausibility(literal: str) -> float:
    """How much a literal looks like a secret, from 0 to 1: by length, by the entropy of its characters, and not a stand-in."""
    n = len(literal)
    if n < 6 or STAND_IN.search(literal):
        return 0.0
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(literal).values())
    kinds = sum(bool(re.search(p, literal)) for p in (r"[a-z]", r"[A-Z]", r"[0-9]", r"[^A-Za-z0-9\s]"))
    plain = 0.5 if kinds == 1 and n < 16 or " " in literal.strip() and kinds < 3 else 1.0
    return min(1.0, n / 10) * min(1.0, entropy / 2.5) * plain


def tokens(text: str) -> list[Token]:
    """Names, strings, bare values and operators, ends of lines among them; blanks are left out."""
    out, at, dead = [], 0, dict.fromkeys(['"""', *_REST], -1)
    while at < len(text):
        m = _TOKENS.match(text, at)
        kind, end = m.lastgroup, m.end()
        if m["user"] or m["tag"]:
            kind = "user" if m["user"] else "tag"
        elif kind == "quote":
            kind, quote = "op", m.group()
            if at >= dead[quote]:
                if quote == '"""':
                    close = text.find(quote, end) + 3
                    closed = close > 2
                else:
                    rest = _REST[quote].match(text, end)
                    closed, close = rest is not None, rest.end() if rest else -1
                if closed:
                    kind, end = "string", close
                else:  # no other quote of this kind has an end before the line's, or the text's
                    line = len(text) if quote == '"""' else text.find("\n", end)
                    dead[quote] = line if line >= 0 else len(text)
        if kind != "blank":
            out.append(Token(kind, at, end, text[at:end]))
        at = end
    return out


def _body(t: Token) -> tuple[int, int]:
    """The place of a string without its quotes."""
    k = 3 if t.text.startswith('"""') and len(t.text) > 5 else 1
    return t.start + k, t.end - k


class Value(NamedTuple):
    """What one assignment gives a name: places of literals, and values of names that it takes over."""

    name: str
    places: list[tuple[int, int]]
    taken: list[int]


class Assignments:
    """The assignments of one text in order; a name stands for its last value."""

    def __init__(self, text: str):
        self.text = text
        self.tokens = tokens(text)
        self.values: list[Value] = []
        self.last: dict[str, int] = {}
        i = 0
        while i < len(self.tokens):
            i = self._read(i)

    def literals(self) -> dict[tuple[int, int], tuple[float, str]]:
        """The most sensitive target that each literal reaches."""
        reach = [(sensitivity(v.name), v.name) for v in self.values]
        out: dict[tuple[int, int], tuple[float, str]] = {}
        for k in range(len(self.values) - 1, -1, -1):  # a value is taken over by later ones only
            for j in self.values[k].taken:
                reach[j] = max(reach[j], reach[k])
            for place in self.values[k].places:
                out[place] = max(out.get(place, (0.0, "")), reach[k])
        return out

    def _read(self, i: int) -> int:
        """Takes the assignment at token ``i``, if there is one; where to go on."""
        t = self.tokens[i]
        if t.kind == "user":
            self._assign(Value("password", [_TOKENS.match(self.text, t.start).span("held")], []))
        elif t.kind == "tag":
            m = _TOKENS.match(self.text, t.start)
            self._assign(Value(m["of"], [(m.start("inner"), m.start("inner") + len(m["inner"].rstrip()))], []))
        elif t.kind == "flag" or t.kind == "op" and t.text in ASSIGNS:
            name = t.text if t.kind == "flag" else self._target(i)
            if name:
                value = Value(name, [], [])
                if t.text == "+=" and name in self.last:
                    value.taken.append(self.last[name])
                to = self._take(i + 1, value)
                self._assign(value)
                return max(to, i + 1)
        return i + 1

    def _assign(self, value: Value) -> None:
        self.last[value.name] = self.last[_LAST.search(value.name).group() or value.name] = len(self.values)
        self.values.append(value)

    def _target(self, i: int) -> str | None:
        """The name before an operator that assigns: a name, a string or subscript, without a type."""
        back = self.tokens[max(0, i - 3) : i]
        if not back:
            return None
        named = back[-1]
        if len(back) == 3 and named.text == "]" and back[0].text == "[":
            named = back[1]
        elif len(back) == 3 and self.tokens[i].text == "=" and named.kind == back[0].kind == "name" and back[1].text == ":":
            named = back[0]
        if named.kind == "string" and named.end - named.start <= QUOTED:
            return self.text[slice(*_body(named))]
        return named.text if named.kind == "name" else None

    def _take(self, i: int, value: Value) -> int:
        """Adds what the value that begins with token ``i`` holds; the first token that can begin another assignment."""
        again = i
        while i < len(self.tokens):
            t, following = self.tokens[i], self.tokens[i + 1].text if i + 1 < len(self.tokens) else "\n"
            if t.kind == "string":
                self._string(t, value)
                i += 1
            elif t.kind == "name" and t.end - t.start <= 2 and i + 1 < len(self.tokens) and self.tokens[i + 1].kind == "string" and self.tokens[i + 1].start == t.end:
                i += 1  # the prefix of a string
                continue
            elif t.text in "([" or t.kind == "name" and following in "([":
                i = self._call(i if t.kind == "op" else i + 1, value, t.kind == "op" or LOOK_UP.search(t.text) is None)
            elif t.kind == "name" and (t.text in self.last or following == "+"):
                if t.text in self.last:
                    value.taken.append(self.last[t.text])
                i += 1
            else:
                if t.kind == "op" and t.text in "\n,;){}]":
                    break
                m = _BARE.match(self.text, t.start)
                if m is None:
                    break
                while i < len(self.tokens) and self.tokens[i].start < m.end():
                    i += 1
                again = i  # a bare value's own operators assign nothing
                if m.group().lower() not in SCHEMES:
                    value.places.append(m.span())
                    break
                continue  # the word after the scheme is meant
            if i < len(self.tokens) and self.tokens[i].text == "+":
                i += 1
            elif not (i < len(self.tokens) and self.tokens[i].kind == t.kind == "string"):
                break
        return again

    def _string(self, t: Token, value: Value) -> None:
        """A string's own literal, and the values of names that it interpolates."""
        place = _body(t)
        body = self.text[slice(*place)]
        value.taken.extend(self.last[n] for m in _INNER.finditer(body) if (n := m[1] or m[2]) in self.last)
        if place[1] > place[0] and not _INNER.fullmatch(body):
            value.places.append(place)
            for m in _USER.finditer(body):
                self._assign(Value("password", [(place[0] + m.start("held"), place[0] + m.end("held"))], []))

    def _call(self, i: int, value: Value, holds: bool) -> int:
        """Adds the strings and names between the brackets that open at ``i``, if the call's result ``holds`` them; the token after."""
        depth, end = 0, min(len(self.tokens), i + CALL)
        while i < end:
            t = self.tokens[i]
            i += 1
            depth += (t.text in "([") - (t.text in ")]") if t.kind == "op" else 0
            if holds and t.kind == "string":
                self._string(t, value)
            elif holds and t.kind == "name" and t.text in self.last:
                value.taken.append(self.last[t.text])
            if depth <= 0 or t.text == "\n":
                break
        return i


def literal_spans(text: str, threshold: float) -> Iterator[Span]:
    """Literals that reach the threshold, each under its most telling target."""
    low = text.lower()
    if not any(x in low for x in STEMS):
        return
    for (start, end), (weight, name) in Assignments(text).literals().items():
        if weight >= threshold and (score := weight * plausibility(text[start:end])) >= threshold:
            yield Span("literal", start, end, name, score)


def _outside(literals: list[Span], base: list[Span]) -> list[Span]:
    """Literals that lie in no span of another kind."""
    cover = sorted(base, key=lambda s: s.start)
    starts, ends = [b.start for b in cover], list(accumulate((b.end for b in cover), max))
    return [s for s in literals if not (k := bisect_right(starts, s.start)) or ends[k - 1] < s.end]


def spans(text: str | None, threshold: float = THRESHOLD) -> list[Span]:
    """All spans of a text, in order; a literal in a span of another kind is that one's."""
    if not text:
        return []
    base = base_spans(text)
    found = base + _outside(list(literal_spans(text, threshold)), base)
    return sorted(found, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("name", pa.string()), ("score", pa.float64())]))
SPAN_SQL = "array<struct<kind:string,start:bigint,end:bigint,name:string,score:double>>"


def scan(docs: DataFrame, threshold: float = THRESHOLD, found: str = "spans") -> DataFrame:
    """``docs`` with a further column of the spans of its column ``text``: kind, start, end, target name and score."""
    prepare(docs.sparkSession)

    def run(batches):
        for whole in batches:
            for b in tk.slices(whole, "text"):
                got = [[s._asdict() for s in spans(x, threshold)] for x in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, SPAN)], names=[*b.schema.names, found])

    others = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{others}, `{found}` {SPAN_SQL}")


def redact(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with each span of its texts replaced by its kind in brackets; overlapping spans go together, under the first one's kind."""
    prepare(docs.sparkSession)

    @F.pandas_udf("string")
    def cleaned(texts):
        def one(text):
            out, at = [], 0
            for s in spans(text, threshold):
                if s.start >= at:
                    out += [text[at : s.start], f"[{s.kind}]"]
                at = max(at, s.end)
            return "".join([*out, text[at:]]) if out else text

        return texts.map(one, na_action="ignore")

    return docs.withColumn("text", cleaned("text"))


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(docs: DataFrame) -> DataFrame:
    """The contract's digest."""
    got = scan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", "spans")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "literal")
    return got.select("doc_id", of("assign"), of("access"), of("hex"), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), of("literal"))
