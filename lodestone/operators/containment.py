"""Which texts contain which of many strings, without comparing every text with every string."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.session import materialize

BETWEEN = r"[^\p{L}\p{N}]+"
#: Inner words of a long string that are looked for together.
RUN = 3
#: Letters by which a short string's longest word is looked for in the vocabulary.
GRAM = 3
#: Keys that are sent to every task, at most; with more of them rows are shuffled, but for those that a filter drops.
SENT = 1 << 20
#: Rows of that filter, a power of two, each of 64 bits. It is as large for any number of keys.
FILTER = 1 << 20


def _all(text: Column | str, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _words(text: Column | str) -> Column:
    return F.array_remove(F.split(text, BETWEEN), "")


def _hashed(df: DataFrame) -> DataFrame:
    """``df`` with hashes of its words ``w`` (wh), their last letters (ends) and their first letters (starts)."""
    of = lambda f: F.transform("w", lambda x: F.xxhash64(f(x)))
    return df.withColumns({"wh": of(lambda x: x), "ends": of(lambda x: F.right(x, F.lit(1))), "starts": of(lambda x: F.left(x, F.lit(1)))})


def _runs(hashes: str, n: int) -> Column:
    """A hash of each ``n`` consecutive values of the column ``hashes``."""
    one = lambda x, i: F.xxhash64(x, *[F.get(hashes, i + k) for k in range(1, n)])
    return F.slice(F.transform(hashes, one), 1, F.greatest(F.size(hashes) - n + 1, F.lit(0)))


def _edged(n: int) -> Column:
    """A hash of each ``n`` consecutive words between two others, with the last letter of the one and the first letter of the other."""
    one = lambda x, i: F.xxhash64(x, *[F.get("wh", i + k) for k in range(1, n + 1)], F.get("starts", i + n + 1))
    return F.slice(F.transform("ends", one), 1, F.greatest(F.size("ends") - n - 1, F.lit(0)))


def _pieces(word: Column | str, n: int) -> Column:
    at = F.sequence(F.lit(1), F.length(word) - n + 1)
    return F.when(F.length(word) >= n, F.transform(at, lambda i: F.substring(word, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def _grams(word: Column | str, sizes: Iterable[int]) -> Column:
    """The distinct pieces of a word, of so many letters each."""
    return F.array_distinct(F.concat(*[_pieces(word, n) for n in sizes]))


def _kept(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The ``rows`` whose ``key`` is one of the distinct ``keys`` (key).

    Texts have far more runs and words than strings ask for, so what no string asks for is dropped before any row is
    shuffled: few keys are sent to every task; many set two bits each in a filter, which is sent instead.
    Rows that find their bits set then meet the keys themselves.
    """
    if keys.count() <= SENT:
        return rows.join(F.broadcast(keys), "key", "left_semi")
    one, key = F.lit(1).cast("long"), F.col("key")
    bit = lambda by: F.call_function("shiftleft", one, F.shiftrightunsigned(key, by).bitwiseAND(F.lit(63)).cast("int"))
    of, own = key.bitwiseAND(F.lit(FILTER - 1)), bit(32).bitwiseOR(bit(48))
    bits = keys.groupBy(of.alias("_of")).agg(F.bit_or(own).alias("_bits"))
    maybe = rows.withColumn("_of", of).join(F.broadcast(bits), "_of").where(F.col("_bits").bitwiseAND(own) == own).drop("_of", "_bits")
    return maybe.join(keys, "key")  # a semi-join would be pushed below the filter


def _by_runs(texts: DataFrame, needles: DataFrame, kinds: list[int], probes: DataFrame | None = None) -> DataFrame:
    """(text_id, needle) of texts that hold the rarest run of a needle (needle, w) of three words or more, or a word of ``probes`` (needle, key).

    The ``kinds`` that there are tell what texts are cut into, in one pass: runs (3, 4 and more words), words (1), what is between words (0).
    """
    parts = {3: _edged(1), 4: _edged(2), RUN + 2: _runs("wh", RUN), 1: F.col("wh"), 0: F.transform(_all("text", BETWEEN), lambda x: F.xxhash64(x))}
    keyed = _hashed(texts.select("text_id", "text", _words("text").alias("w"))).select("text_id", F.explode(F.array_distinct(F.concat(*[parts[n] for n in kinds]))).alias("key"))
    own = F.when(F.size("w") == 3, _edged(1)).when(F.size("w") == 4, _edged(2)).otherwise(_runs("inner", RUN))
    asked = _hashed(needles.where(F.size("w") > 2)).withColumn("inner", F.slice("wh", 2, F.size("w") - 2))
    asked = materialize(asked.select("needle", F.explode(F.array_distinct(own)).alias("key")), "asked-runs")
    keys = asked.select("key") if probes is None else asked.select("key").unionByName(probes.select("key"))
    hits = materialize(_kept(keyed, keys.distinct()), "runs")
    counts = hits.groupBy("key").agg(F.count("*").alias("texts"))
    best = asked.join(counts, "key", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "key")).alias("best"))
    best = best.select("needle", F.col("best.key").alias("key"))
    return hits.join(best if probes is None else best.unionByName(probes), "key").select("text_id", "needle")


def mentions(texts: DataFrame, needles: DataFrame) -> DataFrame:
    """(text_id, needle) of the ``texts`` (text_id, text) that contain a needle as a substring, each pair once.

    A string's inner words are whole words of every text that contains it, as only its first and last word
    may be parts of longer ones. So a string of five words or more is looked for by a run of inner words, of its runs the
    one that the fewest texts have, and one of three or four by its inner words with the letters beside
    them, in equi-joins with the runs of the texts. Texts keep those of their runs that some string has, so these rows grow
    with the texts and not with the strings. For a shorter string the words
    that contain its longest word are looked up in the vocabulary of all texts first, which grows far less than the
    texts; one without words is looked up likewise in what stands between words. ``contains`` then
    decides on the pairs that are left. The empty string is in every text, null in none.
    """
    needles = needles.select("needle").where("needle IS NOT NULL").distinct().withColumn("w", _words("needle"))
    has = lambda c: F.max(F.coalesce(c, F.lit(False)))
    of_size = {n: F.size("w") == n for n in (3, 4)} | {RUN + 2: F.size("w") >= RUN + 2, 1: F.size("w").isin(1, 2), 0: (F.size("w") == 0) & (F.col("needle") != "")}
    sizes = needles.agg(*[has(c).alias(f"n{n}") for n, c in of_size.items()], has(F.col("needle") == "").alias("empty")).first()
    longest = lambda words_: F.array_max(F.transform(words_, lambda x: F.struct(F.length(x), x.alias("word"))))["word"]
    kinds, probes = [n for n in of_size if sizes[f"n{n}"]], None
    if sizes["n0"] or sizes["n1"]:
        kinds = sorted({*kinds, 1})
        words = F.concat(_words("text"), _all("text", BETWEEN)) if sizes["n0"] else _words("text")
        short = needles.where((F.size("w") <= 2) & (F.col("needle") != "")).select("needle", F.when(F.size("w") > 0, longest(F.col("w"))).otherwise(F.col("needle")).alias("part"))
        short = short.withColumn("gram", F.substring("part", 1, GRAM))
        vocabulary = texts.select(F.explode(F.array_distinct(words)).alias("word")).distinct()
        letters = sorted(r["n"] for r in short.select(F.length("gram").alias("n")).distinct().collect())  # at most GRAM
        grams = vocabulary.select("word", F.explode(_grams("word", letters)).alias("gram")).withColumn("key", F.xxhash64("gram"))
        known = _kept(grams, short.select(F.xxhash64("gram").alias("key")).distinct()).join(short, "gram").where(F.contains("word", "part"))
        probes = materialize(known.select("needle", F.xxhash64("word").alias("key")).distinct(), "probes")
    found = []
    if kinds:
        pairs = _by_runs(texts, needles, kinds, probes).repartition("text_id").distinct()  # dealt as the texts are, so once
        found.append(pairs.join(texts, "text_id").where(F.contains("text", "needle")).select("text_id", "needle").distinct())
    if sizes["empty"] or not kinds:
        everywhere = needles.where("needle = ''").select("needle")  # one row at most
        found.append(texts.where("text IS NOT NULL").select("text_id").distinct().crossJoin(F.broadcast(everywhere)))
    return reduce(DataFrame.unionByName, found)


#: Strings that are sent to every task instead of being shuffled, at most.
FEW = 10_000


def _overlapping(word: Column | str, n: int) -> Column:
    """Like ``_pieces``, in one scan, so that a word of any length costs linear time."""
    return F.regexp_extract_all(word, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))


def tokens(text: Column | str, blanks: bool = False) -> Column:
    """The distinct runs of characters other than white space in a text, and those of white space if ``blanks``."""
    return F.array_distinct(_all(text, r"\S+|\s+") if blanks else F.split(text, r"\s+"))


def within_tokens(known: DataFrame, parts: DataFrame, few: bool) -> DataFrame:
    """(part, token, n) of the ``known`` tokens (token, n) that contain one of ``parts`` (part), by an equi-join on the part's first letters.

    ``few`` says that the caller has counted the parts and found at most ``FEW``.
    """
    wanted = parts.select("part").distinct().withColumn("gram", F.substring("part", 1, GRAM))
    pieces = F.array_distinct(F.concat(*[_overlapping("token", n) for n in range(1, GRAM + 1)]))
    grams = known.select("token", "n", F.explode(pieces).alias("gram"))
    return grams.join(F.broadcast(wanted) if few else wanted, "gram").where(F.contains("token", "part")).select("part", "token", "n")


def rarest_tokens(needles: DataFrame, known: DataFrame, few: bool, blanks: bool) -> DataFrame:
    """(needle, token) for strings of several tokens: every text with ``needle`` has one of its ``token`` rows.

    Each token of such a string lies within a token of the texts that contain it. Of these the one is taken whose tokens are
    in the fewest texts, so that a common word is not looked for where a rare one stands beside it. A string with a
    part that is in no token is in no text.
    """
    parts = needles.select("needle", F.explode(tokens("needle", blanks)).alias("part")).where("part <> ''")
    hits = within_tokens(known, parts, few)
    costs = hits.groupBy("part").agg(F.sum("n").alias("cost"))
    best = parts.join(costs, "part", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("cost", F.lit(0)).alias("cost"), "part")).alias("best"))
    return best.select("needle", F.col("best.part").alias("part")).join(hits.select("part", "token"), "part").select("needle", "token")
