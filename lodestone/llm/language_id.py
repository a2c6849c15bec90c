"""Language identification by prediction by partial matching.

Each language has a variable-order byte context tree (orders 0 to 3) with counts from a bounded
labelled sample. The counts are frozen; a symbol that a context has not seen costs the context's
escape (method C: distinct symbols over total plus distinct) and goes on to the shorter context, down
to a uniform order -1 of 8 bits; a context that the language has not seen costs nothing. A text's code
length under each tree is exact, and its language is the one with the shortest.

The trees of up to ``GROUP`` languages are compiled together: for every string of one to four bytes that
any of them has seen, the whole cost of its last byte after the others in each language, escapes
included, and for every context its escapes. Scoring finds the longest known string at each byte and
adds the escapes of the longer contexts before it. Nothing is pruned or rounded.

Bounds. At most ``cells`` texts of each language are learned from, and at most ``most_languages``
languages, beyond which ``fit`` refuses; so is a model of more than ``most_bytes``, as it is sent to
every worker.

Defined results: null text or one without a letter gives ``und`` with score 0; equal code lengths
give the language whose name sorts first; with nothing to learn from every text is ``und``;
repeated rows are scored alike, and learned from once; further columns of ``docs`` are left out of the
result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import textkit as tk
from lodestone.llm.common import batch, crc_of_id, prepare

UNDETERMINED = "und"
ORDER = 3
#: Languages whose costs stand in one table.
GROUP = 8
#: Tasks that count the strings of the sample, which is bounded: fewer tasks give fewer counts to add up.
SAMPLE_TASKS = 8
#: Bytes of texts that are scored at once, and costs that are held at once meanwhile.
SLICE = 750_000
HELD = 1_500_000
#: Bits that the uniform code is behind by, as a rival of the languages.
RIVAL = 16.0

#: Case and digits carry no language.
FOLD = tk.LOWER.copy()
FOLD[48:58] = 48


@dataclass
class Trees:
    """The compiled trees of some languages. ``costs`` and ``escapes`` are in bits, a column for each language."""

    strings: list[tk.Numbered]  # of 1 to ORDER + 1 bytes
    costs: list[np.ndarray]
    contexts: list[tk.Numbered]  # of 0 to ORDER bytes
    escapes: list[np.ndarray]

    def nbytes(self) -> int:
        return sum(x.nbytes for x in (*self.costs, *self.escapes)) + sum(x.keys.nbytes + x.slots.nbytes for x in (*self.strings, *self.contexts))

    def spent(self, string: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each string of ORDER + 1 bytes."""
        number = self.strings[ORDER].find(string)
        out = self.costs[ORDER][number]
        left = np.flatnonzero(number < 0)
        out[left] = 0
        for order in range(ORDER, -1, -1):  # the strings that this order doesn't know
            context = (string[left] >> 8) & ((1 << 8 * order) - 1)
            known = self.contexts[order].find(context)
            out[left] += np.where((known >= 0)[:, None], self.escapes[order][known], 0.0)
            if order:
                number = self.strings[order - 1].find(string[left] & ((1 << 8 * order) - 1))
                out[left[number >= 0]] += self.costs[order - 1][number[number >= 0]]
                left = left[number < 0]
        out[left] += 8.0
        return out


@dataclass
class PpmModel:
    languages: list[str]
    groups: list[Trees]


def _sample(docs: DataFrame, learn: Column, cells: int, most_languages: int) -> DataFrame:
    """At most ``cells`` labelled texts of each language: the least hash in each cell of hashes."""
    known = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    languages = known.select("lang").distinct().limit(most_languages + 1).count()
    if languages > most_languages:
        raise ValueError(f"more than most_languages={most_languages} languages")
    least = known.groupBy("lang", F.pmod("h", F.lit(cells)).alias("cell")).agg(F.min("h").alias("h"))
    taken = known.join(F.broadcast(least.select("lang", "h")), ["lang", "h"]).dropDuplicates(["lang", "h"]).select("lang", "text")
    return taken.coalesce(SAMPLE_TASKS)


def _gram_counts(batches):
    """(lang, order, gram, count); a gram is up to three bytes of context and the byte that follows."""
    schema = pa.schema([("lang", pa.string()), ("len", pa.int32()), ("gram", pa.int64()), ("n", pa.int64())])
    for b in batches:
        langs = np.array(b.column("lang").to_pylist(), object)
        for lang in sorted(set(langs)):
            rows = b.filter(pa.array(langs == lang))
            for part in tk.slices(rows, "text", SLICE):
                data, offs = tk.buffers(part.column("text"))
                codes = FOLD[data].astype(np.int64)
                age = np.arange(len(codes)) - offs[np.searchsorted(offs, np.arange(len(codes)), "right") - 1]
                gram = codes.copy()
                for length in range(1, ORDER + 2):
                    if length > 1:
                        back = np.zeros_like(codes)
                        back[length - 1 :] = codes[: len(codes) - length + 1]
                        gram = gram + (back << (8 * (length - 1)))
                    got, n = np.unique(gram[age >= length - 1], return_counts=True)
                    if len(got):
                        yield batch(schema, lang=[lang] * len(got), len=np.full(len(got), length, np.int32), gram=got, n=n.astype(np.int64))


def _compiled(lang: np.ndarray, length: np.ndarray, gram: np.ndarray, n: np.ndarray, n_languages: int) -> Trees:
    """``lang`` numbers the languages; a gram is ``length`` bytes, the last one lowest."""
    strings, costs, contexts, escapes = [], [], [], []
    for order in range(ORDER + 1):
        at = length == order + 1
        keys, row = np.unique(gram[at], return_inverse=True)
        count = np.zeros((len(keys), n_languages))
        count[row, lang[at]] = n[at]
        before, context = np.unique(keys >> 8, return_inverse=True)
        total, kinds = np.zeros((len(before), n_languages)), np.zeros((len(before), n_languages))
        np.add.at(total, context, count)
        np.add.at(kinds, context, count > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(total > 0, np.log2(total + kinds) - np.log2(kinds), 0.0)
            direct = np.log2((total + kinds)[context]) - np.log2(count)
        # a string without its oldest byte has been seen wherever the string has
        shorter = costs[-1][strings[-1].find(keys & ((1 << 8 * order) - 1))] if order else np.full((len(keys), n_languages), 8.0)
        strings.append(tk.Numbered(keys))
        costs.append(np.where(count > 0, direct, escape[context] + shorter))
        contexts.append(tk.Numbered(before))
        escapes.append(escape)
    return Trees(strings, costs, contexts, escapes)


def fit(docs: DataFrame, learn: Column, cells: int = 256, most_languages: int = 64, most_bytes: int = 512 << 20) -> PpmModel | None:
    """Learn from rows where ``learn`` holds: at most ``cells`` texts a language."""
    prepare(docs.sparkSession)
    grams = _sample(docs, learn, cells, most_languages).mapInArrow(_gram_counts, "lang string, len int, gram long, n long")
    rows = grams.groupBy("lang", "len", "gram").agg(F.sum("n").alias("n")).toPandas()
    if rows.empty:
        return None
    languages = sorted(rows["lang"].unique())
    lang = np.searchsorted(languages, rows["lang"].to_numpy(object).astype(str))
    length, gram, n = rows["len"].to_numpy(), rows["gram"].to_numpy(), rows["n"].to_numpy()
    groups = []
    for first in range(0, len(languages), GROUP):
        own = (lang >= first) & (lang < first + GROUP)
        groups.append(_compiled(lang[own] - first, length[own], gram[own], n[own], min(GROUP, len(languages) - first)))
    if (size := sum(g.nbytes() for g in groups)) > most_bytes:
        raise ValueError(f"the model has {size} bytes, more than most_bytes={most_bytes}: learn from fewer cells")
    return PpmModel(languages, groups)


def code_lengths(model: PpmModel, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Bits of each text under each language; a text starts after blanks."""
    out = np.zeros((len(offs) - 1, len(model.languages)))
    if not len(data):
        return out
    codes, starts = FOLD[data], offs[:-1][np.diff(offs) > 0]
    step = HELD // min(GROUP, len(model.languages))
    for lo in range(0, len(data), step):
        hi = min(lo + step, len(data))
        string = codes[lo:hi].astype(np.int64)
        first = starts[np.searchsorted(starts, lo - ORDER) : np.searchsorted(starts, hi)]  # of texts that start here or just before
        for k in range(1, ORDER + 1):
            old = np.full(hi - lo, 32, np.int64)
            old[max(0, k - lo) :] = codes[max(0, lo - k) : max(0, hi - k)]
            for j in range(k):
                near = first + j - lo
                old[near[(near >= 0) & (near < hi - lo)]] = 32
            string |= old << (8 * k)
        row = np.arange(np.searchsorted(offs, lo, "right") - 1, np.searchsorted(offs, hi, "left"))
        row = row[offs[row + 1] > offs[row]]
        at = np.maximum(offs[row], lo) - lo
        for k, trees in enumerate(model.groups):
            out[row, k * GROUP : k * GROUP + GROUP] += np.add.reduceat(trees.spent(string), at, axis=0)
    return out


def posterior(bits: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """Of the best language of each text, under equal priors of all, against a uniform code of 8 bits a byte too."""
    best = bits.min(1)
    rivals = np.exp2(-(bits - best[:, None])).sum(1)
    with np.errstate(over="ignore"):
        return 1 / (rivals + np.exp2(np.minimum(best - (8.0 * n_bytes + RIVAL), 1000)))


def identify(docs: DataFrame, model: PpmModel | None) -> DataFrame:
    """(doc_id, lang_pred, score): the score is the ``posterior`` of the language."""
    spark = docs.sparkSession
    prepare(spark)
    shape = "doc_id long, lang_pred string, score double"
    has_letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), has_letter, "text")
    if model is None:
        return texts.select("doc_id", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    held = spark.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def score(batches):
        m = held.value
        names = np.array([*m.languages, UNDETERMINED], object)
        for whole in batches:
            for part in tk.slices(whole, "text", SLICE):
                data, offs = tk.buffers(part.column("text"))
                bits = code_lengths(m, data, offs)
                letter = part.column("letter").to_numpy(zero_copy_only=False)
                best = bits.argmin(1)
                yield batch(schema, doc_id=part.column("doc_id"), lang_pred=names[np.where(letter, best, len(m.languages))], score=np.where(letter, posterior(bits, np.diff(offs)), 0.0))

    return texts.mapInArrow(score, shape)


def query(docs: DataFrame) -> DataFrame:
    """The contract's digest: learn where crc32(doc_id) mod 4 is not 2, then predict every text."""
    held_out = F.coalesce(crc_of_id() % 4 == 2, F.lit(False))
    model = fit(docs, ~held_out)
    return identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def gate(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Keep the documents whose language is determined with a ``posterior`` of at least ``least``.

    Texts that no learned language codes better than 8 bits a byte, as those of another script, go.
    Every row is judged by itself and passes with all its columns; repeated rows stay repeated.
    """
    spark = docs.sparkSession
    prepare(spark)
    model = fit(docs, F.coalesce(crc_of_id() % 4 != 2, F.lit(True)))
    if model is None:
        return docs.limit(0)
    held = spark.sparkContext.broadcast(model)

    def keep(batches):
        m = held.value
        for whole in batches:
            for part in tk.slices(whole, "text", SLICE):
                data, offs = tk.buffers(part.column("text"))
                yield part.filter(pa.array(posterior(code_lengths(m, data, offs), np.diff(offs)) >= least))

    return docs.where(F.col("text").rlike(r"\p{L}")).mapInArrow(keep, docs.schema)
