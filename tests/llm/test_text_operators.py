"""Operators on whole texts against brute force, exact round trips and held-out labels."""

import functools
import hashlib
import io
import itertools
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.llm import fingerprints, language_id, media, mixing, near_duplicates, packing, quality, repeats, token_store, tokens, toxicity
from lodestone.llm import textkit as tk

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LETTERS = list(" \n\t  abcZé'’|<>ß0129.,!?́İıÅñ世界🎉 \u0085DžſẞŉY½²ª\x1c\x0b\r") + ["<|endoftext|>", "'s", "don't", " 123"]


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, len(t or "")) for i, t, lang, src in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, copies, ties, a repeated row, and columns with clashing names."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 8))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = text(120)
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, base, "en", "a"), (4, base, "en", "b"), (5, base + " end", "fr", "b"), (6, text(30_000), "en", "a"), (7, "x", "en", None), (7, "x", "en", None), (9, text(40) + " " + base[:200], "fr", "c"), (-3, "é" * 300, None, "c"), (12, "12 !? 34", "en", "a"), (None, "lone text without id", "en", "a")]
    df = documents(spark, rows)
    return df.withColumns({"part": F.lit(1), "kind": F.lit("k"), "payload": F.lit("p"), "row": F.lit("r"), "copy": F.lit("c"), "length": F.lit(5), "_nth": F.lit(2)})


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


library = functools.cache(Tokenizer.from_file)


def plain(df):
    return [r.asDict() for r in df.collect()]


# token ids, packing, token store


@pytest.mark.parametrize(("path", "keep"), [(BYTE, True), (WORD, False)])
@settings(max_examples=200, deadline=None)
@given(texts=st.lists(st.lists(st.sampled_from(LETTERS), max_size=25).map("".join), max_size=8))
def test_unit_ids_are_those_of_the_library(path, keep, texts):
    ids, offs = tokens.encoder(path, keep).encode(*tk.buffers(pa.array(texts, pa.string())))
    want = [e.ids for e in library(path).encode_batch(texts, add_special_tokens=False)] if texts else []
    assert [ids[a:b].tolist() for a, b in itertools.pairwise(offs.tolist())] == want


def test_forgetting_changes_no_ids(monkeypatch):
    monkeypatch.setattr(tokens, "MOST_UNITS", 5)
    e, t = tokens.Encoder(BYTE, True), Tokenizer.from_file(BYTE)
    for texts in (["a b c", "d e f g h i j"], ["a b c d", "k l"], ["a", "b"]):
        ids, offs = e.encode(*tk.buffers(pa.array(texts)))
        assert [ids[a:b].tolist() for a, b in itertools.pairwise(offs.tolist())] == [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120))
def test_plan_places_each_length_as_often_as_it_is_there(lengths):
    counts = np.bincount(lengths, minlength=41)
    patterns = packing.plan(counts, 40)
    used = np.zeros(41, np.int64)
    for held, times in patterns:
        assert sum(held) <= 40
        for x in held:
            used[x] += times
    assert used.tolist() == counts.tolist()


def test_exact_complements_leave_no_gap():
    counts = np.zeros(101, np.int64)
    for a, b, c in ((60, 25, 15), (50, 30, 20), (70, 30, 0), (41, 33, 26)):
        for x in (a, b, c):
            counts[x] += 7 * (x > 0)
    assert sum(times for _, times in packing.plan(counts, 100)) == 28


def test_packing_is_gapless_and_whole(spark, odd):
    got = plain(packing.query(odd, BYTE))
    texts = [r["text"] or "" for r in odd.collect()]
    want = [[*e.ids, 0] for e in Tokenizer.from_file(BYTE).encode_batch(texts, add_special_tokens=False)]
    assert sum(r["length"] for r in got) == sum(map(len, want))
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by_sequence) == -(-sum(map(len, want)) // 2048)
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    pieces = sorted(crc(x[a:b]) for x in want for a, b in itertools.pairwise([0, *range(len(x) % 2048 or 2048, len(x) + 1, 2048)]))
    assert sorted(r["ids_crc32"] for r in got) == pieces


def test_packing_nothing(empty):
    assert packing.query(empty, BYTE).count() == 0


def mirrored(k):
    """Two words of 2**k letters whose polynomial hashes modulo 2**64 are equal for k >= 10."""
    x = "a"
    for _ in range(k):
        x += x.translate(str.maketrans("ab", "ba"))
    return x, x.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize(("path", "keep"), [(BYTE, True), (WORD, False)])
@pytest.mark.parametrize("k", [10, 11])
def test_units_are_known_by_their_characters(spark, tmp_path, path, keep, k):
    one, two = mirrored(k)
    spans = tk.Spans(np.frombuffer((one + two).encode(), np.uint8))
    assert spans(np.array([0]), np.array([2**k])) == spans(np.array([2**k]), np.array([2 ** (k + 1)]))  # the case is real
    texts = [one, two, f"{two} x {one}", two]
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert want[0] != want[1]
    e = tokens.Encoder(path, keep)
    for batch in (texts, texts[::-1], texts):
        ids, offs = e.encode(*tk.buffers(pa.array(batch)))
        got = [ids[a:b].tolist() for a, b in itertools.pairwise(offs.tolist())]
        assert got == (want if batch is texts or batch == texts else want[::-1])
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    docs = documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)]).coalesce(1)
    packed = {r["doc_id"]: r["ids_crc32"] for r in packing.query(docs, path).collect() if r["piece"] == 0}
    assert packed == {i: crc([*x, 0]) for i, x in enumerate(want)}
    if not keep:  # the store takes tokens without white space
        token_store.write(docs, str(tmp_path / "s"), path)
        stored = {r["doc_id"]: r["ids_crc32"] for r in token_store.read(spark, str(tmp_path / "s")).collect()}
        assert stored == {i: crc([*x, 1]) for i, x in enumerate(want)}


def test_more_units_than_slots(monkeypatch):
    monkeypatch.setattr(tokens, "SLOT_BITS", 3)
    text = " ".join(f"w{k}" for k in range(500))
    ids, _ = tokens.Encoder(BYTE, True).encode(*tk.buffers(pa.array([text])))
    assert ids.tolist() == Tokenizer.from_file(BYTE).encode(text, add_special_tokens=False).ids


def test_long_words_make_different_shingles():
    one, two = mirrored(11)
    _, value = tk.shingles(*tk.buffers(pa.array([one, two, one])))
    assert value[0] == value[2] != value[1]


@pytest.mark.parametrize("n", [1, 7, 5000])
def test_perfect_hash_is_minimal_and_round_trips(n):
    keys = tk.mix(np.arange(n, dtype=np.uint64))
    made = token_store.PerfectHash.build(keys)
    again = token_store.PerfectHash.from_bytes(made.to_bytes())
    assert sorted(again.slots(keys).tolist()) == list(range(n))
    assert (again.slots(keys[:1]) == again.slots(keys)[:1]).all()
    with pytest.raises(ValueError, match="repeat"):
        token_store.PerfectHash.build(np.append(keys, keys[0]))


def test_width_holds_every_id():
    assert token_store.id_width(WORD, 1) == 2
    assert token_store.id_width(WORD, 1 << 16) == 4


@pytest.mark.parametrize("bucket", [1 << 14, 4])
def test_token_store_round_trip(spark, odd, tmp_path, monkeypatch, bucket):
    monkeypatch.setattr(token_store, "BUCKET_KEYS", bucket)
    path = str(tmp_path / "store")
    more = [(5, f"another text {k} of the same id", "en", "a") for k in range(20)] + [(None, f"another text {k} without id", "en", "a") for k in range(20)]
    docs = odd.select("doc_id", "text").union(documents(spark, more).select("doc_id", "text"))
    token_store.write(docs, path, WORD, shard_ids=50)
    rows = sorted(plain(token_store.read(spark, path)), key=lambda r: r["start"])
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert [r["doc_id"] for r in rows] == sorted((i for i, _ in texts), key=lambda x: (x is not None, x))
    t = Tokenizer.from_file(WORD)
    want = [(i, [*t.encode(x or "", add_special_tokens=False).ids, 1]) for i, x in texts]
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    key = lambda x: (x[0] is not None, *x)
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows), key=key) == sorted(((i, len(x), crc(x)) for i, x in want), key=key)
    start = 0
    for r in rows:
        assert r["start"] == start
        start += r["n_tokens"]
    asked = spark.createDataFrame([(k,) for k in (3, 5, 6, 6, 7, 1000, -8, None)] + [(k,) for k in range(2000, 4000)], "doc_id long")
    got = sorted(((r["doc_id"], r["ids"]) for r in token_store.lookup(asked, path).collect()), key=lambda x: (str(x[0]), x[1]))
    assert got == sorted(((i, x) for i, x in want if i in (3, 5, 6, 7, None)), key=lambda x: (str(x[0]), x[1]))


def test_empty_token_store(spark, empty, tmp_path):
    token_store.write(empty, str(tmp_path / "s"), WORD)
    assert token_store.read(spark, str(tmp_path / "s")).count() == 0


# media


@pytest.mark.parametrize("shape", [(1, 1), (7, 13), (64, 64)])
@pytest.mark.parametrize("encode", [media.encode_pgm, media.encode_bmp])
def test_grey_files_round_trip(shape, encode):
    x = np.random.default_rng(1).integers(0, 256, shape).astype(np.uint8)
    assert (media.decode(encode(x)) == x).all()


def test_netpbm_kinds():
    assert media.decode(b"P1\n# c\n2 2\n1 0\n01").tolist() == [[0, 255], [255, 0]]
    assert media.decode(b"P2 2 1 3 0 3").tolist() == [[0, 255]]
    assert media.decode(b"P3\n1 1\n255\n1 2 3").tolist() == [[[1, 2, 3]]]
    assert media.decode(b"P4\n3 1\n" + bytes([0b10100000])).tolist() == [[0, 255, 0]]
    assert media.decode(b"P6\n1 1\n255\n\x01\x02\x03").tolist() == [[[1, 2, 3]]]


def bmp(width, height, depth, colours, palette, rows):
    head = struct.pack("<2sIHHI", b"BM", 54 + len(palette) + len(rows), 0, 0, 54 + len(palette))
    return head + struct.pack("<IiiHHIIiiII", 40, width, height, 1, depth, 0, len(rows), 0, 0, colours, 0) + palette + rows


def test_bmp_kinds():
    red, blue = bytes((0, 0, 255, 0)), bytes((255, 0, 0, 0))
    assert media.decode(bmp(2, 1, 1, 2, red + blue, bytes([0b01000000, 0, 0, 0]))).tolist() == [[[255, 0, 0], [0, 0, 255]]]
    assert media.decode(bmp(2, 1, 4, 2, red + blue, bytes([0x10, 0, 0, 0]))).tolist() == [[[0, 0, 255], [255, 0, 0]]]
    assert media.decode(bmp(1, -2, 24, 0, b"", bytes([1, 2, 3, 0, 4, 5, 6, 0]))).tolist() == [[[3, 2, 1]], [[6, 5, 4]]]


BROKEN = [
    b"", b"P7\n", b"GIF89a", b"P5\n9 9\n255\n1", b"BM", b"P5\n1 1\n70000\n12", b"P5 " + b"9" * 400 + b" 9 255\n", b"P2 99999999 99999999 255\n1", b"P2 2 1 9 3 300", b"P2 1 1 255 -4",
    b"P3 1 1 255 1 2 x", b"P5 2 1 3\n\x01\x09", bmp(2, 1, 8, 2, bytes(8), bytes([0, 2, 0, 0])), bmp(2, 1, 8, 1 << 30, bytes(8), bytes(4)), bmp(2**31 - 1, -(2**31), 24, 0, b"", b""),
]


@settings(max_examples=300, deadline=None)
@given(st.sampled_from([b"P1 ", b"P2 3 2 9 ", b"P3 1 1 9 ", b"P4 9 2 ", b"P5 2 2 255 ", b"P6 1 1 99 ", bmp(3, 2, 8, 2, bytes(8), bytes(8))]), st.binary(max_size=80), st.integers(0, 60))
def test_any_bytes_are_described(head, tail, cut):
    for raw in (head + tail, head[:cut] + tail, head[:cut] + tail + head[cut:]):
        assert len(media.described(raw)) == 4


@pytest.mark.parametrize("raw", BROKEN)
def test_broken_files_are_refused(raw):
    with pytest.raises(ValueError, match="."):
        media.decode(raw)


def test_area_resize_weighs_by_area():
    x = np.random.default_rng(2).integers(0, 256, (5, 7)).astype(np.uint8)
    fine = np.repeat(np.repeat(x, 3 * 4, 0), 4 * 3, 1).astype(float)  # each cell of a 3 x 4 grid is whole here
    h, w = fine.shape[0] // 3, fine.shape[1] // 4
    want = fine.reshape(3, h, 4, w).mean((1, 3))
    assert np.allclose(media.area_resize(x, 3, 4), want)


def test_media_digest(odd):
    want = {}
    for r in odd.collect():
        raw = (r["text"] or "").encode()
        want[r["doc_id"]] = (len(raw), raw.ljust(max(1, -(-len(raw) // 64)) * 64, b"\0"))
    got = plain(media.query(odd))
    assert len(got) == odd.count()
    for r in got:
        n, payload = want[r["doc_id"]]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        encode = media.ENCODERS[r["media_format"]]
        stored = encode(np.frombuffer(payload, np.uint8).reshape(-1, 64))
        tile = media.npy_tile(media.decode(stored))
        assert (r["tile_crc32"], r["mean_brightness"]) == (zlib.crc32(tile), np.load(io.BytesIO(tile)).mean())
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
    assert len({r["feature"] for r in got if r["doc_id"] in (3, 4)}) == 1
    assert {r["media_format"] for r in got} == {"pgm", "bmp"}
    assert media.query(odd.where("false")).count() == 0


def test_media_features_of_broken_images_are_null(spark):
    df = spark.createDataFrame([(1, bytearray(b"no image")), (2, None), (3, bytearray(media.encode_bmp(np.eye(9, dtype=np.uint8) * 255)))], "height_id int, media binary")
    got = {r["height_id"]: r for r in media.features(df).collect()}
    assert got[1]["dhash"] is None and got[2]["dhash"] is None
    assert (got[3]["height"], got[3]["width"], len(got[3]["dhash"])) == (9, 9, 16)


# fingerprints


def shingle_set(text, n=5):
    w = text.lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_fingerprints_of_texts_and_edits(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    got = {r["doc_id"]: r for r in fingerprints.query(docs).collect()}
    assert len(got) == len(rows)
    errors = []
    for (i, a), (_, b) in zip(rows, [*rows[1:], rows[0]], strict=True):
        edited = a[: len(a) - len(a) // 2] + b[: len(a) // 2]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i]["n_chars"] == len(a)
        x, y = shingle_set(a), shingle_set(edited)
        errors.append(got[i]["near_edited"] - len(x & y) / len(x | y))
    assert np.sqrt(np.mean(np.square(errors))) < 0.05
    assert abs(np.mean(errors)) < 0.015


def test_fingerprints_of_odd_rows(odd, empty):
    got = plain(fingerprints.query(odd))
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got}
    assert by[3]["fingerprint"] == by[4]["fingerprint"] != by[9]["fingerprint"]
    assert by[1]["near_edited"] == by[1]["near_next"] == by[3]["near_next"] == 1.0
    assert by[2]["near_next"] == 0.0
    assert all(0 <= r[c] <= 1 for r in got for c in ("near_edited", "near_next"))
    assert fingerprints.query(empty).count() == 0
    one = fingerprints.query(odd.where("doc_id = 9")).first()
    assert one["near_next"] == 1.0


def test_densification_leaves_no_bin_empty():
    low, some = fingerprints.sketch(*tk.buffers(pa.array(["a b", "", "one two three four five six seven"])))
    assert some.tolist() == [True, False, True]
    assert len(set(low[0].tolist())) == 1  # one shingle fills all bins
    assert not low[1].any()


# near duplicates


def brute_classes(rows, idf, least):
    """(doc_id, text) rows: the least id that each row reaches by weighted Jaccard similarity."""
    shingled = []
    for _, text in rows:
        _, value, times, own = near_duplicates.weighted(pa.array([text or ""]), idf)
        shingled.append({v: t * w for v, t, w in zip(value.tolist(), times.tolist(), own.tolist(), strict=True)})
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = shingled[i], shingled[j]
        low = sum(min(a[k], b[k]) for k in a.keys() & b.keys())
        high = sum(a.values()) + sum(b.values()) - low
        if (rows[i][1] or "") == (rows[j][1] or "") or high and low / high >= least:
            root[find(j)] = find(i)
    members = {}
    for k in range(len(rows)):
        members.setdefault(find(k), []).append(rows[k][0])
    return sorted((rows[k][0], min(members[find(k)])) for k in range(len(rows)))


@pytest.fixture(scope="module")
def copies(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(2000)]
    rows = []
    for group in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(3, 200))]
        for _ in range(rng.randint(1, 9)):
            own = list(base)
            for _ in range(rng.randint(0, len(base) // 40)):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((len(rows), " ".join(own), "en", f"s{group}"))
    rows += [(len(rows) + k, t, "en", "x") for k, t in enumerate(["", None, "", "one", "one", "two words"])]
    return rows


@pytest.mark.parametrize("block", [128, 2, 5])
def test_near_duplicate_classes(spark, copies, monkeypatch, block):
    monkeypatch.setattr(near_duplicates, "BLOCK", block)
    docs = documents(spark, copies)
    idf = near_duplicates.frequencies(docs)
    got = sorted((r["doc_id"], r["class_id"]) for r in near_duplicates.query(docs).collect())
    assert got == brute_classes([r[:2] for r in copies], idf, 0.8)


@pytest.mark.parametrize("ceiling", [64, 3])
def test_frequencies_are_exact_up_to_the_ceiling(spark, copies, monkeypatch, ceiling):
    monkeypatch.setattr(near_duplicates, "CEILING", ceiling)
    got = near_duplicates.frequencies(documents(spark, copies).repartition(7))
    count = {}
    for r in copies:
        for v in set(tk.shingles(*tk.buffers(pa.array([r[1] or ""])))[1].tolist()):
            count[v] = count.get(v, 0) + 1
    n = len(copies)
    assert got.n_docs == n
    assert dict(zip(got.values.tolist(), got.counts.tolist(), strict=True)) == {v: k for v, k in count.items() if k + 1 > (n + 1) / ceiling}
    value = np.array([*count], np.uint64)
    want = [1 + np.log(min((n + 1) / (k + 1), ceiling)) for k in count.values()]
    assert got.inverse(value) == pytest.approx(np.array(want, np.float32))


def test_large_groups_of_near_copies(spark, monkeypatch):
    """Two groups in one band with a bridge between them and texts of no group, over many blocks."""
    monkeypatch.setattr(near_duplicates, "BLOCK", 4)
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(900)]
    base = [rng.choice(words) for _ in range(200)]
    far = [*base[:150], *[rng.choice(words) for _ in range(50)]]
    rows = []
    for k in range(60):
        own = list(base if k % 2 else far)
        own[rng.randrange(150)] = rng.choice(words)
        rows.append((k, " ".join(own), "en", "a"))
    rows += [(100 + k, " ".join([*base[:120], *[rng.choice(words) for _ in range(80)]]), "en", "a") for k in range(12)]
    docs = documents(spark, rows)
    idf = near_duplicates.frequencies(docs)
    got = sorted((r["doc_id"], r["class_id"]) for r in near_duplicates.query(docs).collect())
    assert got == brute_classes([r[:2] for r in rows], idf, 0.8)
    members = spark.createDataFrame([(1, str(k), k) for k in range(60)] , "meeting long, copy string, h long").withColumn("n", F.lit(60).cast("long"))
    one = members.select("copy", F.lit("0").alias("root"))
    assert near_duplicates._between_blocks(members, one).count() == 0
    two = members.select("copy", F.when(F.col("h") < 58, "0").otherwise(F.col("copy")).alias("root"))
    pairs = near_duplicates._between_blocks(members, two).collect()
    together = {}
    for r in pairs:
        together.setdefault((r["i"], r["j"]), set()).add(int(r["copy"]))
    assert all(any({a, b} <= t for t in together.values()) for a in range(60) for b in (58, 59) if a != b)
    assert len(pairs) < 60 * 3  # about a row a text


def test_recall_on_a_driver_table(spark):
    """Every link of the documents whose id is divisible by 100, by brute force over all rows, is within a class."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    idf = near_duplicates.frequencies(docs)
    rows = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    _, value, times, own = (np.concatenate(x) for x in zip(*[(a + k, *more) for k in range(0, len(rows), 500) for a, *more in [near_duplicates.weighted(pa.array([t for _, t in rows[k : k + 500]]), idf)]], strict=True))
    at = np.cumsum([0, *[len(near_duplicates.weighted(pa.array([t]), idf)[1]) for _, t in rows]])
    weight = times * own
    total = np.add.reduceat(np.append(weight, 0), at[:-1]) * (np.diff(at) > 0)
    row = np.repeat(np.arange(len(rows)), np.diff(at))
    links = []
    for q in [k for k, (i, _) in enumerate(rows) if i % 100 == 0]:
        mine = dict(zip(value[at[q] : at[q + 1]].tolist(), weight[at[q] : at[q + 1]].tolist(), strict=True))
        keys = np.array(sorted(mine), np.uint64)
        hit = np.isin(value, keys)
        low = np.bincount(row[hit], weights=np.minimum(weight[hit], [mine[v] for v in value[hit].tolist()]), minlength=len(rows))
        near = np.flatnonzero(low >= 0.8 * (total + total[q] - low) * (1 - 1e-6))
        links += [(rows[q][0], rows[k][0]) for k in near.tolist() if k != q and total[k] > 0]
    root = {r["doc_id"]: r["class_root"] for r in near_duplicates.query(docs).collect()}
    assert len(links) >= 20
    assert np.mean([root[a] == root[b] for a, b in links]) >= 0.99


def test_similar_pairs_span_all_links():
    v = np.arange(10, dtype=np.uint64)
    one = np.ones(10, np.int64)
    texts = [(v + np.uint64(k), one, np.ones(10, np.float32)) for k in range(6)]
    assert near_duplicates.similar_pairs(texts, 9 / 11) == [(k, k + 1) for k in range(5)]
    assert near_duplicates.similar_pairs(texts, 0.9) == []


def test_consistent_samples_estimate_weighted_similarity():
    rng = np.random.default_rng(4)
    value = tk.mix(np.arange(400, dtype=np.uint64))
    a, b = rng.random(400) + 0.1, rng.random(400) + 0.1
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    row = np.repeat([0, 1], 400)
    sig = [near_duplicates.signatures(row, np.concatenate([np.sort(value + np.uint64(k * 7919))] * 2), np.concatenate([a, b]), 2) for k in range(30)]
    assert abs(np.mean([(s[0] == s[1]).mean() for s in sig]) - true) < 0.04


def test_near_duplicates_of_odd_rows(odd, empty):
    got = plain(near_duplicates.query(odd))
    assert len(got) == odd.count()
    by = {r["doc_id"]: r["class_id"] for r in got}
    assert by[1] == by[2] == 1
    assert by[3] == by[4] == by[5] == 3
    assert by[7] == 7
    kept = near_duplicates.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [-3, 1, 3, 6, 7, 9, 12]
    assert near_duplicates.query(empty).count() == near_duplicates.keep_one(empty).count() == 0


def test_near_duplicates_of_null_and_reused_ids(spark):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(500)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    near = text(300)
    alone, others = [text(60), text(60)], [text(60), text(60)]
    nulls = [*alone, near, near + " end", near + " other", near]
    docs = documents(spark, [(None, t, "en", "a") for t in nulls] + [(5, t, "en", "a") for t in others])
    got = near_duplicates.query(docs).collect()
    assert sorted(r["class_size"] for r in got) == [1, 1, 1, 1, 4, 4, 4, 4]
    assert len({r["class_root"] for r in got}) == 5
    kept = [(r["doc_id"], r["text"]) for r in near_duplicates.keep_one(docs).collect()]
    assert len(kept) == 5
    assert {t for i, t in kept if i is None} >= set(alone) and len([t for i, t in kept if i is None and t.startswith(near)]) == 1
    assert sorted(t for i, t in kept if i == 5) == sorted(others)


# repeated passages


def brute_repeats(rows):
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 1, np.int64)
        for p in range(len(raw) - 99):
            w = raw[p : p + 100]
            if w in seen:
                gone[p] += 1
                gone[p + 100] -= 1
            seen.add(w)
        mask = np.cumsum(gone)[: len(raw)] > 0
        kept = np.frombuffer(raw, np.uint8)[~mask].tobytes()
        out[i] = (len(raw), int(mask.sum()), int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize(("hot", "level"), [(4096, 1024), (1, 1024), (4096, 3), (2, 1)])
@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_equal_brute_force(spark, seed, hot, level):
    rng = random.Random(seed)
    letters = "abé \n" if seed == 1 else "abcdefghijklmnop "
    passages = ["".join(rng.choice(letters) for _ in range(rng.randint(60, 400))) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [rng.choice(passages)[rng.randint(0, 30) :] if rng.random() < 0.6 else "".join(rng.choice(letters) for _ in range(rng.randint(0, 200))) for _ in range(rng.randint(0, 5))]
        rows.append((i, "".join(parts), "en", "a"))
    rows += [(100, "z" * 5000, "en", "a"), (101, "ab" * 300, "en", "a"), (102, None, "en", "a"), (103, "q" * 100, "en", "a"), (104, "q" * 99, "en", "a"), (105, "q" * 101, "en", "a")]
    docs = documents(spark, rows).repartition(5)
    got = repeats.removal(docs.select("doc_id", "text"), False, hot, level).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert {r[0]: tuple(r)[1:] for r in got} == brute_repeats([r[:2] for r in rows])


def test_dictionary_suffixes_are_sorted():
    rng = random.Random(1)
    strings = ["".join(rng.choice("ab") for _ in range(100 + rng.randint(0, 20))).encode() for _ in range(10)]
    strings += [b"y" * 130, b"x" * 115, strings[3]]
    data, size = np.frombuffer(b"".join(strings), np.uint8), np.array([len(x) for x in strings])
    string, offset, rank = repeats.dictionary_suffixes(data, np.cumsum(size) - size, size - 99)
    suffixes = [strings[i][k : k + 100] for i, k in zip(string.tolist(), offset.tolist(), strict=True)]
    assert suffixes == sorted(x[k : k + 100] for x in strings for k in range(len(x) - 99))
    assert rank.tolist() == [sorted(set(suffixes)).index(x) for x in suffixes]


def test_phrases_are_named_by_their_bytes():
    one, two = mirrored(10)
    data = np.frombuffer((one + two + one).encode(), np.uint8)
    high, low = repeats.name_phrases(data, np.array([0, 1024, 2048]), np.array([1024, 2048, 3072]))
    want = [hashlib.sha256(x.encode()).digest()[:12] for x in (one, two, one)]
    assert [int(h).to_bytes(8, "little") + int(x).to_bytes(4, "little") for h, x in zip(high, low, strict=True)] == want


@pytest.mark.parametrize(("parts", "level"), [(1, 4), (4, 4), (5, 4), (100, 4), (102, 1024)])
def test_dealing_reaches_every_part_by_its_group(parts, level):
    dealing = repeats.Dealing.of(parts, level)
    keys = tk.mix(np.arange(5000, dtype=np.uint64))
    part, first = dealing.part(keys), dealing.first(keys)
    assert dealing.parts >= parts and dealing.groups <= level and set(part.tolist()) == set(range(dealing.parts))
    assert (first // dealing.each == part // dealing.each).all() and len(set(first.tolist())) == dealing.groups


@pytest.mark.parametrize("spread", [1, 32])
@pytest.mark.parametrize("hot", [2, 3])
def test_trigger_with_a_hot_and_a_small_side(spark, hot, spread):
    """Many texts share what precedes a core, and two share what follows it, of which one is of the many."""
    rng = random.Random(5)
    some = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    rows = []
    for _ in range(30):
        before, core, after = some(80), some(60), some(80)
        texts = [before + core + some(80) for _ in range(6)] + [before + core + after, some(80) + core + after]
        rows += [(len(rows) + k, x, "en", "a") for k, x in enumerate(rng.sample(texts, len(texts)))]
    docs = documents(spark, rows).repartition(spread, "doc_id")
    got = repeats.removal(docs.select("doc_id", "text"), False, hot).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert {r[0]: tuple(r)[1:] for r in got} == brute_repeats([r[:2] for r in rows])


def test_hot_windows_are_sent_once_a_task():
    """What a task sends of an edge that many texts share doesn't grow with the texts."""
    rng = random.Random(6)
    some = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    passage = some(300)
    texts = [some(120) + passage + some(120) for _ in range(200)]
    rows = pa.RecordBatch.from_pydict({"doc": pa.array(range(200), pa.int64()), "tie": pa.array([0] * 200, pa.int32()), "text": texts})
    out = [r for b in repeats._parse_task(repeats.Dealing.of(1), 8, 8)([rows]) for r in b.to_pylist()]
    for kind in (repeats.TO_PHRASES, repeats.TO_SIDES):
        phrases = repeats.gather(repeats.PHRASES, [r["payload"] for r in out if r["kind"] == kind])
        assert max(repeats._counts(phrases["key"][~repeats._is_mark(phrases)])) <= 8
    notes = repeats.gather(repeats.NOTES, [r["payload"] for r in out if r["kind"] == repeats.TO_TEXTS])
    strings = []
    for k, x in enumerate(texts):
        asked = repeats.take(notes, np.flatnonzero((notes["doc"] == k) & (notes["kind"] == 2)))
        strings.append(repeats._strings(x.encode(), asked))
    sent = [r for b in repeats._send(strings, pa.int64(), repeats.Dealing.of(4)) for r in b.to_pylist()]
    windows = []
    for r in sent:
        if r["kind"] == repeats.STRING:
            c, data = repeats.unpack(repeats.STRINGS, r["payload"])
            assert not c["more"].any()
            windows += [w.tobytes() for w in data.reshape(-1, repeats.LENGTH)]
    assert windows and len(windows) == len(set(windows))
    held = {(k, a): raw[100 * i : 100 * i + 100] for k, (c, raw) in enumerate(strings) for i, a in enumerate(c["at"].tolist())}
    later = repeats.gather(repeats.NOTES, [r["payload"] for r in sent if r["kind"] == repeats.NOTE])
    earliest = {}
    for (k, a), w in sorted(held.items()):
        earliest.setdefault(w, (k, a))
    assert set(zip(later["doc"].tolist(), later["start"].tolist(), strict=True)) == set(held) - set(earliest.values())


LINE = "This line of sixty-four bytes stands between text of their own!!"


def framed(n, some):
    """Texts that share one short line and nothing beside it, but for a few that share one side or both."""
    texts = [some(90) + LINE + some(90) for _ in range(n)]
    for k in range(0, n - 3, 50):
        texts[k + 1] = texts[k][:90] + LINE + some(90)
        texts[k + 2] = some(90) + LINE + texts[k][-90:]
    return texts


@pytest.mark.parametrize(("hot", "spread"), [(4, 3), (4, 64), (4096, 3)])
def test_trigger_with_many_sides(spark, hot, spread):
    rng = random.Random(8)
    some = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    rows = [(k, x, "en", "a") for k, x in enumerate(framed(400, some))]
    docs = documents(spark, rows).repartition(spread, "doc_id")
    got = repeats.removal(docs.select("doc_id", "text"), False, hot).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert {r[0]: tuple(r)[1:] for r in got} == brute_repeats([r[:2] for r in rows])


def test_trigger_with_many_sides_is_dealt_by_side():
    """Of ten thousand texts with one line, no key has more than a few rows at any step."""
    rng = random.Random(9)
    some = lambda n: "".join(chr(rng.randint(33, 122)) for _ in range(n))
    texts, dealing = framed(10_000, some), repeats.Dealing.of(8)
    lots = [pa.RecordBatch.from_pydict({"doc": pa.array(range(a, a + 500), pa.int64()), "tie": pa.array([0] * 500, pa.int32()), "text": texts[a : a + 500]}) for a in range(0, 10_000, 500)]

    def met(task, batches):
        rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: r["part"])
        return list(task([pa.RecordBatch.from_pylist(rows, schema=repeats.PACKED)]))

    def most(batches, kind):
        c = repeats.gather(repeats.PHRASES, [r["payload"] for b in batches for r in b.to_pylist() if r["kind"] == kind])
        return max(repeats._counts(c["key"])[~repeats._is_mark(c)])

    parsed = [b for x in lots for b in repeats._parse_task(dealing, 20, 20)([x])]
    assert most(parsed, repeats.TO_PHRASES) <= 400
    sides = met(repeats._meet_task(dealing, 400, repeats.TO_SIDES), parsed)
    assert most(sides, repeats.TO_SIDES) <= 20
    batches = [*met(repeats._sides_task(dealing, 400), sides), *met(repeats._meet_task(dealing, 400, repeats.TO_TEXTS), parsed)]
    notes = repeats.gather(repeats.NOTES, [r["payload"] for b in batches for r in b.to_pylist()])
    asked = notes["kind"] != repeats.REPEATED
    assert set(notes["kind"][asked].tolist()) <= {repeats.BY_TRIGGER, repeats.BY_LEFT, repeats.BY_RIGHT}
    strings = [repeats._strings(texts[k].encode(), repeats.take(notes, np.flatnonzero((notes["doc"] == k) & asked))) for k in sorted(set(notes["doc"][asked].tolist()))]
    assert max(repeats._counts(np.concatenate([c["key"] for c, _ in strings]))) <= 400


def test_strings_in_turn(monkeypatch):
    rng = np.random.default_rng(3)
    payloads, want = [], []
    for _ in range(4):
        n = 200
        c = {"key": rng.integers(0, 9, n).astype(np.uint64), "doc": rng.integers(0, 9, n), "tie": np.zeros(n, np.int64), "at": np.arange(n), "more": rng.integers(0, 60, n)}
        bodies = [rng.integers(0, 256, int(m) + 100).astype(np.uint8).tobytes() for m in c["more"]]
        payloads.append(repeats.pack(repeats.STRINGS, c, b"".join(bodies)))
        want += list(zip(c["key"].tolist(), bodies, strict=True))
    for opened in (1, 20_000, 1 << 30):
        monkeypatch.setattr(repeats, "OPENED", opened)
        turns = list(repeats._in_turn(payloads))
        got = [(int(k), data[a : a + m + 100].tobytes()) for c, data, begin in turns for k, a, m in zip(c["key"], begin, c["more"].astype(int), strict=True)]
        assert sorted(got) == sorted(want)
        keys = [set(c["key"].tolist()) for c, _, _ in turns]
        assert sum(map(len, keys)) == len(set().union(*keys))  # a key is whole in one turn


def test_removal_keeps_columns_and_rows(odd, empty):
    got = repeats.remove(odd)
    assert got.columns == odd.columns
    by = {r["doc_id"]: r for r in got.collect()}
    assert got.count() == odd.count()
    assert by[4]["text"] == "" and by[3]["text"] != "" and by[7]["text"] == "x"
    assert by[4]["payload"] == "p" and by[4]["row"] == "r"
    assert repeats.query(empty).count() == 0


# mixing


def test_targets_are_capped_and_reshared():
    got = mixing.targets([("a", 10), ("b", 1000), (None, 90), ("c", 0)])
    assert got["a"] == 30 and got["c"] == 0
    assert got["b"] + got[None] == pytest.approx(1070)
    assert sum(got.values()) == pytest.approx(1100)
    assert mixing.targets([]) == {}


def test_mix_comes_near_its_targets(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("doc_id") % 4).cast("string"))))
    rows = docs.select("doc_id", "source").collect()
    source = {r["doc_id"]: r["source"] for r in rows}
    got = plain(mixing.query(docs))
    size = {r["doc_id"]: len(r["text"].split()) for r in docs.collect()}
    assert {r["doc_id"]: r["size"] for r in got} == size
    for s in set(source.values()):
        own = [r for r in got if source[r["doc_id"]] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)
        assert {r["source_size"] for r in own} == {sum(r["size"] for r in own)}
    assert all(r["taken"] <= 3 * r["size"] for r in got)
    assert sum(r["taken"] for r in got) <= sum(size.values())
    assert sorted(map(str, plain(mixing.query(docs.repartition(7))))) == sorted(map(str, got))
    assert mixing.mix(docs).count() == sum(r["taken"] // r["size"] for r in got if r["size"])


def test_mix_of_odd_rows(odd, empty):
    assert mixing.query(odd).count() == odd.count()
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns
    taken = sum(r["taken"] // r["size"] for r in plain(mixing.query(odd)) if r["size"])
    assert mixed.count() == taken
    assert mixing.query(empty).count() == mixing.mix(empty).count() == 0


# language, toxicity, quality


def test_language_is_predicted(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    joined = language_id.query(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in joined if r["held_out"]]
    assert held and np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.95
    assert {r["doc_id"] for r in held} == {r["doc_id"] for r in joined if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2}


def tree_bits(texts, text):
    """Bits of a text, byte by byte, under a context tree of some texts."""
    grams = {}
    for t in texts:
        for n in range(4):
            for i in range(n, len(t)):
                seen = grams.setdefault(t[i - n : i], {})
                seen[t[i]] = seen.get(t[i], 0) + 1
    bits = 0.0
    for i, s in enumerate(text):
        context = (b"   " + text[:i])[-3:]
        while True:
            if seen := grams.get(context):
                total = sum(seen.values()) + len(seen)
                if s in seen:
                    bits -= np.log2(seen[s] / total)
                    break
                bits -= np.log2(len(seen) / total)
            if not context:
                bits += 8
                break
            context = context[1:]
    return bits


@pytest.mark.parametrize("n_languages", [2, 11])
def test_code_lengths_are_those_of_the_tree(spark, monkeypatch, n_languages):
    rng = random.Random(4)
    learned = {}
    for k in range(n_languages):
        letters = rng.sample("abcdefghijklmnopqrstuvwxyzéßñ世界 ", 9) + [" "]
        learned[f"l{k:02}"] = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 400))) for _ in range(12)]
    rows = [(i, t, lang, "s") for i, (lang, t) in enumerate((lang, t) for lang, ts in learned.items() for t in ts)]
    model = language_id.fit(documents(spark, rows), F.lit(True), cells=1 << 20)
    assert model.languages == sorted(learned)
    texts = ["abad cz", "", "q", "\u0416\u0436 unseen \x01", *[t for ts in learned.values() for t in ts[:3]], "ab 12 AB " * 50]
    monkeypatch.setattr(language_id, "HELD", 1000)  # texts are longer than what is held at once
    got = language_id.code_lengths(model, *tk.buffers(pa.array(texts)))
    fold = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", b"abcdefghijklmnopqrstuvwxyz000000000")
    for k, lang in enumerate(model.languages):
        want = [tree_bits([t.encode().translate(fold) for t in learned[lang]], x.encode().translate(fold)) for x in texts]
        assert got[:, k] == pytest.approx(want, abs=1e-6)


def test_language_sample_is_bounded(spark):
    same = [(None, f"text number {k % 700} without id", "en", "s") for k in range(3000)] + [(7, "one text again", "en", "s")] * 500
    got = language_id._sample(documents(spark, same), F.lit(True), 512, 4).collect()
    assert 300 < len(got) <= 512 and len({r["text"] for r in got}) == len(got)
    many = documents(spark, [(k, "text", f"l{k}", "s") for k in range(9)])
    with pytest.raises(ValueError, match="most_languages"):
        language_id.fit(many, F.lit(True), most_languages=8)
    with pytest.raises(ValueError, match="most_bytes"):
        language_id.fit(many, F.lit(True), most_bytes=10)


def test_gate_refuses_texts_of_no_learned_language(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    rng = random.Random(2)
    other = ["".join(chr(rng.randint(0x10A0, 0x10FF)) for _ in range(200)) for _ in range(5)]
    more = spark.createDataFrame([(10_000 + k, t, None) for k, t in enumerate(other)], docs.schema)
    kept = {r["doc_id"] for r in language_id.gate(docs.union(more)).collect()}
    assert not kept & set(range(10_000, 10_005)) and len(kept) > 0.98 * docs.count()


def test_language_of_odd_rows(odd, empty):
    by = {r["doc_id"]: r for r in plain(language_id.query(odd))}
    assert by[1]["lang_pred"] == by[2]["lang_pred"] == by[12]["lang_pred"] == "und"
    assert by[6]["lang_pred"] in ("en", "fr")
    kept = language_id.gate(odd)
    assert kept.columns == odd.columns
    assert not {1, 2, 12} & {r["doc_id"] for r in kept.collect()}
    assert language_id.query(empty).count() == language_id.gate(empty).count() == 0


def held_out_of(rows):
    return [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = toxicity.query(docs, labels).join(labels, "doc_id").collect()
    assert [r["held_out"] for r in rows] == [zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows]
    held = held_out_of(rows)
    assert np.mean([r["predicted"] == r["toxic"] for r in held]) > 0.93
    assert np.mean([a["score"] > b["score"] for a in held if a["toxic"] for b in held if not b["toxic"]]) > 0.9


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.query(docs, labels).join(labels, "doc_id").collect()
    held = held_out_of(rows)
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.93


def test_compiled_rules_are_the_model(spark):
    model = quality.RuleModel(0.5, [((("n_words", 2.0, float("inf")),), 1.5), ((("upper", -float("inf"), 0.1), ("n_words", -float("inf"), 2.0)), -2.0)])
    docs = documents(spark, [(1, "a b c", "en", "s"), (2, "a b", "en", "s"), (3, "A B", "en", "s")])
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    want = {1: 2.0, 2: -1.5, 3: 0.5}
    assert got == {k: pytest.approx(1 / (1 + np.exp(-x))) for k, x in want.items()}


def test_tree_rules():
    text = "DecisionTree...\n  If (feature 0 <= 2.5)\n   If (feature 3 > 0.5)\n    Predict: 0.0\n   Else (feature 3 <= 0.5)\n    Predict: 1.0\n  Else (feature 0 > 2.5)\n   Predict: 1.0\n"
    inf = float("inf")
    assert quality.tree_rules(text) == {(("n_bytes", -inf, 2.5),), (("n_bytes", -inf, 2.5), ("upper", 0.5, inf)), (("n_bytes", -inf, 2.5), ("upper", -inf, 0.5)), (("n_bytes", 2.5, inf),)}


def test_statistics():
    got = quality.statistics(*tk.buffers(pa.array(["Ab cd\nAb cd\n", "", "x"])))
    assert got["n_words"].tolist() == [4, 0, 1]
    assert got["same_words"].tolist() == [0.5, 0, 0]
    assert got["same_lines"].tolist() == [0.5, 0, 0]
    assert got["upper"].tolist() == [2 / 12, 0, 0]


@pytest.mark.parametrize("operator", [toxicity, quality])
def test_classifiers_of_odd_rows(spark, odd, empty, operator):
    column = "toxic" if operator is toxicity else "quality"
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in (1, 2, 3, 4, 5, 6, 7, 9, 99)] + [(None, 1, 1)], "doc_id long, toxic int, quality int")
    got = plain(operator.query(odd, labels))
    assert len(got) == odd.count()
    assert all(0 <= r["score"] <= 1 for r in got)
    one_class = operator.query(odd, labels.where(f"{column} = 1"))
    assert {r["predicted"] for r in one_class.collect()} == {1}
    assert operator.query(odd, labels.where("false")).count() == odd.count()
    assert operator.query(empty, labels).count() == 0
