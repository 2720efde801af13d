"""The operators on text against brute force, round trips, held-out labels and odd rows."""

import hashlib
import os
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factorloom.llm import chat, credentials, exact, jaccard, language, mixing, phrase_index, queries, sequences, substring, text, toxicity
from factorloom.session import shared_dir

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
given = pytest.mark.skipif(not Path(DATA).is_dir(), reason="the given tables are not here")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and very long texts, ties, repeated rows, and columns whose names clash."""
    rows = [
        (1, "One two  three\tfour five six", "en", "a", 1),
        (2, "one two three four five six", "en", "a", 1),
        (2, "one two three four five six", "en", "a", 1),
        (None, "One two three four five six", None, None, None),
        (3, None, None, None, None),
        (4, "", "en", "b", 0),
        (5, " \n\t ", None, "b", 0),
        (6, LONG, "en", "c", 9),
        (7, LONG, "en", None, 9),
        (8, "élan ÉTÉ 日本語 1234", "fr", "c", 3),
        (9, "12 34 !!", "fr", "c", 3),
    ]
    clash = ["row", "kept", "size", "copies", "score", "node", "key", "root", "start", "term"]
    return spark.createDataFrame(rows, DOCS).select("*", *[F.lit("x").alias(c) for c in clash])


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def given_texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def shingle_set(t, width=5):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
    return {tuple(w[k : k + width]) for k in range(max(len(w) - width + 1, min(len(w), 1)))}


def test_words_and_shingles():
    texts = ["A b\tC", None, "", "é ß  x1", "a b c d e f g"]
    ((_, _, data, offsets),) = text.slices(pa.array(texts))
    data, starts, ends, rows = text.words(data, offsets, text.NOT_SPACE)
    found = [data[a:b].tobytes().decode() for a, b in zip(starts, ends)]
    assert found == ["a", "b", "c", "é", "ß", "x1", *"abcdefg"]
    assert rows.tolist() == [0, 3, 3, 3, 6, 13]
    hashes = text.word_hashes(data, starts, ends)
    assert hashes[0] == hashes[6] and len(set(hashes.tolist())) == 10
    assert [len(s) for _, s in text.shingle_rows(pa.array(texts), 5)] == [1, 0, 0, 1, 3]


def test_exact(spark, odd, empty):
    rows = exact.dedup_exact(odd).collect()
    assert len(rows) == odd.count() and exact.dedup_exact(empty).count() == 0
    texts = defaultdict(list)
    for r in rows:
        texts[r["text_sha256"]].append(r)
    for found in texts.values():
        ids = [r["doc_id"] for r in found if r["doc_id"] is not None]
        assert {r["keep_id"] for r in found} == {min(ids, default=None)}
        assert sum(r["kept"] for r in found) == 1 and {r["group_size"] for r in found} == {len(found)}
    assert hashlib.sha256(b" ").hexdigest() in texts


def test_exact_heavy(spark):
    df = spark.range(0, 2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    hot = exact.dedup_exact(df).where("group_size > 1").agg(F.count("*"), F.min("keep_id"), F.max("keep_id"), F.sum(F.col("kept").cast("int"))).first()
    assert tuple(hot) == (667, 0, 0, 1)


def test_mixing(spark, odd, empty):
    mixed = mixing.mix(odd)
    rows = mixed.collect()
    assert len(rows) == odd.count() and mixing.mix(empty).count() == 0
    for r in rows:
        assert r["size"] == len((r["row"]["text"] or "").split()) and r["taken"] == r["size"] * r["copies"] <= 2 * r["size"]
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(odd).collect()))
    assert mixing.emit(mixed).columns == odd.columns
    assert mixing.emit(mixed).count() == sum(r["copies"] for r in rows)


def test_mixing_targets(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 1000), ("c", 10), (None, 0)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    # 1.5 * 1110 = 1665; a (weight 3) and c (2) stop at twice their size, b takes the rest.
    assert got == {"a": 200.0, "c": 20.0, "b": 1445.0, None: 0.0}


def test_sequences(spark, odd, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    path = str(tmp_path / "shards")
    manifest = sequences.write_sequences(odd, path, vocabulary, length=16, rows=4)
    got = sequences.read_documents(manifest, path).orderBy("start").collect()
    plain = Tokenizer.from_file(vocabulary)
    rows = sorted(odd.select("doc_id", "text").collect(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start = 0
    for r, (doc_id, t) in zip(got, rows, strict=True):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (doc_id, start, len(ids), crc)
        start += len(ids)
    shard = sequences.Shard(path, manifest.where("tokens > 16").first()["file"])
    ids, valid, ends = shard[0]
    assert len(ids) == len(valid) == len(ends) == 16 and valid.to_pylist() == [True] * 16


def test_sequences_empty(spark, empty, tmp_path):
    import public_tokenizers

    assert sequences.tokenized(empty, public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_encoder_agrees():
    import public_tokenizers

    odd = ["", "Don't 'saw a's", "a\x1cb c\x85d", "<|endoftext|> x", "ΑΣ ΣΑΣ. İstanbul ½²", "naïve—text\t\r\nnew", "日本語。", "l'é.'t é.", "a.b. a..'s"]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        encode = sequences.Encoder(public_tokenizers.path(name))
        for t, ids in zip(odd, encode(pa.array(odd)), strict=True):
            assert ids.tolist() == encode.full.encode(t, add_special_tokens=False).ids


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "<\\/s> [\\\\INST]", "a [/INST]\n[OUT] b </s>\n", "", "[TURN x] \\", None]
    rows = [(c, t, role, x) for c in (1, None) for t, x in enumerate(nasty) for role in ("user", "assistant", "to]ol %", None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(turns)).collect()}
    for conv in (1, None):
        own = sorted([(t, r or "", x or "") for c, t, r, x in rows if c == conv])
        want = "".join(f"{r}\n{x}\n" for _, r, x in own)
        loss = "".join(x for _, r, x in own if r == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"]) == (24, hashlib.sha256(want.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.format_turns(turns.limit(0))).count() == 0
    assert chat.format_turn("user", "plain text")[0] == "[INST] plain text [/INST]\n"


def test_credentials(spark, odd, empty):
    near = "aws AKIAABCDEFGHIJ1234 then api-key: 'x' https://host.example/path ok password = \"abcdefghijkl\""
    far = "see https://host.example/path" + " word" * 200 + " token=abcdefghijklmnop"
    alone = "only https://host.example/path here"
    rows = [(1, near), (2, far), (3, alone), (4, "secret: token: abcdefghijklmnop deadbeefdeadbeef00"), (5, None)]
    got = by_id(credentials.scan(spark.createDataFrame(rows, "doc_id long, text string")))
    assert (got[1]["n_assign"], got[1]["n_access"], got[1]["n_hex"]) == (1, 1, 0)
    assert "endpoint" in got[1]["spans"] and "endpoint" not in got[2]["spans"] and got[3]["spans"] == ""
    assert got[4]["n_assign"] == 0 and got[4]["n_hex"] == 1  # the short match takes its words
    assert got[5]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert credentials.scan(odd).count() == odd.count() and credentials.scan(empty).count() == 0


def test_credentials_long(spark):
    """Keys and identifiers of any length beside a complement; alone they stay clean."""
    key = "aB3/" * 21 + "xY=="
    name = "ABCD" + "E1F2" * 12
    rows = [(1, f"https://host.example/x {key}"), (2, f"plain {key} text"), (3, f"{name} {key}"), (4, f"plain {name} text")]
    got = by_id(credentials.scan(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got[1]["spans"] == "endpoint:0:22,secret:23:109" and got[3]["spans"] == "id:0:52,secret:53:139"
    assert got[2]["spans"] == got[4]["spans"] == ""


def words_of(t):
    raw = bytes(b if (48 <= b < 58 or 97 <= b < 123 or b > 127) else 32 for b in (t or "").encode().lower())
    return raw.split()


def test_decontaminate(spark, odd, empty):
    benchmark = spark.createDataFrame([(1, LONG[:400]), (2, "Three, four FIVE"), (3, None), (4, "1234")], "item_id long, text string")
    got = phrase_index.decontaminate(odd, benchmark).collect()
    assert len(got) == odd.count() and phrase_index.decontaminate(empty, benchmark).count() == 0
    want = Counter()
    items = {str(r["item_id"]): words_of(r["text"]) for r in benchmark.collect()}
    for r in odd.select("doc_id", "text").collect():
        w, hit, names = words_of(r["text"]), set(), set()
        for name, own in items.items():
            m = min(13, len(own))
            windows = {tuple(own[k : k + m]) for k in range(len(own) - m + 1)} if m else set()
            for k in range(len(w) - m + 1):
                if tuple(w[k : k + m]) in windows:
                    hit |= set(range(k, k + m))
                    names.add(name)
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        want[r["doc_id"], len(w), len(hit), digest, bool(hit) and 20 * len(hit) >= len(w)] += 1
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], r["items_sha256"], r["contaminated"]) for r in got) == want
    assert phrase_index.decontaminate(odd, benchmark.limit(0)).where("n_hit > 0").count() == 0


def linked(sets):
    """Smallest id reachable by links, by comparing all pairs."""
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def test_jaccard_groups(spark):
    """Near copies of one text, more than make its tokens frequent, short texts, and a shared passage."""
    rng = np.random.RandomState(1)
    base = [f"b{i}" for i in range(120)]
    texts = {}
    for i in range(60):
        words = list(base)
        for k in rng.choice(120, rng.randint(0, 5), replace=False):
            words[k] = f"e{i}_{k}"
        texts[i] = " ".join(words)
    for i in range(60, 110):
        texts[i] = " ".join([*base[:80], *[f"o{i}_{k}" for k in range(rng.randint(2, 30))]])
    for i in range(110, 150):
        texts[i] = " ".join(base[i % 7 : i % 7 + rng.randint(1, 26)])
    got = by_id(jaccard.jaccard_join(spark.createDataFrame(list(texts.items()), "doc_id long, text string")))
    sets = {i: shingle_set(t) for i, t in texts.items()}
    assert {i: r["component_id"] for i, r in got.items()} == linked(sets)
    assert all(got[i]["n_shingles"] == len(s) for i, s in sets.items())


def test_jaccard_near_misses(spark, monkeypatch):
    """Copies of one text with so many edits that few link: pairs that cannot link make no rows."""
    rng = np.random.RandomState(2)
    base = [f"b{i}" for i in range(150)]
    texts = {}
    for i in range(150):
        words = list(base)
        for k in rng.choice(150, rng.randint(2, 9), replace=False):
            words[k] = f"e{i}_{k}"
        texts[i] = " ".join(words)
    compared, links = [], []

    def verify(pairs, whole, real=jaccard.verify):
        found = real(pairs, whole)
        compared.append(pairs.count())
        links.append(found.count())
        return found

    monkeypatch.setattr(jaccard, "verify", verify)
    got = by_id(jaccard.jaccard_join(spark.createDataFrame(list(texts.items()), "doc_id long, text string")))
    assert {i: r["component_id"] for i, r in got.items()} == linked({i: shingle_set(t) for i, t in texts.items()})
    # Without bitmaps 1,748 pairs are left after the first star, 33 of which link.
    assert sum(compared[1:]) <= 8 * sum(links[1:])


def test_bitmaps_bound():
    """Bitmaps of two sets never differ in more bits than the sets do in tokens."""
    rng = np.random.RandomState(4)
    for n in (1, 16, 100, 3000):
        tokens = rng.randint(0, 1 << 62, 2 * n).astype(np.uint64)
        for shared in (0, n // 2, n):
            a, b = tokens[:n], tokens[n - shared : 2 * n - shared]
            bits = np.unpackbits((jaccard.bitmap(a) ^ jaccard.bitmap(b)).view(np.uint8)).sum()
            assert bits <= 2 * (n - shared)
    assert len(jaccard.bitmap(tokens)) == jaccard.BITMAP


@given
def test_jaccard_given(spark):
    docs = given_texts(spark)
    got = by_id(queries.QUERIES["op8_jaccard_join"](spark, DATA))
    assert {i: r["component_id"] for i, r in got.items()} == linked({i: shingle_set(t) for i, t in docs.items()})


def test_jaccard_odd(spark, odd, empty):
    rows = jaccard.jaccard_join(odd).collect()
    assert len(rows) == odd.count() and jaccard.jaccard_join(empty).count() == 0
    assert {(r["doc_id"], r["component_id"]) for r in rows if r["doc_id"] in (None, 1, 2, 4, 6, 7)} == {(None, 1), (1, 1), (2, 1), (4, 4), (6, 6), (7, 6)}


def test_combinations_meet():
    """Sets that miss at most m tokens of each other index a common pair."""
    rng = np.random.RandomState(3)
    for n in (16, 21, 40, 100, 333):
        m = jaccard.misses(n)
        common = rng.randint(0, 1 << 62, n - m).astype(np.uint64)
        sides = [np.unique(np.concatenate([common, rng.randint(0, 1 << 62, m).astype(np.uint64)])) for _ in range(2)]
        keys = [set(jaccard.combinations(s, m, 0, n.bit_length() - 1).tolist()) for s in sides]
        assert keys[0] & keys[1]


def test_substring(spark, odd, empty):
    rng = np.random.RandomState(5)
    word = lambda: f"w{rng.randint(10**9)}"
    passage = [word() for _ in range(70)]
    texts = {i: [word() for _ in range(rng.randint(20, 90))] for i in range(40)}
    for i in range(20):
        edited = list(passage)
        if i >= 15:
            edited[35] = word()
        texts[i] = [*texts[i], *edited, *[word() for _ in range(30)]]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    rows = substring.repeated_passages(df).collect()
    assert {r["doc_a"] for r in rows} | {r["doc_b"] for r in rows} == set(range(20))
    exact_rows = [r for r in rows if max(r["doc_a"], r["doc_b"]) < 15]
    for r in exact_rows:
        assert texts[r["doc_a"]][r["a_start"] : r["a_stop"]] == passage == texts[r["doc_b"]][r["b_start"] : r["b_stop"]]
    assert all(r["similarity"] >= 0.75 for r in rows)
    assert {(r["doc_a"], r["doc_b"]) for r in substring.repeated_passages(odd).collect()} == {(6, 7)}
    assert substring.repeated_passages(empty).count() == 0


def test_substring_long_document(spark):
    """A document of many blocks with one line, each block shared with another document; partitions make no difference."""
    rng = np.random.RandomState(6)
    words = lambda n: [f"w{rng.randint(10**9)}" for _ in range(n)]
    line = words(38)
    shared = [[*words(6), *line, *words(8)] for _ in range(40)]
    texts = {i + 1: [*words(20), *p, *words(20)] for i, p in enumerate(shared)}
    texts[0] = [w for p in shared for w in [*words(60), *p]]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    one, many = (sorted(map(tuple, substring.repeated_passages(df.repartition(n)).collect())) for n in (1, 16))
    assert one == many
    for i, p in enumerate(shared):
        assert any(r[0] == 0 and r[3] == i + 1 and texts[0][r[1] : r[2]] == p == texts[i + 1][r[4] : r[5]] for r in one)


def test_substring_widespread_line(spark):
    """Pairs of documents share passages in which only few words lie outside a line that all hold."""
    rng = np.random.RandomState(9)
    words = lambda n: [f"w{rng.randint(10**9)}" for _ in range(n)]
    line, other = words(34), words(34)
    texts = {}
    for k in range(60):
        before = int(rng.randint(0, 17))
        passage = [*words(before), *line, *words(16 - before)]
        for i in (k, k + 100):  # never next to each other among the holders of the line
            texts[i] = [*words(30), *passage, *words(30)]
    # Each line is widespread and so is every part of the passage, the passage itself is not.
    for i in range(60, 100):
        texts[i] = [*words(30), *other, *words(30)]
    for i in (70, 1300):
        texts[i] = [*words(20), *line, *other, *words(20)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    grams = {i: {tuple(t[k : k + 50]) for k in range(len(t) - 49)} for i, t in texts.items()}
    want = {(a, b) for a in grams for b in grams if a < b and grams[a] & grams[b]}
    assert len(want) == 61
    rows = substring.repeated_passages(df).collect()
    assert {(r["doc_a"], r["doc_b"]) for r in rows if r["similarity"] == 1} >= want
    for a, b in want:
        held = {g for r in rows if (r["doc_a"], r["doc_b"]) == (a, b) for k in range(r["a_start"], r["a_stop"] - 49) for g in [tuple(texts[a][k : k + 50])]}
        assert grams[a] & grams[b] <= held


def test_substring_edited_around_a_widespread_line(spark):
    """F8: edited passages meet whatever number of documents holds the line in them."""
    rng = np.random.RandomState(11)
    words = lambda n: [f"w{rng.randint(10**9)}" for _ in range(n)]
    line, texts = words(34), {}
    for k in range(60):
        before = int(rng.randint(2, 20))
        passage = [*words(before), *line, *words(22 - before)]
        edited = list(passage)
        edited[0] = edited[before + 17] = "edited"
        texts[k], texts[k + 100] = ([*words(30), *p, *words(30)] for p in (passage, edited))
    texts[500] = list(texts[7])
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    found = {(r["doc_a"], r["doc_b"]) for r in substring.repeated_passages(df).collect()}
    assert found >= {(k, k + 100) for k in range(60)} | {(7, 500)}
    assert (107, 500) not in found


def test_widespread_passage_is_a_class(spark):
    """holders of a widespread passage are joined by a few rows each, edited ones too, and no link between classes is lost."""
    rng = np.random.RandomState(14)
    words = lambda n: [f"w{rng.randint(10**9)}" for _ in range(n)]
    passage, line, texts = words(70), words(30), {}
    for k in range(100):
        edited = list(passage)
        if k % 10 == 9:
            edited[int(rng.randint(5, 65))] = "edited"
        texts[k] = [*words(20), *edited, *words(20)]
    # A line too short for a passage, in texts of which every second pair shares more around it.
    for k in range(80):
        around = words(25)
        for i in (200 + k, 400 + k) if k % 2 else (200 + k,):
            texts[i] = [*words(20), *around, *line, *words(20)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    rows = substring.with_classes(substring.repeated_passages(df)).collect()
    of = {d: r["class_id"] for r in rows for d in (r["doc_a"], r["doc_b"])}
    assert [of.get(k) for k in range(100)] == [0] * 100
    assert {k: of.get(k) for k in range(200, 500) if k in of} == {i: 200 + k for k in range(1, 80, 2) for i in (200 + k, 400 + k)}
    assert sum(r["class_id"] == 0 for r in rows) < 10 * 100


def test_within_runs():
    common = np.array([0, 0, 0, 1, 1, 1, 0, 1, 1, 1, 0, 0, 0, 0, 0, 0, 1], bool)
    low, high = np.array([3, 0, 5, 9, 16, 3]), np.array([9, 4, 6, 14, 16, 16])
    # Three common tokens on either side bear with the one between them and one more outside.
    assert substring.within_runs(common, 7, low, high).tolist() == [True, False, True, False, False, False]
    assert not substring.within_runs(common, 9, low, high).any()


def test_every_pair_of_a_key():
    """F8: all documents of a key meet, or are named if there are too many for one task."""
    key = np.array([5] * 6 + [9] * 3, np.uint64)
    doc = np.array([4, 1, 2, 3, 5, 5, 1, 2, 3])
    span = np.array([[i, i + 50] for i in range(9)], np.int32)
    rows, held = substring.every(key, doc, span, 4)
    assert {(r[0], r[3]) for r in rows.tolist()} == {(1, 2), (1, 3), (2, 3)}
    assert sorted(map(tuple, held.tolist())) == [(5, d) for d in range(1, 6)]
    rows, held = substring.every(key, doc, span, 5)
    assert {(r[0], r[3]) for r in rows.tolist()} == {(a, b) for a in range(1, 6) for b in range(a + 1, 6)} and not len(held)
    assert {(1, 1, 51, 5, 4, 54), (1, 1, 51, 5, 5, 55)} <= set(map(tuple, rows.tolist()))


def test_blocks_meet_in_rounds(spark, monkeypatch):
    """op1's disk: blocks of a widespread key meet in rounds that send each text twice, and no pair is left out."""
    rng = np.random.RandomState(12)
    words = lambda n: [f"w{rng.randint(10**9)}" for _ in range(n)]
    passage, other = words(60), words(60)
    texts = {k: " ".join([*words(9), *(other if k % 5 == 4 else passage), *words(9)]) for k in range(30)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    held = spark.createDataFrame([(1 + k % 2 * (k > 20), k) for k in texts], "key long, doc_id long")
    keys = {k: 1 + k % 2 * (k > 20) for k in texts}
    tokens = {k: t.copy() for k, t in text.shingle_rows(pa.array(texts.values()), 5)}
    want = sorted(
        (a, s, t + 4, b, u, v + 4)
        for a in texts for b in texts if a < b and keys[a] == keys[b]
        for s, t, u, v, _ in substring.passages(tokens[a], tokens[b], 46, 0.75)
    )
    sent, write = [], substring.stored

    def stored(frame, name, keep=False):
        if name == "block_passages":
            sent.append(name)
        return write(frame, name, keep)

    monkeypatch.setattr(substring, "stored", stored)
    for block, rounds in ((30, 1), (10, 2), (8, 3), (4, 5)):
        monkeypatch.setattr(substring, "BLOCK", block)
        sent.clear()
        assert sorted(tuple(r)[:6] for r in substring.block_passages(df, held, 5, 46, 0.75).collect()) == want and want
        assert len(sent) == rounds


def test_arrays_of_a_slice_are_small():
    """pipeline's memory: a worker's arrays follow a slice of some hundred KB, not the batch."""
    column = pa.array([LONG[k : k + 50_000] for k in range(40)])
    model = language.Model(list("abcd"), language.codewords(4), [np.ones((language.BUCKETS, 7), np.float32)] * 3, np.ones(7))
    for work in (lambda: language.answers(column, model), lambda: [0 for _ in text.shingle_rows(column, 5)]):
        tracemalloc.start()
        work()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 32 << 20


def test_words_are_hashed_by_parts():
    """pipeline's memory: what a worker holds to hash words does not follow the slice, and hashes are the same."""
    column = pa.array([" ".join(f"w{k}" for k in range(600_000))])
    ((_, _, data, offsets),) = text.slices(column, 8 << 20)
    data, starts, ends, _ = text.words(data, offsets, text.ALNUM)
    tracemalloc.start()
    hashes = text.word_hashes(data, starts, ends)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24 << 20
    some = np.concatenate([[0], np.arange(32_760, 32_780), [599_999]])
    assert (hashes[some] == np.concatenate([text.word_hashes(data, starts[i : i + 1], ends[i : i + 1]) for i in some])).all()


def test_common_counts():
    rng = np.random.RandomState(13)
    a, b = ([rng.randint(0, 5000, rng.randint(1, 900)) for _ in range(9)] for _ in range(2))
    brute = lambda x, y: np.array([[np.isin(p, q).sum() for q in y] for p in x])
    assert (substring.common_counts(a, b) == brute(a, b)).all()
    apart = ~np.eye(9, dtype=bool)
    assert (substring.common_counts(a, a) == brute(a, a))[apart].all()
    assert not substring.common_counts([np.array([1])], [np.array([2])]).any()


def test_star_windows():
    """Every window of a document meets each window of the smallest, or the span around them."""
    key = np.array([5] * 9, np.uint64)
    doc = np.array([1, 1, 1, 2, 2, 3, 1, 1, 1])
    span = np.array([[0, 50], [100, 150], [110, 140], [7, 60], [70, 130], [0, 50], [200, 250], [300, 350], [400, 450]], np.int32)
    some = substring.star(key[:6], doc[:6], span[:6])
    want = {(1, *s, d, *t) for s in ((0, 50), (100, 150)) for d, t in ((2, (7, 60)), (2, (70, 130)), (3, (0, 50)))}
    assert set(map(tuple, some.tolist())) == want | {(2, 7, 60, 3, 0, 50), (2, 70, 130, 3, 0, 50)}
    assert (1, 0, 450, 3, 0, 50) in set(map(tuple, substring.star(key, doc, span).tolist()))


def test_passages_edited():
    """Insertions, deletions and moved passages that reach 0.75 as a whole or in their parts."""
    rng = np.random.RandomState(8)
    words = lambda n: rng.randint(0, 1 << 62, n).astype(np.uint64)
    p, q, least = words(36), words(36), 46

    def near(a, b):
        both = np.intersect1d(a, b)
        return len(both) / len(np.union1d(a, b)) if len(a) and len(b) else 0

    def brute(a, b):
        return max(near(a[i : i + n], b[j : j + m]) for n in (46, 76, len(a)) for m in (46, 92, len(b)) for i in range(0, len(a) - n + 1, 2) for j in range(0, len(b) - m + 1, 2))

    one = np.concatenate([p, words(4), q])
    for a, b in ((one, np.concatenate([p, words(20), q])), (np.concatenate([p, words(20), q]), one), (np.concatenate([p, q]), np.concatenate([p, words(24), q])), (np.concatenate([p, q]), np.concatenate([p[:30], q[6:]]))):
        assert brute(a, b) >= 0.75
        found = substring.passages(a, b, least, 0.75)
        assert found and all(near(a[s:t], b[u:v]) == share >= 0.75 and min(t - s, v - u) >= least for s, t, u, v, share in found)
        assert sum(t - s for s, t, *_ in found) >= 0.8 * len(a)
    # Two edited near copies side by side in a, far apart and in another order in b, with a repeated line.
    line = words(12)
    sides = [np.concatenate([words(25), line, words(28)]) for _ in range(2)]
    edited = [s.copy() for s in sides]
    for s in edited:
        s[[8, 20, 40, 52]] = words(4)
    a, b = np.concatenate(sides), np.concatenate([line, words(150), edited[1], words(300), line, edited[0], words(60)])
    for x, y, turn in ((a, b, 1), (b, a, -1)):
        spans = [r[:4] if turn > 0 else (*r[2:4], *r[:2]) for r in substring.passages(x, y, least, 0.75)]
        for start, place in ((0, 12 + 150 + 65 + 300 + 12), (65, 12 + 150)):
            assert any(s < start + 10 and t > start + 55 and u < place + 10 and v > place + 55 for s, t, u, v in spans)
    assert substring.passages(words(200), words(200), least, 0.75) == []


def test_compact_windows_cover():
    """Each long enough subsequence lies in the window of exactly one node, that of its minimum."""
    hashes = np.random.RandomState(2).permutation(60).astype(np.uint64)
    windows = substring.compact_windows(hashes, 8)
    for i in range(60):
        for j in range(i + 8, 61):
            holds = [c for a, c, b in windows if a <= i <= c < j <= b]
            assert holds == [i + int(hashes[i:j].argmin())]


@given
def test_language(spark, odd, empty):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = language.learn(docs)
    got = language.identify(docs, model, keep=("doc_id", "lang")).where(language.held_out(F.col("doc_id")))
    assert got.where("lang = lang_pred").count() >= 0.95 * got.count()
    found = language.identify(odd, model).collect()
    assert len(found) == odd.count() and all(0 <= r["score"] <= 1 for r in found)
    assert {r["doc_id"] for r in found if r["lang_pred"] == "und"} == {3, 4, 5, 9}
    assert language.identify(empty, model).count() == 0 and language.learn(empty) is None
    assert {r["lang_pred"] for r in language.identify(odd, None).collect()} == {"und"}


def test_codewords():
    for n in (2, 3, 4, 7, 12):
        code = language.codewords(n)
        distance = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        assert min(distance) >= (1 if n < 3 else 2) and all(len(set(c)) == 2 for c in code.T)


@given
def test_toxicity(spark, odd, empty):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    machine = toxicity.learn(docs, labels)
    got = toxicity.score(docs, machine).join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id"))).toPandas()
    assert toxicity.accuracy(got) >= 0.9
    found = toxicity.score(odd, machine).collect()
    assert len(found) == odd.count() and all(0 <= r["score"] <= 1 for r in found)
    assert toxicity.score(empty, machine).count() == 0
    assert {r["score"] for r in toxicity.score(odd, toxicity.learn(empty, labels)).collect()} == {0.5}


def test_toxicity_pairs():
    """Two terms that are harmless alone and toxic together."""
    rng = np.random.RandomState(4)
    found, label = [], []
    for _ in range(3000):
        a, b = rng.rand(2) < 0.5
        found.append(np.array([10] * int(a) + [20] * int(b) + [30 + rng.randint(50)]))
        label.append(float(a and b))
    machine = toxicity.fit(found, np.array(label), np.ones(3000))
    pair = machine.place[[10, 20]]
    assert (pair >= 0).all()
    together = machine.vectors[pair[0]] @ machine.vectors[pair[1]]
    assert machine.bias + machine.weights[pair].sum() + together > 0
    assert max(machine.bias + machine.weights[pair]) < 0


@given
def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = by_id(docs)
        docs = stage(spark, docs, DATA)
        if name == "token_sequences":
            break
        assert docs.columns == columns
        after = Counter(r["doc_id"] for r in docs.collect())
        if name == "language_id":
            assert set(after) == {i for i, r in before.items() if any(c.isalpha() for c in r["text"] or "")}
        if name == "near_duplicates":
            low = linked({i: shingle_set(r["text"]) for i, r in before.items()})
            assert after == Counter({i: 1 for i in before if low[i] == i})
        if name == "mix_sources":
            assert set(after) <= set(before) and max(after.values()) <= 2
    assert docs.count() == sum(after.values())


def shown(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_jaccard_null_bridge(spark):
    # Only a row without an id links 1 and 3: 36 shingles each, 4 of 40 words of either side differ.
    base = [f"b{i}" for i in range(40)]
    left, right = ["x1", "x2", "x3", "x4", *base[4:]], [*base[:36], "y1", "y2", "y3", "y4"]
    rows = [(1, " ".join(left)), (None, " ".join(base)), (3, " ".join(right))]
    assert 100 * len(shingle_set(rows[0][1]) & shingle_set(rows[2][1])) < 75 * len(shingle_set(rows[0][1]) | shingle_set(rows[2][1]))
    found = jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["component_id"]) for r in found) == [("1", 1), ("3", 1), ("None", 1)]


def test_passing_tables_go(spark):
    """Of the tables that op8 writes on the way, only those that its result reads stay."""
    here = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(here))
    words = " ".join(f"w{i}" for i in range(30))
    found = jaccard.jaccard_join(spark.createDataFrame([(1, words), (2, words + " x"), (3, "other")], "doc_id long, text string"))
    assert sorted(x.rsplit("-", 1)[0] for x in set(os.listdir(here)) - before) == ["of_node", "rows"]
    assert sorted((r["doc_id"], r["component_id"]) for r in found.collect()) == [(1, 1), (2, 1), (3, 3)]


def test_passing_windows_go(spark):
    """op1's windows and their pairs are gone before texts are joined, and the passage is still found."""
    here = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(here))
    words = " ".join(f"w{i}" for i in range(80))
    found = substring.repeated_passages(spark.createDataFrame([(1, words), (2, words + " x"), (3, "other")], "doc_id long, text string"))
    assert sorted(x.rsplit("-", 1)[0] for x in set(os.listdir(here)) - before) == ["candidates", "ids"]
    assert [(r["doc_a"], r["a_start"], r["a_stop"], r["doc_b"]) for r in found.collect()] == [(1, 0, 80, 2)]


def test_pipeline_odd(spark, odd, empty, tmp_path):
    """Each stage on nulls, repeated ids and clashing columns decides by row."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    stages = dict(corpus_pipeline.STAGES)
    letters = lambda r: any(c.isalpha() for c in r["text"] or "")
    named = stages["language_id"](spark, odd, DATA)
    assert named.columns == odd.columns
    assert shown(named) == sorted((tuple(r) for r in odd.collect() if letters(r)), key=str)
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert stages["language_id"](spark, unlabelled, DATA).count() == sum(map(letters, odd.collect()))

    # (7, A) is near 3, (7, B) is not; a null id goes before a smaller copy; of two null copies one stays.
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(3, a + " end", "en", "s", 1), (7, a, "en", "s", 2), (7, b, "en", "s", 3), (None, b + " end", "en", "s", 4), (None, c, "en", "s", 5), (None, c, "en", "s", 6)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("row_number", F.lit("x")).withColumn("row", F.lit("y"))
    kept = stages["near_duplicates"](spark, docs, DATA)
    assert kept.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["text"].split()[0]) for r in kept.collect()) == [("3", "a0"), ("7", "b0"), ("None", "c0")]

    bench = " ".join(f"q{i}" for i in range(20))
    spark.createDataFrame([("i1", bench), (None, None)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, bench, "en", "s", 1), (1, a, "en", "s", 2), (None, "x " + bench, "en", "s", 3), (None, b, "en", "s", 4), (2, None, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("row_number", F.lit("x"))
    clean = stages["decontaminate"](spark, docs, str(tmp_path))
    assert clean.columns == docs.columns and sorted(str(r["n_chars"]) for r in clean.collect()) == ["2", "4", "None"]
    for name, stage in stages.items():
        assert stage(spark, empty, DATA).count() == 0, name


@given
def test_pipeline_decontaminate(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    plain = lambda t: word.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    grams = defaultdict(set)
    for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect():
        ws = plain(r["text"])
        m = min(13, len(ws))
        grams[m] |= {tuple(ws[k : k + m]) for k in range(len(ws) - m + 1)} if m else set()
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = []
    for r in docs.collect():
        ws = plain(r["text"])
        hit = {k + j for m, found in grams.items() for k in range(len(ws) - m + 1) if tuple(ws[k : k + m]) in found for j in range(m)}
        if not (hit and 20 * len(hit) >= len(ws)):
            want.append(r["doc_id"])
    got = dict(corpus_pipeline.STAGES)["decontaminate"](spark, docs, DATA)
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(want) and len(want) < docs.count()


def test_rows_told_apart(spark, tmp_path):
    """Rows of files are named by their place, alike in every pass, also with a column `_metadata`; others are numbered."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(1, "a"), (1, "a"), (None, None), (2, "")]
    for own in ("row_number", "_metadata"):
        made = spark.createDataFrame(rows, f"`{own}` long, text string").repartition(3)
        made.write.parquet(str(tmp_path / own))
        for docs in (made, spark.read.parquet(str(tmp_path / own))):
            found, name = corpus_pipeline._numbered(docs)
            first, again = ({r[name]: (r[own], r["text"]) for r in found.select(*c).collect()} for c in ([name, own, "text"], [own, "text", name]))
            assert len(first) == 4 and first == again
            assert found.drop(name).columns == docs.columns
