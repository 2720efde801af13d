"""Filter audit, source divergence and fingerprints against brute force and on odd rows."""

import hashlib
import re
import time
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factorloom.llm import divergence, filter_audit, fingerprints

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and very long texts, ties, repeated rows, and columns whose names clash."""
    rows = [
        (1, "One two  three\tfour five six", "en", "a", 1),
        (2, "one two three four five six", "en", "a", 1),
        (2, "one two three four five six", "en", "a", 1),
        (None, "one two three four five six", None, None, None),
        (3, None, None, None, None),
        (4, "", "en", "b", 0),
        (5, " \n\t ", None, "", 0),
        (6, LONG, "en", "c", 9),
        (7, LONG, "en", None, 9),
        (8, "élan ÉTÉ 日本語 1234 $", "fr", "c", 3),
        (9, "One TWO one One ONE one", "en", "c", 3),
        (10, " ".join(["same"] * 60), "en", "b", 3),
        (11, "LOUD & " + " ".join(f"t{i}" for i in range(60)), "en", "b", 3),
        (None, None, None, None, None),
        (12, "one two three four five six", "en", "c", 1),
    ]
    clash = ["part", "mask", "digest", "first", "n", "good", "cells", "term", "split", "at", "total", "piece", "value", "rank"]
    return spark.createDataFrame(rows, DOCS).select("*", *[F.lit("x").alias(c) for c in clash])


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def fails_of(rows):
    lowest = {}
    for r in rows:
        if r["doc_id"] is not None:
            t = r["text"] or ""
            lowest[t] = min(lowest.get(t, r["doc_id"]), r["doc_id"])
    for r in rows:
        t = r["text"] or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        yield {
            f
            for f, bad in zip(
                "ABCDE",
                [
                    len(ws) < 50,
                    100 * len(set(ws)) < 65 * len(ws),
                    100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
                    re.search(r"[#$%&*|]", t) is not None,
                    r["doc_id"] is not None and r["doc_id"] > lowest[t],
                ],
                strict=True,
            )
            if bad
        }


def audit_by_hand(rows, labels):
    found, shapley = {}, Counter()
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    docs = [(r["source"] or "", f, r["doc_id"] in good, r["doc_id"] in toxic) for r, f in zip(rows, fails_of(rows), strict=True)]
    for part in {d[0] for d in docs}:
        for order in permutations("ABCDE"):
            left = [d for d in docs if d[0] == part]
            for step, f in enumerate(order):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                failing = [d for d in docs if d[0] == part and f in d[1]]
                found[part, "".join(order), step + 1] = [
                    len(left),
                    len(gone),
                    len(failing) - len(gone),
                    sum(d[1] == {f} for d in failing),
                    sum(d[2] for d in gone),
                    sum(d[3] for d in gone),
                ]
                shapley[part, f] += len(gone)
    return {k: tuple([*v, shapley[k[0], k[1][k[2] - 1]]]) for k, v in found.items()}


def test_filter_audit(spark, odd, empty):
    marks = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (9, None, 1), (None, 1, 1), (12, 1, None), (99, 1, 1)]
    labels = spark.createDataFrame([(*m, "x") for m in marks], "doc_id long, quality int, toxic int, mask string")
    got = {tuple(r)[:3]: tuple(r)[3:] for r in filter_audit.audit(odd, labels).collect()}
    assert got == audit_by_hand(odd.collect(), marks)
    assert len(got) == 4 * 600 and ("", "EDCBA", 1) in got
    assert filter_audit.audit(empty, labels).count() == 0
    none = filter_audit.audit(odd, labels.limit(0)).agg(F.sum("good_lost"), F.sum("toxic_lost"), F.sum("removed")).first()
    assert tuple(none)[:2] == (0, 0) and none[2] > 0


def test_filter_audit_large_group(spark):
    docs = spark.range(0, 3000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot text").otherwise(F.concat(F.lit("t"), "id")).alias("text"), F.lit("s").alias("source")
    )
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    row = filter_audit.audit(docs, labels).where("filter_order = 'EABCD' AND step = 1").first()
    assert (row["kept"], row["removed"]) == (2001, 999)


def divergence_by_hand(rows, least=3, ranks=200):
    counts, docs, groups = defaultdict(Counter), Counter(), defaultdict(set)
    for r in rows:
        lang, source = r["lang"] or "", r["source"] or ""
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"] or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower)
        groups[lang].add(source)
        counts[lang, source].update(terms)
        docs.update((lang, t) for t in set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for (x, t), n in docs.items() if x == lang and n >= least]
        of_lang = sum((counts[lang, s] for s in sources), Counter())

        def shares(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}

        q, p = shares(of_lang), {s: shares(counts[lang, s]) for s in sources}
        for s in sources:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode()) for o in sources - {s}]
            terms = [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:ranks])):
                out += [(lang, s, part, item.decode(), -v, k + 1) for k, (v, item) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("bits", [64, 9, 3])
def test_divergence(spark, odd, empty, bits):
    # Few bits make terms share digests; the result stays the same.
    docs = odd.where("length(coalesce(text, '')) < 1000")
    more = [(i, f"alpha beta b{'cdefgh'[i % 6]} one ONE gamma{'xyz'[i % 3]}x two", ["en", "fr"][i % 2], f"s{i % 5}", 0) for i in range(40)]
    docs = docs.select(*empty.columns).unionByName(spark.createDataFrame(more, DOCS))
    assert sorted(map(tuple, divergence.divergence(docs, bits=bits).collect())) == divergence_by_hand(docs.collect())
    if bits == 64:
        assert sorted(map(tuple, divergence.divergence(docs, ranks=3).collect())) == divergence_by_hand(docs.collect(), ranks=3)


def test_divergence_odd(spark, odd, empty):
    assert divergence.divergence(empty).count() == 0
    assert sorted(map(tuple, divergence.divergence(odd).collect())) == divergence_by_hand(odd.collect())
    # A language without a kept term still has its pairs, all of value 0.
    few = spark.createDataFrame([(1, "a", "xx", "p", 0), (2, "b", "xx", "q", 0)], DOCS)
    assert sorted(map(tuple, divergence.divergence(few).collect())) == [("xx", "p", "pair", "q", 0, 1), ("xx", "q", "pair", "p", 0, 1)]


def test_shares_are_exact():
    import numpy as np

    counts, totals = np.array([[0, 7, 10**15, 3 * 10**12]]), np.array([3, 11, 9 * 10**15, 10**13 + 7])
    assert divergence.shares(counts, totals).tolist() == [[1 + 10**9 * (c + 1) // t for c, t in zip(counts[0].tolist(), totals.tolist())]]


def winnow_by_hand(text, k=16, w=16):
    data = text.encode()
    grams = [zlib.crc32(data[i : i + k]) for i in range(max(len(data) - k + 1, min(len(data), 1)))]
    chosen = set()
    for s in range(max(len(grams) - w + 1, min(len(grams), 1))):
        low = min(grams[s : s + w])
        chosen.add(max(i for i in range(s, min(s + w, len(grams))) if grams[i] == low))
    return [(grams[i], i) for i in sorted(chosen)]


def like(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def fingerprints_by_hand(rows, k=16, w=16):
    docs = Counter((r["doc_id"], r["text"] or "") for r in rows)
    order = sorted(docs, key=lambda d: (d[0] is None, d[0] or 0, hashlib.sha256(d[1].encode()).hexdigest()))
    out = []
    for i, (doc_id, text) in enumerate(order):
        follower, n = order[(i + 1) % len(order)][1], len(text)
        edited = text[: n - n // 2] + follower[: n // 2]
        own, changed, after = (winnow_by_hand(t, k, w) for t in (text, edited, follower))
        spelled = [",".join(f"{h:X}:{i}" for h, i in x) for x in (own, changed)]
        row = (doc_id, n, hashlib.sha256(edited.encode()).hexdigest(), *spelled, like(own, changed), like(own, after))
        out += [row] * docs[doc_id, text]
    return sorted(out, key=str)


def test_fingerprints(spark, odd, empty):
    more = [(100 + i, "x" * i if i % 3 else "äö " * i, "en", "s", 0) for i in range(40)]
    more += [(200 + i, " ".join(f"{'abcé'[j % 4]}{j * i % 97}" for j in range(130 * i)), "en", "s", 0) for i in range(8)]
    docs = odd.select(*empty.columns).unionByName(spark.createDataFrame(more, DOCS))
    docs = docs.withColumn("text", F.substring("text", 1, 30_000))
    got = sorted((tuple(r) for r in fingerprints.fingerprints(docs).collect()), key=str)
    assert got == fingerprints_by_hand(docs.collect())
    assert fingerprints.fingerprints(odd).count() == odd.count()
    assert fingerprints.fingerprints(empty).count() == 0


@pytest.mark.parametrize(("k", "w"), [(5, 4), (8, 1), (3, 7)])
def test_fingerprints_other_sizes(spark, empty, k, w):
    rows = [(i, "ab" * (3 * i) + "the quick brown fox"[:i], "en", "s", 0) for i in range(25)]
    docs = spark.createDataFrame(rows, DOCS)
    got = sorted((tuple(r) for r in fingerprints.fingerprints(docs, k=k, window=w).collect()), key=str)
    assert got == fingerprints_by_hand(docs.collect(), k, w)


def test_fingerprints_match_guarantee(spark):
    shared = "exactly thirty-one bytes of text"[:31]
    rows = [(i, f"{'pqrst'[i] * 40}{i}{shared}{i}{'uvwxy'[i] * 30}") for i in range(5)]
    found = fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sets = [{e.split(":")[0] for e in r["fingerprint"].split(",")} for r in found]
    assert all(a & b for a in sets for b in sets)


def test_fingerprints_one_row(spark):
    (row,) = fingerprints.fingerprints(spark.createDataFrame([(1, "abc")], "doc_id long, text string")).collect()
    assert (row["n_chars"], row["near_next"]) == (3, 1.0) and row["edited_sha256"] == hashlib.sha256(b"aba").hexdigest()


def _letters(k):
    """A term of its own for each number."""
    return "".join(chr(ord("a") + int(c)) for c in str(k))


def test_terms_seen_cost_nothing(monkeypatch):
    """what a slice costs does not grow with the terms that its task has seen, and terms that leave the table are sent again."""
    batches = [
        pa.RecordBatch.from_arrays([pa.array([0, 1]), pa.array([" ".join(_letters(k) for k in range(b * 30_000 + i, (b + 1) * 30_000, 2)) for i in (0, 1)])], names=["gid", "text"])
        for b in range(30)
    ]
    took, last = [], time.process_time()

    def fed():
        nonlocal last
        for batch in batches:
            last = time.process_time()
            yield batch
            took.append(time.process_time() - last)

    sent = pa.Table.from_batches(divergence._counter(64, False)(fed()))
    assert sent.num_rows >= 2 * 900_000
    assert min(took[20:28]) < 5 * min(took[:5])

    monkeypatch.setattr(divergence, "_SEEN_BITS", 3)
    texts = [["Aa b aa", "b c"], ["c", "aa \u00e9 \u00e9"], ["b aa", "c c \u00e9"]]
    some = [pa.RecordBatch.from_arrays([pa.array([7, 9]), pa.array(t)], names=["gid", "text"]) for t in texts]
    rows = pa.Table.from_batches(divergence._counter(64, False)(iter(some))).to_pylist()
    names = {r["digest"]: r["term"] for r in rows if r["n"] is None}
    found = sorted((r["gid"], names[r["digest"]], r["n"], r["docs"]) for r in rows if r["n"] is not None)
    assert found == [(7, "aa", 3, 2), (7, "b", 2, 2), (7, "c", 1, 1), (9, "aa", 1, 1), (9, "b", 1, 1), (9, "c", 3, 2), (9, "\u00e9", 3, 2)]
