"""Source divergence audit with late string materialization.

Terms are counted under 64-bit digests of their bytes; the counts that are shuffled hold no
strings. Beside them each task writes which string it saw under a digest, once a task; the
smallest and the largest string of a digest differ if two terms share it. Such digests are split:
their terms are counted again under their strings. Strings come back only for the terms that may
be among the kept ranks.

All arithmetic is of whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.llm.common import shuffle_partitions, small, stored
from factorloom.llm.text import slices, word_hashes, words

#: Documents of a language that must hold a kept term, and most terms of a group that are returned.
LEAST_DOCS = 3
RANKS = 200

#: What shares are multiples of.
UNIT = 1_000_000_000

#: Bits of a digest.
BITS = 64

#: Bytes of a term: letters A-Z and a-z and everything beyond ASCII.
TERM = np.zeros(256, dtype=bool)
TERM[ord("A") : ord("Z") + 1] = TERM[ord("a") : ord("z") + 1] = TERM[0x80:] = True

#: Terms of a language in one piece of the comparison of its sources, and cells of a block within it.
_PIECE = 20_000
_CELLS = 1 << 21

#: Parts into which a group is dealt before its first ranks are taken.
_DEALT = 32

#: Rows of counts that a task holds before it sends them.
_HELD = 1 << 20

#: Bits of the number of hashes by which a task knows the terms that it has sent.
_SEEN_BITS = 21

_PARTIAL = "gid long, digest long, term string, n long, docs long"


def _distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(terms, term of each place) of all terms of `data`, which a place's bytes alone tell apart."""
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    places = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[TERM[data]])])
    found = places.dictionary_encode()
    return found.dictionary, found.indices.to_numpy()


def _hashes(terms: pa.Array) -> np.ndarray:
    """One hash per term of `_distinct`."""
    offsets = np.frombuffer(terms.buffers()[1], np.int32)[: len(terms) + 1].astype(np.int64)
    return word_hashes(np.frombuffer(terms.buffers()[2], np.uint8), offsets[:-1], offsets[1:])


def _combined(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """(gid, digest, n, docs) with one row per group and digest."""
    gid, digest, n, docs = (np.concatenate([h[i] for h in held]) for i in range(4))
    order = np.lexsort((digest, gid))
    gid, digest = gid[order], digest[order]
    new = np.flatnonzero(np.append(True, (gid[1:] != gid[:-1]) | (digest[1:] != digest[:-1])))
    return gid[new], digest[new], np.add.reduceat(n[order], new), np.add.reduceat(docs[order], new)


def _counter(bits: int, spelled: bool):
    """From (gid, text): rows of occurrences and documents per group and digest (term null), and of the term of
    a digest (n null). If `spelled`, one kind of rows: occurrences and documents per group and term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A hash lies in the place that its first bits name, so a later one may drive it out: its term is then sent once more.
        seen, held, size, rest = np.zeros(1 << _SEEN_BITS, np.uint64), [], 0, 0
        seen[0] = ~seen[0]
        for batch in batches:
            gids = batch.column(0).to_numpy()
            for start, _, data, offsets in slices(batch.column(1)):
                data, starts, ends, rows = words(data, offsets, TERM)
                if not len(starts):
                    continue
                terms, of = _distinct(data, starts, ends)
                whole = _hashes(terms)
                texts = len(rows) - 1
                names, group = np.unique(gids[start : start + texts], return_inverse=True)
                # In this order places of one group and term lie together, and in order of documents.
                doc = np.repeat(np.arange(texts), np.diff(rows))
                keys, doc = np.divmod(np.sort((of * np.int64(len(names)) + group[doc]) * texts + doc), texts)
                fresh = np.append(True, keys[1:] != keys[:-1])
                new = np.flatnonzero(fresh)
                n = np.diff(np.append(new, len(keys)))
                docs = np.add.reduceat(fresh | np.append(True, doc[1:] != doc[:-1]), new, dtype=np.int64)
                term, gid = keys[new] // len(names), names[keys[new] % len(names)]
                digests = whole >> np.uint64(64 - bits)
                if spelled:
                    yield _rows(gid, digests[term], terms.take(pa.array(term)), n, docs)
                    continue
                place = whole >> np.uint64(64 - _SEEN_BITS)
                at = np.flatnonzero(seen[place] != whole)
                if len(at):
                    yield _rows(None, digests[at], terms.take(pa.array(at)), None, None)
                    seen[place] = whole
                held.append((gid, digests[term], n, docs))
                size += len(gid)
                if size >= rest + _HELD:
                    held = [_combined(held)]
                    size = rest = len(held[0][0])
                    if size >= _HELD:
                        yield _rows(*held[0][:2], None, *held[0][2:])
                        held, size, rest = [], 0, 0
        if held:
            gid, digest, n, docs = _combined(held)
            yield _rows(gid, digest, None, n, docs)

    return run


def _rows(gid, digests, terms, n, docs) -> pa.RecordBatch:
    long = lambda x: pa.nulls(len(digests), pa.int64()) if x is None else pa.array(x.astype(np.int64))
    strings = pa.nulls(len(digests), pa.string()) if terms is None else terms.cast(pa.string())
    names = [c.split(" ")[0] for c in _PARTIAL.split(", ")]
    return pa.RecordBatch.from_arrays([long(gid), pa.array(digests.view(np.int64)), strings, long(n), long(docs)], names=names)


def term_counts(texts: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """From (gid, text): counts (gid, digest, split, n, docs) and dictionary (digest, split, term).

    `split` is the empty string but for digests that several terms share, where it is the term.
    """
    partial = stored(texts.mapInArrow(_counter(bits, False), _PARTIAL), "terms_seen")
    strings = stored(
        partial.where("n IS NULL").groupBy("digest").agg(F.min("term").alias("low"), F.max("term").alias("high")), "term_strings"
    )
    sums = [F.sum(c).alias(c) for c in ("n", "docs")]
    counts = partial.where("n IS NOT NULL").groupBy("gid", "digest").agg(*sums).withColumn("split", F.lit(""))
    dictionary = strings.where("low = high").select("digest", F.lit("").alias("split"), F.col("low").alias("term"))
    shared = strings.where("low <> high").select("digest")
    if not shared.isEmpty():
        shared = small(stored(shared, "shared_digests"))
        again = texts.mapInArrow(_counter(bits, True), _PARTIAL).join(shared, "digest", "left_semi")
        again = stored(again.withColumnRenamed("term", "split").groupBy("gid", "digest", "split").agg(*sums), "split_terms")
        counts = counts.join(shared, "digest", "left_anti").unionByName(again)
        dictionary = dictionary.unionByName(again.select("digest", "split", F.col("split").alias("term")).distinct())
    return counts, dictionary


def numbered_groups(texts: DataFrame) -> tuple[DataFrame, int]:
    """(gid, lid, lang, source, at) of the occurring groups, `at` numbering the sources of a language, and the seed of the ids.

    Ids are hashes, so texts need no join to get theirs; another seed is taken if two groups or languages share one.
    """
    groups, seed = stored(texts.select("lang", "source").distinct(), "groups"), 0
    while True:
        ids = groups.withColumns({"gid": _gid(seed), "lid": F.xxhash64("lang", F.lit(seed))})
        one = ids.agg(*[F.count_distinct(c) for c in ("gid", "lid", "lang")], F.count(F.lit(1))).first()
        if one[0] == one[3] and one[1] == one[2]:
            place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
            return stored(ids.withColumn("at", place), "numbered"), seed
        seed += 1


def _gid(seed: int) -> Column:
    return F.xxhash64("lang", "source", F.lit(seed))


def share(count: Column, total: Column) -> Column:
    """1 + floor(UNIT * (count + 1) / total), exact for counts to 10^18."""
    scaled = (count + 1).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")
    return F.lit(1).cast("long") + F.call_function("div", scaled, total.cast("decimal(20,0)"))


def gain(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)."""
    return F.call_function("div", (p - q) * (p - q), q)


def shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """`share` of [term, source] counts: three decimal places of the quotient at a time, so nothing overflows."""
    whole, rest = np.divmod(counts + 1, totals)
    value = whole
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, totals)
        value = value * 1000 + digits
    return value + 1


def compared(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """[a, b]: floor((p - q)^2 / q) summed over the terms of [term, source] counts, p of a and q of b."""
    k = len(totals)
    found = np.zeros((k, k), np.int64)
    step = max(1, _CELLS // max(k, 1))
    for first in range(0, len(counts), step):
        p = shares(counts[first : first + step], totals)
        for a in range(k):
            d = p[:, a : a + 1] - p
            found[a] += (d * d // p).sum(axis=0)
    return found


def source_pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lid, a, b, value) summed over the kept terms, a and b numbers of sources of a language.

    Terms are dealt to pieces; each takes the one row of every source of its language along.
    """
    many = kept.groupBy("lid").agg(F.count(F.lit(1)).alias("terms"))
    pieces = stored(many.select("lid", F.ceil(F.col("terms") / _PIECE).cast("long").alias("pieces")), "pieces")
    dealt = kept.join(pieces, "lid").withColumn("piece", F.pmod(F.xxhash64("digest", "split"), F.col("pieces")))
    along = groups.join(pieces, "lid").select("lid", "at", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("piece"))

    def compare(key: tuple, terms: pd.DataFrame, sources: pd.DataFrame) -> pd.DataFrame:
        sources = sources.sort_values("at")
        counts = np.zeros((len(terms), len(sources)), np.int64)
        held = [len(x) for x in terms["at"]]
        if len(terms):
            counts[np.repeat(np.arange(len(terms)), held), np.concatenate(terms["at"].to_list())] = np.concatenate(terms["n"].to_list())
        found = compared(counts, sources["total"].to_numpy())
        k = len(sources)
        return pd.DataFrame({"lid": key[0], "a": np.repeat(np.arange(k), k), "b": np.tile(np.arange(k), k), "value": found.reshape(-1)})

    met = dealt.select("lid", "piece", "at", "n").groupBy("lid", "piece").cogroup(along.groupBy("lid", "piece"))
    found = met.applyInPandas(compare, "lid long, a long, b long, value long")
    return found.groupBy("lid", "a", "b").agg(F.sum("value").alias("value"))


def first_ranks(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first `k` rows of each group with their `rank`; a group is dealt to parts that are cut to `k` first."""
    dealt = df.withColumn("dealt", F.pmod(F.xxhash64(*[c for c in df.columns if c not in keys]), F.lit(_DEALT)))
    cut = dealt.withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "dealt").orderBy(*order))).where(F.col("rank") <= k)
    return cut.drop("dealt").withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def raised_terms(kept: DataFrame, dictionary: DataFrame, groups: DataFrame, langs: DataFrame, ranks: int) -> DataFrame:
    """(lang, source, item, value, rank): the first terms of each group whose share is above the language's.

    A group's rows are counted by value to find the value of its last rank; only terms of that
    value or more get their strings, which decide among equal values.
    """
    rows = kept.select("lid", "digest", "split", "all", F.explode(F.arrays_zip("at", "n")).alias("x"))
    rows = rows.select("lid", "digest", "split", "all", F.col("x.at").alias("at"), F.col("x.n").alias("n"))
    rows = rows.join(small(groups.select("lid", "at", "lang", "source", "total")), ["lid", "at"]).join(small(langs), "lid")
    p, q = share(F.col("n"), F.col("total")), share(F.col("all"), F.col("lang_total"))
    rows = rows.select("lang", "source", "digest", "split", p.alias("p"), q.alias("q")).where("p > q")
    rows = stored(rows.select("lang", "source", "digest", "split", gain(F.col("p"), F.col("q")).alias("value")), "raised")
    by_value = rows.groupBy("lang", "source", "value").agg(F.count(F.lit(1)).alias("k"))
    top = first_ranks(by_value, ["lang", "source"], [F.col("value").desc()], ranks)
    before = F.sum("k").over(Window.partitionBy("lang", "source").orderBy(F.col("rank")).rowsBetween(Window.unboundedPreceding, -1))
    least = top.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < ranks)
    least = stored(least.groupBy("lang", "source").agg(F.min("value").alias("least")), "least")
    near = rows.join(small(least), ["lang", "source"]).where("value >= least").drop("least")
    named = near.join(dictionary, ["digest", "split"]).select("lang", "source", F.col("term").alias("item"), "value")
    return first_ranks(named, ["lang", "source"], [F.col("value").desc(), F.col("item")], ranks)


def divergence(
    docs: DataFrame,
    lang_col: str = "lang",
    source_col: str = "source",
    text_col: str = "text",
    *,
    least_docs: int = LEAST_DOCS,
    ranks: int = RANKS,
    bits: int = BITS,
) -> DataFrame:
    """How the sources of a language differ in their terms: lang, source, part, item, value, rank.

    Part `pair` compares a source with each other source of its language over all kept terms,
    part `term` names the first `ranks` terms that a source uses more than its language. Null
    texts, languages and sources count as the empty string; every row is a document, repeated
    or not. A group without terms has pairs but no terms; a language with one source has no pairs.
    Only the three named columns are read; an empty table gives an empty result. `bits` of the digests may be
    fewer in tests. Values are exact while no total of a language is above 9 * 10^15.
    """
    texts = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for n, c in (("lang", lang_col), ("source", source_col), ("text", text_col))])
    numbered, seed = numbered_groups(texts)
    counts, dictionary = term_counts(texts.select(_gid(seed).alias("gid"), "text"), bits)
    of_term = counts.join(small(numbered.select("gid", "lid", "at")), "gid").groupBy("lid", "digest", "split")
    kept = of_term.agg(F.sum("docs").alias("docs"), F.sum("n").alias("all"), F.collect_list("at").alias("at"), F.collect_list("n").alias("n"))
    kept = stored(kept.where(F.col("docs") >= least_docs), "kept_terms")

    sizes = kept.select("lid", F.explode(F.arrays_zip("at", "n")).alias("x")).groupBy("lid", F.col("x.at").alias("at")).agg(F.sum("x.n").alias("size"))
    of_lang = stored(kept.groupBy("lid").agg(F.count(F.lit(1)).alias("terms"), F.sum("all").alias("lang_size")), "langs")
    totals = numbered.join(sizes, ["lid", "at"], "left").join(small(of_lang), "lid", "left")
    totals = stored(totals.select("lid", "at", "lang", "source", (F.coalesce("size", F.lit(0)) + F.coalesce("terms", F.lit(0))).alias("total")), "totals")

    a, b = (numbered.select("lid", "lang", F.col("at").alias(x), F.col("source").alias(f"source_{x}")) for x in "ab")
    pairs = a.join(b.drop("lang"), "lid").where("a <> b").join(source_pairs(kept, totals), ["lid", "a", "b"], "left")
    pairs = pairs.select("lang", F.col("source_a").alias("source"), F.col("source_b").alias("item"), F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item")))
    pairs = pairs.withColumn("rank", place).withColumn("part", F.lit("pair"))
    terms = raised_terms(kept, dictionary, totals, of_lang.select("lid", (F.col("lang_size") + F.col("terms")).alias("lang_total")), ranks)
    found = pairs.unionByName(terms.withColumn("part", F.lit("term")))
    return found.select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))
