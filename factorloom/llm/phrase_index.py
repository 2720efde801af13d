"""Benchmark decontamination with a distributed positional inverted index.

The index is parted by documents: a shard holds some documents' words as postings, a sorted list of
word positions per term, with a gap between documents so that no run of positions reaches over
two of them. Shards are bounded in words and written to the shared folder; the index knows nothing of
the benchmark.

A search takes the benchmark's windows. Terms are ranked by their number of postings over all
shards, and in each shard a window starts from the postings of its rarest term, shifted by the
term's offset, and is intersected with the shifted postings of the next rarest until no start
is left. What remains are exact phrase matches. Proximity matches are items whose rarest terms
all lie near one posting of the rarest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorloom.llm.common import small, stored
from factorloom.llm.text import ALNUM, slices, word_hashes, words

WINDOW = 13

#: Bytes of text in a shard (a longer single text is a shard of its own).
SHARD_BYTES = 4 << 20

#: Words between the documents of a shard, and the words around the rarest term that count as near.
GAP = 64
NEAR = 26
NEAR_TERMS = 4

#: Benchmark rows, in windows, that a task may be sent; more are searched in rounds.
WINDOWS_AT_ONCE = 200_000

_INDEX = "shard long, term long, n long, positions array<int>, docs array<struct<doc_id:ID,first:int,n_words:int,row:long>>"


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of all words of all documents, written to the shared folder.

    One row per (shard, term) with its positions, and per shard one row with a null term that
    lists the documents (id, first position, number of words). Null texts have no words. Rows
    are told apart by their place, so ids may repeat or be null; only the two named columns are
    read. An empty table gives an empty index.
    """
    id_type = docs.select(F.col(f"`{id_col}`")).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        for batch in batches:
            for start, stop, data, offsets in slices(batch.column(1), SHARD_BYTES):
                data, begins, ends, rows = words(data, offsets, ALNUM)
                terms = word_hashes(data, begins, ends)
                counts = np.diff(rows)
                first = rows[:-1] + GAP * np.arange(stop - start)
                place = (np.arange(len(terms)) + GAP * np.repeat(np.arange(stop - start), counts)).astype(np.int32)
                order = np.argsort(terms, kind="stable")
                sorted_terms = terms[order]
                new = np.flatnonzero(np.append(True, sorted_terms[1:] != sorted_terms[:-1])[: len(terms)])
                bounds = np.append(new, len(terms)).astype(np.int32)
                ids = batch.column(0).slice(start, stop - start)
                listed = pa.StructArray.from_arrays(
                    [ids, pa.array(first, pa.int32()), pa.array(counts, pa.int32()), pa.array(shard + np.arange(stop - start), pa.int64())],
                    names=["doc_id", "first", "n_words", "row"],
                )
                size = len(new)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(size + 1, shard), pa.int64()),
                        pa.array([*sorted_terms[new].view(np.int64).tolist(), None], pa.int64()),
                        pa.array(np.append(np.diff(bounds), 0), pa.int64()),
                        pa.ListArray.from_arrays(np.append(bounds, bounds[-1]).astype(np.int32), pa.array(place[order], pa.int32())),
                        pa.ListArray.from_arrays(np.array([0] * (size + 1) + [stop - start], np.int32), listed),
                    ],
                    names=["shard", "term", "n", "positions", "docs"],
                )
                shard += stop - start

    named = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return stored(named.mapInArrow(run, _INDEX.replace("ID", id_type)), "postings")


def benchmark_windows(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """One row per window: item (id as string), place, terms array<long>.

    An item of fewer words than a window, but not none, is one window.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, data, offsets in slices(batch.column(1)):
                data, begins, ends, rows = words(data, offsets, ALNUM)
                terms = word_hashes(data, begins, ends).view(np.int64)
                items, places, found = [], [], []
                for i, item in enumerate(batch.column(0).slice(start, stop - start).to_pylist()):
                    own = terms[rows[i] : rows[i + 1]]
                    for k in range(max(len(own) - window + 1, min(len(own), 1))):
                        items.append(item)
                        places.append(k)
                        found.append(own[k : k + window])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(items, pa.string()), pa.array(places, pa.int64()), pa.array(found, pa.list_(pa.int64()))],
                    names=["item", "place", "terms"],
                )

    named = benchmark.select(
        F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null")).alias("item"), F.col(f"`{text_col}`").cast("string").alias("text")
    )
    return stored(named.mapInArrow(run, "item string, place long, terms array<long>"), "windows")


class Searcher:
    """Matches of a set of windows in one shard."""

    def __init__(self, windows: list[tuple[str, list[int]]], weight: dict[int, int]):
        self.plans = []
        for item, terms in windows:
            ranked = sorted(range(len(terms)), key=lambda j: (weight.get(terms[j], 0), j))
            self.plans.append((item, len(terms), [(terms[j], j) for j in ranked]))
        self.near = {}
        for item, terms in windows:
            self.near.setdefault(item, set()).update(terms)
        self.near = {i: sorted(t, key=lambda x: (weight.get(x, 0), x))[:NEAR_TERMS] for i, t in self.near.items()}

    def exact(self, postings: dict[int, np.ndarray]) -> Iterator[tuple[str, int, np.ndarray]]:
        """(item, words of the window, starts of its occurrences)."""
        for item, size, ranked in self.plans:
            starts = None
            for term, offset in ranked:
                have = postings.get(term)
                if have is None:
                    starts = None
                    break
                if starts is None:
                    starts = have - offset
                else:
                    at = np.searchsorted(have, starts + offset)
                    starts = starts[have[np.minimum(at, len(have) - 1)] == starts + offset]
                if not len(starts):
                    starts = None
                    break
            if starts is not None:
                yield item, size, starts

    def proximity(self, postings: dict[int, np.ndarray], near: int) -> Iterator[tuple[str, np.ndarray]]:
        """(item, positions of its rarest term with the next rarest terms within `near` words)."""
        for item, terms in self.near.items():
            lists = [postings.get(t) for t in terms]
            if any(x is None for x in lists):
                continue
            at = lists[0]
            for have in lists[1:]:
                after = np.searchsorted(have, at)
                gap = np.minimum(
                    np.abs(have[np.minimum(after, len(have) - 1)] - at), np.abs(have[np.maximum(after - 1, 0)] - at)
                )
                at = at[gap <= near]
            if len(at):
                yield item, at


def search(index: DataFrame, windows: DataFrame, *, near: int = NEAR) -> DataFrame:
    """Matches of written `windows` in the index, one row per document row that has any:
    row, items array<string> (exact), near_items array<string>, hits array<int> (word places in
    the document inside any exact match).

    Windows are sent to the tasks in rounds of at most WINDOWS_AT_ONCE, so what a task holds is
    bounded however large the benchmark is; each round reads the index again, pruned to its terms.
    """
    total = windows.count()
    rounds = max(1, -(-total // WINDOWS_AT_ONCE))
    numbered = windows.withColumn("round", F.pmod(F.xxhash64("item"), F.lit(rounds)))
    found = None
    for k in range(rounds):
        some = numbered.where(F.col("round") == k)
        vocabulary = some.select(F.explode("terms").alias("term")).distinct()
        pruned = index.join(small(stored(vocabulary, "vocabulary")), "term", "left_semi")
        weight = {r["term"]: r["n"] for r in pruned.groupBy("term").agg(F.sum("n").alias("n")).collect()}
        searcher = Searcher([(r["item"], list(r["terms"])) for r in some.collect()], weight)
        rows = pruned.unionByName(index.where(F.col("term").isNull()))
        part = _run(rows, searcher, near)
        found = part if found is None else found.unionByName(part)
    return found


def _run(rows: DataFrame, searcher: Searcher, near: int) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(searcher)

    def run(shard: pd.DataFrame) -> pd.DataFrame:
        listed = shard["term"].isna()
        docs = [d for found in shard.loc[listed, "docs"] for d in found]
        postings = {int(t): np.asarray(p, np.int64) for t, p in zip(shard.loc[~listed, "term_key"], shard.loc[~listed, "positions"], strict=True)}
        first = np.array([d["first"] for d in docs], np.int64)
        hits: dict[int, set] = {}
        items: dict[int, set] = {}
        close: dict[int, set] = {}
        for item, size, starts in shared.value.exact(postings):
            for at, doc in zip(starts.tolist(), (np.searchsorted(first, starts, side="right") - 1).tolist(), strict=True):
                items.setdefault(doc, set()).add(item)
                hits.setdefault(doc, set()).update(range(at - int(first[doc]), at - int(first[doc]) + size))
        for item, at in shared.value.proximity(postings, near):
            for doc in set((np.searchsorted(first, at, side="right") - 1).tolist()):
                close.setdefault(doc, set()).add(item)
        some = sorted(items.keys() | close.keys())
        return pd.DataFrame(
            {
                "row": pd.Series([docs[d]["row"] for d in some], dtype="int64"),
                "items": pd.Series([sorted(items.get(d, ())) for d in some], dtype=object),
                "near_items": pd.Series([sorted(close.get(d, ())) for d in some], dtype=object),
                "hits": pd.Series([sorted(hits.get(d, ())) for d in some], dtype=object),
            }
        )

    keyed = rows.select("shard", "term", F.coalesce("term", F.lit(0)).alias("term_key"), "positions", "docs")
    return keyed.groupBy("shard").applyInPandas(run, "row long, items array<string>, near_items array<string>, hits array<int>")


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    *,
    window: int = WINDOW,
    share: int = 20,
) -> DataFrame:
    """One row per input row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near.

    Words are runs of letters a-z (A-Z lower-cased), digits and anything beyond ASCII. A word
    inside any occurrence of a window of `window` item words is hit; a document is
    contaminated if share * n_hit >= n_words and a word is hit. Null and empty texts have no
    words and are clean; rows that repeat an id are judged each by itself; items that repeat an
    id count once. Only the named columns are read. An empty table on either side gives no hit.
    """
    index = build_index(docs, id_col, text_col)
    windows = benchmark_windows(benchmark, item_col, item_text_col, window)
    matches = search(index, windows)
    per_row = matches.groupBy("row").agg(
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
        F.array_distinct(F.flatten(F.collect_list("near_items"))).alias("near"),
        F.size(F.array_distinct(F.flatten(F.collect_list("hits")))).cast("long").alias("hit"),
    )
    rows = index.where(F.col("term").isNull()).select(F.explode("docs").alias("d")).select("d.doc_id", "d.row", F.col("d.n_words").cast("long").alias("n_words"))
    joined = rows.join(per_row, "row", "left")
    names = F.coalesce("items", F.array().cast("array<string>"))
    hit = F.coalesce("hit", F.lit(0).cast("long"))
    return joined.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(names), ",").cast("binary"), 256).alias("items_sha256"),
        ((hit > 0) & (hit * share >= F.col("n_words"))).alias("contaminated"),
        F.size(F.coalesce("near", F.array().cast("array<string>"))).cast("long").alias("n_near"),
    )
