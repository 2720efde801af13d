"""Language identification with error-correcting output codes.

Each language has a codeword. For each bit a binary classifier over hashed n-grams of bytes
weighs the languages whose bit is set against the others (log ratios of smoothed n-gram
shares). Decoding sums, for each codeword, the logistic loss of every bit's margin, weighted by
how well the bit does on the learning sample, and chooses the codeword with the least loss. The
score is the chosen one's share of the likelihood over all codewords; a low one flags ambiguity.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorloom.llm.common import held_out, stored
from factorloom.llm.text import slices

#: Most labelled rows of a language that the classifiers learn from.
SAMPLE = 400

ORDERS = (2, 3, 4)
BUCKETS = 1 << 16

#: Grams beyond which more text adds no certainty, and the score below which a text is ambiguous.
ENOUGH = 200
AMBIGUOUS = 0.6

UNKNOWN = "und"

#: Bytes of text that are weighed at once: each takes about 200 bytes of arrays.
_SLICE = 1 << 16

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[0x80:] = np.arange(0x80, 0x100)


def grams(data: np.ndarray) -> list[np.ndarray]:
    """Bucket of the n-gram that starts at each byte, per order; letters lower-cased, the rest of ASCII as blanks."""
    folded = _FOLD[data]
    after = np.zeros(len(data), bool)
    after[1:] = data[:-1] == 0xC3
    folded[after & (data >= 0x80) & (data <= 0x9E)] += 0x20
    wide = folded.astype(np.uint32)
    found, key = [], wide.copy()
    for order in range(2, max(ORDERS) + 1):
        key = key[:-1] * np.uint32(0x01000193) ^ wide[order - 1 :] if len(key) > 1 else key[:0]
        if order in ORDERS:
            hashed = (key + np.uint32(order)) * np.uint32(0x9E3779B1)
            found.append(hashed >> np.uint32(16))
    return found


def codewords(n: int) -> np.ndarray:
    """n distinct codewords of +1 and -1: the exhaustive code up to 7, beyond it seeded columns."""
    if n < 2:
        return np.zeros((n, 0))
    if n <= 7:
        bits = np.arange(1, 1 << (n - 1))
        return np.array([[1 if i == 0 or not b >> (i - 1) & 1 else -1 for b in bits] for i in range(n)], float)
    wanted, columns = 10 * int(np.ceil(np.log2(n))), []
    for seed in count():
        column = np.random.RandomState(seed).permutation(np.resize([1.0, -1.0], n))
        if not any(abs(column @ c) == n for c in columns):
            columns.append(column)
        if len(columns) >= wanted:
            code = np.array(columns).T
            if len({tuple(r) for r in code}) == n:
                return code


@dataclass
class Model:
    """Languages, their codewords, weights (bucket x bit) per order, and a weight per bit."""

    languages: list[str]
    code: np.ndarray
    weights: list[np.ndarray]
    bits: np.ndarray

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(rows, bits): summed log ratios of each row, evened out for long texts."""
        total = np.zeros((len(offsets) - 1, self.code.shape[1]))
        number = np.zeros(len(offsets) - 1)
        for order, buckets, weights in zip(ORDERS, grams(data), self.weights, strict=True):
            last = np.maximum(offsets[1:] - order + 1, offsets[:-1])
            counts = last - offsets[:-1]
            running = np.zeros((len(buckets) + 1, weights.shape[1]))
            np.cumsum(weights[buckets], axis=0, out=running[1:])
            safe = np.minimum(np.stack([offsets[:-1], last]), len(buckets))
            total += running[safe[1]] - running[safe[0]]
            number += counts
        return total / np.maximum(number, 1)[:, None] * np.minimum(number, ENOUGH)[:, None]

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(best language, its score, the language next to it)."""
        if len(self.languages) == 1:
            return np.zeros(len(margins), int), np.ones(len(margins)), np.zeros(len(margins), int)
        loss = np.stack([(self.bits * np.logaddexp(0, -margins * c)).sum(axis=1) for c in self.code], axis=1)
        order = np.argsort(loss, axis=1, kind="stable")
        share = np.exp(loss.min(axis=1, keepdims=True) - loss)
        return order[:, 0], 1 / share.sum(axis=1), order[:, 1]


def learning_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int) -> DataFrame:
    """At most `per_language` labelled rows of each language outside the held-out fold.

    The rows with the smallest hashes of id and length are chosen; the limit acts before the
    shuffle, so a language of any size sends only so many rows.
    """
    labelled = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang")
    ).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id")))
    order = Window.partitionBy("lang").orderBy(F.xxhash64(F.col("id"), F.lit(2)), "id", F.length("text"))
    return labelled.withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_language).select("lang", "text")


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, per_language: int = SAMPLE) -> Model | None:
    """A model from a bounded sample of labelled rows; None if there is no labelled row.

    Two jobs: n-gram counts of each language, then the margins of the sample, which give each
    bit its weight. The driver gets one table of BUCKETS counts per language and order.
    """
    sample = stored(learning_sample(docs, id_col, text_col, lang_col, per_language), "sample")

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list[np.ndarray]] = {}
        for pdf in batches:
            for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
                own = held.setdefault(lang, [np.zeros(BUCKETS, np.int64) for _ in ORDERS])
                for total, found in zip(own, grams(np.frombuffer(text.encode(), np.uint8)), strict=True):
                    total += np.bincount(found, minlength=BUCKETS)
        if held:
            yield pd.DataFrame({"lang": list(held), "counts": [np.concatenate(v).astype("<i8").tobytes() for v in held.values()]})

    by_language: dict[str, np.ndarray] = {}
    for row in sample.repartition(2).mapInPandas(counts, "lang string, counts binary").toLocalIterator():
        by_language[row["lang"]] = by_language.get(row["lang"], 0) + np.frombuffer(row["counts"], "<i8").reshape(len(ORDERS), BUCKETS)
    if not by_language:
        return None
    languages = sorted(by_language)
    code = codewords(len(languages))
    weights = []
    for k in range(len(ORDERS)):
        share = np.stack([(by_language[x][k] + 0.1) / (by_language[x][k].sum() + 0.1 * BUCKETS) for x in languages])
        columns = [np.log(share[c > 0].mean(axis=0) / share[c < 0].mean(axis=0)) for c in code.T]
        weights.append(np.stack(columns, axis=1).astype(np.float32) if columns else np.zeros((BUCKETS, 0), np.float32))
    model = Model(languages, code, weights, np.ones(code.shape[1]))
    if code.shape[1]:
        model.bits = _bit_weights(sample, model)
    return model


def _bit_weights(sample: DataFrame, model: Model) -> np.ndarray:
    """Log odds of each bit's success on the sample, between 0.1 and 5, divided by their mean."""
    shared = sample.sparkSession.sparkContext.broadcast(model)
    place = {x: i for i, x in enumerate(model.languages)}

    def right(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
                data = np.frombuffer(text.encode(), np.uint8)
                found.append((shared.value.margins(data, np.array([0, len(data)]))[0] * shared.value.code[place[lang]] > 0).astype(float))
            if found:
                yield pd.DataFrame({"n": [len(found)], "right": [np.sum(found, axis=0).tolist()]})

    rows = sample.mapInPandas(right, "n long, right array<double>").collect()
    good = (np.sum([r["right"] for r in rows], axis=0) + 1) / (sum(r["n"] for r in rows) + 2)
    odds = np.clip(np.log(good / (1 - good)), 0.1, 5)
    return odds / odds.mean()


def answers(text: pa.Array, model: Model | None) -> list[pa.Array]:
    """lang_pred, score, ambiguous and lang_next of whole texts, read in slices of bounded size."""
    best, score, after = np.full(len(text), -1), np.zeros(len(text)), np.full(len(text), -1)
    for start, stop, data, offsets in slices(text, _SLICE):
        if model is None or not len(data):
            continue
        here = slice(start, stop)
        best[here], score[here], after[here] = model.decode(model.margins(data, offsets))
        ascii_letter = np.concatenate([[0], np.cumsum((_FOLD[data] != 0x20) & (data < 0x80))])
        for i in np.flatnonzero(np.diff(ascii_letter[offsets]) == 0):
            raw = data[offsets[i] : offsets[i + 1]].tobytes().decode()
            if not any(unicodedata.category(c)[0] == "L" for c in raw):
                best[start + i], score[start + i], after[start + i] = -1, 0.0, -1
    names = [*(model.languages if model else []), UNKNOWN]
    return [
        pa.array([names[i] for i in best], pa.string()),
        pa.array(score, pa.float64()),
        pa.array(score < AMBIGUOUS),
        pa.array([names[i] for i in after], pa.string()),
    ]


def language_of(text: Column, model: Model) -> Column:
    """`lang_pred` as a column: only the text goes to Python, all other columns of its row stay where they are."""
    shared = SparkSession.active().sparkContext.broadcast(model)

    @F.arrow_udf("string")
    def named(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            yield answers(column, shared.value)[0]

    return named(text.cast("string"))


def identify(docs: DataFrame, model: Model | None, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of each input row, lang_pred, score, ambiguous and lang_next.

    `und` with score 0 if the text is null or has no letter, or if nothing could be learned.
    Whole texts are read, in slices of bounded size. Other columns are not read, so their names
    do not matter. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    named = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("string").alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in named.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(len(keep))], *answers(batch.column(len(keep)), shared.value)],
                names=[*keep, "lang_pred", "score", "ambiguous", "lang_next"],
            )

    return named.mapInArrow(run, f"{kinds}, lang_pred string, score double, ambiguous boolean, lang_next string")
