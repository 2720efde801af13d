"""Toxicity scores from a factorization machine over hashed terms.

Terms are a text's words and the beginnings of its words, so that new endings of a known stem
count. A screen keeps the hash buckets that tell the labels of the learning sample apart best;
over these the machine learns a weight per term and a short vector per term, whose products add
what pairs of terms mean together, such as an insult beside a group's name, which separate weights cannot say.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorloom.llm.common import held_out, stored
from factorloom.llm.text import ALNUM, slices, word_hashes, words

#: Most labelled rows of each label that the machine learns from, terms it keeps, length of a term's vector.
SAMPLE = 4000
TERMS = 1024
FACTORS = 4

BUCKETS = 1 << 20
BEGINNINGS = (4, 5, 6)
STEPS = 150
THRESHOLD = 0.3


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every word and word beginning, repeats included."""
    data, starts, ends, rows = words(data, offsets, ALNUM)
    of_row = np.repeat(np.arange(len(offsets) - 1), np.diff(rows))
    found, place = [word_hashes(data, starts, ends)], [of_row]
    for n in BEGINNINGS:
        long = ends - starts >= n
        found.append(word_hashes(data, starts[long], starts[long] + n) + np.uint64(n))
        place.append(of_row[long])
    return np.concatenate(place), (np.concatenate(found) >> np.uint64(44)).astype(np.int64)


@dataclass
class Machine:
    """Term number of each bucket (-1 if not kept), bias, weights and vectors."""

    place: np.ndarray
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        rows = len(offsets) - 1
        if not len(self.weights):
            return np.full(rows, 1 / (1 + np.exp(-self.bias)))
        row, bucket = terms(data, offsets)
        term = self.place[bucket]
        row, term = np.divmod(np.unique(row[term >= 0] * len(self.weights) + term[term >= 0]), len(self.weights))
        total = self.bias + np.bincount(row, self.weights[term], rows)
        for v in self.vectors.T:
            total += 0.5 * (np.bincount(row, v[term], rows) ** 2 - np.bincount(row, v[term] ** 2, rows))
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def learning_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_label: int) -> DataFrame:
    """(text, toxic, share): at most `per_label` rows of each label outside the held-out fold.

    The rows are chosen from the labels alone, by the smallest hashes, with the limit before the
    shuffle; their number is bounded, so they are broadcast to the texts. `share` is how many
    labelled rows a chosen one stands for.
    """
    marked = (
        labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("toxic"))
        .where(F.col("id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("id")))
        .groupBy("id")
        .agg(F.max("toxic").alias("toxic"))
    )
    order = Window.partitionBy("toxic").orderBy(F.xxhash64("id", F.lit(9)), "id")
    chosen = stored(marked.withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_label).drop("k"), "chosen")
    sizes = marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("all"))
    kept = chosen.groupBy("toxic").agg(F.count(F.lit(1)).alias("kept"))
    share = sizes.join(F.broadcast(kept), "toxic").select("toxic", (F.col("all") / F.col("kept")).alias("share"))
    named = chosen.join(F.broadcast(share), "toxic")
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(named), "id").select("text", "toxic", "share")


def learn(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    *,
    per_label: int = SAMPLE,
) -> Machine:
    """A machine from a bounded sample of labelled rows; without any, one that scores 0.5.

    Tasks turn sample texts into distinct buckets; the driver gets those of the bounded sample.
    Learning is deterministic.
    """
    sample = learning_sample(docs, labels, id_col, text_col, label_col, per_label)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [b""] * batch.num_rows
            for start, _, data, offsets in slices(batch.column(0)):
                row, bucket = terms(data, offsets)
                row, bucket = np.divmod(np.unique(row * BUCKETS + bucket), BUCKETS)
                bounds = np.searchsorted(row, np.arange(len(offsets)))
                for i in range(len(offsets) - 1):
                    found[start + i] = bucket[bounds[i] : bounds[i + 1]].astype("<i4").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), batch.column(1), batch.column(2)], names=["terms", "toxic", "share"])

    rows = sample.mapInArrow(run, "terms binary, toxic int, share double").orderBy("toxic", "terms").toPandas()
    return fit([np.frombuffer(t, "<i4") for t in rows["terms"]], rows["toxic"].to_numpy(float), rows["share"].to_numpy(float))


def fit(found: list[np.ndarray], label: np.ndarray, share: np.ndarray) -> Machine:
    """Screen the buckets by their G statistic, then descend the weighted log loss."""
    place = np.full(BUCKETS, -1, np.int32)
    if not len(found) or label.min() == label.max():
        rate = label.mean() if len(label) else 0.5
        return Machine(place, float(np.log((rate + 1e-3) / (1 - rate + 1e-3))), np.zeros(0), np.zeros((0, FACTORS)))
    sides = []
    for side in (0, 1):
        own = [f for f, y in zip(found, label, strict=True) if y == side]
        sides.append((np.bincount(np.concatenate(own), minlength=BUCKETS), len(own)))
    (a, n0), (b, n1) = sides
    p0, p1, p = a / n0, b / n1, (a + b) / (n0 + n1)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = sum(
            np.nan_to_num(n * q * np.log(q / p)) + np.nan_to_num(n * (1 - q) * np.log((1 - q) / (1 - p)))
            for q, n in ((p0, n0), (p1, n1))
        )
    gain[a + b < 5] = 0
    kept = np.argsort(-gain, kind="stable")[:TERMS]
    kept = kept[gain[kept] > 6]
    place[kept] = np.arange(len(kept))
    x = np.zeros((len(found), len(kept)), np.float32)
    for i, f in enumerate(found):
        term = place[f]
        x[i, term[term >= 0]] = 1
    weight = (share / share.sum()).astype(np.float32)
    y = label.astype(np.float32)
    rate = float((weight * y).sum())
    vectors = np.random.RandomState(9).normal(0, 0.05, (len(kept), FACTORS)).astype(np.float32)
    state = [np.zeros(1, np.float32) + np.log(rate / (1 - rate)), np.zeros(len(kept), np.float32), vectors]
    first, second = [np.zeros_like(s) for s in state], [np.zeros_like(s) for s in state]
    balance = np.where(y > 0, 0.5 / rate, 0.5 / (1 - rate)).astype(np.float32)
    for step in range(1, STEPS + 1):
        bias, w, v = state
        inner = x @ v
        total = bias + x @ w + 0.5 * ((inner**2).sum(axis=1) - x @ (v**2).sum(axis=1))
        error = weight * np.sqrt(balance) * (1 / (1 + np.exp(-np.clip(total, -30, 30))) - y)
        push = x.T @ error
        slope = [
            error.sum(keepdims=True),
            push + 1e-5 * w,
            x.T @ (error[:, None] * inner) - v * push[:, None] + 1e-4 * v,
        ]
        for k, g in enumerate(slope):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g**2
            state[k] = state[k] - 0.05 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return Machine(place, float(state[0][0]), state[1].astype(float), state[2].astype(float))


def score(docs: DataFrame, machine: Machine, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of each input row, score and predicted (1 from THRESHOLD on).

    Whole texts are read, in slices of bounded size; null and empty texts get the score of a
    text without terms. No other column is read, so names do not clash. An empty table gives an
    empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    named = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("string").alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in named.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros(batch.num_rows)
            for start, stop, data, offsets in slices(batch.column(len(keep))):
                found[start:stop] = shared.value.score(data, offsets)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(len(keep))], pa.array(found), pa.array((found >= THRESHOLD).astype(np.int32))],
                names=[*keep, "score", "predicted"],
            )

    return named.mapInArrow(run, f"{kinds}, score double, predicted int")


def accuracy(scored: pd.DataFrame, label: str = "toxic") -> float:
    """Share of rows whose prediction is their label."""
    return float((scored["predicted"] == scored[label]).mean())
