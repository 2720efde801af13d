"""Filter interaction audit by contractions of a contingency tensor.

Five filters leave 32 ways in which a document can fail them. Documents are counted once by part
and way; the counts of a part are a 2x2x2x2x2 tensor with one axis a filter. Whatever an order of
the filters does at a step is a contraction of that tensor: along each axis the documents that
pass, that fail, or all of them are taken. So the work over documents does not depend on the
number of orders, and the work over orders not on the number of documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from string import ascii_lowercase

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.llm.common import stored

#: Least words, least distinct words and most capital letters in a hundred, characters of junk.
LEAST_WORDS = 50
DISTINCT = 65
CAPITALS = 5
JUNK = r"[#$%&*|]"

FILTERS = "ABCDE"

_SPACE = r"[\x20\x09-\x0D]+"
_PASS, _FAIL, _ALL = (1, 0), (0, 1), (1, 1)

#: Parts whose tensors are contracted at once.
_PARTS = 64

_FOUND = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, "
    "unique_fails long, good_lost long, toxic_lost long, shapley long"
)


def text_fails(text: Column) -> Column:
    """Bits 1, 2, 4 and 8 of the conditions A to D that a text (not null) fails."""
    words = F.array_remove(F.split(text, _SPACE), "")
    n, distinct = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    fails = [n < LEAST_WORDS, 100 * distinct < DISTINCT * n, 100 * capitals > CAPITALS * F.length(text), text.rlike(JUNK)]
    bits = F.lit(0)
    for k, failed in enumerate(fails):
        bits = bits + F.when(failed, 1 << k).otherwise(0)
    return bits


def selections(count: int = len(FILTERS)) -> tuple[list[tuple[str, int]], np.ndarray, np.ndarray]:
    """(order, step) of each row of the result; per measure (kept, removed, failing, alone) and row
    what is taken along each axis, as [measure, row, axis, 2]; and the filter of each row."""
    named, taken, own = [], [], []
    for order in permutations(range(count)):
        for step, f in enumerate(order):
            before = order[:step]
            named.append(("".join(FILTERS[i] for i in order), step + 1))
            own.append(f)
            taken.append(
                [
                    [_PASS if i in before or i == f else _ALL for i in range(count)],
                    [_PASS if i in before else _FAIL if i == f else _ALL for i in range(count)],
                    [_FAIL if i == f else _ALL for i in range(count)],
                    [_FAIL if i == f else _PASS for i in range(count)],
                ]
            )
    return named, np.array(taken, np.int64).transpose(1, 0, 2, 3), np.array(own)


def contracted(tensors: np.ndarray, taken: np.ndarray) -> np.ndarray:
    """[part, row]: the tensors [part, 2, 2, ...] contracted with what each row takes along each axis."""
    axes = ascii_lowercase[2 : 2 + tensors.ndim - 1]
    spec = f"a{axes}," + ",".join(f"b{x}" for x in axes) + "->ab"
    return np.einsum(spec, tensors, *[taken[:, i] for i in range(len(axes))], optimize="greedy")


def audit_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the result from (part, cells): cells of (mask, all, good, toxic) counts."""
    named, taken, own = selections()
    orders, steps = [o for o, _ in named], np.array([s for _, s in named], np.int32)
    shape = (2,) * len(FILTERS)
    for batch in batches:
        for first in range(0, batch.num_rows, _PARTS):
            piece = batch.slice(first, _PARTS)
            parts = piece.column(0).to_pylist()
            counts = np.zeros((3, len(parts), 1 << len(FILTERS)), np.int64)
            for i, cells in enumerate(piece.column(1).to_pylist()):
                for cell in cells:
                    counts[:, i, cell["mask"]] = cell["n"], cell["good"], cell["toxic"]
            # Bit 0 of a mask is the first filter: the last axis of the plain reshape.
            tensors = counts.reshape(3, len(parts), *shape).transpose(0, 1, *range(len(shape) + 1, 1, -1))
            kept, removed, failing, alone = (contracted(tensors[0], t) for t in taken)
            good, toxic = (contracted(tensors[k], taken[1]) for k in (1, 2))
            shapley = np.stack([removed[:, own == f].sum(axis=1) for f in range(len(FILTERS))], axis=1)[:, own]
            columns = [kept, removed, failing - removed, alone, good, toxic, shapley]
            rows = len(orders)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([p for p in parts for _ in range(rows)], pa.string()),
                    pa.array(orders * len(parts), pa.string()),
                    pa.array(np.tile(steps, len(parts))),
                    *[pa.array(c.reshape(-1)) for c in columns],
                ],
                names=[c.split(" ")[0] for c in _FOUND.split(", ")],
            )


def failing_rows(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """One row per document: doc_id, part and the mask of all filters it fails, written.

    Texts are read once; what meets are ids and digests. A document fails E unless its row
    holds the smallest id of its text. Rows meet those by digest and id together, so a text that
    very many documents hold is no large group of a join. A null id is not above any other.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = stored(
        docs.select(
            F.col(f"`{id_col}`").alias("doc_id"),
            F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"),
            F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
            text_fails(text).alias("mask"),
        ),
        "filter_rows",
    )
    named = rows.where("doc_id IS NOT NULL")
    first = named.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    again = F.when(F.col("first").isNull(), 1 << FILTERS.index("E")).otherwise(0)
    met = named.join(first, ["digest", "doc_id"], "left").select("doc_id", "part", (F.col("mask") + again).alias("mask"))
    return stored(met.unionByName(rows.where("doc_id IS NULL").select("doc_id", "part", "mask")), "filter_masks")


def audit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    part_col: str = "source",
) -> DataFrame:
    """One row per part, order of the filters and step: part, filter_order, step, kept, removed,
    redundant, unique_fails, good_lost, toxic_lost, shapley.

    Counts are of rows. A null text counts as empty, a null part as the empty string, together
    with parts so named. A row with a null id is identical to no smaller one and has no label;
    rows that repeat an id share its labels, and of several labels of an id quality or toxic is 1
    if it is in any. Of `docs` only the three named columns are read, of `labels` doc_id, quality and
    toxic; an empty table gives an empty result. Writes the documents' masks, which have no text.
    """
    masks = failing_rows(docs, id_col, text_col, part_col)
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    known = masks.join(marks.where("good = 1 OR toxic = 1"), "doc_id")
    none = F.lit(0).cast("long")
    cells = masks.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n")).withColumns({"good": none, "toxic": none}).unionByName(
        known.groupBy("part", "mask")
        .agg(F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))
        .withColumn("n", none)
    )
    cells = cells.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    return parts.mapInArrow(audit_parts, _FOUND)
