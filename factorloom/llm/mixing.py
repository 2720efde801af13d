"""Mixing sources to target weights by whole and fractional repetition.

Words are summed per source, a water level shares the wanted amount by weight under a cap per
source, and a source's repetition rate is its target over its size. A document is emitted
floor(rate) times plus one more copy with the fraction as probability, drawn from a hash of the
seed and its id, so reruns agree and no row has to meet another.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.llm.common import shuffle_partitions, small, stored

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
SEED = 17

_WORD = r"[^\x20\x09-\x0D]+"


def words_in(text: Column) -> Column:
    """Number of runs without white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) from the id (null counts as one id of its own) and the seed."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(16**12)


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Per source (columns source, source_size) its weight and target.

    Sources are in code point order, null last, and take the weights in turn. Their positions
    come from sorted partitions and one count per partition, not from one task. Each round of
    the water level is one aggregate over one row per source; it ends when no source is above
    its cap.
    """
    n = shuffle_partitions(sizes.sparkSession)
    ordered = stored(
        sizes.withColumn("no_name", F.col("source").isNull())
        .repartitionByRange(n, "no_name", "source")
        .withColumn("part", F.spark_partition_id()),
        "sources",
    )
    counts = ordered.groupBy("part").count()
    before = counts.withColumn("before", F.sum("count").over(Window.orderBy("part")) - F.col("count"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("no_name", "source")) + F.col("before") - 1
    turn = F.array(*[F.lit(float(w)) for w in weights])
    ranked = stored(
        ordered.join(F.broadcast(before), "part").select(
            "source",
            "source_size",
            F.element_at(turn, (place % len(weights) + 1).cast("int")).alias("weight"),
            (F.col("source_size") * float(cap)).alias("most"),
        ),
        "ranked",
    )
    wanted = float(share) * float(ranked.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = 0.0, -1
    while True:
        at_cap = F.col("weight") * level >= F.col("most")
        row = ranked.agg(
            F.count(F.when(at_cap, 1)),
            F.coalesce(F.sum(F.when(at_cap, F.col("most"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~at_cap, F.col("weight"))), F.lit(0.0)),
        ).first()
        if row[0] == capped or row[2] == 0:
            break
        capped, level = row[0], (wanted - row[1]) / row[2]
    return ranked.select(
        "source",
        "source_size",
        "weight",
        F.least(F.col("weight") * float(level), F.col("most")).alias("target"),
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    *,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    cap: float = CAP,
    seed: int = SEED,
) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, rate, copies, taken, and all
    columns of the input in the struct `row`.

    `copies` is how often the mix takes the document, at most ceil(cap), and `taken` its words times the copies.
    Rows that repeat an id draw alike. A source without words has target 0 and no copy; an
    empty table gives an empty result. Input columns keep their names inside `row`, so no name
    clashes.
    """
    sized = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(f"`{id_col}`").alias("doc_id"),
        F.col(f"`{source_col}`").alias("source"),
        words_in(F.col(f"`{text_col}`")).alias("size"),
    )
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = stored(source_targets(sizes, weights, share, cap), "targets")
    named = small(targets).withColumnRenamed("source", "of")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(cap)))).otherwise(0.0)
    taken = sized.join(named, F.col("source").eqNullSafe(F.col("of"))).withColumn("rate", rate)
    copies = F.floor("rate") + (draw(F.col("doc_id"), seed) < F.col("rate") - F.floor("rate")).cast("long")
    return taken.withColumn("copies", copies).select(
        "row",
        "doc_id",
        "size",
        "source_size",
        "target",
        "rate",
        "copies",
        (F.col("size") * F.col("copies")).alias("taken"),
    )


def emit(mixed: DataFrame) -> DataFrame:
    """The mix itself: each document's row as often as `copies` says."""
    return mixed.where(F.col("copies") > 0).select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).select("row.*")
