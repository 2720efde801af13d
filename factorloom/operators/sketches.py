"""Quantiles with a known rank error from KLL sketches, which can be stored and merged.

An exact quantile reads its input three times. A sketch is one aggregation with map-side
combine; sketches of days or folders are stored once and merged for any coarser grouping.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.guards import finite, require_columns

#: Accuracy parameter of a sketch; it holds about 3 k values, whatever it has seen.
SKETCH_K = 400


def rank_error(k: int = SKETCH_K) -> float:
    """Bound on |rank of a returned quantile - wanted rank| / n, kept with 99 % confidence."""
    # The published fit for single ranks of a KLL sketch.
    return 2.296 / k**0.9021


def value_sketches(df: DataFrame, value: str, keys: Sequence[str] = (), *, k: int = SKETCH_K) -> DataFrame:
    """One row per group with a finite value: the keys and its ``sketch`` (binary)."""
    require_columns(df, [*keys, value])
    rows = df.select(*keys, finite(value).alias("_v")).where("_v is not null")
    found = rows.groupBy(*keys).agg(F.kll_sketch_agg_double("_v", k).alias("sketch"), F.count("_v").alias("_n"))
    return found.where("_n > 0").drop("_n")


def merge_sketches(sketches: DataFrame, keys: Sequence[str] = (), *, k: int = SKETCH_K) -> DataFrame:
    """Sketches of coarser groups from stored ones."""
    require_columns(sketches, [*keys, "sketch"], "sketches")
    found = sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch", k).alias("sketch"), F.count("sketch").alias("_n"))
    return found.where("_n > 0").drop("_n")


def sketch_quantiles(sketches: DataFrame, probabilities: Mapping[str, float]) -> DataFrame:
    """The columns of `sketches` but the sketch, one column per probability, and ``n``.

    A quantile is a value of the input whose rank is off by at most `rank_error` of n.
    """
    require_columns(sketches, ["sketch"], "sketches")
    kept = [F.col(f"`{c}`") for c in sketches.columns if c != "sketch"]
    points = [F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias(n) for n, p in probabilities.items()]
    return sketches.select(*kept, *points, F.kll_sketch_get_n_double("sketch").alias("n"))


def approximate_quantiles(
    df: DataFrame, value: str, probabilities: Mapping[str, float], keys: Sequence[str] = (), *, k: int = SKETCH_K
) -> DataFrame:
    """As `ordered.quantiles`, in one pass and within `rank_error` (k)."""
    return sketch_quantiles(value_sketches(df, value, keys, k=k), probabilities)
