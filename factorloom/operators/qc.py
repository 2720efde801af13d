"""Sparse counts (cell, feature, n): totals, joint masks, feature filters."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.guards import require_columns


def cell_totals(counts: DataFrame, *, cell: str = "cell", n: str = "n", out: str = "total_counts") -> DataFrame:
    """Total count per cell."""
    require_columns(counts, [cell, n], "counts")
    return counts.groupBy(cell).agg(F.sum(n).alias(out))


def cells_passing(
    assays: Mapping[str, tuple[DataFrame, float]], *, cell: str = "cell", n: str = "n"
) -> DataFrame:
    """Cells whose total reaches the minimum in every assay, with ``total_<assay>``."""
    kept = None
    for name, (counts, minimum) in assays.items():
        totals = cell_totals(counts, cell=cell, n=n, out=f"total_{name}")
        totals = totals.where(F.col(f"total_{name}") >= F.lit(minimum))
        kept = totals if kept is None else kept.join(totals, cell)
    if kept is None:
        raise ValueError("no assay was given")
    return kept


def features_in_cells(
    counts: DataFrame, min_cells: int, *, cell: str = "cell", feature: str = "feature", n: str = "n"
) -> DataFrame:
    """Features counted in at least `min_cells` cells, with n_cells and total_counts."""
    require_columns(counts, [cell, feature, n], "counts")
    pairs = counts.groupBy(feature, cell).agg(F.sum(n).alias("_n"))
    per_feature = pairs.groupBy(feature).agg(
        F.count_if(F.col("_n") > 0).alias("n_cells"), F.sum("_n").alias("total_counts")
    )
    return per_feature.where(F.col("n_cells") >= int(min_cells))


def top_features(
    counts: DataFrame, n_features: int, *, feature: str = "feature", n: str = "n"
) -> DataFrame:
    """The features with the largest totals, ties by name."""
    require_columns(counts, [feature, n], "counts")
    totals = counts.groupBy(feature).agg(F.sum(n).alias("total_counts"))
    return totals.orderBy(F.desc("total_counts"), feature).limit(int(n_features))


def keep_features(counts: DataFrame, features: DataFrame, *, feature: str = "feature") -> DataFrame:
    """Counts of the given features."""
    return counts.join(features.select(feature), feature, "left_semi")
