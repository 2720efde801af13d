"""Tables behind the result figures."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.functions import direction_label, significance_class
from factorloom.guards import number, require_columns, require_rows
from factorloom.operators.factors import with_factor_column
from factorloom.operators.ordered import quantiles
from factorloom.operators.testing import Z_COLUMN, bh_boundary


def _label(df: DataFrame, titles: Mapping[str, str] | None):
    return direction_label("factor", "direction" if "direction" in df.columns else None, titles)


def landscape(
    results: DataFrame,
    *,
    trait: str | None = None,
    z: str = Z_COLUMN,
    q: str = "fdr_q",
    tau: str = "Coefficient",
    tau_se: str | None = "Coefficient_std_error",
    alpha: float = 0.05,
    thresholds: Sequence[float] = (0.05, 0.10),
    titles: Mapping[str, str] | None = None,
    top_n: int = 4,
) -> DataFrame:
    """Factors of one trait ranked by z: label, z, tau, its error, class, boundary, labelled.

    ``z_boundary`` is the smallest z that passes at `alpha` in this very table; the
    `top_n` first rows are marked to be labelled. One row per result of the trait.
    """
    results = with_factor_column(results)
    require_columns(results, ["factor", z, q, tau], "results")
    rows = results if trait is None else results.where(F.col("trait") == trait)
    require_rows(rows, f"no results for trait={trait!r}")
    boundary = bh_boundary(rows, q=q, z=z, alpha=alpha).first()["z_boundary"]
    error = number(tau_se) if tau_se and tau_se in rows.columns else F.lit(None).cast("double")
    named = rows.select(
        "factor",
        _label(rows, titles).alias("label"),
        number(F.col(f"`{z}`")).alias("z"),
        number(tau).alias("tau"),
        error.alias("tau_se"),
        number(q).alias("q"),
        significance_class(q, thresholds).alias("q_class"),
        F.lit(boundary).cast("double").alias("z_boundary"),
    )
    first = [r[0] for r in named.orderBy(F.desc_nulls_last("z"), "label").limit(top_n).select("label").collect()]
    return named.withColumn("labelled", F.col("label").isin(*first) if first else F.lit(False)).orderBy(
        F.desc_nulls_last("z"), "label"
    )


def trait_concordance(
    results: DataFrame,
    *,
    traits: Sequence[str],
    z: str = Z_COLUMN,
    titles: Mapping[str, str] | None = None,
) -> DataFrame:
    """z of two traits side by side per factor (and direction), with delta = second - first.

    Only factors with both; a trait without results or no common factor raises.
    """
    traits = list(traits)
    if len(traits) != 2:
        raise ValueError(f"a comparison takes two traits, not {traits}")
    results = with_factor_column(results)
    require_columns(results, ["factor", "trait", z], "results")
    keys = ["factor", "direction"] if "direction" in results.columns else ["factor"]
    v = number(F.col(f"`{z}`"))
    present = {r[0] for r in results.where(F.col("trait").isin(*traits)).select("trait").distinct().collect()}
    missing = [t for t in traits if t not in present]
    if missing:
        raise KeyError(f"no results for traits {missing}")
    wide = results.where(F.col("trait").isin(*traits)).groupBy(*keys).agg(
        F.avg(F.when(F.col("trait") == traits[0], v)).alias("z_left"),
        F.avg(F.when(F.col("trait") == traits[1], v)).alias("z_right"),
    )
    wide = wide.where("z_left is not null and z_right is not null")
    require_rows(wide, "the two traits have no factor with a z-score in common")
    return wide.select(
        *keys,
        _label(wide, titles).alias("label"),
        "z_left",
        "z_right",
        (F.col("z_right") - F.col("z_left")).alias("delta"),
    )


def concordance_summary(table: DataFrame) -> DataFrame:
    """n, median shift, and the histogram range and bin count of delta, as one row.

    A delta that is constant up to rounding gets five bins around its mean.
    """
    middle = quantiles(table, "delta", {"m": 0.5}).first()
    row = table.agg(
        F.count("delta").alias("n"),
        F.avg("delta").alias("centre"),
        F.min("delta").alias("low"),
        F.max("delta").alias("high"),
        F.lit(middle["m"] if middle else None).cast("double").alias("median_shift"),
    )
    spread = F.col("high") - F.col("low")
    varied = spread > F.greatest(F.abs("centre"), F.lit(1.0)) * 1e-9
    pad = F.greatest(F.abs("centre") * 0.05, F.lit(0.05))
    bins = F.least(F.lit(30), F.greatest(F.lit(5), F.floor(F.col("n") / 2).cast("int")))
    return row.select(
        "n",
        "median_shift",
        F.when(varied, bins).otherwise(5).alias("bins"),
        F.when(varied, F.col("low")).otherwise(F.col("centre") - pad).alias("low"),
        F.when(varied, F.col("high")).otherwise(F.col("centre") + pad).alias("high"),
    )


def concordance_histogram(table: DataFrame) -> DataFrame:
    """Histogram of delta: bin, left, right, n; empty bins included, the last one closed."""
    s = concordance_summary(table).first()
    width = (s["high"] - s["low"]) / s["bins"]
    at = F.least(F.floor((F.col("delta") - s["low"]) / width).cast("int"), F.lit(s["bins"] - 1))
    counts = table.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    bins = table.sparkSession.range(s["bins"]).select(F.col("id").cast("int").alias("bin"))
    return bins.join(F.broadcast(counts), "bin", "left").select(
        "bin",
        (F.lit(s["low"]) + F.col("bin") * width).alias("left"),
        (F.lit(s["low"]) + (F.col("bin") + 1) * width).alias("right"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )
