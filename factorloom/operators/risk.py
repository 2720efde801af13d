"""Fitted effects pushed down to single intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorloom.functions import chrom_sort_key, parse_interval
from factorloom.guards import number, require_columns, require_none, require_rows, require_unique
from factorloom.operators.factors import keep_subset, with_factor_column
from factorloom.operators.ordered import first_k_per_group, quantiles
from factorloom.session import broadcast_if_small, materialize


def peak_risk(
    loadings: DataFrame,
    results: DataFrame,
    counts: DataFrame | None = None,
    *,
    peak: str = "peak",
    coefficient: str = "Coefficient",
    count: str = "n_snps",
    include_zero: bool = False,
) -> DataFrame:
    """One row per (peak, factor, direction): loading times the fitted coefficient.

    `loadings` has peak, factor, direction, loading. ``risk_total`` (with `counts`) is the
    rate times the points in the peak. A scored (factor, direction) without a fit, a fit
    given twice, or no loading left raises. The fits are one row per factor and direction.
    """
    results = with_factor_column(results)
    require_columns(results, ["factor", "direction", coefficient], "results")
    require_columns(loadings, [peak, "factor", "direction", "loading"], "loadings")
    pair = ["factor", "direction"]
    require_unique(results, pair, "more than one fit per (factor, direction); filter to one trait")
    tau = results.select(
        F.col("factor").cast("string"), F.col("direction").cast("string"), number(coefficient).alias("tau")
    )
    scored = loadings.select(*pair).distinct()
    lost = scored.join(tau, pair, "left_anti").select(F.concat_ws("/", *pair).alias("pair"))
    require_none(lost, "pair", f"results have no {coefficient!r} for some factors", KeyError)

    rows = loadings if include_zero else loadings.where(F.col("loading") != 0)
    require_rows(rows, "no non-zero loadings to score; include_zero keeps the zero ones")
    chrom, start, end = parse_interval(peak)
    value = F.col("loading").cast("double")
    risk = rows.join(F.broadcast(tau), pair).select(
        peak,
        chrom.alias("chrom"),
        start.alias("start"),
        end.alias("end"),
        "factor",
        "direction",
        value.alias("loading"),
        "tau",
        (value * F.col("tau")).alias("risk_rate"),
    )
    if counts is None:
        return risk
    per_peak = counts.select(peak, F.col(count).alias("_n"))
    return risk.join(per_peak, peak, "left").withColumn(
        "risk_total", F.col("risk_rate") * F.col("_n")
    ).drop("_n")


def top_risk(risk: DataFrame, n: int = 20, *, by: str = "risk_total") -> DataFrame:
    """The n rows with the largest `by`, missing last."""
    require_columns(risk, [by], "risk table (pass counts for risk_total)")
    return risk.orderBy(number(by).desc_nulls_last(), *_row_order(risk)).limit(n)


def _row_order(risk: DataFrame) -> list:
    return [F.col(c) for c in ("peak", "factor", "direction") if c in risk.columns]


def top_risk_per_group(
    risk: DataFrame, n: int = 20, *, by: str = "risk_total", keys: Sequence[str] = ("factor", "direction")
) -> DataFrame:
    """The n rows with the largest `by` in each group."""
    require_columns(risk, [by, *keys], "risk table")
    order = [number(by).desc_nulls_last(), *_row_order(risk)]
    return first_k_per_group(risk, list(keys), order, n, ["peak"])


def best_per_peak(risk: DataFrame, value: str = "risk_total", peak: str = "peak") -> DataFrame:
    """For each peak the row with its largest value (first factor and direction on ties)."""
    require_columns(risk, [peak, value, "factor", "direction"], "risk table")
    v = number(value)
    others = [c for c in risk.columns if c != peak]
    best = F.min_by(F.struct(*others), F.struct((-v).alias("v"), "factor", "direction"))
    rows = risk.where(v.isNotNull()).groupBy(peak).agg(best.alias("_r"))
    return rows.select(peak, *[F.col(f"_r.`{c}`").alias(c) for c in others])


def chromosome_offsets(rows: DataFrame, end: str = "end") -> DataFrame:
    """Running offset of every chromosome: the lengths of those before it, plus 1 each.

    One row per chromosome present; the running sum runs over that table.
    """
    spans = rows.groupBy("chrom").agg(F.max(end).alias("_end"), F.min("start").alias("_lo"))
    earlier = Window.orderBy(*chrom_sort_key("chrom")).rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(F.col("_end") + 1).over(earlier), F.lit(0))
    return spans.select("chrom", offset.alias("offset"))


def risk_track(
    risk: DataFrame, *, value: str = "risk_total", factors: Sequence[str] | None = None
) -> DataFrame:
    """Genome-wide track: ``x`` is start plus the chromosome's offset, ``y`` the value.

    Without `factors` each peak shows its best row; with them, every row of those factors.
    """
    require_columns(risk, ["peak", "chrom", "start", "factor", "direction", value], "risk table")
    if factors is not None:
        rows = keep_subset(risk, "factor", list(factors))
    else:
        require_rows(risk, "no rows to plot")
        rows = best_per_peak(risk, value)
    rows = materialize(rows)
    offsets = chromosome_offsets(rows, "end" if "end" in rows.columns else "start")
    return rows.join(broadcast_if_small(offsets), "chrom").select(
        "peak",
        "chrom",
        "start",
        "factor",
        "direction",
        (F.col("offset") + F.col("start")).alias("x"),
        F.col(value).cast("double").alias("y"),
    )


def track_ticks(track: DataFrame) -> DataFrame:
    """One tick per chromosome: its offset plus the median start."""
    track = materialize(track.select("chrom", "start", "x"))
    offsets = track.groupBy("chrom").agg(F.min(F.col("x") - F.col("start")).alias("offset"))
    middle = quantiles(track, "start", {"middle": 0.5}, ["chrom"]).drop("n")
    return offsets.join(middle, "chrom").select("chrom", (F.col("offset") + F.col("middle")).alias("tick"))
