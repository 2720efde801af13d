"""Factors as array columns: directional arms, statistics, selection, ordering."""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.functions import relu, strict_bool
from factorloom.guards import number, require_columns, require_none


def with_factor_column(df: DataFrame) -> DataFrame:
    """Accept a table that still calls its factor column ``dim``."""
    if "factor" in df.columns or "dim" not in df.columns:
        return df
    warnings.warn("column `dim` is now `factor`", DeprecationWarning, stacklevel=2)
    return df.withColumnRenamed("dim", "factor")


def _suffixes(naming: str) -> tuple[str, str]:
    if naming not in ("suffix", "signed"):
        raise ValueError(f"unknown naming {naming!r}; there are suffix and signed")
    return ("_pos", "_neg") if naming == "suffix" else ("+", "-")


def as_doubles(x: Column | str) -> Column:
    """Array elements as double."""
    return (F.col(x) if isinstance(x, str) else x).cast("array<double>")


def split_directions(
    df: DataFrame, x: str, names: Sequence[str], *, naming: str = "suffix"
) -> tuple[DataFrame, list[str]]:
    """`x` replaced by its non-negative arms: all positive ones, then all negative ones."""
    pos, neg = _suffixes(naming)
    names = [str(n) for n in names]
    require_columns(df, [x])
    bad = df.where(F.size(x) != len(names)).select(F.size(x).alias("width"))
    require_none(bad, "width", f"{len(names)} names but another number of values")
    arms = F.concat(
        F.transform(as_doubles(x), lambda v: relu(v)),
        F.transform(as_doubles(x), lambda v: relu(-v)),
    )
    return df.withColumn(x, arms), [n + pos for n in names] + [n + neg for n in names]


def loadings_long(
    df: DataFrame, x: str, names: Sequence[str], keep: Sequence[str] = (), value: str = "value"
) -> DataFrame:
    """One row per (row, factor): the `keep` columns, factor, pos and value in double."""
    labels = F.array(*[F.lit(str(n)) for n in names])
    return df.select(*keep, F.posexplode(as_doubles(x)).alias("pos", value)).withColumn(
        "factor", labels[F.col("pos")]
    )


def directions_long(df: DataFrame, value: str, directions: Sequence[str] = ("pos", "neg")) -> DataFrame:
    """One row per direction of each row of a long table, `value` replaced by its arm."""
    arm = {"pos": relu(value), "neg": relu(-F.col(value)), "combined": F.col(value)}
    arms = F.array(*[F.struct(F.lit(d).alias("direction"), arm[d].alias(value)) for d in directions])
    others = [c for c in df.columns if c != value]
    return df.select(*others, F.inline(arms))


def factor_stats(df: DataFrame, x: str, names: Sequence[str], *, threshold: float) -> DataFrame:
    """Per factor: min, max, max_abs, mean, std (population), mean_abs and vanished flags.

    One scan with map-side aggregation down to one row per factor.
    """
    long = loadings_long(df, x, names).withColumn("value", number("value"))
    v = F.col("value")
    stats = long.groupBy("pos", "factor").agg(
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.max(F.abs(v)).alias("max_abs"),
        F.avg(v).alias("mean"),
        F.stddev_pop(v).alias("std"),
        F.avg(F.abs(v)).alias("mean_abs"),
    )
    return stats.withColumn("vanished", F.col("max_abs") < F.lit(threshold)).withColumn(
        "vanished_positive_direction", F.col("max") < F.lit(threshold)
    )


def require_bool(df: DataFrame, flag: str) -> DataFrame:
    """`df` with `flag` as a boolean; a value that is no flag raises naming it."""
    if dict(df.dtypes)[flag] == "boolean":
        return df
    bad = df.where(strict_bool(flag).isNull()).select(F.col(flag).cast("string").alias(flag)).distinct()
    require_none(bad, flag, f"non-boolean values in `{flag}`")
    return df.withColumn(flag, strict_bool(flag))


def select_factors(
    stats: DataFrame,
    names: Sequence[str],
    *,
    exclude_vanished: bool = True,
    exclude: Iterable[str] = (),
    factor: str = "factor",
) -> DataFrame:
    """Factor map: factor, pos, vanished, kept, drop_reason, annot_index, negative_only.

    `names` sets order and membership. ``annot_index`` counts the kept factors from 1.
    ``negative_only`` marks a factor that is live in its negative direction alone. The
    table has one row per factor, the width of an array column.
    """
    require_columns(stats, [factor, "vanished"])
    names, exclude = [str(n) for n in names], {str(e) for e in exclude}
    spark = stats.sparkSession
    given = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "factor string, pos int")
    flags = require_bool(stats, "vanished")
    pos_flag = "vanished_positive_direction"
    if pos_flag in stats.columns:
        flags = require_bool(flags, pos_flag)
    flags = flags.select(
        F.col(factor).cast("string").alias("factor"),
        "vanished",
        (F.col(pos_flag) if pos_flag in stats.columns else F.col("vanished")).alias("_pv"),
    )
    require_none(
        flags.join(given, "factor", "full_outer").where("pos is null or vanished is null"),
        "factor",
        "statistics and loadings do not describe the same factors",
    )
    unknown = sorted(exclude - set(names))
    if unknown:
        raise ValueError(f"exclude names unknown factors: {unknown}")
    excluded = F.col("factor").isin(*sorted(exclude)) if exclude else F.lit(False)
    reason = F.when(excluded, "exclude_dims").otherwise("")
    if exclude_vanished:
        reason = F.when(F.col("vanished"), "vanished").otherwise(reason)
    fmap = given.join(flags, "factor").withColumn("drop_reason", reason)
    fmap = fmap.withColumn("kept", F.col("drop_reason") == "")
    if fmap.where("kept").isEmpty():
        raise ValueError("every factor was excluded; nothing is left to enrich")
    index = F.row_number().over(Window.partitionBy("kept").orderBy("pos"))
    return fmap.select(
        "factor",
        "pos",
        "vanished",
        "kept",
        "drop_reason",
        F.when(F.col("kept"), index).alias("annot_index"),
        (F.col("vanished") != F.col("_pv")).alias("negative_only"),
    )


def kept_factors(fmap: DataFrame) -> list[str]:
    """Kept factor names in annotation order (one row per factor is fetched)."""
    return [r["factor"] for r in fmap.where("kept").orderBy("annot_index").select("factor").collect()]


def kept_positions(fmap: DataFrame) -> list[int]:
    """Array positions of the kept factors in annotation order."""
    return [r["pos"] for r in fmap.where("kept").orderBy("annot_index").select("pos").collect()]


def kept_loadings(df: DataFrame, x: str, fmap: DataFrame) -> tuple[DataFrame, list[str]]:
    """`x` cut down to the kept factors in annotation order, signed; and their names.

    Works on cells x factors and on regions x factors alike.
    """
    require_columns(df, [x])
    keep = kept_positions(fmap)
    picked = F.array(*[F.col(x)[int(p)] for p in keep])
    return df.withColumn(x, picked), kept_factors(fmap)


def kept_loadings_long(df: DataFrame, fmap: DataFrame, factor: str = "factor") -> DataFrame:
    """Rows of a long loadings table whose factor is kept, with its annotation index."""
    kept = fmap.where("kept").select(F.col("factor").alias(factor), "annot_index")
    # One row per factor.
    return df.join(F.broadcast(kept), factor)


def directional_factor_table(
    factors: DataFrame, *, title: str = "title", order: str = "order", naming: str = "signed"
) -> DataFrame:
    """One row per (factor, direction): titles with +/-, order nudged so that - precedes +.

    Limits follow the arm: the positive one spans 0 to max(max, 0), the negative one 0 to
    max(-min, 0).
    """
    pos, neg = _suffixes(naming)
    require_columns(factors, ["factor", "min", "max", title, order])

    def arm(sign: str, name: str, nudge: float, top: Column) -> DataFrame:
        return factors.select(
            F.concat(F.col("factor").cast("string"), F.lit(name)).alias("arm"),
            "factor",
            F.lit("pos" if sign == "+" else "neg").alias("direction"),
            F.concat(F.col(title).cast("string"), F.lit(sign)).alias(title),
            (F.col(order) + F.lit(nudge)).alias(order),
            F.lit(0.0).alias("min"),
            relu(top).alias("max"),
        )

    return arm("+", pos, 1e-8, F.col("max")).unionByName(arm("-", neg, -1e-8, -F.col("min")))


def factor_limits(
    factors: DataFrame, *, thresholds: tuple[float, float] | None = (-1.0, 1.0), directional: bool = True
) -> DataFrame:
    """Display limits vmin and vmax per row of a factor table, widened to `thresholds`."""
    require_columns(factors, ["min", "max"])
    low, high = F.col("min").cast("double"), F.col("max").cast("double")
    if directional:
        floor = (thresholds or (0.0, 0.0))[1]
        low, high = F.lit(0.0), F.greatest(high, F.lit(float(floor)))
    elif thresholds is not None:
        low = F.least(low, F.lit(float(thresholds[0])))
        high = F.greatest(high, F.lit(float(thresholds[1])))
    return factors.withColumn("vmin", low).withColumn("vmax", high)


def keep_subset(df: DataFrame, column: str, names: Sequence[str]) -> DataFrame:
    """Rows whose `column` is one of `names`; an unknown name or an empty result raises."""
    if not names:
        raise ValueError("no names were asked for")
    kept = df.where(F.col(column).isin(*names))
    found = {r[0] for r in kept.select(column).distinct().limit(len(set(names)) + 1).collect()}
    missing = sorted(set(names) - found)
    if missing:
        raise KeyError(f"no rows for {missing}")
    return kept


def order_by_specificity(
    factors: DataFrame, scores: DataFrame, *, key: str = "factor", score: str = "specificity"
) -> DataFrame:
    """Factors with their score, highest first, missing last, ties in factor order.

    `factors` has ``pos``; the score table is keyed by factor name, or by title if every
    title has a score and some name has none.
    """
    require_columns(scores, [key, score])
    keyed_scores = scores.select(F.col(key).alias("_key"), number(score).alias(score))
    column = "factor"
    if not _all_scored(factors, "factor", keyed_scores):
        if "title" not in factors.columns or not _all_scored(factors, "title", keyed_scores):
            lost = factors.join(keyed_scores, F.col("factor") == F.col("_key"), "left_anti")
            require_none(lost, "factor", f"{score} has no value for some factors", KeyError)
        column = "title"
    joined = factors.join(keyed_scores, F.col(column) == F.col("_key")).drop("_key")
    return joined.orderBy(F.col(score).desc_nulls_last(), "pos")


def _all_scored(factors: DataFrame, column: str, scores: DataFrame) -> bool:
    return factors.join(scores, F.col(column) == F.col("_key"), "left_anti").isEmpty()


def order_by_peak_row(df: DataFrame, x: str, names: Sequence[str], row: str) -> DataFrame:
    """Factors with the row (first on ties) that holds their largest |x|, in row order."""
    long = loadings_long(df, x, names, [row])
    best = F.max(F.struct(F.abs("value").alias("a"), (-F.col(row)).alias("r")))
    top = long.groupBy("pos", "factor").agg(best.alias("_b"))
    return top.select("factor", "pos", (-F.col("_b.r")).alias(row), F.col("_b.a").alias("max_abs")).orderBy(
        row, "pos"
    )


def rank_by_statistic(
    factors: DataFrame, column: str, *, order: str = "order", drop_vanished: bool = True
) -> DataFrame:
    """Rank-against-value table of one factor statistic.

    Rows in `order`, without vanished factors by default; ``log_scale`` says whether every
    finite value is above 0. Raises if `column` is missing.
    """
    require_columns(factors, [order, "vanished", column], "factor table")
    flags = require_bool(factors, "vanished")
    rows = flags.where(~F.col("vanished")) if drop_vanished else flags
    lowest = rows.agg(F.min(number(column)).alias("low")).first()["low"]
    return rows.select(
        "factor",
        F.col(order).cast("double").alias("rank"),
        F.col(column).cast("double").alias("value"),
        "vanished",
        F.lit(lowest is not None and lowest > 0).alias("log_scale"),
    ).orderBy("rank")
