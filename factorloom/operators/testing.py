"""Multiple-testing correction within families of tests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.functions import p_one_tailed, significant
from factorloom.guards import finite, require_columns
from factorloom.operators.ordered import KEY, join_values, keyed, positions, running, unkeyed, value_ranks
from factorloom.session import materialize

Z_COLUMN = "Coefficient_z-score"


def _keys(by: str | Sequence[str] | None) -> list[str]:
    return [] if by is None else [by] if isinstance(by, str) else list(by)


def _bt(name: str) -> Column:
    return F.col(f"`{name}`")


def bh_qvalues(
    df: DataFrame,
    p: str,
    *,
    by: str | Sequence[str] | None = None,
    n: int | None = None,
    out: str = "fdr_q",
) -> DataFrame:
    """Benjamini-Hochberg q of column `p` inside each family of `by`.

    A missing p gets q = 1 and is not counted. `n` overrides the number of tests and must
    not be smaller than the number of finite p-values of any family. Equal p-values share
    their q, so the work runs on distinct p-values with counts: their cumulative count is
    the rank, and a running minimum from the largest p down makes q monotone.

    The rows are written once: q comes back to them by equal p, and sums of doubles computed a
    second time may differ in their last digit.
    """
    keys = _keys(by)
    require_columns(df, [p, *keys])
    rows = materialize(df.withColumn("_p", finite(_bt(p))))
    ranks = value_ranks(rows, "_p", keys)
    if n is not None:
        most = ranks.agg(F.max("total")).first()[0] or 0
        if n < most:
            raise ValueError(f"n={n} is smaller than the {most} finite p-values of a family")
    tests = F.col("total") if n is None else F.lit(int(n))
    scaled = ranks.withColumn("_scaled", F.col("_p") * tests / F.col("upto"))
    q = running(scaled, [F.col("_p").desc()], {"_q": ("min", "_scaled")}, reverse=True)
    q = q.select(KEY, "_p", "n", F.greatest(F.least("_q", F.lit(1.0)), F.lit(0.0)).alias("_q"))
    joined = join_values(keyed(rows, keys), q, "_p")
    return joined.withColumn(out, F.coalesce("_q", F.lit(1.0))).drop(KEY, "_p", "_q")


def add_fdr(
    df: DataFrame,
    *,
    by: str | Sequence[str] | None = None,
    z_col: str = Z_COLUMN,
    p_col: str = "p_1tailed",
    q_col: str = "fdr_q",
    n: int | None = None,
    tail: str = "upper",
) -> DataFrame:
    """One-tailed p of `z_col` and its BH q inside each family of `by`."""
    require_columns(df, [z_col, *_keys(by)])
    return bh_qvalues(df.withColumn(p_col, p_one_tailed(_bt(z_col), tail)), p_col, by=by, n=n, out=q_col)


def legacy_bh_qvalues(
    df: DataFrame,
    p: str,
    *,
    order: Sequence[str],
    by: str | Sequence[str] | None = None,
    out: str = "q_legacy",
) -> DataFrame:
    """p * m / rank clipped to [0, 1], without the monotone step; for comparison only.

    m counts every row, missing p included. Ties rank in the order of the columns `order`,
    which must identify rows.
    """
    keys = _keys(by)
    require_columns(df, [p, *order, *keys])
    rows = df.withColumn("_p", finite(_bt(p)))
    ranked = positions(rows, [F.col("_p").asc_nulls_last(), *order], "_r", keys)
    ranked = keyed(ranked, keys)
    tests = ranked.groupBy(KEY).agg(F.count(F.lit(1)).alias("_m"))
    scaled = F.col("_p") * F.col("_m") / (F.col("_r") + 1)
    return (
        ranked.join(tests, KEY)
        .withColumn(out, F.greatest(F.least(scaled, F.when(F.col("_p").isNotNull(), 1.0)), F.lit(0.0)))
        .withColumn(out, F.when(F.col("_p").isNotNull(), F.col(out)))
        .drop(KEY, "_p", "_r", "_m")
    )


def compare_bh(
    df: DataFrame,
    p: str,
    *,
    order: Sequence[str],
    by: str | Sequence[str] | None = None,
    n: int | None = None,
    alpha: float = 0.05,
) -> DataFrame:
    """Correct and legacy q side by side: q_correct, q_legacy, delta, flips_at_05."""
    both = legacy_bh_qvalues(
        bh_qvalues(df, p, by=by, n=n, out="q_correct"), p, order=order, by=by
    )
    return both.withColumn("delta", F.col("q_correct") - F.col("q_legacy")).withColumn(
        "flips_at_05", significant("q_correct", alpha) != significant("q_legacy", alpha)
    )


def bh_boundary(
    df: DataFrame,
    *,
    q: str = "fdr_q",
    z: str = Z_COLUMN,
    by: str | Sequence[str] | None = None,
    alpha: float = 0.05,
    tail: str = "upper",
    out: str = "z_boundary",
) -> DataFrame:
    """Least extreme z still passing at `alpha` per family; NULL where nothing passes."""
    if tail not in ("upper", "lower"):
        raise ValueError(f"unknown tail {tail!r}; there are upper and lower")
    keys = _keys(by)
    require_columns(df, [q, z, *keys])
    passing = F.when(finite(_bt(q)) < F.lit(alpha), finite(_bt(z)))
    best = F.min(passing) if tail == "upper" else F.max(passing)
    return unkeyed(keyed(df, keys).groupBy(KEY).agg(best.alias(out)), keys, out)

