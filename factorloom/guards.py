"""Input checks shared by the operators. A missing input is an error, never a skip."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, columns: Iterable[str], what: str = "table") -> None:
    """Raise KeyError naming the columns `df` lacks."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"{missing} not in the {what}; columns are {df.columns}")


def require_rows(df: DataFrame, message: str) -> None:
    """Raise ValueError if `df` has no row."""
    if df.isEmpty():
        raise ValueError(message)


def examples(df: DataFrame, column: str, n: int = 5) -> list:
    """Up to `n` values of `column`, for an error message."""
    return [r[0] for r in df.select(column).limit(n).collect()]


def require_none(bad: DataFrame, column: str, message: str, error: type = ValueError) -> None:
    """Raise `error` with a few values of `column` if `bad` has any row."""
    found = examples(bad, column)
    if found:
        raise error(f"{message}, e.g. {found}")


def require_unique(df: DataFrame, keys: Sequence[str], message: str) -> None:
    """Raise ValueError if `keys` do not identify rows of `df`."""
    repeated = df.groupBy(*keys).count().where("count > 1")
    found = repeated.select(F.concat_ws("/", *[F.col(k).cast("string") for k in keys])).limit(5)
    found = [r[0] for r in found.collect()]
    if found:
        raise ValueError(f"{message}, e.g. {found}")


def number(column: Column | str) -> Column:
    """A numeric column as double with NaN as NULL."""
    c = (F.col(column) if isinstance(column, str) else column).cast("double")
    return F.when(~F.isnan(c), c)


def finite(column: Column | str) -> Column:
    """A numeric column as double with NaN and both infinities as NULL."""
    c = (F.col(column) if isinstance(column, str) else column).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)
