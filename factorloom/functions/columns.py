"""Scalar expressions used by the operators and useful on their own."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from factorloom.guards import number

# The spellings of a flag, and the suffix that marks a direction.
_TRUE = ("true", "1")
_FALSE = ("false", "0")
_DIRECTION_SUFFIX = {"pos": "+", "neg": "-", "combined": ""}

# Fixed value: name pattern of an interval on a primary chromosome.
_PRIMARY = r"^chr([1-9]|1[0-9]|2[0-2]|X|Y):\d+-\d+$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def relu(c: Column | str) -> Column:
    """max(x, 0)."""
    return F.greatest(_col(c), F.lit(0.0))


def safe_ratio(num: Column | str, den: Column | str) -> Column:
    """num / den, NULL where the denominator is 0."""
    return F.try_divide(_col(num).cast("double"), _col(den).cast("double"))


def p_one_tailed(z: Column | str, tail: str = "upper") -> Column:
    """One-tailed normal p-value of a z-score; NULL or NaN stays NULL.

    The tail probability is half of the complementary error function of z / sqrt(2), taken
    from the math library on Spark's own class path so no Python worker is involved.
    """
    if tail not in ("upper", "lower"):
        raise ValueError(f"unknown tail {tail!r}; there are upper and lower")
    z = _col(z).cast("double")
    usable = z.isNotNull() & ~F.isnan(z)
    arg = F.coalesce(z, F.lit(0.0)) * F.lit((1.0 if tail == "upper" else -1.0) / math.sqrt(2.0))
    erfc = F.reflect(
        F.lit("org.apache.commons.math3.special.Erf"), F.lit("erfc"), arg
    ).cast("double")
    return F.when(usable, erfc * 0.5)


def significant(q: Column | str, alpha: float = 0.05) -> Column:
    """q < alpha, false where q is missing."""
    return F.coalesce(number(q) < F.lit(alpha), F.lit(False))


def _cuts(thresholds: Sequence[float]) -> list[float]:
    """The thresholds as numbers; none at all, or one below its predecessor, raises."""
    cuts = [float(t) for t in thresholds]
    if not cuts or sorted(cuts) != cuts:
        raise ValueError(f"significance needs ascending thresholds, not {cuts}")
    return cuts


def significance_class(q: Column | str, thresholds: Sequence[float] = (0.05, 0.10)) -> Column:
    """How many thresholds q reaches: 0 is the most significant class; NULL and infinite q are in the last."""
    cuts, v = _cuts(thresholds), number(q)
    reached = sum(((v >= F.lit(t)).cast("int") for t in cuts), F.lit(0))
    return F.when(v.isNull() | (F.abs(v) == F.lit(float("inf"))), F.lit(len(cuts))).otherwise(reached)


def significance_labels(thresholds: Sequence[float] = (0.05, 0.10), name: str = "BH q") -> list[str]:
    """Display names of the classes of `significance_class`, by class number."""
    cuts = _cuts(thresholds)
    return [f"{name} < {t:g}" for t in cuts] + [f"{name} >= {cuts[-1]:g}"]


def parse_interval(name: Column | str) -> tuple[Column, Column, Column]:
    """(chrom, start, end) of a ``chrom:start-end`` name; a malformed number raises."""
    n = _col(name).cast("string")
    span = F.split_part(n, F.lit(":"), F.lit(2))
    return (
        F.split_part(n, F.lit(":"), F.lit(1)),
        F.split_part(span, F.lit("-"), F.lit(1)).cast("bigint"),
        F.split_part(span, F.lit("-"), F.lit(2)).cast("bigint"),
    )


def interval_name(chrom: Column | str, start: Column | str, end: Column | str) -> Column:
    """Canonical ``chrom:start-end`` spelling."""
    return F.concat(
        _col(chrom).cast("string"),
        F.lit(":"),
        _col(start).cast("bigint").cast("string"),
        F.lit("-"),
        _col(end).cast("bigint").cast("string"),
    )


def is_primary_interval(name: Column | str, pattern: str = _PRIMARY) -> Column:
    """Whether a name is a canonical interval on a primary chromosome."""
    return _col(name).rlike(pattern)


def bare_chrom(chrom: Column | str) -> Column:
    """Chromosome label without a leading ``chr`` in any case."""
    return F.regexp_replace(_col(chrom).cast("string"), "(?i)^chr", "")


def chrom_sort_key(chrom: Column | str) -> list[Column]:
    """Sort columns: numbered chromosomes in numeric order, then the others by name."""
    bare = bare_chrom(chrom)
    numbered = bare.rlike("^[0-9]+$")
    return [
        F.when(numbered, 0).otherwise(1).alias("_chrom_class"),
        F.when(numbered, bare.try_cast("bigint")).alias("_chrom_number"),
        bare.alias("_chrom_name"),
    ]


def strict_bool(flag: Column | str) -> Column:
    """true/false/1/0 in any case as a boolean; anything else NULL (see `require_bool`)."""
    text = F.lower(F.trim(_col(flag).cast("string")))
    return F.when(text.isin(*_TRUE), F.lit(True)).when(text.isin(*_FALSE), F.lit(False))


def direction_label(
    factor: Column | str,
    direction: Column | str | None = None,
    titles: Mapping[str, str] | None = None,
) -> Column:
    """Display name of a factor: its title if one is given, plus ``+``/``-`` by direction."""
    name = _col(factor).cast("string")
    if titles:
        pairs = [F.lit(v) for kv in titles.items() for v in kv]
        name = F.coalesce(F.try_element_at(F.create_map(*pairs), name), name)
    if direction is None:
        return name
    pairs = [F.lit(v) for kv in _DIRECTION_SUFFIX.items() for v in kv]
    suffix = F.try_element_at(F.create_map(*pairs), _col(direction).cast("string"))
    return F.concat(name, F.coalesce(suffix, F.lit("")))


def dot(x: Column | str, weights: Sequence[float], positions: Sequence[int] | None = None) -> Column:
    """Sum of ``x[positions[i]] * weights[i]`` over an array column, in double.

    Positions that are not named do not count, whatever their value. The weights are one
    constant array, so the expression stays small for any number of factors.
    """
    x = _col(x)
    positions = range(len(weights)) if positions is None else positions
    if not len(weights):
        return F.lit(0.0)
    at = dict(zip((int(p) for p in positions), weights, strict=True))
    row = F.array(*[F.lit(float(at[i])) if i in at else F.lit(None).cast("double") for i in range(max(at) + 1)])
    named = F.slice(x, 1, max(at) + 1)
    terms = F.zip_with(named, row, lambda v, w: F.when(w.isNotNull(), v.cast("double") * w).otherwise(0.0))
    return F.aggregate(terms, F.lit(0.0), lambda total, v: total + v)
