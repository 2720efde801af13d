"""Joins between points and intervals and between intervals.

Intervals are ``[start, end)`` on a chromosome. A range condition alone has no join key, so
coordinates are cut into bins. Intervals of very different length are handled by levels: an
interval's *home* level has bins at least as long as the interval, so it touches at most two
of them, and a shorter partner climbs to that level. The join key is then (chromosome,
level, bin), and no interval is copied more than twice per level.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from factorloom.functions import bare_chrom
from factorloom.guards import require_columns, require_none, require_rows, require_unique
from factorloom.operators.ordered import by_order, keyed, running
from factorloom.session import materialize

#: log2 of the bin length of each level; the last one takes any length.
LEVELS = (9, 12, 15, 18, 21, 24, 27, 30, 33, 40, 62)

#: Home levels of disjoint intervals up to this many bits apart share the coarsest one.
NEAR_LEVELS = 6


def _home(length: Column) -> Column:
    level = F.lit(LEVELS[-1])
    for bits in reversed(LEVELS[:-1]):
        level = F.when(length <= F.lit(1 << bits), F.lit(bits)).otherwise(level)
    return level


def _bin(position: Column, bits: int) -> Column:
    return F.shiftright(position, bits)


def _levels(df: DataFrame) -> list[int]:
    """Home levels that occur (at most ten values are fetched)."""
    return sorted(r[0] for r in df.select("_home").distinct().collect())


def _place(level: int, position: Column, role: str) -> Column:
    return F.struct(
        F.lit(role).alias("_role"), F.lit(level).alias("_level"), _bin(position, level).alias("_bin")
    )


def _keys(first: Column, last: Column, own: Sequence[int], climb: Sequence[int], home_role: str,
          climb_role: str, strict: bool) -> Column:
    """Join keys of an interval: its home bins in one role, every higher level in the other."""
    slots = []
    for level in own:
        here = F.col("_home") == level
        slots.append(F.when(here, F.array(_place(level, first, home_role), _place(level, last, home_role))))
    for level in climb:
        above = F.col("_home") < level if strict else F.col("_home") <= level
        slots.append(F.when(above, F.array(_place(level, first, climb_role), _place(level, last, climb_role))))
    return F.array_distinct(F.flatten(F.array_compact(F.array(*slots))))


def overlap_pairs(
    left: DataFrame,
    right: DataFrame,
    *,
    chrom: str = "chrom",
    start: str = "start",
    end: str = "end",
) -> DataFrame:
    """Every pair of a left and a right interval that share at least one base.

    Columns of the right side get the suffix ``_2``; ``overlap`` is the shared length. Zero
    length intervals overlap nothing.
    """
    for side, what in ((left, "left table"), (right, "right table")):
        require_columns(side, [chrom, start, end], what)
    length = F.col(end) - F.col(start)
    a = left.where(F.col(end) > F.col(start)).withColumn("_home", _home(length))
    b = right.where(F.col(end) > F.col(start)).withColumn("_home", _home(length))
    la, lb = _levels(a), _levels(b)
    first, last = F.col(start), F.col(end) - 1
    # Role r: the right interval is at home and the left one climbs (or is as long). Role l:
    # the left one is at home and strictly longer than the right one's level.
    a = a.withColumn("_key", F.explode(_keys(first, last, la, lb, "l", "r", strict=False)))
    b = b.withColumn("_key", F.explode(_keys(first, last, lb, la, "r", "l", strict=True)))
    a = a.select(*left.columns, F.col("_key._role"), F.col("_key._level"), F.col("_key._bin"))
    b = b.select(
        *[F.col(c).alias(f"{c}_2") for c in right.columns],
        F.col("_key._role").alias("_role_2"),
        F.col("_key._level").alias("_level_2"),
        F.col("_key._bin").alias("_bin_2"),
    )
    s1, e1, s2, e2 = (F.col(c) for c in (start, end, f"{start}_2", f"{end}_2"))
    first_shared = F.greatest(s1, s2)
    shift = F.expr("shiftright(greatest(`%s`, `%s_2`), _level)" % (start, start))
    met = (
        (F.col(chrom) == F.col(f"{chrom}_2"))
        & (F.col("_role") == F.col("_role_2"))
        & (F.col("_level") == F.col("_level_2"))
        & (F.col("_bin") == F.col("_bin_2"))
        & (s1 < e2)
        & (s2 < e1)
        & (F.col("_bin") == shift)
    )
    # Sizes of files say little of the keys made above: a side that looks small would be built as a
    # hash table in the driver and in every task.
    return a.join(b.hint("merge"), met).select(
        *left.columns,
        *[f"{c}_2" for c in right.columns],
        (F.least(e1, e2) - first_shared).alias("overlap"),
    )


def check_disjoint(
    intervals: DataFrame,
    *,
    name: str = "peak",
    chrom: str = "chrom",
    start: str = "start",
    end: str = "end",
) -> None:
    """Raise naming two intervals of one chromosome that overlap (runs its own jobs).

    Sorted by start, an interval overlaps an earlier one exactly if it starts before the
    largest end so far; that running maximum is carried across range partitions.
    """
    rows = intervals.where(F.col(end) > F.col(start)).select(name, chrom, start, end)
    order = [start, end, name]
    placed = keyed(by_order(rows, [chrom, *order]), [chrom])
    seen = running(placed, [F.col(c) for c in order], {"_reach": ("max", end)}, before=True)
    bad = seen.where(F.col(start) < F.col("_reach")).orderBy(chrom, *order).limit(1).collect()
    if not bad:
        return
    later = bad[0]
    s, e, n = (F.col(c) for c in order)
    before = (s < later[start]) | (
        (s == later[start]) & ((e < later[end]) | ((e == later[end]) & (n < later[name])))
    )
    reaching = (F.col(chrom) == later[chrom]) & (e > later[start])
    earlier = rows.where(reaching & before).orderBy(*order).first()
    raise ValueError(f"peaks must not overlap: {earlier[name]} and {later[name]}")


def assign_points(
    points: DataFrame,
    intervals: DataFrame,
    *,
    row: str = "row_ix",
    point_chrom: str = "chrom",
    bp: str = "bp",
    name: str = "peak",
    chrom: str = "chrom",
    start: str = "start",
    end: str = "end",
    carry: Sequence[str] = (),
    checked: bool = False,
) -> DataFrame:
    """Every point with the one interval that holds it, or NULL.

    Positions are 1-based: a point lies in an interval if ``start < bp <= end``. Chromosome
    labels match without their ``chr``. Intervals must be disjoint, on every chromosome and
    whatever the points are; `checked` skips that test when the caller has run it. An
    interval with a NULL coordinate is never assigned. Columns named in `carry` come along
    from the interval, which saves a second join of the points.
    """
    require_columns(points, [row, point_chrom, bp], "points")
    require_columns(intervals, [name, chrom, start, end], "intervals")
    require_rows(intervals, "points need at least one interval; the table holds none")
    kept = intervals.select(
        F.col(name).alias("_name"),
        bare_chrom(chrom).alias("_c"),
        F.col(start).cast("bigint").alias("_s"),
        F.col(end).cast("bigint").alias("_e"),
        *carry,
    ).where("_s is not null and _e is not null and _e > _s")
    if not checked:
        check_disjoint(kept, name="_name", chrom="_c", start="_s", end="_e")
    kept = kept.withColumn("_home", _home(F.col("_e") - F.col("_s")))
    levels = _levels(kept)
    if not levels:
        kinds = dict(kept.dtypes)
        gone = [F.lit(None).cast(kinds[c]).alias(c) for c in carry]
        return points.select("*", F.lit(None).cast(kinds["_name"]).alias(name), *gone)
    if levels[-1] - levels[0] <= NEAR_LEVELS:
        # Disjoint intervals of similar length: few share a bin of the coarsest level, so a
        # point needs one look-up and its row is shuffled once.
        levels = levels[-1:]
        kept = kept.withColumn("_home", F.lit(levels[0]))
    base = F.col(bp) - 1
    rows = points.withColumn("_pc", bare_chrom(point_chrom))
    # Disjoint intervals: a bin holds no more of them than it has bases, and at each level a
    # point meets one bin. With one level the join is direct, else one pass over all levels.
    places = F.array_distinct(
        F.array(
            *[F.struct(F.lit(v).alias("l"), _bin(p, v).alias("b")) for v in levels for p in (F.col("_s"), F.col("_e") - 1)]
        )
    )
    binned = kept.withColumn("_at", F.explode(places)).where("_at.l = _home")
    binned = binned.select("_name", *carry, "_c", "_s", "_e", F.col("_at.l").alias("_l"), F.col("_at.b").alias("_b"))
    inside = (F.col("_pc") == F.col("_c")) & (base >= F.col("_s")) & (base < F.col("_e"))
    if len(levels) == 1:
        met = inside & (_bin(base, levels[0]) == F.col("_b"))
        return rows.join(binned, met, "left").select(*points.columns, F.col("_name").alias(name), *carry)
    at = F.explode(F.array(*[F.struct(F.lit(v).alias("l"), _bin(base, v).alias("b")) for v in levels]))
    looked_up = rows.select(row, "_pc", bp, at.alias("_pt"))
    met = inside & (F.col("_pt.l") == F.col("_l")) & (F.col("_pt.b") == F.col("_b"))
    hits = looked_up.join(binned, met).select(row, F.col("_name").alias(name), *carry)
    return points.join(hits, row, "left")


def interval_counts(
    points: DataFrame,
    intervals: DataFrame,
    *,
    name: str = "peak",
    out: str = "n_snps",
    **columns: str | bool,
) -> DataFrame:
    """Number of points in every interval, 0 included."""
    hit = assign_points(points, intervals, name=name, **columns).where(F.col(name).isNotNull())
    counts = hit.groupBy(name).agg(F.count(F.lit(1)).alias(out))
    return intervals.select(name).join(counts, name, "left").select(
        name, F.coalesce(out, F.lit(0)).alias(out)
    )


def restrict_to_reference(
    table: DataFrame, reference: DataFrame, *, key: str = "snp", order: str = "ref_ix"
) -> DataFrame:
    """Rows of `table` listed in `reference`, with the reference's order column.

    A listed key the table lacks raises.
    """
    require_columns(table, [key])
    require_columns(reference, [key, order], "reference list")
    lost = reference.join(table.select(key).distinct(), key, "left_anti")
    require_none(lost, key, "reference keys missing from the table")
    return table.join(reference.select(key, order), key)


@dataclass(frozen=True)
class RegionMap:
    """Pairs (region, feature, overlap) and how much of both tables they reach."""

    pairs: DataFrame
    coverage: dict[str, int]


def _named_once(df: DataFrame, name: str, message: str) -> int:
    """Number of rows; a repeated name raises. Both come from one aggregation by name."""
    seen = Observation()
    names = df.groupBy(name).agg(F.count(F.lit(1)).alias("_c")).observe(
        seen, F.sum("_c").alias("rows"), F.max("_c").alias("most")
    )
    names.write.format("noop").mode("overwrite").save()
    if (seen.get.get("most") or 0) > 1:
        require_unique(df, [name], message)
    return seen.get.get("rows") or 0


def map_regions(
    features: DataFrame,
    regions: DataFrame,
    *,
    feature: str = "peak",
    region: str = "region",
    fraction: float = 0.4,
) -> RegionMap:
    """`region_map` with its coverage: matched and total counts of regions and features.

    Totals are seen while names are checked. The pairs are written once; matched names are
    counted in what was written, so neither table nor the join is read again.
    """
    require_columns(features, [feature, "chrom", "start", "end"], "features")
    require_columns(regions, [region, "chrom", "start", "end"], "regions")
    totals = {
        "features": _named_once(features, feature, "feature names repeat"),
        "regions": _named_once(regions, region, "region names repeat"),
    }
    pairs = materialize(_close_pairs(features, regions, feature, region, fraction))
    hit = pairs.agg(F.count_distinct(region).alias("regions"), F.count_distinct(feature).alias("features")).first()
    if not hit["regions"]:
        raise ValueError(_NO_OVERLAP)
    coverage = {f"{side}{kind}": n for side in ("regions", "features") for kind, n in (("_matched", hit[side]), ("", totals[side]))}
    return RegionMap(pairs, coverage)


_NO_OVERLAP = (
    "no overlap between the two interval sets; check that they share a genome build and "
    "chromosome naming"
)


def _close_pairs(features: DataFrame, regions: DataFrame, feature: str, region: str, fraction: float) -> DataFrame:
    pairs = overlap_pairs(
        features.select(feature, "chrom", "start", "end"), regions.select(region, "chrom", "start", "end")
    )
    share = F.lit(float(fraction))
    close = (F.col("overlap") / (F.col("end") - F.col("start")) > share) | (
        F.col("overlap") / (F.col("end_2") - F.col("start_2")) > share
    )
    return pairs.where(close).select(F.col(f"{region}_2").alias(region), feature, "overlap")


def region_map(
    features: DataFrame,
    regions: DataFrame,
    *,
    feature: str = "peak",
    region: str = "region",
    fraction: float = 0.4,
) -> DataFrame:
    """Pairs (region, feature) whose overlap exceeds `fraction` of either one.

    Both tables have chrom, start, end. Repeated names are refused; no overlap at all, or
    none above the fraction, raises. The pairs are written once, as their readers take them more
    than once. `map_regions` gives the coverage as well.
    """
    require_columns(features, [feature, "chrom", "start", "end"], "features")
    require_columns(regions, [region, "chrom", "start", "end"], "regions")
    require_unique(features, [feature], "feature names repeat")
    require_unique(regions, [region], "region names repeat")
    kept = materialize(_close_pairs(features, regions, feature, region, fraction))
    require_rows(kept, _NO_OVERLAP)
    return kept
