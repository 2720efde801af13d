"""Order-sensitive work without putting a whole group in one task.

A window partitioned only by the group sends that group to a single task, and one group may
hold a large share of all rows. Here the sort order is cut into *segments*: each segment
holds a bounded share of the rows, a window runs inside (group, segment), and what earlier
segments contribute is added from a table with one row per (group, segment).

Segments come from one of two places:

* `by_value` cuts one numeric column at approximate quantiles fetched once as literals, so
  the segment is a pure function of the value. Callers first reduce to distinct values
  with counts; a value shared by most rows is then a single row.
* `by_order` range-partitions rows by any sort key with a unique tie-break and writes the
  tagged rows to the checkpoint folder, because the boundaries are sampled and must not be
  drawn twice.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.guards import finite
from factorloom.session import BROADCAST_ROWS, broadcast_if_small, materialize, shuffle_partitions

SEG = "_seg"
KEY = "_k"
#: Most rows of a group that `first_k_per_group` lets one task rank.
RANKED = 1_000_000

#: Most split points fetched to the driver.
MAX_SEGMENTS = 20_000

#: Segments per round of a quantile search; each round keeps about 2 of them per quantile.
SEARCH_SEGMENTS = 256

#: Distinct values a quantile search may leave for one task to sort.
SORT_ROWS = 10_000_000

#: A value of more than one row in so many is joined apart, by broadcast.
HEAVY_PARTS = 10_000


def keyed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`df` with the group key as one struct column, so NULL keys group and join as values."""
    return df.withColumn(KEY, F.struct(*keys) if keys else F.struct(F.lit(0).alias("_")))


def unkeyed(df: DataFrame, keys: Sequence[str], *columns: str | Column) -> DataFrame:
    """The group key back as its own columns, followed by `columns`."""
    return df.select(*[F.col(f"{KEY}.`{k}`").alias(k) for k in keys], *columns)


def split_points(df: DataFrame, value: str, segments: int | None = None) -> list[float]:
    """At most `segments` - 1 increasing cut values of a numeric column (runs one job)."""
    return _cuts_and_rows(df, value, segments)[0]


def _cuts_and_rows(df: DataFrame, value: str, segments: int | None) -> tuple[list[float], int]:
    """Cut values and the number of rows, from the same job."""
    segments = min(max(segments or shuffle_partitions(df.sparkSession), 2), MAX_SEGMENTS)
    probabilities = [i / segments for i in range(1, segments)]
    row = df.agg(
        F.percentile_approx(value, F.lit(probabilities), F.lit(8 * segments)).alias("cuts"),
        F.count(value).alias("n"),
    ).first()
    return sorted(set(float(c) for c in row["cuts"] or [])), row["n"]


def by_value(df: DataFrame, value: str, cuts: Sequence[float]) -> DataFrame:
    """`df` with its segment number; rows of equal value always share a segment."""
    if not cuts:
        return df.withColumn(SEG, F.lit(0))
    edges = [float("-inf"), *[c for c in cuts if abs(c) != float("inf")], float("inf")]
    tagged = Bucketizer(
        splits=edges, inputCol=value, outputCol=SEG, handleInvalid="keep"
    ).transform(df)
    # Never NULL here; saying so keeps a NULL check of later joins out of the scans below.
    return tagged.withColumn(SEG, F.coalesce(F.col(SEG).cast("int"), F.lit(0)))


def by_order(df: DataFrame, order: Sequence[str | Column], segments: int | None = None) -> DataFrame:
    """`df` sorted and tagged with segment and position inside it (writes a checkpoint).

    `order` must identify rows, or equal rows may fall on either side of a cut.
    """
    n = segments or shuffle_partitions(df.sparkSession)
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    row = F.monotonically_increasing_id()
    tagged = ranged.withColumn(SEG, F.spark_partition_id()).withColumn(
        "_in_seg", row.bitwiseAND(F.lit((1 << 33) - 1))
    )
    return materialize(tagged)


def running(
    df: DataFrame,
    order: Sequence[Column],
    outputs: Mapping[str, tuple[str, str]],
    *,
    reverse: bool = False,
    before: bool = False,
) -> DataFrame:
    """Running aggregates per group over segmented rows.

    `df` has the columns of `keyed` and a segment. `outputs` maps a new column to
    ``(op, column)`` with op one of sum, min, max, or ``total`` for the sum over the whole
    group. `reverse` runs from the last segment down (`order` must then descend), `before`
    leaves the current row out.
    """
    aggregate = {"sum": F.sum, "min": F.min, "max": F.max, "total": F.sum}
    here = Window.partitionBy(KEY, SEG).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1 if before else 0
    )
    seg_order = F.col(SEG).desc() if reverse else F.col(SEG)
    earlier = Window.partitionBy(KEY).orderBy(seg_order).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(KEY)

    totals = df.groupBy(KEY, SEG).agg(
        *[aggregate[op](c).alias(f"_t_{o}") for o, (op, c) in outputs.items()]
    )
    carried = totals.select(
        KEY,
        SEG,
        *[
            aggregate[op](f"_t_{o}").over(whole if op == "total" else earlier).alias(f"_c_{o}")
            for o, (op, _) in outputs.items()
        ],
    )
    local = df
    for o, (op, c) in outputs.items():
        if op != "total":
            local = local.withColumn(f"_l_{o}", aggregate[op](c).over(here))
    joined = local.join(carried, [KEY, SEG])
    merge = {
        "sum": lambda o: F.coalesce(F.col(f"_l_{o}"), F.lit(0)) + F.coalesce(F.col(f"_c_{o}"), F.lit(0)),
        "min": lambda o: F.least(f"_l_{o}", f"_c_{o}"),
        "max": lambda o: F.greatest(f"_l_{o}", f"_c_{o}"),
        "total": lambda o: F.col(f"_c_{o}"),
    }
    return joined.select(*df.columns, *[merge[op](o).alias(o) for o, (op, _) in outputs.items()])


def value_ranks(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Distinct values of each group with their place in the order.

    Columns: the key struct, `value`, its segment, ``n`` rows with it, ``below`` rows with a
    smaller one, ``upto`` rows with it or a smaller one, ``total`` rows of the group. NULL
    and NaN are left out. Runs one job for the split points.
    """
    base = keyed(df, keys).select(KEY, finite_or_inf(value).alias(value)).where(F.col(value).isNotNull())
    cuts = split_points(base, value)
    distinct = base.groupBy(KEY, value).agg(F.count(F.lit(1)).alias("n"))
    ranked = running(
        by_value(distinct, value, cuts),
        [F.col(value).asc()],
        {"upto": ("sum", "n"), "total": ("total", "n")},
    )
    return ranked.withColumn("below", F.col("upto") - F.col("n"))


def finite_or_inf(value: str) -> Column:
    c = F.col(value).cast("double")
    return F.when(~F.isnan(c), c)


def join_values(rows: DataFrame, lookup: DataFrame, value: str) -> DataFrame:
    """`rows` with the columns of `lookup`, which has one row per (`KEY`, `value`) and their ``n`` rows.

    Rows without a value get NULLs. A lookup table that is not small enough to broadcast is
    split: the values held by more than one row in `HEAVY_PARTS`, fewer than that many, are
    broadcast, and only the others are joined by a shuffle, so no value fills a task. `rows`
    is then read three times. Runs a job that writes `lookup`.
    """
    lookup = materialize(lookup)
    size = lookup.agg(F.count(F.lit(1)).alias("values"), F.sum("n").alias("rows")).first()
    on, found = [KEY, value], lookup.drop("n")
    if size["values"] <= BROADCAST_ROWS:
        return rows.join(F.broadcast(found), on, "left")
    heavy = F.col("n") > (size["rows"] or 0) / HEAVY_PARTS
    often, seldom = lookup.where(heavy).drop("n"), lookup.where(~heavy).drop("n")
    there = rows.where(F.col(value).isNotNull())
    rest = there.join(F.broadcast(often.select(*on)), on, "left_anti").join(seldom, on, "left")
    absent = rows.where(F.col(value).isNull()).select(
        *on,
        *[f"`{c}`" for c in rows.columns if c not in on],
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in found.schema if f.name not in on],
    )
    return there.join(F.broadcast(often), on).unionByName(rest).unionByName(absent)


def average_ranks(df: DataFrame, value: str, out: str, keys: Sequence[str] = ()) -> DataFrame:
    """`df` with the average rank of `value` in its group (ties share their mean rank)."""
    ranks = value_ranks(df, value, keys).select(
        KEY, F.col(value).alias("_rv"), "n", (F.col("below") + (F.col("n") + 1) / 2.0).alias("_rank")
    )
    rows = keyed(df, keys).withColumn("_rv", finite_or_inf(value))
    return join_values(rows, ranks, "_rv").withColumn(out, F.col("_rank")).drop(KEY, "_rv", "_rank")


def _segment_counts(tagged: DataFrame, size: Column, total: Column) -> DataFrame:
    """(key, old start, segment, new start, size, rows of the group) of the parts of blocks."""
    counts = tagged.groupBy(KEY, "_at", SEG).agg(size.alias("_c"), F.max("_n").alias("_n"))
    upto = F.sum("_c").over(Window.partitionBy(KEY, "_at").orderBy(SEG))
    return counts.select(KEY, "_at", SEG, "_c", (F.col("_at") + upto - F.col("_c")).alias("_start"), total.alias("_n"))


def _narrowed(values: DataFrame, wanted: str) -> DataFrame:
    """The blocks of `values` cut until none has more than `SORT_ROWS` distinct values.

    Every crowded block is cut at quantiles of its own values, whatever range they are in, and
    only parts that hold a wanted place stay. The loop follows the largest measured block.
    """
    largest = None
    while True:
        values = materialize(values)
        sizes = values.groupBy(KEY, "_start").agg(F.count(F.lit(1)).alias("_d"))
        crowded = materialize(sizes.where(F.col("_d") > SORT_ROWS))
        now = crowded.agg(F.max("_d")).first()[0]
        if now is None or now == largest:
            return values
        largest = now
        at = [F.lit(i / SEARCH_SEGMENTS) for i in range(1, SEARCH_SEGMENTS)]
        cuts = (
            values.join(broadcast_if_small(crowded.drop("_d")), [KEY, "_start"])
            .groupBy(KEY, "_start")
            .agg(F.percentile_approx("_v", F.array(*at), F.lit(8 * SEARCH_SEGMENTS)).alias("_cuts"))
        )
        above = F.size(F.filter(F.array_distinct("_cuts"), lambda c: c <= F.col("_v")))
        tagged = (
            values.join(broadcast_if_small(cuts), [KEY, "_start"], "left")
            .withColumn(SEG, F.when(F.col("_cuts").isNull(), 0).otherwise(above))
            .drop("_cuts")
            .withColumnRenamed("_start", "_at")
        )
        targets = _segment_counts(tagged, F.sum("_w"), F.col("_n")).where(wanted).drop("_c", "_n")
        values = tagged.join(broadcast_if_small(targets), [KEY, "_at", SEG]).drop("_at", SEG)


def quantiles(
    df: DataFrame, value: str, probabilities: Mapping[str, float], keys: Sequence[str] = ()
) -> DataFrame:
    """Exact linearly interpolated quantiles of the finite values of each group.

    One row per group that has a finite value: the keys, a column per entry of
    `probabilities`, and ``n``. Counts per (group, segment) find the few segments that hold
    a wanted position; only their distinct values are sorted. In a table of more than
    `SORT_ROWS` rows, segments that hold too many are cut again until they fit a task.
    One job finds the cut values and, with keys, one writes the wanted segments. `df` is
    read three times, so a costly plan should be materialised before.
    """
    # 0-based places just below and just above each wanted quantile.
    at = {n: f"((_n - 1) * {float(p)!r}D)" for n, p in probabilities.items()}
    low = {n: f"CAST(floor({a}) AS BIGINT)" for n, a in at.items()}
    high = {n: f"CAST(ceil({a}) AS BIGINT)" for n, a in at.items()}
    ends = dict.fromkeys([*low.values(), *high.values()])
    wanted = " OR ".join(f"({e} >= _start AND {e} < _start + _c)" for e in ends)

    # A block is a run of a group's sorted rows, known by the place "_start" of its first.
    pool = keyed(df, keys).select(KEY, finite(value).alias("_v")).where("_v is not null")
    cuts, rows = _cuts_and_rows(pool, "_v", SEARCH_SEGMENTS)
    tagged = by_value(pool, "_v", cuts)
    whole = tagged.withColumns({"_at": F.lit(0).cast("bigint"), "_n": F.lit(0).cast("bigint")})
    counts = _segment_counts(whole, F.count(F.lit(1)), F.sum("_c").over(Window.partitionBy(KEY)))
    targets = counts.where(wanted).drop("_c", "_at")
    # Without keys at most two segments per probability qualify.
    targets = broadcast_if_small(targets) if keys else F.broadcast(targets)
    values = tagged.join(targets, [KEY, SEG]).groupBy(KEY, "_start", "_n", "_v").agg(F.count(F.lit(1)).alias("_w"))
    if rows > SORT_ROWS:
        values = _narrowed(values, wanted)

    order = Window.partitionBy(KEY, "_start").orderBy("_v")
    chosen = values.withColumn("_hi", F.col("_start") + F.sum("_w").over(order)).withColumn(
        "_lo", F.col("_hi") - F.col("_w")
    )
    picks = [
        F.expr(f"max(CASE WHEN {e[n]} >= _lo AND {e[n]} < _hi THEN _v END)").alias(f"_{side}_{n}")
        for side, e in (("lo", low), ("hi", high))
        for n in probabilities
    ]
    found = chosen.groupBy(KEY).agg(F.max("_n").alias("_n"), *picks)
    out = [
        F.expr(f"`_lo_{n}` + (`_hi_{n}` - `_lo_{n}`) * ({a} - floor({a}))").alias(n) for n, a in at.items()
    ]
    return unkeyed(found, keys, *out, F.col("_n").alias("n"))


def positions(
    df: DataFrame,
    order: Sequence[str | Column],
    out: str = "pos",
    keys: Sequence[str] = (),
) -> DataFrame:
    """`df` with the 0-based place of each row in a total order, per group if `keys`.

    One range shuffle, one checkpoint and a lookup with one row per range partition.
    """
    placed = by_order(df, [*keys, *order])
    sizes = placed.groupBy(SEG).agg(F.count(F.lit(1)).alias("_c"))
    offsets = sizes.select(
        SEG,
        F.coalesce(
            F.sum("_c").over(Window.orderBy(SEG).rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ).alias("_offset"),
    )
    # One row per range partition, whatever the data holds.
    numbered = placed.join(F.broadcast(offsets), SEG).withColumn(
        out, F.col("_offset") + F.col("_in_seg")
    )
    numbered = numbered.drop(SEG, "_in_seg", "_offset")
    if not keys:
        return numbered
    rows = keyed(numbered, keys)
    first = rows.groupBy(KEY).agg(F.min(out).alias("_first"))
    return rows.join(broadcast_if_small(first), KEY).withColumn(out, F.col(out) - F.col("_first")).drop(
        KEY, "_first"
    )


def first_k_per_group(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    k: int,
    spread: Sequence[str],
    buckets: int | None = None,
) -> DataFrame:
    """The first `k` rows of each group in `order`.

    Rows are first ranked inside (group, hash bucket of `spread`), of which there are as many as
    shuffle partitions unless given; the second round then sees at most k x buckets rows of a
    group. Where that is more than `RANKED` rows, places come from one range shuffle of all rows
    (`positions`), so no task sees k rows of a group.
    """
    buckets = buckets or shuffle_partitions(df.sparkSession)
    if k * buckets > RANKED:
        return positions(df, order, "_place", keys).where(F.col("_place") < k).drop("_place")
    bucket = F.pmod(F.xxhash64(*spread), F.lit(buckets))
    rows = keyed(df, keys).withColumn("_b", bucket)
    rank = F.row_number().over(Window.partitionBy(KEY, "_b").orderBy(*order))
    rows = rows.withColumn("_r", rank).where(F.col("_r") <= k)
    rank = F.row_number().over(Window.partitionBy(KEY).orderBy(*order))
    return rows.withColumn("_r", rank).where(F.col("_r") <= k).drop(KEY, "_b", "_r")
