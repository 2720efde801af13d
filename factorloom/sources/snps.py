"""Ordered point tables: reading them and writing annotations in their order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from factorloom.guards import require_columns, require_rows
from factorloom.operators.intervals import assign_points
from factorloom.session import broadcast_if_small, materialize, shuffle_partitions
from factorloom.sources.manifest import commit

# Fixed value: columns of the six-column variant table, in file order.
SNP_COLUMNS = ("chrom", "snp", "cm", "bp", "a1", "a2")

#: Values of annotations that a writing task sorts.
SORTED_ROWS = 8_000_000


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Text lines with their place in the input: row_ix, value; files in path order.

    Lines of one split are read in order, and a split knows its offset in the file. Split
    sizes are summed in (file, offset) order: a table with one row per split. The lines are
    written once with their places, since another scan may part the files in another way.
    """
    order = ["_file", "_block"]
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"),
    )
    lines = materialize(lines)
    blocks = lines.groupBy(*order).agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select(*order, "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    # One row per input split.
    return lines.join(broadcast_if_small(starts), order).select(
        (F.col("_start") + F.col("_id") - F.col("_first")).alias("row_ix"), "value"
    )


def read_snp_table(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Whitespace-separated variants without a header: row_ix and the six columns.

    ``row_ix`` is the contract: every consumer aligns by it. No variants raise.
    """
    lines = read_lines(spark, path).where(F.length(F.trim("value")) > 0)
    f = F.split(F.trim("value"), r"\s+")
    kinds = {"cm": "double", "bp": "bigint"}
    table = lines.select(
        "row_ix", *[f[i].cast(kinds.get(c, "string")).alias(c) for i, c in enumerate(SNP_COLUMNS)]
    )
    require_rows(table, f"{path} has no variants")
    return table


def thin_annotation(
    points: DataFrame,
    intervals: DataFrame,
    loadings: DataFrame,
    *,
    row: str = "row_ix",
    chrom: str = "chrom",
    peak: str = "peak",
    annot: str = "annot",
    loading: str = "loading",
    **columns: str | bool,
) -> DataFrame:
    """For every annotation, one value per point: the loading of its interval, else 0.

    `loadings` has peak, annot, loading. Columns: annot, chrom, row, value. The annotation
    names are fetched; an interval carries one value per annotation.
    """
    require_columns(loadings, [peak, annot, loading], "loadings")
    values, names = thin_values(
        points, intervals, loadings, row=row, chrom=chrom, peak=peak, annot=annot, loading=loading, **columns
    )
    return _per_annotation(values, names, annot).select(annot, chrom, row, "value")


def thin_values(
    points: DataFrame,
    intervals: DataFrame,
    loadings: DataFrame,
    *,
    row: str = "row_ix",
    chrom: str = "chrom",
    peak: str = "peak",
    annot: str = "annot",
    loading: str = "loading",
    **columns: str | bool,
) -> tuple[DataFrame, list[str]]:
    """`thin_annotation` with one row per point: chrom, row, an array ``values``; and the names of its entries.

    The intervals are written once with their arrays, since checks and the join read them.
    """
    require_columns(loadings, [peak, annot, loading], "loadings")
    names = sorted(r[0] for r in loadings.select(annot).distinct().collect())
    kind = dict(loadings.dtypes)[annot]
    places = points.sparkSession.createDataFrame(list(enumerate(names)), f"_at int, `{annot}` {kind}")
    placed = loadings.join(F.broadcast(places), annot)
    entry = F.struct("_at", F.col(loading).cast("double").alias("_v"))
    per_peak = placed.groupBy(peak).agg(F.array_sort(F.collect_list(entry)).alias("_e"))
    # An interval with every annotation has its values in their order; else they are looked up.
    whole = F.transform("_e", lambda e: e["_at"]) == F.array(*[F.lit(k) for k in range(len(names))])
    found = F.map_from_entries("_e")
    sparse = F.array(*[F.coalesce(F.try_element_at(found, F.lit(k)), F.lit(0.0)) for k in range(len(names))])
    dense = F.transform("_e", lambda e: F.coalesce(e["_v"], F.lit(0.0)))
    per_peak = per_peak.select(peak, F.when(whole, dense).otherwise(sparse).alias("_values"))
    # The loadings ride on the intervals, so points without one meet no second join.
    loaded = materialize(intervals.join(per_peak, peak, "left"))
    met = assign_points(points, loaded, row=row, name=peak, carry=["_values"], **columns)
    none = F.array(*[F.lit(0.0) for _ in names])
    return met.select(chrom, row, F.coalesce("_values", none).alias("values")), names


def _per_annotation(values: DataFrame, names: list[str], annot: str) -> DataFrame:
    """Rows of `thin_values` once per annotation."""
    others = [c for c in values.columns if c != "values"]
    labels = F.array(*[F.lit(n) for n in names])
    return values.select(*others, F.posexplode("values").alias("_at", "value")).select(
        labels[F.col("_at")].alias(annot), *others, "value"
    )


def write_thin_annotation(
    annotation: DataFrame, path: str, *, row: str = "row_ix", chrom: str = "chrom", annot: str = "annot",
    names: list[str] | None = None,
) -> None:
    """Write annotations as gzipped tab-separated files per annotation and chromosome.

    Rows keep their order: inside a file, and over the files of a folder in name order,
    since a large chromosome spans several range partitions. The partitions are committed, see
    `manifest`.

    With `names`, `annotation` is a table of `thin_values`: points are shuffled instead of values, and
    a range partition holds so many points that a task sorts about `SORTED_ROWS` values.
    """
    if names is None:
        ranged = annotation.repartitionByRange(annot, chrom, row)
    else:
        # Counted and sampled for the ranges, then shuffled.
        points = materialize(annotation)
        width = max(shuffle_partitions(points.sparkSession), -(-points.count() * len(names) // SORTED_ROWS))
        ranged = _per_annotation(points.repartitionByRange(width, chrom, row), names, annot)
    ordered = ranged.sortWithinPartitions(annot, chrom, row)
    seen = Observation()
    (
        ordered.select(annot, chrom, "value")
        .observe(seen, F.count(F.lit(1)).alias("n"))
        .write.mode("overwrite")
        .partitionBy(annot, chrom)
        .option("sep", "\t")
        .option("header", "true")
        .option("compression", "gzip")
        .csv(path)
    )
    keys = [annot, chrom]
    commit(annotation.sparkSession, path, keys, seen.get.get("n") or 0, fmt="csv", sep="\t", header="true")


def read_thin_annotation(spark: SparkSession, path: str) -> DataFrame:
    """Annotations written by `write_thin_annotation`."""
    return spark.read.option("sep", "\t").option("header", "true").schema(
        "value double, annot string, chrom string"
    ).csv(path)
