"""Trees of per-annotation result files, and the store that keeps enrichment arms."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.guards import require_none
from factorloom.operators.testing import Z_COLUMN, add_fdr
from factorloom.session import materialize
from factorloom.sources.manifest import file_path

#: How a path names its trait and annotation.
FILE_LAYOUT = r"([^/]+)/([^/]+)\.results$"
PARTITION_LAYOUT = r"trait=([^/]+)/annot=([^/]+)/[^/]+$"


def results_files(
    spark: SparkSession, results_dir: str, *, pattern: str = "*.results", layout: str = r"([^/]+)\.results$"
) -> DataFrame:
    """(annot, path) of the result files of a folder, by annotation; no such folder raises.

    Other names than ``<annot>.results`` need a file `pattern` and a `layout` whose group is
    the annotation. File contents are not read.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    try:
        files = found.load(results_dir)
    except AnalysisException as error:
        raise FileNotFoundError(f"no results directory for annotations: {results_dir}") from error
    return files.select(F.regexp_extract(file_path(), layout, 1).alias("annot"), F.col("path")).orderBy("annot")


def read_results(
    spark: SparkSession,
    root: str,
    *,
    traits: Iterable[str],
    annot2factor: Mapping[str, str],
    direction: str | Mapping[str, str] = "combined",
    row: int = 0,
    strict: bool = True,
    fdr: bool = True,
    by: str | Sequence[str] | None = "trait",
    text_columns: Sequence[str] = ("Category",),
    layout: str = FILE_LAYOUT,
) -> DataFrame:
    """One row per (trait, annotation): line `row` of its tab-separated file.

    The default layout is ``root/<trait>/<annot>.results``; `layout` may be another pattern
    whose two groups are trait and annotation, such as partition folders written by Spark.
    Files may differ in columns. With `strict` a missing file raises, because leaving it out
    would shrink the number of tests; so does a file without line `row`. All columns but
    `text_columns` are numbers. `fdr` adds one-tailed p and BH q per `by`. The distinct
    headers are fetched to the driver; each file is one line table of a fitted model.
    """
    traits = list(traits)
    if not traits:
        raise ValueError("no traits requested")
    annots = {str(a): str(f) for a, f in annot2factor.items()}
    root = root.rstrip("/")
    try:
        if layout == FILE_LAYOUT:
            folders = [f"{root}/{t}" for t in traits]
            raw = spark.read.option("pathGlobFilter", "*.results").text(folders, wholetext=True)
        else:
            raw = spark.read.option("recursiveFileLookup", "true").text(root, wholetext=True)
    except AnalysisException as error:
        raise FileNotFoundError(f"no results for {traits} under {root}") from error

    path = file_path()
    lines = F.filter(F.split("value", "\r?\n"), lambda v: F.length(v) > 0)
    files = raw.select(
        path.alias("_path"),
        F.regexp_extract(path, layout, 1).alias("trait"),
        F.regexp_extract(path, layout, 2).alias("annot"),
        lines.alias("_lines"),
    )
    files = files.where(F.col("trait").isin(*traits) & F.col("annot").isin(*annots)).select(
        "_path",
        "trait",
        "annot",
        F.split(F.try_element_at("_lines", F.lit(1)), "\t").alias("_header"),
        F.split(F.try_element_at("_lines", F.lit(row + 2)), "\t").alias("_fields"),
    )
    # The files are opened once; the checks and the result read what was parsed.
    files = materialize(files)

    pairs = [(t, a, f, direction if isinstance(direction, str) else direction[a]) for t in traits for a, f in annots.items()]
    expected = spark.createDataFrame(pairs, "trait string, annot string, factor string, direction string")
    if strict:
        lost = expected.join(files.select("trait", "annot"), ["trait", "annot"], "left_anti")
        require_none(
            lost.select(F.concat_ws("/", "trait", "annot").alias("file")),
            "file",
            "result files are missing; leaving them out would shrink the number of tests",
            FileNotFoundError,
        )
    short = files.where("_fields is null")
    require_none(short, "_path", f"row {row} was requested from a shorter file")
    fields = files.select("trait", "annot", "_header", "_fields")
    headers = [r[0] for r in fields.select("_header").distinct().collect()]
    if not headers:
        raise FileNotFoundError(f"no .results files found under {root} for traits {traits}")
    columns = list(dict.fromkeys(c for h in headers for c in h))
    by_name = fields.withColumn("_m", F.map_from_arrays("_header", "_fields"))

    def value(name: str) -> Column:
        v = F.try_element_at(F.col("_m"), F.lit(name))
        return (v if name in text_columns else v.try_cast("double")).alias(name)

    rows = by_name.select(*[value(c) for c in columns], "trait", "annot")
    # As many rows as the caller listed pairs.
    rows = rows.join(F.broadcast(expected), ["trait", "annot"])
    rows = rows.select(*[F.col(f"`{c}`") for c in columns], "trait", "annot", "factor", "direction")
    if not fdr:
        return rows
    if Z_COLUMN not in rows.columns:
        raise KeyError(f"{Z_COLUMN!r} not in the result files; columns are {columns}")
    return add_fdr(rows, by=by)


def write_arm(results: DataFrame, factor_map: DataFrame, path: str, arm: str) -> None:
    """Store an enrichment arm, replacing only that arm: results and factor selection."""
    tables = {"results": results, "factor_selection": factor_map.drop("annot_index")}
    for name, table in tables.items():
        (
            table.withColumn("arm", F.lit(arm))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("arm")
            .parquet(f"{path}/{name}")
        )


def read_arm(spark: SparkSession, path: str, arm: str) -> dict[str, DataFrame]:
    """The tables of one stored arm."""
    return {
        name: spark.read.parquet(f"{path}/{name}").where(F.col("arm") == arm).drop("arm")
        for name in ("results", "factor_selection")
    }
