"""Stored cell scores and region x motif score tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.guards import number, require_columns
from factorloom.operators.ordered import positions
from factorloom.operators.scores import CellScores


def read_cell_scores(
    spark: SparkSession,
    path: str,
    *,
    model: str,
    trait: str,
    column: str = "cs",
    cell: str = "barcode",
) -> CellScores:
    """A tab-separated score table as an enrichment-ratio score (null 1).

    No such path or column raises. Without the `cell` column the first one names cells.
    """
    try:
        table = spark.read.option("sep", "\t").option("header", "true").csv(path)
    except AnalysisException as error:
        raise FileNotFoundError(f"no cell scores at {path}") from error
    if column not in table.columns:
        raise KeyError(f"{column!r} not in {path}; columns are {table.columns}")
    key = cell if cell in table.columns else table.columns[0]
    value = number(F.col(column).try_cast("double"))
    frame = table.select(F.col(key).alias(cell), value.alias("cs"))
    return CellScores(frame, "enrichment_ratio", model, trait, cell)


def read_score_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet scores by region: (region, motif, score), or (region, s) with arrays."""
    table = spark.read.parquet(path)
    require_columns(table, ["region"], "score table")
    if "s" not in table.columns:
        require_columns(table, ["motif", "score"], "score table")
    return table


def score_regions(scores: DataFrame) -> DataFrame:
    """Names of the regions of a score table."""
    require_columns(scores, ["region"], "score table")
    return scores.select("region").distinct()


def score_motifs(scores: DataFrame) -> DataFrame:
    """Motif names of a long score table with their place in name order."""
    require_columns(scores, ["motif"], "score table")
    return positions(scores.select("motif").distinct(), ["motif"], "pos")


def wide_to_long(wide: DataFrame, regions: Sequence[str], motif: str = "motifs") -> DataFrame:
    """A table with one column per region as (region, motif, score).

    `motif` must be the last column, as in the wide layout.
    """
    if wide.columns[-1] != motif:
        raise ValueError(f"expected the last column to be {motif!r}, got {wide.columns[-1]!r}")
    require_columns(wide, regions, "score table")
    cells = F.array(
        *[F.struct(F.lit(r).alias("region"), F.col(f"`{r}`").cast("float").alias("score")) for r in regions]
    )
    return wide.select(F.col(motif).cast("string").alias("motif"), F.inline(cells)).select("region", "motif", "score")
