"""FASTA text as fixed-size sequence chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.guards import require_rows
from factorloom.operators.ordered import KEY, by_value, keyed, running, split_points
from factorloom.operators.sequence import CHUNK
from factorloom.session import broadcast_if_small, materialize
from factorloom.sources.snps import read_lines


def read_fasta(spark: SparkSession, path: str | list[str], size: int = CHUNK) -> DataFrame:
    """Sequences of FASTA files as (chrom, chunk_ix, seq) of `size` characters per chunk.

    A line belongs to the last header before it and starts where the lines since that
    header end: a running maximum and a running sum over line numbers, carried across
    segments of the input. Lines are then cut at chunk borders and put together per chunk.
    """
    lines = read_lines(spark, path).select("row_ix", F.trim("value").alias("value"))
    header = F.col("value").startswith(">")
    lines = lines.select(
        F.col("row_ix").cast("double").alias("row_ix"),
        "value",
        F.when(header, F.col("row_ix").cast("double")).alias("_head"),
        F.when(header, 0).otherwise(F.length("value")).cast("bigint").alias("_len"),
    )
    lines = materialize(lines)
    require_rows(lines.where("_head is not null"), f"{path} has no sequence header")
    placed = by_value(keyed(lines, []), "row_ix", split_points(lines, "row_ix"))
    seen = running(placed, [F.col("row_ix")], {"_at_head": ("max", "_head"), "_end": ("sum", "_len")})
    seen = materialize(seen.drop(KEY))
    heads = seen.where("_head is not null").select(
        F.col("_head").alias("_at_head"),
        F.regexp_extract("value", r"^>\s*(\S*)", 1).alias("chrom"),
        F.col("_end").alias("_from"),
    )
    body = seen.where("_head is null and _len > 0").join(broadcast_if_small(heads), "_at_head")
    start = F.col("_end") - F.col("_len") - F.col("_from")
    body = body.select("chrom", "value", start.alias("_s"), (start + F.col("_len")).alias("_e"))
    ids = F.sequence(F.floor(F.col("_s") / size).cast("int"), F.floor((F.col("_e") - 1) / size).cast("int"))
    pieces = body.withColumn("chunk_ix", F.explode(ids))
    left = F.greatest(F.col("chunk_ix").cast("bigint") * size, F.col("_s"))
    right = F.least((F.col("chunk_ix").cast("bigint") + 1) * size, F.col("_e"))
    pieces = pieces.select(
        "chrom",
        "chunk_ix",
        left.alias("_at"),
        F.substring("value", (left - F.col("_s") + 1).cast("int"), (right - left).cast("int")).alias("_q"),
    )
    # A chunk holds at most `size` characters.
    parts = F.sort_array(F.collect_list(F.struct("_at", "_q")))
    chunks = pieces.groupBy("chrom", "chunk_ix").agg(parts.alias("_p"))
    return chunks.select("chrom", "chunk_ix", F.array_join(F.transform("_p", lambda p: p["_q"]), "").alias("seq"))
