"""G+C content of intervals over sequences stored as fixed-size chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.guards import require_columns, require_unique
from factorloom.session import broadcast_if_small

#: Characters per stored chunk.
CHUNK = 4096


def chunk_sequences(df: DataFrame, contig: str, text: str, size: int = CHUNK) -> DataFrame:
    """Whole sequences as rows (chrom, chunk_ix, seq) of `size` characters each."""
    require_columns(df, [contig, text])
    pieces = F.sequence(F.lit(0), F.floor((F.length(text) - 1) / size).cast("int"))
    rows = df.where(F.length(text) > 0).select(
        F.col(contig).cast("string").alias("chrom"), F.col(text).alias("_t"), F.explode(pieces).alias("chunk_ix")
    )
    return rows.select(
        "chrom", "chunk_ix", F.substring("_t", F.col("chunk_ix") * size + 1, F.lit(size)).alias("seq")
    )


def gc_content(
    intervals: DataFrame,
    chunks: DataFrame,
    *,
    name: str = "region",
    size: int = CHUNK,
    digits: int = 3,
    out: str = "gc",
) -> DataFrame:
    """G+C share of the A, C, G, T letters of every interval, clipped to its contig.

    NULL if the contig is unknown, also without its ``chr``, or the interval has none of the
    four letters. An interval is split at chunk borders and joins its chunks by (contig,
    chunk); counts are summed per interval.
    """
    require_columns(intervals, [name, "chrom", "start", "end"], "intervals")
    require_columns(chunks, ["chrom", "chunk_ix", "seq"], "sequence chunks")
    require_unique(intervals, [name], "interval names repeat")
    contigs = chunks.groupBy(F.col("chrom").alias("_contig")).agg(F.max("chunk_ix").alias("_last"))
    contigs = broadcast_if_small(contigs)
    others = [c for c in intervals.columns if c != name]
    rows = intervals.select(
        name,
        F.struct(*others).alias("_row"),
        F.greatest(F.col("start"), F.lit(0)).cast("bigint").alias("_s"),
        F.col("end").cast("bigint").alias("_e"),
        F.col("chrom").alias("_c"),
        F.replace("chrom", F.lit("chr"), F.lit("")).alias("_bare"),
    )
    plain = contigs.withColumnsRenamed({"_contig": "_c1", "_last": "_l1"})
    bare = contigs.withColumnsRenamed({"_contig": "_c2", "_last": "_l2"})
    rows = rows.join(plain, F.col("_c") == F.col("_c1"), "left").join(bare, F.col("_bare") == F.col("_c2"), "left")
    rows = rows.select(
        name,
        "_row",
        "_s",
        "_e",
        F.coalesce("_c1", "_c2").alias("_contig"),
        F.when(F.col("_c1").isNotNull(), F.col("_l1")).otherwise(F.col("_l2")).alias("_last"),
    )
    first = F.floor(F.col("_s") / size).cast("int")
    last = F.least(F.floor((F.col("_e") - 1) / size).cast("int"), F.col("_last"))
    ids = F.when((F.col("_e") > F.col("_s")) & (first <= F.col("_last")), F.sequence(first, last))
    # An interval without a chunk keeps one row, so that it comes out with NULL.
    pieces = rows.select(name, "_row", "_contig", "_s", "_e", F.explode_outer(ids).alias("_ix"))
    origin = F.col("_ix").cast("bigint") * size
    at = F.greatest(F.col("_s") - origin, F.lit(0))
    until = F.least(F.col("_e") - origin, F.lit(size))
    met = (F.col("_contig") == F.col("chrom")) & (F.col("_ix") == F.col("chunk_ix"))
    cut = pieces.join(chunks, met, "left").select(
        name, "_row", F.substring("seq", (at + 1).cast("int"), (until - at).cast("int")).alias("_q")
    )
    letters = F.length("_q") - F.length(F.translate("_q", "ACGTacgt", ""))
    gc = F.length("_q") - F.length(F.translate("_q", "GCgc", ""))
    counts = cut.groupBy(name).agg(
        F.any_value("_row").alias("_row"), F.sum(gc).alias("_gc"), F.sum(letters).alias("_acgt")
    )
    share = F.bround(F.try_divide(F.col("_gc").cast("double"), F.col("_acgt").cast("double")), digits)
    fields = [name if c == name else F.col(f"_row.`{c}`").alias(c) for c in intervals.columns]
    return counts.select(*fields, share.alias(out))
