"""Exact dedup with a heavy-hitter split.

A Misra-Gries summary of the digests, built with map-side partial summaries, names every digest
that may hold more than about one in `tracked` of all rows. The named ones are counted exactly;
those with at least `heavy` rows win, and their few groups are broadcast, so that their rows
never leave the map side. All other digests take an ordinary shuffle, in which no group is
larger than the summary lets pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorloom.llm.common import stored

#: Counters of the Misra-Gries summary (a power of two) and the most winners that are broadcast.
TRACKED = 4096
WINNERS = 1024

#: Rows that a named digest must have to leave the shuffle.
HEAVY = 16

_SPACE = r"[\x20\x09-\x0D]+"


def normalised(text):
    """The text with each run of white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), _SPACE, " ")


def dedup_exact(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    tracked: int = TRACKED,
    winners: int = WINNERS,
    heavy: int = HEAVY,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    The row with the smallest id of a group of equal texts stays; of rows that repeat that id
    one stays, and a null id counts as the largest (keep_id is null only if all ids of the group
    are). Only the two named columns are read, so other columns may have any name. An empty
    table gives an empty result. Runs two jobs before the result: the digests are written once
    to the shared folder, and the named digests are counted.
    """
    digests = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.unhex(F.sha2(normalised(F.col(f"`{text_col}`")).cast("binary"), 256)).alias("digest"),
    ).withColumn("row", F.monotonically_increasing_id())
    digests = stored(digests, "digests")
    order = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "row")

    keys = digests.select(F.hex("digest").alias("key"))
    summary = keys.agg(F.expr(f"approx_top_k(key, {int(winners)}, {int(tracked)})").alias("top"))
    named = summary.select(F.explode("top").alias("t")).select(F.unhex("t.item").alias("digest"))
    hot = stored(
        digests.join(F.broadcast(named), "digest")
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("group_size"), F.min(order).alias("first"))
        .where(F.col("group_size") >= heavy),
        "heavy",
    )
    marked = digests.join(F.broadcast(hot), "digest", "left")
    light = Window.partitionBy("digest")
    rest = marked.where(F.col("first").isNull()).withColumns(
        {"group_size": F.count(F.lit(1)).over(light), "first": F.min(order).over(light)}
    )
    return marked.where(F.col("first").isNotNull()).unionByName(rest).select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("first.row") == F.col("row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
