"""What several operators need: written intermediate tables, the learning fold, safe broadcasts."""

from __future__ import annotations

import gc
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.session import scratch_path, shuffle_partitions

__all__ = ["bounded_batches", "held_out", "passing", "release", "scratch_path", "shuffle_partitions", "small", "stored", "table"]

#: Most rows a table may have to be broadcast; beyond it the join is shuffled.
SMALL_ROWS = 100_000


#: Most bytes of an Arrow batch that whole texts travel to Python in (a longer single text is a batch of its own).
BATCH_BYTES = 4 << 20

_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Let Arrow batches end at BATCH_BYTES in this session, unless it names a bound of its own.

    The executor holds a batch outside its heap, at up to twice its size while it grows, and the
    Python worker holds it once more; Spark's default is 64 MB.
    """
    if _BATCH_CONF not in spark.conf.getAll:
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files of jobs that are over.

    Its cleaner learns of unused shuffles when the driver collects garbage, which a driver with
    little to do may put off for many minutes.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders written in the blocks of `passing` that are open, innermost last.
_WRITTEN: ContextVar[tuple[list[str], ...]] = ContextVar("written", default=())


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables that `stored` writes in this block are deleted from the shared folder when it ends.

    What is read after the block must be stored with `keep`: it goes to the block around, if
    there is one, or stays.
    """
    token = _WRITTEN.set((*_WRITTEN.get(), []))
    try:
        yield
    finally:
        folders = _WRITTEN.get()[-1]
        _WRITTEN.reset(token)
        for folder in folders:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """`df` written once to the shared folder and read back: a lineage cut that survives lost executors.

    In a block of `passing` the table lasts as long as the block, unless it is to `keep`.
    """
    path = scratch_path(df.sparkSession, name)
    blocks = _WRITTEN.get()[: -1 if keep else None]
    if blocks:
        blocks[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """A written table `df` with a broadcast hint if it has at most `max_rows` rows, else as it is."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def held_out(doc_id: Column) -> Column:
    """Whether a document is in the fold that nothing is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
