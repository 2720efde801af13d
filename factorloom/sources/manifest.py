"""Partitioned output with a commit manifest, so that an interrupted run is resumed where it stopped.

A partition counts as finished when the manifest names it and its folder still holds as many
files as were committed. The manifest is written after the files, so a run that was lost while
writing leaves partitions that count as open.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from factorloom.guards import require_columns
from factorloom.session import broadcast_if_small, materialize

#: Folder of the manifest inside the output; readers of the output skip names with an underscore.
MANIFEST = "_manifest"
#: How a folder names a NULL key.
_NULL_KEY = "__HIVE_DEFAULT_PARTITION__"


def file_path(raw: str = "_metadata.file_path") -> Column:
    """Path of the file a row comes from, with percent escapes undone."""
    return F.url_decode(F.replace(F.col(raw), F.lit("+"), F.lit("%2B")))


def _texts(keys: Sequence[str]) -> list[Column]:
    """Keys of a table as folders spell them."""
    return [F.coalesce(F.col(k).cast("string"), F.lit(_NULL_KEY)).alias(f"_{k}") for k in keys]


def _folders(keys: Sequence[str]) -> list[Column]:
    """Keys of a file `_file`, from its folders, which escape some characters once more."""
    found = [F.regexp_extract(file_path("_file"), f"(?:^|/){k}=([^/]+)/", 1) for k in keys]
    return [F.url_decode(F.replace(v, F.lit("+"), F.lit("%2B"))).alias(f"_{k}") for v, k in zip(found, keys, strict=True)]


def _read(spark: SparkSession, path: str, fmt: str, **options: str) -> DataFrame | None:
    try:
        return spark.read.format(fmt).option("recursiveFileLookup", "true").options(**options).load(path)
    except AnalysisException:
        return None


def _per_partition(files: DataFrame | None, spark: SparkSession, keys: Sequence[str], count: str) -> DataFrame:
    named = [f"_{k}" for k in keys]
    if files is None:
        return spark.createDataFrame([], ", ".join(f"{k} string" for k in named) + f", {count} bigint")
    # Counted by file first, so that names are taken apart once a file and not once a row.
    by_file = files.groupBy(F.col("_metadata.file_path").alias("_file")).agg(F.count(F.lit(1)).alias("_c"))
    return by_file.select(*_folders(keys), "_c").groupBy(*named).agg(F.sum("_c").alias(count))


def _files(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Number of files per partition; contents are not read."""
    return _per_partition(_read(spark, path, "binaryFile"), spark, keys, "n_files")


def commit(
    spark: SparkSession, path: str, keys: Sequence[str], n_rows: int, *, work: DataFrame | None = None,
    fmt: str = "parquet", **options: str,
) -> None:
    """Append the partitions just written to the manifest: keys as text, rows, files.

    Rows are counted in the files; their sum over the partitions of `work` (all if not given)
    must be the `n_rows` that the write has seen, else this raises and commits nothing.
    """
    named = [f"_{k}" for k in keys]
    found = _per_partition(_read(spark, path, fmt, **options), spark, keys, "n_rows")
    if work is not None:
        found = work.select(*_texts(keys)).distinct().join(found, named, "left")
    entries = found.join(_files(spark, path, keys), named, "left").na.fill(0, ["n_rows", "n_files"])
    entries = materialize(entries)
    held = entries.agg(F.sum("n_rows")).first()[0] or 0
    if held != n_rows:
        raise RuntimeError(f"{n_rows} rows were written but {held} are in the files of {path}; nothing is committed")
    entries.withColumn("committed", F.current_timestamp()).write.mode("append").parquet(f"{path}/{MANIFEST}")


def write_work(
    rows: DataFrame, work: DataFrame, path: str, keys: Sequence[str], *, fmt: str = "parquet", **options: str
) -> None:
    """Write the rows of the partitions that `work` lists, then commit these partitions.

    Listed partitions are replaced, others stay as they are. Rows are counted by an
    `Observation` on the write itself and once more in the files. A listed partition without rows is
    committed as empty; if an old run left files there, nothing is committed and this raises.
    """
    require_columns(rows, keys, "rows to write")
    require_columns(work, keys, "work list")
    spark, named = rows.sparkSession, [f"_{k}" for k in keys]
    todo = materialize(work.select(*keys).distinct())
    # A shuffle by the few keys would put all rows of a partition in one task.
    wanted = broadcast_if_small(todo.select(*_texts(keys)).distinct())
    listed = rows.select("*", *_texts(keys)).join(wanted, named, "left_semi").drop(*named)
    seen = Observation()
    writer = listed.observe(seen, F.count(F.lit(1)).alias("n")).write.format(fmt).options(**options)
    writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).save(path)
    commit(spark, path, keys, seen.get.get("n") or 0, work=todo, fmt=fmt, **options)


def pending_work(work: DataFrame, done_path: str, keys: Sequence[str], *, committed: bool = True) -> DataFrame:
    """Rows of a work list whose output partition ``key=value/...`` is not finished.

    Finished is a partition whose latest manifest row names as many files as its folder holds.
    With ``committed=False``, for output of programs that keep no manifest, any file will do.
    """
    spark, named = work.sparkSession, [f"_{k}" for k in keys]
    done = _files(spark, done_path, keys)
    if committed:
        try:
            manifest = spark.read.parquet(f"{done_path}/{MANIFEST}")
        except AnalysisException:
            return work
        latest = manifest.groupBy(*named).agg(F.max_by("n_files", "committed").alias("_was"))
        done = latest.join(done, named, "left").where("_was = coalesce(n_files, 0)")
    return work.select("*", *_texts(keys)).join(done.select(*named), named, "left_anti").select(*work.columns)
