"""Session construction, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows a lookup table may have before it is joined by shuffle instead of broadcast.
BROADCAST_ROWS = 200_000

_CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(
    app: str = "factorloom", cpus: int | str = "*", partitions: int = 8
) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach for checkpoints and hand-over tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master may fall back to
    a folder of this machine.
    """
    named = spark.conf.get(_CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(
        _CHECKPOINT_CONF
    )
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_CHECKPOINT_CONF} to a folder shared by all executors")
    root = getattr(shared_dir, "_local", None)
    if root is None or not os.path.isdir(root):
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        shared_dir._local = root
    return root


def materialize(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and read on from there (runs one job).

    Used where a plan is consumed twice and both readers must see identical rows, such as
    rows tagged with the range partition they landed in.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    import uuid

    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df` with a broadcast hint if it has at most `max_rows` rows, else as it is.

    The table is materialised first, so the check and the join read the same rows and the
    plan above `df` runs once. Beyond the bound the join is shuffled and adaptive
    execution splits skewed partitions.
    """
    small = materialize(df)
    return F.broadcast(small) if small.count() <= max_rows else small


def shuffle_partitions(spark: SparkSession) -> int:
    """Configured shuffle width."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
