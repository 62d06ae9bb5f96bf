"""Session helpers: shared scratch folder and the size limits used before broadcasting."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

# Upper bounds on what may be held by the driver or copied to every executor.
MAX_CLASSES = 10_000
MAX_LITERAL_ROWS = 2_000
MAX_BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one in local mode only."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    return _local_dir()


@functools.cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="tablelab-")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nobody has used before."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df, name: str):
    """Cut the lineage with a written table, so a lost executor never re-runs what led to it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_small(df, rows: int):
    """Broadcast a table whose row count is known and within the limit; otherwise leave the choice
    to the planner, which then shuffles."""
    return F.broadcast(df) if rows <= MAX_BROADCAST_ROWS else df


def spread(df, *keys: str):
    """Deal rows out to all cores, for steps whose work per row far outweighs moving the row."""
    spark = df.sparkSession
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(wanted, spark.sparkContext.defaultParallelism), *keys)
