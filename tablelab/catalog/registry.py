"""Registration of queries and their oracle SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Rows of a dealt table for a task, of narrow columns and of texts.
TASK_ROWS = 1_000_000
TEXT_ROWS = 50_000


def query(name: str, sql: str | None = None):
    """Register a query; without ``sql`` only the tests check its result."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def deal(df: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """Spread a table over all cores when it has fewer files than cores, as the test tables have, and over
    more tasks when it has more than ``task_rows`` rows for each; a table of many files is left where it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores:
        return df
    return df.repartition(max(cores, math.ceil(df.count() / task_rows)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
