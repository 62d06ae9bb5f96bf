"""Saved datasets: parts with one Parquet folder per split, a log of versions, and the ingest job that writes them."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelab import ROW_ID, SPLIT
from tablelab.operators.dataset import as_dataset
from tablelab.operators.schema import update_columns_spec
from tablelab.operators.splits import resplit
from tablelab.session import broadcast_small, materialize
from tablelab.sources.excel import read_excel
from tablelab.sources.folders import SOURCE_BLOCK, SOURCE_FILE
from tablelab.sources.text_formats import read_csv, read_json, read_json_lines


_VERSION = "version long, commit string, parts array<string>, splits array<string>, schema string, change string"


def history(spark: SparkSession, path: str) -> DataFrame:
    """``(version, commit, parts, splits, schema, change)`` of every version, one row each.

    Two writers that reach for one version at once both leave a row; the smaller commit holds it.
    """
    rows = spark.read.schema(_VERSION).parquet(f"{path}/_log/*").select(*[c.split()[0] for c in _VERSION.split(", ")])
    first = F.min_by(F.struct(*rows.columns), "commit").alias("r")
    return rows.groupBy("version").agg(first).select("r.*")


def _newest(spark: SparkSession, path: str, version: int | None = None):
    try:
        rows = history(spark, path)
        found = rows.filter(F.col("version") == version) if version is not None else rows.orderBy(F.desc("version"))
        found = found.take(1)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        found = []
    if version is not None and not found:
        raise ValueError(f"{path} has no version {version}")
    return found[0] if found else None


def _commit(
    spark: SparkSession, path: str, change: str, make: Callable[[Row | None], DataFrame], append: bool = False
) -> int:
    """Writes what ``make(newest version)`` gives as a part of its own and logs a new version: the part, and
    with ``append`` the earlier ones in front of it. Starts anew if another writer was faster."""
    while True:
        base = _newest(spark, path)
        df = make(base)
        commit = uuid.uuid4().hex
        df.write.partitionBy(SPLIT).parquet(f"{path}/_commit={commit}")
        columns = [f for f in df.schema.fields if f.name != SPLIT]
        schema = T.StructType([*columns, df.schema[SPLIT]])
        own = spark.read.schema(schema).parquet(f"{path}/_commit={commit}")
        splits = {r[0] for r in own.select(SPLIT).distinct().collect()}
        parts = [commit]
        if append and base is not None:
            parts, splits = [*base["parts"], commit], splits | set(base["splits"])
            schema = T.StructType.fromJson(json.loads(base["schema"]))
        version = 0 if base is None else base["version"] + 1
        row = (version, commit, parts, sorted(splits), schema.json(), change)
        try:
            spark.createDataFrame([row], _VERSION).coalesce(1).write.parquet(f"{path}/_log/v={version:020d}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_ALREADY_EXISTS":
                raise
            continue
        if _newest(spark, path, version)["commit"] == commit:
            return version


def save_dataset(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Save as a version of the dataset at ``path``; readers of earlier versions are not disturbed.

    ``append`` adds rows of the same columns behind those of the newest version; their ids go on from its
    largest. ``overwrite`` adds a version of these rows alone. A version never changes, and a saved part is
    never written again.
    """
    spark = df.sparkSession
    df = df if SPLIT in df.columns else as_dataset(df)
    if mode not in ("errorifexists", "append", "overwrite"):
        raise ValueError(f"mode should be errorifexists, append or overwrite, got {mode}")

    def rows(base):
        if base is not None and mode == "errorifexists":
            raise ValueError(f"{path} holds a dataset already")
        if base is None or mode != "append":
            return df
        schema = T.StructType.fromJson(json.loads(base["schema"]))
        if set(df.columns) != set(schema.names):
            raise ValueError(f"appended rows need the columns {', '.join(schema.names)}")
        more = df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name, metadata=f.metadata) for f in schema])
        if ROW_ID in more.columns:
            last = _read(spark, path, base).agg(F.max(ROW_ID)).first()[0]
            more = more.withColumn(ROW_ID, F.col(ROW_ID) + F.lit(0 if last is None else last + 1))
        return more

    _commit(spark, path, mode if mode != "errorifexists" else "save", rows, mode == "append")


def update_dataset(spark: SparkSession, path: str, change: Callable[[DataFrame], DataFrame], name: str = "update") -> int:
    """Write ``change(newest version)`` back as a new version; returns its number."""
    def rows(base):
        if base is None:
            raise ValueError(f"{path} holds no dataset with versions")
        return change(_read(spark, path, base))

    return _commit(spark, path, name, rows)


def update_saved_spec(spark: SparkSession, path: str, spec: dict[str, tuple[str, str]]) -> int:
    """``update_columns_spec``, written back."""
    return update_dataset(spark, path, lambda df: update_columns_spec(df, spec), "columns")


def resplit_saved(spark: SparkSession, path: str, split: dict) -> int:
    """``resplit``, written back."""
    return update_dataset(spark, path, lambda df: resplit(df, split), "split")


def _read(spark: SparkSession, path: str, version: Row) -> DataFrame:
    schema = T.StructType.fromJson(json.loads(version["schema"]))
    parts = [f"{path}/_commit={c}" for c in version["parts"]]
    return spark.read.schema(schema).option("basePath", path).parquet(*parts).select(
        *[F.col(f"`{f.name}`").alias(f.name, metadata=f.metadata) for f in schema])


def load_dataset(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """All splits of the newest or a given version; a filter on ``split`` only reads its folders. A folder
    without versions is read as it is."""
    found = _newest(spark, path, version)
    return spark.read.parquet(path) if found is None else _read(spark, path, found)


def read_manifest(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """The splits of a version."""
    found = _newest(spark, path, version)
    if found is None:
        return json.loads(spark.read.text(f"{path}/_manifest", wholetext=True).first()[0])
    return {"splits": list(found["splits"])}


def with_source_order(staged: DataFrame) -> DataFrame:
    """Dense ids in (file, place in the file) order for staged rows that know their source.

    A source block lies in one run of rows of a staged file, so the id is the block's start plus
    the offset inside the run. Only one row per block is ever sorted; that list is broadcast while
    it has at most a million rows (some 100 TB of blocks).
    """
    key = ["_staged", SOURCE_FILE, SOURCE_BLOCK]
    rows = staged.select(
        "*", F.col("_metadata.file_path").alias("_staged"), F.col("_metadata.row_index").alias("_at")
    )
    runs = rows.groupBy(*key).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    order = Window.orderBy(SOURCE_FILE, SOURCE_BLOCK, "_staged", "_first")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select(*key, "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    starts = materialize(starts, "blocks")
    names = [c for c in staged.columns if c not in (SOURCE_FILE, SOURCE_BLOCK)]
    return rows.join(broadcast_small(starts, starts.count()), key).select(
        *names, (F.col("_start") + F.col("_at") - F.col("_first")).cast("long").alias(ROW_ID)
    )


def with_sheet_order(rows: DataFrame) -> DataFrame:
    """Dense ids in (workbook, sheet row) order. A sheet has about a million rows at most, so one
    window per workbook is bounded."""
    inside = Window.partitionBy(SOURCE_FILE).orderBy(SOURCE_BLOCK)
    before = Window.orderBy(SOURCE_FILE).rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(SOURCE_FILE).count().select(
        SOURCE_FILE, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start")
    )
    names = [c for c in rows.columns if c not in (SOURCE_FILE, SOURCE_BLOCK)]
    return rows.withColumn("_at", F.row_number().over(inside)).join(starts, SOURCE_FILE).select(
        *names, (F.col("_start") + F.col("_at") - 1).cast("long").alias(ROW_ID)
    )


READERS = {"csv": read_csv, "json": read_json, "jsonl": read_json_lines, "excel": read_excel}


def ingest(
    spark: SparkSession, path: str | list[str], fmt: str, out: str, options: dict | None = None,
    split: dict | None = None, splits_in_folders: bool = False, mode: str = "errorifexists",
) -> DataFrame:
    """Read files, give every row an id in file order, split, and save as a dataset.

    The input is parsed once into a staged table, which also makes malformed rows fail here. Ids and
    splits are then narrow steps over the staged table; no data row is shuffled.
    """
    if fmt not in READERS:
        raise ValueError(f"format should be one of {', '.join(READERS)}, got {fmt}")
    reader = READERS[fmt]
    rows = reader(spark, path, **(options or {}), splits_in_folders=splits_in_folders, keep_source=True)
    if fmt == "excel":
        numbered = with_sheet_order(rows)  # already staged by the reader
    else:
        numbered = with_source_order(materialize(rows, "ingest"))
    if splits_in_folders:
        if split is not None:
            raise ValueError("the folders give the splits; leave the split spec out")
    elif split is None:
        numbered = numbered.withColumn(SPLIT, F.lit("train"))
    else:
        numbered = resplit(numbered, split)
    save_dataset(numbered, out, mode)
    return load_dataset(spark, out)
