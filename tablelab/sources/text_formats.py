"""CSV and JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelab import messages
from tablelab.sources.folders import SOURCE_FILE, check_split_folders, located, split_of


def _finish(df: DataFrame, splits_in_folders: bool) -> DataFrame:
    if splits_in_folders:
        check_split_folders(df)
    out = located(df)
    return out.withColumn("split", split_of(F.col(SOURCE_FILE))) if splits_in_folders else out


def _require_columns(df: DataFrame, path, kind: str) -> DataFrame:
    if not df.columns:
        raise ValueError(f"Error trying to load the {kind} dataset: {path} holds no columns")
    return df


def read_csv(
    spark: SparkSession, path: str | list[str], separator: str | None = None,
    splits_in_folders: bool = False, schema: str | None = None, sampling_ratio: float = 1.0,
    keep_source: bool = False, multi_line: bool = False,
) -> DataFrame:
    """Headed CSV files. A malformed row fails the job that reads it; headers must agree.

    Quoted fields may hold the separator and doubled quotes. ``multi_line`` also allows line breaks
    inside quotes; a file is then parsed by one task.

    Types are inferred unless ``schema`` is given; on very large inputs give one, or a
    ``sampling_ratio`` for the inference pass.
    """
    if separator is None:
        raise ValueError(messages.NO_SEPARATOR)
    if not isinstance(separator, str):
        raise TypeError(messages.SEPARATOR_TYPE.format(got=type(separator)))
    reader = spark.read.options(
        sep=separator, header=True, mode="FAILFAST", enforceSchema=False, quote='"', escape='"',
        multiLine=multi_line,
        recursiveFileLookup=splits_in_folders,
    )
    if schema is None:
        reader = reader.options(inferSchema=True, samplingRatio=sampling_ratio)
    else:
        reader = reader.schema(schema)
    out = _finish(_require_columns(reader.csv(path), path, "CSV"), splits_in_folders)
    return out if keep_source else _plain(out)


def _plain(df: DataFrame) -> DataFrame:
    return df.drop("_src", "_blk")


def _check_json(texts: DataFrame) -> None:
    """Each file must hold exactly one JSON value: inside brackets it is an array of length 1."""
    one = F.json_array_length(F.concat(F.lit("["), F.col("value"), F.lit("]")))
    bad = texts.filter(one.isNull() | (one != 1)).select("_src").take(1)
    if bad:
        raise ValueError(f"Error trying to load the JSON dataset: {bad[0][0]} is not valid JSON")


def _key_order(first: Column, texts: DataFrame) -> list[str]:
    found = texts.select(F.json_object_keys(first).alias("k")).filter("k IS NOT NULL").take(1)
    return list(found[0][0]) if found else []


def _ordered(df: DataFrame, order: list[str], kept: list[str]) -> DataFrame:
    names = [c for c in df.columns if c not in kept]
    first = [c for c in order if c in names]
    return df.select(*first, *[c for c in names if c not in first], *kept)


def read_json(
    spark: SparkSession, path: str | list[str], data_key: str | None = None,
    splits_in_folders: bool = False, schema: str | None = None, keep_source: bool = False,
) -> DataFrame:
    """JSON documents: an array of records, or under ``data_key`` one of a top-level object.

    Columns keep the order of the first record. A file is one document and is parsed by one task;
    use ``read_json_lines`` for files that should be split.
    """
    if data_key is not None and not isinstance(data_key, str):
        raise TypeError(f"data_key should be a string or None, got {type(data_key)}")
    reader = spark.read.option("recursiveFileLookup", splits_in_folders)
    texts = reader.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("_src"))
    _check_json(texts)
    first = "$[0]" if data_key is None else f"$['{data_key}'][0]"
    order = _key_order(F.get_json_object("value", first), texts)
    strict = reader.options(multiLine=True, mode="FAILFAST")
    if schema is not None:
        strict = strict.schema(schema if data_key is None else f"`{data_key}` array<struct<{schema}>>")
    rows = strict.json(path)
    if data_key is not None:
        if data_key not in rows.columns:
            raise ValueError(f"Error trying to load the JSON dataset: no key {data_key} in {path}")
        out = _finish(rows, splits_in_folders)
        kept = [c for c in ("_src", "_blk", "split") if c in out.columns]
        if not order:
            raise ValueError(f"Error trying to load the JSON dataset: {path} holds no records")
        out = out.select(*kept, F.explode(F.col(f"`{data_key}`")).alias("_r")).select(*kept, "_r.*")
    else:
        out = _finish(_require_columns(rows, path, "JSON"), splits_in_folders)
        kept = [c for c in ("_src", "_blk", "split") if c in out.columns]
    out = _ordered(out, order, kept)
    return out if keep_source else _plain(out)


def read_json_lines(
    spark: SparkSession, path: str | list[str], splits_in_folders: bool = False,
    schema: str | None = None, keep_source: bool = False,
) -> DataFrame:
    """One JSON record per line; large files are split between tasks."""
    reader = spark.read.options(mode="FAILFAST", recursiveFileLookup=splits_in_folders)
    texts = spark.read.option("recursiveFileLookup", splits_in_folders).text(path)
    order = _key_order(F.col("value"), texts)
    if schema is not None:
        reader = reader.schema(schema)
    out = _finish(_require_columns(reader.json(path), path, "JSON"), splits_in_folders)
    kept = [c for c in ("_src", "_blk", "split") if c in out.columns]
    out = _ordered(out, order, kept)
    return out if keep_source else _plain(out)
