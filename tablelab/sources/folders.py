"""Layouts in which folders carry meaning: splits, and labels of image or audio files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Folder name of each split.
SPLIT_FOLDERS = {"train": "train", "test": "test", "val": "validation", "validation": "validation"}

_SPLIT_PART = r".*/(train|test|val|validation)/[^/]*(?:/[^/]*)?$"

# Where a row comes from; kept until row ids are assigned.
SOURCE_FILE, SOURCE_BLOCK = "_src", "_blk"


def split_of(path: Column) -> Column:
    """Split named by a folder of the path; null when there is none."""
    folder = F.regexp_extract(path, _SPLIT_PART, 1)
    return F.when(folder == "val", "validation").when(folder != "", folder)


def located(df: DataFrame) -> DataFrame:
    """Add the source file and block of every row of a file scan."""
    return df.select(
        "*", F.col("_metadata.file_path").alias(SOURCE_FILE),
        F.col("_metadata.file_block_start").cast("long").alias(SOURCE_BLOCK),
    )


def check_split_folders(df: DataFrame) -> None:
    """Every file of a scan must lie in a split folder. Looks at the file listing only."""
    names = df.inputFiles()
    if not names:
        raise ValueError("no files found")
    outside = [n for n in names if n.rsplit("/", 2)[-2] not in SPLIT_FOLDERS]
    if outside:
        raise ValueError(f"files outside train, test, val or validation: {', '.join(outside)}")


def read_labelled_files(spark: SparkSession, path: str, glob: str = "*", kind: str = "image") -> DataFrame:
    """Undecoded files under one folder per label: ``path, <kind>, label, split``.

    Split folders above the label folders are honoured; otherwise all rows are ``train``.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob)
        .load(path)
    )
    split = F.coalesce(split_of(F.col("path")), F.lit("train"))
    return files.select(
        "path", F.col("content").alias(kind),
        F.element_at(F.split("path", "/"), -2).alias("label"), split.alias("split"),
    )
