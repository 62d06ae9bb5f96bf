"""Converter for the old ``{split: {x: [...], y: [...]}}`` layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelab import SPLITS


def read_legacy_xy(spark: SparkSession, path: str) -> DataFrame:
    """Row records with ``split``, ``class`` and either ``text`` or ``feature_0``, ``feature_1``..."""
    return legacy_rows(spark.read.option("multiLine", True).json(path))


def legacy_rows(documents: DataFrame) -> DataFrame:
    """The same for documents already read."""
    parts = []
    for split in SPLITS:
        if split in documents.columns:
            pairs = F.explode(F.arrays_zip(F.col(f"{split}.x").alias("x"), F.col(f"{split}.y").alias("y")))
            parts.append(documents.select(F.lit(split).alias("split"), pairs.alias("p")))
    if not parts:
        raise ValueError("no train, test or validation part found")
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    label = F.col("p.y").alias("class")
    if isinstance(rows.schema["p"].dataType["x"].dataType, T.StringType):
        return rows.select(F.col("p.x").alias("text"), label, "split")
    width = rows.agg(F.max(F.size("p.x"))).first()[0] or 0
    features = [F.get("p.x", F.lit(i)).alias(f"feature_{i}") for i in range(width)]
    return rows.select(*features, label, "split")
