"""Scoring new rows with a fitted or a user-supplied model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelab.operators.dataset import reindex_columns
from tablelab.operators.schema import decode


def score(model: PipelineModel, df: DataFrame, schema: T.StructType | None = None) -> DataFrame:
    """Add ``probability`` and ``prediction``; ``schema`` brings the columns into training order,
    drops the others and fills missing ones with null. Works on batch and streaming frames alike."""
    return model.transform(df if schema is None else reindex_columns(df, schema))


def score_by_name(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Score rows whose columns come in any order, with the input columns and class names kept in the model:
    adds ``class``, the name of the predicted class. Columns that are no inputs stay."""
    if not hasattr(model, "class_names"):
        raise ValueError("the model was saved without its class names")
    missing = [c for c in model.input_schema.names if c not in df.columns]
    if missing:
        raise ValueError(f"columns missing for this model: {', '.join(missing)}")
    others = [F.col(f"`{c}`") for c in df.columns if c not in model.input_schema.names]
    inputs = [F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in model.input_schema.fields]
    scored = model.transform(df.select(*others, *inputs))
    return scored.withColumn("class", decode("prediction", model.class_names))


def score_with(
    df: DataFrame,
    load_model: Callable[[], object],
    predict: Callable[[object, pd.DataFrame], pd.DataFrame],
    schema: str,
) -> DataFrame:
    """Score with any model Python can load: once per task, then batch after batch of rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load_model()
        for batch in batches:
            yield predict(model, batch)

    return df.mapInPandas(run, schema)
