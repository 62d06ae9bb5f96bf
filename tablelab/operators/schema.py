"""Column types: casts, label encoding and decoding."""

from __future__ import annotations

from pyspark.ml.feature import StringIndexerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelab import messages
from tablelab.operators.dataset import data_columns, is_label
from tablelab.operators.ranks import sorted_index
from tablelab.session import MAX_CLASSES

# Spark type for each type name of the column editor.
DTYPES = {
    "null": "string",
    "bool": "boolean",
    "int8": "tinyint",
    "int16": "smallint",
    "int32": "int",
    "int64": "bigint",
    "uint8": "smallint",
    "uint16": "int",
    "uint32": "bigint",
    "uint64": "decimal(20,0)",
    "float16": "float",
    "float32": "float",
    "float64": "double",
    "time32": "bigint",
    "time64": "bigint",
    "timestamp": "timestamp_ntz",
    "timestamp_tz": "timestamp",
    "date32": "date",
    "date64": "date",
    "duration": "interval day to second",
    "decimal128": "decimal(38,18)",
    "binary": "binary",
    "large_binary": "binary",
    "string": "string",
    "large_string": "string",
}


def spark_type(name: str) -> str:
    """Spark type of a type name; ``decimal256`` cannot be held and is refused."""
    if name.startswith("decimal256"):
        raise ValueError("decimals beyond 38 digits are not supported")
    return DTYPES.get(name, name)


def label_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-null values of a label column."""
    return df.select(column).filter(F.col(column).isNotNull()).distinct()


def label_names(df: DataFrame, column: str) -> list[str]:
    """Class names in code order: numbers by value, everything else as text.

    Collected over all splits, so a code means the same class everywhere.
    """
    dtype = df.schema[column].dataType
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        raise ValueError(f"column {column} holds fractions and cannot be made categorical")
    found = label_values(df, column).limit(MAX_CLASSES + 1).collect()
    if len(found) > MAX_CLASSES:
        raise ValueError(f"column {column} has more than {MAX_CLASSES} values, not a label")
    values = sorted(r[0] for r in found)
    if isinstance(dtype, T.BooleanType):
        return [str(v).lower() for v in values]
    return [str(v) for v in values]


def label_table(df: DataFrame, column: str) -> DataFrame:
    """``(value, code)`` of every class in code order, for any number of classes."""
    if isinstance(df.schema[column].dataType, (T.FloatType, T.DoubleType)):
        raise ValueError(f"column {column} holds fractions and cannot be made categorical")
    values = label_values(df, column).select(F.col(column).alias("value"))
    return sorted_index(values, "value", "code")


def encode_label(df: DataFrame, column: str, names: list[str] | None = None) -> DataFrame:
    """Replace a column by its class codes (double), names kept in the column metadata.

    A value outside ``names`` becomes null rather than a wrong class. Columns of more classes than
    metadata can hold are joined with ``label_table`` and get the same codes, without the names.
    """
    if is_label(df.schema[column]):
        return df
    if names is None and label_values(df, column).limit(MAX_CLASSES + 1).count() > MAX_CLASSES:
        codes = label_table(df, column).select(F.col("value").alias("_value"), F.col("code").alias("_code"))
        meta = {"ml_attr": {"type": "nominal", "name": column}}
        return (
            df.join(codes, F.col(column) == F.col("_value"), "left")
            .withColumn(column, F.col("_code").cast("double"))
            .select(*df.columns)
            .withMetadata(column, meta)
        )
    names = label_names(df, column) if names is None else names
    if not names:
        raise ValueError(f"column {column} has no values to encode")
    indexer = StringIndexerModel.from_arrays_of_labels(
        [names], inputCols=["_text"], outputCols=["_code"], handleInvalid="keep"
    )
    code = F.when(F.col("_code") < len(names), F.col("_code"))
    meta = {"ml_attr": {"type": "nominal", "name": column, "vals": names}}
    return (
        indexer.transform(df.withColumn("_text", F.col(column).cast("string")))
        .withColumn(column, code.alias(column, metadata=meta))
        .drop("_text", "_code")
        .withMetadata(column, meta)
    )


def class_names(df: DataFrame, column: str) -> list[str]:
    """Names stored with an encoded label column."""
    field = df.schema[column]
    if not is_label(field):
        raise ValueError(f"column {column} is not an encoded label")
    if "vals" not in field.metadata["ml_attr"]:
        raise ValueError(f"column {column} has too many classes to keep their names; see label_table")
    return list(field.metadata["ml_attr"]["vals"])


def decode(code, names: list[str]) -> Column:
    """Class name of a 0-based code; null for a code without a name."""
    c = F.col(code) if isinstance(code, str) else code
    return F.get(F.array(*[F.lit(n) for n in names]), c.cast("int"))


def change_columns_type(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Make columns ``Categorical`` (label codes) or ``Numerical`` (float32)."""
    for name, kind in types.items():
        if name not in df.columns:
            raise ValueError(messages.UNKNOWN_COLUMN.format(name=name))
        if kind == "Categorical":
            df = encode_label(df, name)
        elif kind == "Numerical":
            df = df.withColumn(name, F.col(name).cast("float"))
        else:
            raise ValueError(f"type should be Categorical or Numerical, got {kind}")
    return df


def update_columns_spec(df: DataFrame, spec: dict[str, tuple[str, str]]) -> DataFrame:
    """Apply ``{column: (kind, dtype)}``; a cell that cannot be cast fails the job under ANSI mode."""
    for name, (kind, dtype) in spec.items():
        if name not in df.columns:
            raise ValueError(f"column '{name}' does not exist in dataset.")
        if kind == "ClassLabel":
            df = encode_label(df, name)
        elif kind == "Value":
            df = df.withColumn(name, F.col(name).cast(spark_type(dtype)))
        else:
            raise ValueError(f"kind should be Value or ClassLabel, got {kind}")
    return df


def set_class_column(df: DataFrame, column: str | int) -> DataFrame:
    """Encode the class column, given by name or 0-based position."""
    if isinstance(column, bool) or not isinstance(column, (str, int)):
        raise TypeError(f"class column should be a name or a position, got {type(column)}")
    if isinstance(column, int):
        names = data_columns(df)
        if not 0 <= column < len(names):
            raise ValueError(f"class column {column} is out of range")
        column = names[column]
    elif column not in df.columns:
        raise ValueError(f"class column {column} does not exist in dataset.")
    return encode_label(df, column)


def cast_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast every named column to the type in ``schema``; other columns stay as they are."""
    casts = {f.name: F.col(f.name).cast(f.dataType) for f in schema.fields}
    missing = [n for n in casts if n not in df.columns]
    if missing:
        raise ValueError(f"columns not in the dataset: {', '.join(missing)}")
    return df.withColumns(casts)
