"""Supervised tasks: which columns they accept, how they prepare a dataset, which metrics apply."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tablelab.operators.dataset import column_names, data_columns, is_label, validate_inputs_outputs
from tablelab.operators.schema import encode_label

_CLASSIFICATION = ("Accuracy", "Precision", "Recall", "F1")


@dataclass(frozen=True)
class Task:
    """Accepted column kinds, number of columns (``"n"`` for any) and metrics of a task."""

    name: str
    inputs_types: tuple[str, ...]
    outputs_types: tuple[str, ...]
    inputs_cardinality: int | str
    outputs_cardinality: int | str
    metrics: tuple[str, ...]
    encodes_output: bool = True


# The four tasks.
TASKS = {
    "TabularClassificationTask": Task(
        "TabularClassificationTask", ("ClassLabel", "Value"), ("ClassLabel",), "n", 1, _CLASSIFICATION
    ),
    "TextClassificationTask": Task(
        "TextClassificationTask", ("Value",), ("ClassLabel",), 1, 1, _CLASSIFICATION
    ),
    "ImageClassificationTask": Task(
        "ImageClassificationTask", ("Image",), ("ClassLabel",), 1, 1, _CLASSIFICATION
    ),
    "TranslationTask": Task(
        "TranslationTask", ("Value", "Sequence"), ("Value", "Sequence"), 1, 1, ("Bleu", "Ter"),
        encodes_output=False,
    ),
}


def task(name: str) -> Task:
    if name not in TASKS:
        raise ValueError(f"{name} is not a task; choose from {', '.join(TASKS)}")
    return TASKS[name]


def metadata(name: str) -> dict:
    """Accepted types and cardinalities of a task."""
    t = task(name)
    return {
        "inputs_types": list(t.inputs_types),
        "outputs_types": list(t.outputs_types),
        "inputs_cardinality": t.inputs_cardinality,
        "outputs_cardinality": t.outputs_cardinality,
    }


def column_kind(field: T.StructField) -> str:
    """``ClassLabel``, ``Image``, ``Sequence`` or ``Value``."""
    if is_label(field):
        return "ClassLabel"
    if isinstance(field.dataType, T.BinaryType):
        return "Image"
    if isinstance(field.dataType, T.ArrayType):
        return "Sequence"
    return "Value"


def validate_for_task(
    df: DataFrame, name: str, inputs: list[str], outputs: list[str], dataset_name: str = "dataset"
) -> None:
    """Column kinds and counts must fit the task. One schema covers every split."""
    t = task(name)
    checks = (
        ("inputs", inputs, t.inputs_types, t.inputs_cardinality),
        ("outputs", outputs, t.outputs_types, t.outputs_cardinality),
    )
    for role, names, kinds, cardinality in checks:
        for c in names:
            kind = column_kind(df.schema[c])
            if kind not in kinds:
                raise TypeError(
                    f"Error in the {role} of {dataset_name}: column {c} is {kind}, "
                    f"{name} takes {' or '.join(kinds)}"
                )
        if cardinality != "n" and len(names) != cardinality:
            raise ValueError(
                f"Error in the {role} of {dataset_name}: {name} takes {cardinality} "
                f"column(s), got {len(names)}"
            )


def prepare_for_task(df: DataFrame, name: str, outputs: list[str]) -> DataFrame:
    """Encode the output labels where the task needs classes; translation stays unchanged."""
    if task(name).encodes_output:
        for c in outputs:
            df = encode_label(df, c)
    return df


def validation_report(
    df: DataFrame, name: str, inputs: list[int], outputs: list[int], dataset_name: str = "dataset"
) -> DataFrame:
    """One row: ``valid``, or ``invalid`` with the reason. Columns are 1-based positions."""
    try:
        ins, outs = column_names(df, inputs), column_names(df, outputs)
        validate_inputs_outputs(df, ins, outs)
        validate_for_task(prepare_for_task(df, name, outs), name, ins, outs, dataset_name)
        row = ("valid", "")
    except (TypeError, ValueError) as e:
        row = ("invalid", str(e))
    return df.sparkSession.createDataFrame([row], "dataset_status string, error string")


def validate_instances(df: DataFrame, needed: list[str]) -> DataFrame:
    """One row telling whether all needed columns are there, and which are missing."""
    missing = [c for c in needed if c not in data_columns(df)]
    row = ("invalid" if missing else "valid", ",".join(missing))
    return df.sparkSession.createDataFrame([row], "dataset_status string, missing string")


def compatible_metrics(name: str) -> tuple[str, ...]:
    """Metrics that can score a task."""
    return task(name).metrics
