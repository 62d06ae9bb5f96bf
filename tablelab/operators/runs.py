"""Tables of experiments, runs and metrics, and the views people compare them in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelab import SPLITS
from tablelab.functions import format_timestamp, metric_column, run_status, two_decimals

# Run state codes.
NOT_STARTED, DELIVERED, STARTED, FINISHED, ERROR = range(5)

EXPERIMENTS = (
    "experiment_id string, name string, dataset string, task string, input_columns array<string>, "
    "output_columns array<string>, splits string, created timestamp, dataset_id string"
)
DATASETS = "dataset_id string, name string, path string, created timestamp"
# one row per state change; the newest row of a run is its current state
RUN_EVENTS = (
    "run_id string, experiment_id string, run_name string, model_name string, "
    "parameters map<string,string>, status int, event_time timestamp, model_path string, error string"
)
PREDICTIONS = (
    "prediction_id string, run_id string, status int, event_time timestamp, path string, error string"
)
RUN_METRICS = "run_id string, split string, metric string, value double"


def current_runs(events: DataFrame) -> DataFrame:
    """Current state of each run, with the times it was delivered, started and ended."""
    columns = [c for c in events.columns if c != "run_id"]
    newest = F.max_by(F.struct(*columns), F.struct("event_time", "status")).alias("now")
    at = lambda *codes: F.max(F.when(F.col("status").isin(*codes), F.col("event_time")))
    return (
        events.groupBy("run_id")
        .agg(
            newest,
            at(NOT_STARTED).alias("created"),
            at(DELIVERED).alias("delivery_time"),
            at(STARTED).alias("start_time"),
            at(FINISHED, ERROR).alias("end_time"),
        )
        .select("run_id", "now.*", "created", "delivery_time", "start_time", "end_time")
        .drop("event_time")
    )


def of_experiment(runs: DataFrame, experiment_id) -> DataFrame:
    """Runs (or explainers) that belong to one key."""
    return runs.filter(F.col("experiment_id") == experiment_id)


def finished(runs: DataFrame) -> DataFrame:
    return runs.filter(F.col("status") == FINISHED)


def leaderboard(
    runs: DataFrame, run_metrics: DataFrame, metrics: list[str], parameters: list[str] = ()
) -> DataFrame:
    """One row per run with ``train_F1``, ``test_F1``, ``val_F1``... as text with two decimals.

    The columns are known beforehand, so one conditional aggregate does it; runs without metrics
    stay. ``parameters`` become columns of their own.
    """
    cells = [(s, m) for s in SPLITS for m in metrics]
    columns = {"train": "train_", "test": "test_", "validation": "val_"}
    wide = run_metrics.groupBy("run_id").agg(*[
        F.max(F.when((F.col("split") == s) & (F.col("metric") == m), F.col("value"))).alias(columns[s] + m)
        for s, m in cells
    ])
    out = runs.join(wide, "run_id", "left")
    return out.select(
        *runs.columns,
        *[F.col("parameters")[p].alias(p) for p in parameters],
        *[
            F.when(F.col(columns[s] + m).isNotNull(), two_decimals(columns[s] + m)).alias(columns[s] + m)
            for s, m in cells
        ],
    )


def metric_series(
    runs: DataFrame, run_metrics: DataFrame, split: str | None = None, metric: str | None = None
) -> DataFrame:
    """Points to plot for the finished runs: all metrics of a split, or one metric in all splits."""
    points = run_metrics
    if split is not None:
        points = points.filter(F.col("split") == split)
    if metric is not None:
        points = points.filter(F.col("metric") == metric)
    named = finished(runs).select("run_id", "run_name")
    return points.join(named, "run_id").select(
        "run_id", "run_name", metric_column("split", "metric").alias("series"), "value"
    )


def runs_with_experiments(runs: DataFrame, experiments: DataFrame) -> DataFrame:
    """Finished runs with the name and task of their experiment."""
    about = experiments.select("experiment_id", F.col("name").alias("experiment_name"), "task")
    return finished(runs).join(about, "experiment_id")


def with_lineage(runs: DataFrame, experiments: DataFrame, datasets: DataFrame) -> DataFrame:
    """Runs with their experiment and its dataset. Small sides are broadcast by the planner's own
    size check, large ones are shuffled on the key."""
    about = experiments.select("experiment_id", F.col("name").alias("experiment_name"), "task", "dataset_id")
    return runs.join(about, "experiment_id").join(
        datasets.select("dataset_id", F.col("name").alias("dataset_name")), "dataset_id"
    )


def listing(runs: DataFrame) -> DataFrame:
    """Runs as shown to people: state as text, creation time formatted."""
    return runs.withColumn("status_text", run_status("status")).withColumn(
        "created_text", format_timestamp("created")
    )
