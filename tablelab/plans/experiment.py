"""Train-and-evaluate jobs whose state, metrics and models are kept as tables in one folder."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelab import SPLIT
from tablelab.models import fit, fit_text, load, save, score_by_name
from tablelab.operators import runs as rt
from tablelab.operators.dataset import validate_inputs_outputs
from tablelab.operators.metrics import classification_scores, scores_long
from tablelab.operators.splits import resplit
from tablelab.operators.tasks import compatible_metrics, prepare_for_task, validate_for_task
from tablelab.plans.tune import resolve_parameters, search


def _now() -> datetime:
    return datetime.now(timezone.utc)


class RunStore:
    """Append-only Parquet tables: ``datasets``, ``experiments``, ``run_events``, ``run_metrics``, ``trials``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _append(self, name: str, df: DataFrame) -> None:
        df.coalesce(1).write.mode("append").parquet(f"{self.path}/{name}")

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def add_dataset(self, name: str, path: str) -> str:
        dataset_id = uuid.uuid4().hex
        self._append("datasets", self.spark.createDataFrame([(dataset_id, name, path, _now())], rt.DATASETS))
        return dataset_id

    def add_experiment(
        self, name: str, dataset: str, task: str, inputs: list[str], outputs: list[str], splits: dict,
        dataset_id: str | None = None,
    ) -> str:
        experiment_id = uuid.uuid4().hex
        row = (experiment_id, name, dataset, task, inputs, outputs, json.dumps(splits), _now(), dataset_id)
        self._append("experiments", self.spark.createDataFrame([row], rt.EXPERIMENTS))
        return experiment_id

    def experiment(self, experiment_id: str) -> dict:
        found = self.experiments().filter(F.col("experiment_id") == experiment_id).take(1)
        if not found:
            raise ValueError(f"experiment {experiment_id} does not exist")
        out = found[0].asDict()
        out["splits"] = json.loads(out["splits"])
        return out

    def record(self, run: dict, status: int, model_path: str | None = None, error: str | None = None) -> None:
        parameters = {k: json.dumps(v) for k, v in run["parameters"].items()}
        row = (run["run_id"], run["experiment_id"], run["run_name"], run["model_name"], parameters,
               status, _now(), model_path, error)
        self._append("run_events", self.spark.createDataFrame([row], rt.RUN_EVENTS))

    def record_metrics(self, run_id: str, long_scores: DataFrame) -> None:
        rows = long_scores.select(F.lit(run_id).alias("run_id"), "split", "metric", F.col("value").cast("double"))
        self._append("run_metrics", rows)

    def record_trials(self, trials: DataFrame) -> None:
        self._append("trials", trials)

    def datasets(self) -> DataFrame:
        return self._read("datasets", rt.DATASETS)

    def experiments(self) -> DataFrame:
        return self._read("experiments", rt.EXPERIMENTS)

    def runs(self) -> DataFrame:
        return rt.current_runs(self._read("run_events", rt.RUN_EVENTS))

    def metrics(self) -> DataFrame:
        return self._read("run_metrics", rt.RUN_METRICS)

    def record_prediction(self, prediction_id: str, run_id: str, status: int, path: str, error: str | None = None) -> None:
        row = (prediction_id, run_id, status, _now(), path, error)
        self._append("predictions", self.spark.createDataFrame([row], rt.PREDICTIONS))

    def predictions(self) -> DataFrame:
        """Newest state of each prediction."""
        rows = self._read("predictions", rt.PREDICTIONS)
        newest = F.max_by(F.struct(*rows.columns), F.struct("event_time", "status")).alias("now")
        return rows.groupBy("prediction_id").agg(newest).select("now.*")

    def model_of(self, run_id: str):
        """The saved model of a finished run."""
        found = self.runs().filter(F.col("run_id") == run_id).take(1)
        if not found:
            raise ValueError(f"run {run_id} does not exist")
        if found[0]["status"] != rt.FINISHED:
            raise ValueError(f"run {run_id} has no finished model")
        return load(found[0]["model_path"])

    def trials(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/trials")


def create_run(
    store: RunStore, experiment_id: str, model_name: str, parameters: dict | None = None,
    run_name: str | None = None,
) -> dict:
    """Register a run that has not started."""
    run = {
        "run_id": uuid.uuid4().hex, "experiment_id": experiment_id, "model_name": model_name,
        "parameters": parameters or {}, "run_name": run_name or model_name,
    }
    store.record(run, rt.NOT_STARTED)
    return run


def run_experiment(
    store: RunStore, run: dict, df: DataFrame, metric: str = "Accuracy", n_trials: int = 10,
    sampler: str = "tpe", seed: int = 0,
):
    """Split, prepare, fit or tune, evaluate all splits, save; returns the fitted model.

    The model scores the data once and one confusion matrix gives all metrics of all splits. The
    run is only marked finished when metrics and model are stored; a failure marks it as an error.
    """
    store.record(run, rt.DELIVERED)
    try:
        spec = store.experiment(run["experiment_id"])
        task, inputs, outputs = spec["task"], spec["input_columns"], spec["output_columns"]
        store.record(run, rt.STARTED)
        validate_inputs_outputs(df, inputs, outputs)
        rows = prepare_for_task(resplit(df, spec["splits"]) if spec["splits"] else df, task, outputs)
        validate_for_task(rows, task, inputs, outputs, spec["dataset"])
        if task == "TextClassificationTask":
            def fit_one(train, params):
                return fit_text(train, run["model_name"], inputs[0], outputs[0], params)
        elif task == "TabularClassificationTask":
            def fit_one(train, params):
                return fit(train, run["model_name"], inputs, outputs[0], params)
        else:
            raise ValueError(f"{task} has no trainable models; score it with a model of your own")
        fixed, space = resolve_parameters(run["parameters"])
        if space:
            found = search(
                rows, lambda train, p: fit_one(train, {**fixed, **p}), outputs[0], space, metric,
                n_trials, sampler, seed, task=task,
            )
            store.record_trials(found.table(df.sparkSession, run["run_id"]))
            model = found.model
        else:
            model = fit_one(rows.filter(F.col(SPLIT) == "train"), fixed)
        scores = scores_long(classification_scores(model.transform(rows), outputs[0]))
        wanted = scores.filter(F.col("metric").isin(*compatible_metrics(task)))
        store.record_metrics(run["run_id"], wanted)
        path = f"{store.path}/models/{run['run_id']}"
        save(model, path)
    except Exception as e:
        store.record(run, rt.ERROR, error=str(e))
        raise
    store.record(run, rt.FINISHED, model_path=path)
    return model


def predict_run(store: RunStore, run_id: str, rows: DataFrame, path: str | None = None) -> DataFrame:
    """Score new rows with the model of a run, class names decoded, and keep the result as a table.

    The rows may have other columns and another order of columns; a missing input is an error. The state of
    the job is kept in the store's ``predictions``.
    """
    prediction_id = uuid.uuid4().hex
    path = path or f"{store.path}/predicted/{prediction_id}"
    store.record_prediction(prediction_id, run_id, rt.STARTED, path)
    try:
        scored = score_by_name(store.model_of(run_id), rows)
        scored.write.parquet(path)
    except Exception as e:
        store.record_prediction(prediction_id, run_id, rt.ERROR, path, str(e))
        raise
    store.record_prediction(prediction_id, run_id, rt.FINISHED, path)
    return store.spark.read.parquet(path)


def predict_arriving(store: RunStore, run_id: str, rows: DataFrame, path: str, checkpoint: str, once: bool = False):
    """The same for rows that keep arriving: every batch goes to a folder of its own, which a repeated batch
    replaces; returns the running query."""
    model = store.model_of(run_id)

    def batch(arrived: DataFrame, number: int) -> None:
        score_by_name(model, arrived).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
