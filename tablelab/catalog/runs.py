"""Run tables taken from orders (runs), lineitem (metrics), customer (experiments), nation (datasets)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablelab.catalog.registry import query, table
from tablelab.operators import runs as rt

_RUNS_SQL = """runs AS (SELECT o_orderkey AS run_id, o_custkey AS experiment_id, 'run ' || o_orderkey AS run_name,
   CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN 1 ELSE 4 END AS status, o_orderdate AS created FROM orders)"""
_METRICS_SQL = """metrics AS (SELECT l_orderkey AS run_id,
    CASE l_returnflag WHEN 'A' THEN 'train' WHEN 'N' THEN 'test' ELSE 'validation' END AS split,
    CASE l_linestatus WHEN 'F' THEN 'F1' ELSE 'Accuracy' END AS metric,
    1 - avg(l_discount * 3.7123 + l_tax / 7.0301) AS value FROM lineitem GROUP BY ALL)"""
_EXPERIMENTS_SQL = """experiments AS (SELECT c_custkey AS experiment_id, c_name AS experiment_name,
    c_mktsegment AS task, c_nationkey AS dataset_id FROM customer)"""


def _runs(spark, sf):
    status = F.when(F.col("o_orderstatus") == "F", 3).when(F.col("o_orderstatus") == "O", 1).otherwise(4)
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("experiment_id"),
        F.concat(F.lit("run "), F.col("o_orderkey").cast("string")).alias("run_name"),
        status.alias("status"), F.col("o_orderdate").alias("created"),
    )


def _metrics(spark, sf):
    split = F.when(F.col("l_returnflag") == "A", "train").when(F.col("l_returnflag") == "N", "test")
    metric = F.when(F.col("l_linestatus") == "F", "F1").otherwise("Accuracy")
    return (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_orderkey").alias("run_id"), split.otherwise("validation").alias("split"), metric.alias("metric"))
        .agg((1 - F.avg(F.col("l_discount") * 3.7123 + F.col("l_tax") / 7.0301)).alias("value"))
    )


def _experiments(spark, sf):
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("experiment_id"), F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("task"), F.col("c_nationkey").alias("dataset_id"),
    )


_CELLS = ", ".join(
    f"""max(CASE WHEN split = '{s}' AND metric = '{m}' THEN format('{{:.2f}}', value) END) AS "{p}_{m}\""""
    for s, p in (("train", "train"), ("test", "test"), ("validation", "val"))
    for m in ("Accuracy", "F1")
)


@query(
    "leaderboard",
    f"""WITH {_RUNS_SQL}, {_METRICS_SQL}, w AS (SELECT run_id, {_CELLS} FROM metrics GROUP BY 1)
        SELECT runs.*, w.* EXCLUDE (run_id),
          CASE status WHEN 3 THEN 'Finished' WHEN 1 THEN 'Delivered' ELSE 'Error' END AS status_text,
          strftime(created, '%Y/%m/%d %H:%M') AS created_text
        FROM runs LEFT JOIN w USING (run_id)""",
)
def _leaderboard(spark, sf):
    return rt.listing(rt.leaderboard(_runs(spark, sf), _metrics(spark, sf), ["Accuracy", "F1"]))


_SERIES_SQL = f"""WITH {_RUNS_SQL}, {_METRICS_SQL}
  SELECT run_id, run_name, CASE split WHEN 'validation' THEN 'val' ELSE split END || '_' || metric AS series,
    round(value, 9) AS value FROM metrics JOIN runs USING (run_id) WHERE status = 3"""


@query("metric_series_by_split", _SERIES_SQL + " AND split = 'test'")
def _series_split(spark, sf):
    out = rt.metric_series(_runs(spark, sf), _metrics(spark, sf), split="test")
    return out.withColumn("value", F.round("value", 9))


@query("metric_series_by_metric", _SERIES_SQL + " AND metric = 'F1'")
def _series_metric(spark, sf):
    out = rt.metric_series(_runs(spark, sf), _metrics(spark, sf), metric="F1")
    return out.withColumn("value", F.round("value", 9))


@query(
    "runs_with_experiments",
    f"""WITH {_RUNS_SQL}, {_EXPERIMENTS_SQL} SELECT runs.*, experiment_name, task
        FROM runs JOIN experiments USING (experiment_id) WHERE status = 3""",
)
def _runs_with(spark, sf):
    return rt.runs_with_experiments(_runs(spark, sf), _experiments(spark, sf))


@query(
    "runs_lineage",
    f"""WITH {_RUNS_SQL}, {_EXPERIMENTS_SQL} SELECT runs.*, experiment_name, task, dataset_id, n_name AS dataset_name
        FROM runs JOIN experiments USING (experiment_id) JOIN nation ON n_nationkey = dataset_id""",
)
def _lineage(spark, sf):
    datasets = table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("dataset_id"), F.col("n_name").alias("name")
    )
    return rt.with_lineage(_runs(spark, sf), _experiments(spark, sf), datasets)


@query(
    "runs_of_experiment",
    f"WITH {_RUNS_SQL} SELECT * FROM runs WHERE experiment_id = 7",
)
def _runs_of(spark, sf):
    return rt.of_experiment(_runs(spark, sf), 7)


@query(
    "run_states",
    """WITH e AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 3 WHEN 'error' THEN 4 ELSE 2 END AS s FROM events)
       SELECT user_id AS run_id, arg_max(s, (ts, s)) AS status, max(ts) FILTER (WHERE s = 0) AS created,
         max(ts) FILTER (WHERE s = 1) AS delivery_time, max(ts) FILTER (WHERE s = 2) AS start_time,
         max(ts) FILTER (WHERE s IN (3, 4)) AS end_time FROM e GROUP BY 1""",
)
def _states(spark, sf):
    kind = F.col("event_type")
    status = F.when(kind == "view", 0).when(kind == "click", 1).when(kind == "purchase", 3).when(kind == "error", 4)
    events = table(spark, sf, "events").select(
        F.col("user_id").alias("run_id"), status.otherwise(2).alias("status"), F.col("ts").alias("event_time")
    )
    return rt.current_runs(events)
