"""Hyperparameter search and trial histories."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tablelab import ROW_ID
from tablelab.catalog.registry import deal, query, table
from tablelab.catalog.scoring import _SPLIT
from tablelab.models import fit
from tablelab.operators.dataset import with_row_ids
from tablelab.operators.schema import encode_label
from tablelab.operators.splits import split_exact
from tablelab.plans.tune import best_trial, resolve_parameters, running_best, search


def _trials(spark, sf):
    order = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("run_id"),
        (F.row_number().over(order) - 1).alias("trial"),
        F.col("o_orderpriority").alias("params"),
        F.round(F.col("o_totalprice") / 1000, 0).alias("score"),
    )


_TRIALS_SQL = """SELECT o_custkey AS run_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS trial,
                   o_orderpriority AS params, round(o_totalprice / 1000, 0) AS score FROM orders"""


@query(
    "running_best",
    f"""SELECT *, max(score) OVER (PARTITION BY run_id ORDER BY trial
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running_best FROM ({_TRIALS_SQL})""",
)
def _running_best(spark, sf):
    return running_best(_trials(spark, sf))


@query(
    "best_trial",
    f"SELECT * FROM ({_TRIALS_SQL}) QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY score DESC, trial) = 1",
)
def _best_trial(spark, sf):
    return best_trial(_trials(spark, sf))


def _tune(spark, sf, sampler):
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias(ROW_ID), "quality")
    documents = table(spark, sf, "documents").select(F.col("doc_id").alias(ROW_ID), "lang", "n_chars")
    rows = encode_label(split_exact(labels.join(documents, ROW_ID), 0.6, 0.2, 0.2, seed=3), "quality")
    fixed, space = resolve_parameters({
        "criterion": "gini",
        "max_depth": {"optimize": True, "fixed_value": 1, "lower_bound": 1, "upper_bound": 8},
        "min_samples_leaf": {"optimize": True, "fixed_value": 1, "lower_bound": 1, "upper_bound": 5},
    })

    def fit_one(train, params):
        return fit(train, "DecisionTreeClassifier", ["lang", "n_chars"], "quality", {**fixed, **params})

    found = search(rows, fit_one, "quality", space, "F1", n_trials=8, sampler=sampler, seed=1)
    return found.table(spark, sampler)


@query("tune_random")
def _tune_random(spark, sf):
    return _tune(spark, sf, "random")


@query("tune_tpe")
def _tune_tpe(spark, sf):
    return _tune(spark, sf, "tpe")


@query(
    "tune_grid",
    f"""WITH numbered AS (SELECT *, row_number() OVER () - 1 AS r FROM lineitem),
          placed AS (SELECT *, row_number() OVER (ORDER BY md5('11:' || r)) AS rn, count(*) OVER () AS n FROM numbered),
          v AS (SELECT round(l_discount * 100) >= 5 AS a, l_quantity >= 6 AS b FROM (SELECT *, {_SPLIT} AS split FROM placed)
                WHERE split = 'validation'),
          s AS (SELECT avg(CASE WHEN a AND NOT b THEN 0.0 ELSE 1.0 END) AS one_level FROM v),
          g AS (SELECT trial, CASE WHEN trial < 2 THEN 1 ELSE 2 END AS depth, 1 + trial % 2 AS leaf FROM range(4) AS t(trial))
        SELECT CAST(trial AS INTEGER) AS trial, CAST(depth AS DOUBLE) AS max_depth, CAST(leaf AS DOUBLE) AS min_samples_leaf,
          round(CASE WHEN depth = 1 THEN one_level ELSE 1.0 END, 9) AS score,
          round(CASE WHEN depth = 1 THEN one_level ELSE 1.0 END, 9) AS running_best FROM g, s""",
)
def _tune_grid(spark, sf):
    """The label is ``a and b``: one level finds ``a`` only, two find both."""
    a, b = F.round(F.col("l_discount") * 100) >= 5, F.col("l_quantity") >= 6
    rows = with_row_ids(table(spark, sf, "lineitem")).select(
        ROW_ID, a.cast("double").alias("a"), b.cast("double").alias("b"),
        F.when(a & b, "yes").otherwise("no").alias("label"))
    rows = deal(encode_label(split_exact(rows, 0.6, 0.2, 0.2, seed=11), "label"))
    fixed, space = resolve_parameters({
        "max_depth": {"optimize": True, "fixed_value": 1, "lower_bound": 1, "upper_bound": 2},
        "min_samples_leaf": {"optimize": True, "fixed_value": 1, "lower_bound": 1, "upper_bound": 2},
    })

    def fit_one(train, params):
        return fit(train, "DecisionTreeClassifier", ["a", "b"], "label", {**fixed, **params})

    found = search(rows, fit_one, "label", space, "Accuracy", sampler="grid").table(spark, "grid")
    return found.select("trial", F.col("params")["max_depth"].alias("max_depth"),
                        F.col("params")["min_samples_leaf"].alias("min_samples_leaf"),
                        F.round("score", 9).alias("score"), F.round("running_best", 9).alias("running_best"))
