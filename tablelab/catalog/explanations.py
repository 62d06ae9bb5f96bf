"""Explanations of fixed scorers, for which plain SQL gives the same numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablelab import ROW_ID, SPLIT
from tablelab.catalog.models import INPUTS, lineitem_dataset
from tablelab.catalog.registry import query, table
from tablelab.catalog.scoring import _LOGITS, _SPLIT
from tablelab.functions import feature_label, link_function, round3
from tablelab.models import fit
from tablelab.operators.schema import encode_label
from tablelab.operators.splits import split_exact
from tablelab.plans import explain as ex
from tablelab.plans.tree_shap import TreeShap

NAMES = ["A", "N", "R"]


def softmax_scorer(df):
    """Fixed linear scorer over lineitem, with softmax."""
    powers = [F.exp(F.expr(z)) for z in _LOGITS]
    total = powers[0] + powers[1] + powers[2]
    return df.withColumn("probability", F.array(*[p / total for p in powers]))


_TEST_SQL = f"""
  numbered AS (SELECT *, row_number() OVER () - 1 AS r FROM lineitem),
  placed AS (SELECT *, row_number() OVER (ORDER BY md5('11:' || r)) AS rn, count(*) OVER () AS n FROM numbered),
  test AS (SELECT * FROM (SELECT r, l_quantity, l_extendedprice, l_discount, l_tax,
                                 dense_rank() OVER (ORDER BY l_returnflag) - 1 AS y, {_SPLIT} AS split FROM placed)
           WHERE split = 'test')"""


def _few(i, c):
    return f"SELECT {i} AS f, row_number() OVER (ORDER BY {c}) - 1 AS pos, {c} AS v FROM (SELECT DISTINCT {c} FROM test)"


_PDP_SQL = f"""
  WITH {_TEST_SQL},
  q AS (SELECT quantile_cont(l_extendedprice, 0.05) AS lo, quantile_cont(l_extendedprice, 0.95) AS hi FROM test),
  grid AS ({_few(0, 'l_quantity')} UNION ALL {_few(2, 'l_discount')} UNION ALL {_few(3, 'l_tax')}
           UNION ALL SELECT 1, i, lo + i * ((hi - lo) / 99) FROM q, range(100) AS k(i)),
  tried AS (SELECT g.f, g.pos, g.v,
      CASE WHEN g.f = 0 THEN g.v ELSE l_quantity END AS l_quantity,
      CASE WHEN g.f = 1 THEN g.v ELSE l_extendedprice END AS l_extendedprice,
      CASE WHEN g.f = 2 THEN g.v ELSE l_discount END AS l_discount,
      CASE WHEN g.f = 3 THEN g.v ELSE l_tax END AS l_tax FROM test, grid g),
  z AS (SELECT f, pos, v, exp({_LOGITS[0]}) AS a, exp({_LOGITS[1]}) AS b, exp({_LOGITS[2]}) AS c FROM tried),
  m AS (SELECT f, pos, v, avg(a / (a + b + c)) AS a, avg(b / (a + b + c)) AS b, avg(c / (a + b + c)) AS c
        FROM z GROUP BY ALL),
  long AS (SELECT f, pos, v, 0 AS class, 'A' AS name, a AS p FROM m UNION ALL SELECT f, pos, v, 1, 'N', b FROM m
           UNION ALL SELECT f, pos, v, 2, 'R', c FROM m),
  named AS (SELECT *, ['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax'][f + 1] AS feature FROM long)
  SELECT feature, pos AS position, round_even(v, 3) AS grid_value, class,
    'Feature: ' || feature || ' - Class: ' || name AS series, round_even(p, 3) AS average FROM named"""


@query("pdp_linear", _PDP_SQL)
def _pdp(spark, sf):
    rows = lineitem_dataset(spark, sf).persist()
    return ex.partial_dependence(softmax_scorer, rows, INPUTS, NAMES).drop("grid_text")


_YHAT = "CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END"
_PFI_SQL = f"""
  WITH {_TEST_SQL},
  base AS (SELECT avg(CASE WHEN {_YHAT} = y THEN 1.0 ELSE 0.0 END) AS score
           FROM (SELECT y, {_LOGITS[0]} AS a, {_LOGITS[1]} AS b, {_LOGITS[2]} AS c FROM test)),
  receivers AS (SELECT *, row_number() OVER (ORDER BY md5('13:' || r)) AS place FROM test),
  cells AS (SELECT r, 0 AS f, l_quantity AS v FROM test UNION ALL SELECT r, 1, l_extendedprice FROM test
            UNION ALL SELECT r, 2, l_discount FROM test UNION ALL SELECT r, 3, l_tax FROM test),
  givers AS (SELECT f, rep, v, row_number() OVER (PARTITION BY f, rep ORDER BY md5('13:' || f || ':' || rep || ':' || r)) AS place
             FROM cells, range(5) AS k(rep)),
  tried AS (SELECT g.f, g.rep, y,
      CASE WHEN g.f = 0 THEN g.v ELSE l_quantity END AS l_quantity,
      CASE WHEN g.f = 1 THEN g.v ELSE l_extendedprice END AS l_extendedprice,
      CASE WHEN g.f = 2 THEN g.v ELSE l_discount END AS l_discount,
      CASE WHEN g.f = 3 THEN g.v ELSE l_tax END AS l_tax FROM receivers JOIN givers g USING (place)),
  z AS (SELECT f, rep, y, {_LOGITS[0]} AS a, {_LOGITS[1]} AS b, {_LOGITS[2]} AS c FROM tried),
  s AS (SELECT f, rep, avg(CASE WHEN {_YHAT} = y THEN 1.0 ELSE 0.0 END) AS score FROM z GROUP BY ALL)
  SELECT ['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax'][f + 1] AS feature,
    round_even(avg(base.score - s.score), 3) AS importance_mean,
    round_even(stddev_pop(base.score - s.score), 3) AS importance_std FROM s, base GROUP BY f"""


@query("pfi_linear", _PFI_SQL)
def _pfi(spark, sf):
    return ex.permutation_importance(softmax_scorer, lineitem_dataset(spark, sf), INPUTS, "l_returnflag", seed=13)


@query("pfi_top_features", f"SELECT * FROM ({_PFI_SQL}) ORDER BY importance_mean DESC, feature LIMIT 2")
def _pfi_top(spark, sf):
    return ex.top_features(_pfi(spark, sf), 2)


# --- SHAP over customers -------------------------------------------------------------------------

FEATURES = ["c_acctbal", "c_nationkey", "c_custkey"]
_LINEAR = "0.2 + 0.00005 * c_acctbal + 0.01 * c_nationkey + 0.1 * (c_custkey % 5)"
_CURVE = "1 / (1 + exp(-(0.0004 * c_acctbal - 0.1 * c_nationkey + 0.02 * (c_custkey % 50))))"


def customer_dataset(spark, sf):
    rows = table(spark, sf, "customer").select(
        F.col("c_custkey").alias(ROW_ID), "c_acctbal", F.col("c_nationkey").cast("double").alias("c_nationkey"),
        F.col("c_custkey").cast("double").alias("c_custkey"),
    )
    return split_exact(rows, 0.6, 0.2, 0.2, seed=17)


def _scorer(formula):
    def scorer(df):
        p = F.expr(formula)
        return df.withColumn("probability", F.array(1 - p, p))

    return scorer


def _shap(spark, sf, formula, link="identity", sample=True):
    rows = customer_dataset(spark, sf)
    shap = ex.KernelShap(_scorer(formula), FEATURES, ["low", "high"], link)
    shap.fit(rows, sample_background=sample, n_background=50, seed=21)
    return shap, shap.explain(rows)


_TRAIN_SQL = f"""
  placed AS (SELECT *, row_number() OVER (ORDER BY md5('17:' || c_custkey)) AS rn, count(*) OVER () AS n FROM customer),
  train AS (SELECT * FROM (SELECT *, {_SPLIT} AS split FROM placed) WHERE split = 'train'),
  background AS (SELECT c_acctbal, c_nationkey, c_custkey FROM train ORDER BY md5('21:' || c_custkey) LIMIT 50)"""
_ALL_TRAIN_SQL = _TRAIN_SQL.replace(" ORDER BY md5('21:' || c_custkey) LIMIT 50", "")


def _shap_sql(formula, source=_TRAIN_SQL, link="p"):
    """Shapley values by their definition, from the mean score of every feature subset."""
    on = lambda j, c: f"CASE WHEN (s >> {j}) & 1 = 1 THEN i.{c} ELSE b.{c} END AS {c}"
    return f"""
      WITH {source},
      mixed AS (SELECT i.c_custkey AS id, s, {on(0, 'c_acctbal')}, {on(1, 'c_nationkey')}, {on(2, 'c_custkey')}
                FROM customer i, range(8) AS k(s), background b),
      v1 AS (SELECT id, s, avg({formula}) AS p FROM mixed GROUP BY ALL),
      v AS (SELECT id, s, 1 AS class, {link} AS v, p FROM v1
            UNION ALL SELECT id, s, 0, {link.replace('p', '(1 - p)')}, 1 - p FROM v1),
      phi AS (SELECT a.id, a.class, j,
                sum((b.v - a.v) * CASE bit_count(a.s::INTEGER) WHEN 1 THEN 1.0 / 6 ELSE 1.0 / 3 END) AS phi
              FROM range(3) AS f(j) JOIN v a ON (a.s >> j) & 1 = 0
              JOIN v b ON b.id = a.id AND b.class = a.class AND b.s = a.s + (1 << j) GROUP BY ALL),
      pred AS (SELECT id, max(p) FILTER (WHERE class = 0) AS p0, max(p) FILTER (WHERE class = 1) AS p1
               FROM v WHERE s = 7 GROUP BY 1)
      SELECT id AS instance_id, class, ['c_acctbal', 'c_nationkey', 'c_custkey'][j + 1] AS feature,
        round_even(phi, 3) AS shap, round(p0, 6) AS p_low, round(p1, 6) AS p_high
      FROM phi JOIN pred USING (id)"""


def _shown(explained, digits=6):
    return explained.select(
        "instance_id", "class", "feature", "shap",
        F.round(F.get("model_prediction", F.lit(0)), digits).alias("p_low"),
        F.round(F.get("model_prediction", F.lit(1)), digits).alias("p_high"),
    )


_OWN = {"c_acctbal": "0.00005 * c_acctbal", "c_nationkey": "0.01 * c_nationkey", "c_custkey": "0.1 * (c_custkey % 5)"}


@query(
    "shap_linear",
    f"WITH {_TRAIN_SQL}, phi AS ("
    + " UNION ALL ".join(
        f"SELECT c_custkey AS id, '{c}' AS feature, {e} - (SELECT avg({e}) FROM background) AS phi FROM customer"
        for c, e in _OWN.items()
    )
    + f""") SELECT id AS instance_id, class, feature, round_even(CASE class WHEN 1 THEN phi ELSE -phi END, 3) AS shap,
         round(1 - ({_LINEAR}), 9) AS p_low, round({_LINEAR}, 9) AS p_high
       FROM phi JOIN customer ON c_custkey = id, (VALUES (0), (1)) AS k(class)""",
)
def _shap_linear(spark, sf):
    return _shown(_shap(spark, sf, _LINEAR)[1], digits=9)


@query("shap_logistic", _shap_sql(_CURVE))
def _shap_logistic(spark, sf):
    return _shown(_shap(spark, sf, _CURVE)[1])


@query("shap_logit_link", _shap_sql(_CURVE, link="ln(p / (1 - p))"))
def _shap_logit(spark, sf):
    return _shown(_shap(spark, sf, _CURVE, "logit")[1])


@query("shap_whole_background", _shap_sql(_CURVE, _ALL_TRAIN_SQL))
def _shap_whole(spark, sf):
    return _shown(_shap(spark, sf, _CURVE, sample=False)[1])


_BASE_SQL = f"""WITH {_TRAIN_SQL}, m AS (SELECT avg({_CURVE}) AS p FROM background)
  SELECT class, round_even(CASE class WHEN 1 THEN p ELSE 1 - p END, 3) AS base_value FROM m, (VALUES (0), (1)) AS k(class)"""


@query("shap_base_values", _BASE_SQL)
def _base(spark, sf):
    return _shap(spark, sf, _CURVE)[0].base_values()


_TOP_SQL = f"""
  WITH e AS ({_shap_sql(_CURVE)}),
  p AS (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY abs(shap) DESC, feature) AS place
        FROM e WHERE class = CASE WHEN p_high > p_low THEN 1 ELSE 0 END)
  SELECT instance_id, class, least(place, 2) AS place, CASE WHEN place > 1 THEN 'Others' ELSE feature END AS feature,
    round_even(sum(shap), 3) AS shap, max(greatest(p_low, p_high)) AS probability FROM p GROUP BY ALL"""


@query("shap_top_others", _TOP_SQL)
def _top(spark, sf):
    out = ex.top_contributions(_shap(spark, sf, _CURVE)[1], 1)
    return out.withColumn("probability", F.round("probability", 6)).drop("value")


@query(
    "waterfall",
    f"""WITH t AS ({_TOP_SQL}), b AS ({_BASE_SQL}),
      x AS (SELECT t.*, base_value, c.c_acctbal, c.c_nationkey,
              CASE feature WHEN 'c_acctbal' THEN 'c_acctbal=' || c.c_acctbal
                WHEN 'c_nationkey' THEN 'c_nationkey=' || c.c_nationkey || '.0'
                WHEN 'c_custkey' THEN 'c_custkey=' || c.c_custkey || '.0' ELSE 'Others=None' END AS label
            FROM t JOIN b USING (class) JOIN customer c ON c.c_custkey = t.instance_id)
      SELECT instance_id, CASE class WHEN 1 THEN 'high' ELSE 'low' END AS predicted_class, base_value, label,
        row_number() OVER w AS step, shap, round_even(base_value + sum(shap) OVER w, 3) AS running_total
      FROM x WINDOW w AS (PARTITION BY instance_id ORDER BY place DESC)""",
)
def _waterfall(spark, sf):
    shap, explained = _shap(spark, sf, _CURVE)
    return ex.waterfall(explained, shap.base_values(), ["low", "high"], 1).drop("predicted_probability")


@query("background_sample", f"WITH {_TRAIN_SQL} SELECT c_acctbal, CAST(c_nationkey AS DOUBLE) AS c_nationkey, CAST(c_custkey AS DOUBLE) AS c_custkey, CAST(1 AS DOUBLE) AS weight FROM background")
def _background(spark, sf):
    rows = customer_dataset(spark, sf).filter(F.col(SPLIT) == "train")
    return ex.background_sample(rows, FEATURES, 50, "shuffle", seed=21)


@query("kmeans_background")
def _kmeans(spark, sf):
    rows = lineitem_dataset(spark, sf)
    return ex.background_sample(rows, INPUTS, 10, "kmeans", seed=1)


@query(
    "explanation_scalars",
    """SELECT p_partkey, round_even(p_retailprice / 7, 3) AS rounded, 'p_brand=' || p_brand AS label,
         round(ln((p_size / 100.0) / (1 - p_size / 100.0)), 9) AS log_odds, abs(p_size - 25) AS size_from_mid,
         row_number() OVER (PARTITION BY p_brand ORDER BY abs(p_size - 25) DESC, p_partkey) AS place FROM part""",
)
def _scalars(spark, sf):
    from pyspark.sql import Window

    part = table(spark, sf, "part").withColumn("size_from_mid", F.abs(F.col("p_size") - 25))
    order = Window.partitionBy("p_brand").orderBy(F.desc("size_from_mid"), "p_partkey")
    return part.select(
        "p_partkey", round3(F.col("p_retailprice") / 7).alias("rounded"),
        feature_label(F.lit("p_brand"), "p_brand").alias("label"),
        F.round(link_function(F.col("p_size") / 100.0, "logit"), 9).alias("log_odds"),
        "size_from_mid", F.row_number().over(order).alias("place"),
    )


# --- SHAP on trees -------------------------------------------------------------------------------

_RULE = "CASE WHEN floor(c_acctbal / 1000) >= 5 AND c_nationkey > 12 THEN 1.0 ELSE 0.0 END"


@query("shap_tree", f"SELECT instance_id, class, feature, shap FROM ({_shap_sql(_RULE, _ALL_TRAIN_SQL)})")
def _shap_tree(spark, sf):
    """A tree that learnt a rule of two inputs, explained against all training rows."""
    rows = customer_dataset(spark, sf).withColumn("c_acctbal", F.floor(F.col("c_acctbal") / 1000).cast("double"))
    high = (F.col("c_acctbal") >= 5) & (F.col("c_nationkey") > 12)
    rows = encode_label(rows.withColumn("side", F.when(high, "high").otherwise("low")), "side", ["low", "high"])
    model = fit(rows, "DecisionTreeClassifier", FEATURES, "side", {"max_depth": None})
    shap = TreeShap(model).fit(rows.filter(F.col(SPLIT) == "train"))
    return shap.explain(rows).select("instance_id", "class", "feature", "shap")
