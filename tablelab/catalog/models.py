"""Classifiers fitted and scored on the test tables."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tablelab import ROW_ID, SPLIT
from tablelab.catalog.registry import TEXT_ROWS, deal, query, table
from tablelab.models import fit, fit_text, load, save, score
from tablelab.models.classifiers import FEATURES
from tablelab.models.knn import fit_knn
from tablelab.models.lsh import measured_recall
from tablelab.models.stages import ClassProbabilities
from tablelab.operators.dataset import with_row_ids
from tablelab.operators.features import tokens
from tablelab.operators.metrics import classification_scores
from tablelab.operators.schema import class_names, decode, encode_label
from tablelab.operators.splits import split_exact
from tablelab.plans.experiment import RunStore, create_run, predict_run, run_experiment
from tablelab.session import materialize, scratch_path

INPUTS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def lineitem_dataset(spark, sf, label="l_returnflag"):
    rows = with_row_ids(table(spark, sf, "lineitem")).select(ROW_ID, *INPUTS, label)
    return deal(encode_label(split_exact(rows, 0.6, 0.2, 0.2, seed=11), label))


def _priors_sql(value: str) -> str:
    return f"""WITH c AS (SELECT l_returnflag AS class, count(*) AS n FROM lineitem GROUP BY 1),
      p AS (SELECT class, n / sum(n) OVER () AS p, row_number() OVER (ORDER BY n DESC, class) AS top,
                   count(*) OVER () AS k FROM c)
      SELECT l_orderkey, l_linenumber, round((SELECT {value} FROM p WHERE class = 'A'), 9) AS p_a,
        round((SELECT {value} FROM p WHERE class = 'N'), 9) AS p_n,
        round((SELECT {value} FROM p WHERE class = 'R'), 9) AS p_r FROM lineitem"""


def _dummy(spark, sf, strategy):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    rows = encode_label(rows, "l_returnflag")
    model = fit(rows, "DummyClassifier", [], "l_returnflag", {"strategy": strategy})
    p = [F.round(F.get("probability", F.lit(i)), 9).alias(n) for i, n in enumerate(("p_a", "p_n", "p_r"))]
    return score(model, rows).select("l_orderkey", "l_linenumber", *p)


@query("dummy_prior", _priors_sql("p"))
def _dummy_prior(spark, sf):
    return _dummy(spark, sf, "prior")


@query("dummy_most_frequent", _priors_sql("CAST(CASE WHEN top = 1 THEN 1 ELSE 0 END AS DOUBLE)"))
def _dummy_frequent(spark, sf):
    return _dummy(spark, sf, "most_frequent")


@query("dummy_uniform", _priors_sql("1.0 / k"))
def _dummy_uniform(spark, sf):
    return _dummy(spark, sf, "uniform")


@query(
    "dummy_stratified",
    """WITH c AS (SELECT o_orderpriority AS class, count(*) AS n FROM orders GROUP BY 1),
       b AS (SELECT class, sum(n) OVER (ORDER BY class) / sum(n) OVER () AS upto FROM c),
       u AS (SELECT o_orderkey, CAST('0x' || substr(md5('0:' || o_orderkey), 1, 13) AS BIGINT)
                / 4503599627370496.0 AS u FROM orders)
       SELECT o_orderkey AS _row_id, CAST((SELECT count(*) FROM b WHERE upto <= u) AS DOUBLE) AS prediction
       FROM u""",
)
def _dummy_stratified(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias(ROW_ID), "o_orderpriority")
    rows = encode_label(rows, "o_orderpriority")
    model = fit(rows, "DummyClassifier", [], "o_orderpriority", {"strategy": "stratified"})
    return score(model, rows).select(ROW_ID, "prediction")


def _knn_sql(vote: str) -> str:
    return f"""
      WITH placed AS (SELECT *, row_number() OVER (ORDER BY md5('5:' || vec_id)) AS rn, count(*) OVER () AS n FROM embeddings),
      train AS (SELECT * FROM placed WHERE rn <= floor(0.7 * n + 1e-9)),
      d AS (SELECT q.vec_id AS qid, t.vec_id AS id, t.label,
              sqrt(list_sum(list_transform(range(1, len(q.embedding) + 1),
                lambda i: (q.embedding[i]::DOUBLE - t.embedding[i]::DOUBLE) * (q.embedding[i]::DOUBLE - t.embedding[i]::DOUBLE)))) AS d
            FROM embeddings q, train t),
      best AS (SELECT *, bool_or(d = 0) OVER (PARTITION BY qid) AS same
               FROM (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY qid ORDER BY d, id) <= 5)),
      v AS (SELECT qid, label, sum({vote}) AS v FROM best GROUP BY ALL),
      w AS (SELECT qid, label, v / sum(v) OVER (PARTITION BY qid) AS p FROM v)
      SELECT qid AS vec_id, CAST(arg_max(label, (p, -label)) AS DOUBLE) AS prediction, round(max(p), 6) AS top
      FROM (SELECT qid, label, round(p, 9) AS p FROM w) GROUP BY 1"""


def embedding_dataset(spark, sf):
    rows = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias(ROW_ID), "label",
        array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias(FEATURES),
    )
    return encode_label(split_exact(rows, 0.7, 0.15, 0.15, seed=5), "label")


def _knn(spark, sf, weights, broadcast_bytes=None):
    rows = embedding_dataset(spark, sf)
    model = fit_knn(rows.filter("split = 'train'"), FEATURES, "label", 10, 5, weights)
    if broadcast_bytes is not None:
        model.broadcast_bytes = broadcast_bytes
    scored = ClassProbabilities(vectors=["_probability"]).transform(model.transform(rows))
    # equal votes go to the lowest class on both sides once rounding noise is gone
    p = F.transform("probability", lambda x: F.round(x, 9))
    return scored.select(
        F.col(ROW_ID).alias("vec_id"),
        (F.array_position(p, F.array_max(p)) - 1).cast("double").alias("prediction"),
        F.round(F.array_max("probability"), 6).alias("top"),
    )


@query("knn_uniform", _knn_sql("1.0"))
def _knn_uniform(spark, sf):
    return _knn(spark, sf, "uniform")


@query("knn_distance", _knn_sql("CASE WHEN same THEN CASE WHEN d = 0 THEN 1.0 ELSE 0.0 END ELSE 1 / d END"))
def _knn_distance(spark, sf):
    return _knn(spark, sf, "distance")


@query("knn_blocked", _knn_sql("CASE WHEN same THEN CASE WHEN d = 0 THEN 1.0 ELSE 0.0 END ELSE 1 / d END"))
def _knn_blocked(spark, sf):
    # no broadcast at all: the way taken when the training rows do not fit an executor
    return _knn(spark, sf, "distance", broadcast_bytes=0)


def _evaluate(spark, sf, name, params):
    rows = lineitem_dataset(spark, sf)
    model = fit(rows.filter(F.col(SPLIT) == "train"), name, INPUTS, "l_returnflag", params)
    return classification_scores(score(model, rows), "l_returnflag")


@query("logreg")
def _logreg(spark, sf):
    return _evaluate(spark, sf, "LogisticRegression", {"max_iter": 50})


@query("dtree")
def _dtree(spark, sf):
    return _evaluate(spark, sf, "DecisionTreeClassifier", {"max_depth": 5, "max_features": "sqrt"})


@query("forest")
def _forest(spark, sf):
    return _evaluate(spark, sf, "RandomForestClassifier", {"n_estimators": 20, "max_depth": 5})


@query("gbt")
def _gbt(spark, sf):
    return _evaluate(spark, sf, "HistGradientBoostingClassifier", {"max_iter": 10, "max_depth": 3})


@query("svc_linear")
def _svc_linear(spark, sf):
    return _evaluate(spark, sf, "SVC", {"kernel": "linear", "max_iter": 20})


@query("svc_rbf")
def _svc_rbf(spark, sf):
    return _evaluate(spark, sf, "SVC", {"kernel": "rbf", "max_iter": 10, "n_components": 32})


@query("svc_poly")
def _svc_poly(spark, sf):
    return _evaluate(spark, sf, "SVC", {"kernel": "poly", "degree": 2, "max_iter": 10})


def quality_dataset(spark, sf):
    """Documents with a quality label, split."""
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    documents = deal(table(spark, sf, "documents").select("doc_id", "text"), TEXT_ROWS)
    rows = labels.join(documents, "doc_id").withColumnRenamed("doc_id", ROW_ID)
    return encode_label(split_exact(rows, 0.6, 0.2, 0.2, seed=3), "quality")


@query("text_pipeline")
def _text(spark, sf):
    rows = quality_dataset(spark, sf)
    model = fit_text(
        rows.filter(F.col(SPLIT) == "train"), "LogisticRegression", "text", "quality", {"max_iter": 20}
    )
    return classification_scores(score(model, rows), "quality")


@query("score_saved")
def _score_saved(spark, sf):
    """Fit on lineitem, save, load, and score rows that lack a column order and the label."""
    rows = lineitem_dataset(spark, sf)
    model = fit(rows.filter(F.col(SPLIT) == "train"), "DecisionTreeClassifier", INPUTS, "l_returnflag",
                {"max_depth": 4})
    path = scratch_path(spark, "model")
    save(model, path)
    new = rows.select(ROW_ID, *reversed(INPUTS))
    scored = score(load(path), new, rows.select(*INPUTS).schema)
    return scored.groupBy("prediction").agg(
        F.count("*").alias("n"), F.round(F.avg(F.array_max("probability")), 6).alias("confidence")
    )


# --- fits with a known answer --------------------------------------------------------------------

# ``high`` decides the label, but for line 7 of an order, whose label is the other one.
_STUMP = """
  r AS (SELECT *, round(l_discount * 100) >= 5 AS high FROM lineitem),
  t AS (SELECT *, CASE WHEN high <> (l_linenumber = 7) THEN 1.0 ELSE 0.0 END AS y FROM r),
  p AS (SELECT high, avg(y) AS p FROM t GROUP BY 1)"""
_KEY = ["l_orderkey", "l_linenumber"]


def _stump_rows(spark, sf, label: str):
    """Lineitem with an encoded label: ``noisy`` as above, or ``side``, which is ``high`` itself."""
    hundredths = F.round(F.col("l_discount") * 100)
    high = hundredths >= 5
    yes = high != (F.col("l_linenumber") == 7) if label == "noisy" else high
    rows = table(spark, sf, "lineitem").select(
        *_KEY, *[F.col(c).cast("double").alias(c) for c in INPUTS], high.cast("double").alias("high"),
        (hundredths - 4.5).cast("double").alias("gap"), F.when(yes, "yes").otherwise("no").alias(label))
    return encode_label(rows, label)


def _stump(spark, sf, name, inputs, params, label="noisy", dealt=False):
    rows = _stump_rows(spark, sf, label)
    learnt = rows.select(*inputs, label)  # a fit caches its rows whole
    return score(fit(deal(learnt) if dealt else learnt, name, inputs, label, params), rows)


def _p_yes(digits: int):
    return F.round(F.get("probability", F.lit(1)), digits).alias("p_yes")


_STUMP_SQL = f"""WITH {_STUMP} SELECT l_orderkey, l_linenumber, CASE WHEN p > 0.5 THEN 1.0 ELSE 0.0 END AS prediction,
                   round(p, 9) AS p_yes FROM t JOIN p USING (high)"""


@query("tree_stump", _STUMP_SQL)
def _tree_stump(spark, sf):
    scored = _stump(spark, sf, "DecisionTreeClassifier", INPUTS, {"max_depth": 1})
    return scored.select(*_KEY, "prediction", _p_yes(9))


@query("score_saved_stump", _STUMP_SQL)
def _score_saved_stump(spark, sf):
    """Saved, loaded, and applied to rows whose columns come in another order."""
    rows = _stump_rows(spark, sf, "noisy")
    path = scratch_path(spark, "model")
    save(fit(rows, "DecisionTreeClassifier", INPUTS, "noisy", {"max_depth": 1}), path)
    new = rows.select(*reversed(INPUTS), *_KEY)
    return score(load(path), new, rows.select(*_KEY, *INPUTS).schema).select(*_KEY, "prediction", _p_yes(9))


@query("forest_stump", f"SELECT l_orderkey, l_linenumber, prediction FROM ({_STUMP_SQL})")
def _forest_stump(spark, sf):
    scored = _stump(spark, sf, "RandomForestClassifier", ["l_discount"], {"n_estimators": 5, "max_depth": 1})
    return scored.select(*_KEY, "prediction")


@query("gbt_stump", f"""WITH {_STUMP} SELECT l_orderkey, l_linenumber, CASE WHEN p > 0.5 THEN 1.0 ELSE 0.0 END AS prediction,
                          round(1 / (1 + exp(-2 * (2 * p - 1))), 9) AS p_yes FROM t JOIN p USING (high)""")
def _gbt_stump(spark, sf):
    scored = _stump(spark, sf, "HistGradientBoostingClassifier", INPUTS, {"max_iter": 1, "max_depth": 1}, dealt=True)
    return scored.select(*_KEY, "prediction", _p_yes(9))


@query("logistic_rates", f"SELECT l_orderkey, l_linenumber, prediction, round(p_yes, 3) AS p_yes FROM ({_STUMP_SQL})")
def _logistic_rates(spark, sf):
    """With one indicator as input the model is saturated: it gives the share of each side."""
    scored = _stump(spark, sf, "LogisticRegression", ["high"], {"C": 1e6, "tol": 1e-10, "max_iter": 200})
    return scored.select(*_KEY, "prediction", _p_yes(3))


_SIDES_SQL = """SELECT l_orderkey, l_linenumber, CASE WHEN round(l_discount * 100) >= 5 THEN 1.0 ELSE 0.0 END AS prediction
                FROM lineitem"""


def _separable(spark, sf, params):
    return _stump(spark, sf, "SVC", ["gap"], params, "side").select(*_KEY, "prediction")


@query("svc_linear_separable", _SIDES_SQL)
def _svc_linear_separable(spark, sf):
    return _separable(spark, sf, {"kernel": "linear"})


@query("svc_rbf_separable", _SIDES_SQL)
def _svc_rbf_separable(spark, sf):
    return _separable(spark, sf, {"kernel": "rbf", "n_components": 64})


@query("svc_poly_separable", _SIDES_SQL)
def _svc_poly_separable(spark, sf):
    return _separable(spark, sf, {"kernel": "poly", "degree": 3})


# Three classes by discount; line 7 of an order has the next one.
_THIRDS = """
  r AS (SELECT l_orderkey, l_linenumber, CASE WHEN round(l_discount * 100) <= 3 THEN 0 WHEN round(l_discount * 100) <= 7 THEN 1 ELSE 2 END AS part
        FROM lineitem),
  t AS (SELECT *, (part + CASE WHEN l_linenumber = 7 THEN 1 ELSE 0 END) % 3 AS y FROM r),
  c AS (SELECT k, avg(CASE WHEN y = k THEN 1.0 ELSE 0.0 END) AS prior FROM t, range(3) AS x(k) GROUP BY 1)"""


def _thirds(spark, sf, name, inputs, params):
    hundredths = F.round(F.col("l_discount") * 100)
    part = F.when(hundredths <= 3, 0).when(hundredths <= 7, 1).otherwise(2)
    code = (part + F.when(F.col("l_linenumber") == 7, 1).otherwise(0)) % 3
    rows = table(spark, sf, "lineitem").select(
        *_KEY, *[F.col(c).cast("double").alias(c) for c in INPUTS],
        F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (code + 1).cast("int")).alias("third"))
    rows = encode_label(rows, "third")
    return score(fit(rows, name, inputs, "third", params), rows).select(
        *_KEY, "prediction", *[F.round(F.get("probability", F.lit(k)), 9).alias(f"p_{x}") for k, x in enumerate("abc")])


@query("boosted_leaves", f"""WITH {_THIRDS},
  leaf AS (  -- three leaves of each class's tree: the three parts
      SELECT part, k, ln(prior) - 0.1 * sum(prior - CASE WHEN y = k THEN 1.0 ELSE 0.0 END) / (count(*) * prior * (1 - prior) + 2) AS raw
      FROM t CROSS JOIN c GROUP BY part, k, prior),
  p AS (SELECT part, k, exp(raw) / sum(exp(raw)) OVER (PARTITION BY part) AS p FROM leaf),
  w AS (SELECT part, max(p) FILTER (k = 0) AS a, max(p) FILTER (k = 1) AS b, max(p) FILTER (k = 2) AS c FROM p GROUP BY part)
  SELECT l_orderkey, l_linenumber, CASE WHEN a >= b AND a >= c THEN 0.0 WHEN b >= c THEN 1.0 ELSE 2.0 END AS prediction,
         round(a, 9) AS p_a, round(b, 9) AS p_b, round(c, 9) AS p_c
  FROM t JOIN w USING (part)""")
def _boosted_leaves(spark, sf):
    """One round of softmax boosting, three leaves a tree, grown best-first with an l2 penalty."""
    return _thirds(spark, sf, "HistGradientBoostingClassifier", ["l_discount"],
                   {"max_iter": 1, "max_depth": None, "max_leaf_nodes": 3, "l2_regularization": 2.0})


@query("tree_leaves", f"""WITH {_THIRDS},
  w AS (SELECT part, avg(CASE WHEN y = 0 THEN 1.0 ELSE 0.0 END) AS a, avg(CASE WHEN y = 1 THEN 1.0 ELSE 0.0 END) AS b,
               avg(CASE WHEN y = 2 THEN 1.0 ELSE 0.0 END) AS c FROM t GROUP BY part)
  SELECT l_orderkey, l_linenumber, CASE WHEN a >= b AND a >= c THEN 0.0 WHEN b >= c THEN 1.0 ELSE 2.0 END AS prediction,
         round(a, 9) AS p_a, round(b, 9) AS p_b, round(c, 9) AS p_c
  FROM t JOIN w USING (part)""")
def _tree_leaves(spark, sf):
    """One tree of three leaves among all inputs; the discount explains most."""
    return _thirds(spark, sf, "DecisionTreeClassifier", INPUTS, {"max_depth": None, "max_leaf_nodes": 3})


# A common word of the invented prose: among all words and bigrams it alone decides the label.
_WORD = "than"


@query("text_any_vocabulary", f"""
    SELECT doc_id, CASE WHEN list_contains(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), '{_WORD}')
                        THEN 'yes' ELSE 'no' END AS said FROM documents""")
def _text_any_vocabulary(spark, sf):
    """Words and bigrams of all documents, coefficients in a table; what decides the label is learnt."""
    rows = deal(table(spark, sf, "documents").select("doc_id", "text"), TEXT_ROWS)
    rows = rows.withColumn("holds", F.when(F.array_contains(tokens("text"), _WORD), "yes").otherwise("no"))
    rows = encode_label(rows, "holds")
    model = fit_text(rows, "LogisticRegression", "text", "holds", {"C": 1e4, "max_iter": 18, "tol": 1e-6}, 1, 2)
    return score(model, rows).select("doc_id", decode("prediction", class_names(rows, "holds")).alias("said"))


@query("knn_approx_recall", """SELECT vec_id, 5 AS wanted, true AS enough, true AS nearest_is_itself
                               FROM embeddings WHERE vec_id % 100 = 0""")
def _knn_approx_recall(spark, sf):
    """Approximate neighbours among all embeddings of those whose id is divisible by 100, against exact ones."""
    vectors = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias(ROW_ID), F.lit(0.0).alias("y"),
        array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias(FEATURES))
    model = fit_knn(vectors, FEATURES, "y", 1, 5, "uniform", approx=0.9)
    queries = vectors.filter(F.col(ROW_ID) % 100 == 0)
    found = materialize(model.neighbour_pairs(queries), "approximate")
    exact = fit_knn(vectors, FEATURES, "y", 1, 5, "uniform").neighbour_pairs(queries)
    recalls = materialize(measured_recall(exact, found, 5), "recall")
    overall = recalls.agg(F.sum("found") / F.sum("wanted")).first()[0]
    first = found.groupBy("qid").agg(F.min_by("id", F.struct("distance", "id")).alias("id"), F.min("distance").alias("d"))
    return recalls.join(first, "qid").select(
        F.col("qid").alias("vec_id"), F.col("wanted").cast("int").alias("wanted"),
        F.lit(overall >= 0.9).alias("enough"), (F.col("d") == 0).alias("nearest_is_itself"))


_MIDDLE_SQL = """SELECT l_orderkey, l_linenumber, CASE WHEN abs(round(l_discount * 100) - 4.5) > 2 THEN 1.0 ELSE 0.0 END AS prediction
                 FROM lineitem"""


def _middle(spark, sf, params):
    """The label is whether the discount lies far from the middle, on either side: no line separates that."""
    gap = (F.round(F.col("l_discount") * 100) - 4.5).cast("double")
    rows = table(spark, sf, "lineitem").select(*_KEY, gap.alias("gap"), F.when(F.abs(gap) > 2, "yes").otherwise("no").alias("far"))
    rows = encode_label(rows, "far")
    learnt = rows.select("gap", "far")  # a fit caches its rows whole
    return score(fit(learnt, "SVC", ["gap"], "far", {"C": 100.0, **params}), rows).select(*_KEY, "prediction")


@query("svc_rbf_middle", _MIDDLE_SQL)
def _svc_rbf_middle(spark, sf):
    return _middle(spark, sf, {"kernel": "rbf", "n_components": 64})


@query("svc_poly_middle", _MIDDLE_SQL)
def _svc_poly_middle(spark, sf):
    return _middle(spark, sf, {"kernel": "poly", "degree": 2, "coef0": 1.0})


@query("predicted_by_run", f"""SELECT l_orderkey, l_linenumber, CASE WHEN prediction = 1 THEN 'yes' ELSE 'no' END AS class, p_yes
                              FROM ({_STUMP_SQL})""")
def _predicted_by_run(spark, sf):
    """An experiment's run is trained and saved; by its id alone new rows are scored and written, names decoded."""
    store = RunStore(spark, scratch_path(spark, "store"))
    rows = _stump_rows(spark, sf, "noisy").withColumn(SPLIT, F.lit("train"))
    experiment = store.add_experiment("stump", "lineitem", "TabularClassificationTask", INPUTS, ["noisy"], {})
    run = create_run(store, experiment, "DecisionTreeClassifier", {"max_depth": 1, "criterion": "entropy"})
    run_experiment(store, run, rows)
    new = table(spark, sf, "lineitem").select("l_orderkey", *reversed(INPUTS), "l_linenumber")
    return predict_run(store, run["run_id"], new).select(*_KEY, "class", _p_yes(9))
