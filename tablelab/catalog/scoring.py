"""Arg-max, softmax and classification metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablelab import ROW_ID, SPLIT
from tablelab.catalog.registry import deal, query, table
from tablelab.functions import argmax, attention_mask, pad_ids, softmax
from tablelab.operators.dataset import with_row_ids
from tablelab.operators.metrics import (
    classification_scores,
    confusion_matrix,
    scores_long,
    with_predicted_class,
)
from tablelab.operators.schema import encode_label
from tablelab.operators.splits import split_exact

# A fixed linear scorer over lineitem: one logit per class, in class order A, N, R. The constants
# keep two logits from coming out nearly equal.
_LOGITS = (
    "(25.0 - l_quantity) / 10.0",
    "(l_extendedprice - 50000.0) / 24999.123457",
    "(l_discount - l_tax) * 41.3 + 0.017",
)
_SPLIT = """CASE WHEN rn <= floor(0.6 * n + 1e-9) THEN 'train'
      WHEN rn <= floor(0.6 * n + 1e-9) + floor(0.5 * (n - floor(0.6 * n + 1e-9)) + 1e-9) THEN 'test'
      ELSE 'validation' END"""
_SCORED_SQL = f"""
  numbered AS (SELECT *, row_number() OVER () - 1 AS r FROM lineitem),
  placed AS (SELECT *, row_number() OVER (ORDER BY md5('11:' || r)) AS rn, count(*) OVER () AS n
             FROM numbered),
  logits AS (SELECT {_SPLIT} AS split, dense_rank() OVER (ORDER BY l_returnflag) - 1 AS y,
                    {_LOGITS[0]} AS a, {_LOGITS[1]} AS b, {_LOGITS[2]} AS c FROM placed),
  scored AS (SELECT split, y, CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END AS yhat
             FROM logits)"""


def metrics_sql(source: str, by: str, macro: bool) -> str:
    """Metrics of the relation ``scored(by, y, yhat)``, written out from the definitions."""
    pick = (lambda c: f"avg({c})") if macro else (
        lambda c: f"coalesce(max(CASE WHEN c = 1 THEN {c} END), 0.0)"
    )
    return f"""WITH {source},
      classes AS (SELECT DISTINCT {by}, y AS c FROM scored UNION SELECT DISTINCT {by}, yhat FROM scored),
      per AS (SELECT k.{by}, k.c,
                count(*) FILTER (WHERE s.y = k.c AND s.yhat = k.c) AS tp,
                count(*) FILTER (WHERE s.y = k.c) AS truth,
                count(*) FILTER (WHERE s.yhat = k.c) AS said
              FROM classes k JOIN scored s ON s.{by} = k.{by} GROUP BY 1, 2),
      r AS (SELECT *, CASE WHEN said > 0 THEN tp / said ELSE 0.0 END AS p,
              CASE WHEN truth > 0 THEN tp / truth ELSE 0.0 END AS q,
              CASE WHEN truth + said > 0 THEN 2 * tp / (truth + said) ELSE 0.0 END AS f FROM per)
    SELECT {by}, sum(tp) / sum(truth) AS "Accuracy", {pick("p")} AS "Precision",
      {pick("q")} AS "Recall", {pick("f")} AS "F1",
      avg(q) FILTER (WHERE truth > 0) AS "BalancedAccuracy" FROM r GROUP BY 1"""


def _scored_lineitem(spark, sf):
    rows = with_row_ids(table(spark, sf, "lineitem")).select(
        ROW_ID, "l_returnflag", *[F.expr(e).alias(f"z{i}") for i, e in enumerate(_LOGITS)]
    )
    labelled = deal(encode_label(split_exact(rows, 0.6, 0.2, 0.2, seed=11), "l_returnflag"))
    return with_predicted_class(
        labelled.withColumn("probability", softmax(F.array("z0", "z1", "z2")))
    )


@query("metrics_by_split", metrics_sql(_SCORED_SQL, "split", macro=True))
def _metrics_by_split(spark, sf):
    return classification_scores(_scored_lineitem(spark, sf), "l_returnflag")


@query(
    "metrics_long",
    f"""SELECT split, metric, value FROM ({metrics_sql(_SCORED_SQL, "split", macro=True)})
        UNPIVOT (value FOR metric IN ("Accuracy", "Precision", "Recall", "F1", "BalancedAccuracy"))""",
)
def _metrics_long(spark, sf):
    return scores_long(classification_scores(_scored_lineitem(spark, sf), "l_returnflag"))


@query(
    "confusion_matrix",
    f"WITH {_SCORED_SQL} SELECT split, CAST(y AS DOUBLE) AS y, CAST(yhat AS DOUBLE) AS yhat, count(*) AS n FROM scored GROUP BY ALL",
)
def _confusion(spark, sf):
    return confusion_matrix(_scored_lineitem(spark, sf), "l_returnflag")


_BINARY_SQL = """scored AS (SELECT d.lang, l.quality AS y, CASE WHEN d.n_chars > 400 THEN 1 ELSE 0 END AS yhat
                            FROM labels l JOIN documents d USING (doc_id))"""


@query("metrics_binary", metrics_sql(_BINARY_SQL, "lang", macro=False))
def _metrics_binary(spark, sf):
    documents = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    rows = labels.join(documents, "doc_id").withColumn("yhat", (F.col("n_chars") > 400).cast("int"))
    return classification_scores(rows, "quality", "yhat", by=["lang"])


_PRIORITY_SQL = """scored AS (SELECT o_orderstatus, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS y,
                     CASE WHEN o_totalprice < 250000 THEN o_custkey % 3 ELSE o_custkey % 4 END AS yhat FROM orders)"""


@query("metrics_macro", metrics_sql(_PRIORITY_SQL, "o_orderstatus", macro=True))
def _metrics_macro(spark, sf):
    orders = encode_label(table(spark, sf, "orders"), "o_orderpriority")
    guess = F.when(F.col("o_totalprice") < 250000, F.col("o_custkey") % 3).otherwise(F.col("o_custkey") % 4)
    return classification_scores(
        orders.withColumn("yhat", guess.cast("double")), "o_orderpriority", "yhat", by=["o_orderstatus"]
    )


@query(
    "balanced_accuracy",
    f"""SELECT "BalancedAccuracy" FROM ({metrics_sql(
        "scored AS (SELECT 1 AS one, quality AS y, toxic AS yhat FROM labels)", "one", macro=False)})""",
)
def _balanced(spark, sf):
    labels = table(spark, sf, "labels")
    return classification_scores(labels, "quality", "toxic", by=[]).select("BalancedAccuracy")


@query(
    "argmax",
    """SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS cls FROM embeddings""",
)
def _argmax(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", argmax("embedding").alias("cls"))


@query(
    "softmax",
    """WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE * 3.0 AS z FROM embeddings)
       SELECT vec_id, round(max(exp(z)) / sum(exp(z)), 9) AS top,
         round(sum(exp(z) * exp(z)) / (sum(exp(z)) * sum(exp(z))), 9) AS concentration
       FROM e GROUP BY 1""",
)
def _softmax(spark, sf):
    rows = table(spark, sf, "embeddings")
    logits = F.transform("embedding", lambda x: x.cast("double") * 3.0)
    p = F.col("p")
    squares = F.aggregate(p, F.lit(0.0), lambda a, x: a + x * x)
    return rows.select("vec_id", softmax(logits).alias("p")).select(
        "vec_id",
        F.round(F.array_max(p), 9).alias("top"),
        F.round(squares, 9).alias("concentration"),
    )


@query(
    "pad_ids",
    """WITH t AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents),
         i AS (SELECT doc_id, list_transform(w, lambda x: length(x)::INTEGER) AS ids FROM t)
       SELECT doc_id,
         list_resize(ids, 512, 0) AS input_ids,
         list_transform(range(512), lambda k: CASE WHEN k < len(ids) THEN 1 ELSE 0 END) AS attention_mask
       FROM i""",
)
def _pad(spark, sf):
    ids = F.transform(F.split("text", " ", -1), lambda w: F.length(w))
    rows = table(spark, sf, "documents").select("doc_id", ids.alias("ids"))
    return rows.select(
        "doc_id",
        pad_ids("ids", 512).alias("input_ids"),
        attention_mask("ids", 512).alias("attention_mask"),
    )


def scored_lineitem(spark, sf):
    """Scored rows with their split, shared with the bench."""
    return _scored_lineitem(spark, sf).select(SPLIT, "l_returnflag", "prediction")
