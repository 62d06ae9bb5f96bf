"""Bag of words over whole documents; BLEU and TER over conversation turns."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tablelab.catalog.registry import TEXT_ROWS, deal, query, table
from tablelab.operators.features import map_batches, term_counts, vocabulary
from tablelab.operators.translation import RULES_13A, bleu, ter

_WORDS = """SELECT doc_id, split, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') AS w
            FROM (SELECT *, CASE WHEN lang = 'en' THEN 'train' ELSE 'test' END AS split FROM documents)"""
_UNIGRAMS = f"SELECT doc_id, split, unnest(w) AS term FROM ({_WORDS})"
_NGRAMS = f"""SELECT doc_id, split, unnest(list_concat(w,
    list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM ({_WORDS})"""


def _documents(spark, sf):
    split = F.when(F.col("lang") == "en", "train").otherwise("test")
    return deal(table(spark, sf, "documents").select("doc_id", "text", split.alias("split")), TEXT_ROWS)


@query(
    "bow_vocabulary",
    f'SELECT term, dense_rank() OVER (ORDER BY term) - 1 AS "index" FROM (SELECT DISTINCT term FROM ({_UNIGRAMS}))',
)
def _vocabulary(spark, sf):
    return vocabulary(_documents(spark, sf), "text")


@query(
    "bow_counts",
    f"""WITH u AS ({_UNIGRAMS}),
          v AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS i
                FROM (SELECT DISTINCT term FROM u WHERE split = 'train'))
        SELECT doc_id, i AS "index", count(*) AS n FROM u JOIN v USING (term) GROUP BY 1, 2""",
)
def _counts(spark, sf):
    documents = _documents(spark, sf)
    vocab = vocabulary(documents.filter("split = 'train'"), "text")
    return term_counts(documents, vocab, "text", row_id="doc_id")


@query(
    "bow_ngrams",
    f"""WITH u AS ({_NGRAMS}),
          v AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS i
                FROM (SELECT DISTINCT term FROM u WHERE split = 'train'))
        SELECT doc_id, i AS "index", count(*) AS n FROM u JOIN v USING (term) GROUP BY 1, 2""",
)
def _ngrams(spark, sf):
    documents = _documents(spark, sf)
    vocab = vocabulary(documents.filter("split = 'train'"), "text", 1, 2)
    return term_counts(documents, vocab, "text", 1, 2, row_id="doc_id")


def _tokens_sql(column: str) -> str:
    out = f"' ' || {column} || ' '"
    for pattern, replacement in RULES_13A:
        new = replacement.replace("$", "\\")
        out = f"regexp_replace({out}, '{pattern}', '{new}', 'g')"
    return f"list_filter(regexp_split_to_array({out}, '\\s+'), lambda t: t <> '')"


_PAIRS = """SELECT a.conv_id, a.turn, a.text AS candidate, u.text AS reference
            FROM conversations a JOIN conversations u
              ON u.conv_id = a.conv_id AND u.turn = a.turn - 1
            WHERE a.role = 'assistant' AND u.role = 'user'"""
_BLEU_SQL = f"""
  WITH t AS (SELECT conv_id, turn, {_tokens_sql('candidate')} AS c, {_tokens_sql('reference')} AS r
             FROM ({_PAIRS})),
  g AS (SELECT conv_id, turn, n, unnest(list_transform(range(1, len(c) - n + 2), lambda i: array_to_string(c[i:i + n - 1], ' '))) AS g,
               1 AS inc, 0 AS inr FROM t, range(1, 5) AS k(n)
        UNION ALL
        SELECT conv_id, turn, n, unnest(list_transform(range(1, len(r) - n + 2), lambda i: array_to_string(r[i:i + n - 1], ' '))),
               0, 1 FROM t, range(1, 5) AS k(n)),
  counted AS (SELECT conv_id, turn, n, g, sum(inc) AS c, sum(inr) AS r FROM g GROUP BY ALL),
  o AS (SELECT n, sum(least(c, r)) AS m, sum(c) AS tot, sum(r) AS ref FROM counted GROUP BY 1),
  f AS (SELECT min(m) AS low, avg(ln(CASE WHEN m > 0 THEN m / tot ELSE 1 END)) AS lg,
               max(tot) FILTER (WHERE n = 1) / max(ref) FILTER (WHERE n = 1) AS ratio FROM o)
  SELECT round(CASE WHEN low = 0 THEN 0.0
                    WHEN ratio > 1 THEN exp(lg) ELSE exp(1 - 1 / ratio) * exp(lg) END, 9) AS "Bleu" FROM f"""


def turn_pairs(spark, sf):
    """Assistant turns as candidates, the user turn just before each as its reference."""
    turns = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf, "conversations").select(
        "conv_id", "turn", "role", F.col("text").alias("candidate"),
        F.lag("role").over(turns).alias("before"), F.lag("text").over(turns).alias("reference"),
        F.lag("turn").over(turns).alias("at"),
    )
    asked = (F.col("role") == "assistant") & (F.col("before") == "user") & (F.col("at") == F.col("turn") - 1)
    pair = F.concat_ws(":", "conv_id", "turn").alias("pair")
    return rows.filter(asked).select("conv_id", "turn", pair, "candidate", "reference")


@query("bleu_corpus", _BLEU_SQL)
def _bleu(spark, sf):
    pairs = turn_pairs(spark, sf)
    return bleu(pairs, "candidate", "reference", "pair").select(F.round("Bleu", 9).alias("Bleu"))


@query("ter_corpus")
def _ter(spark, sf):
    return ter(turn_pairs(spark, sf), "candidate", "reference")


@query(
    "score_udf",
    "SELECT event_id, round(1 / (1 + exp(-(value - 20) / 10)), 9) AS probability FROM events",
)
def _score_udf(spark, sf):
    import numpy as np

    def predict(batch):
        p = 1 / (1 + np.exp(-(batch["value"] - 20) / 10))
        return batch[["event_id"]].assign(probability=p.round(9))

    events = table(spark, sf, "events")
    return map_batches(events, predict, "event_id long, probability double", ["event_id", "value"])
