"""What a task reads, holds or repeats stays bounded, whatever the size of the table."""

import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from tablelab.catalog.registry import deal
from tablelab.models import classifiers, grown, knn
from tablelab.models.stages import Landmarks
from tablelab.operators import translation
from tablelab.operators.ranks import hash_key, hash_rank
from tablelab.operators.schema import encode_label
from tablelab.plans import explain


def test_dealt_tables_have_more_tasks_when_they_are_larger(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(f"{tmp_path}/t")
    rows = spark.read.parquet(f"{tmp_path}/t")
    cores = spark.sparkContext.defaultParallelism
    assert deal(rows).rdd.getNumPartitions() == cores
    dealt = deal(rows, task_rows=10)
    assert dealt.rdd.getNumPartitions() == max(cores, 100)
    assert sorted(r[0] for r in dealt.collect()) == list(range(1000))


def test_a_linear_machine_reads_the_rows_that_are_cached_already(spark, monkeypatch):
    cached = []
    persist = DataFrame.persist
    monkeypatch.setattr(DataFrame, "persist", lambda df, *a: cached.append(df.columns) or persist(df, *a))
    rows = spark.range(20).select(F.col("id").cast("double").alias("x"), F.when(F.col("id") > 9, "a").otherwise("b").alias("y"))
    classifiers.fit(encode_label(rows, "y"), "SVC", ["x"], "y", {"kernel": "linear", "max_iter": 2})
    assert len(cached) == 1


def test_routed_queries_come_in_small_frames():
    n, cells = 100, 1024
    queries = pd.DataFrame({"qid": np.arange(n), "x": [np.zeros(3)] * n})
    blocks = np.where(np.arange(cells) % 2, 1, 2)
    everywhere = lambda x: np.nonzero(np.ones((len(x), cells), bool))
    frames = list(knn.routed_rows(queries, everywhere, np.arange(cells) + 5, blocks, np.ones(cells, int)))
    assert max(map(len, frames)) <= knn.ROUTED_ROWS
    found = pd.concat(frames)
    assert len(found) == n * blocks.sum() and not found.duplicated(["qid", "cell", "block"]).any()
    assert (found.groupby("cell")["block"].max() + 1).tolist() == blocks.tolist()


def test_boosted_trees_are_looked_up_as_they_are_walked():
    draw = np.random.default_rng(3)
    x = draw.integers(0, 256, (500, 3)).astype(np.uint8)
    column = pa.array([None, *[r.tobytes() for r in x]], pa.binary())[1:]
    bins = grown._bins(column, 3)
    assert (bins == x).all()
    assert grown._bins(column[:0], 3).shape == (0, 3)
    tree = {"feature": [0, 1, 0, -1, -1, 2, -1, -1, -1], "bin": [120, 30, 200, 0, 0, 254, 0, 0, 0],
            "left": [1, 3, 5, -1, -1, 7, -1, -1, -1], "right": [2, 4, 6, -1, -1, 8, -1, -1, -1],
            "value": [None, None, None, 0.1, 0.2, None, 0.3, 0.4, 0.5]}
    values = np.array([v or 0.0 for v in tree["value"]])
    assert (grown._masked(bins, tree, values) == values[grown.leaf_of(tree, x, "bin")]).all()


def test_ter_takes_the_steps_of_the_shorter_side(monkeypatch):
    steps = []
    step = translation._row_step
    monkeypatch.setattr(translation, "_row_step", lambda *a: steps.append(1) or step(*a))
    # every word of the reference is already in place: the distance cannot be less, so no move is tried
    assert translation.ter_edits(" ".join(f"w{i}" for i in range(200)), "w3 w7 other w90") == 197
    assert len(steps) == 4


def test_ranks_travel_with_half_the_key(spark):
    rows = spark.range(500)
    ranked = hash_rank(rows, hash_key(7, "id"), n=500)
    assert "unhex" in ranked._jdf.queryExecution().optimizedPlan().toString()
    keys = {r[0]: r[1] for r in rows.select("id", hash_key(7, "id")).collect()}
    assert [r["id"] for r in ranked.orderBy("rank").collect()] == sorted(keys, key=keys.get)


def test_equal_altered_rows_are_scored_once_against_a_large_background(spark, monkeypatch):
    monkeypatch.setattr(explain, "MAX_LITERAL_ROWS", 8)
    monkeypatch.setattr(explain, "MAX_SHARING", 5)
    rows = spark.range(60).select(
        F.col("id").alias("_row_id"), (F.col("id") % 3).cast("double").alias("few"),
        F.when(F.col("id") % 7 > 0, (F.col("id") % 7).cast("string")).alias("text"), F.col("id").cast("double").alias("own"))
    scored = spark.sparkContext.accumulator(0)

    def scorer(df):
        def counted(frames):
            for f in frames:
                scored.add(len(f))
                p = 0.1 + 0.1 * f["few"] * (f["text"].fillna("0").astype(float) + 1) / 7 + 0.002 * f["own"] * f["few"]
                yield f.assign(probability=[[1 - x, x] for x in p])

        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
        return df.mapInPandas(counted, f"{schema}, probability array<double>")

    shap = explain.KernelShap(scorer, ["few", "text", "own"], ["no", "yes"]).fit(rows, split=None)
    got = {(r.instance_id, r["class"], r.feature): r.shap for r in shap.explain(rows, decimals=False).collect()}
    merged = scored.value
    monkeypatch.setattr(explain, "MAX_LITERAL_ROWS", 100)
    want = {(r.instance_id, r["class"], r.feature): r.shap for r in shap.explain(rows, decimals=False).collect()}
    assert got.keys() == want.keys() and len(got) == 60 * 2 * 3
    assert max(abs(got[k] - want[k]) for k in want) < 1e-12
    # features alone: 3, 7 and 60 kinds, few and text 21; and the instances themselves
    assert merged == 60 + 3 * 60 + 7 * 60 + 60 * 21 + 21 * 60 + 60 * 7 + 60 * 3 + 60 + 60


def _vectors(spark, count, kinds):
    return spark.range(count).select(F.array((F.col("id") % kinds).cast("double"), F.lit(2.0)).alias("x")).select(
        array_to_vector("x").alias(classifiers.FEATURES))


def test_landmarks_are_chosen_without_a_shuffle_of_all_rows(spark, monkeypatch):
    for count, kinds, most in ((3000, 3000, 20), (3000, 7, 20), (5, 5, 20), (4000, 30, 29)):
        df = _vectors(spark, count, kinds)
        x = vector_to_array(F.col(classifiers.FEATURES)).alias("x")
        every = df.select(x).distinct().orderBy(F.xxhash64("x", F.lit(3)), "x").limit(most).collect()
        met = []
        distinct = DataFrame.distinct
        monkeypatch.setattr(DataFrame, "distinct", lambda df: met.append(df.count()) or distinct(df))
        got = json.loads(classifiers._landmarks(df, most, 3))
        monkeypatch.undo()
        assert got == [r["x"] for r in every]
        assert kinds < count or met[0] < count // 4 or count < 100


def test_landmarks_map_whole_columns(spark):
    points = [[0.0, 2.0], [1.0, 2.0], [4.0, 2.0]]
    stage = Landmarks(inputCol=classifiers.FEATURES, outputCol="m", kernel="rbf", gamma=0.5, coef0=0.0, degree=3, points=json.dumps(points))
    mapped = stage.transform(_vectors(spark, 50, 9).repartition(3)).collect()
    assert len(mapped) == 50
    # inner products of mapped landmarks are the kernel's
    at = {r[0][0]: r["m"].toArray() for r in mapped}
    for a in (0.0, 1.0, 4.0):
        for b in (0.0, 1.0, 4.0):
            assert abs(at[a] @ at[b] - np.exp(-0.5 * (a - b) ** 2)) < 1e-9
    assert stage.transform(_vectors(spark, 0, 9)).count() == 0


def test_classes_of_large_tables_are_fitted_one_at_a_time(spark, monkeypatch):
    sizes = []
    pool = classifiers.ThreadPool
    monkeypatch.setattr(classifiers, "ThreadPool", lambda n: sizes.append(n) or pool(n))
    rows = spark.range(30).select(F.col("id").cast("double").alias("x"), F.concat(F.lit("c"), F.col("id") % 3).alias("y"))
    rows = encode_label(rows, "y")
    given = {"kernel": "linear", "max_iter": 2}
    first = classifiers.fit(rows, "SVC", ["x"], "y", given).transform(rows).orderBy("x").collect()
    monkeypatch.setattr(classifiers, "CLASS_ROWS", 1)
    assert classifiers.fit(rows, "SVC", ["x"], "y", given).transform(rows).orderBy("x").collect() == first
    assert sizes == [3, 1]
