"""Best-first trees against one leaf at a time in plain Python."""

import json

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tablelab.models import classifiers, fit, grown, load, save, score
from tablelab.models.grown import Rules
from tablelab.operators.schema import encode_label


def rows(n=400, classes=3, seed=4):
    draw = np.random.default_rng(seed)
    x = np.stack([draw.integers(0, 12, n), draw.integers(0, 9, n) / 4, draw.integers(-3, 4, n)], 1).astype(float)
    y = (x[:, 0] > 6).astype(int) + (x[:, 1] * x[:, 2] > 1) * (classes - 2)
    return x, np.where(draw.random(n) < 0.1, draw.integers(0, classes, n), y)


@pytest.fixture(scope="module")
def frame(spark):
    x, y = rows()
    df = spark.createDataFrame([(*map(float, v), float(c)) for v, c in zip(x, y)], "a double, b double, c double, y double")
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="f").transform(df).repartition(3).persist()


def brute_tree(x, stats, score, value, size, rules):
    """Leaves as (gain, rows, split); the one of the largest gain is split next."""
    def look(at, depth):
        best = (0, None)
        whole = score(stats[at].sum(0))
        if size(stats[at]) >= max(rules.min_split, 2 * rules.min_leaf) and (rules.max_depth is None or depth < rules.max_depth):
            for f in range(x.shape[1]):
                values = np.unique(x[:, f])
                for t in (values[:-1] + values[1:]) / 2:
                    side = x[at, f] <= t
                    if min(size(stats[at][side]), size(stats[at][~side])) < rules.min_leaf:
                        continue
                    gain = score(stats[at][side].sum(0)) + score(stats[at][~side].sum(0)) - whole
                    if gain > best[0] + 1e-9:
                        best = gain, (f, t)
        return best[0], at, best[1], depth

    leaves = [look(np.arange(len(x)), 0)]
    while rules.max_leaves is None or len(leaves) < rules.max_leaves:
        k = max(range(len(leaves)), key=lambda i: leaves[i][0])
        gain, at, split, depth = leaves[k]
        if split is None:
            break
        side = x[at, split[0]] <= split[1]
        leaves[k:k + 1] = [look(at[side], depth + 1), look(at[~side], depth + 1)]
    out = [None] * len(x)
    for _, at, _, _ in leaves:
        v = value(stats[at].sum(0))
        for i in at:
            out[i] = v
    return np.array(out), len(leaves)


@pytest.mark.parametrize("rules", [Rules(6, None, 2, 5, 0.5), Rules(None, 3, 2, 20, 0.0), Rules(31, 4, 2, 1, 2.0)])
def test_boosting_is_best_first(frame, monkeypatch, rules):
    monkeypatch.setattr(grown, "SCORED_EVERY", 2)
    monkeypatch.setattr(grown, "HISTOGRAM_BYTES", 5000)  # several passes a level
    x, y = rows()
    model = json.loads(grown.boost(frame, "f", "y", 3, 3, 0.3, rules))
    raw = np.tile(np.log([np.mean(y == k) for k in range(3)]), (len(x), 1))
    assert np.allclose(raw[0], model["start"])
    for trees in model["rounds"]:
        p = grown.probabilities(raw)
        step = np.zeros_like(raw)
        for k, tree in enumerate(trees):
            stats = np.stack([p[:, k] - (y == k), p[:, k] * (1 - p[:, k]), np.ones(len(y))], 1)

            def gain(s):
                return s[0] ** 2 / (s[1] + rules.l2)

            step[:, k], leaves = brute_tree(
                x, stats, gain, lambda s: -0.3 * s[0] / (s[1] + rules.l2), lambda s: len(s), rules)
            assert sum(f < 0 for f in tree["feature"]) == leaves
            assert np.allclose(grown.add_scores(x, np.zeros((len(x), 1)), [[tree]], "at")[:, 0], step[:, k], atol=1e-9)
        raw += step


@pytest.mark.parametrize("rules, criterion", [
    (Rules(5, None, 2, 3), "gini"), (Rules(None, None, 60, 1), "entropy"), (Rules(8, 3, 2, 10), "entropy")])
def test_classification_trees_are_best_first(frame, rules, criterion):
    x, y = rows()
    model = json.loads(grown.forest(frame, "f", "y", 3, 1, criterion, rules, False, None, 0))

    def purity(s):
        p = s[s > 0] / s.sum()
        return -s.sum() * ((1 - (p ** 2).sum()) if criterion == "gini" else -(p * np.log(p)).sum())

    want, leaves = brute_tree(x, np.eye(3)[y], purity, lambda s: s / s.sum(), lambda s: len(s), rules)
    (tree,) = model["forest"][0]
    assert sum(f < 0 for f in tree["feature"]) == leaves
    got = np.array([v or [0.0] * 3 for v in tree["value"]])[grown.leaf_of(tree, x)]
    assert np.allclose(got, want)


def test_two_classes_and_many_values(spark):
    draw = np.random.default_rng(0)
    x = draw.normal(size=(3000, 2))
    data = [(float(a), float(b), "yes" if a * b > 0 else "no") for a, b in x]
    df = encode_label(spark.createDataFrame(data, "a double, b double, y string").repartition(4), "y")
    model = fit(df, "HistGradientBoostingClassifier", ["a", "b"], "y",
                {"max_iter": 12, "max_depth": None, "max_leaf_nodes": 8, "learning_rate": 0.5})
    scored = score(model, df).select((F.col("prediction") == F.col("y")).cast("double").alias("ok"))
    assert scored.agg(F.avg("ok")).first()[0] > 0.97


@pytest.mark.parametrize("name, params", [
    ("DecisionTreeClassifier", {"max_depth": None, "min_samples_split": 40}), ("DecisionTreeClassifier", {"max_depth": 40}),
    ("RandomForestClassifier", {"max_leaf_nodes": 6, "n_estimators": 9, "max_depth": None, "random_state": 3}),
    ("HistGradientBoostingClassifier", {"max_iter": 6, "l2_regularization": 0.5, "max_depth": 3})])
def test_limits_of_leaves_and_nodes(frame, tmp_path, name, params):
    df = encode_label(frame.drop("f").withColumn("y", F.col("y").cast("int").cast("string")), "y")
    model = fit(df, name, ["a", "b", "c"], "y", params)
    scored = score(model, df)
    assert scored.agg(F.avg((F.col("prediction") == F.col("y")).cast("double"))).first()[0] > 0.8
    save(model, str(tmp_path / "m"))
    again = score(load(str(tmp_path / "m")), df).select("a", "b", "c", "probability")
    assert sorted(map(repr, again.collect())) == sorted(map(repr, scored.select("a", "b", "c", "probability").collect()))
    # the same rows in other partitions: the same bins, and without draws the same trees
    if name != "RandomForestClassifier":
        other = score(fit(df.repartition(5), name, ["a", "b", "c"], "y", params), df).select("prediction")
        assert other.groupBy("prediction").count().orderBy("prediction").collect() == (
            scored.groupBy("prediction").count().orderBy("prediction").collect())


def test_bootstrap_weights():
    w = grown.poisson(np.arange(200_000), 3, 1)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and abs((w == 0).mean() - np.exp(-1)) < 0.005
    assert abs(np.corrcoef(w, grown.poisson(np.arange(200_000), 4, 1))[0, 1]) < 0.01


def test_a_class_without_rows_and_one_value(spark):
    df = spark.createDataFrame([(1.0, i % 2 * 2.0) for i in range(20)], "a double, y double")
    df = VectorAssembler(inputCols=["a"], outputCol="f").transform(df)
    model = json.loads(grown.boost(df, "f", "y", 3, 2, 0.1, Rules(4, None, 2, 1)))
    p = grown.probabilities(grown.add_scores(np.array([[1.0]]), np.array([model["start"]]), model["rounds"], "at"))
    assert np.allclose(p, [[0.5, 0, 0.5]], atol=1e-6)
    assert classifiers.SPARK_DEPTH == 30
