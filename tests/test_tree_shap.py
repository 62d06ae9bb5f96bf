"""SHAP of trees against its definition: all subsets, every background row."""

import itertools
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablelab import ROW_ID
from tablelab.models import fit, grown
from tablelab.operators.schema import encode_label
from tablelab.plans.tree_shap import TreeShap, of_leaf

INPUTS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def frame(spark):
    draw = np.random.default_rng(3)
    x = draw.integers(0, 6, (150, 3)).astype(float)
    y = np.where(x[:, 0] > 2, np.where(x[:, 1] * x[:, 2] > 5, "u", "v"), np.where(x[:, 2] > 1, "w", "u"))
    rows = [(i, *map(float, v), str(k)) for i, (v, k) in enumerate(zip(x, y))]
    rows += [(1000 + i, 1.0, 1.0, 1.0, "w") for i in range(100)]  # copies in the background
    return encode_label(spark.createDataFrame(rows, f"{ROW_ID} long, a double, b double, c double, y string").repartition(3), "y")


def predict(model, x):
    start = np.tile(model["start"], (len(x), 1))
    if "rounds" in model:
        return grown.add_scores(x, start, model["rounds"], "at")
    for (t,) in model["forest"]:
        start = start + np.array([v or [0.0] * start.shape[1] for v in t["value"]])[grown.leaf_of(t, x)] / len(model["forest"])
    return start


def brute(model, x, background):
    m = x.shape[1]

    def mean(i, subset):
        mixed = background.copy()
        mixed[:, list(subset)] = x[i, list(subset)]
        return predict(model, mixed).mean(0)

    out = np.zeros((len(x), len(model["start"]), m))
    for i in range(len(x)):
        for j in range(m):
            rest = [k for k in range(m) if k != j]
            for size in range(m):
                for s in itertools.combinations(rest, size):
                    w = math.factorial(size) * math.factorial(m - size - 1) / math.factorial(m)
                    out[i, :, j] += w * (mean(i, (*s, j)) - mean(i, s))
    return out


@pytest.mark.parametrize("name, params", [
    ("DecisionTreeClassifier", {"max_depth": None}),
    ("RandomForestClassifier", {"max_depth": None, "n_estimators": 4, "max_leaf_nodes": 7}),
    ("HistGradientBoostingClassifier", {"max_iter": 3, "max_depth": None, "max_leaf_nodes": 6, "min_samples_leaf": 3})])
def test_contributions(frame, name, params):
    model = fit(frame, name, INPUTS, "y", params)
    background = frame.filter(F.col(ROW_ID) % 3 > 0)
    shap = TreeShap(model).fit(background)
    few = frame.filter(F.col(ROW_ID) < 12)
    got = {}
    for r in shap.explain(few, decimals=False).collect():
        got[r["instance_id"], r["class"], r["feature"]] = (r["shap"], r["value"])
    x = np.array([[r[c] for c in INPUTS] for r in few.orderBy(ROW_ID).collect()])
    back = np.array([[r[c] for c in INPUTS] for r in background.collect()])
    want = brute(shap.model, x, back)
    assert len(got) == want.size
    for (i, k, f), (v, text) in got.items():
        assert v == pytest.approx(want[i, k, INPUTS.index(f)], abs=1e-9) and float(text) == x[i, INPUTS.index(f)]
    # contributions and base values add up to the score
    total = want.sum(2) + np.array(shap.base_values())
    assert np.allclose(total, predict(shap.model, x)) and np.allclose(shap.base_values(), predict(shap.model, back).mean(0))


def test_shares_of_a_leaf_add_up():
    for size in range(1, 6):
        for met, other in itertools.product(range(1 << size), repeat=2):
            total = of_leaf(met, size, {other: 1.0}).sum()
            full = (1 << size) - 1
            assert total == pytest.approx(float(met == full) - float(other == full))


def test_refusals(frame):
    model = fit(frame, "DecisionTreeClassifier", INPUTS, "y", {"max_depth": 2})
    with pytest.raises(ValueError, match="best-first"):
        TreeShap(model)
    model = fit(frame, "DecisionTreeClassifier", INPUTS, "y", {"max_depth": None, "max_leaf_nodes": 2})
    with pytest.raises(ValueError, match="fitted"):
        TreeShap(model).explain(frame)
    with pytest.raises(ValueError, match="no rows"):
        TreeShap(model).fit(frame.limit(0))
    assert json.loads(model.stages[-2].getOrDefault("trees"))["start"] == [0.0] * 3
