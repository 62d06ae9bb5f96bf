import json

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tablelab import ROW_ID, SPLIT
from tablelab.models import CLASSIFIERS, fit, fit_text, load, save, score, score_with
from tablelab.models.knn import fit_knn, nearest
from tablelab.models.stages import Landmarks
from tablelab.operators import runs as rt
from tablelab.operators.metrics import classification_scores
from tablelab.operators.schema import encode_label
from tablelab.operators.splits import split_exact
from tablelab.plans import explain as ex
from tablelab.plans.experiment import RunStore, create_run, run_experiment
from tablelab.plans.tune import Range, resolve_parameters, search
from tablelab.streaming import score_stream

INPUTS = ["x0", "x1", "color"]


@pytest.fixture(scope="module")
def flowers(spark):
    """Three well separated classes over two numbers and a text column."""
    draw = np.random.default_rng(1)
    rows = []
    for i in range(240):
        c = i % 3
        x = draw.normal([(0, 0), (4, 0), (0, 4)][c], 0.6)
        rows.append((i, float(x[0]), float(x[1]), ["red", "blue", "green"][c if draw.random() < 0.7 else 0], "abc"[c]))
    df = spark.createDataFrame(rows, f"{ROW_ID} long, x0 double, x1 double, color string, y string")
    return encode_label(split_exact(df, 0.6, 0.2, 0.2, seed=2), "y").persist()


def train(df):
    return df.filter(F.col(SPLIT) == "train")


CASES = [
    ("LogisticRegression", {"penalty": "elasticnet", "C": 5.0}),
    ("DecisionTreeClassifier", {"max_depth": 4, "criterion": "log_loss", "max_features": "sqrt"}),
    ("RandomForestClassifier", {"n_estimators": 10, "max_depth": 4}),
    ("HistGradientBoostingClassifier", {"max_iter": 5, "max_depth": 3, "min_samples_leaf": 2}),
    ("KNeighborsClassifier", {"n_neighbors": 3, "weights": "distance"}),
    ("SVC", {"kernel": "linear"}),
    ("SVC", {"kernel": "rbf", "n_components": 64}),
    ("SVC", {"kernel": "poly", "degree": 2}),
]


@pytest.mark.parametrize("name, params", CASES)
def test_classifiers(flowers, tmp_path, name, params):
    model = fit(train(flowers), name, INPUTS, "y", params)
    scored = score(model, flowers)
    assert scored.columns == [*flowers.columns, "probability", "prediction"]
    sums = scored.select(F.aggregate("probability", F.lit(0.0), lambda a, x: a + x).alias("s")).collect()
    assert len(sums) == 240 and all(abs(r.s - 1) < 1e-6 for r in sums)
    rows = classification_scores(scored, "y").collect()
    assert len(rows) == 3 and all(r["Accuracy"] > 0.85 for r in rows)
    save(model, str(tmp_path / "m"))
    again = score(load(str(tmp_path / "m")), flowers)
    a = {r[ROW_ID]: r.probability for r in scored.collect()}
    for r in again.collect():
        assert r.probability == pytest.approx(a[r[ROW_ID]])


def test_dummy_strategies(flowers, tmp_path):
    for strategy, want in (("uniform", [1 / 3] * 3), ("prior", None), ("most_frequent", None), ("stratified", None)):
        model = fit(train(flowers), "DummyClassifier", [], "y", {"strategy": strategy})
        p = score(model, flowers).select("probability").collect()
        assert all(sum(r[0]) == pytest.approx(1) for r in p)
        if want:
            assert p[0][0] == pytest.approx(want)
    save(model, str(tmp_path / "d"))
    assert score(load(str(tmp_path / "d")), flowers).collect() == score(model, flowers).collect()
    with pytest.raises(ValueError):
        fit(flowers, "DummyClassifier", [], "y", {"strategy": "zz"})
    with pytest.raises(ValueError, match="not a classifier"):
        fit(flowers, "Oracle", INPUTS, "y")


def test_nearest_matches_brute_force():
    draw = np.random.default_rng(0)
    points = draw.integers(0, 4, size=(300, 3)).astype(float)  # many ties and copies
    queries = np.vstack([points[:40], draw.normal(1, 1, size=(40, 3))])
    ids = draw.permutation(300)
    q, p, d = nearest(queries, points, ids, 7)
    for i in range(len(queries)):
        dist = np.sqrt(((queries[i] - points) ** 2).sum(axis=1))
        want = np.lexsort((ids, dist))[:7]
        assert p[q == i].tolist() == want.tolist() and d[q == i] == pytest.approx(dist[want])


@pytest.mark.parametrize("weights", ["uniform", "distance"])
def test_knn_blocks_give_the_same_votes_with_a_hot_point(spark, weights):
    draw = np.random.default_rng(3)
    x = draw.integers(0, 5, size=(300, 2)).astype(float)
    x[:120] = (1.0, 1.0)  # more than a third of the rows are copies of one point
    rows = [(i, float(a), float(b), i % 3) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, f"{ROW_ID} long, a double, b double, y int")
    df = VectorAssembler(inputCols=["a", "b"], outputCol="v").transform(encode_label(df, "y"))
    model = fit_knn(df, "v", "y", 3, 5, weights)
    narrow = {r[ROW_ID]: r["_probability"].toArray() for r in model.transform(df).collect()}
    model.broadcast_bytes, model.block_rows = 0, 16
    blocked = model.transform(df).collect()
    assert len(blocked) == 300
    for r in blocked:
        assert r["_probability"].toArray() == pytest.approx(narrow[r[ROW_ID]])
        dist = np.sqrt(((x - x[r[ROW_ID]]) ** 2).sum(axis=1))
        best = np.lexsort((np.arange(300), dist))[:5]
        vote = np.ones(5) if weights == "uniform" else (dist[best] == 0).astype(float)
        want = np.bincount(best % 3, vote, minlength=3)
        assert narrow[r[ROW_ID]] == pytest.approx(want / want.sum())


def test_text_model(spark, tmp_path):
    rows = [(i, "good fine great" if i % 2 else "bad poor awful", "np"[i % 2]) for i in range(40)]
    df = encode_label(spark.createDataFrame(rows, f"{ROW_ID} long, words string, y string"), "y")
    model = fit_text(df, "LogisticRegression", "words", "y", ngram_min_n=1, ngram_max_n=2)
    save(model, str(tmp_path / "t"))
    new = spark.createDataFrame([("GREAT fine",), ("awful, truly",)], "words string")
    assert [r.prediction for r in score(load(str(tmp_path / "t")), new).collect()] == [1.0, 0.0]


def test_user_model(spark):
    out = score_with(
        spark.range(5), lambda: 10, lambda m, b: b.assign(p=b["id"] * m), "id long, p long"
    )
    assert [r.p for r in out.orderBy("id").collect()] == [0, 10, 20, 30, 40]


def test_stream_scoring(spark, flowers, tmp_path):
    model = fit(train(flowers), "DecisionTreeClassifier", INPUTS, "y", {"max_depth": 3})
    source = str(tmp_path / "in")
    flowers.select(*INPUTS).write.json(source)
    schema = flowers.select(*INPUTS).schema
    stream = spark.readStream.schema("color string, x1 double, x0 double").json(source)
    run = score_stream(model, stream, schema, str(tmp_path / "out"), str(tmp_path / "cp"), once=True)
    run.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 240


def test_parameters_and_search(flowers):
    fixed, space = resolve_parameters({
        "criterion": "gini", "random_state": 3,
        "max_depth": {"optimize": True, "fixed_value": 1, "lower_bound": 1, "upper_bound": 5},
        "C": {"optimize": True, "fixed_value": 1.0, "lower_bound": 0.5, "upper_bound": 2},
        "min_samples_leaf": {"optimize": False, "fixed_value": 2, "lower_bound": 1, "upper_bound": 5},
    })
    assert fixed == {"criterion": "gini", "random_state": 3, "min_samples_leaf": 2}
    assert space == {"max_depth": Range(1, 5, True), "C": Range(0.5, 2, False)}
    with pytest.raises(ValueError):
        resolve_parameters({"a": {"optimize": True, "lower_bound": 2, "upper_bound": 1}})

    def fit_one(rows, params):
        return fit(rows, "DecisionTreeClassifier", INPUTS, "y", params)

    found = search(flowers, fit_one, "y", {"max_depth": Range(1, 5, True)}, n_trials=7, sampler="tpe", seed=1)
    assert len(found.trials) == 7 and all(1 <= p["max_depth"] <= 5 for _, p, _ in found.trials)
    best = max(s for _, _, s in found.trials)
    table = found.table(flowers.sparkSession).orderBy("trial").collect()
    assert table[-1]["running_best"] == best
    assert [p for _, p, s in found.trials if s == best][0] == found.best_params
    every = search(flowers, fit_one, "y", {"max_depth": Range(1, 3, True), "min_samples_leaf": Range(1, 2, True)},
                   n_trials=2, sampler="grid")
    assert [tuple(p.values()) for _, p, _ in every.trials] == [(d, m) for d in (1, 2, 3) for m in (1, 2)]
    with pytest.raises(ValueError, match="whole-number"):
        search(flowers, fit_one, "y", {"C": Range(0.5, 2, False)}, sampler="grid")
    with pytest.raises(ValueError, match="cannot score"):
        search(flowers, fit_one, "y", {}, metric="Bleu", task="TabularClassificationTask")


def test_experiment_run(spark, flowers, tmp_path):
    store = RunStore(spark, str(tmp_path / "store"))
    raw = flowers.select(ROW_ID, *INPUTS, F.element_at(F.array(*map(F.lit, "abc")), F.col("y").cast("int") + 1).alias("y"))
    spec = {"train": 0.5, "test": 0.25, "validation": 0.25, "seed": 5}
    eid = store.add_experiment("e", "flowers", "TabularClassificationTask", INPUTS, ["y"], spec)
    depth = {"optimize": True, "fixed_value": 2, "lower_bound": 1, "upper_bound": 4}
    run = create_run(store, eid, "DecisionTreeClassifier", {"max_depth": depth}, "tuned")
    run_experiment(store, run, raw, n_trials=3, sampler="random")
    bad = create_run(store, eid, "DecisionTreeClassifier", {"nonsense": 1}, "broken")
    with pytest.raises(TypeError):
        run_experiment(store, bad, raw)
    states = {r.run_name: r for r in store.runs().collect()}
    assert states["tuned"].status == rt.FINISHED and states["broken"].status == rt.ERROR
    assert states["tuned"].start_time and states["tuned"].end_time and states["broken"].error
    assert store.trials().count() == 3 and store.metrics().count() == 12
    board = rt.leaderboard(store.runs(), store.metrics(), ["Accuracy", "F1"], ["max_depth"])
    row = {r.run_name: r for r in board.collect()}
    assert float(row["tuned"]["test_Accuracy"]) > 0.8 and row["broken"]["test_Accuracy"] is None
    assert score(load(states["tuned"].model_path), raw).count() == 240
    assert rt.runs_with_experiments(store.runs(), store.experiments()).count() == 1


# --- explanations --------------------------------------------------------------------------------


def linear(df):
    p = F.expr("0.3 + 0.05 * x0 - 0.02 * x1")
    return df.withColumn("probability", F.array(1 - p, p))


def test_linear_shap_is_exact_and_additive(flowers):
    shap = ex.KernelShap(linear, ["x0", "x1"], ["no", "yes"]).fit(flowers)
    got = shap.explain(flowers, decimals=False).collect()
    means = train(flowers).agg(F.avg("x0"), F.avg("x1")).first()
    values = {r[ROW_ID]: r for r in flowers.collect()}
    for r in got:
        w, mean = {"x0": (0.05, means[0]), "x1": (-0.02, means[1])}[r.feature]
        want = w * (values[r.instance_id][r.feature] - mean)
        assert r.shap == pytest.approx(want if r["class"] == 1 else -want, abs=1e-9)
    base = {r["class"]: r.base_value for r in shap.base_values().collect()}
    totals = {}
    for r in got:
        if r["class"] == 1:
            totals[r.instance_id] = totals.get(r.instance_id, base[1]) + r.shap
            assert totals[r.instance_id] is not None
    first = next(r for r in got if r["class"] == 1)
    assert totals[first.instance_id] == pytest.approx(first.model_prediction[1], abs=1e-3)
    with pytest.raises(ValueError, match="fitted"):
        ex.KernelShap(linear, ["x0"], ["a"]).explain(flowers)


def test_large_background_is_joined_in_blocks(flowers, monkeypatch):
    want = sorted(map(tuple, _brief(ex.KernelShap(linear, ["x0", "x1"], ["n", "y"]).fit(flowers).explain(flowers))))
    monkeypatch.setattr(ex, "MAX_LITERAL_ROWS", 10)
    got = sorted(map(tuple, _brief(ex.KernelShap(linear, ["x0", "x1"], ["n", "y"]).fit(flowers).explain(flowers))))
    assert got == want


def _brief(df):
    return df.select("instance_id", "class", "feature", "shap").collect()


def test_sampled_coalitions_recover_a_linear_game():
    m = 14
    masks, coef = ex.coalitions(m, seed=1)
    weights = np.random.default_rng(2).normal(size=m)
    values = 0.7 + masks @ weights
    assert coef.T @ values == pytest.approx(weights)
    assert len(masks) < 2**m


def test_full_coalitions_match_the_definition():
    masks, coef = ex.coalitions(3)
    game = {tuple(z): float(np.prod(np.array(z) + 1) ** 1.5) for z in masks}
    phi = coef.T @ np.array([game[tuple(z)] for z in masks])
    import itertools

    want = np.zeros(3)
    for order in itertools.permutations(range(3)):
        z = [0, 0, 0]
        for j in order:
            before = game[tuple(z)]
            z[j] = 1
            want[j] += (game[tuple(z)] - before) / 6
    assert phi == pytest.approx(want)


def test_explain_a_fitted_model(flowers, tmp_path):
    model = fit(train(flowers), "DecisionTreeClassifier", INPUTS, "y", {"max_depth": 4})
    names = ["a", "b", "c"]
    pdp = ex.explain(model, flowers, "partial_dependence", INPUTS, "y", names, str(tmp_path / "p"), grid_resolution=20)
    rows = pdp.collect()
    assert {r.feature for r in rows} == set(INPUTS)
    assert {r.grid_text for r in rows if r.feature == "color"} == {"red", "blue", "green"}
    assert sum(r.feature == "x0" for r in rows) == 20 * 3
    pfi = ex.explain(model, flowers, "permutation_importance", INPUTS, "y", names, n_repeats=3, scoring="balanced_accuracy")
    importance = {r.feature: r.importance_mean for r in pfi.collect()}
    assert importance["x0"] > 0.1 and importance["x1"] > 0.1
    few = ex.explain(model, flowers, "permutation_importance", INPUTS, "y", names, max_samples=0.5)
    assert few.count() == 3
    shap = ex.explain(
        model, flowers, "kernel_shap", INPUTS, "y", names, sample_background=True, n_background=10,
        instances=flowers.limit(4),
    ).collect()
    assert len(shap) == 4 * 3 * 3
    with pytest.raises(AssertionError):
        ex.partial_dependence(model.transform, flowers, INPUTS, names, 0.9, 0.1)


def test_kmeans_background(flowers):
    rows = ex.background_sample(flowers, ["x0", "x1"], 5, "kmeans").collect()
    assert sum(r.weight for r in rows) == 240
    known = {r[0] for r in flowers.select("x0").collect()}
    assert all(r.x0 in known for r in rows)
    text = ex.background_sample(flowers, INPUTS, 5, "kmeans")
    assert text.count() == 5 and {r.weight for r in text.collect()} == {1.0}


def test_all_classifiers_are_covered():
    assert {n for n, _ in CASES} | {"DummyClassifier"} == set(CLASSIFIERS)


def test_unknown_kernels_are_refused(flowers):
    with pytest.raises(ValueError, match="kernel should be"):
        fit(train(flowers), "SVC", INPUTS, "y", {"kernel": "cubic"})


@pytest.mark.parametrize("kernel, coef0", [("rbf", 0.0), ("poly", 0.0), ("poly", 1.5)])
def test_landmarks_span_the_kernel(spark, kernel, coef0):
    """With as many landmarks as the kernel has dimensions, inner products are the kernel's."""
    x = np.random.default_rng(2).normal(size=(12, 2))
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "i int, a double, b double")
    df = VectorAssembler(inputCols=["a", "b"], outputCol="v").transform(df)
    stage = Landmarks(inputCol="v", outputCol="m", kernel=kernel, gamma=0.7, coef0=coef0, degree=3,
                      points=json.dumps(x.tolist()))
    m = np.array([r["m"].toArray() for r in stage.transform(df).orderBy("i").collect()])
    want = stage._kernel()(x, x)
    assert np.allclose(m @ m.T, want, atol=1e-6)
    plain = np.exp(-0.7 * ((x[:, None] - x[None]) ** 2).sum(2)) if kernel == "rbf" else (0.7 * x @ x.T + coef0) ** 3
    assert np.allclose(want, plain)
    assert m.shape[1] == {("rbf", 0.0): 12, ("poly", 0.0): 4, ("poly", 1.5): 10}[kernel, coef0]


def test_lineage_of_stored_runs(spark, tmp_path):
    store = RunStore(spark, str(tmp_path))
    dataset = store.add_dataset("flowers", "/data/flowers")
    experiment = store.add_experiment("e", "flowers", "TabularClassificationTask", ["x1"], ["y"], {}, dataset)
    create_run(store, experiment, "DummyClassifier")
    row = rt.with_lineage(store.runs(), store.experiments(), store.datasets()).first()
    assert (row["experiment_name"], row["dataset_id"], row["dataset_name"]) == ("e", dataset, "flowers")
