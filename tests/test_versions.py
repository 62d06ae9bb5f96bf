"""Versions of saved datasets, and prediction with the model of a run."""

import pytest
from pyspark.sql import functions as F

from tablelab import ROW_ID, SPLIT
from tablelab.models import fit, load, save, score_by_name
from tablelab.operators import runs as rt
from tablelab.operators.schema import class_names, encode_label
from tablelab.plans.experiment import RunStore, create_run, predict_arriving, predict_run, run_experiment
from tablelab.sources import history, load_dataset, read_manifest, resplit_saved, save_dataset, storage, update_saved_spec


def rows(spark, ids, split="train"):
    return spark.createDataFrame(
        [(i, float(i), "ab"[i % 2], split) for i in ids], f"{ROW_ID} long, x double, y string, {SPLIT} string")


def values(df):
    return sorted((r["x"], r[SPLIT]) for r in df.collect())


def test_two_appends_and_a_reader_in_between(spark, tmp_path):
    path = str(tmp_path / "d")
    save_dataset(encode_label(rows(spark, range(4)), "y"), path)
    first = load_dataset(spark, path)
    save_dataset(encode_label(rows(spark, range(3), "test"), "y"), path, "append")
    second = load_dataset(spark, path)
    save_dataset(encode_label(rows(spark, [7]), "y", ["a", "b"]), path, "append")
    want = [(float(i), "train") for i in range(4)]
    assert values(first) == want  # planned before the appends, read after them
    want += [(float(i), "test") for i in range(3)]
    assert values(second) == sorted(want)
    newest = load_dataset(spark, path)
    assert values(newest) == sorted([*want, (7.0, "train")])
    assert [r[0] for r in newest.select(ROW_ID).orderBy(ROW_ID).collect()] == [*range(7), 14]  # behind the largest id
    assert class_names(newest, "y") == ["a", "b"] and {r["y"] for r in newest.collect()} == {0.0, 1.0}
    assert read_manifest(spark, path) == {"splits": ["test", "train"]}
    assert read_manifest(spark, path, 0) == {"splits": ["train"]}
    assert [(r["version"], len(r["parts"]), r["change"]) for r in history(spark, path).orderBy("version").collect()] == [
        (0, 1, "save"), (1, 2, "append"), (2, 3, "append")]
    with pytest.raises(ValueError, match="already"):
        save_dataset(newest, path)
    with pytest.raises(ValueError, match="no version 9"):
        load_dataset(spark, path, 9)
    with pytest.raises(ValueError, match="need the columns"):
        save_dataset(newest.drop("x"), path, "append")


def test_changes_are_written_back(spark, tmp_path):
    path = str(tmp_path / "d")
    save_dataset(rows(spark, range(10)), path)
    assert update_saved_spec(spark, path, {"x": ("Value", "int64"), "y": ("ClassLabel", "")}) == 1
    changed = load_dataset(spark, path)
    assert dict(changed.dtypes)["x"] == "bigint" and class_names(changed, "y") == ["a", "b"]
    assert dict(load_dataset(spark, path, 0).dtypes)["x"] == "double"
    assert resplit_saved(spark, path, {"train": 0.6, "test": 0.2, "validation": 0.2}) == 2
    sizes = {r[SPLIT]: r["count"] for r in load_dataset(spark, path).groupBy(SPLIT).count().collect()}
    assert sizes == {"train": 6, "test": 2, "validation": 2}
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        update_saved_spec(spark, path, {SPLIT: ("Value", "int64")})
    assert load_dataset(spark, path).count() == 10 and history(spark, path).count() == 3
    save_dataset(rows(spark, [1]), path, "overwrite")
    assert load_dataset(spark, path).count() == 1 and load_dataset(spark, path, 2).count() == 10


def test_the_slower_of_two_writers_starts_anew(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "d")
    save_dataset(rows(spark, range(3)), path)
    newest, raced = storage._newest, []

    def slow(session, where, version=None):
        out = newest(session, where, version)
        if version is None and not raced:
            raced.append(1)
            save_dataset(rows(spark, [5]), path, "append")  # another writer takes the next version
        return out

    monkeypatch.setattr(storage, "_newest", slow)
    save_dataset(rows(spark, [6]), path, "append")
    monkeypatch.setattr(storage, "_newest", newest)
    assert [x for x, _ in values(load_dataset(spark, path))] == [0.0, 1.0, 2.0, 5.0, 6.0]
    assert load_dataset(spark, path).select(ROW_ID).distinct().count() == 5


@pytest.fixture(scope="module")
def finished(spark, tmp_path_factory):
    store = RunStore(spark, str(tmp_path_factory.mktemp("store")))
    data = spark.createDataFrame(
        [(i, float(i % 10), "low" if i % 10 < 5 else "top", "train") for i in range(60)],
        f"{ROW_ID} long, x double, y string, {SPLIT} string")
    experiment = store.add_experiment("e", "d", "TabularClassificationTask", ["x"], ["y"], {})
    run = create_run(store, experiment, "DecisionTreeClassifier", {"max_depth": 2})
    run_experiment(store, run, data)
    return store, run["run_id"], experiment


def test_prediction_by_run(spark, finished, tmp_path):
    store, run_id, experiment = finished
    new = spark.createDataFrame([("p", 9, 1), ("q", 2, 1)], "name string, x int, `class` int").drop("class")
    out = predict_run(store, run_id, new)
    assert {(r["name"], r["class"]) for r in out.collect()} == {("p", "top"), ("q", "low")}
    with pytest.raises(ValueError, match="columns missing"):
        predict_run(store, run_id, new.drop("x"))
    waiting = create_run(store, experiment, "DummyClassifier")
    with pytest.raises(ValueError, match="no finished model"):
        predict_run(store, waiting["run_id"], new)
    with pytest.raises(ValueError, match="does not exist"):
        predict_run(store, "nobody", new)
    states = sorted((r["status"], r["error"] is None) for r in store.predictions().collect())
    assert states == [(rt.FINISHED, True), (rt.ERROR, False), (rt.ERROR, False), (rt.ERROR, False)]

    source = str(tmp_path / "in")
    new.write.json(source)
    stream = spark.readStream.schema("name string, x int").json(source)
    predict_arriving(store, run_id, stream, str(tmp_path / "out"), str(tmp_path / "c"), once=True).awaitTermination()
    arrived = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {(r["name"], r["class"]) for r in arrived} == {("p", "top"), ("q", "low")}


def test_models_keep_their_names(spark, tmp_path):
    data = encode_label(spark.createDataFrame([(float(i), "no" if i < 5 else "yes") for i in range(10)], "x double, y string"), "y")
    for name in ("DecisionTreeClassifier", "DummyClassifier"):
        path = str(tmp_path / name)
        save(fit(data, name, ["x"] if name != "DummyClassifier" else [], "y"), path)
        model = load(path)
        assert model.class_names == ["no", "yes"]
        assert score_by_name(model, data.select("x")).filter(F.col("class").isNull()).count() == 0
