"""Approximate neighbours: every row is found where all buckets are visited, and recall is what was asked for."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tablelab import ROW_ID
from tablelab.models import lsh
from tablelab.models.knn import fit_knn


@pytest.fixture(scope="module")
def points(spark):
    draw = np.random.default_rng(6)
    x = draw.normal(size=(1500, 8))
    x[1400:] = x[0]  # copies
    rows = [(i, *map(float, v), float(i % 3)) for i, v in enumerate(x)]
    columns = [f"x{i}" for i in range(8)]
    df = spark.createDataFrame(rows, f"{ROW_ID} long, {', '.join(f'{c} double' for c in columns)}, y double")
    return x, VectorAssembler(inputCols=columns, outputCol="v").transform(df).select(ROW_ID, "v", "y").repartition(4).persist()


def test_buckets_are_ranked_by_what_a_query_has_to_cross():
    draw = np.random.default_rng(1)
    planes = lsh.Planes(np.zeros(4), draw.normal(size=(2, 3, 4)))
    x = draw.normal(size=(20, 4))
    for t in range(2):
        order = planes.order(x, t)
        assert (order[:, 0] == planes.bucket(x, t)).all() and (np.sort(order, 1) == np.arange(8)).all()
        d = planes.sides(x, t)
        for row, sides in zip(order, d):
            costs = [sum(s ** 2 for k, s in enumerate(sides) if (b >> k & 1) != (s > 0)) for b in row]
            assert costs == sorted(costs)
    again = lsh.Planes.read(planes.dump())
    assert (again.order(x, 1) == planes.order(x, 1)).all()


def test_recall(points, tmp_path):
    x, df = points
    queries = df.filter(F.col(ROW_ID) < 60)
    exact = fit_knn(df, "v", "y", 3, 5, "uniform")
    want = {}
    for r in exact.neighbour_pairs(queries).collect():
        want.setdefault(r["qid"], set()).add(r["id"])
    model = fit_knn(df, "v", "y", 3, 5, "uniform", approx=0.9)
    model.block_rows = 50  # buckets of several blocks
    got = model.neighbour_pairs(queries).persist()
    found = {}
    for r in got.collect():
        found.setdefault(r["qid"], []).append((r["distance"], r["id"]))
        assert r["distance"] == pytest.approx(np.sqrt(((x[r["qid"]] - x[r["id"]]) ** 2).sum()))
    assert all(len(v) == len({i for _, i in v}) == 5 and min(v)[1] == q for q, v in found.items())
    hit = sum(len(want[q] & {i for _, i in v}) for q, v in found.items())
    assert 0.85 * 300 <= hit
    planes = lsh.Planes.read(model.getOrDefault(model.planes))
    assert planes.probes < 1 << planes.bits
    recall = lsh.measured_recall(exact.neighbour_pairs(queries), got, 5).agg(F.sum("found")).first()[0]
    assert recall >= hit
    model.write().overwrite().save(str(tmp_path / "m"))
    again = type(model).load(str(tmp_path / "m"))
    assert sorted(map(repr, again.transform(queries).collect())) == sorted(map(repr, model.transform(queries).collect()))


def test_all_buckets_give_exact_neighbours(points):
    _, df = points
    queries = df.filter(F.col(ROW_ID) % 100 == 7)
    model = fit_knn(df, "v", "y", 3, 4, "distance", approx=1.0)
    planes = lsh.Planes.read(model.getOrDefault(model.planes))
    planes.probes = 1 << planes.bits
    model._set(planes=planes.dump())
    exact = fit_knn(df, "v", "y", 3, 4, "distance")
    pick = lambda m: sorted((r["qid"], round(r["distance"], 9), r["id"]) for r in m.neighbour_pairs(queries).collect())
    assert pick(model) == pick(exact)
    shares = {r[ROW_ID]: r["_probability"].toArray() for r in exact.transform(queries).collect()}
    for r in model.transform(queries).collect():
        assert r["_probability"].toArray() == pytest.approx(shares[r[ROW_ID]])
