"""The text model against the same objective minimised over a dense matrix."""

import re
from collections import Counter

import numpy as np
import pytest

from tablelab.models import fit_text, load, save, score, text_linear
from tablelab.models.text_linear import TextLinearModel, direction, fit_text_linear
from tablelab.operators.schema import encode_label

WORDS = "red green blue tall short old new fast slow warm cold".split()


def made(n=90, classes=3, seed=8):
    draw = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        words = draw.choice(WORDS, draw.integers(0, 9)).tolist() + [f"only{i}"] * (i % 4 == 0)
        y = int("red" in words) + int("cold" in words) * (classes - 2)
        rows.append((" ".join(words), f"c{(y if draw.random() > 0.15 else draw.integers(classes))}"))
    rows += [("red red tall", "c1"), ("red red tall", "c0"), ("red red tall", "c1")] * 8  # one text, several labels
    return rows + [(None, "c0"), ("", "c1"), ("unlabelled words here", None)]


def grams(text, min_n, max_n):
    w = re.findall(r"\w{2,}", (text or "").lower())
    return Counter(" ".join(w[i:i + n]) for n in range(min_n, max_n + 1) for i in range(len(w) - n + 1))


def dense(rows, classes, C, min_n, max_n):
    """Newton steps on the dense problem: weights of each class's margin, and the shares of each text."""
    rows = [r for r in rows if r[1] is not None]
    counts = [grams(t, min_n, max_n) for t, _ in rows]
    names = sorted({g for c in counts for g in c})
    x = np.array([[1.0] + [c[g] for g in names] for c in counts])
    y = np.eye(classes)[[int(c[1]) for _, c in rows]]
    tracked = [1] if classes == 2 else list(range(classes))
    n, d, k = len(x), x.shape[1], len(tracked)
    pen = np.diag([0.0] + [1 / (C * n)] * (d - 1))
    w = np.zeros((d, k))
    for _ in range(60):
        m = x @ w
        m = np.concatenate([np.zeros((n, 1)), m], 1) if classes == 2 else m
        p = np.exp(m - m.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = x.T @ (p - y)[:, tracked] / n + pen @ w
        h = np.zeros((d * k, d * k))
        for a in range(k):
            for b in range(k):
                s = p[:, tracked[a]] * ((a == b) - p[:, tracked[b]])
                h[a * d:(a + 1) * d, b * d:(b + 1) * d] = x.T @ (x * s[:, None]) / n + (a == b) * pen
        w -= np.linalg.lstsq(h, g.T.ravel(), rcond=None)[0].reshape(k, d).T
    return {(t or ""): q for (t, _), q in zip(rows, p)}, dict(zip(names, w[1:]))


@pytest.mark.parametrize("classes, hot, ngrams", [(2, 10_000, (1, 1)), (3, 3, (1, 2))])
def test_weights_are_those_of_the_dense_problem(spark, classes, hot, ngrams):
    rows = made(classes=classes)
    names = [f"c{k}" for k in range(classes)]
    df = spark.createDataFrame([(t, y, 1, {"a": 1}) for t, y in rows], "key string, y string, n int, `a.b` map<string,int>")
    df = encode_label(df.repartition(4), "y", names)
    model = fit_text_linear(df, "key", "y", classes, C=0.3, max_iter=60, tol=1e-10, hot_terms=hot,
                            min_n=ngrams[0], max_n=ngrams[1])
    shares, weights = dense(rows, classes, 0.3, *ngrams)
    table = {r["term"]: r for r in model.table.collect()}
    assert set(table) == set(weights) | {None}
    for term, w in weights.items():
        assert [table[term][f"w{k}"] for k in range(len(w))] == pytest.approx(w.tolist(), abs=2e-3)
    scored = score(model, df)
    assert scored.columns == [*df.columns, "probability", "prediction"] and scored.count() == len(rows)
    for r in scored.filter("y is not null").collect():
        assert list(r["probability"]) == pytest.approx(shares[r["key"] or ""].tolist(), abs=2e-3)
        assert r["prediction"] == max(range(classes), key=lambda k: r["probability"][k])


def test_saved_and_scored_on_new_texts(spark, tmp_path):
    rows = [(i, "good fine great" if i % 2 else "bad poor awful", "np"[i % 2]) for i in range(40)]
    df = encode_label(spark.createDataFrame(rows, "i long, words string, y string"), "y")
    model = fit_text(df, "LogisticRegression", "words", "y", {"max_iter": 5}, 1, 2)
    assert isinstance(model, TextLinearModel)
    save(model, str(tmp_path / "m"))
    new = spark.createDataFrame([(1, "GREAT unknown"), (2, "truly awful"), (3, None)], "i long, words string")
    got = {r["i"]: r for r in score(load(str(tmp_path / "m")), new).collect()}
    assert (got[1]["prediction"], got[2]["prediction"]) == (1.0, 0.0)
    assert got[3]["probability"][1] == pytest.approx(0.5, abs=1e-6)
    # other penalties and classifiers learn on vectors
    other = fit_text(df, "LogisticRegression", "words", "y", {"penalty": "l1", "C": 10.0})
    assert [r.prediction for r in score(other, new.filter("i < 3").coalesce(1)).orderBy("i").collect()] == [1.0, 0.0]


def test_stream_of_texts(spark, tmp_path):
    from tablelab.streaming import score_stream

    df = encode_label(spark.createDataFrame([("up", "a"), ("down", "b")] * 5, "t string, y string"), "y")
    model = fit_text(df, "LogisticRegression", "t", "y", {"max_iter": 3})
    source = str(tmp_path / "in")
    df.select("t").write.json(source)
    stream = spark.readStream.schema("t string").json(source)
    query = score_stream(model, stream, df.select("t").schema, str(tmp_path / "out"), str(tmp_path / "c"), once=True)
    query.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out")).groupBy("t", "prediction").count().collect()
    assert {(r["t"], r["prediction"], r["count"]) for r in out} == {("up", 0.0, 5), ("down", 1.0, 5)}


def test_no_labels(spark):
    df = spark.createDataFrame([("a word", None)], "t string, y double")
    with pytest.raises(ValueError, match="no labels"):
        fit_text_linear(df, "t", "y", 2)


def test_directions_of_a_quadratic():
    """On a quadratic, exact line searches along the directions end after as many steps as there are unknowns."""
    draw = np.random.default_rng(0)
    a = draw.normal(size=(4, 4))
    a, x, past = a @ a.T + np.eye(4), draw.normal(size=4), []
    for _ in range(4):
        g = a @ x
        basis = np.array([s for s, _ in past] + [y for _, y in past] + [g])
        p = direction(basis @ basis.T, len(past)) @ basis
        step = -(g @ p) / (p @ a @ p) * p
        past.insert(0, (step, a @ step))
        x = x + step
    assert np.abs(x).max() < 1e-6



def test_lengths_of_a_step_are_tried_on_one_pass_over_the_counts(spark, monkeypatch):
    written, tried = [], []
    write, loss = text_linear.materialize, text_linear._Fit.loss
    monkeypatch.setattr(text_linear, "materialize", lambda df, name: written.append(name) or write(df, name))
    monkeypatch.setattr(text_linear._Fit, "loss", lambda *a: tried.append(1) or loss(*a), raising=False)
    # a first step of length 1 says yes by far too much
    rows = [("word " * 50, float(i % 5 < 3)) for i in range(10)] + [("other", 0.0)]
    df = spark.createDataFrame(rows, "text string, y double")
    model = text_linear.fit_text_linear(df, "text", "y", 2, max_iter=2)
    assert written.count("errors") == model.steps + 1
    assert written.count("margins") == model.steps == 2 < len(tried)
