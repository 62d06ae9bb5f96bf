"""Terms of the same texts are one column of the fit; texts come in blocks."""

import numpy as np
import pytest

from tablelab.models import text_linear
from tests.test_text_linear import made


def test_packed_by_blocks(spark):
    texts = [(0, "b a a"), (1, "a c"), (2, None), (3, "aa bb aa bb"), (4, "bb aa"), (5, "aa"), (7, "cc aa bb")]
    df = spark.createDataFrame(texts, "key long, text string")
    items = text_linear.materialize(df.repartition(3), "texts")
    named, columns, marked = text_linear._columns(items, 8, 4, 1, 2, 1)
    cells = {}
    for r in columns.collect():
        for x in np.frombuffer(r["cells"], np.int64).tolist():
            cells.setdefault(r["index"], {})[r["block"] * 4 + (x >> 32)] = x & 0xFFFFFFFF
    index = {r["held"]: r for r in marked.collect()}
    got = {r["term"]: cells[index[r["held"]]["index"]] for r in named.collect()}
    assert got == {"aa": {3: 2, 4: 1, 5: 1, 7: 1}, "bb": {3: 2, 4: 1, 7: 1}, "cc": {7: 1}, "aa bb": {3: 2, 7: 1},
                   "bb aa": {3: 1, 4: 1}, "cc aa": {7: 1}}
    assert sorted(r["m"] for r in index.values()) == [1, 1, 1, 1, 2]  # "cc" and "cc aa" are one column
    assert [index[r["held"]]["hot"] for r in named.orderBy("term").collect()] == [True, False, False, False, False, False]


def test_blocks_and_columns_change_no_weight(spark, monkeypatch):
    # every 3rd text has a term and bigrams of its own
    rows = [(f"{t} only{i}x only{i}y" if t and i % 3 == 0 else t, y) for i, (t, y) in enumerate(made(40, 3))]
    df = spark.createDataFrame([(t, None if y is None else float(y[1:])) for t, y in rows], "text string, y double").coalesce(2)
    given = {"C": 0.3, "max_iter": 2, "max_n": 2, "hot_terms": 4}
    whole = text_linear.fit_text_linear(df, "text", "y", 3, **given)
    want = {r["term"]: [r["w0"], r["w1"], r["w2"]] for r in whole.table.collect()}
    monkeypatch.setattr(text_linear, "BLOCK", 48)  # 16 texts
    monkeypatch.setattr(text_linear, "SENT", 100)
    sizes, write = [], text_linear.materialize

    def noted(df, name):
        out = write(df, name)
        if "g0" in out.columns:
            sizes.append(out.count())
        return out

    monkeypatch.setattr(text_linear, "materialize", noted)
    model = text_linear.fit_text_linear(df, "text", "y", 3, **given)
    got = {r["term"]: [r["w0"], r["w1"], r["w2"]] for r in model.table.collect()}
    assert model.steps == whole.steps == 2 and got.keys() == want.keys()
    assert all(got[t] == pytest.approx(want[t], abs=1e-9) for t in want)
    assert len(set(sizes)) == 1 and sizes[0] < len(want)  # a row per column, not per term
    scored = [{(r["text"], *[round(p, 9) for p in r["probability"]]) for r in m.transform(df).collect()} for m in (whole, model)]
    assert scored[0] == scored[1]
