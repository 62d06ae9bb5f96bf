"""Terms are counted by slices of a task's rows, before any of them becomes a row of its own."""

from collections import Counter

import pyarrow as pa
import pytest

from tablelab.operators import features

ROWS = [(None, "so it is"), (None, "it is so"), (1, "a is a is 42 is"), (2, None), (2, "is"), (3, "one is"), (4, "it is it is"),
        (4, "is it"), (4, None), (4, "it is"), (5, "Is_It ÉTÉ x été")]


def words(text):
    return [w for w in (text or "").lower().split(" ") if len(w) > 1]


def expected(min_n, max_n):
    found = Counter()
    for key, text in ROWS:
        w = words(text)
        found.update((key, " ".join(w[i:i + n])) for n in range(min_n, max_n + 1) for i in range(len(w) - n + 1))
    return found


@pytest.mark.parametrize("most", [1, 4, 1000])
@pytest.mark.parametrize("span", [(1, 1), (1, 2), (2, 3)])
def test_postings_of_slices(monkeypatch, most, span):
    monkeypatch.setattr(features, "COUNTED_WORDS", most)
    rows = pa.RecordBatch.from_arrays(
        [pa.array([k for k, _ in ROWS], pa.int64()),
         pa.array([None if t is None else words(t) for _, t in ROWS], pa.list_(pa.string()))], names=["id", "words"])
    sent = [r for b in features._postings(iter([rows.slice(0, 2), rows.slice(2, 0), rows.slice(2, 5), rows.slice(7)]), *span)
            for r in b.to_pylist()]
    got = [(i, r["term"], n) for r in sent for i, n in zip(r["ids"], r["ns"])]
    assert sorted(got, key=str) == sorted(((*k, n) for k, n in expected(*span).items()), key=str)
    if most == 1000 and span == (1, 1):
        # a term goes once for the rows inside a slice
        assert max(len(r["ids"]) for r in sent) > 1


def test_counts_of_ids_with_several_rows(spark, monkeypatch):
    monkeypatch.setattr(features, "COUNTED_WORDS", 3)
    rows = spark.createDataFrame(ROWS, "key long, text string")
    vocab = features.vocabulary(rows, "text", 1, 2)
    names = {r["term"]: r["index"] for r in vocab.collect()}
    want = expected(1, 2)
    assert sorted(names) == sorted({t for _, t in want}) and [names[t] for t in sorted(names)] == list(range(len(names)))
    got = features.term_counts(rows, vocab, "text", 1, 2, row_id="key")
    assert got.columns == ["key", "index", "n"]
    assert {(r["key"], r["index"]): r["n"] for r in got.collect()} == {(k, names[t]): n for (k, t), n in want.items()}
    assert got.count() == len(want)
