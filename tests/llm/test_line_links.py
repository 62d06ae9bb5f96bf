"""Line dedup: links, bands and whole results against brute force with the operator's pair rule."""

import random
from collections import defaultdict

import pandas as pd
import pytest

from tablelab.llm import line_dedup
from tests.llm.test_operators import documents


def similar(one, other):
    size = line_dedup.SHORT_SHINGLE if min(len(one), len(other)) < line_dedup.SHORT_CHARS else line_dedup.SHINGLE
    a, b = line_dedup.shingles(one, size), line_dedup.shingles(other, size)
    return len(a & b) >= line_dedup.SIMILARITY * len(a | b)


def classes(lines):
    """The first line that each line reaches."""
    label = list(range(len(lines)))
    for i in range(len(lines)):
        for j in range(i):
            if label[i] != label[j] and similar(lines[i], lines[j]):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return label


def joined(ids, links):
    label = {i: i for i in ids}
    for a, b in links:
        low, high = sorted((label[a], label[b]))
        label = {i: low if x == high else x for i, x in label.items()}
    return label


def random_lines(rng, count):
    bases = ["".join(rng.choices("abcd ", k=rng.choice([1, 2, 5, 30, 79, 81, 100, 300]))) for _ in range(3)]
    for _ in range(count):
        line = list(rng.choice(bases))
        for _ in range(rng.choice([0, 1, 2, 6])):
            line[rng.randrange(len(line))] = rng.choice("abcdxyz")
        yield "".join(line) + ("zz" if rng.random() < 0.3 else "")


@pytest.mark.parametrize("block", [3_000, line_dedup.SET_CHARS])
def test_links_join_what_all_pairs_join(monkeypatch, block):
    monkeypatch.setattr(line_dedup, "SET_CHARS", block)
    monkeypatch.setattr(line_dedup, "PAIR_SHINGLES", block)
    rng = random.Random(3)
    for _ in range(10):
        groups = {g: list(random_lines(rng, rng.choice([1, 2, 3, 8, 25]))) for g in range(12)}
        frame = pd.DataFrame([(g, 100 * g + k, x) for g, lines in groups.items() for k, x in enumerate(lines)],
                             columns=["g", "id", "line"])
        links = line_dedup.verified_links(pd.concat([frame, frame.iloc[:3]])).itertuples(index=False)
        got = joined(frame["id"], links)
        for g, lines in groups.items():
            assert [got[100 * g + k] - 100 * g for k in range(len(lines))] == classes(lines)
    assert line_dedup.verified_links(frame.iloc[:0]).empty


def test_lines_that_may_meet_short_ones():
    rng = random.Random(4)
    lines = ["".join(rng.choices("abcdefgh"[:rng.choice([1, 2, 8])], k=rng.choice([1, 5, 97, 98, 99, 100, 159, 160, 161, 400])))
             for _ in range(2000)]
    assert line_dedup.meet_short(lines) == [i for i, x in enumerate(lines) if line_dedup.meets_short(x)]


@pytest.mark.parametrize("batch", [1, 3, 10_000])
def test_shared_bands(spark, batch):
    rng = random.Random(5)
    rows = [(rng.randrange(60), rng.randrange(8)) for _ in range(150)] + [(99, 1)] * 20 + [(98, i % 10) for i in range(30)]
    held = defaultdict(set)
    for key, id_ in rows:
        held[key].add(id_)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = line_dedup.shared_bands(spark.createDataFrame(rows, "key long, id long")).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {tuple(r) for r in got} == {(k, i) for k, ids in held.items() if len(ids) > 1 for i in ids}


def test_whole_result_by_the_pair_rule(spark):
    line = "the quick brown fox jumps over a lazy dog while 7 pale zebras watch from behind"
    rows = [(1, line + "\nalone\n\nMenu"), (2, line[:40] + "!!" + line[40:] + "\nmenu\nother words"),
            (None, "menu\n" + line), (None, "kept"), (3, None), (4, ""), (4, "alone\nalone\nnew one"), (5, "kept")]
    got = {(r["doc_id"], r["text"], r["n_lines_removed"])
           for r in line_dedup.dedup_lines(documents(spark, rows)).collect()}
    # no id comes first
    assert got == {(None, "menu\n" + line, 0), (None, "kept", 0), (1, "alone\n", 2), (2, "other words", 2),
                   (3, None, 0), (4, "", 0), (4, "new one", 2), (5, "", 1)}
