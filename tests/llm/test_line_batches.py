"""Line dedup: the texts of a batch are cut into lines together, keys carry their marks, lines that may meet short ones
are found by whole rows of characters."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tablelab.llm import common, line_dedup


def test_lines_of_a_batch_are_those_of_its_texts():
    rng = random.Random(11)
    letters = ["a", "B", "Σ", "ΑΣ", "İ", " ", "  ", "\t", "\r", "\v", "\f", "\n", "\n", "\n", " ", "ß", " ", "\x1c"]
    for _ in range(1500):
        texts = [None if rng.random() < 0.1 else "".join(rng.choices(letters, k=rng.randrange(8))) for _ in range(rng.randrange(5))]
        rows, numbers, digests, lines = line_dedup.lines_of(pa.record_batch({"text": pa.array(texts, pa.string())}))
        expected = [(r, n, line_dedup.normalise(x)) for r, t in enumerate(texts) for n, x in enumerate((t or "").split("\n"))]
        expected = [x for x in expected if x[2]]
        assert list(zip(rows.tolist(), numbers.tolist(), [x.decode() for x in lines])) == expected, texts
        assert digests == [line_dedup.xxhash.xxh3_128_digest(x) for x in lines]


def test_lines_that_may_meet_short_ones_have_few_shingles():
    rng = random.Random(12)
    lines = ["".join(rng.choices(["\0", "a", "b", "\U0001F600", "\U0002F600", "é", "x", "y", "z"][:rng.choice([2, 4, 9])],
                                 k=rng.choice([98, 99, 100, 101, 102, 159, 160, 400]))) for _ in range(3000)]
    assert line_dedup.meet_short(lines) == [i for i, x in enumerate(lines) if line_dedup.meets_short(x)]


@pytest.mark.parametrize("held", [10, 1 << 23])
def test_marks_find_the_keys_that_hold_the_same_lines(spark, monkeypatch, held):
    monkeypatch.setattr(line_dedup, "HELD", held)
    sets = {1: {5, 6}, 2: {5, 6}, 3: {5, 7}, 4: {5, 6, 7}, 5: {5, 6, 7}, 6: {-9}, 7: {8, 9}, **{k: set(range(20)) for k in range(100, 104)}}
    rows = [(k, i) for k, ids in sets.items() for i in ids]
    bands = spark.createDataFrame(rows + rows[:3], "key long, id long").coalesce(1)
    marked = line_dedup.marked_bands(bands).collect()
    if held > 10:
        for k, ids in sets.items():
            mine = sorted((r for r in marked if r["key"] == k), key=lambda r: r["id"])
            assert [(r["id"], r["n"]) for r in mine] == [(i, 0 if j else len(ids)) for j, i in enumerate(sorted(ids)) if len(ids) > 1]
    got = {}
    for r in line_dedup.without_twins(line_dedup.marked_bands(bands)).collect():
        got.setdefault((r["key"], r["size"]), set()).add(r["id"])
    several = [frozenset(ids) for ids in got.values() if len(ids) > 1]
    assert set(several) == {frozenset(x) for x in sets.values() if len(x) > 1}
    if held > 10:
        assert len(several) == len(set(several)) and all(size == len(sets[k]) for k, size in got)
    grouped = common.bounded_groups(line_dedup.without_twins(line_dedup.marked_bands(bands)), "key", "id", 4, size="size")
    met = {}
    for r in grouped.collect():
        met.setdefault(r["g"], set()).add(r["id"])
    for ids in sets.values():
        assert all(any({a, b} <= x for x in met.values()) for a in ids for b in ids if a != b)


def test_signatures_do_not_depend_on_blocks(monkeypatch):
    rng = np.random.default_rng(13)
    lines = ["".join(map(chr, rng.integers(97, 123, n))) for n in rng.integers(80, 400, 50)]
    whole = line_dedup.signatures(lines)
    monkeypatch.setattr(line_dedup, "SIGNED_CHARS", 500)
    assert np.array_equal(whole, line_dedup.signatures(lines))


def test_sets_are_made_for_pairs_that_bitmaps_leave(monkeypatch):
    rng = random.Random(14)
    words = ["".join(rng.choices("abcdefghij", k=rng.randrange(2, 9))) for _ in range(400)]
    lines = [" ".join(rng.choices(words, k=rng.choice([1, 20, 60, 2000]))) for _ in range(60)] + ["", "a", "ab", "abab" * 500]
    lines += [x[:len(x) // 2] + rng.choice(["", "x", "other words"]) + x[len(x) // 2 + 3:] for x in lines]
    a, b = np.triu_indices(len(lines), 1)
    for size in (line_dedup.SHORT_SHINGLE, line_dedup.SHINGLE):
        expected = [line_dedup.similar(lines[i], lines[j], size) for i, j in zip(a, b)]
        for bits in (6, 12):
            monkeypatch.setattr(line_dedup, "MARK_BITS", bits)
            sets = line_dedup.ShingleSets(lines, size)
            assert sets.linked(a, b, line_dedup.SIMILARITY).tolist() == expected
        assert any(expected) and sum(x is not None for x in sets.sets) == np.count_nonzero(sets.counts)
    unlike = line_dedup.ShingleSets(["".join(rng.choices("abcdefghijklmnop", k=300)) for _ in range(20)], line_dedup.SHINGLE)
    a, b = np.triu_indices(20, 1)
    assert not unlike.linked(a, b, line_dedup.SIMILARITY).any() and unlike.sets == [None] * 20
