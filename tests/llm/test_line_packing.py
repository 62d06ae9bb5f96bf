"""Line dedup: texts are normalised as a whole, band rows travel packed."""

import random
from collections import defaultdict

import numpy as np

from tablelab.llm import line_dedup
from tests.llm.test_operators import documents


def test_a_text_is_normalised_as_its_lines_are():
    rng = random.Random(7)
    letters = ["a", "B", "Σ", "ΑΣ", "İ", "'", "́", " ", "  ", "\t", "\r", "\v", "\f", "\n", "\n", " ", " ", "ß"]
    for _ in range(5000):
        text = "".join(rng.choices(letters, k=rng.randrange(12)))
        assert line_dedup.normalised_lines(text) == [line_dedup.normalise(x) for x in text.split("\n")], repr(text)


def unpacked(batches):
    for b in batches:
        for bucket, keys, ids in zip(*(b.column(c).to_pylist() for c in ("bucket", "keys", "ids"))):
            yield from ((bucket, k, i) for k, i in zip(np.frombuffer(keys, np.int64).tolist(), np.frombuffer(ids, np.int64).tolist()))


def test_packed_rows(monkeypatch):
    monkeypatch.setattr(line_dedup, "PACKED", 1000)
    monkeypatch.setattr(line_dedup, "PACK", 8)
    draw = np.random.default_rng(8)
    for buckets in (1, 13, 70_000):
        parts = [(draw.integers(-50, 50, n), draw.integers(-1 << 60, 1 << 60, n)) for n in (5, 0, 999, 2500, 3)]
        packed = line_dedup._Packed(buckets)
        batches = [b for k, i in parts for b in packed.add(k, i)] + list(packed.rest())
        got = list(unpacked(batches))
        assert sorted(x[1:] for x in got) == sorted((int(k), int(i)) for ks, is_ in parts for k, i in zip(ks, is_))
        assert all(b == (k % (1 << 64)) % buckets for b, k, _ in got)
        assert max(len(x) for b in batches for x in b.column("keys").to_pylist()) <= 64
        # several band rows to a row, one bucket's after another's
        assert buckets > 1 or sum(b.num_rows for b in batches) < len(got) / 7
        assert list(packed.rest()) == []


def test_candidate_bands_are_packed(spark):
    rows = [(i, f"a line of its own about {i * 7919} things\nthe line that all of them have") for i in range(200)]
    bands = line_dedup.candidate_bands(documents(spark, rows)).coalesce(1)
    lines = {x for _, t in rows for x in t.split("\n")}
    found = {(k, i) for r in bands.collect() for k, i in zip(np.frombuffer(r["keys"], np.int64), np.frombuffer(r["ids"], np.int64))}
    keys, places = line_dedup.line_bands(sorted(lines))
    ids = line_dedup.halves([line_dedup.xxhash.xxh3_128_digest(x.encode()) for x in sorted(lines)])[:, 0]
    assert found == set(zip(keys.tolist(), ids[places].tolist()))
    assert bands.count() < len(found) / 4


def test_buckets_beyond_the_limit_lose_no_row(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(rng.randrange(3), i) for i in range(300)] + [(100 + i, i) for i in range(50)]
    held = defaultdict(set)
    for key, id_ in rows:
        held[key].add(id_)
    monkeypatch.setattr(line_dedup, "HELD", 10)
    got = {tuple(r) for r in line_dedup.shared_bands(spark.createDataFrame(rows, "key long, id long")).collect()}
    assert {(k, i) for k, ids in held.items() if len(ids) > 1 for i in ids} <= got <= set(rows)
