"""Mixing, vector codes and tokenizer alignment against brute-force versions and on edge cases."""

import hashlib
import random
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablelab.llm import alignment, mixing, queries, vector_codes
from tablelab.llm.packing import byte_letters
from tablelab.llm.queries import table, tokenizer_path

LONG = " ".join(f"w{i % 997}x{i // 997}" for i in range(20_000))


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- 11: mixing

MIXED = "doc_id long, text string, source string, size string, target map<string,int>, part_ int, `a.b` int"


def mixed(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", None, 3, 4) for i, t, s in rows], MIXED)


def brute_targets(sizes, weights, share, epochs):
    """Share out by weight, again and again, until no source is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if weight[s] * level > epochs * sizes[s]}
        if not above:
            return out | {s: weight[s] * level for s in open_}
        out |= {s: Fraction(epochs * sizes[s]) for s in above}
        left -= sum(epochs * sizes[s] for s in above)
        open_ -= above
    return out


def brute_mix(rows, weights=(5, 2, 1), share=Fraction(3, 2), epochs=2):
    docs = [(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")),
             hashlib.md5(f"11:{'' if i is None else i}:{t or ''}".encode()).hexdigest()) for i, t, s in rows]
    sizes = defaultdict(int)
    for _, s, n, _ in docs:
        sizes[s] += n
    targets = brute_targets(sizes, weights, share, epochs)
    out = []
    for s in sizes:
        taken, budget = Counter(), int(targets[s])
        mine = sorted((d for d in docs if d[1] == s), key=lambda d: d[3])
        while budget and sizes[s]:
            for at, d in enumerate(mine):
                step = min(budget, d[2])
                taken[at] += step
                budget -= step
        out += [(d[0], d[2], sizes[s], float(targets[s]), taken[at]) for at, d in enumerate(mine)]
    return sorted(out, key=repr)


def mixing_rows():
    draw = random.Random(5)
    rows = [(i, "word " * draw.randrange(40), draw.choice(["a", "a", "a", "a", "b", "c", "Z", "é", "", None]))
            for i in range(400)]
    rows += [(1000 + i, "hot copy of words", "a") for i in range(150)] + [(7, "same row here", "b")] * 90
    return rows + [(None, "no id", "b"), (None, None, None), (3, "", "empty only"), (4, None, "empty only"),
                   (5, LONG, "c"), (6, "a\x1cb c\td\x0be", "d")]


@pytest.mark.parametrize("weights, share, epochs", [((5, 2, 1), (3, 2), 2), ((3, 1), (19, 10), 3)])
def test_mixing(spark, monkeypatch, weights, share, epochs):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 50)
    rows = mixing_rows()
    got = mixing.mix(mixed(spark, rows).repartition(5), weights, share, epochs)
    assert rows_of(got) == brute_mix(rows, weights, Fraction(*share), epochs)
    again = mixing.mix(mixed(spark, rows[::-1]).repartition(2), weights, share, epochs)
    assert rows_of(again) == rows_of(got)


def test_mixing_takes_targets_to_the_word(spark, sf):
    got = mixing.mix(table(spark, sf, "documents")).withColumn("id", F.col("doc_id"))
    source = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source")
    sums = got.join(source, "id").groupBy("source").agg(F.sum("taken").alias("n"), F.max("target").alias("t")).collect()
    assert all(0 <= r["t"] - r["n"] < 1 for r in sums)
    assert got.filter("taken > 2 * size").count() == 0
    assert got.schema.simpleString().startswith("struct<doc_id:bigint,size:bigint,source_size:bigint,target:double,taken:bigint")


def test_mixing_of_nothing(spark):
    assert rows_of(mixing.mix(mixed(spark, []))) == []
    assert rows_of(mixing.mix(mixed(spark, [(1, None, "a"), (2, " ", None)]))) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 40)
    rows = [(i, "w " * (1 + i * i % 23), f"s{i % 211:04}") for i in range(900)]
    assert rows_of(mixing.mix(mixed(spark, rows).repartition(4))) == brute_mix(rows)


def test_mixing_has_no_python_in_its_plan(spark, sf):
    plan = mixing.mix(table(spark, sf, "documents"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# --- 12: vector codes

VECTORS = "vec_id long, embedding array<float>, label int, numbers int, code string, `a.b` map<int,int>"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, y, 0, "x", None) for i, v, y in rows], VECTORS)


def brute_codes(rows, entries=256, rounds=4, parts=4):
    kept = [(i, [int(np.floor(np.float32(x).astype(float) * 1024)) for x in v], y) for i, v, y in rows
            if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    first = {}
    for i, v, _ in sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        first.setdefault(i, v)
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width:(p + 1) * width]
    books = [[cut(v, p) for v in list(first.values())[:entries]] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(cut(v, p), e)), k) for k, e in enumerate(books[p]))
                 for p in range(parts)] for _, v, _ in kept]

    for _ in range(rounds):
        codes = assign()
        for p in range(parts):
            members = defaultdict(list)
            for (_, v, _), c in zip(kept, codes):
                members[c[p][1]].append(cut(v, p))
            for k, m in members.items():
                books[p][k] = [sum(x) // len(m) for x in zip(*m)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    errors, codes = defaultdict(int), assign()
    for (_, _, y), c in zip(kept, codes):
        errors[y] += sum(d for d, _ in c)
    return sorted(((i, "".join(f"{k:02x}" for _, k in c), sum(d for d, _ in c), errors[y], digest)
                   for (i, _, y), c in zip(kept, codes)), key=repr)


def vector_rows(n=120, width=8, spread=1.0):
    draw = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in draw.normal(0, spread, width).round(2)], int(i) % 3) for i in range(n)]
    rows += [(500 + i, rows[4][1], None) for i in range(40)] + [rows[5]] * 3 + [(7, rows[9][1], 1)]
    bad = [None, [None] + [0.0] * (width - 1), [float("nan")] * width, [float("inf")] + [0.0] * (width - 1)]
    return rows + [(-9 + i, v, 1) for i, v in enumerate(bad)] + [(None, [0.25] * width, 2), (-3, [0.0] * width, None)]


@pytest.mark.parametrize("entries, spread", [(16, 1.0), (256, 1.0), (5, 30_000.0)])
def test_vector_codes(spark, entries, spread):
    rows = vector_rows(spread=spread)
    got = vector_codes.compress(vectors(spark, rows).repartition(3), entries=entries)
    assert rows_of(got) == brute_codes(rows, entries)


def test_vector_codes_of_nothing(spark):
    assert rows_of(vector_codes.compress(vectors(spark, [(1, None, 2)]))) == []
    got = vector_codes.compress(vectors(spark, [(1, [0.5, -0.5, 0.0, 1.0], None)] * 2))
    assert [tuple(r)[:4] for r in got.collect()] == [(1, "00000000", 0, 0)] * 2


def test_vectors_that_have_no_exact_codes(spark):
    with pytest.raises(Exception, match="different lengths"):
        vector_codes.compress(vectors(spark, [(1, [0.0] * 4, 0), (2, [0.0] * 8, 0)])).collect()
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.compress(vectors(spark, [(1, [0.0] * 6, 0)]))


def test_balls_leave_comparisons_out():
    draw = np.random.default_rng(1)
    centres = draw.integers(-9000, 9000, (64, 16))
    x = centres[draw.integers(0, 64, 3000)] + draw.integers(-900, 900, (3000, 16))
    old, _ = vector_codes.nearest(x, centres)
    moved = centres + draw.integers(-200, 200, centres.shape)
    balls = vector_codes.Balls(moved)
    code, error = balls.reassign(x, old)
    want = vector_codes.nearest(x, moved)
    assert (code == want[0]).all() and (error == want[1]).all()
    assert balls.compared < 0.05 * x.shape[0] * 64
    # from any earlier code the result is the same, ties included
    grid = draw.integers(-3, 4, (500, 2))
    book = draw.integers(-3, 4, (40, 2))
    want = vector_codes.nearest(grid, book)
    code, error = vector_codes.Balls(book).reassign(grid, draw.integers(0, 40, 500))
    assert (code == want[0]).all() and (error == want[1]).all()


# --- 13: tokenizer alignment

ALIGNED = "doc_id long, text string, run long, radix int, head binary, `a.b` map<int,int>"


def aligned(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, None, None) for i, t in rows], ALIGNED)


def brute_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a_side = Tokenizer.from_file(tokenizer_path())
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    letters = byte_letters()

    def a_bytes(i):
        return bytes(letters[c] for c in a_side.id_to_token(i))

    def b_bytes(i):
        p = b_side.id_to_piece(i)
        return bytes([int(p[3:-1], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode()

    docs, holders = [], defaultdict(set)
    for n, (_, t) in enumerate(rows):
        a = a_side.encode(" " + t, add_special_tokens=False).ids if t else []
        b = b_side.encode(t) if t else []
        left, right = [a_bytes(i) for i in a], [b_bytes(i) for i in b]
        if not t or b"".join(left) != (" " + t).encode() or b"".join(right) != (" " + t).encode():
            docs.append(([], [], [], ""))
            continue
        ends = [np.cumsum([len(x) for x in side]).tolist() for side in (left, right)]
        links, j = [], 0
        for i, e in enumerate(ends[0]):
            start = e - len(left[i])
            while ends[1][j] <= start:
                j += 1
            k = j
            while k < len(b) and ends[1][k] - len(right[k]) < e:
                links.append((a[i], b[k]))
                k += 1
        both, groups, start = sorted(set(ends[0]) & set(ends[1])), [], 0
        for e in both:
            groups.append("|".join(",".join(map(str, ids[bisect_right(at, start):bisect_right(at, e)]))
                                   for ids, at in zip((a, b), ends)))
            start = e
        docs.append((a, b, links, ";".join(groups)))
        for pair in links:
            holders[pair].add(n)
    best = defaultdict(int)
    for (x, _), who in holders.items():
        best[x] = max(best[x], len(who))
    return sorted(((i, len(a), len(b), g.count(";") + bool(g), len(links),
                    sum(len(holders[p]) == best[p[0]] for p in links), sum(len(holders[p]) for p in links),
                    hashlib.sha256(g.encode()).hexdigest() if g else "")
                   for (i, _), (a, b, links, g) in zip(rows, docs)), key=repr)


SPELLED = [None, "", " ", "  ", "\n", "a", "Hello world", "two  spaces and  more ", "\nline\n\nbreaks \n x\n", "tab\tand\xa0nbsp　x",
           "<|endoftext|> and <s> </s> <unk>", "under▁line", "Ünïcode ÀÉ 日本語 🙂🙂 é", "don't we'll 12345 67.8", "x\x1cy \x85 z",
           "a" * 300, "<0x41> ​ zero", "ﬁne", "trailing ", "\r\nwindows\r\n", "ragged \t \n mixed \n\t blanks", LONG[:40_000]]


def test_alignment(spark, monkeypatch):
    monkeypatch.setattr(alignment, "MERGE_RUNS", 2)
    monkeypatch.setattr(alignment, "STREAM_RUNS", 3)
    rows = list(enumerate(SPELLED)) + [(None, "Hello world again"), (6, "Hello world"), (6, "Hello there")]
    rows += [(100 + i, "the cat sat on the mat") for i in range(300)]
    made = aligned(spark, rows).repartition(7)
    assert rows_of(alignment.align(made, tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))) == brute_alignment(rows)


def test_alignment_of_documents(spark, sf):
    docs = table(spark, sf, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = queries.QUERIES["op13_alignment"](spark, sf)
    assert rows_of(got) == brute_alignment(rows)


def test_alignment_of_nothing(spark):
    paths = tokenizer_path(), tokenizer_path("piece_bpe_32k.model")
    assert rows_of(alignment.align(aligned(spark, []), *paths)) == []
    assert rows_of(alignment.align(aligned(spark, [(1, None), (2, "")]), *paths)) == [
        (1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_runs_are_spilled_and_merged():
    """Runs of any cut give the counts of all records."""
    draw = random.Random(2)
    docs = [[(draw.randrange(9) << 32 | draw.randrange(4)) for _ in range(draw.randrange(1, 30))] for _ in range(90)]
    want = Counter(p for d in docs for p in set(d))
    heads = defaultdict(list)
    for start in range(0, 90, 13):
        run = alignment.Run()
        for d in docs[start:start + 13]:
            run.add(1, [(b"1|1", np.array(d, np.uint64).tobytes(), np.zeros(2, np.int64).tobytes())])
        for _, radix, head, body in run.spill(start):
            if radix >= 0:
                heads[radix].append(tuple(alignment.unsqueeze(head, np.uint64, np.int64)))
                holders, times = alignment.unsqueeze(body, np.uint32, np.uint32)
                assert heads[radix][-1][1].sum() == len(holders) == len(times)
    got, largest = {}, {}
    for radix, some in heads.items():
        pairs, counts, best = alignment.merge(some)
        assert (np.diff(pairs.astype(np.int64)) > 0).all() and (pairs >> np.uint64(32) == radix).all()
        got |= dict(zip(pairs.tolist(), counts.tolist()))
        largest |= dict(zip(pairs.tolist(), best.tolist()))
    assert got == want
    assert all(largest[p] == (n == max(m for q, m in want.items() if q >> 32 == p >> 32)) for p, n in want.items())
