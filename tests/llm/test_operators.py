"""The operators against brute-force versions on the smallest tables and on edge cases."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tablelab.llm import (
    common, decontaminate, line_dedup, packing, quality_llr, quotes, simhash, substring_dedup, toxicity, warc, weak_quality,
)
from tablelab.llm.queries import table, tokenizer_path
from tablelab.session import scratch_path

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, node long, id long, kept boolean"
LONG = " ".join(f"w{i % 997}x{i // 997}" for i in range(30_000))
PASSAGE = " ".join(f"shared{i}" for i in range(60))
BLANK = ["a b c", "x\x1cy z", "tab\tsep\x0bvt\x0cff\rcr"]
EDGE = (
    [(i, t) for i, t in enumerate([
        None, "", " \n\t ", "one", "one", "two words", "Ünïcode ÀÉ test", LONG, LONG + " end", LONG[10:],
        PASSAGE, "before " + PASSAGE + " after", PASSAGE + " " + PASSAGE, "x " * 80, "A line of some length here.\n" * 5,
        "A line of some length here!\nAnother line, quite different from it.", "special <|endoftext|>  double  spaces \n\n x ",
        *BLANK])]
    + [(4, "one"), (12, PASSAGE + " " + PASSAGE), (None, PASSAGE), (-7, "negative " + PASSAGE)]
)


def documents(spark, rows):
    return spark.createDataFrame([(i, t, None, None, 0, 1, 2, False) for i, t in rows], DOCUMENTS)


@pytest.fixture(scope="module")
def edge(spark):
    return documents(spark, EDGE).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return documents(spark, [])


@pytest.fixture(scope="module")
def docs(spark, sf):
    return table(spark, sf, "documents")


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def union_find(n, links):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


# --- 1, 6, 10: scorers

def test_toxicity_on_the_held_out_fold(spark, edge, empty):
    insult = [f"words {i} and {'vile trash' if i % 4 == 0 else 'kind people'} number {i * 7 % 13}" for i in range(600)]
    d = documents(spark, list(enumerate(insult)))
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(600)] + [(5, 1, None), (4, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    out = toxicity.toxicity(d, labels).collect()
    assert len(out) == 600
    for r in out:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert r["predicted"] == int(r["doc_id"] % 4 == 0) == int(r["score"] >= 0.5)
    assert toxicity.toxicity(empty, labels).count() == 0
    scored = toxicity.toxicity(edge, labels.limit(0)).collect()
    assert len(scored) == len(EDGE) and all(r["score"] == 0.5 for r in scored)


def test_labels_of_the_held_out_fold_are_not_learnt(spark, docs):
    ids = spark.range(200).select(F.col("id").alias("doc_id"))
    labels = ids.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert rows_of(toxicity.toxicity(docs, labels)) == rows_of(toxicity.toxicity(docs, turned))


def test_rare_toxic_terms_are_learnt(spark):
    rows = [(i, f"words {i} and {'grotmuck' if i % 100 == 0 else 'kind people'} number {i * 7 % 13}") for i in range(800)]
    d = documents(spark, rows).select("doc_id", "text").withColumn("label", (F.col("doc_id") % 100 == 0).cast("int"))
    weights = toxicity.fit(d)
    model, hashes = toxicity.Ftrl(np.zeros(len(weights)), np.zeros(len(weights))), common.WordHashes()
    order = [r[0] for r in d.orderBy(F.xxhash64("doc_id", F.lit(11))).select("doc_id").collect()]
    at = {i: np.append(np.unique(toxicity.feature_ids(t.encode(), hashes, toxicity.BITS)), len(weights) - 1) for i, t in rows}
    for _ in range(4):
        for i in order:
            model.learn(at[i], float(i % 100 == 0))
    assert np.allclose(model.weights(slice(None)), weights)
    assert np.array_equal(toxicity.unpacked(toxicity.packed(at[5])), at[5])
    word = common.hashed_grams(hashes.array(["grotmuck"]), toxicity.BITS)
    assert weights[word] > 0
    scored = {r["doc_id"]: r["predicted"] for r in toxicity.score(d, weights, ["doc_id"]).collect()}
    assert all(scored[i] == int(i % 100 == 0) for i in range(800))


def test_samples_are_not_cut():
    assert toxicity.MAX_TRAINING >= 60_000 and weak_quality.MAX_TRAINING >= 30_000


def brute_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    spots = defaultdict(list)
    for i in range(len(words) - 4):
        spots[tuple(words[i:i + 5])].append(i)
    hit = {i + k for s in spots.values() if len(s) > 1 for i in s for k in range(5)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit))


def test_base_rules(spark, sf, docs, edge, empty):
    labels = table(spark, sf, "labels")
    for d in (docs, edge):
        got = quality_llr.quality_rules(d, labels, ["doc_id", "text"]).collect()
        assert len(got) == d.count()
        for r in got:
            base = brute_base(r["text"])
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == base
            failed = base[0] < 10 or 100 * base[4] > 20 * base[0]
            assert r["base_failed"] == failed and r["kept"] == (not failed and r["llr"] >= quality_llr.MIN_SCORE)
    assert quality_llr.quality_rules(empty, labels).count() == 0
    kept = quality_llr.keep_good(edge, labels)
    assert kept.columns == edge.columns


def test_ratio_is_the_one_of_the_counts(spark):
    d = documents(spark, [(1, "a b"), (2, "a c"), (3, None)])
    trusted = spark.createDataFrame([(1,)], "trusted_id long")
    got = quality_llr.log_ratios(d, trusted, bits=8)
    good, raw = np.zeros(256), np.zeros(256)
    h = common.WordHashes()
    for text, g in (("a b", 1), ("a c", 0)):
        for k in common.hashed_grams(h.array(text.split()), 8):
            raw[k] += 1
            good[k] += g
    p = quality_llr.PRIOR
    want = np.log((1 - p) * good / good.sum() + p / 256) - np.log((1 - p) * raw / raw.sum() + p / 256)
    assert np.allclose(got, want, atol=1e-5)


def test_verdict_does_not_depend_on_the_size(spark, sf, docs):
    labels = table(spark, sf, "labels")
    once = {(r["doc_id"], r["kept"], round(r["llr"], 5)) for r in quality_llr.quality_rules(docs, labels).collect()}
    n = docs.agg(F.max("doc_id")).first()[0] + 1
    copies = lambda df: df.crossJoin(spark.range(3)).withColumn("doc_id", F.col("doc_id") + n * F.col("id")).drop("id")
    many = quality_llr.quality_rules(copies(docs), copies(labels)).collect()
    assert len(many) == 3 * docs.count()
    assert {(r["doc_id"] % n, r["kept"], round(r["llr"], 5)) for r in many} == once


CLASHING = ["gone_", "gone_id_", "gone_mark_", "keep_id_", "keep_mark_", "n_", "bad_id_", "bad_mark_", "text_", "kept", "llr",
            "mark", "fp", "row", "c0_", "c1_", "id", "node", "component", "trusted_id", "good", "with.dot", "with`tick", "n_words"]


def test_columns_of_any_name_and_type(spark):
    texts_ = [PASSAGE, PASSAGE, f"{PASSAGE}\nThis line is the second one.", None, "", "Some other text, not at all like that."]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts_)] + [(0, PASSAGE), (None, "without an id")], "doc_id long, text string")
    extra = [F.lit(i).alias(c) for i, c in enumerate(CLASHING)]
    d = rows.select("text", *extra, F.create_map(F.lit("a"), F.col("doc_id")).alias("a map"), "doc_id")
    labels = spark.createDataFrame([(0, 1, 0), (5, 0, 0)], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([(1, "the second one")], "item_id long, text string")
    plain = rows.select("doc_id", "text")
    for stage in (lambda x: quality_llr.keep_good(x, labels), simhash.one_per_component,
                  lambda x: line_dedup.dedup_lines(x).drop("n_lines_removed"),
                  lambda x: decontaminate.without_contaminated(x, benchmark)):
        out = stage(d)
        assert out.columns == d.columns
        got = out.collect()
        assert sorted(((r["doc_id"], r["text"]) for r in got), key=repr) == sorted(pairs(stage(plain)), key=repr)
        for r in got:
            assert [r[c] for c in CLASHING] == list(range(len(CLASHING))) and r["a map"] == {"a": r["doc_id"]}


def test_weak_labels(spark, edge, empty):
    good = [f"This is sentence {i} of a text.\nIt has words and an end {i * 31 % 17}." for i in range(300)]
    junk = [f"ab{i}### cd*** ef$$$ gh%%%\nij&&& kl### {i}*** mn$$$" for i in range(60)]
    out = {r["doc_id"]: r for r in weak_quality.weak_quality(documents(spark, list(enumerate(good + junk)))).collect()}
    assert all(out[i]["kept"] and out[i]["weak_label"] > 0.9 for i in range(300))
    assert not any(out[i]["kept"] or out[i]["weak_label"] > 0.1 for i in range(300, 360))
    assert weak_quality.weak_quality(edge).count() == len(EDGE)
    assert weak_quality.weak_quality(empty).count() == 0


def test_accuracies_follow_agreement():
    rng = np.random.default_rng(3)
    truth = rng.random(20_000) < 0.8
    right = np.array([0.95, 0.9, 0.7] + [0.9] * (len(weak_quality.LABELLERS) - 3))
    vote = np.where(rng.random((20_000, len(right))) < right, truth[:, None], ~truth[:, None])
    ballots = np.where(vote, weak_quality.GOOD, weak_quality.BAD)
    patterns, counts = np.unique([weak_quality.pattern_of(b) for b in ballots.tolist()], return_counts=True)
    _, found = weak_quality.posteriors(patterns, counts.astype(float))
    assert np.abs(found - right).max() < 0.03


# --- 2: WARC

def test_warc_round_trip(spark, sf):
    pages = spark.createDataFrame(
        [(5, "http://a/ b", "same"), (3, "http://c", "same"), (9, None, "same"), (1, "u", None), (2, "u", ""),
         (7, "u", "ä" * 100_000), (4, "u", "x\r\n\r\ny"), (4, "u", "x\r\n\r\ny"), (None, "u", "same"), (None, "u", "alone")],
        "page_id long, url string, html string")
    got = rows_of(warc.page_round_trip(pages))
    want, digest = [], lambda h: warc.base32_sha1_of((h or "").encode())
    first = {"same": 3, "": 1, "ä" * 100_000: 7, "x\r\n\r\ny": 4}
    for r in pages.collect():
        html = r["html"] or ""
        ref = first.get(html)
        again = ref is not None and r["page_id"] != ref
        want.append((r["page_id"], len(html.encode()), digest(html), "revisit" if again else "response", ref if again else None))
    assert got == sorted(want, key=repr)
    assert warc.page_round_trip(pages.limit(0)).count() == 0
    large = {r["page_id"]: r["record_type"] for r in warc.page_round_trip(pages.filter("page_id is not null"), 5).collect()}
    assert large[5] == large[9] == "response" and large[4] == "response"


def test_warc_pushdown_and_pruning(spark, sf):
    path = scratch_path(spark, "warc-test")
    pages = table(spark, sf, "pages")
    warc.write_pages(pages.unionByName(pages.withColumn("page_id", F.col("page_id") + 1000)), path)
    short = warc.read_warc(spark, path, "record_type string, record_id string")
    revisits = short.filter("record_type = 'revisit'")
    assert revisits.count() >= pages.count()
    assert "PushedFilters" in revisits._jdf.queryExecution().toString() or "revisit" in revisits._jdf.queryExecution().toString()
    one = warc.read_warc(spark, path).filter("record_id = '<urn:page:3>'").collect()
    assert len(one) == 1 and one[0]["record_type"] in ("response", "revisit")


def test_foreign_archives(tmp_path):
    import gzip

    rows = [{"record_type": "response", "record_id": f"<urn:page:{i}>", "payload_digest": "sha1:X", "target_uri": None,
             "refers_to": None, "payload_bytes": 3, "payload": b"abc"} for i in range(3)]
    plain = b"".join(map(warc.record, rows))
    for data in (plain, b"".join(gzip.compress(warc.record(r)) for r in rows), b"".join(warc.member(warc.record(r)) for r in rows)):
        (tmp_path / "x").write_bytes(data)
        with open(tmp_path / "x", "rb") as f:
            got = list(warc.read_records(f, lambda h: h["warc-record-id"] != "<urn:page:1>", True))
        assert [(g["record_id"], g["payload"], g["http_length"]) for g in got] == [
            ("<urn:page:0>", b"abc", 3), ("<urn:page:2>", b"abc", 3)]


# --- 3: quotations

def test_reply_order(spark):
    rows = [
        (1, 0, "user", "Hello there.\nHow does it work?"),
        (1, 1, "assistant", "> how does  it WORK?\nLike this."),
        (1, 2, "user", "Another topic."),
        (1, 3, "user", "On Monday, A wrote:\n> Like this.\n>> How does it work?\nThanks."),
        (1, 4, "assistant", "> Nobody said this.\nHm."),
        (1, 5, "assistant", "> Another topic.\n\nYes.\n> Hello there.\nAnd hello."),
        (2, 0, "user", "> Another topic.\nNo."), (2, 1, None, None), (2, 1, None, None), (None, 1, "user", "x"), (3, None, "user", "y"),
    ]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"]): r for r in quotes.reply_order(d).collect()}
    assert quotes.reply_order(d).count() == len(rows)
    assert [(got[1, t]["parent_turn"], got[1, t]["root_turn"], got[1, t]["depth"], got[1, t]["position"]) for t in range(6)] == [
        (None, 0, 0, 0), (0, 0, 1, 1), (None, 2, 0, 3), (1, 0, 2, 2), (None, 4, 0, 5), (2, 2, 1, 4)]
    assert got[1, 3]["body"] == "Thanks." and got[1, 5]["body"] == "Yes.\nAnd hello." and got[2, 0]["body"] == "No."
    assert got[2, 0]["parent_turn"] is None and got[1, 1]["formatted"] == "<|assistant|>\nLike this."
    assert quotes.reply_order(d.limit(0)).count() == 0


# --- 4: packing

def test_packing(spark, docs, edge, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    tokenizer.encode_special_tokens = True
    for d in (docs, edge):
        want = []
        for doc, text in pairs(d):
            ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
            first = len(ids) % 2048 or 2048
            starts = [0, *range(first, len(ids), 2048)]
            for k, s in enumerate(starts):
                piece = ids[s:(starts + [len(ids)])[k + 1]]
                want.append((doc, k, s, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes())))
        got = packing.pack(d, tokenizer_path()).collect()
        assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
        bins = defaultdict(list)
        for r in got:
            bins[r["sequence_id"]].append((r["offset"], r["length"]))
        for b in bins.values():
            at = 0
            for offset, length in sorted(b):
                assert offset == at
                at += length
            assert at <= 2048
        sizes = np.array([w[3] for w in want])
        assert len(bins) <= packing.lower_bound(sizes, 2048) + max(1, len(want) // 100)
    assert packing.pack(empty, tokenizer_path()).count() == 0


def test_added_tokens_in_texts(spark):
    from tokenizers import Tokenizer

    import corpus_pipeline

    tokenizer = Tokenizer.from_file(tokenizer_path())
    ids = packing.TokenIds(tokenizer_path())
    texts = ["a<|endoftext|>b", "special <|endoftext|>  double  spaces \n\n x ", "<|endoftext|><|endoftext|>", "one\n<|endoftext|>\ntwo",
             "<|endoftext|", " <|endoftext|> ", "x <|endoftext|> y z", "<|ENDOFTEXT|>", ""]
    for text in texts:
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids.encode(text), "<u4").tolist() == want, text
        assert (50256 in want) == ("<|endoftext|>" in text)
    d = documents(spark, list(enumerate(texts)))
    got = {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in corpus_pipeline.best_fit_packing(spark, d, "").collect()}
    for i, text in enumerate(texts):
        want = np.array(tokenizer.encode(text, add_special_tokens=False).ids + [0], "<u4")
        assert got[i] == (len(want), zlib.crc32(want.tobytes()))


def test_bounds_hold():
    rng = np.random.default_rng(1)
    for _ in range(30):
        sizes = rng.integers(1, 101, rng.integers(1, 60))
        bins = packing.best_fit_decreasing(sizes, 100)
        assert np.bincount(bins, weights=sizes).max() <= 100
        assert packing.lower_bound(sizes, 100) <= bins.max() + 1
    assert packing.lower_bound(np.full(7, 51), 100) == 7
    assert packing.lower_bound(np.full(6, 34), 100) == 3


def test_groups_with_gaps_exchange(spark):
    # each group alone leaves room that only pieces of another group fill
    rows = spark.range(400).select(F.col("id").alias("row"), F.when(F.col("id") < 200, 60).otherwise(40).cast("long").alias("length"))
    few = packing.pack_lengths(rows, 100, most=20, rounds=1).select("g", "bin").distinct().count()
    more = packing.pack_lengths(rows, 100, most=20, rounds=4)
    assert more.count() == 400 and more.select("g", "bin").distinct().count() < few


# --- 5: line dedup

def brute_lines(rows):
    spots = {}
    for doc, text in rows:
        for number, line in enumerate((text or "").split("\n")):
            line = line_dedup.normalise(line)
            if len(line) >= line_dedup.MIN_CHARS:
                spots[doc, number] = line
    lines = sorted(set(spots.values()))
    sets = [line_dedup.shingles(x) for x in lines]
    links = [(i, j) for i in range(len(lines)) for j in range(i)
             if 0.8 * len(sets[i]) <= len(sets[j]) <= len(sets[i]) / 0.8 and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    group = dict(zip(lines, union_find(len(lines), links)))
    first = {}
    for spot in sorted(spots, key=lambda s: (s[0] is not None, s)):
        first.setdefault(group[spots[spot]], spot)
    kept = set(first.values())
    return {(doc, text): "\n".join(x for k, x in enumerate(text.split("\n")) if (doc, k) not in spots or (doc, k) in kept)
            for doc, text in rows if text is not None}


def test_line_dedup(spark, docs, edge, empty):
    for d in (docs, edge):
        want = brute_lines(pairs(d))
        got = line_dedup.dedup_lines(d)
        assert got.columns == d.columns + ["n_lines_removed"] and got.count() == d.count()
        texts = defaultdict(list)
        for r in got.collect():
            texts[r["doc_id"]].append(r["text"])
        for (doc, _), text in want.items():
            assert text in texts[doc]
    assert line_dedup.dedup_lines(empty).count() == 0


def test_bands_find_similar_lines():
    rng = np.random.default_rng(5)
    found = []
    for _ in range(300):
        line = "".join(rng.choice(list("abcdefghij "), 200))
        at = int(rng.integers(0, 190))
        other = line[:at] + "ZZ" + line[at + 2:]
        keys = line_dedup.band_keys(line_dedup.signatures([line, other]))
        found.append(bool(set(keys[0]) & set(keys[1])))
    assert np.mean(found) > 0.98


def test_short_lines_with_one_edit_are_linked():
    rng = np.random.default_rng(6)
    letters = list("abcdefghijklmnopqrstuvwxyz ")
    missed = tried = 0
    for size in range(30, 81):
        for kind in ("change", "insert", "digits"):
            if kind == "digits" and size < 60:
                continue
            line = line_dedup.normalise("a" + "".join(rng.choice(letters, size - 2)) + "z")
            line += "q" * (size - len(line))
            at = int(rng.integers(3, size - 8))
            if kind == "digits":
                line, other = line[:at] + "2023" + line[at + 4:], line[:at] + "1987" + line[at + 4:]
            else:
                other = line[:at] + "#" + line[at + (kind == "change"):]
            if len(line_dedup.shingles(line, 3)) < size - 3:
                continue
            tried += 1
            keys, places = line_dedup.line_bands([line, other])
            assert set(places.tolist()) == {0, 1}
            met = set(keys[places == 0]) & set(keys[places == 1])
            frame = line_dedup.pd.DataFrame({"g": [1, 1], "id": [1, 2], "line": [line, other]})
            assert len(line_dedup.verified_links(frame)) == 1, (line, other)
            missed += not met
    assert tried > 60 and missed <= 0.02 * tried


def test_lines_on_both_sides_of_the_short_ones():
    line = "the quick brown fox jumps over a lazy dog while 7 pale zebras watch from behind"
    assert len(line) == line_dedup.SHORT_CHARS - 1
    long = line[:40] + "!!" + line[40:]
    for a, b in ((line, long), ("-" * 40, "-" * 300), ("long " * 30 + long, "long " * 30 + line)):
        keys, places = line_dedup.line_bands([a, b])
        assert set(keys[places == 0]) & set(keys[places == 1])
        frame = line_dedup.pd.DataFrame({"g": [1, 1], "id": [1, 2], "line": [a, b]})
        assert len(line_dedup.verified_links(frame)) == 1


def test_short_lines_and_one_typo_in_documents(spark):
    menu = "Home | Products | About us | Contact"
    rows = [(1, menu + "\nMenu\n\nunique text of one"), (2, menu.replace("About", "Abaut") + "\nmenu\n\nother words of two")]
    got = {r["doc_id"]: (r["text"], r["n_lines_removed"]) for r in line_dedup.dedup_lines(documents(spark, rows)).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("\nother words of two", 2)}


# --- 7: decontamination

def brute_contamination(rows, items):
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = defaultdict(set)
    for item, text in items:
        w = fold(text)
        for i in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[i:i + 13])].add(item)
    sizes = {len(w) for w in windows}
    for doc, text in rows:
        w = fold(text)
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i:i + n])]
        joined = ",".join(sorted(map(str, found)))
        yield (doc, len(w), len(hit), len(found), hashlib.sha256(joined.encode()).hexdigest(),
               len(hit) > 0 and 20 * len(hit) >= len(w))


def test_contamination(spark, sf, docs, edge, empty):
    benchmark = table(spark, sf, "benchmark")
    items = [tuple(r) for r in benchmark.select("item_id", "text").collect()]
    more = [(900, "One"), (901, "two WORDS"), (902, None), (903, ""), (904, PASSAGE), (905, "x x x"), (905, "x x x"), (906, "not there")]
    extra = spark.createDataFrame(more, "item_id long, text string")
    for d, b, i in ((docs, benchmark, items), (edge, benchmark.select("item_id", "text").unionByName(extra), items + more)):
        assert rows_of(decontaminate.contamination(d, b)) == sorted(brute_contamination(pairs(d), i), key=repr)
    assert decontaminate.contamination(empty, benchmark).count() == 0
    assert decontaminate.contamination(edge, extra.limit(0)).filter("n_hit = 0").count() == len(EDGE)
    clean = decontaminate.without_contaminated(edge, extra)
    assert clean.columns == edge.columns and 0 < clean.count() < len(EDGE)


def test_benchmark_blocks_and_proximity(spark, sf, docs):
    benchmark = table(spark, sf, "benchmark")
    sizes, whole = decontaminate.search(docs, benchmark)
    _, parts = decontaminate.search(docs, benchmark, most=300)
    assert whole.count() > 0 and rows_of(whole) == rows_of(parts.select(*whole.columns))
    words = [f"term{i}" for i in range(13)]
    d = documents(spark, [(1, " ".join(words)), (2, " ".join([*words[:5], "other", *words[6:]])), (3, "term0 term1")])
    b = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    near = decontaminate.search(d, b, find=lambda i, t: decontaminate.proximity_matches(i, t, 12))[1]
    assert {(r["doc_id"], r["matched"]) for r in near.collect()} >= {(1, 13)}
    assert {r["doc_id"] for r in near.collect()} <= {1, 2}


def brute_near(rows, items):
    """Items that stand nearly in each row, by every window at every place that its 2 rarest terms allow."""
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    n = defaultdict(int)
    for _, t in rows:
        for w in fold(t):
            n[w] += 1
    for doc, text in rows:
        w, near, exact = fold(text), set(), set()
        spots = defaultdict(set)
        for i, x in enumerate(w):
            spots[x].add(i)
        for item, t in items:
            terms = fold(t)
            for k in range(max(1, len(terms) - 12) if terms else 0):
                win = terms[k:k + 13]
                if any(w[i:i + len(win)] == win for i in range(len(w) - len(win) + 1)):
                    exact.add(item)
                order = sorted(range(len(win)), key=lambda p: (n.get(win[p], 0), win[p], p))
                for p in order[:max(0, len(win) - 11)]:
                    for q in spots.get(win[p], ()):
                        if sum(any(q - p + j + d in spots.get(x, ()) for d in (-1, 0, 1)) for j, x in enumerate(win)) >= 12:
                            near.add(item)
        found = sorted(map(str, near - exact))
        yield doc, len(found), ",".join(found)


def test_near_matches(spark, sf, docs):
    words = [f"term{i}" for i in range(13)]
    filler = [f"other{i}" for i in range(20)]
    rows = [(1, words), (2, [*words[:5], "other", *words[6:]]), (3, words[:2]), (4, [*words[:6], "put", "in", *words[6:]]),
            (5, [*filler, *words[:4], "put", *words[4:], *filler]), (6, words[1:]), (7, [*words[:7], *words[8:]]),
            (8, [*words[:5], "one", "two", *words[7:]]), (9, words[::-1]), (5, words[2:]), (None, [*words[:12], "end"]),
            (10, ["same"] * 30), (10, ["same"] * 30)]
    d = documents(spark, [(i, " ".join(w)) for i, w in rows] + [(11, None), (12, "")])
    items = [(1, " ".join(words)), (2, " ".join([*words[:12], "unknown"])), (3, "same " * 12 + "unheard"), (4, "same " * 11), (5, None)]
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {}
    for r in decontaminate.contamination_and_near(d, b).collect():
        got.setdefault(r["doc_id"], []).append(r["near_items"])
    # one term changed, a word put in, the first or one term left out
    assert any("1" in x.split(",") for x in got[5]) and all("1" in got[i][0].split(",") for i in (2, 6, 7, None))
    assert "1" in got[2][0].split(",") and got[1] == ["2"] and got[9] == got[3] == got[8] == got[11] == got[12] == [""]
    benchmark = [tuple(r) for r in table(spark, sf, "benchmark").select("item_id", "text").collect()]
    small = docs.filter("length(text) < 3000")
    for x, y in ((d, items), (small, benchmark)):
        out = decontaminate.contamination_and_near(x, spark.createDataFrame(y, "item_id long, text string"))
        assert rows_of(out.select("doc_id", "n_near_items", "near_items")) == sorted(brute_near(pairs(x), y), key=repr)
        assert rows_of(out.drop("n_near_items", "near_items")) == sorted(brute_contamination(pairs(x), y), key=repr)


# --- 8: SimHash

def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, docs, edge, empty):
    for d in (docs, edge):
        rows = pairs(d)
        marks = [brute_fingerprint(t) for _, t in rows]
        links = [(i, j) for i in range(len(rows)) for j in range(i) if (marks[i] ^ marks[j]).bit_count() <= 3]
        groups = union_find(len(rows), links)
        first = {}
        for g, (doc, _) in zip(groups, rows):
            if doc is not None:
                first[g] = min(doc, first.get(g, doc))
        want = [(doc, f"{m:016x}", first.get(g)) for (doc, _), m, g in zip(rows, marks, groups)]
        assert rows_of(simhash.simhash_components(d)) == sorted(want, key=repr)
    assert simhash.simhash_components(empty).count() == 0
    assert simhash.one_per_component(edge).columns == edge.columns


def test_stages_judge_texts_not_ids(spark):
    one, two, three = (" ".join(f"{x}{i}" for i in range(40)) for x in ("alpha", "beta", "gamma"))
    for shared in (None, 7):
        # copies of one row, two more texts under the same id, a copy under another id
        rows = [(shared, one), (shared, one), (shared, two), (shared, three), (9, two)]
        d = documents(spark, rows)
        kept = pairs(simhash.one_per_component(d))
        assert sorted(t for _, t in kept) == [one, two, three]
        assert ((9 if shared is None else 7), two) in kept
        benchmark = spark.createDataFrame([(1, two)], "item_id long, text string")
        clean = pairs(decontaminate.without_contaminated(d, benchmark))
        assert sorted(clean, key=repr) == sorted([(shared, one), (shared, one), (shared, three)], key=repr)
        lined = documents(spark, [(shared, f"{one}\nunique of the first"), (shared, f"{two}\nunique of the second"),
                                  (shared, f"unique of the third\n{one}")])
        lines = [x for r in line_dedup.dedup_lines(lined).collect() for x in r["text"].split("\n") if x]
        assert sorted(lines) == sorted([one, two, "unique of the first", "unique of the second", "unique of the third"])


def test_bk_links_find_every_pair(spark):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fp = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for _ in range(40)]))
    a, b = simhash.bk_links(np.zeros(len(fp), int), fp)
    want = {(i, j) for i in range(len(fp)) for j in range(len(fp)) if i != j and int(fp[i] ^ fp[j]).bit_count() <= 3}
    assert set(zip(a.tolist(), b.tolist())) == want
    nodes = spark.createDataFrame([(int(x), int(x)) for x in fp.view(np.int64)], "id long, fp long")
    old, common.BLOCK_ROWS = common.BLOCK_ROWS, 16
    found = {r["node"]: r["component"] for r in common.components(simhash.links(nodes)).collect()}
    common.BLOCK_ROWS = old
    groups = union_find(len(fp), want)
    signed = fp.view(np.int64).tolist()
    for i, j in want:
        assert found[signed[i]] == found[signed[j]]
    assert len(set(found.values())) == len({groups[i] for i, _ in want})


def test_large_groups_meet_in_blocks(spark):
    rows = spark.range(100).select(F.lit(1).alias("key"), "id").unionByName(spark.createDataFrame([(2, 7), (3, 8), (3, 9)], "key int, id long"))
    met = defaultdict(set)
    for r in common.bounded_groups(rows, "key", "id", 16).collect():
        met[r["g"]].add(r["id"])
    together = {frozenset((a, b)) for g in met.values() for a in g for b in g if a < b}
    assert together == {frozenset((a, b)) for a in range(100) for b in range(a)} | {frozenset((8, 9))}
    assert max(map(len, met.values())) <= 60


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 103), (103, 101)] + [(200, i) for i in range(201, 260)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {i: 100 for i in (100, 101, 103)} | {i: 200 for i in range(200, 260)}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 9: substring dedup

def brute_repeats(rows):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    for (doc, _), w in zip(rows, words):
        for i in range(len(w) - 49):
            if doc is not None:
                key = tuple(w[i:i + 50])
                first[key] = min(doc, first.get(key, doc))
    for (doc, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - 49):
            lo = first.get(tuple(w[i:i + 50]))
            if doc is not None and lo is not None and lo < doc:
                gone |= set(range(i, i + 50))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        yield doc, len(w), len(gone), kept


def test_substring_dedup(docs, edge, empty):
    for d in (docs, edge):
        got = rows_of(substring_dedup.remove_repeats(d).select("doc_id", "n_words", "n_removed", "kept"))
        assert got == sorted(brute_repeats(pairs(d)), key=repr)
        assert any(r[2] for r in got)
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_spans_are_maximal(spark):
    d = documents(spark, [(1, "a b " + PASSAGE + " c"), (2, "d " + PASSAGE + " e f")])
    r = substring_dedup.remove_repeats(d).filter("doc_id = 2").first()
    assert [tuple(s) for s in r["spans"]] == [(1, 61)] and r["kept"] == "d e f"


# --- pipeline

def test_pipeline(spark, sf, docs):
    import corpus_pipeline

    d, seen = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, sf)
        assert out.columns == docs.columns
        d = out.cache()
        seen.append(d.count())
    assert seen == sorted(seen, reverse=True) and seen[-1] > 0
    last = corpus_pipeline.STAGES[-1][1](spark, d, sf)
    assert {r[0] for r in last.select("doc_id").distinct().collect()} == {r[0] for r in d.select("doc_id").distinct().collect()}
    assert corpus_pipeline.run(spark, sf).count() == last.count()
    spark.catalog.clearCache()
