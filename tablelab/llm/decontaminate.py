"""Benchmark decontamination by a distributed positional inverted index.

Windows of benchmark words are looked up in postings of the training documents: ``term -> document,
positions``. A window starts from its rarest term: the term's positions, moved back by its offset in the
window, are the candidate starts. These are intersected with the moved positions of the second rarest
term, and what is left with those of all others. Postings are stored for the benchmark's terms around the
rarest terms; elsewhere no window can stand.

Near matches miss a term or have a word put in or left out. They start from as many of the rarest terms as it takes for
one of them to be there, whichever are missing; a term that no document has counts as missing.

The benchmark is taken in blocks of a fixed number of windows, so what a scan holds has a fixed bound.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablelab.llm.common import arrow_map, numbered, text_mark, texts
from tablelab.session import broadcast_small, materialize

WORDS = 13
# Windows looked up in one pass over the documents.
BLOCK_WINDOWS = 100_000
# A document is contaminated if at least one word in this many is hit.
MIN_SHARE = 20
# A window stands nearly where this many of its terms do, each at most SLOP words off its place.
NEAR_WORDS = 12
SLOP = 1
# A-Z to a-z; all other ASCII characters but digits and letters separate words
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def windows(benchmark: DataFrame, size: int = WORDS) -> DataFrame:
    """``(window, item_id, terms)``: each ``size`` consecutive words of an item; a shorter item that has
    words is one window. ``window`` is the same for equal words in any item."""

    def per_task():
        def step(batch):
            ids, terms = [], []
            for item, text in zip(batch.column("item_id").to_pylist(), texts(batch)):
                words = [w.decode() for w in words_of(text)]
                for i in range(max(1, len(words) - size + 1) if words else 0):
                    ids.append(item)
                    terms.append(words[i:i + size])
            return {"item_id": ids, "terms": terms} if ids else None

        return step

    cut = arrow_map(benchmark.select(F.col("item_id").cast("long"), "text"), per_task,
                    "item_id long, terms array<string>").distinct()
    return cut.withColumn("window", F.md5(F.concat_ws(" ", F.col("terms"))))


def document_terms(documents: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Per document ``(doc_id, mark, n_words)``, and per task ``(term, n)``: how often each term of the
    vocabulary occurs. Rows of the second kind have a term."""
    known = documents.sparkSession.sparkContext.broadcast(vocabulary)
    schema = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("n_words", pa.int64()),
                        ("term", pa.int32()), ("n", pa.int64())])

    def run(batches):
        get, unknown = known.value.get, len(known.value)
        counts = np.zeros(unknown + 1, np.int64)
        for whole in batches:
            for begin in range(0, whole.num_rows, 1000):
                batch = whole.slice(begin, 1000)
                marks, n = [], []
                for text in texts(batch):
                    words = words_of(text)
                    marks.append(xxhash.xxh64_intdigest(text, 42))
                    n.append(len(words))
                    counts += np.bincount([get(w, unknown) for w in words], minlength=unknown + 1)
                none = pa.nulls(len(n))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(np.array(marks, np.uint64).view(np.int64)), pa.array(n, pa.int64()),
                     none.cast(pa.int32()), none.cast(pa.int64())], schema=schema)
        at = np.flatnonzero(counts[:unknown])
        none = pa.nulls(len(at)).cast(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [none, none, none, pa.array(at, pa.int32()), pa.array(counts[at])], schema=schema)

    return documents.select("doc_id", "text").mapInArrow(
        run, "doc_id long, mark long, n_words long, term int, n long")


def postings(documents: DataFrame, vocabulary: dict[bytes, int], rarest: np.ndarray, reach: int = WORDS) -> DataFrame:
    """``(term, doc_id, mark, positions)`` of the vocabulary's terms, where a term of ``rarest`` stands
    fewer than ``reach`` words away."""
    sent = documents.sparkSession.sparkContext.broadcast((vocabulary, rarest))

    def per_task():
        known, rare = sent.value
        get, unknown = known.get, len(known)
        is_rare = np.zeros(unknown + 1, bool)
        is_rare[rare] = True

        def step(batch):
            out: dict = {x: [] for x in ("term", "doc_id", "mark", "positions")}
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts(batch)):
                words = words_of(text)
                ids = np.fromiter((get(w, unknown) for w in words), np.int64, len(words))
                seeds = np.flatnonzero(is_rare[ids])
                if not len(seeds):
                    continue
                near = np.zeros(len(ids) + 1, np.int64)
                np.add.at(near, np.maximum(seeds - reach + 1, 0), 1)
                np.add.at(near, np.minimum(seeds + reach, len(ids)), -1)
                at = np.flatnonzero((np.cumsum(near[:-1]) > 0) & (ids < unknown))
                at = at[np.argsort(ids[at], kind="stable")]
                terms, first = np.unique(ids[at], return_index=True)
                mark = int(np.uint64(xxhash.xxh64_intdigest(text, 42)).astype(np.int64))
                out["term"] += terms.tolist()
                out["doc_id"] += [doc] * len(terms)
                out["mark"] += [mark] * len(terms)
                out["positions"] += np.split(at, first[1:])
            return out if out["term"] else None

        return step

    return arrow_map(documents.select("doc_id", "text"), per_task,
                     "term int, doc_id long, mark long, positions array<int>")


def ranked_terms(block: DataFrame, frequencies: DataFrame) -> DataFrame:
    """``(window, size, place, term, n, least_n, rank)``: a window's terms by place, rank 1 the rarest; ``n`` is how
    often the documents have the term, ``least_n`` the same of the window's rarest."""
    each = block.select("window", F.size("terms").alias("size"), F.posexplode("terms").alias("place", "word"))
    window = Window.partitionBy("window")
    return each.join(frequencies, "word").select(
        "window", "size", "place", "term", "n", F.min("n").over(window).alias("least_n"),
        F.row_number().over(window.orderBy("n", "term", "place")).alias("rank"))


def exact_matches(index: DataFrame, terms: DataFrame) -> DataFrame:
    """``(doc_id, mark, window, start, size)`` of every occurrence of every window."""
    terms = terms.filter("least_n > 0")  # a window with a term that no document has can't occur
    at = index.select("term", "doc_id", "mark", F.explode("positions").alias("position"))
    starts = _candidates(at, terms, 1).distinct()  # repeated rows have the same postings
    second = _candidates(at, terms, 2)
    same = ["doc_id", "mark", "window", "start"]
    # NULL ids are documents too, so the intersection is null-safe
    key = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in same]
    both = starts.filter("size > 1").alias("a").join(second.alias("b"), key("a", "b"), "left_semi")
    short = starts.filter("size = 1")
    rest = terms.filter("rank > 2").select(F.col("window").alias("w_"), F.col("term").alias("term_"), "place")
    wanted = both.join(rest, F.col("window") == F.col("w_")).withColumn("position_", F.col("start") + F.col("place"))
    met = wanted.alias("x").join(
        at.alias("y"),
        F.col("x.doc_id").eqNullSafe(F.col("y.doc_id")) & (F.col("x.mark") == F.col("y.mark"))
        & (F.col("x.term_") == F.col("y.term")) & (F.col("x.position_") == F.col("y.position")), "left_semi")
    columns = [*same, "size"]
    long = met.groupBy(*columns).agg(F.count("*").alias("n")).filter("n = size - 2").select(*columns)
    return long.unionByName(both.filter("size = 2").select(*columns)).unionByName(short.select(*columns))


def proximity_matches(index: DataFrame, terms: DataFrame, least: int, slop: int = 0) -> DataFrame:
    """Places where at least ``least`` of a window's terms stand, each at most ``slop`` words from where the window has
    it: ``(doc_id, mark, window, start, size, matched, in_place)``, the last one those without any shift.

    ``start`` puts one of the ``size - least + 1`` rarest terms exactly at its place: if ``least`` terms are there, one of
    those is. It is below 0 where the document begins inside the window. The index has to hold all terms
    within ``size - 1 + slop`` words of these (``search(..., least=, slop=)``). Windows of fewer than ``least`` terms
    don't match. With ``slop`` one word may stand for two equal terms of a window.
    """
    at = index.select("term", "doc_id", "mark", F.explode("positions").alias("position"))
    present = terms.filter((F.col("n") > 0) & (F.col("size") >= least)).select(
        "window", "size", "place", "rank", F.col("term").alias("term_"))
    spare = F.col("size") - least
    # two of the size - least + 2 rarest terms are there, near to one another as the window has them
    early = at.join(present.filter(F.col("rank") <= spare + 2), F.col("term") == F.col("term_")).select(
        "doc_id", "mark", "window", "size", (F.col("position") - F.col("place")).alias("start"), "rank").distinct()
    about = Window.partitionBy("doc_id", "mark", "window").orderBy("start").rangeBetween(-slop, slop)
    starts = materialize(
        early.withColumn("low", F.min("rank").over(about)).withColumn("high", F.max("rank").over(about))
        .filter((F.col("rank") <= spare + 1) & ((F.col("low") < F.col("high")) | F.lit(least <= 1)))
        .select("doc_id", "mark", "window", "size", "start").distinct(), "starts")
    at = _within(index, starts)
    rest = present.select(F.col("window").alias("w_"), "term_", "place")
    wanted = starts.join(rest, F.col("window") == F.col("w_")).withColumn(
        "position_", F.explode(F.transform(F.sequence(F.lit(-slop), F.lit(slop)), lambda d: d + F.col("start") + F.col("place"))))
    met = wanted.alias("x").join(
        at.alias("y"),
        F.col("x.doc_id").eqNullSafe(F.col("y.doc_id")) & (F.col("x.mark") == F.col("y.mark"))
        & (F.col("x.term_") == F.col("y.term")) & (F.col("x.position_") == F.col("y.position")), "left_semi")
    columns = ["doc_id", "mark", "window", "start", "size"]
    straight = (F.col("position_") == F.col("start") + F.col("place")).cast("int")
    each = met.groupBy(*columns, "place").agg(F.max(straight).alias("straight"))
    return each.groupBy(*columns).agg(F.count("*").alias("matched"), F.sum("straight").alias("in_place")).filter(
        F.col("matched") >= least)


def _within(index: DataFrame, starts: DataFrame) -> DataFrame:
    """Exploded postings of the documents that hold one of ``starts`` (a written table); their ids are
    broadcast where a count allows it."""
    holders = starts.select(F.col("doc_id").alias("h_id"), F.col("mark").alias("h_mark")).distinct()
    held = index.join(broadcast_small(holders, holders.count()),
                      F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("mark") == F.col("h_mark")), "left_semi")
    return held.select("term", "doc_id", "mark", F.explode("positions").alias("position"))


def _candidates(at: DataFrame, terms: DataFrame, rank: int) -> DataFrame:
    """Starts of windows that the positions of their term of this rank allow."""
    ranked = terms.filter(F.col("rank") == rank).select(
        "window", "size", "place", F.col("term").alias("term_"))
    return at.join(ranked, F.col("term") == F.col("term_")).withColumn(
        "start", F.col("position") - F.col("place")).filter("start >= 0").select(
        "doc_id", "mark", "window", "size", "start")


def search(documents: DataFrame, benchmark: DataFrame, size: int = WORDS, find=exact_matches, most: int = BLOCK_WINDOWS,
           least: int | None = None, slop: int = 0) -> tuple[DataFrame, DataFrame]:
    """Per document ``(doc_id, mark, n_words)``, and the matches that ``find(index, terms)`` gives, once per item
    that has the window.

    The index holds the terms around each window's rarest one; with ``least`` around as many of the rarest as
    ``proximity_matches`` starts from.
    """
    cut = materialize(windows(benchmark, size), "windows")
    # numbers are shorter than digests; they are written, so they stay the same
    lists = materialize(cut.groupBy("window").agg(F.first("terms").alias("terms")).withColumn(
        "number", F.monotonically_increasing_id()), "lists")
    blocks = max(1, -(-lists.count() // most))
    items = cut.join(lists.select("window", "number"), "window").select(F.col("number").alias("of_window"), "item_id")
    sizes, found = None, None
    for k in range(blocks):
        block = lists.filter(F.pmod(F.xxhash64("window"), F.lit(blocks)) == k).select(F.col("number").alias("window"), "terms")
        words = sorted(r[0] for r in block.select(F.explode("terms")).distinct().collect())
        vocabulary = {w.encode(): i for i, w in enumerate(words)}
        counted = materialize(document_terms(documents, vocabulary), "counts")
        frequencies = counted.filter("term is not null").groupBy("term").agg(F.sum("n").alias("n"))
        numbered_words = documents.sparkSession.createDataFrame(list(enumerate(words)), "term int, word string")
        frequencies = numbered_words.join(frequencies, "term", "left").select(
            "term", "word", F.coalesce("n", F.lit(0)).alias("n"))
        terms = materialize(ranked_terms(block, frequencies), "terms")
        seeds = (F.col("least_n") > 0) & (F.col("rank") == 1)
        if least is not None:
            seeds = seeds | (F.col("n") > 0) & (F.col("size") >= least) & (F.col("rank") <= F.col("size") - least + 1)
        rarest = np.array([r[0] for r in terms.filter(seeds).select("term").distinct().collect()], np.int64)
        index = materialize(postings(documents, vocabulary, rarest, size + slop), "postings")
        matches = materialize(find(index, terms), "matches")
        found = matches if found is None else found.unionByName(matches)
        sizes = sizes or counted.filter("term is null").select("doc_id", "mark", "n_words")
    return sizes, found.join(items, F.col("window") == F.col("of_window")).drop("of_window")


def exact_and_near(index: DataFrame, terms: DataFrame, least: int = NEAR_WORDS, slop: int = SLOP) -> DataFrame:
    """``(doc_id, mark, window, start, size, near)``: places where a window stands, ``near`` if not word for word.

    Where a window of at least ``least`` terms stands exactly, all its terms are in place, so one search gives
    both; shorter windows have exact matches only.
    """
    long = proximity_matches(index, terms, least, slop).select(
        "doc_id", "mark", "window", "start", "size", (F.col("in_place") < F.col("size")).alias("near"))
    short = terms.filter(F.col("size") < least)
    # at most the words of one block of windows
    of_short = index.join(F.broadcast(short.select(F.col("term").alias("s_")).distinct()), F.col("term") == F.col("s_"), "left_semi")
    return long.unionByName(exact_matches(of_short, short).withColumn("near", F.lit(False)))


def contamination(documents: DataFrame, benchmark: DataFrame, size: int = WORDS, share: int = MIN_SHARE) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``.

    A word is hit inside any occurrence of a window of the benchmark. A null or empty text has no words
    and is clean. Texts of one ``doc_id`` are judged each on its own. An item without an id hits words
    but is not listed.
    """
    return judged(documents, benchmark, size, share).drop("mark")


def contamination_and_near(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``contamination`` and, by ``proximity_matches`` of ``NEAR_WORDS`` and ``SLOP``, ``n_near_items``: items that stand
    in the document nearly, but nowhere exactly, and ``near_items``, these ``item_id``, sorted as strings,
    comma-joined. They don't make a document contaminated."""
    sizes, found = search(documents, benchmark, find=exact_and_near, least=NEAR_WORDS, slop=SLOP)
    found = materialize(found, "found")
    of_item = found.filter("item_id is not null").groupBy("doc_id", "mark", "item_id").agg(F.min("near").alias("near"))
    near = of_item.filter("near").groupBy(F.col("doc_id").alias("near_id"), F.col("mark").alias("near_mark")).agg(
        F.array_sort(F.collect_list(F.col("item_id").cast("string"))).alias("items"))
    exact = _judged(sizes, found.filter("not near"), MIN_SHARE)
    same = F.col("doc_id").eqNullSafe(F.col("near_id")) & (F.col("mark") == F.col("near_mark"))
    return exact.join(near, same, "left").select(
        *[c for c in exact.columns if c != "mark"],
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_near_items"),
        F.coalesce(F.array_join("items", ","), F.lit("")).alias("near_items"))


def judged(documents: DataFrame, benchmark: DataFrame, size: int = WORDS, share: int = MIN_SHARE) -> DataFrame:
    """``contamination`` with the ``mark`` of each text."""
    return _judged(*search(documents, benchmark, size), share)


def _judged(sizes: DataFrame, found: DataFrame, share: int) -> DataFrame:
    places = Window.partitionBy("doc_id", "mark").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    covered = (
        found.groupBy("doc_id", "mark", "start").agg(F.max(F.col("start") + F.col("size")).alias("end"))
        .withColumn("before", F.coalesce(F.max("end").over(places), F.lit(0)))
        .groupBy("doc_id", "mark").agg(
            F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "before"))).alias("n_hit")))
    items = found.groupBy("doc_id", "mark").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    hits = covered.alias("c").join(
        items.alias("i"), F.col("c.doc_id").eqNullSafe(F.col("i.doc_id")) & (F.col("c.mark") == F.col("i.mark")))
    hits = hits.select(F.col("c.doc_id").alias("id_"), F.col("c.mark").alias("mark_"), "n_hit", "items")
    n_hit, items = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("items", F.array().cast("array<string>"))
    return sizes.join(hits, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("mark") == F.col("mark_")), "left").select(
        "doc_id", "mark", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(items), ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"))


def without_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated; all columns stay as they are. Texts of one id are judged each
    on its own."""
    bad = judged(documents, benchmark).filter("contaminated").select(
        F.col("doc_id").alias("bad_id_"), F.col("mark").alias("bad_mark_")).distinct()
    inside, names = numbered(documents)
    clean = inside.join(
        bad, F.col(names["doc_id"]).eqNullSafe(F.col("bad_id_")) & (text_mark(names["text"]) == F.col("bad_mark_")), "left_anti")
    return clean.toDF(*documents.columns)
