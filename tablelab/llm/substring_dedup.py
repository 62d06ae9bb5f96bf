"""Substring deduplication: seed and extend over winnowed anchors.

Every window of ``WINDOW`` words has an anchor: the smallest hash of its ``SEED_WORDS``-word grams. Equal
windows have equal anchors, wherever they stand, so documents are joined on anchors alone. Around an
anchor, the run of consecutive windows that share it is the seed's extension to both sides. Equal runs of
one anchor are one class; only the first document of each class is compared further, window by window,
with the other classes of its anchor. What matches in front of it, joined over neighbouring windows, are
the maximal repeats of at least ``WINDOW`` words.

No pairs of documents are formed: classes and windows meet in minima that are combined before each
shuffle, so a passage shared by a third of all documents is no hot key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelab.llm.common import MIX, SECOND, WordHashes, arrow_map, bit_filter, passes, texts
from tablelab.session import materialize

WINDOW = 50
# Words of a gram that may become an anchor.
SEED_WORDS = 10
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


class Rolling:
    """Hashes of word ranges by prefix sums of ``h[i] * base ** i`` (modulo 2 ** 64)."""

    def __init__(self):
        self.powers = self.inverses = np.ones(1, np.uint64)

    def prefix(self, h: np.ndarray) -> np.ndarray:
        if len(self.powers) <= len(h):
            n = 2 * len(h) + 1024
            steps = np.full(n, 1, np.uint64)
            steps[1:] = _BASE
            self.powers = np.multiply.accumulate(steps)
            steps[1:] = _INVERSE
            self.inverses = np.multiply.accumulate(steps)
        return np.append(np.uint64(0), np.cumsum(h * self.powers[:len(h)], dtype=np.uint64))

    def hashes(self, prefix: np.ndarray, start: np.ndarray, length) -> np.ndarray:
        x = (prefix[start + length] - prefix[start]) * self.inverses[start]
        x ^= x >> np.uint64(31)
        x *= MIX
        x ^= x >> np.uint64(29)
        return x * SECOND


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by doubling."""
    reach = 1
    while 2 * reach <= width:
        x = np.minimum(x[:-reach], x[reach:])
        reach *= 2
    return np.minimum(x[:len(x) - (width - reach)], x[width - reach:]) if reach < width else x


def runs(h: np.ndarray, rolling: Rolling, window: int = WINDOW, seed: int = SEED_WORDS):
    """``(anchor, run, first window, windows)`` of the runs of a text with word hashes ``h``, and the
    hash of every window."""
    n = len(h) - window + 1
    if n < 1:
        empty = np.empty(0, np.int64)
        return empty, empty, empty, empty, empty
    prefix = rolling.prefix(h)
    grams = rolling.hashes(prefix, np.arange(len(h) - seed + 1), seed)
    anchor = sliding_min(grams, window - seed + 1)
    first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
    many = np.diff(np.append(first, n))
    run = rolling.hashes(prefix, first, many + window - 1)
    windows = rolling.hashes(prefix, np.arange(n), window)
    return anchor[first].view(np.int64), run.view(np.int64), first, many, windows.view(np.int64)


def run_classes(documents: DataFrame, window: int, seed: int) -> DataFrame:
    """``(anchor, run, first_doc, last_doc, classes)`` of the runs that occur in several documents or
    share their anchor with another run."""

    def per_task():
        hashes, rolling = WordHashes(), Rolling()

        def step(batch):
            parts = []
            ids = batch.column("doc_id").to_pylist()
            for k, text in enumerate(texts(batch)):
                anchor, run, *_ = runs(hashes.array(text.split()), rolling, window, seed)
                if len(anchor):
                    parts.append((anchor, run, [ids[k]] * len(anchor)))
            if not parts:
                return None
            return {"anchor": np.concatenate([p[0] for p in parts]), "run": np.concatenate([p[1] for p in parts]),
                    "doc_id": [d for p in parts for d in p[2]]}

        return step

    found = arrow_map(documents.select("doc_id", "text"), per_task, "anchor long, run long, doc_id long")
    classes = found.groupBy("anchor", "run").agg(
        F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
    several = classes.groupBy(F.col("anchor").alias("anchor_")).agg(
        F.count("*").alias("classes"), F.min("first_doc").alias("a"), F.max("last_doc").alias("b")).filter("a < b")
    return materialize(
        classes.join(several, F.col("anchor") == F.col("anchor_")).select(
            "anchor", "run", "first_doc", "last_doc", "classes"), "classes")


def _mixed(anchor, run):
    return anchor ^ (run >> 7)


def repeats(documents: DataFrame, window: int = WINDOW, seed: int = SEED_WORDS) -> DataFrame:
    """``(doc_id, mark, begin, end)``: word ranges covered by windows that also start in a document with
    a smaller ``doc_id``. Ranges of a document may overlap. ``mark`` tells texts of one id apart."""
    classes = run_classes(documents, window, seed)
    context = documents.sparkSession.sparkContext
    alone = classes.filter("classes = 1").select(
        F.col("anchor").bitwiseXOR(F.shiftright("run", 7)).alias("v"))
    by_run = context.broadcast(bit_filter(alone, "v"))
    by_anchor = context.broadcast(bit_filter(classes.filter("classes > 1"), "anchor"))

    def per_task():
        hashes, rolling = WordHashes(), Rolling()

        def step(batch):
            names = ("doc_id", "mark", "anchor", "run", "start", "n", "windows")
            out: dict = {x: [] for x in names}
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts(batch)):
                anchor, run, first, many, windows = runs(hashes.array(text.split()), rolling, window, seed)
                if not len(anchor):
                    continue
                deep = passes(by_anchor.value, anchor)
                at = np.flatnonzero(deep | passes(by_run.value, _mixed(anchor, run)))
                if not len(at):
                    continue
                mark = np.uint64(xxhash.xxh64_intdigest(text, 42)).astype(np.int64)
                out["doc_id"] += [doc] * len(at)
                out["mark"] += [int(mark)] * len(at)
                for name, values in zip(names[2:6], (anchor, run, first, many)):
                    out[name] += values[at].tolist()
                raw = windows.tobytes()
                out["windows"] += [raw[8 * first[i]:8 * (first[i] + many[i])] if deep[i] else None for i in at]
            if not out["doc_id"]:
                return None
            out["windows"] = _long_lists(out["windows"])
            return out

        return step

    seen = arrow_map(documents.select("doc_id", "text"), per_task,
                     "doc_id long, mark long, anchor long, run long, start int, n int, windows array<long>")
    found = materialize(
        seen.join(classes.select(F.col("anchor").alias("a_"), F.col("run").alias("r_"), "first_doc", "classes"),
                  (F.col("anchor") == F.col("a_")) & (F.col("run") == F.col("r_")))
        .withColumn("whole", F.coalesce(F.col("doc_id") > F.col("first_doc"), F.lit(False)))
        .withColumn("windows", F.when(F.col("whole"), None).otherwise(F.col("windows")))
        .select("doc_id", "mark", "anchor", "start", "n", "classes", "whole", "windows"), "runs")
    whole = found.filter("whole").select(
        "doc_id", "mark", F.col("start").alias("begin"), (F.col("start") + F.col("n") + (window - 1)).alias("end"))
    single = found.filter("not whole and classes > 1 and doc_id is not null").select(
        "doc_id", "mark", "anchor", "start", F.posexplode("windows").alias("k", "w"))
    # written, so that the join below reads two shuffles and Spark can split a hot window
    first = materialize(single.groupBy(F.col("anchor").alias("a_"), F.col("w").alias("w_")).agg(
        F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi"), "windows")
    later = single.join(first, (F.col("anchor") == F.col("a_")) & (F.col("w") == F.col("w_"))).filter("doc_id > lo")
    begin = F.col("start") + F.col("k")
    return whole.unionByName(later.select(
        "doc_id", "mark", begin.alias("begin"), (begin + window).alias("end")))


def _long_lists(raw: list) -> pa.Array:
    """A list array of longs from their bytes; None is null."""
    sizes = np.fromiter((len(r) // 8 if r else 0 for r in raw), np.int64, len(raw))
    offsets = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
    values = pa.array(np.frombuffer(b"".join(r for r in raw if r), np.int64))
    return pa.ListArray.from_arrays(offsets, values, mask=pa.array([r is None for r in raw]))


def remove_repeats(documents: DataFrame, window: int = WINDOW, seed: int = SEED_WORDS) -> DataFrame:
    """One row per document: ``doc_id``, ``n_words``, ``n_removed``, ``kept`` (the words left, joined by
    single blanks) and ``spans`` (the maximal removed ranges of words).

    Words are separated by ASCII blanks and compared as they are. A null or empty text has no words. Of
    documents with the same id none stands in front of the other; a null id stands behind and in front
    of nothing, so nothing is removed from it.
    """
    gone = repeats(documents, window, seed).groupBy(
        F.col("doc_id").alias("id_"), F.col("mark").alias("mark_")).agg(
        F.collect_list(F.struct("begin", "end")).alias("gone"))
    rows = documents.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"))
    joined = rows.join(gone, (F.col("doc_id") == F.col("id_")) & (F.col("mark") == F.col("mark_")), "left")

    def per_task():
        def step(batch):
            n_words, n_removed, kept, spans = [], [], [], []
            for text, ranges in zip(texts(batch), batch.column("gone").to_pylist()):
                words = text.split()
                n_words.append(len(words))
                merged: list[list[int]] = []
                for r in sorted((r["begin"], r["end"]) for r in ranges or ()):
                    if merged and r[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], r[1])
                    else:
                        merged.append(list(r))
                n_removed.append(sum(e - b for b, e in merged))
                for b, e in reversed(merged):
                    del words[b:e]
                kept.append(b" ".join(words).decode())
                spans.append([{"begin": b, "end": e} for b, e in merged])
            return {"doc_id": batch.column("doc_id"), "n_words": n_words, "n_removed": n_removed,
                    "kept": kept, "spans": spans}

        return step

    return arrow_map(joined.select("doc_id", "text", "gone"), per_task,
                     "doc_id long, n_words long, n_removed long, kept string, "
                     "spans array<struct<begin:int,end:int>>")
