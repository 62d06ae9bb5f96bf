"""Quality rules: a log-likelihood ratio of hashed n-grams between trusted documents and the corpus.

Two multinomials over hashed words and word pairs are estimated: one from trusted documents, one from
all documents. A document's score is its log-likelihood ratio divided by its number of n-grams, so
long and short texts are measured alike. It is kept if the score reaches a fixed threshold and it
passes the base rules (enough words, few repeated passages).

Both passes are narrow scans: a task adds up a table of ``2**bits`` counts, and only those tables meet.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelab.llm.common import WordHashes, arrow_map, hashed_grams, numbered, texts
from tablelab.session import broadcast_small, materialize

TOKENS = re.compile(r"\w+|[^\w\s]+")
BITS = 18
# Share of a multinomial that is spread evenly over the buckets, on both sides. It is a share of the counts, so
# that a corpus and many copies of it give the same scores, and large, so that a small corpus does not hold
# the rare words of a document without a label against it.
PRIOR = 0.95
# Nats per n-gram. Text drawn from the corpus as a whole scores about 0, trusted text above.
MIN_SCORE = -0.12
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
SYMBOLS = b"#*$%&|<>"
REPEAT_WINDOW = 5
METRICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def trusted_ids(labels: DataFrame) -> DataFrame:
    """``doc_id`` of all documents labelled as good, each once."""
    return materialize(labels.filter("quality = 1 and doc_id is not null").select(
        F.col("doc_id").alias("trusted_id")).distinct(), "trusted")


def log_ratios(documents: DataFrame, trusted: DataFrame, bits: int = BITS) -> np.ndarray:
    """``log p(gram | trusted) - log p(gram | corpus)`` per bucket, each mixed with ``PRIOR`` of a uniform one.

    ``trusted`` has distinct ``trusted_id`` of any number; up to a million are broadcast, more are joined by a
    shuffle. No document or no trusted document gives a uniform distribution on that side.
    """
    marked = documents.select("doc_id", "text").join(
        broadcast_small(trusted, trusted.count()), F.col("doc_id") == F.col("trusted_id"), "left"
    ).select("text", F.col("trusted_id").isNotNull().alias("good"))

    def count(batches):
        hashes, tables = WordHashes(), np.zeros((2, 1 << bits), np.int64)
        for batch in batches:
            for text, good in zip(texts(batch), batch.column("good").to_pylist()):
                grams = hashed_grams(hashes.array(TOKENS.findall(text.decode())), bits)
                for side in (0, 1) if good else (0,):
                    np.add.at(tables[side], grams, 1)
        at = np.flatnonzero(tables[0])
        yield pa.RecordBatch.from_pydict({"bucket": at, "raw": tables[0][at], "good": tables[1][at]})

    counted = (
        marked.mapInArrow(count, "bucket long, raw long, good long")
        .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).toArrow().to_pandas()
    )
    raw, good = np.zeros(1 << bits), np.zeros(1 << bits)
    raw[counted["bucket"]], good[counted["bucket"]] = counted["raw"], counted["good"]
    # both sides get the same share of prior mass, so a bucket that is rare on both says little
    good, raw = (
        ((1 - PRIOR) * c / c.sum() + PRIOR / len(c)) if c.any() else np.full(len(c), 1 / len(c)) for c in (good, raw))
    return (np.log(good) - np.log(raw)).astype(np.float32)


def repeated_words(words: list, size: int = REPEAT_WINDOW) -> int:
    """Words inside windows of ``size`` words that occur twice or more in the text."""
    windows = list(zip(*(words[i:] for i in range(size))))
    if len(set(windows)) == len(windows):
        return 0
    first: dict = {}
    covered = np.zeros(len(words) + 1, np.int64)
    for i, w in enumerate(windows):
        j = first.setdefault(w, i)
        if j != i:
            for start in (i, j):
                covered[start:start + size] = 1
    return int(covered.sum())


def base_metrics(text: bytes) -> tuple[int, int, int, int, int]:
    """Words, code points in words, symbols, repeated lines, words in repeated windows."""
    words = text.split()
    joined = b"".join(words)
    chars = len(joined.decode())
    lines = [x for x in text.split(b"\n") if x.strip()]
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words)


def rate(documents: DataFrame, ratios: np.ndarray, carry: list[str], bits: int = BITS,
         min_score: float = MIN_SCORE) -> DataFrame:
    """Columns ``carry`` of every row, the base metrics, ``llr``, ``base_failed`` and ``kept``.

    A null or empty text has no words and fails the base rules; its ``llr`` is 0. Repeated rows are
    rated alike, each on its own.
    """
    weights = documents.sparkSession.sparkContext.broadcast(ratios)
    rows = documents.select(F.col("text").alias("text_"), *carry)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in carry)

    def per_task():
        hashes = WordHashes()

        def step(batch):
            found = []
            for text in texts(batch, "text_"):
                grams = hashed_grams(hashes.array(TOKENS.findall(text.decode())), bits)
                llr = float(weights.value[grams].mean(dtype=np.float64)) if len(grams) else 0.0
                n, chars, symbols, lines, repeats = base_metrics(text)
                failed = n < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n
                found.append((n, chars, symbols, lines, repeats, llr, failed, not failed and llr >= min_score))
            names = "n_words word_chars n_symbols n_dup_lines n_repeat_words llr base_failed kept".split()
            return {c: batch.column(c) for c in carry} | dict(zip(names, zip(*found)))

        return step

    return arrow_map(rows, per_task, f"{kinds}, {METRICS}, llr double, base_failed boolean, kept boolean")


def quality_rules(documents: DataFrame, labels: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """``rate`` against the documents that ``labels`` marks as good; ``carry`` defaults to ``doc_id``."""
    ratios = log_ratios(documents, trusted_ids(labels))
    return rate(documents, ratios, ["doc_id"] if carry is None else carry)


def keep_good(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that ``rate`` keeps, with the columns of ``documents``, whatever their names."""
    ratios = log_ratios(documents, trusted_ids(labels))
    inside, names = numbered(documents)
    kept = rate(inside.withColumn("text", F.col(names["text"])), ratios, list(names.values())).filter("kept")
    return kept.select(*names.values()).toDF(*documents.columns)
