"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or not at all. Expectation-maximisation over the counts of
vote patterns estimates how accurate each labeller is and gives a posterior per pattern; a hashed linear
scorer is trained on posteriors and scores every document from its text.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelab.llm import toxicity
from tablelab.llm.common import WordHashes, arrow_map, hashed_grams, hashed_share, texts
from tablelab.llm.quality_llr import TOKENS, base_metrics

BITS = 20
# Documents that the scorer is trained on, at most about this many, chosen by a hash.
MAX_TRAINING = 30_000
EM_ROUNDS = 100
ABSTAIN, BAD, GOOD = 0, 1, 2
LABELLERS = ("symbols", "capitals", "bars", "repeats", "lines", "stutter", "word_length", "marks", "sentences", "empty")
# Bytes by kind: capital, digit, blank, letter (all of UTF-8 beyond ASCII too), others as they are.
_SHAPE = bytes(
    88 if 65 <= c <= 90 else 57 if 48 <= c <= 57 else 120 if 97 <= c <= 122 or c >= 128 else c for c in range(256))
_ENDS = re.compile(r"[.!?…][\"')\]]*\s*$")


def votes(text: bytes) -> tuple[int, ...]:
    """A vote of each of ``LABELLERS``. A text without words is bad by ``empty`` alone.

    Detectors of one kind of junk say bad or abstain: that a text has no bars says nothing about its
    symbols. ``sentences`` may say either.
    """
    n, chars, symbols, dup_lines, repeats = base_metrics(text)
    if not n:
        return tuple(BAD if x == "empty" else ABSTAIN for x in LABELLERS)
    decoded = text.decode()
    lines = [x for x in decoded.split("\n") if x.strip()]
    words = text.split()
    points = np.frombuffer(decoded.encode("utf-32-le"), np.uint32)
    # letters of ASCII and Latin-1, and whatever lies beyond
    upper = int(((points >= 65) & (points <= 90) | (points >= 0xC0) & (points <= 0xDE)).sum())
    letters = max(1, int(((points | 32) - 97 < 26).sum() + (points >= 0xC0).sum()))
    ended = sum(bool(_ENDS.search(x)) for x in lines) / max(1, len(lines))
    bars = text.count(b"|")

    def bad(yes: bool) -> int:
        return BAD if yes else ABSTAIN

    return (
        bad(symbols - bars > 0.15 * n),
        bad(upper > 0.5 * letters),
        bad(bars > 0.1 * n),
        bad(repeats > 0.2 * n),
        bad(dup_lines >= 0.3 * len(lines) > 0),
        bad(sum(map(bytes.__eq__, words, words[1:])) > 0.2 * n),
        bad(not 2 <= chars / n <= 12),
        bad(text.count(b"!") > 0.2 * n),
        GOOD if ended >= 0.7 else BAD if ended <= 0.1 and n >= 20 else ABSTAIN,
        ABSTAIN,
    )


def pattern_of(ballot: tuple[int, ...]) -> int:
    """A ballot as a number in base 3."""
    out = 0
    for v in ballot:
        out = 3 * out + v
    return out


def ballots(patterns: np.ndarray) -> np.ndarray:
    powers = 3 ** np.arange(len(LABELLERS) - 1, -1, -1)
    return patterns[:, None] // powers % 3


def posteriors(patterns: np.ndarray, counts: np.ndarray, rounds: int = EM_ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Probability of good per pattern, and the estimated accuracy of each labeller where it votes.

    Both classes are equally likely before any vote. Starts from the view that one bad vote makes a
    document bad, which gives the classes their meaning; an accuracy starts as 9 right votes of 10.
    """
    vote = ballots(patterns)
    sign = (vote == GOOD).astype(float) - (vote == BAD)
    q = np.where((vote == BAD).any(1), 0.001, 0.999)
    for _ in range(rounds):
        right = counts @ ((sign > 0) * q[:, None] + (sign < 0) * (1 - q)[:, None])
        accuracy = np.clip((right + 9) / (counts @ (sign != 0) + 10), 0.5, 0.9999)
        new = 1 / (1 + np.exp(-np.clip(sign @ np.log(accuracy / (1 - accuracy)), -35, 35)))
        if np.abs(new - q).max(initial=0) < 1e-9:
            break
        q = new
    return q, accuracy


def quality_features(text: bytes, hashes: WordHashes, bits: int) -> np.ndarray:
    """Hashed words, marks and pairs of them, and the same of word shapes."""
    tokens = TOKENS.findall(text.decode())
    shapes = text.translate(_SHAPE).split()
    return np.concatenate([hashed_grams(hashes.array(tokens), bits), hashed_grams(hashes.array(shapes), bits, skips=True)])


def weak_quality(documents: DataFrame, most: int = MAX_TRAINING) -> DataFrame:
    """One row per document: ``doc_id``, ``weak_label`` (the posterior), ``score`` (0 to 1, higher: better)
    and ``kept`` (score of at least 0.5).

    A null or empty text has the votes of a text without words. Repeated rows are rated each on its own.
    """
    def count():
        return lambda batch: {"pattern": [pattern_of(votes(t)) for t in texts(batch)]}

    # at most 3 ** 10 rows
    found = arrow_map(documents.select("text"), count, "pattern int").groupBy("pattern").count().orderBy("pattern").toArrow().to_pandas()
    patterns, counts = found["pattern"].to_numpy(np.int64), found["count"].to_numpy(np.float64)
    q, _ = posteriors(patterns, counts)
    known = dict(zip(patterns.tolist(), q.tolist()))
    sample = documents.filter(hashed_share("doc_id", int(counts.sum()), most))

    def label():
        return lambda batch: {"doc_id": batch.column("doc_id"), "text": batch.column("text"),
                              "label": [known[pattern_of(votes(t))] for t in texts(batch)]}

    examples = arrow_map(sample.select("doc_id", "text"), label, "doc_id long, text string, label double")
    weights = toxicity.fit(examples, BITS, quality_features)

    def carry(rows: DataFrame) -> DataFrame:
        def posterior():
            return lambda batch: {"doc_id": batch.column("doc_id"), "text": batch.column("text"),
                                  "weak_label": [known.get(pattern_of(votes(t)), 0.5) for t in texts(batch)]}

        return arrow_map(rows.select("doc_id", "text"), posterior, "doc_id long, text string, weak_label double")

    scored = toxicity.score(carry(documents), weights, ["doc_id", "weak_label"], quality_features)
    return scored.select("doc_id", "weak_label", "score", (F.col("score") >= 0.5).alias("kept"))
