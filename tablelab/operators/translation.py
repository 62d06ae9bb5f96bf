"""Corpus BLEU and TER over one frame holding candidate and reference side by side."""

from __future__ import annotations

from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelab.functions import word_ngrams
from tablelab.session import spread

MAX_ORDER = 4

# The standard "13a" tokenisation rules (pattern, replacement), applied in order.
RULES_13A = (
    ("<skipped>", ""),
    ("-\\n", ""),
    ("\\n", " "),
    ("&quot;", '"'),
    ("&amp;", "&"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("([{-~\\[-` -&(-+:-@/])", " $1 "),
    ("([^0-9])([.,])", "$1 $2 "),
    ("([.,])([^0-9])", " $1 $2"),
    ("([0-9])(-)", "$1 $2 "),
)

# Usual limits of TER's greedy shifts, which ``ter`` takes as arguments.
MAX_SHIFT_SIZE = 10
MAX_SHIFT_DISTANCE = 50

# Moves whose distances are computed together.
MOVES_AT_ONCE = 256


def tokens_13a(text: str | Column) -> Column:
    """Tokens as BLEU counts them."""
    c = F.concat(F.lit(" "), F.col(text) if isinstance(text, str) else text, F.lit(" "))
    for pattern, replacement in RULES_13A:
        c = F.regexp_replace(c, pattern, replacement)
    return F.filter(F.split(c, "\\s+"), lambda t: t != "")


def _tagged(tokens: str, n: int, is_candidate: bool) -> Column:
    """N-grams of one side as ``(order, text, count in candidate, count in reference)``."""
    c, r = (1, 0) if is_candidate else (0, 1)

    def tag(g: Column) -> Column:
        return F.struct(
            F.lit(n).alias("k"), g.alias("g"), F.lit(c).alias("c"), F.lit(r).alias("r")
        )

    return F.transform(word_ngrams(tokens, n), tag)


def ngram_matches(
    df: DataFrame, candidate: str, reference: str, row_id: str, by: list[str] | None = None
) -> DataFrame:
    """Clipped matches and totals per n-gram order for every group: one row per group.

    The pairs are dealt out by row id once. N-grams are then counted where they are made, because
    rows with equal (row, order, text) already share a task: only the texts are ever shuffled, not
    the many times larger set of n-grams. A null text counts as an empty one.
    """
    by = by or []
    pairs = spread(
        df.select(*by, F.col(row_id).alias("_id"), *[
            F.coalesce(F.col(side), F.lit("")).alias(name) for side, name in ((candidate, "_ct"), (reference, "_rt"))]),
        "_id",
    )
    tokens = pairs.select(
        *by, "_id",
        tokens_13a("_ct").alias("_c"), tokens_13a("_rt").alias("_r"),
    )
    sides = [
        _tagged(side, n, side == "_c") for n in range(1, MAX_ORDER + 1) for side in ("_c", "_r")
    ]
    exploded = tokens.select(*by, "_id", F.explode(F.concat(*sides)).alias("x")).select(*by, "_id", "x.*")
    counted = exploded.groupBy(*by, "_id", "k", "g").agg(F.sum("c").alias("c"), F.sum("r").alias("r"))
    aggs = []
    for n in range(1, MAX_ORDER + 1):
        here = F.col("k") == n
        aggs.append(F.sum(F.when(here, F.least("c", "r")).otherwise(0)).alias(f"match_{n}"))
        aggs.append(F.sum(F.when(here, F.col("c")).otherwise(0)).alias(f"total_{n}"))
    aggs.append(F.sum(F.when(F.col("k") == 1, F.col("r")).otherwise(0)).alias("reference_length"))
    return counted.groupBy(*by).agg(*aggs)


def bleu(
    df: DataFrame, candidate: str, reference: str, row_id: str, by: list[str] | None = None
) -> DataFrame:
    """Corpus BLEU (up to 4-grams, brevity penalty, no smoothing) per group, in 0..1."""
    by = by or []
    m = ngram_matches(df, candidate, reference, row_id, by)
    match = [F.coalesce(F.col(f"match_{n}"), F.lit(0)) for n in range(1, MAX_ORDER + 1)]
    total = [F.coalesce(F.col(f"total_{n}"), F.lit(0)) for n in range(1, MAX_ORDER + 1)]
    logs = [F.ln(a / b) for a, b in zip(match, total)]
    mean = F.exp(sum(logs[1:], logs[0]) / MAX_ORDER)
    ratio = F.col("total_1") / F.col("reference_length")
    penalty = F.when(ratio > 1, 1.0).otherwise(F.exp(1 - 1 / ratio))
    score = F.when(F.least(*match) > 0, penalty * mean).otherwise(0.0)
    return m.select(*by, score.alias("Bleu"))


# --- TER -----------------------------------------------------------------------------------------


def _row_step(prev: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Next row(s) of the word edit distance table; works on a batch of rows at once."""
    best = prev + 1
    best[..., 1:] = np.minimum(best[..., 1:], prev[..., :-1] + ~same)
    at = np.arange(prev.shape[-1])
    return np.minimum.accumulate(best - at, axis=-1) + at


def _table(hyp: np.ndarray, ref: np.ndarray) -> np.ndarray:
    """Distances of all beginnings; a step for each word of the shorter side, as they are the same both ways."""
    if len(hyp) > len(ref):
        return np.ascontiguousarray(_table(ref, hyp).T)
    rows = [np.arange(len(ref) + 1)]
    for w in hyp:
        rows.append(_row_step(rows[-1], ref == w))
    return np.stack(rows)


def _alignment(table: np.ndarray, hyp, ref):
    """Hypothesis place of each reference word, and which words of either side are errors."""
    i, j = len(hyp), len(ref)
    place = np.zeros(j, int)
    hyp_bad, ref_bad = np.zeros(i, bool), np.zeros(j, bool)
    while i or j:
        if i and j and table[i, j] == table[i - 1, j - 1] + (hyp[i - 1] != ref[j - 1]):
            i, j = i - 1, j - 1
            place[j] = i
            hyp_bad[i] = ref_bad[j] = hyp[i] != ref[j]
        elif i and table[i, j] == table[i - 1, j] + 1:
            i -= 1
            hyp_bad[i] = True
        else:
            j -= 1
            place[j] = i - 1
            ref_bad[j] = True
    return place, hyp_bad, ref_bad


def _moves(hyp, ref, place, hyp_bad, ref_bad, max_size, max_distance):
    """Block moves worth trying, one by one: (length, start, insertion point)."""
    where: dict = {}
    for j, w in enumerate(ref):
        where.setdefault(w, []).append(j)
    for s, w in enumerate(hyp):
        for r in where.get(w, ()):
            if abs(r - s) > max_distance:
                continue
            for n in range(1, max_size + 1):
                if s + n > len(hyp) or r + n > len(ref) or hyp[s + n - 1] != ref[r + n - 1]:
                    break
                if not hyp_bad[s : s + n].any() or not ref_bad[r : r + n].any():
                    continue
                if s <= place[r] < s + n:
                    continue
                spots = {0 if r + k < 0 else int(place[r + k]) + 1 for k in range(-1, n)}
                yield from ((n, s, t) for t in sorted(spots) if not s <= t <= s + n)


def _moved(hyp: np.ndarray, n: int, start: int, to: int) -> np.ndarray:
    block, rest = hyp[start : start + n], np.delete(hyp, np.s_[start : start + n])
    return np.insert(rest, to - n if to > start else to, block)


def _distances(hyp, ref, forward, backward, moves) -> np.ndarray:
    """Edit distance after each move. Only the words between source and target change place, so
    the table rows before and after them are reused and the rest is computed for all moves at once.
    """
    low = np.array([min(s, t) for _, s, t in moves])
    high = np.array([max(s + n, t) for n, s, t in moves])
    span = high - low
    words = np.full((len(moves), span.max()), -1)
    for k, (n, s, t) in enumerate(moves):
        words[k, : span[k]] = _moved(hyp, n, s, t)[low[k] : high[k]]
    rows = forward[low]
    for step in range(span.max()):
        live = span > step
        rows[live] = _row_step(rows[live], words[live, step][:, None] == ref[None, :])
    return (rows + backward[high]).min(axis=1)


def ter_edits(
    candidate: str, reference: str, max_size: int = MAX_SHIFT_SIZE, max_distance: int = MAX_SHIFT_DISTANCE
) -> int:
    """Edits that turn one sentence into the other: word edits plus greedy block shifts. Every move
    of at most ``max_size`` words over at most ``max_distance`` is tried."""
    if candidate == reference:
        return 0
    hyp_words, ref_words = candidate.lower().split(), reference.lower().split()
    codes = {w: i for i, w in enumerate(dict.fromkeys(hyp_words + ref_words))}
    hyp = np.array([codes[w] for w in hyp_words], dtype=int)
    ref = np.array([codes[w] for w in ref_words], dtype=int)
    if not len(ref) or not len(hyp):
        return len(hyp) + len(ref)
    # no order of the words is nearer than this
    common = np.minimum(np.bincount(hyp, minlength=len(codes)), np.bincount(ref, minlength=len(codes))).sum()
    least = max(len(hyp), len(ref)) - int(common)
    shifts = 0
    while True:
        table = _table(hyp, ref)
        distance = int(table[-1, -1])
        if distance <= least:  # no move gains
            return shifts + distance
        backward = _table(hyp[::-1], ref[::-1])[::-1, ::-1]
        moves = _moves(hyp, ref, *_alignment(table, hyp, ref), max_size, max_distance)
        best = (0,)
        while some := list(islice(moves, MOVES_AT_ONCE)):
            after = _distances(hyp, ref, table, backward, some)
            # largest gain first, then the longest block, then the leftmost
            best = max(best, *((distance - int(d), n, -s, -t) for d, (n, s, t) in zip(after, some)))
        if best[0] <= 0:
            return shifts + distance
        _, n, s, t = best
        hyp = _moved(hyp, n, -s, -t)
        shifts += 1


def ter(
    df: DataFrame, candidate: str, reference: str, by: list[str] | None = None,
    max_shift_size: int = MAX_SHIFT_SIZE, max_shift_distance: int = MAX_SHIFT_DISTANCE,
) -> DataFrame:
    """Corpus TER in percent per group: edits over reference words.

    A shift moves at most ``max_shift_size`` words over at most ``max_shift_distance`` places; the
    defaults are the usual ones. A null text counts as an empty one.
    """
    by = by or []

    @F.pandas_udf(T.LongType())
    def edits_of(candidates: pd.Series, references: pd.Series) -> pd.Series:
        return pd.Series([ter_edits(c or "", r or "", max_shift_size, max_shift_distance)
                          for c, r in zip(candidates, references)], dtype="int64")

    words = F.size(F.filter(F.split(F.lower(F.coalesce(F.col(reference), F.lit(""))), "\\s+"), lambda w: w != ""))
    pairs = spread(df.select(*by, candidate, reference)).select(
        *by, edits_of(F.col(candidate), F.col(reference)).alias("edits"), words.alias("words"))
    edits, total = F.sum("edits"), F.sum("words")
    rate = F.when(total > 0, 100.0 * edits / total).otherwise(F.when(edits > 0, 100.0).otherwise(0.0))
    return pairs.groupBy(*by).agg(
        rate.alias("Ter"), edits.alias("edits"), total.alias("reference_words")
    )
