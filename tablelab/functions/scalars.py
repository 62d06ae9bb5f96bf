"""Scalar functions over labels, probabilities, token ids and run attributes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablelab import messages

# The texts of the run states, by code.
RUN_STATUS = {0: "Not Started", 1: "Delivered", 2: "Started", 3: "Finished", 4: "Error"}

# The prefix each split gives its metric columns in a leaderboard.
METRIC_PREFIX = {"train": "train_", "test": "test_", "validation": "val_"}


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _filled(text: str, place: str, value: Column) -> Column:
    return F.replace(F.lit(text), F.lit(place), value)


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and use it in ``body``; a plain reference inside a lambda
    would be evaluated again for every array element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def argmax(values) -> Column:
    """0-based position of the largest element; the first one wins a tie."""
    v = _col(values)
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def softmax(logits) -> Column:
    """Probabilities from logits, shifted by the maximum so that ``exp`` cannot overflow."""
    v = _col(logits)
    powers = bind(F.array_max(v), lambda top: F.transform(v, lambda x: F.exp(x - top)))

    def normalise(p: Column) -> Column:
        total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
        return bind(total, lambda t: F.transform(p, lambda x: x / t))

    return bind(powers, normalise)


def round3(x) -> Column:
    """Half-even rounding to three decimals, as explanations are reported."""
    return F.bround(_col(x), 3)


def two_decimals(x) -> Column:
    """A number as text with exactly two decimals, halves of its shortest decimal form going up."""
    return F.format_string("%.2f", _col(x).cast("double"))


def display_split(name) -> Column:
    """``train_metrics`` -> ``train``; an unknown name is an error."""
    c = _col(name)
    out = F.when(c == "train_metrics", "train")
    out = out.when(c == "test_metrics", "test").when(c == "validation_metrics", "validation")
    return out.otherwise(
        F.raise_error(_filled(messages.UNKNOWN_SPLIT_NAME, "{name}", c))
    )


def metric_column(split, metric) -> Column:
    """Leaderboard column of a metric: ``train_F1``, ``test_F1``, ``val_F1``."""
    s = _col(split)
    prefix = F.lit("")
    for name, text in METRIC_PREFIX.items():
        prefix = F.when(s == name, text).otherwise(prefix)
    return F.concat(prefix, _col(metric))


def feature_label(feature, value) -> Column:
    """``feature=value``; a missing value gives ``feature=None``."""
    text = F.coalesce(_col(value).cast("string"), F.lit("None"))
    return F.concat_ws("=", _col(feature), text)


def format_timestamp(ts) -> Column:
    """``YYYY/MM/DD HH:mm``, empty text for null."""
    return F.coalesce(F.date_format(_col(ts), "yyyy/MM/dd HH:mm"), F.lit(""))


def run_status(code) -> Column:
    """Text of a run state code; an unknown code is an error."""
    c = _col(code)
    out = None
    for value, text in RUN_STATUS.items():
        out = F.when(c == value, text) if out is None else out.when(c == value, text)
    return out.otherwise(F.raise_error(_filled(messages.UNKNOWN_STATUS, "{code}", c.cast("string"))))


def link_function(p, link: str = "identity") -> Column:
    """Scale on which contributions add up: the probability itself or its log-odds."""
    c = _col(p)
    if link == "identity":
        return c
    if link == "logit":
        return F.ln(c / (1 - c))
    raise ValueError(f"link must be identity or logit, got {link}")


def pad_ids(ids, length: int, pad_id: int = 0) -> Column:
    """Token ids truncated or padded to a fixed length."""
    return F.slice(F.concat(_col(ids), F.array_repeat(F.lit(pad_id), length)), 1, length)


def attention_mask(ids, length: int) -> Column:
    """1 for a real token, 0 for padding, same length as ``pad_ids``."""
    real = F.least(F.size(_col(ids)), F.lit(length))
    return F.concat(F.array_repeat(F.lit(1), real), F.array_repeat(F.lit(0), F.lit(length) - real))


def word_ngrams(words, n: int) -> Column:
    """All runs of ``n`` consecutive words of an array, joined by a blank."""
    w = _col(words)
    if n == 1:
        return w

    def gram(first: Column, i: Column) -> Column:
        return F.concat_ws(" ", first, *[F.get(w, i + k) for k in range(1, n)])

    starts = F.slice(w, 1, F.greatest(F.size(w) - n + 1, F.lit(0)))
    return F.transform(starts, gram)
