"""Column functions. All of them stay in the JVM."""

from .scalars import (
    argmax,
    attention_mask,
    bind,
    display_split,
    feature_label,
    format_timestamp,
    link_function,
    metric_column,
    pad_ids,
    round3,
    run_status,
    softmax,
    two_decimals,
    word_ngrams,
)

__all__ = [
    "argmax",
    "attention_mask",
    "bind",
    "display_split",
    "feature_label",
    "format_timestamp",
    "link_function",
    "metric_column",
    "pad_ids",
    "round3",
    "run_status",
    "softmax",
    "two_decimals",
    "word_ngrams",
]
