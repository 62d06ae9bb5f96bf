"""Bag of words, numeric assembly and batched row functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import (
    CountVectorizer,
    NGram,
    RegexTokenizer,
    SQLTransformer,
    StringIndexer,
    VectorAssembler,
)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelab import ROW_ID
from tablelab.functions import bind, word_ngrams
from tablelab.operators.ranks import sorted_index
from tablelab.session import spread

# As many terms as a vector can have.
ALL_TERMS = (1 << 31) - 1
# Fixed value: a token is a run of two or more letters, digits or underscores.
TOKEN = r"[\p{L}\p{N}_]{2,}"
# Words whose terms are counted together, but for a longer text.
COUNTED_WORDS = 1 << 20


def tokens(text: str | Column) -> Column:
    """Lower-cased tokens of a text."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def _check_range(min_n: int, max_n: int) -> None:
    if not 1 <= min_n <= max_n:
        raise ValueError(f"n-gram range should be 1 <= min <= max, got {min_n}..{max_n}")


def terms(text: str | Column, min_n: int = 1, max_n: int = 1) -> Column:
    """All word n-grams of ``min_n`` to ``max_n`` words, joined by a blank."""
    _check_range(min_n, max_n)
    words = tokens(text)
    if min_n == max_n == 1:
        return words

    return bind(words, lambda t: F.concat(*[word_ngrams(t, n) for n in range(min_n, max_n + 1)]))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``COUNTED_WORDS`` words of the column ``words`` at most, but for longer rows."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("words")), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + COUNTED_WORDS, "right")))
            yield batch.slice(at, end - at)
            at = end


def _grams(words: pa.ListArray, min_n: int, max_n: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Per length of an n-gram its distinct terms, and the place among them and the row of each occurrence."""
    coded = words.flatten().dictionary_encode()
    kinds, word = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    counts = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(words)), counts)
    left = np.repeat(np.cumsum(counts), counts) - np.arange(len(word))  # words up to the end of the row
    names, code = kinds, word
    for n in range(1, max_n + 1):
        at = np.flatnonzero(left >= n)
        if n > 1:
            pairs, found = np.unique(code[at] * len(kinds) + word[at + n - 1], return_inverse=True)
            if not len(pairs):
                return
            before, last = np.divmod(pairs, len(kinds))
            names = pc.binary_join_element_wise(names.take(pa.array(before)), kinds.take(pa.array(last)), " ")
            code = np.zeros(len(word), np.int64)
            code[at] = found
        if n >= min_n and len(at):
            yield names, code[at], row[at]


def vocabulary(df: DataFrame, text: str, min_n: int = 1, max_n: int = 1) -> DataFrame:
    """Distinct terms with their position in sorted order, as a table of any size."""
    _check_range(min_n, max_n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            for names, _, _ in _grams(batch.column("words"), min_n, max_n):
                yield pa.RecordBatch.from_arrays([names], names=["term"])

    distinct = df.select(tokens(text).alias("words")).mapInArrow(run, "term string").distinct()
    return sorted_index(distinct, "term")


def _postings(batches: Iterator[pa.RecordBatch], min_n: int, max_n: int) -> Iterator[pa.RecordBatch]:
    """``(term, ids, ns)``: the rows that hold a term and how often, from rows ``(id, words)`` in the order of ids.

    An id may have several rows. The counts of a slice's last id are held until another id comes.
    """
    held_id, held = None, {}

    def sent(terms: pa.Array, ends: np.ndarray, ids: pa.Array, ns: np.ndarray) -> pa.RecordBatch:
        offsets = pa.array(np.append(0, ends), pa.int32())
        return pa.RecordBatch.from_arrays(
            [terms, pa.ListArray.from_arrays(offsets, ids), pa.ListArray.from_arrays(offsets, pa.array(ns, pa.int64()))],
            names=["term", "ids", "ns"])

    def sent_held() -> pa.RecordBatch:
        size = len(held)
        return sent(pa.array(list(held), pa.string()), np.arange(1, size + 1), held_id.take(pa.array(np.zeros(size, np.int64))),
                    np.fromiter(held.values(), np.int64, size))

    for batch in _slices(batches):
        coded = batch.column("id").dictionary_encode(null_encoding="encode")
        ids, id_of_row = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        goes_on = held_id is not None and ids[:1].equals(held_id)
        if held and not goes_on:
            yield sent_held()
        last = len(ids) - 1
        edge = {0: held} if goes_on else {}  # ids that may have rows in other slices
        edge.setdefault(last, {})
        for names, code, row in _grams(batch.column("words"), min_n, max_n):
            key, n = np.unique(code * len(ids) + id_of_row[row], return_counts=True)
            term, id_ = np.divmod(key, len(ids))
            inner = np.ones(len(key), bool)
            for place, counts in edge.items():
                of = np.flatnonzero(id_ == place)
                inner[of] = False
                for t, k in zip(names.take(pa.array(term[of])).to_pylist(), n[of].tolist()):
                    counts[t] = counts.get(t, 0) + k
            if inner.any():
                term, id_, n = term[inner], id_[inner], n[inner]
                begins = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
                yield sent(names.take(pa.array(term[begins])), np.append(begins[1:], len(term)), ids.take(pa.array(id_)), n)
        if held and goes_on and last:
            yield sent_held()
        held_id, held = ids[last:], edge[last]
    if held:
        yield sent_held()


def postings(
    df: DataFrame, text: str, min_n: int, max_n: int, row_id: str,
    then: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str,
) -> DataFrame:
    """Terms with the rows that hold them, of slices of a task's rows: what ``then`` makes of ``(term, ids, ns)``."""
    _check_range(min_n, max_n)
    rows = spread(df.select(F.col(row_id).alias("id"), text), "id").sortWithinPartitions("id")
    return rows.select("id", tokens(text).alias("words")).mapInArrow(lambda b: then(_postings(b, min_n, max_n)), schema)


def term_counts(
    df: DataFrame, vocab: DataFrame, text: str, min_n: int = 1, max_n: int = 1, row_id: str = ROW_ID
) -> DataFrame:
    """Sparse bag of words in long form: ``(row id, index, n)``; terms outside the vocabulary drop.

    Texts are dealt out by row id, so that counting per (row, term) needs no shuffle of terms. A term
    then meets the vocabulary once per slice of a task's rows, with the rows that hold it as arrays; the
    planner broadcasts a small vocabulary by its own size check.
    """
    schema = T.StructType([
        T.StructField("term", T.StringType()),
        T.StructField("ids", T.ArrayType(df.schema[row_id].dataType)),
        T.StructField("ns", T.ArrayType(T.LongType())),
    ])
    counted = postings(df, text, min_n, max_n, row_id, lambda b: b, schema)
    return (
        counted.join(vocab, "term")
        .select("index", F.inline(F.arrays_zip("ids", "ns")))
        .select(F.col("ids").alias(row_id), "index", F.col("ns").alias("n"))
    )


def bag_of_words(text: str, min_n: int = 1, max_n: int = 1, out: str = "features") -> list:
    """Pipeline stages from a text column to a sparse vector of term counts.

    The vocabulary, all of it, is taken from the rows the pipeline is fitted on. These models keep it
    and what they know of each term on the driver; ``vocabulary``, ``term_counts`` and logistic regression
    (``fit_text``) do not. Terms are in no particular order, which no score depends on.
    """
    names = [f"_grams{n}" for n in range(min_n, max_n + 1)]
    return [
        RegexTokenizer(inputCol=text, outputCol="_words", gaps=False, pattern=TOKEN, minTokenLength=1),
        *[NGram(n=n, inputCol="_words", outputCol=f"_grams{n}") for n in range(min_n, max_n + 1)],
        SQLTransformer(statement=f"SELECT *, concat({', '.join(names)}) AS _terms FROM __THIS__"),
        CountVectorizer(inputCol="_terms", outputCol=out, vocabSize=ALL_TERMS),
    ]


def assemble(df: DataFrame, inputs: list[str], out: str = "features") -> list:
    """Pipeline stages that turn numeric and text columns into one vector."""
    text = [c for c in inputs if isinstance(df.schema[c].dataType, T.StringType)]
    stages: list = []
    if text:
        stages.append(
            StringIndexer(
                inputCols=text, outputCols=[f"_idx_{c}" for c in text],
                stringOrderType="alphabetAsc", handleInvalid="keep",
            )
        )
    columns = [f"_idx_{c}" if c in text else c for c in inputs]
    stages.append(VectorAssembler(inputCols=columns, outputCol=out, handleInvalid="error"))
    return stages


def map_batches(
    df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str,
    inputs: list[str] | None = None,
) -> DataFrame:
    """Apply a pandas function to batches of rows; only ``inputs`` are sent to Python.

    The batch size is ``spark.sql.execution.arrow.maxRecordsPerBatch``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield fn(batch)

    return (df if inputs is None else df.select(*inputs)).mapInPandas(run, schema)
