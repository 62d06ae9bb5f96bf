"""Logistic regression on the words of a text, with any number of terms.

The model is a table with a row per term; the driver never holds a vector over the vocabulary. Texts are
tokenised once, into the texts of each term, packed by blocks of texts. Terms that the same texts hold equally often have
equal coefficients at every step, so they are one column of the fit, with their number as its weight. A step joins the
columns to its direction and adds up per text, tries its length on these sums, then sends the errors of a bounded number of
texts at a time to the columns. The most frequent columns, a bounded number, are met by broadcast; no other has enough texts to be a hot key.

Steps are those of L-BFGS in its vector-free form (Chen, Wang and Zhou 2014): the directions are sums of
columns of the table, and only their inner products reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelab.functions import argmax
from tablelab.operators.dataset import with_row_ids
from tablelab.operators.features import postings
from tablelab.session import materialize

# Terms whose weights are broadcast, the most frequent ones.
HOT_TERMS = 10_000
# Numbers that a task adds up to at a time, one per text of a block and class.
BLOCK = 1 << 17
# Errors that are sent to the columns at a time, one per text and class.
SENT = 1 << 22
# Earlier steps that shape the next one.
HISTORY = 4
# Halvings of a step before the search ends.
HALVINGS = 20
_BIAS = -1


def _key(text: str) -> Column:
    return F.md5(F.coalesce(F.col(text), F.lit("")))


def _block_texts(dims: int) -> int:
    return max(1, BLOCK // dims)


def _binary(values: np.ndarray, begins: np.ndarray) -> pa.Array:
    """A binary per run of 64-bit numbers."""
    ends = np.append(begins, len(values)).astype(np.int32) * 8
    buffers = [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values, np.int64))]
    return pa.Array.from_buffers(pa.binary(), len(begins), buffers)


def _numbers(cells: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all binaries, and how many each has."""
    ends = np.frombuffer(cells.buffers()[1], np.int32, len(cells) + 1, cells.offset * 4)
    size = int(ends[-1] - ends[0])
    values = np.frombuffer(cells.buffers()[2], np.int64, size // 8, int(ends[0])) if size else np.zeros(0, np.int64)
    return values, np.diff(ends) // 8


def _unpacked(cells: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of the text in its block, count, and row of each cell."""
    values, sizes = _numbers(cells)
    return values >> 32, values & 0xFFFFFFFF, np.repeat(np.arange(len(cells)), sizes)


def _cells(texts: DataFrame, size: int, min_n: int, max_n: int) -> DataFrame:
    """``(term, block, cells)`` of ``(key, text)``, the keys being numbers from 0: the texts of a block of ``size`` that
    hold a term, each a 64-bit number of its place and the count. A term has a row per block and slice of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            row = np.repeat(np.arange(len(ids)), pc.list_value_length(ids).to_numpy(zero_copy_only=False))
            key, n = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("ids", "ns"))
            block = key // size
            begins = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (block[1:] != block[:-1])))[:len(row)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("term").take(pa.array(row[begins])), pa.array(block[begins]),
                 _binary((key - block * size) << 32 | n, begins)], names=["term", "block", "cells"])

    return postings(texts, "text", min_n, max_n, "key", run, "term string, block long, cells binary")


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per term and block, its cells in order, from rows that lie by term and in it by block."""

    def sent(rows: pa.Table, begins: np.ndarray) -> pa.RecordBatch:
        values, sizes = _numbers(rows["cells"].combine_chunks())
        of = np.repeat(np.searchsorted(begins, np.arange(len(rows)), "right") - 1, sizes)
        values = values[np.lexsort((values, of))]
        return pa.RecordBatch.from_arrays(
            [rows[c].combine_chunks().take(pa.array(begins)) for c in ("term", "block")]
            + [_binary(values, np.searchsorted(of, np.arange(len(begins))))], names=["term", "block", "cells"])

    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        term, block = batch.column("term"), batch.column("block").to_numpy(zero_copy_only=False)
        other = pc.not_equal(term[1:], term[:-1]).to_numpy(zero_copy_only=False) | (block[1:] != block[:-1])
        if held and not (term[0] == held[0].column("term")[0] and block[0] == held[0].column("block")[0].as_py()):
            yield sent(pa.Table.from_batches(held), np.zeros(1, np.int64))
            held = []
        begins = np.flatnonzero(np.append(True, other))
        if len(begins) > 1:  # the last term may go on
            rows = pa.Table.from_batches([*held, batch.slice(0, begins[-1])])
            yield sent(rows, np.append(0, begins[1:-1] + (len(rows) - begins[-1])))
            held = []
        held.append(batch.slice(begins[-1]))
    if held:
        yield sent(pa.Table.from_batches(held), np.zeros(1, np.int64))


def _text_sums(cells: DataFrame, weights: list[str], size: int, texts: int) -> DataFrame:
    """``(key, d0...)``: the weights ``(block, cells, weights...)`` summed over the cells of each text."""
    names = [f"d{k}" for k in range(len(weights))]

    def sent(block: int, sums: list[np.ndarray], met: np.ndarray) -> Iterator[pa.RecordBatch]:
        at = np.flatnonzero(met)
        for s in range(0, len(at), 1 << 16):
            part = at[s : s + (1 << 16)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part + block * size), *[pa.array(x[part]) for x in sums]], names=["key", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums, met = None, [], None
        for batch in batches:
            blocks = batch.column("block").to_numpy(zero_copy_only=False)
            w = [batch.column(c).to_numpy(zero_copy_only=False) for c in weights]
            at, n, row = _unpacked(batch.column("cells"))
            block = blocks[row]
            for b in np.unique(blocks).tolist():
                if b != now:
                    if now is not None:
                        yield from sent(now, sums, met)
                    now, held = b, min(size, texts - b * size)
                    sums, met = [np.zeros(held) for _ in weights], np.zeros(held, bool)
                here = slice(None) if (blocks == b).all() else block == b
                met[at[here]] = True
                for total, x in zip(sums, w):
                    np.add.at(total, at[here], (n * x[row])[here])
        if now is not None:
            yield from sent(now, sums, met)

    rows = cells.select("block", "cells", *weights)
    if texts > size:
        rows = rows.sortWithinPartitions("block")
    return rows.mapInArrow(run, ", ".join(["key long", *[f"{d} double" for d in names]])).groupBy("key").agg(
        *[F.sum(d).alias(d) for d in names])


class TextLinearModel:
    """Coefficients in a table ``(term, hot, w0, w1, ...)``; the row without a term holds the intercepts."""

    def __init__(self, table: DataFrame, text: str, min_n: int, max_n: int, classes: int, steps: int = 0):
        self.table, self.text, self.min_n, self.max_n = table, text, min_n, max_n
        self.classes, self.steps = classes, steps

    @property
    def margins(self) -> int:
        return 1 if self.classes == 2 else self.classes

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``probability`` and ``prediction``. Equal texts are scored once, and the scores written; a null
        text has no words. Terms without a coefficient do not count."""
        w = [f"w{k}" for k in range(self.margins)]
        bias = self.table.filter("term IS NULL").select(*w).first()
        texts = df.select(_key(self.text).alias("_text_key"), F.col(self.text).alias("text")).dropDuplicates(["_text_key"])
        texts = with_row_ids(materialize(texts, "texts"), "key")
        size = _block_texts(self.margins)
        hashed = F.xxhash64("term").alias("h")  # numbers are sorted faster than texts
        known = self.table.filter("term IS NOT NULL").select(hashed, "term", *w)
        counted = _cells(texts, size, self.min_n, self.max_n).select("*", hashed).join(known, ["h", "term"])
        summed = _text_sums(counted, w, size, texts.count())
        summed = materialize(texts.select("key", "_text_key").join(summed, "key").select(
            "_text_key", F.array(*[f"d{k}" for k in range(self.margins)]).alias("_text_margins")), "margins")
        margins = [F.coalesce(F.col("_text_margins")[k], F.lit(0.0)) + F.lit(bias[k]) for k in range(self.margins)]
        shares = _softmax(margins)[0]
        kept = [c for c in df.columns if c not in ("probability", "prediction")]
        joined = df.select(*[F.col(f"`{c}`") for c in kept]).join(summed, _key(self.text) == F.col("_text_key"), "left")
        return (joined.withColumn("probability", F.array(*shares)).drop("_text_key", "_text_margins")
                .withColumn("prediction", argmax("probability").cast("double")))

    def save(self, path: str) -> None:
        self.table.write.mode("overwrite").parquet(f"{path}/coefficients")
        facts = [(self.text, self.min_n, self.max_n, self.classes, self.steps)]
        self.table.sparkSession.createDataFrame(
            facts, "text string, min_n int, max_n int, classes int, steps int").write.mode("overwrite").parquet(
            f"{path}/text_model")

    @staticmethod
    def load(spark: SparkSession, path: str) -> TextLinearModel:
        facts = spark.read.parquet(f"{path}/text_model").first()
        return TextLinearModel(spark.read.parquet(f"{path}/coefficients"), *facts)


def _softmax(margins: list[Column]) -> tuple[list[Column], Column]:
    """Class shares, and the logarithm of their common divisor; one margin is that of the second class."""
    every = [F.lit(0.0), *margins] if len(margins) == 1 else margins
    top = F.greatest(*every)
    log_sum = top + F.log(sum((F.exp(m - top) for m in every[1:]), F.exp(every[0] - top)))
    return [F.exp(m - log_sum) for m in every], log_sum


class _Fit:
    """The written tables of one fit, and the steps on them."""

    def __init__(self, items: DataFrame, texts: int, columns: DataFrame, classes: int, rows: int, penalty: float):
        self.items, self.texts, self.classes = items, texts, classes
        self.size = _block_texts(1 if classes == 2 else classes)
        # frequent columns and the others apart, so that a step reads either once
        self.near = columns.filter("hot").select("index", "block", "cells").unionByName(self._everywhere())
        self.far = columns.filter("not hot").select("index", "block", "cells")
        self.rows, self.penalty = rows, penalty
        self.sent: list = []  # errors whose gradient is still to be written
        self.tracked = [1] if classes == 2 else list(range(classes))
        self.dims = range(len(self.tracked))

    def names(self, *vectors: str) -> list[str]:
        return [f"{v}{k}" for v in vectors for k in self.dims]

    def _everywhere(self) -> DataFrame:
        """The column of the intercepts: every text once."""
        size, texts = self.size, self.texts

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for b in batch.column("block").to_pylist():
                    cells = np.arange(min(size, texts - b * size), dtype=np.int64) << 32 | 1
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([_BIAS], pa.int64()), pa.array([b], pa.int64()), _binary(cells, np.zeros(1, np.int64))],
                        names=["index", "block", "cells"])

        blocks = self.items.sparkSession.range(math.ceil(texts / size)).withColumnRenamed("id", "block")
        return blocks.mapInArrow(run, "index long, block long, cells binary")

    def toward(self, texts: DataFrame, table: DataFrame) -> DataFrame:
        """The texts with ``p...`` summed over their terms as ``d...``, written. Margins are linear in the
        coefficients, so one pass over the columns serves all steps in a direction."""
        p = self.names("p")
        moves = table.select("index", "hot", *[(F.col(c) * F.col("m")).alias(c) for c in p])
        near = self.near.join(F.broadcast(moves.filter("hot").drop("hot")), "index")
        far = self.far.join(moves.filter("not hot").drop("hot"), "index")
        sums = _text_sums(near.unionByName(far), p, self.size, self.texts)
        return materialize(texts.select("key", *self.given(), *self.names("m")).join(sums, "key"), "margins")

    def given(self) -> list[str]:
        return [f"n_{c}" for c in range(self.classes)]

    def _scores(self, margins: list[Column]) -> tuple[list[Column], Column]:
        """Expected less given rows of each tracked class, and the loss, of a text with these margins."""
        shares, log_sum = _softmax(margins)
        own = [F.col(f"n_{c}") for c in self.tracked]
        total = sum((F.col(c) for c in self.given()[1:]), F.col("n_0"))
        loss = total * log_sum - sum((g * m for g, m in zip(own, margins)), F.lit(0.0))
        return [total * shares[c] - g for c, g in zip(self.tracked, own)], loss

    def loss(self, texts: DataFrame, step: float) -> float:
        """The mean loss after a step along ``d...``."""
        return texts.agg(F.sum(self._scores(self._after(step))[1])).first()[0] / self.rows

    def _after(self, step: float) -> list[Column]:
        return [F.col(m) + F.lit(float(step)) * F.col(d) for m, d in zip(self.names("m"), self.names("d"))]

    def errors(self, texts: DataFrame, step: float | None = None) -> DataFrame:
        """The texts with the margins ``m...`` after the step, and ``r...``: expected less given rows of each class;
        written."""
        margins = [F.lit(0.0) for _ in self.dims] if step is None else self._after(step)
        moved = texts.select("key", *self.given(), *[c.alias(m) for c, m in zip(margins, self.names("m"))])
        errors = self._scores([F.col(m) for m in self.names("m")])[0]
        return materialize(moved.select("*", *[e.alias(r) for e, r in zip(errors, self.names("r"))]), "errors")

    def gradient(self, errors: DataFrame) -> DataFrame:
        """``(at, d...)`` per column; the errors of so many blocks of texts at a time are copied to every task."""
        blocks = math.ceil(self.texts / self.size)
        at_once = max(1, SENT // (self.size * len(self.dims)))
        parts = [self._gradient(errors, first, min(first + at_once, blocks)) for first in range(0, blocks, at_once)]
        sums = parts[0]
        for part in parts[1:]:
            sums = sums.unionByName(part)
        return sums.groupBy("at").agg(*[(F.sum(f"d{k}") / self.rows).alias(f"d{k}") for k in self.dims])

    def _gradient(self, errors: DataFrame, first: int, end: int) -> DataFrame:
        """What the texts of the blocks from ``first`` up to ``end`` add to the gradient."""
        size, spark, names = self.size, errors.sparkSession, [f"d{k}" for k in self.dims]
        found = errors.filter((F.col("key") >= first * size) & (F.col("key") < end * size)).select("key", *self.names("r")).toArrow()
        r = np.zeros(((end - first) * size if end * size <= self.texts else self.texts - first * size, len(names)))
        at = found["key"].to_numpy() - first * size
        for k, c in enumerate(self.names("r")):
            r[at, k] = found[c].to_numpy()
        held = spark.sparkContext.broadcast(r)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                at, n, row = _unpacked(batch.column("cells"))
                blocks = batch.column("block").to_numpy(zero_copy_only=False)
                begins = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                sums = np.add.reduceat(held.value[at + (blocks[row] - first) * size] * n[:, None], begins)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("index"), *[pa.array(sums[:, k]) for k in range(len(names))]], names=["at", *names])

        columns = self.near.unionByName(self.far).filter((F.col("block") >= first) & (F.col("block") < end))
        out = columns.mapInArrow(run, ", ".join(["at long", *[f"{d} double" for d in names]]))
        if end * size >= self.texts and not first:
            self.sent.append(held)
            return out
        out = materialize(out, "gradients")
        held.destroy()
        return out

    def inner(self, table: DataFrame, vectors: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Inner products of vectors of the table, over all rows and over those of terms alone."""
        pairs = [(i, j) for i in range(len(vectors)) for j in range(i, len(vectors))]
        sums = [F.sum(F.col("m") * sum((F.col(f"{vectors[i]}{k}") * F.col(f"{vectors[j]}{k}") for k in self.dims), F.lit(0.0)))
                for i, j in pairs]
        own = [F.max(F.when(F.col("index") == _BIAS, F.col(c))) for c in self.names(*vectors)]
        row = list(table.agg(*sums, *own).first())
        out = np.zeros((len(vectors), len(vectors)))
        for (i, j), v in zip(pairs, row):
            out[i, j] = out[j, i] = v
        bias = np.array(row[len(pairs):]).reshape(len(vectors), -1)
        return out, out - bias @ bias.T


def direction(inner: np.ndarray, history: int) -> np.ndarray:
    """Coefficients of the next direction over steps, gradient changes (the newest first) and the gradient."""
    m = history
    out = np.zeros(2 * m + 1)
    out[2 * m] = -1.0
    alphas = []
    for i in range(m):
        alphas.append(out @ inner[:, i] / inner[i, m + i])
        out[m + i] -= alphas[-1]
    if m:
        out *= inner[0, m] / inner[m, m]
    for i in reversed(range(m)):
        out[i] += alphas[i] - out @ inner[:, m + i] / inner[i, m + i]
    return out


def fit_text_linear(
    df: DataFrame, text: str, output: str, classes: int, *, C: float = 1.0, max_iter: int = 100, tol: float = 1e-3,
    min_n: int = 1, max_n: int = 1, hot_terms: int = HOT_TERMS,
) -> TextLinearModel:
    """Minimises the mean log loss plus ``|w|² / (2 C n)`` over the terms of the texts; intercepts are free.

    Rows without a label are left out. Rows of one text count together, with all their labels. The search ends
    after ``max_iter`` steps, when a step gains less than ``tol`` of the loss, or when no step gains.
    """
    rows = df.select(_key(text).alias("key"), F.col(text).alias("text"), F.col(output).cast("int").alias("y"))
    rows = rows.filter("y IS NOT NULL")
    grouped = [F.count_if(F.col("y") == c).cast("double").alias(f"n_{c}") for c in range(classes)]
    # from here on a text goes by its number
    items = materialize(rows.groupBy("key").agg(F.min("text").alias("text"), *grouped).drop("key"), "texts")
    items = materialize(with_row_ids(items, "key"), "texts")
    n = int(items.agg(F.sum(sum((F.col(f"n_{c}") for c in range(1, classes)), F.col("n_0")))).first()[0] or 0)
    if not n:
        raise ValueError(f"column {output} has no labels to learn from")
    texts, size = items.count(), _block_texts(1 if classes == 2 else classes)
    named, columns, marked = _columns(items, texts, size, min_n, max_n, hot_terms)
    spark, fit = df.sparkSession, _Fit(items.drop("text"), texts, columns, classes, n, 1.0 / (C * n))

    own = spark.range(1).select(F.lit(_BIAS).cast("long").alias("index"), F.lit(True).alias("hot"), F.lit(1).cast("long").alias("m"))
    zero = {c: F.lit(0.0) for c in fit.names("w")}
    table = marked.select("index", "hot", "m").unionByName(own).withColumns(
        {"pen": F.when(F.col("index") != _BIAS, fit.penalty).otherwise(0.0)} | zero)
    errors = fit.errors(fit.items)
    table = _with_gradient(fit, table, errors, "gradients")
    history, steps, value = 0, 0, errors.agg(F.sum(fit._scores([F.col(m) for m in fit.names("m")])[1])).first()[0] / n
    while steps < max_iter:
        basis = [*[f"s{i}_" for i in range(history)], *[f"y{i}_" for i in range(history)], "g"]
        inner, of_terms = fit.inner(table, [*basis, "w"])
        inner = inner[:-1, :-1]
        if history and not inner[0, history] > 1e-14:  # the newest step met no curvature
            break
        along = direction(inner, history)
        slope = float(along @ inner[:, -1])
        if not slope < 0:
            break
        step, taken = (1.0 if history else min(1.0, 1.0 / math.sqrt(inner[-1, -1]))), False
        texts = fit.toward(errors, _moved(fit, table, basis, along))
        for _ in range(HALVINGS):
            place = np.append(step * along, 1.0)
            now = fit.loss(texts, step) + 0.5 * fit.penalty * float(place @ of_terms @ place)
            if now <= value + 1e-4 * step * slope:
                taken = True
                break
            step /= 2
        if not taken:
            break
        errors = fit.errors(texts, step)
        moved = _moved(fit, table, basis, step * along)
        moved = moved.withColumns({f"w{k}": F.col(f"w{k}") + F.col(f"p{k}") for k in fit.dims})
        steps += 1
        kept = min(history, HISTORY - 1)
        table = _with_gradient(fit, moved, errors, "gradients", kept)
        history = kept + 1
        gained, value = value - now, now
        if gained < tol * max(abs(now), 1e-12):
            break
    learnt = table.select("index", *fit.names("w"))
    terms = named.join(marked.select("held", "hot", "index"), "held").join(learnt, "index").select("term", "hot", *fit.names("w"))
    alone = learnt.filter(F.col("index") == _BIAS).select(
        F.lit(None).cast("string").alias("term"), F.lit(True).alias("hot"), *fit.names("w"))
    written = materialize(terms.unionByName(alone), "coefficients")
    return TextLinearModel(written, text, min_n, max_n, classes, steps)


def _columns(
    items: DataFrame, texts: int, size: int, min_n: int, max_n: int, hot_terms: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(term, held)``, ``held`` standing for the texts that hold the term and how often; ``(index, hot, block, cells)`` of
    each of these; and ``(held, index, hot, m)``, ``m`` terms having that column. All written."""
    spark = items.sparkSession
    rows = _cells(items, size, min_n, max_n)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the hash first: numbers are sorted faster than texts
    rows = rows.repartition(tasks, "term").sortWithinPartitions(F.xxhash64("term"), "term", "block").mapInArrow(
        _merged, "term string, block long, cells binary").withColumn("held", F.unhex(F.md5("cells")))
    words = materialize(rows, "words")
    if texts > size:
        here = F.concat_ws(":", F.col("block").cast("string"), F.hex("held"))
        named = words.groupBy("term").agg(F.unhex(F.md5(F.array_join(F.array_sort(F.collect_list(here)), ","))).alias("held"))
        named = materialize(named, "vocabulary")
        words = words.drop("held").join(named, "term")
    else:
        named = words.select("term", "held")
    # terms with the same cells in every block
    distinct = materialize(words.groupBy("held", "block").agg(F.first("cells").alias("cells"), F.count("*").alias("m")), "columns")
    found = distinct.groupBy("held").agg(F.max("m").alias("m"), F.sum(F.octet_length("cells")).alias("texts"))
    numbered = with_row_ids(materialize(found, "vocabulary"), "index")
    top = numbered.orderBy(F.desc("texts"), "held").limit(hot_terms).select(F.col("index").alias("top"))
    top = materialize(top, "frequent")
    marked = materialize(numbered.join(F.broadcast(top), F.col("index") == F.col("top"), "left").select(
        "held", "index", F.col("top").isNotNull().alias("hot"), "m"), "vocabulary")
    columns = distinct.drop("m").join(marked, "held").select("index", "hot", "block", "cells")
    return named, materialize(columns.repartition(tasks, "hot", "index").sortWithinPartitions("hot", "block"), "columns"), marked


def _moved(fit: _Fit, table: DataFrame, basis: list[str], along: np.ndarray) -> DataFrame:
    """The table with the move ``p...``, a sum of columns."""
    return table.withColumns({
        f"p{k}": sum((F.col(f"{b}{k}") * float(a) for b, a in zip(basis, along)), F.lit(0.0)) for k in fit.dims})


def _with_gradient(fit: _Fit, table: DataFrame, errors: DataFrame, name: str, kept: int | None = None) -> DataFrame:
    """The table with its gradient, written; after a step also with the step ``s0_`` and the change of the
    gradient ``y0_`` in front of the ``kept`` earlier ones."""
    joined = table.join(fit.gradient(errors), F.col("index") == F.col("at"))
    columns = ["index", "hot", "m", "pen", *fit.names("w")]
    new = {k: F.col(f"d{k}") + F.col("pen") * F.col(f"w{k}") for k in fit.dims}
    out = [new[k].alias(f"g{k}") for k in fit.dims]
    if kept is not None:
        out += [F.col(f"p{k}").alias(f"s0_{k}") for k in fit.dims]
        out += [(new[k] - F.col(f"g{k}")).alias(f"y0_{k}") for k in fit.dims]
        out += [F.col(f"{v}{i}_{k}").alias(f"{v}{i + 1}_{k}") for v in "sy" for i in range(kept) for k in fit.dims]
    written = materialize(joined.select(*columns, *out), name)
    while fit.sent:
        fit.sent.pop().destroy()
    return written
