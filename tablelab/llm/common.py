"""Helpers shared by the operators: scans in Arrow batches, fixed-size filters, bounded groups and
connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablelab.session import materialize

# Rows of one block of a group; a larger group is compared block by block.
BLOCK_ROWS = 512
# Bits of a membership filter that is copied to every executor: 8 MB, whatever the input.
FILTER_BITS = 1 << 26
# Entries of a task's word cache before it starts anew.
CACHE_ENTRIES = 200_000

MIX = np.uint64(0x9E3779B97F4A7C15)
SECOND = np.uint64(0xC2B2AE3D27D4EB4F)
THIRD = np.uint64(0x165667B19E3779F9)


class WordHashes(dict):
    """64-bit hash of each word (str or bytes), remembered while the cache is small."""

    def __missing__(self, word):
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, 42)
        return value

    def array(self, words) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def hashed_grams(h: np.ndarray, bits: int, skips: bool = False) -> np.ndarray:
    """Buckets of the words, word pairs and, with ``skips``, pairs that leave out one word."""
    shift = np.uint64(64 - bits)
    parts = [h * MIX, (h[:-1] * SECOND + h[1:]) * MIX]
    if skips:
        parts.append((h[:-2] * THIRD + h[2:]) * MIX)
    return (np.concatenate(parts) >> shift).astype(np.int64)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of a text column; null is the empty text."""
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]


def text_marks(values: list[bytes]) -> np.ndarray:
    """A 64-bit number per text, which tells texts of one id apart."""
    return np.array([xxhash.xxh64_intdigest(t, 42) for t in values], np.uint64).view(np.int64)


def text_mark(column: str = "text") -> Column:
    """The same number as ``text_marks``."""
    return F.xxhash64(F.coalesce(F.col(column), F.lit("")))


def numbered(documents: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The same rows under names ``c0_``, ``c1_``, ... and the new name of each column, so that no column of the
    input can clash with one that an operator adds, whatever it is called."""
    names = {c: f"c{i}_" for i, c in enumerate(documents.columns)}
    return documents.toDF(*names.values()), names


def arrow_map(df: DataFrame, per_batch: Callable[[], Callable], schema: str) -> DataFrame:
    """``per_batch()`` is called once per task and gives a function from a record batch to a dict
    of columns (or None). Only the batch at hand is held."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = per_batch()
        for batch in batches:
            # long texts: a few hundred documents at a time keep the working memory small
            for start in range(0, batch.num_rows, 1000):
                out = step(batch.slice(start, 1000))
                if out is not None:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(out[f.name], f.type, from_pandas=True) if not isinstance(out[f.name], pa.Array)
                         else out[f.name].cast(f.type) for f in target],
                        schema=target)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def whole_groups(frames: Iterable[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Frames that hold whole groups, from frames sorted by ``key``."""
    held: list[pd.DataFrame] = []
    for f in frames:
        if f.empty:
            continue
        k = f[key].to_numpy()
        cut = int(np.searchsorted(k, k[-1], "left"))
        if cut or (held and held[-1][key].iloc[-1] != k[0]):
            yield pd.concat([*held, f.iloc[:cut]], ignore_index=True)
            held = []
        held.append(f.iloc[cut:])
    if held:
        yield pd.concat(held, ignore_index=True)


def bounded_groups(rows: DataFrame, key: str, item: str, most: int = BLOCK_ROWS, size: str | None = None) -> DataFrame:
    """Adds ``g``: rows of one ``key`` meet in groups ``g`` of at most about ``2 * most`` rows.

    A key of more rows is cut into blocks by a hash of ``item``, and each pair of blocks becomes a
    group of its own, so any two rows of a key share a group and no task holds a large one. Keys of
    one row are left out. ``size`` names a column with the rows of each key, if there is one. Two groups may share ``g`` by a hash collision: what meets in a group has
    to be verified anyway.
    """
    if size:
        met = rows.withColumn("n_", F.col(size)).filter("n_ > 1")
    else:
        sizes = rows.groupBy(F.col(key).alias("k_")).agg(F.count("*").alias("n_")).filter("n_ > 1")
        met = rows.join(sizes, rows[key] == sizes["k_"])
    blocks = F.ceil(F.col("n_") / most).cast("int")
    met = met.withColumn("b_", F.pmod(F.xxhash64(item), blocks).cast("int"))
    met = met.withColumn("o_", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return met.withColumn("g", F.xxhash64(key, F.least("b_", "o_"), F.greatest("b_", "o_"))).drop(
        "k_", "n_", "b_", "o_")


def in_groups(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame | None], schema: str) -> DataFrame:
    """Apply ``fn`` to frames of whole groups ``g``; far cheaper than a call per group."""

    def run(frames):
        for f in whole_groups(frames, "g"):
            out = fn(f)
            if out is not None and len(out):
                yield out

    return df.repartition("g").sortWithinPartitions("g").mapInPandas(run, schema)


def bit_filter(values: DataFrame, column: str, bits: int = FILTER_BITS) -> np.ndarray:
    """Which ``column mod bits`` occur, as a bitmap of fixed size (bytes, lowest bit first).

    A filter may let others through, so it only thins out what is sent on; an exact join follows.
    """
    at = F.pmod(F.col(column), F.lit(bits))
    rows = (
        values.select(at.alias("p"))
        .groupBy(F.expr("bitmap_bucket_number(p)").alias("b"))
        .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("m"))
        .collect()
    )
    out = np.zeros(bits // 8 + 4096, np.uint8)
    for r in rows:
        # bucket b holds the positions (b - 1) * 32768 + 1 ... b * 32768
        out[r["b"] * 4096:(r["b"] + 1) * 4096] |= np.frombuffer(r["m"], np.uint8)
    return out


def passes(filter_: np.ndarray, values: np.ndarray, bits: int = FILTER_BITS) -> np.ndarray:
    """Whether each (int64) value may be in a ``bit_filter``."""
    p = np.mod(values.astype(np.int64), np.int64(bits))
    bucket, place = _bitmap_place(p)
    return (filter_[bucket * 4096 + (place >> 3)] >> (place & 7).astype(np.uint8)) & 1 == 1


def _bitmap_place(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and bit position of Spark's bitmap functions."""
    bucket = np.where(p > 0, 1 + (p - 1) // 32768, p // 32768)
    place = np.where(p > 0, (p - 1) % 32768, (-p) % 32768)
    return bucket, place


def local_stars(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest row linked to each of ``n`` rows, through the links ``a``-``b``."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = np.minimum(new, new[new])
        if np.array_equal(new, label):
            break
        label = new
    return label


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of every node of the edges ``(a, b)``: the smallest node reachable.

    Large-star and small-star rounds. A node's links are never gathered: each round takes minima
    (combined before the shuffle) and joins them back. Each round is written, so a lost executor
    repeats a round at most.
    """
    pairs = materialize(
        edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi <> lo").distinct(),
        "edges")
    seen = None
    while True:
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        both = pairs.select(F.explode(F.array(
            F.struct(F.col("hi").alias("u"), F.col("lo").alias("v")),
            F.struct(F.col("lo").alias("u"), F.col("hi").alias("v")))).alias("e")).select("e.*")
        least = both.groupBy(F.col("u").alias("w")).agg(F.least("w", F.min("v")).alias("m"))
        large = (both.filter("v > u").join(least, F.col("u") == F.col("w"))
                 .select(F.col("v").alias("hi"), F.col("m").alias("lo")).filter("hi <> lo").distinct())
        least = large.groupBy(F.col("hi").alias("w")).agg(F.min("lo").alias("m"))
        small = (large.join(least, F.col("hi") == F.col("w"))
                 .select(F.explode(F.array(
                     F.struct(F.col("hi"), F.col("m").alias("lo")),
                     F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e")).select("e.*")
                 .filter("hi <> lo").distinct())
        pairs = materialize(small, "stars")
    return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
        pairs.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())


def hashed_share(column: str, rows: int, most: int) -> Column:
    """Rows of a deterministic sample of about ``most`` of ``rows`` rows; all of them if fewer."""
    share = 1.0 if rows <= most else most / rows
    return F.pmod(F.xxhash64(F.col(column), F.lit(7)), F.lit(1_000_000)) < F.lit(int(share * 1_000_000))


def smallest_per(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key: the first in ``order``."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("r_", F.row_number().over(w)).filter("r_ = 1").drop("r_")
