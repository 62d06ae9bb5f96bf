"""Mixing sources to target weights.

Every document gets a hash-random key. Documents are range-sorted by source and key, running totals of
their sizes are summed up range by range, and each source is cut at its exact budget of words: a source
whose budget exceeds its size is gone through again from the start. All steps are DataFrame operations.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablelab.session import broadcast_small, materialize

WEIGHTS = (5, 2, 1)
# Words of the mix as a fraction of all words, and how often a source may be gone through at most.
SHARE = (3, 2)
EPOCHS = 2
# Fixed value: what counts as a word.
WORD = r"[^\x20\x09-\x0D]+"
SEED = 11
# Ranges per shuffle partition, so that ranges dealt out by a hash spread evenly; fewer for few rows.
RANGES = 4
RANGE_ROWS = 4096


def whole(value) -> Column:
    """Whole numbers of up to 38 digits: products of totals overflow a long."""
    return (F.col(value) if isinstance(value, str) else F.lit(value)).cast("decimal(38,0)")


def running_totals(rows: DataFrame, group: list[str], order: list[str], sums: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Sums over the rows before each row, by ``order`` within ``group``, for groups of any size.

    Returns the rows, range-sorted into parts ``part_`` and written, with the sum of the earlier rows of
    their group and part for each ``out: value`` of ``sums``; and one row per part and group that holds
    what the group's earlier parts add to it (``out`` with ``_base`` behind). No window spans more than
    a part. Nulls come last. ``order`` has to tell all rows apart that differ; ``rows`` are read three
    times and so had better be written.
    """
    spark = rows.sparkSession
    most = RANGES * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    parts = min(most, 1 + rows.count() // RANGE_ROWS)
    by = [F.col(c).asc_nulls_last() for c in [*group, *order]]
    dealt = materialize(rows.repartitionByRange(parts, *by).withColumn("part_", F.spark_partition_id()), "ranges")
    earlier = Window.partitionBy("part_", *group).orderBy(*by[len(group):]).rowsBetween(Window.unboundedPreceding, -1)
    within = dealt.withColumns({out: F.coalesce(F.sum(v).over(earlier), F.lit(0)) for out, v in sums.items()})
    ahead = (Window.partitionBy(*(group or [F.lit(0)])).orderBy("part_")
             .rowsBetween(Window.unboundedPreceding, -1))
    totals = dealt.groupBy("part_", *group).agg(*[F.sum(v).alias(f"{out}_base") for out, v in sums.items()])
    bases = totals.withColumns(
        {f"{out}_base": F.coalesce(F.sum(f"{out}_base").over(ahead), F.lit(0)) for out in sums})
    return within, materialize(bases, "bases")


def on_part(rows: DataFrame, bases: DataFrame, group: list[str]) -> DataFrame:
    """Rows of ``running_totals`` beside their part's and group's row; a part keeps large groups apart."""
    keys = ["part_", *group]
    right = bases.withColumnsRenamed({k: f"{k}__" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"{k}__")) for k in group]
    return rows.join(broadcast_small(right, bases.count()), [F.col("part_") == F.col("part___"), *same]).drop(
        *[f"{k}__" for k in keys])


def source_targets(sources: DataFrame, weights=WEIGHTS, share=SHARE, epochs: int = EPOCHS) -> DataFrame:
    """``(source, source_size, target, budget)`` from distinct ``(source, source_size)``.

    Sources by code point, null last, take the weights in turn. A source is full if it meets
    ``epochs`` times its size no later than the common level rises that far; levels are compared in whole
    numbers. The other sources share by weight what the full ones leave. ``budget`` is the target, cut to
    whole words.
    """
    kinds = F.array(*[F.lit(w) for w in weights])
    ranked = on_part(*running_totals(sources.withColumn("one_", F.lit(1)), [], ["source"], {"rank": "one_"}), [])
    unit = math.lcm(*weights)
    weighed = ranked.select(
        "source", "source_size",
        F.element_at(kinds, ((F.col("rank") + F.col("rank_base")) % len(weights) + 1).cast("int")).alias("weight"))
    weighed = weighed.withColumn("level", whole("source_size") * whole(F.lit(unit) / F.col("weight")))
    rising = on_part(*running_totals(weighed, [], ["level", "source"], {"below": "source_size", "heavy": "weight"}), [])
    total, all_weights = (x or 0 for x in rising.agg(F.sum("source_size"), F.sum("weight")).first())
    up, down = share
    below = whole("below") + whole("below_base")
    lighter = whole(all_weights) - whole("heavy") - whole("heavy_base") - whole("weight")
    needed = whole(down * epochs) * ((below + whole("source_size")) * whole("weight") + whole("source_size") * lighter)
    filled = materialize(
        rising.withColumn("full", needed <= whole(up) * whole(total) * whole("weight")), "sources")
    full, free = filled.agg(
        F.sum(F.when(F.col("full"), F.col("source_size"))), F.sum(F.when(~F.col("full"), F.col("weight")))).first()
    rest = up * total - down * epochs * (full or 0)
    over = max(1, down * (free or 0))
    part = whole("weight") * whole(rest)
    return filled.select(
        "source", "source_size",
        F.when(F.col("full"), (whole(epochs) * whole("source_size")).cast("double"))
        .otherwise(part.cast("double") / F.lit(float(over))).alias("target"),
        F.when(F.col("full"), epochs * F.col("source_size"))
        .otherwise(F.floor(part / whole(over)).cast("long")).alias("budget"))


def mix(documents: DataFrame, weights=WEIGHTS, share=SHARE, epochs: int = EPOCHS) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` per row of ``(doc_id, text, source)``.

    ``size`` counts words; ``taken`` is how many of them the mix takes: whole passes through the source,
    and in the last one the documents in the order of their keys up to the budget, whose last document is
    cut. So each source takes its target to the word, and no document more than ``epochs`` times its size.
    Null and empty texts have size 0 and null sources are a source of their own. Rows that share an id are
    rows of their own; equal rows are interchangeable, so reruns give the same rows. An empty table gives
    none. Other columns are not read.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    key = F.md5(F.concat_ws(":", F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
                            F.coalesce("text", F.lit(""))))
    keyed = materialize(documents.select("doc_id", "source", size.alias("size"), key.alias("key")), "keyed")
    sources = materialize(keyed.groupBy("source").agg(F.sum("size").alias("source_size")), "sizes")
    targets = source_targets(sources, weights, share, epochs)
    # equal rows may stand in any order; their number only lets a range end between them
    rows, bases = running_totals(
        keyed.withColumn("copy", F.monotonically_increasing_id()), ["source"], ["key", "copy"], {"before": "size"})
    named = targets.withColumnRenamed("source", "source__")
    bases = materialize(
        bases.join(named, F.col("source").eqNullSafe(F.col("source__"))).drop("source__"), "targets")
    passes = F.when(F.col("source_size") > 0, F.floor(F.expr("budget div source_size"))).otherwise(0)
    rest = F.col("budget") - passes * F.col("source_size")
    last = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before") - F.col("before_base")))
    return on_part(rows, bases, ["source"]).select(
        "doc_id", "size", "source_size", "target", (passes * F.col("size") + last).cast("long").alias("taken"))
