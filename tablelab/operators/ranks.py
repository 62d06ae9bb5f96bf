"""Exact ranks and cut points without sorting everything in one task.

Ordering keys are hexadecimal text (an md5, or a zero-padded id), whose prefixes are ordered like
the keys themselves. Counting rows per prefix therefore finds any order statistic with a few
narrow aggregations, and splits a global rank into many small windows. Everything is a
deterministic expression over the input, so a recomputed task always gives the same answer.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablelab import ROW_ID
from tablelab.operators.dataset import with_row_ids
from tablelab.session import materialize

# Above every hexadecimal digit: a cut that no key reaches.
PAST_THE_END = "~"


def hash_key(seed, *columns) -> Column:
    """Pseudo-random ordering key: md5 of ``seed:column:column...``."""
    parts = [F.lit(str(seed))]
    parts += [(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]
    return F.md5(F.concat_ws(":", *parts))


def id_key(column=ROW_ID) -> Column:
    """Ordering key of a non-negative long, as 16 hexadecimal digits."""
    c = F.col(column) if isinstance(column, str) else column
    return F.lpad(F.hex(c.cast("long")), 16, "0")


def cut_points(
    df: DataFrame,
    key: Column,
    positions: Callable[[int], list[int]],
    stratum: Column | None = None,
    digits: int = 4,
) -> dict:
    """Keys that cut each stratum after exactly the wanted numbers of rows.

    ``positions(n)`` gives the wanted row counts for a stratum of ``n`` rows. Returns
    ``{stratum: [cut, ...]}``: the rows whose key is below ``cut`` are the first ``position`` ones.
    Each pass reads the key columns only. The first returns at most 256 counts per stratum, later
    ones at most ``16**digits`` per open cut.
    """
    stratum = F.lit("") if stratum is None else stratum.cast("string")
    keys = df.select(F.coalesce(stratum, F.lit("")).alias("s"), key.alias("k"))
    cuts: dict = {}
    # (stratum, index of the cut) -> (prefix known so far, rows still to take inside it)
    open_cuts: dict = {}
    width = 0
    while width == 0 or open_cuts:
        rows = keys
        if open_cuts:
            wanted = sorted({f"{s}\x00{prefix}" for (s, _), (prefix, _) in open_cuts.items()})
            inside = F.concat(F.col("s"), F.lit("\x00"), F.substring("k", 1, width))
            rows = keys.filter(inside.isin(wanted))
        first = width == 0
        width += 2 if first else digits
        counted = rows.groupBy("s", F.substring("k", 1, width).alias("p")).count()
        by_stratum: dict = {}
        for s, p, n in counted.collect():
            by_stratum.setdefault(s, []).append((p, n))
        if first:
            for s, buckets in by_stratum.items():
                targets = positions(sum(n for _, n in buckets))
                cuts[s] = [None] * len(targets)
                open_cuts.update({(s, i): ("", t) for i, t in enumerate(targets)})
        for (s, i), (prefix, remaining) in list(open_cuts.items()):
            for p, n in sorted(b for b in by_stratum[s] if b[0].startswith(prefix)):
                if remaining < n:
                    break
                remaining -= n
            else:
                p, remaining = PAST_THE_END, 0
            if remaining == 0:
                cuts[s][i] = p
                del open_cuts[(s, i)]
            else:
                open_cuts[(s, i)] = (p, remaining)
    return cuts


def _prefix_digits(n: int) -> int:
    """Digits that leave a few hundred thousand rows per window at most."""
    digits = 1
    while digits < 5 and n >> (4 * digits) > 200_000:
        digits += 1
    return digits


def hash_rank(
    df: DataFrame, key: Column, within: list[str] | None = None, n: int | None = None,
    out: str = "rank",
) -> DataFrame:
    """0-based rank by a hexadecimal key inside each ``within`` group.

    Rows are windowed per key prefix (uniform for an md5), then shifted by the number of rows in
    lower prefixes, so no window ever covers a whole group. Null is a group of its own.
    """
    within = within or []
    n = df.count() if n is None else n
    digits = _prefix_digits(n)
    # rows travel with the key's bytes, half as many as its digits and in the same order
    keyed = df.withColumn("_key", key).withColumn("_prefix", F.substring("_key", 1, digits)).withColumn("_key", F.unhex("_key"))
    lower = Window.partitionBy(*within).orderBy("_prefix").rowsBetween(
        Window.unboundedPreceding, -1
    )
    group = [*within, "_prefix"]
    offsets = (
        keyed.groupBy(*group)
        .count()
        .select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)],
                F.coalesce(F.sum("count").over(lower), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy(*group).orderBy("_key")
    same = [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(group)]  # null is a group too
    return (
        keyed.withColumn("_pos", F.row_number().over(inside))
        .join(offsets, same)
        .withColumn(out, (F.col("_pos") - 1 + F.col("_before")).cast("long"))
        .drop("_key", "_prefix", "_pos", "_before", *[f"_g{i}" for i in range(len(group))])
    )


def sorted_index(df: DataFrame, column: str, out: str = "index") -> DataFrame:
    """0-based position of each (distinct) value in sort order.

    The values are range-partitioned, sorted and written once; distinct values always divide into
    even ranges, however many share a prefix. The position is then file order plus row number, both
    read from the scan, so nothing is ranked in a window.
    """
    ordered = df.repartitionByRange(column).sortWithinPartitions(column)
    return with_row_ids(materialize(ordered, "sorted"), out)
