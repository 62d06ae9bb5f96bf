"""Exact quantiles of many columns, without gathering any column in one task."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ACCURACY = 10_000
COLLECT_VALUES = 2_000


def exact_quantiles(
    df: DataFrame, columns: list[str], probabilities: list[float]
) -> dict[str, list[float]]:
    """Interpolated quantiles (position ``(n - 1) * p``), all columns at once.

    A sketch brackets each position, exact counts tell where it lies inside the bracket, and the
    bracket shrinks ten-thousandfold per round until the few values in it can be fetched.
    """
    values = {c: F.col(c).cast("double") for c in columns}
    first = df.agg(*[F.count(values[c]).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    targets = []
    for i, c in enumerate(columns):
        if first[f"n{i}"] == 0:
            raise ValueError(f"column {c} has no values")
        for p in probabilities:
            at = (first[f"n{i}"] - 1) * p
            targets.append({"c": c, "at": at, "below": 0, "inside": first[f"n{i}"], "lo": None, "hi": None})

    def inside(t):
        v = values[t["c"]]
        return v.isNotNull() if t["lo"] is None else v.between(t["lo"], t["hi"])

    moving = [t for t in targets if t["inside"] > COLLECT_VALUES]
    while moving:
        brackets = []
        for i, t in enumerate(moving):
            k = math.floor(t["at"]) - t["below"]
            low = max(0.0, (k - 1) / t["inside"] - 2 / ACCURACY)
            high = min(1.0, (k + 3) / t["inside"] + 2 / ACCURACY)
            kept = F.when(inside(t), values[t["c"]])
            brackets.append(F.percentile_approx(kept, [low, high], ACCURACY).alias(f"b{i}"))
        row = df.agg(*brackets).first()
        bounds = [tuple(row[f"b{i}"]) for i in range(len(moving))]
        still = []
        for t, (lo, hi) in zip(moving, bounds):
            if (t["lo"], t["hi"]) != (lo, hi):
                t["lo"], t["hi"] = lo, hi
                still.append(t)
        if still:
            row = df.agg(*[
                e
                for i, t in enumerate(still)
                for e in (
                    F.count_if(values[t["c"]] < t["lo"]).alias(f"l{i}"),
                    F.count_if(inside(t)).alias(f"i{i}"),
                )
            ]).first()
            for i, t in enumerate(still):
                t["below"], t["inside"] = row[f"l{i}"], row[f"i{i}"]
        # a bracket that no longer shrinks is full of copies of few values, which is fine as well
        moving = [t for t in still if t["inside"] > COLLECT_VALUES and t["lo"] != t["hi"]]

    picked = F.array_compact(F.array(*[
        F.when(inside(t), F.struct(F.lit(i).alias("t"), values[t["c"]].alias("v")))
        for i, t in enumerate(targets)
    ]))
    found: dict[int, list] = {}
    counted = df.select(F.explode(picked).alias("x")).groupBy("x.t", "x.v").count()
    for t, v, n in counted.collect():  # a few thousand distinct values per target
        found.setdefault(t, []).append((v, n))

    def value_at(i: int, position: int) -> float:
        left = position - targets[i]["below"]
        for v, n in sorted(found[i]):
            if left < n:
                return v
            left -= n
        return v

    out: dict[str, list[float]] = {c: [] for c in columns}
    for i, t in enumerate(targets):
        base = math.floor(t["at"])
        low, part = value_at(i, base), t["at"] - base
        high = value_at(i, base + 1) if part else low
        out[t["c"]].append(low + (high - low) * part)
    return out
