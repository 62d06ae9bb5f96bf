"""Train / test / validation splits with exact sizes, as narrow expressions over the row id."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelab import ROW_ID, SPLIT
from tablelab.operators.dataset import ids_in_ranges
from tablelab.operators.ranks import PAST_THE_END, cut_points, hash_key, hash_rank, id_key


def check_split_values(train: float, test: float, validation: float) -> None:
    """Each fraction must lie in [0, 1] and all three must add up to 1."""
    for name, value in (("train_size", train), ("test_size", test), ("val_size", validation)):
        if not 0 <= value <= 1:
            raise ValueError(f"{name} should be in the [0, 1] range, got {value}")
    if abs(train + test + validation - 1) > 1e-9:
        raise ValueError(f"split sizes should add up to 1, got {train + test + validation}")


def split_sizes(n: int, train: float, test: float, validation: float) -> tuple[int, int, int]:
    """Exact row counts: train first, then test and validation share the rest."""
    n_train = math.floor(train * n + 1e-9)
    rest = n - n_train
    share = test / (test + validation) if test + validation > 0 else 0.0
    n_test = math.floor(share * rest + 1e-9)
    return n_train, n_test, rest - n_test


def _named(key: Column, first: Column, second: Column) -> Column:
    return F.when(key < first, "train").when(key < second, "test").otherwise("validation")


def split_exact(
    df: DataFrame,
    train: float,
    test: float,
    validation: float,
    seed: int = 0,
    shuffle: bool = True,
    stratify: str | None = None,
    row_id: str = ROW_ID,
) -> DataFrame:
    """Add a ``split`` column whose sizes are exact, overall or within each ``stratify`` value.

    Shuffled rows are ordered by ``md5(seed:row_id)``, unshuffled ones by the row id. Without
    ``stratify`` only the two boundary keys are searched for; the rows are never sorted or shuffled.
    There may be any number of strata; null is one of its own.
    """
    check_split_values(train, test, validation)
    key = hash_key(seed, row_id) if shuffle else id_key(row_id)

    def positions(n: int) -> list[int]:
        n_train, n_test, _ = split_sizes(n, train, test, validation)
        return [n_train, n_train + n_test]

    if stratify is None:
        found = cut_points(df, key, positions)
        if not found:  # no rows, nothing to cut
            return df.withColumn(SPLIT, F.lit("train"))
        first, second = found[""]
        return df.withColumn(SPLIT, _named(key, F.lit(first), F.lit(second)))

    # ranks over the two key columns only; they meet the rows again as two boundary keys per stratum
    keys = df.select(F.col(stratify).alias("_s"), key.alias("_k"))
    count = F.count("*").alias("_n")
    ranked = hash_rank(keys, F.col("_k"), within=["_s"], out="_rank").join(
        keys.groupBy(F.col("_s").alias("_t")).agg(count), F.col("_s").eqNullSafe(F.col("_t")))
    n_train = F.floor(F.lit(float(train)) * F.col("_n") + 1e-9)
    share = test / (test + validation) if test + validation > 0 else 0.0
    n_both = n_train + F.floor(F.lit(float(share)) * (F.col("_n") - n_train) + 1e-9)

    def boundary(position: Column) -> Column:
        return F.coalesce(F.min(F.when(F.col("_rank") >= position, F.col("_k"))), F.lit(PAST_THE_END))

    cuts = ranked.groupBy("_s").agg(boundary(n_train).alias("_first"), boundary(n_both).alias("_second"))
    return (
        df.join(cuts, F.col(stratify).eqNullSafe(F.col("_s")), "left")
        .withColumn(SPLIT, _named(key, F.col("_first"), F.col("_second")))
        .drop("_s", "_first", "_second")
    )


def split_approximate(
    df: DataFrame, train: float, test: float, validation: float, seed: int = 0, row_id: str = ROW_ID
) -> DataFrame:
    """One-pass variant: sizes hold in expectation only, membership is a hash threshold."""
    check_split_values(train, test, validation)
    unit = F.conv(F.substring(hash_key(seed, row_id), 1, 13), 16, 10).cast("double") / float(1 << 52)
    return df.withColumn(SPLIT, _named(unit, F.lit(train), F.lit(train + test)))


def split_by_ranges(
    df: DataFrame,
    train: list[tuple[int, int]],
    test: list[tuple[int, int]],
    validation: list[tuple[int, int]],
    allow_overlap: bool = False,
    row_id: str = ROW_ID,
) -> DataFrame:
    """Splits from lists of inclusive row id ranges; rows in no list vanish.

    With ``allow_overlap`` a row listed twice is returned once per split.
    """
    chosen = {"train": train, "test": test, "validation": validation}
    if not allow_overlap:
        flat = sorted(r for ranges in chosen.values() for r in ranges)
        for (_, end), (start, _) in zip(flat, flat[1:]):
            if start <= end:
                raise ValueError(f"row {start} is listed more than once")
    names = [
        F.when(ids_in_ranges(row_id, ranges), F.lit(name))
        for name, ranges in chosen.items()
        if ranges
    ]
    listed = F.array_compact(F.array(*names))
    return df.withColumn(SPLIT, F.explode(listed))


def resplit(df: DataFrame, spec: dict, row_id: str = ROW_ID) -> DataFrame:
    """Split again a dataset that already has splits, at random or from row ranges.

    ``spec`` holds either ``train``/``test``/``validation`` fractions (plus ``seed``, ``shuffle``,
    ``stratify``) or, under ``ranges``, one list of ranges per split.
    """
    rows = df.drop(SPLIT)
    if "ranges" in spec:
        r = spec["ranges"]
        return split_by_ranges(
            rows, r.get("train", []), r.get("test", []), r.get("validation", []),
            spec.get("allow_overlap", False), row_id,
        )
    return split_exact(
        rows, spec["train"], spec["test"], spec["validation"], seed=spec.get("seed", 0),
        shuffle=spec.get("shuffle", True), stratify=spec.get("stratify"), row_id=row_id,
    )
