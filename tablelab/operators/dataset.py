"""Row ids, column selection, sampling, paging and description of a dataset."""

from __future__ import annotations

import re

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelab import ROW_ID, SPLIT, messages
from tablelab.session import broadcast_small

RESERVED = (ROW_ID, SPLIT)


# --- row ids -------------------------------------------------------------------------------------


def with_row_ids(df: DataFrame, out: str = ROW_ID) -> DataFrame:
    """Dense 0-based ids of a Parquet scan, in (file, row) order, without moving a row.

    The position inside a file is scan metadata; only one count per file is gathered, a list no
    longer than the file listing that the driver holds anyway.
    """
    located = df.select("*", F.col("_metadata.file_path").alias("_file"),
                        F.col("_metadata.row_index").alias("_at"))
    files = sorted((r[0], r[1]) for r in located.groupBy("_file").count().collect())
    if len(files) <= 1:
        return located.withColumn(out, F.col("_at").cast("long")).drop("_file", "_at")
    starts, total = [], 0
    for path, n in files:
        starts.append((path, total))
        total += n
    offsets = df.sparkSession.createDataFrame(starts, "_file string, _start long")
    return (
        located.join(broadcast_small(offsets, len(files)), "_file")
        .withColumn(out, (F.col("_start") + F.col("_at")).cast("long"))
        .select(*df.columns, out)
    )


def row_ids_by_key(df: DataFrame, key: str, out: str = ROW_ID, buckets: int | None = None) -> DataFrame:
    """Dense 0-based ids in the order of a unique numeric or timestamp key.

    Quantile boundaries become literals, so the bucket of a row is a fixed expression; ids are the
    row number inside the bucket plus the rows of the lower buckets. By default a bucket has about a
    million rows at most.
    """
    buckets = buckets or max(256, df.count() // 1_000_000)
    base = df.withColumn("_kd", _as_double(df, key))
    cuts = base.approxQuantile("_kd", [i / buckets for i in range(1, buckets)], 0.5 / buckets)
    bounds = [float("-inf"), *sorted(set(cuts)), float("inf")]
    bucketed = Bucketizer(splits=bounds, inputCol="_kd", outputCol="_bucket").transform(base)
    lower = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (  # at most `buckets` rows
        bucketed.groupBy("_bucket").count()
        .select("_bucket", F.coalesce(F.sum("count").over(lower), F.lit(0)).alias("_start"))
    )
    inside = Window.partitionBy("_bucket").orderBy(key)
    return (
        bucketed.withColumn("_pos", F.row_number().over(inside))
        .join(starts, "_bucket")
        .withColumn(out, (F.col("_start") + F.col("_pos") - 1).cast("long"))
        .select(*df.columns, out)
    )


def _as_double(df: DataFrame, key: str) -> Column:
    c = F.col(key)
    if isinstance(df.schema[key].dataType, (T.TimestampNTZType, T.DateType)):
        # wall-clock seconds: unlike a cast through a time zone, they never run backwards
        clock = F.hour(c) * 3600 + F.minute(c) * 60 + F.extract(F.lit("SECOND"), c)
        return (F.unix_date(c.cast("date")) * 86400.0 + clock).cast("double")
    return c.cast("double")


def as_dataset(df: DataFrame, row_id: str | None = None, split: str = "train") -> DataFrame:
    """Tag rows with ``_row_id`` and ``split`` unless they carry them already.

    ``row_id`` names a unique non-negative integer column to use as the id; otherwise the frame
    must be a Parquet scan (see ``row_ids_by_key`` for the rest).
    """
    if ROW_ID not in df.columns:
        df = with_row_ids(df) if row_id is None else df.withColumn(ROW_ID, F.col(row_id).cast("long"))
    return df if SPLIT in df.columns else df.withColumn(SPLIT, F.lit(split))


def from_rows(spark: SparkSession, rows, schema=None) -> DataFrame:
    """A dataset from a pandas frame (index ignored) or a list of dicts, as ids 0, 1, 2..."""
    rows = rows.to_dict("records") if hasattr(rows, "to_dict") else list(rows)
    numbered = [{**r, ROW_ID: i, SPLIT: "train"} for i, r in enumerate(rows)]
    if schema is not None:
        schema = T.StructType(
            [*T.StructType.fromDDL(schema).fields, T.StructField(ROW_ID, T.LongType()),
             T.StructField(SPLIT, T.StringType())]
        )
        return spark.createDataFrame(numbered, schema)
    names = list(rows[0]) if rows else []
    return spark.createDataFrame(numbered).select(*names, ROW_ID, SPLIT)


# --- columns -------------------------------------------------------------------------------------


def data_columns(df: DataFrame) -> list[str]:
    """Column names without the row id and the split."""
    return [c for c in df.columns if c not in RESERVED]


def _reserved(df: DataFrame) -> list[str]:
    return [c for c in RESERVED if c in df.columns]


def _require(df: DataFrame, names) -> None:
    unknown = [n for n in names if n not in df.columns]
    if unknown:
        raise ValueError(f"columns not in the dataset: {', '.join(unknown)}")


def select_columns(df: DataFrame, inputs: list[str], outputs: list[str]) -> DataFrame:
    """Inputs and outputs in the requested order; both stay in one frame, so no row can shift."""
    _require(df, [*inputs, *outputs])
    return df.select(*_reserved(df), *inputs, *outputs)


def select_features(df: DataFrame, names: list[str]) -> DataFrame:
    """Keep the named columns, in the order of the dataset."""
    if not isinstance(names, (list, tuple)):
        raise TypeError(f"selected features should be a list, got {type(names)}")
    _require(df, names)
    return df.select([c for c in df.columns if c in names or c in RESERVED])


def remove_columns(df: DataFrame, names: str | list[str]) -> DataFrame:
    """Drop columns; an unknown name is an error."""
    names = [names] if isinstance(names, str) else list(names)
    _require(df, names)
    return df.drop(*names)


def drop_by_index(df: DataFrame, index: int | tuple[int, int]) -> DataFrame:
    """Drop one 0-based column position or an inclusive range; a range past the end is cut short."""
    names = data_columns(df)
    if isinstance(index, int):
        if not 0 <= index < len(names):
            raise ValueError(f"column index {index} is out of range")
        return df.drop(names[index])
    start, end = index
    return df.drop(*names[start : end + 1])


def reindex_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of a training schema: reordered, extras dropped, missing ones null."""
    return df.select(
        *_reserved(df),
        *[
            F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name)
            for f in schema.fields
            if f.name not in RESERVED
        ],
    )


def column_names(df: DataFrame, indexes: list[int]) -> list[str]:
    """Names of 1-based column positions."""
    names = data_columns(df)
    for i in indexes:
        if i > len(names):
            raise ValueError(messages.POSITION_TOO_LARGE.format(i=i))
        if i < 1:
            raise ValueError(f"column positions start at 1, got {i}")
    return [names[i - 1] for i in indexes]


def default_roles(df: DataFrame) -> tuple[list[str], list[str]]:
    """All columns but the last are inputs, the last one is the output."""
    names = data_columns(df)
    return names[:-1], names[-1:]


_RANGES = re.compile(r"\d+(-\d+)?(,\d+(-\d+)?)*")


def parse_ranges(text: str, largest: int) -> list[tuple[int, int]]:
    """``1-3,5`` as inclusive ranges, blanks ignored. Ranges are never expanded to a list of rows."""
    text = text.replace(" ", "")
    if not _RANGES.fullmatch(text):
        raise ValueError(messages.RANGE_FORMAT)
    out = []
    for part in text.split(","):
        low, _, high = part.partition("-")
        start, end = int(low), int(high or low)
        if end > largest or start > largest:
            raise ValueError(messages.RANGE_TOO_LARGE)
        if start > end:
            raise ValueError(messages.RANGE_ORDER)
        out.append((start, end))
    return out


def rows_from_ranges(text: str, total: int) -> list[tuple[int, int]]:
    """1-based row ranges as the user writes them, as 0-based inclusive row id ranges."""
    ranges = parse_ranges(text, total)
    if any(start < 1 for start, _ in ranges):
        raise ValueError("rows are counted from 1")
    return [(start - 1, end - 1) for start, end in ranges]


def ids_in_ranges(row_id: str, ranges: list[tuple[int, int]]) -> Column:
    """Predicate for inclusive id ranges; reaches the scan as plain comparisons."""
    out = F.lit(False)
    for start, end in ranges:
        out = out | F.col(row_id).between(start, end)
    return out


def select_rows(df: DataFrame, ids: DataFrame, row_id: str = ROW_ID) -> DataFrame:
    """Rows whose id is listed in another frame (semi-join)."""
    return df.join(ids, row_id, "left_semi")


def zip_by_row_id(left: DataFrame, right: DataFrame, row_id: str = ROW_ID) -> DataFrame:
    """Put the columns of two row-aligned frames side by side, matched by row id."""
    extra = [c for c in right.columns if c not in left.columns]
    return left.join(right.select(row_id, *extra), row_id)


def concat_splits(*frames: DataFrame) -> DataFrame:
    """Bag union of frames with the same columns, matched by name."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


# --- description ---------------------------------------------------------------------------------


def is_label(field: T.StructField) -> bool:
    """Whether a column holds label codes with names in its metadata."""
    return field.metadata.get("ml_attr", {}).get("type") == "nominal"


def columns_spec(df: DataFrame) -> DataFrame:
    """One row per column: name, kind (``Value`` / ``ClassLabel``) and type. Runs no job."""
    rows = [
        (i, f.name, "ClassLabel" if is_label(f) else "Value", f.dataType.simpleString())
        for i, f in enumerate(df.schema.fields)
        if f.name not in RESERVED
    ]
    return df.sparkSession.createDataFrame(
        rows, "position int, column_name string, kind string, dtype string"
    )


def column_summary(df: DataFrame, row_id: str = ROW_ID) -> DataFrame:
    """``columns_spec`` with the value of each column in the first row."""
    names = data_columns(df)
    first = df.orderBy(row_id).limit(1)
    cells = F.explode(
        F.array(*[
            F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("example"))
            for c in names
        ])
    )
    return columns_spec(df).join(first.select(cells.alias("c")).select("c.*"), "column_name", "left")


def dataset_info(df: DataFrame) -> DataFrame:
    """Rows in total and per split, and the number of columns, in one aggregate."""
    return df.groupBy().agg(
        F.count("*").alias("total_rows"),
        F.lit(len(data_columns(df))).alias("total_columns"),
        *[F.count_if(F.col(SPLIT) == s).alias(f"{s}_rows") for s in ("train", "test", "validation")],
    )


def validate_inputs_outputs(df: DataFrame, inputs: list[str], outputs: list[str]) -> None:
    """Inputs and outputs must be non-empty, exist, and not outnumber the columns."""
    names = data_columns(df)
    if not inputs or not outputs:
        raise ValueError(messages.NO_ROLES)
    if len(inputs) + len(outputs) > len(names):
        raise ValueError(
            messages.TOO_MANY_ROLES.format(inputs=len(inputs), outputs=len(outputs), names=len(names))
        )
    extra = [c for c in [*inputs, *outputs] if c not in names]
    if extra:
        raise ValueError(messages.UNKNOWN_ROLES.format(extra=", ".join(extra)))


# --- samples and pages ---------------------------------------------------------------------------


def sample(
    df: DataFrame, n: int = 1, method: str = "head", seed: int = 0, row_id: str = ROW_ID
) -> DataFrame:
    """First, last or ``n`` random rows (with replacement) of a dataset with dense ids.

    A random row drawn twice is returned twice. Draws are md5-based, so they can be repeated
    exactly; the i-th draw is ``md5(seed:i) mod rows``. The first and last rows are found by their
    ids, which may have gaps, and come in the order of the ids.
    """
    from tablelab.operators.ranks import cut_points, id_key

    total, low, high = df.agg(F.count("*"), F.min(row_id), F.max(row_id)).first()
    if n > total:
        raise ValueError(messages.SAMPLE_TOO_LARGE.format(n=n, total=total))
    if method in ("head", "tail"):
        if total and high - low + 1 == total:
            wanted = F.col(row_id) < low + n if method == "head" else F.col(row_id) > high - n
        else:
            at = n if method == "head" else total - n
            cut = cut_points(df, id_key(row_id), lambda _: [at]).get("", [""])[0]
            wanted = id_key(row_id) < cut if method == "head" else id_key(row_id) >= cut
        return df.filter(wanted).orderBy(row_id)
    if method == "random":
        digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id"))), 1, 15)
        drawn = F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(total))
        draws = df.sparkSession.range(n).select(F.col("id").alias("draw"), drawn.alias(row_id))
        return df.join(draws, row_id)
    raise ValueError(f"method must be head, tail or random, got {method}")


def sample_without_replacement(
    df: DataFrame, n: int, seed: int = 0, row_id: str = ROW_ID
) -> DataFrame:
    """``n`` different rows: the ones with the smallest ``md5(seed:row_id)``; all if there are fewer.

    The key of the first row left out is counted out, so the sample is a narrow filter.
    """
    from tablelab.operators.ranks import cut_points, hash_key

    key = hash_key(seed, row_id)
    return df.filter(key < cut_points(df, key, lambda total: [min(n, total)]).get("", [""])[0])


def page(df: DataFrame, size: int, number: int = 0, by: str = ROW_ID) -> DataFrame:
    """A page of the newest-first listing."""
    return df.orderBy(F.desc(by)).offset(size * number).limit(size)
