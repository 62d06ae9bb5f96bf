"""Vector code compression by ball k-means.

Vectors become whole numbers, are cut into equal parts, and each part is coded by the nearest entry of its
position's codebook. All arithmetic is exact.

After the first assignment a part is not compared with every entry. The members of an entry form a ball
around it; only entries nearer than twice its radius are its neighbours. A member nearer than half the
way to the closest neighbour lies in the stable core and stays. The others lie in rings, by the number of
neighbours within twice their distance, and are compared with these candidates alone.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from tablelab.session import broadcast_small, materialize

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
# Members of a ball that are compared at once; they share the candidates of the outermost of them.
RING_ROWS = 64


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``a`` and ``b`` (whole numbers)."""
    most = max(int(np.abs(a).max(initial=0)), int(np.abs(b).max(initial=0)))
    reach = a.shape[1] * (2 * most) ** 2
    if reach < 1 << 53:  # sums of products are exact in doubles
        x, y = a.astype(np.float64), b.astype(np.float64)
        d = (x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)
        return d.astype(np.int64)
    if reach < 1 << 63:
        return np.stack([((a - row) ** 2).sum(1) for row in b], 1)
    raise ValueError("components are too large for exact squared distances in 64 bits")


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each row, ties to the lower index, and its squared distance."""
    d = squared_distances(x, book)
    code = d.argmin(1)
    return code, d[np.arange(len(x)), code]


class Balls:
    """The entries of one codebook, each with the others in order of their distance."""

    def __init__(self, book: np.ndarray):
        self.book = book
        between = squared_distances(book, book)
        np.fill_diagonal(between, -1)  # itself first
        self.order = between.argsort(1, kind="stable")[:, 1:]
        self.between = np.take_along_axis(between, self.order, 1)
        self.compared = 0

    def reassign(self, x: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``nearest(x, book)``, from the entries that the rows had before."""
        own = ((x - self.book[code]) ** 2).sum(1)
        new, error = code.copy(), own.copy()
        by_ball = np.lexsort((own, code))
        edges = np.flatnonzero(np.diff(code[by_ball], prepend=-1, append=-1))
        for begin, end in zip(edges[:-1], edges[1:]):
            entry = code[by_ball[begin]]
            members = by_ball[begin:end]  # the nearest first; the last one's distance is the radius
            # neighbours that may be as near as the entry: half the way to them is no more than the distance
            rings = np.searchsorted(self.between[entry], 4 * own[members], "right")
            for at in range(int(np.searchsorted(rings, 1)), len(members), RING_ROWS):
                some = members[at:at + RING_ROWS]
                candidates = np.sort(np.append(self.order[entry, :rings[at + len(some) - 1]], entry))
                self.compared += len(some) * len(candidates)
                k, error[some] = nearest(x[some], self.book[candidates])
                new[some] = candidates[k]
        return new, error


def _whole_numbers(column: pa.Array, width: int) -> np.ndarray:
    lengths = pc.list_value_length(column)
    if len(column) and (pc.min(lengths).as_py() != width or pc.max(lengths).as_py() != width):
        raise ValueError(f"vectors of different lengths: {width} components expected")
    values = np.asarray(column.flatten())
    if values.dtype.kind == "f":
        values = np.floor(values.astype(np.float64) * SCALE)
        if len(values) and np.abs(values).max() >= 1 << 62:
            raise ValueError("components are too large for exact squared distances in 64 bits")
        values = values.astype(np.int64)
    return values.reshape(-1, width)


def _assign(rows: DataFrame, books: list[np.ndarray], first: bool) -> DataFrame:
    """Assigns all parts of ``rows`` and writes the result: a row per vector, and a row per task and
    used entry (``entry`` counts through the parts) with the number and the sum of its parts."""
    width = sum(b.shape[1] for b in books)
    step, entries = width // len(books), len(books[0])
    schema = StructType([
        rows.schema["vec_id"], rows.schema["label"], StructField("numbers", ArrayType(LongType())),
        StructField("codes", BinaryType()), StructField("error", LongType()),
        StructField("entry", IntegerType()), StructField("n", LongType()), StructField("total", ArrayType(LongType()))])
    target = to_arrow_schema(schema)

    def lists(a: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(np.arange(0, a.size + 1, a.shape[1], dtype=np.int32), pa.array(a.ravel()))

    def out(length: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [columns[f.name].cast(f.type) if f.name in columns else pa.nulls(length, f.type) for f in target], schema=target)

    def run(batches):
        balls = [Balls(b) for b in books]
        count = np.zeros((len(books), entries), np.int64)
        total = np.zeros((len(books), entries, step), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _whole_numbers(batch.column("embedding" if first else "numbers"), width)
            old = None if first else np.frombuffer(
                b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(-1, len(books))
            codes, error = np.empty((len(x), len(books)), np.uint8), np.zeros(len(x), np.int64)
            for p, ball in enumerate(balls):
                part = np.ascontiguousarray(x[:, p * step:(p + 1) * step])
                code, far = nearest(part, ball.book) if first else ball.reassign(part, old[:, p].astype(np.int64))
                codes[:, p] = code
                error += far
                count[p] += np.bincount(code, minlength=entries)
                np.add.at(total[p], code, part)
            yield out(len(x), vec_id=batch.column("vec_id"), label=batch.column("label"), numbers=lists(x),
                      codes=pa.array([c.tobytes() for c in codes], pa.binary()), error=pa.array(error))
        p, e = np.nonzero(count)
        if len(p):
            yield out(len(p), entry=pa.array(p * entries + e), n=pa.array(count[p, e]), total=lists(total[p, e]))

    return materialize(rows.mapInArrow(run, schema), "codes")


def _means(assigned: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """Codebooks moved to the means of their parts, rounded down; unused entries stay."""
    step, entries = books[0].shape[1], len(books[0])
    sums = [F.sum(F.col("total")[i]).alias(f"s{i}") for i in range(step)]
    out = [b.copy() for b in books]
    # one row per entry of a codebook
    for r in assigned.filter("entry is not null").groupBy("entry").agg(F.sum("n"), *sums).collect():
        out[r[0] // entries][r[0] % entries] = [s // r[1] for s in r[2:]]
    return out


def first_entries(vectors: DataFrame, parts: int, entries: int) -> list[np.ndarray]:
    """The parts of the vectors of the smallest ids (null is the largest)."""
    ids = vectors.select("vec_id").distinct().orderBy(F.col("vec_id").asc_nulls_last()).limit(entries)
    ids = F.broadcast(ids.withColumnRenamed("vec_id", "id_"))
    found = (vectors.join(ids, F.col("vec_id").eqNullSafe(F.col("id_"))).groupBy("vec_id")
             .agg(F.min("embedding").alias("e")).orderBy(F.col("vec_id").asc_nulls_last()).collect())
    if not found:
        return []
    width = len(found[0]["e"])
    if width % parts:
        raise ValueError(f"vectors of {width} components cannot be cut into {parts} equal parts")
    kind = to_arrow_schema(vectors.select("embedding").schema)[0].type
    numbers = _whole_numbers(pa.array([r["e"] for r in found], kind), width)
    return np.split(numbers, parts, axis=1)


def compress(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """``(vec_id, code, error, label_error, codebooks_sha256)`` per row of ``(vec_id, embedding, label)``.

    Rows whose vector is null or holds a null or non-finite component are left out. Rows that share an id
    are coded each on its own; the codebooks start with distinct ids, the smallest vector of each, and with
    fewer entries if there are fewer ids. Null labels belong together. Vectors of different lengths, of a
    length that ``parts`` does not divide, and numbers too large for 64 bits raise. An empty table gives no
    rows. Other columns are not read. On the driver and in closures: the codebooks alone.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries must be between 1 and 256")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    vectors = embeddings.select("vec_id", "embedding", "label").filter(F.col("embedding").isNotNull() & finite)
    books = first_entries(vectors, parts, entries)
    if not books:
        return vectors.limit(0).select(
            "vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"),
            F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    at = _assign(vectors, books, True)
    for _ in range(rounds):
        books = _means(at, books)
        at = _assign(at.filter("entry is null"), books, False)
    coded = at.filter("entry is null").select("vec_id", "label", F.lower(F.hex("codes")).alias("code"), "error")
    sums = materialize(coded.groupBy(F.col("label").alias("label_")).agg(F.sum("error").alias("label_error")), "sums")
    digest = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()
    return coded.join(broadcast_small(sums, sums.count()), F.col("label").eqNullSafe(F.col("label_"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
