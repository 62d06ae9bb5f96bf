"""Approximate nearest neighbours: random-projection buckets, probed in several places.

Each table cuts the space by a few random planes through the mean; a vector's bucket is the sides it is on. A
query visits its own bucket and those that differ where it lies closest to a plane, in order of the squared
distances it would have to cross (query-directed probing, Lv et al. 2007). How many buckets that takes is
measured when fitting: the exact neighbours of a bounded sample of rows say how far one has to go for the
recall asked for. Every row is in every table, and buckets of any size meet their queries in bounded blocks.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablelab.models.knn import BLOCK_ROWS, QUERY_ROWS, SLICE_ROWS, nearest
from tablelab.operators.ranks import hash_key
from tablelab.session import broadcast_small, materialize, spread

TABLES = 4
# Rows that a bucket holds on average, and the most planes of a table: its 2 ** MOST_BITS buckets are ranked per query.
BUCKET_ROWS, MOST_BITS = 256, 10
# Rows whose exact neighbours measure the recall.
SAMPLE_ROWS = 256
# Recall aimed at above the one asked for, as the sample is small.
MARGIN = 0.02


@dataclass
class Planes:
    """The planes of all tables, and how many buckets a query visits in each."""

    centre: np.ndarray
    directions: np.ndarray  # (tables, bits, size)
    probes: int = 1

    @property
    def bits(self) -> int:
        return self.directions.shape[1]

    def sides(self, x: np.ndarray, table: int) -> np.ndarray:
        return (x - self.centre) @ self.directions[table].T

    def bucket(self, x: np.ndarray, table: int) -> np.ndarray:
        return ((self.sides(x, table) > 0) << np.arange(self.bits)).sum(1)

    def order(self, x: np.ndarray, table: int) -> np.ndarray:
        """All buckets of each row, the nearest first."""
        d = self.sides(x, table)
        own = ((d > 0) << np.arange(self.bits)).sum(1)
        flips = np.arange(1 << self.bits)
        crossed = (flips[:, None] >> np.arange(self.bits)) & 1
        cost = (d ** 2) @ crossed.T.astype(float)
        return own[:, None] ^ np.argsort(cost, axis=1, kind="stable")

    def dump(self) -> str:
        return json.dumps([self.centre.tolist(), self.directions.tolist(), self.probes])

    @staticmethod
    def read(text: str) -> Planes:
        centre, directions, probes = json.loads(text)
        return Planes(np.array(centre), np.array(directions), probes)


def exact_pairs(train: DataFrame, queries: np.ndarray, k: int) -> list[np.ndarray]:
    """Vectors of the exact k nearest rows of a bounded number of queries: each task sends its best, and the
    best of those remain."""
    def best(batches):
        held = None
        for b in batches:
            held = b if held is None else pd.concat([held, b], ignore_index=True)
            q, p, d = nearest(queries, np.stack(held["x"].to_numpy()), held["id"].to_numpy(), k)
            used = np.unique(p)
            place = np.searchsorted(used, p)
            held = held.iloc[used].reset_index(drop=True)
            found = pd.DataFrame({"q": q, "d": d, "id": held["id"].to_numpy()[place], "x": held["x"].to_numpy()[place]})
        if held is not None:
            yield found

    w = Window.partitionBy("q").orderBy("d", "id")
    rows = (train.select("id", "x").mapInPandas(best, "q int, d double, id long, x array<double>")
            .withColumn("n", F.row_number().over(w)).filter(F.col("n") <= k).select("q", "x").toPandas())
    return [np.stack(rows["x"][rows["q"] == i].to_numpy()) for i in range(len(queries))]


def fit_planes(train: DataFrame, size: int, k: int, recall: float, seed: int = 0, tables: int = TABLES) -> Planes:
    """Planes for a table ``(id, x, y)``, with as few probes as reach ``recall`` on the sample."""
    n = train.count()
    bits = max(1, min(MOST_BITS, math.ceil(math.log2(max(2, n / BUCKET_ROWS)))))
    centre = np.array(train.agg(*[F.avg(F.col("x")[i]) for i in range(size)]).first(), float)
    draw = np.random.default_rng(seed)
    directions = draw.normal(size=(tables, bits, size))
    # orthogonal within a table, as far as there are enough dimensions
    if bits <= size:
        directions = np.stack([np.linalg.qr(t.T)[0].T for t in directions])
    planes = Planes(centre, directions)
    sample = train.orderBy(hash_key(seed, "id"), "id").limit(SAMPLE_ROWS).select("x").toPandas()
    queries = np.stack(sample["x"].to_numpy())
    found = exact_pairs(train, queries, k + 1)
    first = []  # at which probe each neighbour is met, in the luckiest table
    place = [planes.order(queries, t).argsort(1) for t in range(tables)]
    for i, points in enumerate(found):
        others = points[(points != queries[i]).any(1)]
        if len(others):
            first += np.min([place[t][i][planes.bucket(others, t)] for t in range(tables)], axis=0).tolist()
    wanted = min(1.0, recall + MARGIN)
    at = sorted(first)
    planes.probes = 1 + (at[max(0, math.ceil(wanted * len(at)) - 1)] if at else 0)
    return planes


def approximate_pairs(train: DataFrame, planes: Planes, queries: DataFrame, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(qid, distance, id, y)``: of the rows in the buckets that a query ``(qid, x)`` visits, the k nearest."""
    spark = train.sparkSession
    tables = range(len(planes.directions))

    def slices(batches):
        for b in batches:
            for start in range(0, len(b), SLICE_ROWS):
                yield b.iloc[start:start + SLICE_ROWS]

    def place(batches):
        for b in slices(batches):
            x = np.stack(b["x"].to_numpy())
            for t in tables:
                yield b.assign(bucket=(t << planes.bits) + planes.bucket(x, t))

    placed = materialize(train.mapInPandas(place, "id long, x array<double>, y int, bucket int"), "lsh-rows")

    def visit(batches):
        for b in slices(batches):
            x = np.stack(b["x"].to_numpy())
            for t in tables:
                to = planes.order(x, t)[:, :planes.probes]
                yield pd.DataFrame({"qid": np.repeat(b["qid"].to_numpy(), to.shape[1]),
                                    "x": np.repeat(b["x"].to_numpy(), to.shape[1]),
                                    "bucket": (t << planes.bits) + to.ravel()})

    visits = spread(queries, "qid").mapInPandas(visit, "qid long, x array<double>, bucket int")
    # at most tables * 2 ** MOST_BITS rows
    per_bucket = materialize(
        placed.groupBy("bucket").agg(F.ceil(F.count("*") / F.lit(block_rows)).alias("blocks"))
        .join(visits.groupBy(F.col("bucket").alias("b_")).agg(F.ceil(F.count("*") / F.lit(QUERY_ROWS)).alias("groups")),
              F.col("bucket") == F.col("b_")).drop("b_"), "lsh-buckets")
    small = broadcast_small(per_bucket, len(tables) << MOST_BITS)
    points = (placed.join(small, "bucket").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
              .withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)))
              .select("bucket", "block", "g", "id", "x", "y"))
    routed = (visits.join(small, "bucket").withColumn("g", F.pmod(F.xxhash64("qid"), F.col("groups")))
              .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
              .select("bucket", "block", "g", "qid", "x"))

    def meet(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(p):
            return pd.DataFrame({"qid": [], "distance": [], "id": [], "y": []})
        ids = p["id"].to_numpy()
        i, j, d = nearest(np.stack(q["x"].to_numpy()), np.stack(p["x"].to_numpy()), ids, k)
        return pd.DataFrame({"qid": q["qid"].to_numpy()[i], "distance": d, "id": ids[j], "y": p["y"].to_numpy()[j]})

    key = ["bucket", "block", "g"]
    met = routed.groupBy(*key).cogroup(points.groupBy(*key)).applyInPandas(
        meet, "qid long, distance double, id long, y int")
    best = Window.partitionBy("qid").orderBy("distance", "id")
    # a neighbour may be met in several tables
    once = met.groupBy("qid", "id").agg(F.min("distance").alias("distance"), F.min("y").alias("y"))
    return once.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= k).select("qid", "distance", "id", "y")


def measured_recall(exact: DataFrame, approximate: DataFrame, k: int) -> DataFrame:
    """``(qid, found, wanted, recall)``: neighbours no farther than the exact k-th one, of those there are."""
    far = exact.groupBy("qid").agg(F.max("distance").alias("kth"), F.count("*").alias("wanted"))
    near = approximate.withColumnRenamed("qid", "q_").withColumnRenamed("distance", "d_")
    close = F.col("d_") <= F.col("kth") * (1 + 1e-12)
    return (far.join(near, F.col("qid") == F.col("q_"), "left").groupBy("qid", "wanted")
            .agg(F.count_if(close).alias("found"))
            .select("qid", "found", "wanted", (F.col("found") / F.col("wanted")).alias("recall")))
