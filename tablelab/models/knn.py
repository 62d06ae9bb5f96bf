"""Exact k nearest neighbours.

A small training set (its size is checked) is copied to every executor and scoring is a narrow
step. A larger one stays distributed: rows are grouped into cells around pivots, a query is sent to
the cells that can hold one of its neighbours (triangle inequality), and cells and queries meet in
blocks of bounded size. Both ways give the same neighbours: by distance, then by row id.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (
    DefaultParamsReader,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelab import ROW_ID
from tablelab.operators.ranks import hash_key
from tablelab.session import broadcast_small, materialize, spread

BROADCAST_BYTES = 256 << 20
MAX_PIVOTS = 1024
SLICE_ROWS = 1024
BLOCK_ROWS = 4096
QUERY_ROWS = 16384
# Queries routed together, and the most routed rows of a batch: a row carries its vector to each cell it visits.
ROUTED_QUERIES = 32
ROUTED_ROWS = 4096
_TRAIN = "id long, x array<double>, y int"


def nearest(queries: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int):
    """``(query, point, distance)`` index arrays of the k nearest points, by (distance, id).

    Fast inner products find everything within reach of the k-th distance; those few pairs are then
    measured exactly, so ties and zero distances come out right.
    """
    k = min(k, len(points))
    at_q, at_p, dist = [], [], []
    norms = (points**2).sum(axis=1)
    step = max(16, 4_000_000 // len(points))
    for start in range(0, len(queries), step):
        q = queries[start : start + step]
        qn = (q**2).sum(axis=1)
        rough = qn[:, None] + norms[None, :] - 2 * q @ points.T
        kth = np.partition(rough, k - 1, axis=1)[:, k - 1]
        slack = 1e-9 * (qn + norms.max()) + 1e-12
        i, j = np.nonzero(rough <= (kth + slack)[:, None])
        exact = np.concatenate([
            np.sqrt(((q[i[s : s + 100_000]] - points[j[s : s + 100_000]]) ** 2).sum(axis=1))
            for s in range(0, len(i), 100_000)
        ])
        order = np.lexsort((ids[j], exact, i))
        i, j, exact = i[order], j[order], exact[order]
        first = np.searchsorted(i, i)
        keep = np.arange(len(i)) - first < k
        at_q.append(i[keep] + start)
        at_p.append(j[keep])
        dist.append(exact[keep])
    return np.concatenate(at_q), np.concatenate(at_p), np.concatenate(dist)


def neighbour_weights(query: np.ndarray, distance: np.ndarray, weights: str) -> np.ndarray:
    """Vote of each neighbour; with ``distance``, exact matches outvote everything else."""
    if weights == "uniform":
        return np.ones(len(query))
    exact = distance == 0
    has_exact = np.zeros(query.max() + 1 if len(query) else 0, bool)
    has_exact[query[exact]] = True
    with np.errstate(divide="ignore"):
        return np.where(has_exact[query], exact.astype(float), 1.0 / distance)


def routed_rows(queries: pd.DataFrame, visits, cells: np.ndarray, blocks: np.ndarray, groups: np.ndarray):
    """A row for each query and block of a cell it visits, in frames of bounded size however many cells that is."""
    for first in range(0, len(queries), ROUTED_QUERIES):
        few = queries.iloc[first : first + ROUTED_QUERIES]
        qid, x = few["qid"].to_numpy(), few["x"].to_numpy()
        q, c = visits(few["x"])
        q, c = np.repeat(q, blocks[c]), np.repeat(c, blocks[c])
        at = np.arange(len(c))
        start = np.r_[True, (c[1:] != c[:-1]) | (q[1:] != q[:-1])]
        block = at - np.maximum.accumulate(np.where(start, at, 0))
        for s in range(0, len(c), ROUTED_ROWS):
            part = slice(s, s + ROUTED_ROWS)
            yield pd.DataFrame({
                "qid": qid[q[part]], "x": x[q[part]], "cell": cells[c[part]],
                "block": block[part], "groups": groups[c[part]],
            })


class KnnModel(Model, MLReadable, MLWritable):
    """Fitted neighbours; ``train`` is a table ``(id, x, y)``."""

    featuresCol = Param(Params._dummy(), "featuresCol", "vector", TypeConverters.toString)
    classes = Param(Params._dummy(), "classes", "number of classes", TypeConverters.toInt)
    neighbours = Param(Params._dummy(), "neighbours", "k", TypeConverters.toInt)
    weights = Param(Params._dummy(), "weights", "uniform or distance", TypeConverters.toString)
    rows = Param(Params._dummy(), "rows", "training rows", TypeConverters.toInt)
    size = Param(Params._dummy(), "size", "vector length", TypeConverters.toInt)
    planes = Param(Params._dummy(), "planes", "buckets of approximate neighbours", TypeConverters.toString)

    @keyword_only
    def __init__(
        self, *, featuresCol=None, classes=None, neighbours=None, weights=None, rows=None, size=None, planes=None
    ):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})
        self.train: DataFrame | None = None
        self.broadcast_bytes = BROADCAST_BYTES
        self.block_rows = BLOCK_ROWS

    def write(self):
        return _KnnWriter(self)

    @classmethod
    def read(cls):
        return _KnnReader()

    def _transform(self, dataset):
        bytes_needed = self.getOrDefault(self.rows) * (self.getOrDefault(self.size) + 2) * 8
        if bytes_needed <= self.broadcast_bytes and not self.isSet(self.planes):
            return self._narrow(dataset)
        return self._blocked(dataset)

    def _narrow(self, dataset):
        """Every executor holds the training rows; queries never move."""
        spark = dataset.sparkSession
        pdf = self.train.toPandas()
        packed = spark.sparkContext.broadcast(
            (np.stack(pdf["x"].to_numpy()), pdf["id"].to_numpy(), pdf["y"].to_numpy())
        )
        k, classes = self.getOrDefault(self.neighbours), self.getOrDefault(self.classes)
        weights = self.getOrDefault(self.weights)

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def vote(x: pd.Series) -> pd.Series:
            points, ids, labels = packed.value
            q, p, d = nearest(np.stack(x.to_numpy()), points, ids, k)
            votes = np.zeros((len(x), classes))
            np.add.at(votes, (q, labels[p]), neighbour_weights(q, d, weights))
            return pd.Series(list(votes / votes.sum(axis=1, keepdims=True)))

        features = vector_to_array(F.col(self.getOrDefault(self.featuresCol)))
        return dataset.withColumn("_probability", array_to_vector(vote(features)))

    def neighbour_pairs(self, dataset: DataFrame) -> DataFrame:
        """``(query id, distance, id, y)`` of the k nearest training rows, all distributed."""
        if self.isSet(self.planes):
            from tablelab.models.lsh import Planes, approximate_pairs

            vectors = vector_to_array(F.col(self.getOrDefault(self.featuresCol))).alias("x")
            return approximate_pairs(
                self.train, Planes.read(self.getOrDefault(self.planes)), dataset.select(F.col(ROW_ID).alias("qid"), vectors),
                self.getOrDefault(self.neighbours), self.block_rows)
        spark = dataset.sparkSession
        k, block_rows = self.getOrDefault(self.neighbours), self.block_rows
        n = self.getOrDefault(self.rows)
        pivot_count = min(n, max(16, min(MAX_PIVOTS, math.isqrt(n))))
        chosen = self.train.orderBy(hash_key(0, "id"), "id").limit(pivot_count).collect()
        pivots = np.array([r["x"] for r in chosen])

        def slices(batches):
            for b in batches:
                for start in range(0, len(b), SLICE_ROWS):
                    yield b.iloc[start : start + SLICE_ROWS]

        def to_pivots(x: pd.Series) -> np.ndarray:
            block = np.stack(x.to_numpy())
            rough = (block**2).sum(1)[:, None] + (pivots**2).sum(1)[None, :] - 2 * block @ pivots.T
            return np.sqrt(np.maximum(rough, 0))

        def place(batches):
            for b in slices(batches):
                d = to_pivots(b["x"])
                yield b.assign(cell=d.argmin(axis=1), far=d.min(axis=1))

        placed = materialize(
            self.train.mapInPandas(place, f"{_TRAIN}, cell int, far double"), "knn-cells"
        )
        stats = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("r")).collect()
        cells = np.array([s["cell"] for s in stats])  # at most MAX_PIVOTS cells
        counts = np.array([s["n"] for s in stats])
        reach = np.array([s["r"] for s in stats])
        blocks = np.maximum(1, np.ceil(counts / block_rows)).astype(int)

        def visits(x: pd.Series) -> tuple[np.ndarray, np.ndarray]:
            """Which cells each query has to visit, as (query, cell) positions."""
            d = to_pivots(x)[:, cells]
            outer = d + reach
            order = np.argsort(outer, axis=1)
            enough = np.argmax(np.cumsum(counts[order], axis=1) >= min(k, n), axis=1)
            limit = np.take_along_axis(outer, order, 1)[np.arange(len(x)), enough]
            # a little slack covers the rounding of the distances to the pivots
            return np.nonzero(d - reach <= limit[:, None] * (1 + 1e-6) + 1e-6)

        def count_visits(batches):
            for b in slices(batches):
                hits = np.bincount(visits(b["x"])[1], minlength=len(cells))
                yield pd.DataFrame({"c": np.arange(len(cells)), "v": hits})

        vectors = vector_to_array(F.col(self.getOrDefault(self.featuresCol))).alias("x")
        queries = spread(dataset.select(F.col(ROW_ID).alias("qid"), vectors), "qid")
        visited = queries.select("x").mapInPandas(count_visits, "c int, v long").groupBy("c").agg(F.sum("v").alias("v"))
        groups = np.ones(len(cells), dtype=int)
        for r in visited.collect():
            groups[r["c"]] = max(1, math.ceil(r["v"] / QUERY_ROWS))

        def route(batches):
            for b in slices(batches):
                yield from routed_rows(b, visits, cells, blocks, groups)

        routed = queries.mapInPandas(
            route, "qid long, x array<double>, cell int, block long, groups long"
        ).withColumn("g", F.pmod(F.xxhash64("qid"), F.col("groups")))
        per_cell = spark.createDataFrame(
            [(int(c), int(b), int(g)) for c, b, g in zip(cells, blocks, groups)],
            "cell int, blocks long, groups long",
        )
        # a block is copied once per group of queries that visit its cell
        points = (
            placed.join(broadcast_small(per_cell, len(cells)), "cell")
            .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
            .withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)))
            .select("cell", "block", "g", "id", "x", "y")
        )

        def meet(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
            if not len(q) or not len(p):
                return pd.DataFrame({"qid": [], "distance": [], "id": [], "y": []})
            ids = p["id"].to_numpy()
            i, j, d = nearest(np.stack(q["x"].to_numpy()), np.stack(p["x"].to_numpy()), ids, k)
            return pd.DataFrame({
                "qid": q["qid"].to_numpy()[i], "distance": d, "id": ids[j], "y": p["y"].to_numpy()[j],
            })

        key = ["cell", "block", "g"]
        found = routed.groupBy(*key).cogroup(points.groupBy(*key)).applyInPandas(
            meet, "qid long, distance double, id long, y int"
        )
        best = Window.partitionBy("qid").orderBy("distance", "id")
        return found.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= k).drop("_n")

    def _blocked(self, dataset):
        if ROW_ID not in dataset.columns:
            raise ValueError(f"neighbours that are not broadcast need a {ROW_ID} column on the scored rows")
        classes = self.getOrDefault(self.classes)
        pairs = self.neighbour_pairs(dataset)
        if self.getOrDefault(self.weights) == "uniform":
            vote = F.lit(1.0)
        else:
            exact = F.max(F.col("distance") == 0).over(Window.partitionBy("qid"))
            inverse = F.when(F.col("distance") > 0, 1.0 / F.col("distance"))
            vote = F.when(exact, (F.col("distance") == 0).cast("double")).otherwise(inverse)
        voted = pairs.withColumn("v", vote).groupBy("qid").agg(
            F.sum("v").alias("all"),
            *[F.coalesce(F.sum(F.when(F.col("y") == c, F.col("v"))), F.lit(0.0)).alias(f"c{c}")
              for c in range(classes)],
        )
        shares = F.array(*[F.col(f"c{c}") / F.col("all") for c in range(classes)])
        voted = voted.select(F.col("qid").alias(ROW_ID), array_to_vector(shares).alias("_probability"))
        if self.isSet(self.planes):  # buckets may be empty: no vote, equal shares
            none = array_to_vector(F.array(*[F.lit(1.0 / classes)] * classes))
            return dataset.join(voted, ROW_ID, "left").withColumn("_probability", F.coalesce("_probability", none))
        return dataset.join(voted, ROW_ID)


class _KnnWriter(MLWriter):
    def __init__(self, instance):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path):
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance.train.write.parquet(f"{path}/train")


class _KnnReader(MLReader):
    def load(self, path):
        spark = SparkSession.getActiveSession()
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        model = KnnModel()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        model.train = spark.read.schema(_TRAIN).parquet(f"{path}/train")
        return model


def fit_knn(
    df: DataFrame, features: str, label: str, classes: int, neighbours: int, weights: str,
    approx: float | None = None, seed: int = 0,
) -> KnnModel:
    """Keep the training rows as a table; needs ``_row_id`` for reproducible ties.

    ``approx`` is a recall below 1 to be content with: neighbours are then looked for in buckets (``lsh``).
    """
    if weights not in ("uniform", "distance"):
        raise ValueError(f"weights should be uniform or distance, got {weights}")
    if ROW_ID not in df.columns:
        raise ValueError(f"nearest neighbours need a {ROW_ID} column on the training rows")
    rows = df.select(
        F.col(ROW_ID).cast("long").alias("id"),
        vector_to_array(F.col(features)).alias("x"),
        F.col(label).cast("int").alias("y"),
    )
    # copies of one vector are equally far from any query, so only the k lowest ids can ever be
    # among the k nearest; the answer stays exact however many copies there are
    copies = Window.partitionBy("x").orderBy("id")
    rows = rows.withColumn("_n", F.row_number().over(copies)).filter(F.col("_n") <= neighbours)
    train = materialize(rows.select("id", "x", "y"), "knn-train")
    size = len(train.select("x").head()[0])
    model = KnnModel(
        featuresCol=features, classes=classes, neighbours=neighbours, weights=weights,
        rows=train.count(), size=size,
    )
    model.train = train
    if approx is not None:
        from tablelab.models.lsh import fit_planes

        model._set(planes=fit_planes(train, size, neighbours, approx, seed).dump())
    return model
