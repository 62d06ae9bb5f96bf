"""Pipeline stages the built-in library lacks; all are saved and loaded with their pipeline."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelab import ROW_ID
from tablelab.functions import argmax, bind


class _Stage(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    def _given(self, kwargs):
        self._set(**{k: v for k, v in kwargs.items() if v is not None})


class ClassProbabilities(_Stage):
    """Last stage of every classifier: adds ``probability`` (array) and ``prediction``, and drops
    the working columns (names starting with ``_`` other than the row id).

    One input vector is taken as it is. Several are one-against-rest models, whose positive
    probabilities are scaled to add up to 1.
    """

    vectors = Param(Params._dummy(), "vectors", "probability vectors", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, vectors=None):
        super().__init__()
        self._given(self._input_kwargs)

    def _transform(self, dataset):
        names = self.getOrDefault(self.vectors)
        if len(names) == 1:
            probability = vector_to_array(F.col(names[0]))
        else:
            positive = F.array(*[F.get(vector_to_array(F.col(n)), F.lit(1)) for n in names])
            k = float(len(names))

            def scaled(p):
                total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
                return bind(
                    total,
                    lambda t: F.transform(p, lambda x: F.when(t > 0, x / t).otherwise(1.0 / k)),
                )

            probability = bind(positive, scaled)
        working = [c for c in dataset.columns if c.startswith("_") and c != ROW_ID]
        return (
            dataset.drop("probability", "prediction")
            .withColumn("probability", probability)
            .withColumn("prediction", argmax("probability").cast("double"))
            .drop(*working)
        )


class PriorProbabilities(_Stage):
    """The dummy classifier: probabilities that ignore the inputs.

    ``stratified`` draws one class per row from the class frequencies, by the md5 of the row id
    when there is one, so the same row always gets the same class.
    """

    strategy = Param(Params._dummy(), "strategy", "how to predict", TypeConverters.toString)
    priors = Param(Params._dummy(), "priors", "class frequencies", TypeConverters.toListFloat)
    seed = Param(Params._dummy(), "seed", "seed of the draws", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, strategy=None, priors=None, seed=None):
        super().__init__()
        self._setDefault(seed=0)
        self._given(self._input_kwargs)

    def _transform(self, dataset):
        priors = self.getOrDefault(self.priors)
        strategy = self.getOrDefault(self.strategy)
        k = len(priors)
        if strategy == "prior":
            values = priors
        elif strategy == "uniform":
            values = [1.0 / k] * k
        elif strategy == "most_frequent":
            top = priors.index(max(priors))
            values = [float(i == top) for i in range(k)]
        else:
            return self._draw(dataset, priors)
        out = dataset.withColumn("probability", F.array(*[F.lit(float(v)) for v in values]))
        return out.withColumn("prediction", argmax("probability").cast("double"))

    def _draw(self, dataset, priors):
        seed = self.getOrDefault(self.seed)
        if ROW_ID in dataset.columns:
            digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(ROW_ID).cast("string")))
            unit = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)
        else:
            unit = F.rand(seed)
        bounds = np.cumsum(priors)
        drawn = F.lit(len(priors) - 1)
        for i in range(len(priors) - 2, -1, -1):
            drawn = F.when(F.col("_u") < float(bounds[i]), i).otherwise(drawn)
        hot = F.transform(F.sequence(F.lit(0), F.lit(len(priors) - 1)),
                          lambda i: (i == F.col("_c")).cast("double"))
        return (
            dataset.withColumn("_u", unit).withColumn("_c", drawn)
            .withColumn("probability", hot)
            .withColumn("prediction", F.col("_c").cast("double"))
            .drop("_u", "_c")
        )


class RandomFourierFeatures(_Stage):
    """Random cosines whose inner products approximate the RBF kernel (Rahimi & Recht 2007).

    Only the seed and sizes are stored; the directions are drawn again from them.
    """

    inputCol = Param(Params._dummy(), "inputCol", "vector", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "vector", TypeConverters.toString)
    size = Param(Params._dummy(), "size", "length of the input", TypeConverters.toInt)
    components = Param(Params._dummy(), "components", "length of the output", TypeConverters.toInt)
    gamma = Param(Params._dummy(), "gamma", "kernel width", TypeConverters.toFloat)
    seed = Param(Params._dummy(), "seed", "seed of the directions", TypeConverters.toInt)

    @keyword_only
    def __init__(
        self, *, inputCol=None, outputCol=None, size=None, components=None, gamma=None, seed=None
    ):
        super().__init__()
        self._given(self._input_kwargs)

    def _transform(self, dataset):
        size, components = self.getOrDefault(self.size), self.getOrDefault(self.components)
        draw = np.random.default_rng(self.getOrDefault(self.seed))
        spread = np.sqrt(2 * self.getOrDefault(self.gamma))
        directions = draw.normal(scale=spread, size=(size, components))
        phases = draw.uniform(0, 2 * np.pi, components)
        scale = np.sqrt(2.0 / components)

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def cosines(x: pd.Series) -> pd.Series:
            block = np.stack(x.to_numpy())
            return pd.Series(list(scale * np.cos(block @ directions + phases)))

        values = cosines(vector_to_array(F.col(self.getOrDefault(self.inputCol))))
        return dataset.withColumn(self.getOrDefault(self.outputCol), array_to_vector(values))


class Landmarks(_Stage):
    """A kernel by its values at some landmark points (Nyström; Williams & Seeger 2001).

    Inner products of the output are the kernel's on the span of the landmarks: everywhere, if the kernel
    has no more dimensions than there are landmarks. ``sigmoid`` is no inner product; its positive part is.
    """

    inputCol = Param(Params._dummy(), "inputCol", "vector", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "vector", TypeConverters.toString)
    kernel = Param(Params._dummy(), "kernel", "rbf, poly or sigmoid", TypeConverters.toString)
    gamma = Param(Params._dummy(), "gamma", "kernel width", TypeConverters.toFloat)
    coef0 = Param(Params._dummy(), "coef0", "constant of poly and sigmoid", TypeConverters.toFloat)
    degree = Param(Params._dummy(), "degree", "degree of poly", TypeConverters.toInt)
    points = Param(Params._dummy(), "points", "the landmarks as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(
        self, *, inputCol=None, outputCol=None, kernel=None, gamma=None, coef0=None, degree=None, points=None
    ):
        super().__init__()
        self._given(self._input_kwargs)

    def _kernel(self):
        kernel, gamma = self.getOrDefault(self.kernel), self.getOrDefault(self.gamma)
        coef0, degree = self.getOrDefault(self.coef0), self.getOrDefault(self.degree)

        def values(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            products = x @ y.T
            if kernel == "rbf":
                squares = (x ** 2).sum(1)[:, None] + (y ** 2).sum(1)[None, :] - 2 * products
                return np.exp(-gamma * np.maximum(squares, 0))
            inner = gamma * products + coef0
            return inner ** degree if kernel == "poly" else np.tanh(inner)

        return values

    def _transform(self, dataset):
        values, points = self._kernel(), np.array(json.loads(self.getOrDefault(self.points)))
        size, directions = np.linalg.eigh(values(points, points))
        kept = size > 1e-10 * size.max()
        root = directions[:, kept] / np.sqrt(size[kept])

        width = root.shape[1]

        @F.arrow_udf(T.ArrayType(T.DoubleType()))
        def mapped(x: pa.Array) -> pa.Array:
            # rows lie one after another in the column's buffer
            rows = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), points.shape[1])
            out = values(rows, points) @ root
            return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * width, pa.int32()), out.ravel())

        out = mapped(vector_to_array(F.col(self.getOrDefault(self.inputCol))))
        return dataset.withColumn(self.getOrDefault(self.outputCol), array_to_vector(out))
