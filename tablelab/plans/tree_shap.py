"""Exact SHAP values of best-first trees against a whole background, without coalitions or pairs of rows.

A leaf is reached by intervals of the inputs on its path. Of an instance and a background row only one thing
matters to a leaf: which of its intervals each of them meets. The background shrinks to how many rows meet which
intervals of which leaf; an instance's contributions are sums over those counts (interventional SHAP by paths of
agreement; Lundberg et al. 2020). Work grows with rows times leaves, not with instances times background.
"""

from __future__ import annotations

import functools
import json
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelab import ROW_ID
from tablelab.functions import round3
from tablelab.models.grown import GrownTrees


@dataclass
class Leaf:
    inputs: list[int]
    above: np.ndarray
    upto: np.ndarray
    value: np.ndarray

    def meets(self, x: np.ndarray) -> np.ndarray:
        """Which intervals each row meets, a bit per input of the path."""
        inside = (x[:, self.inputs] > self.above) & (x[:, self.inputs] <= self.upto)
        return (inside.astype(np.int64) << np.arange(len(self.inputs))).sum(1)


def leaves(model: dict) -> list[Leaf]:
    """Leaves of all trees of a model; values per class (shares), or per score (boosting)."""
    width = len(model["start"])
    if "rounds" in model:
        trees = [(t, k, 1.0) for r in model["rounds"] for k, t in enumerate(r)]
    else:
        trees = [(t, None, 1.0 / len(model["forest"])) for (t,) in model["forest"]]
    out = []
    for tree, score, share in trees:
        stack = [(0, {})]
        while stack:
            n, path = stack.pop()
            f = tree["feature"][n]
            if f >= 0:
                low, high = path.get(f, (-math.inf, math.inf))
                at = tree["at"][n]
                stack.append((tree["left"][n], {**path, f: (low, min(high, at))}))
                stack.append((tree["right"][n], {**path, f: (max(low, at), high)}))
                continue
            value = np.zeros(width)
            if score is None:
                value += share * np.array(tree["value"][n])
            else:
                value[score] = tree["value"][n] or 0.0
            if len(path) > 62:
                raise ValueError("a path of more than 62 inputs has too many subsets")
            inputs = sorted(path)
            out.append(Leaf(inputs, np.array([path[i][0] for i in inputs]), np.array([path[i][1] for i in inputs]), value))
    return out


@functools.cache
def shares(own: int, other: int) -> tuple[float, float]:
    """What an input that only the instance meets gains, and one that only the background row meets loses."""
    gain = math.factorial(own - 1) * math.factorial(other) / math.factorial(own + other) if own else 0.0
    loss = math.factorial(own) * math.factorial(other - 1) / math.factorial(own + other) if other else 0.0
    return gain, loss


def of_leaf(met: int, size: int, counts: dict[int, float]) -> np.ndarray:
    """Contribution of each of a leaf's inputs to an instance that meets ``met``, for a value of 1; ``counts``
    are the shares of background rows by the intervals that they meet."""
    out = np.zeros(size)
    for other, share in counts.items():
        if met | other != (1 << size) - 1:
            continue  # no mixture of the two reaches the leaf
        mine, theirs = met & ~other, other & ~met
        gain, loss = shares(mine.bit_count(), theirs.bit_count())
        for k in range(size):
            if mine >> k & 1:
                out[k] += share * gain
            elif theirs >> k & 1:
                out[k] -= share * loss
    return out


class TreeShap:
    """Explains a fitted pipeline whose trees were grown best-first: class shares of trees and forests, raw
    scores (one for two classes) of boosting."""

    def __init__(self, model: PipelineModel):
        at = [i for i, s in enumerate(model.stages) if isinstance(s, GrownTrees)]
        if not at:
            raise ValueError("only best-first trees can be explained by their paths")
        self.prepare = PipelineModel(model.stages[:at[0]])
        stage = model.stages[at[0]]
        self.model, self.vector = json.loads(stage.getOrDefault(stage.trees)), stage.getOrDefault(stage.inputCol)
        self.inputs = model.input_schema.names
        self.leaves = leaves(self.model)
        self.counts: list[dict[int, float]] | None = None

    def _vectors(self, df: DataFrame, *columns) -> DataFrame:
        return self.prepare.transform(df).select(*columns, vector_to_array(F.col(self.vector)).alias("x"))

    def fit(self, background: DataFrame) -> TreeShap:
        """Counts all rows of the background; what comes back is at most a count per leaf and subset of its path."""
        size, all_leaves = len(self.inputs), self.leaves
        target = pa.schema([("leaf", pa.int32()), ("met", pa.int64()), ("n", pa.int64())])

        def count(batches):
            known: dict[tuple[int, int], int] = {}
            for b in batches:
                x = np.asarray(b.column("x").flatten(), float).reshape(-1, size)
                for k, leaf in enumerate(all_leaves):
                    for met, n in zip(*np.unique(leaf.meets(x), return_counts=True)):
                        known[k, int(met)] = known.get((k, int(met)), 0) + int(n)
            yield pa.RecordBatch.from_pylist([{"leaf": k, "met": m, "n": n} for (k, m), n in known.items()], schema=target)

        rows = self._vectors(background).mapInArrow(count, "leaf int, met long, n long")
        found = rows.groupBy("leaf", "met").agg(F.sum("n").alias("n")).collect()
        self.counts = [{} for _ in self.leaves]
        total = sum(r["n"] for r in found if r["leaf"] == 0)
        if not total:
            raise ValueError("the background has no rows")
        for r in found:
            self.counts[r["leaf"]][r["met"]] = r["n"] / total
        return self

    def base_values(self) -> list[float]:
        """Mean of the explained values over the background."""
        self._fitted()
        out = np.array(self.model["start"])
        for leaf, counts in zip(self.leaves, self.counts):
            out = out + leaf.value * counts.get((1 << len(leaf.inputs)) - 1, 0.0)
        return out.tolist()

    def _fitted(self) -> None:
        if self.counts is None:
            raise ValueError("the explainer must be fitted before it can explain instances")

    def explain(self, instances: DataFrame, row_id: str = ROW_ID, decimals: bool = True) -> DataFrame:
        """One row per instance, class (or score) and input: ``instance_id, class, feature, value, shap``.

        A narrow step: rows do not move.
        """
        self._fitted()
        size, width, all_leaves, counts = len(self.inputs), len(self.model["start"]), self.leaves, self.counts

        @F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
        def contributions(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=object)
            block = np.stack(x.to_numpy())
            phi = np.zeros((len(block), width, size))
            for leaf, background in zip(all_leaves, counts):
                if not leaf.inputs:
                    continue
                met, back = np.unique(leaf.meets(block), return_inverse=True)
                parts = np.stack([of_leaf(int(m), len(leaf.inputs), background) for m in met])
                phi[:, :, leaf.inputs] += leaf.value[None, :, None] * parts[back][:, None, :]
            return pd.Series([p.tolist() for p in phi])

        texts = F.array(*[F.col(f"`{c}`").cast("string") for c in self.inputs])
        rows = self._vectors(instances, F.col(row_id).alias("instance_id"), texts.alias("texts"))
        long = rows.select("instance_id", "texts", F.posexplode(contributions("x")).alias("class", "of"))
        long = long.select("instance_id", "texts", "class", F.posexplode("of").alias("j", "shap"))
        return long.select(
            "instance_id", "class", F.get(F.array(*[F.lit(c) for c in self.inputs]), F.col("j")).alias("feature"),
            F.get("texts", F.col("j")).alias("value"), (round3("shap") if decimals else F.col("shap")).alias("shap"))
