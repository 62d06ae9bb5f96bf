"""Toxicity: FTRL-proximal logistic regression over hashed words, word pairs and skip-grams.

Per-coordinate learning rates and L1 keep few weights, which are broadcast. A bounded sample of labelled
documents is hashed where the documents lie; the hashes are then learnt in one stream, as the method's
sequential rates need.
"""

from __future__ import annotations

import re
import tempfile

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelab.llm.common import WordHashes, arrow_map, hashed_grams, hashed_share, texts

WORDS = re.compile(r"\w+")
BITS = 20
# Labelled documents that the model is fitted on, at most about this many, chosen by a hash.
MAX_TRAINING = 60_000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 2.0, 0.0


def feature_ids(text: bytes, hashes: WordHashes, bits: int) -> np.ndarray:
    return hashed_grams(hashes.array(WORDS.findall(text.decode().lower())), bits, skips=True)


class Ftrl:
    """State of FTRL-proximal: ``z`` and ``n`` per coordinate; the last coordinate is the intercept."""

    def __init__(self, z: np.ndarray, n: np.ndarray):
        self.z, self.n = z, n

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) > L1, w, 0.0)

    def learn(self, at: np.ndarray, label: float) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        grown = n + g * g
        self.z[at] += g - (np.sqrt(grown) - np.sqrt(n)) / ALPHA * w
        self.n[at] = grown


def packed(ids: np.ndarray) -> bytes:
    """Sorted distinct ids of at most 32 bits in little over two bytes each: how many have each upper half
    up to the last one, then the lower halves."""
    counts = np.bincount(ids >> 16)
    return np.uint32(len(counts)).tobytes() + counts.astype(np.uint32).tobytes() + ids.astype(np.uint16).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    n = int(np.frombuffer(data, np.uint32, 1)[0])
    counts = np.frombuffer(data, np.uint32, n, 4)
    return np.repeat(np.arange(n) << 16, counts) | np.frombuffer(data, np.uint16, -1, 4 + 4 * n)


def fit(examples: DataFrame, bits: int = BITS, featurise=feature_ids) -> np.ndarray:
    """Weights (the last one is the intercept) from ``(doc_id, text, label)``, ``label`` in 0..1.

    The caller bounds the number of examples. Their order is by a hash of ``doc_id``. Without examples
    all weights are 0.
    """
    size = (1 << bits) + 1

    def per_task():
        hashes = WordHashes()

        def step(batch):
            ids = [packed(np.append(np.unique(featurise(t, hashes, bits)), size - 1)) for t in texts(batch)]
            return {"doc_id": batch.column("doc_id"), "label": batch.column("label"), "ids": ids}

        return step

    hashed = arrow_map(examples.select("doc_id", "text", F.col("label").cast("double").alias("label")), per_task,
                       "doc_id long, label double, ids binary")
    # the sample is bounded, so one task may read it in order; it holds a batch at a time
    ordered = (hashed.withColumn("h", F.xxhash64("doc_id", F.lit(11)))
               .repartition(1).sortWithinPartitions("h", "doc_id", "ids", "label"))

    def learn(frames):
        model = Ftrl(np.zeros(size), np.zeros(size))
        # the first pass keeps the examples for the others in a file, so that they are shuffled once
        with tempfile.TemporaryFile() as kept:
            for frame in frames:
                for ids, label in zip(frame["ids"], frame["label"]):
                    model.learn(unpacked(ids), label)
                    kept.write(np.array([len(ids)], "<i8").tobytes() + np.array([label], "<f8").tobytes() + ids)
            for _ in range(EPOCHS - 1):
                kept.seek(0)
                while head := kept.read(16):
                    label = float(np.frombuffer(head, "<f8", 1, 8)[0])
                    model.learn(unpacked(kept.read(int(np.frombuffer(head, "<i8", 1)[0]))), label)
        w = model.weights(slice(None))
        yield pd.DataFrame({"at": np.flatnonzero(w), "w": w[w != 0]})

    found = ordered.select("label", "ids").mapInPandas(learn, "at long, w double").toArrow().to_pandas()
    out = np.zeros(size)
    out[found["at"]] = found["w"]
    return out


def score(documents: DataFrame, weights: np.ndarray, carry: list[str], featurise=feature_ids) -> DataFrame:
    """Columns ``carry`` of every row, ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on).

    An empty or null text has the intercept alone. Rows are scored each on its own.
    """
    bits = (len(weights) - 1).bit_length() - 1
    used = np.flatnonzero(weights)
    sparse = documents.sparkSession.sparkContext.broadcast(
        (len(weights), used.astype(np.int32), weights[used].astype(np.float32)))
    rows = documents.select(F.col("text").alias("text_"), *carry)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in carry)

    def per_task():
        size, at, w = sparse.value
        dense = np.zeros(size, np.float32)
        dense[at] = w
        hashes = WordHashes()

        def step(batch):
            out = []
            for text in texts(batch, "text_"):
                ids = featurise(text, hashes, bits)
                ids = np.unique(ids[dense[ids] != 0])
                out.append(dense[ids].sum(dtype=np.float64) + float(dense[-1]))
            p = 1 / (1 + np.exp(-np.clip(np.array(out), -35, 35)))
            return {c: batch.column(c) for c in carry} | {"score": p, "predicted": (p >= 0.5).astype(np.int32)}

        return step

    return arrow_map(rows, per_task, f"{kinds}, score double, predicted int")


def held_out(doc_id: str = "doc_id") -> Column:
    """The fold that no label is learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def toxicity(documents: DataFrame, labels: DataFrame, most: int = MAX_TRAINING) -> DataFrame:
    """Every document's ``doc_id``, ``held_out``, ``score`` and ``predicted``.

    Learns ``labels.toxic`` of rows outside the held-out fold; of several labels for a document the
    largest counts, null labels are left out. Labels, language, source and id are no inputs of a score.
    """
    known = (labels.filter("toxic is not null and doc_id is not null").filter(~held_out())
             .groupBy(F.col("doc_id").alias("known_id")).agg(F.max("toxic").alias("label")))
    chosen = known.filter(hashed_share("known_id", known.count(), most))
    examples = documents.select("doc_id", "text").join(
        F.broadcast(chosen), F.col("doc_id") == F.col("known_id")).select("doc_id", "text", "label")
    scored = score(documents.select("doc_id", "text"), fit(examples), ["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
