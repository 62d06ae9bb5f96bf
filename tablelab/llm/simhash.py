"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked through BK-trees.

Fingerprints are sharded so that every pair within the radius shares a shard: ``radius + 2`` blocks of
bits, a shard per two blocks and their values; ``radius`` differing bits leave two blocks alone. Each
shard is searched through a BK-tree: a node's children are keyed by their integer Hamming distance to
it, and a query follows only edges within the radius of its own distance. Trees of a shard are built in
the task that holds its queries; a shard that is too large is cut into blocks that meet in pairs. Equal
fingerprints are one node, however many documents share them.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelab.llm.common import (
    arrow_map, bounded_groups, components, in_groups, local_stars, numbered, text_mark, text_marks, texts,
)
from tablelab.session import materialize

SHINGLE = 3
RADIUS = 3
SEED = 42
_NO_LINKS = pd.DataFrame({"a": [], "b": []}, dtype="int64")


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """A bit is set if more than half of the shingle hashes set it. No words: 0."""
    words = text.lower().split()  # on bytes: A-Z only, ASCII blanks only
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    ends = ends.tolist()[size - 1:] or [len(joined)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends)], dtype="<u8")
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    majority = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
    return int(np.packbits(majority, bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame) -> DataFrame:
    """``(doc_id, mark, fp)`` with the 64 bits as a signed long. Null text has no words. ``mark`` tells
    texts of one id apart."""

    def per_task():
        def step(batch):
            values = texts(batch)
            marks = np.array([fingerprint(t) for t in values], np.uint64)
            return {"doc_id": batch.column("doc_id"), "mark": text_marks(values), "fp": marks.view(np.int64)}

        return step

    return arrow_map(documents.select("doc_id", "text"), per_task, "doc_id long, mark long, fp long")


def shard_keys(fp: str = "fp", radius: int = RADIUS):
    """Array of shard numbers of a fingerprint: one for each two of its ``radius + 2`` blocks."""
    n = radius + 2
    edges = [64 * i // n for i in range(n + 1)]
    blocks = [F.shiftrightunsigned(F.col(fp), lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1))
              for lo, hi in zip(edges, edges[1:])]
    return F.array(*(F.xxhash64(F.lit(i), F.lit(j), blocks[i], blocks[j]) for i, j in combinations(range(n), 2)))


def bk_links(group: np.ndarray, fp: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links ``(query, found)`` within ``radius`` inside each group, by one BK-tree per group.

    ``group`` is sorted and ``fp`` (unsigned) distinct inside a group. All trees are built and searched
    level by level together. An edge is the code ``node * 65 + distance``.
    """
    n = len(fp)
    root = np.searchsorted(group, group, "left")
    codes, children = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    waiting, at = np.flatnonzero(root != np.arange(n)), None
    at = root[waiting]
    while len(waiting):
        code = at * 65 + np.bitwise_count(fp[waiting] ^ fp[at]).astype(np.int64)
        edge, first, which = np.unique(code, return_index=True, return_inverse=True)
        codes.append(edge)
        children.append(waiting[first])
        at = waiting[first][which]
        below = at != waiting
        waiting, at = waiting[below], at[below]
    codes, children = np.concatenate(codes), np.concatenate(children)
    order = np.argsort(codes)
    codes, children = codes[order], children[order]
    query, node = np.arange(n), root
    found_q, found_n = [], []
    while len(query):
        d = np.bitwise_count(fp[query] ^ fp[node]).astype(np.int64)
        hit = (d <= radius) & (node != query)
        found_q.append(query[hit])
        found_n.append(node[hit])
        if not len(codes):
            break
        low, high = np.maximum(d - radius, 0), np.minimum(d + radius, 64)
        begin = np.searchsorted(codes, node * 65 + low, "left")
        end = np.searchsorted(codes, node * 65 + high, "right")
        width = end - begin
        query = np.repeat(query, width)
        step = np.arange(len(query)) - np.repeat(np.cumsum(width) - width, width)
        node = children[np.repeat(begin, width) + step]
    return np.concatenate(found_q), np.concatenate(found_n)


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links ``(a, b)`` that connect the distinct fingerprints ``(id, fp)`` within ``radius``.

    Inside a group only a star per linked set is returned: it joins the same sets as all its pairs.
    """
    shards = nodes.select("id", "fp", F.explode(shard_keys("fp", radius)).alias("shard"))

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        g, ids = frame["g"].to_numpy(), frame["id"].to_numpy()
        a, b = bk_links(g, frame["fp"].to_numpy().view(np.uint64), radius)
        label = local_stars(len(ids), a, b)
        low = label != np.arange(len(ids))
        return pd.DataFrame({"a": ids[low], "b": ids[label[low]]}) if low.any() else _NO_LINKS

    groups = bounded_groups(shards, "shard", "id").select("g", "id", "fp")
    return in_groups(groups, search, "a long, b long").distinct()


def simhash_components(documents: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row per document: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id``.

    ``component_id`` is the smallest ``doc_id`` reachable over links of at most ``radius`` bits, the
    document itself included. Documents without words share fingerprint zero and link like any other.
    A null ``doc_id`` forms a component with what it links to, named by the smallest known id.
    """
    marks = materialize(fingerprints(documents).select("doc_id", "fp"), "fingerprints")
    nodes = marks.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    # a node's number is its fingerprint; the smallest doc_id of a component is taken at the end
    joined = components(links(nodes.select(F.col("fp").alias("id"), "fp"), radius))
    named = nodes.join(joined, F.col("fp") == F.col("node"))
    smallest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    linked = named.join(smallest, "component").select(F.col("fp").alias("linked_fp"), "component_id")
    # written, so that the join below reads two shuffles and Spark can split a hot fingerprint
    alone = materialize(nodes.join(linked, F.col("fp") == F.col("linked_fp"), "left").select(
        F.col("fp").alias("node_fp"), F.coalesce("component_id", "first_id").alias("component_id")), "components")
    return marks.join(alone, F.col("fp") == F.col("node_fp")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_per_component(documents: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of each component: the one of the smallest ``doc_id``, rows without an id last; all columns
    stay as they are, whatever their names and types. Texts of one id are judged each on its own. Of rows
    with one id and text that first in JSON is kept."""
    rows = materialize(fingerprints(documents).groupBy("fp", "doc_id", "mark").agg(F.count("*").alias("n")), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark", "n")).alias("first")
    nodes = materialize(rows.groupBy("fp").agg(first), "nodes")
    joined = components(links(nodes.select(F.col("fp").alias("id"), "fp"), radius))
    keep = (nodes.join(joined, F.col("fp") == F.col("node"), "left")
            .groupBy(F.coalesce("component", "fp").alias("class")).agg(F.min("first").alias("first"))
            .select(F.col("first.doc_id").alias("keep_id_"), F.col("first.mark").alias("keep_mark_"), F.col("first.n").alias("n_")))
    keep = materialize(keep, "kept")
    inside, names = numbered(documents)
    kept = lambda k: inside.join(
        k, F.col(names["doc_id"]).eqNullSafe(F.col("keep_id_")) & (text_mark(names["text"]) == F.col("keep_mark_")))
    # rows of one id and text: the first of them as JSON, which orders columns of any type
    row = F.struct(*names.values())
    copies = kept(keep.filter("n_ > 1")).groupBy("keep_id_", "keep_mark_").agg(
        F.min_by(row, F.to_json(row, {"ignoreNullFields": "false"})).alias("row"))
    return kept(keep.filter("n_ = 1")).select(*names.values()).unionByName(
        copies.select("row.*")).toDF(*documents.columns)
