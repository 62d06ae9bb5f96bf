"""Best-fit packing with certified bin counts.

Documents become token pieces of at most ``SEQUENCE`` ids. Pieces are dealt to groups of bounded size;
each group packs best-fit decreasing and compares its bin count with a lower bound from dual-feasible
functions: a group that meets it is certified, no packing of its pieces needs fewer bins. While the bins of
all groups together miss the bound of all pieces, groups exchange: the pieces of bins with room are pooled,
dealt anew and packed again, and the new packing is taken if it needs fewer bins.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablelab.llm.common import CACHE_ENTRIES
from tablelab.operators.dataset import with_row_ids
from tablelab.session import materialize

SEQUENCE = 2048
GROUP_PIECES = 8192
ROUNDS = 3
# A group holds fewer bins than 2 ** BIN_BITS.
BIN_BITS = 20
SEPARATOR = 0
# Fixed value: how a byte-level BPE vocabulary of this kind cuts text into pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Blanks that stand in a run or at an end, or are none of the usual two.
_ODD_BLANKS = re.compile(r"[^\S \n]|\s\s|^\s|\s$")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary: printable Latin-1 letters for themselves,
    the other bytes, in order, for the code points from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_bpe(path: str):
    """The vocabulary of a tokenizer file. Merge order is id order in it, so ids serve as ranks."""
    import tiktoken

    letters = byte_letters()
    with open(path, encoding="utf-8") as f:
        stored = json.load(f)
    vocabulary = stored["model"]["vocab"]
    ranks = {bytes(letters[c] for c in token): i for token, i in vocabulary.items() if all(c in letters for c in token)}
    special = {t["content"]: t["id"] for t in stored["added_tokens"]}
    for t in special:
        ranks.pop(t.encode(), None)
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


class TokenIds(dict):
    """Token ids (little-endian unsigned 32-bit) of the words of texts, remembered.

    The file's added tokens have ids of their own in a text, as `tokenizers` has it by default;
    ``encode_special_tokens`` spells them out like other text.
    """

    def __init__(self, path: str, encode_special_tokens: bool = False):
        super().__init__()
        bpe = load_bpe(path)
        self.encode_word = bpe.encode_ordinary
        self.added = {} if encode_special_tokens else {
            t: array("I", [bpe.encode_single_token(t)]).tobytes() for t in bpe.special_tokens_set}
        # the longest one first, where one begins another
        self.cut = re.compile("(%s)" % "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))))

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        ids = self[word] = array("I", self.encode_word(word)).tobytes()
        return ids

    def encode(self, text: str) -> bytes:
        if not any(t in text for t in self.added):
            return self.encode_plain(text)
        return b"".join(self.added.get(x) or self.encode_plain(x) for x in self.cut.split(text) if x)

    def encode_plain(self, text: str) -> bytes:
        """Same ids as of the whole text: a single blank between two others begins a pre-token with what
        follows it, a single line break is one by itself. Texts with other blanks are not cut."""
        if _ODD_BLANKS.search(text):
            return array("I", self.encode_word(text)).tobytes()
        words: list[str] = []
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            words.append(first)
            words += [f" {w}" for w in rest]
            words.append("\n")
        return b"".join(map(self.__getitem__, words[:-1]))


def pieces(documents: DataFrame, tokenizer: str, length: int = SEQUENCE, encode_special_tokens: bool = True) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)`` of every document's token pieces.

    ``tokenizer`` is the path of the vocabulary, the same on every node. A document is its ids and a closing 0. Longer ones are cut into pieces of ``length``; the first
    piece is the shorter one. A null or empty text is the closing 0 alone.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                        ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        ids = TokenIds(tokenizer, encode_special_tokens)
        for whole in batches:
            for begin in range(0, whole.num_rows, 256):
                batch = whole.slice(begin, 256)
                rows = []
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                    encoded = ids.encode(text or "") + SEPARATOR.to_bytes(4, "little")
                    total = len(encoded) // 4
                    first = total % length or length
                    starts = [0, *range(first, total, length)]
                    for k, (s, e) in enumerate(zip(starts, [*starts[1:], total])):
                        rows.append((doc, k, s, e - s, zlib.crc32(encoded[4 * s:4 * e])))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return documents.select("doc_id", "text").mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def lower_bound(sizes: np.ndarray, capacity: int, counts: np.ndarray | None = None) -> int:
    """Bins that any packing needs, by two families of dual-feasible functions. ``counts`` says how
    often each size occurs (once).

    A dual-feasible function maps sizes so that whatever fits into a bin still sums to at most 1. The
    first family rounds: above ``capacity - t`` counts fully, below ``t`` not at all. The second
    steps: ``floor((k + 1) x / capacity) / k``, or ``x`` where that is whole.
    """
    count = np.zeros(capacity + 1, np.int64)
    np.add.at(count, sizes, 1 if counts is None else counts)
    x = np.flatnonzero(count)
    many = count[x]
    best = -(-int((x * many).sum()) // capacity)
    for t in np.unique(np.minimum(x, capacity - x)):
        value = np.where(x > capacity - t, capacity, np.where(x < t, 0, x))
        best = max(best, -(-int((value * many).sum()) // capacity))
    for k in range(1, 30):
        scaled = (k + 1) * x
        # in units of 1 / (k * capacity)
        value = np.where(scaled % capacity == 0, x * k, scaled // capacity * capacity)
        best = max(best, -(-int((value * many).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each piece. Bins wait in stacks by room left; the set of rooms in use is one integer."""
    out = np.empty(len(sizes), np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    in_use, bins = 0, 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fitting = in_use >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                in_use ^= 1 << room
        else:
            room, b, bins = capacity, bins, bins + 1
        out[i] = b
        left = room - size
        if left:
            stacks[left].append(b)
            in_use |= 1 << left
    return out


_PACKED = "row long, length long, g long, bin long, gap long, room long"


def _pack(rows: DataFrame, capacity: int) -> DataFrame:
    """Pack each group ``g`` of ``(row, length, g)``; adds ``bin``, the group's ``gap`` between bins and
    bound, and the ``room`` left in the bin."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "row"], kind="stable", ignore_index=True)
        sizes = frame["length"].to_numpy()
        frame["bin"] = best_fit_decreasing(sizes, capacity)
        frame["gap"] = frame["bin"].max() + 1 - lower_bound(sizes, capacity)
        frame["room"] = capacity - frame.groupby("bin")["length"].transform("sum")
        return frame[["row", "length", "g", "bin", "gap", "room"]]

    return rows.groupBy("g").applyInPandas(run, _PACKED)


def _deal(rows: DataFrame, n: int, most: int, level: int) -> DataFrame:
    groups = max(1, -(-n // most))
    return rows.withColumn("g", F.pmod(F.xxhash64("row", F.lit(level)), F.lit(groups)) + F.lit(level << 36))


def pack_lengths(rows: DataFrame, capacity: int = SEQUENCE, most: int = GROUP_PIECES,
                 rounds: int = ROUNDS) -> DataFrame:
    """``(row, g, bin, gap)``: a bin of group ``g`` for each ``(row, length)``; rows are distinct.

    ``gap`` is between the group's bins and its own bound. A packing that meets the bound of all pieces
    is certified and final. Otherwise groups give up the pieces of their bins with room; these are dealt
    to groups of twice the size and packed again, as long as that saves bins.
    """
    # at most ``capacity`` rows: how many pieces there are of each length
    lengths = rows.groupBy("length").count().toArrow().to_pandas()
    n = int(lengths["count"].sum())
    bound = lower_bound(lengths["length"].to_numpy(np.int64), capacity, lengths["count"].to_numpy(np.int64)) if n else 0
    packed = materialize(_pack(_deal(rows, n, most, 0), capacity), "packed")
    placed, closed = [], 0
    for level in range(1, rounds):
        now = packed.agg(F.count_distinct("g", "bin").alias("bins"), F.count_distinct("g").alias("groups")).first()
        if closed + now["bins"] == bound or now["groups"] <= 1:
            break
        loose = packed.filter("room > 0")
        old = loose.agg(F.count("*").alias("n"), F.count_distinct("g", "bin").alias("bins")).first()
        again = materialize(
            _pack(_deal(loose.select("row", "length"), old["n"], most << level, level), capacity), "packed")
        if again.agg(F.count_distinct("g", "bin")).first()[0] >= old["bins"]:
            break  # the exchange saved no bin: the earlier packing stays
        placed.append(packed.filter("room = 0"))
        closed += now["bins"] - old["bins"]
        packed = again
    for more in placed:
        packed = packed.unionByName(more)
    return packed.select("row", "g", "bin", "gap")


def pack(documents: DataFrame, tokenizer: str, capacity: int = SEQUENCE, encode_special_tokens: bool = True) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Offsets are gapless from 0 in each sequence. Repeated rows and equal ids are packed each on its own;
    a full piece is a sequence by itself. An empty table gives no rows.
    """
    cut = materialize(pieces(documents, tokenizer, capacity, encode_special_tokens), "pieces")
    # a row's number is its place in the written table, so a repeated task gives the same one
    numbered = with_row_ids(cut, "row")
    whole = numbered.filter(F.col("length") == capacity).withColumns(
        {"sequence_id": -1 - F.col("row"), "offset": F.lit(0).cast("long")})
    part = numbered.filter(F.col("length") < capacity)
    bins = pack_lengths(part.select("row", "length"), capacity)
    joined = part.join(bins.withColumnRenamed("row", "row_"), F.col("row") == F.col("row_"))
    before = Window.partitionBy("g", "bin").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    joined = joined.withColumns({
        "offset": F.coalesce(F.sum("length").over(before), F.lit(0)),
        "sequence_id": F.shiftleft("g", BIN_BITS) + F.col("bin"),
    })
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return whole.select(*columns).unionByName(joined.select(*columns))
