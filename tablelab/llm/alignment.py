"""Cross-tokenizer alignment with external spill counting.

Both tokenizations of a document are laid over its bytes. Which token ids overlap is counted over all
documents without a hash table of pairs: tasks gather pair-document records up to a bound, partition them by
the low bits of the first id (the radix), sort each partition first id first and spill it as a compressed
run. Runs are merged with a heap, a bounded number at a time, in as many levels as it takes. A merge that
passes an id pair by pair knows its largest count at the id's end. The counts are then streamed past the
runs' records, which gives what each partition contributes to each document.

A run's pairs are counted before they travel, and its records stay with the run, so a pair that nearly every
document holds is one entry per run and never a group of its own.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelab.llm.common import CACHE_ENTRIES
from tablelab.llm.packing import load_bpe
from tablelab.session import materialize

RADIXES = 64
# Records of a run, about: a document is never split.
RUN_RECORDS = 1 << 20
# Runs merged at once, and runs that one copy of the counts is streamed past.
MERGE_RUNS = 64
STREAM_RUNS = 1024
# Characters of the units that a task remembers.
CACHE_CHARACTERS = 1 << 23

# A unit begins at a single blank or line break behind a non-blank: no token of either side spans that.
_BREAK = re.compile(r"(?<=\S)(?=[ \n])")
_ODD_BLANKS = re.compile(r"[^\S \n]|\s\s|\s$")
_PLAIN_UNIT = re.compile(r"[ \n][^ \n]*")

DOCUMENT = pa.schema([
    ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
    ("n_links", pa.int64()), ("groups_sha256", pa.string())])
RESULT = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
          "groups_sha256 string")


class Units(dict):
    """What is known of each unit of a text: the groups as text, the linked id pairs (first id in the
    upper half) and the numbers of tokens of both sides, as bytes; None if the bytes of a side differ."""

    def __init__(self, byte_bpe: str, piece_bpe: str):
        super().__init__()
        import sentencepiece

        a = load_bpe(byte_bpe)
        self.encode_a = a.encode_ordinary
        self.a_bytes = [b""] * a.n_vocab
        for token, i in a._mergeable_ranks.items():
            self.a_bytes[i] = token
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_bpe)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = (np.array(list(map(len, t)), np.int64) for t in (self.a_bytes, self.b_bytes))
        self.blank = self.b.piece_to_id("▁")
        self.characters = 0
        # whether no piece reaches over the beginning of a unit, and nothing is rewritten before cutting
        self.cuts = not any("▁" in p.lstrip("▁") or "\n" in p for p in pieces) and all(
            self.b.decode(self.b.encode(t)) == t for t in ("ﬁ  　  x", "Å  "))

    def of(self, text: str) -> list[str]:
        """The units of a blank and the text."""
        full = " " + text
        if not self.cuts:
            return [full]
        return _BREAK.split(full) if _ODD_BLANKS.search(text) or text[0] in " \n" else _PLAIN_UNIT.findall(full)

    def learn(self, texts: list[list[str]]) -> None:
        """Makes the units of some texts known; earlier ones go when there are many."""
        if len(self) > CACHE_ENTRIES or self.characters > CACHE_CHARACTERS:
            self.clear()
            self.characters = 0
        new = list({u for units in texts for u in units if u not in self})
        self.characters += sum(map(len, new))
        # the model sets a blank before what it is given
        right = self.b.encode([u[1:] if u[0] == " " else u for u in new], num_threads=1)
        right = [[self.blank] if u == " " else b if u[0] == " " else b[1:] for u, b in zip(new, right)]
        self.align(new, list(map(self.encode_a, new)), right)

    def align(self, new: list[str], left: list[list[int]], right: list[list[int]]) -> None:
        """Remembers units and their tokens, all laid end to end.

        Between two neighbouring ends of tokens, of either side, exactly one token of each side overlaps.
        """
        if not new:
            return
        spelled = [u.encode() for u in new]
        a, b = (np.fromiter(chain.from_iterable(x), np.int64) for x in (left, right))
        n_a, n_b = (np.array(list(map(len, x)), np.int64) for x in (left, right))
        ends_a, ends_b = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        unit_ends = np.cumsum(list(map(len, spelled)))
        whole = b"".join(spelled)
        if not (len(a) and len(b)
                and np.array_equal(ends_a[np.cumsum(n_a) - 1], unit_ends)
                and np.array_equal(ends_b[np.cumsum(n_b) - 1], unit_ends)
                and b"".join(map(self.a_bytes.__getitem__, a.tolist())) == whole
                and b"".join(map(self.b_bytes.__getitem__, b.tolist())) == whole):
            same = [b"".join(map(self.a_bytes.__getitem__, x)) == u == b"".join(map(self.b_bytes.__getitem__, y))
                    for u, x, y in zip(spelled, left, right)]
            self.update((u, None) for u, ok in zip(new, same) if not ok)
            self.align(*([x for x, ok in zip(xs, same) if ok] for xs in (new, left, right)))
            return
        ends = np.union1d(ends_a, ends_b)
        pairs = a[np.searchsorted(ends_a, ends)] << 32 | b[np.searchsorted(ends_b, ends)]
        both = np.intersect1d(ends_a, ends_b, assume_unique=True)
        groups = map("|".join, zip(*(
            "".join(chain.from_iterable(zip(map(str, ids.tolist()), np.where(np.isin(at, both), "|", ",").tolist())))
            .split("|")[:-1] for ids, at in ((a, ends_a), (b, ends_b)))))
        breaks = np.where(np.isin(both, unit_ends), "\n", ";").tolist()
        texts = "".join(chain.from_iterable(zip(groups, breaks))).encode().split(b"\n")
        data, cuts = pairs.tobytes(), (8 * np.searchsorted(ends, unit_ends, "right")).tolist()
        sizes = np.stack([n_a, n_b], 1).tobytes()
        self.update((u, (t, data[s:e], sizes[16 * k:16 * k + 16]))
                    for k, (u, t, s, e) in enumerate(zip(new, texts, [0, *cuts], cuts)))


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays of one length in one compressed block."""
    return zstandard.ZstdCompressor(level=1).compress(b"".join(a.tobytes() for a in arrays))


def unsqueeze(block: bytes, *kinds) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(block)
    n = len(data) // sum(np.dtype(k).itemsize for k in kinds)
    out, at = [], 0
    for k in kinds:
        out.append(np.frombuffer(data, k, n, at))
        at += n * np.dtype(k).itemsize
    return out


class Run:
    """Documents and pair-document records of one run."""

    def __init__(self):
        self.documents: list[tuple] = []
        self.pairs: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.holders: list[np.ndarray] = []
        self.records = 0

    def add(self, doc_id, units: list | None) -> None:
        here = len(self.documents)
        if not units:
            self.documents.append((doc_id, 0, 0, 0, 0, ""))
            return
        groups = b";".join(u[0] for u in units)
        pairs, times = np.unique(np.frombuffer(b"".join(u[1] for u in units), np.uint64), return_counts=True)
        n_a, n_b = np.frombuffer(b"".join(u[2] for u in units), np.int64).reshape(-1, 2).sum(0).tolist()
        self.documents.append(
            (doc_id, n_a, n_b, groups.count(b"|"), int(times.sum()), hashlib.sha256(groups).hexdigest()))
        self.pairs.append(pairs)
        self.times.append(times.astype(np.uint32))
        self.holders.append(np.full(len(pairs), here, np.uint32))
        self.records += len(pairs)

    def spill(self, run: int) -> Iterator[tuple]:
        """``(run, radix, head, body)`` per radix: the pairs with their numbers of documents, and the records
        in the same order. Radix -1 holds the documents in its body."""
        columns = zip(*self.documents)
        table = pa.table([pa.array(c, f.type) for c, f in zip(columns, DOCUMENT)], schema=DOCUMENT)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, DOCUMENT) as out:
            out.write_table(table)
        yield run, -1, None, zstandard.ZstdCompressor(level=1).compress(sink.getvalue().to_pybytes())
        if not self.records:
            return
        pairs, times, holders = map(np.concatenate, (self.pairs, self.times, self.holders))
        radix = (pairs >> np.uint64(32)) % np.uint64(RADIXES)
        order = np.argsort(radix << np.uint64(56) | pairs, kind="stable")  # documents stay in order
        pairs, times, holders, radix = pairs[order], times[order], holders[order], radix[order]
        ends = np.searchsorted(radix, np.arange(RADIXES + 1))
        for r, (s, e) in enumerate(zip(ends[:-1], ends[1:])):
            if s < e:
                starts = np.flatnonzero(np.diff(pairs[s:e], prepend=pairs[s] + np.uint64(1)))
                count = np.diff(starts, append=e - s)
                yield (run, r, squeeze(pairs[s:e][starts], count.astype(np.int64)),
                       squeeze(holders[s:e], times[s:e]))


SPILLED = "run long, radix int, head binary, body binary"


def spill(documents: DataFrame, byte_bpe: str, piece_bpe: str) -> DataFrame:
    """The written runs of all documents."""
    target = pa.schema([("run", pa.int64()), ("radix", pa.int32()), ("head", pa.binary()), ("body", pa.binary())])

    def run(batches):
        units, first, no = Units(byte_bpe, piece_bpe), TaskContext.get().partitionId() << 32, 0
        held = Run()

        def batch():
            return pa.RecordBatch.from_pylist(
                [dict(zip(target.names, row)) for row in held.spill(first + no)], schema=target)

        for whole in batches:
            for begin in range(0, whole.num_rows, 256):
                part = whole.slice(begin, 256)
                cut = [units.of(t) if t else [] for t in part.column("text").to_pylist()]
                units.learn(cut)
                for doc, names in zip(part.column("doc_id").to_pylist(), cut):
                    known = [units[u] for u in names]
                    held.add(doc, None if None in known else known)
                    if held.records + len(held.documents) >= RUN_RECORDS:
                        yield batch()
                        held, no = Run(), no + 1
        if held.documents:
            yield batch()

    return materialize(documents.select("doc_id", "text").mapInArrow(run, SPILLED), "runs")


def merge(heads: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of all heads in order, their counts added up, and whether a count is its first id's largest.

    The heap holds where each head stands: at the pairs of which first id.
    """
    firsts = [h[0] >> np.uint64(32) for h in heads]
    edges = [np.flatnonzero(np.diff(f, prepend=f[:1] + np.uint64(1), append=f[-1:] + np.uint64(1))) for f in firsts]
    heap = [(int(f[0]), k, 0) for k, f in enumerate(firsts) if len(f)]
    heapq.heapify(heap)
    out: list[tuple] = []
    while heap:
        now, blocks = heap[0][0], []
        while heap and heap[0][0] == now:
            _, k, at = heap[0]
            s, e = edges[k][at], edges[k][at + 1]
            blocks.append((heads[k][0][s:e], heads[k][1][s:e]))
            if e < len(firsts[k]):
                heapq.heapreplace(heap, (int(firsts[k][e]), k, at + 1))
            else:
                heapq.heappop(heap)
        pairs, counts = blocks[0]
        if len(blocks) > 1:
            pairs, place = np.unique(np.concatenate([b[0] for b in blocks]), return_inverse=True)
            counts = np.zeros(len(pairs), np.int64)
            np.add.at(counts, place, np.concatenate([b[1] for b in blocks]))
        out.append((pairs, counts, counts == counts.max()))
    return tuple(np.concatenate(c) for c in zip(*out))


def _in_order(rows: DataFrame, keys: list[str], order: list[str], fn, schema: str) -> DataFrame:
    """``fn`` goes once through the rows of a task, as dicts sorted by ``keys`` and ``order``, and yields
    tuples; a row is a compressed block, so few are held at a time."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))

    def one_by_one(batches):
        for b in batches:
            for i in range(b.num_rows):
                yield {n: b.column(n)[i].as_py() for n in b.schema.names}

    def run(batches):
        for row in fn(one_by_one(batches)):
            yield pa.RecordBatch.from_pylist([dict(zip(target.names, row))], schema=target)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def totals(spilled: DataFrame, runs: int) -> DataFrame:
    """``(radix, head)``: counts and largest marks of all pairs of a radix, as ``merge`` gives them."""
    def merged(keep: int):
        def run(rows):
            at, heads = None, []
            for r in rows:
                if at != (r["radix"], r["chunk"]):
                    if heads:
                        yield *at, squeeze(*merge(heads)[:keep])
                    at, heads = (r["radix"], r["chunk"]), []
                heads.append(tuple(unsqueeze(r["head"], np.uint64, np.int64)))
            if heads:
                yield *at, squeeze(*merge(heads)[:keep])

        return run

    heads, level = spilled.filter("radix >= 0").select("run", "radix", "head"), 0
    while True:
        chunks, level = max(1, -(-runs // MERGE_RUNS)), level + 1
        dealt = heads.withColumn("chunk", F.pmod(F.xxhash64("run", F.lit(level)), F.lit(chunks)))
        last = chunks == 1
        # the marks of a part of the runs would mean nothing
        heads = materialize(_in_order(dealt, ["radix", "chunk"], ["run"], merged(3 if last else 2),
                                      "radix int, run long, head binary"), "merged")
        if last:
            return heads.select("radix", "head")
        runs = chunks


def contributions(spilled: DataFrame, counted: DataFrame, runs: int) -> DataFrame:
    """``(run, radix, body)``: what the links of a radix add to each document of a run."""
    def streamed(rows):
        for r in rows:
            if r["run"] < 0:  # the counts come before the runs they belong to
                pairs, counts, best = unsqueeze(r["head"], np.uint64, np.int64, np.bool_)
                continue
            own, holders_of = unsqueeze(r["head"], np.uint64, np.int64)
            holder, times = unsqueeze(r["body"], np.uint32, np.uint32)
            place = np.repeat(np.searchsorted(pairs, own), holders_of)
            many = times.astype(np.int64)
            docs, to = np.unique(holder, return_inverse=True)
            sums, bests = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
            np.add.at(sums, to, many * counts[place])
            np.add.at(bests, to, many * best[place])
            yield r["run"], r["radix"], squeeze(docs, bests, sums)

    chunks = max(1, -(-runs // STREAM_RUNS))
    slices = spilled.filter("radix >= 0").withColumn("chunk", F.pmod(F.xxhash64("run"), F.lit(chunks)))
    copies = counted.select(
        F.lit(-1).cast("long").alias("run"), "radix", "head", F.lit(None).cast("binary").alias("body"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("chunk"))
    return _in_order(slices.unionByName(copies), ["radix", "chunk"], ["run"], streamed,
                     "run long, radix int, body binary")


def align(documents: DataFrame, byte_bpe: str, piece_bpe: str) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` per row of ``(doc_id, text)``.

    A tokens are those of a blank and the text by ``byte_bpe``, B tokens those of the text by ``piece_bpe``;
    both are paths that are the same on every node, and special tokens' strings are plain text. A null or
    empty text, and one whose tokens do not spell it out, has no tokens: zeros and the empty text. Rows that
    share an id, and equal rows, are documents of their own. An empty table gives no rows. Other columns are
    not read.
    """
    spilled = spill(documents, byte_bpe, piece_bpe)
    docs = spilled.filter("radix = -1")
    runs = docs.count()
    added = contributions(spilled, totals(spilled, runs), runs)

    def finished(batches):
        held = None

        def batch():
            t, best, total = held
            return pa.RecordBatch.from_arrays(
                [*t.columns[:5], pa.array(best), pa.array(total), t.columns[5]], names=[
                    "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

        for b in batches:
            for radix, body in zip(b.column("radix").to_pylist(), b.column("body")):
                if radix < 0:  # a run begins with its documents
                    if held:
                        yield batch()
                    stream = zstandard.ZstdDecompressor().decompress(body.as_py())
                    t = pa.ipc.open_stream(stream).read_all().combine_chunks().to_batches()[0]
                    held = t, np.zeros(t.num_rows, np.int64), np.zeros(t.num_rows, np.int64)
                else:
                    at, best, total = unsqueeze(body.as_py(), np.uint32, np.int64, np.int64)
                    held[1][at] += best
                    held[2][at] += total
        if held:
            yield batch()

    parts = docs.select("run", "radix", "body").unionByName(added)
    return parts.repartition("run").sortWithinPartitions("run", "radix").mapInArrow(finished, RESULT)
