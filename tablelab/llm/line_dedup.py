"""Line deduplication across documents: fuzzy lines by MinHash, one line kept per component.

Lines are normalised (lower case, single blanks). Exact copies meet through a 128-bit digest. For fuzzy
copies, MinHash signatures of character shingles are cut into bands; lines that share a band are compared
by exact Jaccard similarity of their shingle sets; verified links become components by distributed
union-find, and each component keeps its first line in order of ``(doc_id, line number)``.

Only digests and band keys of all lines are shuffled. The text of a line is sent on only where a
fixed-size filter says that it may have a candidate. Documents are read twice, for band keys and for digests with
those texts, before what is left of them is put together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelab.llm.common import (
    MIX, arrow_map, bit_filter, bounded_groups, components, in_groups, local_stars, numbered, passes, text_mark, text_marks,
    texts,
)
from tablelab.session import materialize

# Characters of a shingle. A changed character leaves a similarity of 0.8 in lines of 49 characters or more,
# a changed number of four digits from 76 on.
SHINGLE = 5
# A pair with a line of fewer than SHORT_CHARS characters is compared by SHORT_SHINGLE: one changed character
# leaves 0.8 from 29 characters on, four digits from 56 on.
SHORT_SHINGLE, SHORT_CHARS = 3, 80
SIMILARITY = 0.8
# Shingles of a line that may be similar to a short one, at most.
SHORT_SET = (SHORT_CHARS - SHORT_SHINGLE) / SIMILARITY
# Bands of rows: a pair at the threshold shares a band with probability 0.994, one at 0.85 with 0.9993. Short
# shingles are common to many lines, so they take more rows to a band.
BANDS, ROWS = 13, 5
SHORT_BANDS, SHORT_ROWS = 28, 8
# Only blank lines always stay.
MIN_CHARS = 1
# Lines that a task remembers having sent on, before it forgets them.
SEEN = 200_000
# Characters hashed together, for signatures and for sets.
SIGNED_CHARS, BLOCK_CHARS = 100_000, 12_000
# Characters of a line whose shingles are counted first, and lines at a time.
BEGIN_CHARS, BEGIN_ROWS = 160, 256
# Characters of the lines of groups that go on together, and shingles of pairs compared together.
SET_CHARS, PAIR_SHINGLES = 4_000_000, 20_000
# Bits of a hashed shingle below the number of its line.
HASH_BITS = 42
# Bits of the hashes in the bitmaps that rule pairs out, lines whose bitmaps are made together, and pairs looked at together.
MARK_BITS, MARK_ROWS, MARK_PAIRS = 12, 64, 2_000
# Shingles by which hashes may miscount; pairs as near to the threshold are decided on the text.
DOUBT = 1
# Band rows packed at once and in a row, buckets for each partition of a shuffle, and rows of a bucket held at once.
PACKED, PACK, BUCKETS, HELD = 1 << 20, 512, 16, 1 << 23
# A shingle of three characters in 64 bits, and hashed to 16.
_POINT, _SMALL = np.uint64(1 << 21), np.uint16(0x9E35)
_PRIME, _MIX32 = np.uint32(0x01000193), np.uint32(0x85EBCA6B)
_DRAWN = np.random.default_rng(20240229)
_HASHES = max(BANDS * ROWS, SHORT_BANDS * SHORT_ROWS)
_SPREAD = _DRAWN.integers(0, 1 << 32, _HASHES, dtype=np.uint32)
_FACTORS = _DRAWN.integers(0, 1 << 32, _HASHES, dtype=np.uint32) | np.uint32(1)
_WIDE = np.uint64(0x100000001B3)
_NO_LINKS = pd.DataFrame({"a": [], "b": []}, dtype="int64")


_BLANKS = re.compile(r"[ \t\r\v\f]+")


def _odd_blanks(text: str) -> bool:
    return "  " in text or "\t" in text or "\r" in text or "\v" in text or "\f" in text or text[:1] == " " or text[-1:] == " "


def normalise(line: str) -> str:
    """Lower case, ASCII blanks collapsed and stripped."""
    line = line.lower()
    return _BLANKS.sub(" ", line).strip(" ") if _odd_blanks(line) else line


def normalised_lines(text: str) -> list[str]:
    """Every line of a text, normalised. No letter's lower case depends on what is behind a line break, so a text
    is put in lower case, and searched for blanks to change, as a whole."""
    text = text.lower()
    lines = text.split("\n")
    if _odd_blanks(text) or " \n" in text or "\n " in text:
        return [_BLANKS.sub(" ", x).strip(" ") if _odd_blanks(x) else x for x in lines]
    return lines


def lines_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[bytes], list[bytes]]:
    """Place of the row, line number, digest and normalised line (UTF-8) of the lines that take part, which are all but
    blank ones. The texts of a batch are searched for blanks to change, and cut into lines, together."""
    values = [t.lower() if t.isascii() else t.decode().lower().encode() for t in texts(batch)]
    whole = b"\n".join(values)
    lines = whole.split(b"\n") if values else []
    byte = np.frombuffer(whole, np.uint8)
    ends = np.cumsum(np.fromiter(map(len, values), np.int64, len(values)) + 1)  # behind the line break of each
    breaks = byte == 10
    counts = np.diff(np.searchsorted(np.append(np.flatnonzero(breaks), len(byte)), ends), prepend=0)
    gap = breaks | (byte == 32)
    odd = (byte - np.uint8(9) < 5) ^ breaks
    odd[1:] |= gap[1:] & gap[:-1] & ~(breaks[1:] & breaks[:-1])
    odd[:1] |= byte[:1] == 32
    odd[-1:] |= byte[-1:] == 32
    begins = np.cumsum(counts) - counts
    for row in np.unique(np.searchsorted(ends, np.flatnonzero(odd), "right")).tolist():
        lines[begins[row]:begins[row] + counts[row]] = [x.encode() for x in normalised_lines(values[row].decode())]
    row = np.repeat(np.arange(len(values)), counts)
    number = np.arange(len(row)) - np.repeat(begins, counts)
    some = np.fromiter(map(len, lines), np.int64, len(lines)) >= MIN_CHARS
    lines = [x for x in lines if len(x) >= MIN_CHARS]
    return row[some], number[some], list(map(xxhash.xxh3_128_digest, lines)), lines


def halves(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)


def signatures(lines: list[str], size: int = SHINGLE, hashes: int = BANDS * ROWS) -> np.ndarray:
    """MinHash values, one row per line. Lines go in small blocks, whose arrays stay in the cache."""
    lines = [x if len(x) >= size else x.ljust(size) for x in lines]
    out = np.empty((len(lines), hashes), np.uint32)
    begin, chars = 0, 0
    for i, line in enumerate(lines):
        chars += len(line)
        if chars > SIGNED_CHARS or i == len(lines) - 1:
            out[begin:i + 1] = _signatures(lines[begin:i + 1], size, hashes)
            begin, chars = i + 1, 0
    return out


def grams(text: str, size: int, prime=_PRIME) -> np.ndarray:
    """Hashes of the ``size`` characters from each character on, put together from those of 1, 2, 4, ...; their
    width is that of ``prime``."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(prime.dtype, copy=False)
    rolled, part, have, done, factor = None, points, 1, 0, prime
    left, mask = size, (1 << 8 * prime.itemsize) - 1
    while left:
        if left & 1:
            rolled = part.copy() if rolled is None else rolled[:len(part) - done] * factor + part[done:]
            done += have
        left >>= 1
        part = part[:-have] * factor + part[have:] if left else part
        factor, have = prime.dtype.type(int(factor) ** 2 & mask), have * 2
    return rolled[:len(points) - size + 1]


def _signatures(lines: list[str], size: int, hashes: int) -> np.ndarray:
    rolled = grams("".join(lines), size)
    lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    begins = np.cumsum(lengths) - lengths
    inside = np.ones(lengths.sum(), bool)
    for k in range(1, size):
        inside[begins + lengths - k] = False
    values = rolled[inside[:len(rolled)]]
    values ^= values >> np.uint32(16)
    values *= _MIX32
    values ^= values >> np.uint32(13)
    starts = np.cumsum(lengths - size + 1) - (lengths - size + 1)
    out = np.empty((len(lines), hashes), np.uint32)
    turned = np.empty_like(values)
    for k, (spread, factor) in enumerate(zip(_SPREAD[:hashes], _FACTORS[:hashes])):
        np.bitwise_xor(values, spread, out=turned)
        np.multiply(turned, factor, out=turned)
        out[:, k] = np.minimum.reduceat(turned, starts)
    return out


def band_keys(signature: np.ndarray, bands: int = BANDS, first: int = 0) -> np.ndarray:
    """One 64-bit key per band; bands are numbered from ``first``."""
    rows = signature.astype(np.uint64).reshape(len(signature), bands, -1)
    key = np.broadcast_to(np.arange(first, first + bands, dtype=np.uint64), rows.shape[:2]).copy()
    for k in range(rows.shape[2]):
        key = (key ^ rows[:, :, k]) * MIX
        key ^= key >> np.uint64(31)
    return key.view(np.int64)


def meets_short(line: str) -> bool:
    """Whether a line of fewer than ``SHORT_CHARS`` characters may be similar to this one.

    Sets of that similarity differ in size by it at most; a long line of a repeated pattern has a small set.
    """
    found: set[str] = set()
    for at in range(0, max(1, len(line) - SHORT_SHINGLE + 1), BEGIN_CHARS):
        found |= shingles(line[at:at + BEGIN_CHARS + SHORT_SHINGLE - 1], SHORT_SHINGLE)
        if len(found) > SHORT_SET:
            return False
    return True


def meet_short(lines: list[str]) -> list[int]:
    """Places of the lines that ``meets_short``. The begin of a line mostly has enough shingles already, by the
    number of their hashes, which is never larger than theirs; those of a line no longer than that are counted."""
    chars = np.fromiter(map(len, lines), np.int64, len(lines))
    meets = chars - SHORT_SHINGLE + 1 <= SHORT_SET
    rest = np.flatnonzero(~meets)
    whole = chars[rest] < BEGIN_CHARS
    for rows, filled, kind, factor in ((rest[whole], True, np.uint64, _POINT), (rest[~whole], False, np.uint16, _SMALL)):
        for at in range(0, len(rows), BEGIN_ROWS):
            part = rows[at:at + BEGIN_ROWS]
            begins = "".join([lines[i][:BEGIN_CHARS].ljust(BEGIN_CHARS) for i in part.tolist()])
            points = np.frombuffer(begins.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, BEGIN_CHARS).astype(kind)
            if filled:
                points[np.arange(BEGIN_CHARS) >= chars[part, None]] = factor - kind(1)  # no character
            width = BEGIN_CHARS - SHORT_SHINGLE + 1
            values = points[:, :width].copy()
            for k in range(1, SHORT_SHINGLE):
                values *= factor
                values += points[:, k:k + width]
            values.sort(axis=1)
            counts = 1 + np.count_nonzero(values[:, 1:] != values[:, :-1], axis=1)
            if filled:
                # less the shingles that hold filling: one for each place where it begins
                meets[part] = counts - np.minimum(BEGIN_CHARS - chars[part], SHORT_SHINGLE) <= SHORT_SET
            else:
                meets[part] = [few and meets_short(lines[i]) for i, few in zip(part.tolist(), (counts <= SHORT_SET).tolist())]
    return np.flatnonzero(meets).tolist()


def line_bands(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``(key, place)`` of the bands of lines; ``place`` is the line's. Both lines of a pair have the bands
    of the shingle that the pair is compared by."""
    long = [i for i, x in enumerate(lines) if len(x) >= SHORT_CHARS]
    short = meet_short(lines)
    keys, places = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    if long:
        keys.append(band_keys(signatures([lines[i] for i in long])).ravel())
        places.append(np.repeat(long, BANDS))
    if short:
        marks = signatures([lines[i] for i in short], SHORT_SHINGLE, SHORT_BANDS * SHORT_ROWS)
        keys.append(band_keys(marks, SHORT_BANDS, BANDS).ravel())
        places.append(np.repeat(short, SHORT_BANDS))
    return np.concatenate(keys), np.concatenate(places)


class _Packed:
    """Band rows ``(key, id)`` of a task, packed by bucket of the key: rows ``(bucket, keys, ids)``, whose ``keys`` and
    ``ids`` are up to ``PACK`` longs each."""

    def __init__(self, buckets: int):
        self.buckets, self.keys, self.ids, self.size = buckets, [], [], 0

    def add(self, keys: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.keys.append(keys)
        self.ids.append(ids)
        self.size += len(keys)
        if self.size >= PACKED:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        keys, ids = np.concatenate(self.keys), np.concatenate(self.ids)
        self.keys, self.ids, self.size = [], [], 0
        bucket = (keys.view(np.uint64) % np.uint64(self.buckets)).astype(np.uint16 if self.buckets <= 1 << 16 else np.int32)
        order = np.argsort(bucket, kind="stable")  # of two bytes: a radix sort
        bucket = bucket[order]
        new = np.append(True, bucket[1:] != bucket[:-1])
        place = np.arange(len(bucket))
        place -= np.maximum.accumulate(np.where(new, place, 0))
        begins = np.flatnonzero(place % PACK == 0)
        ends = pa.py_buffer((np.append(begins, len(bucket)) * 8).astype(np.int32))
        column = lambda x: pa.Array.from_buffers(pa.binary(), len(begins), [None, ends, pa.py_buffer(x[order])])
        yield pa.RecordBatch.from_arrays([pa.array(bucket[begins].astype(np.int32)), column(keys), column(ids)],
                                         names=["bucket", "keys", "ids"])


_PACKED_SCHEMA = "bucket int, keys binary, ids binary"


def _buckets(df: DataFrame) -> int:
    return BUCKETS * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def candidate_bands(documents: DataFrame) -> DataFrame:
    """Packed ``(key, id)`` per band of each line; a task sends a line once, however often it occurs."""
    buckets = _buckets(documents)

    def run(batches):
        seen: set = set()
        packed = _Packed(buckets)
        for batch in batches:
            # long texts: a few hundred documents at a time keep the working memory small
            for start in range(0, batch.num_rows, 1000):
                if len(seen) > SEEN:
                    seen.clear()
                _, _, digests, lines = lines_of(batch.slice(start, 1000))
                fresh = {d: x for d, x in zip(digests, lines) if d not in seen}
                if fresh:
                    seen.update(fresh)
                    keys, places = line_bands([x.decode() for x in fresh.values()])
                    yield from packed.add(keys, halves(list(fresh))[:, 0][places])
        yield from packed.rest()
        pa.default_memory_pool().release_unused()

    return documents.select("text").mapInArrow(run, _PACKED_SCHEMA)


def _longs(column: pa.Array, begin: int, end: int) -> np.ndarray:
    """The longs packed in some rows of a binary column, which lie one after another."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset + begin:column.offset + end + 1]
    return np.frombuffer(data, np.int64, (at[-1] - at[0]) // 8, at[0]) if at[-1] > at[0] else np.empty(0, np.int64)


_MARKED = ["key", "id", "n", "s"]


def _several(key: np.ndarray, id_: np.ndarray) -> pa.RecordBatch:
    """The distinct rows of the keys that have several ids. The first row of a key has its smallest id, their number
    ``n`` and a sum ``s`` of them, the others have 0."""
    order = np.argsort(key)
    key = key[order]
    same = key[1:] == key[:-1]
    several = np.append(False, same) | np.append(same, False)
    key, id_ = key[several], id_[order[several]]
    order = np.lexsort((id_, key))
    key, id_ = key[order], id_[order]
    new = np.append(True, (key[1:] != key[:-1]) | (id_[1:] != id_[:-1]))[:len(key)]
    key, id_ = key[new], id_[new]
    same = key[1:] == key[:-1]
    many = (np.append(False, same) | np.append(same, False))[:len(key)]
    key, id_ = key[many], id_[many]
    begins = np.flatnonzero(np.append(True, key[1:] != key[:-1])[:len(key)])
    n, s = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
    if len(key):
        n[begins] = np.diff(np.append(begins, len(key)))
        mixed = id_.view(np.uint64) * MIX
        mixed ^= mixed >> np.uint64(31)
        s[begins] = np.add.reduceat(mixed * MIX, begins).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (key, id_, n, s)], names=_MARKED)


def _unmarked(key: np.ndarray, id_: np.ndarray) -> pa.RecordBatch:
    """Rows of keys that may have more of them."""
    none = pa.nulls(len(key), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(id_), none, none], names=_MARKED)


def shared_bands(bands: DataFrame) -> DataFrame:
    """``(key, id)`` of the keys that several lines have, from such rows, packed or not."""
    return marked_bands(bands).select("key", "id")


def marked_bands(bands: DataFrame) -> DataFrame:
    """``shared_bands`` with the marks of ``_several``, null in rows of a bucket that was not held as a whole.

    Read bucket by bucket, with one bucket held; rows are distinct. Of a bucket of more than ``HELD`` rows all go
    on, also those of keys that no other line has, which the groups to come leave out, and some may go on twice.
    """
    if "keys" not in bands.columns:
        buckets = _buckets(bands)

        def pack(batches):
            packed = _Packed(buckets)
            for batch in batches:
                yield from packed.add(batch.column("key").to_numpy(), batch.column("id").to_numpy())
            yield from packed.rest()

        bands = bands.mapInArrow(pack, _PACKED_SCHEMA)

    def run(batches):
        held, keys, ids, size, large = None, [], [], 0, False

        def sent():
            key, id_ = np.concatenate(keys), np.concatenate(ids)
            return (_unmarked if large else _several)(key, id_)

        for batch in batches:
            bucket = batch.column("bucket").to_numpy()
            begins = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[:len(bucket)])
            for begin, end in zip(begins.tolist(), [*begins[1:].tolist(), len(bucket)]):
                if bucket[begin] != held:
                    if keys:
                        yield sent()
                    held, keys, ids, size, large = bucket[begin], [], [], 0, False
                keys.append(_longs(batch.column("keys"), begin, end))
                ids.append(_longs(batch.column("ids"), begin, end))
                size += len(keys[-1])
                if size > HELD:
                    large = True
                    yield sent()
                    keys, ids, size = [], [], 0
        if keys:
            yield sent()

    return bands.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "key long, id long, n long, s long")


def without_twins(members: DataFrame) -> DataFrame:
    """``(key, id, size)`` of one key of those that hold the same lines, from ``marked_bands``."""
    marks = members.filter("n > 0").select("key", "s", "n", F.col("id").alias("m")).unionByName(
        members.filter("n is null").groupBy("key").agg(
            F.expr("cast(pmod(sum(cast(xxhash64(id) as decimal(38,0))), 9223372036854775808BD) as bigint)").alias("s"),
            F.count("*").alias("n"), F.min("id").alias("m")))
    kept = marks.groupBy("s", "n", "m").agg(F.min("key").alias("kept_key"))
    return members.select("key", "id").join(
        kept.select("kept_key", F.col("n").alias("size")), F.col("key") == F.col("kept_key")).select("key", "id", "size")


def shingles(line: str, size: int | None = None) -> set[str]:
    """The line's shingles; their size goes by its length if not given."""
    size = size or (SHORT_SHINGLE if len(line) < SHORT_CHARS else SHINGLE)
    return {line[i:i + size] for i in range(max(1, len(line) - size + 1))}


def similar(one: str, other: str, size: int, similarity: float = SIMILARITY) -> bool:
    """Whether the Jaccard similarity of two lines' shingle sets is high enough."""
    mine, others = shingles(one, size), shingles(other, size)
    both = len(mine & others)
    return both >= similarity * (len(mine) + len(others) - both)


def ragged(begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Places ``begin ... begin + count - 1`` of each range, one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins - ends + counts, counts)


class ShingleSets:
    """Shingles of lines: a bitmap of their hashes for every line, sorted hashes for those of pairs that bitmaps do not
    rule out, each made once per line for all its pairs."""

    def __init__(self, lines: list[str], size: int):
        self.lines, self.size = lines, size
        self.filled = [x if len(x) >= size else x.ljust(size) for x in lines]
        self.chars = np.fromiter(map(len, self.filled), np.int64, len(lines))
        self.sets: list[np.ndarray | None] = [None] * len(lines)
        self.counts = np.zeros(len(lines), np.int64)
        self.marks = np.empty((len(lines), (1 << MARK_BITS) // 64), np.uint64)
        for begin, end in self._blocks(self.chars, MARK_ROWS):
            self.marks[begin:end] = self._marks(begin, end)

    @staticmethod
    def _blocks(chars: np.ndarray, most: int | None = None) -> Iterator[tuple[int, int]]:
        """Small blocks of lines, whose arrays stay in the cache."""
        ends, at = np.cumsum(chars), 0
        while at < len(chars):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK_CHARS, "right")))
            end = min(end, at + most) if most else end
            yield at, end
            at = end

    def _marks(self, begin: int, end: int) -> np.ndarray:
        """Which hashes the shingles of each line have, as bits."""
        lengths = self.chars[begin:end]
        ends = np.cumsum(lengths)
        begins = ends - lengths
        hashed = grams("".join(self.filled[begin:end]), self.size) * _MIX32 >> np.uint32(32 - MARK_BITS)
        cell = np.repeat(np.arange(end - begin) << MARK_BITS, lengths)
        cell[:len(hashed)] += hashed
        for k in range(1, self.size):  # across two lines: the line's first shingle once more
            cell[ends - k] = cell[begins]
        found = np.zeros((end - begin, 1 << MARK_BITS), bool)
        found.ravel()[cell] = True
        return np.packbits(found, axis=1).view(np.uint64)

    def _block(self, lines: list[str], lengths: np.ndarray) -> np.ndarray:
        """Distinct hashed shingles, the line's number above them, sorted."""
        counts = lengths - self.size + 1
        hashed = grams("".join(lines), self.size, _WIDE) * MIX >> np.uint64(64 - HASH_BITS)
        hashed = hashed[ragged(np.cumsum(lengths) - lengths, counts)]
        hashed |= np.repeat(np.arange(len(lines), dtype=np.uint64) << np.uint64(HASH_BITS), counts)
        hashed.sort()
        return hashed[np.append(True, hashed[1:] != hashed[:-1])]

    def _build(self, places: np.ndarray) -> None:
        """The sets of some lines, if they are not there yet."""
        places = places[self.counts[places] == 0]
        for begin, end in self._blocks(self.chars[places]):
            part = places[begin:end]
            block = self._block([self.filled[i] for i in part.tolist()], self.chars[part])
            ends = np.searchsorted(block.view(np.int64) >> HASH_BITS, np.arange(len(part)), "right")
            block &= np.uint64((1 << HASH_BITS) - 1)
            self.counts[part] = np.diff(ends, prepend=0)
            at = 0
            for i, until in zip(part.tolist(), ends.tolist()):
                self.sets[i] = block[at:until]
                at = until

    def linked(self, a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
        """Whether each pair of lines is similar enough, exactly."""
        # a bit that one line alone has is of a shingle that the other does not have, and similar sets differ in few
        most = (self.chars[a] + self.chars[b] - 2 * (self.size - 1)) * (1 - similarity) / (1 + similarity) + 1e-6
        ok = np.empty(len(a), bool)
        for at in range(0, len(a), MARK_PAIRS):
            p = slice(at, at + MARK_PAIRS)
            ok[p] = np.bitwise_count(self.marks[a[p]] ^ self.marks[b[p]]).sum(axis=1, dtype=np.uint32) <= most[p]
        left = np.flatnonzero(ok)
        self._build(np.unique(np.concatenate([a[left], b[left]])))
        one, other = self.counts[a], self.counts[b]
        least = similarity * (one + other) / (1 + similarity)  # shingles that such a pair shares
        ok[left] = np.minimum(one, other)[left] + DOUBT >= least[left]
        left = np.flatnonzero(ok)
        ends = np.cumsum(one[left] + other[left])
        at = 0
        while at < len(left):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIR_SHINGLES, "right")))
            p = left[at:end]
            both = self._shared(a[p], b[p])
            ok[p] = both >= least[p]
            for i in p[np.abs(both - least[p]) <= DOUBT]:
                ok[i] = similar(self.lines[a[i]], self.lines[b[i]], self.size, similarity)
            at = end
        return ok

    def _shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        # a pair at a time in the upper bits, as many as they hold
        out = np.empty(len(a), np.int64)
        for at in range(0, len(a), 1 << 64 - HASH_BITS):
            rows = np.stack([a[at:at + (1 << 64 - HASH_BITS)], b[at:at + (1 << 64 - HASH_BITS)]], axis=1)
            counts = self.counts[rows].sum(axis=1)
            keys = np.concatenate([self.sets[i] for i in rows.ravel().tolist()])
            keys |= np.repeat(np.arange(len(rows), dtype=np.uint64) << np.uint64(HASH_BITS), counts)
            keys.sort()
            twice = keys[1:][keys[1:] == keys[:-1]] >> np.uint64(HASH_BITS)
            out[at:at + len(rows)] = np.bincount(twice.astype(np.int64), minlength=len(rows))
        return out


def verified_links(frame: pd.DataFrame, similarity: float = SIMILARITY) -> pd.DataFrame:
    """Links that join the same lines as all pairs of a group ``g`` with enough exact Jaccard similarity.

    Pairs already joined in their group are not compared again, nor are sets whose sizes, or bitmaps, rule
    the similarity out. All groups go on together, frames of many characters in parts: each line in turn meets
    those behind it in its group. A pair of which one line is short is compared by the smaller shingles.
    """
    frame = frame.drop_duplicates(["g", "id"])
    frame = frame.iloc[np.argsort(frame["g"].to_numpy(), kind="stable")]
    groups = frame["g"].to_numpy()
    begins = np.flatnonzero(np.append(True, groups[1:] != groups[:-1])[:len(groups)])
    chars = np.add.reduceat(frame["line"].str.len().to_numpy(), begins) if len(begins) else np.empty(0, np.int64)
    part = np.cumsum(chars) // SET_CHARS
    out = []
    for k in np.unique(part):
        of = np.flatnonzero(part == k)
        end = begins[of[-1] + 1] if of[-1] + 1 < len(begins) else len(frame)
        out.append(_verified_links(frame.iloc[begins[of[0]]:end], similarity))
    return pd.concat(out, ignore_index=True) if out else _NO_LINKS


def star_links(frame: pd.DataFrame) -> pd.DataFrame:
    """The verified links of a frame's groups, as one link per line to the smallest line that it reaches there."""
    links = verified_links(frame)
    if links.empty:
        return links
    ids, places = np.unique(links.to_numpy().ravel(), return_inverse=True)
    ends = places.reshape(-1, 2)
    low = ids[local_stars(len(ids), ends[:, 0], ends[:, 1])]
    return pd.DataFrame({"a": ids, "b": low})[ids != low]


def _verified_links(frame: pd.DataFrame, similarity: float) -> pd.DataFrame:
    ids, groups = frame["id"].to_numpy(), frame["g"].to_numpy()
    kinds, line_of = np.unique(ids, return_inverse=True)
    lines = dict(zip(ids.tolist(), frame["line"]))
    lines = [lines[i] for i in kinds.tolist()]
    short = np.fromiter(map(len, lines), np.int64, len(lines))[line_of] < SHORT_CHARS
    group = np.cumsum(np.append(True, groups[1:] != groups[:-1])) - 1
    begins = np.flatnonzero(np.append(True, groups[1:] != groups[:-1]))
    counts = np.diff(np.append(begins, len(ids)))
    # lines whose set of each size is needed
    near_short = np.bincount(group, short)[group] > 0
    sets, number = {}, {}
    for size, rows in ((SHORT_SHINGLE, near_short), (SHINGLE, ~short)):
        used = np.unique(line_of[rows])
        if len(used):
            sets[size] = ShingleSets([lines[i] for i in used], size)
            number[size] = np.searchsorted(used, line_of)
    label = np.arange(len(ids))
    found_a, found_b = [], []
    for turn in range(int(counts.max()) - 1):
        at = np.flatnonzero(counts > turn + 1)
        a = np.repeat(begins[at] + turn, counts[at] - turn - 1)
        b = ragged(begins[at] + turn + 1, counts[at] - turn - 1)
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
        if not len(a):
            continue
        small = short[a] | short[b]
        ok = np.zeros(len(a), bool)
        for size, chosen in ((SHORT_SHINGLE, small), (SHINGLE, ~small)):
            if chosen.any():
                of = number[size]
                ok[chosen] = sets[size].linked(of[a[chosen]], of[b[chosen]], similarity)
        a, b = a[ok], b[ok]
        if not len(a):
            continue
        found_a.append(ids[a])
        found_b.append(ids[b])
        # within a group all of them meet its one line of this turn
        least = np.full(len(begins), len(ids))
        np.minimum.at(least, group[a], np.minimum(label[a], label[b]))
        joined = np.zeros(len(ids), bool)
        joined[label[a]] = joined[label[b]] = True
        joined = joined[label]
        label = np.where(joined, least[group], label)
    if not found_a:
        return _NO_LINKS
    return pd.DataFrame({"a": np.concatenate(found_a), "b": np.concatenate(found_b)})


def occurrences(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """``(doc_id, mark, line_no, id, check, candidate, line)`` of every line that takes part; id and check are its
    digest, ``mark`` tells texts of one id apart. ``candidate`` says that the id may be among ``ids``; a task gives such
    a line's text, which is null else, once while it remembers it."""
    wanted = documents.sparkSession.sparkContext.broadcast(bit_filter(ids, "id"))

    def per_task():
        seen: set = set()

        def step(batch):
            if len(seen) > SEEN:
                seen.clear()
            row, number, digests, lines = lines_of(batch)
            if not digests:
                return None
            both = halves(digests)
            candidate = passes(wanted.value, both[:, 0])
            sent: list[bytes | None] = [None] * len(lines)
            for i in np.flatnonzero(candidate).tolist():
                if digests[i] not in seen:
                    seen.add(digests[i])
                    sent[i] = lines[i]
            return {"doc_id": batch.column("doc_id").take(pa.array(row)), "mark": text_marks(texts(batch))[row],
                    "line_no": number.astype(np.int32), "id": both[:, 0], "check": both[:, 1], "candidate": candidate,
                    "line": pa.array(sent, pa.binary())}

        return step

    return arrow_map(documents.select("doc_id", "text"), per_task,
                     "doc_id long, mark long, line_no int, id long, check long, candidate boolean, line string")


def candidate_lines(found: DataFrame) -> DataFrame:
    """``(id, line)`` of the candidates among ``occurrences``."""
    # shuffled first, so that rows are sorted once, for this and for the join to come
    return found.filter("line is not null").select("id", "line").repartition("id").dropDuplicates(["id"])


def duplicate_lines(documents: DataFrame) -> DataFrame:
    """``(doc_id, mark, line_no)`` of every line that a line in front of it stands for, once per row of the
    document that repeats."""
    members = materialize(
        without_twins(materialize(marked_bands(candidate_bands(documents)), "bands")), "members")
    found = materialize(occurrences(documents, members.select("id")), "lines")
    lines = candidate_lines(found)
    met = bounded_groups(members, "key", "id", size="size").select("g", F.col("id").alias("met_id"))
    groups = met.join(lines, F.col("met_id") == F.col("id")).select("g", "id", "line")
    linked = components(in_groups(groups, star_links, "a long, b long"))
    # the first place of each line that occurs again or is linked; most lines are neither, and only candidates are linked
    again = materialize(
        found.groupBy("id", "check").agg(F.min(F.struct("doc_id", "line_no", "mark")).alias("own"), F.count("*").alias("n"),
                                         F.max("candidate").alias("candidate"))
        .filter("n > 1 or candidate").join(linked, F.col("id") == F.col("node"), "left").filter("n > 1 or component is not null")
        .select("id", "check", "own", "component"), "again")
    of_class = materialize(again.filter("component is not null").groupBy(F.col("component").alias("class")).agg(
        F.min("own").alias("first")), "classes")
    first = materialize(again.join(of_class, F.col("component") == F.col("class"), "left").select(
        F.col("id").alias("id_"), F.col("check").alias("check_"), F.coalesce("first", "own").alias("first")), "first")
    # both sides were written, so that the join reads two shuffles and Spark can split a hot line
    return found.join(first, (F.col("id") == F.col("id_")) & (F.col("check") == F.col("check_"))).filter(
        "not (doc_id <=> first.doc_id and mark = first.mark and line_no = first.line_no)").select(
        "doc_id", "mark", "line_no")


def dedup_lines(documents: DataFrame) -> DataFrame:
    """The documents without duplicate lines: ``text`` is what is left, other columns stay as they are.

    Adds ``n_lines_removed``. Rows with one ``doc_id`` and text count as one document, different
    texts of one ``doc_id`` (or of none) each as its own. Null text stays null,
    empty text empty; a document may lose all its lines and then has an empty text. Blank lines always stay.
    Other columns may have any name and type, but for ``n_lines_removed``.
    """
    gone = duplicate_lines(documents).groupBy(F.col("doc_id").alias("gone_id_"), F.col("mark").alias("gone_mark_")).agg(
        F.collect_set("line_no").alias("gone_"))
    inside, names = numbered(documents)
    text = names["text"]
    joined = inside.join(
        gone, F.col(names["doc_id"]).eqNullSafe(F.col("gone_id_")) & (text_mark(text) == F.col("gone_mark_")), "left")
    kept = F.array_join(F.filter(
        F.split(text, "\n", -1), lambda _, i: ~F.array_contains("gone_", i.cast("int"))), "\n")
    left = F.when(F.col("gone_").isNull(), F.col(text)).otherwise(kept)
    return joined.select(
        *[(left if n == text else F.col(n)).alias(c) for c, n in names.items()],
        F.when(F.col("gone_").isNull(), 0).otherwise(F.size("gone_")).cast("long").alias("n_lines_removed"))
