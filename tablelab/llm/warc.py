"""WARC archives as a Python data source, and page tables written to and read from them.

A record is one gzip member whose header carries the member's length (extra field ``SL``), so a reader
steps over unwanted members without inflating them. Record type and header predicates are pushed down:
a record's headers are parsed first, and the payload is inflated only if the record passes and the
payload column is asked for. Members without the extra field, members of several records and plain files are
read too.

A write is committed by a manifest; files of failed or repeated tasks are not in it and are never read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, StringStartsWith,
    WriterCommitMessage,
)

from tablelab.session import materialize, scratch_path

FIELDS = ("record_id string, record_type string, target_uri string, date string, refers_to string, "
          "payload_digest string, content_length long, http_length long, payload binary")
# Header behind each column that predicates can be pushed to.
HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri",
           "date": "warc-date", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}
WRITTEN = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"
# Begin of the names of manifests, one per write; they end in ``.json``.
MANIFEST = "_manifest"
# A file is closed and the next one begun beyond this size.
FILE_BYTES = 256 << 20
BATCH_BYTES = 8 << 20
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
_UNSAFE = re.compile(r"[\x00-\x20\x7f<>]")


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _manifests(files, base: str) -> list[str]:
    from pyarrow import fs

    found = files.get_file_info(fs.FileSelector(base, allow_not_found=True))
    return sorted(x.path for x in found if x.base_name.startswith(MANIFEST) and x.base_name.endswith(".json"))


# --- records

def record(row: dict) -> bytes:
    """The bytes of one record. A revisit has the HTTP header of its response, but no payload."""
    payload = row["payload"] or b""
    revisit = row["record_type"] == "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % row["payload_bytes"]
    block = http if revisit else http + payload
    head = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", row["record_id"]), ("WARC-Date", DATE),
            ("WARC-Payload-Digest", row["payload_digest"])]
    if row["target_uri"] is not None:
        head.append(("WARC-Target-URI", _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", row["target_uri"])))
    if revisit:
        head += [("WARC-Refers-To", row["refers_to"]), ("WARC-Profile", REVISIT_PROFILE)]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return text.encode() + block + b"\r\n\r\n"


def member(raw: bytes) -> bytes:
    """A gzip member that says how long it is."""
    squeeze = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = squeeze.compress(raw) + squeeze.flush()
    # 24 bytes of header and extra field, 8 of trailer
    extra = b"SL" + struct.pack("<HII", 8, (len(body) + 32) & 0xFFFFFFFF, len(raw) & 0xFFFFFFFF)
    return (b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body
            + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF))


def parse_headers(raw: bytes) -> dict[str, str]:
    out = {}
    for line in raw.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if colon:
            out[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    return out


class _Member:
    """Reads one gzip member, or one record of a plain file, from ``file`` at its position."""

    def __init__(self, file, start: int):
        self.file, self.start, self.next, self.whole, self.raw = file, start, None, None, b""
        file.seek(start)
        head = file.read(2)
        self.done = not head
        self.zipped = head == b"\x1f\x8b"
        self.inflate = zlib.decompressobj(31) if self.zipped else None
        if self.zipped:
            rest = file.read(10)
            if len(rest) == 10 and rest[1] & 4:
                extra = file.read(struct.unpack("<H", rest[8:10])[0])
                at = 0
                while at + 4 <= len(extra):
                    size = struct.unpack("<H", extra[at + 2:at + 4])[0]
                    if extra[at:at + 2] == b"SL" and size == 8:
                        packed, self.whole = struct.unpack("<II", extra[at + 4:at + 12])
                        self.next = start + packed
                    at += 4 + size
        file.seek(start)

    def more(self, size: int = 1 << 14) -> bool:
        """Read on; False at the end of the member or file."""
        if self.zipped and self.inflate.eof:
            return False
        chunk = self.file.read(size)
        if not chunk:
            return False
        self.raw += self.inflate.decompress(chunk) if self.zipped else chunk
        if self.zipped and self.inflate.eof:
            self.next = self.file.tell() - len(self.inflate.unused_data)
        return True

    def until(self, mark: bytes, begin: int = 0) -> int:
        """Position after ``mark``, reading as far as needed; -1 if there is none."""
        while (at := self.raw.find(mark, begin)) < 0:
            if not self.more():
                return -1
        return at + len(mark)

    def fill(self, size: int) -> None:
        while len(self.raw) < size and self.more(1 << 18):
            pass

    def skip(self, size: int) -> bool:
        """Leave out ``size`` bytes, holding none of them; False if the member has no more after them."""
        while len(self.raw) < size:
            size -= len(self.raw)
            self.raw = b""
            if not self.more(1 << 18):
                return False
        self.raw = self.raw[size:]
        while not self.raw:
            if not self.more():
                return False
        return True

    def end(self) -> int:
        """Where the next member begins."""
        if self.next is None:
            raise ValueError(f"the archive ends inside the gzip member at byte {self.start}")
        return self.next


def read_records(file, wanted, payload: bool) -> Iterator[dict]:
    """Records whose headers pass ``wanted(headers)``, as dicts of ``FIELDS``.

    A gzip member may hold any number of records; one whose header gives its lengths, and that a single record
    fills, is stepped over. A record without an end of its headers or a content length raises, and so does a
    file that ends inside a gzip member or a payload that is read.
    """
    at = 0
    while not (m := _Member(file, at)).done:
        more = True
        while more:
            body = m.until(b"\r\n\r\n")
            if body < 0 and not m.raw.strip(b"\r\n"):
                if not m.zipped:
                    return
                break
            headers = parse_headers(m.raw[:body]) if body >= 0 else {}
            if not headers.get("content-length", "").isdigit():
                raise ValueError(f"broken record headers in the member at byte {m.start}")
            length = int(headers["content-length"])
            if wanted(headers):
                out = {c: headers.get(h) for c, h in HEADERS.items()} | {
                    "content_length": length, "http_length": None, "payload": None}
                begin = body
                if headers.get("content-type", "").startswith("application/http"):
                    begin = m.until(b"\r\n\r\n", body)
                    http = parse_headers(m.raw[body:begin]).get("content-length")
                    out["http_length"] = int(http) if http and http.isdigit() else None
                if payload and out["record_type"] != "revisit":
                    m.fill(body + length)
                    if len(m.raw) < body + length:
                        raise ValueError(f"the archive ends inside a record of the member at byte {m.start}")
                    out["payload"] = m.raw[begin:body + length]
                yield out
            size = body + length + 4
            if not m.zipped:
                m.next, more = m.start + size, False
            else:
                more = m.whole != size and m.skip(size)
                m.whole = None
        at = m.end()


# --- data source

@dataclass
class WarcFile(InputPartition):
    path: str


@dataclass
class Written(WriterCommitMessage):
    files: list


class WarcReader(DataSourceReader):
    def __init__(self, schema, options):
        self.schema, self.path, self.tests = schema, options["path"], []

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in HEADERS and isinstance(f, EqualTo):
                self.tests.append((HEADERS[column], "in", {f.value}))
            elif column in HEADERS and isinstance(f, In):
                self.tests.append((HEADERS[column], "in", set(f.value)))
            elif column in HEADERS and isinstance(f, StringStartsWith):
                self.tests.append((HEADERS[column], "prefix", f.value))
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        files, base = _filesystem(self.path)
        if files.get_file_info(base).type == fs.FileType.File:
            return [WarcFile(base)]
        if manifests := _manifests(files, base):
            names = []
            for manifest in manifests:
                with files.open_input_stream(manifest) as f:
                    names += json.loads(f.read())
            return [WarcFile(f"{base}/{name}") for name in names]
        found = files.get_file_info(fs.FileSelector(base, recursive=True))
        return [WarcFile(x.path) for x in sorted(found, key=lambda x: x.path) if re.search(r"\.warc(\.gz)?$", x.path)]

    def wanted(self, headers: dict) -> bool:
        for name, kind, value in self.tests:
            got = headers.get(name)
            if got is None or not (got in value if kind == "in" else got.startswith(value)):
                return False
        return True

    def read(self, partition):
        from pyspark.sql.pandas.types import to_arrow_schema

        if partition is None:  # an archive without files
            return
        schema = to_arrow_schema(self.schema)
        files, _ = _filesystem(self.path)
        with files.open_input_file(partition.path) as file:
            held, size = [], 0
            for row in read_records(file, self.wanted, "payload" in schema.names):
                held.append(row)
                size += len(row["payload"] or b"") + 500
                if size > BATCH_BYTES:
                    yield _batch(held, schema)
                    held, size = [], 0
            if held:
                yield _batch(held, schema)


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in schema], schema=schema)


class WarcWriter(DataSourceArrowWriter):
    """One manifest per commit names the files of a write; an overwriting one then drops the others."""

    def __init__(self, options, overwrite: bool = False):
        self.path, self.overwrite = options["path"], overwrite
        files, base = _filesystem(self.path)
        files.create_dir(base, recursive=True)

    def write(self, iterator):
        files, base = _filesystem(self.path)
        names, out, size = [], None, 0
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if out is None:
                        names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                        out, size = files.open_output_stream(f"{base}/{names[-1]}", compression=None), 0
                    data = member(record(row))
                    out.write(data)
                    size += len(data)
                    if size > FILE_BYTES:
                        out.close()
                        out = None
        finally:
            if out is not None:
                out.close()
        return Written(names)

    def commit(self, messages):
        files, base = _filesystem(self.path)
        names = sorted(n for m in messages if m is not None for n in m.files)
        earlier = _manifests(files, base) if self.overwrite else []
        with files.open_output_stream(f"{base}/{MANIFEST}{uuid.uuid4().hex}.json", compression=None) as out:
            out.write(json.dumps(names).encode())
        for manifest in earlier:
            files.delete_file(manifest)

    def abort(self, messages):
        """Files without a manifest entry are never read."""


class WarcDataSource(DataSource):
    """``spark.read.format("warc")`` of a folder or file, and ``df.write.format("warc")`` of ``WRITTEN``."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return FIELDS

    def reader(self, schema):
        return WarcReader(schema, self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_warc(spark: SparkSession, path: str, columns: str = FIELDS) -> DataFrame:
    """Records of the archives under ``path``. ``columns`` is the schema to read: without ``payload``
    no payload is inflated. Filters on record type, ids, URI and digest reach the reader."""
    register(spark)
    return spark.read.format("warc").schema(columns).load(path)


# --- pages

_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: five hexadecimal digits are four characters."""
    digits = F.sha1(payload)
    out = []
    for i in range(0, 40, 5):
        value = F.conv(F.substring(digits, i + 1, 5), 16, 10).cast("int")
        out += [F.substr(F.lit(_ALPHABET), F.shiftright(value, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def base32_sha1_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def page_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """A row of ``WRITTEN`` per page. Of pages with equal payloads of at least ``min_bytes`` bytes, the
    smallest ``page_id`` is the response, and the others revisit it.

    A null html is an empty payload. A page without id is a response if no equal page has an id. Repeated
    rows of the response are responses.
    """
    full = pages.select("page_id", "url", F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")).alias("payload"))
    full = full.withColumns({"digest": base32_sha1(F.col("payload")), "size": F.length("payload").cast("long")})
    narrow = full.select("page_id", "digest", "size").filter(F.col("size") >= min_bytes)
    # written, so that the join below reads two shuffles and Spark can split a hot payload
    first = materialize(narrow.groupBy(F.col("digest").alias("digest_"), F.col("size").alias("size_")).agg(
        F.min("page_id").alias("response_id"), F.count("*").alias("n")).filter("n > 1"), "responses")
    revisits = narrow.join(first, (F.col("digest") == F.col("digest_")) & (F.col("size") == F.col("size_"))).filter(
        "response_id is not null and not (page_id <=> response_id)").select(
        F.col("page_id").alias("page_id_"), F.col("digest").alias("digest_"), "response_id").distinct()
    # pages move once, by their own id: no payload that many pages share is a key here
    joined = full.join(
        revisits, F.col("page_id").eqNullSafe(F.col("page_id_")) & (F.col("digest") == F.col("digest_")), "left")
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    again = F.col("response_id").isNotNull()
    return joined.select(
        urn("page_id").alias("record_id"), F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"), F.when(again, urn("response_id")).alias("refers_to"),
        F.concat(F.lit("sha1:"), "digest").alias("payload_digest"), F.col("size").alias("payload_bytes"),
        F.when(~again, F.col("payload")).alias("payload"))


def write_pages(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    register(pages.sparkSession)
    page_records(pages, min_bytes).write.format("warc").mode("append").save(path)


def page_round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write an archive of all pages and read it back: ``page_id, payload_bytes, payload_digest,
    record_type, refers_to``. Sizes and digests of responses are those of the payload read."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_pages(pages, path, min_bytes)
    back = read_warc(spark, path).filter(F.col("record_type").isin("response", "revisit"))
    page = lambda c: F.nullif(F.regexp_extract(c, "^<urn:page:(-?[0-9]*)>$", 1), F.lit("")).cast("long")
    response = F.col("record_type") == "response"
    return back.select(
        page("record_id").alias("page_id"),
        F.when(response, F.length("payload")).otherwise(F.col("http_length")).cast("long").alias("payload_bytes"),
        F.when(response, base32_sha1(F.col("payload")))
        .otherwise(F.regexp_replace("payload_digest", "^sha1:", "")).alias("payload_digest"),
        "record_type", page("refers_to").alias("refers_to"))
