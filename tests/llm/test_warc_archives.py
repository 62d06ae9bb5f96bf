"""Archives written in several commits, members of several records, and broken ones."""

import gzip
import io

import pytest

from tablelab.llm import warc
from tablelab.session import scratch_path

ROWS = [{"record_id": f"<urn:page:{i}>", "record_type": "response", "target_uri": f"http://x/{i}", "refers_to": None,
         "payload_digest": warc.base32_sha1_of(p), "payload_bytes": len(p), "payload": p}
        for i, p in enumerate([b"one", b"", b"x" * 400_000, b"\r\n\r\nfour"])]
EACH = [warc.record(r) for r in ROWS]


def read(data, wanted=lambda h: True, payload=True):
    return [(r["record_id"], r["payload"]) for r in warc.read_records(io.BytesIO(data), wanted, payload)]


@pytest.mark.parametrize("data", [
    b"".join(EACH), gzip.compress(b"".join(EACH)), warc.member(b"".join(EACH)),
    b"".join(map(warc.member, EACH)), gzip.compress(EACH[0] + EACH[1]) + warc.member(EACH[2] + EACH[3]),
    gzip.compress(b"".join(EACH) + b"\r\n"), gzip.compress(b"") + gzip.compress(b"".join(EACH))],
    ids=["plain", "one member", "one member with lengths", "member each", "two each", "blank end", "empty member"])
def test_every_record_of_a_member_is_read(data):
    want = [(r["record_id"], r["payload"]) for r in ROWS]
    assert read(data) == want
    assert read(data, lambda h: h["warc-record-id"] != "<urn:page:2>") == want[:2] + want[3:]
    assert read(data, payload=False) == [(i, None) for i, _ in want]


@pytest.mark.parametrize("data", [
    EACH[0] + b"WARC/1.0\r\nno end", gzip.compress(EACH[0] + b"WARC/1.0\r\nno end"),
    b"WARC/1.0\r\nWARC-Type: response\r\n\r\nno length\r\n\r\n", gzip.compress(b"".join(EACH))[:-20], EACH[2][:1000]],
    ids=["plain header", "header in a member", "no length", "cut member", "cut payload"])
def test_broken_archives_raise(data):
    with pytest.raises(ValueError):
        read(data)


def test_appended_and_overwritten_archives(spark):
    path = scratch_path(spark, "warc-commits")
    pages = lambda ids: spark.createDataFrame([(i, f"u{i}", f"html {i}") for i in ids], "page_id long, url string, html string")
    ids = lambda: sorted(r["record_id"] for r in warc.read_warc(spark, path, "record_id string").collect())
    warc.write_pages(pages([1, 2]), path)
    warc.write_pages(pages([3]), path)
    warc.write_pages(pages([]), path)
    assert ids() == [f"<urn:page:{i}>" for i in (1, 2, 3)]
    warc.page_records(pages([4])).write.format("warc").mode("overwrite").save(path)
    assert ids() == ["<urn:page:4>"]
