"""Archives: exact round trips, revisits by a plain loop, damage, and files of other writers."""

import base64
import gzip
import hashlib
import io
import os
import random
import zlib
from collections import Counter

import oracle
import pytest
from pyarrow import fs

from chronolith.llm import queries, warc

DATA = "/root/testdata/sf0.001"


def b32(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def plain(pages, least=0):
    last = {}
    for page_id, _, html in pages:
        if page_id is not None:
            last[html or ""] = max(last.get(html or "", page_id), page_id)
    out = []
    for page_id, _, html in pages:
        body = (html or "").encode()
        top = last.get(html or "") if len(body) >= least else None
        again = top is not None and (page_id is None or page_id < top)
        out.append((page_id, len(body), b32(body), "revisit" if again else "response", top if again else None))
    return Counter(out)


def rows_of(frame):
    return Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in frame.collect() if r.record_type != "warcinfo")


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, monkeypatch, least):
    """Nulls, empty and very long payloads, odd urls, groups of copies cut into parts, repeated rows, several files a task."""
    monkeypatch.setattr(warc, "PART", 7)
    rng = random.Random(1)
    pages = [(i, f"http://a.b/{i}", rng.choice(["<p>same</p>", "", None, f"<p>{i} é 日本</p>", "\r\n\r\nWARC/1.1", "abc"])) for i in range(300)]
    pages += [(900, None, "x" * 3_000_000), (901, "http://ü/ a\r\nb", "y\0" * 100_000), (902, "", "x" * 3_000_000), (None, "u", "abc"), (None, "u", "only null"), (903, "twice", "twice"), (903, "twice", "twice"), (-5, "minus", "minus")]
    frame = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, key string").repartition(6)
    archive = warc.write(frame, least_bytes=least, file_bytes=20_000)
    found = warc.read(archive.files, keep_payloads=True).collect()
    assert archive.files.agg({"records": "sum"}).first()[0] == len(pages) and archive.files.count() > 3
    assert not [r for r in found if r.fault]
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found if r.record_type != "warcinfo") == plain(pages, least)
    texts = {(p[0], p[2] or "") for p in pages}
    assert all((r.page_id, bytes(r.payload).decode()) in texts for r in found if r.record_type == "response")
    for f in archive.files.collect():  # any reader of gzip sees as many members as records, and the file's size
        store, inner = fs.FileSystem.from_uri(f.path)
        raw = store.open_input_file(inner).read()
        members = 0
        while raw:
            z = zlib.decompressobj(31)
            assert z.decompress(raw).startswith(b"WARC/1.1\r\n") and z.eof
            raw, members = z.unused_data, members + 1
        assert members == f.records + 1
    archive.drop(spark)
    assert fs.FileSystem.from_uri(archive.folder)[0].get_file_info(fs.FileSystem.from_uri(archive.folder)[1]).type == fs.FileType.NotFound


def _file(*members):
    return io.BytesIO(b"".join(members))


def test_damaged_files(monkeypatch):
    """Each kind of damage gives its fault, and the records around it are read."""
    good = [warc.page_record(i, f"http://p/{i}", os.urandom(3000).hex().encode(), None, "d") for i in range(3)]
    text = gzip.decompress(good[1])

    def read(data):
        return [(r["record_id"], r["fault"]) for r in warc.records(io.BytesIO(data), len(data))]

    sound = [("urn:page:0", None), ("urn:page:1", None), ("urn:page:2", None)]
    for piece in (7, 64, 1 << 16):
        monkeypatch.setattr(warc, "PIECE", piece)
        assert read(b"".join(good)) == sound
        for middle, fault in {
            gzip.compress(text.replace(b"Content-Length: 6", b"Content-Length: 5")): "record doesn't end with its content length",
            gzip.compress(text[:-4]): "record doesn't end with its content length",
            gzip.compress(text[:-300]): "record shorter than its content length",
            gzip.compress(text.replace(b"\r\n\r\n", b"\r\n", 1).replace(b"Content-Length", b"Content-Width")): "no content length",
            gzip.compress(text[:-100] + b"0" * 96 + text[-4:]): "payload digest differs",
            gzip.compress(text.replace(b"text/html", b"text/xml ")): "block digest differs",
            gzip.compress(b"no record\r\n\r\n"): "no record",
            gzip.compress(b"no line end"): "head cut off",
        }.items():
            got = read(good[0] + middle + good[2])
            assert [got[0], got[2]] == [sound[0], sound[2]] and len(got) == 3 and got[1][1] == fault, (piece, fault, got)
        broken = bytearray(good[1])
        broken[len(broken) // 2] ^= 0xFF
        got = read(good[0] + bytes(broken) + good[2])
        assert [got[0], got[-1]] == [sound[0], sound[2]] and len(got) == 3 and got[1][1]
        got = read(good[0] + good[1][:1500] + good[2])  # cut off, then the next
        assert got[0] == sound[0] and got[-1] == sound[2] and got[1][1] and len(got) == 3
        assert read(good[0] + good[1][:1500])[1:] == [("urn:page:1", "member cut off")]
        assert read(b"not gzip at all" + good[2])[-1] == sound[2]
        assert read(b"") == []


def test_records_of_other_writers():
    """No digests, header names in any case, other records than pages."""
    head = b"WARC/1.0\r\nwarc-type: metadata\r\nWARC-Record-ID: <urn:uuid:1>\r\ncontent-length: 5\r\n\r\n"
    data = gzip.compress(head + b"a\r\n\r\n" + b"\r\n\r\n")
    (row,) = warc.records(io.BytesIO(data), len(data))
    assert row["fault"] is None and row["record_type"] == "metadata" and row["payload_bytes"] == 5 and row["payload_digest"] == b32(b"a\r\n\r\n")


def test_empty_table(spark):
    archive = warc.write(spark.createDataFrame([], "page_id long, url string, html string"))
    assert archive.files.count() == 0 and warc.read(archive.files).count() == 0


@pytest.mark.skipif(not os.path.exists(DATA), reason="needs the driver's tables")
def test_query_equals_its_sql(spark):
    assert oracle.differences(spark, oracle.connect(DATA), queries.op11_warc_records, warc.ORACLE, DATA) == []
