import base64
import hashlib

import pytest

import __spark_entry__ as E
from ledgerlens.llm import warc as W
from ledgerlens.session import scratch_path


def digest(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def run(spark, pages, min_bytes=0):
    arc, path = scratch_path(spark, "test-arc"), scratch_path(spark, "test-warc")
    W.write_arc(pages, arc)
    W.convert(spark.read.parquet(arc), path, min_bytes)
    return W.read_warc(spark.read.parquet(path)).collect()


URLS = ["http://a/", "HTTPS://b/", "ftp://c/x", "mailto:d@e", "data:text/html,x", "file:///f", "dns:g", None, "", "filedesc://h", "urn:i"]


@pytest.mark.parametrize("made", [False, True])
def test_query_equals_brute_force(spark, tmp_path, made):
    sf = "/root/testdata/sf0.001"
    if made:        # pages of every scheme, each payload of its own and shared ones
        sf, rows = str(tmp_path), [(i, u, h) for i, (u, h) in enumerate((u, h) for u in URLS for h in (f"<p>{u}", "<p>x", None, "HTTP/1.1 200 OK"))]
        spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{sf}/pages.parquet")
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    last = {}
    for i in sorted(pages):
        last[pages[i]] = i
    want = {(i, len(b), digest(b), "response" if last[b] == i else "revisit", None if last[b] == i else last[b]) for i, b in pages.items()}
    rows = E.queries()["op10_warc"](spark, sf).collect()
    assert {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows} == want and len(rows) == len(pages)


def test_equal_payloads_and_odd_rows(spark):
    pages = spark.createDataFrame([
        (1, "http://a/", "same"), (2, "http://b/ c\n", "same"), (9, None, "same"), (None, "http://n/", "same"), (3, "u", None),
        (4, "u", ""), (5, "u", "é" * 5000), (6, "u", "\r\n\r\nWARC/1.1\r\n\n200"), (7, "u", "twin"), (7, "u", "twin")],
        "page_id long, url string, html string").selectExpr("*", "'mine' AS archive", "'mine' AS payload")
    rows = run(spark, pages)
    by = {}
    for r in rows:
        by.setdefault(r.page_id, []).append((r.payload_bytes, r.record_type, r.refers_to))
    assert by[1] == by[2] == by[None] == [(4, "revisit", 9)] and by[9] == [(4, "response", None)]
    assert by[3] == [(0, "revisit", 4)] and by[4] == [(0, "response", None)] and by[5] == [(10_000, "response", None)]
    assert sorted(by[7], key=str) == [(4, "response", None), (4, "revisit", 7)] and by[6][0][1] == "response"
    assert {r.url for r in rows if r.page_id in (2, 9)} == {"http://b/%20c%0A", "about:blank"}
    small = {r.page_id: r.record_type for r in run(spark, pages, 1)}
    assert small[3] == small[4] == "response" and small[1] == "revisit"
    assert run(spark, pages.limit(0)) == []


@pytest.mark.parametrize("version", [1, 2])
def test_header_lines_and_record_fields(version):
    block = W.http_block(5, b"body")
    data = W.member(W.arc_head("x.arc", version, "19991231235958")) + W.member(
        W.arc_record(version, "x.arc", "http://h/", "19991231235958", block, 77)) + W.member(
        W.arc_record(version, "x.arc", "http://i/", "20000101", block, 99))
    (one, body), (two, _) = W.arc_records("x.arc", data)
    assert body == block and one["URL"] == "http://h/" and one["Archive-date"] == "19991231235958"
    assert one.get("Offset") == (None if version == 1 else "77") and len(one) == (5, 10)[version - 1]
    record = W.warc_record(one, block, "x.arc", 0, None, False)
    (fields, back), = W.warc_records("x.warc", W.member(record))
    assert back == block and fields["warc-date"] == "1999-12-31T23:59:58Z" and fields["warc-type"] == "response"
    assert fields["warc-payload-digest"] == "sha1:" + digest(b"body") and fields["warc-record-id"].startswith("<urn:uuid:")
    (fields, back), = W.warc_records("x.warc", W.member(W.warc_record(two, block, "x.arc", 1, 8, True)))
    assert fields["warc-type"] == "revisit" and fields["refers-to-page-id"] == "8" and back.endswith(b"\r\n\r\n")
    with pytest.raises(ValueError):
        list(W.arc_records("x.arc", data[:-9]))
    cut = W.member(W.arc_head("x.arc", version, "1999")) + W.member(W.arc_record(version, "x", "u", "1999", block, 0)[:-3])
    with pytest.raises(ValueError):
        list(W.arc_records("x.arc", cut))


HTML = b"<p>caf\xe9</p>\n\nmore"
DNS = b"20010203040506\nwww.h.org. 300 IN A 1.2.3.4\n"
#: url, content type, block, type of the WARC record, payload
FOREIGN = [
    ("dns:www.h.org", "text/dns", DNS, "resource", DNS),
    ("dns:www.i.org", "text/dns", DNS + b"x", "resource", DNS + b"x"),
    ("http://h/bare", "text/html", b"HTTP/1.0 200 OK\nServer: caf\xe9\nContent-Type: text/html\n\n" + HTML, "response", HTML),
    ("http://h/crlf", "text/html", b"HTTP/1.1 200 OK\r\nX-Page-Id: n/a\r\n\r\n\n\n" + HTML, "response", b"\n\n" + HTML),
    ("http://h/again", "text/html", b"HTTP/1.1 200 OK\r\n\r\n" + HTML, "response", HTML),
    ("http://h/none", "text/html", HTML, "resource", HTML),
    ("ftp://h/f.bin", "image/gif", b"\xff\xfe\r\n\r\n\x00", "resource", b"\xff\xfe\r\n\r\n\x00"),
    ("dns:www.h.org", "text/dns", DNS, "resource", DNS),
]


def foreign(version, gz):
    """An ARC file as a crawler writes it: no carriage returns, a filedesc with metadata."""
    info = f"{version} 0 InternetArchive\n{W.FIELDS[version]}\n<arcmetadata>x</arcmetadata>\n".encode()
    rest = "" if version == 1 else "200 - - 0 old.arc "
    parts = [f"filedesc://old.arc 0.0.0.0 20010203040506 text/plain {rest}{len(info)}\n".encode() + info + b"\n"]
    for url, content, block, _, _ in FOREIGN:
        more = "" if version == 1 else f"200 {digest(block)} - 0 old.arc "
        parts.append(f"{url} 1.2.3.4 200102 {content} {more}{len(block)}\n".encode() + block + b"\n")
    return b"".join(map(W.member, parts)) if gz else W.member(b"".join(parts))


@pytest.mark.parametrize("version,gz", [(1, True), (1, False), (2, True)])
def test_archives_of_other_writers(spark, tmp_path, version, gz):
    path = scratch_path(spark, "foreign")
    (tmp_path / "old.arc.gz").write_bytes(foreign(version, gz))
    W.convert(W.read_files(spark, str(tmp_path)), path)
    out = spark.read.parquet(path)
    (name, data), = out.collect()
    (info, block), *records = W.warc_records(name, bytes(data))
    assert info["warc-type"] == "warcinfo" and info["content-type"] == "application/warc-fields"
    assert b"arc-filedesc: filedesc://old.arc" in block and b"<arcmetadata>x</arcmetadata>" in block
    types = [f["warc-type"] for f, _ in records]
    want = [x[3] for x in FOREIGN]
    want[0] = want[2] = "revisit"
    assert types == want
    for (fields, block), (url, content, was, kind, payload) in zip(records, FOREIGN, strict=True):
        assert fields["warc-target-uri"] == url and fields["warc-date"] == "2001-02-01T00:00:00Z"
        assert fields["warc-payload-digest"] == "sha1:" + digest(payload) and fields["warc-ip-address"] == "1.2.3.4"
        assert fields["content-type"] == ("application/http;msgtype=response" if kind == "response" else content)
        assert block == (was if fields["warc-type"] != "revisit" else was.removesuffix(payload))
    ids = [f["warc-record-id"] for f, _ in records]
    assert records[0][0]["warc-refers-to"] == ids[7] and records[2][0]["warc-refers-to"] == ids[4]
    assert len({*ids, info["warc-record-id"]}) == 9
    rows = W.read_warc(out).collect()
    assert [(r.payload_bytes, r.record_type) for r in rows] == [(len(x[4]), t) for x, t in zip(FOREIGN, want, strict=True)]
