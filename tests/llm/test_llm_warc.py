"""Legacy archives to WARC: hand-made files, round trips and groups of equal payloads."""

import gzip
import io
from base64 import b32encode
from hashlib import sha1

import pytest

from busweave.llm import warc

HEAD = b"HTTP/1.1 200 OK\r\nX-Page-Id: %d\r\n\r\n"


def version_block(version, line_fields):
    block = b"%d 0 Crawler\n%s\n\n" % (version, warc.ARC_FIELDS[version].encode())
    return b"filedesc://old.arc 0.0.0.0 19970305120000 text/plain " + line_fields + b"%d\n" % len(block) + block


def arc_v1():
    page = HEAD % 7 + b"<p>one\n\ntwo</p>"
    dns = b"19970305\nhost. 10 IN A 1.2.3.4\n"
    return b"".join(
        [
            version_block(1, b""),
            b"\nhttp://a.example/x y z 1.2.3.4 19970305 text/html %d\n" % len(page), page,
            b"\n\ndns:host 1.2.3.4 199703051201 text/dns %d\n" % len(dns), dns,
            b"http://a.example/raw 1.2.3.4 19970305120203 no-type 5\nab\ncd",
        ]
    )


def arc_v2():
    page = HEAD % 9 + b""
    return version_block(2, b"200 - - 0 old.arc ") + b"http://b.example/ 5.6.7.8 20010203040506 text/html 200 abc - 77 old.arc %d\n" % len(page) + page + b"\n"


def records(data):
    out = []
    for number, fields, body in warc.read_arc(io.BufferedReader(io.BytesIO(data))):
        got = list(warc.read_warc(io.BufferedReader(io.BytesIO(warc.converted("f/old.arc", number, fields, body)))))
        assert len(got) == 1
        out.append(got[0])
    return out


def test_version_1():
    info, page, dns, raw = records(arc_v1())
    assert info[0]["warc-type"] == "warcinfo" and info[0]["warc-date"] == "1997-03-05T12:00:00Z"
    assert page[0]["warc-type"] == "response" and page[0]["warc-target-uri"] == "http://a.example/x y z"
    assert page[0]["warc-date"] == "1997-03-05T00:00:00Z" and page[0]["warc-ip-address"] == "1.2.3.4"
    assert page[0]["warc-payload-digest"] == "sha1:" + b32encode(sha1(b"<p>one\n\ntwo</p>").digest()).decode()
    assert page[1] == HEAD % 7 + b"<p>one\n\ntwo</p>"
    assert dns[0]["warc-type"] == "resource" and dns[0]["content-type"] == "text/dns" and dns[0]["warc-date"] == "1997-03-05T12:01:00Z"
    assert raw[0]["content-type"] == "application/octet-stream" and raw[1] == b"ab\ncd"
    assert len({r[0]["warc-record-id"] for r in (info, page, dns, raw)}) == 4
    assert [r[0]["warc-record-id"] for r in records(arc_v1())] == [r[0]["warc-record-id"] for r in (info, page, dns, raw)]


def test_version_2():
    info, page = records(arc_v2())
    assert page[0]["warc-target-uri"] == "http://b.example/" and page[0]["warc-date"] == "2001-02-03T04:05:06Z"
    assert page[0]["warc-payload-digest"] == "sha1:" + b32encode(sha1(b"").digest()).decode()


@pytest.mark.parametrize(
    "broken",
    [arc_v1()[:-1], arc_v1().replace(b"no-type 5", b"no-type x"), arc_v1().replace(b"1 0 Crawler", b"3 0 Crawler"), b"http://a 1.2.3.4 19970305 a 1\nx"],
)
def test_broken_archives_are_errors(broken):
    with pytest.raises(ValueError):
        records(broken)


def test_dates():
    assert warc.warc_date("2001") == "2001-01-01T00:00:00Z"
    with pytest.raises(ValueError):
        warc.warc_date("20010")


def test_files_of_both_versions(spark, tmp_path):
    (tmp_path / "a.arc").write_bytes(arc_v1())
    (tmp_path / "b.arc.gz").write_bytes(gzip.compress(arc_v2()))
    files = spark.createDataFrame([(str(tmp_path / "a.arc"), 4), (str(tmp_path / "b.arc.gz"), 2)], "file string, records long")
    out = warc.convert(files, str(tmp_path / "out"))
    assert sorted(r.records for r in out.collect()) == [2, 4]
    rows = warc.resolved(warc.read_records(out)).collect()
    assert sorted((r.page_id, r.record_type, r.payload_bytes, r.url) for r in rows) == [
        (7, "response", 15, "http://a.example/x y z"), (9, "response", 0, "http://b.example/")]


def brute(pages):
    best, out = {}, []
    for page_id, _, html in pages:
        key = (html or "").encode()
        best[key] = max(best.get(key, -1), -1 if page_id is None else page_id)
    for page_id, _, html in pages:
        data = (html or "").encode()
        first = page_id == best[data]
        out.append((page_id, len(data), b32encode(sha1(data).digest()).decode(), "response" if first else "revisit", None if first else best[data]))
    return sorted(out, key=str)


PAGES = [
    (1, "http://a/ b\nc", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "http://a", None), (4, "", ""), (5, "filedesc://x", "<p>é\r\n\r\n日本</p>"),
    (6, "dns:x", "WARC/1.1\r\n\r\n"), (None, "http://n", "<p>x</p>"), (7, "http://b", "y" * 300000), (8, "http://b", "y" * 300000),
    *[(100 + i, "http://c", f"page {i % 9}") for i in range(90)],
]


@pytest.mark.parametrize("file_bytes", [32_000_000, 2000])
def test_pages_round_trip(spark, file_bytes):
    rows = [(i, u, h, "n", 5) for i, u, h in PAGES]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, file string, sha int").repartition(3)
    got = warc.archive(pages, file_bytes).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert [t for _, t in got.dtypes] == ["bigint", "bigint", "string", "string", "bigint"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(PAGES)


def test_repeated_rows_and_empty_table(spark):
    pages = spark.createDataFrame([(1, "u", "a"), (1, "u", "a"), (0, "u", "a")], "page_id long, url string, html string")
    got = warc.archive(pages)
    assert sorted((r.page_id, r.record_type, r.refers_to is None) for r in got.collect()) == [(0, "revisit", False), (1, "response", True), (1, "revisit", False)]
    assert warc.archive(pages.limit(0)).count() == 0


def test_small_payloads_may_all_stay(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "a"), (2, "u", "a"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    arcs = warc.write_arcs(pages, str(tmp_path / "arc"))
    rows = warc.read_records(warc.convert(arcs, str(tmp_path / "warc"), least_bytes=2)).collect()
    assert sorted((r.page_id, r.record_type) for r in rows) == [(1, "response"), (2, "response"), (3, "revisit"), (4, "response")]
