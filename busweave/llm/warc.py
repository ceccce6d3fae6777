"""WARC archives out of legacy ARC archives.

An ARC file starts with a version block that names the version and the fields of the header line before each record;
the line's last field is the record's length. The converter reads both versions, takes every record by its declared
length and writes a WARC record with an identifier, a timestamp, a type and digests of its own making. Responses of
equal payload are told apart over all archives: one stays, the others become revisits of it.

Archives are compressed record by record. Each task writes files under names of its own, and only the stored list
of files that comes from the tasks that succeeded says which of them count.
"""

from __future__ import annotations

import gzip
import io
import re
import uuid
import zlib
from base64 import b32encode
from collections.abc import Iterator
from hashlib import sha1, sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from busweave.llm.common import small_batches
from busweave.llm.tokenfiles import filesystem
from busweave.session import checkpointed, scratch_dir

#: Fields of a header line by version, and the WARC profile of a revisit.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of records after which a task begins another file.
FILE_BYTES = 32_000_000
LEVEL = 1


def digest(data: bytes) -> str:
    """Base32 of SHA-1, as WARC headers carry it after ``sha1:``."""
    return b32encode(sha1(data).digest()).decode()


def member(data: bytes) -> bytes:
    """A gzip member of its own for one record."""
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def opened(path: str) -> io.BufferedReader:
    """The archive's bytes, decompressed where they are a gzip file."""
    system, at = filesystem(path)
    with system.open_input_stream(at, compression=None) as source:
        packed = source.read(2) == b"\x1f\x8b"
    source = system.open_input_stream(at, compression=None)
    return io.BufferedReader(gzip.GzipFile(fileobj=source) if packed else source, 1 << 20)


def exactly(source: io.BufferedReader, length: int, what: str) -> bytes:
    data = source.read(length)
    if len(data) != length:
        raise ValueError(f"{what}: {length} bytes declared, {len(data)} left")
    return data


# ARC


def arc_line(version: int, url: str, date: str, kind: str, length: int, offset: int = 0, code: str = "200", ip: str = "0.0.0.0") -> bytes:
    fields = [url, ip, date, kind, str(length)]
    if version == 2:
        fields[4:4] = [code, "-", "-", str(offset), "-"]
    return " ".join(fields).encode() + b"\n"


def arc_head(version: int, name: str, date: str) -> bytes:
    block = f"{version} 0 converted\n{ARC_FIELDS[version]}\n\n".encode()
    return arc_line(version, f"filedesc://{name}", date, "text/plain", len(block)) + block


def read_arc(source: io.BufferedReader) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """``(number, fields, body)`` of every record; number 0 is the version block."""
    number, names = 0, None
    while line := source.readline():
        line = line.rstrip(b"\r\n")
        if not line:  # records may be set apart by any number of empty lines
            continue
        # Only the URL may hold spaces, so that fields are counted from the end.
        last = line.rpartition(b" ")[2]
        if not last.isdigit():
            raise ValueError(f"record {number}: no length in its header line")
        body = exactly(source, int(last), f"record {number}")
        if names is None:
            lines = body.split(b"\n")
            version = lines[0].split(b" ")[0]
            if not line.startswith(b"filedesc:") or version not in (b"1", b"2"):
                raise ValueError("no version block of version 1 or 2")
            names = ARC_FIELDS[int(version)].split(" ")
        fields = line.decode("utf-8", "replace").rsplit(" ", len(names) - 1)
        if len(fields) != len(names):
            raise ValueError(f"record {number}: {len(fields)} fields in its header line, {len(names)} expected")
        yield number, dict(zip(names, fields)), body
        number += 1


# WARC


def warc_date(date: str) -> str:
    """Timestamp of an ARC date; what its digits leave out is the earliest possible."""
    if not re.fullmatch(r"\d{4,14}", date) or len(date) % 2:
        raise ValueError(f"not an archive date: {date}")
    full = date + "00000101000000"[len(date) :]
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:14]}Z"


def warc_record(headers: dict[str, str], block: bytes) -> bytes:
    lines = "".join(f"{name}: {value}\r\n" for name, value in headers.items())
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def read_warc(source: io.BufferedReader) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers, by lower-case name, and block of every record."""
    while line := source.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError("no WARC record where one should begin")
        headers = {}
        while (line := source.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().partition(":")
            headers[name.lower()] = value.strip()
        block = exactly(source, int(headers["content-length"]), headers.get("warc-record-id", "record"))
        exactly(source, 4, "end of record")
        yield headers, block


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """Head of a response, its empty line included, and payload."""
    end = re.search(rb"\r?\n\r?\n", block)
    return (block[: end.end()], block[end.end() :]) if end else (block, b"")


def http_field(head: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^" + re.escape(name.encode()) + rb":[ \t]*([^\r\n]*)", head)
    return found[1].decode("utf-8", "replace").strip() if found else None


def record_id(archive: str, number: int) -> str:
    """Identifier that follows from the archive's name and the record's place in it."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{number}')}>"


def base_name(path: str) -> str:
    return path.rpartition("/")[2]


def converted(path: str, number: int, fields: dict[str, str], body: bytes, same_as: dict | None = None) -> bytes:
    """WARC record of one ARC record; ``same_as`` names the response that a revisit refers to."""
    headers = {
        "WARC-Type": "resource",
        "WARC-Record-ID": record_id(base_name(path), number),
        "WARC-Date": warc_date(fields["Archive-date"]),
        "WARC-Target-URI": fields["URL"],
        "WARC-IP-Address": fields["IP-address"],
        "Content-Type": fields["Content-type"],
    }
    if number == 0:
        info = f"software: arc converter\r\nformat: WARC File Format 1.1\r\ndescription: {base_name(path)}\r\n".encode()
        own = {name: headers[name] for name in ("WARC-Record-ID", "WARC-Date")}
        return warc_record({"WARC-Type": "warcinfo", **own, "Content-Type": "application/warc-fields"}, info)
    if body.startswith(b"HTTP/"):
        head, payload = split_http(body)
        headers |= {"WARC-Type": "response", "Content-Type": "application/http; msgtype=response"}
        headers["WARC-Payload-Digest"] = f"sha1:{digest(payload)}"
        if same_as:
            headers |= {"WARC-Type": "revisit", "WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": same_as["record_id"]}
            headers |= {"WARC-Refers-To-Target-URI": same_as["url"], "WARC-Refers-To-Date": warc_date(same_as["date"])}
            body = head
    elif fields["Content-type"] in ("no-type", "-", ""):
        headers["Content-Type"] = "application/octet-stream"
    headers["WARC-Block-Digest"] = f"sha1:{digest(body)}"
    return warc_record(headers, body)


# Jobs


class Archive:
    """A new file of the task; ``close`` returns its path and number of records."""

    def __init__(self, folder: str, end: str):
        self.system, root = filesystem(folder)
        self.system.create_dir(root, recursive=True)
        self.name, self.records, self.bytes = f"{uuid.uuid4().hex}{end}", 0, 0
        self.path = f"{folder}/{self.name}"
        self.out = self.system.open_output_stream(f"{root}/{self.name}", compression=None)

    def add(self, data: bytes) -> None:
        self.out.write(member(data))
        self.records += 1
        self.bytes += len(data)

    def close(self) -> tuple[str, int]:
        self.out.close()
        return self.path, self.records


def _listed(files: list[tuple[str, int]]) -> pa.RecordBatch:
    paths, records = zip(*files)
    return pa.RecordBatch.from_arrays([pa.array(paths), pa.array(records, pa.int64())], ["file", "records"])


def safe_uri(url: str | None, page_id: int | None) -> str:
    """The URL without blanks and control signs, which header lines cannot hold."""
    return re.sub(r"[\x00-\x20\x7f-\xa0\u2028\u2029]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "") or f"urn:page:{page_id}"


def write_arcs(pages: DataFrame, folder: str, date: str = "20240101000000", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Pages as responses in ARC files of either version in turn; the result lists the files.

    A null html counts as empty. Each row is a record of its own; the page's id is a field of the response's head.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, now, version, offset = [], None, 1, 0
        for batch in small_batches(batches, 64):
            for page_id, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                if now is None:
                    now, offset = Archive(folder, ".arc.gz"), 0
                    now.add(arc_head(version, now.name, date))
                html = html or b""
                own = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(html)}\r\n\r\n"
                body = head.encode() + html
                now.add(arc_line(version, safe_uri(url, page_id), date, "text/html", len(body), now.bytes) + body + b"\n")
                if now.bytes >= file_bytes:
                    files.append(now.close())
                    now, version = None, 3 - version
        if now is not None:
            files.append(now.close())
        if files:
            yield _listed(files)

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("binary"))
    return checkpointed(rows.mapInArrow(run, "file string, records long"), "arcs")


def _one_a_task(files: DataFrame) -> DataFrame:
    return files.repartition(max(1, files.count()))


CENSUS = "file string, number long, page_id long, record_id string, url string, date string, payload_bytes long, sha binary"


def census(arcs: DataFrame) -> DataFrame:
    """What tells payloads of responses apart: one row per response in the listed ARC files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("file").to_pylist():
                rows = []
                with opened(path) as source:
                    for number, fields, body in read_arc(source):
                        if number and body.startswith(b"HTTP/"):
                            head, payload = split_http(body)
                            page = http_field(head, "X-Page-Id")
                            key = record_id(base_name(path), number)
                            own = int(page) if page else None, key, fields["URL"], fields["Archive-date"]
                            rows.append((path, number, *own, len(payload), sha256(payload).digest()))
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]
                names = [c.split(" ")[0] for c in CENSUS.split(", ")]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], names)

    return checkpointed(_one_a_task(arcs.select("file")).mapInArrow(run, CENSUS), "census")


def revisits(found: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``(file, same)`` with the records of each file that revisit another one, as structs.

    Payloads of at least ``least_bytes`` are equal where length and SHA-256 are. The record of the largest page id
    stays (null ids last, then the largest record id among equal ones); the others refer to it.
    """
    big = found.where(F.col("payload_bytes") >= least_bytes)
    best = F.max(F.struct("page_id", "record_id", "url", "date")).alias("best")
    groups = big.groupBy("sha", "payload_bytes").agg(best, F.count("*").alias("n")).where("n > 1").drop("n")
    others = big.select("file", "number", "record_id", "sha", "payload_bytes").join(groups, ["sha", "payload_bytes"])
    others = others.where("record_id != best.record_id")
    return others.groupBy("file").agg(F.collect_list(F.struct("number", "best.record_id", "best.url", "best.date")).alias("same"))


def convert(arcs: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Convert the listed ARC files, each to one WARC file in ``folder``; the result lists those.

    Every record is converted, in order: the version block to ``warcinfo``, what starts like an HTTP response to
    ``response`` or ``revisit``, anything else to ``resource``. A file whose lines or lengths do not fit is an error.
    """
    same = revisits(census(arcs), least_bytes)
    jobs = arcs.select("file").join(same, "file", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1):
            path = batch.column("file")[0].as_py()
            refers = {row["number"]: row for row in batch.column("same")[0].as_py() or []}
            out = Archive(folder, ".warc.gz")
            with opened(path) as source:
                for number, fields, body in read_arc(source):
                    out.add(converted(path, number, fields, body, refers.get(number)))
            yield _listed([out.close()])

    return checkpointed(_one_a_task(checkpointed(jobs, "arc-jobs")).mapInArrow(run, "file string, records long"), "warcs")


RECORDS = "record_type string, record_id string, refers string, page_id long, payload_bytes long, payload_digest string, url string, date string"


def read_records(warcs: DataFrame) -> DataFrame:
    """Responses and revisits of the listed WARC files; digests are compared with what the blocks hold.

    ``payload_bytes`` is null for a revisit, which does not carry its payload.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path in (p for batch in batches for p in batch.column("file").to_pylist()):
            rows = []
            with opened(path) as source:
                for headers, block in read_warc(source):
                    kind = headers["warc-type"]
                    if kind not in ("response", "revisit"):
                        continue
                    head, payload = split_http(block)
                    own = headers["warc-payload-digest"].removeprefix("sha1:")
                    if headers["warc-block-digest"] != f"sha1:{digest(block)}" or kind == "response" and digest(payload) != own:
                        raise ValueError(f"{path}: {headers['warc-record-id']} is damaged")
                    page, size = http_field(head, "X-Page-Id"), len(payload) if kind == "response" else None
                    names = ("warc-record-id", "warc-refers-to", "warc-target-uri", "warc-date")
                    key, refers, url, date = map(headers.get, names)
                    rows.append((kind, key, refers, int(page) if page else None, size, own, url, date))
            kinds = [pa.int64() if c.endswith("long") else pa.string() for c in RECORDS.split(", ")]
            names = [c.split(" ")[0] for c in RECORDS.split(", ")]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], names)

    return _one_a_task(warcs.select("file")).mapInArrow(run, RECORDS)


def resolved(records: DataFrame) -> DataFrame:
    """One row per record; a revisit gets the size and the page of the response that it refers to."""
    records = checkpointed(records, "warc-records")
    own = records.where("record_type = 'response'").select(
        F.col("record_id").alias("refers"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("__bytes")
    )
    first = records.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long"))
    again = records.where("record_type = 'revisit'").drop("payload_bytes").join(own, "refers")
    again = again.withColumnRenamed("__bytes", "payload_bytes")
    return first.select(again.columns).unionByName(again)


def archive(pages: DataFrame, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Pages through ARC files and WARC files: one row per row of ``pages``, as ``resolved`` has them.

    Null html and empty html have the same, empty payload. Of repeated rows with the largest id of their payload one
    is the response and the others revisit it. A null page_id comes back as null and is the smallest id. An empty
    table gives an empty result. Other columns of ``pages`` are not looked at.
    """
    folder = scratch_dir(pages.sparkSession, "archives")
    arcs = write_arcs(pages, f"{folder}/arc", file_bytes=file_bytes)
    return resolved(read_records(convert(arcs, f"{folder}/warc")))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return archive(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS best FROM pages),
d AS (SELECT page_id, html, best, sha1(html) AS hex FROM p)
SELECT page_id, octet_length(encode(html)) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + ((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::INTEGER >> (15 - 5 * (i % 4))) & 31)::INTEGER, 1)), '') AS payload_digest,
       CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id != best THEN best END AS refers_to
FROM d
"""
