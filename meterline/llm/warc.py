"""WARC archives, index first.

Writing gives archives of one compressed member per record, and an index row (archive, offset, length, URL, digest) for each
of them. Reading starts from index rows: those selected are sorted by archive and offset, neighbouring byte ranges are read in
one request, and each record is parsed and checked against its digest. Archives go to a folder that all executors share;
an attempt writes files of its own name, and only committed attempts have index rows, so a lost executor leaves no trace.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks
from .workspace import Workspace, table

ARCHIVE_BYTES = 256 << 20
#: One request reads at most so many bytes, and reads over gaps of at most so many.
READ_BYTES, GAP_BYTES = 4 << 20, 64 << 10
#: A reading task gets about so many bytes of archives at most.
TASK_BYTES = 64 << 20
#: Classes of equal payloads are broadcast up to this count, and joined by a shuffle beyond.
BROADCAST_CLASSES = 200_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "archive string, offset long, length long, url string, digest string, page_id long, record_type string"


def folder(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path else "file://" + path) if not path.startswith("file:/") else (pyarrow.fs.LocalFileSystem(), "/" + path[5:].lstrip("/"))


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None, own: str) -> str:
    """A record's identifier: the page's id and, for a response, its digest, by which revisits find it; else a part of its own."""
    return f"<urn:x-page:{'' if page_id is None else page_id}:{own}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: str) -> bytes:
    """One uncompressed record; a revisit carries the response's HTTP head without its payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: {_name(page_id, digest if refers_to is None and page_id is not None else uuid.uuid4().hex)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {quote(url or '', safe=_URL_SAFE)}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(refers_to, digest)}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


_URL_SAFE = "".join(map(chr, range(0x21, 0x7F)))


def parse(member: bytes) -> dict:
    """Fields of one compressed record; raises ValueError where the payload isn't what its digest says."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    told = {k.lower(): v for k, v in (line.split(": ", 1) for line in http.decode().split("\r\n")[1:])}
    page = lambda name: int(x) if (x := fields.get(name, "<urn:x-page:>")[len("<urn:x-page:") : -1].partition(":")[0]) else None
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    if kind == "response" and (digest_of(payload) != digest or len(payload) != int(told["content-length"])):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't match its digest {digest}")
    return {"page_id": page("WARC-Record-ID"), "url": fields["WARC-Target-URI"], "payload": payload, "payload_bytes": int(told["content-length"]), "payload_digest": digest, "record_type": kind, "refers_to": page("WARC-Refers-To")}


def _compressed(data: bytes) -> bytes:
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _writer(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = folder(path)
        out, offset, name = None, 0, ""
        try:
            for batch in batches:
                rows = []
                for page_id, url, html, latest in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                    payload = (html or "").encode()
                    refers_to = latest if latest is not None and latest != page_id else None
                    digest = digest_of(payload)
                    member = _compressed(record(page_id, url, payload, refers_to, digest))
                    if out is None or offset + len(member) > ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        name, offset = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                        store.create_dir(top, recursive=True)
                        out = store.open_output_stream(f"{top}/{name}", compression=None)
                    out.write(member)
                    rows.append((name, offset, len(member), url, digest, page_id, "response" if refers_to is None else "revisit"))
                    offset += len(member)
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
                columns = list(zip(*rows, strict=True)) or [[] for _ in kinds]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["archive", "offset", "length", "url", "digest", "page_id", "record_type"])
        finally:
            if out is not None:
                out.close()

    return run


def write_archives(pages: DataFrame, path: str, *, min_bytes: int = 0) -> DataFrame:
    """Write one record for each row of ``pages`` (page_id, url, html; more columns are ignored) under ``path`` and return the index
    (archive, offset, length, url, digest, page_id, record_type), lazily: each evaluation writes archives, so store the result.

    Of records with equal payloads of at least ``min_bytes`` bytes, the one with the largest page_id is a response and the others
    revisit it. A null html is an empty payload, a null url an empty one; a null page_id ranks below all others. Rows with the
    largest page_id of their class that occur more than once all are responses, captured alike and so under one record id; all
    other records have ids of their own. An empty table writes nothing. A very long page is one record, held whole.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    hashed = rows.select("page_id", F.sha1("html").alias("sha"), F.octet_length("html").alias("size")).where(F.col("size") >= min_bytes)
    ws = Workspace(pages.sparkSession, "warc-classes")
    classes = ws.write(hashed.groupBy("sha").agg(F.max("page_id").alias("latest"), F.count("*").alias("n")).where("n > 1 and latest is not null").drop("n"), "classes")
    if classes.count() <= BROADCAST_CLASSES:
        classes = F.broadcast(classes)
    joined = rows.withColumn("sha", F.sha1("html")).join(classes, "sha", "left").select("page_id", "url", "html", "latest")
    return blocks.map_arrow(joined, _writer(path), INDEX)


def _reader(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = folder(path)
        held, of = None, None
        try:
            for batch in batches:
                places = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
                at = 0
                while at < len(places):
                    archive, start, length = places[at]
                    end, to = start + length, at + 1
                    while to < len(places) and places[to][0] == archive and 0 <= places[to][1] - end <= GAP_BYTES and places[to][1] + places[to][2] - start <= READ_BYTES:
                        end = places[to][1] + places[to][2]
                        to += 1
                    if archive != of:
                        if held is not None:
                            held.close()
                        held, of = store.open_input_file(f"{top}/{archive}"), archive
                    data = held.read_at(end - start, start)
                    found = [parse(data[o - start : o - start + n]) for _, o, n in places[at:to]]
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in found], t) for c, t in zip(names, kinds, strict=True)], names=names)
                    at = to
        finally:
            if held is not None:
                held.close()

    return run


def read_records(index: DataFrame, path: str) -> DataFrame:
    """(page_id, url, payload binary, payload_bytes, payload_digest, record_type, refers_to) of the records in ``index``
    (archive, offset, length; a selection of a stored index). A revisit's payload is empty; its payload_bytes and digest are those
    of the response it refers to. The selection is dealt out by archive and offset, so that each task reads neighbouring records,
    over as many tasks as there are archives, or as TASK_BYTES asks for. An empty selection reads nothing."""
    size = index.agg(F.sum("length"), F.countDistinct("archive")).first()
    tasks = max(1, size[1], -(-(size[0] or 0) // TASK_BYTES))
    placed = index.select("archive", "offset", "length").repartitionByRange(tasks, "archive", "offset").sortWithinPartitions("archive", "offset")
    return blocks.map_arrow(placed, _reader(path), "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_round_trip(pages: DataFrame, *, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` as archives, store their index, and read every record back through it."""
    ws = Workspace(pages.sparkSession, "warc")
    index = ws.write(write_archives(pages, ws.path("archives"), min_bytes=min_bytes), "index")
    return read_records(index, ws.path("archives"))


def op9_index_first_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = """
with p as (select page_id, coalesce(html, '') x from pages), h as (select page_id, strlen(x) n, upper(sha1(x)) s, max(page_id) over (partition by x) m from p)
select page_id, n::bigint payload_bytes, array_to_string(list_transform(range(0, 8), lambda g: array_to_string(list_transform(range(0, 4), lambda c:
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (('0x' || substr(s, 1 + 5 * g::int, 5))::bigint // (32 ** (3 - c))::bigint % 32)::int, 1)), '')), '') payload_digest,
  case when page_id = m then 'response' else 'revisit' end record_type, case when page_id <> m then m end refers_to from h
"""
