"""WARC archives: written with an index, read back through it.

Writing gives, for each record, its file, offset, length, URL and digest.
Reading starts from any selection of index rows: they are dealt by file and
stretch of file, sorted by offset, and ranges that lie close together are
fetched in one read. Each record is a gzip member of its own.

Archives live under the folder that all executors share. Executors reach it
through ``pyarrow.fs``, so any store that knows (local or mounted paths, HDFS,
S3, GCS) will do. A task that runs again writes other files; the index, which
is kept before anything is read, names those of the run that counted.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logwright.llm.common import checked_broadcast, durable, raw, shared_dir, ship, slices

INDEX = "file string, offset bigint, length bigint, url string, digest string, record_type string, page_id bigint"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record_id(page_id: int | None, salt: str = "page") -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{salt}:{page_id}')}>"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _gzip(data: bytes, level: int) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> tuple[bytes, str]:
    """The bytes of a response or revisit record, and the payload's digest."""
    digest, revisit = digest_of(payload), refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))))}")
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head += [f"WARC-Refers-To: {_record_id(refers_to)}", f"X-Refers-To-Page-Id: {refers_to}", f"WARC-Profile: {_REVISIT}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return b"WARC/1.1\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", digest


def parse(data: bytes) -> dict:
    """A record's headers by lower-case name, and its HTTP headers and payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in head.decode().split("\r\n")[1:])}
    block = rest[: int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    inner = {k.lower(): v for k, _, v in (x.partition(": ") for x in http.decode().split("\r\n")[1:])}
    return {"headers": headers, "http": inner, "payload": payload}


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def write_archives(pages: DataFrame, folder: str | None = None, least_bytes: int = 0, roll_bytes: int = 256 << 20, level: int = 4, date: str = "2024-01-01T00:00:00Z", broadcast_limit: int = 16 << 20) -> DataFrame:
    """Write a record for each page (page_id, url, html) and return the index.

    The payload is the html in UTF-8, empty for null. Of records whose
    payloads of at least ``least_bytes`` bytes are equal, the one with the
    smallest page_id is a response and the others revisit it; rows that repeat
    that page_id and payload are responses too. A null page_id always revisits
    a page that has one. A null url leaves the target out. An empty table gives
    an empty index. Archives roll at
    ``roll_bytes``; each task writes its own."""
    ship(pages.sparkSession)
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    payload = F.coalesce(raw("html"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"), F.when(F.octet_length(payload) >= least_bytes, F.sha1(payload)).alias("sha"))
    firsts = durable(rows.groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("sha is not null and n > 1").select("sha", "first"))
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    dealt = rows.join(checked_broadcast(firsts, 64, broadcast_limit), "sha", "left").select("page_id", "url", "payload", refers.alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        stream, name, at = None, "", 0
        try:
            for batch in slices(batches, "payload", 8 << 20):
                out = []
                for page_id, url, html, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to"))):
                    if stream is None or at >= roll_bytes:
                        if stream is not None:
                            stream.close()
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        stream = store.open_output_stream(f"{root}/{name}", compression=None)
                        note = b"format: WARC File Format 1.1\r\n"
                        info = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {_record_id(None, name)}\r\nWARC-Date: {date}\r\nWARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(note)}\r\n\r\n"
                        at = stream.write(_gzip(info.encode() + note + b"\r\n\r\n", level))
                    data, digest = record(page_id, url, html, refers_to, date)
                    packed = _gzip(data, level)
                    stream.write(packed)
                    out.append((f"{folder}/{name}", at, len(packed), url, digest, "response" if refers_to is None else "revisit", page_id))
                    at += len(packed)
                types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names=["file", "offset", "length", "url", "digest", "record_type", "page_id"])
        finally:
            if stream is not None:
                stream.close()

    return durable(dealt.mapInArrow(run, INDEX))


def coalesced(rows: list[tuple[str, int, int]], gap: int, most: int) -> Iterator[list[tuple[str, int, int]]]:
    """Runs of (file, offset, length), sorted, that one read of at most
    ``most`` bytes fetches, a larger record alone."""
    run: list[tuple[str, int, int]] = []
    for row in rows:
        if run and (row[0] != run[0][0] or row[1] > run[-1][1] + run[-1][2] + gap or row[1] + row[2] - run[0][1] > most):
            yield run
            run = []
        run.append(row)
    if run:
        yield run


def read_records(selected: DataFrame, gap: int = 64 << 10, most: int = 8 << 20, stretch: int = 8 << 20, task_bytes: int = 128 << 20) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload, payload_bytes,
    payload_digest) of the records that the index rows ``selected`` name. The
    payload of a revisit is null; its size and digest are those of the full
    payload, as the record says. A response's are computed from its bytes. A
    task reads about ``task_bytes`` of archives, less where there are more
    cores than that makes tasks, in stretches of files."""
    spark = ship(selected.sparkSession)
    total = selected.agg(F.sum("length")).first()[0] or 0
    tasks = max(-(-total // task_bytes), min(spark.sparkContext.defaultParallelism, -(-total // stretch)), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stores: dict[str, tuple] = {}
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))))
            for group in coalesced(rows, gap, most):
                name, start = group[0][:2]
                if name not in stores:
                    for _, opened in stores.values():
                        opened.close()
                    store, path = _store(name)
                    stores = {name: (store, store.open_input_file(path))}
                data = stores[name][1].read_at(group[-1][1] + group[-1][2] - start, start)
                out = []
                for _, offset, length in group:
                    got = parse(zlib.decompress(data[offset - start : offset - start + length], 31))
                    head, full = got["headers"], got["headers"]["warc-type"] == "response"
                    number = lambda k, head=head: int(head[k]) if k in head else None
                    out.append(
                        (
                            number("x-page-id"),
                            head.get("warc-target-uri"),
                            head["warc-type"],
                            number("x-refers-to-page-id"),
                            got["payload"] if full else None,
                            len(got["payload"]) if full else int(got["http"]["content-length"]),
                            digest_of(got["payload"]) if full else head["warc-payload-digest"].removeprefix("sha1:"),
                        )
                    )
                types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names=["page_id", "url", "record_type", "refers_to", "payload", "payload_bytes", "payload_digest"])

    dealt = selected.select("file", "offset", "length").repartition(tasks, "file", F.floor(F.col("offset") / stretch)).sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(run, "page_id bigint, url string, record_type string, refers_to bigint, payload binary, payload_bytes bigint, payload_digest string")
