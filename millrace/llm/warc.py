"""WARC archives with an index first, then coalesced byte-range reads.

Tasks write their pages as gzip members of WARC records, one file after another, and return where each
record lies: archive, offset, length, URL and digest. That index is a table. To read records back, the
wanted index rows are sorted by archive and offset, neighbouring ranges are joined into one read, and
each member is unpacked and checked against its digest. Files are opened through the file system of
the shared folder's address, so local, HDFS and object-store folders work alike.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import slices
from millrace.session import store, workspace

#: Payloads of fewer bytes are always written whole.
LEAST_REVISIT = 1000
#: An archive is closed once it has this many bytes.
ARCHIVE_BYTES = 1 << 30
#: Ranges at most this far apart are read together, up to this many bytes.
GAP = 1 << 16
READ_BYTES = 8 << 20
#: Archive bytes a task reads, about.
TASK_BYTES = 64 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMES = uuid.UUID("2b6f0d6e-9a43-4d0e-8a55-6f1f6c1f0a51")

INDEX = (
    "page_id {id}, url string, archive string, offset long, length long, "
    "payload_digest string, payload_bytes long, record_type string"
)


def record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{page_id}/{digest}')}>"


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to, date: str = DATE) -> bytes:
    """One record. A revisit has the response's headers, and so its length, but no payload."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if refers_to is not None else http + payload
    label = base64.b32encode(bytes.fromhex(digest)).decode()
    target = re.sub(r"[\s\x00-\x1f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{label}",
        "Content-Type: application/http;msgtype=response",
    ]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        lines += [
            f"WARC-Profile: {PROFILE}",
            f"WARC-Refers-To: {record_id(refers_to, digest)}",
            f"X-Refers-To-Page-Id: {refers_to}",
        ]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of a record, names in lower case."""
    head, _, rest = data.partition(b"\r\n\r\n")
    warc = _fields(head)
    block = rest[: int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, _fields(http), payload


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def with_revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """``page_id, url, payload, payload_digest, refers_to`` of ``pages(page_id, url, html)``.

    Of equal payloads (same SHA-1 and length) of at least ``least`` bytes that with the largest id is kept,
    the others refer to it; rows of that same id are all kept; a null id is less than any other, and if
    all are null none refers. Null html is an empty payload.
    """
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", html.alias("payload")).withColumns(
        {"payload_digest": F.sha1("payload"), "bytes": F.octet_length("payload")}
    )
    # Only payloads that occur twice need a partner. Copies are counted where they are read; the stored
    # table's size decides how it is joined, and a digest with very many copies is split by AQE.
    heads = store(
        rows.filter(F.col("bytes") >= least)
        .groupBy("payload_digest", "bytes")
        .agg(F.max("page_id").alias("head"), F.count("*").alias("n"))
        .filter("n > 1 AND head IS NOT NULL")
        .drop("n"),
        "payload-heads",
    )
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("head")), F.col("head"))
    return rows.join(heads, ["payload_digest", "bytes"], "left").select(
        "page_id", "url", "payload", "payload_digest", refers.alias("refers_to")
    )


def write_archives(rows: DataFrame, folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``rows`` (see ``with_revisits``) to archives in ``folder`` and return the stored index.

    A task that runs again writes files of its own; the index, written once, names only those of the
    attempts that counted. An empty table gives an empty index and no archives.
    """
    spark = rows.sparkSession
    folder = folder or workspace(spark, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(folder)
        out, path, at, n = None, "", 0, 0
        try:
            for batch in slices(batches):
                index = []
                for page_id, url, payload, digest, refers in zip(*(c.to_pylist() for c in batch.columns)):
                    if out is None or at >= archive_bytes:
                        if out is not None:
                            out.close()
                        files.create_dir(base, recursive=True)
                        path = f"pages-{TaskContext.get().partitionId():06d}-{n:04d}-{uuid.uuid4().hex}.warc.gz"
                        out, at, n = files.open_output_stream(f"{base}/{path}", compression=None), 0, n + 1
                    data = gzip.compress(record(page_id, url, payload, digest, refers), 4, mtime=0)
                    out.write(data)
                    kind = "response" if refers is None else "revisit"
                    index.append((page_id, url, path, at, len(data), digest, len(payload), kind))
                    at += len(data)
                if index:
                    kinds = [batch.schema.field(0).type, pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
                    arrays = [pa.array(v, k) for v, k in zip(zip(*index), kinds)]
                    names = ["page_id", "url", "archive", "offset", "length", "payload_digest", "payload_bytes", "record_type"]
                    yield pa.RecordBatch.from_arrays(arrays, names)
        finally:
            if out is not None:
                out.close()

    kind = rows.schema["page_id"].dataType.simpleString()
    index = store(rows.mapInArrow(write, INDEX.format(id=kind)), "warc-index")
    return index.withColumn("folder", F.lit(folder))


def read_records(index: DataFrame, keep_payload: bool = False) -> DataFrame:
    """The records of ``index`` rows (any selection of an index), read from their archives.

    ``page_id, url, record_type, payload_bytes, payload_digest, refers_to[, payload]``; the payload of a
    revisit is null. A response whose payload has another digest than its header is an error.
    """
    wanted = index.select("page_id", "url", "folder", "archive", "offset", "length")
    # The number has to be given: tasks are cut by what lies in the archives, not by what the index weighs.
    size = wanted.agg(F.sum("length")).first()[0] or 0
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
    ordered = wanted.repartitionByRange(int(tasks), "folder", "archive", "offset").sortWithinPartitions(
        "folder", "archive", "offset"
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: tuple[str, object] = ("", None)
        for batch in slices(batches):
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            found, at = [], 0
            while at < len(rows):
                # One read for the ranges from here on that lie close together.
                _, _, folder, archive, first, length = rows[at]
                stop, upto = first + length, at + 1
                while (
                    upto < len(rows)
                    and rows[upto][2:4] == (folder, archive)
                    and rows[upto][4] - stop <= GAP
                    and rows[upto][4] + rows[upto][5] - first <= READ_BYTES
                ):
                    stop, upto = max(stop, rows[upto][4] + rows[upto][5]), upto + 1
                if opened[0] != (name := f"{folder}/{archive}"):
                    if opened[1] is not None:
                        opened[1].close()
                    files, path = fs.FileSystem.from_uri(name)
                    opened = name, files.open_input_file(path)
                data = opened[1].read_at(stop - first, first)
                for page_id, url, _, _, offset, size in rows[at:upto]:
                    member = gzip.decompress(data[offset - first : offset - first + size])
                    found.append((page_id, url, *_checked(member, name)))
                at = upto
            if found:
                columns = list(zip(*found))[: 7 if keep_payload else 6]
                id_kind = batch.schema.field(0).type
                kinds = [id_kind, pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
                arrays = [pa.array(v, k) for v, k in zip(columns, kinds)]
                arrays[5] = arrays[5].cast(id_kind)  # a header's text
                yield pa.RecordBatch.from_arrays(arrays, names[: len(arrays)])
        if opened[1] is not None:
            opened[1].close()

    spark_kind = index.schema["page_id"].dataType.simpleString()
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
    more = ", payload binary" if keep_payload else ""

    def _checked(member: bytes, name: str):
        warc, http, payload = parse(member)
        digest = base64.b32decode(warc["warc-payload-digest"].removeprefix("sha1:")).hex()
        kind, refers = warc["warc-type"], warc.get("x-refers-to-page-id")
        if kind == "response":
            if hashlib.sha1(payload).hexdigest() != digest:
                raise ValueError(f"a record of {name} does not match its digest")
            return kind, len(payload), digest, refers, payload
        return kind, int(http["content-length"]), digest, refers, None

    return ordered.mapInArrow(
        read,
        f"page_id {spark_kind}, url string, record_type string, payload_bytes long, "
        f"payload_digest string, refers_to {spark_kind}{more}",
    )


def archived(pages: DataFrame) -> DataFrame:
    """The digest of every page, as read back from the archives: a row per row, ids of any integer, decimal or
    text type. Null and empty html are payloads of 0 bytes; ties and repeated rows are as in
    ``with_revisits``; an empty table gives no rows; other columns are not read. A task holds a batch of
    pages or one coalesced read, so a page has to fit in memory, whole."""
    index = write_archives(with_revisits(pages))
    return read_records(index).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


ORACLE = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
h AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS head FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM head AND head IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM head THEN head END AS refers_to FROM h
"""
