"""Web archives with an index: records are written one by one and read back by coalesced byte ranges.

Every record is a gzip member of its own in a ``.warc.gz`` file, so each one can be read from its offset and length alone.
Writing returns the index, one row per record. It is itself written to the shared folder, and names only files
of tasks that ended well: what a lost or repeated task leaves behind is never read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, stage

ARCHIVE_BYTES = 64 << 20
RANGE_BYTES = 4 << 20
GAP_BYTES = 64 << 10
INDEX = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, offset long, length long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record. Controls and spaces in a URL are percent-encoded, since a header is one line."""
    urn = lambda i: f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'{digest}:{i}').urn}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": urn(page_id),
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "X-Page-Id": page_id,
        "WARC-Refers-To": None if refers_to is None else urn(refers_to),
        "X-Refers-To-Page-Id": refers_to,
        "WARC-Profile": None if refers_to is None else PROFILE,
        "Content-Type": "application/http;msgtype=response",
        "Content-Length": len(block),
    }
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in head.items() if v is not None)]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _parsed(record: bytes) -> tuple:
    """The columns of RECORD; raises ValueError where lengths or digests do not agree."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError(f"record {fields['WARC-Record-ID']} ends too early")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or payload_digest(payload) != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} does not have the payload that its digest names")
    number = lambda k: int(fields[k]) if k in fields else None
    return number("X-Page-Id"), fields.get("WARC-Target-URI"), kind, number("X-Refers-To-Page-Id"), size, digest, payload if kind == "response" else None


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES
) -> DataFrame:
    """Write a record per row into archives under ``folder`` and return the index.

    Of rows with equal payloads of at least ``least_bytes``, that with the largest id is a response and the others are
    revisits that refer to it; shorter payloads are all responses. A null html is an empty payload. Repeated rows of
    the largest id are all responses. A null id is the smallest; where a payload has null ids only, all its rows are responses. An empty
    table gives an empty index. ``folder`` is a URI that the executors can reach.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pick(pages, page_id=id_col, url=url_col, html=html_col).select(F.col("page_id").cast("long"), "url", payload.alias("payload"))
    rows = rows.withColumn("sha1", F.unhex(F.sha1("payload"))).withColumn("bytes", F.octet_length("payload"))
    # Only payloads that repeat are kept, and as a table, so that the join below can split a payload with very many rows.
    repeats = stage(
        rows.where(F.col("bytes") >= least_bytes).groupBy("sha1", "bytes").agg(F.max("page_id").alias("top"), F.count("*").alias("n"))
        .where("n > 1 AND top IS NOT NULL").drop("n"), "payloads",
    )
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("top")), F.col("top"))
    marked = rows.join(repeats, ["sha1", "bytes"], "left").select("page_id", "url", "payload", refers.alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pyarrow.fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        task, out, name, at = TaskContext.get(), None, "", 0
        for batch in batches:
            index = []
            for page_id, url, body, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None or at >= archive_bytes:
                    if out is not None:
                        out.close()
                    name, at = f"{task.partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0
                    out = files.open_output_stream(f"{root}/{name}", compression=None)
                digest = payload_digest(body)
                member = gzip.compress(_record(page_id, url, body, digest, refers_to), 6, mtime=0)
                out.write(member)
                index.append((page_id, url, len(body), digest, "response" if refers_to is None else "revisit", refers_to, f"{folder}/{name}", at, len(member)))
                at += len(member)
            yield _batch(index, INDEX)
        if out is not None:
            out.close()

    return stage(marked.mapInArrow(run, INDEX), "warc-index")


def read_records(index: DataFrame, range_bytes: int = RANGE_BYTES, gap_bytes: int = GAP_BYTES) -> DataFrame:
    """The records of any selection of index rows, with their payloads; a revisit's payload is null.

    A file's rows are sorted by offset and read in ranges that go on while the gap to the next record is at most ``gap_bytes`` and
    the range at most ``range_bytes``. A task holds one range. Each row of the selection gives a row, repeated ones too.
    """
    wanted = index.select("file", "offset", "length").repartition("file").sortWithinPartitions("file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for span in _spans(((r["file"], r["offset"], r["length"]) for b in batches for r in b.to_pylist()), range_bytes, gap_bytes):
            files, path = pyarrow.fs.FileSystem.from_uri(span[0][0])
            first = span[0][1]
            with files.open_input_file(path) as file:
                data = file.read_at(max(o + n for _, o, n in span) - first, first)
            yield _batch([_parsed(gzip.decompress(data[o - first : o - first + n])) for _, o, n in span], RECORD)

    return wanted.mapInArrow(run, RECORD)


def _spans(rows: Iterator[tuple[str, int, int]], range_bytes: int, gap_bytes: int) -> Iterator[list[tuple[str, int, int]]]:
    span: list[tuple[str, int, int]] = []
    for row in rows:
        if span:
            (name, start, _), (_, last, n) = span[0], span[-1]
            if row[0] != name or row[1] > last + n + gap_bytes or row[1] + row[2] - start > range_bytes:
                yield span
                span = []
        span.append(row)
    if span:
        yield span


_ARROW = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _batch(rows: list[tuple], columns: str) -> pa.RecordBatch:
    names = [c.split() for c in columns.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _ARROW[t]) for i, (_, t) in enumerate(names)], [n for n, _ in names])
