"""WARC archives: written by tasks, read back by byte ranges.

Every record is a gzip member of its own.  A reading task gets a range of a file, looks for gzip
magic in it, accepts a place where decompressing gives the head of a WARC record, and owns the
records that start in its range, wherever they end.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a range, and of one read; a record's heads are looked for in so many decompressed bytes.
RANGE, READ, HEAD = 32 << 20, 1 << 20, 1 << 16
_MAGIC = b"\x1f\x8b\x08"
_DATE = "2000-01-01T00:00:00Z"


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def planned(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, url, html, digest, response): what each page's record is, by the SHA-1 of its payload.

    Of equal payloads of at least ``least`` bytes the page with the largest id is the response.
    ``response`` is that page for the others, null for responses.  Rows that repeat that id are
    responses too; a null id is smaller than any other.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    pages = pages.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    heads = (pages.where(F.octet_length("html") >= least).groupBy("digest")
             .agg(F.max("page_id").alias("top"), F.count("*").alias("n")).where("n > 1").drop("n"))
    # the texts of pages without an equal need no partner: only digests cross the join's small side
    return pages.join(heads, "digest", "left").select(
        "page_id", "url", "html", F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("top")), F.col("top")).alias("response"))


def record(page_id: int | None, url: str | None, html: str, response: int | None) -> bytes:
    """One record as a gzip member.  A revisit holds the response's HTTP head, whose length is that of the full payload."""
    payload = html.encode("utf-8", "surrogatepass")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if response is None else http
    target = "".join(c for c in url or "" if c > " ")
    head = ["WARC/1.1", f"WARC-Type: {'response' if response is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
            f"WARC-Date: {_DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    if response is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{response}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def write(plan: DataFrame, folder: str) -> DataFrame:
    """Writes one archive per task; (path, size, n) of each, to be stored by the caller.

    A task that runs again writes another file; only the one whose row arrives is ever read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _opened(folder)
        store.create_dir(root, recursive=True)
        name, n, size, out = f"{uuid.uuid4().hex}.warc.gz", 0, 0, None
        for batch in batches:
            for k in range(0, len(batch), 200):
                part = batch.slice(k, 200)
                for row in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html", "response")), strict=True):
                    out = out or store.open_output_stream(f"{root}/{name}", compression=None)
                    data = record(*row)
                    out.write(data)
                    n, size = n + 1, size + len(data)
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([size]), pa.array([n])], names=["path", "size", "n"])

    return plan.mapInArrow(run, "path string, size long, n long")


class Range:
    """Bytes of a file from one place on, read as they are asked for."""

    def __init__(self, path: str, start: int):
        store, place = _opened(path)
        self.file, self.start, self.data, self.ended = store.open_input_file(place), start, bytearray(), False
        self.file.seek(start)

    def upto(self, at: int) -> bool:
        """Whether bytes before ``at`` are there, after reading on if need be."""
        while not self.ended and self.start + len(self.data) < at:
            more = self.file.read(READ)
            self.ended = not more
            self.data += more
        return self.start + len(self.data) >= at

    def forget(self, at: int) -> None:
        del self.data[:at - self.start]
        self.start = at

    def member(self, at: int, least: int | None = None) -> tuple[bytes, int] | None:
        """Decompressed bytes and end of the member at ``at``; only the first ``least`` bytes if given; None if it is none."""
        unpack, out, pos = zlib.decompressobj(31), [], at
        try:
            while not unpack.eof:
                if not self.upto(pos + 1):
                    return None
                chunk = bytes(self.data[pos - self.start:pos - self.start + READ])
                out.append(unpack.decompress(chunk, least or 0))
                pos += len(chunk)
                if least and (sum(map(len, out)) >= 5 or unpack.unconsumed_tail):
                    break
        except zlib.error:
            return None
        return b"".join(out), pos - len(unpack.unused_data)


def records(path: str, start: int, end: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of the records whose member starts in [start, end)."""
    data, at = Range(path, start), start
    while at < end:
        data.upto(min(end, at + READ) + len(_MAGIC))
        found = data.data.find(_MAGIC, at - data.start)
        if found < 0:
            if data.ended:
                return
            at = max(at, data.start + len(data.data) - len(_MAGIC) + 1)
            data.forget(at)
            continue
        at = found + data.start
        if at >= end:
            return
        data.forget(at)
        head = data.member(at, 64)
        whole = data.member(at) if head and head[0].startswith(b"WARC/") else None
        if whole is None:
            at += 1
            continue
        content, at = whole
        head, _, rest = content.partition(b"\r\n\r\n")
        fields = dict(line.partition(": ")[::2] for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
        yield fields, rest[:int(fields["Content-Length"])]


def ranges(spark: SparkSession, files: DataFrame, size: int = RANGE) -> DataFrame:
    """(path, start, end) that cover every file, dealt out one by one.

    Rows of ranges are tiny whatever they stand for, so their bytes don't say how many tasks to make:
    a task each as long as the cores want them, some ranges a task beyond that.
    """
    count = files.agg(F.sum(F.ceil(F.col("size") / size))).first()[0] or 1
    tasks = min(count, max(4 * spark.sparkContext.defaultParallelism, count // 16))
    cuts = files.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(size).cast("long"))).alias("start"))
    return cuts.select("path", "start", F.least("size", F.col("start") + size).alias("end")).repartition(int(tasks))


FIELDS = T.StructType([T.StructField(n, t) for n, t in (
    ("page_id", T.LongType()), ("url", T.StringType()), ("record_type", T.StringType()), ("refers_to", T.LongType()),
    ("payload_bytes", T.LongType()), ("payload_digest", T.StringType()), ("payload", T.BinaryType()))])


def read(cuts: DataFrame, payloads: bool = True) -> DataFrame:
    """Records of the ranges: page, type, the response it refers to, length and digest of the full payload, payload.

    A response's payload is hashed again; one that doesn't match its record's digest raises.
    """
    def number(urn: str | None) -> int | None:
        tail = (urn or "").rstrip(">").rpartition(":")[2]
        return int(tail) if tail else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, end in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "end")), strict=True):
                rows, held = [], 0
                for head, block in records(path, start, end):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    length = int(http.decode().rpartition("Content-Length: ")[2])
                    name = head["WARC-Payload-Digest"].partition(":")[2]
                    if head["WARC-Type"] == "response" and (len(payload) != length or digest(payload) != name):
                        raise ValueError(f"a record of {path} is damaged")
                    rows.append((number(head["WARC-Record-ID"]), head["WARC-Target-URI"], head["WARC-Type"], number(head.get("WARC-Refers-To")), length, name,
                                 payload if payloads and head["WARC-Type"] == "response" else None))
                    held += len(payload)
                    if held > 8 << 20 or len(rows) >= 2000:
                        yield pa.RecordBatch.from_pylist([dict(zip(FIELDS.names, r, strict=True)) for r in rows], schema=_ARROW)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(FIELDS.names, r, strict=True)) for r in rows], schema=_ARROW)

    return cuts.mapInArrow(run, FIELDS)


_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
