"""WARC archives: write, index, and read back by coalesced byte ranges.

Records are gzip members of their own.  Writing decides response or revisit from digests; indexing
scans the archives once and writes offset, length, URL and digest of every record to a table; reading
takes any selection of index rows, sorts it by place, joins neighbouring ranges into one read, and
parses the records.  Files are opened through pyarrow's file systems, so archives may lie in any
folder that executors share.  A task writes files under names of its own and reports them when it
ends; files of attempts that failed are in no report and are never read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.store import Scratch, small


@dataclass(frozen=True)
class Warc:
    #: Payloads of fewer bytes are never revisits.
    least: int = 0
    #: Bytes after which a task opens another archive.
    roll: int = 128 << 20
    #: Ranges no further apart than ``gap`` bytes are read at once, up to ``read`` bytes.
    gap: int = 64 << 10
    read: int = 4 << 20
    #: Bytes of archive that one reading task covers.
    slice: int = 32 << 20
    level: int = 4


_ID = "urn:quillspark:page:"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


#: A header of our own, for a URL that a WARC header cannot hold as it is.
_EXACT = "quillspark-target"


def _target(url: str) -> list[str]:
    """The headers of a URL: line ends and outer blanks are escaped, and then the exact URL stands in base64."""
    plain = "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in url)
    inner = plain.strip()
    if inner == url:
        return [f"WARC-Target-URI: {url}"]
    return [f"WARC-Target-URI: {inner.replace(' ', '%20')}", f"{_EXACT}: {base64.b64encode(url.encode()).decode()}"]


def _url(fields: dict[str, str]) -> str | None:
    exact = fields.get(_EXACT)
    return fields.get("warc-target-uri") if exact is None else base64.b64decode(exact).decode()


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit carries no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{_ID}{'none' if page is None else page}>", "WARC-Date: 2024-01-01T00:00:00Z"]
    if url is not None:
        head += _target(url)
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_ID}{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers (names in lower case), HTTP head and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    block = rest[: int(fields.get("content-length", len(rest)))]
    if fields.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        return fields, http, payload
    return fields, b"", block


def members(stream, size: int = 1 << 20) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, record) of every gzip member of an open archive, read in pieces."""
    at = begin = 0
    data, one, parts = b"", None, []
    while True:
        if not data and not (data := stream.read(size)):
            return
        if one is None:
            one, begin = zlib.decompressobj(31), at
        before = len(data)
        parts.append(one.decompress(data))
        data = one.unused_data
        at += before - len(data)
        if one.eof:
            yield begin, at - begin, b"".join(parts)
            one, parts = None, []


def _page(value: str | None) -> int | None:
    name = (value or "").strip("<>").removeprefix(_ID)
    return int(name) if name.lstrip("-").isdigit() else None


def _write(folder: str, p: Warc):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        out, name, size, done = None, "", 0, []
        try:
            for batch in batches:
                for page, url, html, refers in zip(*(batch.column(i) for i in range(4)), strict=True):
                    if out is None:
                        name, size = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    raw = record(page.as_py(), url.as_py(), (html.as_py() or "").encode(), refers.as_py())
                    pack = zlib.compressobj(p.level, zlib.DEFLATED, 31)
                    raw = pack.compress(raw) + pack.flush()
                    out.write(raw)
                    size += len(raw)
                    if size >= p.roll:
                        out.close()
                        done.append((name, size))
                        out = None
        finally:
            if out is not None:
                out.close()
                done.append((name, size))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.string()), pa.array([x for _, x in done], pa.int64())], names=["file", "bytes"])

    return run


_INDEX = "file string, offset long, length long, url string, digest string, page_id long, record_type string"


def _index(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        names = [x.split()[0] for x in _INDEX.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        for batch in batches:
            for file in batch.column(0).to_pylist():
                rows = []

                def flush() -> pa.RecordBatch:
                    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

                with fs.open_input_stream(f"{base}/{file}", compression=None) as stream:
                    for offset, length, raw in members(stream):
                        h, _, _ = parse(raw)
                        rows.append((file, offset, length, _url(h), h.get("warc-payload-digest", "").removeprefix("sha1:"), _page(h.get("warc-record-id")), h.get("warc-type")))
                        if len(rows) == 4096:
                            yield flush()
                            rows = []
                if rows:
                    yield flush()

    return run


_RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _fetch(folder: str, p: Warc, payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        names = [x.split()[0] for x in _RECORD.split(", ")]
        now, opened = None, None

        def emit(file: str, run_: list[tuple[int, int]]) -> pa.RecordBatch:
            nonlocal now, opened
            if file != now:
                if opened:
                    opened.close()
                now, opened = file, fs.open_input_file(f"{base}/{file}")
            start = run_[0][0]
            raw = opened.read_at(run_[-1][0] + run_[-1][1] - start, start)
            rows = []
            for offset, length in run_:
                h, http, payload = parse(zlib.decompress(raw[offset - start : offset - start + length], 31))
                digest = h.get("warc-payload-digest", "").removeprefix("sha1:")
                if (kind := h.get("warc-type")) == "revisit":
                    size = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length"))
                else:
                    size = len(payload)
                    if base32_sha1(payload) != digest:
                        raise ValueError(f"{file} at {offset}: payload does not match its digest")
                rows.append((_page(h.get("warc-record-id")), _url(h), size, digest, kind, _page(h.get("warc-refers-to")), payload if payloads else None))
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

        file, pending = None, []
        for batch in batches:
            for name, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                end = pending[-1][0] + pending[-1][1] if pending else 0
                if pending and (name != file or offset - end > p.gap or offset + length - pending[0][0] > p.read):
                    yield emit(file, pending)
                    pending = []
                file = name
                pending.append((offset, length))
        if pending:
            yield emit(file, pending)
        if opened:
            opened.close()

    return run


class Archive:
    """Archives written by one call, with their index."""

    def __init__(self, spark: SparkSession, folder: str, files: DataFrame, index: DataFrame, p: Warc) -> None:
        self.spark, self.folder, self.files, self.index, self.p = spark, folder, files, index, p

    def read(self, selected: DataFrame | None = None, payloads: bool = True) -> DataFrame:
        """The records that rows of the index (file, offset, length) select, one row each."""
        total = int(self.files.agg(F.sum("bytes")).first()[0] or 0)
        tasks = max(1, min(20_000, -(-total // self.p.slice)))
        rows = (self.index if selected is None else selected).select("file", "offset", "length", F.floor(F.col("offset") / self.p.slice).alias("slice"))
        rows = rows.repartition(max(tasks, self.files.count()), "file", "slice").sortWithinPartitions("file", "offset")
        out = rows.select("file", "offset", "length").mapInArrow(_fetch(self.folder, self.p, payloads), _RECORD)
        return out if payloads else out.drop("payload")


def write(spark: SparkSession, pages: DataFrame, p: Warc = Warc()) -> Archive:
    """Archives of ``pages`` (page_id, url, html), a record a row, and their index.

    A null html is an empty payload.  Of pages with equal payloads of at least ``least`` bytes the one
    with the smallest page_id is a response and those with larger ids revisit it; rows that share the
    smallest id are all responses, and so are rows without id.  A null url is left out of its record;
    any other comes back as it went in, blanks, line ends and escapes included.  An empty table gives an empty index.  Other columns are not read.
    """
    scratch = Scratch(spark, "warc")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    payload = F.col("html").cast("binary")
    digests = scratch.cut(pages.where("page_id IS NOT NULL").select("page_id", F.sha1(payload).alias("sha"), F.octet_length("html").alias("size")).where(F.col("size") >= p.least), "digests")
    first = scratch.cut(digests.groupBy("sha", "size").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("last > refers_to").drop("last"), "first")
    revisits = scratch.cut(digests.join(first, ["sha", "size"]).where("page_id > refers_to").select("page_id", "sha", "refers_to").distinct(), "revisits")
    # an id may come twice with different payloads, so the digest is part of the key
    told = pages.withColumn("sha", F.sha1(payload)).join(small(revisits), ["page_id", "sha"], "left").select("page_id", "url", "html", "refers_to")
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch.path("archives"))
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    folder = fs.makeQualified(path).toString().replace("file:/", "file:///").replace("file://///", "file:///")
    files = scratch.cut(told.mapInArrow(_write(folder, p), "file string, bytes long"), "files")
    index = files.repartition(max(1, files.count())).select("file").mapInArrow(_index(folder), _INDEX)
    return Archive(spark, folder, files, scratch.cut(index, "index"), p)
