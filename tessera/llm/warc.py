"""WARC archives with a two-level capture index.

Tasks write gzip-compressed WARC files into the shared folder, one member per record. Captures are
range-sorted by reversed-host URL key and cut into compressed blocks; a sparse directory holds the
first key of each block. A lookup bisects the directory, reads one block by its byte range, bisects
its lines, and reads one record by its byte range.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Bytes of payload from which equal payloads are written once; captures a block of the index holds.
LEAST_REVISIT, BLOCK_LINES = 1000, 2000
#: Bytes of a WARC file after which a task begins the next one; bytes of records that a task reads back.
FILE_BYTES, READ_BYTES = 1 << 30, 16 << 20
_NO_ID = -(2**63)
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_HOST = re.compile(r"^([a-zA-Z][a-zA-Z0-9+.\-]*)://(?:[^/?#@]*@)?([^/?#:]*)(:\d*)?([^#]*)")


def url_key(url: str | None) -> str:
    """Reversed-host key: ``com,example,www)/path?query``; white space and controls are escaped."""
    m = _HOST.match(url or "")
    key = ",".join(reversed(m[2].lower().split("."))) + ")" + (m[4] or "/") if m else (url or "")
    return quote(key, safe="".join(map(chr, range(33, 127))))


def _files(root: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(root)


def _qualified(scratch: Scratch, path: str) -> str:
    """The path with its file system's name, as tasks need it."""
    jvm = scratch.spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(scratch.spark._jsc.hadoopConfiguration())
    fs.mkdirs(p)
    return re.sub(r"^file:/+", "file:///", fs.makeQualified(p).toString())


def record(kind: str, url: str | None, page_id: int, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP header alone as its block."""
    block = _HTTP + payload if kind == "response" else _HTTP
    head = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"),
        ("WARC-Target-URI", quote(url or "", safe="".join(map(chr, range(33, 127))))),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Page-ID", str(page_id)),
    ]
    if refers_to is not None:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}')}>"), ("WARC-Refers-To-Page-ID", str(refers_to))]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def read_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one compressed record."""
    data = zlib.decompress(raw, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


CAPTURES = "page_id long, url_key string, file string, offset long, length long"


def _writer(root: str, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _files(root)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                rows: dict[str, list] = {c: [] for c in ("page_id", "url_key", "file", "offset", "length")}
                for page_id, url, page, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None or at > FILE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    payload = (page or "").encode("utf-8", "replace")
                    member = gzip.compress(record("response" if refers_to is None else "revisit", url, page_id, payload, digest, refers_to, date), 5, mtime=0)
                    out.write(member)
                    for c, v in zip(rows, (page_id, url_key(url), name, at, len(member)), strict=True):
                        rows[c].append(v)
                    at += len(member)
                yield pa.RecordBatch.from_pydict(rows, pa.schema([("page_id", pa.int64()), ("url_key", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))
        finally:
            if out is not None:
                out.close()

    return run


def write_archives(scratch: Scratch, pages: DataFrame, root: str, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write ``pages(page_id, url, html)`` as WARC files under ``root``; the captures that were written.

    Of payloads of at least ``LEAST_REVISIT`` bytes that are equal, the largest id's record is the
    response and the others are revisits of it. A lost task's files are left aside, since captures
    name only those of finished tasks.
    """
    pages = pages.select(F.coalesce(F.col("page_id"), F.lit(_NO_ID)).alias("page_id"), "url", "html")
    raw = F.coalesce("html", F.lit("")).cast("binary")
    digests = pages.select("page_id", F.sha1(raw).alias("digest"), F.sha2(raw, 256).alias("exact"), F.octet_length(raw).alias("n"))
    heads = scratch.save(digests.where(F.col("n") >= LEAST_REVISIT).select("page_id", "exact"), "heads")
    latest = scratch.save(heads.groupBy("exact").agg(F.max("page_id").alias("latest"), F.min("page_id").alias("first")).where("first < latest").select("exact", "latest"), "latest")
    revisits = heads.join(latest, "exact").where("page_id < latest").select("page_id", F.col("exact").alias("revisit_of"), "latest").distinct()
    revisits = scratch.save(revisits, "revisits")
    rows = pages.select("page_id", "url", "html", F.sha1(raw).alias("digest"), F.sha2(raw, 256).alias("exact"))
    rows = rows.join(revisits.withColumnRenamed("revisit_of", "exact"), ["page_id", "exact"], "left")
    return scratch.save(rows.select("page_id", "url", "html", "digest", "latest").mapInArrow(_writer(root, date), CAPTURES), "captures")


DIRECTORY = "part int, first_key string, first_id long, file string, offset long, length long, lines long"


def _indexer(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, base = _files(root)
        name, part = f"{uuid.uuid4().hex}.cdx.z", TaskContext.get().partitionId()
        out, at, lines = None, 0, []
        blocks: dict[str, list] = {c: [] for c in ("part", "first_key", "first_id", "file", "offset", "length", "lines")}

        def flush() -> None:
            nonlocal out, at, lines
            if out is None:
                out = fs.open_output_stream(f"{base}/{name}", compression=None)
            block = zlib.compress("\n".join(" ".join(map(str, x)) for x in lines).encode(), 6)
            out.write(block)
            for c, v in zip(blocks, (part, lines[0][0], lines[0][1], name, at, len(block), len(lines)), strict=True):
                blocks[c].append(v)
            at, lines = at + len(block), []

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("url_key", "page_id", "file", "offset", "length")), strict=True):
                # All captures of one key and id stay in one block.
                if len(lines) >= BLOCK_LINES and row[:2] != lines[-1][:2]:
                    flush()
                lines.append(row)
        if lines:
            flush()
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_pydict(blocks, pa.schema([("part", pa.int32()), ("first_key", pa.string()), ("first_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("lines", pa.int64())]))

    return run


def parts_of(captures: DataFrame) -> int:
    """Range partitions of the index: the records of each have about ``READ_BYTES`` bytes."""
    return max(1, -(-(captures.agg(F.sum("length")).first()[0] or 0) // READ_BYTES))


def build_index(scratch: Scratch, captures: DataFrame, root: str, parts: int) -> DataFrame:
    """Write the captures as sorted compressed blocks under ``root``; the sparse block directory."""
    ordered = captures.repartitionByRange(parts, "url_key", "page_id").sortWithinPartitions("url_key", "page_id")
    return scratch.save(ordered.mapInArrow(_indexer(root), DIRECTORY), "directory")


class Archive:
    """Range reads of index blocks and records under two folders."""

    def __init__(self, warc_root: str, index_root: str, directory: pd.DataFrame):
        self.warc, self.index = _files(warc_root), _files(index_root)
        self.directory = directory.sort_values(["first_key", "first_id"], key=lambda c: c.str.encode("utf-8") if c.name == "first_key" else c)
        self.firsts = [(k.encode(), i) for k, i in zip(self.directory["first_key"], self.directory["first_id"], strict=True)]
        self.handles: dict[str, object] = {}
        self.at, self.lines = -1, []

    def _read(self, where: tuple[pafs.FileSystem, str], file: str, offset: int, length: int) -> bytes:
        if file not in self.handles:
            if len(self.handles) >= 64:
                self.handles.pop(next(iter(self.handles))).close()
            self.handles[file] = where[0].open_input_file(f"{where[1]}/{file}")
        return self.handles[file].read_at(length, offset)

    def captures(self, key: str, page_id: int) -> list[tuple[str, int, int]]:
        """File, offset and length of each record of a URL key and id."""
        want = (key.encode(), page_id)
        at = bisect.bisect_right(self.firsts, want) - 1
        if at < 0:
            return []
        if at != self.at:
            row = self.directory.iloc[at]
            data = zlib.decompress(self._read(self.index, row["file"], int(row["offset"]), int(row["length"])))
            self.at, self.lines = at, [((x := line.split(b" "))[0], int(x[1]), x[2].decode(), int(x[3]), int(x[4])) for line in data.split(b"\n")]
        lo = bisect.bisect_left(self.lines, (*want, "", 0, 0))
        found = []
        while lo < len(self.lines) and self.lines[lo][:2] == want:
            found.append(self.lines[lo][2:])
            lo += 1
        return found

    def record(self, file: str, offset: int, length: int) -> tuple[dict[str, str], bytes]:
        return read_record(self._read(self.warc, file, offset, length))


READ = "page_id long, url_key string, record_type string, refers_to long, stated_digest string, payload_bytes long, payload_digest string"


def _reader(warc_root: str, index_root: str):
    def run(probes: pd.DataFrame, directory: pd.DataFrame) -> pd.DataFrame:
        archive = Archive(warc_root, index_root, directory)
        rows = []
        for key, page_id in sorted(zip(probes["url_key"], probes["page_id"], strict=True), key=lambda x: (x[0].encode(), x[1])):
            for place in archive.captures(key, page_id):
                headers, payload = archive.record(*place)
                refers = headers.get("WARC-Refers-To-Page-ID")
                whole = headers["WARC-Type"] == "response"
                rows.append((int(headers["WARC-Page-ID"]), key, headers["WARC-Type"], None if refers is None else int(refers), headers["WARC-Payload-Digest"].partition(":")[2], len(payload) if whole else None, hashlib.sha1(payload).hexdigest() if whole else None))
        return pd.DataFrame(rows, columns=["page_id", "url_key", "record_type", "refers_to", "stated_digest", "payload_bytes", "payload_digest"]).astype({"refers_to": "Int64", "payload_bytes": "Int64"})

    return run


def lookup(probes: DataFrame, directory: DataFrame, warc_root: str, index_root: str, parts: int) -> DataFrame:
    """The records of ``probes(url_key, page_id)``, read through the index in as many tasks as it has parts.

    The number is stated, since a probe's few bytes stand for a whole page that its task reads.
    """
    # One row per range partition of the index: where it begins.
    starts = sorted((r["k"].encode(), r["i"], r["part"]) for r in directory.groupBy("part").agg(F.min(F.struct(F.col("first_key").alias("k"), F.col("first_id").alias("i"))).alias("s")).select("part", "s.k", "s.i").collect())
    firsts, numbers = [s[:2] for s in starts], np.array([s[2] for s in starts] or [0], np.int32)

    @F.pandas_udf("int")
    def part_of(keys, ids):
        at = [bisect.bisect_right(firsts, (k.encode(), i)) - 1 for k, i in zip(keys, ids, strict=True)]
        return pd.Series(numbers[np.maximum(at, 0)])

    dealt = probes.select("url_key", "page_id", part_of("url_key", "page_id").alias("part")).distinct().repartition(parts, "part")
    return dealt.groupBy("part").cogroup(directory.repartition(parts, "part").groupBy("part")).applyInPandas(_reader(warc_root, index_root), READ)


def archived(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write ``pages`` as WARC, read every record back through the index; one row per row of ``pages``.

    Columns: page_id, payload_bytes, payload_digest, record_type, refers_to, url_key, stated_digest. A revisit
    takes size and digest from the response that it refers to, as read. Null and empty pages have an
    empty payload; a page of any length is one record, held by its task; a null id or URL is allowed.
    Of equal payloads the largest id is the response, and repeated rows with that id are responses each;
    all are written and read. Further columns are ignored; an empty table gives an empty result.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    warc_root, index_root = (_qualified(scratch, f"{scratch.root}/{x}") for x in ("archives", "index"))
    plain = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    captures = write_archives(scratch, plain, warc_root)
    parts = parts_of(captures)
    directory = build_index(scratch, captures, index_root, parts)
    read = scratch.save(lookup(captures.select("url_key", "page_id"), directory, warc_root, index_root, parts), "read")
    whole = read.where("record_type = 'response'").groupBy("page_id", "payload_digest").agg(F.first("payload_bytes").alias("n"))
    whole = scratch.save(whole.select(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("stated_digest"), "n"), "whole")
    resolved = read.join(whole, ["refers_to", "stated_digest"], "left")
    return resolved.select(
        F.when(F.col("page_id") != _NO_ID, F.col("page_id")).alias("page_id"),
        F.coalesce("payload_bytes", "n").alias("payload_bytes"),
        F.coalesce("payload_digest", F.when(F.col("n").isNotNull(), F.col("stated_digest"))).alias("payload_digest"),
        "record_type",
        "refers_to",
        "url_key",
        "stated_digest",
    )
