"""WARC archives of web pages, written with an index and read back by byte ranges.

A record is a gzip member of its own, so that it can be read alone.  Each task
writes archives of its own to the shared folder and returns one index row a
record: archive, offset, length, URL, payload digest, type.  The index is written
by Spark, hence only archives of tasks that ended well are ever named in it; an
archive of a lost attempt is not read.

Reading sorts the chosen index rows by archive and offset, deals them by range,
and joins neighbouring byte ranges into one read of at most ``READ_BYTES``.
Payloads, digests and lengths are checked against the record's own headers.

Pages with equal payloads: the one with the largest page_id is written as
response, the others as revisits without payload, which keep the digest and
length of the payload in their headers.  Equal payloads are found by SHA-256.
The table of repeated payloads is broadcast if it is small; else the most common
ones (at most 10,000 by their share) are, and the others are joined by key.

Results in special cases: a null html is an empty payload; a null URL is left out
of the record and read back as null; white space and control characters of a URL
are percent-encoded in the record, not in the index; a page without page_id is read back without one and
never the response to a page that has one; rows that share the largest page_id of
a payload are responses all; very long payloads are one record, read alone; an
empty table gives an empty index.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dqspark.llm.text import batch
from dqspark.session import scratch_path, settle

ARCHIVE_BYTES = 1_000_000_000  # an archive is closed beyond
READ_BYTES = 8_000_000  # of one read of neighbouring records
GAP_BYTES = 64_000  # not asked for, but read to join two ranges
TASK_BYTES = 8_000_000  # of archives read by a task, up to READ_TASKS tasks
READ_TASKS = 20_000
SMALL = 100_000  # repeated payloads that are broadcast
COMMON = 10_000  # a payload is common from this part of the pages on
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"
END = b"\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_INDEX = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()),
                    ("payload_digest", pa.string()), ("record_type", pa.string())])
_INDEX_SQL = ("archive string, offset bigint, length bigint, url string, payload_digest string, record_type string")
_READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()),
                   ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                   ("payload", pa.binary())])
_READ_SQL = ("page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, "
             "refers_to bigint, payload binary")


def digest(payload: bytes) -> str:
    """SHA-1 in base32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def resolve(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, refers_to, revisit: which pages repeat another's payload.

    Payloads of fewer than ``min_bytes`` are responses always.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    keyed = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
                         payload.alias("payload")).withColumn("key", F.unhex(F.sha2("payload", 256)))
    counted = keyed.where(F.octet_length("payload") >= min_bytes).groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.max("page_id").alias("last"))
    repeated = settle(counted.where("n > 1"), "warc-repeated")
    kinds, rows = repeated.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    last = repeated.select("key", "last", F.lit(True).alias("met"))
    if kinds <= SMALL:
        out = keyed.join(F.broadcast(last), "key", "left")
    else:
        common = repeated.where(F.col("n") * COMMON >= rows).select("key", F.col("last").alias("last1"), F.lit(True).alias("met1"))
        rare = last.withColumnsRenamed({"key": "key2", "last": "last2", "met": "met2"})
        out = keyed.join(F.broadcast(common), "key", "left")
        # A common key is scattered before the second join, where it matches nothing.
        scattered = F.unhex(F.sha2(F.concat("key", F.monotonically_increasing_id().cast("string").cast("binary")), 256))
        out = (out.withColumn("key2", F.when(F.col("met1"), scattered).otherwise(F.col("key")))
               .join(rare, "key2", "left")
               .withColumns({"last": F.coalesce("last1", "last2"), "met": F.coalesce("met1", "met2")}))
    revisit = F.coalesce(F.col("met") & F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last")), F.lit(False))
    return out.select("page_id", "url", "payload", F.when(revisit, F.col("last")).alias("refers_to"), revisit.alias("revisit"))


def _name(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid4()}>" if page_id is None else f"<urn:page:{page_id}>"


def _headers(fields: list[tuple[str, str | None]], first: str = "WARC/1.1") -> bytes:
    return "".join([f"{first}\r\n", *[f"{k}: {v}\r\n" for k, v in fields if v is not None], "\r\n"]).encode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool,
           date: str = DATE) -> tuple[bytes, str]:
    """A record and the digest of its payload."""
    found = digest(payload)
    http = _headers([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))], "HTTP/1.1 200 OK")
    block = http if revisit else http + payload
    safe = None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m.group()), url)
    return _headers([
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _name(page_id)), ("WARC-Date", date),
        ("WARC-Target-URI", safe), ("WARC-Payload-Digest", f"sha1:{found}"),
        ("WARC-Refers-To", _name(refers_to) if revisit else None), ("WARC-Profile", _PROFILE if revisit else None),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]) + block + END, found


def _info(date: str) -> bytes:
    block = b"software: dqspark\r\nformat: WARC File Format 1.1\r\n"
    return _headers([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _name(None)), ("WARC-Date", date),
                     ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(block)))]) + block + END


def _member(data: bytes) -> bytes:
    deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return deflate.compress(data) + deflate.flush()


class _Archives:
    """Archives of one task, one open at a time."""

    def __init__(self, folder: str, limit: int, date: str):
        self.fs, self.path = pyarrow.fs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.path, recursive=True)
        self.folder, self.limit, self.date = folder, limit, date
        self.out, self.name, self.offset = None, "", 0

    def add(self, data: bytes) -> tuple[str, int, int]:
        if self.out is None or self.offset >= self.limit:
            self.close()
            file = f"pages-{uuid.uuid4().hex}.warc.gz"
            self.name, self.offset = f"{self.folder}/{file}", 0
            self.out = self.fs.open_output_stream(f"{self.path}/{file}", compression=None)
            self._write(_info(self.date))
        start = self.offset
        return self.name, start, self._write(data)

    def _write(self, data: bytes) -> int:
        member = _member(data)
        self.out.write(member)
        self.offset += len(member)
        return len(member)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()


def write(pages: DataFrame, folder: str | None = None, *, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES,
          date: str = DATE) -> DataFrame:
    """Write the archives below ``folder``, a path or URI that all executors share; returns the stored index."""
    folder = (folder or scratch_path(pages.sparkSession, "warc")).rstrip("/")

    def kernel(batches):
        archives = None
        for b in batches:
            if not b.num_rows:
                continue
            archives = archives or _Archives(folder, archive_bytes, date)
            rows = []
            for page_id, url, payload, refers_to, revisit in zip(*(c.to_pylist() for c in b.columns), strict=True):
                data, found = record(page_id, url, payload, refers_to, revisit, date)
                rows.append((*archives.add(data), url, found, "revisit" if revisit else "response"))
            yield batch(_INDEX, **dict(zip(_INDEX.names, zip(*rows, strict=True), strict=True)))
        if archives:
            archives.close()

    return settle(resolve(pages, min_bytes).mapInArrow(kernel, _INDEX_SQL), "warc-index")


def ranges(offsets: list[int], lengths: list[int]) -> list[tuple[int, int, int, int]]:
    """Join sorted byte ranges of a file: (first record, last record + 1, from byte, to byte) of each read."""
    out: list[tuple[int, int, int, int]] = []
    for i, (at, length) in enumerate(zip(offsets, lengths, strict=True)):
        if out:
            first, _, start, end = out[-1]
            if at - end <= GAP_BYTES and at + length - start <= READ_BYTES:
                out[-1] = (first, i + 1, start, max(end, at + length))
                continue
        out.append((i, i + 1, at, at + length))
    return out


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")[1:]
    return {k.lower(): v for k, v in (line.split(": ", 1) for line in lines)}


def _page(name: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?[0-9]+)>", name or "")
    return int(found.group(1)) if found else None


def parse(member: bytes) -> tuple:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload of a compressed record."""
    data = zlib.decompress(member, 31)
    head, rest = data.split(END, 1)
    warc = _fields(head)
    block = rest[: int(warc["content-length"])]
    if rest[len(block) :] != END:
        raise ValueError(f"record {warc.get('warc-record-id')} does not end where its length says")
    http, payload = block.split(END, 1)
    size, found = int(_fields(http)["content-length"]), warc["warc-payload-digest"].removeprefix("sha1:")
    revisit = warc["warc-type"] == "revisit"
    if not revisit and (len(payload) != size or digest(payload) != found):
        raise ValueError(f"payload of {warc['warc-record-id']} is not what its headers say")
    return (_page(warc["warc-record-id"]), warc.get("warc-target-uri"), size, found, warc["warc-type"],
            _page(warc.get("warc-refers-to")), None if revisit else payload)


def read(index: DataFrame, *, payload: bool = False) -> DataFrame:
    """Records of the index rows given: page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    With ``payload`` also the payload (null for revisits).  Only the records'
    bytes, and small gaps between them, are read.
    """
    total = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = min(max(1, -(-total // TASK_BYTES)), READ_TASKS)
    chosen = index.select("archive", "offset", "length").repartitionByRange(tasks, "archive", "offset")

    def kernel(batches):
        for b in batches:
            names, offsets, lengths = (c.to_pylist() for c in b.columns)
            begin = [i for i in range(len(names)) if not i or names[i] != names[i - 1]]
            for s, e in zip(begin, [*begin[1:], len(names)], strict=True):
                fs, path = pyarrow.fs.FileSystem.from_uri(names[s])
                with fs.open_input_file(path) as file:
                    for first, last, lo, hi in ranges(offsets[s:e], lengths[s:e]):
                        data = memoryview(file.read_at(hi - lo, lo))
                        members = (data[offsets[i] - lo : offsets[i] - lo + lengths[i]] for i in range(s + first, s + last))
                        rows = [parse(m) if payload else (*parse(m)[:-1], None) for m in members]
                        yield batch(_READ, **dict(zip(_READ.names, zip(*rows, strict=True), strict=True)))

    found = chosen.sortWithinPartitions("archive", "offset").mapInArrow(kernel, _READ_SQL)
    return found if payload else found.drop("payload")
