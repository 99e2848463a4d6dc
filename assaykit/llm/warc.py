"""WARC archives: a distributed writer and a splittable reader.

Every record is a gzip member of its own. A reading task gets a byte range of a file; it scans it
for gzip magic, validates candidate members by decoding their first bytes up to a record header,
then follows member after member, and owns the records that start inside its range. Places where
a member does not decode, or no record follows a member, come back as records of type damaged.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, table, written

MAGIC = b"\x1f\x8b\x08"
#: Payloads below this size are never stored as revisits.
LEAST_REVISIT = 100
#: Copies of the small side of the join on digests, so that a digest of very many pages is dealt out.
SALTS = 32
#: Bytes read at a time, and those from which a member is told.
BLOCK, PROBE = 1 << 18, 4096


def _clean(value: str) -> str:
    """A header value on one line: white space and control characters are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f-\x9f  ]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), value)


def record_id(page: str | None) -> str:
    """The URN of a page's record; that of a null id is one that no id has."""
    return "<urn:null-page>" if page is None else f"<urn:page:{quote(page)}>"


def page_of(urn: str | None) -> str | None:
    """The page of a record_id."""
    return unquote(urn.removeprefix("<urn:page:").removesuffix(">")) if urn and urn.startswith("<urn:page:") else None


def record(page: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """A response, or a revisit of the record of page refers_to, which has HTTP headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_clean(url)}")
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, html with digest (SHA-256 of the payload) and refers_to.

    Of records with equal payloads of at least LEAST_REVISIT bytes that with the smallest page_id
    stays (refers_to null), and all rows of this id with it; others refer to it. A null html is an
    empty payload. A null page_id comes after all others.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), F.sha2(payload, 256).alias("digest"))
    first = (
        rows.where(F.octet_length("html") >= LEAST_REVISIT).groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
        .select(F.col("digest").alias("same"), "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("part"))
    )
    salt = F.pmod(F.hash("page_id"), F.lit(SALTS))
    joined = rows.withColumn("salt", salt).join(first, (F.col("digest") == F.col("same")) & (F.col("salt") == F.col("part")), "left")
    return joined.select("page_id", "url", "html", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write_warc(pages: DataFrame, path: str) -> DataFrame:
    """Writes the records of pages (page_id, url, html) and returns the archives: path, bytes, records.

    Each task writes one file under a name of its own; only files of tasks that ended well are
    in the result, so those of lost or repeated tasks are never read. An empty table gives none.
    """

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        fs, root = pafs.FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        name = f"{root}/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
        size = count = 0
        with fs.open_output_stream(name, compression=None) as out:
            batch = first
            while batch is not None:
                for i in range(batch.num_rows):
                    page, url, html, digest, refers_to = (c[i].as_py() for c in batch.columns)
                    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                    raw = record(None if page is None else str(page), url, html.encode(), digest, None if refers_to is None else str(refers_to))
                    size += out.write(pack.compress(raw) + pack.flush())
                    count += 1
                batch = next(batches, None)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size], pa.int64()), pa.array([count], pa.int64())], names=["path", "bytes", "records"])

    return written(with_revisits(pages).mapInArrow(save, "path string, bytes long, records long"), "warc-files")


class _Range:
    """A file's bytes from a position on, read block by block. What is dropped is held no longer."""

    def __init__(self, fs, path: str, start: int):
        self.file = fs.open_input_file(path)
        self.file.seek(start)
        self.start, self.data, self.ended = start, bytearray(), False

    def fill(self, n: int) -> bool:
        """Reads on until n bytes are held; false if the file ends before."""
        while len(self.data) < n and not self.ended:
            block = self.file.read(BLOCK)
            self.data += block
            self.ended = not block
        return len(self.data) >= n

    def drop(self, upto: int) -> None:
        del self.data[: upto - self.start]
        self.start = upto

    def opens_record(self, at: int = 0) -> bool:
        """Whether a gzip member that holds a WARC record starts at this place of the bytes held."""
        self.fill(at + PROBE)
        try:
            return zlib.decompressobj(31).decompress(self.data[at : at + PROBE], 64).startswith(b"WARC/1.")
        except zlib.error:
            return False

    def member(self) -> bytes | None:
        """The decoded member at the first byte, which is dropped with it; null if it is damaged."""
        unpack, out = zlib.decompressobj(31), bytearray()
        try:
            while not unpack.eof:
                if not self.fill(1):
                    return None
                piece = bytes(self.data)
                out += unpack.decompress(piece)
                self.drop(self.start + len(piece) - len(unpack.unused_data))
        except zlib.error:
            return None
        return bytes(out)


def _first_member(src: _Range, end: int) -> int | None:
    """Position of the first member that starts before end."""
    look = 0
    while True:
        at = src.data.find(MAGIC, look)
        if at >= 0:
            if src.start + at >= end:
                return None
            if src.opens_record(at):
                return src.start + at
            look = at + 1
        elif src.ended or src.start + len(src.data) - 2 >= end:
            return None
        else:
            src.drop(src.start + max(0, len(src.data) - 2))
            look = 0
            src.fill(len(src.data) + 1)


def members(fs, path: str, start: int, end: int) -> Iterator[tuple[int, bytes | None]]:
    """(position, content) of the file's members that start in [start, end).

    The content is null where a member does not decode, where bytes that open no record follow a
    member (reported with the member before, wherever its range ends), and at 0 if the file does
    not begin with a record. The search goes on behind such a place.
    """
    src = _Range(fs, path, start)
    at = _first_member(src, end)
    if start == 0 and at != 0 and end > 0:
        yield 0, None
    while at is not None and at < end:
        src.drop(at)
        content = src.member()
        yield at, content
        if content is None:
            src = _Range(fs, path, at + 1)
            at = _first_member(src, end)
        elif not src.fill(1):
            return
        elif src.opens_record():
            at = src.start
        else:
            yield src.start, None
            at = _first_member(src, end) if src.start < end else None


def parse(raw: bytes) -> tuple[dict[str, str], bytes, int]:
    """Header fields (names lower-case), payload, and the payload's full length as its HTTP headers say."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    block = rest[: int(fields.get("content-length", 0))]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = re.search(rb"(?im)^Content-Length:\s*(\d+)", http)
    return fields, payload, int(length[1]) if length else len(payload)


RECORD = "page_id string, record_type string, url string, payload binary, payload_bytes long, payload_digest string, refers_to string, intact boolean, position long"


def read_warc(spark: SparkSession, files: DataFrame, split_bytes: int = 128 << 20) -> DataFrame:
    """The records of the archives (path, bytes): ids, type, URL, payload (null in revisits), the
    length and digest of the full payload, whether a response's payload has the stored digest, and
    the position in the file.

    A task reads one range of split_bytes. A damaged place is a row of type damaged: only position
    and intact (false) are not null there. An empty list of files gives no rows.
    """
    root = new_path(spark, "")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(root)
        for batch in batches:
            for path, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, held = [], 0
                for at, raw in members(fs, path, start, end):
                    if raw is None:
                        rows.append((None, "damaged", None, None, None, None, None, False, at))
                        continue
                    fields, payload, length = parse(raw)
                    full, stored = fields.get("warc-type") == "response", fields.get("warc-payload-digest", "").removeprefix("sha256:")
                    digest = hashlib.sha256(payload).hexdigest() if full else stored
                    rows.append((
                        page_of(fields.get("warc-record-id")), fields.get("warc-type"), fields.get("warc-target-uri"), payload if full else None, length, digest,
                        page_of(fields.get("warc-refers-to")), digest == stored and (not full or length == len(payload)), at,
                    ))
                    held += len(payload)
                    if held > 8 << 20 or len(rows) >= 2000:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long")))
    splits = files.select("path", starts.alias("start"), "bytes").select("path", "start", F.least(F.col("start") + split_bytes, "bytes").alias("end"))
    # rows of splits are few bytes, of which adaptive execution would make one task; it keeps a stated number
    n = files.agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0] or 1
    return splits.repartition(int(n)).mapInArrow(read, RECORD)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.int64()]
    names = ["page_id", "record_type", "url", "payload", "payload_bytes", "payload_digest", "refers_to", "intact", "position"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def op2_warc(spark, sf_dir: str) -> DataFrame:
    """Every page through archives and back. Null and empty html are empty payloads, repeated rows are
    repeated records, a null page_id comes back as null, other columns are not archived. A damaged
    place of an archive would be a row of its own, of type damaged without ids."""
    pages = table(spark, sf_dir, "pages")
    files = write_warc(pages, new_path(spark, "warc"))
    kind = pages.schema["page_id"].dataType
    id_of = lambda c: F.expr(f"try_cast({c} as {kind.simpleString()})").alias(c)
    return read_warc(spark, files, split_bytes=4 << 20).select(id_of("page_id"), "payload_bytes", "payload_digest", "record_type", id_of("refers_to"))


OP2_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest,
  CASE WHEN strlen(html) >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN strlen(html) >= 100 AND page_id <> first THEN first END AS refers_to
FROM p
"""
