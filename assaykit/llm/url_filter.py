"""URL filters: a sorted array of 64-bit digests, memory-mapped and probed by binary search.

Entries are strings of host and path, kept apart by the path's own slash or, before a path without one, by MARK; no host has either: they fit their host and its subdomains where the URL's path
starts with the entry's. A URL's candidate entries are its host suffixes (of label counts that
entries have) with prefixes of its path (of lengths that entries have). Their xxhash64 digests
are looked up in the sorted array at once, and stored strings confirm each hit.
"""

from __future__ import annotations

import mmap
import re
import struct
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, position, table, with_arrow, without

#: Entries' bytes up to which one array is sent to all executors; larger lists are many arrays.
MAX_ARRAY_BYTES = 64 << 20
#: About this many bytes of entries are in each of many arrays, and in this many places each.
SHARD_BYTES, SALTS = 8 << 20, 8
HOST = r"(?s)^.*?://([^/?#]*)"
PATH = r"(?s)^.*?://[^/?#]*([^?#]*)"
#: Before a path that begins with no slash, in stored strings: without it, host example.co with path m would be host example.com.
MARK = "?"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PATH, 1), F.lit(""))


def entry_of(host: str, path: str) -> str:
    return host + path if path[:1] in ("", "/") else host + MARK + path


def host_and_path(entry: str) -> tuple[str, str]:
    """Those that an entry was made of."""
    host = re.match("[^/?]*", entry)[0]
    return host, entry[len(host) :].removeprefix(MARK)


class DigestArray:
    """Sorted digests, offsets into the strings, and strings, in one byte sequence."""

    def __init__(self, data):
        n, self.shape = struct.unpack_from("<qq", data, 0)
        head = 16
        self.labels = np.frombuffer(data, "<i4", self.shape & 0xFFFF, head)
        self.lengths = np.frombuffer(data, "<i4", self.shape >> 16, head + self.labels.nbytes)
        head += self.labels.nbytes + self.lengths.nbytes
        self.keys = np.frombuffer(data, "<u8", n, head)
        self.offsets = np.frombuffer(data, "<i8", n + 1, head + 8 * n)
        self.base, self.data = head + 16 * n + 8, data

    @staticmethod
    def pack(entries: Iterable[tuple[str, str]]) -> bytes:
        """entries: host, path."""
        pairs = sorted({(xxhash.xxh64_intdigest(entry_of(h, p)), entry_of(h, p).encode(), len(h.split(".")), len(p)) for h, p in entries})
        labels, lengths = sorted({x[2] for x in pairs}), sorted({x[3] for x in pairs})
        offsets = np.cumsum([0, *(len(x[1]) for x in pairs)])
        return b"".join([
            struct.pack("<qq", len(pairs), len(lengths) << 16 | len(labels)), np.asarray(labels, "<i4").tobytes(), np.asarray(lengths, "<i4").tobytes(),
            np.asarray([x[0] for x in pairs], "<u8").tobytes(), offsets.astype("<i8").tobytes(), *(x[1] for x in pairs),
        ])

    @classmethod
    def mapped(cls, packed: bytes) -> DigestArray:
        """The array in an unnamed file of this process, mapped into memory."""
        with tempfile.TemporaryFile() as f:
            f.write(packed)
            f.flush()
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def candidates(self, host: str, path: str) -> list[str]:
        return candidates(host, path, self.labels, self.lengths)

    def find(self, strings: list[str]) -> np.ndarray:
        """Whether each string is stored."""
        digests = np.fromiter(map(xxhash.xxh64_intdigest, strings), np.uint64, len(strings))
        at, found = np.searchsorted(self.keys, digests), np.zeros(len(strings), bool)
        open_ = np.flatnonzero((at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == digests)) if len(self.keys) else []
        for i in open_:
            k, raw = at[i], strings[i].encode()
            while k < len(self.keys) and self.keys[k] == digests[i] and not found[i]:
                found[i] = self.data[self.base + self.offsets[k] : self.base + self.offsets[k + 1]] == raw
                k += 1
        return found


def candidates(host: str, path: str, labels: Iterable[int], lengths: Iterable[int]) -> list[str]:
    """Host suffixes of the given label counts, each with path prefixes of the given lengths; none of a host with a slash or MARK."""
    parts = host.split(".") if "/" not in host and MARK not in host else []
    return [entry_of(".".join(parts[len(parts) - n :]), path[:m]) for n in labels if n <= len(parts) for m in lengths if m <= len(path)]


#: Arrays that this Python worker has mapped, by the lookup they belong to; the oldest goes first.
_mapped: dict[str, DigestArray] = {}


def _once_a_worker(key: str, packed: Broadcast) -> DigestArray:
    if key not in _mapped:
        while len(_mapped) > 3:
            _mapped.pop(next(iter(_mapped)))
        _mapped[key] = DigestArray.mapped(packed.value)
    return _mapped[key]


def longest_match(urls: DataFrame, entries: DataFrame, name: str) -> DataFrame:
    """urls (with host and path) with the column name: the longest entry (host + path) that fits, else null.

    entries has host and path. Of the same length the smaller string wins. Nulls in urls' host
    or path count as empty; entries with a null in either, or a slash or question mark in the host, are left out; an empty list fits none.
    Up to MAX_ARRAY_BYTES, entries are one digest array that all executors map; beyond, they are
    one array a range of digests (_sharded), and candidates come to the arrays.
    """
    entries = entries.select("host", "path").dropna().where(~F.col("host").rlike("[/?]")).distinct()
    size = entries.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 24)).first()[0] or 0
    urls = without(urls, name)
    if size > MAX_ARRAY_BYTES:
        return _sharded(urls, entries, name, (size // SHARD_BYTES).bit_length())
    packed, key = urls.sparkSession.sparkContext.broadcast(DigestArray.pack((r.host, r.path) for r in entries.toLocalIterator())), uuid.uuid4().hex
    h, p = position(urls, "host"), position(urls, "path")

    def probe(batch: pa.RecordBatch) -> list[pa.Array]:
        array = _once_a_worker(key, packed)
        tries = [array.candidates(a or "", b or "") for a, b in zip(batch.column(h).to_pylist(), batch.column(p).to_pylist(), strict=True)]
        hit = iter(array.find([c for t in tries for c in t]).tolist())
        shown = [["".join(host_and_path(c)) for c in t if next(hit)] for t in tries]
        return [pa.array([min(s, key=lambda c: (-len(c), c), default=None) for s in shown], pa.string())]

    return with_arrow(urls, probe, {name: "string"})


def _sharded(urls: DataFrame, entries: DataFrame, name: str, bits: int) -> DataFrame:
    """longest_match with an array for each value of the digests' first bits.

    Distinct pairs of host and path send their candidates to the arrays. Every array stands in
    SALTS places, among which pairs are dealt by their hash, so a candidate that most pairs have
    isn't one task's. In a partition sorted by place, the entries come before the candidates: one
    array at a time is mapped, and candidates stream past it. Answers go back to the rows dealt
    the same way, as one URL may hold a third of them.
    """
    shapes = entries.agg(F.collect_set(F.size(F.split("host", r"\."))), F.collect_set(F.length("path"))).first()
    labels, lengths = sorted(shapes[0]), sorted(shapes[1])

    def shards(strings: list[str]) -> pa.Array:
        return pa.array([xxhash.xxh64_intdigest(x) >> (64 - bits) if bits else 0 for x in strings], pa.int64())

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tries = candidates(a, b, labels, lengths)
                yield pa.RecordBatch.from_arrays([pa.array([a] * len(tries), pa.string()), pa.array([b] * len(tries), pa.string()), pa.array(tries, pa.string()), shards(tries)], names=["h", "p", "entry", "shard"])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), shards(batch.column(0).to_pylist())], names=["entry", "shard"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, stored, array = None, [], None
        for batch in batches:
            hs, ps, tries, *at, asked = (c.to_pylist() for c in batch.columns)
            found, run = [], []
            for i, (x, ask) in enumerate([*zip(zip(*at, strict=True), asked, strict=True), (None, True)]):
                if run and x != place:
                    found += [j for j, hit in zip(run, array.find([tries[j] for j in run]).tolist(), strict=True) if hit]
                    run = []
                if x is None:
                    break
                if x != place:
                    place, stored, array = x, [], None
                if not ask:
                    stored.append(host_and_path(tries[i]))
                    continue
                if array is None:
                    array, stored = DigestArray.mapped(DigestArray.pack(stored)), []
                run.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([c[j] for j in found], pa.string()) for c in (hs, ps, tries)], names=["h", "p", "entry"])

    bounded_batches(urls.sparkSession)
    h, p = (F.coalesce(F.col(c), F.lit("")) for c in ("host", "path"))
    copies = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    asked = (
        urls.select(h.alias("h"), p.alias("p")).distinct().mapInArrow(spread, "h string, p string, entry string, shard long")
        .select("h", "p", "entry", "shard", F.pmod(F.xxhash64("h", "p"), F.lit(SALTS)).cast("int").alias("salt"), F.lit(True).alias("asked"))
    )
    none = F.lit(None).cast("string")
    arrays = (
        entries.select(F.concat("host", F.when(~F.col("path").startswith("/") & (F.col("path") != ""), MARK).otherwise(""), "path").alias("entry")).distinct().mapInArrow(placed, "entry string, shard long")
        .select(none.alias("h"), none.alias("p"), "entry", "shard", copies.alias("salt"), F.lit(False).alias("asked"))
    )
    places = max(SALTS << bits, int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    hits = asked.unionByName(arrays).repartition(places, "shard", "salt").sortWithinPartitions("shard", "salt", "asked").mapInArrow(probe, "h string, p string, entry string")
    shown = F.regexp_replace("entry", r"^([^/?]*)\?", "$1")
    best = hits.groupBy("h", "p").agg(F.min(F.struct((-F.length(shown)).alias("n"), shown.alias("e")))["e"].alias("found")).withColumn("part", copies)
    plain = urls.toDF(*[f"c{i}" for i in range(len(urls.columns))])
    h, p = (F.coalesce(F.col(f"c{position(urls, c)}"), F.lit("")) for c in ("host", "path"))
    rows = plain.withColumn("own_part", F.spark_partition_id() % SALTS)
    return rows.join(best, (h == best["h"]) & (p == best["p"]) & (F.col("own_part") == F.col("part")), "left").select(*plain.columns, "found").toDF(*urls.columns, name)


#: The rules (host, path, verdict), and the hosts that the filter's own list blocks.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
BLOCKED = [("casino-win.example.com", ""), ("free-bets.example.com", ""), ("adult-x.example.net", "")]


def judge(urls: DataFrame, rules: list[tuple[str, str, str]], blocked: DataFrame) -> DataFrame:
    """urls with host, path, rule, listed, verdict added (columns of these names are replaced).

    The longest rule that fits decides; without one, block if an entry of the list blocked (host,
    path) fits, else allow. A null URL or one without :// has an empty host and path.
    """
    spark = urls.sparkSession
    kept = without(urls, "host", "path", "rule", "listed", "verdict")
    split = kept.select("*", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    given = spark.createDataFrame([(h, p) for h, p, _ in rules], "host string, path string")
    found = longest_match(longest_match(split, given, "rule"), blocked, "listed")
    said = F.create_map(*[F.lit(x) for h, p, v in rules for x in (h + p, v)]) if rules else F.create_map().cast("map<string,string>")
    return found.withColumn("verdict", F.coalesce(said[F.col("rule")], F.when(F.col("listed").isNotNull(), "block").otherwise("allow")))


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    """Every page's url judged by RULES and the list BLOCKED: page_id, host, path, rule, verdict, listed. Null and odd urls have
    an empty host and path, which nothing fits, and are allowed; repeated rows come back as often; no pages give no rows."""
    blocked = spark.createDataFrame(BLOCKED, "host string, path string")
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), RULES, blocked).select("page_id", "host", "path", "rule", "verdict", "listed")


OP3_SQL = r"""
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
r(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
b(h) AS (VALUES ('casino-win.example.com'), ('free-bets.example.com'), ('adult-x.example.net')),
j AS (
  SELECT u.*, (SELECT max_by([r.h || r.p, r.v], length(r.h || r.p)) FROM r WHERE (host = r.h OR ends_with(host, '.' || r.h)) AND starts_with(path, r.p)) AS rule,
    (SELECT max_by(b.h, length(b.h)) FROM b WHERE host = b.h OR ends_with(host, '.' || b.h)) AS listed
  FROM u)
SELECT page_id, host, path, rule[1] AS rule, coalesce(rule[2], CASE WHEN listed IS NULL THEN 'allow' ELSE 'block' END) AS verdict, listed FROM j
"""
