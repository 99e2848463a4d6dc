"""The splittable reader: every record once at every split, damage is reported, work is dealt out and linear."""

import hashlib
import random
import time
import zlib

import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from assaykit.llm import warc
from assaykit.llm.common import new_path

FS = pafs.LocalFileSystem()


def packed(page, html, level=6):
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(warc.record(page, "u", html.encode(), hashlib.sha256(html.encode()).hexdigest(), None)) + c.flush()


@pytest.fixture
def archive(tmp_path):
    def make(parts):
        path = tmp_path / "x.warc.gz"
        path.write_bytes(b"".join(parts))
        return str(path), sum(map(len, parts))

    return make


def read(path, size, split):
    """The page of each member, or the place of damage."""
    found = [m for a in range(0, size, split) for m in warc.members(FS, path, a, min(size, a + split))]
    return [at if raw is None else warc.page_of(warc.parse(raw)[0]["warc-record-id"]) for at, raw in found]


def random_parts():
    random.seed(4)
    return [packed(str(i), random.randbytes(random.randrange(3000)).hex() + "\x1f", random.choice((0, 6))) for i in range(30)]


def test_members_at_every_split(archive):
    path, size = archive(random_parts())
    for split in (100, 999, 5000, size):
        assert read(path, size, split) == [str(i) for i in range(30)]


@pytest.mark.parametrize("split", [300, 2000, 10**9])
def test_damage_is_reported_once(archive, split):
    parts = random_parts()
    starts = [sum(map(len, parts[:i])) for i in range(30)]
    head = [*parts[:6], bytes(len(parts[6])), *parts[7:]]  # no member there any more
    path, size = archive(head)
    assert read(path, size, split) == [*map(str, range(6)), starts[6], *map(str, range(7, 30))]
    body = bytearray(parts[6])
    body[-10] ^= 1
    path, size = archive([*parts[:6], bytes(body), *parts[7:]])
    assert read(path, size, split) == [*map(str, range(6)), starts[6], *map(str, range(7, 30))]
    path, size = archive([b"junk", *parts[:3]])
    assert read(path, size, split) == [0, "0", "1", "2"]
    path, size = archive([*parts[:3], parts[3][:-9]])
    assert read(path, size, split) == ["0", "1", "2", starts[3]]
    path, size = archive([b"no archive at all" * 9])
    assert read(path, size, split) == [0]


def test_damaged_rows(spark, archive):
    parts = random_parts()[:4]
    path, size = archive([parts[0], parts[1][:-1], parts[2]])
    files = spark.createDataFrame([(path, size)], "path string, bytes long")
    got = warc.read_warc(spark, files).orderBy("position").collect()
    assert [(r.page_id, r.record_type, r.intact) for r in got] == [("0", "response", True), (None, "damaged", False), ("2", "response", True)]


def test_long_members_in_linear_time(archive):
    random.seed(1)
    html = random.randbytes(24 << 20).hex()
    path, size = archive([packed("0", html, 1)])
    began = time.time()
    ((_, raw),) = warc.members(FS, path, 0, size)
    assert len(raw) > len(html) and time.time() - began < 6


def test_ids_come_back(spark):
    rows = [("a b", "x" * 200), ("null", "x" * 200), (None, "y"), ("<urn:page:é%20>\r\n", "z"), ("", "q")]
    pages = spark.createDataFrame(rows, "page_id string, html string").withColumn("url", F.lit(None).cast("string"))
    got = warc.read_warc(spark, warc.write_warc(pages, new_path(spark, "warc"))).collect()
    assert sorted((str(r.page_id), r.refers_to) for r in got) == sorted([("a b", None), ("null", "a b"), ("None", None), ("<urn:page:é%20>\r\n", None), ("", None)])


def test_ranges_are_dealt_out(spark):
    random.seed(7)
    pages = spark.createDataFrame([(i, "u", random.randbytes(2000).hex()) for i in range(300)], "page_id long, url string, html string")
    files = warc.write_warc(pages, new_path(spark, "warc"))
    got = warc.read_warc(spark, files, split_bytes=20_000)
    per_task = {r.task: r.n for r in got.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n")).collect()}
    assert sum(per_task.values()) == 300 and len(per_task) >= 8 and max(per_task.values()) < 100
