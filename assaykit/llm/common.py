"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def _local_shared_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-shared-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (spark.checkpoint.dir).

    Only a local master, where they are one process, may go without the setting.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_shared_dir()


_made = threading.local()


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if (paths := getattr(_made, "paths", None)) is not None:
        paths[path] = False
    return path


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the folders of new_path that were made in it by this thread, but for tables
    written with keep: these are left to the intermediates around it, or to the user, who may clear the
    shared folder when the result has been written."""
    outer, _made.paths = getattr(_made, "paths", None), {}
    try:
        yield
    finally:
        paths, _made.paths = _made.paths, outer
        for path, kept in paths.items():
            if not kept:
                folder = spark._jvm.org.apache.hadoop.fs.Path(path)
                folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
            elif outer is not None:
                outer[path] = False


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """df as a table written to the shared folder: it survives lost executors and cuts the lineage.

    Its size is known to the planner, which broadcasts it in joins only if it is below
    spark.sql.autoBroadcastJoinThreshold. Shuffle files of the write are dropped when it ends, by a
    setting that holds for the session meanwhile. keep saves the table from intermediates.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)
    if keep and getattr(_made, "paths", None) is not None:
        _made.paths[path] = True
    return spark.read.schema(df.schema).parquet(path)


def quoted(name: str) -> str:
    """The name as SQL text, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without its columns of these names, which Spark compares without regard to case."""
    gone = {n.lower() for n in names}
    return df.select(*[F.col(quoted(c)) for c in df.columns if c.lower() not in gone])


def unused(df: DataFrame, name: str) -> str:
    """The name, or the name after as many underscores as no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def position(df: DataFrame, name: str) -> int:
    """Of the column name among df's columns, without regard to case."""
    return [c.lower() for c in df.columns].index(name.lower())


def with_arrow(df: DataFrame, work: Callable[[pa.RecordBatch], list[pa.Array]], added: dict[str, str]) -> DataFrame:
    """df with the columns added (name -> type), which work makes of each batch.

    Columns go through it by place, as mapInArrow takes no names with dots in them.
    """
    names = [f"c{i}" for i in range(len(df.columns) + len(added))]
    kinds = [*(f.dataType.simpleString() for f in df.schema.fields), *added.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *work(batch)], names=names)

    plain = df.toDF(*names[: len(df.columns)])
    return plain.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True))).toDF(*df.columns, *added)


def bounded_batches(spark: SparkSession, rows: int = 1000, size: str = "16m") -> None:
    """From now on, Arrow batches of the session hold no more than this: long texts in batches of
    the default 10,000 rows could fill a Python worker's memory. Smaller settings stay.

    The setting can't be put back: results are lazy, and it must hold when they are worked out.
    Sessions that want other batches elsewhere should use operators in a session of their own."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def word_count(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")

