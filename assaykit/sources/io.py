"""Reading and writing of corpora, predictions, run results and reports.

Corpora of one small file a document are slow to list and don't split: read them once and keep
them as a table. Writers here make partitioned files, not one a document.
"""

from __future__ import annotations

import fnmatch
import re
import tempfile
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schemas import EXTRACTION, RUNS, TRUTH


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; a local one only on a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.gettempdir() + "/assaykit"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, if it is there."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def small_files(spark: SparkSession, root: str, name: str, beside: str | None = None) -> DataFrame:
    """path, content (bytes), beside (whether a file of that name stands in the same folder) of the files below root whose name fits the pattern.

    Spark's readers list all files in the driver, which millions fill. Here a task lists the root's own entries, and others go
    through what is below them and read it, so the driver holds no names. Of file systems that pyarrow opens; hidden names are passed over, as Spark does.
    """
    parts = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    seen = lambda path: not path.rsplit("/", 1)[1].startswith((".", "_"))

    def entries(batches):
        fs, base = pafs.FileSystem.from_uri(root)
        for batch in batches:
            found = fs.get_file_info(pafs.FileSelector(base)) if batch.num_rows else []
            for at in range(0, len(found), 10_000):
                some = [x for x in found[at : at + 10_000] if seen(x.path)]
                yield pa.RecordBatch.from_arrays([pa.array([x.path for x in some], pa.string()), pa.array([x.type == pafs.FileType.Directory for x in some], pa.bool_())], names=["path", "folder"])

    def files(fs, path, folder):
        if not folder:
            yield path
            return
        for x in fs.get_file_info(pafs.FileSelector(path)):
            if seen(x.path):
                yield from files(fs, x.path, x.type == pafs.FileType.Directory)

    def read(batches):
        fs, base = pafs.FileSystem.from_uri(root)
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.binary(), pa.bool_()))], names=["path", "content", "beside"])
        rows, size = [], 0
        for batch in batches:
            for entry, folder in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for path in files(fs, entry, folder):
                    above, own = path.rsplit("/", 1)
                    if not fnmatch.fnmatchcase(own, name):
                        continue
                    with fs.open_input_stream(path, compression=None) as f:
                        content = f.read()
                    with_it = beside is not None and fs.get_file_info(f"{above}/{beside}").type == pafs.FileType.File
                    rows.append((root.rstrip("/") + path[len(base.rstrip("/")) :], content, with_it))
                    size += len(content)
                    if len(rows) == 1000 or size > 16_000_000:
                        yield made(rows)
                        rows, size = [], 0
        yield made(rows)

    dealt = spark.range(0, 1, 1, 1).mapInArrow(entries, "path string, folder boolean").repartition(parts)
    return dealt.mapInArrow(read, "path string, content binary, beside boolean")


def _records(files: DataFrame, schema: T.StructType) -> DataFrame:
    """The files' columns and record: the JSON object of each, or those of its array; nulls for what is none."""
    parsed = F.from_json(F.col("content").cast("string"), T.ArrayType(schema))
    return files.where(F.length("content") > 0).withColumn("record", F.explode_outer(parsed))


def load_truth(spark: SparkSession, corpus_dir: str, with_pdf: bool = True, in_order: bool = True, in_tasks: bool = False) -> DataFrame:
    """doc_id, difficulty_tier, seed, extraction, path of {corpus_dir}/*/ground_truth.json; only of documents that
    have a document.pdf beside it, unless with_pdf is false. By path, which costs a sort of the whole corpus, unless in_order is false.
    Files are listed by Spark, in the driver, or in_tasks (see small_files)."""
    if in_tasks:
        files = _records(small_files(spark, corpus_dir, "ground_truth.json", "document.pdf"), TRUTH)
        truth = (files.where("beside") if with_pdf else files).select("record.*", "path")
        return truth.orderBy("path") if in_order else truth
    truth = spark.read.schema(TRUTH).option("multiLine", True).option("pathGlobFilter", "ground_truth.json").option("recursiveFileLookup", True).json(corpus_dir)
    truth = truth.select("*", F.col("_metadata.file_path").alias("path"))
    if with_pdf:
        parent = lambda c: F.regexp_replace(F.regexp_replace(c, r"/[^/]*\z", ""), r"\A[a-z]+:/*", "/")
        pdfs = spark.read.format("binaryFile").option("pathGlobFilter", "document.pdf").option("recursiveFileLookup", True).load(corpus_dir)
        truth = truth.withColumn("dir", parent(F.col("path"))).join(pdfs.select(parent(F.col("path")).alias("dir")), "dir", "left_semi").drop("dir")
    return truth.orderBy("path") if in_order else truth


def load_manifest(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """The records of one JSON array."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def load_predictions(spark: SparkSession, pred_dir: str, in_tasks: bool = False) -> DataFrame:
    """doc_id (from the file name), extraction of {pred_dir}/*.json, listed as in load_truth. Pairing with the truth is an inner join."""
    if in_tasks:
        preds = _records(small_files(spark, pred_dir, "*.json"), EXTRACTION).where(~F.substring("path", F.lit(len(pred_dir.rstrip("/")) + 2), F.length("path")).contains("/"))
        return preds.select(F.regexp_extract("path", r"([^/]*)\.json\z", 1).alias("doc_id"), F.struct(*[F.col(f"record.{f}").alias(f) for f in EXTRACTION.names]).alias("extraction"))
    preds = spark.read.schema(EXTRACTION).option("multiLine", True).option("pathGlobFilter", "*.json").json(pred_dir)
    return preds.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.json\z", "").alias("doc_id"), F.struct(*EXTRACTION.names).alias("extraction"))


def load_results(spark: SparkSession, path: str) -> DataFrame:
    """key, doc_id, condition, run_index, extraction of JSON lines; blank lines are passed over."""
    return spark.read.schema(RUNS).json(path)


def _lines(rows: DataFrame, path: str, mode: str, compression: str) -> None:
    rows.write.mode(mode).option("zlib.compress.level", "BEST_COMPRESSION").json(path, compression=compression)


def append_results(new: DataFrame, path: str, compression: str = "none") -> None:
    """Appends rows of RUNS; leave out what is done (worklist.remaining) before. Runs of a document beside each other are
    alike, so gzip takes a small part of their lines; files of both kinds are read as one log."""
    _lines(new.select(*RUNS.names), path, "append", compression)


def write_predictions(preds: DataFrame, path: str, compression: str = "none") -> None:
    """doc_id and the extraction's fields as JSON lines."""
    _lines(preds.select("doc_id", "extraction.*"), path, "overwrite", compression)


def run_summary(headline: DataFrame, per_field: DataFrame, spend_usd: DataFrame) -> DataFrame:
    """One row: n_docs, headline, min_field, max_field, spend_usd, per_field (map); spend_usd is one row with cost."""
    fields = per_field.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "accuracy")))).alias("per_field"))
    return (
        headline.crossJoin(fields).crossJoin(spend_usd.select(F.coalesce("cost", F.lit(0.0)).alias("spend_usd")))
        .select("n_docs", F.col("accuracy").alias("headline"), "min_field", "max_field", "spend_usd", "per_field")
    )


def stability_report(summary: DataFrame, flips: DataFrame) -> DataFrame:
    """A row a condition: condition, n_docs, single, majority, flip_rates (map)."""
    rates = flips.groupBy("condition").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "flip_rate")))).alias("flip_rates"))
    return summary.join(rates, "condition").select("condition", "n_docs", "single", "majority", "flip_rates")


STABILITY = "condition string, n_docs bigint, single double, majority double, flip_rates map<string,double>"


def write_report(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def load_stability(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(summary, flips) as condition_summary and flip_rates give them, without delta."""
    report = spark.read.schema(STABILITY).json(path)
    flips = report.select("condition", F.explode("flip_rates").alias("field", "flip_rate"), "n_docs")
    return report.select("condition", "single", "majority", "n_docs"), flips
