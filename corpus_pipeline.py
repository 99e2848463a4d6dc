"""From documents to token ids: quality, near-duplicates, benchmark leaks, mixing, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.llm import decontamination, minhash, mixing, quality, tokens
from assaykit.llm.common import intermediates, quoted, table, written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels, doesn't reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of copies and near copies."""
    return minhash.keep_first(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item stands."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once, or twice."""
    whole = docs.select("doc_id", "source", "text", F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("whole"))
    taken = mixing.mix(whole).where("copies > 0")
    return taken.select("whole", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("whole.*")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids written as ORC, and for each document, read back, its place and a checksum."""
    return tokens.token_digest(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("MinHash near-dedup", one_of_each),
    ("benchmark decontamination", no_benchmark),
    ("mixing", mixed),
    ("token ids", token_ids),
]

#: Trees, signatures and tokenizers have no SQL. A test runs all stages against plain versions of each in turn.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn. When a stage is written, what it has worked with goes; stages' tables stay, for
    whoever looks into a run, until the shared folder is cleared.

    Documents may have nulls in any column and more columns than these; what becomes of them is said in
    each stage's operator. An empty table gives none.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with intermediates(spark):
            docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}", keep=True)
    return docs
