"""Two tables from one scan: rows that are fine, and rows that are not, with what they were and why.

A batch is one write, split by a partition column, so the input is read once; an observation counts
each reason on the way. A batch that is repeated replaces itself.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.normalize import col

GOOD, BAD = "good", "bad"
#: Columns that a quarantine adds; rows may not have these.
OUTCOME, BATCH, REASONS = "outcome", "batch", "reasons"


class Sorted(NamedTuple):
    """good and bad as they are stored, and the number of rows: `good`, `bad`, and a number for each reason."""

    good: DataFrame
    bad: DataFrame
    counts: dict[str, int]


def _fields(rows: DataFrame, names: Sequence[str]) -> list[T.StructField]:
    return [T.StructField(n, rows.schema[n].dataType) for n in names]


def tables(spark: SparkSession, path: str, schema: T.StructType, good: Sequence[str], bad: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The good and the bad rows of all batches below path; schema is that of the stored rows."""
    whole = T.StructType([*schema.fields, T.StructField(REASONS, T.ArrayType(T.StringType())), T.StructField(BATCH, T.StringType()), T.StructField(OUTCOME, T.StringType())])
    rows = spark.read.schema(whole).parquet(path)
    return rows.where(F.col(OUTCOME) == GOOD).select(*good, BATCH), rows.where(F.col(OUTCOME) == BAD).select(*bad, REASONS, BATCH)


def sort_out(rows: DataFrame, reasons: Mapping[str, Column], path: str, good: Sequence[str], bad: Sequence[str], batch: str = "0") -> Sorted:
    """Writes rows below path and gives what was stored of all batches, and the counts of this one.

    reasons are named conditions, null counting as false; a row of which one holds at least is bad, and keeps
    the names of all that do. good and bad are the columns that are kept of the two: a value is not stored in the other
    table's rows. A row may have several reasons, so their counts add up to more than `bad`.
    """
    if taken := {OUTCOME, BATCH, REASONS} & {c.lower() for c in rows.columns}:
        raise ValueError(f"columns have names that are needed here: {sorted(taken)}")
    if clash := {GOOD, BAD} & {*reasons}:
        raise ValueError(f"these are no names of reasons: {sorted(clash)}")
    holds = [F.coalesce(c, F.lit(False)) for c in reasons.values()]
    # array_compact leaves out the conditions that don't hold
    marked = rows.withColumn(REASONS, F.array_compact(F.array(*[F.when(h, F.lit(n)) for n, h in zip(reasons, holds, strict=True)]).cast("array<string>")))
    is_bad = F.size(REASONS) > 0
    seen = Observation()
    count = lambda c, name: F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(name)
    observed = marked.observe(seen, count(~is_bad, GOOD), count(is_bad, BAD), *[count(F.array_contains(REASONS, n), n) for n in reasons])
    names = list(dict.fromkeys([*good, *bad]))
    kept = [F.when(is_bad if n not in good else ~is_bad, F.col(n)).alias(n) if (n in good) != (n in bad) else F.col(n) for n in names]
    stored = observed.select(*kept, F.when(is_bad, F.col(REASONS)).alias(REASONS), F.when(is_bad, BAD).otherwise(GOOD).alias(OUTCOME))
    stored.write.mode("overwrite").partitionBy(OUTCOME).parquet(f"{path.rstrip('/')}/{BATCH}={batch}")
    counts = {k: int(v) for k, v in seen.get.items()}
    return Sorted(*tables(rows.sparkSession, path, T.StructType(_fields(rows, names)), good, bad), counts)


def released(bad: DataFrame, fixed: Column | str) -> DataFrame:
    """Rows of the bad table, of those batches and reasons that the caller chose, whose condition fixed holds now: as they
    were, without reasons, to be sorted out again as a batch of another name."""
    return bad.where(F.coalesce(col(fixed), F.lit(False))).drop(REASONS, BATCH)
