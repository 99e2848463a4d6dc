"""Extraction tables derived from the driver's tables by integer arithmetic that SQL can repeat.

A truth record is an order; predictions and runs are the truth with values reformatted, changed,
or left out where a variant of the field says so (see VARIANTS). k is the order's key, c the
condition (0, 1) and r the run; at condition 0 runs don't differ.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.io import exists, scratch
from ..sources.schemas import CONDITIONS, N_RUNS, RAW_LOSS, TIERS

#: field -> multiplier, step and modulus of its variant.
VARIANTS = {
    "named_insured": (7, 3, 31), "mailing_address": (11, 5, 29), "business_description": (13, 7, 23), "effective_date": (17, 4, 19), "expiration_date": (19, 6, 37),
    "industry_code": (23, 8, 27), "industry_code_type": (29, 9, 41), "per_occurrence_limit": (31, 10, 43), "aggregate_limit": (37, 11, 33), "deductible": (41, 12, 25),
    "building_value": (43, 13, 39), "contents_value": (47, 14, 35), "year_built": (53, 15, 21), "construction_type": (59, 16, 26), "loss_history": (61, 17, 18),
}
BLANK = "(k % 20 = 1)"


def variant(field: str) -> str:
    """SQL for both engines."""
    a, b, m = VARIANTS[field]
    return f"((k * {a} + c * r * {b}) % {m})"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_kept: dict[tuple[str, str, str], tuple[str, str]] = {}
#: Documents of a bucket, at most about: what the runs of one task take in memory follows it.
BUCKET_DOCS = 25_000
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def buckets(spark: SparkSession, sf_dir: str) -> int:
    docs = _table(spark, sf_dir, "orders").count()
    return max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs // BUCKET_DOCS))


def kept(spark: SparkSession, sf_dir: str, name: str, build: Callable[[int], DataFrame]) -> DataFrame:
    """A derived table of documents, written to the shared folder when a session first asks for it and read from there since.

    It is in buckets of doc_id: what build gives for so many is dealt out by doc_id in advance, and what is
    made of the table and grouped or joined by doc_id is not shuffled again. Shuffle files go when it is written.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _kept or not exists(spark, _kept[key][0]):  # the shared folder may have been cleared
        path, n, before = scratch(spark, f"derived-{name}"), buckets(spark, sf_dir), spark.conf.get(_CLEANUP, None)
        spark.conf.set(_CLEANUP, "true")
        try:
            build(n).write.bucketBy(n, "doc_id").option("path", path).option("compression", "zstd").saveAsTable(stored := f"derived_{name}_{uuid.uuid4().hex}")
        finally:
            spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
        _kept[key] = path, stored
    return spark.table(_kept[key][1])


#: Typed truth columns as Spark SQL over orders, customer and nation.
_TRUTH = {
    "named_insured": "concat(c_name, ' ', c_mktsegment, ' LLC')",
    "mailing_address": "concat(k % 999 + 1, ' ', n_name, ' Street Suite ', k % 50)",
    "business_description": "concat(c_mktsegment, ' wholesale and retail business of ', n_name)",
    "effective_date": "cast(o_orderdate as date)",
    "expiration_date": "add_months(cast(o_orderdate as date), 12)",
    "industry_code": "if(k % 13 = 0, null, lpad(cast(k * 7919 % 1000000 as string), 6, '0'))",
    "industry_code_type": "if(k % 3 = 0, 'SIC', 'NAICS')",
    "per_occurrence_limit": "p",
    "aggregate_limit": "2 * p",
    "deductible": "if(k % 11 = 0, null, 500 * (1 + k % 10))",
    "building_value": "3 * p",
    "contents_value": "p + k % 1000",
    "year_built": "1955 + k % 65",
    "construction_type": "element_at(array('Fire Resistive', 'Masonry Non-Combustible', 'Frame', 'Joisted Masonry', 'Modified Fire Resistive'), cast(k % 5 + 1 as int))",
}


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, k, difficulty_tier, the typed truth columns, and losses: sorted array of raw events."""
    return kept(spark, sf_dir, "base", lambda n: _base(spark, sf_dir, n))


def _doc_id(k: str) -> F.Column:
    return F.concat(F.lit("doc_"), F.col(k)).alias("doc_id")


def _base(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """Both sides are dealt into n parts by doc_id. Customers are merged, as a broadcast of few MB of them is millions of strings; events are shuffled as numbers and marks."""
    orders = _table(spark, sf_dir, "orders").selectExpr("o_orderkey as k", "o_custkey", "o_orderdate", "cast(floor(o_totalprice) as bigint) as p")
    people = _table(spark, sf_dir, "customer").join(F.broadcast(_table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "c_mktsegment", "n_name")
    docs = orders.join(people.hint("merge"), F.col("o_custkey") == F.col("c_custkey")).drop("o_custkey", "c_custkey").withColumn("doc_id", _doc_id("k")).repartition(n, "doc_id")
    marks = F.struct(F.year("l_shipdate").alias("year"), F.col("l_returnflag").alias("flag"), F.expr("cast(floor(l_extendedprice / 25000) as int)").alias("paid"), (F.col("l_linestatus") == "O").alias("open"))
    events = _table(spark, sf_dir, "lineitem").where("l_orderkey is not null").select(_doc_id("l_orderkey"), marks.alias("e")).select("doc_id", "e.*").repartition(n, "doc_id")
    event = "struct(concat(e.year, '-01-01') as date, concat('Return ', e.flag) as cause, cast(e.paid as bigint) * 25000 as paid_amount, if(e.open, 'Open', 'Closed') as status)"
    losses = events.groupBy("doc_id").agg(F.collect_list(F.struct("year", "flag", "paid", "open")).alias("losses")).withColumn("losses", F.array_sort(F.expr(f"transform(losses, e -> {event})")))
    losses = losses.withColumn("losses", F.transform("losses", lambda e: F.struct(e["date"].alias("date"), e["cause"].alias("cause"), e["paid_amount"].cast("string").alias("paid_amount"), e["status"].alias("status"))))
    joined = docs.join(losses.hint("merge"), "doc_id", "left")
    tier = F.element_at(F.array(*map(F.lit, TIERS)), (F.col("k") % 5 + 1).cast("int"))
    none = F.array().cast(f"array<{RAW_LOSS.simpleString()}>")
    return joined.select("doc_id", "k", tier.alias("difficulty_tier"), *[F.expr(x).alias(f) for f, x in _TRUTH.items()], F.coalesce("losses", none).alias("losses"))


def _raw(values: dict[str, str], losses: str) -> str:
    return "struct(" + ", ".join(f"cast({x} as string) as {f}" for f, x in values.items()) + f", {losses} as loss_history)"


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, k, difficulty_tier, truth (raw extraction)."""
    return base(spark, sf_dir).select("doc_id", "k", "difficulty_tier", F.expr(_raw({f: f for f in _TRUTH}, "losses")).alias("truth"))


def _date(f: str) -> str:
    shapes = [f"date_format({f}, 'MM/dd/yyyy')", f"date_format({f}, 'yyyy/MM/dd')", f"date_format({f}, 'MMMM d, yyyy')", "null", f"cast(date_add({f}, 1) as string)", f"date_format({f}, 'dd/MM/yy')"]
    return _cases(f, shapes)


def _amount(f: str) -> str:
    return _cases(f, [f"concat('$', format_number({f}, 2))", f"concat({f}, '.0')", "null", f"cast({f} + 1 as string)", f"if({f} % 1000 = 0, concat({f} div 1000, 'K'), cast({f} as string))", "'N/A'"])


def _cases(f: str, shapes: list[str], other: str | None = None) -> str:
    cases = " ".join(f"when {i} then {s}" for i, s in enumerate(shapes))
    return f"case {variant(f)} {cases} else cast({other or f} as string) end"


def _predicted() -> str:
    v = {f: _date(f) for f in ("effective_date", "expiration_date")} | {f: _amount(f) for f in ("per_occurrence_limit", "aggregate_limit", "deductible", "building_value", "contents_value")}
    v["named_insured"] = _cases("named_insured", ["concat(upper(named_insured), '.')", "replace(named_insured, ' LLC', '')", "null", "'   '"])
    v["mailing_address"] = _cases("mailing_address", ["replace(mailing_address, ' Street', '  St.')", "null"])
    v["business_description"] = _cases("business_description", ["replace(business_description, ' and', '')", "concat(business_description, ' plus unrelated words here')", "null"])
    v["industry_code"] = _cases("industry_code", ["concat('NAICS ', industry_code)", "null", "if(industry_code is null, null, lpad(cast((k * 7919 + 1) % 1000000 as string), 6, '0'))", "concat(substring(industry_code, 1, 2), '-', substring(industry_code, 3, 4))"])
    v["industry_code_type"] = _cases("industry_code_type", ["concat(' ', lower(industry_code_type), ' ')", "null"])
    v["year_built"] = _cases("year_built", ["concat(year_built, '.0')", "cast(year_built + 1 as string)", "null", "concat(year_built, '.7')"])
    v["construction_type"] = _cases("construction_type", ["upper(replace(construction_type, ' ', '-'))", "concat(construction_type, ' X')", "null"])
    blank = {f: f"if({BLANK}, null, {v[f]})" for f in _TRUTH}
    kind = f"array<{RAW_LOSS.simpleString()}>"
    none = f"cast(array() as {kind})"
    no_status = "transform(losses, e -> struct(e.date as date, e.cause as cause, e.paid_amount as paid_amount, cast(null as string) as status))"
    losses = (
        f"cast(case when {BLANK} then {none} when {variant('loss_history')} = 0 then if(size(losses) > 0, slice(losses, 2, size(losses)), losses) "
        f"when {variant('loss_history')} = 1 then concat(slice(losses, 1, 1), losses) when {variant('loss_history')} = 2 then {no_status} when {variant('loss_history')} = 3 then {none} else losses end as {kind})"
    )
    return _raw(blank, losses)


def _made(rows: DataFrame, value: str, name: str) -> DataFrame:
    """rows with a column that is worked out once a row: a projection would be merged with those that read it, and stand in each mention."""
    return rows.withColumn(name, F.explode(F.array(F.expr(value))))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, k, condition, run_index, pred (raw extraction) of all conditions and runs.

    They are made from the base table as they are read, in its buckets, and never stored: they are ten times its rows.
    """
    rows = base(spark, sf_dir).withColumn("c", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(N_RUNS - 1))))
    condition = F.element_at(F.array(*map(F.lit, CONDITIONS)), F.col("c") + 1)
    named = rows.withColumn("condition", condition).withColumn("run_index", F.col("r"))
    return _made(named, _predicted(), "pred").select("doc_id", "k", "condition", "run_index", "pred")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, k, difficulty_tier, truth, pred: the predictions are those of run 0 at condition 0."""
    return kept(spark, sf_dir, "pairs", lambda _: _pairs(spark, sf_dir))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base(spark, sf_dir).withColumn("c", F.lit(0)).withColumn("r", F.lit(0))
    return rows.select("doc_id", "k", "difficulty_tier", F.expr(_raw({f: f for f in _TRUTH}, "losses")).alias("truth"), F.expr(_predicted()).alias("pred"))


def form_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, k, text: the truth as form text, in layouts by k."""
    return kept(spark, sf_dir, "forms", lambda _: _form_text(spark, sf_dir))


def _form_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = lambda f: f"if(k % 4 = 0, concat(date_format({f}, 'MM/dd/yy'), ' (', date_format({f}, 'dd/MM/yy'), ')'), date_format({f}, 'MM/dd/yyyy'))"
    limits = "if(k % 7 = 0, array(concat('Limits    ', per_occurrence_limit, '/', aggregate_limit)), array(concat('Per-Occurrence    $', format_number(per_occurrence_limit, 0), '    each'), concat('Aggregate    ', aggregate_limit)))"
    lines = (
        "flatten(array(array(concat('Named Insured    ', named_insured, '    Agency copy'), concat('Mailing Address    ', mailing_address), concat(industry_code_type, ' Code: ', coalesce(industry_code, '-')), "
        f"concat('Business Description: ', business_description), concat('Effective Date    ', {day('effective_date')}), concat('Expiration Date    ', {day('expiration_date')})), {limits}, "
        "array(concat('Deductible    ', coalesce(cast(deductible as string), '—')), concat('Building Value    ', building_value), concat('Contents Value    $', format_number(contents_value, 0)), concat('Year Built    ', year_built), "
        "concat('Construction Type    ', construction_type), 'Loss history'), if(size(losses) = 0, array('None reported'), "
        "transform(losses, e -> concat(date_format(cast(e.date as date), 'MM/dd/yyyy'), '   ', e.cause, '   $', format_number(cast(e.paid_amount as bigint), 0), '   ', e.status)))))"
    )
    return base(spark, sf_dir).select("doc_id", "k", F.expr(f"array_join({lines}, '\\n')").alias("text"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """call_id, run_id, ts, provider, model, prompt_tokens, completion_tokens from events."""
    models = "element_at(array('gpt-4o-mini', 'gpt-4o', 'claude-haiku-4-5', 'local-pdf-parser', 'some-other-model'), cast(event_id % 5 + 1 as int))"
    return _table(spark, sf_dir, "events").selectExpr(
        "event_id as call_id", "user_id % 7 as run_id", "cast(ts as timestamp) as ts", "event_type as provider", f"{models} as model",
        "if(event_id % 17 = 0, null, 100 + event_id * 37 % 5000) as prompt_tokens", "10 + event_id * 11 % 700 as completion_tokens",
    )
