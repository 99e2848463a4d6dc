"""Queries over the derived tables, and SQL for an independent engine that must give the same rows.

The SQL never parses a raw string: it works out from the variants which values are right, and
what they normalize to. So it checks parsing, scoring and rollups at once.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import formtext
from ..functions import normalize as N
from ..operators import metrics, routing, scoring, stability, state, usage, worklist
from ..sources import io, validate
from ..sources.io import scratch
from ..sources.schemas import ALL_FIELDS, AMOUNT_FIELDS, CONDITIONS, DATE_FIELDS, EXTRACTION, N_RUNS, SCALAR_FIELDS, TIERS
from ..streaming import ingest
from . import fixtures
from .fixtures import BLANK, variant

# ---------------------------------------------------------------- SQL

_TEXT = ("named_insured", "mailing_address", "business_description", "construction_type")
_PRED_TEXT = {
    "named_insured": ["named_insured", "replace(named_insured, ' LLC', '')", "NULL", "NULL"],
    "mailing_address": ["replace(mailing_address, ' Street', ' St')", "NULL"],
    "business_description": ["replace(business_description, ' and', '')", "business_description || ' plus unrelated words here'", "NULL"],
    "construction_type": ["construction_type", "construction_type || ' X'", "NULL"],
}
_AMOUNT_OK = {2: "{f} IS NULL", 3: "{f} IS NULL", 5: "{f} IS NULL"}


def _case(field: str, cases: dict[int, str], other: str) -> str:
    return f"CASE {variant(field)} " + " ".join(f"WHEN {i} THEN {x}" for i, x in cases.items()) + f" ELSE {other} END"


def _tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-z0-9]+')"


def _unclear(f: str) -> str:
    return f"(day({f}) <= 12 AND day({f}) <> month({f}))"


def _canon_sql(f: str) -> str:
    """Canonical value as text; null for missing."""
    if f in DATE_FIELDS:
        true, swapped = f"strftime({f}, '%Y-%m-%d')", f"strftime({f}, '%Y-%d-%m')"
        cases = {0: f"CASE WHEN {_unclear(f)} THEN {true} || ',' || {swapped} ELSE {true} END", 3: "NULL", 4: f"strftime({f} + 1, '%Y-%m-%d')", 5: f"CASE WHEN {_unclear(f)} THEN {swapped} || ',' || {true} ELSE {true} END"}
        x = _case(f, cases, true)
    elif f == "industry_code":
        x = _case(f, {1: "NULL", 2: "CASE WHEN industry_code IS NULL THEN NULL ELSE lpad(((k * 7919 + 1) % 1000000)::VARCHAR, 6, '0') END"}, "industry_code")
    elif f == "industry_code_type":
        x = _case(f, {0: "' ' || industry_code_type || ' '", 1: "NULL"}, "industry_code_type")
    elif f in AMOUNT_FIELDS:
        x = _case(f, {2: "NULL", 3: f"({f} + 1)::VARCHAR", 5: "NULL"}, f"{f}::VARCHAR")
    elif f == "year_built":
        x = _case(f, {1: "(year_built + 1)::VARCHAR", 2: "NULL"}, "year_built::VARCHAR")
    elif f in _TEXT:
        x = f"array_to_string({_tokens(_case(f, dict(enumerate(_PRED_TEXT[f])), f))}, ' ')"
    else:
        drop = "CASE WHEN n_losses = 1 THEN 'none' ELSE 'fewer' END"
        return f"CASE WHEN n_losses = 0 OR {BLANK} THEN 'none' ELSE {_case(f, {0: drop, 1: repr('more'), 3: repr('none')}, repr('same'))} END"
    return f"CASE WHEN {BLANK} THEN NULL ELSE {x} END"


def _ok_sql(f: str) -> str:
    """Whether the predicted value is right."""
    if f in DATE_FIELDS:
        x = _case(f, {0: f"NOT {_unclear(f)}", 3: "false", 4: "false", 5: f"NOT {_unclear(f)}"}, "true")
    elif f == "industry_code":
        x = _case(f, {1: "industry_code IS NULL", 2: "industry_code IS NULL"}, "true")
    elif f == "industry_code_type":
        x = _case(f, {1: "false"}, "true")
    elif f in AMOUNT_FIELDS:
        x = _case(f, {i: t.format(f=f) for i, t in _AMOUNT_OK.items()}, "true")
    elif f == "year_built":
        x = _case(f, {1: "false", 2: "false"}, "true")
    elif f == "construction_type":
        x = _case(f, {1: "false", 2: "false"}, "true")
    elif f in _TEXT:
        a, b = _tokens(_case(f, dict(enumerate(_PRED_TEXT[f])), f)), _tokens(f)
        x = f"coalesce(len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))), 0) >= 0.8"
    else:
        return f"(n_losses = 0 OR NOT ({BLANK} OR {variant(f)} IN (0, 1, 3)))"
    missing = f"{f} IS NULL" if f in (*AMOUNT_FIELDS, "industry_code") else "false"
    return f"CASE WHEN {BLANK} THEN {missing} ELSE {x} END"


_TYPE = "CASE k % 5 WHEN 0 THEN 'Fire Resistive' WHEN 1 THEN 'Masonry Non-Combustible' WHEN 2 THEN 'Frame' WHEN 3 THEN 'Joisted Masonry' ELSE 'Modified Fire Resistive' END"
_TIER = "CASE k % 5 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(TIERS)) + " END"
BASE = f"""
o AS (SELECT o_orderkey AS k, floor(o_totalprice)::BIGINT AS p, o_orderdate::DATE AS d, c_name, c_mktsegment, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
ll AS (SELECT l_orderkey, count(*) AS n_losses FROM lineitem GROUP BY l_orderkey),
t AS (
  SELECT 'doc_' || k AS doc_id, k, {_TIER} AS difficulty_tier, c_name || ' ' || c_mktsegment || ' LLC' AS named_insured,
    (k % 999 + 1) || ' ' || n_name || ' Street Suite ' || (k % 50) AS mailing_address, c_mktsegment || ' wholesale and retail business of ' || n_name AS business_description,
    d AS effective_date, (d + INTERVAL 12 MONTH)::DATE AS expiration_date, CASE WHEN k % 13 = 0 THEN NULL ELSE lpad((k * 7919 % 1000000)::VARCHAR, 6, '0') END AS industry_code,
    CASE WHEN k % 3 = 0 THEN 'SIC' ELSE 'NAICS' END AS industry_code_type, p AS per_occurrence_limit, 2 * p AS aggregate_limit,
    CASE WHEN k % 11 = 0 THEN NULL ELSE 500 * (1 + k % 10) END AS deductible, 3 * p AS building_value, p + k % 1000 AS contents_value,
    1955 + k % 65 AS year_built, {_TYPE} AS construction_type, coalesce(n_losses, 0) AS n_losses
  FROM o LEFT JOIN ll ON k = l_orderkey)"""
_RUN_ROWS = f"rr AS (SELECT t.*, c, r, CASE c WHEN 0 THEN 'temp_0' ELSE 'temp_default' END AS condition FROM t, range(2) AS x(c), range({N_RUNS}) AS y(r))"
_ONE_ROW = "rr AS (SELECT t.*, 0 AS c, 0 AS r, 'temp_0' AS condition FROM t)"
_OKS = ", ".join(f"({_ok_sql(f)}) AS ok_{f}" for f in ALL_FIELDS)
_COUNT = " + ".join(f"ok_{f}::INT" for f in ALL_FIELDS)
_SCALARS = " + ".join(f"ok_{f}::INT" for f in SCALAR_FIELDS)
SCORED = f"{BASE}, {_ONE_ROW}, f AS (SELECT doc_id, k, difficulty_tier, {_OKS} FROM rr), s AS (SELECT *, ({_COUNT}) / 15.0::DOUBLE AS aggregate_accuracy, ({_SCALARS}) / 14.0::DOUBLE AS scalar_accuracy FROM f)"
_UNNEST = "unnest([" + ", ".join(f"{{'field': '{f}', 'ok': ok_{f}}}" for f in ALL_FIELDS) + "])"
LONG = f"{SCORED}, u AS (SELECT doc_id, difficulty_tier, c.field AS field, c.ok AS ok FROM (SELECT doc_id, difficulty_tier, {_UNNEST} AS c FROM s))"
_CELLS = "unnest([" + ", ".join(f"{{'field': '{f}', 'canon': coalesce({_canon_sql(f)}, '(none)'), 'ok': {_ok_sql(f)}}}" for f in ALL_FIELDS) + "])"
RUN_CELLS = f"{BASE}, {_RUN_ROWS}, u AS (SELECT doc_id, k, condition, r, x.field AS field, x.canon AS canon, x.ok AS ok FROM (SELECT doc_id, k, condition, r, {_CELLS} AS x FROM rr))"
VOTES = f"""{RUN_CELLS},
v AS (SELECT doc_id, condition, field, canon, count(*) AS n, min(r) AS first, arg_min(ok, r) AS ok FROM u GROUP BY ALL),
m AS (SELECT doc_id, condition, field, arg_max(canon, n * 100 - first) AS canon, arg_max(ok, n * 100 - first) AS ok, count(*) AS n_values FROM v GROUP BY doc_id, condition, field)"""
FLIPS = "fl AS (SELECT condition, field, avg((n_values > 1)::INT::DOUBLE) AS flip_rate, count(*) AS n_docs FROM m GROUP BY condition, field)"
SUMMARY = """
sd AS (SELECT doc_id, condition, avg(ok::INT::DOUBLE) AS single FROM u GROUP BY doc_id, condition),
md AS (SELECT doc_id, condition, avg(ok::INT::DOUBLE) AS majority FROM m GROUP BY doc_id, condition)"""
_PF = "pf AS (SELECT field, sum(ok::INT)::BIGINT AS correct, count(*) AS total, avg(ok::INT::DOUBLE) AS accuracy FROM u GROUP BY field)"
POLICY = f"""{VOTES.replace(BASE, BASE, 1)}, {FLIPS},
pf AS (SELECT field, avg(ok::INT::DOUBLE) AS accuracy FROM u WHERE condition = 'temp_0' AND r = 0 GROUP BY field),
po AS (
  SELECT pf.field, round(accuracy, 6) AS accuracy, round(greatest(coalesce(a.flip_rate, 0), coalesce(b.flip_rate, 0)), 6) AS flip_rate,
    round(coalesce(a.flip_rate, 0), 6) AS flip_rate_temp_0, round(coalesce(b.flip_rate, 0), 6) AS flip_rate_temp_default,
    CASE WHEN accuracy >= 0.95 AND greatest(a.flip_rate, b.flip_rate) <= 0.05 THEN 'auto_post' WHEN accuracy < 0.80 AND greatest(a.flip_rate, b.flip_rate) > 0.20 THEN 'always_human' ELSE 'review' END AS class
  FROM pf LEFT JOIN fl a ON pf.field = a.field AND a.condition = 'temp_0' LEFT JOIN fl b ON pf.field = b.field AND b.condition = 'temp_default')"""
_CALLS = """
cl AS (
  SELECT event_id AS call_id, user_id % 7 AS run_id, ts, event_type AS provider, CASE WHEN event_id % 17 = 0 THEN NULL ELSE 100 + event_id * 37 % 5000 END AS prompt_tokens, 10 + event_id * 11 % 700 AS completion_tokens,
    CASE event_id % 5 WHEN 0 THEN 'gpt-4o-mini' WHEN 1 THEN 'gpt-4o' WHEN 2 THEN 'claude-haiku-4-5' WHEN 3 THEN 'local-pdf-parser' ELSE 'some-other-model' END AS model,
    CASE event_id % 5 WHEN 0 THEN 15 WHEN 1 THEN 250 WHEN 2 THEN 100 WHEN 3 THEN 0 ELSE 100 END::BIGINT AS pin, CASE event_id % 5 WHEN 0 THEN 60 WHEN 1 THEN 1000 WHEN 2 THEN 500 WHEN 3 THEN 0 ELSE 500 END::BIGINT AS pout
  FROM events),
co AS (SELECT *, coalesce(prompt_tokens, 0) * pin + completion_tokens * pout AS cost FROM cl)"""  # whole 1e-8 USD: sums are exact


def _usd(cost: str) -> str:
    """USD to six places of a sum of costs."""
    return f"((({cost}) + 50) // 100)::DOUBLE / 1e6::DOUBLE"


# ---------------------------------------------------------------- helpers


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles and decimals rounded: means depend on the order of adding in their last bits."""
    return df.select(*[F.round(c, digits).cast("double").alias(c) if t == "double" or t.startswith("decimal") else F.col(c) for c, t in df.dtypes])


QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _scored(spark, sf_dir):
    return scoring.score_pairs(fixtures.pairs(spark, sf_dir))


# ---------------------------------------------------------------- C: normalizers


_NORMAL = f"""WITH {BASE}, {_ONE_ROW}
SELECT doc_id, {", ".join(f"CASE WHEN contains({_canon_sql(f)}, ',') THEN NULL ELSE {_canon_sql(f)} END AS {f}_iso, CASE WHEN contains({_canon_sql(f)}, ',') THEN {_canon_sql(f)} ELSE '' END AS {f}_unclear" for f in DATE_FIELDS)},
  {_canon_sql("industry_code")} AS industry_code, trim({_canon_sql("industry_code_type")}) AS industry_code_type,
  {", ".join(f"({_canon_sql(f)})::DOUBLE AS {f}" for f in AMOUNT_FIELDS)}, ({_canon_sql("year_built")})::BIGINT AS year_built, {_canon_sql("construction_type")} AS construction_type,
  upper(regexp_replace(named_insured, '[^A-Za-z0-9]', '', 'g')) AS identifier, p_left AS limit_left, p_right AS limit_right
FROM (SELECT *, per_occurrence_limit::DOUBLE AS p_left, CASE WHEN k % 4 = 0 THEN NULL ELSE aggregate_limit * 1e3::DOUBLE END AS p_right FROM rr)"""


@query(_NORMAL)
def normalized_values(spark, sf_dir):
    """C1-C7, C9, C10 over raw predictions."""
    rows = fixtures.pairs(spark, sf_dir)
    pred = F.col("pred")
    dates = []
    for f in DATE_FIELDS:
        d = N.normalize_date(pred[f])
        dates += [d["iso"].alias(f"{f}_iso"), F.array_join(d["candidates"], ",").alias(f"{f}_unclear")]
    compound = F.when(F.col("k") % 4 == 0, F.col("truth.per_occurrence_limit")).otherwise(F.concat(F.lit("$"), F.col("truth.per_occurrence_limit"), F.lit(" / "), F.col("truth.aggregate_limit"), F.lit("k")))
    limits = N.split_compound_limits(compound)
    return rows.select(
        "doc_id", *dates, N.normalize_code(pred["industry_code"]).alias("industry_code"), N.code_type(pred["industry_code_type"]).alias("industry_code_type"),
        *[N.normalize_amount(pred[f]).alias(f) for f in AMOUNT_FIELDS], N.normalize_int(pred["year_built"]).alias("year_built"), F.array_join(N.normalize_text_tokens(N.missing_to_none(pred["construction_type"])), " ").alias("construction_type"),
        N.normalize_identifier(F.col("truth.named_insured")).alias("identifier"), limits["left"].alias("limit_left"), limits["right"].alias("limit_right"),
    )


@query("""WITH d AS (SELECT d.doc_id, b.item_id, list_distinct(regexp_extract_all(lower(d.text), '[a-z0-9]+')) AS a, list_distinct(regexp_extract_all(lower(b.text), '[a-z0-9]+')) AS b
  FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id % (SELECT max(item_id) + 1 FROM benchmark))
SELECT doc_id, item_id, len(a)::INT AS n_tokens, round(CASE WHEN len(a) = 0 AND coalesce(len(b), 0) = 0 THEN 1 WHEN len(a) = 0 OR coalesce(len(b), 0) = 0 THEN 0 ELSE len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) END, 6) AS overlap FROM d""")
def document_overlap(spark, sf_dir):
    """C7, C8 over real texts: each document against one item of the whole benchmark, by their ids."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", F.col("text").alias("item"))
    n = (items.agg(F.max("item_id")).first()[0] or 0) + 1
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", (F.col("doc_id") % n).alias("of_item"))
    tokens = F.coalesce(F.size(F.array_distinct(N.normalize_text_tokens("text"))), F.lit(0))
    return docs.join(items, F.col("of_item") == F.col("item_id"), "left").select("doc_id", "item_id", tokens.alias("n_tokens"), F.round(N.token_overlap("text", "item"), 6).alias("overlap"))


# ---------------------------------------------------------------- D: scores


@query(f"WITH {LONG} SELECT doc_id, field, ok AS correct FROM u")
def field_scores(spark, sf_dir):
    """Long form."""
    return scoring.field_details(fixtures.pairs(spark, sf_dir), ["doc_id"]).drop("detail")


#: field -> variants whose raw prediction is null, and those where it is not even if the truth is.
_RAW_NULL = {f: ((3,), ()) for f in DATE_FIELDS} | {f: ((2,), (5,)) for f in AMOUNT_FIELDS} | {
    "industry_code": ((1,), ()), "industry_code_type": ((1,), ()), "year_built": ((2,), ()), "named_insured": ((2,), ()), "mailing_address": ((1,), ()), "business_description": ((2,), ()), "construction_type": ((2,), ()),
}


def _raw_missing(f: str) -> str:
    null, other = _RAW_NULL[f]
    return f"{BLANK} OR {_case(f, {i: 'true' for i in null} | {i: 'false' for i in other}, f'{f} IS NULL')}"


_RAW_CELLS = ", ".join(f"{{'field': '{f}', 'truth': {f}::VARCHAR, 'missing': {_raw_missing(f)}}}" for f in SCALAR_FIELDS)


@query(f"WITH {BASE}, {_ONE_ROW}, x AS (SELECT doc_id, unnest([{_RAW_CELLS}]) AS c FROM rr) SELECT doc_id, c.field AS field, c.truth AS truth, c.missing AS missing FROM x")
def raw_cells(spark, sf_dir):
    """Raw values in long form."""
    return scoring.long_fields(fixtures.pairs(spark, sf_dir), ["doc_id"]).select("doc_id", "field", "truth", F.col("pred").isNull().alias("missing"))


@query(f"WITH {SCORED} SELECT doc_id, round(scalar_accuracy, 6) AS scalar_accuracy, round(aggregate_accuracy, 6) AS aggregate_accuracy, ok_loss_history FROM s")
def document_scores(spark, sf_dir):
    """D6."""
    return _rounded(_scored(spark, sf_dir).select("doc_id", "scalar_accuracy", "aggregate_accuracy", "ok_loss_history"))


_LOSS = f"""WITH {BASE}, {_ONE_ROW},
x AS (SELECT doc_id, n_losses AS n, CASE WHEN n_losses = 0 THEN 9 WHEN {BLANK} THEN 3 ELSE {variant("loss_history")} END AS v FROM rr),
y AS (SELECT doc_id, CASE v WHEN 0 THEN n - 1 WHEN 3 THEN 0 ELSE n END AS tp, CASE v WHEN 1 THEN 1 ELSE 0 END AS fp, CASE v WHEN 0 THEN 1 WHEN 3 THEN n ELSE 0 END AS fn FROM x),
z AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 1 END AS p, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 1 END AS r FROM y)
SELECT doc_id, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 1 END, 6) AS f1, tp::INT AS true_positives, fp::INT AS false_positives, fn::INT AS false_negatives, fp = 0 AND fn = 0 AS exact_set_match FROM z"""


@query(_LOSS)
def loss_scores(spark, sf_dir):
    """D4, D5 within the row."""
    return _rounded(fixtures.pairs(spark, sf_dir).select("doc_id", scoring.loss_score(F.col("truth.loss_history"), F.col("pred.loss_history")).alias("l")).select("doc_id", "l.*"))


@query(_LOSS)
def loss_scores_by_key(spark, sf_dir):
    """D5 by exploding and grouping."""
    return _rounded(scoring.loss_scores_grouped(fixtures.pairs(spark, sf_dir).select("doc_id", "truth", "pred"), "doc_id"))


# ---------------------------------------------------------------- E: rollups


@query(f"WITH {LONG}, {_PF} SELECT field, correct, total, round(accuracy, 6) AS accuracy FROM pf")
def per_field_accuracy(spark, sf_dir):
    """E1."""
    return _rounded(metrics.per_field(_scored(spark, sf_dir)))


@query(f"WITH {SCORED} SELECT difficulty_tier, round(avg(aggregate_accuracy), 6) AS accuracy, count(*) AS n_docs FROM s GROUP BY difficulty_tier")
def per_tier_accuracy(spark, sf_dir):
    """E2."""
    return _rounded(metrics.per_tier(_scored(spark, sf_dir)))


@query(f"WITH {LONG} SELECT difficulty_tier, field, sum(ok::INT)::BIGINT AS correct, count(*) AS total, round(avg(ok::INT::DOUBLE), 6) AS accuracy FROM u GROUP BY difficulty_tier, field")
def tier_field_accuracy(spark, sf_dir):
    """E3."""
    return _rounded(metrics.per_tier_field(_scored(spark, sf_dir)))


@query(f"WITH {LONG}, {_PF} SELECT (SELECT round(avg(aggregate_accuracy), 6) FROM s) AS accuracy, (SELECT count(*) FROM s) AS n_docs, round(min(accuracy), 6) AS min_field, round(max(accuracy), 6) AS max_field FROM pf")
def headline_accuracy(spark, sf_dir):
    """E4, E6."""
    return _rounded(metrics.evaluate(fixtures.pairs(spark, sf_dir))["headline"])


@query(f"WITH {LONG} SELECT difficulty_tier, field, (grouping(difficulty_tier) * 2 + grouping(field))::INT AS level, sum(ok::INT)::BIGINT AS correct, count(*) AS total, round(avg(ok::INT::DOUBLE), 6) AS accuracy FROM u GROUP BY CUBE (difficulty_tier, field)")
def accuracy_cube(spark, sf_dir):
    """E5."""
    return _rounded(metrics.all_levels(_scored(spark, sf_dir)))


@query(f"WITH {BASE} SELECT count(*) AS n_docs, 0::BIGINT AS n_failed FROM t")
def self_check(spark, sf_dir):
    """How many records don't score 1 against themselves."""
    truth = fixtures.truth(spark, sf_dir)
    failed = metrics.self_check(truth).agg(F.count("*").alias("n_failed"))
    return truth.agg(F.count("*").alias("n_docs")).crossJoin(failed)


# ---------------------------------------------------------------- F: stability


@query(f"WITH {VOTES}, {FLIPS} SELECT condition, field, round(flip_rate, 6) AS flip_rate, n_docs FROM fl")
def flip_rates(spark, sf_dir):
    """F1-F3, F6, F7."""
    return _rounded(stability.flip_rates(fixtures.runs(spark, sf_dir).drop("k")))


@query(SQL["flip_rates"])
def flip_rates_long(spark, sf_dir):
    """F3, F6 in long form, for any number of runs a document."""
    return _rounded(stability.flips_long(fixtures.runs(spark, sf_dir)))


@query(f"""WITH {RUN_CELLS}, g AS (SELECT condition, field, doc_id, count(*) AS n, count(DISTINCT canon) AS n_values FROM u WHERE NOT (condition = 'temp_default' AND (k + r) % 9 = 0) GROUP BY ALL)
SELECT condition, field, round(avg((n_values > 1)::INT::DOUBLE), 6) AS flip_rate, count(*) AS n_docs FROM g WHERE n >= {N_RUNS} GROUP BY condition, field""")
def flip_rates_of_complete(spark, sf_dir):
    """some documents lack a run of one condition and are left out there."""
    runs = fixtures.runs(spark, sf_dir).where(~((F.col("condition") == "temp_default") & ((F.col("k") + F.col("run_index")) % 9 == 0)))
    return _rounded(stability.flip_rates(runs.drop("k")))


_VOTED = ("year_built", "industry_code", "named_insured", "per_occurrence_limit", "effective_date")


@query(f"""WITH {VOTES} SELECT doc_id, condition, {", ".join(f"max(CASE WHEN field = '{f}' THEN nullif(canon, '(none)') END) AS {f}" for f in _VOTED)} FROM m GROUP BY doc_id, condition""")
def majority_votes(spark, sf_dir):
    """canonical values of the voted extraction."""
    votes = stability.majority_votes(fixtures.runs(spark, sf_dir).drop("k"))
    shown = []
    for f in _VOTED:
        c = stability.canonical_value(f, F.col(f"majority.{f}"))
        shown.append((c.cast("bigint") if f in AMOUNT_FIELDS else c).cast("string").alias(f))
    return votes.select("doc_id", "condition", *shown)


@query(f"WITH {VOTES}, {SUMMARY} SELECT doc_id, condition, {N_RUNS}::BIGINT AS n_runs, round(single, 6) AS single, round(majority, 6) AS majority FROM sd JOIN md USING (doc_id, condition)")
def single_vs_majority(spark, sf_dir):
    """F8."""
    return _rounded(stability.single_vs_majority(fixtures.truth(spark, sf_dir), fixtures.runs(spark, sf_dir).drop("k")))


@query(f"WITH {VOTES}, {SUMMARY} SELECT condition, round(avg(single), 6) AS single, round(avg(majority), 6) AS majority, round(avg(majority) - avg(single), 6) AS delta, count(*) AS n_docs FROM sd JOIN md USING (doc_id, condition) GROUP BY condition")
def condition_summary(spark, sf_dir):
    """F9, F10."""
    return _rounded(stability.condition_summary(fixtures.truth(spark, sf_dir), fixtures.runs(spark, sf_dir).drop("k")))


@query(f"WITH {BASE} SELECT doc_id FROM t WHERE k % 7 = 0")
def results_without_truth(spark, sf_dir):
    """F8: the documents of results for which there is no truth."""
    truth = fixtures.truth(spark, sf_dir).where(F.col("k") % 7 != 0)
    return stability.without_truth(truth, fixtures.runs(spark, sf_dir))


# ---------------------------------------------------------------- G: routing


def _policy(spark, sf_dir):
    fields = metrics.per_field(_scored(spark, sf_dir))
    return routing.build_policy(fields, stability.flip_rates(fixtures.runs(spark, sf_dir).drop("k")))


@query(f"WITH {POLICY} SELECT * FROM po")
def routing_policy(spark, sf_dir):
    """G1, G2."""
    return _rounded(_policy(spark, sf_dir))


@query(f"WITH {POLICY}, c(class) AS (VALUES ('auto_post'), ('review'), ('always_human')) SELECT c.class, count(po.class) AS n FROM c LEFT JOIN po ON c.class = po.class GROUP BY c.class")
def routing_counts(spark, sf_dir):
    """G3."""
    return routing.class_counts(_policy(spark, sf_dir))


@query(f"WITH {POLICY} SELECT field, round(accuracy, 3) AS accuracy, round(flip_rate, 3) AS flip_rate, round(flip_rate_temp_0, 3) AS flip_rate_temp_0, round(flip_rate_temp_default, 3) AS flip_rate_temp_default, class FROM po")
def report_routing_table(spark, sf_dir):
    """The routing table, rounded; A9: as it is read back from the written policy."""
    policy = _policy(spark, sf_dir)
    path = scratch(spark, "policy")
    io.write_report(routing.policy_document(_rounded(policy)), path)
    back = spark.read.json(path).select(F.explode("fields").alias("f")).select("f.field", *[F.round(f"f.{c}", 3).alias(c) for c in ("accuracy", "flip_rate", "flip_rate_temp_0", "flip_rate_temp_default")], "f.class")
    return back


@query(f"""WITH {POLICY}, {SUMMARY}, one AS (SELECT *, {_TIER} AS tier FROM u WHERE condition = 'temp_0' AND r = 0)
SELECT 'headline' AS name, '' AS row, round(avg(ok::INT::DOUBLE), 3) AS value FROM one
UNION ALL SELECT 'per_field', field, round(avg(ok::INT::DOUBLE), 3) FROM one GROUP BY field
UNION ALL SELECT 'per_tier', tier, round(avg(ok::INT::DOUBLE), 3) FROM one GROUP BY tier
UNION ALL SELECT 'flips', condition || '|' || field, round(flip_rate, 3) FROM fl
UNION ALL SELECT 'majority', condition, round(avg(majority), 3) FROM sd JOIN md USING (doc_id, condition) GROUP BY condition
UNION ALL SELECT 'routing', field || '|' || class, round(flip_rate, 3) FROM po""")
def report_values(spark, sf_dir):
    """A value of each row of the report's six tables."""
    truth, runs, scored = fixtures.truth(spark, sf_dir), fixtures.runs(spark, sf_dir).drop("k"), _scored(spark, sf_dir)
    flips, fields = stability.flip_rates(runs), metrics.per_field(scored)
    return _values_of(routing.report_tables(metrics.headline(scored), fields, metrics.per_tier(scored), flips, stability.condition_summary(truth, runs), routing.build_policy(fields, flips)))


def _values_of(tables: dict[str, DataFrame]) -> DataFrame:
    """name, row, value: a value of each row of the report's tables."""
    shown = {
        "headline": (F.lit(""), "accuracy"), "per_field": (F.col("field"), "accuracy"), "per_tier": (F.col("difficulty_tier"), "accuracy"),
        "flips": (F.concat_ws("|", "condition", "field"), "flip_rate"), "majority": (F.col("condition"), "majority"), "routing": (F.concat_ws("|", "field", "class"), "flip_rate"),
    }
    rows = [tables[name].select(F.lit(name).alias("name"), row.alias("row"), F.col(value).alias("value")) for name, (row, value) in shown.items()]
    out = rows[0]
    for more in rows[1:]:
        out = out.union(more)
    return out


@query(SQL["report_values"])
def report_values_of_state(spark, sf_dir):
    """The report of a state that three batches of documents were merged into, one of them twice, and that was made compact after the second."""
    path = scratch(spark, "state")
    truth, runs, pairs = fixtures.truth(spark, sf_dir), fixtures.runs(spark, sf_dir), fixtures.pairs(spark, sf_dir)
    for batch in (0, 1, 1, 2):
        part = F.col("k") % 3 == batch
        cells = state.add(state.accuracy_cells(pairs.where(part)), state.stability_cells(truth.where(part), runs.where(part).drop("k")))
        if state.save(cells, path, f"b{batch}") and batch == 1:
            state.compact(spark, path, "b0-b1")
    return _values_of(state.report_tables(state.load(spark, path)))


@query(f"WITH {VOTES}, {FLIPS} SELECT condition, field, round(flip_rate, 3) AS flip_rate, n_docs FROM fl")
def stability_report(spark, sf_dir):
    """The flip table of the written stability report, read back."""
    truth, runs = fixtures.truth(spark, sf_dir), fixtures.runs(spark, sf_dir).drop("k")
    path = scratch(spark, "stability")
    io.write_report(io.stability_report(stability.condition_summary(truth, runs), stability.flip_rates(runs)), path)
    return _rounded(io.load_stability(spark, path)[1], 3)


@query(f"WITH {LONG}, {_PF}, {_CALLS.strip()} SELECT (SELECT count(*) FROM s) AS n_docs, (SELECT round(avg(aggregate_accuracy), 6) FROM s) AS headline, round(min(accuracy), 6) AS min_field, round(max(accuracy), 6) AS max_field, (SELECT {_usd("sum(cost)")} FROM co) AS spend_usd, round(sum(accuracy), 6) AS field_sum FROM pf")
def run_summary(spark, sf_dir):
    """The summary of a run, read back."""
    scored = _scored(spark, sf_dir)
    total = usage.with_cost(fixtures.calls(spark, sf_dir)).agg(F.sum("cost").alias("cost"))
    path = scratch(spark, "summary")
    io.write_report(io.run_summary(metrics.headline(scored), metrics.per_field(scored), total), path)
    back = spark.read.schema("n_docs bigint, headline double, min_field double, max_field double, spend_usd double, per_field map<string,double>").json(path)
    return _rounded(back.select("n_docs", "headline", "min_field", "max_field", "spend_usd", F.aggregate(F.map_values("per_field"), F.lit(0.0), lambda a, x: a + x).alias("field_sum")))


# ---------------------------------------------------------------- H, B: work lists, choices


def _docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat(F.lit("doc_"), F.col("o_orderkey")).alias("doc_id"), F.col("o_orderkey").alias("k"))


def _done(spark, sf_dir):
    """Finished runs: all but some, and some twice. k is read from the doc_id: a join for it would be planned by the file's size,
    and orders of few MB are broadcast as millions of strings."""
    work = worklist.expand(_docs(spark, sf_dir)).withColumn("k", F.expr("cast(substring(doc_id, 5) as bigint)"))
    kept = work.where((F.col("k") + F.col("run_index")) % 7 != 0)
    return kept.union(kept.where(F.col("k") % 50 == 0)).drop("k")


_WORK = f"w AS (SELECT 'doc_' || o_orderkey AS doc_id, o_orderkey AS k, condition, r::INT AS run_index, 'doc_' || o_orderkey || '|' || condition || '|' || r AS key FROM orders, (VALUES ('temp_0'), ('temp_default')) AS c(condition), range({N_RUNS}) AS x(r))"


@query(f"WITH {_WORK} SELECT doc_id, condition, run_index, key FROM w WHERE (k + run_index) % 7 = 0")
def remaining_work(spark, sf_dir):
    """H1, H2."""
    return worklist.remaining_runs(_docs(spark, sf_dir), worklist.finished(_done(spark, sf_dir)))


@query(f"WITH {_WORK} SELECT doc_id, condition, count(*) AS done, {N_RUNS} AS expected, count(*) >= {N_RUNS} AS complete FROM w WHERE (k + run_index) % 7 <> 0 GROUP BY doc_id, condition")
def run_coverage(spark, sf_dir):
    """H3."""
    return worklist.coverage(worklist.finished(_done(spark, sf_dir)))


@query(f"WITH {_WORK} SELECT key FROM w WHERE (k + run_index) % 7 <> 0")
def completed_keys(spark, sf_dir):
    """H3."""
    return worklist.completed(_done(spark, sf_dir))


_RESULT = f"""WITH {BASE}, {_RUN_ROWS} SELECT doc_id, condition, r::INT AS run_index, doc_id || '|' || condition || '|' || r AS key,
  CASE WHEN {BLANK} THEN 0 ELSE CASE {variant("loss_history")} WHEN 0 THEN greatest(n_losses - 1, 0) WHEN 1 THEN n_losses + least(n_losses, 1) WHEN 3 THEN 0 ELSE n_losses END END::INT AS n_losses,
  ({_canon_sql("year_built")})::INT AS year_built, trim({_canon_sql("industry_code_type")}) AS industry_code_type FROM rr"""


def _results(spark, sf_dir):
    """Runs as the log has them: typed where the raw value is plain."""
    return _typed_runs(fixtures.runs(spark, sf_dir))


def _typed_runs(runs: DataFrame) -> DataFrame:
    pred = F.col("pred")
    cells = []
    for f in EXTRACTION.names:
        if f == "loss_history":
            cells.append(F.transform(pred[f], lambda e: F.struct(e["date"].cast("date").alias("date"), e["cause"].alias("cause"), e["paid_amount"].cast("double").alias("paid_amount"), e["status"].alias("status"))).alias(f))
        elif f in DATE_FIELDS:
            cells.append(N.date_iso(pred[f]).cast("date").alias(f))
        elif f in AMOUNT_FIELDS:
            cells.append(N.normalize_amount(pred[f]).alias(f))
        elif f == "year_built":
            cells.append(N.normalize_int(pred[f]).cast("int").alias(f))
        else:
            cells.append((N.code_type(pred[f]) if f == "industry_code_type" else pred[f]).alias(f))
    return runs.select(worklist.run_key().alias("key"), "doc_id", "condition", "run_index", F.struct(*cells).alias("extraction"))


def _shown(results: DataFrame) -> DataFrame:
    return results.select("doc_id", "condition", "run_index", "key", F.size("extraction.loss_history").alias("n_losses"), "extraction.year_built", "extraction.industry_code_type")


@query(_RESULT.replace("SELECT doc_id, condition, r::INT AS run_index, doc_id || '|' || condition || '|' || r AS key,", "SELECT doc_id,") + " WHERE c = 0 AND r = 0")
def stored_predictions(spark, sf_dir):
    """One run's predictions as JSON lines, read back."""
    path = scratch(spark, "predictions")
    io.write_predictions(worklist.of_condition(_results(spark, sf_dir)), path, "gzip")
    back = spark.read.schema(T.StructType([T.StructField("doc_id", T.StringType()), *EXTRACTION.fields])).json(path)
    return back.select("doc_id", F.size("loss_history").alias("n_losses"), "year_built", "industry_code_type")


@query(_RESULT)
def result_log(spark, sf_dir):
    """Results appended as JSON lines in two parts, the second without what is done, and read back."""
    path, rows = scratch(spark, "results"), _results(spark, sf_dir)
    io.append_results(rows.where("run_index < 3"), path, "gzip")
    io.append_results(worklist.remaining(rows, io.load_results(spark, path)), path, "gzip")
    return _shown(io.load_results(spark, path))


#: Packed files of the log in a batch of the stream: some millions of rows, which are kept while the sink is searched for them.
BATCH_FILES = 16


@query(_RESULT)
def streamed_results(spark, sf_dir):
    """H4: the log, in which some rows repeat, as the stream stores it; the stream is stopped and started again."""
    log, sink, state = scratch(spark, "log"), scratch(spark, "sink"), scratch(spark, "state")
    rows = _results(spark, sf_dir)
    io.append_results(rows.where("run_index < 4"), log, "gzip")
    ingest.ingest(spark, log, sink, state, BATCH_FILES).awaitTermination()
    ingest.results_sink(spark, sink).vacuum()
    io.append_results(rows.where("run_index >= 3"), log, "gzip")
    ingest.ingest(spark, log, sink, state, BATCH_FILES).awaitTermination()
    ingest.results_sink(spark, sink).vacuum()
    return _shown(ingest.stored(spark, sink))


@query(f"""WITH {BASE}, {_RUN_ROWS}, w AS (SELECT * FROM rr WHERE r = 0 AND ((k % 3 <> 0 AND c = 1) OR (k % 3 = 0 AND k % 2 = 0 AND c = 0)))
SELECT doc_id, {_canon_sql("industry_code")} AS industry_code, ({_canon_sql("year_built")})::BIGINT AS year_built FROM w""")
def fallback_predictions(spark, sf_dir):
    """Single-pass predictions for two documents of three, run results for half of the others."""
    runs = fixtures.runs(spark, sf_dir)
    single = runs.where((F.col("condition") == "temp_default") & (F.col("run_index") == 0) & (F.col("k") % 3 != 0)).select("doc_id", "pred")
    other = runs.where((F.col("k") % 3 != 0) | (F.col("k") % 2 == 0)).drop("k")
    chosen = worklist.with_fallback(fixtures.truth(spark, sf_dir).select("doc_id"), single, other)
    return chosen.select("doc_id", N.normalize_code("pred.industry_code").alias("industry_code"), N.normalize_int("pred.year_built").alias("year_built"))


@query("""WITH p AS (SELECT conv_id, turn, role, CASE WHEN conv_id % 5 = 0 THEN '   ' ELSE text END AS text FROM conversations)
SELECT conv_id, turn, role, sha256('Extract fields from the following submission document text.' || chr(10) || chr(10) || '----- BEGIN DOCUMENT -----' || chr(10)
  || CASE WHEN trim(text) = '' THEN '[Document appears to be a scanned/image PDF with no extractable text layer. Return all fields as null and loss_history as [].]' ELSE text END || chr(10) || '----- END DOCUMENT -----' || chr(10)) AS prompt FROM p""")
def prompts(spark, sf_dir):
    """B8."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    text = F.when(F.col("conv_id") % 5 == 0, "   ").otherwise(F.col("text"))
    return rows.select("conv_id", "turn", "role", F.sha2(worklist.prompt(text), 256).alias("prompt"))


@query("SELECT 'doc_' || o_orderkey AS doc_id FROM orders ORDER BY 'doc_' || o_orderkey LIMIT 50")
def first_documents(spark, sf_dir):
    """The limit is the feature."""
    return worklist.first_documents(_docs(spark, sf_dir).select("doc_id"), 50)


_JSON_OK = "k % 10 NOT IN (3, 5, 6, 7, 8, 9)"


@query(f"""WITH {BASE}, {_ONE_ROW}
SELECT doc_id, {_JSON_OK} AS valid, CASE k % 10 WHEN 3 THEN 'unknown keys: extra' WHEN 5 THEN 'wrong values: effective_date' WHEN 6 THEN 'wrong values: industry_code_type' WHEN 7 THEN 'no JSON object' WHEN 8 THEN 'wrong values: loss_history' WHEN 9 THEN 'wrong values: year_built' END AS error,
  CASE WHEN {_JSON_OK} THEN CASE WHEN k % 10 = 1 THEN NULL ELSE named_insured END END AS named_insured, CASE WHEN {_JSON_OK} THEN year_built::INT END AS year_built,
  CASE WHEN {_JSON_OK} THEN deductible::DOUBLE END AS deductible, CASE WHEN {_JSON_OK} THEN CASE WHEN k % 10 = 2 THEN 0 ELSE n_losses END::INT END AS n_losses FROM rr""")
def validated_outputs(spark, sf_dir):
    """Model outputs in fences, with empty strings, missing histories, odd events, unknown keys and wrong values."""
    out = validate.validate(_outputs(spark, sf_dir))
    return out.select("doc_id", "valid", "error", "extraction.named_insured", "extraction.year_built", "extraction.deductible", F.when(F.col("valid"), F.size("extraction.loss_history")).alias("n_losses"))


def _outputs(spark, sf_dir):
    base, n = fixtures.base(spark, sf_dir), F.col("k") % 10
    event = "named_struct('date', e.date, 'cause', e.cause, 'paid_amount', cast(e.paid_amount as double), 'status', if(k % 10 = 4, '', e.status))"
    fields = ", ".join(f"{f if f not in ('effective_date', 'named_insured', 'industry_code_type', 'year_built') else {'effective_date': 'if(k % 10 = 5, date_format(effective_date, ' + repr('MM/dd/yyyy') + '), cast(effective_date as string))', 'named_insured': 'if(k % 10 = 1, ' + repr('') + ', named_insured)', 'industry_code_type': 'if(k % 10 = 6, ' + repr('ISO') + ', industry_code_type)', 'year_built': 'if(k % 10 = 9, year_built + 0.5, cast(year_built as double))'}[f]} as {f}" for f in EXTRACTION.names if f != "loss_history")
    odd = F.expr("if(k % 10 = 8, '{\"when\":1}', null)")
    body = F.to_json(F.expr(f"struct({fields}, if(k % 10 = 3, 1, null) as extra)"))
    losses = F.to_json(F.expr(f"transform(losses, e -> {event})"))
    losses = F.when(n == 2, "null").when(n == 8, F.concat(F.lit("["), odd, F.lit("]"))).when(n == 4, F.regexp_replace(losses, r"\A\[", '["none", ')).otherwise(losses)
    losses = F.regexp_replace(losses, r", \]", "]")
    text = F.concat(F.regexp_replace(body, r"\}\z", ""), F.lit(',"loss_history":'), losses, F.lit("}"))
    text = F.when(n == 0, F.concat(F.lit("Here it is:\n```json\n"), text, F.lit("\n```\nDone."))).when(n == 7, "I cannot read this.").otherwise(F.concat(F.lit("  "), text, F.lit("\n")))
    return base.select("doc_id", text.alias("text"))


def _observed(counts: dict[str, int], name: str) -> F.Column:
    """The observed number of rows of the kind in column name."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in counts.items() for x in kv]), F.col(name)).cast("bigint")


@query(f"""WITH {BASE}, {_ONE_ROW}, w AS (SELECT doc_id, k, n_losses, year_built, CASE k % 10 WHEN 3 THEN 'unknown keys' WHEN 5 THEN 'wrong effective_date' WHEN 6 THEN 'wrong industry_code_type' WHEN 7 THEN 'no JSON object' WHEN 8 THEN 'wrong loss_history' WHEN 9 THEN 'wrong year_built' ELSE 'good' END AS kind FROM rr)
SELECT doc_id, kind, count(*) OVER (PARTITION BY kind) AS observed, CASE WHEN kind = 'good' THEN year_built::INT END AS year_built,
  CASE WHEN kind = 'good' THEN CASE WHEN k % 10 = 2 THEN 0 ELSE n_losses END::INT END AS n_losses, CASE WHEN kind = 'no JSON object' THEN 'I cannot read this.' END AS unread, CASE WHEN kind <> 'good' THEN true END AS kept_text FROM w""")
def quarantined_outputs(spark, sf_dir):
    """Both tables of model outputs, read back, with what the observation of the one pass has counted of each kind."""
    found = validate.sort_out(_outputs(spark, sf_dir), scratch(spark, "outputs"))
    none = lambda t: F.lit(None).cast(t)
    good = found.good.select("doc_id", F.lit("good").alias("kind"), "extraction.year_built", F.size("extraction.loss_history").alias("n_losses"), none("string").alias("unread"), none("boolean").alias("kept_text"))
    bad = found.bad.select("doc_id", F.element_at("reasons", 1).alias("kind"), none("int").alias("year_built"), none("int").alias("n_losses"), F.when(F.array_contains("reasons", "no JSON object"), F.col("text")).alias("unread"), F.length("text") > 0)
    return good.union(bad).withColumn("observed", _observed(found.counts, "kind"))


@query("""WITH cl AS (SELECT event_id AS call_id, event_type AS provider, CASE WHEN event_id % 29 = 0 THEN 'no cost' WHEN event_id % 23 = 0 THEN 'negative cost' ELSE 'good' END AS kind FROM events)
SELECT call_id, provider, kind, count(*) OVER (PARTITION BY kind) AS observed FROM cl""")
def quarantined_calls(spark, sf_dir):
    """Calls without a cost or with a negative one, stored apart."""
    calls, one = usage.with_cost(fixtures.calls(spark, sf_dir)), F.lit("0.0000000001").cast("decimal(20,10)")
    cost = F.when(F.col("call_id") % 29 == 0, None).when(F.col("call_id") % 23 == 0, -F.col("cost") - one).otherwise(F.col("cost"))
    found = usage.sort_out_calls(calls.withColumn("cost", cost), scratch(spark, "calls"))
    rows = found.good.select("call_id", "provider", F.lit("good").alias("kind")).union(found.bad.select("call_id", "provider", F.element_at("reasons", 1)))
    return rows.withColumn("observed", _observed(found.counts, "kind"))


# ---------------------------------------------------------------- J: form text


_FORM_COLUMNS = "named_insured, mailing_address, business_description, effective_date, expiration_date, industry_code, industry_code_type, per_occurrence_limit::DOUBLE AS per_occurrence_limit, aggregate_limit::DOUBLE AS aggregate_limit, deductible::DOUBLE AS deductible, building_value::DOUBLE AS building_value, contents_value::DOUBLE AS contents_value, year_built::INT AS year_built, construction_type"


@query(f"""WITH {BASE}, a AS (SELECT l_orderkey, sum(floor(l_extendedprice / 25000) * 25000) AS loss_sum, count(*) FILTER (l_linestatus = 'O') AS n_open FROM lineitem GROUP BY l_orderkey)
SELECT doc_id, {_FORM_COLUMNS}, n_losses::INT AS n_losses, coalesce(loss_sum, 0)::DOUBLE AS loss_sum, coalesce(n_open, 0)::INT AS n_open FROM t LEFT JOIN a ON k = l_orderkey""")
def parsed_forms(spark, sf_dir):
    """Form text gives the truth back."""
    forms = fixtures.form_text(spark, sf_dir).select("doc_id", formtext.parse_form(F.col("text")).alias("x"))
    losses = F.col("x.loss_history")
    scalars = [F.col(f"x.{f}") for f in EXTRACTION.names if f != "loss_history"]
    return forms.select("doc_id", *scalars, F.size(losses).alias("n_losses"), F.aggregate(losses, F.lit(0.0), lambda a, e: a + e["paid_amount"]).alias("loss_sum"), F.size(F.filter(losses, lambda e: e["status"] == "Open")).alias("n_open"))


# ---------------------------------------------------------------- I: usage


@query("SELECT conv_id, turn, role, greatest(length(text) // 4, 1)::BIGINT AS tokens FROM conversations")
def token_estimates(spark, sf_dir):
    """I1."""
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", usage.token_estimate("text").alias("tokens"))


@query(f"WITH {_CALLS} SELECT call_id, model, cost::DOUBLE / 1e8::DOUBLE AS cost FROM co")
def call_costs(spark, sf_dir):
    """I2."""
    return _rounded(usage.with_cost(fixtures.calls(spark, sf_dir)).select("call_id", "model", "cost"), 9)


@query(f"WITH {_CALLS} SELECT provider, model, (grouping(provider) * 2 + grouping(model))::INT AS level, {_usd("sum(cost)")} AS cost, count(*) AS n_calls FROM co GROUP BY ROLLUP (provider, model)")
def spend_totals(spark, sf_dir):
    """I3."""
    return _rounded(usage.spend(usage.with_cost(fixtures.calls(spark, sf_dir))))


def _audit_sql(part: str, cap: float) -> str:
    units = round(cap * 10**8)
    return f"""WITH {_CALLS}, q AS (SELECT call_id, run_id, cost, sum(cost) OVER ({part} ORDER BY ts, call_id) AS running FROM co)
SELECT call_id, run_id, {_usd("running")} AS running, CASE WHEN running <= {units} THEN 'charged' WHEN running - cost <= {units} THEN 'tripped' ELSE 'skipped' END AS status FROM q"""


def _audit(spark, sf_dir, cap, run):
    calls = usage.with_cost(fixtures.calls(spark, sf_dir))
    return _rounded(usage.spend_audit(calls, cap, ["ts", "call_id"], run).select("call_id", "run_id", "running", "status"))


@query(_audit_sql("PARTITION BY run_id", 1.2345))
def spend_audit_by_run(spark, sf_dir):
    """I4: a cap for each run."""
    return _audit(spark, sf_dir, 1.2345, "run_id")


@query(_audit_sql("", 9.8765))
def spend_audit_all(spark, sf_dir):
    """I4: one cap over all calls in their order, by two-level prefix sums."""
    return _audit(spark, sf_dir, 9.8765, None)


def _continued(spark, sf_dir, cap, run):
    """The audit in three parts of the time, each with the totals that the one before has saved."""
    calls = usage.with_cost(fixtures.calls(spark, sf_dir))
    low, high = calls.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    third = F.least(F.floor((F.unix_micros("ts") - low) * 3 / F.lit(high - low + 1)), F.lit(2))
    carry, done = None, None
    for i in range(3):
        part = calls.where(third == i)
        audited = usage.spend_audit(part, cap, ["ts", "call_id"], run, carry).select("call_id", "run_id", "running", "status")
        path = scratch(spark, "totals")
        usage.totals_after(part, run, carry=carry).write.parquet(path)
        carry, done = spark.read.parquet(path), audited if done is None else done.unionByName(audited)
    return _rounded(done)


@query(_audit_sql("PARTITION BY run_id", 1.2345))
def spend_audit_continued_by_run(spark, sf_dir):
    """I4: as spend_audit_by_run, but continued over three days from saved totals."""
    return _continued(spark, sf_dir, 1.2345, "run_id")


@query(_audit_sql("", 9.8765))
def spend_audit_continued(spark, sf_dir):
    """I4: as spend_audit_all, but continued over three days from saved totals."""
    return _continued(spark, sf_dir, 9.8765, None)


@query(f"""WITH {_CALLS} SELECT call_id, provider, n AS in_window, n > 2 AS over FROM (
  SELECT call_id, provider, count(*) OVER (PARTITION BY provider ORDER BY ts RANGE BETWEEN INTERVAL 59999999 MICROSECONDS PRECEDING AND CURRENT ROW) AS n FROM cl)""")
def rate_audit(spark, sf_dir):
    """I5."""
    return usage.rate_audit(fixtures.calls(spark, sf_dir), rpm=2).select("call_id", "provider", "in_window", "over")


# ---------------------------------------------------------------- A: corpora of small files


def _save_files(rows: DataFrame, root: str) -> None:
    """Writes each row's content (bytes) under its path below root, in tasks."""

    def save(batches):
        fs, base = pafs.FileSystem.from_uri(root)
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs.create_dir(f"{base}/{path}".rsplit("/", 1)[0], recursive=True)
                with fs.open_output_stream(f"{base}/{path}", compression=None) as f:
                    f.write(content)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    rows.select("path", F.col("content").cast("binary")).mapInArrow(save, "n long").write.format("noop").mode("overwrite").save()


@query("""SELECT 'c' || c_custkey AS doc_id, c_name AS named_insured, c_custkey % 5 AS seed, n_name AS manifest_name, CASE WHEN c_custkey % 4 <> 0 THEN 1900 + c_nationkey END::INT AS year_built
FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 3 <> 0""")
def corpus_files(spark, sf_dir):
    """A1-A4: a corpus of one record and, for two of three, one PDF a folder; predictions by file name; a manifest as one array."""
    root = scratch(spark, "corpus")
    people = spark.read.parquet(f"{sf_dir}/customer.parquet").withColumn("id", F.concat(F.lit("c"), F.col("c_custkey")))
    record = F.to_json(F.struct(F.col("id").alias("doc_id"), F.lit(TIERS[0]).alias("difficulty_tier"), (F.col("c_custkey") % 5).alias("seed"), F.struct(F.col("c_name").alias("named_insured")).alias("extraction")), {"pretty": "true"})
    predicted = F.to_json(F.struct((F.lit(1900) + F.col("c_nationkey")).alias("year_built")), {"pretty": "true"})
    records = people.select(F.concat(F.lit("docs/"), "id", F.lit("/ground_truth.json")).alias("path"), record.alias("content"))
    pdfs = people.where("c_custkey % 3 <> 0").select(F.concat(F.lit("docs/"), "id", F.lit("/document.pdf")).alias("path"), F.lit("%PDF-1.4").alias("content"))
    preds = people.where("c_custkey % 4 <> 0").select(F.concat(F.lit("predictions/"), "id", F.lit(".json")).alias("path"), predicted.alias("content"))
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.to_json(F.collect_list(F.struct("n_nationkey", "n_name")), {"pretty": "true"}).alias("content"))
    _save_files(records.union(pdfs).union(preds).union(nations.select(F.lit("manifest.json").alias("path"), "content")), root)
    truth = io.load_truth(spark, f"{root}/docs", in_order=False, in_tasks=True)
    found = io.load_predictions(spark, f"{root}/predictions", in_tasks=True).withColumnRenamed("extraction", "pred")
    manifest = io.load_manifest(spark, f"{root}/manifest.json", "n_nationkey int, n_name string")
    nation = people.select(F.col("id").alias("doc_id"), "c_nationkey")
    joined = truth.join(found.hint("merge"), "doc_id", "left").join(nation.hint("merge"), "doc_id").join(F.broadcast(manifest), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select("doc_id", "extraction.named_insured", "seed", F.col("n_name").alias("manifest_name"), "pred.year_built")
