import pytest
from pyspark.sql import functions as F

from assaykit.operators import metrics, routing, scoring, stability, usage, worklist
from assaykit.sources.schemas import ALL_FIELDS, RAW_EXTRACTION, TIERS

RECORD = {
    "named_insured": "Acme Storage and Freight LLC", "mailing_address": "12 Main St., Springfield", "effective_date": "2024-05-06", "expiration_date": "2025-05-06", "industry_code": "493110",
    "industry_code_type": "NAICS", "business_description": "General warehousing", "per_occurrence_limit": "1000000", "aggregate_limit": "2000000", "deductible": "2500", "building_value": "5",
    "contents_value": "6", "year_built": "1984", "construction_type": "Joisted Masonry", "loss_history": [{"date": "2020-01-02", "cause": "Fire", "paid_amount": "10", "status": "Closed"}],
}
BLANK = {f: None for f in RECORD} | {"loss_history": []}


def frame(spark, rows):
    """rows: (id, truth, pred)."""
    kind = RAW_EXTRACTION.simpleString()
    order = RAW_EXTRACTION.names
    as_row = lambda d: tuple([tuple(e[k] for k in ("date", "cause", "paid_amount", "status")) for e in d[f]] if f == "loss_history" and d[f] is not None else d[f] for f in order)
    return spark.createDataFrame([(i, TIERS[0], as_row(t), as_row(p)) for i, t, p in rows], f"doc_id string, difficulty_tier string, truth {kind}, pred {kind}")


def test_scores(spark):
    same = RECORD | {"effective_date": "05/06/2024", "mailing_address": "12 MAIN ST SPRINGFIELD", "loss_history": [RECORD["loss_history"][0] | {"status": None}]}
    got = {r.doc_id: r for r in scoring.score_pairs(frame(spark, [("self", RECORD, RECORD), ("blank", RECORD, BLANK), ("odd", RECORD, same), ("unclear", same, same)])).collect()}
    assert got["self"].aggregate_accuracy == got["unclear"].aggregate_accuracy == 1.0
    assert got["blank"].aggregate_accuracy == 0.0 and got["blank"].loss.precision == 1.0 and got["blank"].loss.recall == 0.0
    assert not got["odd"].ok_effective_date and got["odd"].ok_mailing_address and got["odd"].ok_loss_history


def test_details(spark):
    """What is compared of exact fields, the overlap of texts, the counts of losses."""
    pred = RECORD | {"effective_date": "05/06/2024", "deductible": "$2,500", "contents_value": None, "year_built": "1985", "named_insured": "Acme Storage LLC", "loss_history": []}
    rows = scoring.field_details(frame(spark, [("a", RECORD, pred)]), ["doc_id"]).collect()
    got = {r.field: (r.correct, r.detail) for r in rows}
    assert set(got) == {*ALL_FIELDS} and len(rows) == len(ALL_FIELDS)
    assert got["effective_date"] == (False, "truth=2024-05-06 pred=__ambiguous__|05/06/2024")
    assert got["deductible"] == (True, "truth=2500.0 pred=2500.0") and got["contents_value"] == (False, "truth=6.0 pred=null")
    assert got["year_built"] == (False, "truth=1984 pred=1985") and got["construction_type"] == (True, "truth=joisted masonry pred=joisted masonry")
    assert got["named_insured"] == (False, "overlap=0.600 threshold=0.8") and got["mailing_address"] == (True, "overlap=1.000 threshold=0.8")
    assert got["loss_history"] == (False, "tp=0 fp=0 fn=1")


LOSSES = [(2, 1, (1.0, 0.5, 0, 1)), (2, 3, (2 / 3, 1.0, 1, 0)), (0, 0, (1.0, 1.0, 0, 0))]


@pytest.mark.parametrize(("n", "m", "want"), LOSSES)
def test_losses(spark, n, m, want):
    event = lambda i: {"date": f"2020-01-0{i + 1}", "cause": "Fire", "paid_amount": "5", "status": None}
    pairs = frame(spark, [("a", RECORD | {"loss_history": [event(i) for i in range(n)]}, RECORD | {"loss_history": [event(i) for i in range(m)]})])
    in_row = pairs.select(scoring.loss_score(F.col("truth.loss_history"), F.col("pred.loss_history")).alias("l")).select("l.*").first()
    assert (in_row.precision, in_row.recall, in_row.false_positives, in_row.false_negatives) == want
    assert tuple(scoring.loss_scores_grouped(pairs, "doc_id").drop("doc_id").first()) == tuple(in_row)


def test_repeated_and_disjoint_losses(spark):
    e, other = RECORD["loss_history"][0], RECORD["loss_history"][0] | {"cause": "Hail"}
    rows = frame(spark, [("twice", RECORD | {"loss_history": [e, e]}, RECORD | {"loss_history": [e]}), ("none", RECORD, RECORD | {"loss_history": [other]}), ("null", RECORD | {"loss_history": None}, BLANK)])
    got = {r.doc_id: r.l for r in rows.select("doc_id", scoring.loss_score(F.col("truth.loss_history"), F.col("pred.loss_history")).alias("l")).collect()}
    assert (got["twice"].false_negatives, got["twice"].recall) == (1, 0.5)
    assert (got["none"].precision, got["none"].recall, got["none"].f1) == (0.0, 0.0, 1.0)
    assert got["null"].exact_set_match


def test_rollups(spark):
    scored = scoring.score_pairs(frame(spark, [("a", RECORD, RECORD), ("a", RECORD, BLANK)]))
    head = metrics.headline(scored).first()
    assert head.n_docs == 2 and head.min_field <= head.accuracy == 0.5 <= head.max_field
    empty = metrics.headline(scored.limit(0)).first()
    assert (empty.accuracy, empty.n_docs) == (0.0, 0)
    assert metrics.self_check(frame(spark, [("a", RECORD, BLANK)])).count() == 0


def test_published_arithmetic(spark):
    """Correct answers of 50 by field, and the headline they give."""
    right = {f: 40 for f in ALL_FIELDS} | {"deductible": 30, "named_insured": 30, "year_built": 30, "loss_history": 43}
    flags = [F.col("i").__lt__(F.lit(n)).alias(f"ok_{f}") for f, n in right.items()]
    rows = spark.range(50).select(F.col("id").alias("i")).select("i", *flags)
    rows = rows.withColumn("aggregate_accuracy", sum((F.col(f"ok_{f}").cast("int") for f in ALL_FIELDS), F.lit(0)) / 15)
    head = metrics.headline(rows).first()
    assert round(head.accuracy, 3) == 0.764 and (head.min_field, head.max_field) == (0.6, 0.86)


def runs(spark, years):
    df = frame(spark, [(str(i), RECORD, RECORD | {"year_built": y}) for i, y in enumerate(years)])
    return df.select(F.lit("d").alias("doc_id"), F.lit("temp_0").alias("condition"), F.col("doc_id").cast("int").alias("run_index"), "pred")


VOTES = [(["1984", "1985", "1984"], "1984"), (["1985", "1984"], "1985"), (["1984.0", "1985", "1984"], "1984.0"), ([None, None, "1984"], None), ([None, "1984"], None), (["1984"], "1984")]


@pytest.mark.parametrize(("years", "want"), VOTES)
def test_majority(spark, years, want):
    assert stability.majority_votes(runs(spark, years)).first().majority.year_built == want


def test_flips(spark):
    flips = lambda years: {r.field: r.flip_rate for r in stability.flip_rates(runs(spark, years), len(years)).collect()}
    assert flips(["1984", "1984.0"])["year_built"] == 0.0 and flips([None, None])["year_built"] == 0.0
    assert flips(["1984", None])["year_built"] == 1.0 and flips(["1984", None])["named_insured"] == 0.0
    assert stability.flip_rates(runs(spark, ["1984"]), 2).count() == 0


def test_classify(spark):
    rows = spark.createDataFrame([(0.99, 0.01), (0.70, 0.30), (0.90, 0.10), (0.95, 0.05), (0.80, 0.30), (0.70, 0.20)], "a double, f double")
    assert [r.c for r in rows.select(routing.classify("a", "f").alias("c")).collect()] == ["auto_post", "always_human", "review", "auto_post", "review", "review"]


def test_cost_and_cap(spark):
    calls = spark.createDataFrame([(1, "gpt-4o-mini", 1_000_000, 0), (2, "x", 0, 1_000_000), (3, "gpt-4o", None, None)], "n int, model string, prompt_tokens long, completion_tokens long")
    assert {r.n: float(r.cost) for r in usage.with_cost(calls).collect()} == {1: 0.15, 2: 5.0, 3: 0.0}
    charges = spark.createDataFrame([(i, c) for i, c in enumerate([1.0, 1.25, -1.0, 0.5, 0.1])], "n int, cost double")
    assert {r.n: r.status for r in usage.spend_audit(charges, 2.25, ["n"]).collect()} == {0: "charged", 1: "charged", 2: "invalid", 3: "tripped", 4: "skipped"}


def test_running_total_beyond_the_range_sample(spark):
    calls = spark.range(0, 100_000, 1, 8).select("id", (F.col("id") * 48_271 % 100_003).alias("at"), (F.col("id") % 7).alias("cost"))
    want, total = {}, 0
    for r in sorted(calls.collect(), key=lambda r: r["at"]):
        want[r.id] = total = total + r.cost
    assert {r.id: r.running for r in usage.running_total(calls, ["at"], rows=1000).collect()} == want


def test_running_total_of_a_large_run(spark):
    run = F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 50 > 0, F.col("id") % 50)
    calls = spark.range(0, 30_000, 1, 8).select("id", run.alias("run"), (F.col("id") * 4_827 % 30_011).alias("at"), F.when(F.col("id") % 11 > 0, F.col("id") % 7).alias("cost"))
    want, totals = {}, {}
    for r in sorted(calls.collect(), key=lambda r: r["at"]):
        if r.cost is not None:
            totals[r.run] = totals.get(r.run, 0) + r.cost
        want[r.id] = totals.get(r.run)
    got = usage.running_total(calls, ["at"], "run", rows=1000)
    assert {r.id: r.running for r in got.collect()} == want
    assert "windowspecdefinition(run#" in (plan := got._jdf.queryExecution().optimizedPlan().toString())
    assert all("part#" in x.split("]")[0] for x in plan.split("windowspecdefinition(")[1:])  # no window over a whole run's calls


def test_rate_across_hours(spark):
    calls = spark.sql("select id, 'p' as provider, timestamp_seconds(3590 + id * 10) as ts from range(8)")
    assert [r.in_window for r in usage.rate_audit(calls, 5).orderBy("id").collect()] == [1, 2, 3, 4, 5, 6, 6, 6]


def test_resume(spark):
    work = worklist.expand(spark.createDataFrame([("a",), ("b",)], "doc_id string"))
    assert work.count() == 20 and worklist.remaining(work, work).count() == 0
    assert worklist.completed(work).first().key == "a|temp_0|0"
