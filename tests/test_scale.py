"""Plans that hold at size: what passes through the driver, what is shuffled, what is stored."""

import gzip

import pytest
from pyspark.sql import functions as F

from assaykit.functions import formtext
from assaykit.operators import stability, worklist
from assaykit.plans import fixtures
from assaykit.plans import queries as Q
from assaykit.sources import io
from assaykit.sources.schemas import RAW_EXTRACTION

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["completed_keys", "remaining_work", "run_coverage"])
def test_work_lists_are_not_broadcast(spark, name):
    """Orders are few bytes a row, so tables of documents looked small enough to broadcast."""
    assert "Broadcast" not in plan(Q.QUERIES[name](spark, SF))


RUNS = ["condition_summary", "flip_rates", "flip_rates_long", "flip_rates_of_complete", "majority_votes", "single_vs_majority", "routing_policy", "routing_counts", "results_without_truth", "fallback_predictions"]


@pytest.mark.parametrize("name", RUNS)
def test_runs_are_neither_stored_nor_shuffled(spark, name):
    """Documents' runs are ten times their rows: they stay in the buckets of the table that they are made of."""
    text = plan(Q.QUERIES[name](spark, SF))
    assert "derived_base" in text and "hashpartitioning(doc_id" not in text and "RoundRobin" not in text
    assert not any(name == "runs" for _, _, name in fixtures._kept)


def test_what_is_left_stays_in_its_buckets(spark):
    """The log's keys come to the work, a row for each document; the work is not shuffled. A null equals nothing."""
    rows = Q._results(spark, SF)
    left = worklist.remaining(rows, rows.where("run_index < 3").select("doc_id", "condition", F.col("run_index").cast("long").alias("run_index")))
    assert "SortMergeJoin" in plan(left) and "hashpartitioning(doc_id" not in plan(left)
    assert left.count() * 5 == rows.count() * 2
    work = spark.createDataFrame([("a", "c", 0, 1), ("a", None, 0, 2), (None, "c", 0, 3), ("a", "c", None, 4), ("a", "c", 0, 5), ("b", "c", 1, 6)], "doc_id string, condition string, run_index int, n int")
    assert sorted(r.n for r in worklist.remaining(work, work.where("n < 5")).collect()) == [2, 3, 4, 6]


@pytest.mark.parametrize(("name", "table"), [("result_log", "results"), ("stored_predictions", "predictions"), ("streamed_results", "log")])
def test_logs_are_packed(spark, tmp_path, monkeypatch, name, table):
    """Runs of a document stand beside each other and are packed together: a log takes a small part of its lines."""
    monkeypatch.setattr(Q, "scratch", lambda spark, name: f"file://{tmp_path}/{name}")
    Q.QUERIES[name](spark, SF)
    files = [*(tmp_path / table).glob("part-*")]
    lines = sum(len(gzip.open(f).read()) if f.suffix == ".gz" else f.stat().st_size for f in files)
    assert files and sum(f.stat().st_size for f in files) * 4 < lines


def test_forms_are_searched_once_for_each_layout(spark):
    text = spark.createDataFrame([("Deductible    5",)], "text string").select(formtext.label_value(F.col("text"), "Deductible").alias("v"), formtext.loss_rows(F.col("text")).alias("l"))
    found = text._jdf.queryExecution().optimizedPlan().toString().split(" AS ")
    assert [found[0].count(f"regexp_extract(text#{found[0].split('text#')[1].split(',')[0].split(')')[0]}, {layout.format(label='Deductible')}") for layout in formtext.LABEL_LAYOUTS] == [1, 1, 1]
    assert found[1].count("regexp_extract_all(") == 1
    assert text.first().v == "5"


def test_small_files_are_not_listed_by_the_driver(spark, tmp_path):
    """Both ways of listing give the same corpus; in tasks, the driver's plan holds no files."""
    def put(path, text):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)

    for i in ("a", "b", "deep/c", "_hidden/d"):
        put(f"docs/{i}/ground_truth.json", '{\n "doc_id": "%s", "seed": 1, "extraction": {"named_insured": "Ä", "effective_date": "2024-01-02", "loss_history": []}}' % i)
    for i in ("a", "deep/c", "_hidden/d"):
        put(f"docs/{i}/document.pdf", "%PDF-1.4")
    put("docs/b/notes.txt", "x")
    put("preds/a.json", '{"year_built": 1984}')
    put("preds/b.json", '[{"year_built": 1}, {"year_built": 2}]')
    put("preds/e.json", "")
    put("preds/f.txt", "{}")
    put("preds/sub/g.json", '{"year_built": 5}')
    docs, preds = f"file://{tmp_path}/docs", f"file://{tmp_path}/preds"
    for with_pdf in (True, False):
        slow, fast = (io.load_truth(spark, docs, with_pdf, in_tasks=t).drop("path") for t in (False, True))
        assert [tuple(r) for r in fast.collect()] == [tuple(r) for r in slow.collect()] and fast.count() == (2 if with_pdf else 3)
    slow, fast = (io.load_predictions(spark, preds, in_tasks=t) for t in (False, True))
    assert sorted(map(tuple, fast.collect())) == sorted(map(tuple, slow.collect()))
    assert fast.count() == 3


def test_a_corpus_passes_by_the_driver(spark):
    text = plan(Q.QUERIES["corpus_files"](spark, SF))
    assert "binaryFile" not in text and text.count("MapInArrow") >= 4 and "/docs" not in text
    assert text.count("BroadcastExchange") == 1  # the manifest


def test_zeros_agree(spark):
    """Runs that differ in the sign of a zero don't flip: sets of doubles tell the two apart."""
    kind = RAW_EXTRACTION.simpleString()
    rows = spark.createDataFrame([("d", "c", i, {"deductible": v}) for i, v in enumerate(["-0", "0"])], "doc_id string, condition string, run_index int, p map<string,string>")
    runs = rows.select("doc_id", "condition", "run_index", F.from_json(F.to_json("p"), kind).alias("pred"))
    for rates in (stability.flip_rates, stability.flips_long):
        assert {r.field: r.flip_rate for r in rates(runs, 2).collect()}["deductible"] == 0.0
