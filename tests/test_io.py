import json

from pyspark.sql import functions as F

from assaykit.functions import formtext
from assaykit.sources import io, validate
from assaykit.streaming import ingest


def test_corpus(spark, tmp_path):
    for i, pdf in (("a", True), ("b", False)):
        d = tmp_path / "corpus" / i
        d.mkdir(parents=True)
        (d / "ground_truth.json").write_text(json.dumps({"doc_id": i, "difficulty_tier": "scanned", "seed": 1, "extraction": {"named_insured": "X", "effective_date": "2024-01-02", "loss_history": []}}, indent=1))
        if pdf:
            (d / "document.pdf").write_bytes(b"%PDF")
    corpus = str(tmp_path / "corpus")
    assert [r.doc_id for r in io.load_truth(spark, corpus).collect()] == ["a"]
    assert [r.doc_id for r in io.load_truth(spark, corpus, with_pdf=False).collect()] == ["a", "b"]
    unordered = io.load_truth(spark, corpus, with_pdf=False, in_order=False)
    assert {r.doc_id for r in unordered.collect()} == {"a", "b"} and "Sort" not in unordered._jdf.queryExecution().optimizedPlan().toString()
    (tmp_path / "manifest.json").write_text('[{"doc_id": "a"}, {"doc_id": "b"}]')
    assert io.load_manifest(spark, str(tmp_path / "manifest.json"), "doc_id string").count() == 2
    preds = tmp_path / "preds"
    preds.mkdir()
    (preds / "doc_1.json").write_text('{"named_insured": "X",\n "year_built": 1984}')
    row = io.load_predictions(spark, str(preds)).first()
    assert (row.doc_id, row.extraction.year_built) == ("doc_1", 1984)


def test_results_and_stream(spark, tmp_path):
    log, sink = tmp_path / "log", str(tmp_path / "sink")
    log.mkdir()
    line = lambda i: json.dumps({"key": f"d|temp_0|{i}", "doc_id": "d", "condition": "temp_0", "run_index": i, "extraction": {"named_insured": "X"}})
    (log / "1.json").write_text("\n".join([line(0), "", line(1), line(1)]) + "\n")
    assert io.load_results(spark, str(log)).count() == 3
    for _ in range(2):
        ingest.ingest(spark, str(log), sink, str(tmp_path / "state")).awaitTermination()
        assert ingest.stored(spark, sink).count() == 2
    (log / "2.json").write_text(line(1) + "\n" + line(2) + "\n")
    ingest.ingest(spark, str(log), sink, str(tmp_path / "state2")).awaitTermination()  # all again, as after a lost state
    assert ingest.stored(spark, sink).count() == 3


OUTPUTS = [
    ('```json\n{"named_insured": "A", "year_built": "1984", "loss_history": null}\n```', None, 1984),
    ('{"named_insured": "", "loss_history": [1, {"date": "2024-01-02", "status": ""}]}', None, None),
    ('{"year_built": 1984.0}', None, 1984),
    ('{"year_built": 1984.5}', "wrong values: year_built", None),
    ('{"deductible": "NaN"}', "wrong values: deductible", None),
    ('{"color": 1}', "unknown keys: color", None),
    ('{"loss_history": [{"color": 1}]}', "wrong values: loss_history", None),
    ("sorry", "no JSON object", None),
    (None, "no JSON object", None),
]


def test_validate(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(OUTPUTS)], "i int, text string")
    got = validate.validate(rows).orderBy("i").collect()
    assert [(r.error, r.extraction.year_built if r.extraction else None) for r in got] == [(e, y) for _, e, y in OUTPUTS]
    assert got[1].extraction.named_insured is None and len(got[1].extraction.loss_history) == 1


FORM = """Named Insured    Acme Freight LLC      Agency copy
Mailing Address    12 Main St
NAICS Code: 493110
Effective Date    05/06/24 (06/05/24)
Expiration Date    2025-05-06
Limits    1M/2M
Deductible    —
Building Value
Contents Value: $5,000
Year Built    about 1984
09/15/20 (15/09/20)  Water damage  $1,250.50  Closed
1/2/2021  Fire  3  Open
"""


def test_form(spark):
    x = spark.createDataFrame([(FORM,)], "t string").select(formtext.parse_form(F.col("t")).alias("x")).first().x
    assert (x.named_insured, x.mailing_address, x.industry_code, x.industry_code_type) == ("Acme Freight LLC", "12 Main St", "493110", "NAICS")
    assert (str(x.effective_date), str(x.expiration_date), x.per_occurrence_limit, x.aggregate_limit) == ("2024-05-06", "2025-05-06", 1e6, 2e6)
    assert (x.deductible, x.contents_value, x.year_built) == (None, 5000.0, 1984)
    assert [(str(e.date), e.cause, e.paid_amount, e.status) for e in x.loss_history] == [("2020-09-15", "Water damage", 1250.5, "Closed"), ("2021-01-02", "Fire", 3.0, "Open")]
    empty = spark.createDataFrame([("",), (None,)], "t string").select(formtext.parse_form(F.col("t")).alias("x")).collect()
    assert all(r.x.named_insured is None and r.x.loss_history == [] for r in empty)
