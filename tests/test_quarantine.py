"""One pass, two tables: what is kept of each, counts, repeated and later batches, and release."""

import pytest
from pyspark.sql import functions as F

from assaykit.operators import usage
from assaykit.sources import quarantine as Q
from assaykit.sources import validate

GOOD = '{"named_insured": "A", "year_built": 1984}'
OUTPUTS = [("a", GOOD), ("b", '{"deductible": "x", "effective_date": "1/2/2024"}'), ("c", None), ("d", "  sorry\n"), ("e", '{"color": 1}'), ("f", '{"loss_history": [{"date": "2024-13-40"}]}')]


def outputs(spark, rows=OUTPUTS):
    return spark.createDataFrame(rows, "doc_id string, text string")


def test_outputs(spark, tmp_path):
    found = validate.sort_out(outputs(spark), str(tmp_path / "q"))
    assert [(r.doc_id, r.extraction.year_built) for r in found.good.collect()] == [("a", 1984)]
    bad = {r.doc_id: (r.text, r.reasons) for r in found.bad.collect()}
    assert bad == {
        "b": (OUTPUTS[1][1], ["wrong effective_date", "wrong deductible"]), "c": (None, ["no JSON object"]), "d": ("  sorry\n", ["no JSON object"]),
        "e": ('{"color": 1}', ["unknown keys"]), "f": (OUTPUTS[5][1], ["wrong loss_history"]),
    }
    assert {k: n for k, n in found.counts.items() if n} == {"good": 1, "bad": 5, "no JSON object": 2, "unknown keys": 1, "wrong effective_date": 1, "wrong deductible": 1, "wrong loss_history": 1}


def test_one_scan(spark, tmp_path):
    """Each input row is evaluated once, though it is judged, counted and stored."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def watched(text):
        seen.add(1)
        return text

    rows = outputs(spark).repartition(1).withColumn("text", watched.asNondeterministic()("text"))
    validate.sort_out(rows, str(tmp_path / "q"))
    assert seen.value == len(OUTPUTS)


def test_batches(spark, tmp_path):
    """A repeated batch replaces itself, also if it has fewer kinds of rows; another one is added; what is fixed is released."""
    path = str(tmp_path / "q")
    validate.sort_out(outputs(spark), path, batch="1")
    again = validate.sort_out(outputs(spark), path, batch="1")
    assert (again.good.count(), again.bad.count()) == (1, 5)
    more = validate.sort_out(outputs(spark, [("g", GOOD), ("h", "no")]), path, batch="2")
    assert (more.good.count(), more.bad.count(), more.counts["good"], more.counts["bad"]) == (2, 6, 1, 1)
    fewer = validate.sort_out(outputs(spark, [("g", GOOD)]), path, batch="2")
    assert (fewer.good.count(), fewer.bad.count()) == (2, 5)
    retry = Q.released(fewer.bad, F.array_contains("reasons", "unknown keys")).withColumn("text", F.lit(GOOD))
    assert retry.columns == ["doc_id", "text", "error"]
    assert sorted(r.doc_id for r in validate.sort_out(retry.select("doc_id", "text"), path, batch="3").good.collect()) == ["a", "e", "g"]


def test_edges(spark, tmp_path):
    """No rows, no bad rows, conditions that are null, and names that are taken."""
    none = validate.sort_out(outputs(spark).limit(0), str(tmp_path / "none"))
    assert (none.good.count(), none.bad.count(), sum(none.counts.values())) == (0, 0, 0)
    rows = spark.createDataFrame([(1, None), (2, 5)], "i int, x int")
    found = Q.sort_out(rows, {"large": F.col("x") > 3}, str(tmp_path / "x"), ["i"], ["i", "x"])
    assert [tuple(r) for r in found.good.collect()] == [(1, "0")] and [(r.i, r.x, r.reasons) for r in found.bad.collect()] == [(2, 5, ["large"])]
    with pytest.raises(ValueError):
        Q.sort_out(rows.withColumn("Batch", F.lit(1)), {}, str(tmp_path / "y"), ["i"], ["i"])


def test_calls(spark, tmp_path):
    calls = spark.createDataFrame([(1, 2.5), (2, -1.0), (3, None), (4, 0.0)], "call_id int, cost double")
    found = usage.sort_out_calls(calls, str(tmp_path / "calls"))
    assert sorted(r.call_id for r in found.good.collect()) == [1, 4]
    assert sorted((r.call_id, r.cost, r.reasons) for r in found.bad.collect()) == [(2, -1.0, ["negative cost"]), (3, None, ["no cost"])]
    assert found.counts == {"good": 2, "bad": 2, "no cost": 1, "negative cost": 1}
