"""Running totals: trees of ranges of any size, and totals that are carried on."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from assaykit.operators import usage

KIND = "call_id int, run_id string, at int, cost decimal(20,10)"


def some_calls(n, seed=1, none=0.1):
    r = random.Random(seed)
    return [(i, r.choice(["a", "a", "a", "b", None]), r.randrange(n), None if r.random() < none else Decimal(r.randrange(-5, 100)) / 1000) for i in range(n)]


def plain(rows, by_run, carry=None):
    """call_id -> running; calls of one time and id are in one place."""
    out, sums = {}, dict(carry or {})
    for call_id, run, _, cost in sorted(rows, key=lambda x: (x[2], x[0])):
        key = run if by_run else 0
        sums[key] = sums.get(key, 0) + (cost or 0)
        out[call_id] = sums[key]
    return out


@pytest.mark.parametrize(("rows", "leaf"), [(1_000_000, 1000), (20, 1000), (7, 3), (3, 2)])
@pytest.mark.parametrize("run", [None, "run_id"])
def test_tree(spark, monkeypatch, rows, leaf, run):
    """Any number of ranges, and any number of levels over them."""
    monkeypatch.setattr(usage._before, "__defaults__", (leaf,))
    calls = some_calls(150)
    got = usage.running_total(spark.createDataFrame(calls, KIND), ["at", "call_id"], run, rows=rows).collect()
    want = plain(calls, run is not None)
    assert {r.call_id: r.running or 0 for r in got} == want


def test_ranges_follow_rows(spark):
    calls = spark.range(1000).select(F.col("id").alias("call_id"), F.lit(1.0).alias("cost"))
    got = usage.running_total(calls, ["call_id"], rows=100)
    assert 8 <= len({f.rsplit("part-", 1)[1][:5] for f in got.inputFiles()}) <= 10
    assert [r.running for r in got.orderBy("call_id").collect()] == [float(i + 1) for i in range(1000)]


@pytest.mark.parametrize("run", [None, "run_id"])
def test_carried(spark, run):
    """Calls of three days give the same audit in one go and day by day; runs come, stay away and come back."""
    calls = [c for c in some_calls(120, seed=4) if not (c[1] == "b" and 40 <= c[2] < 80)]
    whole = usage.spend_audit(spark.createDataFrame(calls, KIND), 1.0, ["at", "call_id"], run)
    carry, got = None, []
    for day in range(3):
        part = spark.createDataFrame([c for c in calls if c[2] // 40 == day], KIND)
        got += usage.spend_audit(part, 1.0, ["at", "call_id"], run, carry).select("call_id", "running", "status").collect()
        carry = spark.createDataFrame(usage.totals_after(part, run, carry=carry).collect(), usage.totals_after(part, run).schema)
    assert sorted(map(tuple, got)) == sorted(map(tuple, whole.select("call_id", "running", "status").collect()))
    assert {r.status for r in got} == {"charged", "tripped", "skipped", "invalid"}
    sums = {r[run] if run else 0: r.total for r in carry.collect()}
    last = plain([(i, r, t, c if c is not None and c > 0 else None) for i, r, t, c in calls], run is not None)
    assert sorted(map(str, sums)) == sorted({str(c[1]) if run else "0" for c in calls}) and sum(sums.values()) == sum(max(c[3] or 0, 0) for c in calls) and last


def test_edges(spark):
    none = spark.createDataFrame([], KIND)
    assert usage.running_total(none, ["at"], "run_id").count() == 0
    assert usage.totals_after(none).first().total == 0 and usage.totals_after(none, "run_id").count() == 0
    one = spark.createDataFrame([(1, "a", 0, Decimal(2))], KIND)
    above = spark.createDataFrame([("a", Decimal(5)), ("b", Decimal(1))], "run_id string, total decimal(30,10)")
    assert [(r.running, r.status) for r in usage.spend_audit(one, 4, ["at"], "run_id", above).collect()] == [(Decimal(7), "skipped")]
    assert {r.run_id: r.total for r in usage.totals_after(one, "run_id", carry=above).collect()} == {"a": Decimal(7), "b": Decimal(1)}
