import pytest
from pyspark.sql import functions as F

from assaykit.functions import normalize as N


def values(spark, f, inputs):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r.y for r in rows.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


CASES = {
    "missing_to_none": [(None, None), ("", None), ("   ", None), ("x", "x"), (" x ", " x ")],
    "normalize_identifier": [("Acme, Inc. 5", "ACMEINC5"), ("--", None), (None, None)],
    "normalize_code": [("NAICS 493110", "493110"), ("42-13", "4213"), ("0042", "0042"), ("none", None), (None, None)],
    "code_type": [(" sic ", "SIC"), ("", None), (None, None)],
    "normalize_amount": [
        ("1M", 1e6), ("1m", 1e6), ("$1,000,000", 1e6), ("1000000", 1e6), ("1.5M", 1.5e6), ("$2,500", 2500.0), ("1M/2M", None), ("N/A", None), ("-5", -5.0),
        (".5M", None), ("1e6", None), ("(500)", None), ("2.5MM", 2.5e6), ("€ 3k", 3000.0), ("2B", 2e9), ("", None), ("  ", None), (None, None), ("m", None), ("1 000", 1000.0),
    ],
    "normalize_int": [("1984", 1984), ("1984.0", 1984), ("1984.7", 1984), ("1,984", None), ("5d", None), ("-3.9", -3), ("1e3", 1000), ("", None), (None, None), ("1e300", None), ("nan", None)],
    "normalize_text_tokens": [("Acme LLC, 5", ["acme", "llc", "5"]), ("", None), ("--", None), (None, None), ("café", ["caf"])],
}


@pytest.mark.parametrize("name", CASES)
def test_scalars(spark, name):
    assert values(spark, getattr(N, name), [x for x, _ in CASES[name]]) == [y for _, y in CASES[name]]


DATES = [
    ("2026-12-18", "2026-12-18", []), ("2026/1/5", "2026-01-05", []), ("20240131", "2024-01-31", []), ("202411", None, []), ("March 5, 2024", "2024-03-05", []), ("mar  5,  2024", "2024-03-05", []),
    ("5 March 2024", "2024-03-05", []), ("5 Mar 2024", "2024-03-05", []), ("12/18/2026", "2026-12-18", []), ("15/03/2024", "2024-03-15", []), ("03/15/2024", "2024-03-15", []),
    ("05/06/2024", None, ["2024-05-06", "2024-06-05"]), ("05/05/2024", "2024-05-05", []), ("31/31/2024", None, []), ("02/30/2024", None, []), ("1/2/69", None, ["2069-01-02", "2069-02-01"]),
    ("1-2-70", None, ["1970-01-02", "1970-02-01"]), ("13/1/0099", "1999-01-13", []), (" 2024-02-29 ", "2024-02-29", []), ("2023-02-29", None, []), ("", None, []), (None, None, []), ("soon", None, []),
]


def test_dates(spark):
    got = values(spark, N.normalize_date, [x for x, _, _ in DATES])
    assert [(r.iso if r else None, list(r.candidates) if r else []) for r in got] == [(i, c) for _, i, c in DATES]


def test_overlap_and_limits(spark):
    pairs = [("Smith & Sons", "SMITH sons", 1.0), (None, None, 1.0), ("abc", None, 0.0), ("", " ", 1.0), ("a b c d", "a b c", 0.75), ("a a b", "a b b", 1.0)]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(pairs)], "i int, a string, b string")
    assert [r.o for r in rows.select("i", N.token_overlap("a", "b").alias("o")).orderBy("i").collect()] == [o for _, _, o in pairs]
    limits = values(spark, N.split_compound_limits, ["1M/2M", "$500k", "1M/2M/3M", "", None, "/5"])
    assert [(r.left, r.right) for r in limits] == [(1e6, 2e6), (5e5, None), (1e6, None), (None, None), (None, None), (None, 5.0)]
