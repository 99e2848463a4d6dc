"""Schemas and field lists of extraction records."""

from __future__ import annotations

from pyspark.sql import types as T

#: Tiers, conditions, and the fields in their order.
TIERS = ("clean_digital", "scanned", "handwritten_fields", "incomplete", "ambiguous")
CONDITIONS = ("temp_0", "temp_default")
CODE_TYPES = ("SIC", "NAICS")
DATE_FIELDS = ("effective_date", "expiration_date")
AMOUNT_FIELDS = ("per_occurrence_limit", "aggregate_limit", "deductible", "building_value", "contents_value")
EXACT_FIELDS = (*DATE_FIELDS, "industry_code", "industry_code_type", *AMOUNT_FIELDS, "year_built", "construction_type")
TEXT_FIELDS = ("named_insured", "mailing_address", "business_description")
SCALAR_FIELDS = (*EXACT_FIELDS, *TEXT_FIELDS)
ALL_FIELDS = (*SCALAR_FIELDS, "loss_history")
#: Of string fields an empty string means null.
EMPTY_IS_NULL = ("named_insured", "mailing_address", "industry_code", "business_description", "construction_type")
LOSS_FIELDS = ("date", "cause", "paid_amount", "status")
TEXT_THRESHOLD = 0.8
N_RUNS = 5

_TYPES = {f: T.DateType() for f in DATE_FIELDS} | {f: T.DoubleType() for f in AMOUNT_FIELDS} | {"year_built": T.IntegerType()}
#: The fields of a record in their order.
_ORDER = (
    "named_insured", "mailing_address", "effective_date", "expiration_date", "industry_code", "industry_code_type", "business_description",
    "per_occurrence_limit", "aggregate_limit", "deductible", "building_value", "contents_value", "year_built", "construction_type",
)

LOSS = T.StructType([T.StructField("date", T.DateType()), T.StructField("cause", T.StringType()), T.StructField("paid_amount", T.DoubleType()), T.StructField("status", T.StringType())])
RAW_LOSS = T.StructType([T.StructField(f, T.StringType()) for f in LOSS_FIELDS])
EXTRACTION = T.StructType([*(T.StructField(f, _TYPES.get(f, T.StringType())) for f in _ORDER), T.StructField("loss_history", T.ArrayType(LOSS))])
#: Every scalar as a string: what normalizers read.
RAW_EXTRACTION = T.StructType([*(T.StructField(f, T.StringType()) for f in _ORDER), T.StructField("loss_history", T.ArrayType(RAW_LOSS))])
TRUTH = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("difficulty_tier", T.StringType()), T.StructField("seed", T.LongType()), T.StructField("extraction", EXTRACTION)])
RUNS = T.StructType(
    [T.StructField("key", T.StringType()), T.StructField("doc_id", T.StringType()), T.StructField("condition", T.StringType()), T.StructField("run_index", T.IntegerType()), T.StructField("extraction", EXTRACTION)]
)
