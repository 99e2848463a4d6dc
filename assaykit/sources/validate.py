"""Model output to typed extractions: parse, coerce, validate; bad rows are marked, or sorted out, not raised."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.normalize import col, let, strip
from . import quarantine as Q
from .schemas import AMOUNT_FIELDS, CODE_TYPES, DATE_FIELDS, EXTRACTION, LOSS, LOSS_FIELDS, RAW_LOSS

_STRINGS = T.StructType([*(T.StructField(f, T.StringType()) for f in EXTRACTION.names if f != "loss_history"), T.StructField("loss_history", T.ArrayType(T.StringType()))])
#: Fixed value: JSON within a fence.
_FENCE = r"```(?:json)?\s*([\s\S]*?)```"
_NUMBER = r"\A\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*\z"


def json_text(text: Column | str) -> Column:
    """The content of the first ``` fence, else the whole text; stripped."""
    text = strip(text)
    return strip(F.when(text.rlike(_FENCE), F.regexp_extract(text, _FENCE, 1)).otherwise(text))


def coerce(raw: Column) -> Column:
    """A struct of strings (of _STRINGS): empty strings null, missing loss_history [], events that are no objects dropped."""
    cells = [F.when(raw[f] != "", raw[f]).alias(f) for f in EXTRACTION.names if f != "loss_history"]
    events = F.filter(F.coalesce(raw["loss_history"], F.array().cast("array<string>")), lambda e: F.ltrim(e).startswith("{"))
    known = F.array(*map(F.lit, LOSS_FIELDS))

    def event(e: Column) -> Column:
        unknown = F.array_except(F.json_object_keys(e), known).alias("unknown")
        return let(F.from_json(e, RAW_LOSS), lambda x: F.struct(*[F.when(x[f] != "", x[f]).alias(f) for f in LOSS_FIELDS], unknown))

    return F.struct(*cells, F.transform(events, event).alias("loss_history"))


def _number(c: Column) -> Column:
    return F.when(c.rlike(_NUMBER), F.trim(c).try_cast("double"))


def _date(c: Column) -> Column:
    return F.when(c.rlike(r"\A\d{4}-\d{2}-\d{2}\z"), F.try_to_date(c, "yyyy-MM-dd"))


def _integer(c: Column) -> Column:
    number = _number(c)
    return F.when(number == F.floor(number), number.try_cast("int"))


def typed(field: str, raw: Column) -> Column:
    if field in DATE_FIELDS or field == "date":
        return _date(raw)
    if field in AMOUNT_FIELDS or field == "paid_amount":
        return _number(raw)
    if field == "year_built":
        return _integer(raw)
    return raw


def validate(outputs: DataFrame, text: str = "text") -> DataFrame:
    """outputs with extraction (typed; null if invalid), valid and error (null if valid).

    Invalid: no JSON object; unknown keys; dates that are not ISO; text for numbers (numbers in
    strings are read; NaN and infinity are no numbers); years with a fraction; a code type that
    is neither of the two. A number for a string field is read as its text.
    """
    json = json_text(col(text))
    fields = [f for f in EXTRACTION.names if f != "loss_history"]
    # each column is worked out once: what is parsed must not be mixed with the many uses of its fields
    rows = outputs.withColumn("_json", json).withColumn("_keys", F.json_object_keys("_json")).withColumn("_parsed", F.from_json("_json", _STRINGS))
    rows = rows.withColumn("_raw", coerce(F.col("_parsed")))
    raw = F.col("_raw")
    unknown = F.array_except("_keys", F.array(*map(F.lit, EXTRACTION.names)))
    wrong = [F.when(raw[f].isNotNull() & typed(f, raw[f]).isNull(), F.lit(f)) for f in (*DATE_FIELDS, *AMOUNT_FIELDS, "year_built")]
    wrong.append(F.when(raw["industry_code_type"].isNotNull() & ~raw["industry_code_type"].isin(*CODE_TYPES), F.lit("industry_code_type")))
    bad_event = lambda e: (F.size(e["unknown"]) > 0) | (e["date"].isNotNull() & _date(e["date"]).isNull()) | (e["paid_amount"].isNotNull() & _number(e["paid_amount"]).isNull())
    wrong.append(F.when(F.exists(raw["loss_history"], bad_event), F.lit("loss_history")))
    fields_wrong = F.array_compact(F.array(*wrong))
    error = (
        F.when(F.col("_keys").isNull(), "no JSON object")
        .when(F.size(unknown) > 0, F.concat(F.lit("unknown keys: "), F.array_join(F.array_sort(unknown), ",")))
        .when(F.size(fields_wrong) > 0, F.concat(F.lit("wrong values: "), F.array_join(fields_wrong, ",")))
    )
    losses = F.transform(raw["loss_history"], lambda e: F.struct(*[typed(f, e[f]).alias(f) for f in LOSS_FIELDS]))
    extraction = F.struct(*[typed(f, raw[f]).alias(f) for f in fields], losses.cast(T.ArrayType(LOSS)).alias("loss_history"))
    return rows.withColumn("error", error).withColumn("valid", F.col("error").isNull()).withColumn("extraction", F.when(F.col("valid"), extraction)).drop("_json", "_keys", "_parsed", "_raw")


def reasons() -> dict[str, Column]:
    """Of validate's rows: one condition for each way of being wrong, by its name."""
    error = F.col("error")
    fields = F.split(F.regexp_extract(error, r"\Awrong values: (.*)", 1), ",")
    wrong = {f"wrong {f}": F.array_contains(fields, f) for f in (*DATE_FIELDS, *AMOUNT_FIELDS, "year_built", "industry_code_type", "loss_history")}
    return {"no JSON object": error == "no JSON object", "unknown keys": error.startswith("unknown keys: "), **wrong}


def sort_out(outputs: DataFrame, path: str, ids: Sequence[str] = ("doc_id",), text: str = "text", batch: str = "0") -> Q.Sorted:
    """Validates outputs and stores them below path in one pass: extractions of valid ones (ids, extraction), and of the
    others the raw text as it came, the error, and its reasons. Counts are a number for each reason."""
    rows = validate(outputs, text)
    return Q.sort_out(rows.select(*ids, text, "extraction", "error"), reasons(), path, [*ids, "extraction"], [*ids, text, "error"], batch)
