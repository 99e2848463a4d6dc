"""Normalizers: Column -> Column, from raw strings (typed values are cast to strings by the caller).

White space is Unicode's; digits are ASCII's. A compact date needs its eight digits.

Most values are written plainly (an ISO date, digits) and are read by a first branch in generated code.
The others go through let, which binds a value that a formula mentions often; it is interpreted, but
without it each mention would be a copy of the whole expression.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"[\s\x1c-\x1f]"

#: Factors of amount suffixes.
SUFFIXES = {"k": 1e3, "m": 1e6, "mm": 1e6, "b": 1e9}
#: Fixed value: dates of three numbers.
SLASHED = r"\A(\d{1,2})[/-](\d{1,2})[/-](\d{4}|\d{2})\z"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """body(value), with value worked out once: else each mention of it in body would be a copy."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column | str) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(col(c), rf"(?U)\A{_SPACE}+|{_SPACE}+\z", "")


def missing_to_none(c: Column | str) -> Column:
    """Null for null, empty and white-space-only strings; others unchanged."""
    return F.when(col(c).rlike(r"(?U)[^\s\x1c-\x1f]"), col(c))


def _or_null(c: Column) -> Column:
    return F.when(c != "", c)


def normalize_identifier(c: Column | str) -> Column:
    """Upper-case letters and digits alone."""
    return _or_null(F.regexp_replace(F.upper(col(c)), "[^A-Z0-9]", ""))


def normalize_code(c: Column | str) -> Column:
    """Digits alone, leading zeros kept."""
    return _or_null(F.regexp_replace(col(c), "[^0-9]", ""))


def code_type(c: Column | str) -> Column:
    """Stripped and upper-case; null if blank."""
    return F.upper(strip(missing_to_none(c)))


def read_date(c: Column | str, unclear: Callable[[Column, Column], Column] | None = None) -> Column:
    """The ISO string; null for missing and unreadable values. Of an ambiguous one unclear(month-first date,
    day-first date), or null."""
    raw = col(c)
    none = F.lit(None).cast("string")
    slow = let(strip(raw), lambda text: F.coalesce(_plain_date(text), F.when(text.rlike(SLASHED), let(_readings(text), lambda d: _decided(d, unclear(d["a"], d["b"]) if unclear else none)))))
    return F.when(raw.rlike(r"\A\d{4}-\d{2}-\d{2}\z"), F.try_to_date(raw, "yyyy-MM-dd").cast("string")).when(raw.isNotNull(), slow)


def _guarded_date(text: Column, shape: str, pattern: str) -> Column:
    return F.when(text.rlike(shape), F.try_to_date(text, pattern))


def _plain_date(text: Column) -> Column:
    named = let(
        F.regexp_replace(text, rf"(?U){_SPACE}+", " "),
        lambda flat: F.coalesce(
            _guarded_date(flat, r"\A[A-Za-z]{4,} \d{1,2}, \d{4}\z", "MMMM d, yyyy"),
            _guarded_date(flat, r"\A[A-Za-z]{3} \d{1,2}, \d{4}\z", "MMM d, yyyy"),
            _guarded_date(flat, r"\A\d{1,2} [A-Za-z]{4,} \d{4}\z", "d MMMM yyyy"),
            _guarded_date(flat, r"\A\d{1,2} [A-Za-z]{3} \d{4}\z", "d MMM yyyy"),
        ),
    )
    return F.coalesce(
        _guarded_date(text, r"\A\d{4}-\d{1,2}-\d{1,2}\z", "yyyy-M-d"),
        _guarded_date(text, r"\A\d{4}/\d{1,2}/\d{1,2}\z", "yyyy/M/d"),
        _guarded_date(text, r"\A\d{8}\z", "yyyyMMdd"),
        F.when(text.rlike("[A-Za-z]"), named),
    ).cast("string")


def _readings(text: Column) -> Column:
    """struct(a, b): the month-first and the day-first date of three numbers. A last one below 70 is a year of
    this century, one below 100 of the last."""
    this_century = F.regexp_replace(F.translate(text, "-", "/"), r"\A(?<day>.*/)(?:00)?(?<year>[0-6]\d)\z", "${day}20${year}")
    whole = F.regexp_replace(this_century, r"\A(?<day>.*/)(?:00)?(?<year>[7-9]\d)\z", "${day}19${year}")
    return let(whole, lambda x: F.struct(F.try_to_date(x, "M/d/yyyy").cast("string").alias("a"), F.try_to_date(x, "d/M/yyyy").cast("string").alias("b")))


def _decided(d: Column, unclear: Column) -> Column:
    return F.when(d["a"] != d["b"], unclear).otherwise(F.coalesce(d["a"], d["b"]))


def date_iso(c: Column | str) -> Column:
    """The ISO string; null for missing, unreadable and ambiguous values."""
    return read_date(c)


def date_or_both(c: Column | str) -> Column:
    """The ISO string, or both dates of an ambiguous value with a comma between."""
    return read_date(c, lambda a, b: F.concat_ws(",", a, b))


def normalize_date(c: Column | str) -> Column:
    """struct(iso string, candidates array<string>).

    iso is null for missing, unreadable and ambiguous values; candidates has the two dates,
    month-first and day-first, of ambiguous ones and is empty otherwise.
    """
    none = F.array().cast("array<string>")
    both = lambda d: F.struct(F.when(~d.contains(","), d).alias("iso"), F.when(d.contains(","), F.split(d, ",")).otherwise(none).alias("candidates"))
    return let(date_or_both(c), both)


def normalize_amount(c: Column | str) -> Column:
    """Money as double: currency signs and commas dropped, suffixes k, m, mm, b applied; compound and other values null."""
    raw = col(c)
    shape = r"\A(-?\d+(?:\.\d+)?)(mm|k|m|b)?\z"

    def amount(text: Column) -> Column:
        factors = F.create_map(*[F.lit(x) for pair in {"": 1.0, **SUFFIXES}.items() for x in pair])
        return F.when(text.rlike(shape), F.regexp_extract(text, shape, 1).try_cast("double") * factors[F.regexp_extract(text, shape, 2)])

    bare = F.regexp_replace(F.regexp_replace(strip(raw), rf"(?U)[$€£]{_SPACE}*", ""), ",", "")
    slow = let(F.regexp_replace(F.lower(strip(bare)), " ", ""), amount)
    written = F.regexp_replace(raw, "[$,]", "").try_cast("double")
    return F.when(raw.rlike(r"\A\d+\z"), raw.try_cast("double")).when(raw.rlike(r"\A\$?\d[\d,]*(?:\.\d+)?\z"), written).when(raw.isNotNull(), slow)


def normalize_int(c: Column | str) -> Column:
    """Integers, and other numbers cut off after the point; null for what is no number or too large."""
    raw = col(c)
    number = F.regexp_extract(F.regexp_replace(strip(raw), r"(?<=\d)_(?=\d)", ""), r"\A[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z", 0)
    return F.when(raw.rlike(r"\A\d{1,15}\z"), raw.try_cast("bigint")).when(raw.isNotNull(), number.try_cast("double").try_cast("bigint"))


def normalize_text_tokens(c: Column | str) -> Column:
    """All [a-z0-9]+ of the lower-cased text in order; null for none."""
    return F.nullif(F.regexp_extract_all(F.lower(col(c)), F.lit("([a-z0-9]+)"), F.lit(1)), F.array().cast("array<string>"))


def joined_tokens(c: Column | str) -> Column:
    """The tokens of the text with one blank between them; null for none, and for null."""
    return _or_null(F.trim(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", " ")))


def token_overlap(a: Column | str, b: Column | str) -> Column:
    """Jaccard overlap of distinct tokens; 1 if both are missing, 0 if one is. Equal texts are not taken apart."""
    tokens = F.struct(F.array_distinct(normalize_text_tokens(a)).alias("a"), F.array_distinct(normalize_text_tokens(b)).alias("b"))
    share = let(
        tokens,
        lambda t: F.when(t["a"].isNull() & t["b"].isNull(), 1.0)
        .when(t["a"].isNull() | t["b"].isNull(), 0.0)
        .otherwise(F.size(F.array_intersect(t["a"], t["b"])) / F.size(F.array_union(t["a"], t["b"]))),
    )
    return F.when(col(a).eqNullSafe(col(b)), 1.0).otherwise(share)


def split_compound_limits(c: Column | str) -> Column:
    """struct(left, right): amounts on both sides of the first slash; without one, the amount and null."""
    parts = F.split(missing_to_none(c), "/", 2)
    return F.struct(normalize_amount(parts[0]).alias("left"), normalize_amount(F.get(parts, F.lit(1))).alias("right"))
