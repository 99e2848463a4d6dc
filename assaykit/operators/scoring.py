"""Scores of extracted fields against the truth, in one projection without a shuffle.

Pairs are rows with two structs of raw extractions, truth and pred (see schemas.RAW_EXTRACTION).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..sources.schemas import ALL_FIELDS, AMOUNT_FIELDS, DATE_FIELDS, EXACT_FIELDS, SCALAR_FIELDS, TEXT_FIELDS, TEXT_THRESHOLD


def exact_value(field: str, raw: Column) -> Column:
    """The value by which exact fields are compared. An ambiguous date equals only the same raw string."""
    if field in DATE_FIELDS:
        return N.read_date(raw, lambda *_: F.concat(F.lit("__ambiguous__|"), raw))
    if field == "industry_code":
        return N.normalize_code(raw)
    if field == "industry_code_type":
        return N.code_type(raw)
    if field in AMOUNT_FIELDS:
        return N.normalize_amount(raw)
    if field == "year_built":
        return N.normalize_int(raw)
    if field == "construction_type":
        return N.joined_tokens(raw)
    return N.normalize_identifier(raw)


def field_correct(field: str, truth: Column, pred: Column, threshold: float = TEXT_THRESHOLD) -> Column:
    """Whether a scalar field is right; two nulls are, and equal raw strings, which are not taken apart."""
    if field in TEXT_FIELDS:
        return N.token_overlap(truth, pred) >= threshold
    return truth.eqNullSafe(pred) | exact_value(field, truth).eqNullSafe(exact_value(field, pred))


def loss_key(event: Column) -> Column:
    """struct(date, cause, amount); the status doesn't count."""
    date = event["date"]
    return F.struct(
        N.read_date(date, lambda *_: F.concat(F.lit("ambiguous:"), date)).alias("date"),
        N.joined_tokens(event["cause"]).alias("cause"),
        N.normalize_amount(event["paid_amount"]).alias("amount"),
    )


def _rates(tp: Column, fp: Column, fn: Column) -> Column:
    counts = F.struct(tp.cast("int").alias("true_positives"), fp.cast("int").alias("false_positives"), fn.cast("int").alias("false_negatives"))

    def rates(c: Column) -> Column:
        tp, fp, fn = (c[k] for k in ("true_positives", "false_positives", "false_negatives"))
        precision = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(1.0)
        recall = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(1.0)
        f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(1.0)
        return F.struct(
            precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), tp.alias("true_positives"), fp.alias("false_positives"),
            fn.alias("false_negatives"), ((fp == 0) & (fn == 0)).alias("exact_set_match"),
        )

    return N.let(counts, rates)


def loss_score(truth: Column, pred: Column) -> Column:
    """Multiset precision, recall, f1 and exact match of two arrays of events, within the row.

    Its work is the square of the events of a document; loss_scores_grouped is for long lists.
    """
    none = F.array().cast("array<struct<date:string,cause:string,amount:double>>")
    keys = F.struct(F.coalesce(F.transform(truth, loss_key), none).alias("t"), F.coalesce(F.transform(pred, loss_key), none).alias("p"))
    count = lambda keys, k: F.size(F.filter(keys, lambda x: x.eqNullSafe(k)))
    both = lambda k: F.aggregate(F.array_distinct(k["t"]), F.lit(0), lambda acc, x: acc + F.least(count(k["t"], x), count(k["p"], x)))
    return N.let(keys, lambda k: N.let(both(k), lambda tp: _rates(tp, F.size(k["p"]) - tp, F.size(k["t"]) - tp)))


def loss_scores_grouped(pairs: DataFrame, pair_id: str = "pair_id") -> DataFrame:
    """pair_id and the columns of loss_score, by exploding and grouping on (pair, key)."""
    key = lambda side: F.transform(F.col(f"{side}.loss_history"), loss_key)
    events = pairs.select(pair_id, F.explode(key("truth")).alias("k"), F.lit(1).alias("t"), F.lit(0).alias("p")).union(
        pairs.select(pair_id, F.explode(key("pred")).alias("k"), F.lit(0).alias("t"), F.lit(1).alias("p"))
    )
    by_key = events.groupBy(pair_id, "k").agg(F.sum("t").alias("t"), F.sum("p").alias("p"))
    sums = by_key.groupBy(pair_id).agg(F.sum(F.least("t", "p")).alias("tp"), F.sum("t").alias("t"), F.sum("p").alias("p"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    rates = _rates(zero(F.col("tp")), zero(F.col("p") - F.col("tp")), zero(F.col("t") - F.col("tp")))
    return pairs.select(pair_id).join(sums, pair_id, "left").select(pair_id, rates.alias("loss")).select(pair_id, "loss.*")


def score_pairs(pairs: DataFrame, threshold: float = TEXT_THRESHOLD) -> DataFrame:
    """The pairs' other columns, a boolean column ok_<field> for each of the 15 fields, the struct
    loss, and the accuracies scalar_accuracy (of 14) and aggregate_accuracy (of 15)."""
    truth, pred = F.col("truth"), F.col("pred")
    others = [c for c in pairs.columns if c not in ("truth", "pred")]
    flags = [field_correct(f, truth[f], pred[f], threshold).alias(f"ok_{f}") for f in SCALAR_FIELDS]
    scored = pairs.select(*others, *flags, loss_score(truth["loss_history"], pred["loss_history"]).alias("loss"))
    right = sum((F.col(f"ok_{f}").cast("int") for f in SCALAR_FIELDS), F.lit(0))
    exact = F.col("loss.exact_set_match")
    return scored.select(
        "*", exact.alias("ok_loss_history"), (right / len(SCALAR_FIELDS)).alias("scalar_accuracy"),
        ((right + exact.cast("int")) / len(ALL_FIELDS)).alias("aggregate_accuracy"),
    )


def long_fields(pairs: DataFrame, id_cols: list[str]) -> DataFrame:
    """A row for each pair and scalar field: field, truth, pred (raw strings)."""
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"truth.{f}").alias("truth"), F.col(f"pred.{f}").alias("pred")) for f in SCALAR_FIELDS])
    return pairs.select(*id_cols, F.explode(cells).alias("cell")).select(*id_cols, "cell.*")


def field_details(pairs: DataFrame, id_cols: list[str], threshold: float = TEXT_THRESHOLD) -> DataFrame:
    """A row for each pair and field: field, correct, detail."""
    truth, pred = F.col("truth"), F.col("pred")
    shown = lambda v: F.coalesce(v.cast("string"), F.lit("null"))
    cells = []
    for f in SCALAR_FIELDS:
        if f in EXACT_FIELDS:
            detail = F.concat(F.lit("truth="), shown(exact_value(f, truth[f])), F.lit(" pred="), shown(exact_value(f, pred[f])))
        else:
            detail = F.format_string(f"overlap=%.3f threshold={threshold}", N.token_overlap(truth[f], pred[f]))
        cells.append(F.struct(F.lit(f).alias("field"), field_correct(f, truth[f], pred[f], threshold).alias("correct"), detail.alias("detail")))
    def shown_loss(loss: Column) -> Column:
        detail = F.format_string("tp=%d fp=%d fn=%d", loss["true_positives"], loss["false_positives"], loss["false_negatives"])
        return F.struct(F.lit("loss_history").alias("field"), loss["exact_set_match"].alias("correct"), detail.alias("detail"))

    cells.append(N.let(loss_score(truth["loss_history"], pred["loss_history"]), shown_loss))
    return pairs.select(*id_cols, F.explode(F.array(*cells)).alias("cell")).select(*id_cols, "cell.*")
