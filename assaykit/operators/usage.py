"""Usage, cost and rate of model calls, from a call log."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.normalize import col
from ..sources import quarantine as Q
from ..sources.io import scratch

#: USD per 1M input and output tokens by model, and of any other model.
PRICES = [
    ("gpt-4o-mini", 0.15, 0.60),
    ("gpt-4o", 2.50, 10.00),
    ("claude-3-5-haiku-latest", 0.80, 4.00),
    ("claude-3-5-sonnet-latest", 3.00, 15.00),
    ("claude-haiku-4-5", 1.00, 5.00),
    ("local-pdf-parser", 0.0, 0.0),
]
OTHER_PRICE = (1.0, 5.0)
#: Of USD: exact for every whole number of tokens at prices of four places.
MONEY = "decimal(20,10)"
#: Calls of a range of a running total, about; ranges of a node in the tree over them.
RANGE_ROWS, LEAF = 1_000_000, 1000


def token_estimate(text: Column | str) -> Column:
    """A token for every four characters, one at least."""
    return F.greatest(F.floor(F.coalesce(F.length(col(text)), F.lit(0)) / 4), F.lit(1)).cast("bigint")


def with_cost(calls: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """calls with cost, in USD as a decimal of MONEY; missing token counts are 0, models without a price have
    OTHER_PRICE. Prices are read to four places, so costs and their sums are exact in any order of adding."""
    prices = calls.sparkSession.createDataFrame(PRICES, "model string, input_usd double, output_usd double") if prices is None else prices
    joined = calls.join(prices.select("model", "input_usd", "output_usd"), "model", "left")
    price = lambda usd, other: F.coalesce(usd, F.lit(other)).cast("decimal(12,4)")  # noqa: E731  of a million tokens: 1e-10 USD a token
    part = lambda tokens, usd, other: F.coalesce(tokens, F.lit(0)).cast("decimal(16,0)") * price(usd, other)
    total = part(F.col("prompt_tokens"), F.col("input_usd"), OTHER_PRICE[0]) + part(F.col("completion_tokens"), F.col("output_usd"), OTHER_PRICE[1])
    cost = (total.cast("decimal(26,4)") * F.lit("0.000001").cast("decimal(6,6)")).cast(MONEY)
    return joined.withColumn("cost", cost).select(*[calls[c] if c != "model" else F.col("model") for c in calls.columns if c != "cost"], "cost")


def sort_out_calls(calls: DataFrame, path: str, batch: str = "0") -> Q.Sorted:
    """Stores calls with a cost below path, and apart from them those whose cost is missing or negative, in one pass."""
    why = {"no cost": F.col("cost").isNull(), "negative cost": F.col("cost") < 0}
    return Q.sort_out(calls, why, path, calls.columns, calls.columns, batch)


def spend(calls: DataFrame) -> DataFrame:
    """provider, model (null: all), level (of rollup: 0, 1, 3), cost, n_calls."""
    return calls.rollup("provider", "model").agg(F.grouping_id().cast("int").alias("level"), F.sum("cost").alias("cost"), F.count("*").alias("n_calls"))


def _before(sums: DataFrame, runs: list[str], total: Callable[[Column], Column], leaf: int = LEAF) -> DataFrame:
    """of, of_run and before of rows (run, part, total): the run's total in all parts before this one.

    leaf neighbouring parts are a node of a tree; within a node it is a window, and the nodes' own totals are
    summed up in the same way, so no window has more than leaf rows, however many parts a run has.
    """
    names = [F.col(r).alias("of_run") for r in runs]
    within = lambda *node: total(F.sum("total").over(W.partitionBy(*runs, *node).orderBy("part").rowsBetween(W.unboundedPreceding, -1)))
    most = sums.agg(F.max("part")).first()[0]
    if most is None or most < leaf:
        return sums.select(F.col("part").alias("of"), *names, within().alias("before"))
    node = F.floor(F.col("part") / leaf).cast("int")
    here = sums.select(F.col("part").alias("of"), *names, node.alias("node"), within(node).alias("inside"))
    nodes = sums.groupBy(*runs, node.alias("part")).agg(total(F.sum("total")).alias("total"))
    above = _before(nodes, runs, total, leaf).toDF("above", *["above_run"] * len(runs), "outside")
    same = F.col("node") == F.col("above")
    for _ in runs:
        same &= F.col("of_run").eqNullSafe(F.col("above_run"))
    return here.join(above, same).select("of", *["of_run"] * len(runs), F.coalesce(F.col("inside") + F.col("outside"), "inside", "outside").alias("before"))


def running_total(calls: DataFrame, order: list[str], run: str | None = None, amount: str = "cost", carry: DataFrame | None = None, rows: int = RANGE_ROWS) -> DataFrame:
    """calls with running: the sum of amount up to and with the call, in the given order.

    Within each run, or over all calls. Calls are dealt out in ranges of run and order, of about as many rows
    as said, so their number follows the calls'; each range is summed by itself, and the sums of the run's
    ranges before are added, which come from a tree of ranges; no task sees all calls of a run, nor all its ranges. The dealt
    calls are written once: each plan that reads them would else sample ranges of its own. Rows that tie in
    the order are summed together; null amounts count nothing. Decimal amounts add up exactly, with
    ten more digits before the point.

    carry has what earlier calls came to (totals_after): a row (run, total) for each run, or one row (total); runs
    that it lacks begin at nothing.
    """
    of = calls.schema[amount].dataType
    kind = f"decimal({min(37, of.precision + 10)},{of.scale})" if isinstance(of, T.DecimalType) else None
    total = lambda c: c.cast(kind) if kind else c
    runs = [] if run is None else [run]
    path = scratch(calls.sparkSession, "dealt")
    dealt = calls.repartitionByRange(max(1, -(-calls.count() // rows)), *runs, *order).withColumn("part", F.spark_partition_id())
    dealt.write.parquet(path)
    dealt = calls.sparkSession.read.schema(dealt.schema).parquet(path)
    before = _before(dealt.groupBy(*runs, "part").agg(total(F.sum(amount)).alias("total")), runs, total)
    dealt = dealt.withColumn("within", total(F.sum(amount).over(W.partitionBy(*runs, "part").orderBy(*order))))
    same = F.col("part") == F.col("of")
    for r in runs:
        same &= F.col(r).eqNullSafe(F.col("of_run"))
    running = F.coalesce(F.col("within") + F.col("before"), "within", "before")
    found = dealt.join(before, same).withColumn("running", running).drop("part", "within", "of", "of_run", "before")
    if carry is None:
        return found
    if run is None:
        saved = carry.agg(F.sum("total").alias("carried"))  # one row
        found = found.crossJoin(F.broadcast(saved))
    else:
        saved = carry.groupBy(F.col(run).alias("of_run")).agg(F.sum("total").alias("carried"))
        found = found.join(saved, found[run].eqNullSafe(saved["of_run"]), "left")
    return found.withColumn("running", total(F.coalesce(F.col("running") + F.col("carried"), "running", "carried"))).drop("of_run", "carried")


def totals_after(calls: DataFrame, run: str | None = None, amount: str = "cost", carry: DataFrame | None = None) -> DataFrame:
    """What calls come to, with what was carried into them: (run, total) or one row (total), to be saved and carried into
    the next calls. Negative and missing amounts count nothing, as in spend_audit; runs without new calls keep theirs."""
    kind = calls.schema[amount].dataType
    counted = F.when(F.col(amount) >= 0, F.col(amount)).otherwise(F.lit(0).cast(kind))
    runs = [] if run is None else [run]
    rows = calls.select(*runs, counted.alias("total"))
    if carry is not None:
        rows = rows.unionByName(carry.select(*runs, "total"))
    wide = f"decimal({min(37, kind.precision + 10)},{kind.scale})" if isinstance(kind, T.DecimalType) else "double"
    return rows.groupBy(*runs).agg(F.coalesce(F.sum("total"), F.lit(0)).cast(wide).alias("total"))


def spend_audit(calls: DataFrame, cap: float, order: list[str], run: str | None = None, carry: DataFrame | None = None) -> DataFrame:
    """calls with running and status: charged; tripped, the first whose running total is above the cap
    (it is still charged); skipped after that; invalid for a negative or missing cost, which counts nothing.

    What has been spent is the running total of the tripped call; that of skipped ones is what it would
    have been. Decimal costs (with_cost) are compared exactly. With carry (totals_after of the calls before) the
    audit goes on where the last one ended: in a run that is above the cap already, all is skipped.
    """
    kind = calls.schema["cost"].dataType
    valid = F.coalesce(F.col("cost") >= 0, F.lit(False))
    marked = calls.withColumn("counted", F.when(valid, F.col("cost")).otherwise(F.lit(0).cast(kind)))
    rows = running_total(marked, order, run, "counted", carry)
    before = F.col("running") - F.col("counted")
    limit = F.lit(Decimal(str(cap)) + Decimal("1e-12")) if isinstance(kind, T.DecimalType) else F.lit(cap + 1e-12)
    status = F.when(~valid, "invalid").when(F.col("running") <= limit, "charged").when(before <= limit, "tripped").otherwise("skipped")
    return rows.withColumn("status", status).drop("counted")


def rate_audit(calls: DataFrame, rpm: int, ts: str = "ts", provider: str = "provider", seconds: int = 60, span: int = 600) -> DataFrame:
    """calls with in_window, the provider's calls in (ts - seconds, ts], and over (more than rpm; never if rpm <= 0).

    Calls of one time count each other. Windows are by provider and span of that many seconds: each
    call is also sent to the next span if it is in the last `seconds` of its own, so no task needs
    all calls of a provider, and a shorter span makes smaller tasks. It can't be below `seconds`.
    """
    if not 0 < seconds <= span:
        raise ValueError("a span must have as many seconds as the window, at least")
    width = span * 1_000_000
    rows = calls.withColumn("at", F.unix_micros(F.col(ts).cast("timestamp"))).withColumn("spell", F.floor(F.col("at") / width))
    copies = F.when(F.pmod(F.col("at"), F.lit(width)) >= width - seconds * 1_000_000, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    dealt = rows.withColumn("later", F.explode(copies)).withColumn("spell", F.col("spell") + F.col("later"))
    window = W.partitionBy(provider, "spell").orderBy("at").rangeBetween(-(seconds * 1_000_000 - 1), 0)
    counted = dealt.withColumn("in_window", F.count("*").over(window)).where("later = 0").drop("at", "spell", "later")
    return counted.withColumn("over", F.lit(rpm > 0) & (F.col("in_window") > rpm))
