"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Every source gets a target of words. A document's wanted copies are the source's target over
its words (times an optional weight of the document). The whole part is allocated for certain;
the fraction is the inclusion probability p of one more copy. For that copy documents are
ranked by (u / (1 - u)) / (p / (1 - p)), u being a fixed hash of the document's id, and taken in
this order until the source's remaining words are reached (the last one only if it brings the
sum nearer).

The cut in that order is found without sorting a source in one task: scores fall into
``BUCKETS`` equal steps of q / (1 + q), a histogram per source gives the step that holds the cut,
first among coarse steps of ``COARSE`` steps each and then within one, and only the rows of that
step are put in order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import quoted, table, without, word_count, written

BUCKETS, COARSE = 65536, 256


def targets(sized: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, n, source_size, mass, target of every source.

    sized has source, size and mass (size times the document's weight). Sources in order of
    code points, null last, weigh ``weights`` repeating, and share ``share`` of all sizes. No
    target is above ``most`` times its source's size: with the level at which sources that
    are not capped stand, target = min(most * size, level * weight), and the level is the
    first one, over sources by most * size / weight, that caps exactly those below it.
    """
    all_rows = W.partitionBy()
    by_cap = all_rows.orderBy("cap_level", "rank")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    return (
        sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum("mass").alias("mass"))
        .withColumn("rank", F.row_number().over(all_rows.orderBy(F.col("source").asc_nulls_last())))
        .withColumn("weight", w)
        .withColumn("cap", F.lit(float(most)) * F.col("source_size"))
        .withColumn("cap_level", F.col("cap") / F.col("weight"))
        .withColumn("open_weight", F.sum("weight").over(by_cap.rowsBetween(W.currentRow, W.unboundedFollowing)))
        .withColumn("capped", F.coalesce(F.sum("cap").over(by_cap.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("total", F.sum("source_size").over(all_rows.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) * F.lit(float(share)))
        .withColumn("level_here", (F.col("total") - F.col("capped")) / F.col("open_weight"))
        .withColumn("level", F.min(F.when(F.col("level_here") <= F.col("cap_level"), F.struct("cap_level", "rank", "level_here"))).over(all_rows.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))["level_here"])
        .withColumn("target", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))))
        .select("source", "source_size", "mass", "target")
    )


def uniform(doc_id: Column, seed: int) -> Column:
    """A number in (0, 1) fixed by the id and the seed: 52 bits of an MD5."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f":{seed}")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(4503599627370496.0)


def _scored(rows: DataFrame, most: float) -> DataFrame:
    """Adds certain (whole copies), q (Pareto score, null where there is no fraction) and bucket."""
    wanted = F.when(F.col("mass_sum") > 0, F.least(F.lit(float(most)), F.col("target") * F.col("doc_weight") / F.col("mass_sum"))).otherwise(F.lit(0.0))
    p = F.col("wanted") - F.col("certain")
    return (
        rows.withColumn("wanted", wanted)
        .withColumn("certain", F.floor("wanted"))
        .withColumn("q", F.when((p > 0) & (F.col("size") > 0), F.col("u") / (1 - F.col("u")) * ((1 - p) / p)))
        .withColumn("bucket", F.least(F.lit(BUCKETS - 1), F.floor(F.lit(BUCKETS) * (F.col("q") / (1 + F.col("q"))))))
    )


def mix(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 0, weight_col: str | None = None, keep_rows: bool = True) -> DataFrame:
    """docs with the columns size, source_size, target and copies (0 to ``most``) added.

    Sizes are words. A null or empty text has size 0: it keeps its certain copies, which add no
    words, and gets no more. A null source is a source of its own. Of repeated rows (same source,
    id and size) at the cut as many are taken as fit, whichever they are. Columns of docs that have the added names are replaced;
    other extra columns stay. weight_col, if given, names a non-negative weight of each document
    within its source (null: 0); a document whose wanted copies would exceed ``most`` stays
    there. keep_rows=False returns doc_id, source and the added columns alone, without a second
    scan of the texts. An empty table gives an empty result.
    """
    weight = F.greatest(F.coalesce(F.col(weight_col).cast("double"), F.lit(0.0)), F.lit(0.0)) if weight_col else F.lit(1.0)
    keyed = docs.select(
        "doc_id", "source", word_count(F.col("text")).alias("size"), uniform(F.col("doc_id"), seed).alias("u"),
        weight.alias("doc_weight"), F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"),
    )
    narrow = written(without(keyed, "row"), "mix-sizes")
    cuts = _cuts(narrow, weights, share, most)
    added = ["size", "source_size", "target", "copies"]
    if not keep_rows:
        return _copies(narrow, cuts, most).select("doc_id", "source", *added)
    own = [F.col(f"row.{quoted(c)}") for c in docs.columns if c.lower() not in added]
    return _copies(keyed, cuts, most).select(*own, *added)


def _copies(rows: DataFrame, cuts: DataFrame, most: int) -> DataFrame:
    """Joins the sources' targets and cuts and decides on the copies of each row."""
    c = cuts.withColumnRenamed("source", "cut_source")
    joined = _scored(rows.join(c, rows["source"].eqNullSafe(c["cut_source"]), "left"), most)
    place = F.struct(F.col("q"), F.col("doc_id"), F.col("size"))
    more = F.when(F.col("q").isNotNull() & F.col("cut").isNotNull() & (place <= F.col("cut")), 1).otherwise(0)
    decided = joined.withColumn("copies", (F.col("certain") + more).cast("long"))
    if cuts.where("n_last < n_tied").isEmpty():
        return decided
    split = F.col("q").isNotNull() & F.coalesce(F.col("n_last") < F.col("n_tied"), F.lit(False)) & F.coalesce(place == F.col("cut"), F.lit(False))
    # the tied rows are numbered by the task that wrote them, and within it
    tied = written(decided.where(split).withColumn("task", F.spark_partition_id()), "mix-tied")
    earlier = W.partitionBy("source").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    counts = tied.groupBy("source", "task").agg(F.count("*").alias("n")).select(
        F.col("source").alias("n_source"), F.col("task").alias("n_task"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n_before")
    )
    numbered = tied.withColumn("number", F.row_number().over(W.partitionBy("source", "task").orderBy("u")))
    numbered = numbered.join(counts, numbered["source"].eqNullSafe(counts["n_source"]) & (numbered["task"] == counts["n_task"]))
    copies = (F.col("certain") + F.when(F.col("number") + F.col("n_before") <= F.col("n_last"), 1).otherwise(0)).cast("long")
    return decided.where(~split).unionByName(numbered.withColumn("copies", copies).select(*decided.columns))


def _last_step(rows: DataFrame, key: str) -> DataFrame:
    """source, step: the last step that begins before the words of rest are reached, with the words before it."""
    earlier = W.partitionBy("source").orderBy(F.col(key).asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    words = F.when(F.col(key).isNotNull(), F.col("words"))
    return (
        rows.withColumn("before", F.col("base") + F.coalesce(F.sum(words).over(earlier), F.lit(0)))
        .where(F.col(key).isNotNull() & (F.col("before") < F.col("rest")))
        .groupBy("source").agg(F.max_by(F.struct(key, "before", "rest"), key).alias("step"))
    )


def _cuts(narrow: DataFrame, weights: Sequence[int], share: float, most: int) -> DataFrame:
    """For each source its target and its cut: the last place taken, with how many of the rows that tie there (n_last of n_tied)."""
    goal = written(targets(narrow.withColumn("mass", F.col("size") * F.col("doc_weight")), weights, share, most), "mix-targets").withColumnsRenamed({"source": "cut_source", "mass": "mass_sum"})
    scored = _scored(narrow.join(goal, narrow["source"].eqNullSafe(goal["cut_source"])), most)
    histogram = scored.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.sum(F.col("certain") * F.col("size")).alias("sure"), F.max("target").alias("target"))
    histogram = written(histogram.withColumn("coarse", F.floor(F.col("bucket") / COARSE)), "mix-histogram")
    coarse = histogram.groupBy("source", "coarse").agg(F.sum("words").alias("words"), F.sum("sure").alias("sure"), F.max("target").alias("target"))
    coarse = coarse.withColumn("rest", F.col("target") - F.sum("sure").over(W.partitionBy("source"))).withColumn("base", F.lit(0).cast("long"))
    wide = written(_last_step(coarse, "coarse").select(F.col("source").alias("wide_source"), "step"), "mix-wide-steps")
    fine = histogram.join(wide, histogram["source"].eqNullSafe(wide["wide_source"]) & (histogram["coarse"] == F.col("step.coarse")))
    fine = fine.select("source", "bucket", "words", F.col("step.before").alias("base"), F.col("step.rest").alias("rest"))
    step = _last_step(fine, "bucket").withColumnRenamed("source", "step_source")
    step = written(step, "mix-steps")
    edge = scored.join(step, scored["source"].eqNullSafe(step["step_source"]) & (scored["bucket"] == F.col("step.bucket")))
    # rows that tie count as one place; i of them fit while i * size - size / 2 is below the words left
    edge = edge.where(F.col("q").isNotNull()).groupBy("source", "q", "doc_id", "size").agg(F.count("*").alias("n_tied"), F.first("step").alias("step"))
    sorted_edge = W.partitionBy("source").orderBy("q", "doc_id", "size")
    earlier = F.sum(F.col("size") * F.col("n_tied")).over(sorted_edge.rowsBetween(W.unboundedPreceding, -1))
    left = F.col("step.rest") - F.col("step.before") - F.col("earlier")
    taken = (
        edge.withColumn("earlier", F.coalesce(earlier, F.lit(0)))
        .where(F.col("earlier") + F.col("size") / 2 < F.col("step.rest") - F.col("step.before"))
        .withColumn("n_last", F.greatest(F.lit(1), F.least(F.col("n_tied"), F.ceil(left / F.col("size") + 0.5) - 1)))
        .groupBy(F.col("source").alias("last_source"))
        .agg(F.max(F.struct("q", "doc_id", "size")).alias("last"), F.max_by(F.struct("n_last", "n_tied"), F.struct("q", "doc_id", "size")).alias("tie"))
    )
    # no row of the step may fit: then the cut lies just below it
    cuts = (
        goal.join(step, goal["cut_source"].eqNullSafe(step["step_source"]), "left")
        .join(taken, goal["cut_source"].eqNullSafe(taken["last_source"]), "left")
        .select(
            F.col("cut_source").alias("source"), "source_size", "mass_sum", "target",
            F.coalesce(
                F.col("last"),
                F.when(F.col("step").isNotNull(), F.struct((F.col("step.bucket") / (F.lit(float(BUCKETS)) - F.col("step.bucket"))).alias("q"), F.lit(None).cast(narrow.schema["doc_id"].dataType).alias("doc_id"), F.lit(None).cast("long").alias("size"))),
            ).alias("cut"),
            "tie.n_last", "tie.n_tied",
        )
    )
    return written(cuts, "mix-cuts")


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    """What the mix takes of every document; for nulls, empty texts and ties see mix. targets works on one row a
    source in one task: up to some hundred thousand sources."""
    mixed = mix(table(spark, sf_dir, "documents"), keep_rows=False)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':0'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM s),
w AS (SELECT *, CASE (rk - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, 2.0::DOUBLE * source_size AS cap FROM r),
l AS (
  SELECT *, cap / weight AS cap_level,
    (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY cap / weight, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level_here
  FROM w),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT level_here FROM l WHERE level_here <= cap_level ORDER BY cap_level, rk LIMIT 1) * weight, cap)) AS target FROM l),
c AS (
  SELECT doc_id, d.source, size, u, source_size, target,
    CASE WHEN source_size > 0 THEN least(2.0::DOUBLE, target * 1.0::DOUBLE / source_size::DOUBLE) ELSE 0.0::DOUBLE END AS wanted
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, floor(wanted) AS certain, wanted - floor(wanted) AS p FROM c),
q AS (SELECT *, CASE WHEN p > 0 AND size > 0 THEN u / (1 - u) * ((1 - p) / p) END AS q,
        target - sum(floor(wanted) * size) OVER (PARTITION BY source) AS rest FROM p),
o AS (SELECT *, sum(CASE WHEN q IS NOT NULL THEN size END) OVER (PARTITION BY source ORDER BY q NULLS LAST, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM q)
SELECT doc_id, size, source_size, target,
  ((certain + CASE WHEN q IS NOT NULL AND upto - size / 2.0::DOUBLE < rest THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM o
"""
