"""Mixing sources to target weights, in DataFrame operations only.

A document gets one copy more than the whole part of its source's rate with a
probability equal to the fraction, by a draw seeded with a hash.  Draws that know
nothing of each other leave a source of few documents far from its target (half
of it, for 50), so the draws of a source are taken from one line: its documents
in hash order, each as long as it has words, and a point within each by another
part of its hash.  Points in the first part of the line, as long as the fraction
asks for, are copies.  A source's words then miss its target by the one document
in which the line is cut, at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import WORD, Scratch, load

#: Weights of the sources by code point, repeating, and the most copies of a document.
WEIGHTS = (5, 2, 1)
MOST = 3
#: A table of so many sources is sent to every executor; a larger one is joined with salted keys.
MAX_BROADCAST = 50_000
SALTS = 32
#: Hex digits of a document's place in its source's line, of the point within the document, and of the steps that narrow down the cut.
PLACE, POINT = 15, 8
STEPS = (2, 4, 6, 8, PLACE)


def n_words(text):
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """Targets of ``(source, source_size)``: shares of the total by weight, at most MOST times the source.

    What a source can't take goes to the others by weight: there is one level
    such that each target is the lesser of its cap and level * weight.  With
    sources in order of cap / weight, the level follows from running sums: it is
    that of the first source that it doesn't fill, and levels only fall after.
    """
    weights = F.array(*map(F.lit, WEIGHTS))
    ranked = sizes.withColumn("rank_", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    capped = ranked.select(
        "source",
        "source_size",
        F.get(weights, F.col("rank_") % len(WEIGHTS)).alias("weight"),
        (F.col("source_size") * MOST).alias("cap"),
        "rank_",
    )
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank_")
    below, above = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(below), F.lit(0))) / F.sum("weight").over(above)
    leveled = capped.withColumn("level_", level)
    fits = F.when(F.col("level_") * F.col("weight") <= F.col("cap"), F.col("level_"))
    return leveled.withColumn("level", F.max(fits).over(everything)).select(
        "source",
        "source_size",
        F.coalesce(F.least(F.col("level") * F.col("weight"), F.col("cap").cast("double")), F.lit(0.0)).alias("target"),
    )


def _digits(name, first: int, n: int):
    return F.conv(F.substring(name, first, n), 16, 10).cast("long")


def _beside(rows: DataFrame, side: DataFrame, few: bool) -> DataFrame:
    """``rows`` with what ``side`` has for their sources; a large side is joined by salted keys, as one source may have most rows."""
    side = side.withColumnRenamed("source", "source_")
    same = F.col("source").eqNullSafe(F.col("source_"))
    if few:
        return rows.join(F.broadcast(side), same).drop("source_")
    salted = side.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod("place_", F.lit(SALTS))).join(salted, same & (F.col("salt") == F.col("salt_"))).drop("salt", "salt_", "source_")


def source_cuts(placed: DataFrame, rates: DataFrame, few: bool, scratch: Scratch) -> DataFrame:
    """(source, cut_, before_): the place in each source's line where the fraction ends, and the words before it.

    ``placed(source, place_, size)``; only sources that have a fraction.  Each step
    adds up words by two more digits of the place, where the digits so far are
    those of the cut: some 256 sums a source, and at the last what is left.
    """
    cuts, digits = None, 0
    for step in STEPS:
        start = rates.filter("want_ > 0").select("source", "want_", F.lit(0).cast("long").alias("held_"), F.lit(0).cast("long").alias("start_")) if cuts is None else cuts
        rows = _beside(placed, start, few).filter(F.shiftright("place_", 4 * (PLACE - digits)) == F.col("held_"))
        cell = F.shiftright("place_", 4 * (PLACE - step)).alias("cell_")
        sums = rows.groupBy("source", cell, "want_", "start_").agg(F.sum("size").alias("s_"))
        before = Window.partitionBy("source").orderBy("cell_").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("before_", F.col("start_") + F.coalesce(F.sum("s_").over(before), F.lit(0)))
        crossing = sums.filter((F.col("before_") <= F.col("want_")) & (F.col("want_") < F.col("before_") + F.col("s_")))
        cuts = scratch.save(crossing.select("source", "want_", F.col("cell_").alias("held_"), F.col("before_").alias("start_")))
        digits = step
    return cuts.select("source", F.col("held_").alias("cut_"), F.col("start_").alias("before_"))


def mix_counts(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """``docs`` with size, source_size, target and copies of each row.

    The rate of a source is its target over its size; a document gets floor(rate)
    copies, and one more as the module's docstring tells.  Null text has no words;
    a null source is a source of its own.  Rows of one doc_id and text have one
    place and get the same number of copies each, so a source misses its target by
    all of them if the cut falls there.  Columns of docs of these names go.
    """
    docs = docs.drop("size", "source_size", "target", "copies", "place_", "point_", "rate_", "want_", "cut_", "before_")
    text = F.coalesce(F.col("text"), F.lit(""))
    name = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(text.cast("binary"))).cast("binary"))
    point = _digits(name, PLACE + 1, POINT) / F.lit(float(16**POINT))
    sized = docs.withColumn("size", n_words(F.col("text"))).withColumn("place_", _digits(name, 1, PLACE))
    scratch = Scratch(docs.sparkSession)
    placed = scratch.save(sized.select("source", "place_", "size"))
    rates = source_targets(placed.groupBy("source").agg(F.sum("size").alias("source_size")))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(MOST)))).otherwise(F.lit(1.0))
    rates = rates.withColumn("rate_", rate).withColumn("want_", (F.col("rate_") - F.floor("rate_")) * F.col("source_size"))
    rates = scratch.save(rates)
    few = rates.count() <= MAX_BROADCAST
    cuts = source_cuts(placed, rates, few, scratch)
    cuts = cuts.withColumnRenamed("source", "cut_source_")
    cut = rates.join(cuts, F.col("source").eqNullSafe(F.col("cut_source_")), "left").drop("cut_source_")
    joined = _beside(sized.withColumn("point_", point), cut, few)
    within = (F.col("place_") < F.col("cut_")) | ((F.col("place_") == F.col("cut_")) & (F.col("before_") + F.col("point_") * F.col("size") < F.col("want_")))
    extra = (F.col("want_") > 0) & F.coalesce(within, F.lit(True))  # no cut: the fraction is the whole line
    copies = F.floor("rate_") + extra.cast("long")
    return joined.withColumn("copies", copies).drop("place_", "point_", "rate_", "want_", "cut_", "before_")


def mix_documents(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The mix itself: every row as often as mix_counts says, with the columns of ``docs``."""
    packed = docs.select("doc_id", "text", "source", F.struct("*").alias("row_"))
    copy = F.explode(F.sequence(F.lit(1), F.col("copies")))
    return mix_counts(packed, seed).filter("copies > 0").withColumn("copy_", copy).select("row_.*")


def op2_mixing(spark, sf_dir):
    mixed = mix_counts(load(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS name FROM documents
), sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rank_
  FROM sized GROUP BY source
), capped AS (
  SELECT *, CASE rank_ % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 3 AS cap FROM sizes
), leveled AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(weight) OVER (ORDER BY cap / weight, rank_ ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level_
  FROM capped
), targets AS (
  SELECT source, source_size, coalesce(least(max(CASE WHEN level_ * weight <= cap THEN level_ END) OVER () * weight, cap::DOUBLE), 0.0) AS target
  FROM leveled
), placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, ('0x' || substr(s.name, 16, 8))::BIGINT / 4294967296.0::DOUBLE AS point,
    CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, 3.0::DOUBLE) ELSE 1.0::DOUBLE END AS rate,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY ('0x' || substr(s.name, 1, 15))::BIGINT RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (floor(rate)::BIGINT + (before + point * size < (rate - floor(rate)) * source_size)::BIGINT) * size AS taken FROM placed
"""
