"""Covered stretches and gaps of overlapping intervals per entity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked_bounds(ranges: DataFrame, keys: list[str], bucket_width: int) -> DataFrame:
    """The distinct starts and the distinct ends of each entity with their ranks, each side ordered by itself.

    Returns keys, _side ("s" or "e"), _at, _rank and _total. Equal positions share one row: an end has the rank of its last, a start the
    number of starts in front of it, which is its first rank less one; _total is the number of ranges of the entity. Positions are
    counted on the map side and ranked in two levels, within buckets of bucket_width positions and over the buckets, so the order of one
    entity spreads over many tasks; over the buckets there is a row for each of at most 2^32 / bucket_width.
    """
    bounds = ranges.select(*keys, F.explode(F.array(F.struct(F.lit("s").alias("_side"), F.col("_s").alias("_at")), F.struct(F.lit("e").alias("_side"), F.col("_e").alias("_at")))).alias("_x"))
    bounds = bounds.select(*keys, "_x.*").withColumn("_bucket", F.floor(F.col("_at") / bucket_width))
    side = [*keys, "_side"]
    counted = bounds.groupBy(*side, "_bucket", "_at").agg(F.count("*").alias("_n"))
    per_bucket = bounds.groupBy(*side, "_bucket").agg(F.count("*").alias("_in_bucket"))
    over = Window.partitionBy(*side).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*side)
    carried = per_bucket.select(*side, "_bucket", F.coalesce(F.sum("_in_bucket").over(over), F.lit(0)).alias("_before"), F.sum("_in_bucket").over(whole).alias("_total"))
    upto = Window.partitionBy(*side, "_bucket").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    last = F.col("_before") + F.sum("_n").over(upto)
    ranked = counted.join(carried, [*side, "_bucket"]).withColumn("_last", last)
    return ranked.select(*side, "_at", F.when(F.col("_side") == "e", F.col("_last")).otherwise(F.col("_last") - F.col("_n")).alias("_rank"), "_total")


def spans_and_gaps(df: DataFrame, keys: list[str], first: str, last: str, bucket_width: int = 4096) -> DataFrame:
    """Maximal covered stretches ("span") and the uncovered ones between two of them ("gap"), per entity.

    Starts and ends are ordered independently. A gap follows the i-th end exactly if the next-ranked start, the (i+1)-th, lies beyond the line
    behind it. Of equal ends only the last can have one, for the start ranked behind another of them is not beyond their common
    line; and the start behind a gap is the first of its equals. So ends meet starts by one equi-join on rank. The first start and the
    last end are boundaries as well, and each boundary's start pairs with the next boundary's end to a period.

    A boundary's next one is found within buckets of bucket_width positions and, behind a bucket's last, over the buckets that hold any, so an
    entity with a third of all rows, all of them apart, is no task of its own.

    first and last are inclusive integers in either order; null last means first. Rows with a null first or a null key are left
    out, for they have no place. Equal rows count once or many times alike. An empty input gives no rows.
    Returns keys, span_kind, first_line, last_line (bigint).
    """
    a, b = F.col(first).cast("long"), F.coalesce(F.col(last), F.col(first)).cast("long")
    known = F.col(first).isNotNull()
    for key in keys:
        known = known & F.col(key).isNotNull()
    ranges = df.where(known).select(*keys, F.least(a, b).alias("_s"), F.greatest(a, b).alias("_e"))
    ranked = ranked_bounds(ranges, keys, bucket_width)
    at = lambda side: F.max(F.when(F.col("_side") == side, F.col("_at")))
    # the join on rank as one aggregation: an end and the start of one rank are at most one row each
    met = ranked.groupBy(*keys, "_rank").agg(at("e").alias("_close"), at("s").alias("_open"), F.max("_total").alias("_total"))
    gap = F.col("_open") > F.col("_close") + 1
    edges = met.where(gap | (F.col("_rank") == 0) | (F.col("_rank") == F.col("_total")))
    edges = edges.withColumn("_bucket", F.floor(F.coalesce("_close", "_open") / bucket_width))
    per_bucket = edges.groupBy(*keys, "_bucket").agg(F.min("_close").alias("_first_close"))
    behind = Window.partitionBy(*keys).orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    carried = per_bucket.select(*keys, "_bucket", F.min("_first_close").over(behind).alias("_later_close"))
    along = Window.partitionBy(*keys, "_bucket").orderBy("_rank")
    paired = edges.join(carried, [*keys, "_bucket"]).withColumn("_next", F.coalesce(F.lead("_close").over(along), F.col("_later_close")))
    span = F.when(F.col("_open").isNotNull(), F.struct(F.lit("span").alias("span_kind"), F.col("_open").alias("first_line"), F.col("_next").alias("last_line")))
    hole = F.when(gap, F.struct(F.lit("gap").alias("span_kind"), (F.col("_close") + 1).alias("first_line"), (F.col("_open") - 1).alias("last_line")))
    out = paired.select(*keys, F.explode(F.array_compact(F.array(span, hole))).alias("_x"))
    return out.select(*keys, "_x.*")
