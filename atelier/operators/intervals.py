"""Joins on order: intervals that overlap, intervals that hold a value, the nearest row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bins(lo: Column, hi: Column, width: int) -> Column:
    return F.explode(F.sequence(F.floor(lo / width), F.floor(hi / width)))


def overlapping(a: DataFrame, b: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Pairs of rows of a (keys, a_lo, a_hi, more) and b (keys, b_lo, b_hi, more) with equal
    keys whose closed intervals overlap. They meet in bins of a width, which should be about
    an interval's length, and a pair counts in the first bin that both are in, once."""
    left = a.withColumn("_bin", _bins(F.col("a_lo"), F.col("a_hi"), width))
    right = b.withColumn("_bin", _bins(F.col("b_lo"), F.col("b_hi"), width))
    met = left.join(right, [*keys, "_bin"])
    first = F.greatest(F.floor(F.col("a_lo") / width), F.floor(F.col("b_lo") / width))
    return met.where((F.col("a_lo") <= F.col("b_hi")) & (F.col("b_lo") <= F.col("a_hi")) & (F.col("_bin") == first)).drop("_bin")


def within(rows: DataFrame, value: str, bands: DataFrame, width: int) -> DataFrame:
    """rows with each band (lo, hi, more) that holds their value; rows outside all go."""
    held = bands.withColumn("_bin", _bins(F.col("lo"), F.col("hi"), width))
    met = rows.withColumn("_bin", F.floor(F.col(value) / width)).join(held, "_bin")
    return met.where(F.col(value).between(F.col("lo"), F.col("hi"))).drop("_bin", "lo", "hi")


def nearest(rows: DataFrame, others: DataFrame, keys: list[str], at: str, width: int) -> DataFrame:
    """rows with `near`, the nearest value of others' column `at` under equal keys, the smaller
    of two that are as near, null where there is none.

    Both tables are put in one order, in which each row carries the last and the next value of
    others. The order is cut into stretches of a width, so that a key with most rows is many
    tasks: a stretch takes what is before and after it from a small table of stretches.
    """
    columns = rows.columns
    values = others.select(*keys, F.col(at).alias("_v")).where("_v IS NOT NULL").distinct()
    part = [*keys, "_s"]
    stretch = lambda c: F.floor(F.col(c) / width)
    ends = rows.select(*keys, stretch(at).alias("_s")).distinct().withColumns({"_lo": F.lit(None).cast("double"), "_hi": F.lit(None).cast("double")})
    ends = ends.unionByName(values.groupBy(*keys, stretch("_v").alias("_s")).agg(F.min("_v").cast("double").alias("_lo"), F.max("_v").cast("double").alias("_hi")))
    ends = ends.groupBy(*part).agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    by_key = Window.partitionBy(*keys).orderBy("_s")
    before, after = by_key.rowsBetween(Window.unboundedPreceding, -1), by_key.rowsBetween(1, Window.unboundedFollowing)
    ends = ends.select(*part, F.last("_hi", True).over(before).alias("_before"), F.first("_lo", True).over(after).alias("_after"))
    tagged = rows.withColumns({"_v": F.lit(None).cast("double"), "_x": F.col(at).cast("double"), "_s": stretch(at)})
    both = tagged.unionByName(values.select(*keys, F.col("_v").cast("double").alias("_v"), F.col("_v").cast("double").alias("_x"), stretch("_v").alias("_s")), allowMissingColumns=True)
    inside = Window.partitionBy(*part).orderBy("_x")
    carried = both.withColumns({
        "_last": F.last("_v", True).over(inside.rangeBetween(Window.unboundedPreceding, Window.currentRow)),
        "_next": F.first("_v", True).over(inside.rangeBetween(Window.currentRow, Window.unboundedFollowing)),
    }).where("_v IS NULL")
    whole = carried.join(ends, part, "left")
    last, following = F.coalesce("_last", "_before"), F.coalesce("_next", "_after")
    near = F.when(following.isNull() | (F.col("_x") - last <= following - F.col("_x")), last).otherwise(following)
    return whole.select(*columns, F.coalesce(near, last, following).alias("near"))
