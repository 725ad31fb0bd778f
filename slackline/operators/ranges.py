"""Running totals inside groups of any size: by ranges of a value first, inside a range afterwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that a group's values are cut into.
RANGES = 4096


def running(rows: DataFrame, group: str, value: str, order: list[str], n: Column, name: str, ranges: int = RANGES) -> DataFrame:
    """``rows`` with ``name``: the sum of ``n`` over the group's rows up to and including this one, by (value, order).

    A group's values, whole numbers, are cut into equal ranges, so its totals are few rows and its
    rows are sorted range by range, in as many tasks. Rows of equal value share a range: bring
    those together before, where one value may hold very many.
    """
    span = rows.groupBy(F.col(group).alias("group_")).agg(F.min(value).alias("lo_"), F.max(value).alias("hi_"))
    wide = (F.col("hi_") - F.col("lo_")).cast("decimal(20,0)") + 1
    at = (((F.col(value) - F.col("lo_")).cast("decimal(20,0)") * ranges) / wide).cast("int")
    placed = rows.join(span, F.col(group) == F.col("group_")).withColumn("range_", at).withColumn("n_", n).drop("lo_", "hi_", "group_")
    sums = placed.groupBy(F.col(group).alias("group_"), F.col("range_").alias("at_")).agg(F.sum("n_").alias("s_"))
    before = Window.partitionBy("group_").orderBy("at_").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("group_", "at_", F.coalesce(F.sum("s_").over(before), F.lit(0)).alias("base_"))
    within = Window.partitionBy(group, "range_").orderBy(value, *order).rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("within_", F.sum("n_").over(within))
    joined = placed.join(sums, (F.col(group) == F.col("group_")) & (F.col("range_") == F.col("at_")))
    return joined.withColumn(name, (F.col("base_") + F.col("within_")).cast("long")).drop("group_", "at_", "base_", "within_", "range_", "n_")
