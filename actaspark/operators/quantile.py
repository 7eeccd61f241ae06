"""Exact medians of many groups, none of which has to fit into one task.

The input is a value-count table (group columns, value, count). It is range-partitioned by group and
value; sums of counts per range give each range's offset, so that only the ranges holding a group's
middle ranks are read again and ordered. A group of any size is thus spread over as many tasks as it
has ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from actaspark.storage import materialise


def grouped_median(df: DataFrame, group: list[str], value: str, count: str, out: str = "median") -> DataFrame:
    """One row per group: group columns, ``out`` (mean of the two middle values; null values do not count).

    Groups without non-null values give no row. Counts must be positive. Ties and repeated value rows are
    allowed: repeated rows add up.
    """
    v = df.where(F.col(value).isNotNull() & (F.col(count) > 0)).select(*group, F.col(value).cast("double").alias("_v"), F.col(count).cast("long").alias("_n"))
    v = v.groupBy(*group, "_v").agg(F.sum("_n").alias("_n"))
    parts = materialise(v.repartitionByRange(*[F.col(g) for g in group], F.col("_v")).withColumn("_p", F.spark_partition_id()), "ranges")
    sums = parts.groupBy(*group, "_p").agg(F.sum("_n").alias("_s"))
    before = Window.partitionBy(*group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    sums = sums.select(*group, "_p", "_s", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_o"), F.sum("_s").over(whole).alias("_t"))
    low, high = F.floor((F.col("_t") - 1) / 2) + 1, F.floor(F.col("_t") / 2) + 1
    wanted = sums.where((F.col("_o") < high) & (F.col("_o") + F.col("_s") >= low))
    run = Window.partitionBy(*group, "_p").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    near = parts.join(wanted, [*group, "_p"]).withColumn("_c", F.col("_o") + F.sum("_n").over(run))
    holds = lambda rank: (F.col("_c") >= rank) & (F.col("_c") - F.col("_n") < rank)
    return near.groupBy(*group).agg(((F.max(F.when(holds(low), F.col("_v"))) + F.max(F.when(holds(high), F.col("_v")))) / 2).alias(out))
