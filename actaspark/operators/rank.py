"""Row numbers and top rows of groups of any size.

A group is spread over ranges of its order; counts of the ranges give each range's offset, and rows are numbered within
ranges. So the largest sort is that of one range, whatever share of the rows one group holds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from actaspark.storage import materialise


def row_number(df: DataFrame, group: Sequence[str], order: Sequence[Column], out: str) -> DataFrame:
    """df with ``out``: each row's place in its group, from 1. order must leave no ties. Null group parts are values like others."""
    parts = materialise(df.repartitionByRange(*[F.col(g) for g in group], *order).withColumn("_range", F.spark_partition_id()), "ranks")
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    start = parts.groupBy(*group, "_range").agg(F.count(F.lit(1)).alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    start = start.select(F.col("_range").alias("_r2"), "_start", *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)])
    same = F.col("_range") == F.col("_r2")
    for i, g in enumerate(group):
        same &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    w = Window.partitionBy(*group, "_range").orderBy(*order)
    n = parts.withColumn("_k", F.row_number().over(w)).join(start, same)
    return n.select(*df.columns, (F.col("_k") + F.col("_start")).cast("int").alias(out))


def top(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, out: str, salts: int = 64) -> DataFrame:
    """The first k rows of each group with their place. Each of ``salts`` parts of a group is cut to k rows before they meet."""
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(salts))
    w = Window.partitionBy(*group, "_salt").orderBy(*order)
    few = df.withColumn("_salt", salt).withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k)
    whole = Window.partitionBy(*group).orderBy(*order)
    return few.withColumn(out, F.row_number().over(whole)).where(F.col(out) <= k).select(*df.columns, out)
