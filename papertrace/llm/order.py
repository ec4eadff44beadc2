"""Running totals over a whole ordered table, without one task for all of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut


def running_totals(df: DataFrame, by: list[str], value: str, before: str, place: str, group: str | None = None) -> DataFrame:
    """df with `before`, the sum of `value` over all rows that stand earlier in the order `by` (within rows of
    equal `group`, which leads `by`), and `place`, their number.

    The rows are dealt by range, stored, and summed per range; the few sums are added up, and each range adds
    its own rows to what stands before it. `by` must tell rows apart for the order to be one. JVM only."""
    groups = [group] if group else []
    ranged = cut(df.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()))
    sums = ranged.groupBy("_range", *groups).agg(F.sum(value).alias("_sum"), F.count(F.lit(1)).alias("_rows"))
    # a row per range and group, at most ranges + groups of them
    earlier = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_range", *groups, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"), F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_place"))
    own = Window.partitionBy("_range", *groups).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.withColumn("_own", F.coalesce(F.sum(value).over(own), F.lit(0))).withColumn("_at", F.coalesce(F.count(F.lit(1)).over(own), F.lit(0)))
    match = [F.col("_r2") == F.col("_range"), *(F.col("_g2").eqNullSafe(F.col(g)) for g in groups)]
    sums = sums.select(F.col("_range").alias("_r2"), *(F.col(g).alias("_g2") for g in groups), "_before", "_place")
    out = out.join(sums, match)
    return out.select(*df.columns, (F.col("_own") + F.col("_before")).cast("long").alias(before), (F.col("_at") + F.col("_place")).cast("long").alias(place))
