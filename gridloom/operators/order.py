"""Running sums in a total order of all rows, without a task that holds them all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.sources.store import kept


def running(df: DataFrame, keys: Sequence[str], order: Sequence[Column], weight: Column | None = None) -> DataFrame:
    """Adds _before, the weight (default: number) of a group's rows before each row, and _all, that of the group.

    Rows are dealt by ranges of the keys and the order, summed up within a range, and shifted by the
    ranges before: a group of most rows is spread as well. The order is total within a group. The
    dealt rows are a table of their own, since ranges are drawn anew whenever they are computed.
    """
    weighed = df.withColumn("_w", F.lit(1).cast("long") if weight is None else weight)
    dealt = kept(weighed.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    so_far = Window.partitionBy(*keys).orderBy("_range")
    whole = so_far.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sizes = dealt.groupBy(*keys, "_range").agg(F.sum("_w").alias("_size"))  # a row for each range that a group is in
    starts = sizes.select(*keys, "_range", (F.sum("_size").over(so_far) - F.col("_size")).alias("_start"), F.sum("_size").over(whole).alias("_all"))
    within = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.withColumn("_inside", F.coalesce(F.sum("_w").over(within), F.lit(0)))
    return summed.join(starts, [*keys, "_range"]).withColumn("_before", F.col("_start") + F.col("_inside")).drop("_w", "_range", "_start", "_inside")
