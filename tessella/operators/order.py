"""Places and running totals in an order that no single task could hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .lookup import attach


def running_total(df: DataFrame, by: list[str], order: list[str], value: Column | None = None, name: str = "before") -> DataFrame:
    """`df` with `name`: the sum of `value` (none: the number) of the rows that come before in
    `order` within the group `by`.

    A group may hold all rows: they are laid out in ranges of (by, order), as a table,
    because ranges may differ when they are drawn again. Sums within a range are added to
    those of the ranges before, of which a group has at most as many as the session
    shuffles into. `order` has to be unique within a group for a definite result; nulls of
    `order` come first, null values count 0, a null in `by` takes the row out."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    v = F.coalesce(value, F.lit(0)) if value is not None else F.lit(1)
    keyed = df.dropna(subset=by) if by else df
    laid = written(keyed.withColumn("__v", v.cast("long")).repartitionByRange(n, *by, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    within = Window.partitionBy(*by, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = laid.groupBy(*by, "__range").agg(F.sum("__v").alias("__s")).withColumn("__o", F.coalesce(F.sum("__s").over(earlier), F.lit(0))).drop("__s")
    local = laid.withColumn("__l", F.coalesce(F.sum("__v").over(within), F.lit(0)))
    return attach(local, sums, [*by, "__range"]).withColumn(name, F.col("__l") + F.col("__o")).select(*df.columns, name)
