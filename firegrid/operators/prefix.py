"""Running sums over an order that one task need not hold: range partitions, and an offset for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from firegrid.storage import stored


def running_sums(df: DataFrame, by: list[str], order: str, sums: dict[str, str]) -> DataFrame:
    """df with, for each new name in sums, the sum of a column over rows of the same `by` up to and including this one.

    Rows of one `by` differ in order. They lie in ranges of (by, order), written so that they stay; what is carried from
    range to range is a row for each range and value of by, at most as many as ranges and values of by together.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(df.repartitionByRange(parts, *by, order).withColumn("range__", F.spark_partition_id()), "ranges")
    carried = ranged.groupBy(*by, "range__").agg(*[F.sum(c).alias(f"{k}__") for k, c in sums.items()])
    before = Window.partitionBy(*by).orderBy("range__").rowsBetween(Window.unboundedPreceding, -1)
    offsets = carried.select(*by, "range__", *[F.coalesce(F.sum(f"{k}__").over(before), F.lit(0)).alias(f"{k}__") for k in sums])
    inside = Window.partitionBy(*by, "range__").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    own = ranged.withColumns({k: F.sum(c).over(inside) for k, c in sums.items()})
    joined = own.join(offsets, [*by, "range__"])
    return joined.withColumns({k: F.col(k) + F.col(f"{k}__") for k in sums}).drop("range__", *[f"{k}__" for k in sums])
