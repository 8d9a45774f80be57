"""Running sums over an order without putting all rows into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import written


def sum_before(df: DataFrame, value: str, *order: str, out: str = "before") -> DataFrame:
    """``df`` with the sum of ``value`` over all rows before each one, in ``order`` (a key).

    Rows are dealt by range; each range sums by itself, and the ranges' totals, one row
    each, are summed up and added.
    """
    dealt = written(df.repartitionByRange(*(F.col(c) for c in order)).withColumn("_part", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("_part").agg(F.sum(value).alias("_sum"))
    starts = totals.select(F.col("_part").alias("_p"), (F.sum("_sum").over(Window.orderBy("_part")) - F.col("_sum")).alias("_start"))  # one row for each range
    inner = Window.partitionBy("_part").orderBy(*order)
    own = F.sum(value).over(inner) - F.col(value)
    return dealt.withColumn("_own", own).join(F.broadcast(starts), F.col("_part") == F.col("_p")).withColumn(out, F.col("_own") + F.col("_start")).drop("_part", "_p", "_own", "_start")
