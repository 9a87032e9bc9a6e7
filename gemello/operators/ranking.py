"""Global row numbers without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gemello.session import written


def global_row_number(rows: DataFrame, key: str, name: str) -> DataFrame:
    """rows with name, their place from 1 in the order of key.

    Rows are dealt by ranges of the key and written, so that a range is a fixed set; a row's number is that in its range plus the rows
    of the ranges before, a sum over one small row for each range.
    """
    dealt = written(rows.repartitionByRange(key).withColumn("_range", F.spark_partition_id()), "ranked")
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(key))
    return dealt.join(before, "_range").withColumn(name, own + F.col("_before")).drop("_range", "_before")
