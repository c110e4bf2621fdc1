"""Positions and running sums in a global order, by ranges: no task sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.sources.tables import checkpointed


def _dealt(df: DataFrame, keys: list[Column]) -> DataFrame:
    """Written table of the rows with `_part`, the number of their range of the order."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return checkpointed(df.repartitionByRange(parts, *keys).withColumn("_part", F.spark_partition_id()))


def numbered(df: DataFrame, *keys: str, out: str = "pos") -> DataFrame:
    """`df` with each row's place, from 0, in ascending order of the keys, which must tell all rows apart."""
    return running_sum(df.withColumn("_one", F.lit(1).cast("long")), "_one", *map(F.col, keys), out=out).withColumn(out, F.col(out) - 1).drop("_one")


def running_sum(df: DataFrame, value: str, *keys: Column, out: str = "running") -> DataFrame:
    """`df` with the sum of `value` over all rows up to this one in the order of the keys, this one included."""
    dealt = _dealt(df, list(keys))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("_part").agg(F.sum(value).alias("_total")).withColumn("_before", F.coalesce(F.sum("_total").over(before), F.lit(0)))  # a row a range
    inside = Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = dealt.join(F.broadcast(totals.drop("_total")), "_part")
    return joined.withColumn(out, F.sum(value).over(inside) + F.col("_before")).drop("_part", "_before")
