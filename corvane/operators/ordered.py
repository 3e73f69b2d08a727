"""Neighbours and running counts in a global order, split by range.

A window over a key puts all of a hot key into one task. Here rows are range-partitioned
by key and position, so a hot key spans many partitions; what crosses a partition border
is one row for each partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.session import through_table


def ranged(df: DataFrame, key: str, seq: str) -> DataFrame:
    """Rows with ``_range``, the number of their range; fixed by writing them once."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, key, seq).withColumn("_range", F.spark_partition_id())
    return through_table(placed, "ranged")


def with_previous(rows: DataFrame, key: str, seq: str, value: str, out: str) -> DataFrame:
    """Add the ``value`` of the row before of the same key to ``ranged`` rows, else NULL."""
    window = Window.partitionBy("_range").orderBy(key, seq)
    last = rows.groupBy("_range").agg(F.max(F.struct(key, seq, F.col(value).alias("_value"))).alias("_last"))
    border = last.select("_range", F.lag("_last").over(Window.orderBy("_range")).alias("_border"))
    before = F.coalesce(
        F.lag(F.struct(key, F.col(value).alias("_value"))).over(window),
        F.struct(F.col(f"_border.{key}").alias(key), F.col("_border._value").alias("_value")))
    joined = rows.join(F.broadcast(border), "_range", "left").withColumn("_before", before)
    return joined.withColumn(out, F.when(F.col(f"_before.{key}") == F.col(key), F.col("_before._value"))).drop("_before", "_border")


def with_running_count(rows: DataFrame, key: str, seq: str, flag: Column, out: str) -> DataFrame:
    """Add the number of flagged rows up to and with each row, over all ``ranged`` rows."""
    hit = F.coalesce(flag, F.lit(False)).cast("long")
    window = Window.partitionBy("_range").orderBy(key, seq).rowsBetween(Window.unboundedPreceding, 0)
    flagged = rows.withColumn("_hit", hit)
    totals = flagged.groupBy("_range").agg(F.sum("_hit").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return flagged.join(F.broadcast(base), "_range").withColumn(out, F.col("_base") + F.sum("_hit").over(window)).drop("_hit", "_base")
