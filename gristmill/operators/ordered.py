"""Global row numbers without a global window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame, order: str, name: str = "row_number") -> DataFrame:
    """Adds a gapless number from 1 in the given order.

    Rows are dealt by range and numbered within a range; a range starts where those before it
    end. Only one count for each range goes through a single task, and their number is the
    number of shuffle partitions. The range of a row is computed from its own value and the
    bounds, so it is the same on every run of a task.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / parts for i in range(1, parts)]
    bounds = (rows.select(F.percentile_approx(order, shares, 10_000)).first()[0] or []) if shares else []
    part = F.lit(0)
    for b in sorted(set(bounds)):
        part = part + F.when(F.col(order) > F.lit(b), 1).otherwise(0)
    dealt = rows.withColumn("range_no", part)
    counts = dealt.groupBy("range_no").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("range_no", "before")
    ranked = dealt.withColumn("in_range", F.row_number().over(Window.partitionBy("range_no").orderBy(order)))
    return ranked.join(F.broadcast(before), "range_no").withColumn(name, F.col("in_range") + F.col("before")).drop("range_no", "in_range", "before")


def batches(rows: DataFrame, size: int, order: str = "pos") -> DataFrame:
    """Adds batch: the number, from 0, of the batch of `size` rows in the given order."""
    return numbered(rows, order, "batch_row").withColumn("batch", F.floor((F.col("batch_row") - 1) / size).cast("long")).drop("batch_row")
