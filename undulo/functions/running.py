"""Running sums and positions in two steps, over ranges of the order and inside each, so that no task holds a whole partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from undulo.sources.scratch import small_side, stored


def in_ranges(df: DataFrame, order: list[str]) -> DataFrame:
    """``df``, written, with ``_part``: the number of its range in the order. Ranges follow the rows, however the values lie."""
    return stored(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")


def running_sum(df: DataFrame, keys: list[str], order: str, value: str, out: str, inclusive: bool = False) -> DataFrame:
    """Adds the sum of ``value`` over the rows before (or up to) each one, by ``keys``, in an order that tells a key's rows apart."""
    rows = in_ranges(df, [*keys, order])
    totals = stored(rows.groupBy(*keys, "_part").agg(F.sum(value).alias("_total")), "range-totals")
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = totals.select(*keys, "_part", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    rows = rows.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    rows = rows.join(small_side(earlier, totals.count()), [*keys, "_part"])
    return rows.withColumn(out, (F.col("_before") + F.col("_inside")).cast("long")).drop("_part", "_before", "_inside")


def with_positions(df: DataFrame, order: list[str], out: str = "pos") -> DataFrame:
    """Numbers rows from 0 in an order; nulls come first, rows that it doesn't tell apart stand in any order."""
    rows = in_ranges(df, order)
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each shuffle partition
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    rows = rows.withColumn("_rank", rank).join(F.broadcast(counts), "_part")
    return rows.withColumn(out, (F.col("_before") + F.col("_rank") - 1).cast("long")).drop("_part", "_before", "_rank")
