"""Places of rows in an order, without one task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import forget, saved


def ranked(rows: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """rows (a written table) with place, from 0, among the rows of the same group by order, and size, the group's number of rows. Nulls come first.

    Rows are dealt out by ranges of group and order, so a group of any size is spread over many tasks; a row's place is its place among the group's
    rows in its range, plus the number of the group's rows in earlier ranges. Rows that are equal in all of group and order are split by where they stood."""
    spark = rows.sparkSession
    keys = [F.col(c).asc_nulls_first() for c in (*group, *order, "__stood")]
    dealt = rows.withColumn("__stood", F.monotonically_increasing_id()).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)
    placed = saved(dealt.drop("__stood").withColumn("__at", F.monotonically_increasing_id()), name)
    # monotonically_increasing_id counts from partition * 2^33 on
    placed_in = placed.withColumn("__range", F.shiftright("__at", 33))
    pieces = placed_in.groupBy("__range", *group).agg(F.min("__at").alias("__first"), F.count("*").alias("__rows"))
    # one row for each range and group that meet, so a window holds as many rows as there are ranges at most
    of_group, so_far = Window.partitionBy(*group), Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    begun = saved(pieces.withColumn("size", F.sum("__rows").over(of_group)).withColumn("__before", F.coalesce(F.sum("__rows").over(so_far), F.lit(0))), f"{name}-ranges")
    here = begun.select(F.col("__range").alias("__r"), *[F.col(c).alias(f"__{c}") for c in group], "__first", "__before", "size")
    same = F.col("__range") == F.col("__r")
    for c in group:
        same &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    out = placed_in.join(here, same).select(*rows.columns, (F.col("__at") - F.col("__first") + F.col("__before")).alias("place"), "size")
    out = saved(out, f"{name}-places")
    forget(placed, begun)
    return out
