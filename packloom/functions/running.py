"""Running sums and numbers inside groups of any size: rows are dealt out by range, so a group spreads over as many tasks as it needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packloom.storage import stored


def dealt(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """The rows with ``_part``, the number of the range of (group, order) that they lie in; stored, as a second dealing might cut elsewhere."""
    return stored(rows.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()))


def running_sum(rows: DataFrame, group: list[str], order: list[str], value: Column, name: str, start: DataFrame | None = None) -> DataFrame:
    """``dealt`` rows with ``name``: the sum of ``value`` over the rows before, in the group by ``order``; nulls come first and rows of equal order in any.

    ``start`` (group, start): what a group's sum begins with.  The ranges' sums are added up (a row a range and
    group), and each range is summed up on its own after such a row, so rows are dealt out once more and by range, however many a group has.
    """
    own = [*group, "_part"]
    valued = rows.withColumn("_value", value)
    before = F.sum("_sum").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = valued.groupBy(*own).agg(F.sum("_value").alias("_sum")).select(*own, F.coalesce(before, F.lit(0)).alias("_value"))
    if start is not None:
        starts = starts.join(start.hint("shuffle_merge"), group, "left").select(*own, (F.col("_value") + F.coalesce("start", F.lit(0))).alias("_value"))
    both = valued.withColumn("_later", F.lit(1)).unionByName(starts.withColumn("_later", F.lit(0)), allowMissingColumns=True)
    within = F.sum("_value").over(Window.partitionBy(*own).orderBy("_later", *order).rowsBetween(Window.unboundedPreceding, -1))
    return both.withColumn(name, within.cast("bigint")).filter("_later = 1").drop("_value", "_later")


def numbered(rows: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """The rows with their number in the group, from 1."""
    out = running_sum(dealt(rows, group, order), group, order, F.lit(1), name)
    return out.withColumn(name, F.col(name) + 1).drop("_part")
