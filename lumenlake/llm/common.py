"""What several operators of this subpackage share: words, running totals; scratch tables and components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.operators.tables import components, materialise, scratch, shared_dir, spent

__all__ = ["WORD", "components", "materialise", "running_total", "scratch", "shared_dir", "spent"]

#: A word is a run of anything but these six ASCII white-space characters.
WORD = "[^\\x20\\x09-\\x0D]+"


def running_total(df: DataFrame, group: list[str], bucket: str, order: list[Column], value: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows before this one in its group, by (bucket, order).

    A group may hold a third of all rows, so no window spans one: sums for each (group, bucket) are added up
    over the few thousand buckets, and only rows of one bucket are sorted together. ``group`` and ``bucket``
    must not be null.
    """
    keys = [*group, bucket]
    sums = df.groupBy(*keys).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, F.coalesce(F.sum("_sum").over(before), F.lit(0)).cast("long").alias("_before"))
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.join(sums, keys)
        .withColumn(out, F.col("_before") + F.coalesce(F.sum(value).over(within), F.lit(0)))
        .drop("_before")
    )
