"""Numbering rows without gaps inside groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quadframe.llm.common import bucket_of, partitions


def number_within(df: DataFrame, group: list[str], spread: list[str], order: list[Column | str], name: str, buckets: int | None = None) -> DataFrame:
    """Adds ``name``: 0, 1, 2 ... within each group.

    Rows of a group are dealt into buckets by the columns ``spread`` and numbered inside each bucket by
    ``order``; counts of the buckets, a small table, say where each bucket's numbers begin.  So a group
    that holds all rows is numbered by as many tasks as there are buckets.
    """
    buckets = buckets or 2 * partitions(df.sparkSession)
    dealt = df.withColumn("__bucket", bucket_of(buckets, *map(F.col, spread)))
    keys = [*group, "__bucket"]
    counts = dealt.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(*group).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    begins = counts.select(*keys, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__begin"))
    inside = dealt.withColumn("__i", F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1)
    return inside.join(begins, keys).withColumn(name, F.col("__begin") + F.col("__i")).drop("__bucket", "__i", "__begin")
