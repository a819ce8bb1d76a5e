"""The best N items of each of millions of groups, one of which may hold a third of all rows.

A histogram of scores per group, combined before it is shuffled, gives each group the lowest bucket that still leaves at least N items. Rows
below it are dropped where they lie; the few that are left are ranked exactly, by a total order, so every run gives the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.operators.lookup import lookup_join


def top_n(rows: DataFrame, group: str, n: int, bucket: Column, order: Sequence[Column], size_of_rows: int | None = None) -> DataFrame:
    """The first ``n`` rows of each ``group`` by ``order``, with their place in ``rank``.

    ``order`` must be total, or equal rows share their places at random. ``bucket`` is an int that never falls along ``order`` (smaller is better)
    and takes a few hundred values at most. Groups with fewer than ``n`` rows keep all; null groups are left out; a column named rank is replaced.
    """
    rows = rows.where(F.col(group).isNotNull()).drop("rank").withColumn("__bucket", bucket)
    histogram = rows.groupBy(group, "__bucket").agg(F.count("*").alias("__n"))
    by = Window.partitionBy(group)
    # A group has as many rows here as it has buckets.
    totals = histogram.withColumn("__before", F.sum("__n").over(by.orderBy("__bucket")) - F.col("__n"))
    cut = totals.groupBy(group).agg(F.max(F.when(F.col("__before") < n, F.col("__bucket"))).alias("__cut"), F.sum("__n").alias("__size"))
    total = rows.count() if size_of_rows is None else size_of_rows
    near = lookup_join(rows, cut, [group], "__size", total).where(F.col("__bucket") <= F.col("__cut"))
    ranked = near.withColumn("rank", F.row_number().over(by.orderBy(*order))).where(F.col("rank") <= n)
    return ranked.drop("__bucket", "__cut", "__size")
