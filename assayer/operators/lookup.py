"""Joining rows to a table with one row per key, where a key may hold a third of all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys with at least 1/HOT_SHARE of all rows are hot. There can be no more than HOT_SHARE of them, which bounds the broadcast.
HOT_SHARE = 1000
#: Below so many rows for one key a shuffle partition takes it without harm.
HOT_ROWS = 20_000


def lookup_join(rows: DataFrame, lookup: DataFrame, keys: list[str], size: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``lookup`` added, ``how`` being inner or left.

    ``lookup`` has one row per ``keys``, none of them null, and in ``size`` the number of rows that carry the key. ``total`` is the number of
    rows altogether. Hot keys are joined by a broadcast of at most ``HOT_SHARE`` rows, so none of their rows is moved; the rest meet in a
    shuffle in which no key can outweigh a partition. A null key meets nothing: inner drops the row, left keeps it with nulls.
    """
    least = max(HOT_ROWS, -(-total // HOT_SHARE))
    hot = lookup.where(F.col(size) >= least)
    cold = lookup.where(F.col(size) < least)
    if total < HOT_ROWS:
        return rows.join(lookup, keys, how)
    marks = hot.select(*keys, F.lit(True).alias("__hot"))
    marked = rows.join(F.broadcast(marks), keys, "left")
    warm = marked.where("__hot").drop("__hot").join(F.broadcast(hot), keys, "inner")
    rest = marked.where(F.col("__hot").isNull()).drop("__hot")
    if how == "left":
        null_key = reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys))
        added = [F.lit(None).cast(t).alias(c) for c, t in lookup.dtypes if c not in keys]
        nulls = rest.where(null_key).select(*rest.columns, *added)
        cool = rest.where(~null_key).join(cold, keys, "left")
        return warm.unionByName(cool).unionByName(nulls)
    return warm.unionByName(rest.join(cold, keys, "inner"))
