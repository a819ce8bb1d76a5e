"""A sample whose category shares follow given targets, with floors for small categories and a report of what could not be met.

Categories are counted, integer quotas are allotted by largest remainder, raised to the floors, cut to what is there and brought back to the
total, and in each category the rows with the smallest random keys are taken. A histogram of the keys gives each category a threshold that keeps at least its quota, so
only about as many rows as are drawn are ever sorted, however large a category is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of the histogram of random keys, by category.
BUCKETS = 1 << 14
#: Cells with a target up to which they are broadcast; more are joined by shuffle.
BROADCAST_CELLS = 100_000


def settle(want: list[int], floors: list[int], there: list[int], shares: list[float], total: int) -> list[int]:
    """Quotas that sum up to ``total``, or to all there is: ``want`` cut to what is there, and the difference given or taken by shares.

    Seats that a short category leaves go to the others by largest remainder of their shares; seats that floors take beyond the total come from
    those above their floor, by largest remainder of what they have above it. Ties go to the earlier category.
    """
    quota = [min(w, a) for w, a in zip(want, there)]
    while (gap := min(total, sum(there)) - sum(quota)) != 0:
        if gap > 0:
            weight = [s if a > q else 0.0 for s, a, q in zip(shares, there, quota)]
            if not any(weight):
                weight = [float(a - q) for a, q in zip(there, quota)]
        else:
            weight = [float(max(q - min(f, a), 0)) for q, f, a in zip(quota, floors, there)]
            if not any(weight):
                break  # the floors alone are more than the total
        exact = [abs(gap) * w / sum(weight) for w in weight]
        step = [int(x) for x in exact]
        for i in sorted((i for i, w in enumerate(weight) if w), key=lambda i: (step[i] - exact[i], i))[: abs(gap) - sum(step)]:
            step[i] += 1
        quota = [min(q + n, a) if gap > 0 else max(q - n, min(f, a)) for q, n, a, f in zip(quota, step, there, floors)]
    return quota


def allot(targets: DataFrame, counts: DataFrame, group: str, category: str, share: str, floor: str, total: int) -> DataFrame:
    """One row per row of ``targets``: group, category, want, quota, available, shortfall.

    ``targets`` has group, category (each pair once), ``share`` (of the group's ``total``) and ``floor``; ``counts`` has group, category and
    ``available``. Shares and floors that are null or negative count as 0. The integer parts of share * total are given out first, the rest of
    the total by largest remainder (ties: the smaller category); want is the greater of this and the floor, shortfall what of it is not there.
    quota is as ``settle`` has it. Targets are a small table: each task gets the categories of one group.
    """
    joined = targets.select(group, category, F.col(share).cast("double").alias("share"), F.col(floor).cast("long").alias("floor")).join(
        counts.select(group, category, F.col("available").cast("long")), [group, category], "left"
    )
    kind = dict(joined.dtypes)
    schema = f"`{group}` {kind[group]}, `{category}` {kind[category]}, want long, quota long, available long, shortfall long"

    def one(pdf):
        pdf = pdf.sort_values(category, kind="stable").reset_index(drop=True)
        shares = [max(float(x), 0.0) for x in pdf["share"].fillna(0)]
        floors = [max(int(x), 0) for x in pdf["floor"].fillna(0)]
        there = [int(x) for x in pdf["available"].fillna(0)]
        exact = [round(s * total, 6) for s in shares]
        given = [int(x) for x in exact]
        for i in sorted(range(len(exact)), key=lambda i: (given[i] - exact[i], i))[: round(sum(exact)) - sum(given)]:
            given[i] += 1
        want = [max(g, f) for g, f in zip(given, floors)]
        quota = settle(want, floors, there, shares, total)
        return pdf[[group, category]].assign(want=want, quota=quota, available=there, shortfall=[max(w - a, 0) for w, a in zip(want, there)])

    return joined.groupBy(group).applyInPandas(one, schema)


def distinct_units(rows: DataFrame, unit: str, group: str, category: str, unknown: str = "Unknown") -> DataFrame:
    """Each ``unit`` once in each group and category that it stands in; a null category counts as ``unknown``. Null units and groups are left out."""
    named = rows.select(F.col(f"`{group}`").alias(group), F.coalesce(F.col(f"`{category}`"), F.lit(unknown)).alias(category), F.col(f"`{unit}`").alias(unit))
    return named.where(F.col(unit).isNotNull() & F.col(group).isNotNull()).distinct()


def quota_report(rows: DataFrame, targets: DataFrame, unit: str, group: str, category: str, share: str, floor: str, total: int) -> DataFrame:
    """The quotas and shortfalls of ``allot`` for the distinct units of ``rows``. Empty ``rows`` give shortfalls only."""
    units = distinct_units(rows, unit, group, category)
    # The units are grouped by unit first, so the second count is of few rows however skewed the categories are.
    counts = units.groupBy(group, category).agg(F.count("*").alias("available"))
    return allot(targets, counts, group, category, share, floor, total)


def quota_sample(rows: DataFrame, targets: DataFrame, unit: str, group: str, category: str, share: str, floor: str, total: int, seed: int = 42) -> DataFrame:
    """The drawn units: group, category, unit, place (from 1 in its cell). The same rows and seed give the same sample.

    The random key of a unit is a hash of it and the seed; equal keys go by the unit itself. Cells without a target are not drawn from.
    """
    units = distinct_units(rows, unit, group, category)
    keyed = units.withColumn("__key", F.xxhash64(F.col(unit).cast("string"), F.lit(seed)))
    keyed = keyed.withColumn("__bucket", F.shiftright(F.col("__key"), 50) + F.lit(BUCKETS // 2))
    histogram = keyed.groupBy(group, category, "__bucket").agg(F.count("*").alias("__n"))
    counts = histogram.groupBy(group, category).agg(F.sum("__n").alias("available"))
    quotas = allot(targets, counts, group, category, share, floor, total).where("quota > 0").select(group, category, "quota")
    few = F.broadcast if targets.count() <= BROADCAST_CELLS else (lambda df: df)
    running = F.sum("__n").over(Window.partitionBy(group, category).orderBy("__bucket"))
    # At most BUCKETS rows of a cell are in this window.
    cut = (
        histogram.join(few(quotas), [group, category])
        .withColumn("__sum", running)
        .where(F.col("__sum") >= F.col("quota"))
        .groupBy(group, category)
        .agg(F.min("__bucket").alias("__cut"), F.first("quota").alias("quota"))
    )
    near = keyed.join(few(cut), [group, category]).where(F.col("__bucket") <= F.col("__cut"))
    place = F.row_number().over(Window.partitionBy(group, category).orderBy("__key", unit))
    return near.withColumn("place", place).where(F.col("place") <= F.col("quota")).select(group, category, unit, "place")
