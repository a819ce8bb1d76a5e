"""Row selection by a total order, numbering, nesting and reshaping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key by ``order``, which should be total. Null keys form groups of their own."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__place", place).where(F.col("__place") <= n).drop("__place")


def latest_per_key(rows: DataFrame, key: str, at: str, columns: Sequence[str]) -> DataFrame:
    """``columns`` of the row with the latest ``at`` of each ``key``; equal times go by the greatest values of ``columns`` in order.

    A null time is older than any; a null key is left out. It is one aggregate over ``key``, combined before the shuffle, so a key of any size is
    taken.
    """
    values = F.struct(*(F.col(f"`{c}`").alias(c) for c in columns))
    held = rows.where(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").alias(key)).agg(F.max(F.struct(F.col(f"`{at}`").alias("at"), values.alias("v"))).alias("b"))
    return held.select(key, *(F.col(f"b.v.{c}").alias(c) for c in columns))


def with_sequence(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "seq") -> DataFrame:
    """``df`` with a running number from 1 within each key."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def assert_unique(df: DataFrame, keys: Sequence[str], what: str = "table") -> DataFrame:
    """``df``, if no key occurs twice; an error otherwise. Costs one aggregate."""
    repeated = df.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if repeated:
        raise ValueError(f"{what}: more than one row for {repeated[0].asDict()}")
    return df


def join_one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """A join of which both sides are checked to have each key once."""
    return assert_unique(left, keys, "left side").join(assert_unique(right, keys, "right side"), list(keys), how)


def is_duplicated(keys: Sequence[str]) -> Column:
    """Whether another row has the same keys; nulls are equal."""
    return F.count(F.lit(1)).over(Window.partitionBy(*keys)) > 1


def nest(df: DataFrame, keys: Sequence[str], fields: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """One row per key with ``name``, the array of its rows' ``fields`` by ``order``. Null keys are kept.

    A key's rows become one value, so they must fit one: nest by keys whose groups are bounded, and keep large ones long.
    """
    rows = F.array_sort(F.collect_list(F.struct(*(F.col(o).alias(f"__o{i}") for i, o in enumerate(order)), F.struct(*fields).alias("__v"))))
    return df.groupBy(*keys).agg(F.transform(rows, lambda r: r["__v"]).alias(name))


def unnest(df: DataFrame, name: str, keys: Sequence[str], pos: str = "pos") -> DataFrame:
    """The elements of the array of structs ``name`` as rows with their position from 1; null elements are dropped."""
    out = df.select(*keys, F.posexplode(name).alias("__pos", "__v")).where(F.col("__v").isNotNull())
    return out.select(*keys, (F.col("__pos") + 1).alias(pos), "__v.*")


def unpivot(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str, value: str) -> DataFrame:
    """Wide to long."""
    return df.unpivot([F.col(k) for k in keys], [F.col(c) for c in columns], name, value)


def share_of_group(df: DataFrame, keys: Sequence[str], n: str, name: str = "share") -> DataFrame:
    """``df`` with ``n`` as a share of its sum over ``keys``."""
    return df.withColumn(name, F.try_divide(F.col(n), F.sum(n).over(Window.partitionBy(*keys))))


def pool_rare(df: DataFrame, column: str, least: int, other: str = "Other") -> DataFrame:
    """``df`` with values of ``column`` on fewer than ``least`` rows replaced by ``other``. Counted first, so a frequent value is never gathered."""
    counts = df.groupBy(column).agg(F.count("*").alias("__n"))
    kept = counts.where(F.col("__n") >= least).select(column, F.lit(True).alias("__kept"))
    return df.join(kept, column, "left").withColumn(column, F.when(F.col(column).isNull() | F.col("__kept"), F.col(column)).otherwise(other)).drop("__kept")


def eliminate(df: DataFrame, key: str, text: str, variants: Sequence[tuple[str, str]]) -> DataFrame:
    """variant, n_keys: for each of ``variants`` (name, pattern) in turn the keys with a text that matches it, among those no earlier variant took."""
    taken = [F.when(F.col(text).rlike(pattern), i) for i, (_, pattern) in enumerate(variants)]
    first = df.groupBy(key).agg(F.min(F.coalesce(*taken, F.lit(len(variants)))).alias("i"))
    # A key's first variant is the smallest over its texts, which is what dropping keys variant by variant leaves.
    names = F.element_at(F.array(*(F.lit(n) for n, _ in variants), F.lit("(rest)")), F.col("i") + 1)
    return first.groupBy(names.alias("variant")).agg(F.count("*").alias("n_keys"))


def rule_table(df: DataFrame, keys: Sequence[str], rules: Sequence[tuple[str, Column]], otherwise: str, name: str = "outcome") -> DataFrame:
    """The first of ``rules`` (label, condition) that holds for any row of the key."""
    found = df.groupBy(*keys).agg(*(F.bool_or(F.coalesce(c, F.lit(False))).alias(f"__r{i}") for i, (_, c) in enumerate(rules)))
    out = F.coalesce(*(F.when(F.col(f"__r{i}"), F.lit(label)) for i, (label, _) in enumerate(rules)), F.lit(otherwise))
    return found.select(*keys, out.alias(name))


def exclude(df: DataFrame, key: str, ids: Sequence[str]) -> DataFrame:
    """``df`` without the rows of a fixed list of keys, each of which must be there."""
    here = {r[0] for r in df.where(F.col(key).isin(*ids)).select(key).distinct().collect()}
    if missing := sorted(set(ids) - here):
        raise ValueError(f"not there: {missing}")
    return df.where(F.col(key).isNull() | ~F.col(key).isin(*ids))


def find_texts(df: DataFrame, text: str, pattern: str, missing: bool = False) -> DataFrame:
    """The rows whose ``text`` has a match of ``pattern``, whatever its case, or has none. Null texts are in neither."""
    hit = F.col(text).rlike(f"(?i){pattern}")
    return df.where(~hit if missing else hit)


def crosstab(df: DataFrame, row: str | Sequence[str], column: str) -> DataFrame:
    """Counts of fields with their margins, which are named (all); nulls are named (null). ``row`` may be several fields, which stand for one."""
    rows = [row] if isinstance(row, str) else list(row)
    counts = df.groupBy(*rows, column).agg(F.count("*").alias("n")).select(*(F.coalesce(F.col(c).cast("string"), F.lit("(null)")).alias(c) for c in (*rows, column)), "n")
    # The fields of a row are rolled up together.
    whole = counts.select(F.struct(*rows).alias("__r"), column, "n").cube("__r", column).agg(F.sum("n").alias("n"))
    return whole.select(*(F.coalesce(F.col(f"__r.{c}"), F.lit("(all)")).alias(c) for c in rows), F.coalesce(column, F.lit("(all)")).alias(column), "n")


def row_shares(df: DataFrame, row: Sequence[str], column: str, name: str = "share") -> DataFrame:
    """Counts n of fields and their share of the row's; nulls are named (null)."""
    named = df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("(null)")).alias(c) for c in (*row, column)))
    return share_of_group(named.groupBy(*row, column).agg(F.count("*").alias("n")), row, "n", name)


def invalid_codes(codes: DataFrame, codebook: DataFrame) -> DataFrame:
    """The rows of ``codes`` (field, value and more) whose field is not in ``codebook`` (field, value), or whose value is not allowed in it; values are compared as texts.

    ``reason`` says which. A null value is no code yet and is allowed in a known field.
    """
    fields = codebook.select("field").distinct().withColumn("__known", F.lit(True))
    allowed = codebook.select("field", F.col("value").cast("string").alias("value")).distinct().withColumn("__ok", F.lit(True))
    told = codes.withColumn("value", F.col("value").cast("string")).join(fields, "field", "left").join(allowed, ["field", "value"], "left")
    reason = F.when(F.col("__known").isNull(), "unknown field").when(F.col("value").isNotNull() & F.col("__ok").isNull(), "value not allowed")
    return told.withColumn("reason", reason).where("reason IS NOT NULL").drop("__known", "__ok")
