"""Records that differ only in formatting, collapsed and counted by a ledger that is kept from batch to batch.

The ledger has one row per canonical key: its bucket, the number of copies so far and the earliest record. A new batch is aggregated by key
first, combined before the shuffle, so a text that makes up a third of the batch is one row per task; then a full outer join with the ledger's
matching buckets adds the counts and keeps the earlier representative.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions.text import unmark
from assayer.operators.lookup import lookup_join

BUCKETS = 64
#: A named field inside a text, "Name: value", after the beginning or a separator.
_FIELD_START = r"(?=(?:^|[|;/,\n\r•·])[\s\p{Z}\p{P}]*\p{L}{2,20}[\s\p{Z}]*:)"
_IS_FIELD = r"^[\s\p{Z}\p{P}|]*\p{L}{2,20}[\s\p{Z}]*:"


def bare_text(text: Column) -> Column:
    """``text`` in lower case with its letters and digits only; marks on letters stay, full-width characters become plain ones."""
    wide = F.translate(text, "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F))))
    return F.regexp_replace(F.lower(wide), r"[^\p{L}\p{N}]+", "")


def canonical_text(text: Column) -> Column:
    """``text`` apart from white space, letter case and punctuation; fields named inside it ("Name: value", two or more) in sorted order.

    Null for a text without a letter or digit.
    """
    parts = F.filter(F.split(text, _FIELD_START), lambda p: p.rlike(r"[\p{L}\p{N}]"))

    def by_name(parts: Column) -> Column:
        named = (F.size(parts) >= 2) & F.forall(parts, lambda p: p.rlike(_IS_FIELD))
        return F.when(named, F.array_join(F.array_sort(F.transform(parts, bare_text)), "|")).otherwise(bare_text(text))

    # The parts are bound to a lambda's variable, so they are worked out once, and only for texts that may hold two fields.
    several = F.element_at(F.transform(F.array(parts), by_name), 1)
    return F.nullif(F.when(text.rlike(r"(?s):.*[|;/,\n\r•·].*:"), several).otherwise(bare_text(text)), F.lit(""))


def keyed(records: DataFrame, scope: str, text: str, record: str, buckets: int = BUCKETS, keep: Sequence[str] = ()) -> DataFrame:
    """``record``, its canonical key and bucket, and the columns ``keep``. Records with a null id, or whose scope or text has no letter or digit, are left out."""
    scope_key = F.nullif(bare_text(unmark(F.col(f"`{scope}`").cast("string"))), F.lit(""))
    key = F.sha2(F.concat(scope_key, F.lit("\n"), canonical_text(F.col(f"`{text}`"))), 256)
    named = records.select(*keep, F.col(f"`{record}`").alias("record"), key.alias("key")).where(F.col("key").isNotNull() & F.col("record").isNotNull())
    return named.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))


def empty_ledger(spark: SparkSession, record_type: str = "bigint") -> DataFrame:
    return spark.createDataFrame([], f"bucket int, key string, copies bigint, first_record {record_type}")


def counted(batch: DataFrame) -> DataFrame:
    """A keyed batch as a ledger of its own."""
    return batch.groupBy("bucket", "key").agg(F.count("*").alias("copies"), F.min("record").alias("first_record"))


def fold(ledger: DataFrame, batch: DataFrame) -> DataFrame:
    """The ledger after a keyed ``batch``: counts added, the smaller record kept. Each batch must be folded in once.

    The join is on bucket and key. A ledger stored by bucket is read and written for the batch's buckets only (``fold_into``).
    """
    new = counted(batch).select("bucket", "key", F.col("copies").alias("n"), F.col("first_record").alias("r"))
    both = ledger.join(new, ["bucket", "key"], "full")
    zero = F.lit(0).cast("bigint")
    return both.select("bucket", "key", (F.coalesce("copies", zero) + F.coalesce("n", zero)).alias("copies"), F.least("first_record", "r").alias("first_record"))


def generations(spark: SparkSession, folder: str) -> dict[int, int]:
    """The newest committed generation of each bucket of the stored ledger ``folder``."""
    file = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = lambda path: [s.getPath() for s in system.listStatus(path)] if system.exists(path) else []
    newest: dict[int, int] = {}
    for generation in names(file):
        inside = names(generation)
        # A write that failed leaves no such mark and is not read.
        if generation.getName().startswith("g=") and any(p.getName() == "_SUCCESS" for p in inside):
            number = int(generation.getName()[2:])
            for bucket in (int(p.getName()[7:]) for p in inside if p.getName().startswith("bucket=")):
                newest[bucket] = max(number, newest.get(bucket, -1))
    return newest


def stored(spark: SparkSession, folder: str, newest: dict[int, int], record_type: str = "bigint") -> DataFrame:
    """The rows of the buckets ``newest`` (bucket: generation) of the stored ledger ``folder``."""
    if not newest:
        return empty_ledger(spark, record_type)
    paths = [f"{folder}/g={g}/bucket={b}" for b, g in sorted(newest.items())]
    read = spark.read.option("basePath", folder).schema(f"key string, copies bigint, first_record {record_type}, g int, bucket int").parquet(*paths)
    return read.select("bucket", "key", "copies", "first_record")


def fold_into(spark: SparkSession, folder: str, batch: DataFrame) -> None:
    """Folds a keyed ``batch`` into the ledger stored by bucket in ``folder``, which need not exist.

    Only the batch's buckets are read, joined and written, as a new generation of theirs; the others stay as they are, and so do older generations, so
    a lost executor or a failed write costs a retry and nothing else.
    """
    kind = dict(batch.dtypes)["record"]
    newest = generations(spark, folder)
    # At most BUCKETS numbers.
    touched = {r.bucket for r in batch.select("bucket").distinct().collect()}
    old = stored(spark, folder, {b: g for b, g in newest.items() if b in touched}, kind)
    number = max(newest.values(), default=-1) + 1
    # One file a bucket.
    fold(old, batch).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/g={number}")


def current(spark: SparkSession, folder: str, record_type: str = "bigint") -> DataFrame:
    """The whole ledger stored in ``folder``."""
    return stored(spark, folder, generations(spark, folder), record_type)


def copies(batch: DataFrame, ledger: DataFrame, total: int) -> DataFrame:
    """The records of a keyed ``batch`` that are not the first of their key: first_record, record. ``total`` is the number of records."""
    repeated = ledger.where("copies > 1").select("key", "copies", "first_record")
    return lookup_join(batch.select("key", "record"), repeated, ["key"], "copies", total).where("record <> first_record").select("first_record", "record")
