"""Answers that arrive in files over time: the latest record of each id wins, failures stay to be retried."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.operators.batch import latest_answers


def merge_batch(folder: str, key: str, order: list[str]):
    """A foreachBatch function that keeps ``folder`` as the table of latest records.

    Each batch gives a generation, folder/v=<batch id>, from the one before; a batch that runs again after a failure overwrites its own generation only.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        now = latest_answers(batch, key, order)
        if number > 0:
            old = spark.read.parquet(f"{folder}/v={number - 1}").select(*now.columns)
            now = latest_answers(now.unionByName(old), key, order)
        now.write.mode("overwrite").parquet(f"{folder}/v={number}")

    return merge


def run(stream: DataFrame, folder: str, checkpoint: str, key: str, order: list[str], mode: str = "append") -> DataFrame:
    """Merges what ``stream`` brings now into ``folder`` and returns the table of latest records."""
    query = stream.writeStream.outputMode(mode).foreachBatch(merge_batch(folder, key, order)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return current(stream.sparkSession, folder)


def ingest(spark: SparkSession, source: str, schema: str, folder: str, checkpoint: str, key: str, order: list[str], files_per_batch: int = 1) -> DataFrame:
    """Reads what is new in the folder of JSON lines ``source``, merges it into ``folder`` and returns the table of latest records.

    The checkpoint remembers which files were taken, so a call after new files have come takes these only.
    """
    return run(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(source), folder, checkpoint, key, order)


def table_stream(spark: SparkSession, folder: str, name: str, columns: list[str]) -> DataFrame:
    """The Parquet table ``name`` of ``folder``, one file or a folder of them, as a stream of its files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    # The pattern lets a single file be a source, too.
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}.parque[t]").select(*columns)


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The newest generation of the table in ``folder``."""
    versions = spark.read.parquet(folder)
    newest = versions.agg(F.max("v")).first()[0]
    return spark.read.parquet(f"{folder}/v={newest}")


def windowed_counts(events: DataFrame, at: str, keys: list[str], width: str, late: str) -> DataFrame:
    """Events by tumbling window and key with a watermark: rows later than ``late`` are not counted any more. For streams and tables alike."""
    timed = events.withColumn(at, F.col(at).cast("timestamp"))
    return timed.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")
