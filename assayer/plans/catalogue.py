"""All queries of the engine by name, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.operators.packed import unpack
from assayer.plans import agreement, prepare, ratings, texts
from assayer.sources.tables import table


def citations(spark: SparkSession, folder: str) -> DataFrame:
    """Every single citation of guidelines with its position and the number of them in its field."""
    labels = table(spark, folder, "guideline_catalog", "label").where(F.col("label").rlike("[,;|+~]")).distinct()
    # The catalogue is a fixed list of about a hundred labels.
    whole = [r.label for r in labels.collect()]
    return unpack(table(spark, folder, "guidelines", "ref_id", "raw_reference"), "raw_reference", whole)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return citations(spark, folder).where("n_values >= 2").select("ref_id", "pos", "value_text")


PARTS = (prepare, agreement, ratings, texts)


def queries() -> dict:
    return {"p7_found": p7_found} | {k: v for part in PARTS for k, v in part.registry.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for part in PARTS for k, v in part.registry.sql.items()}
