"""The queries of this subpackage and, where SQL can say it, the same result in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import canonical, consensus, encoding, leakage, ledger, packing, quota, survivor, topn
from assayer.llm.sql import SQL
from assayer.operators.reshape import latest_per_key
from assayer.session import cut_lineage, shared_folder, written
from assayer.sources.tables import table

FIELDS = ("source", "category", "subcategory")
PER_MODEL = 400


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "guidelines", "ref_id", *FIELDS)
    return canonical.map_to_reference(rows, table(spark, folder, "guideline_catalog"), "ref_id", FIELDS)


def p1_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """The values that stand for no label, with the number of rows that hold them."""
    rows = table(spark, folder, "guidelines", "ref_id", *FIELDS)
    pairs = ", ".join(f"'{f}', {f}" for f in FIELDS)
    long = rows.selectExpr("ref_id", f"stack({len(FIELDS)}, {pairs}) AS (field_name, value)")
    none = p1_found(spark, folder).where("canon_id = -1")
    return long.join(none.select("ref_id", "field_name"), ["ref_id", "field_name"]).groupBy("field_name", "value").agg(F.count("*").alias("n_rows"))


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "match_pairs", "pair_id", "model_short", "app_category", "llm_observed_issue").where("llm_observed_issue IS NOT NULL")


def _quota(spark: SparkSession, folder: str) -> tuple:
    targets = table(spark, folder, "sample_targets").withColumn("app_category", F.coalesce("app_category", F.lit("Unknown")))
    return targets, "pair_id", "model_short", "app_category", "target_share", "min_n", PER_MODEL


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    report = quota.quota_report(_pairs(spark, folder), *_quota(spark, folder))
    return report.where("shortfall > 0").select("model_short", "app_category")


def p2_quotas(spark: SparkSession, folder: str) -> DataFrame:
    return quota.quota_report(_pairs(spark, folder), *_quota(spark, folder))


def p2_sample(spark: SparkSession, folder: str) -> DataFrame:
    return quota.quota_sample(_pairs(spark, folder), *_quota(spark, folder))


#: Labels that judges may choose from, at most: they are held in the driver and in expressions.
MOST_LABELS = 1000


def _ranks(spark: SparkSession, folder: str) -> list:
    """The rows of relation_ranks, whose number is checked."""
    held = table(spark, folder, "relation_ranks").where("relation IS NOT NULL").orderBy("rank_no", "relation").limit(MOST_LABELS + 1).collect()
    if len(held) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    return held


def p3_top(spark: SparkSession, folder: str) -> DataFrame:
    """The three best pairs of each expert comment: expert_comment_id, rank, pair_id, relation, confidence."""
    rows = table(spark, folder, "match_pairs", "pair_id", "expert_comment_id", "relation", "confidence", "judged_at")
    latest = latest_per_key(rows, "pair_id", "judged_at", ["expert_comment_id", "relation", "confidence"])
    ranks = {r.relation: r.rank_no for r in reversed(_ranks(spark, folder))}
    rank = F.try_element_at(F.create_map(*(F.lit(x) for pair in ranks.items() for x in pair)), "relation") if ranks else F.lit(None).cast("int")
    # Written once: its histogram, its size and its best rows are read from columns.
    judged = written(latest.withColumn("rank_no", rank).where("confidence IS NOT NULL AND NOT isnan(confidence) AND rank_no IS NOT NULL"))
    bucket = (F.col("rank_no") * 1000 + 50 - F.floor(F.least(F.greatest("confidence", F.lit(0.0)), F.lit(1.0)) * 50)).cast("int")
    order = [F.col("rank_no").asc(), F.col("confidence").desc(), F.col("pair_id").asc()]
    best = topn.top_n(judged, "expert_comment_id", 3, bucket, order)
    return best.select("expert_comment_id", "rank", "pair_id", "relation", "confidence")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return p3_top(spark, folder).select("expert_comment_id", "pair_id")


def _ledger(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, int]:
    """The keyed comments, the stored ledger after the older and then the newer half of the time they span, and their number."""
    rows = table(spark, folder, "human_comments", "record_id", "screen_task_id", "observed_issue", "updated_at")
    span = rows.agg(F.min("updated_at").alias("a"), F.max("updated_at").alias("b"), F.count("*").alias("n")).first()
    newer = F.lit(False) if span.a is None else F.coalesce(F.col("updated_at") >= F.lit(span.a + (span.b - span.a) / 2), F.lit(False))
    # The keys are worked out once and read again by both batches and by the search for copies.
    keyed = cut_lineage(ledger.keyed(rows.withColumn("newer", newer), "screen_task_id", "observed_issue", "record_id", keep=["newer"]))
    place = f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}"
    for batch in (keyed.where("NOT newer"), keyed.where("newer")):
        ledger.fold_into(spark, place, batch)
    return keyed, ledger.current(spark, place), span.n


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    found = ledger.copies(*_ledger(spark, folder))
    return found.select(F.col("first_record").alias("record_id_a"), F.col("record").alias("record_id_b"))


def p6_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Each distinct comment once: its first record and the number of its copies."""
    return _ledger(spark, folder)[1].select(F.col("first_record").alias("record_id"), "copies")


TEXTS = ("observed_issue", "suggested_fix")


def _merge_values(spark: SparkSession, folder: str) -> DataFrame:
    """The usable values of the comments that are merged: group_id, field_name, comment_id, value, dropped, updated_at, comment_source, posterior."""
    reviews = table(spark, folder, "dup_reviews", "custom_id", "left_comment_id", "right_comment_id", "recommended_action", "reviewed_at")
    groups, dropped = survivor.merge_groups(reviews, "custom_id", "reviewed_at", "left_comment_id", "right_comment_id", "recommended_action")
    comments = table(spark, folder, "human_comments", "comment_id", "comment_source", *TEXTS, "updated_at")
    member = groups.select(F.col("node").alias("comment_id"), F.col("component").alias("group_id"))
    held = comments.join(member, "comment_id").join(dropped.withColumn("dropped", F.lit(1)), "comment_id", "left")
    pairs = ", ".join(f"'{f}', {f}" for f in TEXTS)
    long = held.selectExpr("group_id", "comment_id", "coalesce(dropped, 0) AS dropped", "updated_at", "comment_source", f"stack({len(TEXTS)}, {pairs}) AS (field_name, value)")
    usable = cut_lineage(survivor.usable_values(long))
    return survivor.with_posteriors(usable, "comment_source")


def p4_survivors(spark: SparkSession, folder: str) -> DataFrame:
    """The surviving value of each merged group and field, with the comment it was taken from."""
    # Later first; no time at all goes last.
    order = [F.col("dropped"), F.coalesce(-F.unix_micros(F.col("updated_at").cast("timestamp")), F.lit(2**62))]
    return survivor.survivors(_merge_values(spark, folder), order)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return p4_survivors(spark, folder).select("group_id", "field_name", "comment_id")


def p4_fused(spark: SparkSession, folder: str) -> DataFrame:
    """As p4_survivors, by the posterior of Bayesian fusion with the comments' origin as source."""
    return survivor.survivors(_merge_values(spark, folder))


def _votes(spark: SparkSession, folder: str) -> DataFrame:
    """The counted votes of the judges on pairs and of the raters on screen tasks."""
    judges = table(spark, folder, "judge_votes", "pair_id", "judge_id", "relation", "voted_at")
    # A spelling is led back to its label by letters alone.
    plain = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")
    spellings = {"".join(ch for ch in r.relation.lower() if ch.isalnum()): r.relation for r in reversed(_ranks(spark, folder))}
    spelled = F.create_map(*(F.lit(x) for pair in (spellings or {"": ""}).items() for x in pair))
    relation = F.coalesce(F.try_element_at(spelled, plain(F.col("relation"))), F.trim("relation"))
    raters = table(spark, folder, "raw_critiques", "screen_task_id", "rater_id", "aesthetics_rating", "rated_at")
    rating = F.when(F.col("aesthetics_rating").between(1, 10), F.col("aesthetics_rating"))
    judged = consensus.latest_votes(judges, "pair_id", "judge_id", relation, "voted_at").withColumn("kind", F.lit("pair"))
    rated = consensus.latest_votes(raters, "screen_task_id", "rater_id", rating, "rated_at").withColumn("kind", F.lit("screen"))
    return judged.unionByName(rated)


def p5_labels(spark: SparkSession, folder: str) -> DataFrame:
    """The agreed label of each pair and screen task, with its agreement."""
    return consensus.consensus(_votes(spark, folder)).withColumnRenamed("item", "item_id")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return p5_labels(spark, folder).select("item_id", "label")


def p5_reliability(spark: SparkSession, folder: str) -> DataFrame:
    return consensus.reliability(_votes(spark, folder))


def p8_packed(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    return packing.pack(docs, "doc_id", "text")


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    return packing.fill(p8_packed(spark, folder))


def p9_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.find_leaks(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "heldout_items"), "doc_id", "text", "item_id", "text")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return p9_leaks(spark, folder).select("doc_id", "item_id")


def p10_restored(spark: SparkSession, folder: str) -> DataFrame:
    return encoding.find_garbled(table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return p10_restored(spark, folder).select("doc_id").distinct()


def queries() -> dict:
    return {f.__name__: f for f in (p8_packed, p8_fill, p9_found, p9_leaks, p10_found, p10_restored, p5_found, p5_labels, p5_reliability, p4_found, p4_survivors, p4_fused, p6_found, p6_counts, p1_found, p1_unmatched, p2_found, p2_quotas, p2_sample, p3_found, p3_top)}


def oracle_sql() -> dict[str, str]:
    return SQL
