"""Duplicates, judges and matching over the domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions import scalars as S
from assayer.operators import dedup, matching as M, reshape as R
from assayer.operators.components import components
from assayer.plans.registry import Registry, Tables
from assayer.session import cut_lineage

registry = Registry()
query = registry.query

# ---- shared inputs, and the same in SQL

LABEL_COLUMNS = ["model_short", "screen_task_id", "app_category", "expert_comment_id", "llm_comment_id", "relation", "confidence", "decision_source"]
LBL = """lbl AS (SELECT * EXCLUDE (k) FROM (SELECT pair_id, model_short, screen_task_id, app_category, expert_comment_id, llm_comment_id, relation, CASE WHEN isnan(confidence) THEN NULL ELSE confidence END AS confidence, decision_source,
    row_number() OVER (PARTITION BY pair_id ORDER BY judged_at DESC, relation DESC NULLS LAST, confidence DESC NULLS LAST) AS k FROM match_pairs) WHERE k = 1)"""
W = "CASE relation WHEN 'equivalent' THEN 1.0 WHEN 'A_broader' THEN 0.85 WHEN 'B_broader' THEN 0.85 WHEN 'partial_overlap' THEN 0.5 ELSE 0.0 END::DOUBLE"
RANK = "CASE relation WHEN 'equivalent' THEN 1 WHEN 'A_broader' THEN 2 WHEN 'B_broader' THEN 3 WHEN 'partial_overlap' THEN 4 WHEN 'contradiction' THEN 5 WHEN 'related_but_different' THEN 6 WHEN 'no_match' THEN 7 END"
REL = "CASE replace(replace(lower(trim(relation)), '-', '_'), ' ', '_') WHEN 'a_broader' THEN 'A_broader' WHEN 'b_broader' THEN 'B_broader' ELSE replace(replace(lower(trim(relation)), '-', '_'), ' ', '_') END"
VOTE = f"""vote AS (SELECT pair_id, judge_id, {REL} AS relation, confidence, error, voted_at FROM
    (SELECT *, row_number() OVER (PARTITION BY pair_id, judge_id ORDER BY voted_at DESC, vote_id DESC) AS k FROM judge_votes) WHERE k = 1)"""
DEC = """dec AS (SELECT custom_id, left_comment_id AS a, right_comment_id AS b, replace(replace(lower(trim(recommended_action)), ' ', '_'), '-', '_') AS action, relationship, confidence FROM
    (SELECT *, row_number() OVER (PARTITION BY custom_id ORDER BY reviewed_at DESC, recommended_action DESC NULLS LAST, judge DESC) AS k FROM dup_reviews) WHERE k = 1)"""


def labels(t: Tables) -> DataFrame:
    """The latest label of each pair. NaN counts as no confidence."""
    df = t("match_pairs", "pair_id", *LABEL_COLUMNS, "judged_at")
    latest = R.latest_per_key(df, "pair_id", "judged_at", ["relation", "confidence", *(c for c in LABEL_COLUMNS if c not in ("relation", "confidence"))])
    return latest.withColumn("confidence", F.when(~F.isnan("confidence"), F.col("confidence")))


def votes(t: Tables) -> DataFrame:
    """The latest vote of each judge on a pair, its relation spelled evenly."""
    df = t("judge_votes", "pair_id", "judge_id", "vote_id", "relation", "confidence", "error", "voted_at")
    best = F.max(F.struct("voted_at", "vote_id", "relation", "confidence", "error"))
    out = df.groupBy("pair_id", "judge_id").agg(best.alias("v"))
    return out.select("pair_id", "judge_id", M.relation_key(F.col("v.relation")).alias("relation"), F.col("v.confidence").alias("confidence"), F.col("v.error").alias("error"))


def decisions(t: Tables) -> DataFrame:
    """The latest review of each pair of comments."""
    df = t("dup_reviews", "custom_id", "left_comment_id", "right_comment_id", "recommended_action", "judge", "relationship", "confidence", "reviewed_at")
    latest = R.latest_per_key(df, "custom_id", "reviewed_at", ["recommended_action", "judge", "left_comment_id", "right_comment_id", "relationship", "confidence"])
    return latest.select("custom_id", F.col("left_comment_id").alias("a"), F.col("right_comment_id").alias("b"), dedup.action_key(F.col("recommended_action")).alias("action"), "relationship", "confidence")


# ---- duplicates

_BOX = "least(b.x_min, b.x_max) AS x0, greatest(b.x_min, b.x_max) AS x1, least(b.y_min, b.y_max) AS y0, greatest(b.y_min, b.y_max) AS y1, b.x_min IS NOT NULL AND b.x_max IS NOT NULL AND b.y_min IS NOT NULL AND b.y_max IS NOT NULL AND b.x_min <> b.x_max AND b.y_min <> b.y_max AS ok"
_IOU = "greatest(0, least(l.x1, r.x1) - greatest(l.x0, r.x0)) * greatest(0, least(l.y1, r.y1) - greatest(l.y0, r.y0)) AS i, (l.x1 - l.x0) * (l.y1 - l.y0) + (r.x1 - r.x0) * (r.y1 - r.y0) AS areas"


def reviewed_boxes(t: Tables) -> DataFrame:
    c = t("human_comments", "comment_id", "bounding_box")
    d = decisions(t)
    d = d.join(c.select(F.col("comment_id").alias("a"), F.col("bounding_box").alias("box_a")), "a").join(c.select(F.col("comment_id").alias("b"), F.col("bounding_box").alias("box_b")), "b")
    return d.withColumn("iou", S.box_iou(F.col("box_a"), F.col("box_b"))).withColumn("status", S.box_status(F.col("box_a"), F.col("box_b")))


@query(f"""WITH {DEC}, box AS (SELECT comment_id, {_BOX} FROM (SELECT comment_id, bounding_box AS b FROM human_comments)), p AS (SELECT custom_id, l.ok AS lo, r.ok AS ro, {_IOU} FROM dec JOIN box l ON l.comment_id = a JOIN box r ON r.comment_id = b)
    SELECT custom_id, CASE WHEN lo AND ro THEN round(i / (areas - i), 6) END AS iou, CASE WHEN coalesce(lo, false) AND coalesce(ro, false) THEN CASE WHEN i / (areas - i) >= 0.5 THEN 'same_target' WHEN i / (areas - i) >= 0.1 THEN 'manual_ambiguous_target' ELSE 'different_target' END
    WHEN coalesce(lo, false) OR coalesce(ro, false) THEN 'manual_missing_bbox' ELSE 'same_target_missing_bbox' END AS status FROM p""")
def bbox_pair_status(t: Tables):
    """Overlap of the boxes of two reviewed comments."""
    return reviewed_boxes(t).select("custom_id", F.round("iou", 6).alias("iou"), "status")


@query(f"""WITH {DEC}, box AS (SELECT comment_id, {_BOX} FROM (SELECT comment_id, bounding_box AS b FROM human_comments)), p AS (SELECT custom_id, action, l.ok AND r.ok AS both_ok, {_IOU} FROM dec JOIN box l ON l.comment_id = a JOIN box r ON r.comment_id = b WHERE action IN ('keep_a', 'keep_b'))
    SELECT custom_id, action FROM p WHERE coalesce(CASE WHEN both_ok THEN i / (areas - i) END, 0) < 0.2""")
def low_iou_audit(t: Tables):
    """Merges of comments whose boxes hardly overlap."""
    return reviewed_boxes(t).where(F.col("action").isin("keep_a", "keep_b") & (F.coalesce("iou", F.lit(0.0)) < 0.2)).select("custom_id", "action")


@query(f"""WITH RECURSIVE c AS (SELECT comment_id AS k, screen_task_id || '|' || regexp_replace(lower(observed_issue), '[^\\pL\\pN]+', '', 'g') AS g, {_BOX} FROM (SELECT *, bounding_box AS b FROM human_comments) WHERE regexp_matches(observed_issue, '[\\pL\\pN]') AND screen_task_id IS NOT NULL),
    e AS (SELECT l.k AS a, r.k AS b FROM c l JOIN c r ON l.g = r.g AND l.k <> r.k WHERE (NOT coalesce(l.ok, false) AND NOT coalesce(r.ok, false)) OR (l.ok AND r.ok AND (greatest(0, least(l.x1, r.x1) - greatest(l.x0, r.x0)) * greatest(0, least(l.y1, r.y1) - greatest(l.y0, r.y0)))
        / ((l.x1 - l.x0) * (l.y1 - l.y0) + (r.x1 - r.x0) * (r.y1 - r.y0) - greatest(0, least(l.x1, r.x1) - greatest(l.x0, r.x0)) * greatest(0, least(l.y1, r.y1) - greatest(l.y0, r.y0))) >= 0.5)),
    reach AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a), comp AS (SELECT a AS comment_id, least(a, min(b)) AS component FROM reach GROUP BY a)
    SELECT comment_id, component, count(*) OVER (PARTITION BY component)::BIGINT AS size FROM comp""")
def exact_dup_components(t: Tables):
    """Comments with the same issue in the same task whose boxes mean the same target, by component."""
    df = t("human_comments", "comment_id", "screen_task_id", "observed_issue", "bounding_box").where(F.col("observed_issue").rlike(r"[\p{L}\p{N}]"))
    df = df.withColumn("g", F.concat("screen_task_id", F.lit("|"), F.regexp_replace(F.lower("observed_issue"), r"[^\p{L}\p{N}]+", "")))
    return dedup.duplicate_components(df, "g", "comment_id", "bounding_box")


TRIPLET = ["screen_task_id", "expected_standard", "observed_issue", "suggested_fix"]
_ONCE = "(SELECT comment_id, comment_label, screen_task_id, expected_standard, observed_issue, suggested_fix, bounding_box FROM (SELECT *, row_number() OVER (PARTITION BY comment_id ORDER BY record_id) AS k FROM human_comments) WHERE k = 1)"
_LINK = "greatest(0, least(l.x1, r.x1) - greatest(l.x0, r.x0)) * greatest(0, least(l.y1, r.y1) - greatest(l.y0, r.y0))"
_OVER = f"{_LINK} / ((l.x1 - l.x0) * (l.y1 - l.y0) + (r.x1 - r.x0) * (r.y1 - r.y0) - {_LINK})"
_TRIPLET_SQL = f"""c AS (SELECT comment_id AS k, comment_label, screen_task_id, observed_issue, concat_ws(chr(1), coalesce(screen_task_id, chr(2)), coalesce(expected_standard, chr(2)), coalesce(observed_issue, chr(2)), coalesce(suggested_fix, chr(2))) AS g, {_BOX} FROM (SELECT *, bounding_box AS b FROM {_ONCE})),
    e AS (SELECT l.k AS a, r.k AS b FROM c l JOIN c r ON l.g = r.g AND l.k <> r.k WHERE (NOT coalesce(l.ok, false) AND NOT coalesce(r.ok, false)) OR (l.ok AND r.ok AND {_OVER} >= 0.5)),
    reach AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a), comp AS (SELECT a AS k, least(a, min(b)) AS component FROM reach GROUP BY a),
    kept AS (SELECT c.* FROM c LEFT JOIN (SELECT k, row_number() OVER (PARTITION BY component ORDER BY comment_label NULLS LAST, k) AS o FROM comp JOIN c USING (k)) d USING (k) WHERE coalesce(o, 1) = 1)"""
_REVIEW_SQL = f"""{_TRIPLET_SQL}, t AS (SELECT * FROM kept WHERE screen_task_id IS NOT NULL AND observed_issue IS NOT NULL),
    f AS (SELECT l.k AS a, r.k AS b FROM t l JOIN t r ON l.screen_task_id = r.screen_task_id AND l.observed_issue = r.observed_issue AND l.k <> r.k WHERE NOT coalesce(l.ok, false) OR NOT coalesce(r.ok, false) OR {_OVER} >= 0.1),
    far AS (SELECT a, b FROM f UNION SELECT far.a, f.b FROM far JOIN f ON far.b = f.a), rev AS (SELECT a AS comment_id, least(a, min(b)) AS component FROM far GROUP BY a)"""


def once(t: Tables) -> DataFrame:
    """Each comment once, by its first record."""
    rest = ["comment_label", *TRIPLET, "bounding_box"]
    first = t("human_comments", "record_id", "comment_id", *rest).groupBy("comment_id").agg(F.min_by(F.struct(*rest), "record_id").alias("r"))
    return first.select("comment_id", "r.*")


def after_triplets(t: Tables) -> DataFrame:
    rows = dedup.drop_exact(once(t), TRIPLET, "comment_id", "comment_label", "bounding_box")
    return rows.withColumn("g", F.when(F.col("screen_task_id").isNotNull() & F.col("observed_issue").isNotNull(), dedup.group_key(["screen_task_id", "observed_issue"])))


@query(f"WITH RECURSIVE {_TRIPLET_SQL} SELECT k AS comment_id FROM kept")
def triplet_dedup(t: Tables):
    """Comments that are no repetition of an earlier one in all three parts and on the same target."""
    return dedup.drop_exact(once(t), TRIPLET, "comment_id", "comment_label", "bounding_box").select("comment_id")


@query(f"WITH RECURSIVE {_REVIEW_SQL} SELECT comment_id, component, count(*) OVER (PARTITION BY component)::BIGINT AS size FROM rev")
def duplicate_review_groups(t: Tables):
    """What is left to look at: the same issue in one task, with boxes that overlap somewhat or are missing."""
    return dedup.duplicate_components(cut_lineage(after_triplets(t)), "g", "comment_id", "bounding_box", S.REVIEW_TARGET, missing_meets_all=True)


@query(f"WITH RECURSIVE {_REVIEW_SQL} SELECT k AS comment_id FROM kept WHERE k NOT IN (SELECT comment_id FROM rev WHERE comment_id <> component)")
def chosen_survivors(t: Tables):
    """The reference after the review, for which the first comment of each group is chosen, with nothing left to look at."""
    rows = cut_lineage(after_triplets(t))
    review = cut_lineage(dedup.duplicate_components(rows, "g", "comment_id", "bounding_box", S.REVIEW_TARGET, missing_meets_all=True))
    kept = dedup.apply_choices(rows, review, "comment_id", review.select(F.col("component").alias("comment_id")))
    return dedup.assert_resolved(kept, "g", "comment_id", "bounding_box").select("comment_id")


@query(f"""WITH RECURSIVE {DEC}, m AS (SELECT a, b, action FROM dec WHERE action IN ('keep_a', 'keep_b')), e AS (SELECT a, b FROM m UNION SELECT b, a FROM m), reach AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
    comp AS (SELECT a AS node, least(a, min(b)) AS component FROM reach GROUP BY a), dropped AS (SELECT DISTINCT CASE action WHEN 'keep_a' THEN b ELSE a END AS node FROM m)
    SELECT component, count(*)::BIGINT AS n_members, count(dropped.node)::BIGINT AS n_dropped, count(*) = count(dropped.node) AS contradiction FROM comp LEFT JOIN dropped USING (node) GROUP BY 1""")
def merge_components(t: Tables):
    """Merged groups, with those whose members are all dropped."""
    return dedup.merge_outcome(decisions(t))


@query(f"""WITH RECURSIVE {DEC}, m AS (SELECT a, b FROM dec WHERE action IN ('keep_a', 'keep_b')), e AS (SELECT a, b FROM m UNION SELECT b, a FROM m), reach AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a)
    SELECT a AS node, least(a, min(b)) AS component FROM reach GROUP BY a""")
def component_labels(t: Tables):
    return components(decisions(t).where(F.col("action").isin("keep_a", "keep_b")))


@query("""SELECT custom_id, CASE WHEN fa = la THEN fa WHEN fa IN ('keep_a', 'keep_b') AND la IN ('keep_a', 'keep_b') AND fr = 'duplicate' AND lr = 'duplicate' THEN 'manual_review' ELSE 'keep_both' END AS decision, fa = la AS agreed FROM
    (SELECT custom_id, arg_min(x, (reviewed_at, x, relationship)) AS fa, arg_max(x, (reviewed_at, x, relationship)) AS la, arg_min(relationship, (reviewed_at, x, relationship)) AS fr, arg_max(relationship, (reviewed_at, x, relationship)) AS lr FROM
    (SELECT *, replace(replace(lower(trim(recommended_action)), ' ', '_'), '-', '_') AS x FROM dup_reviews) WHERE x IS NOT NULL AND x <> 'manual_review' GROUP BY 1)""")
def dup_consensus(t: Tables):
    """The first and the last review of a pair as two judges, and what they come to."""
    df = t("dup_reviews", "custom_id", "recommended_action", "relationship", "reviewed_at").withColumn("x", dedup.action_key(F.col("recommended_action"))).where("x IS NOT NULL AND x <> 'manual_review'")
    row = F.struct("reviewed_at", "x", "relationship")
    two = df.groupBy("custom_id").agg(F.min(row).alias("f"), F.max(row).alias("l"))
    return two.select("custom_id", dedup.consensus_decision(F.col("f.x"), F.col("l.x"), F.col("f.relationship"), F.col("l.relationship")).alias("decision"), (F.col("f.x") == F.col("l.x")).alias("agreed"))


@query(f"""WITH {DEC} SELECT comment_id FROM human_comments WHERE comment_id NOT IN (SELECT CASE action WHEN 'keep_a' THEN b ELSE a END FROM dec WHERE action IN ('keep_a', 'keep_b'))""")
def manual_survivors(t: Tables):
    """Comments that no counted review drops."""
    merges = decisions(t).where(F.col("action").isin("keep_a", "keep_b"))
    dropped = merges.select(F.when(F.col("action") == "keep_a", F.col("b")).otherwise(F.col("a")).alias("comment_id"))
    return t("human_comments", "comment_id").join(dropped, "comment_id", "left_anti")


@query("""SELECT screen_task_id, l.rater_id AS left_rater, r.rater_id AS right_rater, l.usability_rating - r.usability_rating AS diff FROM
    (SELECT screen_task_id, rater_id, max(usability_rating) AS usability_rating FROM raw_critiques GROUP BY ALL) l JOIN (SELECT screen_task_id, rater_id, max(usability_rating) AS usability_rating FROM raw_critiques GROUP BY ALL) r USING (screen_task_id) WHERE l.rater_id < r.rater_id""")
def self_join_pairs(t: Tables):
    """Ordered pairs of raters of a task. A task has each rater once, so there are no more pairs of a task than of raters."""
    df = t("raw_critiques", "screen_task_id", "rater_id", "usability_rating").groupBy("screen_task_id", "rater_id").agg(F.max("usability_rating").alias("u"))
    both = df.select("screen_task_id", F.col("rater_id").alias("left_rater"), F.col("u").alias("lu")).join(df.select("screen_task_id", F.col("rater_id").alias("right_rater"), F.col("u").alias("ru")), "screen_task_id")
    return both.where("left_rater < right_rater").select("screen_task_id", "left_rater", "right_rater", (F.col("lu") - F.col("ru")).alias("diff"))


@query("""SELECT record_id, trim(observed_issue) <> '' AS has_issue FROM human_comments WHERE trim(coalesce(observed_issue, '')) <> ''""")
def issue_filter(t: Tables):
    df = t("human_comments", "record_id", "observed_issue").where("trim(coalesce(observed_issue, '')) <> ''")
    return df.select("record_id", (F.trim("observed_issue") != "").alias("has_issue"))


# ---- judges


@query(f"""WITH {VOTE} SELECT judge_id, count(*)::BIGINT AS n, count(*) FILTER (error IS NULL AND relation IS NOT NULL)::BIGINT AS valid, count(*) FILTER (error = 'http_429')::BIGINT AS http, count(*) FILTER (error = 'invalid_json')::BIGINT AS bad_json,
    count(*) FILTER (error = 'missing_field')::BIGINT AS missing FROM vote GROUP BY 1""")
def judge_latest_valid(t: Tables):
    """The latest vote of each judge on each pair, by outcome."""
    e = F.col("error")
    return votes(t).groupBy("judge_id").agg(F.count("*").alias("n"), F.count_if(e.isNull() & F.col("relation").isNotNull()).alias("valid"), F.count_if(e == "http_429").alias("http"), F.count_if(e == "invalid_json").alias("bad_json"), F.count_if(e == "missing_field").alias("missing"))


@query(f"""WITH {VOTE} SELECT pair_id FROM (SELECT DISTINCT pair_id FROM judge_votes) WHERE pair_id NOT IN (SELECT pair_id FROM vote WHERE relation IS NOT NULL)""")
def failed_ids(t: Tables):
    """Pairs without one valid vote."""
    return t("judge_votes", "pair_id").distinct().join(votes(t).where("relation IS NOT NULL"), "pair_id", "left_anti")


BOTH = f"""{VOTE}, duo AS (SELECT a.pair_id, a.judge_id AS judge_a, b.judge_id AS judge_b, a.relation AS ra, b.relation AS rb, a.confidence AS ca, b.confidence AS cb FROM vote a JOIN vote b ON a.pair_id = b.pair_id AND a.judge_id < b.judge_id)"""
JUDGES = ("judge_a", "judge_b")


def judge_pairs(t: Tables, alone: bool = False) -> DataFrame:
    """Every two judges that voted on a pair, side by side; no more of a pair than its judges squared. With ``alone`` also the only judge of a pair, with nulls for the other."""
    columns = ("judge_id", "relation", "confidence", "error")
    read = votes(t).where("judge_id IS NOT NULL").groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("v"))
    first = read.select("pair_id", "v", F.posexplode("v").alias("at", "a"))
    both = first.select("pair_id", "a", F.size("v").alias("n"), F.explode_outer(F.slice("v", F.col("at") + 2, F.size("v"))).alias("b")).where(F.col("b").isNotNull() | (F.lit(alone) & (F.col("n") == 1)))
    return both.select("pair_id", *(F.col(f"{s}.{c}").alias(f"{'judge' if c == 'judge_id' else c}_{s}") for c in columns for s in ("a", "b")))


@query(f"""WITH {BOTH} SELECT pair_id, judge_a, judge_b, ra AS relation_a, rb AS relation_b, ca AS confidence_a, cb AS confidence_b, coalesce(ra = rb, false) AS agreed FROM duo
    UNION ALL SELECT pair_id, judge_id, NULL, relation, NULL, confidence, NULL, false FROM vote WHERE pair_id IN (SELECT pair_id FROM vote GROUP BY 1 HAVING count(*) = 1)""")
def judge_compare_wide(t: Tables):
    """Every two judges of a pair side by side, and the only judge of a pair."""
    return judge_pairs(t, alone=True).select("pair_id", *JUDGES, "relation_a", "relation_b", "confidence_a", "confidence_b", F.coalesce(F.col("relation_a") == F.col("relation_b"), F.lit(False)).alias("agreed"))


_FALL = "CASE {x} WHEN 'contradiction' THEN 1 WHEN 'no_match' THEN 2 WHEN 'related_but_different' THEN 3 WHEN 'partial_overlap' THEN 4 WHEN 'equivalent' THEN 5 WHEN 'A_broader' THEN 6 WHEN 'B_broader' THEN 7 ELSE 999 END"


@query(f"""WITH {BOTH}, {LBL}, two AS (SELECT duo.*, CASE WHEN l.decision_source = 'manual' THEN l.relation END AS manual FROM duo JOIN lbl l USING (pair_id) WHERE ra IS NOT NULL AND rb IS NOT NULL),
    s AS (SELECT *, coalesce(cb, -1) > coalesce(ca, -1) OR (coalesce(cb, -1) = coalesce(ca, -1) AND {_FALL.format(x='rb')} < {_FALL.format(x='ra')}) AS second FROM two)
    SELECT pair_id, judge_a, judge_b, CASE WHEN ra = rb THEN ra WHEN manual IS NOT NULL THEN manual WHEN second THEN rb ELSE ra END AS relation, round(CASE WHEN ra = rb THEN coalesce((ca + cb) / 2, ca, cb) WHEN manual IS NOT NULL THEN 1 WHEN second THEN coalesce(cb, -1) ELSE coalesce(ca, -1) END, 6)::DOUBLE AS confidence,
    CASE WHEN ra = rb THEN 'judge_agreement' WHEN manual IS NOT NULL THEN 'manual_override' ELSE 'confidence_fallback' END AS decision_source FROM s""")
def match_finalize(t: Tables):
    """The final relation of a pair for every two judges with a valid vote on it, with manual decisions and the fallback."""
    manual = labels(t).select("pair_id", F.when(F.col("decision_source") == "manual", F.col("relation")).alias("manual"))
    two = judge_pairs(t).where("relation_a IS NOT NULL AND relation_b IS NOT NULL").join(M.valid_manual(manual), "pair_id")
    return M.finalize(two).select("pair_id", *JUDGES, "relation", F.round("confidence", 6).alias("confidence"), "decision_source")


@query(f"""WITH {BOTH}, {LBL}, two AS (SELECT duo.*, CASE WHEN l.decision_source = 'manual' THEN l.relation END AS manual FROM duo JOIN lbl l USING (pair_id) WHERE ra IS NOT NULL AND rb IS NOT NULL)
    SELECT judge_a, judge_b, CASE WHEN ra = rb THEN 'judge_agreement' WHEN manual IS NOT NULL THEN 'manual_override' ELSE 'manual_review' END AS decision_source, count(*)::BIGINT AS n,
    round(avg(CASE WHEN ra = rb THEN coalesce((ca + cb) / 2, ca, cb) WHEN manual IS NOT NULL THEN 1 END), 6) AS mean_confidence FROM two GROUP BY ALL""")
def manual_review_counts(t: Tables):
    """What becomes of the pairs of every two judges if disagreement is left to people: agreed, decided by hand, still to review."""
    manual = labels(t).select("pair_id", F.when(F.col("decision_source") == "manual", F.col("relation")).alias("manual"))
    two = judge_pairs(t).where("relation_a IS NOT NULL AND relation_b IS NOT NULL").join(M.valid_manual(manual), "pair_id")
    return M.finalize(two, fallback=False).groupBy(*JUDGES, "decision_source").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


@query(f"""WITH {BOTH} SELECT judge_a, judge_b, least(ra, rb) || ' | ' || greatest(ra, rb) AS label, count(*)::BIGINT AS n FROM duo WHERE ra <> rb GROUP BY ALL""")
def disagreement_pairs(t: Tables):
    """How often every two judges said which two different relations."""
    df = judge_pairs(t).where("relation_a <> relation_b")
    return df.groupBy(*JUDGES, F.concat_ws(" | ", F.least("relation_a", "relation_b"), F.greatest("relation_a", "relation_b")).alias("label")).agg(F.count("*").alias("n"))


@query(f"""WITH {BOTH}, c AS (SELECT judge_a, judge_b, ra, rb, count(*) AS n FROM duo GROUP BY ALL), f AS (SELECT j.judge_a, j.judge_b, x.relation AS relation_a, y.relation AS relation_b FROM (SELECT DISTINCT judge_a, judge_b FROM duo) j, relation_ranks x, relation_ranks y)
    SELECT f.judge_a, f.judge_b, relation_a, relation_b, coalesce(n, 0)::BIGINT AS n FROM f LEFT JOIN c ON c.judge_a = f.judge_a AND c.judge_b = f.judge_b AND ra = relation_a AND rb = relation_b""")
def confusion_fixed_labels(t: Tables):
    """Relations of every two judges against each other, every label of the fixed set included."""
    counts = judge_pairs(t).groupBy(*JUDGES, "relation_a", "relation_b").agg(F.count("*").alias("n"))
    # Seven labels on either side, from arrays.
    every = F.array(*(F.lit(r) for r in M.WEIGHTS))
    full = counts.select(*JUDGES).distinct().select("*", F.explode(every).alias("relation_a")).select("*", F.explode(every).alias("relation_b"))
    return full.join(counts, [*JUDGES, "relation_a", "relation_b"], "left").select(*JUDGES, "relation_a", "relation_b", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


# ---- matching


@query(f"""WITH {LBL} SELECT model_short, expert_comment_id, llm_comment_id, relation, confidence FROM (SELECT *, row_number() OVER (PARTITION BY model_short, expert_comment_id ORDER BY {RANK}, confidence DESC NULLS LAST, pair_id) AS k FROM lbl WHERE relation IS NOT NULL) WHERE k = 1""")
def best_ranked(t: Tables):
    """The best pair of each expert comment and model."""
    return M.best_ranked(labels(t), ["model_short", "expert_comment_id"]).select("model_short", "expert_comment_id", "llm_comment_id", "relation", "confidence")


COVERAGE = f"""{LBL}, cell AS (SELECT model_short, screen_task_id, expert_comment_id, llm_comment_id, max({W}) AS w FROM lbl GROUP BY ALL),
    e AS (SELECT model_short, screen_task_id, avg(w) AS coverage FROM (SELECT model_short, screen_task_id, expert_comment_id, max(w) AS w FROM cell GROUP BY ALL) GROUP BY ALL),
    l AS (SELECT model_short, screen_task_id, avg(w) AS support FROM (SELECT model_short, screen_task_id, llm_comment_id, max(w) AS w FROM cell GROUP BY ALL) GROUP BY ALL)"""


@query(f"""WITH {COVERAGE} SELECT model_short, round(avg(coverage), 6) AS coverage, round(avg(support), 6) AS support, count(*)::BIGINT AS n_tasks FROM e JOIN l USING (model_short, screen_task_id) GROUP BY 1""")
def match_macro_coverage(t: Tables):
    """Coverage and support by model, averaged over tasks."""
    per_task = M.unconstrained(M.cell_matrix(labels(t), ["model_short", "screen_task_id"]), ["model_short", "screen_task_id"])
    return per_task.groupBy("model_short").agg(F.round(F.avg("coverage"), 6).alias("coverage"), F.round(F.avg("support"), 6).alias("support"), F.count("*").alias("n_tasks"))


@query(f"""WITH {LBL} SELECT model_short, screen_task_id, expert_comment_id, llm_comment_id, max({W}) AS weight FROM lbl GROUP BY ALL""")
def cell_matrix_max(t: Tables):
    return M.cell_matrix(labels(t), ["model_short", "screen_task_id"])


@query()
def bipartite_coverage(t: Tables):
    """Coverage and support by model when a comment may be matched once, averaged over tasks."""
    per_task = M.bipartite(M.cell_matrix(labels(t), ["model_short", "screen_task_id"]), ["model_short", "screen_task_id"])
    return per_task.groupBy("model_short").agg(F.round(F.avg("coverage"), 6).alias("coverage"), F.round(F.avg("support"), 6).alias("support"), F.sum("matched").alias("matched"))


@query()
def fixed_k(t: Tables):
    """bipartite_coverage over the first 1, 3 and 5 model comments of each task."""
    cells = M.cell_matrix(labels(t), ["model_short", "screen_task_id"])
    ids = cells.select("model_short", "screen_task_id", "llm_comment_id").distinct()
    first = R.first_per_key(ids, ["model_short", "screen_task_id"], [F.asc("llm_comment_id")], 5)
    place = R.with_sequence(first, ["model_short", "screen_task_id"], [F.asc("llm_comment_id")], "place").withColumn("k", F.explode(F.array(F.lit(1), F.lit(3), F.lit(5)))).where("place <= k")
    keys = ["model_short", "screen_task_id", "k"]
    per_task = M.bipartite(cells.join(place.drop("place"), ["model_short", "screen_task_id", "llm_comment_id"]), keys)
    return per_task.groupBy("model_short", "k").agg(F.round(F.avg("coverage"), 6).alias("coverage"), F.round(F.avg("support"), 6).alias("support"))


@query(f"""WITH {LBL} SELECT k, model_short, count(*)::BIGINT AS n FROM (SELECT *, row_number() OVER (PARTITION BY model_short, screen_task_id ORDER BY llm_comment_id) AS place FROM (SELECT DISTINCT model_short, screen_task_id, llm_comment_id FROM lbl)),
    (SELECT unnest([1, 3, 5])::INT AS k) WHERE place <= k GROUP BY ALL""")
def first_k_positions(t: Tables):
    """Model comments among the first 1, 3 and 5 of their task."""
    ids = t("match_pairs", "model_short", "screen_task_id", "llm_comment_id").distinct()
    first = R.first_per_key(ids, ["model_short", "screen_task_id"], [F.asc("llm_comment_id")], 5)
    place = R.with_sequence(first, ["model_short", "screen_task_id"], [F.asc("llm_comment_id")], "place").withColumn("k", F.explode(F.array(F.lit(1), F.lit(3), F.lit(5)))).where("place <= k")
    return place.groupBy("k", "model_short").agg(F.count("*").alias("n"))


@query(f"""WITH {LBL}, o AS (SELECT model_short, expert_comment_id, CASE WHEN bool_or(relation IN ('equivalent', 'A_broader', 'B_broader')) THEN 'covered' WHEN bool_or(relation = 'partial_overlap') THEN 'partial' WHEN bool_or(relation = 'contradiction') THEN 'contradicted'
    WHEN bool_or(relation = 'related_but_different') THEN 'related' ELSE 'missed' END AS outcome FROM lbl GROUP BY ALL) SELECT model_short, outcome, n, round(100.0 * n / sum(n) OVER (PARTITION BY model_short), 4)::DOUBLE AS pct FROM (SELECT model_short, outcome, count(*)::BIGINT AS n FROM o GROUP BY ALL)""")
def non_coverage(t: Tables):
    """Why expert comments are not covered: the first outcome of a rule table that any of their pairs meets."""
    r = F.col("relation")
    rules = [("covered", r.isin("equivalent", "A_broader", "B_broader")), ("partial", r == "partial_overlap"), ("contradicted", r == "contradiction"), ("related", r == "related_but_different")]
    counts = R.rule_table(labels(t), ["model_short", "expert_comment_id"], rules, "missed").groupBy("model_short", "outcome").agg(F.count("*").alias("n"))
    return R.share_of_group(counts, ["model_short"], "n", "pct").withColumn("pct", F.round(F.col("pct") * 100, 4))


@query(f"""WITH {LBL}, b AS (SELECT expert_comment_id, model_short, min({RANK}) AS r FROM lbl WHERE relation IS NOT NULL GROUP BY ALL) SELECT expert_comment_id, count(*)::BIGINT AS n_models FROM b WHERE r >= 6 GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT model_short) FROM lbl)""")
def unmatched_all(t: Tables):
    """Expert comments that no model matched."""
    best = labels(t).where("relation IS NOT NULL").groupBy("expert_comment_id", "model_short").agg(F.min(M.relation_rank(F.col("relation"))).alias("r"))
    n_models = t("match_pairs", "model_short").distinct().count()
    return best.where("r >= 6").groupBy("expert_comment_id").agg(F.count("*").alias("n_models")).where(F.col("n_models") == n_models)


@query(f"""WITH {LBL}, b AS (SELECT expert_comment_id, model_short, min({RANK}) <= 3 AS c FROM lbl WHERE relation IS NOT NULL GROUP BY ALL), s AS (SELECT expert_comment_id, sum(c::INT) AS k FROM b GROUP BY 1)
    SELECT model_short, (k - c::INT)::BIGINT AS others, count(*)::BIGINT AS n FROM b JOIN s USING (expert_comment_id) GROUP BY ALL""")
def other_models_covered(t: Tables):
    """By how many other models a model's expert comments are covered."""
    best = labels(t).where("relation IS NOT NULL").groupBy("expert_comment_id", "model_short").agg((F.min(M.relation_rank(F.col("relation"))) <= 3).cast("long").alias("c"))
    others = F.sum("c").over(Window.partitionBy("expert_comment_id")) - F.col("c")
    return best.withColumn("others", others).groupBy("model_short", "others").agg(F.count("*").alias("n"))


@query(f"""WITH {LBL} SELECT model_short, count(DISTINCT expert_comment_id)::BIGINT AS n_expert, count(DISTINCT expert_comment_id) FILTER (relation = 'contradiction')::BIGINT AS contradicted,
    round(count(DISTINCT expert_comment_id) FILTER (relation = 'contradiction') / count(DISTINCT expert_comment_id), 6)::DOUBLE AS rate FROM lbl GROUP BY 1""")
def contradiction_rates(t: Tables):
    hit = F.bool_or(F.coalesce(F.col("relation") == "contradiction", F.lit(False))).cast("long")
    per = labels(t).groupBy("model_short", "expert_comment_id").agg(hit.alias("c"))
    return per.groupBy("model_short").agg(F.count("*").alias("n_expert"), F.sum("c").alias("contradicted"), F.round(F.avg("c"), 6).alias("rate"))


@query(f"""WITH {VOTE}, m AS (SELECT pair_id, avg((relation = 'no_match')::INT) > 0.5 AS no_match FROM vote WHERE relation IS NOT NULL GROUP BY 1) SELECT model_short, round(avg(confidence) FILTER (no_match), 6) AS mean_dependent, round(avg(confidence) FILTER (NOT no_match), 6) AS mean_other, count(*)::BIGINT AS n
    FROM (SELECT pair_id, model_short, max(CASE WHEN isnan(confidence) THEN NULL ELSE confidence END) AS confidence FROM match_pairs GROUP BY ALL) JOIN m USING (pair_id) GROUP BY 1""")
def dependency_summary(t: Tables):
    """Mean confidence of pairs that most judges call no match, and of the others."""
    major = votes(t).where("relation IS NOT NULL").groupBy("pair_id").agg((F.avg((F.col("relation") == "no_match").cast("int")) > 0.5).alias("flag"))
    pairs = t("match_pairs", "pair_id", "model_short", "confidence").groupBy("pair_id", "model_short").agg(F.max(F.when(~F.isnan("confidence"), F.col("confidence"))).alias("c"))
    return pairs.join(major, "pair_id").groupBy("model_short").agg(F.round(F.avg(F.when(F.col("flag"), F.col("c"))), 6).alias("mean_dependent"), F.round(F.avg(F.when(~F.col("flag"), F.col("c"))), 6).alias("mean_other"), F.count("*").alias("n"))


@query(f"""WITH {LBL} SELECT model_short, count(*)::BIGINT AS n_pairs, count(DISTINCT screen_task_id)::BIGINT AS n_tasks, count(DISTINCT expert_comment_id)::BIGINT AS n_expert, round(count(*) / count(DISTINCT screen_task_id), 6)::DOUBLE AS per_task FROM lbl GROUP BY 1""")
def task_volume(t: Tables):
    per = labels(t).groupBy("model_short", "screen_task_id", "expert_comment_id").agg(F.count("*").alias("n"))
    return per.groupBy("model_short").agg(F.sum("n").alias("n_pairs"), F.count_distinct("screen_task_id").alias("n_tasks"), F.count_distinct("expert_comment_id").alias("n_expert")).withColumn("per_task", F.round(F.col("n_pairs") / F.col("n_tasks"), 6))


@query(f"""WITH {LBL}, b AS (SELECT model_short, app_category, expert_comment_id, relation, row_number() OVER (PARTITION BY model_short, expert_comment_id ORDER BY {RANK}, confidence DESC NULLS LAST, pair_id) AS k, pair_id FROM lbl WHERE relation IS NOT NULL)
    SELECT section, model_short, count(*)::BIGINT AS n FROM (SELECT CASE WHEN relation IN ('equivalent', 'A_broader', 'B_broader') THEN 'covered' WHEN relation = 'contradiction' THEN 'contradiction' ELSE 'unmatched' END AS section, model_short FROM b WHERE k = 1) GROUP BY ALL""")
def review_population(t: Tables):
    """Expert comments to review, by section and model."""
    r = F.col("relation")
    section = F.when(r.isin("equivalent", "A_broader", "B_broader"), "covered").when(r == "contradiction", "contradiction").otherwise("unmatched")
    return M.best_ranked(labels(t), ["model_short", "expert_comment_id"]).groupBy(section.alias("section"), "model_short").agg(F.count("*").alias("n"))


@query(f"""WITH {LBL}, s AS (SELECT model_short, app_category, pair_id, row_number() OVER (PARTITION BY model_short, app_category ORDER BY md5(pair_id || '42'), pair_id) AS k FROM lbl WHERE app_category IS NOT NULL AND relation IS NOT NULL),
    f AS (SELECT *, row_number() OVER (PARTITION BY model_short ORDER BY (k > 1)::INT, md5(pair_id || '42'), pair_id) AS place FROM s) SELECT model_short, app_category, pair_id FROM f WHERE place <= 50""")
def stratified_sample(t: Tables):
    """Fifty pairs of each model: one of each category first, then by random key."""
    df = labels(t).where("app_category IS NOT NULL AND relation IS NOT NULL").select("model_short", "app_category", "pair_id").withColumn("key", F.md5(F.concat("pair_id", F.lit("42"))))
    # The first of each category, and the fifty smallest keys of each model, hold every pair that can be drawn.
    one = df.groupBy("model_short", "app_category").agg(F.min(F.struct("key", "pair_id")).alias("s")).select("model_short", "app_category", "s.pair_id", "s.key", F.lit(0).alias("late"))
    rest = R.first_per_key(df, ["model_short"], [F.asc("key"), F.asc("pair_id")], 100).join(one, "pair_id", "left_anti").withColumn("late", F.lit(1))
    both = one.unionByName(rest)
    return R.first_per_key(both, ["model_short"], [F.asc("late"), F.asc("key"), F.asc("pair_id")], 50).select("model_short", "app_category", "pair_id")


@query(f"""WITH {LBL} SELECT 'pairs without relation' AS check_name, count(*) FILTER (relation IS NULL)::BIGINT AS n FROM lbl UNION ALL SELECT 'pairs without confidence', count(*) FILTER (confidence IS NULL)::BIGINT FROM lbl
    UNION ALL SELECT 'pairs without expert comment', count(*)::BIGINT FROM lbl WHERE expert_comment_id NOT IN (SELECT comment_id FROM human_comments) UNION ALL SELECT 'repeated pair ids', (SELECT count(*) - count(DISTINCT pair_id) FROM match_pairs)::BIGINT""")
def input_validation(t: Tables):
    """Checks of the labels, each with the number of rows that fail it."""
    lbl = labels(t)
    counts = lbl.agg(F.count_if(F.col("relation").isNull()).alias("r"), F.count_if(F.col("confidence").isNull()).alias("c"))
    orphans = lbl.join(t("human_comments", F.col("comment_id").alias("expert_comment_id")), "expert_comment_id", "left_anti").agg(F.count("*").alias("n"))
    repeated = t("match_pairs", "pair_id").groupBy("pair_id").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n"))
    out = counts.selectExpr("stack(2, 'pairs without relation', r, 'pairs without confidence', c) AS (check_name, n)")
    return out.unionByName(orphans.select(F.lit("pairs without expert comment").alias("check_name"), "n")).unionByName(repeated.select(F.lit("repeated pair ids").alias("check_name"), "n"))


@query("""SELECT judge_id, relation, n FROM (SELECT judge_id, coalesce(relation, '(null)') AS relation, count(*)::BIGINT AS n FROM judge_votes GROUP BY ALL) WHERE relation NOT IN (SELECT relation FROM relation_ranks)""")
def code_validation(t: Tables):
    """Codes that are not allowed as they stand, by judge."""
    counts = t("judge_votes", "judge_id", "relation").groupBy("judge_id", F.coalesce("relation", F.lit("(null)")).alias("relation")).agg(F.count("*").alias("n"))
    return counts.join(t("relation_ranks", "relation"), "relation", "left_anti").select("judge_id", "relation", "n")


@query("""SELECT field, value, model_short, n, n || ' (' || printf('%.1f', 100.0 * n / sum(n) OVER (PARTITION BY field, model_short)) || '%)' AS text FROM
    (SELECT 'relation' AS field, coalesce(relation, '(null)') AS value, model_short, count(*)::BIGINT AS n FROM match_pairs GROUP BY ALL UNION ALL SELECT 'decision_source', coalesce(decision_source, '(null)'), model_short, count(*)::BIGINT FROM match_pairs GROUP BY ALL)""")
def audit_summary(t: Tables):
    """Codes by field, value and model as "n (pct%)"."""
    counts = t("match_pairs", "relation", "decision_source", "model_short").groupBy("relation", "decision_source", "model_short").agg(F.count("*").alias("n"))
    long = counts.selectExpr("model_short", "n", "stack(2, 'relation', relation, 'decision_source', decision_source) AS (field, value)").groupBy("field", F.coalesce("value", F.lit("(null)")).alias("value"), "model_short").agg(F.sum("n").alias("n"))
    pct = 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("field", "model_short"))
    return long.select("field", "value", "model_short", "n", F.format_string("%d (%.1f%%)", "n", pct).alias("text"))


@query("""SELECT model_short, count(*)::BIGINT AS n, count(relation)::BIGINT AS judged, count(*) FILTER (decision_source = 'manual')::BIGINT AS manual, count(*) FILTER (relation IS NULL)::BIGINT AS open FROM match_pairs GROUP BY 1""")
def progress_counts(t: Tables):
    df = t("match_pairs", "model_short", "relation", "decision_source")
    return df.groupBy("model_short").agg(F.count("*").alias("n"), F.count("relation").alias("judged"), F.count_if(F.col("decision_source") == "manual").alias("manual"), F.count_if(F.col("relation").isNull()).alias("open"))


@query("""SELECT llm_comment_id, o.pair_id, o.relation, o.other_task FROM (SELECT m.llm_comment_id, m.pair_id, m.relation, m.screen_task_id <> s.screen_task_id AS other_task FROM match_pairs m JOIN (SELECT comment_id, screen_task_id FROM human_comments) s ON m.expert_comment_id = s.comment_id) o""")
def screen_comments_across_tasks(t: Tables):
    """Pairs with whether the expert comment stands under another task."""
    experts = t("human_comments", F.col("comment_id").alias("expert_comment_id"), F.col("screen_task_id").alias("task"))
    df = t("match_pairs", "llm_comment_id", "pair_id", "relation", "screen_task_id", "expert_comment_id").join(experts, "expert_comment_id")
    return df.select("llm_comment_id", "pair_id", "relation", (F.col("screen_task_id") != F.col("task")).alias("other_task"))


@query(f"""WITH {LBL} SELECT model_short, text, n, round(w, 6) AS mean_weight FROM (SELECT model_short, lower(trim(llm_observed_issue)) AS text, count(DISTINCT pair_id)::BIGINT AS n, avg(w) AS w FROM (SELECT m.model_short, m.llm_observed_issue, m.pair_id, {W.replace('relation', 'l.relation')} AS w FROM (SELECT DISTINCT model_short, llm_observed_issue, pair_id FROM match_pairs) m JOIN lbl l USING (pair_id))
    GROUP BY ALL) WHERE n >= 10 AND text IS NOT NULL""")
def template_sensitivity(t: Tables):
    """Texts that a model used ten times or more, with the mean weight of their pairs."""
    texts = t("match_pairs", "model_short", "llm_observed_issue", "pair_id").distinct().withColumn("text", F.lower(F.trim("llm_observed_issue"))).where("text IS NOT NULL")
    both = texts.join(labels(t).select("pair_id", F.coalesce(M.relation_weight(F.col("relation")), F.lit(0.0)).alias("w")), "pair_id")
    return both.groupBy("model_short", "text").agg(F.count_distinct("pair_id").alias("n"), F.round(F.avg("w"), 6).alias("mean_weight")).where("n >= 10")


@query(f"""WITH {LBL}, b AS (SELECT model_short, expert_comment_id, min({RANK}) AS r FROM lbl WHERE relation IS NOT NULL GROUP BY ALL) SELECT h.comment_id, p.model_short, b.r::INT AS best_rank FROM human_comments h JOIN (SELECT DISTINCT model_short, expert_comment_id FROM match_pairs) p ON h.comment_id = p.expert_comment_id LEFT JOIN b USING (model_short, expert_comment_id)""")
def coverage_selection(t: Tables):
    """The best relation of every expert comment and model that were paired, null where none was judged."""
    best = labels(t).where("relation IS NOT NULL").groupBy("model_short", "expert_comment_id").agg(F.min(M.relation_rank(F.col("relation"))).alias("best_rank"))
    paired = t("match_pairs", "model_short", "expert_comment_id").distinct()
    return t("human_comments", F.col("comment_id").alias("expert_comment_id")).join(paired, "expert_comment_id").join(best, ["model_short", "expert_comment_id"], "left").select(F.col("expert_comment_id").alias("comment_id"), "model_short", "best_rank")


@query()
def pairs_within_critique(t: Tables):
    """Every pair of an expert's and a model's comment of one critique; the lists are paired inside their row, without a join."""
    df = t("raw_critiques", "critique_id", "comments", "comments_source").select("critique_id", F.arrays_zip(S.literal_list(F.col("comments")).alias("c"), S.literal_list(F.col("comments_source")).alias("s")).alias("z"))
    human = df.select("critique_id", "z", F.posexplode(F.filter("z", lambda x: x["s"] == "human")).alias("left_pos", "l"))
    both = human.select("critique_id", "left_pos", F.col("l.c").alias("left_comment"), F.posexplode(F.filter("z", lambda x: x["s"] == "llm")).alias("right_pos", "r"))
    return both.select("critique_id", "left_pos", "right_pos", "left_comment", F.col("r.c").alias("right_comment"))


@query("""SELECT model_short || '_' || expert_comment_id || '_' || regexp_extract(llm_comment_id, '[^_]*$') AS pair_id, model_short, screen_task_id, expert_comment_id, llm_comment_id
    FROM (SELECT DISTINCT screen_task_id, comment_id AS expert_comment_id FROM human_comments) JOIN (SELECT DISTINCT model_short, screen_task_id, llm_comment_id FROM match_pairs) USING (screen_task_id)""")
def expert_llm_pairs(t: Tables):
    """Every reference comment of a task with every model comment of it, tasks of any size included."""
    experts = t("human_comments", "screen_task_id", F.col("comment_id").alias("expert_comment_id")).distinct()
    models = t("match_pairs", "model_short", "screen_task_id", "llm_comment_id").distinct()
    return M.comment_pairs(experts, models).select("pair_id", "model_short", "screen_task_id", "expert_comment_id", "llm_comment_id")


# ---- flags


FLAGS = ["same_usability_problem", "logical_conflict"]
_SAME = "CASE {x} WHEN 'equivalent' THEN 'yes' WHEN 'A_broader' THEN 'yes' WHEN 'B_broader' THEN 'partial' WHEN 'partial_overlap' THEN 'partial' ELSE 'no' END"


def flagged(t: Tables, two: DataFrame) -> DataFrame:
    """Pairs read by two judges (``two``), whose flags are told from their relations, with the final relation of the labels."""
    problem = lambda r: F.when(r.isin("equivalent", "A_broader"), "yes").when(r.isin("B_broader", "partial_overlap"), "partial").otherwise("no")
    conflict = lambda r: F.when(r == "contradiction", "yes").otherwise("no")
    two = two.where("relation_a IS NOT NULL AND relation_b IS NOT NULL")
    for s in ("a", "b"):
        r = F.col(f"relation_{s}")
        two = two.withColumn(f"same_usability_problem_{s}", problem(r)).withColumn(f"logical_conflict_{s}", conflict(r))
    final = labels(t).select("pair_id", "relation", F.when(F.col("decision_source") == "manual", "manual_override").otherwise("judges").alias("decision_source"))
    return M.finalize_flags(two.join(final, "pair_id"), FLAGS)


_FLAGS_ALL = f"""WITH {BOTH}, {LBL}, i AS (SELECT duo.*, l.decision_source = 'manual' AS manual, {_SAME.format(x='ra')} AS fa, {_SAME.format(x='rb')} AS fb, coalesce(l.relation = ra, false) AS ka, coalesce(l.relation = rb, false) AS kb,
    CASE l.relation WHEN 'equivalent' THEN 'yes' WHEN 'A_broader' THEN 'yes' WHEN 'B_broader' THEN 'yes' WHEN 'partial_overlap' THEN 'partial' WHEN 'related_but_different' THEN 'no' WHEN 'no_match' THEN 'no' END AS follows FROM duo JOIN lbl l USING (pair_id) WHERE ra IS NOT NULL AND rb IS NOT NULL),
    f AS (SELECT pair_id, judge_a, judge_b, follows, CASE WHEN manual AND follows IS NOT NULL THEN follows WHEN fa = fb THEN fa WHEN ka AND NOT kb THEN fa WHEN kb AND NOT ka THEN fb ELSE 'disagree' END AS same_usability_problem FROM i)"""


@query(_FLAGS_ALL + " SELECT pair_id, judge_a, judge_b, same_usability_problem FROM f")
def flag_finalize(t: Tables):
    """The final flag of a pair for every two judges with a valid vote on it."""
    return flagged(t, judge_pairs(t)).select("pair_id", *JUDGES, "same_usability_problem")


@query(_FLAGS_ALL + " SELECT judge_a, judge_b, 'same_usability_problem' AS flag, count(follows)::BIGINT AS n, round(avg((same_usability_problem = follows)::INT), 6) AS share FROM f GROUP BY ALL")
def flag_consistency(t: Tables):
    """How far the final flags of every two judges are what the final relations imply."""
    return M.flag_consistency(flagged(t, judge_pairs(t)), FLAGS[:1], JUDGES).withColumn("share", F.round("share", 6))


@query("""SELECT coalesce(model_short, '(all)') AS model_short, coalesce(relation, '(all)') AS relation, sum(n)::BIGINT AS n FROM (SELECT model_short, coalesce(relation, '(null)') AS relation, count(*) AS n FROM match_pairs GROUP BY ALL) GROUP BY CUBE (model_short, relation)""")
def crosstab_margins(t: Tables):
    return R.crosstab(t("match_pairs", "model_short", "relation"), "model_short", "relation")


@query("""WITH c AS (SELECT coalesce(model_short, '(null)') AS model_short, coalesce((relation = 'contradiction')::VARCHAR, '(null)') AS contradiction, coalesce(decision_source, '(null)') AS decision_source FROM match_pairs)
    SELECT model_short, contradiction, decision_source, count(*)::BIGINT AS n FROM c GROUP BY ALL UNION ALL SELECT model_short, contradiction, '(all)', count(*)::BIGINT FROM c GROUP BY ALL
    UNION ALL SELECT '(all)', '(all)', decision_source, count(*)::BIGINT FROM c GROUP BY ALL UNION ALL SELECT '(all)', '(all)', '(all)', count(*)::BIGINT FROM c""")
def crosstab_two_keys(t: Tables):
    """Models and whether they contradict, against how it was decided, with margins."""
    return R.crosstab(t("match_pairs", "model_short", "relation", "decision_source").withColumn("contradiction", F.col("relation") == "contradiction"), ["model_short", "contradiction"], "decision_source")


@query("""SELECT model_short, relation, n, round(n / sum(n) OVER (PARTITION BY model_short), 6)::DOUBLE AS share FROM (SELECT model_short, coalesce(relation, '(null)') AS relation, count(*)::BIGINT AS n FROM match_pairs GROUP BY ALL)""")
def crosstab_row_shares(t: Tables):
    return R.row_shares(t("match_pairs", "model_short", "relation"), ["model_short"], "relation").withColumn("share", F.round("share", 6))


@query("""SELECT vote_id, field, value, CASE WHEN field = 'note' THEN 'unknown field' ELSE 'value not allowed' END AS reason FROM (SELECT vote_id, unnest(['relation', 'note']) AS field, unnest([relation, judge_id]) AS value FROM judge_votes)
    WHERE field = 'note' OR (value IS NOT NULL AND value NOT IN (SELECT relation FROM relation_ranks))""")
def codebook_validation(t: Tables):
    """Codes of votes that the codebook does not allow: relations that are none as they stand, and a field that it does not know."""
    codes = t("judge_votes", "vote_id", "relation", "judge_id").selectExpr("vote_id", "stack(2, 'relation', relation, 'note', judge_id) AS (field, value)")
    return R.invalid_codes(codes, t("relation_ranks", F.lit("relation").alias("field"), F.col("relation").alias("value"))).select("vote_id", "field", "value", "reason")
