"""Ratings of tasks: raters against the first one of each task, by aspect."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions import scalars as S
from assayer.operators import matching as M, reshape as R, stats as T
from assayer.operators.lookup import lookup_join
from assayer.plans import agreement as A
from assayer.plans.prepare import ASPECTS, SCALES
from assayer.plans.registry import Registry, Tables

registry = Registry()
query = registry.query

# The first rater of a task stands for the expert, the others for models; the half-year stands for the prompting.
LONG_SQL = (
    "long AS (SELECT l.screen_task_id, l.rater_id AS model, l.prompting, l.aspect, e.score AS expert_score, l.score AS llm_score, l.score - e.score AS delta FROM s l JOIN s e ON l.screen_task_id = e.screen_task_id AND l.aspect = e.aspect "
    "AND e.first AND NOT l.first)"
)
RATED_SQL = (
    "WITH r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY screen_task_id, rater_id ORDER BY rated_at DESC, critique_id DESC) AS k FROM raw_critiques) WHERE k = 1), "
    "s AS (SELECT screen_task_id, rater_id, CASE WHEN rated_at < TIMESTAMP '2025-09-01' THEN 'zero_shot' ELSE 'few_shot' END AS prompting, rater_id = min(rater_id) OVER (PARTITION BY screen_task_id) AS first, aspect, score FROM (UNPIVOT (SELECT screen_task_id, rater_id, rated_at, "
    + ", ".join(ASPECTS)
    + " FROM r) ON " + ", ".join(ASPECTS) + " INTO NAME aspect VALUE score) WHERE score BETWEEN 1 AND CASE WHEN aspect IN ('learnability', 'efficiency') THEN 5 ELSE 10 END), "
    + LONG_SQL
)
SCALE_SQL = "CASE WHEN aspect IN ('learnability', 'efficiency') THEN 5 ELSE 10 END"


def scale(aspect: str = "aspect"):
    return F.when(F.col(aspect).isin("learnability", "efficiency"), 5).otherwise(10)


def scores(t: Tables) -> DataFrame:
    """screen_task_id, rater_id, prompting, first, aspect, score of the latest row of each rater and task, without scores off the scale."""
    df = t("raw_critiques", "critique_id", "screen_task_id", "rater_id", "rated_at", *ASPECTS)
    latest = df.groupBy("screen_task_id", "rater_id").agg(F.max(F.struct("rated_at", "critique_id", *ASPECTS)).alias("r")).select("screen_task_id", "rater_id", "r.rated_at", *(f"r.{a}" for a in ASPECTS))
    # "first" is told before the long form, over the raters of a task.
    firsts = latest.groupBy("screen_task_id").agg(F.min("rater_id").alias("first_rater"))
    prompting = F.when(F.col("rated_at") < F.lit("2025-09-01").cast("timestamp_ntz"), "zero_shot").otherwise("few_shot")
    wide = latest.join(firsts, "screen_task_id").withColumn("prompting", prompting).withColumn("first", F.col("rater_id") == F.col("first_rater"))
    long = R.unpivot(wide, ["screen_task_id", "rater_id", "prompting", "first"], ASPECTS, "aspect", "score")
    return long.where(F.col("score").between(1, scale()))


def rating_long(t: Tables) -> DataFrame:
    """One row per task, model and aspect with both scores and their difference. "first" depends on valid scores of the task's first rater."""
    s = scores(t)
    expert = s.where("first").select("screen_task_id", "aspect", F.col("score").alias("expert_score"))
    model = s.where("NOT first").select("screen_task_id", F.col("rater_id").alias("model"), "prompting", "aspect", F.col("score").alias("llm_score"))
    return model.join(expert, ["screen_task_id", "aspect"]).withColumn("delta", F.col("llm_score") - F.col("expert_score"))


@query(RATED_SQL + "SELECT screen_task_id, model, prompting, aspect, expert_score, llm_score, delta FROM long")
def melt_scores(t: Tables):
    return rating_long(t).select("screen_task_id", "model", "prompting", "aspect", "expert_score", "llm_score", "delta")


@query(RATED_SQL + """SELECT model, prompting, aspect, count(*)::BIGINT AS n, round(avg(llm_score), 6) AS mean, round(stddev_samp(llm_score), 6) AS sd, quantile_cont(llm_score, 0.25)::DOUBLE AS q1, quantile_cont(llm_score, 0.5)::DOUBLE AS median, quantile_cont(llm_score, 0.75)::DOUBLE AS q3,
    min(llm_score)::INT AS low, max(llm_score)::INT AS high FROM long GROUP BY ALL""")
def rating_summary(t: Tables):
    v = "llm_score"
    q = lambda p: F.percentile(v, F.lit(p))
    return rating_long(t).groupBy("model", "prompting", "aspect").agg(F.count("*").alias("n"), F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_samp(v), 6).alias("sd"), q(0.25).alias("q1"), q(0.5).alias("median"), q(0.75).alias("q3"), F.min(v).alias("low"), F.max(v).alias("high"))


@query(RATED_SQL + """SELECT aspect, expert_score, model, round(avg(llm_score), 6) AS mean, round(1.96 * stddev_samp(llm_score) / sqrt(count(*)), 6) AS half, count(*)::BIGINT AS n FROM long GROUP BY ALL HAVING count(*) >= 5""")
def calibration(t: Tables):
    """Mean score by the expert's, with a band, where at least five rows stand behind it."""
    v = "llm_score"
    return rating_long(t).groupBy("aspect", "expert_score", "model").agg(F.round(F.avg(v), 6).alias("mean"), F.round(1.96 * F.stddev_samp(v) / F.sqrt(F.count("*")), 6).alias("half"), F.count("*").alias("n")).where("n >= 5")


_BIN = "CASE WHEN {x} <= CASE WHEN {s} = 10 THEN 3 ELSE 2 END THEN 'low' WHEN {x} <= CASE WHEN {s} = 10 THEN 7 ELSE 4 END THEN 'mid' ELSE 'high' END"


@query(RATED_SQL + f"SELECT aspect, model, {_BIN.format(x='expert_score', s=SCALE_SQL)} AS bin, round(avg(abs(delta)), 6) AS mae, count(*)::BIGINT AS n FROM long GROUP BY ALL")
def ratings_error_by_bin(t: Tables):
    return rating_long(t).groupBy("aspect", "model", S.binned(F.col("expert_score"), scale()).alias("bin")).agg(F.round(F.avg(F.abs("delta")), 6).alias("mae"), F.count("*").alias("n"))


@query(RATED_SQL + f""", b AS (SELECT model, aspect, CASE WHEN {_BIN.format(x='expert_score', s=SCALE_SQL)} = 'low' THEN 1 WHEN {_BIN.format(x='expert_score', s=SCALE_SQL)} = 'mid' THEN 2 ELSE 3 END AS e, CASE WHEN {_BIN.format(x='llm_score', s=SCALE_SQL)} = 'low' THEN 1 WHEN {_BIN.format(x='llm_score', s=SCALE_SQL)} = 'mid' THEN 2 ELSE 3 END AS l FROM long)
    SELECT model, aspect, e::INT AS expert_bin, round(avg((l < e)::INT), 6) AS below, round(avg((l = e)::INT), 6) AS same, round(avg((l > e)::INT), 6) AS above FROM b GROUP BY ALL""")
def bin_shift(t: Tables):
    """Shares of scores in a lower, the same and a higher bin than the expert's."""
    rank = lambda c: F.element_at(F.create_map(F.lit("low"), F.lit(1), F.lit("mid"), F.lit(2), F.lit("high"), F.lit(3)), S.binned(F.col(c), scale()))
    df = rating_long(t).withColumn("e", rank("expert_score")).withColumn("l", rank("llm_score"))
    share = lambda c: F.round(F.avg(c.cast("int")), 6)
    return df.groupBy("model", "aspect", F.col("e").alias("expert_bin")).agg(share(F.col("l") < F.col("e")).alias("below"), share(F.col("l") == F.col("e")).alias("same"), share(F.col("l") > F.col("e")).alias("above"))


@query(RATED_SQL + """, n AS (SELECT screen_task_id, CASE WHEN count(*) >= 5 THEN '5+' ELSE greatest(count(*), 1)::VARCHAR END AS bucket FROM human_comments GROUP BY 1), m AS (SELECT model, bucket, avg(delta) AS d FROM long JOIN n USING (screen_task_id) GROUP BY ALL)
    SELECT model, bucket, round(d, 6) AS bias, round(d - first_value(d) OVER (PARTITION BY model ORDER BY bucket), 6) AS beyond_first FROM m""")
def issue_bucket_bias(t: Tables):
    """Bias by the number of comments on the task, against the first bucket."""
    n = t("human_comments", "screen_task_id").groupBy("screen_task_id").agg(S.issue_bucket(F.count("*")).alias("bucket"))
    m = rating_long(t).join(n, "screen_task_id").groupBy("model", "bucket").agg(F.avg("delta").alias("d"))
    return m.select("model", "bucket", F.round("d", 6).alias("bias"), F.round(F.col("d") - F.first("d").over(Window.partitionBy("model").orderBy("bucket")), 6).alias("beyond_first"))


@query(RATED_SQL + f""", c AS (SELECT screen_task_id, CASE WHEN app_category IS NULL THEN 'Unknown' WHEN count(*) OVER (PARTITION BY app_category) >= 10 THEN app_category ELSE 'Other' END AS category FROM screen_tasks)
    SELECT category, model, round(avg(100.0 * abs(delta) / ({SCALE_SQL} - 1)), 6) AS error, count(*)::BIGINT AS n FROM long JOIN c USING (screen_task_id) GROUP BY ALL""")
def category_error(t: Tables):
    """Error in percent of the scale by category, rare categories pooled."""
    c = R.pool_rare(t("screen_tasks", "screen_task_id", "app_category"), "app_category", 10).select("screen_task_id", F.coalesce("app_category", F.lit("Unknown")).alias("category"))
    df = rating_long(t).join(c, "screen_task_id")
    return df.groupBy("category", "model").agg(F.round(F.avg(100.0 * F.abs("delta") / (scale() - 1)), 6).alias("error"), F.count("*").alias("n"))


@query(RATED_SQL + """, t AS (SELECT screen_task_id, avg(abs(delta)) AS e FROM long GROUP BY 1 ORDER BY round(e, 9) DESC, screen_task_id LIMIT 10)
    SELECT screen_task_id, round(t.e, 6) AS mean_error, aspect, round(avg(abs(delta)), 6) AS aspect_error FROM long JOIN t USING (screen_task_id) GROUP BY ALL""")
def consensus_failures(t: Tables):
    """The ten tasks that the models miss most (a top-k report), by aspect."""
    df = rating_long(t)
    worst = df.groupBy("screen_task_id").agg(F.avg(F.abs("delta")).alias("e")).orderBy(F.desc(F.round("e", 9)), "screen_task_id").limit(10)
    out = df.join(F.broadcast(worst), "screen_task_id").groupBy("screen_task_id", F.round("e", 6).alias("mean_error"), "aspect").agg(F.round(F.avg(F.abs("delta")), 6).alias("aspect_error"))
    return out


@query(RATED_SQL + """SELECT model, round(avg(abs(delta)), 6) AS mae, round(avg(delta), 6) AS bias, round(100.0 * avg((abs(delta) <= 1)::INT), 6) AS within_one, quantile_cont(delta, 0.5)::DOUBLE AS median FROM long GROUP BY 1""")
def rating_overall_summary(t: Tables):
    d = F.col("delta")
    return rating_long(t).groupBy("model").agg(F.round(F.avg(F.abs(d)), 6).alias("mae"), F.round(F.avg(d), 6).alias("bias"), F.round(100.0 * F.avg((F.abs(d) <= 1).cast("int")), 6).alias("within_one"), F.percentile("delta", F.lit(0.5)).alias("median"))


@query(RATED_SQL + """SELECT model, coalesce(round(avg(abs(delta)) FILTER (aspect = 'aesthetics_rating'), 6), 0) AS aesthetics, coalesce(round(avg(abs(delta)) FILTER (aspect = 'usability_rating'), 6), 0) AS usability, coalesce(round(avg(abs(delta)) FILTER (aspect = 'design_quality_rating'), 6), 0) AS design FROM long GROUP BY 1""")
def pivot_fixed_order(t: Tables):
    """Long to wide with a fixed list of columns, missing cells 0."""
    names = {"aesthetics_rating": "aesthetics", "usability_rating": "usability", "design_quality_rating": "design"}
    wide = rating_long(t).groupBy("model").pivot("aspect", list(names)).agg(F.round(F.avg(F.abs("delta")), 6))
    return wide.select("model", *(F.coalesce(a, F.lit(0.0)).alias(b) for a, b in names.items()))


WILCOXON_SQL = RATED_SQL + """, z AS (SELECT model, aspect, abs(delta) AS m, delta FROM long WHERE delta <> 0), k AS (SELECT *, rank() OVER (PARTITION BY model, aspect ORDER BY m) + (count(*) OVER (PARTITION BY model, aspect, m) - 1) / 2.0 AS rk FROM z),
    t AS (SELECT model, aspect, sum(c * c * c - c)::DOUBLE AS ties FROM (SELECT model, aspect, m, count(*) AS c FROM z GROUP BY ALL) GROUP BY ALL), a AS (SELECT model, aspect, count(*)::BIGINT AS n, least(sum(rk) FILTER (delta > 0), sum(rk) FILTER (delta < 0)) AS w0, sum(rk) AS all_w, sum(rk) FILTER (delta > 0) AS p FROM k GROUP BY ALL),
    o AS (SELECT model, aspect, quantile_cont(delta, 0.5)::DOUBLE AS median FROM long GROUP BY ALL)"""


@query(WILCOXON_SQL + """SELECT model, aspect, n, least(coalesce(p, 0), all_w - coalesce(p, 0))::DOUBLE AS w, ties, round((least(coalesce(p, 0), all_w - coalesce(p, 0)) - n * (n + 1) / 4.0) / sqrt((n * (n + 1) * (2 * n + 1) - ties / 2) / 24.0), 6) AS z, median FROM a JOIN t USING (model, aspect) JOIN o USING (model, aspect)""")
def wilcoxon_core(t: Tables):
    return T.wilcoxon(rating_long(t), ["model", "aspect"], "delta").withColumn("z", F.round("z", 6)).drop("zeros")


@query()
def wilcoxon_p(t: Tables):
    """wilcoxon_core with its p (exact for small samples without ties), stars and significance."""
    out = T.wilcoxon(rating_long(t), ["model", "aspect"], "delta")
    out = out.withColumn("p", T.wilcoxon_p(F.col("w"), F.col("n"), F.col("ties"), F.col("zeros"), F.col("z")))
    return out.select("model", "aspect", "n", "median", "p", S.p_stars(F.col("p")).alias("stars"), S.p_text(F.col("p")).alias("text"), (F.col("p") < 0.05).alias("significant"))


@query(RATED_SQL + """SELECT model, aspect, m, (min(place) + (count(*) - 1) / 2.0)::DOUBLE AS avg_rank, count(*)::BIGINT AS n FROM (SELECT model, aspect, abs(delta) AS m, row_number() OVER (PARTITION BY model, aspect ORDER BY abs(delta)) AS place FROM long WHERE delta <> 0) GROUP BY ALL""")
def avg_rank_ties(t: Tables):
    """The rank that equal sizes of a difference share."""
    sizes = rating_long(t).where("delta <> 0").groupBy("model", "aspect", F.abs("delta").alias("m")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("model", "aspect").orderBy("m").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sizes.select("model", "aspect", "m", (before + (F.col("n") + 1) / 2).alias("avg_rank"), "n")


def _kappa_sql(kind: str) -> str:
    w = {"linear": "1 - abs(delta) / 9.0", "quadratic": "1 - delta * delta / 81.0", "ordinal": "1 - (abs(delta) + 1) * abs(delta) / 90.0"}[kind]
    pe = T.chance(10, kind)
    return RATED_SQL + f"SELECT model, count(*)::BIGINT AS n, round(avg((({w}) - {pe!r}) / (1 - {pe!r})), 6) AS kappa FROM long WHERE aspect = 'usability_rating' GROUP BY 1"


def _kappa(t: Tables, kind: str) -> DataFrame:
    df = rating_long(t).where("aspect = 'usability_rating'")
    return T.uniform_kappa(df, ["model"], "expert_score", "llm_score", 10, kind).select("model", "n", F.round("kappa", 6).alias("kappa"))


@query(_kappa_sql("quadratic"))
def bp_kappa_quadratic(t: Tables):
    return _kappa(t, "quadratic")


@query(_kappa_sql("linear"))
def bp_kappa_linear(t: Tables):
    return _kappa(t, "linear")


@query(_kappa_sql("ordinal"))
def bp_kappa_ordinal(t: Tables):
    return _kappa(t, "ordinal")


@query()
def bp_kappa_ci(t: Tables):
    """Quadratic kappa of each model and aspect with its t interval and p, at least ten pairs."""
    out = None
    for q in (5, 10):
        df = rating_long(t).where(scale() == q)
        one = T.uniform_kappa(df, ["model", "aspect"], "expert_score", "llm_score", q, "quadratic")
        out = one if out is None else out.unionByName(one)
    out = out.where("n >= 10").withColumn("half", T.t_half_width(F.col("n"), F.col("se"))).withColumn("p", T.t_probability(F.try_divide(F.col("kappa"), F.col("se")), F.col("n")))
    return out.select("model", "aspect", "n", "kappa", (F.col("kappa") - F.col("half")).alias("low"), F.least(F.col("kappa") + F.col("half"), F.lit(1.0)).alias("high"), "p")


@query(RATED_SQL + f"""SELECT a.model AS left_model, b.model AS right_model, count(*)::BIGINT AS n, round(avg(((1 - (a.llm_score - b.llm_score) * (a.llm_score - b.llm_score) / 81.0) - {T.chance(10, 'quadratic')!r}) / (1 - {T.chance(10, 'quadratic')!r})), 6) AS kappa
    FROM long a JOIN long b ON a.screen_task_id = b.screen_task_id AND a.aspect = b.aspect AND a.model < b.model WHERE a.aspect = 'usability_rating' GROUP BY ALL""")
def inter_model_kappa(t: Tables):
    """Kappa of each two models over the tasks both rated. A task has each model once."""
    df = rating_long(t).where("aspect = 'usability_rating'").select("screen_task_id", "model", "llm_score")
    both = df.select("screen_task_id", F.col("model").alias("left_model"), F.col("llm_score").alias("x")).join(df.select("screen_task_id", F.col("model").alias("right_model"), F.col("llm_score").alias("y")), "screen_task_id").where("left_model < right_model")
    return T.uniform_kappa(both, ["left_model", "right_model"], "x", "y", 10, "quadratic").select("left_model", "right_model", "n", F.round("kappa", 6).alias("kappa"))


@query(RATED_SQL + """, c AS (SELECT model, expert_score >= 6 AS a, llm_score >= 6 AS b FROM long WHERE aspect = 'usability_rating'), g AS (SELECT model, count(*) AS n, avg((a = b)::INT) AS po, avg(a::INT) AS pa, avg(b::INT) AS pb FROM c GROUP BY 1)
    SELECT model, n::BIGINT AS n, round(po, 6) AS agreement, CASE WHEN pa * pb + (1 - pa) * (1 - pb) < 1 THEN round((po - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))), 6) END AS kappa FROM g""")
def cohen_kappa(t: Tables):
    df = rating_long(t).where("aspect = 'usability_rating'").select("model", (F.col("expert_score") >= 6).alias("a"), (F.col("llm_score") >= 6).alias("b"))
    return T.cohen_kappa(df, ["model"], "a", "b").select("model", "n", F.round("agreement", 6).alias("agreement"), F.round("kappa", 6).alias("kappa"))


@query(RATED_SQL + "SELECT model, aspect, count(*)::BIGINT AS n, round(avg(delta) / (stddev_samp(delta) / sqrt(count(*))), 6) AS t FROM long GROUP BY ALL HAVING count(*) >= 10 AND stddev_samp(delta) > 0")
def paired_t(t: Tables):
    d = F.stddev_samp("delta")
    return rating_long(t).groupBy("model", "aspect").agg(F.count("*").alias("n"), F.round(F.try_divide(F.avg("delta"), d / F.sqrt(F.count("*"))), 6).alias("t"), d.alias("sd")).where("n >= 10 AND sd > 0").drop("sd")


@query("""WITH s AS (SELECT screen_task_id, rater_id, usability_rating AS v FROM (SELECT *, row_number() OVER (PARTITION BY screen_task_id, rater_id ORDER BY rated_at DESC, critique_id DESC) AS k FROM raw_critiques) WHERE k = 1 AND usability_rating BETWEEN 1 AND 10),
    q AS (SELECT a.rater_id AS left_rater, b.rater_id AS right_rater, count(*)::BIGINT AS n, avg(a.v) AS ma, avg(b.v) AS mb, sum(a.v * a.v + b.v * b.v)::DOUBLE AS sq, sum((a.v + b.v) * (a.v + b.v)) / 2.0 AS sp FROM s a JOIN s b ON a.screen_task_id = b.screen_task_id AND a.rater_id < b.rater_id GROUP BY ALL),
    m AS (SELECT left_rater, right_rater, n, (sp - 2 * n * ((ma + mb) / 2) ** 2) / nullif(n - 1, 0) AS r, n * ((ma - (ma + mb) / 2) ** 2 + (mb - (ma + mb) / 2) ** 2) AS c, (sq - sp - n * ((ma - (ma + mb) / 2) ** 2 + (mb - (ma + mb) / 2) ** 2)) / nullif(n - 1, 0) AS e, (sq - sp) / n AS w FROM q)
    SELECT left_rater, right_rater, n, round((r - w) / nullif(r + w, 0), 6) AS icc1, round((r - e) / nullif(r + e + 2 * (c - e) / n, 0), 6) AS icc2, round((r - e) / nullif(r + e, 0), 6) AS icc3, round((r - w) / nullif(r, 0), 6) AS icc1k, round((r - e) / nullif(r + (c - e) / n, 0), 6) AS icc2k, round((r - e) / nullif(r, 0), 6) AS icc3k FROM m""")
def icc(t: Tables):
    """The six intraclass correlations of every two raters over the tasks that both rated."""
    out = T.icc_pairs(scores(t).where("aspect = 'usability_rating'"), "screen_task_id", "rater_id", "score")
    return out.select("left_rater", "right_rater", "n", *(F.round(c, 6).alias(c) for c in ("icc1", "icc2", "icc3", "icc1k", "icc2k", "icc3k")))


@query()
def bootstrap_ci(t: Tables):
    """Mean error of each model with an interval from resampling apps."""
    apps = t("screen_tasks", "screen_task_id", "app")
    return T.bootstrap_mean(rating_long(t).join(apps, "screen_task_id").withColumn("e", F.abs("delta").cast("double")), ["model"], "app", "e")


GAP_SQL = f"""WITH {A.LBL}, h AS (SELECT comment_id, lower(trim(observed_issue)) AS text FROM (SELECT *, row_number() OVER (PARTITION BY comment_id ORDER BY record_id) AS k FROM human_comments) WHERE k = 1), f AS (SELECT comment_id, count(*) OVER (PARTITION BY text) >= 10 AS template FROM h WHERE text IS NOT NULL),
    e AS (SELECT model_short, expert_comment_id, max({A.W}) AS w FROM lbl GROUP BY ALL)"""


def template_weights(t: Tables) -> DataFrame:
    """model_short, expert_comment_id, w (its best weight), template (whether ten expert comments or more have its text), app."""
    first = t("human_comments", "record_id", "comment_id", "observed_issue", "screen_task_id").groupBy("comment_id").agg(F.min_by(F.struct("observed_issue", "screen_task_id"), "record_id").alias("r"))
    texts = first.select("comment_id", F.lower(F.trim("r.observed_issue")).alias("text"), F.col("r.screen_task_id").alias("screen_task_id")).where("text IS NOT NULL")
    often = texts.groupBy("text").agg(F.count("*").alias("n"))
    flagged = lookup_join(texts, often, ["text"], "n", texts.count()).select(F.col("comment_id").alias("expert_comment_id"), (F.col("n") >= 10).alias("template"), "screen_task_id")
    best = A.labels(t).groupBy("model_short", "expert_comment_id").agg(F.max(F.coalesce(M.relation_weight(F.col("relation")), F.lit(0.0))).alias("w"))
    return best.join(flagged, "expert_comment_id").join(t("screen_tasks", "screen_task_id", "app"), "screen_task_id", "left")


@query(GAP_SQL + """ SELECT model_short, round(avg(w) FILTER (template), 6) AS template_cov, round(avg(w) FILTER (NOT template), 6) AS other_cov, round(avg(w) FILTER (template) - avg(w) FILTER (NOT template), 6) AS gap FROM e JOIN f ON expert_comment_id = comment_id GROUP BY 1""")
def coverage_gap(t: Tables):
    """How much better or worse a model covers expert comments of a frequent wording than others."""
    side = lambda c: F.avg(F.when(c, F.col("w")))
    out = template_weights(t).groupBy("model_short").agg(side(F.col("template")).alias("a"), side(~F.col("template")).alias("b"))
    return out.select("model_short", F.round("a", 6).alias("template_cov"), F.round("b", 6).alias("other_cov"), F.round(F.col("a") - F.col("b"), 6).alias("gap"))


@query()
def coverage_gap_ci(t: Tables):
    """coverage_gap with an interval from resampling apps."""
    return T.bootstrap_gap(template_weights(t), ["model_short"], "app", "template", "w")


@query()
def normality(t: Tables):
    """W and p of each model's differences from their frequency table. All of them count; p is null above 5000, the end of the method's range."""
    counts = rating_long(t).groupBy("model", "aspect", "delta").agg(F.count("*").alias("c"))

    def one(key, pdf):
        import pandas as pd

        w, p = T.shapiro_counts(pdf["delta"].to_numpy(float), pdf["c"].to_numpy()) if pdf["c"].sum() >= 3 else (None, None)
        return pd.DataFrame([[*key, w, p]], columns=["model", "aspect", "w", "p"])

    return counts.groupBy("model", "aspect").applyInPandas(one, "model string, aspect string, w double, p double")


@query()
def error_gap(t: Tables):
    """How much larger a model's error is in the first half-year, with an interval from resampling apps."""
    df = rating_long(t).join(t("screen_tasks", "screen_task_id", "app"), "screen_task_id").withColumn("e", F.abs("delta").cast("double")).withColumn("side", F.col("prompting") == "zero_shot")
    return T.bootstrap_gap(df, ["model"], "app", "side", "e")


@query()
def manova(t: Tables):
    """The first raters of the tasks, who stand for people, against the others on all five ratings at once."""
    wide = scores(t).groupBy("screen_task_id", "rater_id", "first").pivot("aspect", list(ASPECTS)).agg(F.max("score"))
    return T.manova(wide.withColumn("source", F.when(F.col("first"), "Human").otherwise("Model")), "source", list(ASPECTS))
