"""Cleaning, keys, audits, nesting and text queries over the domain tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from assayer.functions import scalars as S
from assayer.operators import matching as M, reshape as R
from assayer.plans.registry import Registry, Tables

registry = Registry()
query = registry.query

#: The scale of each rating. Fixed values.
SCALES = {"aesthetics_rating": 10, "learnability": 5, "efficiency": 5, "usability_rating": 10, "design_quality_rating": 10}
ASPECTS = tuple(SCALES)


@query(" UNION ALL ".join(f"SELECT '{a}' AS aspect, count(*) FILTER ({a} < 1 OR {a} > {n})::BIGINT AS out_of_range, count(*) FILTER ({a} IS NULL)::BIGINT AS missing FROM raw_critiques" for a, n in SCALES.items()))
def clean_range_violations(t: Tables):
    """Ratings off their scale, by aspect; all counted in one pass."""
    counts = [x for a, n in SCALES.items() for x in (F.count_if((F.col(a) < 1) | (F.col(a) > n)).alias(f"o_{a}"), F.count_if(F.col(a).isNull()).alias(f"m_{a}"))]
    one = t("raw_critiques", *ASPECTS).agg(*counts)
    return one.selectExpr(f"stack({len(SCALES)}, " + ", ".join(f"'{a}', o_{a}, m_{a}" for a in SCALES) + ") AS (aspect, out_of_range, missing)")


@query("""SELECT rico_id, task, critique_id, n_comments FROM (
    SELECT rico_id, task, critique_id, ((length(comments_source) - length(replace(comments_source, '''', ''))) // 2)::BIGINT AS n_comments,
           row_number() OVER (PARTITION BY rico_id, task ORDER BY (length(comments_source) - length(replace(comments_source, '''', ''))) // 2 DESC NULLS LAST, critique_id) AS k
    FROM raw_critiques) WHERE k = 1""")
def dup_keep_max(t: Tables):
    """Of the rows for one screen and task, the one with most comments."""
    df = t("raw_critiques", "rico_id", "task", "critique_id", "comments_source")
    df = df.withColumn("n_comments", F.size(S.literal_list(F.col("comments_source"))).cast("long"))
    return R.first_per_key(df, ["rico_id", "task"], [F.desc_nulls_last("n_comments"), F.asc("critique_id")]).drop("comments_source")


@query("""SELECT rico_id, task, rico_id || '_T' || lpad(row_number() OVER (PARTITION BY rico_id ORDER BY task)::VARCHAR, 2, '0') AS made_id
    FROM (SELECT DISTINCT rico_id, task FROM raw_critiques)""")
def task_ids(t: Tables):
    """Task ids numbered within each screen."""
    numbered = R.with_sequence(t("raw_critiques", "rico_id", "task").distinct(), ["rico_id"], [F.asc("task")])
    return numbered.select("rico_id", "task", S.numbered(F.concat(F.col("rico_id").cast("string"), F.lit("_T")), F.col("seq"), 2).alias("made_id"))


@query("""SELECT screen_task_id, rater_id, count(*)::BIGINT AS n_rows, count(DISTINCT usability_rating) > 1 OR count(DISTINCT aesthetics_rating) > 1 AS differs,
    min_by(aesthetics_rating, critique_id) AS first_rating, count(*) FILTER (aesthetics_rating = top) > 1 AS top_is_tied
    FROM (SELECT *, max(aesthetics_rating) OVER (PARTITION BY screen_task_id, rater_id) AS top FROM raw_critiques) GROUP BY ALL HAVING count(*) > 1""")
def dup_review(t: Tables):
    """Raters with several rows for a task: whether their ratings differ, the first one and whether the greatest occurs twice."""
    df = t("raw_critiques", "screen_task_id", "rater_id", "critique_id", "usability_rating", "aesthetics_rating")
    # Counted by rating first: no list of a rater's rows, however many there are.
    tops = df.where("aesthetics_rating IS NOT NULL").groupBy("screen_task_id", "rater_id", "aesthetics_rating").agg(F.count("*").alias("c"))
    tied = tops.groupBy("screen_task_id", "rater_id").agg((F.max_by("c", "aesthetics_rating") > 1).alias("top_is_tied"))
    out = df.groupBy("screen_task_id", "rater_id").agg(
        F.count("*").alias("n_rows"), ((F.count_distinct("usability_rating") > 1) | (F.count_distinct("aesthetics_rating") > 1)).alias("differs"), F.min_by("aesthetics_rating", "critique_id").alias("first_rating")
    )
    out = out.where("n_rows > 1").join(tied, ["screen_task_id", "rater_id"], "left").withColumn("top_is_tied", F.coalesce("top_is_tied", F.lit(False)))
    return out


@query("""SELECT m.screen_task_id, m.app_category, s.screen_task_id IS NULL AS unknown_task, s.app_category IS NOT NULL AND s.app IS NULL AS no_app
    FROM (SELECT DISTINCT screen_task_id, app_category FROM match_pairs) m LEFT JOIN screen_tasks s ON m.screen_task_id = s.screen_task_id AND m.app_category = s.app_category""")
def pair_membership_flag(t: Tables):
    """Whether a pair of keys is among the known ones."""
    known = t("screen_tasks", "screen_task_id", "app_category", "app").withColumn("here", F.lit(True))
    df = t("match_pairs", "screen_task_id", "app_category").distinct().join(known, ["screen_task_id", "app_category"], "left")
    return df.select("screen_task_id", "app_category", F.col("here").isNull().alias("unknown_task"), (F.col("here").isNotNull() & F.col("app").isNull()).alias("no_app"))


@query("""SELECT screen_task_id, CASE WHEN o.screen_id IS NOT NULL THEN o.app_category ELSE s.app_category END AS app_category, o.screen_id IS NOT NULL AS overridden,
    coalesce(s.app, 'unknown') || ' - screen ' || s.screen_id AS label FROM screen_tasks s LEFT JOIN
    (SELECT screen_id, CASE WHEN count(DISTINCT app_category) > 1 THEN NULL ELSE max(app_category) END AS app_category FROM screen_tasks GROUP BY screen_id HAVING count(*) > 1) o ON s.screen_id = o.screen_id""")
def override_metadata(t: Tables):
    """Categories set from an override table, which may set null, so a flag of the match decides and not a coalesce."""
    df = t("screen_tasks", "screen_task_id", "screen_id", "app", "app_category")
    several = df.groupBy("screen_id").agg(F.count("*").alias("n"), F.count_distinct("app_category").alias("k"), F.max("app_category").alias("c")).where("n > 1")
    over = several.select("screen_id", F.when(F.col("k") <= 1, F.col("c")).alias("new"), F.lit(True).alias("hit"))
    out = df.join(over, "screen_id", "left")
    label = F.concat(F.coalesce("app", F.lit("unknown")), F.lit(" - screen "), F.col("screen_id").cast("string"))
    return out.select("screen_task_id", F.when(F.col("hit"), F.col("new")).otherwise(F.col("app_category")).alias("app_category"), F.coalesce("hit", F.lit(False)).alias("overridden"), label.alias("label"))


@query("SELECT app_category, count(DISTINCT screen_id)::BIGINT AS n_screens, count(*)::BIGINT AS n_tasks, min(screen_task_id) AS first_task FROM screen_tasks GROUP BY 1")
def category_summary(t: Tables):
    """Screens and tasks by category, the null one included."""
    return t("screen_tasks", "app_category", "screen_id", "screen_task_id").groupBy("app_category").agg(F.count_distinct("screen_id").alias("n_screens"), F.count("*").alias("n_tasks"), F.min("screen_task_id").alias("first_task"))


@query(" UNION ALL ".join(f"""SELECT '{a}' AS aspect, count({a})::BIGINT AS n, round(avg({a}), 6) AS mean, round(stddev_samp({a}), 6) AS sd, min({a})::DOUBLE AS low,
    quantile_cont({a}, 0.25)::DOUBLE AS q1, quantile_cont({a}, 0.5)::DOUBLE AS median, quantile_cont({a}, 0.75)::DOUBLE AS q3, max({a})::DOUBLE AS high FROM raw_critiques""" for a in SCALES))
def describe_numeric(t: Tables):
    """Count, mean, deviation, extremes and quartiles of each rating."""
    long = R.unpivot(t("raw_critiques", "critique_id", *ASPECTS), ["critique_id"], ASPECTS, "aspect", "v")
    q = lambda p: F.percentile("v", F.lit(p))
    return long.groupBy("aspect").agg(F.count("v").alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_samp("v"), 6).alias("sd"), F.min("v").cast("double").alias("low"), q(0.25).alias("q1"), q(0.5).alias("median"), q(0.75).alias("q3"), F.max("v").cast("double").alias("high"))


VARIANTS = (("to fix this", "(?i)to fix this"), ("please", "(?i)please"), ("would help", "(?i)would help"), ("try this", "(?i)try this"))


@query("""SELECT coalesce(variant, '(rest)') AS variant, count(*)::BIGINT AS n_keys FROM (SELECT screen_task_id, CASE WHEN bool_or(coalesce(regexp_matches(raw_text, '(?i)to fix this'), false)) THEN 'to fix this'
    WHEN bool_or(coalesce(regexp_matches(raw_text, '(?i)please'), false)) THEN 'please' WHEN bool_or(coalesce(regexp_matches(raw_text, '(?i)would help'), false)) THEN 'would help'
    WHEN bool_or(coalesce(regexp_matches(raw_text, '(?i)try this'), false)) THEN 'try this' END AS variant FROM human_comments GROUP BY 1) GROUP BY 1""")
def variant_elimination(t: Tables):
    """Tasks by the first wording variant that any of their comments holds."""
    return R.eliminate(t("human_comments", "screen_task_id", "raw_text"), "screen_task_id", "raw_text", VARIANTS)


@query("""SELECT screen_task_id, pos::INT AS pos, comment_id, observed_issue FROM (SELECT *, row_number() OVER (PARTITION BY screen_task_id ORDER BY comment_label, comment_id) AS pos FROM human_comments
    WHERE observed_issue IS NOT NULL)""")
def explode_nest_roundtrip(t: Tables):
    """Comments nested by task in the text order of their labels, and taken apart again."""
    df = t("human_comments", "screen_task_id", "comment_label", "comment_id", "observed_issue").where("observed_issue IS NOT NULL")
    return R.unnest(R.nest(df, ["screen_task_id"], ["comment_id", "observed_issue"], ["comment_label", "comment_id"], "comments"), "comments", ["screen_task_id"])


@query("""SELECT record_id, nullif(regexp_replace(trim(regexp_replace(translate(lower(suggested_fix), '‘’“”', '''''""'), '[\\s\\pZ]+', ' ', 'g')), '^[^\\pL\\pM\\pN_]+|[^\\pL\\pM\\pN_]+$', '', 'g'), '') AS norm FROM human_comments""")
def normalize_text(t: Tables):
    """Normalised texts."""
    return t("human_comments", "record_id", "suggested_fix").select("record_id", S.normalize_text(F.col("suggested_fix")).alias("norm"))


@query("""SELECT missing_parts, count(*)::BIGINT AS n FROM (SELECT array_to_string(list_filter(['expected_standard', 'observed_issue', 'suggested_fix'],
    lambda x: CASE x WHEN 'expected_standard' THEN coalesce(trim(expected_standard), '') = '' WHEN 'observed_issue' THEN coalesce(trim(observed_issue), '') = '' ELSE coalesce(trim(suggested_fix), '') = '' END), ',') AS missing_parts FROM human_comments) GROUP BY 1""")
def marker_missing_audit(t: Tables):
    """Which of the three parts the comments lack."""
    parts = ("expected_standard", "observed_issue", "suggested_fix")
    lacking = F.concat_ws(",", *(F.when(F.trim(F.coalesce(p, F.lit(""))) == "", F.lit(p)) for p in parts))
    return t("human_comments", *parts).groupBy(lacking.alias("missing_parts")).agg(F.count("*").alias("n"))


@query("""SELECT observed_issue, count(*)::BIGINT AS n, min(comment_id) AS first_comment, count(DISTINCT screen_task_id)::BIGINT AS n_tasks,
    coalesce(array_to_string(list_sort(list_distinct(list(app) FILTER (app IS NOT NULL)))[1:5], ', '), '') AS apps
    FROM human_comments LEFT JOIN (SELECT screen_task_id, app FROM screen_tasks) USING (screen_task_id) WHERE trim(coalesce(observed_issue, '')) <> '' GROUP BY 1 HAVING count(*) > 1""")
def frequent_comments(t: Tables):
    """Comments that occur more than once, with the first five apps they stand at."""
    df = t("human_comments", "observed_issue", "comment_id", "screen_task_id").where("trim(coalesce(observed_issue, '')) <> ''").join(t("screen_tasks", "screen_task_id", "app"), "screen_task_id", "left")
    counts = df.groupBy("observed_issue").agg(F.count("*").alias("n"), F.min("comment_id").alias("first_comment"), F.count_distinct("screen_task_id").alias("n_tasks")).where("n > 1")
    # Each app once and the first five of them: no list of all.
    first = R.first_per_key(df.where("app IS NOT NULL").select("observed_issue", "app").distinct(), ["observed_issue"], [F.asc("app")], 5)
    apps = first.groupBy("observed_issue").agg(F.array_join(F.array_sort(F.collect_list("app")), ", ").alias("apps"))
    return counts.join(apps, "observed_issue", "left").withColumn("apps", F.coalesce("apps", F.lit("")))


@query("""SELECT screen_task_id, n FROM (SELECT screen_task_id, count(*) FILTER (x IS NULL)::BIGINT AS n FROM (SELECT screen_task_id, unnest([expected_standard, observed_issue, suggested_fix]) AS x FROM human_comments) GROUP BY 1) WHERE n > 0""")
def null_audit(t: Tables):
    """Tasks with rows that lack a part."""
    n = sum((F.col(c).isNull().cast("long") for c in ("expected_standard", "observed_issue", "suggested_fix")), F.lit(0).cast("long"))
    return t("human_comments", "screen_task_id", "expected_standard", "observed_issue", "suggested_fix").groupBy("screen_task_id").agg(F.sum(n).alias("n")).where("n > 0")


@query("""SELECT 'in both' AS part, count(*)::BIGINT AS n FROM (SELECT DISTINCT screen_task_id FROM screen_tasks INTERSECT SELECT DISTINCT screen_task_id FROM human_comments)
    UNION ALL SELECT 'tasks only', count(*)::BIGINT FROM (SELECT DISTINCT screen_task_id FROM screen_tasks EXCEPT SELECT screen_task_id FROM human_comments)
    UNION ALL SELECT 'comments only', count(*)::BIGINT FROM (SELECT DISTINCT screen_task_id FROM human_comments EXCEPT SELECT screen_task_id FROM screen_tasks)""")
def semi_anti_members(t: Tables):
    """Keys of two tables in both, in the first and in the second only."""
    a, b = t("screen_tasks", "screen_task_id").distinct(), t("human_comments", "screen_task_id").distinct()
    parts = (("in both", a.join(b, "screen_task_id", "left_semi")), ("tasks only", a.join(b, "screen_task_id", "left_anti")), ("comments only", b.join(a, "screen_task_id", "left_anti")))
    out = None
    for name, df in parts:
        one = df.agg(F.lit(name).alias("part"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT screen_id, count(DISTINCT app_category)::BIGINT AS n_categories, count(*)::BIGINT AS n_tasks, array_to_string(list_sort(list(task)), '; ') AS tasks
    FROM screen_tasks WHERE app IS NULL OR app_category IS NULL GROUP BY screen_id""")
def problem_report(t: Tables):
    """Screens with tasks that lack an app or a category."""
    df = t("screen_tasks", "screen_id", "app", "app_category", "task").where("app IS NULL OR app_category IS NULL")
    return df.groupBy("screen_id").agg(F.count_distinct("app_category").alias("n_categories"), F.count("*").alias("n_tasks"), F.array_join(F.array_sort(F.collect_list("task")), "; ").alias("tasks"))


@query("""SELECT relation, CASE relation WHEN 'equivalent' THEN 1.0 WHEN 'A_broader' THEN 0.85 WHEN 'B_broader' THEN 0.85 WHEN 'partial_overlap' THEN 0.5 ELSE 0.0 END::DOUBLE AS weight, count(*)::BIGINT AS n
    FROM match_pairs WHERE relation IS NOT NULL GROUP BY ALL""")
def map_default_strict(t: Tables):
    """Relations with their weight; a relation without one is an error."""
    from assayer.operators.matching import relation_weight

    df = t("match_pairs", "relation").where("relation IS NOT NULL").groupBy("relation").agg(F.count("*").alias("n"))
    return df.select("relation", relation_weight(F.col("relation"), strict=True).alias("weight"), "n")


@query("""SELECT record_id, coalesce(observed_issue, suggested_fix, '') AS text, CASE WHEN observed_issue IS NULL AND suggested_fix IS NULL THEN 'none' WHEN observed_issue IS NULL THEN 'fix' WHEN suggested_fix IS NULL THEN 'issue' ELSE 'both' END AS kind FROM human_comments""")
def coalesce_select_case(t: Tables):
    issue, fix = F.col("observed_issue"), F.col("suggested_fix")
    kind = F.when(issue.isNull() & fix.isNull(), "none").when(issue.isNull(), "fix").when(fix.isNull(), "issue").otherwise("both")
    return t("human_comments", "record_id", "observed_issue", "suggested_fix").select("record_id", F.coalesce(issue, fix, F.lit("")).alias("text"), kind.alias("kind"))


@query("""SELECT expert_comment_id, CASE WHEN bool_or(relation IN ('equivalent', 'A_broader', 'B_broader')) THEN 'covered' WHEN bool_or(relation = 'partial_overlap') THEN 'partly' WHEN bool_or(relation = 'contradiction') THEN 'contradicted'
    ELSE 'uncovered' END AS outcome FROM match_pairs GROUP BY 1""")
def rule_table_first_match(t: Tables):
    """The first rule that any pair of an expert comment meets."""
    r = F.col("relation")
    rules = [("covered", r.isin("equivalent", "A_broader", "B_broader")), ("partly", r == "partial_overlap"), ("contradicted", r == "contradiction")]
    return R.rule_table(t("match_pairs", "expert_comment_id", "relation"), ["expert_comment_id"], rules, "uncovered")


@query("""SELECT critique_id, CASE WHEN usability_rating BETWEEN 0 AND 3 THEN 'low' WHEN usability_rating BETWEEN 4 AND 7 THEN 'mid' WHEN usability_rating BETWEEN 8 AND 10 THEN 'high' END AS bin10,
    CASE WHEN efficiency BETWEEN 0 AND 2 THEN 'low' WHEN efficiency BETWEEN 3 AND 4 THEN 'mid' WHEN efficiency = 5 THEN 'high' END AS bin5 FROM raw_critiques""")
def bins_right_closed(t: Tables):
    df = t("raw_critiques", "critique_id", "usability_rating", "efficiency")
    return df.select("critique_id", S.binned(F.col("usability_rating"), 10).alias("bin10"), S.binned(F.col("efficiency"), 5).alias("bin5"))


@query("""SELECT relation, round(100.0 * count(*) / sum(count(*)) OVER (), 2)::DOUBLE AS pct, printf('%.1f%%', 100.0 * count(*) / sum(count(*)) OVER ()) AS text FROM match_pairs GROUP BY 1""")
def percent_scale(t: Tables):
    """Relations in percent of all pairs."""
    counts = t("match_pairs", "relation").groupBy("relation").agg(F.count("*").alias("n"))
    # A handful of rows is left when the shares are taken.
    pct = 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))
    return counts.select("relation", F.round(pct, 2).alias("pct"), F.format_string("%.1f%%", pct).alias("text"))


@query("""SELECT count(*)::BIGINT AS n_rows, count(*) FILTER (coalesce(task, '') = '')::BIGINT AS no_task, count(*) FILTER (s.app IS NULL)::BIGINT AS no_app, count(*) FILTER (coalesce(c.task, '') <> '' AND s.app IS NOT NULL)::BIGINT AS valid
    FROM raw_critiques c LEFT JOIN (SELECT screen_task_id, app FROM screen_tasks) s USING (screen_task_id)""")
def prompt_row_validity(t: Tables):
    """How many rows a prompt could be made of."""
    df = t("raw_critiques", "screen_task_id", "task").join(t("screen_tasks", "screen_task_id", "app"), "screen_task_id", "left")
    blank = F.coalesce("task", F.lit("")) == ""
    return df.agg(F.count("*").alias("n_rows"), F.count_if(blank).alias("no_task"), F.count_if(F.col("app").isNull()).alias("no_app"), F.count_if(~blank & F.col("app").isNotNull()).alias("valid"))


@query("""SELECT record_id, regexp_replace(suggested_fix, '^To fix this, ', '') AS stripped, starts_with(suggested_fix, 'To fix this') AS marked FROM human_comments WHERE suggested_fix IS NOT NULL""")
def prefix_flags(t: Tables):
    df = t("human_comments", "record_id", "suggested_fix").where("suggested_fix IS NOT NULL")
    return df.select("record_id", F.regexp_replace("suggested_fix", "^To fix this, ", "").alias("stripped"), F.col("suggested_fix").startswith("To fix this").alias("marked"))


@query("""SELECT screen_id, count(*)::BIGINT AS n_rows, count(DISTINCT s.screen_task_id)::BIGINT AS n_tasks, array_to_string(list_sort(list_distinct(list(rater_id))), ',') AS raters
    FROM screen_tasks s JOIN raw_critiques c ON s.screen_task_id = c.screen_task_id GROUP BY 1""")
def one_to_many_screen(t: Tables):
    df = t("screen_tasks", "screen_id", "screen_task_id").join(t("raw_critiques", "screen_task_id", "rater_id"), "screen_task_id")
    return df.groupBy("screen_id").agg(F.count("*").alias("n_rows"), F.count_distinct("screen_task_id").alias("n_tasks"), F.array_join(F.array_sort(F.collect_set("rater_id")), ",").alias("raters"))


@query("""SELECT count(*)::BIGINT AS n, count(s.task)::BIGINT AS with_task FROM (SELECT screen_task_id, app FROM screen_tasks) a JOIN (SELECT screen_task_id, task FROM screen_tasks) s USING (screen_task_id)""")
def validated_one_to_one(t: Tables):
    both = R.join_one_to_one(t("screen_tasks", "screen_task_id", "app"), t("screen_tasks", "screen_task_id", "task"), ["screen_task_id"])
    return both.agg(F.count("*").alias("n"), F.count("task").alias("with_task"))


@query("""SELECT rater_id, avg((usability_rating = learnability + efficiency)::INT) AS equal_rate, max(n)::BIGINT AS most_rows FROM (SELECT *, count(*) OVER (PARTITION BY screen_task_id, rater_id) AS n FROM raw_critiques) GROUP BY 1""")
def rating_variation(t: Tables):
    """How often a rater's usability is the sum of its two parts, and the most rows for one task."""
    df = t("raw_critiques", "screen_task_id", "rater_id", "usability_rating", "learnability", "efficiency")
    equal = (F.col("usability_rating") == F.col("learnability") + F.col("efficiency")).cast("int")
    per = df.groupBy("rater_id", "screen_task_id").agg(F.sum(equal).alias("s"), F.count(equal).alias("c"), F.count("*").alias("n"))
    return per.groupBy("rater_id").agg((F.sum("s") / F.sum("c")).alias("equal_rate"), F.max("n").alias("most_rows"))


@query("""SELECT aspect, score::INT AS score, coalesce(n, 0)::BIGINT AS n FROM (SELECT 'usability_rating' AS aspect, unnest(range(1, 11)) AS score UNION ALL SELECT 'efficiency', unnest(range(1, 6)))
    LEFT JOIN (SELECT 'usability_rating' AS aspect, usability_rating AS score, count(*) AS n FROM raw_critiques GROUP BY 2 UNION ALL SELECT 'efficiency', efficiency, count(*) FROM raw_critiques GROUP BY 2) USING (aspect, score)""")
def score_histogram_full_scale(t: Tables):
    """Counts of every score of a scale, those nobody gave included."""
    counts = R.unpivot(t("raw_critiques", "critique_id", "usability_rating", "efficiency"), ["critique_id"], ["usability_rating", "efficiency"], "aspect", "score").groupBy("aspect", "score").agg(F.count("*").alias("n"))
    full = t.spark.createDataFrame([(a, s) for a in ("usability_rating", "efficiency") for s in range(1, SCALES[a] + 1)], "aspect string, score int")
    return full.join(counts, ["aspect", "score"], "left").select("aspect", "score", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("""SELECT tbl, count(*)::BIGINT AS n, count(DISTINCT screen_task_id)::BIGINT AS n_tasks FROM (SELECT 'critiques' AS tbl, screen_task_id FROM raw_critiques UNION ALL SELECT 'comments', screen_task_id FROM human_comments
    UNION ALL SELECT 'guidelines', screen_task_id FROM guidelines UNION ALL SELECT 'pairs', screen_task_id FROM match_pairs) GROUP BY 1""")
def load_summary(t: Tables):
    """Rows and tasks of several tables, united by name."""
    out = None
    for label, name in (("critiques", "raw_critiques"), ("comments", "human_comments"), ("guidelines", "guidelines"), ("pairs", "match_pairs")):
        one = t(name, "screen_task_id").groupBy("screen_task_id").agg(F.count("*").alias("n")).agg(F.lit(label).alias("tbl"), F.sum("n").alias("n"), F.count("screen_task_id").alias("n_tasks"))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


@query("""SELECT 'relation' AS field, coalesce(relation, '(null)') AS value, count(*)::BIGINT AS n FROM match_pairs GROUP BY 2 UNION ALL SELECT 'decision_source', coalesce(decision_source, '(null)'), count(*)::BIGINT FROM match_pairs GROUP BY 2
    UNION ALL SELECT 'model_short', coalesce(model_short, '(null)'), count(*)::BIGINT FROM match_pairs GROUP BY 2""")
def value_counts_all(t: Tables):
    fields = ["relation", "decision_source", "model_short"]
    # Grouped by all three first: one pass over the pairs.
    counts = t("match_pairs", *fields).groupBy(*fields).agg(F.count("*").alias("n"))
    long = counts.selectExpr("n", "stack(3, 'relation', relation, 'decision_source', decision_source, 'model_short', model_short) AS (field, value)")
    return long.groupBy("field", F.coalesce("value", F.lit("(null)")).alias("value")).agg(F.sum("n").alias("n"))


@query("""SELECT screen_task_id, min_by(comment_id, (comment_label, record_id)) AS first_comment, count(*)::BIGINT AS n, bool_or(dup) AS has_same_issue FROM
    (SELECT *, observed_issue IS NOT NULL AND count(*) OVER (PARTITION BY screen_task_id, observed_issue) > 1 AS dup FROM human_comments) GROUP BY 1""")
def first_per_key(t: Tables):
    """The first comment of each task, and whether two say the same."""
    df = t("human_comments", "screen_task_id", "comment_label", "record_id", "comment_id", "observed_issue")
    per_text = df.groupBy("screen_task_id", "observed_issue").agg(F.count("*").alias("n"), F.min(F.struct("comment_label", "record_id", "comment_id")).alias("f"))
    same = F.bool_or(F.col("observed_issue").isNotNull() & (F.col("n") > 1))
    return per_text.groupBy("screen_task_id").agg(F.min("f").getField("comment_id").alias("first_comment"), F.sum("n").alias("n"), same.alias("has_same_issue"))


@query("""SELECT model_short, app_category, n, round(n / sum(n) OVER (PARTITION BY model_short), 6)::DOUBLE AS share, (sum(n) OVER (PARTITION BY model_short ORDER BY n DESC, app_category ROWS UNBOUNDED PRECEDING) - n)::BIGINT AS before
    FROM (SELECT model_short, coalesce(app_category, 'Unknown') AS app_category, count(*)::BIGINT AS n FROM match_pairs GROUP BY ALL)""")
def share_of_group(t: Tables):
    """Shares within a model and running sums, over counts by cell."""
    counts = t("match_pairs", "model_short", "app_category").groupBy("model_short", F.coalesce("app_category", F.lit("Unknown")).alias("app_category")).agg(F.count("*").alias("n"))
    running = F.sum("n").over(Window.partitionBy("model_short").orderBy(F.desc("n"), "app_category").rowsBetween(Window.unboundedPreceding, 0))
    return R.share_of_group(counts, ["model_short"], "n").select("model_short", "app_category", "n", F.round("share", 6).alias("share"), (running - F.col("n")).alias("before"))


@query("""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model_short ORDER BY n DESC, app_category)::INT AS place
    FROM (SELECT model_short, app_category, count(*)::BIGINT AS n FROM match_pairs WHERE app_category IS NOT NULL GROUP BY ALL)) WHERE place <= 3""")
def topn_per_group(t: Tables):
    counts = t("match_pairs", "model_short", "app_category").where("app_category IS NOT NULL").groupBy("model_short", "app_category").agg(F.count("*").alias("n"))
    return R.with_sequence(counts, ["model_short"], [F.desc("n"), F.asc("app_category")], "place").where("place <= 3")


@query("""SELECT custom_id, element_at_2 || '::' || element_at_3 AS last_two, regexp_extract(element_at_2, '^(.*)_[0-9]+$', 1) AS task, right(element_at_3, 3) AS suffix FROM
    (SELECT DISTINCT custom_id, string_split(custom_id, '::')[2] AS element_at_2, string_split(custom_id, '::')[3] AS element_at_3 FROM dup_reviews)""")
def string_toolkit(t: Tables):
    """Parts of composite ids."""
    df = t("dup_reviews", "custom_id").distinct().withColumn("p", F.split("custom_id", "::"))
    last = F.array_join(F.slice("p", -2, 2), "::")
    return df.select("custom_id", last.alias("last_two"), F.regexp_extract(F.element_at("p", 2), "^(.*)_[0-9]+$", 1).alias("task"), F.right(F.element_at("p", 3), F.lit(3)).alias("suffix"))


@query("""SELECT vec_id, label, round(min_v, 6) AS min_v, round(max_v, 6) AS max_v, round(norm, 5) AS norm FROM (SELECT vec_id, label, list_min(embedding)::DOUBLE AS min_v, list_max(embedding)::DOUBLE AS max_v,
    sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS norm FROM embeddings)""")
def elementwise_math(t: Tables):
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return t("embeddings", "vec_id", "label", "embedding").select("vec_id", "label", F.round(F.array_min("embedding").cast("double"), 6).alias("min_v"), F.round(F.array_max("embedding").cast("double"), 6).alias("max_v"), F.round(norm, 5).alias("norm"))


@query("""SELECT a.vec_id AS left_id, b.vec_id AS right_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS cosine FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id
    WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.40""")
def cosine_pairs(t: Tables):
    """Every two vectors of a label that pass the reference's gate."""
    return M.similar_pairs(t("embeddings", "vec_id", "label", "embedding"), "vec_id", "label", "embedding", least=0.40).withColumn("cosine", F.round("cosine", 5))


@query("""SELECT event_id, (user_id // 3)::BIGINT AS k, round(value, 6) AS value, strftime(ts, '%Y-%m-%d %H:%M:%S') AS text FROM events WHERE value IS NOT NULL""")
def epoch_format(t: Tables):
    df = t("events", "event_id", "user_id", "value", "ts").where("value IS NOT NULL")
    return df.select("event_id", F.floor(F.col("user_id") / 3).alias("k"), F.round("value", 6).alias("value"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("text"))


@query()
def literal_lists(t: Tables):
    """Comments of the list literals with their sources, where both lists have as many entries."""
    df = t("raw_critiques", "critique_id", "comments", "comments_source").select("critique_id", S.any_literal_list(F.col("comments")).alias("c"), S.any_literal_list(F.col("comments_source")).alias("s"))
    zipped = df.where(F.size("c") == F.size("s")).select("critique_id", F.posexplode(F.arrays_zip("c", "s")).alias("pos", "z"))
    return zipped.select("critique_id", (F.col("pos") + 1).alias("pos"), F.col("z.c").alias("comment"), F.col("z.s").alias("source"))


@query("""SELECT source, count(*)::BIGINT AS n FROM (SELECT unnest(regexp_extract_all(comments_source, '[a-z]+')) AS source FROM raw_critiques) GROUP BY 1""")
def source_header_crosstab(t: Tables):
    """Entries of the source lists by source."""
    s = t("raw_critiques", "comments_source").select(F.explode(S.literal_list(F.col("comments_source"))).alias("source"))
    return s.groupBy("source").agg(F.count("*").alias("n"))


@query("""SELECT task, count(DISTINCT screen_id)::BIGINT AS n_screens FROM screen_tasks WHERE task LIKE '%a%' AND NOT starts_with(task, 'set') GROUP BY 1 HAVING count(DISTINCT screen_id) > 1""")
def reused_tasks(t: Tables):
    """Tasks that stand on several screens, by string predicates."""
    df = t("screen_tasks", "task", "screen_id").where(F.col("task").contains("a") & ~F.col("task").startswith("set"))
    return df.groupBy("task").agg(F.count_distinct("screen_id").alias("n_screens")).where("n_screens > 1")


@query("""SELECT record_id, comment_id FROM human_comments WHERE raw_text IS NOT NULL AND NOT regexp_matches(raw_text, '(?i)to fix this')""")
def texts_without(t: Tables):
    """Comments whose text lacks a wording."""
    return R.find_texts(t("human_comments", "record_id", "comment_id", "raw_text"), "raw_text", "to fix this", missing=True).select("record_id", "comment_id")


@query("""SELECT screen_task_id, split_part(screen_task_id, '_', 1) AS identifier, nullif(split_part(screen_task_id, '_', 2), '') AS name FROM screen_tasks""")
def identifier_parts(t: Tables):
    df = t("screen_tasks", "screen_task_id")
    return df.select("screen_task_id", S.identifier_parts(F.replace("screen_task_id", F.lit("_"), F.lit("/"))).alias("p")).select("screen_task_id", "p.*")
