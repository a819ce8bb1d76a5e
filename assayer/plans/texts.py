"""Comment and guideline texts, and the data side of batch runs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions import scalars as S
from assayer.operators import batch as B, guidelines as G, matching as M, parser as P, prompts as PR, reshape as R
from assayer.plans.registry import Registry, Tables
from assayer.session import shared_folder
from assayer.streaming import ingest

registry = Registry()
query = registry.query


def _q(text: str) -> str:
    return text.replace("'", "''")


def _clean(x: str) -> str:
    return f"regexp_replace(trim(regexp_replace({x}, '[\\s\\pZ]+', ' ', 'g')), '^[ .;]+|[ .;]+$', '', 'g')"


def _key(x: str) -> str:
    return f"trim(regexp_replace(replace(lower({x}), '&', 'and'), '[^a-z0-9]+', ' ', 'g'))"


# ---- comments


@query("""WITH c AS (SELECT record_id, raw_text, regexp_extract(raw_text, '(?i)^\\s*(?:llm\\s+)?comment\\s*[:#]?\\s*(\\d+)', 1) AS num, regexp_matches(raw_text, '(?i)^\\s*llm\\s+comment') AS llm,
    strpos(lower(raw_text), 'to fix this') AS f, strpos(lower(raw_text), 'the expected standard') AS e FROM human_comments)
    SELECT record_id, 'Comment ' || CASE WHEN num = '' THEN '1' ELSE num END AS comment_label, CASE WHEN llm THEN 'LLM' ELSE 'Human' END AS comment_source, e > 0 AS has_standard, f > 0 AS has_fix FROM c WHERE raw_text IS NOT NULL""")
def parse_comment_header(t: Tables):
    """Labels, sources and which parts a comment's text has by its markers."""
    df = P.parse_comments(t("human_comments", "record_id", "raw_text").where("raw_text IS NOT NULL"), "raw_text", F.lit(1))
    lower = F.lower("raw_text")
    return df.select("record_id", "parsed.comment_label", "parsed.comment_source", lower.contains("the expected standard").alias("has_standard"), lower.contains("to fix this").alias("has_fix"))


def _re(pattern: str) -> str:
    """A pattern of the parser for DuckDB, whose U means something else."""
    return _q(pattern.replace("(?iU)", "(?i)"))


def _tidy_sql(x: str) -> str:
    return f"nullif(regexp_replace(regexp_replace({x}, '^[\\s,:\\-–—]+', ''), '[\\s,:\\-–—]+$', ''), '')"


def _glue_sql(x: str) -> str:
    x = f"regexp_replace({x}, '^[\\s,:\\-–—]+', '')"
    for glue in ("is\\s+that", "is\\s+to", "that", "to", "is"):
        x = f"regexp_replace({x}, '(?i)^(?:{glue})\\b\\s*', '')"
    return _tidy_sql(x)


@query(rf"""WITH a AS (SELECT record_id, regexp_replace(coalesce(raw_text, ''), '^\s+|\s+$', '', 'g') AS raw FROM human_comments), b AS (SELECT *, regexp_extract(raw, '{_re(P.HEADER)}', 1) AS cid, regexp_replace(regexp_replace(raw, '{_re(P.HEADER)}', ''), '^\s+|\s+$', '', 'g') AS rest FROM a),
    c AS (SELECT *, list_transform(regexp_extract_all(regexp_extract(rest, '{_re(P.BOX_PATTERN)}', 1), '[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?'), lambda z: z::DOUBLE) AS nums, CASE WHEN regexp_matches(rest, '{_re(P.BOX_PATTERN)}') THEN regexp_replace(regexp_replace(rest, '{_re(P.BOX_PATTERN)}', ' '), '^\s+|\s+$', '', 'g') ELSE rest END AS t FROM b),
    d AS (SELECT *, regexp_extract(t, '{_re(P.EXPECTED)}', 0) AS em, regexp_extract(t, '{_re(P.OBSERVED)}', 0) AS om, regexp_extract(t, '{_re(P.FIX)}', 0) AS fm FROM c),
    e AS (SELECT *, CASE WHEN em <> '' THEN strpos(t, em) END AS e, CASE WHEN om <> '' THEN strpos(t, om) END AS o, CASE WHEN fm <> '' THEN strpos(t, fm) END AS f FROM d),
    g AS (SELECT *, CASE WHEN e IS NOT NULL THEN substr(t, e + length(em), greatest(least(CASE WHEN o > e THEN o ELSE length(t) + 1 END, CASE WHEN f > e THEN f ELSE length(t) + 1 END) - e - length(em), 0)) END AS eseg,
    CASE WHEN o IS NOT NULL THEN substr(t, o + length(om), greatest(least(CASE WHEN e > o THEN e ELSE length(t) + 1 END, CASE WHEN f > o THEN f ELSE length(t) + 1 END) - o - length(om), 0)) WHEN e IS NULL AND f IS NULL THEN t END AS oseg, CASE WHEN f IS NOT NULL THEN substr(t, f + length(fm)) END AS fseg FROM e),
    h AS (SELECT *, {_tidy_sql('oseg')} AS issue FROM g)
    SELECT record_id, 'Comment ' || CASE WHEN cid = '' THEN '1' ELSE regexp_extract(cid, '(\d+)$', 1) END AS comment_label, CASE WHEN regexp_matches(cid, '(?i)^llm\b') THEN 'LLM' ELSE 'Human' END AS comment_source, nums[1:4] AS box_numbers, {_glue_sql('eseg')} AS expected_standard,
    {_tidy_sql(f"CASE WHEN regexp_matches(issue, '{_re(P.FIX)}') THEN left(issue, strpos(issue, regexp_extract(issue, '{_re(P.FIX)}', 0)) - 1) ELSE issue END")} AS observed_issue,
    {_tidy_sql("regexp_replace(regexp_replace(regexp_replace(regexp_replace(fseg, '^\\s+', ''), '(?i)^(?:issue|issues)\\b', ''), '^\\s+', ''), '^,', '')")} AS suggested_fix, trim(regexp_replace(raw, '[\s\pZ]+', ' ', 'g')) AS raw_text FROM h""")
def parse_comment_parts(t: Tables):
    """All parts of the comments' texts. Numbers of a box are given as they stand, of a longer list the first four."""
    df = P.parse_comments(t("human_comments", "record_id", "raw_text"), "raw_text", F.lit(1))
    return df.select("record_id", *(f"parsed.{c}" for c in ("comment_label", "comment_source")), F.coalesce(F.slice("parsed.box_numbers", 1, 4), F.array().cast("array<double>")).alias("box_numbers"), *(f"parsed.{c}" for c in (*P.PARTS, "raw_text")))


@query(rf"""SELECT ref_id, trim(regexp_replace(coalesce(evidence, ''), '[\s\pZ]+', ' ', 'g')) AS clean, {_clean("coalesce(evidence, '')")} AS phrase, {_clean("regexp_replace(" + _clean("coalesce(category, '')") + ", '^(—|–|>|/|\\\\|:|-)\\s*', '')")} AS reference, {_key("coalesce(category, '')")} AS key,
    list_filter(list_transform(string_split(coalesce(raw_reference, ''), ';'), lambda z: {_clean('z')}), lambda z: z <> '') AS pieces, concat_ws(' / ', nullif({_clean("coalesce(category, '')")}, ''), nullif({_clean("coalesce(subcategory, '')")}, '')) AS concept, coalesce(evidence, '') || '|' AS null_as_empty FROM guidelines""")
def text_functions(t: Tables):
    """The text functions on free wordings: cleaned texts, phrases, references, keys, pieces and concept labels, nulls as empty."""
    df = t("guidelines", "ref_id", "category", "subcategory", "evidence", "raw_reference")
    concept = F.concat_ws(" / ", F.nullif(S.clean_phrase(F.col("category")), F.lit("")), F.nullif(S.clean_phrase(F.col("subcategory")), F.lit("")))
    return df.select(
        "ref_id", S.clean_text(F.col("evidence")).alias("clean"), S.clean_phrase(F.col("evidence")).alias("phrase"), S.clean_reference(F.col("category")).alias("reference"), S.normalize_key(F.col("category")).alias("key"),
        S.split_clean(F.coalesce("raw_reference", F.lit("")), ";").alias("pieces"), concept.alias("concept"), F.concat(F.coalesce("evidence", F.lit("")), F.lit("|")).alias("null_as_empty"),
    )


@query("""WITH r AS (SELECT record_id, screen_task_id, observed_issue, suggested_fix, row_number() OVER (PARTITION BY record_id % 1000 ORDER BY record_id) AS nr, record_id % 2 = 0 AS plural FROM human_comments)
    SELECT 'T' || (record_id % 1000) AS screen_task_id, 'L_m_T' || (record_id % 1000) || '_' || lpad(nr::VARCHAR, greatest(3, length(nr::VARCHAR))::INT, '0') AS llm_comment_id, trim(regexp_replace(coalesce(observed_issue, ''), '[\\s\\pZ]+', ' ', 'g')) AS llm_observed_issue, suggested_fix AS llm_suggested_fix,
    CASE WHEN plural THEN '[{"source":"s"}]' ELSE 's' END AS llm_guideline_reference FROM r WHERE trim(regexp_replace(coalesce(observed_issue, ''), '[\\s\\pZ]+', ' ', 'g')) <> ''""")
def llm_critiques_expand(t: Tables):
    """Critiques that came as JSON lists, one row per comment: numbered in their order, the reference under either of its names, blank issues dropped."""
    df = t("human_comments", "record_id", "observed_issue", "suggested_fix")
    several = F.when(F.col("record_id") % 2 == 0, F.array(F.struct(F.lit("s").alias("source"))))
    one = F.when(F.col("record_id") % 2 == 1, F.lit("s"))
    said = F.to_json(F.struct("observed_issue", "suggested_fix", several.alias("guideline_references"), one.alias("guideline_reference")))
    # A thousand lists of bounded share stand for the answers of a thousand tasks.
    lists = df.groupBy(F.concat(F.lit("T"), (F.col("record_id") % 1000).cast("string")).alias("screen_task_id")).agg(F.array_sort(F.collect_list(F.struct("record_id", said.alias("j")))).alias("c"))
    answers = lists.select("screen_task_id", F.concat(F.lit("["), F.array_join(F.transform("c", lambda x: x["j"]), ","), F.lit("]")).alias("critiques"))
    return M.expand_critiques(answers, "m").select("screen_task_id", "llm_comment_id", "llm_observed_issue", "llm_suggested_fix", "llm_guideline_reference")


@query("""WITH x AS (SELECT comment_id, screen_task_id, row_number() OVER (PARTITION BY screen_task_id ORDER BY comment_id) AS i, expected_standard, observed_issue, suggested_fix FROM human_comments),
    k AS (SELECT screen_task_id, 1 AS i, CASE WHEN dropped THEN NULL ELSE 'Use one accent colour only.' END AS v FROM (SELECT screen_task_id, count(*) > 5 AS dropped FROM human_comments GROUP BY 1))
    SELECT comment_id, CASE WHEN k.i IS NOT NULL THEN k.v ELSE suggested_fix END AS suggested_fix, array_to_string(list_filter([CASE WHEN trim(coalesce(expected_standard, '')) = '' THEN 'expected_standard' END, CASE WHEN trim(coalesce(observed_issue, '')) = '' THEN 'observed_issue' END,
    CASE WHEN trim(coalesce(CASE WHEN k.i IS NOT NULL THEN k.v ELSE suggested_fix END, '')) = '' THEN 'suggested_fix' END], lambda z: z IS NOT NULL), ',') AS missing FROM x LEFT JOIN k ON x.screen_task_id = k.screen_task_id AND x.i = k.i""")
def patch_nested(t: Tables):
    """Corrections of single fields, which may be null, and the parts missing afterwards."""
    c = t("human_comments", "comment_id", "screen_task_id", *P.PARTS)
    first = c.groupBy("screen_task_id").agg(F.min("comment_id").alias("comment_id"), (F.count("*") > 5).alias("dropped"))
    fixes = first.select("comment_id", F.lit("suggested_fix").alias("field"), F.when(~F.col("dropped"), "Use one accent colour only.").alias("value"))
    out = P.patch(c, fixes, ["comment_id"])
    return out.select("comment_id", "suggested_fix", F.array_join(P.missing_parts(F.struct(*P.PARTS)), ",").alias("missing"))


@query("""SELECT llm_comment_id, count(*)::BIGINT AS n, count(*) FILTER (trim(coalesce(llm_observed_issue, '')) <> '')::BIGINT AS with_issue FROM (SELECT DISTINCT llm_comment_id, llm_observed_issue, pair_id FROM match_pairs) GROUP BY 1""")
def llm_comment_expand(t: Tables):
    """Model comments with the number of their pairs, and of those with an issue."""
    df = t("match_pairs", "llm_comment_id", "llm_observed_issue", "pair_id").distinct()
    return df.groupBy("llm_comment_id").agg(F.count("*").alias("n"), F.count_if(F.trim(F.coalesce("llm_observed_issue", F.lit(""))) != "").alias("with_issue"))


# ---- guidelines


def catalog_sources(t: Tables) -> list[str]:
    """The sources of the catalogue: five, a fixed list."""
    return [r.label for r in t("guideline_catalog", "tier", "label").where("tier = 'source'").orderBy("label").collect()]


def sources_of(t: Tables) -> list[G.Source]:
    """The sources of the catalogue with their keys: about a hundred labels."""
    return G.catalog_sources(t("guideline_catalog").collect())


def _citations_sql(sources: str, begins: str) -> str:
    """ref_id, m (mention), p (part), g (piece), source and piece of the citations in free text; ``begins`` tells whether a part x of source s begins one."""
    return rf"""src AS (SELECT label AS source FROM guideline_catalog WHERE tier = 'source'), k AS (SELECT source, {_key('label')} AS key, coalesce(category, label) AS category, CASE WHEN tier = 'subcategory' THEN label END AS sub, canon_id FROM guideline_catalog WHERE tier <> 'source'),
    r AS (SELECT ref_id, {_clean('raw_reference')} AS t, (SELECT string_agg(replace(source, '.', '\.'), '|' ORDER BY length(source) DESC) FROM src) AS pat FROM guidelines WHERE raw_reference IS NOT NULL AND NOT regexp_matches({_clean('raw_reference')}, '^[\[{{]')),
    n AS (SELECT ref_id, unnest(regexp_extract_all(lower(t), lower(pat))) AS low, generate_subscripts(regexp_extract_all(lower(t), lower(pat)), 1) AS m, t, pat FROM r),
    c AS (SELECT ref_id, m, source, {_clean("string_split_regex(t, '(?i)(' || pat || ')')[m + 1]")} AS chunk FROM n JOIN src ON lower(source) = low WHERE source IN ({sources})),
    b AS (SELECT ref_id, m, source, unnest(string_split(regexp_replace(chunk, '\||\.\s+([A-Z])', chr(1) || '\1', 'g'), chr(1))) AS bar, generate_subscripts(string_split(regexp_replace(chunk, '\||\.\s+([A-Z])', chr(1) || '\1', 'g'), chr(1)), 1) AS p FROM c),
    h AS (SELECT ref_id, m, p, source, unnest(list_filter(list_transform(string_split(bar, ';'), lambda z: {_clean('z')}), lambda z: z <> '')) AS x, generate_subscripts(list_filter(list_transform(string_split(bar, ';'), lambda z: {_clean('z')}), lambda z: z <> ''), 1) AS i FROM b),
    g AS (SELECT *, sum(CASE WHEN i = 1 OR ({begins}) THEN 1 ELSE 0 END) OVER (PARTITION BY ref_id, m, p ORDER BY i) AS g FROM h),
    cite AS (SELECT ref_id, m, p, g, source, {_clean("regexp_replace(string_agg(x, '; ' ORDER BY i), '^(—|–|-|>|/|\\\\|:)\\s*', '')")} AS piece, row_number() OVER (PARTITION BY ref_id, m ORDER BY p, g) AS nr FROM g GROUP BY ref_id, m, p, g, source)"""


_SEG = r"""list_filter(list_transform(string_split_regex(piece, '\s*(—|–|>|/|\\|:)\s*'), lambda z: """ + _clean("z") + r"""), lambda z: z <> '')"""
_KNOWN = "EXISTS (SELECT 1 FROM k WHERE k.source = h.source AND contains(" + _key("h.x") + ", k.key))"


def _citations(t: Tables, rule: str) -> DataFrame:
    sources = sources_of(t)
    df = G.parse_references(t("guidelines", "ref_id", "raw_reference").where("NOT coalesce(raw_reference rlike '^[ .;]*[\\\\[{]', false)"), "raw_reference", "ref_id", sources)
    return df.where(F.col("source").isin([s.name for s in sources if s.rule == rule]))


@query("WITH " + _citations_sql("'PanelCrit', 'Quayside Checklist', 'Ferrow Access Notes'", "true") + f""" SELECT ref_id, m::INT AS mention, nr::INT AS piece, source, coalesce(s[1], piece) AS category, nullif(array_to_string(s[2:], '; '), '') AS evidence, piece AS raw_reference FROM (SELECT *, {_SEG} AS s FROM cite)""")
def guideline_themes(t: Tables):
    """Citations in free text of the sources that are read by their first segment."""
    return _citations(t, "theme").drop("subcategory")


@query("WITH " + _citations_sql("'Marlow Interface Guide'", _KNOWN) + f""", s AS (SELECT *, CASE WHEN len({_SEG}) = 0 THEN [piece] ELSE {_SEG} END AS s FROM cite), e AS (SELECT ref_id, m, nr, unnest(s) AS seg, generate_subscripts(s, 1) AS i FROM s),
    hit AS (SELECT ref_id, m, nr, i, k.category, k.sub, row_number() OVER (PARTITION BY ref_id, m, nr, i ORDER BY (sub IS NOT NULL)::INT DESC, length(key) DESC, canon_id) AS o FROM e JOIN k ON k.source = 'Marlow Interface Guide' AND contains({_key('seg')}, key)),
    best AS (SELECT ref_id, m, nr, i, category, sub, row_number() OVER (PARTITION BY ref_id, m, nr ORDER BY (sub IS NOT NULL)::INT DESC, i DESC) AS o FROM hit WHERE o = 1)
    SELECT s.ref_id, s.m::INT AS mention, s.nr::INT AS piece, s.source, coalesce(b.category, s.s[1]) AS category, b.sub AS subcategory, nullif(array_to_string(list_filter(s.s, lambda z, j: j <> coalesce(b.i, 1)), '; '), '') AS evidence, s.piece AS raw_reference
    FROM s LEFT JOIN best b ON b.o = 1 AND s.ref_id = b.ref_id AND s.m = b.m AND s.nr = b.nr""")
def guideline_tree(t: Tables):
    """Citations in free text of the source that is a tree of categories."""
    return _citations(t, "tree")


@query("WITH " + _citations_sql("'Tessel Heuristics'", _KNOWN) + f""", hit AS (SELECT cite.*, k.category AS cat, k.key, row_number() OVER (PARTITION BY ref_id, m, nr ORDER BY length(k.key) DESC NULLS LAST, canon_id) AS o FROM cite LEFT JOIN k ON k.source = cite.source AND contains({_key('piece')}, k.key)),
    w AS (SELECT *, {_clean("regexp_replace(piece, '(?i)' || replace(key, ' ', '[^a-zA-Z0-9]+'), '')")} AS rest FROM hit WHERE o = 1)
    SELECT ref_id, m::INT AS mention, nr::INT AS piece, source, coalesce(cat, piece) AS category, CASE WHEN cat IS NOT NULL THEN nullif({_clean("regexp_replace(rest, '\\s*(—|–|>|/|\\\\|:)\\s*', ' ')")}, '') END AS evidence, piece AS raw_reference FROM w""")
def guideline_headings(t: Tables):
    """Citations in free text of the source with numbered headings and other wordings."""
    return _citations(t, "heuristic").drop("subcategory")


@query()
def guideline_parse(t: Tables):
    """Every citation in raw_reference, lists and objects included, with its source, category, subcategory and evidence."""
    return G.parse_references(t("guidelines", "ref_id", "raw_reference"), "raw_reference", "ref_id", sources_of(t))


@query("""SELECT ref_id, s.label AS source, (len(regexp_extract_all(lower(raw_reference), lower(s.label))))::BIGINT AS n FROM guidelines, (SELECT label FROM guideline_catalog WHERE tier = 'source') s WHERE contains(lower(raw_reference), lower(s.label))""")
def guideline_source_slices(t: Tables):
    """How often each source is mentioned in a field."""
    df = G.cited(t("guidelines", "ref_id", "raw_reference"), "raw_reference", catalog_sources(t))
    return df.groupBy("ref_id", "source").agg(F.count("*").alias("n"))


VOCAB_SQL = """v AS (SELECT source, trim(regexp_replace(replace(lower(label), '&', 'and'), '[^a-z0-9]+', ' ', 'g')) AS v_key, coalesce(category, label) AS category, CASE WHEN tier = 'subcategory' THEN label END AS subcategory, canon_id FROM guideline_catalog WHERE tier <> 'source'),
    x AS (SELECT DISTINCT c.label AS source, trim(regexp_replace(replace(lower(g.category), '&', 'and'), '[^a-z0-9]+', ' ', 'g')) AS norm FROM guidelines g JOIN guideline_catalog c ON c.tier = 'source' AND lower(trim(g.source)) = lower(c.label) WHERE g.category IS NOT NULL)"""


@query(f"""WITH {VOCAB_SQL} SELECT source, norm, category, subcategory FROM (SELECT x.source, norm, v.category, subcategory, row_number() OVER (PARTITION BY x.source, norm ORDER BY (norm = v_key)::INT DESC, length(v_key) DESC, canon_id) AS k
    FROM x JOIN v ON x.source = v.source AND contains(' ' || norm || ' ', ' ' || v_key || ' ')) WHERE k = 1""")
def vocab_longest_match(t: Tables):
    """The category meant by the longest label that a typed category holds in whole words."""
    sources = F.create_map(*(F.lit(x) for s in catalog_sources(t) for x in (s.lower(), s)))
    texts = t("guidelines", "source", "category").select(F.try_element_at(sources, F.lower(F.trim("source"))).alias("source"), S.normalize_key(F.col("category")).alias("norm"))
    texts = texts.where("source IS NOT NULL AND norm IS NOT NULL").distinct()
    found = G.longest_match(texts, G.vocabulary(t("guideline_catalog")), "norm")
    return found.where("matched IS NOT NULL").select("source", "norm", "category", "subcategory")


@query("""SELECT source, category, n, round(100.0 * n / sum(n) OVER (PARTITION BY source), 4)::DOUBLE AS pct FROM (SELECT g.source, coalesce(c.label, '(unmapped)') AS category, count(*)::BIGINT AS n FROM (SELECT source, category FROM guidelines WHERE source IN (SELECT label FROM guideline_catalog WHERE tier = 'source')) g
    LEFT JOIN guideline_catalog c ON c.tier = 'category' AND c.source = g.source AND c.label = g.category GROUP BY ALL)""")
def guideline_focus(t: Tables):
    """Shares of the categories within their source, unmapped wordings pooled."""
    cat = t("guideline_catalog", "tier", "source", "label")
    g = t("guidelines", "source", "category").groupBy("source", "category").agg(F.count("*").alias("n")).join(cat.where("tier = 'source'").select(F.col("label").alias("source")), "source", "left_semi")
    known = cat.where("tier = 'category'").select("source", F.col("label").alias("category"), F.lit(True).alias("hit"))
    counts = g.join(known, ["source", "category"], "left").groupBy("source", F.when(F.col("hit"), F.col("category")).otherwise("(unmapped)").alias("category")).agg(F.sum("n").alias("n"))
    return R.share_of_group(counts, ["source"], "n", "pct").withColumn("pct", F.round(F.col("pct") * 100, 4))


@query("""SELECT CASE WHEN k <= 9 THEN category ELSE 'Other' END AS concept, sum(n)::BIGINT AS n FROM (SELECT category, n, row_number() OVER (ORDER BY n DESC, category) AS k FROM (SELECT category, count(*)::BIGINT AS n FROM guidelines WHERE trim(coalesce(category, '')) <> '' GROUP BY 1)) GROUP BY 1""")
def concept_top_k(t: Tables):
    """The nine most cited wordings and the rest together."""
    counts = t("guidelines", "category").where("trim(coalesce(category, '')) <> ''").groupBy("category").agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "category").limit(9).select("category", F.lit(True).alias("hit"))
    return counts.join(F.broadcast(top), "category", "left").groupBy(F.when(F.col("hit"), F.col("category")).otherwise("Other").alias("concept")).agg(F.sum("n").alias("n"))


FOCUS = (("layout", "align|spac|grid|crowd|balanc"), ("text", "text|label|word|legib|type"), ("colour", "colou?r|contrast|hue|accent"), ("feedback", "state|feedback|load|wait"), ("errors", "error|slip|recover|undo"))


@query("""SELECT CASE WHEN regexp_matches(x, 'align|spac|grid|crowd|balanc') THEN 'layout' WHEN regexp_matches(x, 'text|label|word|legib|type') THEN 'text' WHEN regexp_matches(x, 'colou?r|contrast|hue|accent') THEN 'colour' WHEN regexp_matches(x, 'state|feedback|load|wait') THEN 'feedback'
    WHEN regexp_matches(x, 'error|slip|recover|undo') THEN 'errors' ELSE 'other' END AS focus, count(*)::BIGINT AS n FROM (SELECT lower(category) AS x FROM guidelines WHERE category IS NOT NULL) GROUP BY 1""")
def crowd_focus(t: Tables):
    """Categories by the first keyword pattern that they hold."""
    df = t("guidelines", "category").where("category IS NOT NULL")
    return df.groupBy(S.first_match(F.lower("category"), FOCUS, "other").alias("focus")).agg(F.count("*").alias("n"))


@query("""SELECT issue, value, n FROM (SELECT *, row_number() OVER (PARTITION BY issue ORDER BY n DESC, value) AS k FROM (SELECT 'source' AS issue, source AS value, count(*)::BIGINT AS n FROM guidelines WHERE source IS NOT NULL AND source NOT IN (SELECT label FROM guideline_catalog WHERE tier = 'source') GROUP BY 2
    UNION ALL SELECT 'category', category, count(*)::BIGINT FROM guidelines WHERE category IS NOT NULL AND category NOT IN (SELECT label FROM guideline_catalog WHERE tier = 'category') GROUP BY 2)) WHERE k <= 20""")
def unmapped_report(t: Tables):
    """The twenty most frequent wordings that are no label, by field."""
    cat = t("guideline_catalog", "tier", "label")
    out = None
    for field in ("source", "category"):
        counts = t("guidelines", field).where(F.col(field).isNotNull()).groupBy(F.col(field).alias("value")).agg(F.count("*").alias("n"))
        one = counts.join(cat.where(F.col("tier") == field).select(F.col("label").alias("value")), "value", "left_anti").select(F.lit(field).alias("issue"), "value", "n")
        out = one if out is None else out.unionByName(one)
    return R.first_per_key(out, ["issue"], [F.desc("n"), F.asc("value")], 20)


@query("""SELECT screen_task_id, count(*)::BIGINT AS n, count(*) FILTER (trim(coalesce(raw_reference, '')) <> '')::BIGINT AS with_reference, min(cited_at) FILTER (trim(coalesce(raw_reference, '')) <> '') AS first_cited, count(DISTINCT source)::BIGINT AS n_sources FROM guidelines GROUP BY 1""")
def reference_presence(t: Tables):
    here = F.trim(F.coalesce("raw_reference", F.lit(""))) != ""
    return t("guidelines", "screen_task_id", "raw_reference", "cited_at", "source").groupBy("screen_task_id").agg(F.count("*").alias("n"), F.count_if(here).alias("with_reference"), F.min(F.when(here, F.col("cited_at"))).alias("first_cited"), F.count_distinct("source").alias("n_sources"))


# ---- batch runs

ASPECTS = ["aesthetics", "usability", "design_quality"]


@query("""SELECT screen_task_id, trial::INT AS trial, aspect, screen_task_id || '&trial' || trial || '&aspect=' || aspect AS custom_id FROM screen_tasks, (SELECT unnest([1, 2]) AS trial), (SELECT unnest(['aesthetics', 'usability', 'design_quality']) AS aspect)""")
def schedule_rating(t: Tables):
    return B.rating_schedule(t("screen_tasks", "screen_task_id"), ASPECTS, 2)


@query("""SELECT screen_task_id, trial::INT AS trial FROM screen_tasks, (SELECT unnest([1, 2, 3]) AS trial)""")
def trials_cross(t: Tables):
    """Every task with its trial numbers, made by an array and not by a join."""
    return t("screen_tasks", "screen_task_id").select("screen_task_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("trial"))


@query("""SELECT screen_id, screen_task_id FROM (SELECT screen_id, min(screen_task_id) AS screen_task_id FROM screen_tasks GROUP BY 1) ORDER BY screen_id LIMIT 50""")
def subset_first_n(t: Tables):
    """The first task of each of the first fifty screens (a subset that the feature asks for)."""
    return t("screen_tasks", "screen_id", "screen_task_id").groupBy("screen_id").agg(F.min("screen_task_id").alias("screen_task_id")).orderBy("screen_id").limit(50)


@query("""WITH s AS (SELECT critique_id, aesthetics_rating + usability_rating + design_quality_rating AS total FROM raw_critiques WHERE aesthetics_rating + usability_rating + design_quality_rating IS NOT NULL), r AS (SELECT *, row_number() OVER (ORDER BY total, critique_id) AS k, count(*) OVER () AS n FROM s),
    d AS (SELECT *, row_number() OVER (ORDER BY total DESC, critique_id DESC) AS j FROM r) SELECT critique_id, total, 'low' AS section FROM d WHERE k <= 3 UNION ALL SELECT critique_id, total, 'middle' FROM d WHERE k = n // 2 + 1 UNION ALL SELECT critique_id, total, 'high' FROM d WHERE j <= 3""")
def few_shot_pick(t: Tables):
    """The three lowest and highest and the middle critique by their total."""
    df = t("raw_critiques", "critique_id", "aesthetics_rating", "usability_rating", "design_quality_rating")
    df = df.select("critique_id", (F.col("aesthetics_rating") + F.col("usability_rating") + F.col("design_quality_rating")).alias("total")).where("total IS NOT NULL")
    return B.few_shot(df, "total", "critique_id")


TEMPLATE = "Rate the screen for this task: {task}. App category: {category}. Answer with a number."


@query("""SELECT screen_task_id, replace(replace('Rate the screen for this task: {task}. App category: {category}. Answer with a number.', '{task}', task), '{category}', coalesce(app_category, 'unknown')) AS prompt FROM screen_tasks WHERE task IS NOT NULL""")
def few_shot_prompt_text(t: Tables):
    df = t("screen_tasks", "screen_task_id", "task", "app_category").where("task IS NOT NULL")
    return df.select("screen_task_id", B.fill_template(TEMPLATE, task=F.col("task"), category=F.coalesce("app_category", F.lit("unknown"))).alias("prompt"))


@query("""SELECT screen_task_id, screen_task_id || '&aspect=usability' AS custom_id, length('Rate: ' || task)::INT AS n_chars FROM screen_tasks WHERE trim(coalesce(task, '')) <> ''""")
def request_rows(t: Tables):
    """Request lines of valid tasks, read back from their JSON."""
    df = B.rating_schedule(t("screen_tasks", "screen_task_id"), ["usability"]).join(t("screen_tasks", "screen_task_id", "task"), "screen_task_id").where("trim(coalesce(task, '')) <> ''")
    line = B.chat_request(F.col("custom_id"), "m", "s", B.fill_template("Rate: {task}", task=F.col("task")), 0.0, 2048)
    body = df.select("screen_task_id", line.alias("line"))
    return body.select("screen_task_id", F.get_json_object("line", "$.custom_id").alias("custom_id"), F.length(F.get_json_object("line", "$.body.messages[1].content")).alias("n_chars"))


_BLOCKS = {a: PR.RATING_HEADER.replace("{guidelines}", PR.GUIDELINES_P1) + PR.TASK_LINE + "\n\n" + r + "\n" + PR.RETURN_LINE + f for a, (r, f, _) in PR.ASPECTS.items()}


@query("SELECT screen_task_id, aspect, md5(replace(text, '{task}', task)) AS prompt FROM screen_tasks, (" + " UNION ALL ".join(f"SELECT '{a}' AS aspect, '{_q(x)}' AS text" for a, x in _BLOCKS.items()) + ") WHERE task IS NOT NULL")
def rating_prompts(t: Tables):
    """The prompts of all ratings without examples, by their digest."""
    df = B.rating_schedule(t("screen_tasks", "screen_task_id"), list(PR.ASPECTS)).join(t("screen_tasks", "screen_task_id", "task"), "screen_task_id").where("task IS NOT NULL")
    return df.select("screen_task_id", "aspect", F.md5(PR.rating_prompt(F.col("task"), F.col("aspect"), PR.GUIDELINES_P1)).alias("prompt"))


@query("SELECT screen_task_id, version, md5(replace(text, '{task}', task)) AS prompt FROM screen_tasks, (" + " UNION ALL ".join(f"SELECT '{v}' AS version, '{_q(PR.critique_template(v).replace('{guidelines}', PR.GUIDELINES_P1 if v == 'p1' else PR.GUIDELINES))}' AS text" for v in PR.CRITIQUES) + ") WHERE task IS NOT NULL")
def critique_prompts(t: Tables):
    """The prompts of all critiques in every version, by their digest."""
    df = t("screen_tasks", "screen_task_id", "task").where("task IS NOT NULL")
    told = F.array(*(F.struct(F.lit(v).alias("version"), F.md5(PR.critique_prompt(F.col("task"), PR.GUIDELINES_P1 if v == "p1" else PR.GUIDELINES, v)).alias("prompt")) for v in PR.CRITIQUES))
    return df.select("screen_task_id", F.inline(told))


_BOX_TEXT = "CASE WHEN {b} IS NULL THEN 'unavailable' ELSE '[' || concat_ws(', ', printf('%.3f', {b}.x_min), printf('%.3f', {b}.y_min), printf('%.3f', {b}.x_max), printf('%.3f', {b}.y_max)) || ']' END"


@query(f"""WITH h AS (SELECT comment_id, observed_issue, CASE WHEN bounding_box.x_min IS NULL OR bounding_box.x_max IS NULL OR bounding_box.y_min IS NULL OR bounding_box.y_max IS NULL THEN NULL ELSE bounding_box END AS b, screen_task_id FROM (SELECT *, row_number() OVER (PARTITION BY comment_id ORDER BY record_id) AS k FROM human_comments) WHERE k = 1)
    SELECT pair_id, md5('{_q(chr(10).join(PR.MATCH_HEAD))}' || chr(10) || coalesce(s.task, '') || chr(10) || '{_q(chr(10).join(PR.MATCH_BOX))}' || chr(10) || {_BOX_TEXT.format(b='h.b')} || chr(10) || chr(10) || 'Comment A:' || chr(10) || coalesce(h.observed_issue, '') || chr(10) || chr(10) || 'Comment B:' || chr(10) || coalesce(m.llm_observed_issue, '')
    || chr(10) || '{_q(chr(10).join(PR.MATCH_TAIL))}') AS prompt FROM (SELECT DISTINCT pair_id, screen_task_id, expert_comment_id, llm_observed_issue FROM match_pairs) m JOIN h ON h.comment_id = m.expert_comment_id LEFT JOIN screen_tasks s ON s.screen_task_id = m.screen_task_id""")
def match_prompts(t: Tables):
    """The question of each pair of an expert's and a model's comment, by its digest. A box that lacks a corner counts as none."""
    first = t("human_comments", "record_id", "comment_id", "observed_issue", "bounding_box").groupBy(F.col("comment_id").alias("expert_comment_id")).agg(F.min_by(F.struct("observed_issue", "bounding_box"), "record_id").alias("r"))
    b = F.col("r.bounding_box")
    box = F.when(b["x_min"].isNotNull() & b["x_max"].isNotNull() & b["y_min"].isNotNull() & b["y_max"].isNotNull(), b)
    pairs = t("match_pairs", "pair_id", "screen_task_id", "expert_comment_id", "llm_observed_issue").distinct().join(first, "expert_comment_id").join(t("screen_tasks", "screen_task_id", "task"), "screen_task_id", "left")
    return pairs.select("pair_id", F.md5(PR.MATCH_REVIEW.prompt(F.col("task"), F.col("r.observed_issue"), box, F.col("llm_observed_issue"))).alias("prompt"))


@query("""SELECT shape, screen_task_id AS custom_id, model, task AS text, 'sys' AS system, 0.5::DOUBLE AS temperature, 2048 AS max_tokens, CASE WHEN screen_id % 2 = 0 THEN ['sample image 1', 'target image'] ELSE ['target image'] END AS labels FROM
    (SELECT * FROM screen_tasks WHERE trim(coalesce(task, '')) <> ''), (SELECT unnest(['chat', 'messages', 'parts']) AS shape, unnest(['m', 'm', 'models/m']) AS model)""")
def request_previews(t: Tables):
    """Request lines in three providers' shapes with a sample image for every other screen, read back."""
    df = t("screen_tasks", "screen_task_id", "screen_id", "task").where("trim(coalesce(task, '')) <> ''")
    images = F.array(F.when(F.col("screen_id") % 2 == 0, F.base64(F.lit("sample").cast("binary"))), F.base64(F.col("screen_task_id").cast("binary")))
    args = (F.col("screen_task_id"), "m", "sys", F.col("task"), 0.5, 2048, images)
    lines = {"chat": B.chat_request(*args, schema=PR.MATCH_REVIEW.schema), "messages": B.messages_request(*args), "parts": B.content_parts_request(*args, schema=PR.MATCH_REVIEW.schema)}
    rows = df.select(F.inline(F.array(*(F.struct(F.lit(k).alias("shape"), v.alias("line")) for k, v in lines.items())))).withColumn("p", B.preview(F.col("line")))
    return rows.select("shape", "p.custom_id", "p.model", "p.text", "p.system", "p.temperature", "p.max_tokens", F.transform("p.images", lambda x: x["label"]).alias("labels"))


@query("""WITH r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY screen_task_id ORDER BY rated_at DESC, critique_id DESC) AS k FROM raw_critiques WHERE screen_task_id IS NOT NULL) WHERE k = 1)
    SELECT screen_task_id, NULL::INT AS trial, aesthetics_rating::DOUBLE AS aesthetics_rating, learnability::DOUBLE AS learnability, efficiency::DOUBLE AS efficiency, usability_rating::DOUBLE AS usability_rating, NULL::DOUBLE AS design_quality_rating FROM r""")
def ratings_from_answers(t: Tables):
    """Answers about two aspects, written as models do, led back to the columns they fill; the last answer counts and the third aspect was never asked."""
    df = t("raw_critiques", "critique_id", "screen_task_id", "rated_at", "aesthetics_rating", "learnability", "efficiency", "usability_rating").where("screen_task_id IS NOT NULL")
    noisy = lambda *columns: F.concat(F.lit("Sure:\n```json\n"), F.to_json(F.struct(*columns)), F.lit("\n```"))
    asked = {"aesthetics_rating": noisy("aesthetics_rating"), "usability_rating": noisy("learnability", "efficiency", "usability_rating")}
    rows = df.select("rated_at", "critique_id", F.inline(F.array(*(F.struct(F.concat("screen_task_id", F.lit(f"&aspect={a}")).alias("custom_id"), text.alias("text")) for a, text in asked.items()))))
    return B.ratings_of(rows, ["rated_at", "critique_id"])


@query("""SELECT o_orderkey AS job, CASE WHEN o_orderstatus = 'P' THEN 'retry_pending' ELSE o_orderstatus END AS status, CASE WHEN o_orderstatus <> 'P' THEN o_custkey::VARCHAR END AS batch_id, (o_orderstatus = 'P')::BIGINT AS n_attempts, CASE WHEN o_orderstatus = 'P' THEN o_custkey::VARCHAR END AS last_batch FROM orders""")
def attempts_archive(t: Tables):
    """Jobs whose attempt failed keep it and are ready to be submitted again."""
    s, none = F.col("o_orderstatus"), F.lit(None).cast("string")
    kept = "array<struct<input_file_id:string,batch_id:string,status:string,created_at:string,retrieved_at:string,error:string,check_failures:int,archived_at:string>>"
    jobs = t("orders", "o_orderkey", "o_custkey", "o_orderstatus").select(
        F.col("o_orderkey").alias("job"), none.alias("input_file_id"), F.col("o_custkey").cast("string").alias("batch_id"), s.alias("status"), none.alias("created_at"), none.alias("retrieved_at"), none.alias("error"), F.lit(0).alias("check_failures"), F.lit(None).cast(kept).alias("attempts")
    )
    out = B.archive_attempts(jobs, F.col("status") == "P", F.lit("now"))
    return out.select("job", "status", "batch_id", F.greatest(F.coalesce(F.size("attempts"), F.lit(0)), F.lit(0)).cast("long").alias("n_attempts"), F.try_element_at("attempts", F.lit(-1))["batch_id"].alias("last_batch"))


@query("""SELECT screen_task_id FROM screen_tasks WHERE screen_task_id NOT IN (SELECT min(screen_task_id) FROM screen_tasks GROUP BY screen_id ORDER BY screen_id LIMIT 50)""")
def schedule_complement(t: Tables):
    """The tasks outside the subset of subset_first_n."""
    return t("screen_tasks", "screen_task_id").join(subset_first_n(t), "screen_task_id", "left_anti")


@query()
def pack_files(t: Tables):
    """Request lines packed into files of at most 20,000 bytes."""
    df = t("screen_tasks", "screen_task_id", "task").select("screen_task_id", F.to_json(F.struct("screen_task_id", "task")).alias("line"))
    return B.pack_lines(df, "screen_task_id", "line", 20_000, 4)


@query("""SELECT DISTINCT custom_id, task, trial::INT AS trial, aspect FROM (SELECT screen_task_id || '&trial2&aspect=usability' AS custom_id, screen_task_id AS task, 2 AS trial, 'usability' AS aspect FROM screen_tasks UNION ALL SELECT screen_task_id || '&aspect=aesthetics', screen_task_id, NULL, 'aesthetics' FROM screen_tasks UNION ALL SELECT screen_task_id, screen_task_id, NULL, screen_task_id FROM screen_tasks)""")
def custom_id_parse(t: Tables):
    s = F.col("screen_task_id")
    ids = t("screen_tasks", "screen_task_id").select(F.explode(F.array(F.concat(s, F.lit("&trial2&aspect=usability")), F.concat(s, F.lit("&aspect=aesthetics")), s)).alias("custom_id")).distinct()
    return ids.withColumn("p", B.parse_custom_id(F.col("custom_id"))).select("custom_id", F.col("p.screen_task_id").alias("task"), "p.trial", "p.aspect")


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 2 = 1""")
def json_from_noise(t: Tables):
    """An object found between code fences; every other text is cut so that nothing can be read."""
    noisy = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Here it is:\n```json\n"), "props", F.lit("\n```"))).otherwise(F.concat(F.lit("```json\n"), F.left("props", F.length("props") - 1)))
    return t("events", "event_id", "props").select("event_id", F.get_json_object(S.json_object_in(noisy), "$.k").alias("k"))


@query("""SELECT user_id, n, props FROM (SELECT user_id, count(*)::BIGINT AS n, arg_max(props, event_id) AS props FROM events GROUP BY 1)""")
def stream_latest_wins(t: Tables):
    """The last record of each id, as the stream of events leaves it, with the number of its records."""
    place = f"{shared_folder(t.spark)}/stream-{uuid.uuid4().hex}"
    last = ingest.run(ingest.table_stream(t.spark, t.folder, "events", ["event_id", "user_id", "props"]), f"{place}/table", f"{place}/checkpoint", "user_id", ["event_id"])
    n = t("events", "user_id").groupBy("user_id").agg(F.count("*").alias("n"))
    return last.join(n, "user_id").select("user_id", "n", "props")


@query("""SELECT date_trunc('hour', ts) AS start, event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL""")
def event_windows(t: Tables):
    """Events by hour and type, counted by a stream with a watermark; a window's latest count stands."""
    place = f"{shared_folder(t.spark)}/stream-{uuid.uuid4().hex}"
    counts = ingest.windowed_counts(ingest.table_stream(t.spark, t.folder, "events", ["ts", "event_type"]), "ts", ["event_type"], "1 hour", "2 hours")
    keyed = counts.withColumn("key", F.concat_ws("|", F.col("start").cast("string"), "event_type"))
    last = ingest.run(keyed, f"{place}/table", f"{place}/checkpoint", "key", ["n"], "update")
    return last.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("""SELECT s.screen_task_id, coalesce(r.v, s.screen_id) AS value, r.v IS NOT NULL AS answered FROM screen_tasks s LEFT JOIN (SELECT screen_task_id, arg_max(usability_rating, (rated_at, critique_id)) AS v FROM raw_critiques GROUP BY 1) r USING (screen_task_id)""")
def upsert_responses(t: Tables):
    """The latest answer of each task put into a table of responses; tasks without one keep what they had."""
    answers = B.latest_answers(t("raw_critiques", "screen_task_id", "rated_at", "critique_id", "usability_rating"), "screen_task_id", ["rated_at", "critique_id"])
    base = t("screen_tasks", "screen_task_id", "screen_id").select("screen_task_id", F.col("screen_id").alias("value"))
    out = B.upsert(base, answers.select("screen_task_id", F.col("usability_rating").alias("value")), ["screen_task_id"], ["value"])
    return out.join(answers.select("screen_task_id", F.col("usability_rating").isNotNull().alias("answered")), "screen_task_id", "left").select("screen_task_id", "value", F.coalesce("answered", F.lit(False)).alias("answered"))


@query("""SELECT pair_id, judge_id, error FROM (SELECT *, row_number() OVER (PARTITION BY pair_id, judge_id ORDER BY voted_at DESC, vote_id DESC) AS k FROM judge_votes) WHERE k = 1 AND error IS NOT NULL""")
def error_view(t: Tables):
    """Votes whose latest record is still an error."""
    df = t("judge_votes", "pair_id", "judge_id", "vote_id", "voted_at", "error")
    latest = df.groupBy("pair_id", "judge_id").agg(F.max(F.struct("voted_at", "vote_id", "error")).alias("r"))
    return latest.where("r.error IS NOT NULL").select("pair_id", "judge_id", "r.error")


@query("""SELECT vote_id, CASE WHEN error = 'http_429' THEN 'http status 429' WHEN error = 'invalid_json' THEN 'invalid json' WHEN relation IS NULL THEN 'missing relation' WHEN relation NOT IN (SELECT relation FROM relation_ranks) THEN 'invalid relation' END AS reason FROM judge_votes""")
def record_content_extract(t: Tables):
    """Votes written as provider records, read back through the ladder of checks."""
    e, content = F.col("error"), F.to_json(F.struct("relation"))
    text = F.when(e == "invalid_json", F.lit("no answer")).otherwise(F.coalesce(content, F.lit("{}")))
    message = F.struct(F.lit("assistant").alias("role"), text.alias("content"))
    status = F.when(e == "http_429", 429).otherwise(200)
    record = F.to_json(F.struct(F.col("vote_id").alias("custom_id"), F.struct(status.alias("status_code"), F.struct(F.array(F.struct(message.alias("message"))).alias("choices")).alias("body")).alias("response")))
    from assayer.operators.matching import WEIGHTS

    return t("judge_votes", "vote_id", "relation", "error").select("vote_id", B.answer_error(record, {"relation": list(WEIGHTS)}).alias("reason"))


@query("""SELECT DISTINCT pair_id, judge_id FROM judge_votes v WHERE NOT EXISTS (SELECT 1 FROM judge_votes w WHERE w.pair_id = v.pair_id AND w.judge_id = v.judge_id AND w.relation IS NOT NULL)""")
def retry_subset(t: Tables):
    """Votes to ask for again: no record of them is valid."""
    df = t("judge_votes", "pair_id", "judge_id", "relation")
    return df.groupBy("pair_id", "judge_id").agg(F.count("relation").alias("n")).where("n = 0").select("pair_id", "judge_id")


@query("""SELECT status, next, count(*)::BIGINT AS n FROM (SELECT status, CASE WHEN status = 'completed' AND retrieved THEN 'done' WHEN status IN ('failed', 'expired') THEN 'submit' WHEN f >= 3 THEN 'give_up' WHEN f > 0 THEN 'unverified' ELSE 'running' END AS next FROM
    (SELECT CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status, o_orderkey % 2 = 0 AS retrieved, o_custkey % 4 AS f FROM orders)) GROUP BY ALL""")
def job_reconcile(t: Tables):
    """What to do next with jobs in all states."""
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running").otherwise("failed")
    jobs = t("orders", "o_orderkey", "o_custkey", "o_orderstatus").select(status.alias("status"), (F.col("o_orderkey") % 2 == 0).alias("retrieved"), (F.col("o_custkey") % 4).alias("check_failures"), F.col("o_orderkey").cast("string").alias("batch_id"))
    return B.reconcile(jobs).groupBy("status", "next").agg(F.count("*").alias("n"))


@query("""SELECT screen_task_id, array_to_string(list_sort(list(comment_id)), ',') AS ids FROM human_comments GROUP BY 1""")
def json_roundtrip(t: Tables):
    """Lists written as JSON and read again."""
    lists = t("human_comments", "screen_task_id", "comment_id").groupBy("screen_task_id").agg(F.to_json(F.array_sort(F.collect_list("comment_id"))).alias("j"))
    return lists.select("screen_task_id", F.array_join(F.from_json("j", "array<string>"), ",").alias("ids"))


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL""")
def line_summary(t: Tables):
    """A plain aggregate over the largest of the order tables."""
    df = t("lineitem", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount")
    return df.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("""SELECT 'left only' AS side, count(*)::BIGINT AS n FROM (SELECT screen_task_id, task FROM screen_tasks EXCEPT SELECT screen_task_id, task FROM raw_critiques) UNION ALL SELECT 'right only', count(*)::BIGINT FROM (SELECT screen_task_id, task FROM raw_critiques EXCEPT SELECT screen_task_id, task FROM screen_tasks)""")
def set_difference_pair(t: Tables):
    """Rows that only one of two tables has."""
    a, b = t("screen_tasks", "screen_task_id", "task"), t("raw_critiques", "screen_task_id", "task")
    one = lambda x, y, name: x.subtract(y).agg(F.lit(name).alias("side"), F.count("*").alias("n"))
    return one(a, b, "left only").unionByName(one(b, a, "right only"))


@query("""SELECT screen_task_id AS task_key, upper(left(app_category, 1)) || lower(substr(app_category, 2)) AS category_label, screen_id AS left_screen_id FROM screen_tasks WHERE app_category IS NOT NULL""")
def project_rename(t: Tables):
    df = t("screen_tasks", "screen_task_id", "app_category", "screen_id").where("app_category IS NOT NULL")
    c = F.col("app_category")
    return df.select(F.col("screen_task_id").alias("task_key"), F.concat(F.upper(F.left(c, F.lit(1))), F.lower(F.substring(c, F.lit(2), F.length(c)))).alias("category_label"), F.col("screen_id").alias("left_screen_id"))
