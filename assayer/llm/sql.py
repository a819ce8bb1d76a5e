"""The results of this subpackage's queries in SQL, where SQL can say them over whole tables."""

_WIDE, _PLAIN = "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F))).replace("'", "''")

def _bare(x: str) -> str:
    """``x`` in lower case with its letters and digits only."""
    return f"regexp_replace(lower(translate({x}, '{_WIDE}', '{_PLAIN}')), '[^\\pL\\pN]+', '', 'g')"


P2_FOUND = """SELECT s.model_short, s.app_category FROM (SELECT model_short, coalesce(app_category, 'Unknown') AS app_category, target_n, min_n FROM sample_targets) s LEFT JOIN
    (SELECT model_short, coalesce(app_category, 'Unknown') AS app_category, count(DISTINCT pair_id) AS n FROM match_pairs WHERE llm_observed_issue IS NOT NULL GROUP BY ALL) u USING (model_short, app_category)
    WHERE coalesce(u.n, 0) < greatest(target_n, min_n)"""

P3_TOP = """WITH lbl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY judged_at DESC, expert_comment_id DESC, relation DESC NULLS LAST, confidence DESC NULLS LAST) AS k FROM match_pairs) WHERE k = 1),
    r AS (SELECT expert_comment_id, pair_id, l.relation, confidence, row_number() OVER (PARTITION BY expert_comment_id ORDER BY rank_no, confidence DESC, pair_id)::INT AS rank FROM lbl l JOIN relation_ranks q ON l.relation = q.relation WHERE confidence IS NOT NULL AND NOT isnan(confidence))
    SELECT expert_comment_id, rank, pair_id, relation, confidence FROM r WHERE rank <= 3"""

P4_SURVIVORS = """WITH RECURSIVE dec AS (SELECT left_comment_id AS a, right_comment_id AS b, replace(replace(lower(trim(recommended_action)), ' ', '_'), '-', '_') AS action FROM
    (SELECT *, row_number() OVER (PARTITION BY custom_id ORDER BY reviewed_at DESC, recommended_action DESC NULLS LAST) AS k FROM dup_reviews) WHERE k = 1), m AS (SELECT * FROM dec WHERE action IN ('keep_a', 'keep_b')),
    e AS (SELECT a, b FROM m UNION SELECT b, a FROM m), reach AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a), grp AS (SELECT a AS comment_id, least(a, min(b)) AS group_id FROM reach GROUP BY a),
    dropped AS (SELECT DISTINCT CASE action WHEN 'keep_a' THEN b ELSE a END AS comment_id FROM m),
    v AS (SELECT group_id, comment_id, updated_at, field_name, value FROM (SELECT group_id, comment_id, updated_at, unnest(['observed_issue', 'suggested_fix']) AS field_name, unnest([observed_issue, suggested_fix]) AS value FROM human_comments JOIN grp USING (comment_id)) WHERE value IS NOT NULL),
    s AS (SELECT *, trim(regexp_replace(value, '[\\s\\pZ]+', ' ', 'g')) AS text FROM v WHERE regexp_replace(lower(value), '^[\\s\\pZ\\pP\\pS]+|[\\s\\pZ\\pP\\pS]+$', '', 'g') NOT IN ('', 'n/a', 'none', 'null', 'tbd', 'todo', 'x', 'blank', 'no text', 'same as above', 'see other comment')),
    t AS (SELECT *, trim(regexp_replace(text, '(?:[\\s\\pZ]*(?:…|\\.{2,}|[\\[(](?:cut|truncated|\\.\\.\\.|…)[\\])]|[-–—]))+[\\s\\pZ]*$', '')) AS stem FROM s),
    u AS (SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM t o WHERE o.group_id = t.group_id AND o.field_name = t.field_name AND length(o.text) > length(t.stem) AND t.stem <> '' AND starts_with(o.text, t.stem) AND o.text <> t.text))
    SELECT group_id, field_name, comment_id, value FROM (SELECT *, row_number() OVER (PARTITION BY group_id, field_name ORDER BY comment_id IN (SELECT comment_id FROM dropped), updated_at DESC NULLS LAST, comment_id) AS k FROM u) WHERE k = 1"""

_KEYED = (
    "x AS (SELECT record_id, " + _bare("screen_task_id") + " AS scope, observed_issue, list_filter(string_split(regexp_replace(observed_issue, '([|;/,\\n\\r•·])([\\s\\pZ\\pP]*\\pL{2,20}[\\s\\pZ]*:)', chr(1) || '\\2', 'g'), chr(1)), lambda p: regexp_matches(p, '[\\pL\\pN]')) AS parts FROM human_comments),"
    " y AS (SELECT record_id, scope, CASE WHEN len(parts) >= 2 AND list_bool_and(list_transform(parts, lambda p: regexp_matches(p, '^[\\s\\pZ\\pP|]*\\pL{2,20}[\\s\\pZ]*:'))) THEN array_to_string(list_sort(list_transform(parts, lambda p: " + _bare("p") + ")), '|') ELSE " + _bare("observed_issue") + " END AS key FROM x),"
    " g AS (SELECT record_id, min(record_id) OVER (PARTITION BY scope, key) AS first_id, count(*) OVER (PARTITION BY scope, key)::BIGINT AS copies FROM y WHERE scope <> '' AND key <> '')"
)

SQL = {
    "p2_found": P2_FOUND,
    "p3_top": P3_TOP,
    "p3_found": f"SELECT expert_comment_id, pair_id FROM ({P3_TOP})",
    "p4_survivors": P4_SURVIVORS,
    "p4_found": f"SELECT group_id, field_name, comment_id FROM ({P4_SURVIVORS})",
    "p6_found": f"WITH {_KEYED} SELECT first_id AS record_id_a, record_id AS record_id_b FROM g WHERE record_id <> first_id",
    "p6_counts": f"WITH {_KEYED} SELECT record_id, copies FROM g WHERE record_id = first_id",
}
