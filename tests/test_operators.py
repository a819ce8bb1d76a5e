import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.functions import scalars as S
from assayer.operators import batch as B, dedup, guidelines as G, lookup, matching as M, parser as P, reshape as R, stats as T
from assayer.operators.components import components
from assayer.plans import ratings


def test_components_of_random_graphs_chains_and_stars(spark):
    random.seed(3)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(220)]
    edges += [(1000 + i, 1001 + i) for i in range(400)] + [(5000, 5001 + i) for i in range(300)] + [(9000, 9000), (None, 1)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("how", ["inner", "left"])
def test_lookup_join_with_hot_keys(spark, how, monkeypatch):
    monkeypatch.setattr(lookup, "HOT_ROWS", 10)
    rows = spark.range(1000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 1, None).otherwise((F.col("id") % 50).cast("string")).alias("k"))
    table = rows.where("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    got = lookup.lookup_join(rows, table.where("k <> '5'"), ["k"], "n", 1000, how)
    want = rows.join(table.where("k <> '5'"), "k", how)
    assert sorted(map(tuple, got.select("id", "k", "n", "first").collect()), key=repr) == sorted(map(tuple, want.select("id", "k", "n", "first").collect()), key=repr)


def test_assignment_against_all_permutations():
    rng = np.random.default_rng(1)
    for n, m in [(1, 1), (1, 4), (4, 1), (3, 3), (3, 5), (5, 3), (4, 4)]:
        for _ in range(20):
            w = rng.choice([0, 0.5, 0.85, 1.0], size=(n, m))
            small, large = (w, m) if n <= m else (w.T, n)
            best = max(sum(small[i, c] for i, c in enumerate(p)) for p in itertools.permutations(range(large), len(small)))
            assert abs(M.assignment(w) - best) < 1e-9
    assert M.assignment(np.zeros((0, 3))) == 0


@pytest.mark.parametrize("split", [5, 20_000])
def test_bipartite_pruning_keeps_the_optimum(spark, monkeypatch, split):
    """Whole groups and their connected parts give the same."""
    monkeypatch.setattr(M, "SPLIT_CELLS", split)
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for task in range(12):
        n, m = rng.integers(1, 5), rng.integers(1, 30)
        w = rng.choice([0, 0, 0.5, 0.85, 1.0], size=(n, m))
        rows += [("m", task, f"e{i}", f"l{j:02d}", float(w[i, j])) for i in range(n) for j in range(m)]
        want[task] = M.assignment(w)
    cells = spark.createDataFrame(rows, "model string, task int, expert_comment_id string, llm_comment_id string, weight double")
    got = {r.task: r.matched for r in M.bipartite(cells, ["model", "task"]).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_finalize(spark):
    rows = [("agree", "equivalent", 0.4, "equivalent", 0.8, None), ("manual", "no_match", 0.9, "equivalent", 0.8, "A_broader"), ("surer", "no_match", 0.5, "equivalent", 0.8, None), ("tie", "equivalent", 0.5, "no_match", 0.5, None), ("none", "equivalent", None, "no_match", None, None)]
    df = spark.createDataFrame(rows, "pair_id string, relation_a string, confidence_a double, relation_b string, confidence_b double, manual string")
    got = {r.pair_id: (r.relation, r.confidence, r.decision_source) for r in M.finalize(df).collect()}
    assert got["agree"][0] == "equivalent" and abs(got["agree"][1] - 0.6) < 1e-9
    assert got["manual"] == ("A_broader", 1.0, "manual_override")
    assert got["surer"] == ("equivalent", 0.8, "confidence_fallback") and got["tie"][0] == "no_match" and got["none"][0] == "no_match"


def test_boxes(spark):
    box = lambda *c: dict(zip(S.BOX, c))
    rows = [(1, box(0.0, 0.0, 1.0, 1.0), box(0.0, 0.0, 1.0, 0.5)), (2, box(1.0, 1.0, 0.0, 0.0), box(0.0, 0.0, 1.0, 1.0)), (3, box(0.0, 0.0, 0.0, 1.0), None), (4, None, box(0.0, 0.0, 1.0, 1.0)), (5, box(0.0, 0.0, 1.0, 1.0), box(2.0, 2.0, 3.0, 3.0)), (6, box(None, 0.0, 1.0, 1.0), box(0.0, 0.0, 1.0, 0.1)), (7, box(0.0, 0.0, 1.0, 1.0), box(0.0, 0.0, 1.0, 0.1))]
    kind = "struct<x_min:double,y_min:double,x_max:double,y_max:double>"
    df = spark.createDataFrame(rows, f"id int, a {kind}, b {kind}").select("id", S.box_iou(F.col("a"), F.col("b")).alias("iou"), S.box_status(F.col("a"), F.col("b")).alias("s"))
    assert {r.id: (r.iou, r.s) for r in df.collect()} == {1: (0.5, "same_target"), 2: (1.0, "same_target"), 3: (None, "same_target_missing_bbox"), 4: (None, "manual_missing_bbox"), 5: (0.0, "different_target"), 6: (None, "manual_missing_bbox"), 7: (0.1, "manual_ambiguous_target")}


def test_overlap_components_against_all_pairs(spark):
    random.seed(8)
    rows = []
    for i in range(240):
        x, y, w, h = random.random(), random.random(), random.choice([0.1, 0.2, 0.35]) * random.uniform(0.7, 1.4), random.choice([0.1, 0.3]) * random.uniform(0.7, 1.4)
        rows.append((random.choice("abc"), f"k{i:03d}", None if i % 12 == 0 else (x, y, x + w, y + h)))
    kind = "struct<x_min:double,y_min:double,x_max:double,y_max:double>"
    got = {r.k: r.component for r in dedup.duplicate_components(spark.createDataFrame(rows, f"g string, k string, box {kind}"), "g", "k", "box").collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    def iou(p, q):
        w, h = min(p[2], q[2]) - max(p[0], q[0]), min(p[3], q[3]) - max(p[1], q[1])
        both = max(w, 0) * max(h, 0)
        return both / ((p[2] - p[0]) * (p[3] - p[1]) + (q[2] - q[0]) * (q[3] - q[1]) - both)

    for (g, k, p), (g2, k2, q) in itertools.combinations(rows, 2):
        if g == g2 and ((p is None and q is None) or (p and q and iou(p, q) >= 0.5)):
            a, b = root(k), root(k2)
            parent[max(a, b)] = min(a, b)
    assert got == {k: root(k) for k in parent}


PARSER_CASES = [
    ("Comment 3\nThe expected standard is that numbers carry their unit. In the current design, the total has none. To fix this, add it.\nBounding Box: [0.1, 0.2, 0.3, 0.4]", ("Comment 3", "Human", "numbers carry their unit.", "the total has none.", "add it.\nBounding Box: [0.1, 0.2, 0.3, 0.4]")),
    ("LLM Comment 2: To fix this issue, enlarge. In the current layout, it is small.", ("Comment 2", "LLM", None, "it is small.", "enlarge. In the current layout, it is small.")),
    ("no marker at all", ("Comment 9", "Human", None, "no marker at all", None)),
    ("The standard is to be clear; in the current design it isn't. To fix it: say so", ("Comment 9", "Human", "be clear;", "it isn't.", "say so")),
    ("Comment 4\nhe expected standard is calm", ("Comment 4", "Human", "calm", None, None)),
]


def test_parser(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(PARSER_CASES)] + [(99, None), (98, "BoundingBox [1, 2, 3] x"), (97, "Bounding Box: [.1,.2,.3,.4,.5]")], "id int, t string")
    rows = {r.id: r.p for r in P.parse_comments(df, "t", F.lit(9), "p").collect()}
    for i, (_, (label, source, expected, issue, fix)) in enumerate(PARSER_CASES):
        p = rows[i]
        want_fix = None if fix is None else fix.split("\nBounding")[0]
        assert (p.comment_label, p.comment_source, p.expected_standard, p.observed_issue, p.suggested_fix) == (label, source, expected, issue, want_fix), i
    assert tuple(rows[0].bounding_box) == (0.1, 0.2, 0.3, 0.4) and rows[98].bounding_box is None and tuple(rows[97].bounding_box) == (0.1, 0.2, 0.3, 0.4)
    assert rows[99].observed_issue is None and rows[99].raw_text == "" and rows[98].observed_issue == "x"


def test_patch_may_set_null(spark):
    c = spark.createDataFrame([("a", "s", "i", "f"), ("b", "s", None, "f")], "id string, expected_standard string, observed_issue string, suggested_fix string")
    fixes = spark.createDataFrame([("a", "suggested_fix", None), ("b", "observed_issue", "new")], "id string, field string, value string")
    got = {r.id: tuple(r) for r in P.patch(c, fixes, ["id"]).collect()}
    assert got == {"a": ("a", "s", "i", None), "b": ("b", "s", "new", "f")}


STANDARD = {
    "Nielsen Norman 10 Heuristics: Heuristic 4 (Consistency and standards) labels differ": [("Nielsen", "Consistency and Standards", None, "labels differ")],
    "Nielsen - Visibility of System Status; NN/g: error prevention — no undo": [("Nielsen", "Visibility of System Status", None, None), ("Nielsen", "Error Prevention", None, "no undo")],
    "Nielsen: Heuristic 1 (Feedback), Heuristic 5 (Prevent errors)": [("Nielsen", "Visibility of System Status", None, None), ("Nielsen", "Error Prevention", None, None)],
    "Nielsen: feedback; it is slow; error recovery": [("Nielsen", "Visibility of System Status", None, "it is slow"), ("Nielsen", _RECOVER := "Help Users Recognize, Diagnose, and Recover from Errors", None, None)],
    "Nielsen: nothing known": [("Nielsen", "nothing known", None, None)],
    "Apple HIG: Components > Buttons > too small": [("Apple HIG", "Components", "Menus and Actions / Buttons", "Components; too small")],
    "apple human interface guidelines (HIG) — Layout": [("Apple HIG", "Foundations", "Layout", None)],
    "Apple HIG / Patterns / something": [("Apple HIG", "Patterns", None, "something")],
    "Apple HIG: Navigation": [("Apple HIG", "Components", "Navigation and Search", None)],
    "Apple HIG: touch targets": [("Apple HIG", "Foundations", "Layout", None)],
    "Apple HIG: unheard of > here": [("Apple HIG", "unheard of", None, "here")],
    "CrowCrit: Layout - crowded | CrowdCrit: Balance > left heavy": [("CrowdCrit", "Layout - crowded", None, None), ("CrowdCrit", "Balance", None, "left heavy")],
    "CrowdCrit Visual Design: Clutter. Typography too thin": [("CrowdCrit", "Clutter", None, None), ("CrowdCrit", "Typography too thin", None, None)],
    '[{"source": "Nielsen", "category": "Error recovery", "evidence": "no way back"}, {"source": "NN Group", "category": "x"}]': [("Nielsen", _RECOVER, None, "no way back"), ("NN Group", None, None, None)],
    "[{'source': 'apple hig', 'category': 'Color', 'evidence': None}, 'plain text']": [("Apple HIG", "Foundations", "Color", None), (None, None, None, None)],
    '{"source": "CrowdCrit", "category": "Contrast: low"}': [("CrowdCrit", "Contrast", None, "low")],
    "[not a list Nielsen: feedback": [("Nielsen", "Visibility of System Status", None, None)],
    "no source at all": [], "": [], " ; ": [],
}


def test_guidelines_of_the_three_sources(spark):
    df = spark.createDataFrame([*enumerate(STANDARD), (900, None)], "id long, t string")
    got: dict = {}
    for r in sorted(G.parse_references(df, "t", "id", G.standard_sources()).collect(), key=lambda r: (r.id, r.mention, r.piece)):
        got.setdefault(r.id, []).append((r.source, r.category, r.subcategory, r.evidence))
    for i, (text, want) in enumerate(STANDARD.items()):
        assert got.get(i, []) == want, text
    assert 900 not in got and len(G.HEURISTICS) == 10
    assert G.parse_references(df.limit(0), "t", "id", G.standard_sources()).count() == 0


def test_keys_keep_their_first_place_and_take_the_last_value():
    rows = G.Source("s", "tree", ("s",), {"Ab c": ("x", "1"), "de f": ("x", "2"), "ab  C": ("y", "3")}).vocabulary()
    assert [(r["key"], r["category"], r["subcategory"]) for r in rows] == [("ab c", "y", "3"), ("de f", "x", "2")]


def test_statistics(spark):
    d = [1.0, -2.0, 3.0, 0.0, 2.0, 2.0, -1.0, 5.0]
    row = T.wilcoxon(spark.createDataFrame([("k", x) for x in d], "k string, d double"), ["k"], "d").first()
    some = [x for x in d if x]
    order = sorted(map(abs, some))
    rank = {v: sum(i + 1 for i, y in enumerate(order) if y == v) / order.count(v) for v in order}
    plus = sum(rank[abs(x)] for x in some if x > 0)
    assert row.n == 7 and row.w == min(plus, 28 - plus) and row.ties == (2**3 - 2) + (3**3 - 3) and row.median == 1.5
    zeros = spark.createDataFrame([("k", 0.0)], "k string, d double")
    assert T.wilcoxon(zeros, ["k"], "d").count() == 0
    same = T.cohen_kappa(spark.createDataFrame([("k", "y", "y")] * 3, "k string, a string, b string"), ["k"], "a", "b").first()
    assert same.agreement == 1 and same.kappa is None
    k = T.cohen_kappa(spark.createDataFrame([("k", a, b) for a, b in ["yy"] * 20 + ["yn"] * 5 + ["ny"] * 10 + ["nn"] * 15], "k string, a string, b string"), ["k"], "a", "b").first()
    assert abs(k.kappa - 0.4) < 1e-9
    assert abs(T.chance(2, "linear") - 0.5) < 1e-12 and abs(T.chance(5, "ordinal") - sum(1 - (abs(i - j) + 1) * abs(i - j) / 20 for i in range(5) for j in range(5)) / 25) < 1e-12
    ratings = [[9, 2, 5, 8], [6, 1, 3, 2], [8, 4, 6, 8], [7, 1, 2, 6], [10, 5, 6, 9], [6, 2, 4, 7]]
    df = spark.createDataFrame([(i, j, float(x)) for i, row in enumerate(ratings) for j, x in enumerate(row)], "s int, r int, x double")
    assert abs(T.icc(df, "s", "r", "x").first().icc - 0.2897638) < 1e-6
    assert abs(T.t_quantile(0.975, 10) - 2.2281389) < 1e-6
    w, p = T.shapiro([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])
    assert abs(w - 0.79) < 0.01 and abs(p - 0.0067) < 0.002
    boot = T.bootstrap_mean(spark.createDataFrame([("k", f"c{i % 5}", float(i % 7)) for i in range(70)], "k string, c string, v double"), ["k"], "c", "v").first()
    assert boot.low <= boot["mean"] <= boot.high


def test_batch(spark):
    lines = spark.createDataFrame([(i, "x" * (i % 40)) for i in range(200)] + [(999, "y" * 500)], "id int, line string")
    packed = B.pack_lines(lines, "id", "line", 120, 3).collect()
    files = {}
    for r in packed:
        files.setdefault((r.stream, r.file), []).append(r.bytes)
    assert len(packed) == 201 and all(sum(v) <= 120 or len(v) == 1 for v in files.values())
    schema = {"relation": ["yes", "no"], "confidence": None}
    record = lambda content, status=200, error="null": '{"response":{"status_code":%d,"body":{"choices":[{"message":{"content":%s}}]}},"error":%s}' % (status, content, error)
    rows = [(1, record('"{\\"relation\\":\\"yes\\",\\"confidence\\":1}"')), (2, record('"x"', 429)), (3, record('"x"', 200, '{"a":1}')), (4, record('""')), (5, record('"[1]"')), (6, record('"{\\"relation\\":\\"yes\\"}"')), (7, record('"{\\"relation\\":\\"maybe\\"}"')), (8, '{"key":"a","response":{"candidates":[{"content":{"parts":[{"text":"{\\"relation\\":\\"no\\",\\"confidence\\":0}"}]}}]}}')]
    got = {r.id: r.e for r in spark.createDataFrame(rows, "id int, r string").select("id", B.answer_error(F.col("r"), schema).alias("e")).collect()}
    assert got == {1: None, 2: "http status 429", 3: "provider error", 4: "missing content", 5: "invalid json", 6: "missing confidence", 7: "invalid relation", 8: None}
    table = spark.createDataFrame([("a", 1, None), ("b", 2, "old")], "k string, x int, y string")
    new = spark.createDataFrame([("b", "new"), ("c", "lost"), ("a", None)], "k string, y string")
    assert sorted(map(tuple, B.upsert(table, new, ["k"], ["y"]).collect())) == [("a", 1, None), ("b", 2, "new")]


def test_reshape(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), (None, 1, "z"), (None, 5, "w")], "k string, o int, v string")
    back = R.unnest(R.nest(df, ["k"], ["v"], ["o"], "vs"), "vs", ["k"]).collect()
    assert sorted(map(tuple, back), key=repr) == sorted([("a", 1, "y"), ("a", 2, "x"), (None, 1, "z"), (None, 2, "w")], key=repr)
    with pytest.raises(ValueError):
        R.assert_unique(df, ["k"])
    late = R.latest_per_key(spark.createDataFrame([("p", None, 9), ("p", 1, 2), ("p", 1, 3), (None, 5, 5)], "k string, at int, v int"), "k", "at", ["v"]).collect()
    assert [tuple(r) for r in late] == [("p", 3)]
    pooled = R.pool_rare(spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "c string"), "c", 2).collect()
    assert sorted((r.c for r in pooled), key=repr) == ["Other", "a", "a", None] or sorted(map(repr, (r.c for r in pooled))) == sorted(map(repr, ["Other", "a", "a", None]))


def test_scalars(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first().x
    assert get(S.normalize_text(F.lit("  “Ünder\u00a0 Test”! "))) == "ünder test" and get(S.normalize_text(F.lit(" .. "))) is None
    assert get(S.normalize_key(F.lit(" Color & Contrast (HIG). "))) == "color and contrast hig"
    assert get(S.clean_reference(F.lit("— Layout ; "))) == "Layout"
    assert get(S.numbered("T", F.lit(7), 2)) == "T07" and get(S.numbered("T", F.lit(1234), 2)) == "T1234"
    assert get(S.json_object_in(F.lit('```json\n{"a": {"b": 1}}\n``` bye'))) == '{"a": {"b": 1}}' and get(S.json_object_in(F.lit("{oops"))) is None
    assert get(S.literal_list(F.lit("['it\\'s', \"b\"]"))) == ["it's", "b"]
    assert [get(S.binned(F.lit(x), 10)) for x in (0, 3, 4, 7, 8, 10, 11)] == ["low", "low", "mid", "mid", "high", "high", None]
    assert [get(S.binned(F.lit(x), 5)) for x in (2, 3, 4, 5)] == ["low", "mid", "mid", "high"]


def test_flags_pairs_and_lists(spark):
    kinds = "pair_id string, relation string, decision_source string, relation_a string, relation_b string, logical_conflict_a string, logical_conflict_b string"
    rows = [("same", "no_match", "judge_agreement", "no_match", "no_match", "no", "no"), ("left", "no_match", "confidence_fallback", "no_match", "contradiction", "no", "yes"), ("neither", "equivalent", "confidence_fallback", "no_match", "contradiction", "no", "yes"), ("manual", "contradiction", "manual_override", "no_match", "contradiction", "no", "yes")]
    final = M.finalize_flags(spark.createDataFrame(rows, kinds), ["logical_conflict"])
    assert {r.pair_id: r.logical_conflict for r in final.collect()} == {"same": "no", "left": "no", "neither": "disagree", "manual": "yes"}
    assert M.flag_consistency(final, ["logical_conflict"]).first().share == 0.75
    experts = spark.createDataFrame([("t", "e1"), ("t", "e2"), ("u", "e3")], "screen_task_id string, expert_comment_id string")
    models = spark.createDataFrame([("m", "t", "L_001"), ("m", "t", "L_002")], "model_short string, screen_task_id string, llm_comment_id string")
    for block in (1, 1000):
        assert sorted(r.pair_id for r in M.comment_pairs(experts, models, block=block).collect()) == ["m_e1_001", "m_e1_002", "m_e2_001", "m_e2_002"]
    with pytest.raises(ValueError):
        R.exclude(experts, "expert_comment_id", ["e1", "e9"])
    assert R.exclude(experts, "expert_comment_id", ["e1"]).count() == 2


def test_manova_and_gap(spark):
    rng = np.random.default_rng(2)
    rows = [(g, float(rng.normal(m)), float(rng.normal(-m))) for g, m in (("a", 0), ("b", 2)) for _ in range(50)]
    row = T.manova(spark.createDataFrame(rows + [("a", None, 1.0), (None, 1.0, 1.0)], "g string, x double, y double"), "g", ["x", "y"]).first()
    x = np.array([r[1:] for r in rows])
    parts = [x[:50], x[50:]]
    within = sum((p - p.mean(0)).T @ (p - p.mean(0)) for p in parts)
    total = (x - x.mean(0)).T @ (x - x.mean(0))
    assert row.n == 100 and abs(row.wilks - np.linalg.det(within) / np.linalg.det(total)) < 1e-9 and abs(row.pillai - np.trace((total - within) @ np.linalg.inv(total))) < 1e-9
    gaps = T.bootstrap_gap(spark.createDataFrame([("k", f"c{i % 9}", i % 2 == 0, float(i % 2 == 0)) for i in range(90)], "k string, c string, s boolean, v double"), ["k"], "c", "s", "v").first()
    assert gaps.gap == gaps.low == gaps.high == 1.0


@pytest.mark.parametrize("block", [7, 1000])
def test_similar_pairs_are_all_pairs_of_a_group(spark, block):
    rng = np.random.default_rng(5)
    rows = [(i, i % 2, [float(x) for x in rng.normal(size=6)]) for i in range(60)]
    unit = {i: np.array(v) / np.linalg.norm(v) for i, _, v in rows}
    want = {(a, b): unit[a] @ unit[b] for a, b in itertools.combinations(range(60), 2) if a % 2 == b % 2 and unit[a] @ unit[b] >= 0.4}
    odd = [(90, 0, None), (91, 0, [0.0] * 6), (92, None, rows[0][2]), (93, 0, [1.0]), (94, 0, [None] * 6), (95, 0, [float("nan")] * 6), (96, 0, [])]
    df = spark.createDataFrame(rows + odd, "id long, g int, v array<float>")
    got = M.similar_pairs(df, "id", "g", "v", block=block).collect()
    assert any(b - a > 2 for a, b in want) and {(r.left_id, r.right_id) for r in got} == set(want) and len(got) == len(want)
    assert all(abs(r.cosine - want[r.left_id, r.right_id]) < 1e-5 for r in got)
    assert M.similar_pairs(df.limit(0), "id", "g", "v").count() == 0


def test_normality_of_many_values_takes_all_of_them(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = np.concatenate([np.round(rng.normal(size=7000) * 2), np.arange(8, 60), [-40.0, 90.0]])
    few = np.round(rng.normal(size=300) * 2)
    rows = [("m", "many", float(v)) for v in x] + [("m", "few", float(v)) for v in few] + [("m", "same", 1.0)] * 6000
    monkeypatch.setattr(ratings, "rating_long", lambda t: spark.createDataFrame(rows, "model string, aspect string, delta double"))
    got = {r.aspect: r for r in ratings.normality(None).collect()}
    assert abs(got["many"].w - T.shapiro(x)[0]) < 1e-9 and got["many"].p is None
    w, p = T.shapiro(few)
    assert abs(got["few"].w - w) < 1e-12 and abs(got["few"].p - p) < 1e-12
    assert got["same"].p is None and (got["same"].w is None or np.isnan(got["same"].w))
    p = np.concatenate([[1e-12, 1e-7, 0.3, 0.5, 0.999], rng.random(200)])
    assert np.allclose(T._normal_quantiles(p), [T._normal_quantile(v) for v in p], rtol=1e-12, atol=1e-14)


def test_every_pair_with_two_valid_votes_is_finalised(spark, folder):
    from assayer.plans import agreement

    class Without(agreement.Tables):
        def __call__(self, name, *columns):
            df = super().__call__(name, *columns)
            return df.where("judge_id NOT IN ('j01', 'j09')") if name == "judge_votes" else df

    t = Without(spark, folder)
    valid = agreement.votes(t).where("relation IS NOT NULL").groupBy("pair_id").agg(F.count("*").alias("n")).where("n > 1")
    want = {r.pair_id: r.n * (r.n - 1) // 2 for r in valid.join(t("match_pairs", "pair_id").distinct(), "pair_id").collect()}
    for query in (agreement.match_finalize, agreement.flag_finalize):
        got = {r.pair_id: r["count"] for r in query(t).groupBy("pair_id").count().collect()}
        assert want and got == want


@pytest.mark.parametrize("block", [3, 1000])
def test_pairs_of_large_tasks_in_blocks(spark, block):
    experts = [("t", f"e{i}") for i in range(205)] + [("u", "e900"), (None, "e901"), ("w", "e902")]
    models = [("m", "t", f"L_{i:03d}") for i in range(20)] + [("m", "t", "L_1005"), ("k", "u", "L_001"), ("k", None, "L_002"), ("k", "v", "L_003")]
    df = M.comment_pairs(spark.createDataFrame(experts, "screen_task_id string, expert_comment_id string"), spark.createDataFrame(models, "model_short string, screen_task_id string, llm_comment_id string"), block=block)
    got = [r.pair_id for r in df.collect()]
    want = {f"{m}_{e}_{c.split('_')[1]}" for t, e in experts for m, u, c in models if t == u and t}
    assert len(got) == len(want) == 205 * 21 + 1 and set(got) == want


def test_pairs_come_in_order(spark):
    """In such an order that written pairs take little room: the experts of a block, sorted, for one model comment after the other."""
    experts = spark.createDataFrame([("t", f"e{i * 7 % 40:02d}") for i in range(40)], "screen_task_id string, expert_comment_id string")
    models = spark.createDataFrame([("m", "t", f"L_{i:03d}") for i in range(30)], "model_short string, screen_task_id string, llm_comment_id string")
    runs = [(k, [r.expert_comment_id for r in rows]) for k, rows in itertools.groupby(M.comment_pairs(experts, models).collect(), lambda r: r.llm_comment_id)]
    assert len(runs) == 30 and all(es == [f"e{i:02d}" for i in range(40)] for _, es in runs)


def test_pairs_of_large_tasks_come_in_order(spark):
    """Blocks hold comments that follow each other by id, so one model comment after the other meets whole stretches of experts; every pair comes once, with all columns."""
    experts = spark.createDataFrame([("t", f"e{i * 7 % 400:03d}", i) for i in range(400)], "screen_task_id string, expert_comment_id string, seen int").repartition(5)
    models = spark.createDataFrame([("m", "t", f"L_{i * 7 % 300:03d}", {"n": i}) for i in range(300)], "model_short string, screen_task_id string, llm_comment_id string, tags map<string, int>").repartition(5)
    rows = M.comment_pairs(experts, models, block=100).collect()
    assert len(rows) == len({(r.expert_comment_id, r.llm_comment_id) for r in rows}) == 400 * 300
    assert all(r.pair_id == f"m_{r.expert_comment_id}_{r.llm_comment_id[2:]}" and r.seen * 7 % 400 == int(r.expert_comment_id[1:]) and r.tags["n"] * 7 % 300 == int(r.llm_comment_id[2:]) for r in rows)
    follows = [int(b.expert_comment_id[1:]) - int(a.expert_comment_id[1:]) == 1 for a, b in itertools.pairwise(rows) if a.llm_comment_id == b.llm_comment_id]
    assert all(follows) and len(follows) > 0.9 * len(rows)


def test_pairs_of_one_sided_tasks_and_nulls(spark):
    experts = spark.createDataFrame([("t", "e1"), ("t", None), *[("x", f"e{i}") for i in range(10, 20)]], "screen_task_id string, expert_comment_id string")
    models = spark.createDataFrame([("m", "t", "L_001"), (None, "t", "L_002"), *[("m", "y", f"L_{i}") for i in range(10, 20)]], "model_short string, screen_task_id string, llm_comment_id string")
    got = M.comment_pairs(experts, models, block=3).select("pair_id", "model_short", "expert_comment_id", "llm_comment_id").collect()
    assert {tuple(r) for r in got} == {("m_e1_001", "m", "e1", "L_001"), (None, None, "e1", "L_002"), (None, "m", None, "L_001"), (None, None, None, "L_002")} and len(got) == 4


def test_choices_are_checked(spark):
    rows = spark.createDataFrame([(k,) for k in "abcdef"], "id string")
    review = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c"), ("d", "c")], "id string, component string")
    pick = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id string")
    assert sorted(r.id for r in dedup.apply_choices(rows, review, "id", pick("b", "c")).collect()) == ["b", "c", "e", "f"]
    for wrong in (("b",), ("b", "e"), ("a", "b")):
        with pytest.raises(ValueError):
            dedup.apply_choices(rows, review, "id", pick(*wrong))


def test_unrelated_comments_in_other_scripts_are_no_duplicates(spark):
    """Texts without a Latin letter once had one empty key."""
    from assayer.plans import agreement

    rows = [(1, "c1", "t", "L", None, "Кнопка не видна", None, None), (2, "c2", "t", "L", None, "色が薄い", None, None), (3, "c3", "t", "L", None, "色が薄い。", None, None), (4, "c4", "t", "L", None, "...", None, None), (5, "c5", "t", "L", None, "???", None, None)]
    df = spark.createDataFrame(rows, "record_id long, comment_id string, screen_task_id string, comment_label string, expected_standard string, observed_issue string, suggested_fix string, bounding_box struct<x_min: double, y_min: double, x_max: double, y_max: double>")
    got = {(r.comment_id, r.component) for r in agreement.exact_dup_components(lambda name, *columns: df.select(*columns)).collect()}
    assert got == {("c2", "c2"), ("c3", "c2")}


def test_mean_of_one_confidence_and_manual_review(spark):
    rows = [(1, "equivalent", 0.8, "equivalent", None, None), (2, "equivalent", None, "equivalent", None, None), (3, "no_match", 0.5, "equivalent", 0.9, None), (4, "no_match", 0.5, "equivalent", 0.9, "contradiction")]
    df = spark.createDataFrame(rows, "id int, relation_a string, confidence_a double, relation_b string, confidence_b double, manual string")
    got = {r.id: (r.relation, r.confidence, r.decision_source) for r in M.finalize(df, fallback=False).collect()}
    assert got == {1: ("equivalent", 0.8, "judge_agreement"), 2: ("equivalent", None, "judge_agreement"), 3: (None, None, "manual_review"), 4: ("contradiction", 1.0, "manual_override")}
    with pytest.raises(ValueError):
        M.valid_manual(df.withColumn("manual", F.lit("other")))


def test_boxes_against_all_pairs(spark):
    """Edges of boxes that overlap, found in cells, connect what comparing all pairs connects, at both thresholds."""
    import numpy as np

    rng = np.random.default_rng(8)
    boxes = [(f"k{i:03d}", "g" if i % 3 else "h", tuple(float(v) for v in (x, y, x + w, y + h))) for i, (x, y, w, h) in enumerate(zip(rng.random(120), rng.random(120), rng.random(120) ** 3 + 0.01, rng.random(120) ** 3 + 0.01))]
    df = spark.createDataFrame(boxes, "k string, g string, b struct<x_min: double, y_min: double, x_max: double, y_max: double>")

    def iou(p, q):
        w, h = max(0, min(p[2], q[2]) - max(p[0], q[0])), max(0, min(p[3], q[3]) - max(p[1], q[1]))
        return w * h / ((p[2] - p[0]) * (p[3] - p[1]) + (q[2] - q[0]) * (q[3] - q[1]) - w * h)

    for least in (0.5, 0.1):
        want = {(a[0], b[0]) for a in boxes for b in boxes if a[0] < b[0] and a[1] == b[1] and iou(a[2], b[2]) >= least}
        assert {tuple(r) for r in dedup.overlap_edges(df, "g", "k", "b", least).collect()} == want


def test_rating_prompts_with_examples(spark):
    from assayer.operators import prompts

    df = spark.createDataFrame([("Find {it}", "usability_rating"), (None, "usability_rating")], "task string, aspect string")
    examples = [{"task": f"e{i}", "learnability": i, "efficiency": i, "usability_rating": 2 * i} for i in (1, 2, 3)]
    text, none = (r[0] for r in df.select(prompts.rating_prompt(F.col("task"), F.col("aspect"), "G", examples)).collect())
    assert none is None and text.count("Screen Task: ") == 4 and "Image 2 — mid rating\nScreen Task: e2\nExpert Learnability: 2, Efficiency: 2, Usability Rating: 4\n" in text
    assert text.endswith('Screen Task: Find {it}\n' + prompts.RETURN_LINE + '{"learnability": <number>, "efficiency": <number>, "usability_rating": <number>}')
    with pytest.raises(ValueError):
        prompts.rating_prompt(F.col("task"), F.col("aspect"), "G", examples[:2])
    with pytest.raises(Exception, match="unknown aspect"):
        df.select(prompts.rating_prompt(F.col("task"), F.lit("speed"), "G")).collect()


def test_duplicate_prompt_and_its_answers(spark):
    from assayer.operators import prompts

    box = "struct<x_min: double, y_min: double, x_max: double, y_max: double>"
    df = spark.createDataFrame([("t", "a", (0.0, 0.0, 1.0, 1.0), None, (0.0, 0.0, 1.0, 0.5)), (None, "a", None, "b", None)], f"task string, l string, lb {box}, r string, rb {box}")
    review = prompts.DUPLICATE_REVIEW
    one, two = (r[0] for r in df.select(review.prompt(F.col("task"), F.col("l"), F.col("lb"), F.col("r"), F.col("rb"))).collect())
    assert "Task: t\nComment A: a\nComment A bounding box: [0.000, 0.000, 1.000, 1.000]\nComment B: \nComment B bounding box: [0.000, 0.000, 1.000, 0.500]\nBBox IoU between annotated regions: 0.500\n" in one
    assert "Task: \n" in two and two.count("unavailable") == 3
    assert review.required()["recommended_action"] == ["keep_A", "keep_B", "keep_both", "manual_review"] and review.required()["reasoning"] is None


def test_exact_and_normal_p(spark):
    """Known values: W = 3 of six differences has p = 0.15625; F and t tails from tables."""
    d = [1.0, -2.0, 3.0, 4.0, 5.0, 6.0]
    out = T.wilcoxon(spark.createDataFrame([("k", x) for x in d], "k string, d double"), ["k"], "d")
    row = out.withColumn("p", T.wilcoxon_p(F.col("w"), F.col("n"), F.col("ties"), F.col("zeros"), F.col("z"))).first()
    assert row.w == 2.0 and abs(row.p - 6 / 64) < 1e-12
    assert abs(T.t_tail(2.228139, 10) - 0.05) < 1e-6 and abs(T.f_tail(4.102821, 2, 10) - 0.05) < 1e-6 and abs(T.t_quantile(0.975, 10) - 2.228139) < 1e-5


def test_icc_forms(spark):
    """Two raters of a published example's kind, worked out by mean squares."""
    import numpy as np

    x = np.array([[9, 2], [6, 1], [8, 4], [7, 1], [10, 5], [6, 2]], dtype=float)
    rows = [(str(i), r, float(v)) for i, pair in enumerate(x) for r, v in zip("ab", pair)]
    got = T.icc_pairs(spark.createDataFrame(rows, "s string, r string, v double"), "s", "r", "v").first()
    n, k = x.shape
    ms_r = k * ((x.mean(1) - x.mean()) ** 2).sum() / (n - 1)
    ms_c = n * ((x.mean(0) - x.mean()) ** 2).sum() / (k - 1)
    ms_e = ((x - x.mean(1, keepdims=True) - x.mean(0) + x.mean()) ** 2).sum() / ((n - 1) * (k - 1))
    ms_w = ((x - x.mean(1, keepdims=True)) ** 2).sum() / (n * (k - 1))
    want = {"icc1": (ms_r - ms_w) / (ms_r + ms_w), "icc2": (ms_r - ms_e) / (ms_r + ms_e + 2 * (ms_c - ms_e) / n), "icc3": (ms_r - ms_e) / (ms_r + ms_e), "icc1k": (ms_r - ms_w) / ms_r, "icc2k": (ms_r - ms_e) / (ms_r + (ms_c - ms_e) / n), "icc3k": (ms_r - ms_e) / ms_r}
    assert all(abs(got[name] - v) < 1e-9 for name, v in want.items())


def test_lists_that_only_python_reads(spark):
    from assayer.functions import scalars

    texts = {"['a', \"b\"]": ["a", "b"], "['a', None]": ["a", None], "('x', 'y')": ["x", "y"], "['it' 's']": ["its"], "no list": None, "[": None, "[]": []}
    df = spark.createDataFrame([*enumerate(texts), (90, None)], "id int, t string").withColumn("v", scalars.any_literal_list(F.col("t")))
    assert {r.id: r.v for r in df.collect()} == dict(enumerate(texts.values())) | {90: None}
