import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.llm import canonical, consensus, ledger, quota, survivor, topn
from assayer.operators import lookup

# ---- 1: canonical values

LABELS = [("t", 1, "Visible State of the System"), ("t", 2, "Contrast"), ("t", 3, "Notice, Name, and Mend Errors"), ("t", 4, "Content / Image Frames"), ("t", 5, "Marlow Interface Guide"), ("u", 6, "Other Tier")]


@pytest.fixture
def labels(spark):
    return spark.createDataFrame(LABELS, "tier string, canon_id int, label string")


TYPED = {
    "contrast": 2, " CONTRAST\t": 2, "cöntrást": 2, "Соntrаst": 2, "contrats": 2, "Contrast, see top row": 2, "Heuristic 4 (Contrast)": 2, "#2 Contrast": 2, "“Contrast”": 2, "contrast issue": 2,
    "visible system state": 1, "Visible  State_of-the System": 1, "VisibleStateOfTheSystem": 1, "Visib. State of the Syst.": 1, "visble sate of the sytem": 1, "Visible State of the System - too weak": 1,
    "notice-name-and-mend-errors": 3, "Notice, Name, Mend Error": 3, "image frames": 4, "Frames Image": 4, "content/image frames": 4, "Marlow": 5, "marlow guide v3": 5,
    "Legal Budget": -1, "???": -1, "n/a": -1, "Other Tier": -1, "x" * 50_000: -1, "see screenshot": -1,
}


def test_canonical_values(spark, labels):
    rows = [(i, t) for i, t in enumerate(TYPED)] + [(900, None), (901, "  "), (902, "Contrast"), (903, " "), (904, "contrats"), (904, "contrats")]
    df = spark.createDataFrame(rows, "id long, t string").withColumn("u", F.lit(None).cast("string")).withColumn("value", F.lit("clash"))
    got = canonical.map_to_reference(df, labels, "id", ["t", "u"]).collect()
    assert sorted((r.id, r.canon_id) for r in got if r.id < 900) == [(i, c) for i, c in enumerate(TYPED.values())]
    assert sorted((r.id, r.canon_id) for r in got if r.id >= 900) == [(904, 2), (904, 2)]
    assert {r.field_name for r in got} == {"t"}


def test_pigeonhole_loses_nothing(spark, labels):
    """Every text within the allowed edits of a label is found, as comparing all pairs finds it."""
    random.seed(5)
    typed = set()
    for _ in range(150):
        s = list(random.choice(["contrast", "visiblestatesystem", "marlowinterfaceguide"]))
        for _ in range(random.randrange(1, 5)):
            i = random.randrange(len(s))
            s[i : i + random.randrange(2)] = random.choice(["", "q", s[i]])
        typed.add("".join(s))
    values = spark.createDataFrame([("t", v) for v in typed], "tier string, value string")
    got = {r.value: r.edits for r in canonical.match_values(values, labels).collect()}
    forms = {"contrast", "visiblestatesystem", "visiblestateofthesystem", "marlowinterfaceguide", "statesystemvisible", "guideinterfacemarlow"}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    for v in typed:
        best = min((d for f in forms if (d := distance(v, f)) <= min(4, int(len(f) / 2.5))), default=None)
        if best is not None:
            assert got[v] <= best, v


def test_canonical_on_empty_tables(spark, labels):
    df = spark.createDataFrame([(1, "contrast")], "id long, t string")
    assert canonical.map_to_reference(df.limit(0), labels, "id", ["t"]).count() == 0
    assert [r.canon_id for r in canonical.map_to_reference(df, labels.limit(0), "id", ["t"]).collect()] == [-1]


# ---- 2: quotas


def test_settle():
    assert quota.settle([5, 3, 2], [0, 0, 0], [10, 10, 10], [0.5, 0.3, 0.2], 10) == [5, 3, 2]
    assert sum(quota.settle([5, 3, 2], [1, 1, 1], [2, 10, 10], [0.5, 0.3, 0.2], 10)) == 10
    assert quota.settle([5, 3, 2], [0, 0, 0], [1, 1, 1], [0.5, 0.3, 0.2], 10) == [1, 1, 1]
    assert quota.settle([8, 5, 5], [5, 5, 5], [9, 9, 9], [0.8, 0.1, 0.1], 10) == [5, 5, 5]
    assert sum(quota.settle([9, 3], [0, 3], [9, 9], [0.9, 0.1], 10)) == 10


def test_sample_meets_quotas_and_is_stable(spark):
    rows = spark.range(3000).select(F.concat(F.lit("p"), "id").alias("u"), F.lit("m").alias("g"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") < 20, "rare").when(F.col("id") % 50 == 1, None).otherwise("b").alias("c"), F.lit(1).alias("share"))
    rows = rows.unionByName(rows)
    targets = spark.createDataFrame([("m", "a", 0.5, 5), ("m", "b", 0.3, 5), ("m", "rare", 0.15, 5), ("m", "Unknown", 0.05, 5), ("m", "nowhere", 0.0, 4)], "g string, c string, share double, floor int")
    args = (rows, targets, "u", "g", "c", "share", "floor", 100)
    report = {r.c: r for r in quota.quota_report(*args).collect()}
    assert report["a"].want == 50 and report["rare"].quota == report["rare"].available == 13 and report["rare"].shortfall == 2
    assert report["nowhere"].shortfall == 4 and sum(r.quota for r in report.values()) == 100
    drawn = [tuple(r) for r in quota.quota_sample(*args).collect()]
    assert sorted(drawn) == sorted(map(tuple, quota.quota_sample(rows.repartition(7), *args[1:]).collect()))
    assert {c: sum(d[1] == c for d in drawn) for c in report} == {c: r.quota for c, r in report.items()}
    assert len({d[2] for d in drawn}) == 100
    assert quota.quota_sample(rows.limit(0), *args[1:]).count() == 0
    assert {r.shortfall for r in quota.quota_report(rows.limit(0), *args[1:]).collect()} == {50, 30, 15, 5, 4}


# ---- 3: top N


def test_top_n_against_sorting(spark, monkeypatch):
    monkeypatch.setattr(lookup, "HOT_ROWS", 50)
    random.seed(2)
    rows = [(random.choice(["hot"] * 5 + [f"g{i}" for i in range(60)]), random.randrange(1, 4), random.choice([0.1, 0.5, 0.5, 0.9]), f"p{i:05d}", "x") for i in range(3000)] + [(None, 1, 0.9, "p", "x")]
    df = spark.createDataFrame(rows, "g string, rank_no int, conf double, id string, rank string")
    got = topn.top_n(df, "g", 3, (F.col("rank_no") * 100 - F.floor(F.col("conf") * 50)).cast("int"), [F.asc("rank_no"), F.desc("conf"), F.asc("id")])
    want = set()
    for g in {r[0] for r in rows if r[0]}:
        want |= {(g, i + 1, r[3]) for i, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], -r[2], r[3]))[:3])}
    assert {(r.g, r["rank"], r.id) for r in got.collect()} == want
    assert topn.top_n(df.limit(0), "g", 3, F.lit(1), [F.asc("id")]).count() == 0


# ---- 4: survivors


def test_usable_values(spark):
    values = ["Drop the second heading.", "Drop the second…", "Drop the sec", "drop the second heading", "n/a", " ", None, "(blank)", "See other comment.", "Drop the second heading.", "Align it [cut]", "x", "Ends - with dash -"]
    df = spark.createDataFrame([("g", "f", f"c{i:02d}", v) for i, v in enumerate(values)] + [("h", "f", "c99", "Drop the sec")], "group_id string, field_name string, comment_id string, value string")
    got = {r.comment_id for r in survivor.usable_values(df).collect()}
    assert got == {"c00", "c03", "c09", "c10", "c12", "c99"}
    assert survivor.usable_values(df.limit(0)).count() == 0


def test_merge_groups_and_precedence(spark):
    rows = [("r1", "a", "b", " keep_A", 1), ("r1", "a", "b", "keep both", 2), ("r2", "b", "c", "KEEP-b", 1), ("r2", "b", "c", "KEEP-b", 1), ("r3", "c", "d", "keep a", 3), ("r4", "e", "f", None, 1)]
    groups, dropped = survivor.merge_groups(spark.createDataFrame(rows, "rid string, l string, r string, act string, at int"), "rid", "at", "l", "r", "act")
    assert {tuple(r) for r in groups.collect()} == {("b", "b"), ("c", "b"), ("d", "b")}
    assert {r.comment_id for r in dropped.collect()} == {"b", "d"}


def test_fusion_finds_accuracies_and_discounts_copies(spark):
    rng = np.random.default_rng(0)
    claims, truth = [], {}
    for i in range(300):
        truth[i] = "t"
        say = lambda p: "t" if rng.random() < p else f"f{rng.integers(4)}"
        bad = say(0.4)
        claims += [(f"i{i}", "good1", say(0.8)), (f"i{i}", "good2", say(0.8)), (f"i{i}", "bad", bad)]
        claims += [(f"i{i}", f"copy{k}", bad if rng.random() < 0.95 else say(0.4)) for k in range(3)]
    df = spark.createDataFrame(claims, "item string, source string, value string")
    best = survivor.posteriors(df).groupBy("item").agg(F.max_by("value", "posterior").alias("v"))
    right = best.where("v = 't'").count() / 300
    assert survivor.posteriors(df.unionByName(df)).count() == df.distinct().count()
    votes = df.groupBy("item", "value").count().groupBy("item").agg(F.max_by("value", "count").alias("v")).where("v = 't'").count() / 300
    assert right > 0.7 and right > votes + 0.1
    assert survivor.posteriors(df.limit(0)).count() == 0


def test_posterior_of_one_item_by_hand(spark):
    """Two sources that never meet another claim: accuracies stay at the mean posterior of their claims."""
    df = spark.createDataFrame([("i", "a", "x"), ("i", "b", "x"), ("i", "c", "y"), ("j", "a", "x"), ("j", "b", "z"), ("j", "c", "z")], "item string, source string, value string")
    got = {(r.item, r.source): r.posterior for r in survivor.posteriors(df, copy_prior=1e-12).collect()}
    acc = {"a": 0.8, "b": 0.8, "c": 0.8}
    for _ in range(60):
        post = {}
        for item, claims in {"i": {"x": "ab", "y": "c"}, "j": {"x": "a", "z": "bc"}}.items():
            e = {v: np.exp(sum(np.log(10 * acc[s] / (1 - acc[s])) for s in who)) for v, who in claims.items()}
            post |= {(item, s): e[v] / sum(e.values()) for v, who in claims.items() for s in who}
        acc = {s: (acc[s] + min(max((post["i", s] + post["j", s]) / 2, 0.05), 0.95)) / 2 for s in acc}
    assert all(abs(got[k] - post[k]) < 0.02 for k in post), (got, post)


def test_many_values_of_few_sources_stay_few_pairs(spark):
    """One group holds all rows: 4,000 values said by two sources."""
    df = spark.range(4000).select(F.lit("i").alias("item"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("source"), F.concat(F.lit("v"), F.col("id").cast("string")).alias("value"))
    assert survivor.posteriors(df).count() == 4000


def test_posterior_decides_between_values_of_one_comment(spark):
    rows = [("g", "f", "c1", "often", 0, "s1"), ("g", "f", "c1", "seldom", 0, "s1"), ("g", "f", "c2", "often", 1, "s2"), ("g", "f", "c3", "often", 1, "s3")]
    df = spark.createDataFrame(rows, "group_id string, field_name string, comment_id string, value string, dropped int, source string")
    values = survivor.with_posteriors(df, "source")
    assert survivor.survivors(values, [F.col("dropped")]).first().value == "often"
    assert survivor.survivors(values).first().comment_id == "c1"
    assert survivor.with_posteriors(df.limit(0), "source").count() == 0


# ---- 5: consensus


def make_votes(rng, items=400):
    skill = {"a": 0.9, "b": 0.85, "c": 0.6, "d": 0.1, "always": None, "u": 0.35, "w": None}
    rows, truth = [], {}
    for i in range(items):
        truth[f"i{i}"] = t = str(rng.integers(1, 6))
        said = {k: t if p is not None and rng.random() < p else str(rng.integers(1, 6)) for k, p in skill.items()}
        said["always"], said["w"] = "3", said["u"] if rng.random() < 0.95 else said["w"]
        rows += [(f"i{i}", k, v) for k, v in said.items() if rng.random() < 0.85]
    return rows, truth


def test_spectral_consensus_beats_majority(spark):
    rows, truth = make_votes(np.random.default_rng(1))
    votes = spark.createDataFrame(rows, "item string, annotator string, label string")
    got = {r.item: r.label for r in consensus.consensus(votes, 3).collect()}
    n = {}
    for i, _, _ in rows:
        n[i] = n.get(i, 0) + 1
    assert set(got) == {i for i, c in n.items() if c >= 3}
    right = sum(truth[i] == v for i, v in got.items()) / len(got)
    majority = {}
    for i in got:
        said = sorted(v for j, _, v in rows if j == i)
        majority[i] = max(set(said), key=lambda v: (said.count(v), -int(v)))
    assert right > 0.9 and right > sum(truth[i] == v for i, v in majority.items()) / len(got) + 0.05
    own = {r.annotator: r for r in consensus.reliability(votes).collect()}
    assert own["a"].skill > own["c"].skill > own["d"].skill and abs(own["always"].skill) < 0.1 and own["u"].dependents == own["w"].dependents == 1


def test_matrix_against_numpy(spark):
    rows, _ = make_votes(np.random.default_rng(2), 60)
    got = {(r.a, r.b): (r.n, r.kappa) for r in consensus.agreement(spark.createDataFrame(rows, "item string, annotator string, label string")).collect()}
    said = {}
    for i, a, v in rows:
        said.setdefault(a, {})[i] = v
    for a, b in itertools.permutations(sorted(said), 2):
        both = said[a].keys() & said[b].keys()
        chance = sum(list(said[a].values()).count(v) / len(said[a]) * list(said[b].values()).count(v) / len(said[b]) for v in "12345")
        agree = sum(said[a][i] == said[b][i] for i in both) / len(both)
        assert got[a, b][0] == len(both) and abs(got[a, b][1] - (agree - chance) / (1 - chance)) < 1e-9


def test_votes_edge_cases(spark):
    rows = [("i", "a", 1, "x"), ("i", "a", 2, None), ("i", "b", 1, "x"), ("i", "b", 1, "x"), ("i", "c", 1, "y"), (None, "c", 1, "y"), ("i", None, 1, "y"), ("j", "a", 1, "x")]
    df = spark.createDataFrame(rows, "item string, who string, at int, label string")
    votes = consensus.latest_votes(df, "item", "who", F.col("label"), "at")
    assert sorted(map(tuple, votes.collect())) == [("i", "b", "x"), ("i", "c", "y"), ("j", "a", "x")]
    assert consensus.consensus(votes).count() == 0 and consensus.consensus(votes, 1).count() == 2
    assert consensus.consensus(votes.limit(0)).count() == 0


# ---- 6: ledger


def test_ledger_in_batches_equals_one_batch(spark, tmp_path):
    texts = ["A b.", "a  B", "“A-b”", "Ａ ｂ!", "Element: x; Problem: y", "problem: Y | ELEMENT: X.", "Element x Problem y", "other", None, " - ", "a bc", "Ab"]
    rows = [(i, s, t) for i, (s, t) in enumerate((s, t) for s in ("1_T01", " 1-t01.", "2_T01", None) for t in texts)]
    df = spark.createDataFrame(rows, "id long, task string, text string").withColumn("key", F.lit("clash"))
    keyed = ledger.keyed(df, "task", "text", "id", 8)
    whole = ledger.fold(ledger.empty_ledger(spark), keyed)
    parts = ledger.empty_ledger(spark)
    for k in range(3):
        batch = ledger.keyed(df.where(F.col("id") % 3 == k), "task", "text", "id", 8)
        parts = ledger.fold(parts, batch)
        ledger.fold_into(spark, str(tmp_path / "l"), batch)
    stored = ledger.current(spark, str(tmp_path / "l"))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect())) == sorted(map(tuple, stored.collect()))
    assert whole.agg(F.sum("copies")).first()[0] == 3 * 10
    pairs = {tuple(r) for r in ledger.copies(keyed, whole, len(rows)).collect()}
    same = {(a, b) for b, a in [(1, 0), (2, 0), (3, 0), (11, 0), (5, 4), (12, 0), (13, 0), (14, 0), (15, 0), (23, 0), (16, 4), (17, 4), (18, 6), (19, 7), (22, 10)]}
    assert {p for p in pairs if p[1] < 24} == same
    assert ledger.copies(keyed.limit(0), whole.limit(0), 0).count() == 0


def test_only_touched_buckets_are_written(spark, tmp_path):
    folder = str(tmp_path / "l")
    rows = spark.createDataFrame([(i, "t", f"text {i % 40}") for i in range(80)], "id long, task string, text string")
    keyed = ledger.keyed(rows, "task", "text", "id", 8)
    ledger.fold_into(spark, folder, keyed.where("record < 70"))
    last = keyed.where("record = 75")
    ledger.fold_into(spark, folder, last)
    bucket = last.first().bucket
    assert {p.name for p in (tmp_path / "l" / "g=1").iterdir() if p.is_dir()} == {f"bucket={bucket}"}
    assert ledger.generations(spark, folder)[bucket] == 1 and ledger.current(spark, folder).agg(F.sum("copies")).first()[0] == 71
    # A generation without its mark was not written to the end and does not count.
    (tmp_path / "l" / "g=1" / "_SUCCESS").unlink()
    assert ledger.current(spark, folder).agg(F.sum("copies")).first()[0] == 70
    assert ledger.current(spark, str(tmp_path / "none")).count() == 0
