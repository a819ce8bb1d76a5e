from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from assayer.functions import scalars as S
from assayer.operators import matching as M, reshape as R, stats as T
from assayer.operators.matching import assignment

weights = st.lists(st.lists(st.sampled_from([0.0, 0.5, 0.85, 1.0]), min_size=3, max_size=3), min_size=1, max_size=5)


@settings(max_examples=200, deadline=None)
@given(weights)
def test_assignment_is_symmetric_and_bounded(w):
    transposed = [list(c) for c in zip(*w)]
    assert abs(assignment(w) - assignment(transposed)) < 1e-9
    assert max(map(max, w)) - 1e-9 <= assignment(w) <= min(sum(map(max, w)), sum(map(max, transposed))) + 1e-9


def test_matching_identities(spark, folder):
    """support * models = coverage * experts = matched sum; unconstrained is at least bipartite; more model comments never lower coverage."""
    from assayer.plans.agreement import labels
    from assayer.plans.registry import Tables

    keys = ["model_short", "screen_task_id"]
    cells = M.cell_matrix(labels(Tables(spark, folder)), keys)
    both = M.bipartite(cells, keys).alias("b").join(M.unconstrained(cells, keys).alias("u"), keys)
    bad = both.where(
        (F.abs(F.col("b.coverage") * F.col("n_expert") - F.col("matched")) > 1e-9) | (F.abs(F.col("b.support") * F.col("n_llm") - F.col("matched")) > 1e-9) | (F.col("u.coverage") < F.col("b.coverage") - 1e-9) | (F.col("u.support") < F.col("b.support") - 1e-9)
    )
    assert both.count() > 10 and bad.count() == 0
    from assayer.plans import catalogue

    k = {}
    for r in catalogue.queries()["fixed_k"](spark, folder).collect():
        k.setdefault(r.model_short, {})[r.k] = r.coverage
    assert all(v[1] <= v[3] + 1e-9 and v[3] <= v[5] + 1e-9 for v in k.values())


def test_iou_is_symmetric_and_between_0_and_1(spark):
    a = spark.range(400).select(*(F.struct(*((F.rand(s + i) * 2 - 0.5).alias(n) for i, n in enumerate(S.BOX))).alias(c) for s, c in ((1, "a"), (9, "b"))))
    x, y = S.box_iou(F.col("a"), F.col("b")), S.box_iou(F.col("b"), F.col("a"))
    assert a.where(~x.eqNullSafe(y) | (x < 0) | (x > 1) | (F.abs(S.box_iou(F.col("a"), F.col("a")) - 1) > 1e-9)).count() == 0


def test_kappa_of_equal_scores_is_one(spark):
    df = spark.range(50).select(F.lit("k").alias("k"), (F.col("id") % 10 + 1).alias("x"))
    for kind in ("linear", "quadratic", "ordinal"):
        assert abs(T.uniform_kappa(df, ["k"], "x", "x", 10, kind).first().kappa - 1) < 1e-12
    assert T.cohen_kappa(df, ["k"], "x", "x").first().kappa == 1


def test_nest_and_unnest_are_inverse(spark):
    df = spark.range(300).select((F.col("id") % 7).alias("k"), F.col("id").alias("o"), F.md5(F.col("id").cast("string")).alias("v"))
    back = R.unnest(R.nest(df, ["k"], ["o", "v"], ["o"], "vs"), "vs", ["k"]).select("k", "o", "v")
    assert back.exceptAll(df).count() == 0 == df.exceptAll(back).count()
