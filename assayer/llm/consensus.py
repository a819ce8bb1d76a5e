"""One agreed label per item from annotators who disagree, with a reliability for each annotator and an agreement for each item.

Spectral reliability: the agreement of two annotators on the items both labelled, beyond what their own label frequencies give by chance, is about
the product of their skills, so the skills are the leading eigenvector of that matrix. It is found by power iteration with one sparse join per
step. Each step divides by the overlap-weighted squares of the partners' skills, which corrects for how many items two annotators share and needs
no value for pairs without any, nor for the diagonal. Pairs that agree far more than their skills explain do not judge independently; they are left out of a second
iteration, and share one vote.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.operators.lookup import lookup_join
from assayer.session import cut_lineage, written

#: Steps of the iteration that are worked out at once, the change of a skill that ends it, and the most steps.
STRIDE, SETTLED, MOST_STEPS = 4, 1e-3, 200
#: Between a kind and what it is prefixed to.
MARK = "\x1f"
#: Agreement beyond chance and skills from which two annotators count as dependent.
DEPENDENT = 0.3


def latest_votes(rows: DataFrame, item: str, annotator: str, label: Column, at: str) -> DataFrame:
    """item, annotator, label of each annotator's latest row on an item, where its label is not null.

    Equal times go by the greatest label. Rows with a null item or annotator are left out; a null time is older than any.
    """
    named = rows.select(F.col(f"`{item}`").cast("string").alias("item"), F.col(f"`{annotator}`").cast("string").alias("annotator"), F.col(f"`{at}`").alias("at"), label.cast("string").alias("label"))
    held = named.where("item IS NOT NULL AND annotator IS NOT NULL").groupBy("item", "annotator").agg(F.max(F.struct("at", "label")).alias("b"))
    return held.select("item", "annotator", F.col("b.label").alias("label")).where("label IS NOT NULL")


def agreement(votes: DataFrame) -> DataFrame:
    """a, b (both ways), n, kappa: items both labelled, and agreement beyond chance on them.

    An item has one vote per annotator, so it makes no more pairs than the matrix has cells, and the pairs are counted before they are shuffled.
    """
    left = votes.select("item", F.col("annotator").alias("a"), F.col("label").alias("x"))
    right = votes.select("item", F.col("annotator").alias("b"), F.col("label").alias("y"))
    pairs = left.join(right, "item").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"), F.sum((F.col("x") == F.col("y")).cast("long")).alias("same"))
    counts = votes.groupBy("annotator", "label").agg(F.count("*").alias("n"))
    sums = counts.groupBy("annotator").agg(F.sum("n").alias("whole"))
    share = counts.join(sums, "annotator").select("annotator", "label", (F.col("n") / F.col("whole")).alias("p"))
    chance = (
        pairs.select("a", "b")
        .join(share.select(F.col("annotator").alias("a"), "label", F.col("p").alias("p")), "a")
        .join(share.select(F.col("annotator").alias("b"), "label", F.col("p").alias("q")), ["b", "label"])
        .groupBy("a", "b")
        .agg(F.sum(F.col("p") * F.col("q")).alias("chance"))
    )
    kappa = (F.col("same") / F.col("n") - F.col("chance")) / (1 - F.col("chance"))
    one_way = pairs.join(chance, ["a", "b"], "left").na.fill(0.0, ["chance"]).where("chance < 0.999999").select("a", "b", "n", kappa.alias("kappa"))
    return one_way.unionByName(one_way.select(F.col("b").alias("a"), F.col("a").alias("b"), "n", "kappa"))


def skills(start: DataFrame, matrix: DataFrame) -> DataFrame:
    """annotator, skill: the leading eigenvector of ``matrix``, so scaled that kappa is about the product of two skills.

    ``start`` has annotator and skill. Half of each step's result and half of the last one are taken, which settles its scale. A step needs no sum over
    all annotators, so kinds that share none settle side by side. An annotator without a partner has skill 0. The steps end when no skill changes by more
    than SETTLED in one of them; it is an error if they do not end in MOST_STEPS.
    """
    now = start.select("annotator", "skill")
    for _ in range(0, MOST_STEPS, STRIDE):
        for _ in range(STRIDE):
            met = matrix.join(now.select(F.col("annotator").alias("b"), "skill"), "b")
            found = met.groupBy("a").agg((F.sum(F.col("n") * F.col("kappa") * F.col("skill")) / F.greatest(F.sum(F.col("n") * F.col("skill") * F.col("skill")), F.lit(1e-9))).alias("new"))
            found = found.select(F.col("a").alias("annotator"), F.least(F.greatest("new", F.lit(-2.0)), F.lit(2.0)).alias("new"))
            step = F.when(F.col("new").isNull(), 0.0).otherwise((F.col("skill") + F.col("new")) / 2)
            now = now.join(found, "annotator", "left").select("annotator", step.alias("skill"), F.abs(step - F.col("skill")).alias("change"))
        # A few steps are one small plan.
        now = written(now)
        if (now.agg(F.max("change")).first()[0] or 0.0) <= SETTLED:
            return now.drop("change")
    raise RuntimeError(f"skills did not settle in {MOST_STEPS} steps")


def _joined(votes: DataFrame) -> DataFrame:
    """``votes`` with the kind in front of items and annotators, so all kinds are worked on at once."""
    kind = F.col("kind") if "kind" in votes.columns else F.lit("")
    return votes.select(F.concat(kind, F.lit(MARK), "item").alias("item"), F.concat(kind, F.lit(MARK), "annotator").alias("annotator"), "label")


def _kind(c: str) -> Column:
    return F.substring_index(c, MARK, 1)


def _name(c: str) -> Column:
    return F.expr(f"substring({c}, locate('{MARK}', {c}) + 1)")


def _reliability(votes: DataFrame) -> DataFrame:
    matrix = written(agreement(votes))
    counts = votes.groupBy("annotator", "label").agg(F.count("*").alias("n"))
    # One row per annotator; kinds are a handful.
    own = counts.groupBy("annotator").agg(F.sum("n").alias("n_votes"), (F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n"))).alias("chance"))
    labels = counts.groupBy(_kind("annotator").alias("kind")).agg(F.greatest(F.count_distinct("label"), F.lit(2)).alias("labels"))
    own = written(own.join(labels, _kind("annotator") == F.col("kind")).drop("kind"))
    first = skills(own.select("annotator", F.lit(0.5).alias("skill")), matrix)
    a = first.select(F.col("annotator").alias("a"), F.col("skill").alias("sa"))
    b = first.select(F.col("annotator").alias("b"), F.col("skill").alias("sb"))
    judged = matrix.join(a, "a").join(b, "b").withColumn("tied", F.col("kappa") - F.col("sa") * F.col("sb") > DEPENDENT)
    # With three annotators or fewer there is nothing to tell a tie from skill by.
    partners = judged.groupBy("a").agg(F.count("*").alias("partners"))
    judged = written(judged.join(partners, "a").withColumn("tied", F.col("tied") & (F.col("partners") >= 3)).select("a", "b", "n", "kappa", "tied"))
    final = skills(first, judged.where("NOT tied").drop("tied"))
    ties = judged.where("tied").groupBy(F.col("a").alias("annotator")).agg(F.count("*").alias("dependents"))
    skill = F.least(F.greatest("skill", F.lit(0.0)), F.lit(0.98))
    accuracy = F.least(skill + (1 - skill) * F.least("chance", 1.0 / F.col("labels")), F.lit(0.99))
    whole = own.join(final, "annotator").join(ties, "annotator", "left").na.fill(0, ["dependents"]).withColumn("accuracy", accuracy)
    odds = F.log(F.col("accuracy") * (F.col("labels") - 1) / (1 - F.col("accuracy")))
    return whole.select("annotator", "n_votes", "skill", "accuracy", "dependents", (F.greatest(odds, F.lit(0.0)) / (1 + F.col("dependents"))).alias("weight"))


def reliability(votes: DataFrame) -> DataFrame:
    """kind, annotator, n_votes, skill, accuracy, dependents, weight; ``weight`` is what a vote counts.

    Accuracy: right with probability skill, else by chance at the annotator's own label frequencies. Weight: ln((K - 1) accuracy / (1 - accuracy))
    with the K labels of its kind, not under 0, divided by 1 + the annotators it depends on. ``votes`` has item, annotator, label and, if there is more than
    one kind of items and labels, kind.
    """
    found = _reliability(cut_lineage(_joined(votes)))
    return found.select(_kind("annotator").alias("kind"), _name("annotator").alias("annotator"), "n_votes", "skill", "accuracy", "dependents", "weight")


def consensus(votes: DataFrame, least_votes: int = 3) -> DataFrame:
    """kind, item, label, agreement, n_votes of each item with at least ``least_votes`` votes (see ``reliability``).

    The label with the greatest sum of weights wins; equal sums go by more votes, then, for labels that are numbers, by nearness to the weighted mean of the
    item's votes, then by the smaller label. agreement is the winner's share of the weights (of the votes, if all weigh nothing).
    """
    votes = cut_lineage(_joined(votes))
    weights = _reliability(votes)
    weighed = lookup_join(votes, weights.select("annotator", "n_votes", "weight"), ["annotator"], "n_votes", votes.count()).select("item", "label", "weight")
    sums = weighed.groupBy("item", "label").agg(F.sum("weight").alias("w"), F.count("*").alias("n"))
    value = F.col("label").try_cast("double")
    whole = sums.groupBy("item").agg(F.sum("w").alias("all_w"), F.sum("n").alias("n_votes"), F.try_divide(F.sum(F.col("w") * value), F.sum("w")).alias("mean"))
    away = F.coalesce(F.round(F.abs(value - F.col("mean")), 6), F.lit(0.0))
    order = F.struct((-F.round("w", 6)).alias("w"), (-F.col("n")).alias("n"), away.alias("away"), value.alias("v"), F.col("label"))
    best = sums.join(whole.where(F.col("n_votes") >= least_votes), "item").groupBy("item").agg(
        F.min(F.struct(order.alias("o"), F.col("w"), F.col("n"))).alias("b"), F.first("all_w").alias("all_w"), F.first("n_votes").alias("n_votes")
    )
    share = F.when(F.col("all_w") > 0, F.col("b.w") / F.col("all_w")).otherwise(F.col("b.n") / F.col("n_votes"))
    return best.select(_kind("item").alias("kind"), _name("item").alias("item"), F.col("b.o.label").alias("label"), share.alias("agreement"), "n_votes")
