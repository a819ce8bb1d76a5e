"""One surviving record for each group of duplicates, its values chosen field by field.

Groups are the connected components of the merge decisions. Values that are nothing (null, blank, a stand-in, the cut-off beginning of another
value of the group) are set aside. Among the rest, Bayesian fusion with copy detection gives each value a posterior: sources have accuracies,
estimated with the posteriors in turns; two sources that share many values nobody else has are taken to copy, and the vote of the one that copies is
discounted. ``survivors`` takes the value that stands first by ``precedence`` and comment; the posterior decides between different values
of one comment and, without a precedence, between all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.operators.components import components
from assayer.operators.lookup import lookup_join
from assayer.session import cut_lineage, written

#: What people write instead of a text. Fixed values.
STAND_INS = (
    "n/a", "na", "n.a.", "none", "null", "nil", "nan", "tbd", "tba", "todo", "x", "xx", "xxx", "blank", "empty", "no text", "no comment",
    "same as above", "as above", "see above", "see other comment", "see comment", "see screenshot", "ditto", "same", "unknown", "missing",
)
#: Marks at the end of a text that was cut.
_CUT_MARK = r"(?:[\s\p{Z}]*(?:…|\.{2,}|[\[(](?:cut|truncated|\.\.\.|…)[\])]|[-–—]))+[\s\p{Z}]*$"


def is_nothing(text: Column) -> Column:
    """Null, blank, punctuation only, or one of STAND_INS, whatever the case, brackets and dots around it."""
    core = F.regexp_replace(F.lower(text), r"^[\s\p{Z}\p{P}\p{S}]+|[\s\p{Z}\p{P}\p{S}]+$", "")
    return text.isNull() | core.isin("", *STAND_INS)


def usable_values(values: DataFrame) -> DataFrame:
    """``values`` (group_id, field_name, comment_id, value and more) without those that are nothing or a cut-off beginning.

    A value is cut off if it, without a mark of cutting at its end, is the beginning of a longer value of its group and field. Each value is
    compared by hash with the beginnings of the others at the lengths that occur in the group, so no pairs within a group are made.
    """
    some = values.where(~is_nothing(F.col("value"))).withColumn("text", F.trim(F.regexp_replace("value", r"[\s\p{Z}]+", " ")))
    some = some.withColumn("stem", F.trim(F.regexp_replace("text", _CUT_MARK, "")))
    by = ["group_id", "field_name"]
    texts = cut_lineage(some.groupBy(*by, "text", "stem").agg(F.count("*").alias("size")))
    # One array per group: as many numbers at most as the longest text has letters.
    lengths = texts.groupBy(*by).agg(F.collect_set(F.length("stem")).alias("lengths"), F.count("*").alias("texts"))
    several = lengths.where("texts > 1").select(*by, "lengths", "texts")
    beginnings = lookup_join(texts.select(*by, "text"), several, by, "texts", texts.count()).select(*by, "text", F.explode("lengths").alias("n"))
    own = F.sha2("text", 256)
    # No more of a text than it has letters; the hash spreads a large group.
    beginnings = beginnings.where((F.col("n") > 0) & (F.col("n") < F.length("text"))).select(*by, F.expr("sha2(substring(text, 1, n), 256)").alias("h"), own.alias("of"))
    # A beginning of two texts is one of another text, whichever is looked at.
    beginnings = beginnings.groupBy(*by, "h").agg(F.min("of").alias("one"), F.max("of").alias("two"))
    met = texts.withColumn("h", F.sha2("stem", 256)).join(beginnings, [*by, "h"])
    cut = met.where((F.col("one") != own) | (F.col("two") != own)).select(*by, "text", "size", F.lit(True).alias("cut"))
    marked = lookup_join(some, cut, [*by, "text"], "size", values.count(), "left")
    return marked.where("cut IS NULL").drop("size", "cut", "text", "stem")


def posteriors(claims: DataFrame, false_values: int = 10, copy_rate: float = 0.8, copy_prior: float = 0.2, settled: float = 0.005, most_rounds: int = 40) -> DataFrame:
    """``claims`` (item, source, value; distinct) with the ``posterior`` of each claim's value among the item's values.

    Accuracy of a source: the mean posterior of its claims. A value has the sum of ln(n A / (1 - A)) over its sources, ``false_values`` being n.
    Dependence of two sources: the odds, by Bayes' rule, of the values they share on common items being true (posterior at least one half), false or different, with
    ``copy_rate`` of a copier's values copied; the source with the lower accuracy of the two (ties: the greater name) counts as the copier, and its
    vote for a shared value is multiplied by 1 - copy_rate * P(dependent). The turns end when no accuracy changes by more than ``settled``; after
    five turns half of each change is taken. It is an error if they do not end in ``most_rounds``.
    """
    claims = written(claims.where("item IS NOT NULL AND source IS NOT NULL AND value IS NOT NULL").select("item", "source", "value").distinct())
    n = float(false_values)
    accuracy = written(claims.select("source").distinct().withColumn("accuracy", F.lit(0.8)))
    said = claims.groupBy("item", "source").agg(F.count("*").alias("c"))
    # Sources are few and items many: pairs of sources are counted, from one row per item and source and one per value and source.
    met = written(_pairs_of(said, ["item"], (F.col("c") * F.col("d")).alias("x")).groupBy("s", "t").agg(F.sum("x").alias("met")))
    shared = written(_pairs_of(claims.withColumn("c", F.lit(1)), ["item", "value"], F.lit(1).alias("x")).select("item", "value", "s", "t"))
    # Before anything is known of the truth, agreeing counts as agreeing on it: only sources that agree beyond their accuracy are then dependent,
    # and copies cannot outvote the rest in the first round.
    value = claims.select("item", "value").distinct().withColumn("posterior", F.lit(1.0))
    for turn in range(most_rounds):
        copying = _copying(shared, met, value, accuracy, n, copy_rate, copy_prior)
        votes = claims.join(accuracy, "source").withColumn("vote", F.log(F.lit(n) * F.col("accuracy") / (1 - F.col("accuracy"))))
        both = shared.select("item", "value", F.col("s").alias("source"), F.col("t").alias("original")).unionByName(shared.select("item", "value", F.col("t").alias("source"), F.col("s").alias("original")))
        kept = both.join(copying, ["source", "original"]).groupBy("item", "value", "source").agg(F.exp(F.sum(F.log(1 - F.lit(copy_rate) * F.col("dependent")))).alias("kept"))
        votes = votes.join(kept, ["item", "value", "source"], "left").withColumn("vote", F.col("vote") * F.coalesce("kept", F.lit(1.0)))
        score = votes.groupBy("item", "value").agg(F.sum("vote").alias("score"))
        top = score.groupBy("item").agg(F.max("score").alias("top"))
        share = score.join(top, "item").withColumn("e", F.exp(F.col("score") - F.col("top")))
        whole = share.groupBy("item").agg(F.sum("e").alias("whole"))
        value = written(share.join(whole, "item").select("item", "value", (F.col("e") / F.col("whole")).alias("posterior")))
        new = claims.join(value, ["item", "value"]).groupBy("source").agg(F.least(F.greatest(F.avg("posterior"), F.lit(0.05)), F.lit(0.95)).alias("new"))
        # Turns that go back and forth are damped.
        step = F.lit(1.0 if turn < 5 else 0.5)
        now = written(accuracy.join(new, "source").select("source", (F.col("accuracy") + step * (F.col("new") - F.col("accuracy"))).alias("accuracy"), F.abs(F.col("new") - F.col("accuracy")).alias("change")))
        change = now.agg(F.max("change")).first()[0] or 0.0
        accuracy = now.drop("change")
        if change <= settled:
            return claims.join(value, ["item", "value"])
    raise RuntimeError(f"accuracies still change by {change} after {most_rounds} rounds")


def _pairs_of(said: DataFrame, by: list[str], *columns: Column) -> DataFrame:
    """s < t of each two sources that meet in ``by``, with ``columns`` of their counts c and d. No more of one key than the square of the sources."""
    left = said.select(*by, F.col("source").alias("s"), "c")
    right = said.select(*by, F.col("source").alias("t"), F.col("c").alias("d"))
    return left.join(right, by).where("s < t").select(*by, "s", "t", *columns)


def _copying(shared: DataFrame, met: DataFrame, value: DataFrame, accuracy: DataFrame, n: float, rate: float, prior: float) -> DataFrame:
    """source, original, dependent: the probability that ``source`` copies from ``original``."""
    truth = (F.col("posterior") >= 0.5).cast("long")
    same = shared.join(value, ["item", "value"]).groupBy("s", "t").agg(F.sum(truth).alias("same_true"), F.sum(1 - truth).alias("same_false"))
    counts = met.join(same, ["s", "t"], "left").na.fill(0, ["same_true", "same_false"]).withColumn("different", F.col("met") - F.col("same_true") - F.col("same_false"))
    with_a = counts.join(accuracy.select(F.col("source").alias("s"), F.col("accuracy").alias("x")), "s").join(accuracy.select(F.col("source").alias("t"), F.col("accuracy").alias("y")), "t")
    a = (F.col("x") + F.col("y")) / 2
    free_true, free_false = a * a, (1 - a) * (1 - a) / n
    free_other = 1 - free_true - free_false
    tied_true, tied_false, tied_other = a * rate + free_true * (1 - rate), (1 - a) * rate + free_false * (1 - rate), free_other * (1 - rate)
    log_odds = F.log(F.lit(prior / (1 - prior))) + F.col("same_true") * F.log(tied_true / free_true) + F.col("same_false") * F.log(tied_false / free_false) + F.col("different") * F.log(tied_other / free_other)
    p = 1 / (1 + F.exp(-F.least(F.greatest(log_odds, F.lit(-50.0)), F.lit(50.0))))
    s_copies = F.col("x") < F.col("y")
    return with_a.select(F.when(s_copies, F.col("s")).otherwise(F.col("t")).alias("source"), F.when(s_copies, F.col("t")).otherwise(F.col("s")).alias("original"), p.alias("dependent"))


def merge_groups(reviews: DataFrame, review: str, at: str, a: str, b: str, action: str) -> tuple[DataFrame, DataFrame]:
    """node, component of the comments joined by reviews that keep one side only, and the comments that a counted review drops (``comment_id``).

    Of each ``review`` id only the latest by ``at`` counts; equal times go by the greatest action and sides. Actions are read whatever their case,
    blanks and hyphens.
    """
    act = F.regexp_replace(F.lower(F.trim(F.col(action))), r"[\s_-]+", "_")
    read = reviews.where(F.col(review).isNotNull()).groupBy(review).agg(F.max(F.struct(F.col(at).alias("at"), act.alias("act"), F.col(a).alias("a"), F.col(b).alias("b"))).alias("r"))
    merges = cut_lineage(read.select("r.act", "r.a", "r.b").where(F.col("act").isin("keep_a", "keep_b")))
    dropped = merges.select(F.when(F.col("act") == "keep_a", F.col("b")).otherwise(F.col("a")).alias("comment_id")).distinct()
    return components(merges), dropped


def with_posteriors(values: DataFrame, source: str, unknown: str = "unknown") -> DataFrame:
    """``values`` with the ``posterior`` of each one in its group and field (see ``posteriors``); a null ``source`` counts as ``unknown``."""
    item = F.to_json(F.struct("group_id", "field_name"))
    claims = values.select(item.alias("__item"), F.coalesce(F.col(source), F.lit(unknown)).alias("source"), "value")
    fused = posteriors(claims.withColumnRenamed("__item", "item")).groupBy("item", "value").agg(F.first("posterior").alias("posterior"))
    sizes = values.groupBy(item.alias("__item"), "value").agg(F.count("*").alias("__n"))
    told = fused.select(F.col("item").alias("__item"), "value", "posterior").join(sizes, ["__item", "value"])
    return lookup_join(values.drop("posterior").withColumn("__item", item), told, ["__item", "value"], "__n", values.count()).drop("__item", "__n")


def survivors(values: DataFrame, precedence: Sequence[Column] | None = None) -> DataFrame:
    """The surviving value of each group_id and field_name: group_id, field_name, comment_id, value.

    ``values`` has these columns, those ``precedence`` speaks of, and ``posterior`` (see ``with_posteriors``). Smaller precedence goes
    first, then the smaller comment_id, then of one comment's values the one with the greatest posterior; without a precedence the greatest posterior goes
    first. It is one aggregate, combined before the shuffle, so a group of any size is taken.
    """
    likely = -F.round("posterior", 9)
    order = [*precedence, F.col("comment_id"), likely] if precedence is not None else [likely, F.col("comment_id")]
    best = F.min(F.struct(*(c.alias(f"p{i}") for i, c in enumerate(order)), "comment_id", "value"))
    return values.groupBy("group_id", "field_name").agg(best.alias("b")).select("group_id", "field_name", "b.comment_id", "b.value")
