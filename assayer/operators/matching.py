"""Relations of comment pairs: weights, finalisation, coverage and one-to-one assignment."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions.scalars import clean_text
from assayer.operators.components import components
from assayer.operators.lookup import lookup_join
from assayer.operators.reshape import first_per_key
from assayer.session import cut_lineage, written

#: Credit of a pair by relation, in the order from best to worst. Fixed values.
WEIGHTS = {"equivalent": 1.0, "A_broader": 0.85, "B_broader": 0.85, "partial_overlap": 0.5, "contradiction": 0.0, "related_but_different": 0.0, "no_match": 0.0}
#: Ranks when two judges are equally sure. Fixed values.
FALLBACK = ("contradiction", "no_match", "related_but_different", "partial_overlap", "equivalent", "A_broader", "B_broader")


def relation_key(relation: Column) -> Column:
    """A relation apart from case, blanks and hyphens, as WEIGHTS spells it; null if it is none."""
    plain = F.regexp_replace(F.lower(F.trim(relation)), r"[\s-]+", "_")
    return F.try_element_at(F.create_map(*(x for r in WEIGHTS for x in (F.lit(r.lower()), F.lit(r)))), plain)


def relation_weight(relation: Column, strict: bool = False) -> Column:
    """The weight of a relation; null for an unknown one, or an error if ``strict``."""
    weight = F.try_element_at(F.create_map(*(F.lit(x) for pair in WEIGHTS.items() for x in pair)), relation)
    return F.when(weight.isNotNull(), weight).otherwise(F.raise_error(F.concat(F.lit("unknown relation: "), relation)).cast("double")) if strict else weight


def relation_rank(relation: Column, order: tuple[str, ...] = tuple(WEIGHTS)) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for i, r in enumerate(order) for x in (r, i + 1))), relation)


def finalize(pairs: DataFrame, fallback: bool = True) -> DataFrame:
    """``pairs`` (relation_a, confidence_a, relation_b, confidence_b, manual) with relation, confidence and decision_source.

    The judges' shared relation with their mean confidence, of those that are there; else the manual one with confidence 1; else, with ``fallback``, the surer
    judge's, ties by FALLBACK, then the first, and without it nulls and manual_review. A missing confidence is less than any.
    """
    a, b = F.col("relation_a"), F.col("relation_b")
    agreed = F.coalesce(a == b, F.lit(False))
    ca, cb = F.coalesce("confidence_a", F.lit(-1.0)), F.coalesce("confidence_b", F.lit(-1.0))
    ra, rb = (F.coalesce(relation_rank(x, FALLBACK), F.lit(999)) for x in (a, b))
    second = (cb > ca) | ((cb == ca) & (rb < ra))
    manual = F.col("manual").isNotNull()
    mean = F.coalesce((F.col("confidence_a") + F.col("confidence_b")) / 2, "confidence_a", "confidence_b")
    relation, confidence = F.when(agreed, a).when(manual, F.col("manual")), F.when(agreed, mean).when(manual, 1.0)
    if fallback:
        relation, confidence = relation.otherwise(F.when(second, b).otherwise(a)), confidence.otherwise(F.when(second, cb).otherwise(ca))
    return (
        pairs.withColumn("relation", relation)
        .withColumn("confidence", confidence)
        .withColumn("decision_source", F.when(agreed, "judge_agreement").when(manual, "manual_override").otherwise("confidence_fallback" if fallback else "manual_review"))
    )


def valid_manual(manual: DataFrame, relation: str = "manual") -> DataFrame:
    """``manual`` decisions, if each is null or one of WEIGHTS; an error that names some of the others, otherwise."""
    wrong = manual.where(~F.col(relation).isin(*WEIGHTS)).select(relation).distinct().limit(5).collect()
    if wrong:
        raise ValueError(f"invalid manual relations: {[r[0] for r in wrong]}")
    return manual


def best_ranked(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """The pair of best relation of each key: rank, then confidence, then the smaller pair_id. Unknown relations take no part."""
    ranked = pairs.withColumn("__rank", relation_rank(F.col("relation"))).where("__rank IS NOT NULL")
    return first_per_key(ranked, keys, [F.asc("__rank"), F.desc_nulls_last("confidence"), F.asc("pair_id")]).drop("__rank")


def cell_matrix(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """The greatest weight of each expert and model comment of ``keys``."""
    return pairs.groupBy(*keys, "expert_comment_id", "llm_comment_id").agg(F.max(F.coalesce(relation_weight(F.col("relation")), F.lit(0.0))).alias("weight"))


def unconstrained(cells: DataFrame, keys: list[str]) -> DataFrame:
    """coverage and support of each of ``keys``: the mean over expert (model) comments of their best weight."""
    experts = cells.groupBy(*keys, "expert_comment_id").agg(F.max("weight").alias("w")).groupBy(*keys).agg(F.avg("w").alias("coverage"), F.count("*").alias("n_expert"))
    models = cells.groupBy(*keys, "llm_comment_id").agg(F.max("weight").alias("w")).groupBy(*keys).agg(F.avg("w").alias("support"), F.count("*").alias("n_llm"))
    return experts.join(models, keys)


def assignment(weights) -> float:
    """The greatest sum of a one-to-one choice from a matrix of weights (Hungarian method with potentials, rows the shorter side)."""
    import numpy as np

    cost = -np.asarray(weights, dtype=float)
    if cost.size == 0:
        return 0.0
    if cost.shape[0] > cost.shape[1]:
        cost = cost.T
    n, m = cost.shape
    u, v, row_of = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        row_of[0] = i
        j = 0
        slack, came, seen = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=bool)
        while row_of[j]:
            seen[j] = True
            r = row_of[j]
            free = np.flatnonzero(~seen[1:]) + 1
            reduced = cost[r - 1, free - 1] - u[r] - v[free]
            closer = reduced < slack[free]
            slack[free[closer]] = reduced[closer]
            came[free[closer]] = j
            nearest = free[np.argmin(slack[free])]
            step = slack[nearest]
            u[row_of[seen]] += step
            v[seen] -= step
            slack[~seen] -= step
            j = nearest
        while j:
            row_of[j] = row_of[came[j]]
            j = came[j]
    matched = [(row_of[j] - 1, j - 1) for j in range(1, m + 1) if row_of[j]]
    return float(-sum(cost[r, c] for r, c in matched))


#: Cells of a group from which it is solved in its connected parts; it changes the plan and not the result.
SPLIT_CELLS = 20_000


def bipartite(cells: DataFrame, keys: list[str]) -> DataFrame:
    """coverage, support and matched sum of each of ``keys`` when every comment may be matched once.

    Only cells with a weight can matter, and of one comment no more than there are comments on the other side, counting those with a weight: its
    best ones. What is left of a group falls into connected parts, which are solved one by one; a part has no more cells than twice the square of its shorter side.
    """
    sizes = cells.groupBy(*keys).agg(F.count_distinct("expert_comment_id").alias("n_expert"), F.count_distinct("llm_comment_id").alias("n_llm"))
    some = cells.where("weight > 0")
    short = some.groupBy(*keys).agg(F.least(F.count_distinct("expert_comment_id"), F.count_distinct("llm_comment_id")).alias("__most"))
    some = some.join(short, keys)
    for side, other in (("expert_comment_id", "llm_comment_id"), ("llm_comment_id", "expert_comment_id")):
        place = F.row_number().over(Window.partitionBy(*keys, side).orderBy(F.desc("weight"), other))
        some = some.withColumn("__place", place).where(F.col("__place") <= F.col("__most"))
    some = cut_lineage(some.drop("__most", "__place"))
    # Comments that share no cell, directly or through others, are matched apart: a large group falls into its connected parts, and a task solves one of them.
    large = some.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > SPLIT_CELLS)
    if large.limit(1).count():
        side = lambda c: F.to_json(F.struct(*keys, F.lit(c).alias("__side"), F.col(c).alias("__id")), {"ignoreNullFields": "false"})
        marked = lookup_join(some.withColumn("__g", F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})), large.select(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("__g"), "__n"), ["__g"], "__n", some.count(), "left")
        marked = cut_lineage(marked.withColumn("__a", F.when(F.col("__n").isNotNull(), side("expert_comment_id"))).withColumn("__b", F.when(F.col("__n").isNotNull(), side("llm_comment_id"))))
        parts = components(marked.select("__a", "__b"), "__a", "__b").select(F.col("node").alias("__a"), F.col("component").alias("__part"))
        some = marked.join(parts, "__a", "left").drop("__a", "__b", "__g", "__n")
    else:
        some = some.withColumn("__part", F.lit(None).cast("string"))
    cell = F.collect_list(F.struct(F.col("expert_comment_id").alias("e"), F.col("llm_comment_id").alias("m"), F.col("weight").alias("w")))
    short = F.least(F.count_distinct("expert_comment_id"), F.count_distinct("llm_comment_id"))
    grouped = some.groupBy(*keys, "__part").agg(short.alias("__most"), F.max("weight").alias("__top"), cell.alias("__cells"))
    plain = grouped.where("__most <= 1").select(*keys, F.col("__top").alias("matched"))
    rest = grouped.where("__most > 1").select(*keys, *(F.col(f"__cells.{f}").alias(f"__{f}") for f in "emw"))
    kinds = dict(cells.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", matched double"

    def solve(batches):
        import numpy as np

        for batch in batches:
            sums = []
            for es, ms, ws in zip(batch["__e"], batch["__m"], batch["__w"]):
                rows, columns = {e: i for i, e in enumerate(dict.fromkeys(es))}, {m: i for i, m in enumerate(dict.fromkeys(ms))}
                table = np.zeros((len(rows), len(columns)))
                for e, m, w in zip(es, ms, ws):
                    table[rows[e], columns[m]] = max(w, table[rows[e], columns[m]])
                sums.append(assignment(table))
            yield batch[keys].assign(matched=sums)

    matched = plain.unionByName(rest.mapInPandas(solve, schema)).groupBy(*keys).agg(F.sum("matched").alias("matched"))
    out = sizes.join(matched, keys, "left").withColumn("matched", F.coalesce("matched", F.lit(0.0)))
    return out.select(*keys, (F.col("matched") / F.col("n_expert")).alias("coverage"), (F.col("matched") / F.col("n_llm")).alias("support"), "matched")


#: What a relation says about a flag, where it says anything. Fixed values.
IMPLIED = {
    "same_usability_problem": {"equivalent": "yes", "A_broader": "yes", "B_broader": "yes", "partial_overlap": "partial", "related_but_different": "no", "no_match": "no"},
    "logical_conflict": {r: "yes" if r == "contradiction" else "no" for r in WEIGHTS},
}


def implied(flag: str, relation: Column) -> Column:
    """The value of ``flag`` that follows from a relation; null where nothing follows."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in IMPLIED[flag].items() for x in pair)), relation)


def finalize_flags(pairs: DataFrame, flags: list[str]) -> DataFrame:
    """``pairs`` (final relation and decision_source, relation_a, relation_b, <flag>_a, <flag>_b) with each flag's final value.

    What both judges say; else what the one judge says whose relation became final; else "disagree". A manual relation takes the flag that follows from it.
    """
    a, b = F.coalesce(F.col("relation") == F.col("relation_a"), F.lit(False)), F.coalesce(F.col("relation") == F.col("relation_b"), F.lit(False))
    for flag in flags:
        x, y = F.col(f"{flag}_a"), F.col(f"{flag}_b")
        said = F.when(x == y, x).when(a & ~b, x).when(b & ~a, y).otherwise("disagree")
        follows = implied(flag, F.col("relation"))
        pairs = pairs.withColumn(flag, F.when((F.col("decision_source") == "manual_override") & follows.isNotNull(), follows).otherwise(said))
    return pairs


def flag_consistency(pairs: DataFrame, flags: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """flag, n, share (of each of ``keys``): how many pairs have the value that follows from their relation, among those where one follows."""
    counts = [x for f in flags for x in (F.count(implied(f, F.col("relation"))).alias(f"n_{f}"), F.avg((F.col(f) == implied(f, F.col("relation"))).cast("int")).alias(f"s_{f}"))]
    return pairs.groupBy(*keys).agg(*counts).selectExpr(*keys, f"stack({len(flags)}, " + ", ".join(f"'{f}', n_{f}, s_{f}" for f in flags) + ") AS (flag, n, share)")


def similar_pairs(df: DataFrame, key: str, group: str, vector: str, least: float = 0.40, block: int = 1000) -> DataFrame:
    """left_id, right_id, cosine of every two rows of a group, the smaller key left, whose cosine is ``least`` or more.

    The rows of a group are spread over blocks of about ``block`` rows and each two blocks meet in one task, so no task holds more than two blocks,
    whatever the size of a group; every pair is compared. Rows without a group, vectors that are null, hold a null or a NaN or have no length, and pairs
    of different dimensions have no cosine. Repeated rows give repeated pairs.
    """
    kind = dict(df.dtypes)[key]
    rows = df.select(F.col(key).alias("__id"), F.col(group).alias("__g"), F.col(vector).cast("array<double>").alias("__v"))
    rows = rows.where(F.col("__id").isNotNull() & F.col("__g").isNotNull() & F.forall("__v", lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists("__v", lambda x: x != 0)).withColumn("__d", F.size("__v"))
    sizes = rows.groupBy("__g", "__d").agg(F.count("*").alias("__n")).withColumn("__blocks", F.ceil(F.col("__n") / block).cast("int"))
    placed = lookup_join(rows, sizes, ["__g", "__d"], "__n", rows.count()).withColumn("__b", F.pmod(F.xxhash64("__id"), F.col("__blocks")).cast("int"))
    b = F.col("__b")
    spots = F.concat(
        F.transform(F.sequence(b, F.col("__blocks") - 1), lambda j: F.struct(b.alias("__i"), j.alias("__j"), F.lit(True).alias("__left"))),
        F.transform(F.sequence(F.lit(0), b), lambda i: F.struct(i.alias("__i"), b.alias("__j"), F.lit(False).alias("__left"))),
    )

    def meet(key, pdf):
        import numpy as np
        import pandas as pd

        sides = []
        for part in (pdf[pdf["__left"]], pdf[~pdf["__left"]]):
            m = np.stack(part["__v"].to_numpy()) if len(part) else np.zeros((0, key[1]))
            sides.append((part["__id"].to_numpy(), m / np.sqrt((m * m).sum(1))[:, None]))
        (x, left), (y, right) = sides
        cosine = left @ right.T
        at = np.nonzero(cosine >= least)
        x, y, c = x[at[0]], y[at[1]], cosine[at]
        # Inside one block each pair is met from both sides.
        keep = x < y if key[2] == key[3] else x != y
        return pd.DataFrame({"left_id": np.where(x < y, x, y)[keep], "right_id": np.where(x < y, y, x)[keep], "cosine": c[keep]})

    by = ["__g", "__d", "__i", "__j"]
    met = placed.select("__g", "__d", "__id", "__v", F.explode(spots).alias("s")).select("__g", "__d", "s.*", "__id", "__v")
    return met.groupBy(*by).applyInPandas(meet, f"left_id {kind}, right_id {kind}, cosine double")


#: Pairs that a task of ``comment_pairs`` makes, about, and comments in one of its lists.
TASK_PAIRS, RUN = 8_000_000, 256


def comment_pairs(experts: DataFrame, models: DataFrame, task: str = "screen_task_id", block: int = 4000) -> DataFrame:
    """Every expert comment with every model comment of its task, whatever the size of the task: pair_id and both sides' columns.

    ``experts`` has expert_comment_id, ``models`` has model_short and llm_comment_id. Comments that follow each other in order of their ids are kept in lists, which
    take little room when shuffled. The lists of a task are spread over blocks of about ``block`` comments, and each two blocks meet under a key of their own, so no
    key makes much more than ``block`` squared pairs. The experts of a list, whose columns Spark must be able to sort, come out one after the other for each model
    comment of a list: such rows take little room when written. The pair_id ends with the whole number of the model comment; its last three digits alone would
    repeat in large tasks. It is null if one of its parts is.
    """

    def lists(side: DataFrame, ids: list[str], name: str, listed: Callable[[Column], Column] = lambda x: x) -> DataFrame:
        rest = [c for c in side.columns if c not in (task, *ids)]
        # By all that can be sorted: a list must hold the same rows when a lost task is run again.
        order = [task, *ids, *(c for c in rest if not {"map", "variant"} & set(re.findall(r"\w+", dict(side.dtypes)[c])))]
        rows = side.where(F.col(task).isNotNull()).sort(*order).select(F.expr(f"monotonically_increasing_id() div {min(RUN, block)}").alias("__r"), task, F.struct(*ids, *rest).alias("__c"))
        return written(rows.groupBy(task, "__r").agg(listed(F.collect_list("__c")).alias(name)))

    left = lists(experts, ["expert_comment_id"], "__es", F.sort_array)
    right = lists(models, ["model_short", "llm_comment_id"], "__ms")
    counts = [side.groupBy(task).agg(F.sum(F.size(name)).alias(n)) for side, name, n in ((left, "__es", "__ne"), (right, "__ms", "__nm"))]
    sizes = written(counts[0].join(counts[1], task, "full").fillna(0, ["__ne", "__nm"]))
    pairs = sizes.agg(F.sum(F.col("__ne").cast("double") * F.col("__nm"))).first()[0] or 0
    # By number, for the blocks are so small beside their pairs that adaptive execution would put them all into a few tasks.
    tasks = min(max(int(experts.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(pairs / TASK_PAIRS)), 100_000)
    # Each of these tasks has more than ``block`` rows, which bounds the broadcast; any other is one block. What has nothing on the other side meets nothing.
    large = sizes.where(F.greatest("__ne", "__nm") > block).select(task, *(F.ceil(F.col(n) / block).cast("int").alias(n) for n in ("__ne", "__nm")))

    def spread(side: DataFrame, name: str, own: str, other: str, own_block: str, other_block: str) -> DataFrame:
        placed = side.join(F.broadcast(large), task, "left").fillna(1, [own, other]).where(F.col(other) > 0)
        met = placed.select(task, name, F.pmod(F.xxhash64("__r"), F.col(own)).cast("int").alias(own_block), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other_block))
        return met.repartition(tasks, task, "__i", "__j")

    by = [task, "__i", "__j"]
    met = spread(right, "__ms", "__nm", "__ne", "__j", "__i").join(spread(left, "__es", "__ne", "__nm", "__i", "__j").hint("merge"), by)
    # ``transform`` keeps this step out of generated code, which would hold all pairs of two lists at once instead of those of one model comment.
    ends = F.transform("__ms", lambda m: F.struct(m.alias("__m"), F.regexp_extract(m["llm_comment_id"], "[^_]*$", 0).alias("__end")))
    both = met.select(task, "__es", F.explode(ends).alias("__s")).select(task, "__s.*", F.explode("__es").alias("__e"))
    pair_id = F.concat("__m.model_short", F.lit("_"), "__e.expert_comment_id", F.lit("_"), "__end")
    return both.select(pair_id.alias("pair_id"), task, *(F.col(f"{side}.`{c}`") for side, df in (("__e", experts), ("__m", models)) for c in df.columns if c != task))


def expand_critiques(answers: DataFrame, model: str, task: str = "screen_task_id", critiques: str = "critiques") -> DataFrame:
    """One row per comment of the JSON lists in ``critiques``: task, llm_comment_id (L_<model>_<task>_<number>) and the comment's fields with llm_ in front.

    Comments are numbered in the order of the answer; the reference is taken from guideline_references or else guideline_reference, lists as JSON. Elements
    that are no objects are no comments; comments without an issue are dropped after they were numbered. Lists that cannot be read give no row.
    """
    elements = F.filter(F.from_json(F.col(critiques), "array<string>"), lambda e: e.startswith("{"))
    rows = answers.select(task, F.posexplode(elements).alias("__i", "__e"))
    get = lambda name: F.get_json_object("__e", f"$.{name}")
    number = F.lpad((F.col("__i") + 1).cast("string"), F.greatest(F.lit(3), F.length((F.col("__i") + 1).cast("string"))), F.lit("0"))
    out = rows.select(
        task, F.concat(F.lit(f"L_{model}_"), F.col(task), F.lit("_"), number).alias("llm_comment_id"), get("expected_standard").alias("llm_expected_standard"), clean_text(get("observed_issue")).alias("llm_observed_issue"),
        get("suggested_fix").alias("llm_suggested_fix"), F.coalesce(get("guideline_references"), get("guideline_reference")).alias("llm_guideline_reference"),
    )
    return out.where("llm_observed_issue <> ''")
