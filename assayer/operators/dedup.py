"""Duplicates of comments: boxes that overlap, review decisions and what they leave."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.scalars import REVIEW_TARGET, SAME_TARGET, box_corners, box_iou
from assayer.operators.components import components
from assayer.operators.lookup import lookup_join
from assayer.session import cut_lineage


def action_key(action: Column) -> Column:
    """A review action apart from case, blanks and hyphens."""
    return F.regexp_replace(F.lower(F.trim(action)), r"[\s-]+", "_")


def overlap_edges(rows: DataFrame, group: str, key: str, box: str, least: float = SAME_TARGET, missing_meets_all: bool = False) -> DataFrame:
    """Edges a, b between rows of one group whose boxes overlap by ``least`` at least, or which both have no valid box.

    With ``missing_meets_all`` a row without a valid box is linked to every other one of its group.
    Rows without a valid box, and rows with the same box, are linked to the first of them, so a group of equal rows of any size gives as many edges as it
    has rows. Different boxes meet in cells: of boxes that overlap by t one is no more than 1 / t times as wide and as high as the other, and their centres are no
    farther apart than half their sides together, so each box is looked up in the cells of its neighbourhood, at the scales that its group has.
    """
    corners = box_corners(F.col(box))
    some = rows.select(F.col(group).alias("g"), F.col(key).alias("k"), corners.alias("r"))
    alike = some.groupBy("g", "r").agg(F.min("k").alias("first"), F.count("*").alias("n"))
    total = rows.count()
    packed = F.to_json(F.struct("g", "r"))
    # A null inside a key would meet nothing: the text of both stands for them.
    chained = lookup_join(some.select("k", packed.alias("p")), alike.select(packed.alias("p"), "first", "n"), ["p"], "n", total).select(F.col("first").alias("a"), F.col("k").alias("b")).where("a < b")
    if missing_meets_all:
        # The first of each box of a group, and the first without one: a star links them all.
        lone = alike.where("r IS NULL").select("g", F.col("first").alias("m"))
        stars = alike.where("r IS NOT NULL").join(lone, "g").select(F.least("m", "first").alias("a"), F.greatest("m", "first").alias("b"))
        chained = chained.unionByName(stars)
    boxes = alike.where("r IS NOT NULL").select("g", "first", "r", (F.col("r.x_max") - F.col("r.x_min")).alias("w"), (F.col("r.y_max") - F.col("r.y_min")).alias("h"))
    # Most groups have one box and nothing to compare.
    several = boxes.groupBy("g").agg(F.count("*").alias("n")).where("n > 1")
    boxes = lookup_join(boxes, several, ["g"], "n", total).drop("n")
    boxes = cut_lineage(boxes.withColumn("lw", F.floor(F.log2("w"))).withColumn("lh", F.floor(F.log2("h"))))
    cx, cy = (F.col("r.x_min") + F.col("r.x_max")) / 2, (F.col("r.y_min") + F.col("r.y_max")) / 2
    sw, sh = F.pow(F.lit(2.0), F.col("lw") + 1), F.pow(F.lit(2.0), F.col("lh") + 1)
    home = boxes.select("g", "first", "r", "lw", "lh", F.floor(cx / sw).alias("ix"), F.floor(cy / sh).alias("iy"))
    # One row per scale of a group: a few.
    scales = boxes.groupBy("g").agg(F.collect_set(F.struct("lw", "lh")).alias("scales"), F.count("*").alias("n"))
    far = math.ceil(math.log2(1 / least))
    probe = lookup_join(boxes.select("g", F.col("first").alias("other"), F.col("r").alias("q"), "w", "h", cx.alias("cx"), cy.alias("cy"), F.col("lw").alias("ow"), F.col("lh").alias("oh")), scales, ["g"], "n", total)
    probe = probe.select("*", F.explode("scales").alias("s")).select("g", "other", "q", "w", "h", "cx", "cy", "ow", "oh", "s.lw", "s.lh").where((F.abs(F.col("lw") - F.col("ow")) <= far) & (F.abs(F.col("lh") - F.col("oh")) <= far))
    # A partner of a scale is less than a cell of it wide or high.
    near = lambda centre, side, cell: F.sequence(F.floor((centre - (side + cell) / 2) / cell), F.floor((centre + (side + cell) / 2) / cell))
    probe = probe.select("g", "other", "q", "h", "cy", "lw", "lh", F.explode(near(F.col("cx"), F.col("w"), sw)).alias("ix"))
    probe = probe.select("g", "other", "q", "lw", "lh", "ix", F.explode(near(F.col("cy"), F.col("h"), sh)).alias("iy"))
    met = home.join(probe, ["g", "lw", "lh", "ix", "iy"]).where((F.col("first") != F.col("other")) & (box_iou(F.col("r"), F.col("q")) >= least))
    return chained.unionByName(met.select(F.least("first", "other").alias("a"), F.greatest("first", "other").alias("b")).distinct())


def duplicate_components(rows: DataFrame, group: str, key: str, box: str, least: float = SAME_TARGET, missing_meets_all: bool = False) -> DataFrame:
    """key, component, size of each row that is linked to another one of its group (see ``overlap_edges``); the component is its smallest key. Null groups take no part."""
    found = components(overlap_edges(rows.where(F.col(group).isNotNull()), group, key, box, least, missing_meets_all))
    sizes = found.groupBy("component").agg(F.count("*").alias("size"))
    return found.join(sizes, "component").select(F.col("node").alias(key), "component", "size")


def group_key(columns: Sequence[str]) -> Column:
    """The values of ``columns`` as one text; nulls are equal to each other and unlike any value."""
    return F.to_json(F.struct(*(F.col(c).alias(c) for c in columns)), {"ignoreNullFields": "false"})


def drop_exact(rows: DataFrame, columns: Sequence[str], key: str, label: str, box: str) -> DataFrame:
    """``rows`` without those that say the same in all ``columns`` about the same target as an earlier one, by ``label`` and then ``key``; a null label goes last."""
    held = rows.withColumn("__g", group_key(columns))
    found = duplicate_components(held, "__g", key, box).select(key, "component")
    first = found.join(rows.select(key, F.col(label).alias("__l")), key).groupBy("component").agg(F.min(F.struct(F.col("__l").isNull().alias("n"), F.col("__l").alias("l"), F.col(key).alias("k"))).alias("f"))
    dropped = found.join(first, "component").where(F.col(key) != F.col("f.k")).select(key)
    return rows.join(dropped, key, "left_anti")


def apply_choices(rows: DataFrame, review: DataFrame, key: str, choices: DataFrame) -> DataFrame:
    """``rows`` outside the groups of ``review`` (key, component), and of each group the one row that ``choices`` (key) names.

    It is an error if there are not as many choices as groups, if a choice is of no group, or if a group has no choice or several.
    """
    chosen = choices.select(key).distinct()
    groups = review.select("component").distinct().count()
    if (n := chosen.count()) != groups:
        raise ValueError(f"{n} choices for {groups} groups: exactly one is needed for each")
    if stray := chosen.join(review, key, "left_anti").limit(1).collect():
        raise ValueError(f"{stray[0][0]} is chosen and of no group")
    if (n := review.join(chosen, key, "left_semi").select("component").distinct().count()) != groups:
        raise ValueError(f"{groups - n} groups have no choice and others several")
    dropped = review.join(chosen, key, "left_anti").select(key)
    return rows.join(dropped, key, "left_anti")


def assert_resolved(rows: DataFrame, group: str, key: str, box: str, least: float = REVIEW_TARGET) -> DataFrame:
    """``rows``, if no two of a group are duplicates that someone would have to look at; an error otherwise."""
    if left := duplicate_components(rows, group, key, box, least, missing_meets_all=True).limit(1).collect():
        raise ValueError(f"duplicates remain, {left[0][key]} among them")
    return rows


def merge_outcome(decisions: DataFrame) -> DataFrame:
    """component, n_members, n_dropped, contradiction of the comments joined by ``decisions`` (a, b, action) that keep one side only.

    A component contradicts itself if every member of it is dropped.
    """
    merges = cut_lineage(decisions.where(F.col("action").isin("keep_a", "keep_b")).select("a", "b", "action"))
    dropped = merges.select(F.when(F.col("action") == "keep_a", F.col("b")).otherwise(F.col("a")).alias("node")).distinct().withColumn("dropped", F.lit(1))
    members = components(merges).join(dropped, "node", "left")
    out = members.groupBy("component").agg(F.count("*").alias("n_members"), F.count("dropped").alias("n_dropped"))
    return out.withColumn("contradiction", F.col("n_members") == F.col("n_dropped"))


def consensus_decision(a: Column, b: Column, relation_a: Column, relation_b: Column) -> Column:
    """What two reviews of one pair come to: the same action; manual_review where they keep different sides of what both call a duplicate; else keep_both."""
    conflict = a.isin("keep_a", "keep_b") & b.isin("keep_a", "keep_b") & (relation_a == "duplicate") & (relation_b == "duplicate")
    return F.when(a == b, a).when(conflict, "manual_review").otherwise("keep_both")
