"""Scalar functions as built-in column expressions, all of which stay in generated code."""

from __future__ import annotations

import ast
import json
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Thresholds of the overlap of two boxes. Fixed values.
SAME_TARGET, REVIEW_TARGET = 0.50, 0.10
BOX = ("x_min", "y_min", "x_max", "y_max")


def collapse(text: Column) -> Column:
    """White space of any kind as single blanks, none at the ends. Null stays null."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def clean_text(text: Column) -> Column:
    """``collapse`` with null as the empty text."""
    return F.coalesce(collapse(text), F.lit(""))


def clean_phrase(text: Column) -> Column:
    """``clean_text`` without blanks, periods and semicolons at the ends."""
    return F.trim(F.regexp_replace(clean_text(text), r"^[ .;]+|[ .;]+$", ""))


def clean_reference(text: Column) -> Column:
    """``clean_phrase`` without one delimiter in front."""
    return clean_phrase(F.regexp_replace(clean_phrase(text), r"^[—–>/\\:-]\s*", ""))


def normalize_text(text: Column) -> Column:
    """Lower case, straight quotes, single blanks, no non-word characters at the ends; null if nothing is left."""
    straight = F.translate(F.lower(text), "‘’“”", "''\"\"")
    return F.nullif(F.regexp_replace(collapse(straight), r"(?U)^[^\w]+|(?U)[^\w]+$", ""), F.lit(""))


def normalize_key(text: Column) -> Column:
    """Lower case, & as and, anything but a-z and 0-9 as one blank."""
    return F.trim(F.regexp_replace(F.replace(F.lower(clean_phrase(text)), F.lit("&"), F.lit("and")), r"[^a-z0-9]+", " "))


def split_clean(text: Column, pattern: str) -> Column:
    """The pieces of ``text`` between matches of ``pattern``, cleaned, without blank ones."""
    return F.filter(F.transform(F.split(text, pattern), clean_phrase), lambda p: p != "")


def numbered(prefix: Column | str, number: Column, width: int) -> Column:
    """``prefix`` followed by ``number``, zero-padded to ``width`` and never cut."""
    digits = number.cast("string")
    return F.concat(F.lit(prefix) if isinstance(prefix, str) else prefix, F.lpad(digits, F.greatest(F.lit(width), F.length(digits)), F.lit("0")))


def json_object_in(text: Column) -> Column:
    """The text from the first { to the last }, code fences and talk around it dropped; null if it is no JSON object."""
    found = F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))
    return F.when(F.try_parse_json(found).isNotNull(), found)


def box_corners(box: Column) -> Column:
    """The box with its corners in order; null if a coordinate is missing or it has no area."""
    x = F.least(box["x_min"], box["x_max"]), F.greatest(box["x_min"], box["x_max"])
    y = F.least(box["y_min"], box["y_max"]), F.greatest(box["y_min"], box["y_max"])
    whole = box["x_min"].isNotNull() & box["y_min"].isNotNull() & box["x_max"].isNotNull() & box["y_max"].isNotNull() & (x[1] > x[0]) & (y[1] > y[0])
    return F.when(whole, F.struct(x[0].alias("x_min"), y[0].alias("y_min"), x[1].alias("x_max"), y[1].alias("y_max")))


def box_iou(left: Column, right: Column) -> Column:
    """Intersection over union of two boxes; null if either is not valid."""
    a, b = box_corners(left), box_corners(right)
    w = F.greatest(F.lit(0.0), F.least(a["x_max"], b["x_max"]) - F.greatest(a["x_min"], b["x_min"]))
    h = F.greatest(F.lit(0.0), F.least(a["y_max"], b["y_max"]) - F.greatest(a["y_min"], b["y_min"]))
    area = lambda r: (r["x_max"] - r["x_min"]) * (r["y_max"] - r["y_min"])
    return F.try_divide(w * h, area(a) + area(b) - w * h)


def box_status(left: Column, right: Column) -> Column:
    """How far two boxes mean the same target."""
    iou = box_iou(left, right)
    neither = box_corners(left).isNull() & box_corners(right).isNull()
    missing = F.when(neither, "same_target_missing_bbox").otherwise("manual_missing_bbox")
    return F.when(iou.isNull(), missing).when(iou >= SAME_TARGET, "same_target").when(iou >= REVIEW_TARGET, "manual_ambiguous_target").otherwise("different_target")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors in double; null where one has no length or the dimensions differ."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(a) == F.size(b), F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))))


def binned(score: Column, scale: Column | int) -> Column:
    """low, mid or high: right-closed bins of a 10-point or a 5-point scale; null outside of it."""
    if isinstance(scale, int):
        first, second = (3, 7) if scale == 10 else (2, 4)
        return F.when((score < 0) | (score > scale) | score.isNull(), None).when(score <= first, "low").when(score <= second, "mid").otherwise("high")
    return F.when(scale == 10, binned(score, 10)).otherwise(binned(score, 5))


def issue_bucket(n: Column) -> Column:
    """1, 2, 3, 4 or 5+: a number clipped to 1..5 as a label."""
    return F.when(n >= 5, "5+").otherwise(F.greatest(n, F.lit(1)).cast("string"))


def p_stars(p: Column) -> Column:
    return F.when(p.isNull(), "").when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def p_text(p: Column) -> Column:
    """A probability as it is written beside a figure."""
    return F.when(p < 0.001, "p<0.001").otherwise(F.concat(F.lit("p="), F.format_string("%.3f", p)))


def literal_list(text: Column) -> Column:
    """A list literal of quoted texts as array<string>; null if it is none."""
    return F.from_json(text, "array<string>", {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"})


def _as_json(texts):
    def one(text):
        try:
            value = ast.literal_eval(text) if text is not None else None
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            return None
        return json.dumps(value, default=str) if isinstance(value, (list, tuple, dict)) else None

    return texts.map(one)


def python_literal(text: Column) -> Column:
    """A Python literal of a list, tuple or dict as JSON; null for others. In Python, so for the rows only that nothing built in can read: nulls cost nothing."""
    return F.pandas_udf(_as_json, StringType())(text)


def any_literal_list(text: Column) -> Column:
    """``literal_list``, and what only Python reads (None, tuples, joined strings) as its values; elements that are no texts are given as such."""
    plain = literal_list(text)
    return F.coalesce(plain, F.from_json(python_literal(F.when(plain.isNull(), text)), "array<string>"))


def first_match(text: Column, patterns: Sequence[tuple[str, str]], otherwise: str) -> Column:
    """The name of the first of ``patterns`` (name, regular expression) that ``text`` holds."""
    out = None
    for name, pattern in patterns:
        out = F.when(text.rlike(pattern), name) if out is None else out.when(text.rlike(pattern), name)
    return out.otherwise(otherwise)


def identifier_parts(text: Column) -> Column:
    """struct(identifier, name): what stands before and after the first slash; empty parts are null."""
    parts = F.split(text, "/", 2)
    return F.struct(F.nullif(F.element_at(parts, 1), F.lit("")).alias("identifier"), F.nullif(F.get(parts, F.lit(1)), F.lit("")).alias("name"))
