"""Free-text comments taken apart into their label, box and three parts, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.scalars import BOX

PARTS = ("expected_standard", "observed_issue", "suggested_fix")

# Wordings that begin a part. Fixed values.
HEADER = r"(?iU)^\s*((?:llm\s+)?comment\s*[:#]?\s*\d+)\b[\s:,\-–—]*"
BOX_PATTERN = r"(?iU)(?:\bbounding\s*box\b|\bboundingbox\b)\s*[:\-]?\s*\[([^\]]+)\]"
EXPECTED = r"(?iU)\bthe\s+expected\s+standard\b|\bthe\s+standard\s+is\b|\nhe\s+expected\s+standard\s+is\b|\bhe\s+expected\s+standard\s+is\b"
OBSERVED = r"(?iU)\bin\s+the\s+current\s+design\b|\bin\s+the\s+current\s+layout\b|\bin\s+this\s+current\s+design\b|\bin\s+the\s+current\s+,"
FIX = r"(?iU)\bto\s+fix\s+this\b|\bto\s+fix\s+it\b"
#: Connecting words after the expected standard, taken off one after the other.
_GLUE = (r"is\s+that", r"is\s+to", "that", "to", "is")


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _tidy(text: Column) -> Column:
    """Without blanks, commas, colons and dashes at the ends; null if nothing is left."""
    return F.nullif(_strip(F.regexp_replace(_strip(F.regexp_replace(_strip(text), r"(?U)^[\s,:\-–—]+", "")), r"(?U)[\s,:\-–—]+$", "")), F.lit(""))


def _without_glue(text: Column) -> Column:
    out = F.regexp_replace(text, r"^[ \t\r\n:,\-–—]+", "")
    for glue in _GLUE:
        out = F.regexp_replace(out, rf"(?iU)^(?:{glue})\b\s*", "")
    return _tidy(out)


def parse_comments(df: DataFrame, text: str, position: Column, name: str = "parsed") -> DataFrame:
    """``df`` with the struct ``name`` of the comment in ``text``; ``position`` labels comments without a header.

    A part runs from its first marker to the next part's first marker; the fix runs from its marker to the end. Without any marker all is the observed
    issue. A box with fewer than four numbers is null; the numbers of any box are in box_numbers. Null texts give null parts.
    """
    raw = _strip(F.coalesce(F.col(text), F.lit("")))
    cid = F.regexp_extract("__raw", HEADER, 1)
    number = F.regexp_extract(cid, r"(?iU)comment\s*(\d+)", 1)
    plain = F.regexp_replace(F.concat(F.upper(F.substring(cid, 1, 1)), F.substring(cid, F.lit(2), F.length(cid))), r"(?iU)^llm\s+", "")
    label = F.when(cid == "", F.concat(F.lit("Comment "), position.cast("string"))).when(number != "", F.concat(F.lit("Comment "), number)).otherwise(_strip(plain))
    source = F.when(cid.rlike("(?iU)^llm\\b"), "LLM").otherwise("Human")
    numbers = F.transform(F.regexp_extract_all(F.regexp_extract("__rest", BOX_PATTERN, 1), F.lit(r"[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?"), F.lit(0)), lambda x: x.cast("double"))
    listed = F.when(F.size(numbers) > 0, numbers)
    box = F.when(F.size(numbers) >= 4, F.struct(*(F.get(numbers, F.lit(i)).alias(k) for i, k in enumerate(BOX))))
    step = (
        df.withColumn("__raw", raw)
        .withColumn("__rest", _strip(F.regexp_replace("__raw", HEADER, "")))
        .withColumn("__t", F.when(F.col("__rest").rlike(BOX_PATTERN), _strip(F.concat(F.element_at(F.split("__rest", BOX_PATTERN, 2), 1), F.lit(" "), F.element_at(F.split("__rest", BOX_PATTERN, 2), 2)))).otherwise(F.col("__rest")))
    )
    for key, pattern in (("e", EXPECTED), ("o", OBSERVED), ("f", FIX)):
        step = step.withColumn(f"__{key}", F.nullif(F.regexp_instr("__t", F.lit(pattern)), F.lit(0))).withColumn(f"__{key}_end", F.col(f"__{key}") + F.length(F.regexp_extract("__t", pattern, 0)))
    length = F.length("__t") + 1

    def segment(key: str, others: str) -> Column:
        stops = [F.when(F.col(f"__{o}") > F.col(f"__{key}"), F.col(f"__{o}")) for o in others]
        end = F.least(*stops, length)
        return F.when(F.col(f"__{key}").isNotNull(), F.substring(F.col("__t"), F.col(f"__{key}_end"), F.greatest(end - F.col(f"__{key}_end"), F.lit(0))))

    none = F.col("__e").isNull() & F.col("__o").isNull() & F.col("__f").isNull()
    issue = F.when(none, _tidy(F.col("__t"))).otherwise(_tidy(segment("o", "ef")))
    issue = _tidy(F.when(issue.rlike(FIX), F.element_at(F.split(issue, FIX, 2), 1)).otherwise(issue))
    tail = F.substring(F.col("__t"), F.col("__f_end"), length)
    tail = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(tail, r"(?U)^\s+", ""), r"(?iU)^(?:issue|issues)\b", ""), r"(?U)^\s+", ""), "^,", "")
    fields = F.struct(
        label.alias("comment_label"), source.alias("comment_source"), box.alias("bounding_box"), listed.alias("box_numbers"), _without_glue(segment("e", "of")).alias("expected_standard"), issue.alias("observed_issue"),
        F.when(F.col("__f").isNotNull(), _tidy(tail)).alias("suggested_fix"), F.trim(F.regexp_replace(F.translate("__raw", " ", " "), r"(?U)\s+", " ")).alias("raw_text"),
    )
    return step.select(*df.columns, fields.alias(name))


def missing_parts(fields: Column) -> Column:
    """The names of the parts that are null or blank."""
    return F.filter(F.array(*(F.when(F.trim(F.coalesce(fields[p], F.lit(""))) == "", F.lit(p)) for p in PARTS)), lambda x: x.isNotNull())


def patch(comments: DataFrame, corrections: DataFrame, keys: list[str]) -> DataFrame:
    """``comments`` with the values of ``corrections`` (keys, field, value), which may be null: a flag of the match decides, not the value."""
    wide = corrections.groupBy(*keys).agg(*(x for p in PARTS for x in (F.bool_or(F.col("field") == p).alias(f"__has_{p}"), F.max(F.when(F.col("field") == p, F.col("value"))).alias(f"__new_{p}"))))
    out = comments.join(wide, keys, "left")
    for p in PARTS:
        out = out.withColumn(p, F.when(F.col(f"__has_{p}"), F.col(f"__new_{p}")).otherwise(F.col(p)))
    return out.select(*comments.columns)
