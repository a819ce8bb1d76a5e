"""Several values packed in one field: one row per value, with its position.

Quoted spans, bracketed remarks and known labels that themselves hold a delimiter are replaced by indexed placeholders; what is left is split
at the delimiters; the spans are put back by array lookup; the pieces are exploded with their positions. All of it is built-in expressions, row
by row: no shuffle, whatever the size or skew.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Delimiters between values, other than the comma, the line break, numbering and a plus between blanks.
DELIMITERS = (";", "|", "~", "·", "¦", "‖", "\t", "、", "；")
#: A placeholder is OPEN, the span's index, CLOSE. An OPEN of the text itself becomes OPEN + LITERAL, which no placeholder looks like.
OPEN, CLOSE, LITERAL = "\ue000", "\ue001", "\ue002"

_BLANK = r"[\s\p{Z}\x{200B}\x{FEFF}]"
#: What may stand before an opening quote, and after a closing one.
_BEFORE = r"(?<=^|[\[(,;|~·¦‖\t\n、；]|[,;|~·¦‖、；\[][\s\p{Z}]{1,4}|[\n\t][\s\p{Z}]{0,4}(?:[-*•–]|\(?\d{1,3}[.)])[\s\p{Z}]{1,4}|^[\s\p{Z}]{1,4})"
_AFTER = rf"(?={_BLANK}*(?:$|[\],;|~·¦‖\t\n、；]|\(?\d{{1,3}}[.)]\s))"
# The loops over escapes are possessive: Java runs those in a loop, any other group of alternatives in recursion that a long field would overflow.
# They lose no match, for the quote that ends a span is never followed by another one.
# The mark itself is looked for first: what stands before it is looked at nowhere else.
_QUOTED = (
    rf'(?=["\'“„«‘]){_BEFORE}(?:"[^"\\]*+(?:(?:\\.|"")[^"\\]*+)*+"{_AFTER}'
    rf"|'[^'\\]*+(?:(?:\\.|'')[^'\\]*+)*+'{_AFTER}"
    rf"|“[^”]*”{_AFTER}|„[^“”]*[“”]{_AFTER}|«[^»]*»{_AFTER}|‘.*?’{_AFTER})"
)
_REMARK = r"\((?!\d{1,3}\))[^()\n]*\)"
#: Marks before a value: bullets and numbering.
_MARK = rf"^(?:{_BLANK}|[-*•–—‣◦▪●]+(?={_BLANK})|[•‣◦▪●]|\(?\d{{1,3}}[.)](?={_BLANK})|\[\d{{1,3}}\](?={_BLANK})|#\d{{1,3}}[.):]?(?={_BLANK}))++"


def _java(text: str) -> str:
    """``text`` as a literal inside a Java pattern."""
    return re.sub(r"([^\w\s])", r"\\\1", text)


def split_values(df: DataFrame, column: str, name: str, protected: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``name``, the values of ``column`` as array<string>, in order, without empty ones.

    A null gives null; blank text, or delimiters only, gives an empty array. ``protected`` are labels that hold a delimiter and stay whole.
    """
    labels = "".join(f"|{_java(p)}" for p in sorted(protected, key=len, reverse=True))
    spans_re = f"(?s){_QUOTED}|{_REMARK}{labels}"
    escaped = F.replace(F.col(f"`{column}`"), F.lit(OPEN), F.lit(OPEN + LITERAL))
    # A list literal loses its outer brackets.
    body = F.regexp_replace(escaped, rf"(?s)^{_BLANK}*\[({_BLANK}*[\"'].*[\"']{_BLANK}*,?{_BLANK}*)\]{_BLANK}*$", "$1")
    staged = _fixed(df, __body=body)
    staged = _fixed(staged, __spans=F.regexp_extract_all("__body", F.lit(spans_re), F.lit(0)), __between=F.split("__body", spans_re, -1))
    # As many placeholders as spans, and nothing after the last stretch between them.
    marks = F.concat(F.transform(F.sequence(F.lit(1), F.size("__spans")), lambda i: F.concat(F.lit(OPEN), (i - 1).cast("string"), F.lit(CLOSE))), F.array(F.lit("")))
    marks = F.when(F.size("__spans") > 0, marks).otherwise(F.array(F.lit("")))
    masked = F.array_join(F.zip_with("__between", marks, lambda a, b: F.concat(a, b)), "")
    numbering = rf"(?:(?=\()(?<=[\s\p{{Z}}{CLOSE}])\(\d{{1,3}}\)(?=[\s\p{{Z}}])|(?=\d)(?<=[\s\p{{Z}}{CLOSE}])\d{{1,3}}[.)](?=[\s\p{{Z}}]))"
    pieces = F.split(masked, rf"[\n\r,{''.join(_java(d) for d in DELIMITERS)}]|(?=\+)(?<=[\s\p{{Z}}{CLOSE}])\+(?=[\s\p{{Z}}])|{numbering}", -1)

    def restored(piece: Column) -> Column:
        """Each placeholder starts a part; the part's number looks the span up."""
        put_back = lambda p: F.when(
            p.rlike(f"^{OPEN}\\d"), F.concat(F.try_element_at(F.col("__spans"), F.regexp_extract(p, f"^{OPEN}(\\d+)", 1).cast("int") + 1), F.regexp_replace(p, f"^{OPEN}\\d+{CLOSE}", ""))
        ).otherwise(p)
        whole = F.array_join(F.transform(F.split(piece, f"(?={OPEN}\\d)", -1), put_back), "")
        return F.replace(F.when(piece.contains(OPEN), whole).otherwise(piece), F.lit(OPEN + LITERAL), F.lit(OPEN))

    # One pass after the other: what a lambda reads is an element or a column, never an expression that would be worked out again for each element.
    values = F.transform(F.transform(pieces, restored), _trimmed)
    values = F.filter(F.transform(values, lambda v: F.when(v.rlike(_IS_QUOTED) & (F.length(v) > 1), _unquoted(v)).otherwise(v)), lambda v: v != "")
    return staged.select(*df.columns, values.alias(name)) if name not in df.columns else staged.select(*(c for c in df.columns if c != name), values.alias(name))


def _fixed(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with ``columns`` worked out once for each row; a plain projection might be folded into the lambdas that read them."""
    kept = [c for c in df.columns if c not in columns]
    return df.select(*(F.col(f"`{c}`") for c in kept), F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


_IS_QUOTED = r"(?s)^(?:\".*\"|'.*'|“.*”|„.*[“”]|«.*»|‘.*’)$"


def _trimmed(value: Column) -> Column:
    """``value`` without blanks, list marks and numbering."""
    return F.regexp_replace(F.regexp_replace(value, _MARK, ""), rf"{_BLANK}+$", "")


def _unquoted(value: Column) -> Column:
    """``value`` without its enclosing quotes, with the escapes of a quoted value resolved."""

    def resolved(plain: Column) -> Column:
        # \uXXXX and the like are resolved by the JSON reader; a quote inside is escaped for it first.
        as_json = F.concat(F.lit('["'), F.regexp_replace(F.regexp_replace(plain, r"\\'", "'"), r'(?<!\\)"', r'\\"'), F.lit('"]'))
        return F.when(plain.contains("\\"), F.coalesce(F.try_element_at(F.from_json(as_json, "array<string>"), F.lit(1)), plain)).otherwise(plain)

    plain = F.regexp_replace(F.regexp_replace(value, r"(?s)^[\"'“„«‘](.*)[\"'”“»’]$", "$1"), rf"^{_BLANK}+|{_BLANK}+$", "")
    once = F.element_at(F.transform(F.array(plain), resolved), 1)
    return F.when(value.startswith('"'), F.replace(once, F.lit('""'), F.lit('"'))).when(value.startswith("'"), F.replace(once, F.lit("''"), F.lit("'"))).otherwise(once)


def unpack(df: DataFrame, column: str, protected: Sequence[str] = (), pos: str = "pos", value: str = "value_text", count: str = "n_values") -> DataFrame:
    """One row per value of ``column``: the columns of ``df`` and ``pos`` (from 1), ``value`` and ``count``, the number of values in the field.

    Null and blank fields give no row. Existing columns named like the new ones are replaced. Texts of any length are taken whole.
    """
    kept = [c for c in df.columns if c not in (pos, value, count)]
    values = split_values(df, column, "__values", protected)
    out = values.select(*(F.col(f"`{c}`") for c in kept), F.size("__values").alias(count), F.posexplode("__values").alias("__pos", value))
    return out.select(*(F.col(f"`{c}`") for c in kept), (F.col("__pos") + 1).alias(pos), value, count)
