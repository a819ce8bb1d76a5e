"""Text folding as built-in column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _table() -> tuple[str, str]:
    """Letters with marks up to U+024F and full-width forms, each with its plain character, built from their Unicode decompositions."""
    pairs = []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F), 0x3000]:
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(plain) == 1 and plain != chr(code):
            pairs.append((chr(code), plain))
    pairs += zip("øØłŁđĐ", "oOlLdD")
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


MARKED, UNMARKED = _table()
#: Cyrillic letters that are drawn like a Latin one. Fixed values.
LOOKALIKE, LATIN = "аеосрхуіјѕкмтнвАЕОСРХУІЈЅКМТНВ", "aeocpxyijskmthbAEOCPXYIJSKMTHB"


def unmark(text: Column) -> Column:
    """``text`` without combining marks; letters with marks and full-width characters become plain ones."""
    return F.translate(F.regexp_replace(text, r"\p{M}", ""), MARKED, UNMARKED)


def latin(text: Column) -> Column:
    """``text`` with Cyrillic lookalikes replaced."""
    return F.translate(text, LOOKALIKE, LATIN)
