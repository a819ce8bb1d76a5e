"""Leading freely typed values back to the closest entry of a reference list; values that stand for no entry are reported.

A pigeonhole join in SQL only. Each form of a reference entry is cut into k + 1 segments; a text within k edits of it must hold one of the
segments unchanged, shifted by at most k places, so an equality join on substrings and a filter on their positions bring up every candidate.
The built-in levenshtein verifies them, and an anti-join reports what found nothing.

Only distinct values are matched, so a value held by a third of all rows costs one comparison. The reference list is the small side by its
nature; it is broadcast only where its counted size is within BROADCAST_FORMS.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.text import latin, unmark
from assayer.operators.lookup import lookup_join
from assayer.session import cut_lineage

#: Most reference forms that are broadcast; a longer list is joined by a shuffle.
BROADCAST_FORMS = 50_000
#: Words that carry no meaning in a label.
STOP_WORDS = ("the", "a", "an", "of", "and", "to", "with", "in", "at", "for", "on", "by", "my", "our")
#: Most edits looked for; a form of n letters may differ by n / LETTERS_PER_EDIT of them.
MOST_EDITS, LETTERS_PER_EDIT = 4, 2.5


def tidy(value: Column) -> Column:
    """``value`` in lower case without marks on letters and without lookalikes of letters; blanks, _ and the like become one blank."""
    plain = F.lower(latin(unmark(value)))
    return F.trim(F.regexp_replace(plain, r"[\s\p{Z}\p{Cf}_]+", " "))


def tokens(text: Column) -> Column:
    """The words of tidy ``text`` without stop words, each once."""
    return F.array_distinct(F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda w: (w != "") & ~w.isin(*STOP_WORDS)))


def variants(text: Column) -> Column:
    """Readings of tidy ``text``, as array of struct(rank, reading): the whole, then with remarks, numbering and additions taken off."""
    bare = F.trim(F.regexp_replace(text, r"^(?:[^\p{L}\p{N}]|#?\d+[.):]?\s|no\.? ?\d+\s)+|[^\p{L}\p{N}.]+$", ""))
    head = F.trim(F.regexp_replace(bare, r"\s*[(\[].*$", ""))
    inner = F.regexp_extract(bare, r"\(([^()]*\p{L}[^()]*)\)?$", 1)
    clause = F.regexp_replace(head, r"(?:\s*[,;:|]|\s[-–—]\s).*$", "")
    added = F.regexp_replace(head, r"\s+(?:v\.?\d+(?:\.\d+)*|issues?|problems?|\d+(?:st|nd|rd|th)? ed\.?|edition)$", "")
    before = F.regexp_replace(head, r"\s*[/>–—]\s*[^/>–—]*$", "")
    after = F.regexp_replace(bare, r"^.*[/>:–—]\s*", "")
    readings = (text, bare, head, added, clause, before, inner, after)
    return F.filter(F.array(*(F.struct(F.lit(i).alias("rank"), r.alias("reading")) for i, r in enumerate(readings))), lambda v: v["reading"].rlike(r"\p{L}"))


def forms(text: Column) -> Column:
    """Comparable forms of ``text``, as array of struct(kind, form): all words run together, without stop words, and these in sorted order."""
    words = tokens(text)
    return F.array(
        F.struct(F.lit("all").alias("kind"), F.regexp_replace(text, r"[^\p{L}\p{N}]+", "").alias("form")),
        F.struct(F.lit("bare").alias("kind"), F.array_join(words, "").alias("form")),
        F.struct(F.lit("sorted").alias("kind"), F.array_join(F.array_sort(words), "").alias("form")),
    )


def edits_of(form: Column) -> Column:
    """The edits allowed to a reference form, by its length."""
    return F.least(F.lit(MOST_EDITS), F.floor(F.length(form) / F.lit(LETTERS_PER_EDIT))).cast("int")


def _segments(form: Column, k: Column) -> Column:
    """``form`` cut into k + 1 segments of nearly equal length, as array of struct(at, piece), at from 1."""
    n, parts = F.length(form), k + 1
    at = lambda i: F.floor(i * n / parts).cast("int")
    return F.transform(F.sequence(F.lit(0), k), lambda i: F.struct((at(i) + 1).alias("at"), F.substring(form, at(i) + 1, at(i + 1) - at(i)).alias("piece")))


def _substrings(form: Column, n: int) -> Column:
    """All substrings of ``n`` letters, as array of struct(pos, piece)."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(form) - n + 1, F.lit(1)))
    found = F.transform(starts, lambda p: F.struct(p.alias("pos"), F.substring(form, p, F.lit(n)).alias("piece")))
    return F.when(F.length(form) >= n, found).otherwise(F.array().cast("array<struct<pos:int,piece:string>>"))


def match_values(values: DataFrame, reference: DataFrame) -> DataFrame:
    """The entry of ``reference`` (tier, canon_id, label) meant by each of ``values`` (tier, value; distinct): tier, value, canon_id, edits.

    Values that mean none are left out. Of several entries the one with fewest edits is taken, then the plainer reading, then the smaller
    canon_id. Nulls and values without a letter mean none.
    """
    typed = values.where(F.col("value").isNotNull()).select("tier", "value", tidy(F.col("value")).alias("text"))
    entries = reference.where(F.col("label").isNotNull()).select("tier", "canon_id", tidy(F.col("label")).alias("text"))
    # An entry of several parts also goes by its last part, if no other entry has it.
    tails = entries.where(F.col("text").rlike(r"\s/\s")).select("tier", "canon_id", F.regexp_replace("text", r"^.*\s/\s", "").alias("text"))
    shared = tails.unionByName(entries).groupBy("tier", "text").agg(F.count("*").alias("n")).where("n = 1")
    names = entries.unionByName(tails.join(shared.select("tier", "text"), ["tier", "text"], "left_semi").select("tier", "canon_id", "text"))
    entry_forms = (
        names.select("tier", "canon_id", F.size(tokens(F.col("text"))).alias("n_words"), F.explode(forms(F.col("text"))).alias("f"))
        .select("tier", "canon_id", "n_words", "f.kind", "f.form")
        .where(F.length("form") > 0)
        .withColumn("k", edits_of(F.col("form")))
    )
    readings = typed.select("tier", "value", F.explode(variants(F.col("text"))).alias("v")).select("tier", "value", "v.rank", "v.reading")
    # One row per form: the plainest reading that gives it.
    value_forms = (
        readings.select("tier", "value", "rank", F.explode(forms(F.col("reading"))).alias("f"))
        .where(F.length("f.form") > 0)
        .groupBy("tier", "value", "f.kind", "f.form")
        .agg(F.min("rank").alias("rank"))
    )
    # Written once: the plans that read it stay small, and so does what the driver holds of them.
    value_forms, entry_forms = cut_lineage(value_forms), cut_lineage(entry_forms)
    n_forms, longest = entry_forms.agg(F.count("*"), F.max(F.length("form"))).first()
    small = n_forms <= BROADCAST_FORMS
    # Longer forms are out of reach of any entry.
    value_forms = value_forms.where(F.length("form") <= (longest or 0) + MOST_EDITS)
    side = F.broadcast if small else (lambda df: df)

    # Exact forms first: most values end here.
    exact = value_forms.join(side(entry_forms.select("tier", "kind", "form", "canon_id")), ["tier", "kind", "form"]).select(
        "tier", "value", "canon_id", F.lit(0).alias("edits"), "rank"
    )
    settled = cut_lineage(_best(exact))
    open_forms = value_forms.join(settled.select("tier", "value"), ["tier", "value"], "left_anti")

    pieces = entry_forms.select("tier", "kind", "canon_id", "k", F.col("form").alias("entry"), F.explode(_segments(F.col("form"), F.col("k"))).alias("s"))
    pieces = cut_lineage(pieces.select("tier", "kind", "canon_id", "k", "entry", "s.at", "s.piece"))
    lengths = [r[0] for r in pieces.select(F.length("piece").alias("n")).distinct().collect()] or [1]
    windows = F.flatten(F.array(*(_substrings(F.col("form"), n) for n in sorted(lengths))))
    probes = open_forms.select("tier", "kind", "value", "rank", "form", F.explode(windows).alias("w")).select("tier", "kind", "value", "rank", "form", "w.pos", "w.piece")
    candidates = (
        probes.join(side(pieces), ["tier", "kind", "piece"])
        .where((F.abs(F.col("pos") - F.col("at")) <= F.col("k")) & (F.abs(F.length("form") - F.length("entry")) <= F.col("k")))
        .withColumn("edits", F.levenshtein("form", "entry", MOST_EDITS))
        .where((F.col("edits") >= 0) & (F.col("edits") <= F.col("k")))
        .select("tier", "value", "canon_id", "edits", "rank")
    )
    near = cut_lineage(_best(candidates))
    short = _shortened(readings.join(settled.select("tier", "value"), ["tier", "value"], "left_anti"), entries, side)
    found = near.unionByName(short.join(near.select("tier", "value"), ["tier", "value"], "left_anti"))
    return settled.unionByName(found).select("tier", "value", "canon_id", "edits")


def _best(candidates: DataFrame) -> DataFrame:
    best = F.min(F.struct("edits", "rank", "canon_id"))
    return candidates.groupBy("tier", "value").agg(best.alias("b")).select("tier", "value", "b.canon_id", "b.edits")


def _shortened(readings: DataFrame, entries: DataFrame, side) -> DataFrame:
    """Values whose words are beginnings of the words of just one entry: "Build. Blocks", "Marlow guide".

    The equality join is on the first three letters of the first word; as many words in the same order, or for an entry whose first word is
    its own in its tier the first word and any of the others.
    """
    own = entries.withColumn("words", tokens(F.col("text"))).where(F.size("words") > 0)
    first = own.groupBy("tier", F.element_at("words", 1).alias("first")).agg(F.count("*").alias("same_first"))
    own = own.withColumn("first", F.element_at("words", 1)).join(first, ["tier", "first"])
    own = own.select("tier", "canon_id", F.col("words").alias("entry"), "same_first", F.substring("first", 1, 3).alias("start"))
    typed = readings.withColumn("words", tokens(F.col("reading"))).where(F.size("words") > 0)
    typed = typed.withColumn("start", F.substring(F.element_at("words", 1), 1, 3))
    both = typed.join(side(own), ["tier", "start"])
    begins = lambda whole, cut: whole.startswith(cut) | (F.levenshtein(F.substring(whole, F.lit(1), F.length(cut)), cut) <= F.when(F.length(cut) >= 5, 2).otherwise(0))
    same_words = (F.size("words") == F.size("entry")) & F.forall(F.zip_with("entry", "words", lambda e, w: begins(e, w) & (F.length(w) >= 3)), lambda ok: ok)
    leading = (
        (F.col("same_first") == 1)
        & (F.size("words") < F.size("entry"))
        & (F.element_at("words", 1) == F.element_at("entry", 1))
        & (F.length(F.element_at("words", 1)) >= 5)
        & F.forall("words", lambda w: F.array_contains(F.col("entry"), w))
    )
    hits = both.where(same_words | leading).select("tier", "value", "canon_id", "rank").distinct()
    one = hits.groupBy("tier", "value").agg(F.min("canon_id").alias("canon_id"), F.countDistinct("canon_id").alias("n"))
    return one.where("n = 1").select("tier", "value", "canon_id", F.lit(0).alias("edits"))


def map_to_reference(rows: DataFrame, reference: DataFrame, key: str, fields: Sequence[str], none_id: int = -1) -> DataFrame:
    """One row per row of ``rows`` and field of ``fields`` with a value that is no label as it stands: key, field_name, canon_id.

    ``reference`` has tier (one of ``fields``), canon_id and label. canon_id is the entry meant, ``none_id`` if the value stands for none.
    Null and blank values, and values that are a label character for character, are no cases. Repeated rows give repeated results. An empty
    reference gives ``none_id`` throughout.
    """
    reference = reference.select("tier", "canon_id", "label")
    pairs = ", ".join(f"'{f}', `{f}`" for f in fields)
    long = rows.select(F.col(f"`{key}`").alias("key"), *(F.col(f"`{f}`").cast("string").alias(f) for f in fields)).selectExpr("key", f"stack({len(fields)}, {pairs}) AS (tier, value)")
    long = long.where(F.col("value").rlike(r"[^\s\p{Z}]"))
    counted = long.groupBy("tier", "value").agg(F.count("*").alias("n"))
    labels = reference.select("tier", F.col("label").alias("value")).distinct()
    counted = cut_lineage(counted.join(labels, ["tier", "value"], "left_anti"))
    matched = cut_lineage(match_values(counted.select("tier", "value"), reference))
    unmatched = counted.join(matched, ["tier", "value"], "left_anti").select("tier", "value", F.lit(none_id).alias("canon_id"))
    mapping = matched.select("tier", "value", "canon_id").unionByName(unmatched).join(counted, ["tier", "value"])
    cases = lookup_join(long, mapping, ["tier", "value"], "n", rows.count() * len(fields))
    return cases.select(F.col("key").alias(key), F.col("tier").alias("field_name"), F.col("canon_id").cast("int").alias("canon_id"))
