"""Citations of guidelines led to source, category, subcategory and evidence.

``parse_references`` takes a field as people and models write it: a list or an object in JSON or as a Python literal, or free text in which sources are mentioned.
How a citation is read depends on its source: by numbered headings with other wordings, by a tree of categories, or by its first segment (see ``Source``).
All of it is built-in expressions, row by row; only literals that are no JSON go through Python.

``longest_match`` looks distinct texts up in a vocabulary of any size by joins.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.scalars import clean_phrase, clean_reference, normalize_key, python_literal

DELIMITER = r"\s*(?:—|–|>|/|\\|:)\s*"
#: Most rows of a vocabulary that are broadcast.
MOST_KEYS = 20_000
#: Most keys of a source that a parser's expressions hold; a larger vocabulary is a table for ``longest_match``.
MOST_OWN_KEYS = 5_000

# ---- Fixed values: the sources as they are written, and what they hold.

#: How the sources are written in texts, longer wordings first, and as the value of a field.
MENTIONS = {
    "Apple Human Interface Guidelines (HIG)": "Apple HIG", "Apple Human Interface Guidelines": "Apple HIG", "Apple HIG": "Apple HIG",
    "Nielsen Norman 10 Heuristics": "Nielsen", "Nielsen Norman Group": "Nielsen", "Nielsen Norman Heuristics": "Nielsen", "Nielsen Norman Heuristic": "Nielsen",
    "Nielsen Norman": "Nielsen", "NN/g": "Nielsen", "Nielsen": "Nielsen",
    "CrowdCrit Visual Design Critiques": "CrowdCrit", "CrowdCrit Visual Design": "CrowdCrit", "CrowdCrit": "CrowdCrit", "CrowCrit": "CrowdCrit",
}
HEURISTICS = (
    "Visibility of System Status", "Match Between the System and the Real World", "User Control and Freedom", "Consistency and Standards", "Error Prevention",
    "Recognition Rather than Recall", "Flexibility and Efficiency of Use", "Aesthetic and Minimalist Design", "Help Users Recognize, Diagnose, and Recover from Errors", "Help and Documentation",
)
_ERRORS = "Help Users Recognize, Diagnose, and Recover from Errors"
HEURISTIC_ALIASES = {
    "minimize user memory load": "Recognition Rather than Recall",
    "error recovery": _ERRORS,
    "match between system and the real world": "Match Between the System and the Real World",
    "match between system and real world": "Match Between the System and the Real World",
    "feedback": "Visibility of System Status",
    "Prevent errors": "Error Prevention",
    "efficiency of use": "Flexibility and Efficiency of Use",
    "visibility of system state": "Visibility of System Status",
    "aesthetics and minimalist design": "Aesthetic and Minimalist Design",
    "focus and minimalist design": "Aesthetic and Minimalist Design",
    "help users recognize and recover from errors": _ERRORS,
    "help users recognize and recover": _ERRORS,
    "Help users recognize, diagnose information": _ERRORS,
    "Help users recognize and understand": _ERRORS,
    "Help users recognize and recover from ambiguity": _ERRORS,
    "Help users recognize, diagnose…": _ERRORS,
    "Help Users Recognize, Diagnose, and Recover": _ERRORS,
    "Help users recognize, diagnose actions": _ERRORS,
    "help users recover from errors": _ERRORS,
    "help users prevent errors": "Error Prevention",
}
TREE = {
    "Foundations": (
        "App icons", "Branding", "Color", "Dark Mode", "Icons", "Images", "Immersive experiences", "Inclusion", "Layout", "Materials", "Motion", "Privacy", "Right to left",
        "SF Symbols", "Spatial layout", "Typography", "Writing",
    ),
    "Patterns": (
        "Charting Data", "Collaboration and Sharing", "Drag and Drop", "Entering Data", "Feedback", "File Management", "Going Full Screen", "Launching", "Live-Viewing Apps", "Loading",
        "Managing Accounts", "Managing Notifications", "Modality", "Multitasking", "Offering Help", "Onboarding", "Playing Audio", "Playing Haptics", "Playing Video", "Printing",
        "Ratings and Reviews", "Searching", "Settings", "Undo and Redo", "Workouts",
    ),
    "Components": {
        "Content": ("Charts", "Image Views", "Text Views", "Web Views"),
        "Layout and Organization": ("Boxes", "Collections", "Column Views", "Disclosure Controls", "Labels", "Lists and Tables", "Lockups", "Outline Views", "Split Views", "Tab Views"),
        "Menus and Actions": ("Activity Views", "Buttons", "Context Menus", "Dock Menus", "Edit Menus", "Home Screen Quick Actions", "Menus", "Going Full Screen", "Ornaments", "Pop-up Buttons", "Pull-down Buttons", "The Menu Bar", "Toolbars"),
        "Navigation and Search": ("Path Controls", "Search Fields", "Sidebars", "Tab Bars", "Token Fields"),
        "Presentation": ("Action Sheets", "Alerts", "Page Controls", "Panels", "Popovers", "Scroll Views", "Sheets", "Windows"),
        "Selection and Input": ("Color Wells", "Combo Boxes", "Digit Entry Views", "Image Wells", "Pickers", "Segmented Controls", "Sliders", "Steppers", "Text Fields", "Toggles", "Virtual Keyboards"),
        "Status": ("Activity Rings", "Gauges", "Progress Indicators", "Rating Indicators"),
        "System Experiences": ("App Shortcuts", "Complications", "Controls", "Live Activities", "Notifications", "Snippets", "Status Bars", "Top Shelf", "Watch Faces", "Widgets"),
    },
    "Inputs": (
        "Action Button", "Apple Pencil and Scribble", "Camera Control", "Digital Crown", "Eyes", "Focus and Selection", "Game Controls", "Gestures", "Gyroscope and Accelerometer",
        "Keyboards", "Nearby Interactions", "Pointing Devices", "Remotes",
    ),
    "Technologies": (
        "AirPlay", "Always On", "App Clips", "Apple Pay", "Augmented Reality", "CareKit", "CarPlay", "Game Center", "Generative AI", "HealthKit", "HomeKit", "iCloud", "ID Verifier",
        "iMessage Apps and Stickers", "In-App Purchase", "Live Photos", "Mac Catalyst", "Machine Learning", "Maps", "NFC", "Photo Editing", "ResearchKit", "SharePlay", "ShazamKit",
        "Sign in with Apple", "Siri", "Tap to Pay on iPhone", "VoiceOver", "Wallet",
    ),
}
#: Two lists of further wordings; the second overrides the first.
TREE_ALIASES = (
    ("color and contrast", "Foundations", "Color"), ("visual design", "Foundations", "Layout"), ("touch targets", "Inputs", "Gestures"), ("navigation bars", "Components", "Navigation and Search"),
    ("clarity", "Foundations", "Writing"), ("search", "Patterns", "Searching"), ("navigation", "Components", "Navigation and Search"), ("typography and color", "Foundations", "Typography"),
    ("table views", "Components", "Lists and Tables"), ("writing and terminology", "Foundations", "Writing"), ("lists", "Components", "Lists and Tables"),
    ("Iconography", "Foundations", "Icons"), ("Terminology", "Foundations", "Writing"), ("Requesting Permission", "Foundations", "Privacy"), ("touch target", "Foundations", "Layout"),
    ("touch targets", "Foundations", "Layout"), ("writing and terminology", "Foundations", "Writing"), ("typography and color", "Foundations", "Typography"),
    ("color and contrast", "Foundations", "Color"), ("Data Entry", "Patterns", "Entering Data"), ("search", "Patterns", "Searching"), ("Authentication", "Patterns", "Managing Accounts"),
    ("Sharing", "Patterns", "Collaboration and Sharing"), ("text input", "Components", "Selection and Input / Text Fields"), ("Secure Text Entry", "Components", "Selection and Input / Text Fields"),
    ("Secure Text Field", "Components", "Selection and Input / Text Fields"), ("Switches", "Components", "Selection and Input / Toggles"),
    ("Tables", "Components", "Layout and Organization / Lists and Tables"), ("table views", "Components", "Layout and Organization / Lists and Tables"),
    ("navigation bars", "Components", "Navigation and Search"), ("navigation", "Components", "Navigation and Search"), ("Lists", "Components", "Layout and Organization / Lists and Tables"),
    ("Table views", "Components", "Layout and Organization / Lists and Tables"), ("Page Control", "Components", "Presentation / Page Controls"),
    ("Disclosure Indicators", "Components", "Layout and Organization / Disclosure Controls"),
)

# ---- end of fixed values


@dataclass(frozen=True)
class Source:
    """A source of guidelines and how its citations are read.

    ``rule`` is "heuristic" (the longest key contained names the category, the rest is evidence), "tree" (of the segments the one that names a subcategory wins over
    one that names a category, a later one over an earlier, the others are evidence) or "theme" (the first segment is the category, the others are evidence).
    ``mentions`` are its wordings in texts. ``keys`` leads a wording to (category, subcategory); of wordings that come to the same key the last one's value counts.
    """

    name: str
    rule: str
    mentions: tuple[str, ...]
    keys: dict[str, tuple[str, str | None]] = field(default_factory=dict)

    def vocabulary(self) -> list[dict]:
        """The keys, normalised, longer ones first, among equally long ones in their order."""
        found: dict[str, tuple[str, str | None]] = {}
        for wording, value in self.keys.items():
            found[plain_key(wording)] = value
        if len(found) > MOST_OWN_KEYS:
            raise ValueError(f"{self.name} has more than {MOST_OWN_KEYS} keys: look them up with longest_match")
        rows = [{"key": k, "category": c, "subcategory": s} for k, (c, s) in found.items() if k]
        return sorted(rows, key=lambda r: -len(r["key"]))


def plain_key(text: str) -> str:
    """``scalars.normalize_key`` of a plain string."""
    return re.sub(r"[^a-z0-9]+", " ", text.strip().strip(" .;").lower().replace("&", "and")).strip()


def standard_sources() -> list[Source]:
    """The three sources of MENTIONS, with what they hold."""
    tree: dict[str, tuple[str, str | None]] = {}
    for top, children in TREE.items():
        for group, items in children.items() if isinstance(children, dict) else ((None, children),):
            if group:
                tree[group] = (top, group)
            for item in items:
                tree[item] = (top, f"{group} / {item}" if group else item)
                if group:
                    tree[f"{group} {item}"] = (top, f"{group} / {item}")
    # A wording that comes again keeps its first place and takes the last value.
    held: dict[str, tuple[str, str | None]] = {plain_key(k): v for k, v in tree.items()}
    for wording, top, sub in TREE_ALIASES:
        held[plain_key(wording)] = (top, sub)
    tops = {f"{top}": (top, None) for top in TREE}
    written = lambda name: tuple(m for m, s in MENTIONS.items() if s == name)
    return [
        Source("Apple HIG", "tree", written("Apple HIG"), held | {k: v for k, v in tops.items() if plain_key(k) not in held}),
        Source("Nielsen", "heuristic", written("Nielsen"), {h: (h, None) for h in HEURISTICS} | {k: (v, None) for k, v in HEURISTIC_ALIASES.items()}),
        Source("CrowdCrit", "theme", written("CrowdCrit")),
    ]


def catalog_sources(rows: Sequence) -> list[Source]:
    """Sources from the rows of a table of labels (tier, source, category, label): a tree where there are subcategories, headings where a name says heuristics, else themes."""
    out = []
    for name in sorted({r["source"] for r in rows}):
        own = [r for r in rows if r["source"] == name and r["tier"] != "source"]
        keys = {r["label"]: (r["category"] or r["label"], r["label"] if r["tier"] == "subcategory" else None) for r in sorted(own, key=lambda r: r["canon_id"])}
        rule = "tree" if any(s for _, s in keys.values()) else "heuristic" if "heuristic" in name.lower() else "theme"
        out.append(Source(name, rule, (name,), keys))
    return out


_FOUND = "struct<category:string,subcategory:string,evidence:string,raw_reference:string>"


def _longest(key: Column, source: Source, only: str | None = None) -> Column:
    """The first entry (key, category, subcategory) of the vocabulary that ``key`` holds, null if none; an equal key is the longest there can be."""
    rows = [r for r in source.vocabulary() if only is None or (r["subcategory"] is None) == (only == "category")]
    entries = F.from_json(F.lit(json.dumps(rows)), "array<struct<key:string,category:string,subcategory:string>>")
    return F.get(F.filter(entries, lambda e: key.contains(e["key"])), 0)


def _bound(value: Column, use) -> Column:
    """``use(value)``, with ``value`` worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _segments(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, DELIMITER), clean_phrase), lambda p: p != "")


def _result(category: Column, subcategory: Column, evidence: Column, text: Column) -> Column:
    return F.struct(category.alias("category"), subcategory.cast("string").alias("subcategory"), F.nullif(evidence, F.lit("")).alias("evidence"), text.alias("raw_reference"))


def _heuristic(piece: Column, source: Source) -> Column:
    numbered = r"(?is)^Heuristic\s+\d+\s*\(\s*([^)]*?)\s*\)\s*(.*)$"

    def whole(text: Column) -> Column:
        name, rest = F.regexp_extract(text, numbered, 1), F.regexp_extract(text, numbered, 2)
        return F.when(text.rlike(numbered), clean_phrase(F.when(rest != "", F.concat(name, F.lit(" — "), rest)).otherwise(name))).otherwise(text)

    def read(text: Column) -> Column:
        def found(hit: Column) -> Column:
            # The words of the key, whatever stands between them, are taken out once, and then one delimiter.
            phrase = F.concat(F.lit("(?i)"), F.replace(hit["key"], F.lit(" "), F.lit("[^a-zA-Z0-9]+")))
            without = clean_phrase(F.array_join(F.split(text, phrase, 2), ""))
            rest = clean_phrase(F.array_join(F.split(without, DELIMITER, 2), " "))
            none = F.lit(None).cast("string")
            return F.when(hit.isNull(), _result(text, none, none, text)).otherwise(_result(hit["category"], none, rest, text))

        return _bound(_longest(normalize_key(text), source), found)

    return _bound(_bound(clean_reference(piece), whole), read)


def _tree(piece: Column, source: Source) -> Column:
    def read(text: Column) -> Column:
        def chosen(parts: Column) -> Column:
            told = F.transform(parts, lambda p, i: F.struct(_longest(normalize_key(p), source, "subcategory").alias("sub"), _longest(normalize_key(p), source, "category").alias("top"), i.alias("at")))
            ranked = F.filter(F.transform(told, lambda x: F.struct(F.when(x["sub"].isNotNull(), 2).otherwise(1).alias("rank"), x["at"].alias("at"), F.coalesce(x["sub"], x["top"]).alias("hit"))), lambda x: x["hit"].isNotNull())

            def out(best: Column) -> Column:
                at = F.coalesce(best["at"], F.lit(0))
                others = F.array_join(F.filter(parts, lambda p, i: i != at), "; ")
                return _result(F.coalesce(best["hit"]["category"], F.get(parts, F.lit(0))), best["hit"]["subcategory"], others, text)

            # The place is unlike for all, so the entry itself is never compared.
            return _bound(F.array_max(ranked), out)

        return _bound(F.when(F.size(_segments(text)) > 0, _segments(text)).otherwise(F.array(text)), chosen)

    return _bound(clean_reference(piece), read)


def _theme(piece: Column) -> Column:
    def read(text: Column) -> Column:
        return _bound(_segments(text), lambda parts: _result(F.coalesce(F.get(parts, F.lit(0)), text), F.lit(None), F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), "; "), text))

    return _bound(clean_reference(piece), read)


def _read(piece: Column, source: Source) -> Column:
    """The struct of one citation of ``source``."""
    return _heuristic(piece, source) if source.rule == "heuristic" else _tree(piece, source) if source.rule == "tree" else _theme(piece)


def _pieces(chunk: Column, source: Source) -> Column:
    """The citations in what follows a mention: cut at bars, at a period before a capital letter, and at semicolons before a citation that is recognised."""
    cut = F.filter(F.transform(F.split(clean_phrase(chunk), r"\||\.\s+(?=[A-Z])"), clean_phrase), lambda p: p != "")
    begins = (lambda p: F.lit(True)) if source.rule == "theme" else (lambda p: _longest(normalize_key(p), source).isNotNull())

    def rejoined(part: Column) -> Column:
        pieces = F.filter(F.transform(F.split(part, ";"), clean_phrase), lambda p: p != "")
        # Each piece that begins no citation is hung onto the one before it.
        marked = F.transform(pieces, lambda p, i: F.concat(F.when(i == 0, "").when(begins(p), "\x01").otherwise("; "), p))
        return F.filter(F.split(F.array_join(marked, ""), "\x01"), lambda p: p != "")

    out = F.flatten(F.transform(cut, rejoined))
    if source.rule == "heuristic":
        out = F.filter(F.flatten(F.transform(out, lambda p: F.split(p, r"(?i),\s*(?=Heuristic\s+\d+\b)"))), lambda p: clean_phrase(p) != "")
    return out


def parse_references(df: DataFrame, text: str, key: str, sources: Sequence[Source]) -> DataFrame:
    """One row per citation of ``text``: key, mention, piece, source, category, subcategory, evidence, raw_reference.

    ``mention`` is the place of the element or of the mention in the field, ``piece`` that of the citation after its mention, both from 1.

    A field that is a list or an object: its elements with the fields source, category and evidence; the category is read by the rule of the source, given
    evidence is kept, a source that is unknown keeps its name and has no category, and an element that is no object has no source either.
    Any other text: the citations after each mention of a source. Null and blank fields, and texts without a mention, give no row.
    """
    by_mention = {m.lower(): s.name for s in sources for m in s.mentions}
    pattern = "(?i)(" + "|".join(r"\Q" + m + r"\E" for m in sorted(by_mention, key=len, reverse=True)) + ")"
    lookup = lambda table: F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    as_text = F.col(f"`{text}`").cast("string")
    rows = df.select(F.col(f"`{key}`").alias(key), clean_phrase(as_text).alias("__t"))
    rows = rows.withColumn("__is", F.col("__t").rlike(r"^[\[{]"))
    rows = rows.withColumn("__json", F.when(F.col("__is") & F.try_parse_json("__t").isNotNull(), F.col("__t")))
    rows = rows.withColumn("__json", F.coalesce("__json", python_literal(F.when(F.col("__is") & F.col("__json").isNull(), F.col("__t")))))
    # What looks like a list and can be read as none is free text.
    wrapped = F.when(F.col("__json").startswith("{"), F.concat(F.lit("["), "__json", F.lit("]"))).otherwise(F.col("__json"))
    elements = F.from_json(wrapped, "array<string>")
    given = rows.where("__json IS NOT NULL").select(key, F.posexplode(elements).alias("__a", "__e"), F.lit(0).alias("__b"))
    is_object = F.col("__e").startswith("{")
    said = F.get_json_object("__e", "$.source")
    name = F.coalesce(F.try_element_at(lookup({plain_key(m): s for m, s in by_mention.items()}), normalize_key(F.coalesce(said, F.lit("")))), F.nullif(clean_phrase(said), F.lit("")))
    given = given.select(
        key, "__a", "__b", F.when(is_object, name).alias("source"), clean_phrase(F.when(is_object, F.get_json_object("__e", "$.category")).otherwise(F.col("__e"))).alias("__p"),
        F.when(is_object, F.nullif(F.get_json_object("__e", "$.evidence"), F.lit(""))).alias("__ev"),
    )
    free = rows.where("__json IS NULL AND __t <> ''").select(key, F.regexp_extract_all("__t", F.lit(pattern), F.lit(1)).alias("__m"), F.split("__t", pattern, -1).alias("__c")).where(F.size("__m") > 0)
    chunks = free.select(key, F.posexplode(F.zip_with("__m", F.slice("__c", 2, F.size("__m")), lambda m, c: F.struct(F.try_element_at(lookup(by_mention), F.lower(m)).alias("source"), c.alias("chunk")))).alias("__a", "__z"))
    pieces = F.coalesce(*(F.when(F.col("__z.source") == s.name, _pieces(F.col("__z.chunk"), s)) for s in sources))
    cited = chunks.select(key, "__a", F.col("__z.source").alias("source"), F.posexplode(pieces).alias("__b", "__p")).select(key, "__a", "__b", "source", "__p", F.lit(None).cast("string").alias("__ev"))
    both = given.unionByName(cited)
    none = F.lit(None).cast("string")
    found = F.coalesce(*(F.when(F.col("source") == s.name, _read(F.col("__p"), s)) for s in sources), _result(none, none, none, F.col("__p")))
    read = both.select(key, (F.col("__a") + 1).alias("mention"), (F.col("__b") + 1).alias("piece"), "source", "__ev", found.alias("__f"))
    return read.select(key, "mention", "piece", "source", "__f.category", "__f.subcategory", F.coalesce("__ev", "__f.evidence").alias("evidence"), "__f.raw_reference")


def vocabulary(catalog: DataFrame, source: str = "source", category: str = "category", label: str = "label") -> DataFrame:
    """A vocabulary from a table of labels in two tiers: categories of a source, and subcategories with their category."""
    text = F.col(label)
    sub = F.when(F.col("tier") == "subcategory", text)
    return catalog.where("tier <> 'source'").select(F.col(source).alias("source"), normalize_key(text).alias("key"), F.coalesce(F.col(category), text).alias("category"), sub.alias("subcategory"), F.col("canon_id").alias("pos"))


def cited(df: DataFrame, text: str, sources: list[str]) -> DataFrame:
    """``df`` once for each mention of one of ``sources`` in ``text``: source, chunk (what follows up to the next mention) and mention (from 1)."""
    pattern = "(?i)(" + "|".join(r"\Q" + s + r"\E" for s in sorted(sources, key=len, reverse=True)) + ")"
    names = F.create_map(*(x for s in sources for x in (F.lit(s.lower()), F.lit(s))))
    found = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1))
    after = F.slice(F.split(F.col(text), pattern, -1), 2, F.greatest(F.size(found), F.lit(0)))
    out = df.select("*", F.posexplode(F.arrays_zip(found.alias("s"), after.alias("c"))).alias("mention", "__z"))
    return out.withColumn("mention", F.col("mention") + 1).withColumn("source", F.try_element_at(names, F.lower("__z.s"))).withColumn("chunk", clean_phrase(F.col("__z.c"))).drop("__z")


def longest_match(texts: DataFrame, vocab: DataFrame, key: str) -> DataFrame:
    """``texts`` (source, key) with category, subcategory and the matched key of ``vocab``: the same key, else the longest one contained; nulls if none.

    Distinct texts are matched once and joined back. Keys are found by an equality join on their first word, so no text meets the whole vocabulary.
    """
    small = vocab.count() <= MOST_KEYS
    side = vocab.select("source", F.col("key").alias("v_key"), "category", "subcategory", "pos").withColumn("word", F.element_at(F.split("v_key", " "), 1)).where("v_key <> ''")
    own = texts.select("source", key).where(F.col(key).isNotNull()).distinct()
    words = own.select("source", key, F.explode(F.array_distinct(F.split(key, " "))).alias("word"))
    met = words.join(F.broadcast(side) if small else side, ["source", "word"]).where(F.concat(F.lit(" "), key, F.lit(" ")).contains(F.concat(F.lit(" "), F.col("v_key"), F.lit(" "))))
    best = F.max(F.struct((F.col(key) == F.col("v_key")).alias("same"), F.length("v_key").alias("n"), (-F.col("pos")).alias("p"), "category", "subcategory", "v_key"))
    found = met.groupBy("source", key).agg(best.alias("b")).select("source", key, "b.category", "b.subcategory", F.col("b.v_key").alias("matched"))
    return texts.join(found, ["source", key], "left")
