"""Evaluation items that stand, wholly or in part, in a training corpus.

Spaced seeds: a mask picks some of a few neighbouring words and ignores the others, so a hash over the picked words still meets its counterpart when
an ignored word was changed. The hashes of all items at all masks are joined with those of the documents, and around the hits the words are aligned
with room for single words changed, added or left out. An alignment counts by its length, or, where more of it was changed, by how much the
shared words say: what is usual in the items after the word before it says little, so turns of phrase that many texts share are no leak.

The corpus is read once, whatever the number of items. Items of up to BROADCAST_CHARS characters (counted beforehand) are sent to every executor, and documents
never leave the task that reads them. A larger table is joined by shuffle: the hashes of the documents, thinned by a bitmap of fixed size, meet those of
the items, and hashes that many items share are split. Both ways give the same result.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions.text import LATIN, LOOKALIKE
from assayer.operators.lookup import lookup_join
from assayer.session import cut_lineage

#: Characters of evaluation text up to which the items are broadcast; beyond, they are joined by shuffle.
BROADCAST_CHARS = 1_000_000
#: Distinct words of evaluation text that the executors hold for reading documents; beyond, the items are dealt into groups and the corpus is read once for each.
MOST_WORDS = 1_000_000
#: Offsets of the words that a seed picks.
MASKS = ((0, 1, 2, 3), (0, 1, 3, 4), (0, 1, 2, 4), (0, 2, 3, 4), (0, 1, 4, 5), (0, 2, 3, 5), (0, 1, 3, 5), (0, 2, 4, 6))
#: A leak is so many running words of an item.
LEAST_WORDS = 15
#: Hits around one place of an item from which it is looked at: fifteen words with any four of them changed still give as many.
LEAST_HITS = 4
#: Words on either side of the hits of one passage that are aligned with it.
AROUND = 15
#: Intact or nearly so: what an error costs against an equal word's 1, the least sum and share of equal words, and how many others may stand between two of them.
ERROR_COST, LEAST_SCORE, LEAST_SHARE, WIDE_GAP = 0.8, 13.0, 0.55, 2
#: With more errors, each a single word: the least share of equal words, and the bits they must have. A chance passage of so many bits is met
#: once in thirty million places; words of free text have six to ten bits each, those of a template near none.
CHANGED_SHARE, LEAST_BITS = 0.7, 25.0
#: Entries of the bitmap of item hashes (of one bit each) that thins the documents' hashes before they are shuffled.
BITMAP = 1 << 29
#: Items that share a hash, by row of the joined table.
SHARERS = 64

_SILENT = {c: None for c in (*range(0x300, 0x370), 0xAD, *range(0x200B, 0x2010), 0x2060, 0xFEFF, 0x27, 0x2018, 0x2019, 0x60, 0xB4, 0x2BC)}
_FOLD = _SILENT | dict(zip(map(ord, LOOKALIKE), LATIN))
_WORD = re.compile(r"[^\W_]+")
#: A word with the characters that are nothing inside it.
_TOKEN = re.compile("[^\\W_](?:[^\\W_]|[" + "".join(map(re.escape, map(chr, _SILENT))) + "])*")
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)


def _folded(token: str) -> list[str]:
    return _WORD.findall(unicodedata.normalize("NFKD", token).translate(_FOLD).casefold())


def words_of(text: str) -> list[str]:
    """The words of ``text`` apart from case, marks on letters, apostrophes, invisible characters and lookalikes."""
    return [w for token in _TOKEN.findall(text) for w in _folded(token)]


class Vocabulary:
    """The words of the items, numbered, and a reader that leads the words of a text back to them."""

    def __init__(self, words: list[str]):
        self.number = {w: i for i, w in enumerate(sorted(words))}
        # A form that several words are shortened to stands for the first of them.
        self.near: dict[str, int] = {}
        for w, i in self.number.items():
            if len(w) >= 5:
                for form in _shortened(w):
                    self.near.setdefault(form, i)
        self.longest = max(map(len, self.number), default=0)
        #: Tokens of one word, and the others (such as a fraction).
        self.cache: dict[str, int] = {}
        self.others: dict[str, list[int]] = {}

    def __getstate__(self):
        return sorted(self.number)

    def __setstate__(self, words):
        self.__init__(words)

    def read(self, text: str) -> np.ndarray:
        """The words of ``text`` as numbers, -1 for others. A longer word with one damaged place counts as the word meant."""
        tokens, cache, others = _TOKEN.findall(text), self.cache, self.others
        if len(cache) > 500_000:
            cache.clear()
            others.clear()
        kinds = set(tokens)
        for token in kinds:
            if token not in cache:
                numbers = [self._number(w) for w in _folded(token)]
                cache[token] = numbers[0] if len(numbers) == 1 else -1
                if len(numbers) != 1:
                    others[token] = numbers
        if others and not kinds.isdisjoint(others):
            return np.array([n for token in tokens for n in others.get(token, (cache[token],))], dtype=np.int64)
        return np.fromiter(map(cache.__getitem__, tokens), dtype=np.int64, count=len(tokens))

    def _number(self, w: str) -> int:
        if w in self.number:
            return self.number[w]
        # A word that is longer than any of the items' by two is none of them.
        if 4 <= len(w) <= self.longest + 1:
            for form in _shortened(w):
                if form in self.near:
                    return self.near[form]
        return -1


def _shortened(word: str) -> Iterator[str]:
    """``word`` and the word without each of its letters: two words that differ in one place share one of them."""
    yield word
    for i in range(len(word)):
        yield word[:i] + word[i + 1 :]


def information(lists: list[np.ndarray]) -> list[np.ndarray]:
    """The bits of each word of the items: how rare it is in the other items, by itself or after the word before it, whichever is less."""
    single, pairs = Counter(), Counter()
    for ws in lists:
        w = ws.tolist()
        single.update(set(w))
        pairs.update(set(zip(w, w[1:])))
    out = []
    for ws in lists:
        w = ws.tolist()
        alone = [_rare(single[x], len(lists)) for x in w]
        out.append(np.array([min(a, _after(pairs[p, x], single[p], a)) if p is not None else a for p, x, a in zip([None, *w], w, alone)]))
    return out


def _rare(n: int, items: int) -> float:
    """Bits of a word that ``n`` of ``items`` hold, one of them its own."""
    return -math.log2((n - 0.5) / (items + 1))


def _after(n: int, n_before: int, alone: float) -> float:
    """Bits of a word after another one, if ``n`` items hold both so and ``n_before`` the other one."""
    return -math.log2((n - 1 + 0.5 * 2**-alone) / (n_before - 0.5))


def seeds(words: np.ndarray, mask: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The places of ``words`` where the ``mask`` fits and picks known words only, and the hashes there."""
    n = max(len(words) - mask[-1], 0)
    at = np.flatnonzero(reduce(np.logical_and, (words[o : o + n] >= 0 for o in mask)))
    key = np.full(len(at), hash(mask) & 0xFFFF, dtype=np.uint64)
    for o, by in zip(mask, _MULTIPLIERS):
        key = (key ^ words[at + o].astype(np.uint64)) * by
        key ^= key >> np.uint64(29)
    return at, key


class Items:
    """A table of items in memory: words, bits and sorted seeds."""

    def __init__(self, ids: list, lists: list[np.ndarray]):
        self.ids, self.words, self.bits = ids, lists, information(lists)
        parts = [(k, np.full(len(k), n, dtype=np.int32), at.astype(np.int32)) for n, ws in enumerate(lists) for at, k in (seeds(ws, mask) for mask in MASKS)]
        keys, of, places = (np.concatenate(x) if parts else np.array([], dtype=t) for x, t in zip(zip(*parts) if parts else ((),) * 3, (np.uint64, np.int32, np.int32)))
        order = np.argsort(keys, kind="stable")
        self.keys, self.of, self.places = keys[order], of[order], places[order]
        self.sieve = np.zeros(1 << 22, dtype=bool)
        self.sieve[(self.keys >> np.uint64(42)).astype(np.int64)] = True

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place in ``words``, item and place in the item of every seed that both have."""
        found = []
        for mask in MASKS:
            at, key = seeds(words, mask)
            some = self.sieve[(key >> np.uint64(42)).astype(np.int64)]
            at, key = at[some], key[some]
            left = np.searchsorted(self.keys, key, "left")
            n = np.searchsorted(self.keys, key, "right") - left
            entry = np.repeat(left - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(n) else left
            found.append((np.repeat(at, n), self.of[entry], self.places[entry]))
        return tuple(np.concatenate(x) for x in zip(*found))


def aligned(doc: np.ndarray, item: np.ndarray, bits: np.ndarray, gap: int) -> tuple[int, int, float, float, int]:
    """Words of the item spanned, equal words, score and bits of the best alignment of ``item`` within ``doc``, and its ends beyond which both have a word.

    Equal words follow each other with at most ``gap`` others in between on either side.
    """
    where = defaultdict(list)
    for j, w in enumerate(doc.tolist()):
        if w >= 0:
            where[w].append(j)
    steps = [(di, dj, 1 - ERROR_COST * (max(di, dj) - 1)) for di in range(1, gap + 2) for dj in range(1, gap + 2)]
    best: dict[tuple[int, int], tuple[float, int, int, float, int]] = {}
    top, end = (0.0, 0, 0, 0.0, 0), (0, 0)
    value = bits.tolist()
    for i, w in enumerate(item.tolist()):
        for j in where.get(w, ()):
            most = (1.0, i, 1, value[i], j)
            for di, dj, gain in steps:
                if (p := best.get((i - di, j - dj))) and p[0] + gain > most[0]:
                    most = (p[0] + gain, p[1], p[2] + 1, p[3] + value[i], p[4])
            best[i, j] = most
            if most[0] > top[0]:
                top, end = most, (i, j)
    score, first, equal, said, began = top
    return end[0] - first + 1 if equal else 0, equal, score, said, (first > 0 and began > 0) + (end[0] < len(item) - 1 and end[1] < len(doc) - 1)


def leak(doc: np.ndarray, item: np.ndarray, bits: np.ndarray, least_words: int = LEAST_WORDS) -> tuple[int, int] | None:
    """Words spanned and equal words of the passage of ``item`` that ``doc`` carries, None if it carries none of ``least_words``."""
    here = np.isin(item, doc)
    n, score_needed = int(here.sum()), LEAST_SCORE * least_words / LEAST_WORDS
    if n >= CHANGED_SHARE * least_words and (n >= least_words or float(bits[here].sum()) >= LEAST_BITS):
        span, equal, score, said, ends = aligned(doc, item, bits, 1)
        # The first and the last word may be changed as well.
        span += min(ends, max(least_words - span, 0))
        if span >= least_words and equal >= CHANGED_SHARE * span and (said >= LEAST_BITS or equal == span):
            return span, equal
    if n >= score_needed:
        span, equal, score, _, _ = aligned(doc, item, bits, WIDE_GAP)
        if span >= least_words and score >= score_needed and equal >= LEAST_SHARE * span:
            return span, equal
    return None


def slack(item_words: int) -> int:
    """How far hits of one passage may be shifted against each other."""
    return 4 + item_words // 5


def spots(hits: list[tuple[int, int, int, int, int]], room: int) -> Iterator[tuple[int, int, int, int]]:
    """Where to look: the parts (first word, end) of the document and of the item around hits whose shifts lie within ``room`` of each other.

    Each of ``hits`` has the least and greatest shift, the least and greatest place in the item, and the number of hits; LEAST_HITS are needed.
    """
    hits.sort()
    low, high, first, last, n = hits[0]
    for a, b, c, d, k in [*hits[1:], (math.inf, 0, 0, 0, 0)]:
        if a - high > room:
            if n >= LEAST_HITS:
                end = last + MASKS[-1][-1] + 1 + AROUND
                yield max(first + low - AROUND - room, 0), end + high + room, max(first - AROUND, 0), end
            low, high, first, last, n = a, b, c, d, k
        else:
            high, first, last, n = max(high, b), min(first, c), max(last, d), n + k


def search(items: Items, docs: list[np.ndarray], least_words: int = LEAST_WORDS) -> Iterator[tuple[int, int, int, int]]:
    """The place in ``docs`` and the item (by place) of each leak, with its words spanned and equal.

    All documents are hashed at once, set apart by words that are in no item.
    """
    gap = np.full(max(m[-1] for m in MASKS), -1, dtype=np.int64)
    begins = np.cumsum([0, *(len(d) + len(gap) for d in docs)])
    whole = np.concatenate([x for d in docs for x in (d, gap)]) if docs else gap
    at, of, place = items.hits(whole)
    doc = np.searchsorted(begins, at, "right") - 1
    pair = doc.astype(np.int64) * max(len(items.ids), 1) + of
    order = np.argsort(pair, kind="stable")
    pair, shift, place = pair[order], (at - begins[doc] - place)[order], place[order]
    edges = np.flatnonzero(np.diff(pair, prepend=-1, append=-1))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if b - a >= LEAST_HITS:
            d, n = divmod(int(pair[a]), max(len(items.ids), 1))
            near = spots([(s, s, p, p, 1) for s, p in zip(shift[a:b].tolist(), place[a:b].tolist())], slack(len(items.words[n])))
            found = (leak(docs[d][x:y], items.words[n][v:w], items.bits[n][v:w], least_words) for x, y, v, w in near)
            if top := max(filter(None, found), default=None):
                yield d, n, *top


def _some(keys: list, texts: list[str], read, size: int = 500_000) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Keys and read texts in portions of about ``size`` words."""
    held, n = ([], []), 0
    for key, text in zip(keys, texts):
        words = read(text)
        held[0].append(key)
        held[1].append(words)
        n += len(words)
        if n >= size:
            yield held
            held, n = ([], []), 0
    if held[0]:
        yield held


def find_leaks(docs: DataFrame, items: DataFrame, doc_key: str, doc_text: str, item_key: str, item_text: str, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc key, item key, span_words, equal_words of each document and item of which it carries a passage of ``least_words`` running words.

    Passages are compared apart from formatting, damaged characters and single words changed, added or left out (see ``leak``). Null keys and texts have no leak;
    items shorter than ``least_words`` cannot leak; of repeated items each id is reported. Whole texts are read, whatever their length.
    """
    items = items.select(F.col(f"`{item_key}`").alias("item"), F.col(f"`{item_text}`").alias("text")).where("item IS NOT NULL AND text IS NOT NULL").distinct()
    rows = docs.select(F.col(f"`{doc_key}`").alias("doc"), F.col(f"`{doc_text}`").alias("text")).where("doc IS NOT NULL AND text IS NOT NULL")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    found = broadcast_search(rows, items, least_words) if chars <= BROADCAST_CHARS else shuffled_search(rows, items, least_words)
    return found.groupBy(F.col("doc").alias(doc_key), F.col("item").alias(item_key)).agg(F.max("span_words").alias("span_words"), F.max("equal_words").alias("equal_words"))


def broadcast_search(rows: DataFrame, items: DataFrame, least_words: int) -> DataFrame:
    """The leaks of ``items`` (item, text; of a size that was checked) in ``rows`` (doc, text), found where the documents are read."""
    types = dict(items.dtypes)["item"], dict(rows.dtypes)["doc"]
    held = items.orderBy("item", "text").collect()
    lists = [words_of(r.text) for r in held]
    sent = rows.sparkSession.sparkContext.broadcast(([r.item for r in held], lists, sorted({w for ws in lists for w in ws})))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, lists, words = sent.value
        vocabulary = Vocabulary(words)
        ours = Items(ids, [np.array([vocabulary.number[w] for w in ws], dtype=np.int64) for ws in lists])
        for batch in batches:
            out = []
            for keys, docs in _some(batch["doc"].tolist(), batch["text"].tolist(), vocabulary.read):
                out += [(keys[d], ours.ids[n], span, equal) for d, n, span, equal in search(ours, docs, least_words)]
            yield pd.DataFrame(out, columns=["doc", "item", "span_words", "equal_words"])

    return rows.mapInPandas(scan, f"doc {types[1]}, item {types[0]}, span_words int, equal_words int")


def item_words(items: DataFrame) -> DataFrame:
    """no, item, at, word, before of each word of the items; ``no`` sets items of one id apart."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(words=[words_of(t) for t in batch["text"]])[["item", "words"]]

    lists = items.mapInPandas(split, f"item {dict(items.dtypes)['item']}, words array<string>").select(F.xxhash64("item", "words").alias("no"), "item", "words").dropDuplicates(["no"])
    words = lists.select("no", "item", "words", F.posexplode("words").alias("at", "word"))
    return words.select("no", "item", "at", "word", F.when(F.col("at") > 0, F.get("words", F.col("at") - 1)).alias("before"))


def shuffled_search(rows: DataFrame, items: DataFrame, least_words: int) -> DataFrame:
    """As ``broadcast_search`` for items of any number: their hashes are joined with those of the documents."""
    spark = rows.sparkSession
    words = cut_lineage(item_words(items))
    n_items, n_words = words.agg(F.count_distinct("no"), F.count("*")).first()
    single = cut_lineage(words.groupBy("word").agg(F.count_distinct("no").alias("n"), F.count("*").alias("rows")))
    pairs = words.where("before IS NOT NULL").groupBy("before", "word").agg(F.count_distinct("no").alias("n2"), F.count("*").alias("rows2"))
    told = lookup_join(words, single, ["word"], "rows", n_words).drop("rows")
    told = lookup_join(told, pairs, ["before", "word"], "rows2", n_words, "left").drop("rows2")
    told = lookup_join(told, single.select(F.col("word").alias("before"), F.col("n").alias("n1"), "rows"), ["before"], "rows", n_words, "left").drop("rows")
    alone = -F.log2((F.col("n") - 0.5) / (n_items + 1))
    after = -F.log2((F.col("n2") - 1 + 0.5 * F.pow(F.lit(2.0), -alone)) / (F.col("n1") - 0.5))
    told = cut_lineage(told.select("no", "item", "at", "word", F.when(F.col("before").isNull(), alone).otherwise(F.least(alone, after)).alias("bits")))
    groups = 1
    while (told.select(F.pmod("no", F.lit(groups)).alias("g"), "word").distinct().groupBy("g").count().agg(F.max("count")).first()[0] or 0) > MOST_WORDS:
        groups *= 2
    parts = []
    for g in range(groups):
        own = told.where(F.pmod("no", F.lit(groups)) == g)
        # At most MOST_WORDS words.
        vocabulary = spark.sparkContext.broadcast(Vocabulary([r.word for r in own.select("word").distinct().collect()]))
        parts.append(_shuffled(rows, own, vocabulary, least_words))
    return reduce(DataFrame.unionByName, parts)


def _shuffled(rows: DataFrame, told: DataFrame, vocabulary, least_words: int) -> DataFrame:
    spark = rows.sparkSession
    types = dict(told.dtypes)["item"], dict(rows.dtypes)["doc"]
    lists = told.groupBy("no").agg(F.first("item").alias("item"), F.array_sort(F.collect_list(F.struct("at", "word", "bits"))).alias("w"))

    def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = vocabulary.value.number
        for batch in batches:
            yield batch.assign(words=[[number[w] for w in ws] for ws in batch["words"]])

    lists = cut_lineage(lists.select("no", "item", F.col("w.word").alias("words"), F.col("w.bits").alias("bits")).mapInPandas(numbered, f"no long, item {types[0]}, words array<int>, bits array<double>"))

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [(k, np.full(len(k), no), at) for no, ws in zip(batch["no"], batch["words"]) for at, k in (seeds(np.asarray(ws, dtype=np.int64), m) for m in MASKS)]
            keys, no, at = (np.concatenate(x) for x in zip(*parts)) if parts else ([], [], [])
            yield pd.DataFrame({"key": np.asarray(keys, dtype=np.uint64).view(np.int64), "no": no, "place": at})

    entries = lists.select("no", "words").mapInPandas(hashed, "key long, no long, place int")
    # A hash that many items share is several rows, of SHARERS entries each.
    rank = F.row_number().over(Window.partitionBy("key", F.pmod("no", F.lit(1024))).orderBy("no", "place"))
    dealt = entries.withColumn("part", F.floor((rank - 1) / SHARERS) * 1024 + F.pmod("no", F.lit(1024)))
    shared = cut_lineage(dealt.groupBy("key", "part").agg(F.collect_list(F.struct("no", "place")).alias("entries")))
    bitmap = spark.sparkContext.broadcast(_bitmap(shared, BITMAP))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, read = bitmap.value, vocabulary.value.read
        for batch in batches:
            out = []
            for doc, text in zip(batch["doc"].tolist(), batch["text"].tolist()):
                ws = read(text)
                found = [(at[some], key[some]) for at, key in (seeds(ws, m) for m in MASKS) if len(some := np.flatnonzero(_marked(known, key)))]
                if sum(len(at) for at, _ in found) >= LEAST_HITS:
                    out.append((doc, ws.astype(np.int32), np.concatenate([a for a, _ in found]).astype(np.int32), np.concatenate([k for _, k in found]).view(np.int64)))
            yield pd.DataFrame(out, columns=["doc", "words", "at", "key"])

    # Of the documents only those with hits go on, as numbers.
    staged = cut_lineage(rows.mapInPandas(scan, f"doc {types[1]}, words array<int>, at array<int>, key array<long>").withColumn("row", F.monotonically_increasing_id()))
    hits = staged.select("row", F.explode(F.arrays_zip("at", "key")).alias("h")).select("row", "h.at", "h.key").join(shared, "key")
    hits = hits.select("row", "at", F.explode("entries").alias("e")).select("row", "e.no", "e.place", (F.col("at") - F.col("e.place")).alias("shift"))
    # Counted by stretches of shifts, so a phrase that comes again and again in a document stays one row per stretch.
    near = hits.groupBy("row", "no", F.floor(F.col("shift") / 32).alias("stretch")).agg(
        F.min("shift").alias("low"), F.max("shift").alias("high"), F.min("place").alias("first"), F.max("place").alias("last"), F.count("*").cast("int").alias("n")
    )
    pairs = near.groupBy("row", "no").agg(F.collect_list(F.struct("low", "high", "first", "last", "n")).alias("hits"), F.sum("n").alias("n")).where(F.col("n") >= LEAST_HITS)

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(row, no, *spot) for row, no, hits, size in zip(batch["row"], batch["no"], batch["hits"], batch["size"]) for spot in spots([tuple(h.values()) for h in hits], slack(size))]
            yield pd.DataFrame(out, columns=["row", "no", "x", "y", "v", "w"])

    sized = pairs.join(lists.select("no", F.size("words").alias("size")), "no").select("row", "no", "hits", "size")
    spans = sized.mapInPandas(windows, "row long, no long, x int, y int, v int, w int")
    text = spans.join(staged.select("row", "doc", "words"), "row").select("doc", "no", "v", "w", F.expr("slice(words, x + 1, y - x)").alias("passage"))
    both = text.join(lists, "no").select("doc", "item", "passage", F.expr("slice(words, v + 1, w - v)").alias("words"), F.expr("slice(bits, v + 1, w - v)").alias("bits"))

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, item, passage, ws, bits in zip(batch["doc"].tolist(), batch["item"].tolist(), batch["passage"], batch["words"], batch["bits"]):
                if top := leak(np.asarray(passage), np.asarray(ws), np.asarray(bits), least_words):
                    out.append((doc, item, *top))
            yield pd.DataFrame(out, columns=["doc", "item", "span_words", "equal_words"])

    return both.mapInPandas(verify, f"doc {types[1]}, item {types[0]}, span_words int, equal_words int")


def _places(keys: np.ndarray, size: int) -> np.ndarray:
    return ((keys >> np.uint64(20)) % np.uint64(size)).astype(np.int64)


def _bitmap(shared: DataFrame, size: int) -> np.ndarray:
    """``size`` bits, set for the hashes of the items; hashes share bits as it fills, and the join sorts them out."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"spots": [np.unique(_places(batch["key"].to_numpy().view(np.uint64), size)).tobytes()]})

    bits = np.zeros(size // 8, dtype=np.uint8)
    # A batch at a time comes to the driver and is laid over the others.
    for r in shared.select("key").mapInPandas(fold, "spots binary").toLocalIterator():
        spot = np.frombuffer(r.spots, dtype=np.int64)
        np.bitwise_or.at(bits, spot >> 3, (1 << (spot & 7)).astype(np.uint8))
    return bits


def _marked(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    spot = _places(keys, len(bits) * 8)
    return (bits[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1 > 0
