"""Texts that were decoded with the wrong character encoding, found and restored.

All adjacent character pairs with a character beyond ASCII are counted over the corpus. A pair is improbable if it adds little to the mutual
information of neighbours, or if it is what the corpus's own characters would look like when wrongly decoded: garbled text is part of the corpus and must not make itself
probable. Runs of improbable pairs are isolated as maximum-scoring segments, and only inside them the inverse mappings are
tested: written back with the encoding that was wrongly used and read again with the right one, a run must become likelier under the corpus
counts by so many bits.

Everything is told by shares, not by counts, so it does not depend on the size of the corpus. The counts are combined in each task and again before the
shuffle. What comes to the driver are the pairs that make up at least FLOOR of all counted ones, a million at most, whatever the corpus; a rarer
pair is worth the same as one that never occurs, so nothing is lost with it.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.session import cut_lineage

#: Share of all counted pairs from which a pair is told from one that never occurs.
FLOOR = 1e-6
#: Pairs that are counted in a task before they are passed on.
HELD_PAIRS = 1_000_000
#: Bits of mutual information (of all pairs) under which a pair is improbable.
PROBABLE_BITS = 2e-3
#: Scores of the segments: an improbable pair, a probable one, a pair of ASCII characters between them; a segment ends where it falls this low.
UNLIKELY, LIKELY, PLAIN, DROP = 1.0, -1.0, -0.34, -2.0
#: Bits that a restored run must gain, in all and by changed character, for UTF-8 read as something else and for two single-byte encodings mixed up.
GAIN_UTF8, GAIN_SINGLE, GAIN_BY_CHARACTER = 9.0, 9.5, 4.0
#: Two single-byte encodings are mixed up all over a corpus if so many of the commonest pairs of the right reading, at most and at least, have a wrong one, and
#: what share of them must; a wrong pair counts from this share of the right one's number.
COMMONEST, SEEN_WRONG, WRONG_SHARE = (40, 8), 0.7, 0.002

#: Most words of a label.
LABEL_WORDS = 4

#: Encodings that texts are wrongly read with, and single-byte ones that they were written in.
WRONG = ("cp1252", "cp1250", "cp1251", "cp1253", "cp1254", "cp1257", "cp437", "cp850", "cp852", "cp866", "mac_roman", "koi8_r", "iso8859_2", "iso8859_15")
WRITTEN = ("cp1252", "cp1250", "iso8859_2", "cp1251", "koi8_r", "mac_roman", "cp850", "cp437")
WIDE = ("gbk", "shift_jis", "big5")
#: Encodings of two bytes a character that a text may have been written in.
WRITTEN_WIDE = ("euc_jp", "shift_jis", "gb18030", "big5", "euc_kr")

_UTF8 = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xef][\x80-\xbf]{2}|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}")
_ENTITIES = re.compile(r"(?:&#(?:x[0-9a-fA-F]{2,6}|[0-9]{3,7});)+")
#: Marks that set something off; straight double quotes also enclose whole texts and are none of them.
_SET_OFF = re.compile(r"“[^“”\n]*”|«[^«»\n]*»|„[^„“”\n]*[“”]|‘[^‘’\n]*’|\([^()\n]*\)")
_SENTENCE = re.compile(r"[.!?…。！？][\"'”’»)\]]*(?=[\s,}\]]|$)|[\n\r]")


@cache
def to_byte(encoding: str) -> dict[str, int]:
    """The byte of each character beyond ASCII; bytes without a character stand for themselves, as decoders let them through."""
    out: dict[str, int] = {}
    for b in range(0x80, 0x100):
        try:
            out[bytes([b]).decode(encoding)] = b
        except UnicodeDecodeError:
            pass
    for b in range(0x80, 0xA0 if encoding != "cp1252" else 0x100):
        out.setdefault(chr(b), b)
    return out


@cache
def remap(wrong: str, written: str) -> dict[int, str]:
    """The translation table from a text read as ``wrong`` to one read as ``written``."""
    out = {}
    for ch, b in to_byte(wrong).items():
        try:
            if (right := bytes([b]).decode(written)) != ch and not 0x7F <= ord(right) < 0xA0:
                out[ord(ch)] = right
        except UnicodeDecodeError:
            pass
    return out


@cache
def moved(wrong: str, written: str) -> frozenset[str]:
    """The characters that ``remap`` changes."""
    return frozenset(map(chr, remap(wrong, written)))


class _Bytes(dict):
    """A translation table of characters to their bytes; what has none becomes a blank."""

    def __missing__(self, code: int) -> int:
        self[code] = 0x20
        return 0x20


@cache
def as_bytes(encoding: str) -> tuple[_Bytes, frozenset[str]]:
    """The table of ``to_byte``, and the characters that can begin a UTF-8 sequence."""
    table = to_byte(encoding)
    return _Bytes({ord(ch): b for ch, b in table.items()}), frozenset(ch for ch, b in table.items() if 0xC2 <= b < 0xF5)


def _chunks(texts: pd.Series, size: int = 2_000_000) -> Iterator[str]:
    """The texts, set apart by line breaks, in pieces of about ``size`` characters; a text is never cut."""
    held, n = [], 0
    for text in texts:
        held.append(text)
        n += len(text)
        if n >= size:
            yield "\n".join(held)
            held, n = [], 0
    if held:
        yield "\n".join(held)


def count_pairs(docs: DataFrame) -> DataFrame:
    """a, b, n over all texts: adjacent characters with one beyond ASCII at least; b = -1 holds the counts of single characters."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs: Counter = Counter()
        singles = np.zeros(0x110000, dtype=np.int64)
        for batch in batches:
            for text in _chunks(batch["text"]):
                codes = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.int64)
                singles += np.bincount(codes, minlength=0x110000)
                wide = codes > 0x7F
                at = np.flatnonzero(wide[:-1] | wide[1:])
                keys, n = np.unique((codes[at] << 21) | codes[at + 1], return_counts=True)
                pairs.update(dict(zip(keys.tolist(), n.tolist())))
            if len(pairs) > HELD_PAIRS:
                yield _frame(pairs)
                pairs = Counter()
        yield _frame(pairs)
        used = np.flatnonzero(singles)
        yield pd.DataFrame({"a": used, "b": np.full(len(used), -1), "n": singles[used]})

    def _frame(pairs: Counter) -> pd.DataFrame:
        keys, n = np.array(list(pairs), dtype=np.int64), np.array(list(pairs.values()), dtype=np.int64)
        return pd.DataFrame({"a": keys >> 21, "b": keys & 0x1FFFFF, "n": n})

    rows = docs.select("text").where("text IS NOT NULL AND text <> ''")
    return rows.mapInPandas(count, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


class Pairs:
    """The corpus counts of pairs, with what is drawn from them."""

    def __init__(self, a: np.ndarray, b: np.ndarray, n: np.ndarray, total: int | None = None):
        single = b < 0
        self.counts = dict(zip(a[single].tolist(), n[single].tolist()))
        a, b, n = a[~single], b[~single], n[~single]
        self.whole = max(sum(self.counts.values()), 1)
        #: All counted pairs, those too rare to be given here included.
        self.total = max(int(n.sum()) if total is None else total, 1)
        keys = (a << 21) | b
        order = np.argsort(keys)
        self.keys, n = keys[order], n[order]
        na, nb = (np.array([self.counts.get(x, 1) for x in v.tolist()], dtype=float) for v in (a[order], b[order]))
        # Relative to the pairs that are counted at all: the share of plain ASCII in the corpus must not matter.
        bits = n / self.total * np.log2(np.maximum(n * self.whole / np.maximum(na * nb, 1), 1e-9))
        garbled = self._garbled(n) | self._mixed_up(n)
        self.probable = (bits >= PROBABLE_BITS) & ~garbled
        share = np.where(garbled, 0.0, n / self.total)
        self.cost_of = dict(zip(self.keys.tolist(), (-np.log2(np.maximum(share, FLOOR))).tolist()))
        self.unseen = -math.log2(FLOOR)
        #: Runs that were tested, with their result: the same phrases come again and again.
        self.tested: dict[tuple[str, str, str], tuple[str | None, tuple[str, str] | None]] = {}

    def _garbled(self, n: np.ndarray) -> np.ndarray:
        """Whether a pair is what characters of the corpus, as UTF-8, look like when read wrongly; such a pair is no more frequent than they are."""
        of: Counter = Counter()
        for code, count in self.counts.items():
            if code > 0x7F and not 0xD800 <= code < 0xE000:
                data = chr(code).encode()
                of.update(dict.fromkeys((pair for wrong in WRONG for pair in _read_wrongly(data, wrong)), count))
        return np.array([x <= of[k] for k, x in zip(self.keys.tolist(), n.tolist())], dtype=bool)

    def _mixed_up(self, n: np.ndarray) -> np.ndarray:
        """Whether a pair is the wrong reading of a commoner one under encodings that are mixed up all over the corpus: most common pairs have such a wrong reading."""
        out = np.zeros(len(n), dtype=bool)
        if not len(n):
            return out
        a, b = self.keys >> 21, self.keys & 0x1FFFFF
        by_number = np.argsort(-n, kind="stable")
        for wrong in WRONG:
            for written in WRITTEN:
                table = {ord(v): k for k, v in remap(wrong, written).items()} if wrong != written else {}
                if not table:
                    continue
                # From the right reading to the wrong one; characters that both encodings have in one place stay.
                to = np.arange(0x250, dtype=np.int64) if max(table) < 0x250 else np.arange(max(table) + 1, dtype=np.int64)
                to[list(table)] = list(table.values())
                inside = (a < len(to)) & (b < len(to))
                x, y = to[np.where(inside, a, 0)], to[np.where(inside, b, 0)]
                moved = inside & ((x != a) | (y != b))
                common = by_number[moved[by_number]][: COMMONEST[0]]
                if len(common) < COMMONEST[1]:
                    continue
                place = np.minimum(np.searchsorted(self.keys, (x << 21) | y), len(self.keys) - 1)
                there = moved & (self.keys[place] == ((x << 21) | y))
                seen = there[common] & (n[place[common]] >= np.maximum(2, WRONG_SHARE * n[common])) & (n[place[common]] <= n[common])
                if seen.mean() >= SEEN_WRONG:
                    out[place[there & (n[place] <= n)]] = True
        return out

    def unlikely(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether the pairs of ``codes`` that begin ``at`` are improbable."""
        key = (codes[at] << 21) | codes[at + 1]
        if not len(self.keys):
            return np.ones(len(at), dtype=bool)
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return ~((self.keys[place] == key) & self.probable[place])

    def cost(self, text: str) -> float:
        """The bits that the pairs of ``text`` with a character beyond ASCII take; a pair of ASCII characters takes what such pairs take at a usual place."""
        get, total, unseen = self.cost_of.get, 0.0, self.unseen
        for x, y in zip(text, text[1:]):
            total += get((ord(x) << 21) | ord(y), unseen) if x > "\x7f" or y > "\x7f" else 7.0
        return total

    def known(self, text: str, least: int) -> bool:
        """Whether all characters of ``text`` occur in the corpus, ``least`` times in a hundred million and at least so often."""
        least = max(least, least * self.whole / 1e8)
        return all(ch < "\x80" or self.counts.get(ord(ch), 0) >= least for ch in text)


def _read_wrongly(data: bytes, wrong: str) -> set[int]:
    """The pairs of characters that ``data`` gives when read as ``wrong``; a byte without a character may stand for itself."""
    kinds = []
    for byte in data:
        forms = {byte} if byte < 0xA0 else set()
        try:
            forms.add(ord(bytes([byte]).decode(wrong)))
        except UnicodeDecodeError:
            pass
        kinds.append(forms)
    return {(x << 21) | y for left, right in zip(kinds, kinds[1:]) for x in left for y in right}


def segments(codes: np.ndarray, pairs: Pairs) -> list[tuple[int, int]]:
    """The maximum-scoring segments of improbable pairs, as (first character, end)."""
    wide = codes > 0x7F
    at = np.flatnonzero(wide[:-1] | wide[1:])
    if not len(at):
        return []
    bad = pairs.unlikely(codes, at)
    out: list[tuple[int, int]] = []
    score, best, begin, end, last = 0.0, 0.0, -1, -1, -1
    for i, unlikely in zip(at.tolist(), bad.tolist()):
        if begin >= 0:
            score += PLAIN * (i - last - 1)
            if score < best + DROP or score <= 0:
                out.append((begin, end))
                begin, score, best = -1, 0.0, 0.0
        if unlikely:
            if begin < 0:
                begin, score, best = i, 0.0, 0.0
            score += UNLIKELY
            if score >= best:
                best, end = score, i + 2
        elif begin >= 0:
            score += LIKELY
            if score < best + DROP:
                out.append((begin, end))
                begin, score, best = -1, 0.0, 0.0
        last = i
    if begin >= 0:
        out.append((begin, end))
    return out


def _utf8(text: str, wrong: str) -> tuple[str, int]:
    """``text`` with the sequences that are UTF-8 read as ``wrong`` put right, and their number."""
    data = text.translate(as_bytes(wrong)[0]).encode("latin-1")
    out, done, n = [], 0, 0
    for m in _UTF8.finditer(data):
        try:
            ch = m.group().decode()
        except UnicodeDecodeError:
            continue
        if 0x7F <= ord(ch) < 0xA0:
            continue
        out += text[done : m.start()], ch
        done = m.end()
        n += 1
    return "".join([*out, text[done:]]), n


def restored(run: str, before: str, after: str, pairs: Pairs) -> tuple[str | None, tuple[str, str] | None]:
    """``run`` in its likeliest original form, None if no inverse mapping makes it likelier by enough bits; the mapping used, if it is one of WRONG."""
    key = run, before, after
    if key not in pairs.tested:
        if len(pairs.tested) > 200_000:
            pairs.tested.clear()
        pairs.tested[key] = _restored(run, before, after, pairs)
    return pairs.tested[key]


def _restored(run: str, before: str, after: str, pairs: Pairs) -> tuple[str | None, tuple[str, str] | None]:
    now, found, mapping = run, None, None
    while True:  # wrongly decoded several times over; each time must gain bits, so this ends
        cost = pairs.cost(before + now + after)
        best, best_gain = None, 0.0
        wide = [ch for ch in now if ch > "\x7f"]
        kinds = set(wide)
        for wrong in WRONG:
            if as_bytes(wrong)[1].isdisjoint(kinds):
                continue
            right, n = _utf8(now, wrong)
            if n and (gain := cost - pairs.cost(before + right + after)) >= GAIN_UTF8 and gain > best_gain and pairs.known(right, 1):
                best, best_gain, mapping = right, gain, (wrong, "utf-8")
        if any("⺀" <= ch for ch in kinds):
            for wrong in WIDE:
                try:
                    right = now.encode(wrong).decode("utf-8")
                except UnicodeError:
                    continue
                if (gain := cost - pairs.cost(before + right + after)) >= GAIN_UTF8 and gain > best_gain:
                    best, best_gain = right, gain
        if best is None and found is None and len(wide) >= 4:
            for wrong in WRONG:
                table = to_byte(wrong)
                if any(ch not in table for ch in kinds):
                    continue
                data = bytes(table.get(ch, ord(ch) & 0x7F) for ch in now)
                for written in WRITTEN_WIDE:
                    try:
                        right = data.decode(written)
                    except UnicodeDecodeError:
                        continue
                    if (gain := cost - pairs.cost(before + right + after)) >= GAIN_SINGLE and gain > best_gain and pairs.known(right, 2):
                        best, best_gain = right, gain
        if best is None and found is None:
            for wrong in WRONG:
                for written in WRITTEN:
                    # All characters beyond ASCII must change.
                    if wrong == written or not wide or not kinds <= moved(wrong, written):
                        continue
                    right, changed = now.translate(remap(wrong, written)), len(wide)
                    gain = cost - pairs.cost(before + right + after)
                    if gain >= max(GAIN_SINGLE, GAIN_BY_CHARACTER * changed) and gain > best_gain and pairs.known(right, 5) and _joined(now, before + right + after, len(before)):
                        best, best_gain, mapping = right, gain, (wrong, written)
        if best is None:
            return found, mapping
        now = found = best
    return found, mapping


def _joined(old: str, new: str, offset: int) -> bool:
    """Whether a changed character is no letter, or stands beside a letter of its own script: a letter by itself proves nothing."""
    for i, was in enumerate(old):
        ch = new[offset + i]
        if ch == was:
            continue
        near = new[max(offset + i - 1, 0) : offset + i] + new[offset + i + 1 : offset + i + 2]
        if not ch.isalpha() or any(x.isalpha() and _script(x) == _script(ch) for x in near):
            return True
    return False


def _script(ch: str) -> int:
    """Latin, Greek, Cyrillic, or the block of another letter."""
    code = ord(ch)
    return 0 if code < 0x250 else 1 if 0x370 <= code < 0x400 else 2 if 0x400 <= code < 0x530 else code >> 8


def repair(text: str, pairs: Pairs) -> tuple[bool, bool, str]:
    """Whether ``text`` was decoded wrongly, whether all of that could be restored, and the text with what could be."""
    plain = text.isascii()
    if plain and "&#" not in text:
        return False, True, text
    # Characters of a wrongly decoded text may have been written as numeric references afterwards.
    opened = _ENTITIES.sub(lambda m: html.unescape(m.group()), text) if "&#" in text else text
    whole, wrong = _repair(opened, pairs)
    if not wrong and opened is not text:
        whole, wrong = _repair(text, pairs)
        opened = text
    lost = [m.start() for m in re.finditer("�", opened)]
    if not wrong and not lost:
        return False, True, text
    # Labels quoted from an app are none of the text's own damage.
    own = [s for s in (*wrong, *((i, i + 1, None) for i in lost)) if not _label(s, opened)]
    if not own:
        return False, True, text
    return True, not lost, whole


def _label(spot: tuple[int, int, str | None], text: str) -> bool:
    """Whether what is garbled at ``spot`` is a label that the text speaks of: set off by intact marks that hold LABEL_WORDS words at most, or
    followed or preceded in the same sentence by the same words rightly written."""
    a, b, right = spot
    for m in _SET_OFF.finditer(text, max(a - 400, 0), b + 400):
        if m.start() <= a and b <= m.end() or m.start() < b - 1 and a <= m.start() + 1 and b <= m.end() + 1:
            if len(m.group().split()) <= LABEL_WORDS:
                return True
    if right is None:
        return False
    # Blanks that a segment took in do not belong to the word.
    run = text[a:b]
    a, b, right = a + len(run) - len(run.lstrip()), b - len(run) + len(run.rstrip()), right.strip()
    x = a
    while x > 0 and not text[x - 1].isspace():
        x -= 1
    y = b
    while y < len(text) and not text[y].isspace():
        y += 1
    word = (text[x:a] + right + text[b:y]).strip(".,;:!?()[]{}\"'“”«»„‘’")
    if not word or len(word) == 1 and word.isalnum():
        return False
    begin = max((m.end() for m in _SENTENCE.finditer(text, max(x - 1000, 0), x)), default=max(x - 1000, 0))
    end = _SENTENCE.search(text, b)
    rest = text[begin:x] + "\n" + text[y : end.start() if end else len(text)]
    return re.search(rf"(?<!\w){re.escape(word)}(?!\w)", rest) is not None


def _repair(text: str, pairs: Pairs) -> tuple[str, list[tuple[int, int, str]]]:
    if text.isascii():
        return text, []
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.int64)
    end, wrong, mappings = 0, [], Counter()
    for a, b in segments(codes, pairs):
        # A sequence is never cut: the segment takes in the characters beyond ASCII around it.
        while a > end and codes[a - 1] > 0x7F:
            a -= 1
        while b < len(codes) and codes[b] > 0x7F:
            b += 1
        if a < end:
            continue
        right, mapping = restored(text[a:b], text[max(a - 1, 0) : a], text[b : b + 1], pairs)
        if right is not None and right != text[a:b]:
            end = b
            wrong.append((a, b, right))
            mappings.update([mapping] if mapping else [])
    pieces, done = [], 0
    for a, b, right in wrong:
        pieces += (text[done:a], False), (right, True)
        done = b
    pieces.append((text[done:], False))
    if mappings:
        # What was read wrongly once in a text was so throughout: weaker evidence is enough for the same mapping.
        for found, _ in mappings.most_common():
            pieces = [(p if put_right else _BEYOND.sub(lambda m, p=p, found=found: _again(m, p, found, pairs), p), put_right) for p, put_right in pieces]
    return "".join(p for p, _ in pieces), wrong


_BEYOND = re.compile(r"[^\x00-\x7f]+")


def _again(m: re.Match, text: str, mapping: tuple[str, str], pairs: Pairs) -> str:
    before, after = text[max(m.start() - 1, 0) : m.start()], text[m.end() : m.end() + 1]
    wrong, written = mapping
    right = _utf8(m.group(), wrong)[0] if written == "utf-8" else m.group().translate(remap(wrong, written))
    least = 0 if written == "utf-8" else 3
    return right if pairs.cost(before + m.group() + after) - pairs.cost(before + right + after) > least else m.group()


def corpus_pairs(docs: DataFrame) -> Pairs:
    """The counts over the texts of ``docs``: pairs that make up FLOOR of all at least, and all single characters."""
    counted = cut_lineage(count_pairs(docs))
    total = counted.where("b >= 0").agg(F.sum("n")).first()[0] or 0
    # At most 1 / FLOOR pairs, and as many characters as there are.
    kept = counted.where((F.col("b") < 0) | (F.col("n") >= FLOOR * total)).toPandas()
    return Pairs(*(kept[c].to_numpy(dtype=np.int64) for c in ("a", "b", "n")), total)


def find_garbled(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, restored, complete of each text that was decoded wrongly, wholly or in part; complete is false where characters are lost.

    Null and empty texts are none. A text that only quotes a garbled label of an app is none. Whole texts are read; repeated rows give repeated results.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).where("text IS NOT NULL AND text <> ''")
    sent = spark.sparkContext.broadcast(corpus_pairs(rows))
    kind = dict(rows.dtypes)["key"]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs = sent.value
        for batch in batches:
            out = []
            for k, t in zip(batch["key"], batch["text"]):
                garbled, complete, whole = repair(t, pairs)
                if garbled:
                    out.append((k, whole, complete))
            yield pd.DataFrame(out, columns=["key", "restored", "complete"])

    return rows.mapInPandas(scan, f"key {kind}, restored string, complete boolean").withColumnRenamed("key", key)
