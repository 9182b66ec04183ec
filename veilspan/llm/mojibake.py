"""Garbled text from a wrong character encoding: find it and restore it.

Method: round-trip repair. A stretch of text is encoded back with a candidate legacy
encoding (the one it was wrongly read with) and strictly decoded with the encoding it was
written in. The result replaces the stretch when a garbling cost drops; nested layers are
peeled by repeating the step until no cost drops: a step that leaves the garbling cost as it
was lowers the pair cost, so it ends by itself. Stretches whose characters are lost for good (replacement
characters) are reported as garbled and left as they are.

The work is one pass over the text per document, in Arrow batches, with no shuffle.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Encodings text is wrongly read with. Bytes an encoding leaves undefined
#: read as the control character of the same number, as lenient readers do.
READ_AS = ["cp1252", "latin-1", "cp1250", "cp1251", "cp1253", "cp1254", "cp437", "cp850", "cp866", "koi8-r", "mac_roman", "iso8859-15"]
#: Multi-byte encodings text is wrongly read with.
READ_AS_WIDE = ["cp949", "cp932", "gbk", "big5"]
#: Legacy encodings text was wrongly read with, and written in.
LEGACY_PAIRS = [
    (read_as, written)
    for read_as in ("cp1252", "latin-1", "cp1251", "koi8-r", "cp866", "cp850", "cp437", "mac_roman", "cp1250")
    for written in ("cp1252", "cp1251", "koi8-r", "cp866", "cp850", "cp437", "mac_roman", "cp1250", "euc-kr", "cp932", "euc-jp")
    if read_as != written
]
EAST_ASIAN = {"euc-kr", "cp932", "euc-jp"}
#: Words whose readings are remembered per task; those of further words are worked out again.
REMEMBERED = 100_000
#: Least drop of the pair cost for which a word is restored; the second where its shape improves too.
MARGIN, MARGIN_SHAPE = 1.5, 0.8
#: Drop of the garbling cost from which a word is no evidence of how the corpus is spelled.
SUSPECT = 1.5

_UTF8 = re.compile(
    rb"(?:[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]"
    rb"|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2})+"
)
_LOST = re.compile("[\ufffd\x80-\x84\x86-\x9f]")


@lru_cache(maxsize=None)
def _page(name: str) -> dict[int, int]:
    """Code point -> byte of a single-byte encoding, lenient for undefined bytes."""
    out: dict[int, int] = {}
    for b in range(256):
        try:
            ch = bytes([b]).decode(name)
        except UnicodeDecodeError:
            ch = chr(b)
        out.setdefault(ord(ch), b)
    return out


def _bytes(text: str, name: str) -> bytes:
    """``text`` in a single-byte encoding; 0xFF, never part of UTF-8, where it has no byte."""
    page = _page(name)
    return bytes(page.get(ord(c), 0xFF) for c in text)


@lru_cache(maxsize=65536)
def _kind(ch: str) -> str:
    """Coarse class of a character for the garbling cost."""
    o = ord(ch)
    if o < 128:
        return "a" if ch.isalpha() else "d" if ch.isdigit() else "p"
    if 0x80 <= o < 0xA0 or o == 0xFFFD or 0xE000 <= o < 0xF900:
        return "!"
    if ch in "–—‘’“”…«»¡¿·€£§°":
        return "q"
    if ch in "    　​‌‍⁠﻿­":
        return "s"
    if 0xAC00 <= o < 0xD7A4 or 0x1100 <= o < 0x1200:
        return "k"
    if 0x3041 <= o < 0x3100 or o in (0x3005, 0x3006):
        return "j"
    if 0x3000 <= o < 0x3041 or 0xFF00 <= o < 0xFF61:
        return "f"
    if 0x4E00 <= o < 0xA000:
        return "c"
    if 0xF900 <= o < 0xFB00 or 0xFF61 <= o < 0xFFA0 or 0x3400 <= o < 0x4E00:
        return "h"
    if not ch.isalpha():
        return "w" if unicodedata.category(ch)[0] != "M" else "s" if 0x300 <= o < 0x370 or o == 0xFE0F else "m"
    if 0x400 <= o < 0x530:
        return "r" if 0x410 <= o < 0x450 or o in (0x401, 0x451) else "R"
    if 0x370 <= o < 0x400:
        return "g"
    if o < 0x180 or 0x1E00 <= o < 0x1F00:
        return "l" if o < 0x100 or ch in "œŒŸ" else "L"
    return "x"


#: Cost of one character of a class, in any place.
_ALONE = {"!": 3.0, "h": 0.8, "x": 3.0, "m": 3.0, "L": 0.8, "R": 0.8, "w": 0.4}
_LETTERS = {"a": "latin", "l": "latin", "L": "latin", "r": "cyr", "R": "cyr", "g": "greek", "k": "hangul", "j": "kana", "c": "han", "h": "compat", "x": "other"}
_FREE = {("kana", "han"), ("han", "kana"), ("hangul", "han"), ("han", "hangul"), ("hangul", "latin"), ("latin", "hangul"), ("kana", "latin"), ("latin", "kana"), ("han", "latin"), ("latin", "han")}
#: Latin letter pairs that ordinary spelling puts side by side.
_PAIRS = set("çã çõ ãé éé áá ÇÃ ÇÕ Çà íã öß üß äß ßä ßü ßö èé".split())


def garbling_cost(text: str) -> float:
    """How garbled a stretch looks; 0 for ordinary text in one script."""
    cost, before, bk, bs = 0.0, " ", "p", ""
    run = 0
    for ch in text:
        k = _kind(ch)
        cost += _ALONE.get(k, 0.0)
        s = _LETTERS.get(k, "")
        if s and bs and s != bs and (bs, s) not in _FREE:
            cost += 2.0
        elif s == "latin" and bs == "latin":
            if before.islower() and ch.isupper() and (k != "a" or bk != "a"):
                cost += 1.2
            if k == "l" and bk == "l" and before + ch not in _PAIRS:
                cost += 0.9
        elif s == "cyr" and bs == "cyr" and before.islower() and ch.isupper():
            cost += 1.0
        if (k == "w" and (bs or bk in "wlq")) or (bk == "w" and s):
            cost += 1.2
        if k == "q" and bk in "lrRL" and ch not in "’”»…–—“":
            cost += 0.8
        if bk == "q" and s and before in "”…–—»€£§°·¡¿‘" and before not in "¡¿‘":
            cost += 0.8
        if before and before in "ÂÃÄÅ" and ch in "\u00a0\u00ad":
            cost += 1.0
        if k in "wqs" and bk == "q" and ch not in " ”’»“":
            cost += 0.6
        if s == "han" and bs == "han":
            run += 1
            if run > 6:
                cost += 0.25
        elif s != "han":
            run = 0
        before, bk, bs = ch, k, s
    return cost


def _run_pattern(name: str) -> re.Pattern:
    """Characters that are UTF-8 lead and continuation bytes of a page, as one pattern."""
    lead = "".join(re.escape(chr(c)) for c, b in _page(name).items() if 0xC2 <= b <= 0xF4)
    rest = "".join(re.escape(chr(c)) for c, b in _page(name).items() if 0x80 <= b <= 0xBF)
    return re.compile(f"(?:[{lead}][{rest}]+)+")


_RUNS = {name: _run_pattern(name) for name in READ_AS}


@lru_cache(maxsize=1)
def _roles() -> tuple[np.ndarray, ...]:
    """Per code point, one bit per page of ``READ_AS``: leads of 2, 3 and 4 bytes, and continuations. The last entry stands for all others."""
    ranges = ((0xC2, 0xDF), (0xE0, 0xEF), (0xF0, 0xF4), (0x80, 0xBF))
    out = tuple(np.zeros(0x10000, np.uint16) for _ in ranges)
    for bit, name in enumerate(READ_AS):
        for c, b in _page(name).items():
            for table, (low, high) in zip(out, ranges):
                if low <= b <= high:
                    table[c] |= 1 << bit
    return out


def _pages_with_runs(text: str) -> list[str]:
    """The pages under which some characters of a text are the bytes of a UTF-8 character."""
    at = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 0xFFFF)
    two, three, four, more = _roles()
    rest = more[at]
    if not rest.any():
        return []
    pair = rest[1:]
    met = int(np.bitwise_or.reduce(two[at[:-1]] & pair, initial=0))
    if len(at) > 2:
        triple = pair[:-1] & pair[1:]
        met |= int(np.bitwise_or.reduce(three[at[:-2]] & triple, initial=0))
        if len(at) > 3:
            met |= int(np.bitwise_or.reduce(four[at[:-3]] & triple[:-1] & pair[2:], initial=0))
    return [name for bit, name in enumerate(READ_AS) if met >> bit & 1]


_WIDE_RUN = re.compile(r"[^\x00-\x7f\ufffd]{2,}")
_WORD = re.compile(r"[^ \t\r\n]+")
#: A character that makes a word worth the legacy trial: outside ASCII and the common East Asian blocks.
_LEGACY_CHAR = re.compile(r"[^\x00-\x7f\u3000-\u30ff\u4e00-\u9fff\uac00-\ud7a3\uff00-\uff60\ufffd]")


def _around(text: str, a: int, b: int) -> tuple[int, int]:
    """The part of the word around [a, b) on which the change of its cost depends.

    The cost of a character depends on the one before it and, among Chinese characters, on how
    many of them stand before it. So one further character on either side, and all Chinese
    ones up to there, give the same difference as the whole word.
    """
    left, right = a, b
    while left > 0 and text[left - 1] not in " \n\t":
        left -= 1
        if _kind(text[left]) != "c":
            break
    while right < len(text) and text[right] not in " \n\t":
        right += 1
        if _kind(text[right - 1]) != "c":
            break
    return left, right


@lru_cache(maxsize=REMEMBERED)
def _drop(before: str, old: str, new: str, after: str) -> float:
    """How much the garbling cost drops where ``new`` takes the place of ``old``."""
    return garbling_cost(before + old + after) - garbling_cost(before + new + after)


def _utf8_layer(text: str, read_as: str) -> tuple[str, int, tuple[int, float]]:
    """Undo one layer of UTF-8 read as ``read_as`` where it lowers the cost of the word around.

    Returns the new text, the stretches changed, and the characters explained with the drop of the cost.
    """
    out, at, done, size, gain = [], 0, 0, 0, 0.0
    for run in _RUNS[read_as].finditer(text):
        base = run.start()
        for m in _UTF8.finditer(_bytes(run.group(), read_as)):
            a, b = base + m.start(), base + m.end()
            new = m.group().decode("utf-8")
            left, right = _around(text, a, b)
            drop = _drop(text[left:a], text[a:b], new, text[b:right])
            if drop > 0.5:
                out += [text[at:a], new]
                at, done, size, gain = b, done + 1, size + b - a, gain + drop
    return ("".join(out) + text[at:], done, (size, gain)) if done else (text, 0, (0, 0.0))


@lru_cache(maxsize=REMEMBERED)
def _wide_readings(run: str) -> dict[str, tuple[str, float]]:
    """By East Asian encoding: a run of characters as UTF-8 read as that encoding, and the drop of the cost; lost bytes stay lost."""
    out = {}
    for name in READ_AS_WIDE:
        try:
            new = run.encode(name).decode("utf-8")
        except (UnicodeEncodeError, UnicodeDecodeError):
            continue
        drop = garbling_cost(run) - garbling_cost(new)
        if drop > 0.5:
            out[name] = (new, drop)
    return out


def _wide_layers(text: str) -> list[tuple[str, int, tuple[int, float]]]:
    """Undo one layer of UTF-8 read as an East Asian encoding: one result per encoding that explains any run."""
    found = {run: ways for run in _WIDE_RUN.findall(text) if (ways := _wide_readings(run))}
    out = []
    for name in dict.fromkeys(name for ways in found.values() for name in ways):
        done, size, gain = 0, 0, 0.0

        def fix(m: re.Match) -> str:
            nonlocal done, size, gain
            way = found.get(m.group(), {}).get(name)  # noqa: B023
            if way is None:
                return m.group()
            done, size, gain = done + 1, size + len(m.group()), gain + way[1]
            return way[0]

        out.append((_WIDE_RUN.sub(fix, text), done, (size, gain)))
    return out


class _Folded(dict):
    """Code point -> the symbol it counts as: itself within the legacy alphabets, else one symbol for all of its kind.

    The pair table is bounded by the square of some 700 symbols, whatever the corpus holds.
    """

    kept = {c for name in {*READ_AS, *(x for p in LEGACY_PAIRS for x in p if x not in EAST_ASIAN)} for o in _page(name) for c in chr(o).lower()}

    def __missing__(self, o: int) -> str:
        c = chr(o)
        if "0" <= c <= "9":
            out = "0"
        elif 0x4E00 <= o < 0xA000:
            out = "漢"
        elif 0xAC00 <= o < 0xD7A4:
            out = "한"
        elif 0x3041 <= o < 0x3100:
            out = "か"
        else:
            out = c if o < 128 or c in self.kept else "\uffff"
        self[o] = out
        return out


_FOLD = _Folded()


def _trials(word: str) -> Iterator[tuple[tuple[str, str], str, float]]:
    """((read as, written in), restored word, drop of the garbling cost) of every reading that looks no worse."""
    shape, plain = garbling_cost(word), sum(c.isascii() and c.isalnum() for c in word)
    for pair in LEGACY_PAIRS:
        page = _page(pair[0])
        try:
            new = bytes(page[ord(c)] for c in word).decode(pair[1])
        except (KeyError, UnicodeDecodeError):
            continue
        fall = shape - garbling_cost(new)
        if new == word or fall < 0:
            continue
        if pair[1] in EAST_ASIAN:
            kept = sum(c.isascii() and c.isalnum() for c in new)
            wide = sum(_kind(c) in "kjc" for c in new)
            if wide < 2 or fall < 1.5 or (kept < plain and pair[1] != "cp932"):
                continue
        yield pair, new, fall


def suspect(word: str) -> bool:
    """Whether another reading of a word looks so much better that it cannot vouch for its pairs."""
    if not _LEGACY_CHAR.search(word):
        return False
    letters = sum(c.isalpha() and not c.isascii() for c in word)
    return letters > 1 and garbling_cost(word) >= SUSPECT and any(fall >= SUSPECT for _, _, fall in _trials(word))


@lru_cache(maxsize=REMEMBERED)
def _pairs_of(word: str) -> frozenset[str] | None:
    """Adjacent character pairs of a word with a character outside ASCII, in lower case; null for a suspect word."""
    if suspect(word):
        return None
    w = f" {word.lower().translate(_FOLD)} "
    return frozenset(p for p in map("".join, zip(w, w[1:])) if not p.isascii())


def word_pairs(text: str) -> set[str]:
    """Character pairs of all words of a text.

    Suspect words are left out, and with them the others of a text in which they are at least half.
    """
    pairs = [_pairs_of(w) for w in _WORD.findall(text) if not w.isascii()]
    good = [p for p in pairs if p is not None]
    return set().union(*good) if 2 * len(good) > len(pairs) else set()


class PairCost:
    """Cost of a word by how rare its character pairs are in the corpus.

    A pair seen in at least one text in a thousand is free; rarer ones cost the logarithm of
    how much rarer they are. Pairs within ASCII are free.
    """

    def __init__(self, pairs: dict[str, int], texts: int):
        self.pairs, self.free = pairs, max(3.0, texts / 1000)
        self.known: dict[str, str | None] = {}

    def __call__(self, word: str) -> float:
        w, cost = f" {word.lower().translate(_FOLD)} ", 0.0
        for p in map("".join, zip(w, w[1:])):
            if not p.isascii():
                n = self.pairs.get(p, 0)
                if n < self.free:
                    cost += math.log(self.free / (n + 0.1))
        return cost

    def gains(self, word: str) -> dict[tuple[str, str], tuple[str, float]]:
        """By (read as, written in): the word restored, and the drop of its cost if it is large enough."""
        if word not in self.known:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            self.known[word] = self._gains(word)
        return self.known[word]

    def _gains(self, word: str) -> dict[tuple[str, str], tuple[str, float]]:
        base, out = self(word), {}
        core = word.strip("“”‘’„«»….,:;!?()[]\"'-–—")
        if base < 1.0 or len(core) < 2 or core.isascii() and word.rstrip(".,:;!?)") != core + "“" and word[-1] not in "‚„ˆ‰":
            return out
        for pair, new, fall in _trials(word):
            cost = self(new)
            if pair[1] in EAST_ASIAN:
                cost = cost * len(word) / len(new) + (1.0 if all(_kind(c) != "j" for c in new) and any(_kind(c) == "c" for c in new) else 0.0)
            if base - cost > (MARGIN if fall < 0.8 else MARGIN_SHAPE):
                out[pair] = (new, base - cost)
        return out


def _follows(word: str, pair: tuple[str, str], cost: PairCost, most: bool) -> str:
    """A word that gains too little by itself, read by the pair that explains its text; else ''.

    East Asian readings must give East Asian characters only. Others are taken where ``most``
    of the line is read that way and neither cost rises.
    """
    page = _page(pair[0])
    try:
        new = bytes(page[ord(c)] for c in word).decode(pair[1])
    except (KeyError, UnicodeDecodeError):
        return ""
    if new == word or garbling_cost(new) > garbling_cost(word):
        return ""
    if pair[1] in EAST_ASIAN:
        kinds = [_kind(c) for c in new if not c.isascii()]
        return new if kinds and all(k in "kjc" for k in kinds) else ""
    return new if most and cost(new) <= cost(word) else ""


def _legacy_layer(text: str, cost: PairCost) -> tuple[str, int, int]:
    """Undo one layer of one legacy encoding read as another, word by word.

    Returns the new text, the words changed and the characters outside ASCII in them.

    The pair of encodings that explains most of the text goes first; words it cannot
    restore take their own best pair.
    """
    total: Counter = Counter()
    for word in {w for w in _WORD.findall(text) if _LEGACY_CHAR.search(w)}:
        for pair, (_, gain) in cost.gains(word).items():
            total[pair] += gain
    if not total:
        return text, 0, 0
    first = max(total, key=lambda p: (total[p], p))
    done = size = 0

    def line(part: str) -> str:
        odd = [w for w in _WORD.findall(part) if _LEGACY_CHAR.search(w)]
        if not odd:
            return part
        most = 2 * sum(first in cost.gains(w) for w in odd) >= len(odd)

        def fix(m: re.Match) -> str:
            nonlocal done, size
            word = m.group()
            if not _LEGACY_CHAR.search(word):
                return word
            ways = cost.gains(word)
            new = ways[first][0] if first in ways else _follows(word, first, cost, most)
            if not new and ways:
                new = max(ways.values(), key=lambda x: (x[1], x[0]))[0]
            if not new:
                return word
            done, size = done + 1, size + sum(not c.isascii() for c in word)
            return new

        return _WORD.sub(fix, part)

    return "\n".join(map(line, text.split("\n"))), done, size


def repair(text: str, cost: PairCost | None = None) -> tuple[str, int, int, int]:
    """(restored text, stretches restored, layers peeled, characters lost for good)."""
    if not text or text.isascii():
        return text or "", 0, 0, 0
    stretches = layers = 0
    while True:
        # The page that explains most characters goes first: a wrong one leaves some of them.
        best, most, count = text, (0, 0.0), 0
        for new, n, gain in [_utf8_layer(text, name) for name in _pages_with_runs(text)] + _wide_layers(text):
            if gain > most:
                best, most, count = new, gain, n
        if cost is not None:
            # Legacy bytes hold UTF-8 characters by chance, but these explain only a few of them.
            new, n, size = _legacy_layer(text, cost)
            if n and size >= 2 * most[0]:
                best, count = new, n
        if not count:
            break
        text, stretches, layers = best, stretches + count, layers + 1
    return text, stretches, layers, len(_LOST.findall(text))


class _Pairs:
    """Sums ``word_pairs`` over the texts of one partition."""

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        texts = 0
        for batch in batches:
            for text, n in zip(batch["text"], batch["n"]):
                texts += n
                if text and not text.isascii():
                    seen.update(dict.fromkeys(word_pairs(text), n))
        rows = [*seen.items(), ("", texts)]
        yield pd.DataFrame({"pair": [k for k, _ in rows], "n": [v for _, v in rows]})


def corpus_pairs(docs: DataFrame, text: str = "text") -> PairCost:
    """The pair cost of a corpus, counted over all its distinct texts; repeated ones count twice, however many.

    Characters outside the legacy alphabets count as one symbol, so the table is bounded by
    the square of these, not by the corpus; counts are summed per partition before the shuffle.
    """
    counted = (
        docs.select(F.col(text).alias("text"))
        .where("text IS NOT NULL")
        .groupBy("text")
        .agg(F.least(F.count("*"), F.lit(2)).alias("n"))
        .mapInPandas(_Pairs(), "pair string, n long")
        .groupBy("pair")
        .agg(F.sum("n").alias("n"))
        .where("n > 1 OR pair = ''")
    )
    table = {r.pair: r.n for r in counted.toLocalIterator()}
    return PairCost(table, table.pop("", 0))


def repair_documents(docs: DataFrame, cost: PairCost, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, restored, stretches, layers, lost) of every document with a garbled stretch.

    ``stretches`` counts what was restored, ``layers`` the wrong readings peeled, ``lost`` the
    characters that cannot be had back. Texts within ASCII, empty and null texts are no case.
    """
    held = docs.sparkSession.sparkContext.broadcast((cost.pairs, cost.free))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = PairCost(held.value[0], 0)
        own.free = held.value[1]
        for batch in batches:
            rows = []
            for k, t in zip(batch["key"], batch["text"]):
                new, n, layers, lost = repair(t, own)
                if n or lost:
                    rows.append((k, t, new, n, layers, lost))
            yield pd.DataFrame(rows, columns=["key", "text", "restored", "stretches", "layers", "lost"])

    return (
        docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
        .where(F.col("text").rlike("[^\\x00-\\x7f]"))
        .mapInPandas(run, f"key {kind}, text string, restored string, stretches int, layers int, lost int")
        .withColumnRenamed("key", key)
    )
