"""Personal data in free text: find each occurrence with its type, and redact it readably.

Method: candidate gradient boosting. High-recall generators propose overlapping spans of five
kinds, boosted trees judge each by its format and its context, and per kind a threshold
calibrated on held-out texts selects. Overlaps go to the higher score.

Labels are the spans the detectors stored: incomplete, sometimes cut short or of the wrong
kind. A candidate is positive where a stored span of its kind has exactly its bounds; spans
with an unknown kind take their candidate out of the training. Since the labels miss
occurrences, a score is the chance that an occurrence is labelled: the chance that a candidate
is personal data is that score over the mean score of held-out labelled ones, and the threshold
is where leaving it costs as much as redacting it (``MISS_COST``). The trees and the context rates are fitted on ``TRAIN_TEXTS``
texts at most, chosen by hash, of up to ``TRAIN_LENGTH`` characters; how often a word stands in
names and addresses is counted over all spans and all texts, in a sketch of fixed size.

Placeholders of an earlier redaction are no candidates.

Everything is found on a shadow of the text - invisible characters dropped, wide forms,
blanks and look-alike letters in one spelling - that remembers the places in the original.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.llm import boost, lookalike
from veilspan.llm.sampling import hash_sample

KINDS = ["private_person", "private_email", "private_phone", "account_number", "private_address"]
PERSON, EMAIL, PHONE, ACCOUNT, ADDRESS = range(5)
#: Texts the trees are fitted on, at most; and of one text, the characters up to which it may serve.
TRAIN_TEXTS = 1500
TRAIN_LENGTH = 6000
#: What a missed occurrence costs where a false one costs 1.
MISS_COST = 2.0
#: Columns of the sketch of word counts, which has two rows.
BUCKETS = 1 << 20
#: Sub-spans of a row of names have at most so many words; a longer row is proposed as a whole.
NAME_WORDS = 5


def span_kind(kind: Column) -> Column:
    """Index of the kind a detector's label means; -1 for a label that may mean any."""
    k = F.lower(F.coalesce(kind, F.lit("")))
    return (
        F.when(k.rlike("address|location|street"), ADDRESS)
        .when(k.rlike("mail"), EMAIL)
        .when(k.rlike("phone|tele"), PHONE)
        .when(k.rlike("person|name"), PERSON)
        .when(k.rlike("account|card|number|national|iban"), ACCOUNT)
        .otherwise(-1)
    )


# ---------------------------------------------------------------- shadow text

_CLUSTER = re.compile("[^̀-ͯ][̀-ͯ]+|[ᄀ-ᄒ][ᅡ-ᅵ][ᆨ-ᇂ]?|[ｦ-ﾟ][ﾞﾟ]?")
_CHANGES = re.compile(_CLUSTER.pattern + "|[" + "".join(re.escape(chr(c)) for c in lookalike._spellings()) + "]")


def shadow(text: str) -> tuple[str, np.ndarray | None, np.ndarray | None]:
    """(shadow, starts, ends): per shadow character the bounds of what it stands for; None for the same places."""
    if text.isascii():
        return text, None, None
    table = lookalike._spellings()
    out: list[str] = []
    starts: list[int] = []
    ends: list[int] = []
    at, moved = 0, False
    for m in _CHANGES.finditer(text):
        a, b = m.span()
        out.append(text[at:a])
        starts.extend(range(at, a))
        ends.extend(range(at + 1, a + 1))
        old = m.group()
        new = (table.get(ord(old)) or "") if b - a == 1 else unicodedata.normalize("NFKC" if old[0] >= "ｦ" else "NFC", old)
        out.append(new)
        starts.extend([a] * len(new))
        ends.extend([b] * len(new))
        moved = moved or len(new) != b - a
        at = b
    if not at:
        return _unmixed(text), None, None
    out.append(text[at:])
    if not moved:
        return _unmixed("".join(out)), None, None
    starts.extend(range(at, len(text)))
    ends.extend(range(at + 1, len(text) + 1))
    return _unmixed("".join(out)), np.array(starts), np.array(ends)


def _unmixed(text: str) -> str:
    """Mixed-script tokens in their dominant script, numbers with letters in Latin; length stays."""
    if not lookalike._OTHER_SCRIPT.search(text):
        return text
    around = lookalike.context(text)

    def spell(m: re.Match) -> str:
        t = m.group()
        if t.isascii():
            return t
        return lookalike.spelled(t, "latin" if any(map(str.isdigit, t)) else around)

    return lookalike.TOKEN.sub(spell, text)


# ---------------------------------------------------------------- generators

_WORD = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
_CAPITAL = re.compile(r"(?<![^\W\d_])[A-ZÀ-ÖØ-ÞĀ-ŽΑ-ΩА-ЯЁІ][^\W\d_]*(?:[-'’][^\W\d_]+)*")
_AT = re.compile(r" ?(?:@|[\[(] ?at ?[\])]) ?", re.I)
#: The part before the @, read from right to left.
_LOCAL = re.compile(r"(?:[\w+\-%]|(?<=[\w+\-%])\.(?=[\w+\-%])| ?[\])]tod[\[(] ?)+", re.I)
_DOMAIN = re.compile(r"[^\W_](?:[\w\-]*[^\W_])?(?:(?:\.| ?[\[(]dot[\])] ?)[^\W_](?:[\w\-]*[^\W_])?)+", re.I)
_NUMBER = re.compile(r"(?<![0-9A-Za-z+])(?:\+|\()?[0-9](?:[ .\-/()]{0,3}[0-9]){6,18}(?![0-9A-Za-z])")
_DATE = re.compile(r"[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{1,2}([./-])[0-9]{1,2}\1[0-9]{4}")
_MIXED_ID = re.compile(r"(?<![0-9A-Za-z])[A-Z]{1,2}[ \-]?[0-9](?:[ \-]?[0-9]){4,8}[ \-]?[A-Z](?![0-9A-Za-z])", re.I)
_HOUSE = re.compile(r"(?<![\w/.\-:#])[0-9]{1,4}[A-Za-z]?(?![\w/:]|[.,\-][0-9])")
#: A unit before a house number, read from right to left.
_UNIT = re.compile(r" ,[A-Za-z]?[0-9]{1,4} \.?[^\W\d_]+")
_STREET_RIGHT = re.compile(r" [^\W\d_][\w'’.\-]*(?: [^\W\d_][\w'’.\-]*)*?(?=,? ?\n|, )")
_PLACE = re.compile(r"(?:, ?|,? ?\n| in )(?:([0-9]{3,6}(?: [A-Z]{2})?) )?([^\W\d_][\w'’\-]*(?: [^\W\d_][\w'’\-]*){0,4})(?: ([0-9]{4,6}(?![\w,.][0-9])))?")
_JP = re.compile(r"(?:〒[0-9]{3}-?[0-9]{4}[ \n]?)?[一-龥]{1,4}[県都府道][一-龥ァ-ヶぁ-ん]{1,8}?[市区町村郡][一-龥ァ-ヶぁ-ん]{1,10}?[0-9]+(?:丁目[0-9]+番(?:地)?(?:[0-9]+号)?|(?:-[0-9]+)*)")
_KR = re.compile(r"(?:\([0-9]{5}\) |[0-9]{5} )?[가-힣]{2,6}(?:시|도|군) (?:[가-힣]{1,6} ){0,2}[가-힣0-9]{1,8}(?:로|길|동|가)(?: ?[0-9]{1,3}번길)? [0-9]{1,4}(?:-[0-9]+)?(?:, [0-9]+호)?")
_HANGUL = re.compile(r"(?<![가-힣])[가-힣]{2,8}")
_JNAME_END = re.compile(r"(?<=[一-龥々ァ-ヶー])(?=さん|様|氏|殿|:|：|。|\.|\n|$|、|,)")


def buckets(role: str, word: str) -> tuple[int, int]:
    """Columns of a word in both rows of the sketch, by role: t any text, p names, v whole names, f first and l last word of addresses."""
    h = xxhash.xxh3_64_intdigest(f"{role}:{word.lower()}".encode("utf-8", "replace"))
    return h & (BUCKETS - 1), BUCKETS + ((h >> 32) & (BUCKETS - 1))


class Counts:
    """Word counts of the corpus in a count-min sketch, with remembered look-ups.

    ``table`` holds both rows one after the other. ``least`` is what words that were never
    counted may show by sharing columns (the sketch's error bound, which grows with the
    corpus), and one chance hit of the labels.
    """

    def __init__(self, table: np.ndarray):
        self.table = table
        self.least = 2 + math.e * float(table[:BUCKETS].sum(dtype=np.float64)) / BUCKETS * float((table[:BUCKETS] > 0).mean())
        self.known: dict[tuple[str, str], int] = {}

    def __call__(self, role: str, word: str) -> int:
        key = (role, word)
        n = self.known.get(key)
        if n is None:
            if len(self.known) > 200_000:
                self.known.clear()
            a, b = buckets(role, word)
            n = self.known[key] = int(min(self.table[a], self.table[b]))
        return n

    def name(self, word: str) -> float:
        """Share of a word's occurrences that stand in a name, as far as known."""
        n = self("p", word)
        return n / (self("t", word) + 3) if n >= self.least else 0.0


#: A bracket with or without an ordinal or code at its end.
_BRACKET = re.compile(r"\[([^\[\]\n]+?)(:[0-9]+|:[0-9a-z]{6})?\]")
_KIND_WORD = re.compile("ADDRESS|LOCATION|STREET|MAIL|PHONE|PERSON|NAME|ACCOUNT|CARD|NUMBER|IBAN|DATE|URL|SECRET|CUSTOM")


def placeholders(s: str) -> list[tuple[int, int]]:
    """Bounds of the placeholders of a redacted text: a kind in capitals in brackets, with or without its index."""
    if "[" not in s:
        return []
    return [m.span() for m in _BRACKET.finditer(s) if m.group(1) == m.group(1).upper() and any(map(str.isalpha, m.group(1))) and (m.group(2) or "_" in m.group(1) or _KIND_WORD.search(m.group(1)))]


def candidates(s: str, counts: Counts) -> list[tuple[int, int, int, int]]:
    """(start, end, kind, generator) proposals on a shadow text; they overlap."""
    out: list[tuple[int, int, int, int]] = []
    n, back = len(s), ""
    for m in _AT.finditer(s):
        back = back or s[::-1]
        head = _LOCAL.match(back, n - m.start())
        tail = _DOMAIN.match(s, m.end()) if head else None
        if tail:
            a = n - head.end()
            a += len(s[a : m.start()]) - len(s[a : m.start()].lstrip())
            out.append((a, tail.end(), EMAIL, 0))
    for m in _NUMBER.finditer(s):
        a, b = m.span()
        if b - a <= 10 and _DATE.fullmatch(s, a, b):
            continue
        if sum(map(str.isdigit, m.group())) < 16:
            out.append((a, b, PHONE, 1))
        if s[a] not in "+(":
            out.append((a, b, ACCOUNT, 1))
    for m in _MIXED_ID.finditer(s):
        out.append((m.start(), m.end(), ACCOUNT, 2))
    _addresses(s, counts, out)
    _names(s, counts, out)
    held = placeholders(s)
    if held:
        starts = [a for a, _ in held]
        out = [c for c in out if not (k := bisect_left(starts, c[1])) or held[k - 1][1] <= c[0]]
    return list(dict.fromkeys(out))


def _addresses(s: str, counts: Counts, out: list) -> None:
    east = not s.isascii()
    if east:
        out += [(m.start(), m.end(), ADDRESS, 3) for m in _JP.finditer(s)]
        for m in _KR.finditer(s):
            out.append((m.start(), m.end(), ADDRESS, 4))
            comma = s.find(",", m.start(), m.end())
            if comma > 0:
                out.append((m.start(), comma, ADDRESS, 4))
    back = ""
    for m in _HOUSE.finditer(s):
        a, b = m.span()
        # House number first: the street to the right, then the place.
        street = _STREET_RIGHT.match(s, b)
        if street:
            ends = _places(s, street.end(), counts)
            unit = None
            if ends and s[max(0, a - 2) : a] == ", ":
                back = back or s[::-1]
                unit = _UNIT.match(back, len(s) - a)
            for end in ends:
                out.append((a, end, ADDRESS, 5))
                if unit:
                    out.append((len(s) - unit.end(), end, ADDRESS, 5))
        # Street first: all words to the left up to a number, a comma between allowed.
        stop = a - 2 if s[max(0, a - 2) : a] == ", " else a - 1 if s[max(0, a - 1) : a] == " " else -1
        if stop > 0 and s[stop - 1].isalpha():
            ends = None
            at = stop
            while True:
                first = at
                while first > 0 and (s[first - 1].isalnum() or s[first - 1] in "'’.-"):
                    first -= 1
                if first == at or s[first].isdigit():
                    break
                if counts("f", s[first:at]) > counts.least:
                    ends = _places(s, b, counts) if ends is None else ends
                    out += [(first, end, ADDRESS, 6) for end in ends]
                    if not ends:
                        break
                if first == 0 or s[first - 1] != " ":
                    break
                at = first - 1


def _places(s: str, at: int, counts: Counts) -> list[int]:
    """Where an address may end that has its street end at ``at``."""
    m = _PLACE.match(s, at)
    if not m:
        return []
    ends = []
    if m.group(3):
        ends.append(m.end(3))
    base = m.start(2)
    for w in re.finditer(r"\S+", m.group(2)):
        word = w.group()
        if word[0].isupper() and (counts("l", word) > counts.least or m.group(1) or m.group(3)):
            ends.append(base + w.end())
    return ends


def _names(s: str, counts: Counts, out: list) -> None:
    # Tokens of a row, whether each is surely a name, and whether a plain blank stands before it.
    row: list[tuple[int, int, bool, bool]] = []

    def propose(i: int, j: int) -> None:
        a, b = row[i][0], row[j][1]
        if any(s[row[k][1] - 1] != "." for k in range(i, j + 1)) and (s[b - 1] != "." or "," in s[a:b]):
            out.append((a, b, PERSON, 7))

    def flush() -> None:
        n = len(row)
        # Whether so many sure tokens stand side by side that they may be several names.
        several = [False] * n
        i = 0
        while i < n:
            j = plain = i + 1
            while j < n and row[j][3] and row[j][2] and row[j - 1][2]:
                j += 1
            if j - i > 3:
                several[i:j] = [True] * (j - i)
            while plain < n and row[plain][3]:
                plain += 1
            if plain - i > NAME_WORDS and not (i and row[i][3]):
                propose(i, plain - 1)
            i = j
        for i in range(n):
            # A span may start or end inside a row only next to a doubtful token or an unusual gap.
            if i and row[i][3] and row[i - 1][2] and not several[i]:
                continue
            for j in range(i, min(n, i + NAME_WORDS)):
                if j + 1 < n and row[j + 1][3] and row[j + 1][2] and not several[j]:
                    continue
                propose(i, j)
        row.clear()

    last = -9
    for m in _CAPITAL.finditer(s):
        a, b = m.span()
        share = 0.0
        if b - a == 1:
            if s[b : b + 1] != ".":
                continue
            b += 1
        else:
            share = counts.name(m.group())
            if share < 0.02:
                continue
        gap = s[last:a] if row else ""
        if row and gap not in (" ", ", ", "\n", "  ", ",\n"):
            flush()
        row.append((a, b, share > 0.5, gap == " "))
        last = b
    flush()
    if s.isascii():
        return
    for m in _HANGUL.finditer(s):
        a = m.start()
        for b in range(a + 2, min(m.end(), a + 6) + 1):
            if counts("v", s[a:b]) > counts.least:
                out.append((a, b, PERSON, 8))
        nxt = _HANGUL.match(s, m.end() + 1) if s[m.end() : m.end() + 1] == " " and m.end() - a <= 3 else None
        if nxt:
            for b in range(nxt.start() + 2, min(nxt.end(), nxt.start() + 5) + 1):
                if counts("v", s[nxt.start() : b]) > counts.least and counts("v", s[a:b]) > 0:
                    out.append((a, b, PERSON, 9))
    for m in _JNAME_END.finditer(s):
        b = m.start()
        for n in range(2, 10):
            a = b - n
            if a < 0 or not ("一" <= s[a] <= "龥" or "ァ" <= s[a] <= "ヶ"):
                if a < 0 or s[a] not in " 々ーノヶケ":
                    break
                continue
            if counts("v", s[a:b]) > counts.least or (n >= 4 and counts("v", s[a:b]) > 0):
                out.append((a, b, PERSON, 10))


# ---------------------------------------------------------------- features

_DIGITS = str.maketrans("123456789", "000000000")
_DIGIT = re.compile("[1-9]")
_TOKENS = re.compile(r"\w+|[^\w\s]|\n")
_BEFORE = re.compile(r"([^\W\d_][\w'’-]*)[ ,]{1,2}$")
_AFTER = re.compile(r"[ ,]{1,2}(?:[^\W\d_]\. )?([^\W\d_][\w'’-]*)")
_CJK = "\u3040"


def _zeroed(text: str) -> str:
    """Every digit as 0; most contexts hold none."""
    return text.translate(_DIGITS) if _DIGIT.search(text) else text


def _pattern(text: str, kind: int) -> str:
    if kind == EMAIL:
        return "e"
    out = text.translate(_DIGITS)
    return out if kind in (PHONE, ACCOUNT) and not any(c.isalpha() for c in out) else re.sub(r"[^\W\d_]+", lambda m: "A" if m.group().isupper() else "a", out)[:40]


class _Sides:
    """What stands before and after a place of a text, remembered per place."""

    def __init__(self, s: str, counts: Counts):
        self.s, self.counts = s, counts
        self.left: dict[int, tuple[str, str, float, float]] = {}
        self.right: dict[int, tuple[str, str, float, float]] = {}

    def before(self, a: int) -> tuple[str, str, float, float]:
        """The word, the two words (CJK: one and three characters), and how much a name or address the word before is."""
        if a not in self.left:
            raw = self.s[max(0, a - 28) : a]
            text = _zeroed(raw.lower())
            w = _TOKENS.findall(text)
            one, two = " ".join(w[-1:]), " ".join(w[-2:])
            if one and one[-1] > _CJK:
                one, two = text[-1:], text[-3:]
            m = _BEFORE.search(raw)
            name = self.counts.name(m.group(1)) if m and m.group(1)[0].isupper() else 0.0
            self.left[a] = (one, two, name, float(np.log1p(self.counts("f", m.group(1)))) if m else 0.0)
        return self.left[a]

    def after(self, b: int) -> tuple[str, str, float, float]:
        if b not in self.right:
            raw = self.s[b : b + 28]
            text = _zeroed(raw.lower())
            w = _TOKENS.findall(text)
            one, two = " ".join(w[:1]), " ".join(w[:2])
            if one and one[0] > _CJK:
                one, two = text.strip()[:1], text.strip()[:2]
            m = _AFTER.match(raw)
            capital = m and m.group(1)[0].isupper()
            name = self.counts.name(m.group(1)) if capital else 0.0
            self.right[b] = (one, two, name, float(np.log1p(self.counts("l", m.group(1)))) if capital and raw[0] == " " else 0.0)
        return self.right[b]


def _luhn(digits: str) -> bool:
    t = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        t += d - 9 if d > 9 else d
    return t % 10 == 0


ROLES = ("l1", "l2", "r1", "r2", "pat")


class Rates:
    """Share of labelled candidates by a word of the context or by the pattern, smoothed to the kind's mean."""

    def __init__(self) -> None:
        self.hits: dict[tuple[int, str, str], list[float]] = defaultdict(lambda: [0.0, 0.0])
        self.mean = [[0.0, 1e-9] for _ in KINDS]

    def add(self, kind: int, keys: tuple[str, ...], y: float) -> None:
        self.mean[kind][0] += y
        self.mean[kind][1] += 1
        for role, key in zip(ROLES, keys):
            cell = self.hits[kind, role, key]
            cell[0] += y
            cell[1] += 1

    def frozen(self) -> tuple[dict, list[float]]:
        mean = [a / b for a, b in self.mean]
        return {k: ((a + 4 * mean[k[0]]) / (n + 4)) for k, (a, n) in self.hits.items() if n >= 3}, mean


_LONGER = re.compile(r" [0-9]{4,6}(?![0-9])")
_EDGE = {"": 0, "\n": 0, " ": 1, ":": 2, "：": 2, ".": 3, "。": 3, ",": 4, "、": 4}


def describe(s: str, spans: list[tuple[int, int, int, int]], counts: Counts) -> tuple[list[list[float]], list[tuple[str, ...]]]:
    """Plain features and context keys of the candidates of one shadow text."""
    rows, keys = [], []
    sides = _Sides(s, counts)
    for a, b, kind, gen in spans:
        v = s[a:b]
        l1, l2, left_name, left_first = sides.before(a)
        r1, r2, right_name, right_last = sides.after(b)
        digits = "".join(filter(str.isdigit, v)) if kind != PERSON else ""
        n_words = 0
        if kind == PERSON:
            words = _WORD.findall(v)
            n_words = len(words)
            parts = [counts.name(w) for w in words if len(w) > 1] or [0.0]
            extra = [min(parts), max(parts), sum(parts) / len(parts), left_name, right_name, float(np.log1p(counts("v", v))) if gen >= 8 else 0.0]
            pattern = str(gen)
        elif kind == ADDRESS:
            words = v.replace(",", " ").split()
            n_words = len(words)
            f = counts("f", words[0]) if words else 0
            extra = [
                float(np.log1p(f)),
                float(np.log1p(counts("l", words[-1]))) if words else 0.0,
                right_last,
                left_first,
                1.0 if _LONGER.match(s, b) else 0.0,
                float(counts("t", words[0]) + 1) ** -0.5 if words else 0.0,
            ]
            pattern = _pattern(v, kind)
        else:
            seps = [c for c in v if not c.isalnum()]
            extra = [float(_luhn(digits)) if len(digits) > 8 else 0.5, len(seps), len(set(seps)), float(v[0] in "+("), float(digits[:1] == "0"), float(digits[:4] == "9999")]
            pattern = _pattern(v, kind)
        keys.append((l1, l2, r1, r2, pattern))
        before, after = s[a - 1 : a] if a else "", s[b : b + 1]
        edge = [_EDGE.get(before, 5 if before.isalnum() else 6), _EDGE.get(after, 5 if after.isalnum() else 6)]
        rows.append([kind, gen, b - a, len(digits), n_words, float(before in ("", "\n")), *edge, float(v.isupper()), float("," in v), float("\n" in v), *extra])
    return rows, keys


def matrix(rows: list[list[float]], keys: list[tuple[str, ...]], rates: tuple[dict, list[float]]) -> np.ndarray:
    table, mean = rates
    x = np.array(rows, np.float64)
    add = np.array([[table.get((int(r[0]), role, k), mean[int(r[0])]) for role, k in zip(ROLES, ks)] for r, ks in zip(rows, keys)])
    return np.hstack([x, add])


class Detector:
    """Fitted trees, context rates, thresholds and corpus counts."""

    def __init__(self, model: boost.Boosted, rates: tuple[dict, list[float]], limits: list[float], counts: Counts):
        self.model, self.rates, self.limits, self.counts = model, rates, limits, counts

    def find(self, texts: list[str]) -> list[list[tuple[int, int, int, float]]]:
        """(start, end, kind, score) of the selected spans of each text, in order."""
        shadows = [shadow(t) for t in texts]
        proposed = [candidates(s, self.counts) for s, _, _ in shadows]
        rows, keys = [], []
        for (s, _, _), spans in zip(shadows, proposed):
            r, k = describe(s, spans, self.counts)
            rows += r
            keys += k
        out: list[list[tuple[int, int, int, float]]] = []
        score = self.model.predict(matrix(rows, keys, self.rates)) if rows else np.zeros(0)
        at = 0
        for (s, starts, ends), spans in zip(shadows, proposed):
            p = score[at : at + len(spans)]
            at += len(spans)
            good = [(q, b - a, a, b, k, q) for (a, b, k, _), q in zip(spans, p) if q >= self.limits[k]]
            good.sort(key=lambda g: (-g[0], -g[1], g[2], g[4]))
            taken: list[tuple[int, int, int, float]] = []
            for _, _, a, b, k, q in good:
                if all(b <= c or d <= a for c, d, _, _ in taken):
                    taken.append((a, b, k, float(q)))
            if starts is not None:
                taken = [(int(starts[a]), int(ends[b - 1]), k, q) for a, b, k, q in taken]
            out.append(sorted(taken))
        return out


def fit(texts: list[str], spans: list[list[tuple[int, int, int]]], counts: Counts) -> Detector:
    """Fit on texts with stored spans (start, end, kind index or -1).

    The context rates of one half of the texts come from the other half, so the trees see
    them as they will be on new texts; one text in five sets the thresholds.
    """
    data = []
    for t, known in zip(texts, spans):
        s, starts, ends = shadow(t)
        props = candidates(s, counts)
        marks = defaultdict(set)
        for a, b, k in known:
            marks[a, b].add(k)
        ys = []
        for a, b, k, _ in props:
            where = (a, b) if starts is None else (int(starts[a]), int(ends[b - 1]))
            kinds = marks.get(where, set())
            ys.append(1.0 if k in kinds else None if kinds else 0.0)
        rows, keys = describe(s, props, counts)
        keep = [i for i, y in enumerate(ys) if y is not None]
        data.append((np.array(rows, np.float32)[keep] if keep else [], [keys[i] for i in keep], [ys[i] for i in keep]))

    def rates(parts: list[int]) -> Rates:
        r = Rates()
        for i in parts:
            for row, key, y in zip(*data[i]):
                r.add(int(row[0]), key, y)
        return r

    halves = [[i for i in range(len(data)) if i % 2 == h] for h in (0, 1)]
    cross = [rates(halves[1]).frozen(), rates(halves[0]).frozen()]
    xs, ys, held = [], [], []
    for i, (rows, keys, y) in enumerate(data):
        if len(rows):
            xs.append(matrix(rows, keys, cross[i % 2]))
            ys += y
            held += [i % 5 == 4] * len(y)
    if not xs or not any(ys):
        return Detector(boost.Boosted([np.zeros(0)] * 22, [], -9.0), ({}, [0.0] * 5), [0.5] * 5, counts)
    x, y, h = np.vstack(xs), np.array(ys), np.array(held)
    limits = [0.3] * len(KINDS)
    if h.any() and y[~h].any():
        p = boost.fit(x[~h], y[~h]).predict(x[h])
        for k in range(len(KINDS)):
            rows = x[h][:, 0] == k
            limits[k] = threshold(p[rows], y[h][rows])
    return Detector(boost.fit(x, y), rates(list(range(len(data)))).frozen(), limits, counts)


def threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The score from which leaving a candidate costs more than redacting it.

    Labels miss occurrences at random, so labelled candidates show how high scores of true
    ones are on average: that mean is the chance that an occurrence is labelled. With too few
    held-out labels every occurrence is taken as labelled.
    """
    labelled = float(p[y > 0.5].mean()) if y.sum() >= 20 else 1.0
    return labelled / (1 + MISS_COST)


# ---------------------------------------------------------------- Spark

def count_words(texts: DataFrame, spans: DataFrame) -> Counts:
    """Counts over all texts (``text``) and all stored spans (``value``, ``kind`` index), summed per partition first."""

    def of_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: Counter = Counter()
        for batch in batches:
            for t in batch["text"]:
                words.update(_CAPITAL.findall(shadow(t)[0]))
        yield _rows([("t", w, n) for w, n in words.items()])

    def of_spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for batch in batches:
            for v, k in zip(batch["value"], batch["kind"]):
                s = shadow(v)[0]
                words = _WORD.findall(s)
                if k == PERSON:
                    seen.update(("p", w) for w in words if w[0].isupper())
                    if not s.isascii():
                        seen["v", s] += 1
                elif k == ADDRESS and words:
                    head = re.match(r"[^\s,]+", s)
                    seen["f", head.group() if head else ""] += 1
                    seen["l", words[-1]] += 1
        yield _rows([(r, w, n) for (r, w), n in seen.items()])

    def _rows(items: list[tuple[str, str, int]]) -> pd.DataFrame:
        total: Counter = Counter()
        for r, w, n in items:
            for b in buckets(r, w):
                total[b] += n
        return pd.DataFrame({"bucket": list(total.keys()), "n": list(total.values())}, dtype="int64")

    one = texts.select("text").mapInPandas(of_texts, "bucket long, n long")
    two = spans.where(F.col("kind").isin(PERSON, ADDRESS)).select("value", "kind").mapInPandas(of_spans, "bucket long, n long")
    found = one.unionByName(two).groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(2 * BUCKETS, np.float32)
    table[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return Counts(table)


def training_texts(texts: DataFrame, spans: DataFrame) -> tuple[list[str], list[list[tuple[int, int, int]]]]:
    """At most ``TRAIN_TEXTS`` texts with their stored spans.

    ``texts`` has key and text, ``spans`` key, kind, value, start and end. Twice as many texts
    are drawn by hash, since some have no span; a span counts if the text has its value there.
    """
    drawn = hash_sample(texts.where(F.length("text").between(1, TRAIN_LENGTH)), ["key", "text"], 2 * TRAIN_TEXTS)
    # The drawn texts are bounded by number and length, and so is their broadcast.
    held = (
        spans.join(F.broadcast(drawn), "key")
        .where((F.col("start") >= 0) & (F.col("end") > F.col("start")) & (F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")) == F.col("value")))
        .select("key", "text", "start", "end", "kind")
        .groupBy("key")
        .agg(F.first("text").alias("text"), F.collect_set(F.struct("start", "end", "kind")).alias("spans"))
        .collect()
    )
    held = sorted(held, key=lambda r: zlib.crc32(r.key.encode()))[:TRAIN_TEXTS]
    return [r.text for r in held], [sorted((x.start, x.end, x.kind) for x in r.spans) for r in held]


def find_spans(items: DataFrame, detector: Detector, key: list[str], text: str, redact: bool = False) -> DataFrame:
    """Selected spans: key, pii_kind, pii_start, pii_end, score; or with ``redact`` key and the redacted text.

    Null and empty texts have no spans, and are left out. Offsets count code points of the
    stored text. A placeholder is the kind in capitals in brackets.
    """
    held = items.sparkSession.sparkContext.broadcast((detector.model, detector.rates, detector.limits, detector.counts.table))
    types = {c: items.schema[c].dataType.simpleString() for c in key}
    schema = ", ".join(f"`{c}` {t}" for c, t in types.items())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, rates, limits, table = held.value
        own = Detector(model, rates, limits, Counts(table))
        for batch in batches:
            rows = []
            texts = batch[text].tolist()
            for at in range(0, len(texts), 64):
                part = texts[at : at + 64]
                for i, spans in enumerate(own.find(part)):
                    head = [batch[c].iloc[at + i] for c in key]
                    if redact:
                        rows.append((*head, redacted(part[i], spans), len(spans)))
                    else:
                        rows += [(*head, KINDS[k], a, b, q) for a, b, k, q in spans]
            yield pd.DataFrame(rows, columns=[*key, *(["redacted", "spans"] if redact else ["pii_kind", "pii_start", "pii_end", "score"])])

    given = items.select(*key, text).where(F.length(text) > 0)
    return given.mapInPandas(run, f"{schema}, redacted string, spans int" if redact else f"{schema}, pii_kind string, pii_start int, pii_end int, score double")


def redacted(text: str, spans: list[tuple[int, int, int, float]]) -> str:
    """The text with a typed placeholder for each span."""
    out, at = [], 0
    for a, b, k, _ in spans:
        out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = b
    return "".join(out) + text[at:]
