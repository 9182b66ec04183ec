"""Oversized texts cut into overlapping pieces under a size limit, at natural boundaries.

Method: balanced targets. The least number of pieces is computed, equal-length targets are
placed, and each target snaps to the strongest boundary nearby; when a limit fails, pieces
are added and the targets placed anew. A piece repeats ``overlap`` characters of the piece
before, or fewer when a natural start lies within that reach.

All sizes count Unicode code points. Null and empty texts and texts within the limit are one
piece, which ``split_items`` does not return unless asked to.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 4000
OVERLAP = 200

#: Boundaries from the strongest down; a match ends where a piece may end.
BOUNDARIES = [
    ("paragraph", re.compile(r"\n[ \t\r]*\n\s*")),
    ("line", re.compile(r"\n[ \t]*")),
    ("sentence", re.compile(r"[.!?…][\"'”’»)\]]*[ \t ]+|[。！？]+[」』”)）]*")),
    ("clause", re.compile(r"[;:,–—][ \t]+|[、，；：]")),
    ("word", re.compile(r"[ \t  - 　]+")),
]


def _whole(text: str, at: int) -> bool:
    """Whether a cut before ``at`` keeps characters whole (no mark, joiner or low part follows)."""
    if at <= 0 or at >= len(text):
        return True
    here, before = text[at], text[at - 1]
    return not (unicodedata.category(here) in ("Mn", "Mc", "Me") or here in "‍️︎⃣" or before == "‍" or "\U0001f3fb" <= here <= "\U0001f3ff" or (before == "\r" and here == "\n"))


def _snap(text: str, target: int, low: int, high: int, reach: int) -> tuple[int, str]:
    """The cut in [low, high] for ``target``: the strongest boundary within reach, else within the limits."""
    for a, b in ((max(low, target - reach), min(high, target + reach)), (low, high)):
        if a > b:
            continue
        for name, pattern in BOUNDARIES:
            best = -1
            for m in pattern.finditer(text, max(0, a - 80), min(len(text), b + 80)):
                end = m.end()
                if a <= end <= b and (best < 0 or abs(end - target) < abs(best - target)):
                    best = end
            if best >= 0:
                return best, name
    at = min(max(target, low), high)
    while at > low and not _whole(text, at):
        at -= 1
    return (at if at > low else min(max(target, low), high)), "character"


def _natural_start(text: str, cut: int, overlap: int, floor: int) -> int:
    """Where the piece after ``cut`` starts: the earliest strong start within ``overlap`` before it."""
    low = max(floor, cut - overlap)
    for name, pattern in BOUNDARIES:
        if name == "clause":
            continue
        starts = [m.end() for m in pattern.finditer(text, max(0, low - 80), cut) if low <= m.end() < cut]
        if name != "word":
            starts = [s for s in starts if cut - s >= overlap // 2]
        if starts:
            return starts[0]
    while low < cut and not _whole(text, low):
        low += 1
    return low


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, str]]:
    """(start, end, repeated, boundary) of each piece; ``repeated`` characters stand in the piece before."""
    if limit <= overlap or limit < 1:
        raise ValueError("the limit must exceed the overlap")
    n = len(text)
    if n <= limit:
        return [(0, n, 0, "end")]
    count = max(2, -(-(n - overlap) // (limit - overlap)))
    while True:
        cut = _try(text, n, count, limit, overlap)
        if cut:
            return cut
        count += 1


def _try(text: str, n: int, count: int, limit: int, overlap: int) -> list[tuple[int, int, int, str]] | None:
    out, start, cut = [], 0, 0
    for i in range(count - 1):
        left = count - i
        # What is left, with one overlap for each further piece, in equal parts.
        length = -(-(n - start + overlap * (left - 1)) // left)
        high = min(start + limit, n - 1)
        low = min(max(cut + 1, start + length // 2), high)
        end, name = _snap(text, min(start + length, high), low, high, max(1, length // 8))
        out.append((start, end, cut - start, name))
        start = _natural_start(text, end, overlap, cut + 1 if i else 1)
        cut = end
    if n - start > limit:
        return None
    out.append((start, n, cut - start, "end"))
    return out


def split_items(items: DataFrame, key: list[str], text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of every text over the limit: key, piece_no, pieces, start, end, repeated, boundary, piece.

    Texts within the limit need no cut and stay out; the length filter runs before any text
    reaches Python. One row of the input is one item, also when keys repeat.
    """
    types = {c: items.schema[c].dataType.simpleString() for c in key}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [*key, "piece_no", "pieces", "start", "end", "repeated", "boundary", "piece"]
        for batch in batches:
            for at in range(len(batch)):
                whole = batch[text].iloc[at]
                head = [batch[c].iloc[at] for c in key]
                cut = pieces(whole, limit, overlap)
                yield pd.DataFrame([(*head, no, len(cut), a, b, r, name, whole[a:b]) for no, (a, b, r, name) in enumerate(cut, 1)], columns=columns)

    schema = ", ".join(f"`{c}` {t}" for c, t in types.items())
    return (
        items.select(*key, text)
        .where(F.length(text) > limit)
        .mapInPandas(run, f"{schema}, piece_no int, pieces int, start int, end int, repeated int, boundary string, piece string")
    )
