"""Checks of candidate numbers: as column expressions, and for the hits of a scan.

Every column check takes the matched value; ``isolated`` looks at what stands around it. Nulls
give null, which a filter treats as a failed check. ``CHECKS`` are the same checks on a hit's
place in its text, by validator name.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[ -]", "")


def _digit(text: Column, place: int) -> Column:
    return F.substring(text, place, 1).cast("int")


def _weighted(text: Column, weights: list[int]) -> Column:
    total = _digit(text, 1) * weights[0]
    for k, w in enumerate(weights[1:], 2):
        total = total + _digit(text, k) * w
    return total


def all_equal(text: Column) -> Column:
    return F.length(F.replace(text, F.substring(text, 1, 1), F.lit(""))) == 0


def card_valid(value: Column) -> Column:
    """13 to 19 digits with single blanks or hyphens, not all equal, check digit modulo 10."""
    d = digits(value)
    return F.when(d.rlike("^[0-9]{13,19}$"), F.call_function("luhn_check", d) & ~all_equal(d)).otherwise(F.lit(False))


def kr_class(value: Column) -> Column:
    """'invalid', 'legacy-checksum' or 'possible-modern' for a Korean registration number.

    The birth date must exist; the seventh digit gives century and nationality. Numbers given
    out since 2020 have no check digit, so a failed sum does not make a number invalid.
    """
    d = F.regexp_replace(value, "-", "")
    sex = F.substring(d, 7, 1)
    year = F.concat(F.when(sex.isin("1", "2", "5", "6"), "19").otherwise("20"), F.substring(d, 1, 2))
    date = F.try_to_date(F.concat(year, F.substring(d, 3, 4)), "yyyyMMdd")
    total = _weighted(d, [2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5])
    base = F.when(sex.cast("int") <= 4, 11).otherwise(13)
    legacy = (base - total % 11) % 10 == _digit(d, 13)
    return F.when(
        d.rlike("^[0-9]{6}[1-8][0-9]{6}$"),
        F.when(date.isNull(), "invalid").when(legacy, "legacy-checksum").otherwise("possible-modern"),
    ).otherwise("invalid")


def jp_my_number_valid(value: Column) -> Column:
    """Twelve digits, not all equal, check digit modulo 11."""
    d = digits(value)
    rest = _weighted(d, [6, 5, 4, 3, 2, 7, 6, 5, 4, 3, 2]) % 11
    check = F.when(rest <= 1, 0).otherwise(11 - rest)
    return F.when(d.rlike("^[0-9]{12}$"), ~all_equal(d) & (check == _digit(d, 12))).otherwise(F.lit(False))


def jp_corporate_valid(value: Column) -> Column:
    """Thirteen digits, the first a check digit modulo 9 over the rest and not 0."""
    d = digits(value)
    rest = _weighted(F.substring(d, 2, 12), [2, 1] * 6) % 9
    return F.when(d.rlike("^[1-9][0-9]{12}$"), ~all_equal(d) & (9 - rest == _digit(d, 1))).otherwise(F.lit(False))


def isolated(text: Column, start: Column, end: Column) -> Column:
    """No ASCII digit directly before or after [start, end)."""
    return ~F.substring(text, start, F.when(start > 0, 1).otherwise(0)).rlike("[0-9]") & ~F.substring(text, end + 1, F.lit(1)).rlike("[0-9]")


def apart(text: Column, start: Column, end: Column) -> Column:
    """No further digit group joined by one blank or hyphen on either side."""
    before = F.substring(text, F.greatest(start - 1, F.lit(1)), F.when(start > 1, 2).otherwise(0))
    return ~before.rlike("[0-9][ -]$") & ~F.substring(text, end + 1, F.lit(2)).rlike("^[ -][0-9]")


# ---------------------------------------------------------------- hits of a scan


def _weighed(digits_: str, weights: list[int]) -> int:
    return sum(int(d) * w for d, w in zip(digits_, weights))


def _plain(value: str) -> str:
    return value.replace(" ", "").replace("-", "")


def _card(value: str) -> bool:
    d = _plain(value)
    if not 13 <= len(d) <= 19 or len(set(d)) == 1:
        return False
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def _kr(value: str) -> bool:
    d = _plain(value)
    if not re.fullmatch("[0-9]{6}[1-8][0-9]{6}", d):
        return False
    try:
        datetime.date((1900 if d[6] in "1256" else 2000) + int(d[:2]), int(d[2:4]), int(d[4:6]))
    except ValueError:
        return False
    return True


def _my_number(value: str) -> bool:
    d = _plain(value)
    rest = _weighed(d, [6, 5, 4, 3, 2, 7, 6, 5, 4, 3, 2]) % 11
    return len(d) == 12 and len(set(d)) > 1 and int(d[11]) == (0 if rest <= 1 else 11 - rest)


def _corporate(value: str) -> bool:
    d = _plain(value)
    return len(d) == 13 and d[0] != "0" and len(set(d)) > 1 and int(d[0]) == 9 - _weighed(d[1:], [2, 1] * 6) % 9


def _alone(text: str, a: int, b: int) -> bool:
    return text[max(0, a - 1) : a] not in _ASCII_DIGITS and text[b : b + 1] not in _ASCII_DIGITS


def _ungrouped(text: str, a: int, b: int) -> bool:
    return not re.fullmatch("[0-9][ -]", text[max(0, a - 2) : a]) and not re.fullmatch("[ -][0-9]", text[b : b + 2])


_ASCII_DIGITS = frozenset("0123456789")

#: Validator name -> (text, start, end) -> accepted; null for rules without a check.
CHECKS: dict[str | None, Callable[[str, int, int], bool] | None] = {
    None: None,
    "luhn": lambda t, a, b: _alone(t, a, b) and _card(t[a:b]),
    "kr_registration": lambda t, a, b: _alone(t, a, b) and _kr(t[a:b]),
    "jp_my_number": lambda t, a, b: _alone(t, a, b) and _ungrouped(t, a, b) and _my_number(t[a:b]),
    "jp_corporate": lambda t, a, b: _alone(t, a, b) and _ungrouped(t, a, b) and _corporate(t[a:b]),
}
