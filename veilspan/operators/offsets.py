"""Offsets in code points, UTF-16 units and UTF-8 bytes.

Stored offsets count code points; the others follow from the text before them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def before(text: Column, at: Column) -> Column:
    """The text before a code point offset; offsets outside are moved to the nearest end."""
    return F.substring(text, F.lit(1), F.greatest(F.least(at, F.length(text)), F.lit(0)))


def utf8_offset(text: Column, at: Column) -> Column:
    return F.octet_length(before(text, at))


def _units(text: Column) -> Column:
    """UTF-16 units of a text."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def utf16_offset(text: Column, at: Column) -> Column:
    return _units(before(text, at))


def _head(text: Column, at: Column) -> Column:
    """The text before a byte offset; a character cut through counts as one replacement character."""
    n = F.greatest(F.least(at, F.octet_length(text)), F.lit(0))
    return F.make_valid_utf8(F.substring(F.encode(text, "UTF-8"), F.lit(1), n).cast("string"))


def utf8_to_code_points(text: Column, at: Column) -> Column:
    """Code points before a byte offset; inside a character, that character counts as passed."""
    return F.length(_head(text, at))


def utf8_to_utf16(text: Column, at: Column) -> Column:
    """UTF-16 units before a byte offset; inside a character one unit is counted for it."""
    return _units(_head(text, at))
