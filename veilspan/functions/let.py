"""Binding of an intermediate value within a column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    An expression captured by a lambda is evaluated for every element; a lambda variable is
    not. Null values are bound like others.
    """
    return F.transform(F.array(value), body)[0]
