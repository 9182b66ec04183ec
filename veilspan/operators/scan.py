"""Row-wise passes over texts and span lists in Arrow batches.

Positions of hits, the left-to-right choice among overlapping spans and the like carry a state
from one element to the next. As a fold over arrays each step copies what was built so far, so
the cost grows with the square of the hits; here it grows with their number. Texts that cannot
have a hit are kept back on the JVM side, and no row moves to another task.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspan.catalog import Rule, UserRule, blanks
from veilspan.dialect import compiled
from veilspan.operators.validate import CHECKS

SPAN = "struct<match_id:string,kind:string,value:string,start:int,end:int>"
_TEXT, _INT = pa.string(), pa.int32()

#: (prefix, kind, what to search, how): how is '' for a script pattern, 'exact' for a literal, else 'rule' or 'unicode'.
Spec = tuple[str, str, object, str]


def rule_spec(rule: Rule, unicode: bool = False) -> Spec:
    return (rule.prefix, rule.kind, rule, "unicode" if unicode else "rule")


def user_spec(rule: UserRule) -> Spec:
    return (f"custom-{rule.id}", rule.kind, rule.pattern, "" if rule.mode == "regex" else "exact")


#: Blanks of a rule's ``\s`` where its classes know Unicode.
_UNICODE_BLANKS = r"\t-\r \x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


@lru_cache(maxsize=256)
def pattern(rule: Rule, unicode: bool = False) -> re.Pattern:
    """A built-in rule's pattern. ``unicode``: word bounds, digits and blanks of all scripts, for the rules that are not tied to a country's digits."""
    wide = unicode and rule.validator in (None, "luhn") and rule.prefix != "jp-postal"
    if wide:
        source = blanks(rule.pattern, body=_UNICODE_BLANKS)
    else:
        source = re.sub(r"\\x\{([0-9A-F]{4})\}", r"\\u\1", blanks(rule.pattern))
    return re.compile(source, (0 if wide else re.ASCII) | (re.I if rule.ignore_case else 0))


def _literals(text: str, value: str) -> Iterator[tuple[int, int]]:
    at = text.find(value) if value else -1
    while at >= 0:
        yield at, at + len(value)
        at = text.find(value, at + len(value))


def searches(specs: list[Spec]) -> list[tuple[str, str, Callable[[str], Iterator[tuple[int, int, int]]]]]:
    """(prefix, kind, text -> (ordinal, start, end) of accepted hits); ordinals count all hits, also rejected ones."""

    def by_rule(rule: Rule, unicode: bool):
        find, check = pattern(rule, unicode).finditer, CHECKS[rule.validator]
        hint = re.compile(rule.hint).search if rule.hint and not unicode else None

        def run(text: str):
            if hint is None or hint(text):
                for i, m in enumerate(find(text)):
                    if check is None or check(text, m.start(), m.end()):
                        yield i, m.start(), m.end()

        return run

    def by_literal(value: str):
        return lambda text: ((i, a, b) for i, (a, b) in enumerate(_literals(text, value)))

    def by_script(source: str):
        find = compiled(source)
        return lambda text: ((i, *m.span()) for i, m in enumerate(find.finditer(text)) if m.end() > m.start()) if find else ()

    return [(p, k, by_rule(what, how == "unicode") if how in ("rule", "unicode") else by_literal(what) if how == "exact" else by_script(what)) for p, k, what, how in specs]


class _Lists:
    """Builds an array column of structs."""

    def __init__(self, **fields: pa.DataType):
        self.types = fields
        self.columns: dict[str, list] = {f: [] for f in fields}
        self.offsets = [0]

    def add(self, *row) -> None:
        for column, value in zip(self.columns.values(), row):
            column.append(value)

    def close(self) -> None:
        """End the array of a row."""
        self.offsets.append(len(next(iter(self.columns.values()))))

    def array(self) -> pa.Array:
        parts = [pa.array(v, t) for v, t in zip(self.columns.values(), self.types.values())]
        return pa.ListArray.from_arrays(pa.array(self.offsets, _INT), pa.StructArray.from_arrays(parts, list(self.types)))


def _ids(prefix: str, start: int, ordinal: int) -> str:
    return f"{prefix}-{start}-{ordinal}"


def _once(run: Callable) -> Callable:
    """The function as one the optimizer neither repeats in a filter it infers nor moves below an exchange: a scan is dear."""
    return run.asNondeterministic()


def span_scan(specs: list[Spec]) -> Callable[[Column], Column]:
    """Text column -> array of the spans of all specs, in their order; null texts have none."""
    held = tuple(specs)

    def run(text: pa.Array) -> pa.Array:
        found, out = searches(held), _Lists(match_id=_TEXT, kind=_TEXT, value=_TEXT, start=_INT, end=_INT)
        for t in text.to_pylist():
            if t:
                for prefix, kind, search in found:
                    for i, a, b in search(t):
                        out.add(_ids(prefix, a, i), kind, t[a:b], a, b)
            out.close()
        return out.array()

    run.__annotations__ = {"text": pa.Array, "return": pa.Array}
    return _once(F.arrow_udf(run, f"array<{SPAN}>"))


def residual_scan(specs: list[Spec]) -> Callable[[Column, Column], Column]:
    """(text, array<struct<kind, value>>) -> distinct array<struct<kind, start, end>> of rules and literal values."""
    held = tuple(specs)

    def run(text: pa.Array, values: pa.Array) -> pa.Array:
        found, out = searches(held), _Lists(kind=_TEXT, start=_INT, end=_INT)
        for t, wanted in zip(text.to_pylist(), values.to_pylist()):
            if t:
                seen = {(kind, a, b) for _, kind, search in found for _, a, b in search(t)}
                for v in wanted or []:
                    if v and v["value"]:
                        seen.update((v["kind"], a, b) for a, b in _literals(t, v["value"]))
                for row in sorted(seen, key=lambda r: (r[1], r[2], r[0] or "")):
                    out.add(*row)
            out.close()
        return out.array()

    run.__annotations__ = {"text": pa.Array, "values": pa.Array, "return": pa.Array}
    return _once(F.arrow_udf(run, "array<struct<kind:string,start:int,end:int>>"))


def _typed(fn: Callable, n: int) -> Callable:
    """The function with the annotations that name it an Arrow function of ``n`` columns."""
    if n == 1:

        def run(a: pa.Array) -> pa.Array:
            return fn(a)

    elif n == 2:

        def run(a: pa.Array, b: pa.Array) -> pa.Array:
            return fn(a, b)

    elif n == 3:

        def run(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
            return fn(a, b, c)

    else:

        def run(a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array) -> pa.Array:
            return fn(a, b, c, d)

    run.__annotations__ = {k: pa.Array for k in [*"abcd"[:n], "return"]}
    return run


def _rebuilt(lists: pa.Array, rows: list[list[int]], **changed: pa.Array) -> pa.Array:
    """An array column with the given elements (places in the flat values) in each row, and some fields replaced by the given ones."""
    values = lists.flatten()
    picked = pa.array([i for r in rows for i in r], pa.int64())
    names = [f.name for f in values.type]
    parts = [changed[n] if n in changed else values.field(n).take(picked) for n in names]
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(r) for r in rows])]), _INT), pa.StructArray.from_arrays(parts, names))


def _bounds(lists: pa.Array) -> list[int]:
    """Where each row's elements begin among the flat values; the last entry is their number."""
    return np.concatenate([[0], np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))]).astype(int).tolist()


def _usable(items: pa.Array, length: pa.Array) -> pa.Array:
    values, at = items.flatten(), np.array(_bounds(items))
    a, b = (values.field(f).cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False) for f in ("start", "end"))
    n = np.repeat(length.cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False), np.diff(at))
    good = (a >= 0) & (b > a) & (b <= n) & values.is_valid().to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(good)])[at]
    return pa.ListArray.from_arrays(pa.array(offsets, _INT), values.filter(pa.array(good)))


def usable(items: Column, length: Column) -> Column:
    """Spans with 0 <= start < end <= length, in their order; null arrays are empty."""
    return F.arrow_udf(_typed(_usable, 2), f"array<{SPAN}>")(items, length)


def _truthful(items: pa.Array, text: pa.Array) -> pa.Array:
    values, at = items.flatten(), _bounds(items)
    a, b, v = (values.field(f).to_pylist() for f in ("start", "end", "value"))
    return _rebuilt(items, [[i for i in range(lo, hi) if v[i] is not None and a[i] is not None and b[i] is not None and 0 <= a[i] <= b[i] and t[a[i] : b[i]] == v[i]] if t is not None else [] for t, lo, hi in zip(text.to_pylist(), at, at[1:])])


def truthful(items: Column, text: Column) -> Column:
    """Spans whose value stands at their place in the text."""
    return F.arrow_udf(_typed(_truthful, 2), f"array<{SPAN}>")(items, text)


def _selected(items: pa.Array, decisions: pa.Array) -> pa.Array:
    values, at = items.flatten(), _bounds(items)
    ids, a, b = (values.field(f).to_pylist() for f in ("match_id", "start", "end"))
    # Nulls first, ids in byte order.
    key = lambda i: ((a[i] is not None, a[i] or 0), (b[i] is None, -(b[i] or 0)), (ids[i] is not None, (ids[i] or "").encode()))
    rows = []
    for given, lo, hi in zip(decisions.to_pylist(), at, at[1:]):
        no = {k for k, v in given or () if v is False}
        rows.append(sorted((i for i in range(lo, hi) if ids[i] not in no), key=key))
    return _rebuilt(items, rows)


def selected(items: Column, decisions: Column) -> Column:
    """Spans whose id has no decision against it, by start, longest first, then id."""
    return F.arrow_udf(_typed(_selected, 2), f"array<{SPAN}>")(items, decisions)


TOKEN = "struct<token:string,value:string,match_id:string,kind:string,start:int,end:int>"


def _resolved(items: pa.Array) -> pa.Array:
    values, at = items.flatten(), _bounds(items)
    a, b = values.field("start").to_pylist(), values.field("end").to_pylist()
    rows = []
    for lo, hi in zip(at, at[1:]):
        cursor, keep = 0, []
        for i in range(lo, hi):
            if a[i] is not None and b[i] is not None and a[i] >= cursor:
                keep.append(i)
                cursor = b[i]
        rows.append(keep)
    return _rebuilt(items, rows)


def resolved(items: Column) -> Column:
    """Tokens taken from left to right: one is kept if it starts at or after the end of the last kept one."""
    return F.arrow_udf(_typed(_resolved, 1), f"array<{TOKEN}>")(items)


def _located(text: pa.Array, items: pa.Array) -> pa.Array:
    names, at = items.flatten().field("token").to_pylist(), _bounds(items)
    rows, starts, ends = [], [], []
    for t, lo, hi in zip(text.to_pylist(), at, at[1:]):
        reached: dict[str, int] = {}
        found = []
        for i in range(lo, hi):
            token = names[i]
            place = (t or "").find(token, reached.get(token, 0)) if token else -1
            if place >= 0:
                reached[token] = place + len(token)
                found.append((place, i))
        found.sort()
        rows.append([i for _, i in found])
        starts += [p for p, _ in found]
        ends += [p + len(names[i]) for p, i in found]
    return _rebuilt(items, rows, start=pa.array(starts, _INT), end=pa.array(ends, _INT))


def located(text: Column, items: Column) -> Column:
    """Tokens at their places in a text, in its order; repeated ones in turn, those that are not found left out."""
    return F.arrow_udf(_typed(_located, 2), f"array<{TOKEN}>")(text, items)


def segments(text: Column, items: Column, emit: str) -> Column:
    """array<struct<text, match_id>>: kept tokens with the field ``emit`` in their place, and the stretches between them that are not empty."""

    def run(text: pa.Array, items: pa.Array) -> pa.Array:
        values, at, out = items.flatten(), _bounds(items), _Lists(text=_TEXT, match_id=_TEXT)
        a, b, new, ids = (values.field(f).to_pylist() for f in ("start", "end", emit, "match_id"))
        for t, lo, hi in zip(text.to_pylist(), at, at[1:]):
            cursor = 0
            for i in range(lo, hi):
                if a[i] > cursor:
                    out.add(t[cursor : a[i]], None)
                out.add(new[i], ids[i])
                cursor = b[i]
            if t and cursor < len(t):
                out.add(t[cursor:], None)
            out.close()
        return out.array()

    return F.arrow_udf(_typed(run, 2), "array<struct<text:string,match_id:string>>")(text, items)


def _ranked(items: pa.Array, chosen: pa.Array) -> pa.Array:
    values, at = items.flatten(), _bounds(items)
    ids, out = values.field("match_id").to_pylist(), []
    for some, lo, hi in zip(chosen.to_pylist(), at, at[1:]):
        place: dict[str, int] = {}
        for i, x in enumerate(some or [], 1):
            place.setdefault(x, i)
        out += [place.get(x, 0) for x in ids[lo:hi]]
    names = [f.name for f in values.type]
    parts = pa.StructArray.from_arrays([*(values.field(n) for n in names), pa.array(out, _INT)], [*names, "rank"])
    return pa.ListArray.from_arrays(pa.array(at, _INT), parts)


def ranked(items: Column, chosen: Column) -> Column:
    """Spans with ``rank``: the place of their id in a list, from 1; 0 where it is not in there."""
    return F.arrow_udf(_typed(_ranked, 2), f"array<{SPAN[:-1]},rank:int>>")(items, chosen)


def _page_ranges(pages: pa.Array, boxes: pa.Array) -> pa.Array:
    out = _Lists(page=_INT, start=_INT, end=_INT)
    for wanted, given in zip(pages.to_pylist(), boxes.to_pylist()):
        first: dict[int, int] = {}
        last: dict[int, int] = {}
        for at, page in enumerate(given or []):
            if page is not None:
                first.setdefault(page, at)
                last[page] = at
        for page in wanted or []:
            if page in first:
                out.add(page, first[page], last[page] + 1)
        out.close()
    return out.array()


def page_ranges(pages: Column, boxes: Column) -> Column:
    """array<struct<page, start, end>> from the page numbers wanted and the page number of every character."""
    return F.arrow_udf(_typed(_page_ranges, 2), "array<struct<page:int,start:int,end:int>>")(pages, boxes)


def _stretches(length: pa.Array, starts: pa.Array, ends: pa.Array, ids: pa.Array) -> pa.Array:
    starts_, ends_, covers, rows = [], [], [], [0]
    names: list[str] = []
    cuts = [0]
    for n, a, b, i in zip(length.to_pylist(), starts.to_pylist(), ends.to_pylist(), ids.to_pylist()):
        events: dict[int, tuple[list[int], list[int]]] = {0: ([], []), n or 0: ([], [])}
        for k, (x, y) in enumerate(zip(a or [], b or [])):
            events.setdefault(x, ([], []))[0].append(k)
            events.setdefault(y, ([], []))[1].append(k)
        open_now: dict[int, None] = {}
        places = sorted(events)
        for p, q in zip(places, places[1:]):
            for k in events[p][1]:
                open_now.pop(k, None)
            open_now.update(dict.fromkeys(events[p][0]))
            starts_.append(p)
            ends_.append(q)
            names += [i[k] for k in open_now]
            cuts.append(len(names))
        rows.append(len(starts_))
    covers = pa.ListArray.from_arrays(pa.array(cuts, _INT), pa.array(names, _TEXT))
    parts = pa.StructArray.from_arrays([pa.array(starts_, _INT), pa.array(ends_, _INT), covers], ["start", "end", "match_ids"])
    return pa.ListArray.from_arrays(pa.array(rows, _INT), parts)


def stretches(length: Column, starts: Column, ends: Column, ids: Column) -> Column:
    """array<struct<start, end, match_ids>>: a sweep over the bounds of usable spans, with those open between two bounds, in their order."""
    return F.arrow_udf(_typed(_stretches, 4), "array<struct<start:int,end:int,match_ids:array<string>>>")(length, starts, ends, ids)


def _nearest(text: pa.Array, value: pa.Array, target: pa.Array) -> pa.Array:
    out = []
    for t, v, at in zip(text.to_pylist(), value.to_pylist(), target.to_pylist()):
        places = _literals(t, v) if t and v and at is not None else ()
        out.append(min(((abs(a - at), a) for a, _ in places), default=(0, None))[1])
    return pa.array(out, _INT)


def nearest(text: Column, value: Column, target: Column) -> Column:
    """The occurrence of a literal nearest to a place, the earlier of two; null if there is none."""
    return F.arrow_udf(_typed(_nearest, 3), "int")(text, value, target)
