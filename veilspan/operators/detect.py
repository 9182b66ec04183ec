"""Detectors: text in, spans out.

A span is struct(match_id, kind, value, start, end) with half-open offsets in code points.
A detector is one Arrow pass over the texts that can have a hit: all its rules search a text
while it is there, checks run on the hits only, and the cost grows with text and hits. No
shuffle. Hits of one rule never overlap; rules are scanned independently, so spans of
different rules may. Null texts have no spans.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.catalog import RULES, Rule, UserRule
from veilspan.operators import scan
from veilspan.operators.scan import SPAN


class Detector(Protocol):
    """Anything that turns a text column into an array of spans."""

    def __call__(self, text: Column) -> Column: ...


def empty_spans() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def built_in(rules: Iterable[Rule] = RULES, unicode: bool = False) -> Detector:
    """The given rules, as one array in rule order.

    Texts without any rule's hint stay on the JVM side. With ``unicode`` word bounds, digits
    and blanks are those of all scripts, but for the rules of one country's numbers.
    """
    held = list(rules)
    run = scan.span_scan([scan.rule_spec(r, unicode) for r in held])
    hints = [r.hint for r in held if r.hint] if not unicode else []
    some = "|".join(f"(?:{h})" for h in hints) if len(hints) == len(held) else None
    return lambda text: run(F.when(text.rlike(some), text) if some else text)


def rule_spans(text: Column, rule: Rule) -> Column:
    """Validated spans of one built-in rule."""
    return built_in([rule])(text)


def literal(pattern: str) -> str:
    """A literal as a pattern of any dialect."""
    return re.sub(r"([^\w\s])", r"\\\1", pattern)


def user_rules(rules: Iterable[UserRule]) -> Detector:
    """All user rules: exact ones mind letter case, regex ones (``dialect``) do not; bad and empty patterns find nothing.

    Rules are bound when the plan is built, so later edits change no result.
    """
    bound = [scan.user_spec(r) for r in rules if r.pattern]
    run = scan.span_scan(bound)
    return lambda text: run(text) if bound else empty_spans()


def model_spans(run: Callable[[Column], Column]) -> Detector:
    """A model's Arrow function (text -> spans) as a detector."""
    return lambda text: run(text)


def detector(backend: str, rules: Iterable[Rule] = RULES, models: dict[str, Detector] | None = None, unicode: bool = False) -> Detector:
    """The detector of a backend name: that of a loaded model, else the rules; a model that is not loaded is an error."""
    if backend in (models or {}):
        return models[backend]
    if backend in ("onnx", "bardsai"):
        raise LookupError(f"model of backend {backend!r} is not loaded")
    return built_in(rules, unicode)


class _SpanTable:
    """A table function of one text column: its spans by all built-in rules."""

    def __init__(self) -> None:
        self.found = scan.searches([scan.rule_spec(r) for r in RULES])

    def eval(self, text: str):
        for prefix, kind, search in self.found if text else ():
            for i, a, b in search(text):
                yield f"{prefix}-{a}-{i}", kind, text[a:b], a, b


def register(spark: SparkSession) -> None:
    """Make the built-in rules a table function in SQL: ``FROM t, LATERAL pii_spans(t.text)``."""
    spark.udtf.register("pii_spans", F.udtf(_SpanTable, returnType="match_id string, kind string, value string, start int, end int"))


def detect(docs: DataFrame, detectors: list[Detector], text: str = "text", out: str = "matches") -> DataFrame:
    """``docs`` with the spans of all detectors in ``out``, ordered; narrow, so it runs on streams as well."""
    from veilspan.operators.spans import ordered

    arrays = [d(F.col(text)) for d in detectors]
    joined = reduce(lambda a, b: F.concat(a, b), arrays) if arrays else empty_spans()
    return docs.withColumn(out, ordered(joined))


def raw_hits(docs: DataFrame, key: str, text: str = "text", rules: Iterable[Rule] = RULES) -> DataFrame:
    """(key, rule prefix, kind, ordinal, value, start, end) of all hits, those a check rejects too."""
    unchecked = [scan.rule_spec(Rule(r.prefix, r.kind, r.pattern, r.ignore_case, None, r.hint)) for r in rules]
    rows = docs.select(F.col(key).alias("_key"), F.inline(scan.span_scan(unchecked)(F.col(text))))
    at = F.regexp_extract("match_id", "^(.*)-[0-9]+-([0-9]+)$", 1)
    return rows.select(F.col("_key").alias(key), at.alias("rule"), "kind", F.regexp_extract("match_id", "-([0-9]+)$", 1).cast("int").alias("ordinal"), "value", "start", "end")
