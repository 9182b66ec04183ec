"""Residual scan of exported texts: what personal data can still be read in them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.catalog import RULES, TAXONOMY, UserRule
from veilspan.functions.let import let
from veilspan.operators import scan
from veilspan.operators.chunk import is_blank
from veilspan.operators.detect import empty_spans

#: What a clean report does not say, given what this engine looks at.
LIMITATIONS = [
    "Searched: the text that could be extracted, page by page. Not searched: pictures, annotations, form data, file properties.",
    "Searched with: built-in rules, user rules, and the selected values letter by letter. No classifier reads the export.",
    "A value that extraction breaks over two pages, or joins with its neighbours, is not found.",
    "No finding means that nothing of the above was found, not that nothing is there.",
]


def residual_spans(text: Column, chosen: Column, rules: Iterable[UserRule] = ()) -> Column:
    """array<struct<kind, start, end>> of all rules and of the chosen spans' values, each place and kind once.

    Literals are taken left to right without overlap; empty and null values find nothing.
    """
    values = F.array_distinct(F.transform(F.coalesce(chosen, empty_spans()), lambda s: F.struct(s["kind"].alias("kind"), s["value"].alias("value"))))
    specs = [scan.rule_spec(r) for r in RULES] + [scan.user_spec(r) for r in rules if r.pattern]
    return scan.residual_scan(specs)(text, values)


def reported_kind(kind: Column) -> Column:
    """Kinds of the taxonomy by name, others as 'custom', so that no rule name shows."""
    return F.when(kind.isin(*TAXONOMY), kind).otherwise("custom")


def residual_report(pages: DataFrame, key: str, page: str, text: str, chosen: str, rules: Iterable[UserRule] = ()) -> DataFrame:
    """(key, page, kind, count) of residual spans; pages without any have no row.

    Spans are made distinct before their kinds are masked. Everything up to the count is
    narrow; the count shuffles one row per page and kind.
    """
    rows = pages.select(key, page, F.explode(residual_spans(F.col(text), F.col(chosen), rules)).alias("r"))
    return rows.groupBy(key, page, reported_kind(F.col("r.kind")).alias("kind")).agg(F.count("*").alias("count"))


def document_report(pages: DataFrame, key: str, page: str, text: str, chosen: str, rules: Iterable[UserRule] = ()) -> DataFrame:
    """One row per document: status, page counts, residual count and the residuals."""
    found = pages.select(key, page, (~is_blank(F.col(text))).alias("has_text"), residual_spans(F.col(text), F.col(chosen), rules).alias("r"))
    counted = lambda kinds: F.transform(F.array_distinct(kinds), lambda k: F.struct(F.col(page).alias("page"), k.alias("kind"), F.size(F.filter(kinds, lambda x: x == k)).alias("count")))
    rows = let(F.transform("r", lambda s: reported_kind(s["kind"])), counted)
    return (
        found.select(key, "has_text", F.size("r").alias("n"), rows.alias("rows"))
        .groupBy(key)
        .agg(F.count("*").alias("page_count"), F.count_if("has_text").alias("pages_with_text"), F.sum("n").alias("residual_count"), F.sort_array(F.flatten(F.collect_list("rows"))).alias("residuals"))
        .select(
            key,
            F.lit("extractable-text-only").alias("scope"),
            F.when(F.col("residual_count") > 0, "residual-matches").when(F.col("pages_with_text") > 0, "no-text-matches").otherwise("no-extractable-text").alias("status"),
            "page_count",
            "pages_with_text",
            "residual_count",
            "residuals",
            F.array(*map(F.lit, LIMITATIONS)).alias("limitations"),
        )
    )


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def blob_hash(content: Column) -> Column:
    """SHA-1 of content with the header that version control puts before it."""
    return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(content).cast("string")), "UTF-8"), F.unhex(F.lit("00")), content))

