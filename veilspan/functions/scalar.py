"""Scalar functions: labels, file names, sizes, word counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspan.catalog import BLANKS, KIND_ALIASES

MARKDOWN, PLAIN, PDF = ("md", "markdown"), ("txt", "text"), ("pdf",)


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{BLANKS}]+|[{BLANKS}]+$", "")


def word_count(text: Column) -> Column:
    """Blank-separated words; 0 for null and blank texts."""
    t = trimmed(F.coalesce(text, F.lit("")))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, f"[{BLANKS}]+")))


def display_label(kind: Column) -> Column:
    """Parts of a kind between _, - and blanks, each with a capital, joined; the kind itself if none is left."""
    parts = F.filter(F.split(kind, f"[_{BLANKS}-]+"), lambda p: p != "")
    out = F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p)))), "")
    return F.when(out != "", out).otherwise(kind)


def badge_label(match_id: Column, kind: Column) -> Column:
    return F.when(match_id.startswith("custom-"), F.concat(F.lit("custom:"), kind)).otherwise(display_label(kind))


def normal_kind(kind: Column) -> Column:
    """A model's label in the taxonomy: lower case, blanks and hyphens to underscores, other names resolved; unknown ones stay."""
    k = F.translate(F.lower(kind), " -", "__")
    pairs = [F.lit(x) for target, names in KIND_ALIASES.items() for n in names for x in (n, target)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), k), k)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, r"[\\/]"), -1)


def file_extension(path: Column) -> Column:
    """Text after the last dot of the file name in lower case; none for names without one or with a leading one only."""
    name = file_name(path)
    return F.when(F.locate(".", name, 2) > 0, F.lower(F.substring_index(name, ".", -1))).otherwise("")


def import_kind(path: Column) -> Column:
    """'markdown' for markdown and plain text files, 'pdf', else null: not supported."""
    e = file_extension(path)
    return F.when(e.isin(*MARKDOWN, *PLAIN), "markdown").when(e.isin(*PDF), "pdf")


def file_stem(title: Column) -> Column:
    """A safe stem for output files: extension off, other characters than [A-Za-z0-9._-] to hyphens."""
    t = F.regexp_replace(trimmed(F.coalesce(title, F.lit(""))), r"\.[A-Za-z0-9]+$", "")
    t = F.regexp_replace(F.regexp_replace(t, "[^A-Za-z0-9._-]+", "-"), "^-+|-+$", "")
    return F.when(t == "", "pii-output").otherwise(t)


def output_name(title: Column, suffix: str) -> Column:
    """``suffix``: '-redacted.txt', '-redacted.pdf' or '-input.txt'."""
    return F.concat(file_stem(title), F.lit(suffix))


def result_file_name(completed_ms: Column) -> Column:
    """ISO time of a completion with : and . as hyphens, as a file name."""
    return F.concat(F.translate(F.date_format(F.timestamp_millis(completed_ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), ":.", "--"), F.lit(".json"))


def safe_segment(name: Column) -> Column:
    """Whether a name may stand in an output path."""
    return name.rlike("^[A-Za-z0-9_-]+$")


def bare_file_name(name: Column) -> Column:
    """Whether a name is a file name without folders."""
    return (F.coalesce(name, F.lit("")) != "") & ~name.rlike(r"[\\/]") & ~name.isin(".", "..")


def size_label(n: Column) -> Column:
    """Bytes in units of 1000; one decimal under 10 of a unit but bytes."""
    unit = F.when(n >= 1_000_000_000, 3).when(n >= 1_000_000, 2).when(n >= 1000, 1).otherwise(0)
    size = n / F.pow(F.lit(1000.0), unit)
    shown = F.when((size >= 10) | (unit == 0), F.format_string("%.0f", size)).otherwise(F.format_string("%.1f", size))
    return F.when(n <= 0, "0 B").otherwise(F.concat(shown, F.lit(" "), F.element_at(F.array(*map(F.lit, ("B", "KB", "MB", "GB"))), unit + 1)))


def percent(done: Column, expected: Column) -> Column:
    """Share in percent between 0 and 100; 0 where nothing is expected."""
    return F.when(expected > 0, F.least(F.greatest(done / expected * 100, F.lit(0.0)), F.lit(100.0))).otherwise(0.0)


def index_format(value: Column) -> Column:
    return F.when(value.isin("number", "id"), value).otherwise("none")


def workflow_mode(value: Column) -> Column:
    return F.when(value == "pii-to-text", value).otherwise("text-to-pii")


def document_kind(value: Column) -> Column:
    return F.when(value.isin("markdown", "pdf"), value).otherwise("text")


def backend(value: Column) -> Column:
    return F.when(value.isin("onnx", "bardsai"), value).otherwise("regex")


def history_status(value: Column) -> Column:
    return F.when(value == "failed", value).otherwise("completed")


def rule_mode(value: Column) -> Column:
    return F.when(value == "regex", value).otherwise("exact")
