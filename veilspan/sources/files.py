"""Documents from files, tabs and rules from stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.catalog import UserRule
from veilspan.functions.scalar import backend, document_kind, file_name, history_status, import_kind, index_format, rule_mode, workflow_mode
from veilspan.operators.detect import SPAN
from veilspan.session import current_tabs, parsed_json

PDF_DOCUMENT = "struct<fileName:string,text:string,pages:array<struct<index:int,width:double,height:double>>,charBoxes:array<struct<pageIndex:int,x:double,y:double,width:double,height:double>>>"
_STORED_SPAN = "array<struct<id:string,kind:string,value:string,start:int,end:int>>"
_SUMMARY = "array<struct<kind:string,count:long>>"


def read_import_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, file_name, kind, text, content, error), one row per file.

    Markdown and text files get their text, PDF files their bytes. A file of another kind, or
    one that is not UTF-8, keeps its row with an error, so one bad file never stops the rest.
    """
    rows = spark.read.format("binaryFile").load(paths).select("path", "content")
    kind = import_kind(F.col("path"))
    text = F.when(kind == "markdown", F.try_validate_utf8(F.col("content").cast("string")))
    return rows.select(
        "path",
        file_name(F.col("path")).alias("file_name"),
        kind.alias("kind"),
        text.alias("text"),
        F.when(kind == "pdf", F.col("content")).alias("content"),
        F.when(kind.isNull(), "unsupported file type").when((kind == "markdown") & text.isNull(), "not valid UTF-8").alias("error"),
    )


def read_markdown(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, file_name, text) of markdown files only; other paths are left out before they are read."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.{md,markdown,MD,MARKDOWN}").load(paths)
    return rows.select("path", file_name(F.col("path")).alias("file_name"), F.try_validate_utf8(F.col("content").cast("string")).alias("text"))


def load_tabs(tabs: DataFrame, closed: bool | None = None, columns: list[str] | None = None) -> DataFrame:
    """Current tabs with parsed columns and defaults for unknown values.

    ``closed`` picks open or closed ones. ``columns`` names the result's columns besides ``id``;
    only what they are made of is read and travels through the shuffle. Unusable JSON gives an
    empty list, map or null. Order for display: ``orderBy('sort_order', 'updated_at')``.
    """
    spans = F.transform(
        parsed_json(F.col("matches_json"), _STORED_SPAN),
        lambda s: F.struct(s["id"].alias("match_id"), s["kind"].alias("kind"), s["value"].alias("value"), s["start"].alias("start"), s["end"].alias("end")),
    )
    text = lambda c: (c, F.coalesce(c, F.lit("")))
    made = {
        "title": ("title", F.col("title")),
        "document_kind": ("document_kind", document_kind(F.col("document_kind"))),
        "input": text("input"),
        "output": text("output"),
        "matches": ("matches_json", F.coalesce(spans, F.array().cast(f"array<{SPAN}>"))),
        "selection": ("selection_json", F.coalesce(parsed_json(F.col("selection_json"), "map<string,boolean>"), F.create_map().cast("map<string,boolean>"))),
        "index_format": ("index_format", index_format(F.col("index_format"))),
        "mode": ("mode", workflow_mode(F.col("mode"))),
        "restore_input": text("restore_input"),
        "restore_output": text("restore_output"),
        "pdf_document": ("pdf_document_json", parsed_json(F.col("pdf_document_json"), PDF_DOCUMENT)),
        "is_closed": ("is_closed", F.coalesce("is_closed", F.lit(0)) != 0),
        "sort_order": ("sort_order", F.col("sort_order")),
        "updated_at": ("updated_at", F.col("updated_at")),
    }
    wanted = [c for c in (list(made) if columns is None else columns) if c != "id"]
    stored = [made[c][0] for c in wanted]
    if closed is not None and "is_closed" not in stored:
        stored.append("is_closed")
    rows = current_tabs(tabs, stored)
    if closed is not None:
        rows = rows.where(F.coalesce(F.col("is_closed"), F.lit(0)) == int(closed))
    return rows.select("id", *[made[c][1].alias(c) for c in wanted])


def rule_rows(rules: DataFrame) -> DataFrame:
    """(id, name, mode, pattern, updated_at) of the stored rules: empty patterns dropped, unknown modes exact, null names empty."""
    return rules.where(F.length("pattern") > 0).select("id", F.coalesce("name", F.lit("")).alias("name"), rule_mode(F.col("mode")).alias("mode"), "pattern", "updated_at")


def load_rules(rules: DataFrame) -> list[UserRule]:
    """The user's rules by age. A list the user keeps by hand."""
    return [UserRule(r.id, r.name, r.mode, r.pattern) for r in rule_rows(rules).orderBy("updated_at", "id").toLocalIterator()]


def load_history(results: DataFrame, limit: int = 200) -> DataFrame:
    """The newest tasks with defaults for unknown values; the sort keeps ``limit`` rows per task (top-k)."""
    return (
        results.orderBy(F.col("queued_at").desc(), F.col("id"))
        .limit(limit)
        .select(
            F.when(F.coalesce(F.col("task_id"), F.lit("")) != "", F.col("task_id")).otherwise(F.col("id")).alias("task_id"),
            "tab_id",
            backend(F.col("backend")).alias("backend"),
            index_format(F.col("index_format")).alias("index_format"),
            history_status(F.col("status")).alias("status"),
            "input_length",
            "queued_at",
            "started_at",
            "completed_at",
            "duration_ms",
            "match_count",
            parsed_json(F.col("category_summary_json"), _SUMMARY).alias("category_summary"),
            "result_path",
            "error",
        )
    )


def with_added_columns(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Older tables read as newer ones: missing columns are added with their default expression."""
    return df.select("*", *[F.expr(e).alias(c) for c, e in wanted.items() if c not in df.columns])


def missing_files(catalog: DataFrame, listing: DataFrame) -> DataFrame:
    """Catalog files (path, bytes) that the listing lacks or has in another size."""
    return catalog.join(listing.select("path", "bytes"), ["path", "bytes"], "left_anti")
