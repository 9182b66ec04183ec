"""What happens to a stored document: import, clearing, closing, panes, scan results coming in.

All functions take and give documents as ``sources.files.load_tabs`` has them. They set columns
of the rows concerned and leave the others, so all but the import are narrow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.functions.scalar import import_kind
from veilspan.operators import scan, spans
from veilspan.operators.detect import empty_spans

_NO_DECISIONS = "map<string,boolean>"


def entity_id(prefix: str, *parts: Column) -> Column:
    """An id that follows from what it names, so a repeated run gives the same: prefix and 128 bits of a hash.

    Parts are told apart, nulls too: ('a', null) and ('a', '') differ.
    """
    told = F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("+"), p.cast("string")), F.lit("-")) for p in parts])
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(told, 256), 1, 32))


def _reset(tabs: DataFrame, rows: Column, values: dict[str, Column]) -> DataFrame:
    there = {c: v for c, v in values.items() if c in tabs.columns}
    return tabs.withColumns({c: F.when(F.coalesce(rows, F.lit(False)), v.cast(tabs.schema[c].dataType)).otherwise(F.col(c)) for c, v in there.items()})


def _cleared() -> dict[str, Column]:
    none = F.lit("")
    return {"output": none, "matches": empty_spans(), "selection": F.create_map().cast(_NO_DECISIONS), "restore_output": none}


def cleared_input(tabs: DataFrame, rows: Column) -> DataFrame:
    """The chosen documents without their text and all that came from it; when restoring, without the text to restore."""
    restoring, none = F.col("mode") == "pii-to-text", F.lit("")
    out = _reset(tabs, rows & restoring, {"restore_input": none, "restore_output": none})
    return _reset(out, rows & ~restoring, {**_cleared(), "document_kind": F.lit("text"), "input": none, "restore_input": none, "pdf_document": F.lit(None)})


def cleared_output(tabs: DataFrame, rows: Column) -> DataFrame:
    """The chosen documents without their result; when restoring, without the restored text only."""
    restoring = F.col("mode") == "pii-to-text"
    out = _reset(tabs, rows & restoring, {"restore_output": F.lit("")})
    return _reset(out, rows & ~restoring, _cleared())


def toggled_format(tabs: DataFrame, rows: Column, index_format: str) -> DataFrame:
    """The index format set, or taken back to none where it is set; the output follows."""
    new = F.when(F.col("index_format") == index_format, "none").otherwise(index_format)
    out = _reset(tabs, rows, {"index_format": new})
    fresh = spans.redacted(F.col("input"), spans.selected(F.col("matches"), F.col("selection")), F.col("index_format"))
    return out.withColumn("output", F.when(F.coalesce(rows, F.lit(False)) & (F.col("mode") != "pii-to-text"), fresh).otherwise(F.col("output")))


def closed(tabs: DataFrame, rows: Column, value: bool = True) -> DataFrame:
    """The chosen documents closed, or opened again; whether any is left open is the caller's question."""
    return _reset(tabs, rows, {"is_closed": F.lit(value)})


def import_counts(files: DataFrame, path: str = "path") -> DataFrame:
    """(files, supported, unsupported) of the files given for an import."""
    return files.agg(F.count("*").alias("files"), F.count(import_kind(F.col(path))).alias("supported"), F.count_if(import_kind(F.col(path)).isNull()).alias("unsupported"))


def imported(tabs: DataFrame, files: DataFrame, current: str | None = None) -> DataFrame:
    """Documents after an import: files (file_name, kind, text, pdf_document, file_no) become documents.

    With ``current`` the file of the lowest number takes the place of that document, which
    keeps its id, order and whether it is closed; the others, or all of them, are appended in
    their order. Files without a kind are left out; ``file_no`` tells files apart. New ids follow
    from name, text and number.
    """
    good = files.where("kind IS NOT NULL")
    none = F.lit("")
    fresh = {
        "title": F.col("file_name"), "document_kind": F.col("kind"), "input": F.coalesce("text", none), "index_format": F.lit("number"), "mode": F.lit("text-to-pii"),
        "restore_input": none, "pdf_document": F.col("pdf_document"), **_cleared(),
    }
    new = good.select("file_no", F.col("file_name"), *[v.alias(f"_{c}") for c, v in fresh.items()], F.coalesce("text", none).alias("_t"))
    if current is not None:
        first = new.agg(F.min_by(F.struct(*[c for c in new.columns if c != "file_no"]), "file_no").alias("f"), F.min("file_no").alias("first"))
        # One row with a known key: a join by it, not a product.
        one = first.where("first IS NOT NULL").select(F.lit(current).alias("id"), "first", "f")
        met = tabs.join(F.broadcast(one), "id", "left")
        took = F.col("first").isNotNull()
        tabs = met.select(*[F.when(took, F.col(f"f._{c}").cast(tabs.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in fresh else F.col(c) for c in tabs.columns])
        rest = new.join(F.broadcast(first.select(F.col("first").alias("file_no"))), "file_no", "left_anti")
    else:
        rest = new
    more = {**{c: F.col(f"_{c}") for c in fresh}, "id": entity_id("tab", F.col("file_name"), F.col("_t"), F.col("file_no")), "is_closed": F.lit(False), "sort_order": F.col("file_no"), "updated_at": F.lit(None)}
    return tabs.unionByName(rest.select(*[more.get(c, F.lit(None)).cast(tabs.schema[c].dataType).alias(c) for c in tabs.columns]))


def pane_segments(tabs: DataFrame, view: str) -> DataFrame:
    """(id, segments): what a pane shows, as array<struct<text, match_ids>>; ``view`` is 'input' or 'output'.

    When restoring, the input pane marks placeholders and the output pane restored values; if
    these do not join to the text shown, it is shown plain. Else the output pane shows the
    redacted text, or as long as there is none, and the input pane, the text with its spans.
    """
    restoring, out = F.col("mode") == "pii-to-text", view == "output"
    shown = F.when(restoring, F.col("restore_output" if out else "restore_input")).otherwise(F.col("output" if out else "input"))
    rows = tabs.select("id", restoring.alias("_r"), shown.alias("_v"), F.col("restore_input"), "input", "matches", "index_format", spans.selected(F.col("matches"), F.col("selection")).alias("_s"))
    marked = lambda c: F.transform(c, lambda s: F.struct(s["text"].alias("text"), F.when(s["match_id"].isNotNull(), F.array(s["match_id"])).otherwise(F.array().cast("array<string>")).alias("match_ids")))
    ok = spans.usable(F.col("matches"), F.col("_v"))
    cut = scan.stretches(F.length("_v"), ok["start"], ok["end"], ok["match_id"])
    rows = rows.select(
        "*",
        spans.restored_segments(F.col("restore_input"), F.col("_s"), F.col("index_format"), "value" if out else "token").alias("_back"),
        spans.segments(F.col("input"), spans.resolved(spans.tokens(F.col("_s"), F.col("index_format")))).alias("_red"),
        cut.alias("_cut"),
    )
    plain = F.when(F.length("_v") > 0, F.array(F.struct(F.col("_v").alias("text"), F.array().cast("array<string>").alias("match_ids")))).otherwise(F.array().cast("array<struct<text:string,match_ids:array<string>>>"))
    covered = F.transform("_cut", lambda p: F.struct(F.substring(F.col("_v"), p["start"] + 1, p["end"] - p["start"]).alias("text"), p["match_ids"].alias("match_ids")))
    restored = F.when(spans.joined(F.col("_back")) == F.col("_v"), marked(F.col("_back"))).otherwise(plain)
    written = F.when(F.lit(out) & (F.length("input") > 0) & (F.length("_v") > 0), marked(F.col("_red"))).otherwise(covered)
    return rows.select("id", F.when(F.col("_r"), restored).otherwise(written).alias("segments"))


def overlays(tabs: DataFrame, view: str) -> DataFrame:
    """(id, match spans) a page preview marks: all spans in the input view, the selected ones in the output view."""
    shown = spans.selected(F.col("matches"), F.col("selection")) if view == "output" else spans.ordered(F.col("matches"))
    return tabs.select("id", F.inline(shown))


def merged_results(tabs: DataFrame, results: DataFrame) -> DataFrame:
    """Documents with scan results taken in: (id, start, end, found), one row per scanned range, or null bounds for a whole scan.

    Old spans that touch a scanned range give way to those found; decisions stay; the output
    is redacted anew. Ranges of one document in ``results`` must not overlap. Documents without
    a result stay as they are, results without a document are left out.
    """
    per = results.groupBy("id").agg(
        F.collect_list(F.struct(F.coalesce("start", F.lit(0)).alias("start"), F.coalesce("end", F.lit(2**31 - 1)).alias("end"))).alias("_ranges"), F.flatten(F.collect_list("found")).alias("_found")
    )
    met = tabs.join(per, "id", "left").withColumn("_new", F.col("_ranges").isNotNull())
    kept = F.filter("matches", lambda m: ~F.exists(F.col("_ranges"), lambda r: (m["start"] < r["end"]) & (m["end"] > r["start"])))
    met = met.withColumn("_all", F.when(F.col("_new"), spans.merged(kept, F.col("_found"))).otherwise(F.col("matches")))
    chosen = F.when(F.col("_new"), spans.full_selection(F.col("_all"), F.col("selection"))).otherwise(F.col("selection"))
    met = met.withColumn("_sel", chosen)
    fresh = spans.redacted(F.col("input"), spans.selected(F.col("_all"), F.col("_sel")), F.col("index_format"))
    new = {"matches": F.col("_all"), "selection": F.col("_sel"), "output": F.when(F.col("_new"), fresh).otherwise(F.col("output"))}
    return met.select(*[new.get(c, F.col(c)).alias(c) for c in tabs.columns])
