"""Queries of the training-data problems over the test tables, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm import langid, leakage, lookalike, mojibake, packing, pii, splitting
from veilspan.session import current_tabs, durable, parsed_json, spread, table


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _language_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    tabs = table(spark, sf_dir, "tabs")
    model = langid.fit(*langid.labelled_lines(tabs, "input", "lang"))
    current = current_tabs(tabs, ["input", "lang"]).select(F.col("id").alias("tab_id"), F.col("input").alias("text"), "lang")
    return langid.label_segments(current, model, "tab_id", "text", ["lang"])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of each tab whose label is missing, wrong or hides a mix of languages."""
    named = langid.label_language(F.col("lang"))
    return _language_runs(spark, sf_dir).where(named.isNull() | (F.col("runs") > 1) | (named != F.col("seg_lang"))).select("tab_id", "seg_no", "seg_lang")


def p1_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run of lines of every tab with its language, confidence and bounds."""
    return _language_runs(spark, sf_dir).select("tab_id", "seg_no", "seg_lang", "confidence", "seg_start", "seg_end")


def p1_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each tab: that of its longest text, with the share-weighted confidence."""
    size = F.col("seg_end") - F.col("seg_start")
    return (
        _language_runs(spark, sf_dir)
        .groupBy("tab_id", "seg_lang")
        .agg(F.sum(size).alias("n"), F.sum(size * F.col("confidence")).alias("c"))
        .groupBy("tab_id")
        .agg(F.max(F.struct("n", "seg_lang", "c")).alias("top"), F.sum("n").alias("total"))
        .select("tab_id", F.col("top.seg_lang").alias("lang"), F.round(F.col("top.c") / F.greatest("total", F.lit(1)), 6).alias("confidence"))
    )


def _p3_sides(spark: SparkSession, sf_dir: str) -> list[tuple[str, DataFrame, list[str], str, str]]:
    matches = table(spark, sf_dir, "redact_matches").where("tab_id IS NOT NULL").select("tab_id", "match_id", "value")
    tabs = current_tabs(table(spark, sf_dir, "tabs"), ["input"]).where(F.col("input").rlike(r"[\p{L}\p{N}]"))
    return [("match", matches, ["tab_id"], "match_id", "value"), ("tab", tabs, [], "id", "input")]


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Match values of one tab, and tab inputs, that differ as stored but read the same."""
    one, two = (lookalike.same_pairs(*side).select(F.lit(kind).alias("rec_type"), "rec_a", "rec_b") for kind, *side in _p3_sides(spark, sf_dir))
    return one.unionByName(two)


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as classes: every record with its class and how many of it are spelled otherwise."""
    one, two = (lookalike.same_classes(*side).select(F.lit(kind).alias("rec_type"), "rec", "class_id", "records", "spellings", "links") for kind, *side in _p3_sides(spark, sf_dir))
    return one.unionByName(two)


def p3_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct match value with its consistent form."""
    values = table(spark, sf_dir, "redact_matches").where("value IS NOT NULL").select("value").distinct()
    return lookalike.consistent_form(values.withColumn("text", F.col("value")), ["value"], "text").select("value", "form")


def p3_tabs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consistent form of every current tab input."""
    tabs = current_tabs(table(spark, sf_dir, "tabs"), ["input"])
    return lookalike.consistent_form(tabs, ["id"], "input").select(F.col("id").alias("tab_id"), "form")


def _tab_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Only the text of a page document travels, not its boxes.
    text = parsed_json(F.col("pdf_document_json"), "struct<text:string>")["text"]
    tabs = current_tabs(table(spark, sf_dir, "tabs").select("id", "updated_at", "input", text.alias("pdf_text")), ["input", "pdf_text"])
    return tabs.select(
        F.col("id").alias("tab_id"),
        F.inline(F.array(*[F.struct(F.lit(field).alias("item_field"), F.col(c).alias("text")) for field, c in (("input", "input"), ("pdf_document_json", "pdf_text"))])),
    )


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every tab text over 4,000 characters."""
    return splitting.split_items(_tab_items(spark, sf_dir), ["tab_id", "item_field"], "text")


def p4_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per cut item: whether its pieces keep the limit, join to the text and overlap as allowed, and that they are no more than twice the least number."""
    rows = p4_pieces(spark, sf_dir)
    n = rows.groupBy("tab_id", "item_field").agg(
        F.max(F.col("end") - F.col("start")).alias("longest"), F.min("start").alias("first"), F.max("end").alias("last"), F.sum(F.col("end") - F.col("start") - F.col("repeated")).alias("fresh"),
        F.max("repeated").alias("most"), F.min(F.when(F.col("piece_no") > 1, F.col("repeated"))).alias("least"), F.max("pieces").alias("pieces"), F.count("*").alias("rows"),
    )
    return n.select(
        "tab_id", "item_field", F.col("last").alias("chars"), (F.col("longest") <= 4000).alias("within"), ((F.col("first") == 0) & (F.col("fresh") == F.col("last"))).alias("whole"),
        ((F.col("most") <= 200) & (F.col("least") >= 0)).alias("overlapping"), ((F.col("pieces") == F.col("rows")) & (F.col("pieces") <= 2 * F.ceil(F.col("last") / 3800))).alias("few"),
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that had to be cut: one row for each first piece."""
    return p4_pieces(spark, sf_dir).where("piece_no = 1 AND pieces > 1").select("tab_id", "item_field")


def _pii(spark: SparkSession, sf_dir: str, redact: bool) -> DataFrame:
    tabs = durable(current_tabs(table(spark, sf_dir, "tabs"), ["input", "output", "matches_json"]), "current")
    found = table(spark, sf_dir, "redact_matches").where("tab_id IS NOT NULL AND value IS NOT NULL").select(F.col("tab_id").alias("key"), pii.span_kind(F.col("kind")).alias("kind"), "value", "start", "end")
    own = tabs.select("id", F.inline(parsed_json(F.col("matches_json"), "array<struct<kind:string,value:string,start:int,end:int>>")))
    own = own.where("value IS NOT NULL").select(F.col("id").alias("key"), pii.span_kind(F.col("kind")).alias("kind"), "value", "start", "end")
    spans = durable(found.unionByName(own).distinct(), "spans")
    texts = tabs.where(F.length("input") > 0).select(F.col("id").alias("key"), F.col("input").alias("text"))
    detector = pii.fit(*pii.training_texts(texts, spans), pii.count_words(texts, spans))
    # An output that equals its input is searched once.
    one = lambda fields, c: F.struct(F.array(*map(F.lit, fields)).alias("fields"), F.col(c).alias("text"))
    items = F.when(F.col("input").eqNullSafe(F.col("output")), F.array(one(["input", "output"], "input"))).otherwise(F.array(one(["input"], "input"), one(["output"], "output")))
    found = pii.find_spans(tabs.select(F.col("id").alias("tab_id"), F.inline(items)), detector, ["tab_id", "fields"], "text", redact)
    return found.select("tab_id", F.explode("fields").alias("tab_field"), *[c for c in found.columns if c not in ("tab_id", "fields")])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every occurrence of personal data in the current inputs and outputs."""
    return _pii(spark, sf_dir, False).select("tab_id", "tab_field", "pii_kind", "pii_start", "pii_end")


def p5_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current inputs and outputs with typed placeholders in place of the personal data."""
    return _pii(spark, sf_dir, True).select("tab_id", "tab_field", "redacted", "spans")


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every document, or of every piece of a document over capacity."""
    return packing.fill_containers(_documents(spark, sf_dir))


def p6_certificates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, lower bound and gap of every partition of the packing, and of the whole (null part)."""
    return packing.certificate(p6_containers(spark, sf_dir))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold at least 13 consecutive words of an item, with the item."""
    return leakage.leaks(_documents(spark, sf_dir), table(spark, sf_dir, "eval_items"))


def p7_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact and proximity matches with the longest run and the most aligned words."""
    return leakage.matches(_documents(spark, sf_dir), table(spark, sf_dir, "eval_items"))


def p8_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a garbled stretch, with the restored text."""
    docs = _documents(spark, sf_dir)
    return mojibake.repair_documents(docs, mojibake.corpus_pairs(docs)).select("doc_id", "restored", "stretches", "layers", "lost")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with at least one garbled stretch."""
    return p8_restored(spark, sf_dir).select("doc_id")


_WORDS_SQL = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"

P7_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, {_WORDS_SQL} AS w FROM eval_items WHERE text IS NOT NULL),
dg AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 11), lambda k: array_to_string(w[k:k+12], ' '))) AS g FROM d WHERE len(w) >= 13),
ig AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 11), lambda k: array_to_string(w[k:k+12], ' '))) AS g FROM i WHERE len(w) >= 13)
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)"""

P4_SQL = """
WITH cur AS (SELECT id, any_value(input) AS input, any_value(pdf_document_json) AS pj FROM
  (SELECT *, rank() OVER (PARTITION BY id ORDER BY updated_at DESC) AS rk FROM tabs) WHERE rk = 1 GROUP BY id)
SELECT id AS tab_id, 'input' AS item_field FROM cur WHERE length(input) > 4000
UNION ALL
SELECT id, 'pdf_document_json' FROM (SELECT id, CASE WHEN json_valid(pj) THEN json_extract_string(pj, '$.text') END AS t FROM cur) WHERE length(t) > 4000"""

P4_CHECKS_SQL = """
WITH cur AS (SELECT id, any_value(input) AS input, any_value(pdf_document_json) AS pj FROM
  (SELECT *, rank() OVER (PARTITION BY id ORDER BY updated_at DESC) AS rk FROM tabs) WHERE rk = 1 GROUP BY id),
t AS (SELECT id, 'input' AS item_field, input AS x FROM cur UNION ALL SELECT id, 'pdf_document_json', CASE WHEN json_valid(pj) THEN json_extract_string(pj, '$.text') END FROM cur)
SELECT id AS tab_id, item_field, length(x) AS chars, true AS "within", true AS whole, true AS overlapping, true AS few FROM t WHERE length(x) > 4000"""

QUERIES = {
    "p1_found": p1_found,
    "p1_segments": p1_segments,
    "p1_labels": p1_labels,
    "p3_found": p3_found,
    "p3_classes": p3_classes,
    "p3_values": p3_values,
    "p3_tabs": p3_tabs,
    "p4_found": p4_found,
    "p4_pieces": p4_pieces,
    "p4_checks": p4_checks,
    "p5_found": p5_found,
    "p5_redacted": p5_redacted,
    "p6_containers": p6_containers,
    "p6_certificates": p6_certificates,
    "p7_found": p7_found,
    "p7_matches": p7_matches,
    "p8_found": p8_found,
    "p8_restored": p8_restored,
}
ORACLES = {"p4_found": P4_SQL, "p4_checks": P4_CHECKS_SQL, "p7_found": P7_SQL}
