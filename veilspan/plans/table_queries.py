"""Queries over stored tabs, rules, task history and page data, and streams, with SQL twins."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilspan.functions import scalar
from veilspan.operators import chunk, document, model, pdfgeo, report, spans, verify
from veilspan.operators.detect import built_in, register
from veilspan.plans.span_queries import _TABS_SQL, _all_rules_sql, _label_sql, quoted
from veilspan.session import own_folder, parsed_json, spread, table
from veilspan.sources import sinks
from veilspan.sources.files import load_history, load_tabs, rule_rows
from veilspan.streaming import stream

# ------------------------------------------------------------------ tabs


def _load(closed: bool) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = load_tabs(table(spark, sf_dir, "tabs"), closed)
        return t.select("id", "title", "document_kind", "index_format", "mode", F.size("matches").alias("matches"), F.size("selection").alias("decisions"), F.length("pdf_document.text").alias("pdf_chars"), "sort_order", "updated_at")

    query.__doc__ = f"Current {'closed' if closed else 'open'} tabs, parsed, with defaults for unknown values."
    return query


def _load_sql(closed: int) -> str:
    return f"""WITH {_TABS_SQL} SELECT cur.id, title, CASE WHEN dk IN ('markdown', 'pdf') THEN dk ELSE 'text' END AS document_kind, CASE WHEN fmt IN ('number', 'id') THEN fmt ELSE 'none' END AS index_format,
CASE WHEN mode = 'pii-to-text' THEN mode ELSE 'text-to-pii' END AS mode, coalesce(nm, 0) AS matches, coalesce(ns, 0) AS decisions, CASE WHEN json_valid(pj) THEN length(json_extract_string(pj, '$.text')) END AS pdf_chars, sort_order, updated_at
FROM cur LEFT JOIN (SELECT id, count(*) AS nm FROM ms GROUP BY id) USING (id) LEFT JOIN (SELECT id, count(*) AS ns FROM dec GROUP BY id) USING (id) WHERE coalesce(is_closed, 0) = {closed}"""


def tab_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names and kinds that follow from tab titles."""
    t = table(spark, sf_dir, "tabs").where("title IS NOT NULL").select("title").distinct()
    more = spark.createDataFrame([(x,) for x in ("a/b.MD", "x\\notes.TXT", ".md", "report.final.pdf", "plain", "--.txt", "  spaced name .text", "bad/name.docx")], "title string")
    c = F.col("title")
    return t.unionByName(more).distinct().select(
        "title",
        scalar.file_extension(c).alias("extension"),
        scalar.import_kind(c).alias("import_kind"),
        scalar.output_name(c, "-redacted.txt").alias("output_name"),
        scalar.bare_file_name(c).alias("bare"),
        scalar.safe_segment(c).alias("safe"),
    )


_EXT = "(CASE WHEN position('.' IN substr(fn, 2)) > 0 THEN lower(regexp_extract(fn, '[^.]*$')) ELSE '' END)"
_STEM = "regexp_replace(regexp_replace(regexp_replace(trim(title), '\\.[A-Za-z0-9]+$', ''), '[^A-Za-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g')"
_NAMES_SQL = f"""WITH t AS (SELECT DISTINCT title FROM (SELECT title FROM tabs WHERE title IS NOT NULL UNION ALL VALUES ('a/b.MD'), ('x\\notes.TXT'), ('.md'), ('report.final.pdf'), ('plain'), ('--.txt'), ('  spaced name .text'), ('bad/name.docx'))),
f AS (SELECT title, regexp_extract(title, '[^\\\\/]*$') AS fn FROM t)
SELECT title, {_EXT} AS extension, CASE WHEN {_EXT} IN ('md', 'markdown', 'txt', 'text') THEN 'markdown' WHEN {_EXT} = 'pdf' THEN 'pdf' END AS import_kind,
CASE WHEN {_STEM} = '' THEN 'pii-output' ELSE {_STEM} END || '-redacted.txt' AS output_name, (title <> '' AND NOT regexp_matches(title, '[\\\\/]') AND title NOT IN ('.', '..')) AS bare, regexp_full_match(title, '[A-Za-z0-9_-]+') AS safe FROM f"""


def kind_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stored kind with its display label and its place in the taxonomy."""
    k = table(spark, sf_dir, "redact_matches").where("kind IS NOT NULL").select("kind").distinct()
    return k.select("kind", scalar.display_label(F.col("kind")).alias("label"), scalar.normal_kind(F.col("kind")).alias("normal"))


_LABELS_SQL = """WITH k AS (SELECT DISTINCT kind FROM redact_matches WHERE kind IS NOT NULL), p AS (SELECT kind, list_filter(string_split_regex(kind, '[_ -]+'), lambda x: x <> '') AS ps, replace(replace(lower(kind), ' ', '_'), '-', '_') AS n FROM k)
SELECT kind, array_to_string(list_transform(ps, lambda x: upper(x[1]) || x[2:]), '') AS label, CASE
 WHEN n IN ('per', 'person', 'name', 'person_name', 'person_alias', 'proper_name') THEN 'private_person' WHEN n IN ('email', 'email_address') THEN 'private_email' WHEN n IN ('phone', 'phone_number', 'telephone') THEN 'private_phone'
 WHEN n IN ('address', 'addr', 'location', 'postal_address', 'geo_location') THEN 'private_address' WHEN n IN ('date', 'date_of_birth') THEN 'private_date' WHEN n IN ('url', 'website', 'identifying_link') THEN 'private_url'
 WHEN n IN ('iban', 'account', 'account_number', 'account_identifier', 'bank_account_identifier', 'payment_card') THEN 'account_number' WHEN n IN ('password', 'secret', 'api_key', 'token', 'auth_secret', 'payment_card_security') THEN 'secret' ELSE n END AS normal FROM p"""


def result_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exported span list of each tab: selected flag and placeholder."""
    t = load_tabs(table(spark, sf_dir, "tabs"), columns=["input", "matches", "selection", "index_format"]).withColumn("matches", spans.usable(F.col("matches"), F.col("input")))
    return t.select("id", F.inline(sinks.payload(F.col("matches"), F.col("selection"), F.col("index_format"))).alias("match_id", "kind", "value", "start", "end", "selected", "replacement"))


_PAYLOAD_SQL = f"""WITH {_TABS_SQL} SELECT sp.id, sp.match_id, sp.kind, sp.value, sp.start, sp."end", c.idx IS NOT NULL AS selected,
CASE WHEN c.idx IS NOT NULL THEN {_label_sql('sp.kind', 'c.idx', "(CASE WHEN fmt IN ('number', 'id') THEN fmt ELSE 'none' END)")} END AS replacement
FROM sp JOIN cur USING (id) LEFT JOIN (SELECT id, match_id, any_value(idx) AS idx FROM chosen GROUP BY id, match_id) c ON c.id = sp.id AND c.match_id = sp.match_id"""

# ------------------------------------------------------------------ rules and history


def load_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable rules with their kind; unknown modes count as exact."""
    name = F.trim("name")
    return rule_rows(table(spark, sf_dir, "custom_rules")).select("id", F.when(name == "", "Custom").otherwise(name).alias("kind"), "mode", "pattern", "updated_at")


_RULES_SQL = "SELECT id, CASE WHEN trim(coalesce(name, '')) = '' THEN 'Custom' ELSE trim(name) END AS kind, CASE WHEN mode = 'regex' THEN mode ELSE 'exact' END AS mode, pattern, updated_at FROM custom_rules WHERE length(pattern) > 0"


def duplicate_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that match exactly like an older one, with that one."""
    r = load_rules(spark, sf_dir).withColumn("p", F.trim("pattern")).where("p <> ''")
    w = Window.partitionBy("mode", "p").orderBy("updated_at", "id")
    return r.select("id", F.first("id").over(w).alias("first_id")).where("id <> first_id")


_DUP_SQL = f"WITH r AS ({_RULES_SQL}) SELECT id, first_id FROM (SELECT id, first_value(id) OVER (PARTITION BY mode, trim(pattern) ORDER BY updated_at, id) AS first_id FROM r WHERE trim(pattern) <> '') WHERE id <> first_id"

_RES = ["id", "task_id", "tab_id", "backend", "index_format", "status", "input_length", "queued_at", "started_at", "completed_at", "duration_ms", "match_count", "category_summary_json", "result_path", "error", "recorded_at"]


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.latest(table(spark, sf_dir, "pii_filter_results").select(*_RES), "id", "recorded_at")


_RES_SQL = "res AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY recorded_at DESC NULLS LAST) AS rk FROM (SELECT DISTINCT " + ", ".join(_RES) + " FROM pii_filter_results)) WHERE rk = 1)"


def latest_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last written row of each result."""
    return _results(spark, sf_dir).select("id", "status", "queued_at", "match_count")


def history_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 200 newest tasks with defaults for unknown values."""
    h = load_history(_results(spark, sf_dir))
    return h.select("task_id", "tab_id", "backend", "index_format", "status", "queued_at", "duration_ms", "match_count", F.aggregate(F.coalesce("category_summary", F.array().cast("array<struct<kind:string,count:bigint>>")), F.lit(0).cast("long"), lambda a, c: a + c["count"]).alias("counted"))


_HISTORY_COLUMNS = """CASE WHEN coalesce(task_id, '') <> '' THEN task_id ELSE id END AS task_id, tab_id, CASE WHEN backend IN ('onnx', 'bardsai') THEN backend ELSE 'regex' END AS backend,
CASE WHEN index_format IN ('number', 'id') THEN index_format ELSE 'none' END AS index_format, CASE WHEN status = 'failed' THEN status ELSE 'completed' END AS status, queued_at, duration_ms, match_count"""
_HISTORY_SQL = f"""WITH {_RES_SQL} SELECT {_HISTORY_COLUMNS}, coalesce(list_sum(list_transform(from_json(CASE WHEN json_valid(category_summary_json) THEN category_summary_json END, '[{{"kind":"VARCHAR","count":"BIGINT"}}]'), lambda c: c.count)), 0)::BIGINT AS counted
FROM (SELECT * FROM res ORDER BY queued_at DESC, id LIMIT 200)"""


def history_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of five tasks."""
    rows = report.history_page(_results(spark, sf_dir), "queued_at", "id", 3, 5)
    return rows.select("id", "queued_at", "page", "page_size", "total_pages", "total_items")


_PAGE_SQL = f"WITH {_RES_SQL} SELECT id, queued_at, 3 AS page, 5 AS page_size, ((SELECT count(*) FROM res) + 4) // 5 AS total_pages, (SELECT count(*) FROM res) AS total_items FROM res ORDER BY queued_at DESC, id LIMIT 5 OFFSET 10"


def task_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duration of every finished task from its times, never negative; and its file name."""
    r = _results(spark, sf_dir)
    return r.where("completed_at IS NOT NULL").select("id", report.duration_ms(F.col("started_at"), F.col("completed_at")).alias("ms"), scalar.result_file_name(F.col("completed_at")).alias("file_name"))


_DURATION_SQL = f"WITH {_RES_SQL} SELECT id, CASE WHEN started_at IS NOT NULL THEN greatest(completed_at - started_at, 0) END AS ms, strftime(make_timestamp(completed_at * 1000), '%Y-%m-%dT%H-%M-%S') || '-' || lpad((completed_at % 1000)::VARCHAR, 3, '0') || 'Z.json' AS file_name FROM res WHERE completed_at IS NOT NULL"


def active_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tabs with a queued or running task."""
    t = load_tabs(table(spark, sf_dir, "tabs"), columns=[]).select(F.col("id").alias("tab_id"))
    return report.active_documents(t, "tab_id", _results(spark, sf_dir))


_ACTIVE_SQL = f"WITH {_RES_SQL} SELECT DISTINCT id AS tab_id FROM tabs WHERE id IN (SELECT tab_id FROM res WHERE status IN ('queued', 'running'))"


def active_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many tasks are queued or running."""
    return report.active_count(_results(spark, sf_dir))


_ACTIVE_COUNT_SQL = f"WITH {_RES_SQL} SELECT count(*) AS active FROM res WHERE status IN ('queued', 'running')"


def history_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored counts per backend and kind."""
    rows = _results(spark, sf_dir).select(scalar.backend(F.col("backend")).alias("backend"), F.inline(parsed_json(F.col("category_summary_json"), "array<struct<kind:string,count:bigint>>")))
    return rows.groupBy("backend", "kind").agg(F.sum("count").alias("count"), F.count("*").alias("tasks"))


_HSUM_SQL = f"""WITH {_RES_SQL}, x AS (SELECT CASE WHEN backend IN ('onnx', 'bardsai') THEN backend ELSE 'regex' END AS backend, unnest(from_json(CASE WHEN json_valid(category_summary_json) THEN category_summary_json END, '[{{"kind":"VARCHAR","count":"BIGINT"}}]')) AS c FROM res)
SELECT backend, c.kind AS kind, sum(c.count)::BIGINT AS count, count(*) AS tasks FROM x GROUP BY 1, 2"""


def task_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tab each task belongs to: open, closed, or gone."""
    t = load_tabs(table(spark, sf_dir, "tabs"), columns=["is_closed"]).withColumnRenamed("id", "tab_id")
    r = _results(spark, sf_dir).select("id", "tab_id")
    return r.join(t, "tab_id", "left").select("id", F.when(F.col("is_closed").isNull(), "gone").when(F.col("is_closed"), "closed").otherwise("open").alias("where"))


_TASKDOC_SQL = f"""WITH {_TABS_SQL}, {_RES_SQL} SELECT res.id, CASE WHEN cur.id IS NULL THEN 'gone' WHEN coalesce(cur.is_closed, 0) <> 0 THEN 'closed' ELSE 'open' END AS "where" FROM res LEFT JOIN cur ON cur.id = res.tab_id"""


def size_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of results in units, and their share of the largest limit."""
    r = _results(spark, sf_dir).select("id", (F.col("input_length").cast("long") * F.col("input_length")).alias("bytes"))
    return r.select("id", scalar.size_label(F.col("bytes")).alias("size"), F.round(scalar.percent(F.col("bytes").cast("double"), F.lit(1_000_000.0)), 6).alias("percent"))


_B = "(input_length::BIGINT * input_length)"
_SIZE_SQL = f"""WITH {_RES_SQL} SELECT id, CASE WHEN {_B} <= 0 THEN '0 B' WHEN {_B} >= 1000000000 THEN CASE WHEN {_B} >= 10000000000 THEN printf('%.0f', {_B} / 1e9) ELSE printf('%.1f', {_B} / 1e9) END || ' GB'
WHEN {_B} >= 1000000 THEN CASE WHEN {_B} >= 10000000 THEN printf('%.0f', {_B} / 1e6) ELSE printf('%.1f', {_B} / 1e6) END || ' MB' WHEN {_B} >= 1000 THEN CASE WHEN {_B} >= 10000 THEN printf('%.0f', {_B} / 1e3) ELSE printf('%.1f', {_B} / 1e3) END || ' KB'
ELSE {_B}::VARCHAR || ' B' END AS size, round(least(greatest({_B} / 1000000.0 * 100, 0), 100), 6) AS percent FROM res WHERE input_length IS NOT NULL
UNION ALL SELECT id, NULL, NULL FROM res WHERE input_length IS NULL"""

# ------------------------------------------------------------------ persistence


def persist_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task results after the newer half was written over the older half; rows without a time count as older than all."""
    r = table(spark, sf_dir, "pii_filter_results").select(*_RES)
    late = F.coalesce(F.col("recorded_at") >= F.lit("2025-07-01").cast("timestamp"), F.lit(False))
    old = report.latest(r.where(~late), "id", "recorded_at")
    return sinks.upserted(old, r.where(late), "id", "recorded_at").select("id", "status", "recorded_at")


_UPSERT_SQL = f"WITH {_RES_SQL} SELECT id, status, recorded_at FROM res"


def persist_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What saving only the open tabs does to each stored tab."""
    tabs = load_tabs(table(spark, sf_dir, "tabs"), columns=["is_closed"])
    return sinks.merge_delta(tabs, tabs.where("NOT is_closed"), "id")


_PRUNE_SQL = f"WITH {_TABS_SQL} SELECT id, CASE WHEN coalesce(is_closed, 0) = 0 THEN 'update' ELSE 'delete' END AS action FROM cur"


def persist_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results that stay when those of closed tabs are deleted; those of no tab stay."""
    gone = load_tabs(table(spark, sf_dir, "tabs"), closed=True, columns=[]).select(F.col("id").alias("tab_id"))
    return sinks.deleted(_results(spark, sf_dir), "tab_id", gone).select("id", "tab_id")


_DELETE_SQL = f"WITH {_TABS_SQL}, {_RES_SQL} SELECT id, tab_id FROM res WHERE tab_id IS NULL OR tab_id NOT IN (SELECT id FROM cur WHERE coalesce(is_closed, 0) <> 0)"

# ------------------------------------------------------------------ pages


def _pdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_tabs(table(spark, sf_dir, "tabs"), columns=["pdf_document", "matches", "selection"]).where("pdf_document IS NOT NULL")


_PDF_SQL = """pd AS (SELECT id, from_json(pj, '{"text":"VARCHAR","pages":[{"index":"INTEGER","width":"DOUBLE","height":"DOUBLE"}],"charBoxes":[{"pageIndex":"INTEGER","x":"DOUBLE","y":"DOUBLE","width":"DOUBLE","height":"DOUBLE"}]}') AS d FROM cur WHERE json_valid(pj) AND json_type(pj) = 'OBJECT'),
bx AS (SELECT id, d.charBoxes[i] AS b, i - 1 AS pos FROM (SELECT id, d, unnest(range(1, len(d.charBoxes) + 1)) AS i FROM pd)),
pg AS (SELECT id, p.index AS page, p.width AS width, p.height AS height FROM (SELECT id, unnest(d.pages) AS p FROM pd))"""


def pdf_page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the characters of each page begin and end."""
    rows = _pdf(spark, sf_dir).select("id", F.inline(chunk.page_ranges(F.col("pdf_document.pages"), F.col("pdf_document.charBoxes"))))
    return rows.select("id", "page", "start", "end")


_RANGES_SQL = f'WITH {_TABS_SQL}, {_PDF_SQL} SELECT bx.id, b.pageIndex AS page, min(pos)::INT AS start, (max(pos) + 1)::INT AS "end" FROM bx JOIN pg ON pg.id = bx.id AND pg.page = b.pageIndex GROUP BY 1, 2'


def pdf_span_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the spans of PDF tabs stand in the page text: at their own place, or where their value is nearest."""
    rows = _pdf(spark, sf_dir).select("id", F.col("pdf_document.text").alias("text"), F.inline("matches")).where("start IS NOT NULL AND `end` IS NOT NULL AND text IS NOT NULL")
    at = pdfgeo.drifted_range(F.col("text"), F.col("value"), F.col("start"), F.col("end"))
    return rows.select("id", "match_id", F.col("start").alias("stored_start"), F.col("end").alias("stored_end"), at.alias("r")).select("id", "match_id", "stored_start", "stored_end", "r.start", "r.end")


_BLANK_ENDS = "'^[\\s\\x{00A0}\\x{FEFF}\\x{3000}\\x{2000}-\\x{200A}\\x{202F}]+|[\\s\\x{00A0}\\x{FEFF}\\x{3000}\\x{2000}-\\x{200A}\\x{202F}]+$'"


def _nearest_sql(name: str, value: str) -> str:
    """CTE ``name``(k, pos): the occurrence of a value nearest to its stored start, the earlier of two."""
    return f"""{name} AS (SELECT k, arg_min(pos, abs(pos - s)::BIGINT * 1000000000 + pos) AS pos FROM (SELECT k, s, (list_sum(list_transform(g[1:i], lambda x: length(x))) + (i - 1) * length({value}))::INT AS pos
  FROM (SELECT k, s, {value}, g, unnest(range(1, len(g))) AS i FROM (SELECT k, s, {value}, string_split(text, {value}) AS g FROM m WHERE length({value}) > 0 AND contains(text, {value})))) GROUP BY k)"""


_DRIFT_SQL = f"""WITH {_TABS_SQL}, m AS (SELECT row_number() OVER () AS k, ms.id, m.id AS match_id, m.start AS s, m."end" AS e, m.value AS v, CASE WHEN length(t) >= 2 AND t <> m.value THEN t END AS sv, text
  FROM (SELECT ms.id, m, regexp_replace(m.value, {_BLANK_ENDS}, '', 'g') AS t FROM ms) ms JOIN (SELECT id, CASE WHEN json_valid(pj) THEN json_extract_string(pj, '$.text') END AS text FROM cur) p USING (id)
  WHERE m.start IS NOT NULL AND m."end" IS NOT NULL AND text IS NOT NULL),
{_nearest_sql('a', 'v')}, {_nearest_sql('b', 'sv')}
SELECT id, match_id, s AS stored_start, e AS stored_end, CASE WHEN keep THEN s ELSE pos END AS start, CASE WHEN keep THEN e ELSE pos + length(v) END AS "end"
FROM (SELECT m.*, coalesce(a.pos, b.pos) AS pos, coalesce(length(v), 0) = 0 OR substr(text, s + 1, e - s) = v OR coalesce(a.pos, b.pos) IS NULL AS keep FROM m LEFT JOIN a USING (k) LEFT JOIN b USING (k))"""


def pdf_line_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Padded line boxes of the selected spans of PDF tabs."""
    docs = _pdf(spark, sf_dir)
    chosen = docs.select(F.col("id").alias("doc_id"), F.col("pdf_document.text").alias("text"), F.col("pdf_document.charBoxes").alias("boxes"), F.inline(spans.selected(F.col("matches"), F.col("selection"))))
    good = chosen.where("start >= 0 AND `end` > start AND `end` <= size(boxes)").withColumn("boxes", F.slice("boxes", F.col("start") + 1, F.col("end") - F.col("start")))
    pages = docs.select(F.col("id").alias("doc_id"), F.inline("pdf_document.pages")).select("doc_id", F.col("index").alias("page_index"), F.col("width").alias("page_width"), F.col("height").alias("page_height"))
    rows = pdfgeo.span_boxes(good.select("doc_id", "match_id", "start", "end", "boxes").dropDuplicates(["doc_id", "match_id", "start", "end"]), pages, ["match_id", "start", "end"])
    return rows.select("doc_id", "match_id", "start", "end", "page_index", *[F.round(c, 4).alias(c) for c in ("line", "x", "y", "width", "height")])


_LINES_SQL = f"""WITH {_TABS_SQL}, {_PDF_SQL},
pm AS (SELECT DISTINCT ms.id, m.id AS match_id, m.start AS start, m."end" AS "end" FROM ms JOIN pd USING (id) LEFT JOIN dec ON dec.id = ms.id AND dec.match_id = m.id WHERE coalesce(keep, true) AND m.start >= 0 AND m."end" > m.start AND m."end" <= len(d.charBoxes)),
ch AS (SELECT pm.*, b FROM pm JOIN bx ON bx.id = pm.id AND bx.pos >= pm.start AND bx.pos < pm."end" WHERE b IS NOT NULL),
ln AS (SELECT id, match_id, start, "end", b.pageIndex AS page_index, floor(b.y * 2 + 0.5) / 2 AS line, min(b.x) AS x, min(b.y) AS y, max(b.x + b.width) AS r, max(b.y + b.height) AS bt, arg_min(b.width, b.x) FILTER (b.width > 0) AS g FROM ch GROUP BY 1, 2, 3, 4, 5, 6),
pd2 AS (SELECT *, bt - y AS h, greatest(2.0, (bt - y) * 0.1) AS e FROM ln),
pl AS (SELECT *, e + CASE WHEN g IS NULL THEN h * 0.12 ELSE least(greatest(g * 0.6, 1.5), h * 0.55) END AS l FROM pd2),
rw AS (SELECT id, match_id, start, "end", page_index, line, x - l AS x, y - e AS y, r - x + l + e AS w, h * 1.25 + e * 2 AS hh FROM pl)
SELECT rw.id AS doc_id, match_id, start, "end", page_index, round(line, 4) AS line, round(CASE WHEN pg.page IS NULL THEN x ELSE greatest(0, x) END, 4) AS x, round(CASE WHEN pg.page IS NULL THEN y ELSE greatest(0, y) END, 4) AS y,
round(CASE WHEN pg.page IS NULL THEN w ELSE greatest(1, least(pg.width, x + w) - greatest(0, x)) END, 4) AS width, round(CASE WHEN pg.page IS NULL THEN hh ELSE greatest(1, least(pg.height, y + hh) - greatest(0, y)) END, 4) AS height
FROM rw LEFT JOIN pg ON pg.id = rw.id AND pg.page = rw.page_index"""


def pdf_page_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each page is exported: copied, or covered where it has boxes."""
    docs = _pdf(spark, sf_dir)
    hit = pdf_line_boxes(spark, sf_dir).select(F.col("doc_id").alias("id"), "page_index")
    return pdfgeo.page_plan(docs.select("id", F.size("pdf_document.pages").alias("n")), "id", "n", hit, "searchable")


_PLAN_SQL = f"""WITH bxs AS ({_LINES_SQL}), {_TABS_SQL}, {_PDF_SQL}, n AS (SELECT id, unnest(range(0, len(d.pages)))::INT AS page_index FROM pd)
SELECT n.id, n.page_index, CASE WHEN h.doc_id IS NULL THEN 'copy' ELSE 'cover' END AS strategy FROM n LEFT JOIN (SELECT DISTINCT doc_id, page_index FROM bxs) h ON h.doc_id = n.id AND h.page_index = n.page_index"""

# ------------------------------------------------------------------ documents


def _panes(view: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = load_tabs(table(spark, sf_dir, "tabs"), columns=["input", "output", "matches", "selection", "index_format", "mode", "restore_input", "restore_output"])
        rows = document.pane_segments(t.withColumn("matches", spans.usable(F.col("matches"), F.col("input"))), view)
        marked = F.aggregate("segments", F.lit(0), lambda a, s: a + F.size(s["match_ids"]))
        return rows.select("id", F.size("segments").alias("segments"), marked.alias("marks"), F.length(F.array_join(F.transform("segments", lambda s: s["text"]), "")).alias("chars"))

    query.__doc__ = f"Segments, marks and characters of the {view} pane of every tab."
    return query


def documents_cleared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths after the inputs of closed tabs and the outputs of open ones were cleared."""
    columns = ["document_kind", "input", "output", "matches", "mode", "restore_input", "restore_output", "is_closed"]
    t = document.cleared_input(load_tabs(table(spark, sf_dir, "tabs"), columns=columns), F.col("is_closed"))
    t = document.cleared_output(t, ~F.col("is_closed"))
    return t.select("id", "document_kind", *[F.length(c).alias(c) for c in ("input", "output", "restore_input", "restore_output")], F.size("matches").alias("matches"))


_CLEARED_SQL = f"""WITH {_TABS_SQL}, t AS (SELECT cur.id, mode = 'pii-to-text' AS r, coalesce(is_closed, 0) <> 0 AS c, CASE WHEN dk IN ('markdown', 'pdf') THEN dk ELSE 'text' END AS dk, length(coalesce(input, '')) AS i, length(coalesce(output, '')) AS o,
 length(coalesce(ri, '')) AS ri, length(coalesce(ro, '')) AS ro, coalesce(n, 0) AS n FROM cur JOIN (SELECT id, any_value(restore_input) AS ri, any_value(restore_output) AS ro FROM (SELECT *, rank() OVER (PARTITION BY id ORDER BY updated_at DESC) AS rk FROM tabs) WHERE rk = 1 GROUP BY id) USING (id)
 LEFT JOIN (SELECT id, count(*) AS n FROM ms GROUP BY id) USING (id))
SELECT id, CASE WHEN c AND NOT coalesce(r, false) THEN 'text' ELSE dk END AS document_kind, CASE WHEN c AND NOT coalesce(r, false) THEN 0 ELSE i END AS input, CASE WHEN NOT coalesce(r, false) THEN 0 ELSE o END AS output,
CASE WHEN c THEN 0 ELSE ri END AS restore_input, 0 AS restore_output, CASE WHEN NOT coalesce(r, false) THEN 0 ELSE n END AS matches FROM t"""


def entity_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of spans that follow from tab, kind and place."""
    r = table(spark, sf_dir, "redact_matches").select("tab_id", "kind", "start").distinct()
    return r.select("tab_id", "kind", "start", document.entity_id("span", F.col("tab_id"), F.col("kind"), F.col("start")).alias("entity_id"))


_ENTITY_SQL = """SELECT tab_id, kind, start, 'span-' || substr(sha256(coalesce('+' || tab_id, '-') || chr(31) || coalesce('+' || kind, '-') || chr(31) || coalesce('+' || start, '-')), 1, 32) AS entity_id
FROM (SELECT DISTINCT tab_id, kind, start FROM redact_matches)"""


def import_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tab titles taken as file names: how many an import takes and how many not."""
    return document.import_counts(table(spark, sf_dir, "tabs").where("title IS NOT NULL").select(F.col("title").alias("path")).distinct())


_IMPORT_SQL = """WITH f AS (SELECT DISTINCT regexp_extract(title, '[^\\/]*$') AS fn, title FROM tabs WHERE title IS NOT NULL),
e AS (SELECT CASE WHEN position('.' IN substr(fn, 2)) > 0 THEN lower(regexp_extract(fn, '[^.]*$')) ELSE '' END IN ('md', 'markdown', 'txt', 'text', 'pdf') AS ok FROM f)
SELECT count(*) AS files, count(*) FILTER (ok) AS supported, count(*) FILTER (NOT ok) AS unsupported FROM e"""


def page_overlays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans the output preview of PDF tabs marks."""
    t = load_tabs(table(spark, sf_dir, "tabs"), columns=["document_kind", "input", "matches", "selection"]).where("document_kind = 'pdf'")
    return document.overlays(t.withColumn("matches", spans.usable(F.col("matches"), F.col("input"))), "output").select("id", "match_id", "start", "end")


_OVERLAY_SQL = f"WITH {_TABS_SQL} SELECT chosen.id, match_id, start, \"end\" FROM chosen JOIN cur USING (id) WHERE dk = 'pdf'"


def chunk_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tabs after the first 500 characters of each were scanned again by all rules: spans that stay and new ones."""
    t = load_tabs(table(spark, sf_dir, "tabs"), columns=["input", "output", "matches", "selection", "index_format"])
    t = t.withColumn("matches", spans.usable(F.col("matches"), F.col("input")))
    found = t.select("id", F.lit(0).alias("start"), F.lit(500).alias("end"), built_in()(F.substring("input", 1, 500)).alias("found"))
    rows = document.merged_results(t, found)
    return rows.select("id", F.inline("matches")).select("id", "kind", "start", "end")


_CHUNK_CTES, _CHUNK_SELECT = _all_rules_sql("(SELECT id, substr(input, 1, 500) AS text FROM cur)", "id")
_CHUNK_SQL = f'WITH {_TABS_SQL}, {_CHUNK_CTES} SELECT id, kind, start, "end" FROM sp WHERE NOT (start < 500 AND "end" > 0) UNION ALL SELECT id, kind, start, "end" FROM ({_CHUNK_SELECT})'


def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content hashes of the current inputs, as used to verify files."""
    t = load_tabs(table(spark, sf_dir, "tabs"), columns=["input"])
    return t.select("id", verify.content_hash(F.col("input")).alias("sha256"), F.sha1("input").alias("sha1"))


_HASH_SQL = f"WITH {_TABS_SQL} SELECT id, sha256(coalesce(input, '')) AS sha256, sha1(coalesce(input, '')) AS sha1 FROM cur"

# ------------------------------------------------------------------ models

_LABELS = ["O", "B-PER", "I-PER", "B-email address", "I-email address"]


def _word_runner() -> model.LogitsRunner:
    """Words as tokens, and logits that peak where they look like names or addresses."""
    word, name, upper = re.compile(r"[^ \t\n\x0b\f\r]+"), re.compile("[A-Z][a-z]+[\x85\u2028\u2029]?"), re.compile("[A-Z]")

    def run(text: str) -> tuple[list[tuple[int, int]], np.ndarray]:
        found = [(m.span(), m.group()) for m in word.finditer(text)]
        peaks = [(1, 3 * bool(name.fullmatch(w)), 3 * bool(upper.match(w)), 3 * ("@" in w), 3 * ("." in w)) for _, w in found]
        return [at for at, _ in found], np.array(peaks, np.float32).reshape(-1, 5)

    return run


def _model_spans(spark: SparkSession, sf_dir: str, scheme: str, names: list[str]) -> DataFrame:
    """Spans of all documents; tokens and logits live one text at a time, so long texts need no room in a batch."""
    docs = spread(table(spark, sf_dir, "documents").where(F.length("text") > 0).select("doc_id", "text"))
    return model.detect_model(docs, _word_runner, "doc_id", scheme=scheme, names=names)


def model_bio_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of a begin-inside classifier decoded from its logits."""
    return _model_spans(spark, sf_dir, "bio", _LABELS)


def model_bioes_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with begin-inside-end-single labels."""
    return _model_spans(spark, sf_dir, "bioes", ["O", "B-private_person", "E-private_person", "S-private_email", "I-private_person"])


# ------------------------------------------------------------------ streams

_DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, collected_at timestamp"
_MATCH_SCHEMA = "match_id string, tab_id string, task_id string, kind string, value string, start int, end int, selected boolean, detected_at timestamp, received_at timestamp"


def _streamed(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Run a stream over what is there and read its table back."""
    at = own_folder(spark, "stream")
    stream.run_to_table(rows, f"{at}/out", f"{at}/state").awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{at}/out")


def _source(spark: SparkSession, sf_dir: str, name: str, schema: str) -> DataFrame:
    """A table as a stream: its files are picked up as they are listed."""
    table(spark, sf_dir, name)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/{name}.parquet*")


def stream_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of all rules found on a stream of documents."""
    rows = stream.detected(_source(spark, sf_dir, "documents", _DOC_SCHEMA), "doc_id", "text")
    return _streamed(spark, rows.select("doc_id", "kind", "value", "start"))


def stream_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of a stream without repeated deliveries, counted per kind."""
    rows = stream.distinct_deliveries(_source(spark, sf_dir, "redact_matches", _MATCH_SCHEMA), "match_id", "received_at", "400 days")
    return _streamed(spark, rows.select("match_id", "kind")).groupBy("kind").agg(F.count("*").alias("n"))


def sql_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of all rules through the table function in SQL, counted per kind."""
    register(spark)
    table(spark, sf_dir, "documents").createOrReplaceTempView("_veilspan_documents")
    return spark.sql("SELECT kind, count(*) AS n, sum(s.start) AS starts FROM _veilspan_documents, LATERAL pii_spans(text) s GROUP BY kind")


def _sql_spans() -> str:
    ctes, select = _all_rules_sql("documents")
    return f"WITH {ctes} SELECT kind, count(*) AS n, sum(start)::BIGINT AS starts FROM ({select}) GROUP BY kind"


def _stream_sql() -> str:
    ctes, select = _all_rules_sql("documents")
    return f"WITH {ctes} SELECT doc_id, kind, value, start FROM ({select})"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"load_tabs_open": _load(False), "load_tabs_closed": _load(True), "pane_input": _panes("input"), "pane_output": _panes("output")}
ORACLES: dict[str, str] = {"load_tabs_open": _load_sql(0), "load_tabs_closed": _load_sql(1)}
for _query, _sql in (
    (tab_names, _NAMES_SQL),
    (kind_labels, _LABELS_SQL),
    (result_payload, _PAYLOAD_SQL),
    (load_rules, _RULES_SQL),
    (duplicate_rules, _DUP_SQL),
    (latest_results, f"WITH {_RES_SQL} SELECT id, status, queued_at, match_count FROM res"),
    (history_top, _HISTORY_SQL),
    (history_page, _PAGE_SQL),
    (task_durations, _DURATION_SQL),
    (active_tasks, _ACTIVE_SQL),
    (active_count, _ACTIVE_COUNT_SQL),
    (history_summary, _HSUM_SQL),
    (task_documents, _TASKDOC_SQL),
    (size_labels, _SIZE_SQL),
    (persist_upsert, _UPSERT_SQL),
    (persist_prune, _PRUNE_SQL),
    (persist_delete, _DELETE_SQL),
    (pdf_page_ranges, _RANGES_SQL),
    (pdf_span_ranges, _DRIFT_SQL),
    (pdf_line_boxes, _LINES_SQL),
    (pdf_page_plan, _PLAN_SQL),
    (documents_cleared, _CLEARED_SQL),
    (entity_ids, _ENTITY_SQL),
    (import_counts, _IMPORT_SQL),
    (page_overlays, _OVERLAY_SQL),
    (chunk_merge, _CHUNK_SQL),
    (content_hashes, _HASH_SQL),
    (model_bio_spans, None),
    (model_bioes_spans, None),
    (sql_spans, _sql_spans()),
    (stream_detect, _stream_sql()),
    (stream_distinct, "SELECT kind, count(*) AS n FROM (SELECT match_id, any_value(kind) AS kind FROM redact_matches GROUP BY match_id) GROUP BY kind"),
):
    QUERIES[_query.__name__] = _query
    if _sql:
        ORACLES[_query.__name__] = _sql
