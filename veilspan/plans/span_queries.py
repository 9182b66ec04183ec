"""Queries of detection, validation and the span algebra over the test tables, with SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.catalog import RULES, Rule, TAXONOMY, UserRule, blanks
from veilspan.operators import chunk, detect, offsets, report, spans, validate, verify
from veilspan.sources.files import load_tabs
from veilspan.session import spread, table

#: Texts with hits of rules that the test tables lack.
FIXTURES = [
    (-1, "Write to mia.k@harbour.example or ring +1 (617) 555-0148; minutes at https://wiki.example/minutes/7 of 2031-02-11, key sk_demo_0a1b2c3d4e5f."),
    (-2, "Lines: 010-5551-0199 (mobile), 02-555-0199 (desk), +82 10-5551-0199 (abroad), 080-5551-0199 (branch), 03-5551-0199 (front)."),
    (-3, "Resident 900101-1234560, insured 123456789018, locker 123456789012."),
    (-4, "Nothing to hide in this line."),
    (-5, "paid with 4111 1111 1111 1111, refused 4111 1111 1111 1112"),
    (-6, "serial 94111111111111111 no. 9001011234560 firm 8700110005901"),
    (-7, "会員123456789018号、〒987-6543 but 987-6543"),
    (-8, "tokens ASIABBBBBBBBBBBBBBBB ghs_DDDDDDDDDDDDDDDDDDDDDDDDDDDDDDDDDDDD ghs_brief ASIA77 eyJ0eXBlIjoi.eyJuYW1lIjoi.bm9uZQ"),
    (-9, "Due 2031-12-24, 11/30/31, March 3, 2031; see www.portal.example/q?x=1#y."),
    (-10, "1234 5678 9018 7 and 6-1234-5678-9018 stay; 🌊🌊 nora@pier.example, Ольга oleg7@pier.example"),
    (-11, ""),
    (-12, "a [bracket and xABc, then abC]"),
]

_Q = "'"


def quoted(text: str) -> str:
    return _Q + text.replace(_Q, _Q * 2) + _Q


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.unionByName(spark.createDataFrame(FIXTURES, "doc_id long, text string"))


_DOCS_SQL = "docs AS (SELECT doc_id, text FROM documents UNION ALL VALUES " + ", ".join(f"({i}, {quoted(t)})" for i, t in FIXTURES) + ")"


def hits_sql(source: str, key: str, pattern: str, name: str, text: str = "text") -> str:
    """CTEs ``name``(key, text, value, start, ordinal): non-overlapping hits with code point starts."""
    p = quoted(pattern)
    return f"""{name}_r AS (SELECT {key}, {text} AS text, regexp_extract_all({text}, {p}) AS v, string_split_regex({text}, {p}) AS g FROM {source} WHERE regexp_matches({text}, {p})),
{name}_u AS (SELECT {key}, text, v, g, unnest(range(1, len(v) + 1)) AS i FROM {name}_r),
{name} AS (SELECT {key}, text, v[i] AS value, i - 1 AS ordinal,
  (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(v[1:i - 1], lambda x: length(x))), 0))::INT AS start FROM {name}_u)"""


def _weights(d: str, weights: list[int], skip: int = 0) -> str:
    return " + ".join(f"substr({d}, {k + 1 + skip}, 1)::INT * {w}" for k, w in enumerate(weights))


def _all_equal(d: str) -> str:
    return f"length(replace({d}, substr({d}, 1, 1), '')) = 0"


_LUHN = "list_sum(list_transform(range(1, length({d}) + 1), lambda k: CASE WHEN k % 2 = 1 THEN substr({d}, length({d}) + 1 - k, 1)::INT ELSE (2 * substr({d}, length({d}) + 1 - k, 1)::INT) // 10 + (2 * substr({d}, length({d}) + 1 - k, 1)::INT) % 10 END)) % 10 = 0"


def check_sql(validator: str | None, value: str = "value") -> str:
    d = f"regexp_replace({value}, '[ -]', '', 'g')"
    if validator == "luhn":
        return f"(regexp_full_match({d}, '[0-9]{{13,19}}') AND NOT {_all_equal(d)} AND {_LUHN.format(d=d)})"
    if validator == "kr_registration":
        return f"({kr_sql(value)} <> 'invalid')"
    if validator == "jp_my_number":
        s = f"(({_weights(d, [6, 5, 4, 3, 2, 7, 6, 5, 4, 3, 2])}) % 11)"
        return f"(CASE WHEN regexp_full_match({d}, '[0-9]{{12}}') THEN NOT {_all_equal(d)} AND substr({d}, 12, 1)::INT = CASE WHEN {s} <= 1 THEN 0 ELSE 11 - {s} END ELSE false END)"
    if validator == "jp_corporate":
        s = f"(({_weights(d, [2, 1] * 6, 1)}) % 9)"
        return f"(CASE WHEN regexp_full_match({d}, '[1-9][0-9]{{12}}') THEN NOT {_all_equal(d)} AND substr({d}, 1, 1)::INT = 9 - {s} ELSE false END)"
    return "true"


def kr_sql(value: str) -> str:
    d = f"replace({value}, '-', '')"
    year = f"(CASE WHEN substr({d}, 7, 1) IN ('1', '2', '5', '6') THEN '19' ELSE '20' END || substr({d}, 1, 2))"
    total = f"({_weights(d, [2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5])})"
    base = f"(CASE WHEN substr({d}, 7, 1)::INT <= 4 THEN 11 ELSE 13 END)"
    return f"""(CASE WHEN NOT regexp_full_match({d}, '[0-9]{{6}}[1-8][0-9]{{6}}') THEN 'invalid'
  WHEN try_cast({year} || '-' || substr({d}, 3, 2) || '-' || substr({d}, 5, 2) AS DATE) IS NULL THEN 'invalid'
  WHEN ({base} - {total} % 11) % 10 = substr({d}, 13, 1)::INT THEN 'legacy-checksum' ELSE 'possible-modern' END)"""


def rule_sql(rule: Rule, source: str = "docs", key: str = "doc_id", name: str = "h") -> tuple[str, str]:
    """(CTEs, select) of a rule's validated spans."""
    guard = check_sql(rule.validator)
    if rule.validator:
        guard += " AND NOT (start > 0 AND regexp_matches(substr(text, start, 1), '[0-9]')) AND NOT regexp_matches(substr(text, start + length(value) + 1, 1), '[0-9]')"
    if (rule.validator or "").startswith("jp_"):
        guard += " AND NOT (start > 1 AND regexp_matches(substr(text, start - 1, 2), '^[0-9][ -]$')) AND NOT regexp_matches(substr(text, start + length(value) + 1, 2), '^[ -][0-9]')"
    select = f"SELECT {key}, '{rule.prefix}-' || start || '-' || ordinal AS match_id, '{rule.kind}' AS kind, value, start, (start + length(value))::INT AS \"end\" FROM {name} WHERE {guard}"
    return hits_sql(source, key, rule.re2, name), select


def _rows(df: DataFrame, key: str, column: str = "matches") -> DataFrame:
    return df.select(key, F.inline(column))


def _rule_query(rule: Rule) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = _documents(spark, sf_dir)
        return _rows(docs.withColumn("matches", detect.rule_spans(F.col("text"), rule)), "doc_id")

    query.__doc__ = f"Validated spans of the rule {rule.prefix}."
    return query


def detect_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of all built-in rules."""
    return _rows(detect.detect(_documents(spark, sf_dir), [detect.built_in()]), "doc_id")


def _all_rules_sql(source: str = "docs", key: str = "doc_id") -> tuple[str, str]:
    parts = [rule_sql(r, source, key, f"h{i}") for i, r in enumerate(RULES)]
    return ",\n".join(c for c, _ in parts), " UNION ALL ".join(s for _, s in parts)


_ALL_CTES, _ALL_SELECT = _all_rules_sql()


def detect_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits per rule before any check."""
    hits = detect.raw_hits(_documents(spark, sf_dir), "doc_id")
    return hits.groupBy("rule").agg(F.count("*").alias("hits"), F.sum("start").alias("starts"))


_RAW_SQL = (
    "WITH " + _DOCS_SQL + ",\n" + _ALL_CTES + "\n"
    + " UNION ALL ".join(f"SELECT '{r.prefix}' AS rule, count(*) AS hits, sum(start)::BIGINT AS starts FROM h{i} HAVING count(*) > 0" for i, r in enumerate(RULES))
)


# ------------------------------------------------------------------ validators

NUMBERS = [
    "4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1111", "378282246310005", "4000000000000000006", "4111111111111112",
    "0000000000000000", "1111111111111", "411111111111", "41111111111111111111", "900101-1234560", "000229-3234563", "990229-1234567",
    "000230-3123456", "900101-9234567", "900231-1234567", "000229-1234568", "901301-1234567", "123456789018", "123456789019",
    "000000000000", "8700110005901", "1700110005901", "",
]


def _numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "redact_matches").where(F.col("value").rlike("^[0-9 -]{11,24}$")).select("value").distinct()
    return found.unionByName(spark.createDataFrame([(n,) for n in NUMBERS], "value string")).distinct()


_NUMBERS_SQL = (
    "n AS (SELECT DISTINCT value FROM (SELECT value FROM redact_matches WHERE regexp_full_match(value, '[0-9 -]{11,24}') UNION ALL VALUES "
    + ", ".join(f"({quoted(n)})" for n in NUMBERS) + "))"
)


def validate_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every check on every number-like value."""
    v = F.col("value")
    return _numbers(spark, sf_dir).select(
        "value",
        validate.card_valid(v).alias("card"),
        validate.kr_class(v).alias("kr"),
        validate.jp_my_number_valid(v).alias("my_number"),
        validate.jp_corporate_valid(v).alias("corporate"),
    )


_VALIDATE_SQL = f"WITH {_NUMBERS_SQL} SELECT value, {check_sql('luhn')} AS card, {kr_sql('value')} AS kr, {check_sql('jp_my_number')} AS my_number, {check_sql('jp_corporate')} AS corporate FROM n"

# ------------------------------------------------------------------ tabs and their stored spans

_TABS_SQL = """
cur AS (SELECT id, any_value(input) AS input, any_value(matches_json) AS mj, any_value(selection_json) AS sj, any_value(index_format) AS fmt, any_value(pdf_document_json) AS pj,
    any_value(document_kind) AS dk, any_value(output) AS output, any_value(is_closed) AS is_closed, any_value(title) AS title, any_value(sort_order) AS sort_order, any_value(updated_at) AS updated_at, any_value(mode) AS mode
  FROM (SELECT *, rank() OVER (PARTITION BY id ORDER BY updated_at DESC) AS rk FROM tabs) WHERE rk = 1 GROUP BY id),
ms AS (SELECT id, unnest(from_json(mj, '[{"id":"VARCHAR","kind":"VARCHAR","value":"VARCHAR","start":"INTEGER","end":"INTEGER"}]')) AS m FROM cur WHERE json_valid(mj) AND json_type(mj) = 'ARRAY'),
sp AS (SELECT ms.id, m.id AS match_id, m.kind AS kind, m.value AS value, m.start AS start, m."end" AS "end" FROM ms JOIN cur USING (id) WHERE m.start >= 0 AND m."end" > m.start AND m."end" <= length(coalesce(input, ''))),
sl AS (SELECT id, unnest(map_entries(from_json(sj, '"MAP(VARCHAR,BOOLEAN)"'))) AS e FROM cur WHERE json_valid(sj) AND json_type(sj) = 'OBJECT'),
dec AS (SELECT id, e.key AS match_id, e.value AS keep FROM sl),
chosen AS (SELECT sp.*, row_number() OVER (PARTITION BY sp.id ORDER BY start, "end" DESC, match_id) AS idx FROM sp LEFT JOIN dec USING (id, match_id) WHERE coalesce(keep, true))"""


def _tabs(spark: SparkSession, sf_dir: str, *further: str) -> DataFrame:
    """Inputs with their usable stored spans, and what else is asked for."""
    tabs = load_tabs(table(spark, sf_dir, "tabs"), columns=["input", "matches", *further])
    return tabs.withColumn("matches", spans.usable(F.col("matches"), F.col("input")))


def span_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored spans of each tab with their place in total order."""
    rows = _tabs(spark, sf_dir).select("id", F.posexplode(spans.ordered(F.col("matches"))).alias("at", "m"))
    return rows.select("id", (F.col("at") + 1).alias("place"), "m.match_id", "m.start", "m.end")


_ORDER_SQL = f'WITH {_TABS_SQL} SELECT id, row_number() OVER (PARTITION BY id ORDER BY start, "end" DESC, match_id) AS place, match_id, start, "end" FROM sp'


def span_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule spans and stored spans of each tab united: how many, and how many places."""
    tabs = _tabs(spark, sf_dir)
    both = tabs.select("id", spans.merged(detect.built_in()(F.col("input")), F.col("matches")).alias("all"))
    return both.where(F.size("all") > 0).select("id", F.size("all").alias("n"), F.size(F.array_distinct(F.transform("all", lambda s: F.struct(s["start"], s["end"])))).alias("places"))


_INPUT_CTES, _INPUT_SELECT = _all_rules_sql("(SELECT id, input AS text FROM cur)", "id")
_MERGE_SQL = f'WITH {_TABS_SQL}, {_INPUT_CTES}, b AS (SELECT id, start, "end" FROM sp UNION ALL SELECT id, start, "end" FROM ({_INPUT_SELECT})) SELECT id, count(*) AS n, count(DISTINCT start::BIGINT * 100000000 + "end") AS places FROM b GROUP BY id'


def span_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected spans with their index among the selected."""
    rows = _tabs(spark, sf_dir, "selection").select("id", F.posexplode(spans.selected(F.col("matches"), F.col("selection"))).alias("at", "m"))
    return rows.select("id", "m.match_id", (F.col("at") + 1).alias("idx"))


_SELECTION_SQL = f"WITH {_TABS_SQL} SELECT id, match_id, idx FROM chosen"


def selection_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision of every stored span, after the first one's was turned over."""
    tabs = _tabs(spark, sf_dir, "selection").where(F.size("matches") > 0)
    full = tabs.select("id", F.element_at(spans.ordered(F.col("matches")), 1)["match_id"].alias("first"), spans.full_selection(F.col("matches"), F.col("selection")).alias("s"))
    return full.select("id", F.explode(spans.toggled(F.col("s"), F.col("first"))).alias("match_id", "keep"))


_SELECTION_MAP_SQL = f"""WITH {_TABS_SQL}, one AS (SELECT id, match_id FROM (SELECT id, match_id, row_number() OVER (PARTITION BY id ORDER BY start, "end" DESC, match_id) AS k FROM sp) WHERE k = 1)
SELECT DISTINCT sp.id, sp.match_id, CASE WHEN one.match_id IS NULL THEN coalesce(keep, true) ELSE NOT coalesce(keep, true) END AS keep FROM sp LEFT JOIN dec USING (id, match_id) LEFT JOIN one USING (id, match_id)"""


def _label_sql(kind: str, idx: str, fmt: str) -> str:
    code = f"(CASE WHEN ({idx}::HUGEINT * 2654435761) % 4294967296 >= 2176782336 THEN substr(lower(to_base((({idx}::HUGEINT * 2654435761) % 4294967296)::BIGINT, 36)), 1, 6) ELSE lpad(lower(to_base((({idx}::HUGEINT * 2654435761) % 4294967296)::BIGINT, 36)), 6, '0') END)"
    return f"('[' || upper({kind}) || CASE {fmt} WHEN 'number' THEN ':' || {idx} WHEN 'id' THEN ':' || {code} ELSE '' END || ']')"


def _redact_query(fmt: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        tabs = _tabs(spark, sf_dir, "selection").where(F.size("matches") > 0)
        return tabs.select("id", spans.redacted(F.col("input"), spans.selected(F.col("matches"), F.col("selection")), F.lit(fmt)).alias("redacted"))

    query.__doc__ = f"Inputs of tabs with placeholders for their selected spans, format {fmt}."
    return query


def _fold_sql(fmt: str) -> str:
    """The greedy choice as a list fold, then the text put together."""
    return f"""WITH {_TABS_SQL},
l AS (SELECT id, list({{'s': start, 'e': "end", 't': {_label_sql('kind', 'idx', quoted(fmt))}, 'c': 0, 'o': ''}} ORDER BY idx) AS xs FROM chosen WHERE kind IS NOT NULL GROUP BY id),
f AS (SELECT cur.id, input, list_reduce(xs, lambda a, m: CASE WHEN m.s >= a.c THEN {{'s': m.s, 'e': m.e, 't': m.t, 'c': m.e, 'o': a.o || substr(cur.input, a.c + 1, m.s - a.c) || m.t}} ELSE {{'s': a.s, 'e': a.e, 't': a.t, 'c': a.c, 'o': a.o}} END, {{'s': 0, 'e': 0, 't': '', 'c': 0, 'o': ''}}) AS r FROM l JOIN cur USING (id))
SELECT id, r.o || substr(input, r.c + 1) AS redacted FROM f
UNION ALL SELECT id, input FROM cur WHERE id IN (SELECT id FROM sp) AND id NOT IN (SELECT id FROM l)"""


def redacted_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain and replaced segments of each tab, counted and measured."""
    tabs = _tabs(spark, sf_dir, "selection").where(F.size("matches") > 0)
    chosen = spans.selected(F.col("matches"), F.col("selection"))
    seg = spans.segments(F.col("input"), spans.resolved(spans.tokens(chosen, F.lit("number"))))
    return tabs.select("id", seg.alias("seg")).select(
        "id", F.size("seg").alias("segments"), F.size(F.filter("seg", lambda s: s["match_id"].isNotNull())).alias("replaced"), F.length(spans.joined(F.col("seg"))).alias("chars")
    )


_COUNT_SQL = f"""WITH {_TABS_SQL},
l AS (SELECT id, list({{'s': start, 'e': "end", 't': {_label_sql('kind', 'idx', "'number'")}, 'c': 0, 'n': 0, 'k': 0, 'z': 0::BIGINT}} ORDER BY idx) AS xs FROM chosen WHERE kind IS NOT NULL GROUP BY id),
f AS (SELECT cur.id, length(input) AS m, list_reduce(xs, lambda a, x: CASE WHEN x.s >= a.c THEN {{'s': x.s, 'e': x.e, 't': x.t, 'c': x.e, 'n': a.n + 1 + (x.s > a.c)::INT, 'k': a.k + 1, 'z': a.z + x.s - a.c + length(x.t)}}
  ELSE {{'s': a.s, 'e': a.e, 't': a.t, 'c': a.c, 'n': a.n, 'k': a.k, 'z': a.z}} END, {{'s': 0, 'e': 0, 't': '', 'c': 0, 'n': 0, 'k': 0, 'z': 0::BIGINT}}) AS r FROM l JOIN cur USING (id))
SELECT id, r.n + (m > r.c)::INT AS segments, r.k AS replaced, r.z + m - r.c AS chars FROM f
UNION ALL SELECT id, (length(input) > 0)::INT, 0, length(input) FROM cur WHERE id IN (SELECT id FROM sp) AND id NOT IN (SELECT id FROM l)"""


def restore_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redacted by number and restored again: whether the input comes back, for tabs whose spans hold their values."""
    tabs = _tabs(spark, sf_dir, "selection")
    rows = tabs.select("id", "input", spans.truthful(spans.selected(F.col("matches"), F.col("selection")), F.col("input")).alias("m")).where(F.size("m") > 0)
    rows = rows.withColumn("red", spans.redacted(F.col("input"), F.col("m"), F.lit("number")))
    return rows.select("id", (spans.restored(F.col("red"), F.col("m"), F.lit("number")) == F.col("input")).alias("same"), F.length("red").alias("redacted_chars"))


_ROUNDTRIP_SQL = f"""WITH {_TABS_SQL},
t AS (SELECT c.id, c.value, c.start, c."end", row_number() OVER (PARTITION BY c.id ORDER BY c.start, c."end" DESC, c.match_id) AS i, c.kind FROM chosen c JOIN cur USING (id) WHERE substr(input, c.start + 1, c."end" - c.start) = c.value),
k AS (SELECT *, '[' || upper(kind) || ':' || i || ']' AS tok FROM t),
l AS (SELECT id, list({{'s': start, 'e': "end", 't': tok, 'c': 0, 'o': ''}} ORDER BY i) AS xs FROM k GROUP BY id),
f AS (SELECT cur.id, input, list_reduce(xs, lambda a, m: CASE WHEN m.s >= a.c THEN {{'s': m.s, 'e': m.e, 't': m.t, 'c': m.e, 'o': a.o || substr(cur.input, a.c + 1, m.s - a.c) || m.t}} ELSE {{'s': a.s, 'e': a.e, 't': a.t, 'c': a.c, 'o': a.o}} END, {{'s': 0, 'e': 0, 't': '', 'c': 0, 'o': ''}}) AS r FROM l JOIN cur USING (id)),
red AS (SELECT id, input, r.o || substr(input, r.c + 1) AS x FROM f),
back AS (SELECT red.id, list({{'s': strpos(x, tok) - 1, 'e': strpos(x, tok) - 1 + length(tok), 't': value, 'c': 0, 'o': ''}} ORDER BY strpos(x, tok)) AS ys FROM red JOIN k USING (id) WHERE contains(x, tok) GROUP BY red.id),
g AS (SELECT red.id, input, x, list_reduce(ys, lambda a, m: CASE WHEN m.s >= a.c THEN {{'s': m.s, 'e': m.e, 't': m.t, 'c': m.e, 'o': a.o || substr(red.x, a.c + 1, m.s - a.c) || m.t}} ELSE {{'s': a.s, 'e': a.e, 't': a.t, 'c': a.c, 'o': a.o}} END, {{'s': 0, 'e': 0, 't': '', 'c': 0, 'o': ''}}) AS r FROM red JOIN back USING (id))
SELECT id, (r.o || substr(x, r.c + 1)) = input AS same, length(x) AS redacted_chars FROM g"""


def input_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches between span bounds with the number of covering spans."""
    seg = spans.input_segments(_tabs(spark, sf_dir).select("id", "input", "matches"), "id", "input", "matches")
    return seg.select("id", "seg_no", "start", "end", F.size("match_ids").alias("covering"))


_SEGMENTS_SQL = f"""WITH {_TABS_SQL},
b AS (SELECT id, 0 AS p FROM cur WHERE length(input) > 0 UNION SELECT id, length(input) FROM cur WHERE length(input) > 0 UNION SELECT id, start FROM sp UNION SELECT id, "end" FROM sp),
e AS (SELECT id, p AS start, lead(p) OVER (PARTITION BY id ORDER BY p) AS stop FROM b),
c AS (SELECT e.id, e.start, e.stop, count(sp.id) AS covering FROM e LEFT JOIN sp ON sp.id = e.id AND sp.start <= e.start AND sp."end" >= e.stop WHERE stop IS NOT NULL GROUP BY ALL)
SELECT id, row_number() OVER (PARTITION BY id ORDER BY start) AS seg_no, start, stop AS "end", covering FROM c"""


def retain_outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored spans that stay when the first 500 characters of each tab are scanned again."""
    kept = _tabs(spark, sf_dir).select("id", F.inline(spans.outside(F.col("matches"), F.lit(0), F.lit(500))))
    return kept.select("id", "match_id", "start", "end")


_RETAIN_SQL = f'WITH {_TABS_SQL} SELECT id, match_id, start, "end" FROM sp WHERE NOT (start < 500 AND "end" > 0)'


def chunk_rebase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of all rules found chunk by chunk (80 tokens), at their places in the whole text."""
    tabs = load_tabs(table(spark, sf_dir, "tabs"), columns=["input"])
    rows = chunk.chunk_rows(tabs, "id", "input", 80)
    found = rows.select("id", F.inline(spans.rebased(detect.built_in()(F.col("chunk_text")), F.col("start"))))
    return found.select("id", "kind", "value", "start", "end")


def _chunk_sql(source: str, key: str, text: str, limit: int) -> str:
    token = quoted("(" + blanks(r"\S+\s*") + ")")
    return f"""tk AS (SELECT {key}, {text} AS text, regexp_extract_all({text}, {token}) AS t FROM {source} WHERE regexp_matches({text}, {quoted(blanks(chr(92) + 'S'))})),
tg AS (SELECT {key}, text, list_transform(t, lambda x: length(x)) AS n, len(t) AS k, unnest(range(0, ((len(t) + {limit - 1}) // {limit})::BIGINT)) AS g FROM tk),
ck AS (SELECT {key}, text, (CASE WHEN g = 0 THEN 0 ELSE length(text) - list_sum(n) + list_sum(n[1:g * {limit}]) END)::INT AS start,
  (length(text) - list_sum(n) + list_sum(n[1:(g + 1) * {limit}]))::INT AS "end", g::INT AS chunk_index, ((k + {limit - 1}) // {limit})::INT AS chunk_total FROM tg)"""


_REBASE_CTES, _REBASE_SELECT = _all_rules_sql('(SELECT id, start AS st, substr(text, start + 1, "end" - start) AS text FROM ck)', "id, st")
_REBASE_SQL = f'WITH {_TABS_SQL}, {_chunk_sql("cur", "id", "input", 80)}, {_REBASE_CTES} SELECT id, kind, value, (st + start)::INT AS start, (st + "end")::INT AS "end" FROM ({_REBASE_SELECT})'


def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of at most 1,000 tokens of every document."""
    return chunk.chunk_rows(_documents(spark, sf_dir), "doc_id", "text").drop("chunk_text")


def chunk_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with at most 20 tokens."""
    return chunk.chunk_rows(_documents(spark, sf_dir), "doc_id", "text", 20).drop("chunk_text")


def _chunk_query_sql(limit: int) -> str:
    return f'WITH {_DOCS_SQL}, {_chunk_sql("docs", "doc_id", "text", limit)} SELECT doc_id, start, "end", chunk_index, chunk_total FROM ck'


def span_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UTF-8 and UTF-16 offsets of stored spans, and back from bytes."""
    rows = _tabs(spark, sf_dir).select("id", "input", F.inline("matches"))
    t, a, b = F.col("input"), F.col("start"), F.col("end")
    return rows.select(
        "id", "match_id", "start", "end",
        offsets.utf8_offset(t, a).alias("start_byte"), offsets.utf8_offset(t, b).alias("end_byte"),
        offsets.utf16_offset(t, a).alias("start_utf16"), offsets.utf16_offset(t, b).alias("end_utf16"),
        offsets.utf8_to_code_points(t, offsets.utf8_offset(t, b)).alias("back"), offsets.utf8_to_utf16(t, offsets.utf8_offset(t, b)).alias("back_utf16"),
    )


_ASTRAL = "length(regexp_replace({x}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g'))"
_U16 = lambda x: f"(length({x}) + {_ASTRAL.format(x=x)})"
_OFFSETS_SQL = f"""WITH {_TABS_SQL} SELECT id, match_id, start, "end", strlen(substr(input, 1, start)) AS start_byte, strlen(substr(input, 1, "end")) AS end_byte,
{_U16('substr(input, 1, start)')} AS start_utf16, {_U16('substr(input, 1, "end")')} AS end_utf16, "end" AS back, {_U16('substr(input, 1, "end")')} AS back_utf16 FROM sp JOIN cur USING (id)"""

# ------------------------------------------------------------------ user rules

USER_RULES = [
    UserRule("r1", "Project", "exact", "Paper Lantern"),
    UserRule("r2", " Ticket", "regex", r"\bno\. \d{4}-\d{4}"),
    UserRule("r3", "", "regex", r"#\d{6}"),
    UserRule("r4", "CaseNo", "regex", "[BK("),
    UserRule("r5", "CaseNo", "exact", ""),
    UserRule("r6", "Lower", "regex", r"the [a-z]+ (?:letter|notice)"),
    UserRule("r7", "Case", "exact", "the travel claim"),
    UserRule("r8", "Open", "regex", "[[]"),
    UserRule("r9", "Named", "regex", "(?<n>ab)c"),
    UserRule("r10", "Greedy", "regex", "a++"),
    UserRule("r11", "Atomic", "regex", "(?>the)"),
]
#: Rules whose pattern is not valid in the dialect.
_BAD_RULES = ("r4", "r10", "r11")


def user_rule_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of user rules of every sort: literals, patterns that other dialects refuse, invalid and empty ones."""
    return _rows(detect.detect(_documents(spark, sf_dir), [detect.user_rules(USER_RULES)]), "doc_id")


def _user_sql() -> str:
    ctes, selects = [], []
    for i, r in enumerate(USER_RULES):
        if r.pattern and r.id not in _BAD_RULES:
            p = ("(?i)" + blanks(r.pattern).replace("(?<n>", "(?P<n>")) if r.mode == "regex" else detect.literal(r.pattern)
            ctes.append(hits_sql("docs", "doc_id", p, f"u{i}"))
            selects.append(f"SELECT doc_id, 'custom-{r.id}-' || start || '-' || ordinal AS match_id, {quoted(r.kind)} AS kind, value, start, (start + length(value))::INT AS \"end\" FROM u{i}")
    return f"WITH {_DOCS_SQL}, " + ", ".join(ctes) + " " + " UNION ALL ".join(selects)


def stored_rule_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of the stored rule list, counted per rule."""
    from veilspan.sources.files import load_rules

    rules = load_rules(table(spark, sf_dir, "custom_rules"))
    found = detect.detect(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), [detect.user_rules(rules)])
    rows = found.select(F.inline("matches"))
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.sum("start").alias("starts"))


_STORED_SQL = """WITH r AS (SELECT id, CASE WHEN trim(name) = '' THEN 'Custom' ELSE trim(name) END AS kind,
  CASE WHEN mode = 'regex' THEN '(?i)' || pattern ELSE regexp_escape(pattern) END AS p FROM custom_rules WHERE length(pattern) > 0 AND NOT (mode = 'regex' AND pattern LIKE '[__('))
, h AS (SELECT kind, regexp_extract_all(text, p) AS v, string_split_regex(text, p) AS g FROM documents, r WHERE regexp_matches(text, p)),
u AS (SELECT kind, v, g, unnest(range(1, len(v) + 1)) AS i FROM h)
SELECT kind, count(*) AS n, sum(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(v[1:i - 1], lambda x: length(x))), 0))::BIGINT AS starts FROM u GROUP BY kind"""

# ------------------------------------------------------------------ reports

def category_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule spans per source and kind."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    rows = detect.detect(docs, [detect.built_in()]).select("source", F.inline("matches"))
    return report.category_counts(rows, "kind", "source")


_SOURCE_CTES, _SOURCE_SELECT = _all_rules_sql("documents", "source")
_BY_SOURCE_SQL = f"WITH {_SOURCE_CTES}, a AS ({_SOURCE_SELECT}) SELECT source, kind, count(*) AS count FROM a GROUP BY source, kind"


def category_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored spans rolled up by document kind and kind."""
    rows = _tabs(spark, sf_dir, "document_kind").select("document_kind", F.inline("matches"))
    return report.rolled_up(rows, "document_kind", "kind")


_ROLLUP_SQL = f"""WITH {_TABS_SQL}, x AS (SELECT CASE WHEN dk IN ('markdown', 'pdf') THEN dk ELSE 'text' END AS document_kind, kind FROM sp JOIN cur USING (id))
SELECT document_kind, kind, count(*) AS count, grouping(document_kind, kind) AS level FROM x GROUP BY ROLLUP (document_kind, kind)"""


def category_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of each tab by count, with the words of their values."""
    tabs = _tabs(spark, sf_dir)
    counts = tabs.select("id", F.posexplode(report.category_summary(F.col("matches"))).alias("at", "c"), "matches")
    words = F.aggregate(F.filter("matches", lambda s: s["kind"].eqNullSafe(F.col("c.kind"))), F.lit(0), lambda a, s: a + report.word_count(s["value"]))
    return counts.select("id", (F.col("at") + 1).alias("place"), "c.kind", "c.count", words.alias("words"))


_TRIM = "regexp_replace({x}, " + quoted(f"^{blanks(chr(92) + 's')}+|{blanks(chr(92) + 's')}+$") + ", '', 'g')"
_WC = lambda x: f"(CASE WHEN {_TRIM.replace("{x}", x)} = '' THEN 0 ELSE len(string_split_regex({_TRIM.replace("{x}", x)}, {quoted(blanks(chr(92) + 's') + '+')})) END)"
_SUMMARY_SQL = f"WITH {_TABS_SQL}, k AS (SELECT id, kind, count(*) AS count, sum({_WC('value')})::BIGINT AS words FROM sp GROUP BY id, kind) SELECT id, row_number() OVER (PARTITION BY id ORDER BY count DESC, kind) AS place, kind, count, words FROM k"


def text_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters, words, spans and preview of each tab."""
    t = _tabs(spark, sf_dir)
    return t.select("id", F.length("input").alias("chars"), report.word_count(F.col("input")).alias("words"), F.size("matches").alias("spans"), report.preview(F.col("input")).alias("preview"))


_FLAT = "trim(regexp_replace(coalesce(input, ''), " + quoted(blanks(chr(92) + "s") + "+") + ", ' ', 'g'))"
_STATS_SQL = f"""WITH {_TABS_SQL} SELECT cur.id, length(coalesce(input, '')) AS chars, {_WC("coalesce(input, '')")} AS words, coalesce(n, 0) AS spans,
CASE WHEN length({_FLAT}) > 120 THEN substr({_FLAT}, 1, 119) || '...' ELSE {_FLAT} END AS preview FROM cur LEFT JOIN (SELECT id, count(*) AS n FROM sp GROUP BY id) USING (id)"""


def summary_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of each tab: every span with its status and range."""
    t = _tabs(spark, sf_dir, "selection").where(F.size("matches") > 0)
    return t.select("id", report.summary_text(spans.ordered(F.col("matches")), F.col("selection")).alias("report"))


_REPORT_SQL = f"""WITH {_TABS_SQL} SELECT sp.id, string_agg(kind || ': ' || value || chr(10) || 'Status: ' || CASE WHEN coalesce(keep, true) THEN 'included' ELSE 'excluded' END || chr(10) || 'Range: ' || start || '-' || "end",
chr(10) || chr(10) ORDER BY start, "end" DESC, match_id) AS report FROM sp LEFT JOIN dec USING (id, match_id) GROUP BY sp.id"""


def residual_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What rules and selected values still find in the redacted outputs."""
    tabs = _tabs(spark, sf_dir, "output", "selection").where(F.length("output") > 0)
    pages = tabs.select("id", F.lit(1).alias("page"), F.col("output").alias("text"), spans.selected(F.col("matches"), F.col("selection")).alias("chosen"))
    return verify.residual_report(pages, "id", "page", "text", "chosen")


_OUT_CTES, _OUT_SELECT = _all_rules_sql("(SELECT id, output AS text FROM cur WHERE length(output) > 0)", "id")
_RESIDUAL_SQL = f"""WITH {_TABS_SQL}, {_OUT_CTES},
lv AS (SELECT DISTINCT id, kind, value FROM chosen WHERE length(value) > 0),
lg AS (SELECT id, kind, value, string_split(output, value) AS g FROM lv JOIN cur USING (id) WHERE contains(output, value)),
lu AS (SELECT id, kind, value, g, unnest(range(1, len(g))) AS i FROM lg),
ls AS (SELECT id, kind, (list_sum(list_transform(g[1:i], lambda x: length(x))) + (i - 1) * length(value))::INT AS start, length(value) AS n FROM lu),
al AS (SELECT DISTINCT id, kind, start, "end" FROM (SELECT id, kind, start, "end" FROM ({_OUT_SELECT}) UNION ALL SELECT id, kind, start, start + n FROM ls))
SELECT id, 1 AS page, CASE WHEN kind IN ({', '.join(map(quoted, TAXONOMY))}) THEN kind ELSE 'custom' END AS kind, count(*) AS count FROM al GROUP BY 1, 3"""


def residual_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verification status of every redacted output."""
    tabs = _tabs(spark, sf_dir, "output", "selection")
    pages = tabs.select("id", F.lit(1).alias("page"), F.col("output").alias("text"), spans.selected(F.col("matches"), F.col("selection")).alias("chosen"))
    return verify.document_report(pages, "id", "page", "text", "chosen").select("id", "status", "pages_with_text", "residual_count")


_STATUS_SQL = _RESIDUAL_SQL.rsplit("SELECT id, 1 AS page", 1)[0] + f"""SELECT cur.id, CASE WHEN coalesce(n, 0) > 0 THEN 'residual-matches' WHEN regexp_matches(coalesce(output, ''), {quoted(blanks(chr(92) + 'S'))}) THEN 'no-text-matches' ELSE 'no-extractable-text' END AS status,
regexp_matches(coalesce(output, ''), {quoted(blanks(chr(92) + 'S'))})::INT AS pages_with_text, coalesce(n, 0) AS residual_count FROM cur LEFT JOIN (SELECT id, count(*) AS n FROM al GROUP BY id) USING (id)"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _rule in RULES:
    _name = "detect_" + _rule.prefix.replace("-", "_")
    QUERIES[_name] = _rule_query(_rule)
    _ctes, _select = rule_sql(_rule)
    ORACLES[_name] = f"WITH {_DOCS_SQL}, {_ctes} {_select}"
for _fmt in ("none", "number", "id"):
    QUERIES[f"redact_{_fmt}"] = _redact_query(_fmt)
    ORACLES[f"redact_{_fmt}"] = _fold_sql(_fmt)
for _query, _sql in (
    (detect_all, f"WITH {_DOCS_SQL}, {_ALL_CTES} {_ALL_SELECT}"),
    (detect_raw, _RAW_SQL),
    (validate_numbers, _VALIDATE_SQL),
    (span_order, _ORDER_SQL),
    (span_merge, _MERGE_SQL),
    (span_selection, _SELECTION_SQL),
    (selection_map, _SELECTION_MAP_SQL),
    (redacted_segments, _COUNT_SQL),
    (restore_roundtrip, _ROUNDTRIP_SQL),
    (input_segments, _SEGMENTS_SQL),
    (retain_outside, _RETAIN_SQL),
    (chunk_rebase, _REBASE_SQL),
    (chunk_documents, _chunk_query_sql(1000)),
    (chunk_small, _chunk_query_sql(20)),
    (span_offsets, _OFFSETS_SQL),
    (user_rule_spans, _user_sql()),
    (stored_rule_spans, _STORED_SQL),
    (category_by_source, _BY_SOURCE_SQL),
    (category_rollup, _ROLLUP_SQL),
    (category_summary, _SUMMARY_SQL),
    (text_stats, _STATS_SQL),
    (summary_text, _REPORT_SQL),
    (residual_report, _RESIDUAL_SQL),
    (residual_status, _STATUS_SQL),
):
    QUERIES[_query.__name__] = _query
    if _sql:
        ORACLES[_query.__name__] = _sql
