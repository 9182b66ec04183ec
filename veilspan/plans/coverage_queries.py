"""Problem 2: covered periods and gaps of the spans of each tab."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.operators.intervals import coverage
from veilspan.session import current_tabs, parsed_json, table


def tab_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct usable spans (tab_id, start, end) of both stores.

    Usable: both offsets present and 0 <= start < end <= length of the current input. The
    spans of ``redact_matches`` are made distinct before the join, so a tab that was scanned
    again and again sends each of its spans once.
    """
    tabs = current_tabs(table(spark, sf_dir, "tabs"), ["input", "matches_json", "updated_at"])
    stored = tabs.select(
        F.col("id").alias("tab_id"),
        F.coalesce(F.length("input"), F.lit(0)).alias("n"),
        parsed_json(F.col("matches_json"), "array<struct<start:int,end:int>>").alias("ms"),
    )
    found = (
        table(spark, sf_dir, "redact_matches")
        .where("tab_id IS NOT NULL AND start >= 0 AND start < `end`")
        .select("tab_id", "start", "end")
        .distinct()
        .join(stored.select("tab_id", "n"), "tab_id")
        .where("`end` <= n")
        .select("tab_id", "start", "end")
    )
    own = stored.select("tab_id", "n", F.inline("ms")).where("start >= 0 AND start < `end` AND `end` <= n").select("tab_id", "start", "end")
    return found.unionByName(own)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods and gaps per tab; positions are bounded by the length of the tab's text."""
    return coverage(tab_spans(spark, sf_dir), "tab_id", "start", "end").select(
        F.col("entity").alias("tab_id"), "seg_type", F.col("seg_start").cast("int").alias("seg_start"), F.col("seg_end").cast("int").alias("seg_end")
    )


_SPANS_SQL = """
cur AS (SELECT id, any_value(input) AS input, any_value(matches_json) AS mj FROM
  (SELECT *, rank() OVER (PARTITION BY id ORDER BY updated_at DESC) AS rk FROM tabs) WHERE rk = 1 GROUP BY id),
js AS (SELECT id, coalesce(length(input), 0) AS n, unnest(from_json(mj, '[{"start":"INTEGER","end":"INTEGER"}]')) AS m FROM cur
  WHERE json_valid(mj) AND json_type(mj) = 'ARRAY'),
sp AS (SELECT r.tab_id, r.start AS s, r."end" AS e FROM redact_matches r JOIN cur c ON c.id = r.tab_id
    WHERE r.start >= 0 AND r.start < r."end" AND r."end" <= coalesce(length(c.input), 0)
  UNION SELECT id, m.start, m."end" FROM js WHERE m.start >= 0 AND m.start < m."end" AND m."end" <= n)"""

P2_SQL = f"""
WITH {_SPANS_SQL},
mx AS (SELECT tab_id, s, e, max(e) OVER (PARTITION BY tab_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM sp),
isl AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe THEN 1 ELSE 0 END) OVER (PARTITION BY tab_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM mx),
per AS (SELECT tab_id, g, min(s) AS a, max(e) AS b FROM isl GROUP BY tab_id, g)
SELECT tab_id, 'period' AS seg_type, a AS seg_start, b AS seg_end FROM per
UNION ALL
SELECT tab_id, 'gap', b, na FROM (SELECT *, lead(a) OVER (PARTITION BY tab_id ORDER BY g) AS na FROM per) WHERE na IS NOT NULL"""

QUERIES = {"p2_found": p2_found}
ORACLES = {"p2_found": P2_SQL}
