"""Summaries over spans and tasks: counts per kind, groups, task history, previews, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspan.catalog import BLANKS
from veilspan.functions.let import let
from veilspan.functions.scalar import word_count

PREVIEW = 120


def category_counts(spans: DataFrame, kind: str, *by: str) -> DataFrame:
    """(by.., kind, count): a partial aggregate per task, then one shuffle of the few groups."""
    return spans.groupBy(*by, kind).agg(F.count("*").alias("count"))


def category_summary(spans: Column) -> Column:
    """array<struct<kind, count>> of a document's spans, most frequent first, then by kind."""
    def count(kinds: Column) -> Column:
        counted = F.transform(F.array_distinct(kinds), lambda k: F.struct((-F.size(F.filter(kinds, lambda x: x.eqNullSafe(k)))).alias("n"), k.alias("kind")))
        return F.transform(F.sort_array(counted), lambda c: F.struct(c["kind"].alias("kind"), (-c["n"]).cast("long").alias("count")))

    return let(F.transform(spans, lambda s: s["kind"]), count)


def category_groups(spans: Column) -> Column:
    """array<struct<category, matches, word_count>> in the order in which kinds first appear."""

    def groups(all_spans: Column) -> Column:
        return F.transform(
            F.array_distinct(F.transform(all_spans, lambda s: s["kind"])),
            lambda k: F.struct(
                k.alias("category"),
                F.size(F.filter(all_spans, lambda s: s["kind"].eqNullSafe(k))).alias("matches"),
                F.aggregate(F.filter(all_spans, lambda s: s["kind"].eqNullSafe(k)), F.lit(0), lambda a, s: a + word_count(s["value"])).alias("word_count"),
            ),
        )

    return let(spans, groups)


def summary_text(spans: Column, selection: Column) -> Column:
    """One paragraph per span: kind and value, whether it is included, and its range."""
    line = lambda d: F.array_join(
        F.transform(
            spans,
            lambda s: F.concat(
                s["kind"], F.lit(": "), s["value"], F.lit("\nStatus: "),
                F.when(F.coalesce(F.try_element_at(d, s["match_id"]), F.lit(True)), "included").otherwise("excluded"),
                F.lit("\nRange: "), s["start"].cast("string"), F.lit("-"), s["end"].cast("string"),
            ),
        ),
        "\n\n",
    )
    return let(selection, line)


def preview(text: Column) -> Column:
    """Blanks collapsed and trimmed; over 120 characters cut to 119 and an ellipsis of dots."""
    flat = F.trim(F.regexp_replace(text, f"[{BLANKS}]+", " "))
    return let(flat, lambda t: F.when(F.length(t) > PREVIEW, F.concat(F.substring(t, 1, PREVIEW - 1), F.lit("..."))).otherwise(t))


def duration_ms(started: Column, completed: Column) -> Column:
    return F.when(started.isNotNull() & completed.isNotNull(), F.greatest(completed - started, F.lit(0)))


def queued(docs: DataFrame, text: str, now: Column) -> DataFrame:
    """Documents with a non-blank text as queued tasks."""
    from veilspan.operators.chunk import is_blank

    return docs.where(~is_blank(F.col(text))).select("*", F.lit("queued").alias("status"), now.alias("queued_at"), F.length(text).alias("input_length"), preview(F.col(text)).alias("input_preview"))


def started(tasks: DataFrame, now: Column) -> DataFrame:
    """The oldest queued task set running, unless one runs. Two values are looked up first: is one busy, which is next."""
    state = tasks.agg(F.max(F.col("status") == "running").alias("busy"), F.min(F.when(F.col("status") == "queued", F.struct("queued_at", "id"))).alias("next")).first()
    if state.busy or state.next is None:
        return tasks
    turn = F.col("id") == F.lit(state.next.id)
    return tasks.withColumns({"status": F.when(turn, "running").otherwise(F.col("status")), "started_at": F.when(turn, now).otherwise(F.col("started_at"))})


def completed(tasks: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """Tasks with their results taken over: ``results`` has id, match_count, category_summary_json, result_path, error.

    A result with an error makes the task failed and keeps its other columns; else it is
    completed and the error cleared. Tasks without a result stay as they are.
    """
    r = results.select(F.col("id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in ("match_count", "category_summary_json", "result_path", "error")])
    met = tasks.join(r, tasks["id"] == r["_id"], "left")
    done, bad = F.col("_id").isNotNull(), F.col("_error").isNotNull()
    new = {
        "status": F.when(done & bad, "failed").when(done, "completed").otherwise(F.col("status")),
        "completed_at": F.when(done, now).otherwise(F.col("completed_at")),
        "duration_ms": F.when(done, duration_ms(F.col("started_at"), now)).otherwise(F.col("duration_ms")),
        "error": F.when(done, F.col("_error")).otherwise(F.col("error")),
        **{c: F.when(done & ~bad, F.col(f"_{c}")).otherwise(F.col(c)) for c in ("match_count", "category_summary_json", "result_path")},
    }
    return met.select(*[new.get(c, F.col(c)).alias(c) for c in tasks.columns])


def active_count(tasks: DataFrame) -> DataFrame:
    return tasks.agg(F.count_if(F.col("status").isin("queued", "running")).alias("active"))


def active_documents(docs: DataFrame, key: str, tasks: DataFrame) -> DataFrame:
    """Documents with a queued or running task."""
    busy = tasks.where(F.col("status").isin("queued", "running")).select(F.col("tab_id").alias(key))
    return docs.join(busy, key, "left_semi")


def history_page(tasks: DataFrame, order: str, tie: str, page: int, size: int) -> DataFrame:
    """One page of the history, newest first, with page, total_pages and total_items.

    Pages outside are moved to the nearest. Only the rows up to the page's end are sorted
    (a top-k per task), the totals are one count.
    """
    total = tasks.count()
    pages = max(1, -(-total // size))
    at = min(max(page, 1), pages)
    rows = tasks.orderBy(F.col(order).desc(), F.col(tie)).offset((at - 1) * size).limit(size)
    return rows.select("*", F.lit(at).alias("page"), F.lit(size).alias("page_size"), F.lit(pages).alias("total_pages"), F.lit(total).cast("long").alias("total_items"))


def latest(df: DataFrame, key: str, version: str) -> DataFrame:
    """The last written row of each key: highest version, ties by the whole row; combined on the map side."""
    rest = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(F.col(version), F.to_json(F.struct(*rest)))).alias("_r"))
    return best.select(key, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


def rolled_up(spans: DataFrame, first: str, second: str) -> DataFrame:
    """Counts by both columns, by the first, and in all; ``level`` tells them apart: an extension."""
    return spans.rollup(first, second).agg(F.count("*").alias("count"), F.grouping_id().alias("level"))


def ranked_kinds(counts: DataFrame, by: str) -> DataFrame:
    """Kinds of each group by count, then name."""
    w = Window.partitionBy(by).orderBy(F.col("count").desc(), F.col("kind"))
    return counts.withColumn("rank", F.row_number().over(w))
