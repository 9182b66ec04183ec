"""Covered periods and gaps of half-open intervals per entity, by a sweep line.

Every interval becomes a plus event at its start and a minus event at its end. Events
are summed per (entity, position) before any shuffle of more than one row per position,
a prefix sum over the positions gives the number of active intervals, and the places
where that number leaves or returns to zero bound the covered periods.

Two physical forms give the same rows:

* ``block=None``: one ordered window per entity. Right where the positions of an entity
  are bounded (offsets into a text), since the window then holds at most one event per
  position however many intervals an entity has.
* ``block=n``: positions are cut into blocks of ``n``; the prefix sum is taken over block
  totals first and inside each block afterwards, so one entity is spread over many tasks
  even when its positions are unbounded (timestamps).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def boundary_events(spans: DataFrame, entity: str, start: str, end: str) -> DataFrame:
    """(entity, pos, delta): plus and minus events summed per position; empty spans drop out.

    Rows with a null entity, a null bound or ``end <= start`` hold no interval. Positions at
    which as many intervals begin as end keep a row with ``delta = 0`` only if one of them
    begins there, which a touching pair needs not; they are removed.
    """
    good = spans.where(
        F.col(entity).isNotNull() & F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(end) > F.col(start))
    )
    events = good.select(
        F.col(entity).alias("entity"),
        F.inline(
            F.array(
                F.struct(F.col(start).cast("long").alias("pos"), F.lit(1).cast("long").alias("delta")),
                F.struct(F.col(end).cast("long").alias("pos"), F.lit(-1).cast("long").alias("delta")),
            )
        ),
    )
    return events.groupBy("entity", "pos").agg(F.sum("delta").alias("delta")).where("delta <> 0")


def _prefix(events: DataFrame, value: str, out: str, block: int | None) -> DataFrame:
    """Inclusive prefix sum of ``value`` per entity in order of ``pos``."""
    if block is None:
        w = Window.partitionBy("entity").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
        return events.withColumn(out, F.sum(value).over(w))
    cut = events.withColumn("_block", F.floor(F.col("pos") / F.lit(block)))
    before = Window.partitionBy("entity").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        cut.groupBy("entity", "_block")
        .agg(F.sum(value).alias("_total"))
        .select("entity", "_block", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))
    )
    inside = Window.partitionBy("entity", "_block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return (
        cut.withColumn("_in", F.sum(value).over(inside))
        .join(totals, ["entity", "_block"])
        .withColumn(out, F.col("_base") + F.col("_in"))
        .drop("_block", "_in", "_base")
    )


def coverage(spans: DataFrame, entity: str, start: str, end: str, block: int | None = None) -> DataFrame:
    """(entity, seg_type, seg_start, seg_end): 'period' and 'gap' rows of each entity.

    Touching, nested, repeated and overlapping intervals form one period. A gap is the
    uncovered stretch between two consecutive periods; before the first and after the last
    period there is none. Empty input gives an empty result. Column names of ``spans`` other
    than the three given never matter.
    """
    active = _prefix(boundary_events(spans, entity, start, end), "delta", "active", block)
    edges = active.select(
        "entity",
        "pos",
        (F.col("active") == F.col("delta")).cast("long").alias("opens"),
        (F.col("active") == 0).alias("closes"),
    ).where("opens = 1 OR closes")
    numbered = _prefix(edges, "opens", "period", block)
    # An opening bounds its own period from the left and the gap before it from the right.
    sides = numbered.select(
        "entity",
        F.inline(
            F.when(
                F.col("opens") == 1,
                F.array(
                    F.struct(F.lit("period").alias("seg_type"), F.col("period").alias("no"), F.col("pos").alias("a"), F.lit(None).cast("long").alias("b")),
                    F.struct(F.lit("gap").alias("seg_type"), (F.col("period") - 1).alias("no"), F.lit(None).cast("long").alias("a"), F.col("pos").alias("b")),
                ),
            ).otherwise(
                F.array(
                    F.struct(F.lit("period").alias("seg_type"), F.col("period").alias("no"), F.lit(None).cast("long").alias("a"), F.col("pos").alias("b")),
                    F.struct(F.lit("gap").alias("seg_type"), F.col("period").alias("no"), F.col("pos").alias("a"), F.lit(None).cast("long").alias("b")),
                )
            )
        ),
    )
    return (
        sides.groupBy("entity", "seg_type", "no")
        .agg(F.max("a").alias("seg_start"), F.max("b").alias("seg_end"))
        .where("seg_start IS NOT NULL AND seg_end IS NOT NULL")
        .select("entity", "seg_type", "seg_start", "seg_end")
    )
