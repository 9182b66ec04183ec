"""The span algebra: order, union, selection, resolution, redaction, restoring, segments.

Spans of a document stay nested in its row, so everything here is narrow. A span is
struct(match_id, kind, value, start, end). Offsets count code points. Spans that do not lie
within the text (null or crossed offsets, past the end) are left out by ``usable`` first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.functions.let import let
from veilspan.operators import scan
from veilspan.operators.detect import SPAN, empty_spans


def ordered(spans: Column) -> Column:
    """Spans by start, longest first, then id (byte order); repeated spans stay."""
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("a"), (-s["end"]).alias("b"), s["match_id"].alias("c"), s.alias("s")))
    return F.transform(F.sort_array(keyed), lambda k: k["s"])


def merged(*spans: Column) -> Column:
    """Bag union of span arrays in total order; nulls count as empty."""
    return ordered(F.concat(*[F.coalesce(s, empty_spans()) for s in spans]))


def usable(spans: Column, text: Column) -> Column:
    """Spans with 0 <= start < end <= length of the text."""
    return scan.usable(spans, F.length(text))


def truthful(spans: Column, text: Column) -> Column:
    """Spans whose value stands at their place in the text."""
    return scan.truthful(spans, text)


def rebased(spans: Column, offset: Column, prefix: Column | str = "") -> Column:
    """Spans of a chunk at their places in the whole text, with prefixed ids."""
    lead = F.lit(prefix) if isinstance(prefix, str) else prefix
    return F.transform(
        spans,
        lambda s: F.struct(F.concat(lead, s["match_id"]).alias("match_id"), s["kind"].alias("kind"), s["value"].alias("value"), (s["start"] + offset).cast("int").alias("start"), (s["end"] + offset).cast("int").alias("end")),
    )


def outside(spans: Column, start: Column, end: Column) -> Column:
    """Spans that do not overlap [start, end): what a new scan of that range keeps."""
    return F.filter(spans, lambda s: ~((s["start"] < end) & (s["end"] > start)))


def selected(spans: Column, selection: Column) -> Column:
    """Spans the review kept: decision by id, absent means kept; in total order."""
    return scan.selected(spans, selection)


def full_selection(spans: Column, previous: Column) -> Column:
    """A decision for every span: the previous one, else kept. Of repeated ids one entry stays."""
    ids = F.array_distinct(F.transform(spans, lambda s: s["match_id"]))
    return let(previous, lambda d: F.map_from_entries(F.transform(ids, lambda i: F.struct(i.alias("key"), F.coalesce(F.try_element_at(d, i), F.lit(True)).alias("value")))))


def toggled(selection: Column, match_id: Column) -> Column:
    """The selection with one decision turned over; an absent one becomes false."""
    return let(
        F.struct(selection.alias("s"), match_id.alias("m")),
        lambda x: F.map_concat(F.map_filter(x["s"], lambda k, v: k != x["m"]), F.create_map(x["m"], ~F.coalesce(F.try_element_at(x["s"], x["m"]), F.lit(True)))),
    )


def all_selected(spans: Column, value: bool) -> Column:
    """One decision for all spans."""
    ids = F.array_distinct(F.transform(spans, lambda s: s["match_id"]))
    return F.map_from_entries(F.transform(ids, lambda i: F.struct(i.alias("key"), F.lit(value).alias("value"))))


def index_id(index: Column) -> Column:
    """A six-character code of an ordinal: multiplicative hash in base 36, padded, cut to six."""
    hashed = F.pmod(index.cast("long") * F.lit(2654435761), F.lit(4294967296))
    return F.substring(F.lpad(F.lower(F.conv(hashed.cast("string"), 10, 36)), 6, "0"), 1, 6)


def label(kind: Column, index: Column, index_format: Column) -> Column:
    """[KIND], [KIND:n] or [KIND:code] by format none, number or id; unknown formats count as none."""
    return F.concat(F.lit("["), F.upper(kind), F.when(index_format == "number", F.concat(F.lit(":"), index.cast("string"))).when(index_format == "id", F.concat(F.lit(":"), index_id(index))).otherwise(""), F.lit("]"))


def tokens(spans: Column, index_format: Column) -> Column:
    """The placeholder of each selected span by its place in total order, overlapped ones included."""
    return F.transform(
        spans,
        lambda s, i: F.struct(
            label(s["kind"], i + 1, index_format).alias("token"), s["value"].alias("value"), s["match_id"].alias("match_id"), s["kind"].alias("kind"), s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end")
        ),
    )


def resolved(items: Column) -> Column:
    """Items kept from left to right: one is kept if it starts at or after the end of the last kept one."""
    return scan.resolved(items)


def segments(text: Column, kept: Column, replacement: str = "token") -> Column:
    """array<struct<text, match_id>> that makes up the result; empty plain stretches are left out."""
    return scan.segments(text, kept, replacement)


def joined(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda s: s["text"]), "")


def redacted(text: Column, spans: Column, index_format: Column) -> Column:
    """The text with placeholders for the selected spans, overlaps resolved from the left.

    As specified, a span that overlaps a kept one is skipped as a whole, also the part that
    sticks out; ``cover=True`` plans use ``merged_cover`` first.
    """
    return joined(segments(text, resolved(tokens(spans, index_format))))


def located(text: Column, spans: Column, index_format: Column) -> Column:
    """Where each selected span's placeholder stands in a redacted text, in text order.

    Repeated placeholders are taken in turn: the k-th span with a placeholder gets its k-th
    place. Placeholders that are not found are left out.
    """
    return scan.located(text, tokens(spans, index_format))


def restored_segments(text: Column, spans: Column, index_format: Column, emit: str = "value") -> Column:
    """Segments of a redacted text with the stored values ('value') or the placeholders ('token')."""
    return segments(text, resolved(located(text, spans, index_format)), emit)


def restored(text: Column, spans: Column, index_format: Column) -> Column:
    """The text with the stored values in place of placeholders; values are not searched again."""
    return joined(restored_segments(text, spans, index_format))


def input_segments(docs: DataFrame, key: str, text: str, spans: str) -> DataFrame:
    """(key, seg_no, start, end, segment, match_ids): stretches between span bounds with all spans that cover them.

    A sweep over each row's bounds keeps the open spans, so the cost grows with spans and
    output; no join and no shuffle. A text without usable spans is one stretch; an empty text
    has none.
    """
    ok = docs.where(F.length(text) > 0).select(key, F.col(text).alias("_text"), ordered(usable(F.col(spans), F.col(text))).alias("_ok"))
    swept = scan.stretches(F.length("_text"), F.transform("_ok", lambda s: s["start"]), F.transform("_ok", lambda s: s["end"]), F.transform("_ok", lambda s: s["match_id"]))
    rows = ok.select(key, "_text", F.posexplode(swept).alias("no", "p"))
    return rows.select(
        key,
        (F.col("no") + 1).alias("seg_no"),
        F.col("p.start").alias("start"),
        F.col("p.end").alias("end"),
        F.substring(F.col("_text"), F.col("p.start") + 1, F.col("p.end") - F.col("p.start")).alias("segment"),
        F.col("p.match_ids").alias("match_ids"),
    )


def merged_cover(spans: Column) -> Column:
    """Overlapping spans of a row widened into one, so that no part stays uncovered: an extension.

    The widened span keeps id and kind of its first part and has no single stored value.
    """
    state = F.aggregate(
        ordered(spans),
        F.array().cast(f"array<{SPAN}>"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (s["start"] < F.element_at(acc, -1)["end"]),
            F.concat(
                F.slice(acc, 1, F.size(acc) - 1),
                F.array(
                    F.struct(
                        F.element_at(acc, -1)["match_id"].alias("match_id"),
                        F.element_at(acc, -1)["kind"].alias("kind"),
                        F.element_at(acc, -1)["value"].alias("value"),
                        F.element_at(acc, -1)["start"].alias("start"),
                        F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"),
                    )
                ),
            ),
        ).otherwise(F.array_append(acc, s)),
    )
    return state
