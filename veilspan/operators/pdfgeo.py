"""Page geometry of spans: text assembly, character boxes, line boxes, page plans.

Boxes are struct(pageIndex, x, y, width, height) with y down the page; a document's boxes are
one nullable box per character of its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspan.functions.scalar import trimmed
from veilspan.operators import scan

BOX = "struct<pageIndex:int,x:double,y:double,width:double,height:double>"


def assembled_text(items: DataFrame, key: str) -> DataFrame:
    """(key, text) from rows (key, page, item_no, str): items joined by a blank where neither side has one, pages by an empty line.

    Empty items are dropped; every page from the second on starts with the empty line, also
    one without items if it has a row.
    """
    w = Window.partitionBy(key).orderBy("page", "item_no")
    rows = items.where(F.coalesce(F.length("str"), F.lit(0)) > 0)
    before = F.lag("str").over(w)
    first = F.coalesce(F.lag("page").over(w) != F.col("page"), F.lit(False))
    gap = F.when(before.isNull() | first, "").when(before.rlike(r"\s$") | F.col("str").rlike(r"^\s"), "").otherwise(" ")
    breaks = F.repeat(F.lit("\n\n"), F.coalesce(F.col("page") - F.lag("page").over(w), F.col("page") - F.lit(0)).cast("int"))
    parts = rows.select(key, "page", "item_no", F.concat(breaks, gap, F.col("str")).alias("part"))
    return parts.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "item_no", "part"))), lambda p: p["part"]), "").alias("text"))


def item_box(transform: Column, width: Column, height: Column, page: Column) -> Column:
    """struct(box, split) of a text item from its matrix (a, b, c, d, x, baseline) in page units.

    At least 1 wide and 8 high; ``split`` tells horizontal text, whose box may be shared out
    evenly to its characters.
    """
    a, b, c, d, x, base = (F.element_at(transform, k).cast("double") for k in range(1, 7))
    w, h = F.greatest(F.abs(width), F.lit(1.0)), F.greatest(F.abs(height), F.lit(8.0))
    m, n = F.hypot(a, b), F.hypot(c, d)
    wx, wy = F.when(m == 0, w).otherwise(a / m * w), F.when(m == 0, 0.0).otherwise(b / m * w)
    hx, hy = F.when(n == 0, 0.0).otherwise(c / n * h), F.when(n == 0, -h).otherwise(d / n * h)
    xs, ys = (x, x + wx, x + hx, x + wx + hx), (base, base + wy, base + hy, base + wy + hy)
    box = F.struct(
        page.cast("int").alias("pageIndex"),
        F.least(*xs).alias("x"),
        F.least(*ys).alias("y"),
        F.greatest(F.greatest(*xs) - F.least(*xs), F.lit(1.0)).alias("width"),
        F.greatest(F.greatest(*ys) - F.least(*ys), h).alias("height"),
    )
    return F.struct(box.alias("box"), ((F.abs(wy) < 0.01) & (F.abs(hx) < 0.01)).alias("split"))


def char_boxes(text: Column, box: Column, split: Column) -> Column:
    """One box per character: an even share of the item's box, or the whole box where it may not be split."""
    n = F.length(text)
    share = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(box["pageIndex"].alias("pageIndex"), (box["x"] + box["width"] / n * i).alias("x"), box["y"].alias("y"), (box["width"] / n).alias("width"), box["height"].alias("height")))
    return F.when(n == 0, F.array().cast(f"array<{BOX}>")).when(split, share).otherwise(F.array_repeat(box, n))


def drifted_range(text: Column, value: Column, start: Column, end: Column) -> Column:
    """struct(start, end): the span's own place if its value stands there, else the nearest one of the value, or of the trimmed value."""
    own = F.substring(text, start + 1, end - start) == value
    at = scan.nearest(text, value, start)
    short = trimmed(value)
    other = F.when((F.length(short) >= 2) & (short != value), scan.nearest(text, short, start))
    pair = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))
    # The reach of a trimmed value found instead is still that of the whole value.
    hit = F.coalesce(at, other)
    return F.when((F.coalesce(F.length(value), F.lit(0)) == 0) | own | hit.isNull(), pair(start, end)).otherwise(pair(hit, hit + F.length(value)))


def line_key(y: Column) -> Column:
    """Lines are half units apart; halves round up."""
    return F.floor(y * 2 + 0.5) / 2


def span_boxes(spans: DataFrame, pages: DataFrame, key: list[str]) -> DataFrame:
    """Padded boxes of each span, one per page and line.

    ``spans``: key columns, doc_id and ``boxes`` (the character boxes of the span, nulls
    allowed). ``pages``: doc_id, page_index, page_width, page_height. A box takes in all its
    characters, widened for edges, the first glyph and descenders, and clamped to its page.
    """
    chars = spans.select("doc_id", *key, F.explode("boxes").alias("b")).where("b IS NOT NULL")
    lines = (
        chars.groupBy("doc_id", *key, F.col("b.pageIndex").alias("page_index"), line_key(F.col("b.y")).alias("line"))
        .agg(
            F.min("b.x").alias("x"),
            F.min("b.y").alias("y"),
            F.max(F.col("b.x") + F.col("b.width")).alias("right"),
            F.max(F.col("b.y") + F.col("b.height")).alias("bottom"),
            F.min_by(F.when(F.col("b.width") > 0, F.col("b.width")), F.when(F.col("b.width") > 0, F.col("b.x"))).alias("glyph"),
        )
        .withColumn("h", F.col("bottom") - F.col("y"))
        .withColumn("edge", F.greatest(F.lit(2.0), F.col("h") * 0.1))
        .withColumn("left", F.col("edge") + F.when(F.col("glyph").isNull(), F.col("h") * 0.12).otherwise(F.least(F.greatest(F.col("glyph") * 0.6, F.lit(1.5)), F.col("h") * 0.55)))
    )
    raw = lines.select("doc_id", *key, "page_index", "line", (F.col("x") - F.col("left")).alias("x"), (F.col("y") - F.col("edge")).alias("y"), (F.col("right") - F.col("x") + F.col("left") + F.col("edge")).alias("width"), (F.col("h") * 1.25 + F.col("edge") * 2).alias("height"))
    met = raw.join(pages, ["doc_id", "page_index"], "left")
    known = F.col("page_width").isNotNull()
    x, y = F.greatest(F.lit(0.0), F.col("x")), F.greatest(F.lit(0.0), F.col("y"))
    right, bottom = F.least("page_width", F.col("x") + F.col("width")), F.least("page_height", F.col("y") + F.col("height"))
    return met.select(
        "doc_id",
        *key,
        "page_index",
        "line",
        F.when(known, x).otherwise(F.col("x")).alias("x"),
        F.when(known, y).otherwise(F.col("y")).alias("y"),
        F.when(known, F.greatest(F.lit(1.0), right - x)).otherwise(F.col("width")).alias("width"),
        F.when(known, F.greatest(F.lit(1.0), bottom - y)).otherwise(F.col("height")).alias("height"),
    )


def page_plan(documents: DataFrame, key: str, page_count: str, redacted: DataFrame, mode: str = "raster") -> DataFrame:
    """(key, page_index, strategy): copy for pages without boxes, else raster, or cover in searchable mode."""
    pages = documents.where(F.col(page_count) > 0).select(key, F.explode(F.sequence(F.lit(0), F.col(page_count).cast("int") - 1)).alias("page_index"))
    hit = redacted.select(key, "page_index").distinct().withColumn("hit", F.lit(True))
    how = "cover" if mode == "searchable" else "raster"
    return pages.join(hit, [key, "page_index"], "left").select(key, "page_index", F.when(F.col("hit"), how).otherwise("copy").alias("strategy"))


def cover_box(box: Column, view_width: Column, view_height: Column, page_width: Column, page_height: Column) -> Column:
    """A box in page space with y up, scaled from the view, at least 2 by 8."""
    sx = F.when(view_width > 0, page_width / view_width).otherwise(1.0)
    sy = F.when(view_height > 0, page_height / view_height).otherwise(1.0)
    return F.struct(
        (box["x"] * sx).alias("x"),
        (page_height - (box["y"] + box["height"]) * sy).alias("y"),
        F.greatest(F.lit(2.0), box["width"] * sx).alias("width"),
        F.greatest(F.lit(8.0), box["height"] * sy).alias("height"),
    )
