"""Texts cut into chunks of a limited number of blank-separated tokens.

Chunks keep their places: struct(start, end, chunk_index, chunk_total), half-open in code
points. Leading blanks belong to the first chunk, blanks after a token to its chunk, and
chunks of blanks only are dropped. Null and blank texts have no chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.catalog import BLANKS, blanks
from veilspan.functions.let import let
from veilspan.operators import scan
from veilspan.operators.spans import outside

TOKEN_LIMIT = 1000
CHUNK = "struct<start:int,end:int,chunk_index:int,chunk_total:int>"


def is_blank(text: Column) -> Column:
    return ~F.coalesce(text, F.lit("")).rlike(f"[^{BLANKS}]")


def chunks(text: Column, limit: int = TOKEN_LIMIT, base: Column | int = 0) -> Column:
    """The chunks of a text that starts at ``base`` of the whole document."""
    limit = max(1, limit)
    off = F.lit(base) if isinstance(base, int) else base
    sizes = F.transform(F.regexp_extract_all(text, F.lit("(" + blanks(r"\S+\s*") + ")"), F.lit(1)), F.length)
    cut = let(sizes, lambda n: let(_bounds(text, n, limit), lambda b: _chunks(b, off)))
    return F.when(is_blank(text), F.array().cast(f"array<{CHUNK}>")).otherwise(cut)


def _bounds(text: Column, sizes: Column, limit: int) -> Column:
    """Ends of the chunks: the running sum of token sizes after every ``limit`` tokens and after the last."""
    total = F.aggregate(sizes, F.lit(0), lambda a, n: a + n)
    state = F.aggregate(
        sizes,
        F.struct((F.length(text) - total).alias("at"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("ends")),
        lambda acc, n: F.struct(
            (acc["at"] + n).alias("at"),
            F.when(acc["n"] + 1 == limit, 0).otherwise(acc["n"] + 1).alias("n"),
            F.when(acc["n"] + 1 == limit, F.array_append(acc["ends"], acc["at"] + n)).otherwise(acc["ends"]).alias("ends"),
        ),
    )
    return let(state, lambda s: F.when(s["n"] > 0, F.array_append(s["ends"], s["at"])).otherwise(s["ends"]))


def _chunks(ends: Column, off: Column) -> Column:
    starts = F.concat(F.array(F.lit(0)), F.slice(ends, 1, F.greatest(F.size(ends) - 1, F.lit(0))))
    return F.transform(
        F.arrays_zip(starts.alias("a"), ends.alias("b")),
        lambda p, i: F.struct((off + p["a"]).cast("int").alias("start"), (off + p["b"]).cast("int").alias("end"), i.cast("int").alias("chunk_index"), F.size(ends).alias("chunk_total")),
    )


def chunk_rows(docs: DataFrame, key: str, text: str, limit: int = TOKEN_LIMIT) -> DataFrame:
    """(key, start, end, chunk_index, chunk_total, chunk_text), one row per chunk; narrow."""
    return docs.select(key, F.col(text).alias("_text"), F.inline(chunks(F.col(text), limit))).withColumn("chunk_text", F.substring(F.col("_text"), F.col("start") + 1, F.col("end") - F.col("start"))).drop("_text")


def page_ranges(pages: Column, boxes: Column) -> Column:
    """array<struct<page, start, end>>: where the characters of each page begin and end; pages without any are left out."""
    return scan.page_ranges(F.transform(pages, lambda p: p["index"]), F.transform(boxes, lambda b: b["pageIndex"]))


def page_chunks(text: Column, ranges: Column, limit: int = TOKEN_LIMIT) -> Column:
    """Chunks that never cross a page; a text without page ranges is cut as a whole."""
    cut = F.flatten(F.transform(ranges, lambda r: chunks(F.substring(text, r["start"] + 1, r["end"] - r["start"]), limit, r["start"])))
    return let(cut, lambda c: F.when(F.size(c) > 0, c).otherwise(chunks(text, limit)))


def document_chunks(kind: Column, text: Column, limit: int = TOKEN_LIMIT) -> Column:
    """Markdown and PDF texts in chunks; typed text as one chunk; without any, the whole text."""
    whole = F.array(F.struct(F.lit(0).alias("start"), F.length(text).alias("end"), F.lit(0).alias("chunk_index"), F.lit(1).alias("chunk_total")))
    cut = chunks(text, limit)
    return F.when(kind.isin("markdown", "pdf") & (F.size(cut) > 0), cut).otherwise(whole)


def rescanned(previous: Column, found: Column, start: Column, end: Column) -> Column:
    """Spans after a chunk was scanned again: the old ones that do not touch it, and the new ones."""
    from veilspan.operators.spans import merged

    return merged(outside(previous, start, end), found)
