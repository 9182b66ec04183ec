from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilspan.operators import chunk, offsets, pdfgeo, report, spans, verify
from veilspan.operators.detect import SPAN

SCHEMA = f"text string, m array<{SPAN}>, sel map<string,boolean>"


def frame(spark, text, matches, sel=None):
    return spark.createDataFrame([(text, matches, sel or {})], SCHEMA)


def redact(spark, text, matches, fmt="number", sel=None):
    df = frame(spark, text, matches, sel)
    return df.select(spans.redacted(F.col("text"), spans.selected(F.col("m"), F.col("sel")), F.lit(fmt))).first()[0]


T = "Email: a@example.com Tel: 123-456-7890"
M = [("e", "Email", "a@example.com", 7, 20), ("p", "Phone", "123-456-7890", 26, 38)]


def test_redact_formats(spark):
    assert redact(spark, T, M) == "Email: [EMAIL:1] Tel: [PHONE:2]"
    assert redact(spark, T, M, "none", {"p": False}) == "Email: [EMAIL] Tel: 123-456-7890"
    assert redact(spark, T, M, "id") == f"Email: [EMAIL:17wdrq] Tel: [PHONE:{_code(2)}]"


def _code(i):
    n, out = i * 2654435761 % 2**32, ""
    while n:
        n, r = divmod(n, 36)
        out = "0123456789abcdefghijklmnopqrstuvwxyz"[r] + out
    return out.rjust(6, "0")[:6]


def test_index_id(spark):
    got = spark.range(1, 2000).select("id", spans.index_id(F.col("id")).alias("c")).collect()
    assert all(r.c == _code(r.id) for r in got)


def test_overlaps_and_ties(spark):
    ms = [("a", "a", "abcde", 0, 5), ("b", "b", "defghij", 3, 10), ("c", "c", "ijkl", 8, 12)]
    assert redact(spark, "abcdefghijklmnop", ms, "none") == "[A]fgh[C]mnop"
    assert redact(spark, "abcdefghijklmnop", ms) == "[A:1]fgh[C:3]mnop"
    both = [("z", "Part", "ABC", 6, 9), ("y", "Full", "ABC-123", 6, 13)]
    assert redact(spark, "Token ABC-123", both) == "Token [FULL:1]"


def test_restore(spark):
    ms = [("1", "EMAIL", "a@x.org", 5, 12), ("2", "EMAIL", "b$&", 24, 27)]
    df = frame(spark, "Send [EMAIL], then copy [EMAIL].", ms)
    assert df.select(spans.restored(F.col("text"), spans.ordered(F.col("m")), F.lit("none"))).first()[0] == "Send a@x.org, then copy b$&."
    ms = [("1", "SECRET", "[SECRET:2]", 0, 10), ("2", "SECRET", "actual", 10, 16)]
    df = frame(spark, "[SECRET:1][SECRET:2]", ms)
    assert df.select(spans.restored(F.col("text"), spans.ordered(F.col("m")), F.lit("number"))).first()[0] == "[SECRET:2]actual"


def test_empty_everything(spark):
    assert redact(spark, "", []) == ""
    assert redact(spark, "plain", []) == "plain"
    df = frame(spark, "", [])
    assert spans.input_segments(df.withColumn("id", F.lit(1)), "id", "text", "m").count() == 0
    bad = [("n", "k", "v", None, 3), ("o", "k", "v", 4, 2), ("q", "k", "v", 2, 99)]
    assert frame(spark, "abc", bad).select(F.size(spans.usable(F.col("m"), F.col("text")))).first()[0] == 0


def test_input_segments(spark):
    ms = [("w", "k", "ABC-123", 6, 13), ("p", "k", "ABC", 6, 9)]
    rows = spans.input_segments(frame(spark, "Token ABC-123", ms).withColumn("id", F.lit(1)), "id", "text", "m").orderBy("seg_no").collect()
    assert [(r.segment, len(r.match_ids)) for r in rows] == [("Token ", 0), ("ABC", 2), ("-123", 1)]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(1, 8)), max_size=8))
def test_roundtrip_property(spark, places):
    text = "abcdefghijklmnopqrstuvwxyz0123"
    ms = [(f"m{i}", "k", text[a : a + n], a, a + n) for i, (a, n) in enumerate(places)]
    df = frame(spark, text, ms).withColumn("o", spans.ordered(F.col("m")))
    df = df.withColumn("r", spans.redacted(F.col("text"), F.col("o"), F.lit("number")))
    row = df.select("r", spans.restored(F.col("r"), F.col("o"), F.lit("number")).alias("back"), spans.resolved(spans.tokens(F.col("o"), F.lit("number"))).alias("kept")).first()
    assert row.back == text
    assert all(x.end <= y.start for x, y in zip(row.kept, row.kept[1:]))


def test_selection(spark):
    df = frame(spark, T, M, {"e": False})
    full = df.select(spans.full_selection(F.col("m"), F.col("sel")).alias("s"))
    assert full.first().s == {"e": False, "p": True}
    assert full.select(spans.toggled(F.col("s"), F.lit("e")).alias("t")).first().t == {"e": True, "p": True}
    assert df.select(spans.all_selected(F.col("m"), False).alias("s")).first().s == {"e": False, "p": False}
    wide = [("a", "a", "x", 0, 5), ("b", "b", "x", 3, 10), ("c", "c", "x", 12, 13)]
    got = frame(spark, "x" * 20, wide).select(spans.merged_cover(F.col("m")).alias("c")).first().c
    assert [(s.start, s.end) for s in got] == [(0, 10), (12, 13)]


def test_chunks(spark):
    def texts(text, limit):
        df = spark.createDataFrame([(1, text)], "id int, text string")
        return [r.chunk_text for r in chunk.chunk_rows(df, "id", "text", limit).orderBy("chunk_index").collect()]

    assert texts("one two three four five six", 2) == ["one two ", "three four ", "five six"]
    assert [len(t.split()) for t in texts("w " * 1005, 1000)] == [1000, 5]
    assert texts("  lead a b", 1) == ["  lead ", "a ", "b"]
    assert texts("   ", 3) == [] and texts(None, 3) == []


def test_pages(spark):
    box = "array<struct<pageIndex:int,x:double,y:double,width:double,height:double>>"
    boxes = [(0, 0.0, 0.0, 5.0, 10.0)] * 3 + [None] + [(1, 0.0, 0.0, 5.0, 10.0)] * 3
    df = spark.createDataFrame([("a b c d", [(0, 100.0, 100.0), (1, 100.0, 100.0), (2, 1.0, 1.0)], boxes)], f"text string, pages array<struct<index:int,width:double,height:double>>, b {box}")
    ranges = chunk.page_ranges(F.col("pages"), F.col("b"))
    assert [tuple(r) for r in df.select(ranges.alias("r")).first().r] == [(0, 0, 3), (1, 4, 7)]
    cut = df.select(chunk.page_chunks(F.col("text"), ranges, 2).alias("c")).first().c
    assert [(c.start, c.end) for c in cut] == [(0, 3), (4, 7)]


def test_offsets(spark):
    text = "😀😁 test@example.com"
    df = spark.createDataFrame([(text,)], "t string")
    t = F.col("t")
    row = df.select(offsets.utf8_offset(t, F.lit(3)), offsets.utf16_offset(t, F.lit(3)), offsets.utf8_to_utf16(t, F.lit(25)), offsets.utf8_to_code_points(t, F.lit(9)), offsets.utf8_to_code_points(t, F.lit(2))).first()
    assert tuple(row) == (9, 5, 21, 3, 1)


def test_reports(spark):
    ms = [("1", "b", "two words", 0, 9), ("2", "a", "x", 10, 11), ("3", "b", " ", 12, 13)]
    df = frame(spark, "x" * 20, ms)
    assert [tuple(c) for c in df.select(report.category_summary(F.col("m")).alias("c")).first().c] == [("b", 2), ("a", 1)]
    assert [tuple(c) for c in df.select(report.category_groups(F.col("m")).alias("c")).first().c] == [("b", 2, 2), ("a", 1, 1)]
    assert df.select(report.preview(F.lit("a " * 100))).first()[0].endswith("...")


def test_residuals(spark):
    ms = [("1", "private_person", "Synthetic Person", 0, 16)]
    pages = frame(spark, "Synthetic Person ada@example.com", ms).withColumn("id", F.lit(1)).withColumn("page", F.lit(1))
    rows = verify.residual_report(pages, "id", "page", "text", "m").collect()
    assert {(r.kind, r["count"]) for r in rows} == {("private_person", 1), ("private_email", 1)}
    doc = verify.document_report(pages, "id", "page", "text", "m").first()
    assert doc.status == "residual-matches" and doc.residual_count == 2
    empty = pages.withColumn("text", F.lit(" ")).withColumn("m", F.array().cast(f"array<{SPAN}>"))
    assert verify.document_report(empty, "id", "page", "text", "m").first().status == "no-extractable-text"


def test_geometry(spark):
    df = spark.createDataFrame([("ab xy ab", "ab", 5, 7), ("ab xy ab", "xy", 3, 5), ("abc", "zz", 0, 2), ("q ab", " ab ", 0, 4)], "t string, v string, a int, b int")
    got = [tuple(r.r) for r in df.select(pdfgeo.drifted_range(F.col("t"), F.col("v"), F.col("a"), F.col("b")).alias("r")).collect()]
    assert got == [(6, 8), (3, 5), (0, 2), (2, 6)]
    item = spark.range(1).select(pdfgeo.item_box(F.array(*[F.lit(x) for x in (10.0, 0.0, 0.0, -10.0, 50.0, 100.0)]), F.lit(40.0), F.lit(10.0), F.lit(0)).alias("i")).first().i
    assert item.split and (item.box.x, item.box.y, item.box.width, item.box.height) == (50.0, 90.0, 40.0, 10.0)
    items = spark.createDataFrame([(1, 0, 0, "a"), (1, 0, 1, "b"), (1, 0, 2, ""), (1, 1, 0, "c "), (1, 1, 1, "d")], "id int, page int, item_no int, str string")
    assert pdfgeo.assembled_text(items, "id").first().text == "a b\n\nc d"
    docs = spark.createDataFrame([(1, 3), (2, 0)], "id int, n int")
    hit = spark.createDataFrame([(1, 1), (1, 1), (1, 9)], "id int, page_index int")
    assert [r.strategy for r in pdfgeo.page_plan(docs, "id", "n", hit).orderBy("page_index").collect()] == ["copy", "raster", "copy"]
