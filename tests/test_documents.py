import json
import os

import pytest
from pyspark.sql import functions as F

from veilspan import session
from veilspan.operators import document, pdfgeo
from veilspan.operators.scan import SPAN
from veilspan.sources import models, sinks
from veilspan.sources.files import load_tabs
from veilspan.streaming import stream

SCHEMA = f"id string, title string, document_kind string, input string, output string, matches array<{SPAN}>, selection map<string,boolean>, index_format string, mode string, restore_input string, restore_output string, is_closed boolean, sort_order int, updated_at long"
ADA = ("m1", "person", "Ada", 0, 3)


def tabs(spark, *rows):
    base = dict(id="t", title="T", document_kind="markdown", input="Ada and Bo", output="[PERSON] and Bo", matches=[ADA], selection={}, index_format="none", mode="text-to-pii", restore_input="", restore_output="", is_closed=False, sort_order=1, updated_at=5)
    names = [c.split()[0] for c in SCHEMA.replace(SPAN, "x").split(", ")]
    return spark.createDataFrame([tuple({**base, **r}[n] for n in names) for r in rows], SCHEMA)


def test_clearing(spark):
    df = tabs(spark, {}, {"id": "r", "mode": "pii-to-text", "restore_input": "x", "restore_output": "y"})
    got = {r.id: r for r in document.cleared_input(df, F.lit(True)).collect()}
    assert (got["t"].document_kind, got["t"].input, got["t"].output, got["t"].matches) == ("text", "", "", [])
    assert (got["r"].input, got["r"].restore_input, got["r"].restore_output) == ("Ada and Bo", "", "")
    got = {r.id: r for r in document.cleared_output(df, F.col("id").isin("t", "r")).collect()}
    assert (got["t"].input, got["t"].output, got["t"].matches) == ("Ada and Bo", "", []) and (got["r"].restore_input, got["r"].restore_output, got["r"].output) == ("x", "", "[PERSON] and Bo")
    assert document.cleared_output(df, F.lit(None).cast("boolean")).where("output = ''").count() == 0


def test_format_and_closing(spark):
    df = tabs(spark, {})
    once = document.toggled_format(df, F.lit(True), "number")
    assert once.first().output == "[PERSON:1] and Bo" and document.toggled_format(once, F.lit(True), "number").first().output == "[PERSON] and Bo"
    assert document.closed(df, F.col("id") == "t").first().is_closed and not document.closed(df, F.col("id") == "u").first().is_closed


def test_imports(spark):
    df = tabs(spark, {}, {"id": "u"})
    files = spark.createDataFrame([(1, "a.md", "markdown", "one"), (2, "b.txt", "markdown", "two"), (3, "c.exe", None, None)], "file_no int, file_name string, kind string, text string").withColumn("pdf_document", F.lit(None).cast("string"))
    rows = document.imported(df, files, "t").collect()
    assert sorted(r.input for r in rows) == ["Ada and Bo", "one", "two"] and next(r for r in rows if r.id == "t").matches == []
    more = document.imported(df, files).collect()
    assert len(more) == 4 and {r.id for r in document.imported(df, files).collect()} == {r.id for r in more}
    assert document.imported(df, files.limit(0), "t").count() == 2
    assert tuple(document.import_counts(files.withColumnRenamed("file_name", "path")).first()) == (3, 2, 1)


def test_ids_tell_nulls_apart(spark):
    rows = spark.createDataFrame([("a", None), ("a", ""), (None, "a"), ("a", None)], "x string, y string")
    ids = [r[0] for r in rows.select(document.entity_id("m", F.col("x"), F.col("y"))).collect()]
    assert len(set(ids)) == 3 and ids[0] == ids[3] and ids[0].startswith("m-")


def test_panes(spark):
    back = {"mode": "pii-to-text", "restore_input": "Hi [PERSON]!", "restore_output": "Hi Ada!"}
    df = tabs(spark, {}, {"id": "r", **back}, {"id": "stale", **back, "restore_output": "old"}, {"id": "none", "output": ""}, {"id": "empty", "input": "", "output": ""})
    show = lambda view: {r.id: [(s.text, s.match_ids) for s in r.segments] for r in document.pane_segments(df, view).collect()}
    left, right = show("input"), show("output")
    assert left["t"] == [("Ada", ["m1"]), (" and Bo", [])] and right["t"] == [("[PERSON]", ["m1"]), (" and Bo", [])]
    assert left["r"] == [("Hi ", []), ("[PERSON]", ["m1"]), ("!", [])] and right["r"] == [("Hi ", []), ("Ada", ["m1"]), ("!", [])]
    assert right["stale"] == [("old", [])] and right["none"] == [] and left["empty"] == [] == right["empty"]


def test_overlays(spark):
    df = tabs(spark, {"selection": {"m1": False}})
    assert document.overlays(df, "input").count() == 1 and document.overlays(df, "output").count() == 0


def test_scan_results_come_in(spark):
    old = [ADA, ("m2", "person", "Bo", 8, 10)]
    df = tabs(spark, {"matches": old, "selection": {"m2": False}}, {"id": "u"})
    found = spark.createDataFrame([("t", 0, 5, [("n1", "name", "Ada", 0, 3)]), ("gone", 0, 5, [])], f"id string, start int, end int, found array<{SPAN}>")
    got = {r.id: r for r in document.merged_results(df, found).collect()}
    assert [m.match_id for m in got["t"].matches] == ["n1", "m2"] and got["t"].selection == {"n1": True, "m2": False} and got["t"].output == "[NAME] and Bo"
    assert got["u"].matches[0].match_id == "m1" and set(got) == {"t", "u"}
    whole = spark.createDataFrame([("t", None, None, [])], found.schema)
    assert document.merged_results(df, whole).where("id = 't'").first().output == "Ada and Bo"


def test_models(tmp_path, monkeypatch):
    (tmp_path / "onnx").mkdir()
    (tmp_path / "onnx" / "model_q4.onnx").write_bytes(b"1234")
    files = {"onnx/model_q4.onnx": 4, "tokenizer.json": None}
    assert models.resolve(tmp_path, ["onnx/model.onnx", "onnx/model_q4.onnx"]).name == "model_q4.onnx"
    s = models.status(tmp_path, files)
    assert (s.present, s.bytes_present, s.missing, s.complete) == (1, 4, ("tokenizer.json",), False)
    assert models.status(tmp_path, {"onnx/model_q4.onnx": 5}).missing == ("onnx/model_q4.onnx",)
    with pytest.raises(ValueError):
        models.status(tmp_path, {"../x": None})
    with pytest.raises(FileNotFoundError):
        models.resolve(tmp_path, ["none.onnx"])
    monkeypatch.setenv("MODEL_DIR", str(tmp_path / "other"))
    assert models.delete(tmp_path / "onnx", {"model_q4.onnx": None}, "MODEL_DIR").present == 0 and os.environ["MODEL_DIR"]
    monkeypatch.setenv("MODEL_DIR", str(tmp_path))
    models.delete(tmp_path, files, "MODEL_DIR")
    assert "MODEL_DIR" not in os.environ and not tmp_path.exists()


def test_files_under_their_own_names(spark, tmp_path):
    rows = spark.createDataFrame([("tab-1", 0, 2), ("../x", 0, 2), ("tab-2", None, 1)], "tab_id string, completed_at long, match_count int")
    sinks.write_results(rows, str(tmp_path))
    written = [p for p in tmp_path.rglob("*") if p.is_file()]
    assert [str(p.relative_to(tmp_path)) for p in written] == ["tab-1/1970-01-01T00-00-00.000Z.json".replace(".000", "-000")]
    assert json.loads(written[0].read_text())["match_count"] == 2
    sinks.write_sidecars(spark.createDataFrame([("out.pdf", "ok")], "name string, status string"), str(tmp_path / "side"), "name")
    assert json.loads((tmp_path / "side" / "out.pdf.verification.json").read_text()) == {"status": "ok"}


def test_tables_are_replaced_whole(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.write_table(spark.range(3), path)
    sinks.write_table(spark.read.parquet(path).where("id > 0"), path)
    assert spark.read.parquet(path).count() == 2 and [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["t"]


def test_batches_are_appended_and_compacted(spark, tmp_path):
    src, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    log = stream.ProgressLog()
    spark.streams.addListener(log)
    save = lambda: stream.upsert_batches(spark.readStream.schema("id string, v long, x string").parquet(src), out, state, "id", "v").awaitTermination()
    spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("b", 1, "b")], "id string, v long, x string").write.parquet(src)
    save()
    spark.createDataFrame([("a", 1, "again")], "id string, v long, x string").write.mode("append").parquet(src)
    save()
    spark.streams.removeListener(log)
    read = lambda: {r.id: r.x for r in stream.upserted_table(spark, out, "id", "v").collect()}
    assert read() == {"a": "again", "b": "b"}
    stream.compact(spark, out, "id", "v")
    assert read() == {"a": "again", "b": "b"} and len(list((tmp_path / "out").glob("batch=*"))) <= 1


def test_pruned_tabs(spark, tmp_path):
    path = str(tmp_path / "tabs")
    spark.createDataFrame([("a", 1, 5, "in", "[]"), ("a", 0, 4, "in", None)], "id string, is_closed int, updated_at long, input string, matches_json string").write.parquet(path)
    df = spark.read.parquet(path)
    rows = load_tabs(df, columns=["is_closed"])
    assert rows.columns == ["id", "is_closed"] and rows.first().is_closed and load_tabs(df, closed=False, columns=[]).count() == 0
    assert "ReadSchema: struct<id:string,is_closed:int,updated_at:bigint>" in rows._jdf.queryExecution().executedPlan().toString()


def test_drifted_ranges(spark):
    df = spark.createDataFrame([("ab Ada xx Ada", "Ada", 5, 8), ("Ada", "Ada", 0, 3), ("x", "Ada", 0, 1), ("x", None, 0, 1), (" Ada ", "Ada\n", 0, 4)], "t string, v string, a int, b int")
    rows = df.select(pdfgeo.drifted_range(*map(F.col, "tvab")).alias("r")).collect()
    assert [tuple(r.r) for r in rows] == [(3, 6), (0, 3), (0, 1), (0, 1), (1, 5)]


def test_durable_tables_go(spark):
    df = session.durable(spark.range(2), "kept")
    assert df.count() == 2 and session.clear_durable(spark) >= 1
    assert session.clear_durable(spark) == 0
