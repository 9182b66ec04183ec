import random

from pyspark.sql import functions as F

from veilspan.operators import model, report
from veilspan.operators.intervals import coverage
from veilspan.sources import sinks
from veilspan.sources.files import load_rules, read_import_files
from veilspan.session import parsed_json
from veilspan.streaming import stream


def brute(spans):
    rows, ends = [], sorted({(a, b) for a, b in spans if a is not None and b is not None and a < b})
    periods = []
    for a, b in ends:
        if periods and a <= periods[-1][1]:
            periods[-1][1] = max(periods[-1][1], b)
        else:
            periods.append([a, b])
    rows += [("period", a, b) for a, b in periods]
    return sorted(rows + [("gap", x[1], y[0]) for x, y in zip(periods, periods[1:])])


def test_coverage_against_brute_force(spark):
    rng = random.Random(5)
    data = {e: [(a, a + rng.randint(-1, 12)) for a in (rng.randint(0, 200) for _ in range(rng.randint(0, 40)))] + [(None, 3), (5, None)] for e in "abcdef"}
    rows = [(e, a, b, 1) for e, s in data.items() for a, b in s + s[:3]] + [(None, 1, 2, 1)]
    df = spark.createDataFrame(rows, "who string, start long, `end` long, pos int")
    for block in (None, 16):
        got = coverage(df, "who", "start", "end", block).collect()
        for e, s in data.items():
            assert sorted((r.seg_type, r.seg_start, r.seg_end) for r in got if r.entity == e) == brute(s)
    assert coverage(df.limit(0), "who", "start", "end").count() == 0


def test_viterbi_rules():
    import numpy as np

    z = np.zeros((2, 33), np.float32)
    z[0, 18], z[1, 19] = 9, 9
    assert model.viterbi(z, *model.bioes_rules()) == [17, 19]
    names = ["O", "B-EMAIL", "I-EMAIL", "B-ORG", "I-ORG"]
    assert model.viterbi(np.array([[0, 9, 0, 0, 0], [0, 0, 9, 0, 10]]), *model.bio_rules(names)) == [1, 2]
    assert model.viterbi(np.array([[9, 0, 0, 0, 0], [0, 0, 0, 9, 10]]), *model.bio_rules(names)) == [0, 3]
    assert model.viterbi(np.zeros((0, 5)), *model.bio_rules(names)) == []


def test_bio_spans_and_bridges():
    names = ["O", "B-EMAIL", "I-EMAIL", "B-PER"]
    text = "ada@x.org, bob"
    got = model.finished(text, model.bio_spans(text, [(0, 3), (3, 4), (4, 9), (9, 10), (10, 14)], [1, 0, 1, 0, 3], names))
    assert [(g[1], g[2]) for g in got] == [("private_email", "ada@x.org"), ("private_person", "bob")]
    two = model.bio_spans("a,b", [(0, 1), (1, 2), (2, 3)], [1, 0, 1], names)
    assert len(two) == 2
    assert model.bioes_spans("abcd", [(0, 1), (9, 9), (1, 2)], [1, 0, 3], ["O", "B-k", "I-k", "E-k", "S-k"]) == [("k", 0, 2)]
    assert model.label_names('{"id2label": {"1": "B-A", "0": "O", "x": "?"}}') == ["O", "B-A"]


def test_model_spans_of_long_texts(spark, tmp_path):
    from veilspan.plans import table_queries

    rows = [(1, "met Ada today"), (2, "we met them " * 400 + "and Ada left"), (3, ""), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for query in (table_queries.model_bio_spans, table_queries.model_bioes_spans):
        got = {(r.doc_id, r.value[:3], r.start) for r in query(spark, str(tmp_path)).collect()}
        assert got == {(1, "Ada", 4), (2, "Ada", 4804)}


def test_model_detector(spark):
    def runner():
        import numpy as np

        return lambda text: ([(0, len(text))], np.eye(33, dtype=np.float32)[[20]] * 5)

    df = spark.createDataFrame([(1, " Ada "), (2, ""), (3, None)], "id long, text string")
    rows = model.detect_model(df, runner, "id").collect()
    assert [(r.id, r.kind, r.value, r.start) for r in rows] == [(1, "private_person", "Ada", 1)]


def test_import_files(spark, tmp_path):
    (tmp_path / "a.MD").write_text("# Grüße")
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    (tmp_path / "d.docx").write_bytes(b"x")
    rows = {r.file_name: r for r in read_import_files(spark, str(tmp_path)).collect()}
    assert rows["a.MD"].text == "# Grüße" and rows["a.MD"].error is None
    assert rows["b.txt"].error == "not valid UTF-8" and rows["c.pdf"].kind == "pdf" and rows["d.docx"].error == "unsupported file type"


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "id string, v int, t string")
    new = spark.createDataFrame([("b", 2, "z"), ("b", 3, "w"), ("c", 1, "n")], "id string, v int, t string")
    assert sorted(map(tuple, sinks.upserted(old, new, "id", "v").collect())) == [("a", 1, "x"), ("b", 3, "w"), ("c", 1, "n")]
    assert {(r.id, r.action) for r in sinks.merge_delta(old, new, "id").collect()} == {("a", "delete"), ("b", "update"), ("c", "insert")}
    sinks.write_texts(old.withColumn("n", F.concat("id", F.lit(".txt"))), str(tmp_path / "o"), "n", "t")
    assert (tmp_path / "o" / "a.txt").read_text() == "x"
    path = str(tmp_path / "t")
    assert sinks.seed_if_empty(spark, path, old) and not sinks.seed_if_empty(spark, path, old)
    sinks.write_table(sinks.upserted(spark.read.parquet(path), new, "id", "v"), path)
    assert spark.read.parquet(path).count() == 3
    sinks.write_rules(spark, [], str(tmp_path / "r"))
    assert load_rules(spark.read.parquet(str(tmp_path / "r"))) == []
    assert sinks.clear_folder(spark, path) > 0 and sinks.file_count(spark, path) == 0


def test_json_as_a_whole(spark):
    cases = [('[{"a":1}]', True), ('[{"a":1}] x', False), ('[{"a":1}', False), ("undefined", False), ("", False), (" ", False), (None, False), ("1,2", False)]
    df = spark.createDataFrame([(j,) for j, _ in cases], "j string").select(parsed_json(F.col("j"), "array<struct<a:int>>").alias("p"))
    assert [r.p is not None for r in df.collect()] == [ok for _, ok in cases]


def test_latest_and_tasks(spark):
    t = spark.createDataFrame([("1", "queued", 5, None, None, None, None, None, None, None), ("2", "queued", 3, None, None, None, None, None, None, None)], "id string, status string, queued_at long, started_at long, completed_at long, duration_ms long, match_count int, category_summary_json string, result_path string, error string")
    run = report.started(t, F.lit(10).cast("long"))
    assert {(r.id, r.status) for r in run.collect()} == {("1", "queued"), ("2", "running")}
    assert {r.status for r in report.started(run, F.lit(11).cast("long")).collect()} == {"queued", "running"}
    res = spark.createDataFrame([("2", 4, "[]", "p", None)], "id string, match_count int, category_summary_json string, result_path string, error string")
    done = {r.id: r for r in report.completed(run, res, F.lit(15).cast("long")).collect()}
    assert (done["2"].status, done["2"].duration_ms, done["1"].status) == ("completed", 5, "queued")


def test_stream_upserts(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([("a", 1, "x@y.org"), ("a", 2, "none")], "id string, v int, text string").coalesce(1).write.parquet(str(src))
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    rows = stream.read_documents(spark, str(src), "id string, v int, text string")
    stream.upsert_batches(rows, out, state, "id", "v").awaitTermination()
    assert [tuple(r) for r in stream.upserted_table(spark, out, "id", "v").collect()] == [("a", 2, "none")]
    found = stream.detected(stream.read_documents(spark, str(src), "id string, v int, text string"), "id")
    stream.run_to_table(found, str(tmp_path / "f"), str(tmp_path / "fs")).awaitTermination()
    assert [r.value for r in spark.read.parquet(str(tmp_path / "f")).collect()] == ["x@y.org"]
