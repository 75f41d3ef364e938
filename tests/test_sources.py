import json

import pytest
from pyspark.sql import functions as F

from quern.operators import documents, extract, tables
from quern.plans import runs
from quern.sources import readers, writers
from quern.streaming import follow_attempts


def test_texts_and_sheets(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("# note\nidx\tpage\tocr_token\ttruth\n1\t6\t\"2OO\t200\n2\t7\tO.5\t0.5\n")
    got = readers.read_digit_truth(spark, str(tmp_path / "t.tsv")).orderBy("idx").collect()
    assert [(r.idx, r.page, r.ocr_token, r.truth) for r in got] == [(1, 6, '"2OO', "200"), (2, 7, "O.5", "0.5")]
    (tmp_path / "s.csv").write_text('junk\nPatent,Catalyst\nUS 1,"Cu, x"\n')
    cells = readers.read_sheet(spark, str(tmp_path / "s.csv"))
    named = tables.header_row(cells, "Patent")
    assert {(r.header, r.value) for r in named.collect()} == {("Patent", "US 1"), ("Catalyst", "Cu, x")}
    (tmp_path / "d.txt").write_text("[Page 1]\nfirst\nline\n\n[Page 2]\n[Table on page 2]\na | b\n")
    pages = readers.read_page_texts(spark, str(tmp_path / "d.txt")).orderBy("page").collect()
    assert [(r.doc, r.page, r.text) for r in pages] == [("d", 1, "first\nline"), ("d", 2, "[Table on page 2]\na | b")]
    (tmp_path / "m.json").write_text("{not json")
    assert readers.read_metadata(spark, str(tmp_path / "m.json")).first().value is None
    assert readers.list_files(spark, str(tmp_path)).count() == 4


def test_attempt_log_batch_and_stream(spark, tmp_path):
    rows = [{"slug": "p", "version": "V4", "rep": 1, "chunk": "methods", "attempt": a, "elapsed_s": 1.5, "models": ["m"], "cost_usd": None, "status": s} for a, s in ((1, "parse_error"), (2, "ok"))]
    log = tmp_path / "log"
    log.mkdir()
    (log / "attempts.jsonl").write_text("\n".join(map(json.dumps, rows)))
    df = readers.read_attempts(spark, str(log))
    assert df.where("status = 'ok'").count() == 1
    writers.append_attempts(df.limit(1), str(tmp_path / "more"))
    writers.append_attempts(df.limit(1), str(tmp_path / "more"))
    assert readers.read_attempts(spark, str(tmp_path / "more")).count() == 2
    q = follow_attempts(spark, str(log)).writeStream.format("memory").queryName("followed").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("followed").count() == 2


def test_record_and_report_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("p", "V4", 1, 0, "Cu"), ("q", "V4", 1, 0, None)], "slug string, version string, rep int, pred_ord int, catalyst string")
    writers.write_records(rows, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    assert json.loads(writers.as_json(rows, ["slug"]).where("slug = 'q'").first().json)["catalyst"] is None
    writers.write_csv(rows, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    pages = spark.createDataFrame([("d", p, "300 2OO 1O.S 45.2") for p in range(1, 10)], "doc string, page int, text string")
    fixed = documents.repaired_lines(documents.text_lines(pages))
    sheet = writers.verification_sheet(documents.changes(fixed), 6)
    assert [r.page for r in sheet.orderBy("page").collect()] == [1, 2, 4, 5, 7, 8]
    writers.write_repaired(fixed, str(tmp_path / "text"))
    assert {r.value for r in spark.read.text(str(tmp_path / "text")).collect()} == {"300 200 10.5 45.2"}
    top = documents.samples(documents.line_verdicts(documents.text_lines(pages)), 2).orderBy("page").collect()
    assert [r.page for r in top] == [1, 2] and documents.tier_counts(documents.changes(fixed)).select(F.sum("n")).first()[0] == 18


def test_names_are_plain(spark, tmp_path):
    for name in ("a b_V4_r1_results[2].txt", "c+d_V4_r2_methods_a2.FAILED.txt", "e%5B_B0_r1_tables.txt", "other.txt"):
        (tmp_path / name).write_text("x")
    want = [("a b", "V4", 1, "results[2]", False), ("c+d", "V4", 2, "methods", True), ("e%5B", "B0", 1, "tables", False)]
    for read in (readers.read_replies, readers.reply_files):
        assert sorted((r.slug, r.version, r.rep, r.label, r.failed) for r in read(spark, str(tmp_path)).collect()) == want


def test_wide_sheets_and_empty_ones(spark, tmp_path):
    (tmp_path / "s.csv").write_text(",".join(f"c{i}" for i in range(300)) + "\n" + ",".join(map(str, range(300))))
    cells = readers.read_sheet(spark, str(tmp_path / "s.csv"))
    assert tables.header_row(cells, "c7").where("header = 'c299'").first().value == "299"
    (tmp_path / "e.csv").write_text("")
    assert readers.read_sheet(spark, str(tmp_path / "e.csv")).count() == 0


def test_runs_are_finished_once(spark, tmp_path):
    run = tmp_path / "run"
    (run / "raw").mkdir(parents=True)
    (run / "a_V4_r1_extracted.json").write_text('[{"paper": "A"}, {"paper": "A"}]')
    (run / "raw" / "a_V4_r1_body[1].txt").write_text("[]")
    one = spark.createDataFrame([("a", "V4", 1)], "slug string, version string, rep int")
    two = spark.createDataFrame([("a", "V4", 1), ("a", "V4", 2)], one.schema)
    with pytest.raises(ValueError, match="missing"):
        runs.finalise(spark, str(run), two)
    assert not runs.is_frozen(spark, str(run))
    assert [tuple(r) for r in runs.finalise(spark, str(run), one).select("slug", "n_rows", "n_calls", "n_failed_calls").collect()] == [("a", 2, 1, 0)]
    assert len((run / "manifest_SHA256.txt").read_text().splitlines()) == 2
    with pytest.raises(ValueError, match="finished"):
        runs.finalise(spark, str(run), one)
    with pytest.raises(ValueError, match="finished"):
        writers.write_records(one, str(run))


def test_metadata_is_merged_into_its_file(spark, tmp_path):
    x = spark.createDataFrame([("r", "a", "V4", 1, "ok", 1.5, 0.25, ["m"]), ("r", "a", "V4", 1, "call_error", 0.5, None, ["n"])], "run_id string, slug string, version string, rep int, status string, elapsed_s double, cost_usd double, models array<string>")
    meta = runs.run_metadata(x)
    path = str(tmp_path)
    (tmp_path / "meta.json").write_text("{broken")
    runs.write_metadata(meta, path)
    runs.write_metadata(runs.run_metadata(x.withColumn("slug", F.lit("b"))), path)
    got = json.loads((tmp_path / "meta.json").read_text())
    assert (got["cells"], got["calls"], got["failed_calls"], got["call_failure_rate"], got["merged_invocations"]) == (2, 4, 2, 0.5, 2)
    assert got["papers"] == ["a", "b"] and got["models_observed"] == ["m", "n"] and got["wall_clock_s"] == 4.0
    runs.write_metadata(meta.withColumn("run_id", F.lit("other")), path)
    assert json.loads((tmp_path / "meta.json").read_text())["merged_invocations"] == 1


def test_extraction_defined_cases(spark):
    chunks = spark.createDataFrame([("a", None), ("b", "x"), ("b", "x")], "chunk string, prompt string")
    got = extract.extract(chunks, lambda: lambda p: p + "!")
    assert sorted((r.chunk, r.attempt, r.status, r.text) for r in got.collect()) == [("a", 1, "ok", "!"), ("b", 1, "ok", "x!"), ("b", 1, "ok", "x!")]
    assert extract.extract(chunks.limit(0), lambda: str).count() == 0
    assert extract.variant("one two", [("two", "three")]) == "one three"
    for edit in (("four", ""), ("o", "")):
        with pytest.raises(ValueError, match="places"):
            extract.variant("one two", [edit])
