import csv
import json

import pytest
from pyspark.sql import functions as F

from quern.operators import align, manifest, metrics, tables
from quern.plans import score
from quern.schema import ALL_COLS, Protocol, audit_protocols
from quern.sources import readers, writers

TRUTH = ", ".join(f"{c} string" for c in ALL_COLS) + ", gt_ord long"
PRED = ", ".join(f"{c} string" for c in ALL_COLS) + ", version string, rep int, pred_ord long, _text_recoverable map<string,boolean>"


def truth(spark, *rows):
    return spark.createDataFrame([(*[r.get(c) for c in ALL_COLS], i) for i, r in enumerate(rows)], TRUTH)


def preds(spark, *rows):
    return spark.createDataFrame([(*[r.get(c) for c in ALL_COLS], r.get("version", "V4"), r.get("rep", 1), i, r.get("flags")) for i, r in enumerate(rows)], PRED)


def columns(out):
    return {r.column: (r.tp, r.tp_rng, r.fp, r.fp_un, r.fn, r.fn_fig) for r in out["columns"].collect()}


def test_cells(spark):
    t = truth(spark, {"paper": "A", "catalyst": "Mg-Al", "temperature_K": "623", "pressure": "1 atm", "conversion_pct": "46", "gas_mix": "N2", "GHSV_h": "5"}, {"paper": "B", "catalyst": "Cu"})
    p = preds(
        spark,
        {"paper": "A", "catalyst": "MgAlOx", "temperature_K": "630", "pressure": "101 kPa", "conversion_pct": "29-46", "LHSV_h": "3", "flags": {"gas_mix": False}},
        {"paper": "A", "catalyst": "Zn", "temperature_K": "none"},
    )
    got = columns(score.score_run(t, p))
    assert got["temperature_K"] == (1, 0, 0, 0, 0, 0) and got["pressure"] == (1, 0, 0, 0, 0, 0)
    assert got["conversion_pct"] == (1, 1, 0, 0, 0, 0) and got["gas_mix"] == (0, 0, 0, 0, 1, 1) and got["GHSV_h"] == (0, 0, 0, 0, 1, 0)
    assert got["LHSV_h"] == (0, 0, 1, 0, 0, 0)
    assert got["catalyst"] == (0, 0, 2, 1, 2, 0)  # other spelling; surplus row; paper B without rows
    composed = columns(score.score_run(t, p, [Protocol().plus("strict", "composition_cells")]))
    assert composed["catalyst"] == (1, 0, 1, 1, 1, 0)
    assert columns(score.score_run(t, p, [Protocol().without("strict", "surplus")]))["catalyst"] == (0, 0, 1, 0, 2, 0)
    assert columns(score.score_present(t, p))["catalyst"] == (0, 0, 2, 1, 1, 0)
    assert "paper" in columns(score.score_run(t, p, [Protocol("legacy", frozenset())]))


def test_greedy_is_in_truth_order_and_ties_go_to_the_first(spark):
    same = {"paper": "A", "catalyst": "x", "temperature_K": "600", "conversion_pct": "10"}
    t = truth(spark, {**same, "conversion_pct": "50"}, same)
    p = preds(spark, {**same, "gas_mix": "a"}, same, {"paper": "A", "catalyst": "x"})
    for match in (align.greedy, align.greedy_large):
        out = score.score_run(t, p, match=match)["matches"]
        assert {(r.gt_ord, r.pred_ord) for r in out.collect()} == {(0, 0), (1, 1)}


def test_gate(spark):
    t = truth(spark, {"paper": "A", "catalyst": "Mg-Al", "temperature_K": "600", "conversion_pct": "10"})
    p = preds(spark, {"paper": "A", "catalyst": "Zn-Al", "temperature_K": "600", "conversion_pct": "10"})
    assert score.score_run(t, p)["matches"].count() == 1 and score.score_run(t, p, [Protocol().plus("strict", "composition_gate")])["matches"].count() == 0


def test_rates(spark):
    df = spark.createDataFrame([(0, 0, 0, 0), (0, 1, 1, 0), (2, 1, 1, 1), (3, 0, 0, 0)], "tp long, fp long, fn long, fn_fig long")
    got = [(r.p, r.r, r.f1, r.f1_text) for r in metrics.with_prf(df).collect()]
    assert got[0] == (None, None, None, None) and got[1][2] == 0.0 and got[2][:3] == pytest.approx((2 / 3, 2 / 3, 2 / 3)) and got[2][3] == pytest.approx(0.8) and got[3][2] == 1.0
    reps = spark.createDataFrame([("V4", 0.5, 0.5, 0.5, 0.5), ("V4", 0.7, 0.5, 0.5, None), ("V5", 0.3, None, None, None)], "v string, f1 double, p double, r double, f1_text double")
    out = {r.v: r for r in metrics.over_repeats(reps, ["v"]).collect()}
    assert out["V4"].f1_sd == pytest.approx(0.1414213562) and out["V5"].f1_sd == 0.0 and out["V4"].f1_text_mean == 0.5


def test_audit_in_one_plan_equals_single_runs(spark):
    rows = [{"paper": "A", "catalyst": "Mg-Al", "temperature_K": str(600 + i), "pressure": "1 atm", "conversion_pct": str(i)} for i in range(6)]
    t = truth(spark, *rows)
    p = preds(spark, *[{**r, "catalyst": "MgAlOx", "pressure": "0.1 MPa", "conversion_pct": f"{i}-{i + 5}"} for i, r in enumerate(rows[:5])])
    together = {r.protocol: r for r in score.audit(t, p, audit_protocols(True)).collect()}
    assert [together[q.name].step for q in audit_protocols(True)] == list(range(7))
    for q in (audit_protocols(True)[2], audit_protocols(True)[5]):
        alone = score.score_run(t, p, [q])["scores"].first()
        assert (alone.tp, alone.fp, alone.fn) == (together[q.name].tp, together[q.name].fp, together[q.name].fn)
    assert together["v1_c3"].d_f1 is None and together["fix5_drop_paper_c3"].d_f1 is not None


def test_files_end_to_end(spark, tmp_path):
    with open(tmp_path / "truth.csv", "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f)
        w.writerow(["open_access_repo", "open_access", *ALL_COLS])
        w.writerow(["", "", "A", " Mg-Al", "None", "623 - 723", *[""] * 8])
        w.writerow(["", "", "", "dropped", *[""] * 10])
        w.writerow(["", "", "B", "Cu, x", *[""] * 10])
    t = readers.read_truth(spark, str(tmp_path / "truth.csv"))
    assert [(r.paper, r.catalyst, r.loading_g, r.temperature_K) for r in t.orderBy("gt_ord").collect()] == [("A", " Mg-Al", None, "623 - 723"), ("B", "Cu, x", None, None)]
    assert readers.read_truth(spark, str(tmp_path / "truth.csv"), "B").count() == 1
    run = tmp_path / "run"
    run.mkdir()
    (run / "a_V4_r1_extracted.json").write_text(json.dumps([{"paper": "A", "catalyst": "Mg-Al", "temperature_K": "700", "_text_recoverable": {"pressure": False}}, {"paper": "A"}]))
    (run / "a_V4_r2_extracted.json").write_text("[]")
    got = readers.read_predictions(spark, str(run)).orderBy("pred_ord").collect()
    assert [(r.slug, r.version, r.rep, r.pred_ord, r.temperature_K) for r in got] == [("a", "V4", 1, 0, "700"), ("a", "V4", 1, 1, None)] and got[0]._text_recoverable == {"pressure": False}
    cells = readers.discover(spark, str(run)).drop("file")
    assert cells.count() == 2
    hashes = manifest.file_hashes(spark, str(run))
    lines = manifest.manifest_lines(hashes)
    writers.write_lines(lines, lines["line"], str(tmp_path / "manifest"), ["file"])
    back = readers.read_manifest(spark, str(tmp_path / "manifest"))
    assert manifest.changed_files(hashes, back).count() == 0
    (run / "a_V4_r2_extracted.json").write_text("[1]")
    assert [r.state for r in manifest.changed_files(manifest.file_hashes(spark, str(run)), back).collect()] == ["changed"]
    expected = spark.createDataFrame([("a", "V4", 1), ("a", "V4", 2)], "slug string, version string, rep int")
    replies = spark.createDataFrame([("a", "V4", 1, False), ("a", "V4", 1, True)], "slug string, version string, rep int, failed boolean")
    done = {r.rep: r for r in manifest.finalised_cells(expected, cells.withColumn("n_rows", cells.rep * 0), replies).collect()}
    assert (done[1].n_calls, done[1].n_failed_calls, done[2].n_calls) == (1, 1, 0)
    with pytest.raises(ValueError, match="missing"):
        manifest.finalised_cells(expected, cells.where("rep = 1"), replies)


def test_tables(spark):
    cells = spark.createDataFrame([(0, 0, "Data"), (1, 0, " Patent "), (1, 1, "Loading"), (2, 0, "US1"), (2, 1, " 5 ")], "row_no int, col_no int, value string")
    assert {(r.header, r.value) for r in tables.header_row(cells, "Patent").collect()} == {("Patent", "US1"), ("Loading", "5")}
    m = spark.range(1).select(tables.map_merge(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("b"), F.lit(3))).alias("m")).first().m
    assert m == {"a": 1, "b": 3}
    x = spark.range(23).withColumn("g", F.lit(1))
    assert sorted(r.id for r in tables.systematic_sample(x, ["g"], ["id"], 5).collect()) == [0, 4, 8, 12, 16]
