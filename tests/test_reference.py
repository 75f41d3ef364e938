from quern.operators import documents
from quern.plans import reference


def test_truth_from_sheet(spark):
    rows = [["Title"], ["Patent", "Catalyst", "Temperature / deg C", "Pressure /atm", "Other"], ["US 1", "Cu", "26.35", "2", "x"], ["EP 2", "Ni", "1", "1", ""], ["US 1", " Mg ", "a - b", None, ""]]
    cells = [(i, j, v) for i, r in enumerate(rows) for j, v in enumerate(r) if v is not None]
    df = spark.createDataFrame(cells, "row_no int, col_no int, value string")
    got = reference.truth_from_sheet(df, {"US 1": "US1"}).orderBy("row_no").collect()
    assert [(r.paper, r.catalyst, r.temperature_K, r.pressure, r.loading_g) for r in got] == [("US1", "Cu", "300", "203 kPa", ""), ("US1", "Mg", "a - b", "", "")]


def test_repair_accuracy(spark):
    pages = spark.createDataFrame([("d", 1, "300 2OO 1O.S 45.2 O.50")], "doc string, page int, text string")
    edits = documents.changes(documents.repaired_lines(documents.text_lines(pages)))
    truth = spark.createDataFrame([("d", 1, "2OO", "200"), ("d", 2, "1O.S", "10.6"), ("d", 3, "O.5", ".5"), ("d", 4, "x", "1")], "doc string, idx int, ocr_token string, truth string")
    got = reference.repair_judgements(edits, truth).orderBy("place").collect()
    assert [(r.after, r.drift, r.correct) for r in got] == [("200", False, True), ("10.5", False, False), ("0.50", True, True)]
    assert tuple(reference.repair_accuracy(edits, truth).first())[:2] == (3, 2)
