"""The plain functions of ``functions.lines`` against the column functions."""

import random

from pyspark.sql import functions as F

from quern.functions import fidelity as fx
from quern.functions import lines

PARTS = ["1O.5", "2SS", "l2", "O", "OO1", "0l5", "SO2", "B2", "3B", "(1S)", "Mg", "Al3O", "Mg3Al1O", "12.1", "13.2", "14.3", "1.5", "350", "99", "0123", "Ol23", "lOO", "5.S", "1S.2,", "I.", "A1O", "S12", "BO3"]
PARTS += ["Run", "Table 1B", "see US 8,318,989 B2", "patent", "Jan. 5, 2O12", "(2012.01)", "wt %", "H2O", "é1O", "±S", "–5O", "“1O”", ",1S;", "*", "2O 1", "G6", "I5I", "°C", "CO2", "2", "20", "Cu-Zn", "et al"]
GAPS = [" ", "  ", "\t", " ", " ", " ", " ", "\n"]


def test_lines_are_read_as_columns_are(spark):
    r = random.Random(11)
    made = ["", None, " ", *("".join(r.choice(GAPS + [""]) + r.choice(PARTS) for _ in range(r.randrange(1, 12))) + r.choice(["", " "]) for _ in range(4000))]
    v = F.col("line")
    x = spark.createDataFrame([(i, s) for i, s in enumerate(made)], "i int, line string").repartition(3)
    x = x.select("line", lines.classify_line(v).alias("a"), fx.classify_line(v).alias("b"), *[f(v, *k).alias(f"{n}{i}") for n, f in (("c", lines.repair_line), ("d", fx.repair_line)) for i, k in enumerate(KINDS)], fx.parseable(v).alias("ok"))
    n = 0
    for row in x.collect():
        assert row.a == row.b, repr(row.line)
        n += row.a is not None
        for i in range(len(KINDS)):
            c, d = row[f"c{i}"], row[f"d{i}"]
            assert (c.text, c.kind, c.changes) == (d.text, d.kind, d.changes), (repr(row.line), KINDS[i])
        assert row.c0.ok == (None if row.line is None else row.ok)
    assert n > 500


KINDS = (("data", True, False), ("data", True, True), ("all", False, True))


def test_no_nested_functions_in_the_plan(spark):
    """Lines go to the function as they are; only patterns of whole lines are the engine's."""
    from quern import queries

    for name in ("ocr_line_kind", "repair_edits", "repair_coverage", "char_hits"):
        shown = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "transform(" not in shown and shown.count("run(") == 1, name
