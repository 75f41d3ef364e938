import math

import pytest
from pyspark.sql import functions as F

from quern.functions import units

# One idea a line: conversions within a dimension, ranges against points, what isn't a number, and tolerances.
KINDS = [
    ("7 bar", "700 kPa", "pressure", "rel", 0.05, "exact"), ("3 atm", "304", "pressure", "rel", 0.05, "exact"), ("760 Torr", "1 ATM", "pressure", "rel", 0.05, "exact"),
    ("14.7 psi", "1 atm", "pressure", "rel", 0.05, "exact"), ("2 GPa", "2000 MPa", "pressure", "rel", 0.05, "exact"), ("500 Pa", "0.5 kPa", "pressure", "rel", 0.05, "exact"),
    ("4 bar", "4 atm", "pressure", "rel", 0.05, "exact"), ("4 bar", "5 atm", "pressure", "rel", 0.05, "miss"), ("9 stone", "9", "pressure", "rel", 0.05, "no_parse"),
    ("14.7 psig", "101.35", "pressure", "rel", 0.05, "exact"),
    ("27 C", "300", "temperature", "abs", 10.0, "exact"), ("80.33 F", "300", "temperature", "abs", 10.0, "exact"), ("400 kelvin", "405", "temperature", "abs", 10.0, "exact"),
    ("400", "450", "temperature", "abs", 10.0, "miss"), ("500", "480 – 520", "temperature", "abs", 10.0, "range"), ("470–530", "500", "temperature", "abs", 10.0, "range"),
    ("200", "480 — 520", "temperature", "abs", 10.0, "miss"), ("410 K - 420 K", "410", "temperature", "abs", 1.0, "exact"), ("88 ℃", "88", "temperature", "abs", 1.0, "exact"),
    ("12-18", "18", None, "abs", 2.0, "range"), ("12-18", "12 to 18", None, "abs", 2.0, "exact"), ("12 ~ 18", "12...18", None, "abs", 2.0, "exact"), ("12-18", "40", None, "abs", 2.0, "miss"),
    ("1", "2.5", None, "abs", 2.0, "exact"), ("6±2", "2-6", None, "rel", 0.05, "exact"), ("20,500", "20", None, "rel", 0.01, "exact"), ("40%-50%", "40", None, "abs", 0.5, "exact"),
    (" 3.25 ", "3.25", None, "rel", 0.01, "exact"), (".75", "0.75", None, "rel", 0.01, "exact"), ("2e2", "200", None, "rel", 0.01, "exact"), ("-4", "−4", None, "rel", 0.01, "exact"),
    ("2.0x", "2", None, "rel", 0.05, "exact"), ("0", "0", None, "rel", 0.05, "exact"), ("8", "8.5", None, "rel", 0.05, "miss"), ("8", "8.5", None, "rel", 0.1, "exact"), ("8 h-1", "8", None, "rel", 0.1, "exact"),
    ("ZnO", "2", None, "rel", 0.05, "no_parse"), ("none", "2", None, "rel", 0.05, "no_parse"), ("-", "2", None, "rel", 0.05, "no_parse"), (None, "2", None, "rel", 0.05, "no_parse"),
]


@pytest.mark.parametrize("dimension,mode,tol", sorted({(d, m, t) for _, _, d, m, t, _ in KINDS}, key=str))
def test_kinds(spark, dimension, mode, tol):
    own = [(p, t, k) for p, t, d, m, x, k in KINDS if (d, m, x) == (dimension, mode, tol)]
    df = spark.createDataFrame(own, "p string, t string, want string")
    got = df.select("p", "t", "want", units.values_match(F.col("p"), F.col("t"), dimension, mode, tol).alias("got")).collect()
    assert [(r.p, r.t, r.got) for r in got] == [(r.p, r.t, r.want) for r in got]


def test_structs_and_conversions(spark):
    df = spark.createDataFrame([("9 - 4 bar",), ("120 ℃",), (None,)], "x string")
    r = df.select(units.parse_quantity(F.col("x"), "pressure").alias("q")).collect()
    assert (r[0].q.lo, r[0].q.hi, r[0].q.unit, r[0].q.raw) == (400.0, 900.0, "bar", "9 - 4 bar") and r[2].q is None
    glyph = df.select(units.parse_quantity(F.col("x"), "temperature", degree_glyphs=True)["lo"].alias("k")).collect()
    assert glyph[1].k == pytest.approx(393.15)
    cells = spark.createDataFrame([("26.35",), ("27.35",), ("a-b",), ("",), (None,), (" 300 ",)], "x string")
    got = cells.select(units.celsius_cell(F.col("x")).alias("k"), units.atm_cell(F.col("x")).alias("p")).collect()
    assert [r.k for r in got] == [str(round(26.35 + 273.15)), str(round(27.35 + 273.15)), "a-b", "", "", "573"]
    assert got[5].p == f"{round(300 * 101.325)} kPa"
    assert math.isclose(cells.limit(1).select(units.to_kpa(F.lit("1 atm")).alias("v")).first().v, 101.325)
    assert cells.limit(1).select(units.to_kelvin(F.lit("25 - 30 C")).alias("v")).first().v == 298.15


def test_projected_parsing_is_the_same(spark):
    texts = sorted({x for k in KINDS for x in k[:2] if x is not None}) + [None, "", "x", "- 5", "1..3", "5 kPa\nx"]
    for dimension in (None, "pressure", "temperature"):
        df = spark.createDataFrame([(t,) for t in texts], "x string")
        got = units.with_quantities(df, {"q": (F.col("x"), dimension)}).select("q", units.parse_quantity(F.col("x"), dimension).alias("w")).collect()
        assert [r.q for r in got] == [r.w for r in got]
