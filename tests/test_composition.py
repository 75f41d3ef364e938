from pyspark.sql import functions as F

from quern.functions import composition

MATCHES = [
    # spellings of one material
    ("ZnAlOx", "Zn-Al", True), ("Ni/ZnAlOx", "Ni/Zn-Al", True), ("Ni0.4Zn3Al1.1", "Ni-Zn-Al", True), ("c-Zn2Al1O", "Zn-Al", True), ("FeCo-PMO", "FeCo-Mg-Al", True),
    ("15% MgO/AC", "15% MgO/C", True), ("2% Ni/Zn-Al", "2 wt% Ni/Zn-Al", True), ("Zn3.05Al1", "Zn3Al1", True),
    # other supports, promoters, loadings, ratios, order
    ("Ni/Mg-Al", "Ni/Zn-Al", False), ("FeCo-PMO", "Fe-Mg-Al", False), ("5% MgO/C", "30% MgO/C", False), ("Zn1Al1O", "Zn4Al1O", False), ("FeCo-Mg-Al", "CoFe-Mg-Al", False),
    # names without elements are equal to each other, a ratio to zero to nothing, not even to itself
    ("sand", "glass", True), ("Zn1Al0", "Zn1Al0", False), (None, None, True), (None, "Zn-Al", False), ("", None, True),
]
CANONICAL = [
    ("Ni0.4Zn3Al1.1", "Ni-Zn-Al", "Ni-Zn-Al(3:1.1)"), ("Zn3Al1", "Zn-Al", "Zn-Al(3:1)"), ("15 wt% MgO/AC", "15% MgO/C", "15% MgO/C"), ("2% Ni/Zn-Al", "2% Ni-Zn-Al", "2% Ni-Zn-Al"),
    ("glass", "", ""), ("3% glass", "3% ", "3% "), ("Ni hydrotalcite", "Ni-Mg-Al", "Ni-Mg-Al"),
]


def test_matches(spark):
    df = spark.createDataFrame(MATCHES, "a string, b string, want boolean")
    got = df.select("a", "b", "want", composition.catalyst_match(F.col("a"), F.col("b")).alias("got")).collect()
    assert [(r.a, r.b, r.got) for r in got] == [(r.a, r.b, r.want) for r in got]


def test_canonical(spark):
    df = spark.createDataFrame(CANONICAL, "a string, plain string, ratio string")
    c = F.col("a")
    got = df.select("a", composition.canonical_catalyst(c).alias("plain"), composition.canonical_catalyst(c, True).alias("ratio")).collect()
    assert [tuple(r) for r in got] == CANONICAL


def test_struct(spark):
    c = spark.range(1).select(composition.parse_catalyst(F.lit(" 7% Ni/Mg2Al1O ")).alias("c")).first().c
    assert (c.loading, c.promoters, c.base, c.support, c.base_ratio, c.raw) == (7.0, ["ni"], ["mg", "al"], None, [2.0, 1.0], "7% Ni/Mg2Al1O")
