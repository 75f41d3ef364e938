"""Written quantities as closed intervals in canonical units, and their comparison.

A quantity is a struct (lo, hi, unit, dimension, raw) or null where the text isn't comparable as a
number. Everything is Catalyst expressions. Parse a cell once, before rows are paired.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import DASHES, NOT_WS, WS, let, quoted, strip

# The number grammar, range separators and units.
NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
WRITTEN = rf"(?di)^(?:({NUMBER}){WS}*(?:-|to|~|±|\.\.\.|\.\.){WS}*({NUMBER})|({NUMBER})){WS}*(.*)$"
UNIT_NOISE = rf"[°º∘˚℃℉._]|{WS}"
KPA = {
    "pa": 1e-3, "hpa": 0.1, "kpa": 1.0, "mpa": 1e3, "gpa": 1e6, "bar": 100.0, "mbar": 0.1, "atm": 101.325,
    "torr": 101.325 / 760.0, "mmhg": 101.325 / 760.0, "psi": 6.894757, "psia": 6.894757, "psig": 6.894757,
}
KELVIN = ("k", "degk", "kelvin")
CELSIUS = ("c", "degc", "celsius", "centigrade")
FAHRENHEIT = ("f", "degf", "fahrenheit")

QUANTITY = "struct<lo:double,hi:double,unit:string,dimension:string,raw:string>"


def squash_unit(c: Column) -> Column:
    return F.regexp_replace(F.lower(strip(c)), UNIT_NOISE, "")


def convert(value: Column, unit: Column, dimension: str | None, glyph: Column | None = None) -> Column:
    """``value`` written in ``unit`` (squashed) in the dimension's unit; null if the unit is unknown."""
    if dimension == "pressure":
        factors = F.create_map(*[F.lit(x) for pair in KPA.items() for x in pair])
        return F.when(unit == "", value).otherwise(value * F.try_element_at(factors, unit))
    if dimension == "temperature":
        celsius, fahrenheit = unit.isin(*CELSIUS), unit.isin(*FAHRENHEIT)
        if glyph is not None:  # the one-character degree signs, which squashing removes
            celsius, fahrenheit = celsius | glyph.contains("℃"), fahrenheit | glyph.contains("℉")
        out = F.when(celsius, value + 273.15).when(fahrenheit, (value - 32.0) * 5.0 / 9.0 + 273.15)
        return out.when((unit == "") | unit.isin(*KELVIN), value)
    return value


def parse_quantity(text: Column, dimension: str | None = None, degree_glyphs: bool = False) -> Column:
    """The quantity in ``text``. ``degree_glyphs`` reads the signs for degrees Celsius and Fahrenheit
    that are one character; by default they are dropped and the number is taken for kelvins."""
    def from_parts(s: Column) -> Column:
        # One match gives low end, high end, single number and tail, parted by a control character.
        parts = F.split(F.regexp_replace(s, WRITTEN, "$1\x01$2\x01$3\x01$4"), "\x01", -1)
        return let(parts, numbers)

    def numbers(m: Column) -> Column:
        one = F.get(m, F.lit(2))
        low, high = F.when(one != "", one).otherwise(F.get(m, F.lit(0))), F.when(one != "", one).otherwise(F.get(m, F.lit(1)))
        parts = F.struct(low.try_cast("double").alias("a"), high.try_cast("double").alias("b"), strip(F.get(m, F.lit(3))).alias("tail"))
        return F.when(F.size(m) == 4, let(parts, with_unit))  # words for nothing have no number

    def with_unit(x: Column) -> Column:
        if dimension is None:
            return finished(x)
        first = F.regexp_extract(x["tail"], rf"^({NOT_WS}+)", 1)
        unit = F.btrim(squash_unit(first), F.lit("%"))
        return let(F.struct(x.alias("x"), first.alias("first"), unit.alias("unit")), converted)

    def converted(y: Column) -> Column:
        x, glyph = y["x"], y["first"] if degree_glyphs else None
        a, b = convert(x["a"], y["unit"], dimension, glyph), convert(x["b"], y["unit"], dimension, glyph)
        return let(F.struct(a.alias("a"), b.alias("b"), x["tail"].alias("tail")), finished)

    def finished(z: Column) -> Column:
        q = F.struct(
            F.least(z["a"], z["b"]).alias("lo"),
            F.greatest(z["a"], z["b"]).alias("hi"),
            F.when(z["tail"] != "", z["tail"]).alias("unit"),
            F.lit(dimension).cast("string").alias("dimension"),
            text.alias("raw"),
        )
        return F.when(z["a"].isNotNull() & z["b"].isNotNull(), q)

    return F.when(text.isNotNull(), let(F.translate(strip(text), DASHES, "-" * len(DASHES)), from_parts))


def with_quantities(df: DataFrame, columns: dict[str, tuple[Column, str | None]]) -> DataFrame:
    """Add quantity columns, name -> (text, dimension). The steps of ``parse_quantity`` as
    projections, so that wide tables are parsed in generated code."""
    m, x, u = (lambda n, k=k: f"{n}__{k}" for k in "mxu")
    df = df.withColumns({m(n): F.split(F.regexp_replace(F.translate(strip(c), DASHES, "-" * len(DASHES)), WRITTEN, "$1\x01$2\x01$3\x01$4"), "\x01", -1) for n, (c, _) in columns.items()})
    part = lambda n, k: F.get(F.col(quoted(m(n))), F.lit(k))
    end = lambda n, k: F.when(part(n, 2) != "", part(n, 2)).otherwise(part(n, k)).try_cast("double")
    df = df.withColumns({x(n): F.struct(end(n, 0).alias("a"), end(n, 1).alias("b"), strip(part(n, 3)).alias("tail")) for n in columns})
    field = lambda n, k: F.col(quoted(x(n)))[k]
    unit = lambda n: F.btrim(squash_unit(F.regexp_extract(field(n, "tail"), rf"^({NOT_WS}+)", 1)), F.lit("%"))
    df = df.withColumns({u(n): unit(n) for n, (_, d) in columns.items() if d})
    made = {}
    for n, (c, d) in columns.items():
        a, b = (convert(field(n, k), F.col(quoted(u(n))) if d else F.lit(""), d) for k in "ab")
        ok = (F.size(F.col(quoted(m(n)))) == 4) & a.isNotNull() & b.isNotNull()
        tail = F.when(field(n, "tail") != "", field(n, "tail"))
        made[n] = F.when(ok, F.struct(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"), tail.alias("unit"), F.lit(d).cast("string").alias("dimension"), c.alias("raw")))
    return df.withColumns(made).drop(*[k(n) for n in columns for k in (m, x, u)])


def to_kpa(text: Column) -> Column:
    return parse_quantity(text, "pressure")["lo"]


def to_kelvin(text: Column) -> Column:
    return parse_quantity(text, "temperature")["lo"]


def pad(lo: Column, hi: Column, mode: Column, tol: Column) -> Column:
    """How far a value may be off: ``tol`` itself, or that share of the larger end."""
    return F.when(mode == "abs", tol).otherwise(tol * F.greatest(F.abs(lo), F.abs(hi), F.lit(1e-9)))


def close(value: Column, reference: Column, mode: Column, tol: Column) -> Column:
    return F.abs(value - reference) <= pad(reference, reference, mode, tol)


def quantity_kind(pred: Column, truth: Column, mode: Column, tol: Column) -> Column:
    """``exact``, ``range`` (a point in an interval), ``miss``, or ``no_parse``."""
    p_range, t_range = pred["lo"] != pred["hi"], truth["lo"] != truth["hi"]
    said = lambda ok, word: F.when(ok, F.lit(word)).otherwise(F.lit("miss"))
    ends = close(pred["lo"], truth["lo"], mode, tol) & close(pred["hi"], truth["hi"], mode, tol)
    inside = lambda r, x: (x["lo"] >= r["lo"] - pad(r["lo"], r["hi"], mode, tol)) & (x["lo"] <= r["hi"] + pad(r["lo"], r["hi"], mode, tol))
    return (
        F.when(pred.isNull() | truth.isNull(), F.lit("no_parse"))
        .when(p_range & t_range, said(ends, "exact"))
        .when(~p_range & ~t_range, said(close(pred["lo"], truth["lo"], mode, tol), "exact"))
        .when(p_range, said(inside(pred, truth), "range"))
        .otherwise(said(inside(truth, pred), "range"))
    )


def values_match(pred: Column, truth: Column, dimension: str | None = None, mode: str = "rel", tol: float = 0.05) -> Column:
    both = F.struct(parse_quantity(pred, dimension).alias("p"), parse_quantity(truth, dimension).alias("t"))
    return let(both, lambda x: quantity_kind(x["p"], x["t"], F.lit(mode), F.lit(tol)))


def whole_or_decimal(x: Column) -> Column:
    """A number without its fraction where that is zero."""
    return F.when(x == F.floor(x), F.floor(x).cast("bigint").cast("string")).otherwise(x.cast("string"))


def _rounded(text: Column, value: Column, suffix: str) -> Column:
    """Half to even, as the reference tables were made; words stay as they are."""
    s = strip(text)
    number = F.when(s.rlike(rf"^{NUMBER}$"), s.try_cast("double"))
    done = F.concat(F.bround(value(number), 0).cast("bigint").cast("string"), F.lit(suffix))
    return F.when(text.isNull() | (s == ""), F.lit("")).when(number.isNull(), s).otherwise(done)


def celsius_cell(text: Column) -> Column:
    return _rounded(text, lambda n: n + 273.15, "")


def atm_cell(text: Column) -> Column:
    return _rounded(text, lambda n: n * 101.325, " kPa")
