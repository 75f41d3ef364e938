"""What comparisons need of a written value, as plain functions: the twins of ``text``, ``units`` and ``composition``.

Values of records repeat, so a batch's distinct values are read once each, here, and rows carry numbers that stand
for them. The column functions give the same for every text; ``tests/test_cells.py`` holds them against each other.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import composition as comp
from . import units
from .text import DASHES, NOT_WS, NULL_CELL, NULL_COMPARED, WS, WS_CHARS

_WRITTEN = re.compile(units.WRITTEN.replace("(?di)", ""), re.I | re.A)
_DASHES = str.maketrans(DASHES, "-" * len(DASHES))
_FIRST = re.compile(rf"^({NOT_WS}+)")
_NOISE = re.compile(units.UNIT_NOISE)
# A cast to double passes over line ends that a pattern's end does.
_PLAIN = re.compile(rf"^({units.NUMBER})(?:\r\n|[\n\r])?\Z", re.A)


def is_null(v: str | None) -> bool:
    return v is None or v.strip(WS_CHARS).lower() in NULL_CELL


def normalised(v: str | None) -> str | None:
    if v is None or v.lower() in NULL_COMPARED:
        return None
    s = v.strip(WS_CHARS).lower().replace(" ", "").replace(",", ".")
    return s.replace("/ac", "/c").replace("mgo/ac", "mgo/c")


def plain_number(norm: str | None) -> float | None:
    m = _PLAIN.match(norm.rstrip("%")) if norm is not None else None
    return float(m[1]) if m else None


def _converted(value: float, unit: str, dimension: str | None) -> float | None:
    if dimension is None or unit == "":
        return value
    if dimension == "pressure":
        return value * units.KPA[unit] if unit in units.KPA else None
    if unit in units.CELSIUS:
        return value + 273.15
    if unit in units.FAHRENHEIT:
        return (value - 32.0) * 5.0 / 9.0 + 273.15
    return value if unit in units.KELVIN else None


def quantity(v: str | None, dimension: str | None) -> tuple[float, float] | None:
    """The low and the high end, in the dimension's unit."""
    m = _WRITTEN.match(v.strip(WS_CHARS).translate(_DASHES)) if v is not None else None
    if not m or "\x01" in m[4]:
        return None
    low, high = (m[3], m[3]) if m[3] else (m[1], m[2])
    unit = ""
    if dimension is not None:
        first = _FIRST.match(m[4].strip(WS_CHARS))
        unit = _NOISE.sub("", first[1].lower()).strip("%") if first else ""
    a, b = (_converted(float(x), unit, dimension) for x in (low, high))
    return None if a is None or b is None else (min(a, b), max(a, b))


# ── Compositions ─────────────────────────────────────────────────────────────

_RATIO = re.compile(comp.RATIO_PREFIX, re.A)
_BRACKETS = re.compile(comp.BRACKETS.replace("(?d)", ""))
_NOUN = re.compile(comp.NOUN.replace("(?i)", ""), re.I | re.A)
_LOADING = re.compile(comp.LOADING.replace("(?i)", ""), re.I | re.A)
_PHASE = re.compile(comp.PHASE.replace("(?iu)", ""), re.I)
_SQUASHED = re.compile(rf"[\-_]|{WS}")
_ELEMENT = re.compile(comp.ELEMENT, re.A)
_FAMILY = [re.compile(rf"\b{f}\b", re.I) for f in comp.FAMILIES]


def _elements(s: str) -> list[tuple[str, float | None]]:
    return [(e.lower(), float(n) if n else None) for e, n in _ELEMENT.findall(s)]


def _more(have: list[str], symbols: list[str]) -> list[str]:
    return have + list(dict.fromkeys(e for e in symbols if e in comp.PROMOTERS and e not in have))


def parse_catalyst(name: str | None) -> tuple | None:
    """loading, promoters, base, support, base_ratio."""
    if name is None or not (raw := name.strip(WS_CHARS)):
        return None
    s = _BRACKETS.sub("", _RATIO.sub("", raw)).strip(WS_CHARS)
    s = _NOUN.sub("", s)
    m = _LOADING.match(s)
    loading = float(m[1]) if m else None
    s = _PHASE.sub("", _LOADING.sub("", s)).strip(WS_CHARS)
    left, slash, right = (x.strip(WS_CHARS) for x in s.partition("/"))
    carbon = bool(slash) and _SQUASHED.sub("", right).lower() in comp.CARBON
    lead = [e for e, _ in _elements(left)]
    decorated = bool(slash) and not carbon and bool(lead) and all(e in comp.PROMOTERS for e in lead)
    first = lead if decorated else []
    stem = s if not slash else left if carbon else right
    at = next((m for f in _FAMILY if (m := f.search(stem))), None)
    found = [(e, n) for e, n in _elements(stem.replace("-", "").replace(" ", "")) if e not in comp.OXIDES]
    rest = [(e, n) for e, n in found if e not in comp.PROMOTERS]
    symbols, numbers = [e for e, _ in rest], [n for _, n in rest]
    system = tuple(symbols) in comp.BASE_SYSTEMS
    active = not system and carbon and bool(rest)
    if at:
        promoters = _more(first, [e for e, _ in _elements(stem[: at.start()])])
    else:
        promoters = symbols if active else _more(first, [e for e, _ in found])
    base = ["mg", "al"] if at else symbols if rest and not active else None
    ratio = numbers if not at and system and all(n is not None for n in numbers) else None
    return loading, promoters, base, "c" if carbon else None, ratio


def _shown(x: float) -> str:
    """A number as Spark writes it, without its fraction where that is zero."""
    if abs(x) < 2.0**63 and x == math.floor(x):
        return str(int(x))
    if math.isinf(x):
        return "Infinity"
    if 1e-3 <= abs(x) < 1e7:
        return repr(x)
    _, figures, exponent = Decimal(repr(x)).as_tuple()
    digits = "".join(map(str, figures)).rstrip("0") or "0"
    return f"{digits[0]}.{digits[1:] or '0'}E{len(figures) + exponent - 1}"


def _caps(symbols: list[str]) -> list[str]:
    return [e[:1].upper() + e[1:] for e in symbols]


def canonical(c: tuple | None) -> str | None:
    if c is None:
        return None
    loading, promoters, base, support, _ = c
    metals = "".join(_caps(promoters))
    if base is not None:
        stem = "-".join(([metals] if metals else []) + ["-".join(_caps(base))])
    else:
        stem = f"{metals or 'Mg'}O/C" if support else metals
    return (f"{_shown(loading)}% " if loading is not None else "") + stem


def comparable(name: str | None) -> tuple[str, bool, float | None] | None:
    """One spelling, whether a ratio is stated, and the ratio."""
    c = parse_catalyst(name)
    if c is None:
        return None
    ratio = c[4]
    return canonical(c), ratio is not None, ratio[0] / ratio[1] if ratio and ratio[1] else None


# ── As columns ───────────────────────────────────────────────────────────────


def _of_distinct(f: Callable, *columns: pd.Series) -> pd.Series:
    """``f`` of a batch's rows, called once for each distinct one."""
    rows = list(zip(*columns, strict=True)) if len(columns) > 1 else [(v,) for v in columns[0]]
    known = {r: f(*r) for r in set(rows)}
    return pd.Series([known[r] for r in rows], dtype=object)


def canonical_catalyst(name: Column) -> Column:
    """As ``composition.canonical_catalyst``, a distinct name of a batch being read once."""
    return F.pandas_udf(lambda s: _of_distinct(lambda v: canonical(parse_catalyst(v)), s.where(s.notna(), None)), "string")(name)


def same_material(a: str | None, b: str | None) -> bool:
    x, y = comparable(a), comparable(b)
    if x is None or y is None:
        return x is y
    if x[0] != y[0] or not (x[1] and y[1]):
        return x[0] == y[0]
    return x[2] is not None and y[2] is not None and abs(x[2] - y[2]) / max(y[2], 1e-9) <= 0.05


def catalyst_match(a: Column, b: Column) -> Column:
    """As ``composition.catalyst_match``, a distinct pair of a batch being compared once."""
    return F.pandas_udf(lambda s, t: _of_distinct(same_material, s.where(s.notna(), None), t.where(t.notna(), None)), "boolean")(a, b)
