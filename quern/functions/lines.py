"""Damage of lines and its repair as plain functions over a line: the twins of ``fidelity``.

A line's verdict needs its tokens several times over, which nested column functions interpret token by token.
Tokens and lines repeat, so what is known of a token is remembered, and a batch's distinct lines are read once.
``tests/test_lines.py`` holds the two against each other.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from . import fidelity as fx
from .text import NOT_WS

_TOKEN = re.compile(NOT_WS + "+")
_CLEAN, _SUSPECT, _SHAPE, _CPC, _IDENTIFIER, _PANEL, _INITIAL, _SUBSCRIPT = (
    re.compile(p, re.A) for p in (fx.CLEAN, fx.SUSPECT, fx.SHAPE, fx.CPC, fx.IDENTIFIER, fx.PANEL, fx.INITIAL, fx.SUBSCRIPT)
)
_ELEMENT = re.compile(f"{fx.ELEMENT_2}|{fx.ELEMENT_1}", re.A)
_ZERO, _HUNDREDS, _ONE = (re.compile(p, re.A) for p in (r"^0\d{1,4}$", r"^[1-9]\d{2}$", r"^\d{1,2}\.\d$"))
_WORDS = frozenset(fx.CHEMICAL + fx.LEXICAL)
_DIGITS = str.maketrans(fx.CONFUSED, fx.DIGITS)


# On ASCII alone these say what the engine's patterns say.
_FORMULA, _CITATION = re.compile(fx.FORMULA, re.A), [re.compile(p.replace("(?i)", ""), re.A | (re.I if p.startswith("(?i)") else 0)) for p in fx.CITATION]


class Token(NamedTuple):
    core: str
    clean: bool
    candidate: bool
    repaired: str
    panel: bool
    letters: bool


def _candidate(core: str) -> bool:
    if not _SUSPECT.search(core) or (len(core) == 1 and core != "O") or core.upper() in _WORDS or _CPC.search(core) or _INITIAL.search(core):
        return False
    if not re.search("[.,]", core) and len(re.findall("[0-9]", core)) >= 2 and _IDENTIFIER.search(core):
        return False
    return bool(_SHAPE.search(core) and _CLEAN.search(core.translate(_DIGITS)))


@lru_cache(100_000)
def token(raw: str) -> Token:
    core = raw.strip(fx.EDGES)
    return Token(core, bool(_CLEAN.search(core)), _candidate(core), core.translate(_DIGITS), bool(_PANEL.search(core)), not re.search("[0-9.,]", core))


def _in_formula(cores: list[str], i: int) -> bool:
    if i + 1 < len(cores) and _ELEMENT.search(cores[i + 1]):
        return True
    left = [c for c in reversed(cores[:i]) if c != ""][:4]
    stop = next((c for c in left if not _SUBSCRIPT.search(c)), None)
    return stop is not None and bool(_ELEMENT.search(stop))


def classify(line: str, tokens: list[str], said: tuple[bool, bool] | None) -> tuple[str, list[int]] | None:
    """kind and 0-based places of damaged tokens, or None. ``said``: whether the line has a formula and a citation,
    None for a line of ASCII, whose patterns are tried where it matters."""
    known = [token(t) for t in tokens]
    found = [i for i, k in enumerate(known) if k.candidate]
    if not found:
        return None
    n_clean = sum(k.clean for k in known)
    mass = n_clean + len(found)
    data = n_clean >= 1 and mass >= 3 and mass / len(tokens) >= 0.5
    formula = not data and (said[0] if said else bool(_FORMULA.search(line)))
    number = lambda j: 0 <= j < len(known) and (known[j].clean or known[j].candidate)
    cores = [k.core for k in known]

    def real(i: int) -> bool:
        if (not data and known[i].panel) or ("O" in cores[i] and _in_formula(cores, i)):
            return False
        if known[i].letters:
            return data and (number(i - 1) or number(i + 1))
        return not formula

    places = [i for i in found if real(i)]
    if not places:
        return None
    cited = said[1] if said else any(p.search(line) for p in _CITATION)
    return "CITATION" if cited else "DATA" if data else "PROSE", places


def _one_decimal(tokens: list[str], places: list[int]) -> bool:
    v = [token(t).core for i, t in enumerate(tokens) if i and i not in places and token(t).clean]

    def below(t: str) -> bool:
        try:
            return float(t.rstrip(".,;:%)")) < 100
        except ValueError:
            return False

    return len(v) >= 4 and all(map(below, v)) and sum(bool(_ONE.search(t)) for t in v) / len(v) >= 0.6


def verdict(line: str | None, said: tuple[bool, bool] | None) -> tuple | None:
    """kind, places, suspects, repaired."""
    tokens = _TOKEN.findall(line) if line is not None else []
    v = classify(line, tokens, said)
    return v and (*v, [tokens[i] for i in v[1]], [token(tokens[i]).repaired for i in v[1]])


def repair(line: str | None, said: tuple[bool, bool] | None, scope: str, use_d1: bool, use_d2: bool) -> tuple:
    """text, kind, changes, and the numbers of tokens, of those that a parser reads, and of those after the repair."""
    if line is None:
        return None, None, [], None, None, None
    tokens = _TOKEN.findall(line)
    v = classify(line, tokens, said)
    ok = sum([token(t).clean for t in tokens])
    if v is None or (scope == "data" and v[0] != "DATA"):
        return line, v and v[0], [], len(tokens), ok, ok
    places = v[1]
    agreed = use_d2 and _one_decimal(tokens, places)
    new, changes = list(tokens), []
    for i in places:
        raw = tokens[i]
        core, t1 = token(raw).core, token(raw).repaired
        fixed, tier = t1, "T1"
        if use_d1 and _ZERO.search(t1):
            fixed, tier = f"0.{t1[1:]}", "D1"
        elif agreed and i and _HUNDREDS.search(t1):
            fixed, tier = f"{t1[:2]}.{t1[2]}", "D2"
        if fixed != core:
            at = raw.index(core)
            new[i] = raw[:at] + fixed + raw[at + len(core) :]
            changes.append({"place": i, "before": raw, "after": new[i], "tier": tier})
    if not changes:
        return line, v[0], changes, len(tokens), ok, ok
    text = "".join([g + t for g, t in zip(_TOKEN.split(line), [*new, ""], strict=True)])
    return text, v[0], changes, len(tokens), ok, sum([token(t).clean for t in _TOKEN.findall(text)])


# ── As columns ───────────────────────────────────────────────────────────────

VERDICT = "struct<kind:string,places:array<int>,suspects:array<string>,repaired:array<string>>"
REPAIR = "struct<text:string,kind:string,changes:array<struct<place:int,before:string,after:string,tier:string>>,n:int,ok:int,ok_after:int>"


def _column(f: Callable, kind: str, line: Column) -> Column:
    """``f`` of the distinct lines of a batch. Of a line that isn't ASCII, what its patterns say comes from the engine's own."""
    made = to_arrow_type(DataType.fromDDL(kind))

    def run(lines: pa.Array, formula: pa.Array, cited: pa.Array) -> pa.Array:
        coded = lines.dictionary_encode(null_encoding="encode")
        own, at = coded.dictionary.to_pylist(), coded.indices
        said = {}
        if formula.null_count < len(formula):
            said = {i: (a, b) for i, a, b in zip(at.to_pylist(), formula.to_pylist(), cited.to_pylist(), strict=True) if a is not None}
        found = [f(v, said.get(i)) for i, v in enumerate(own)]
        none = (None,) * made.num_fields
        columns = zip(*[none if r is None else r for r in found], strict=True) if found else [()] * made.num_fields
        arrays = [pa.array(c, made.field(i).type) for i, c in enumerate(columns)]
        out = pa.StructArray.from_arrays(arrays, fields=list(made), mask=pa.array([r is None for r in found], pa.bool_()))
        return out if len(own) == len(lines) else out.take(at)

    wide = lambda c: F.when(line.rlike(r"[^\x00-\x7F]"), line.rlike(fx.WORTH) & c)
    # Taken for one that must not be called again, or it would be for each filter on what it gives.
    return F.arrow_udf(run, kind).asNondeterministic()(line, wide(line.rlike(fx.FORMULA)), wide(fx.is_citation(line)))


def classify_line(line: Column) -> Column:
    """As ``fidelity.classify_line``."""
    return _column(verdict, VERDICT, line)


def repair_line(line: Column, scope: str = "data", use_d1: bool = True, use_d2: bool = False) -> Column:
    """As ``fidelity.repair_line``, and the numbers of tokens, of those that a parser reads, and of those after the repair."""
    return _column(lambda v, said: repair(v, said, scope, use_d1, use_d2), REPAIR, line)
