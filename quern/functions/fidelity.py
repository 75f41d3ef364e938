"""Digit/letter confusion in scanned numbers: which tokens of a line are damaged, and their repair.

A line is a string column; its verdict and its repair are structs. Tokens are handled by
higher-order functions over the line's own array, so nothing is exploded or shuffled.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import NOT_WS, WS, let, words

# The confusion model, words that are no numbers, and the shapes of tokens.
CONFUSED, DIGITS = "OSlIBG", "051186"
EDGES = "(),;:*[]‘’“”\"'"
CHEMICAL = (
    "SO", "SO2", "SO3", "SO4", "SOX", "SO42-", "SO3H", "OS", "OSO4", "OSO2", "B2O3", "BO3", "BO2", "BO", "B2O", "GO", "IO", "IO3", "IO4",
    "IO4-", "OB", "BS", "SB", "BI", "GI", "OI", "IB", "SI", "IS", "OG", "GS", "SG", "O2", "O3",
)
LEXICAL = ("ISO", "SOS", "BOB", "GOB", "SOB", "BIOS", "GIS", "SIB", "OBI", "IBS", "BOS", "SIS", "GIG", "BIG", "LOGS", "GOSS", "BOSS", "II", "III", "IV", "OO")
CLEAN = r"^[-+(]?\d{1,6}(?:[.,]\d{1,6})?[)%]?[.,;:]?$"
SUSPECT = rf"^[0-9{CONFUSED}.,%()\-+/±–—:;*]*[{CONFUSED}][0-9{CONFUSED}.,%()\-+/±–—:;*]*$"  # shaped like a number, with a letter
SHAPE = r"^[0-9OSlIBG.,%()\-+/±–—:;*]+$"
CPC = r"^[A-H][O0oQ][\dOSlIB][A-Z]?\.?$"
IDENTIFIER = r"^[A-Za-z][\dOSlIBG]*\d[\dOSlIBG]*$"
PANEL = r"^\(?\d+[A-Z]\)?[.,;]?$"
INITIAL = r"^[A-Za-z]\.[;,]?$"
FORMULA = r"[A-Z][a-z]?\d|\([A-Z][a-z]?[A-Z]?\)\d?|\bH2O\b|\bwt\s?%"
CITATION = (
    r"\b(?:US|EP|WO|JP|CN|DE|FR|GB|KR|CA|AU|RU|TW)\s?[\dOSlIBG]{2}[\dOSlIBG,/\s\-]{3,}",
    r"\b[AB][12]\b",
    r"(?i)\b(?:patent|publication|application|appl|pub\.|ser\.|no\.)",
    r"(?i)\b(?:et\s?al|cited by|references|bibliograph|sheet\s+\d)",
    r"\b\d{1,2}/\d{3},?\s?\d{3}\b",
    r"(?i)\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\.?\s+\d{1,2},\s*(?:19|20)\d{2}",
    r"\(20[\dOSlIB]{2}\.[\dOSlIB]{2}\)",
    r"(?i)\b(?:int\.?\s*cl|u\.?s\.?\s*cl|classification|cpc\b|ipc\b)",
)
TWO_LETTER = (
    "Mg", "Al", "Ca", "Zn", "Ti", "Si", "Zr", "Cu", "Ni", "Co", "La", "Ba", "Sr", "Fe", "Mn", "Cr", "Cs", "Rb", "Pd", "Pt", "Ru", "Rh", "Ag", "Sn",
    "Ce", "Nb", "Mo", "Hf", "Ta", "Li", "Be", "Na", "Cl", "Br", "Sc", "Ga", "Ge", "Se", "In", "Sb", "Te", "Cd", "Ir", "Au", "Pb", "Bi", "Th", "Yb",
    "Er", "Nd", "Sm", "Eu", "Gd", "Pr", "Ho", "Tm", "Lu", "Re", "Os", "Tl", "Hg", "As", "Ar", "Ne", "He", "Kr", "Xe", "Ac", "Pa", "Np", "Pu",
)
# A token somewhere on the line that may be a candidate; most lines of prose end here.
MARK = f"[{re.escape(EDGES)}]"
WORTH = rf"(?:^|{WS}){MARK}*+[0-9{CONFUSED}.,%()\-+/±–—:;*]*[{CONFUSED}][0-9{CONFUSED}.,%()\-+/±–—:;*]*{MARK}*(?:{WS}|$)"
BOUNDARY = r"[\d\-()·•/,\.]"
ELEMENT_2 = rf"(?:^|{BOUNDARY}|[A-Z])(?:{'|'.join(TWO_LETTER)})(?=$|{BOUNDARY}|[A-Z])"
ELEMENT_1 = rf"(?:^|{BOUNDARY})[KPCNHFVWYU](?=$|{BOUNDARY}|[A-Z])"
SUBSCRIPT = r"^(?:0?\d|1\d|20)$"  # integers up to 20 of one or two digits


def repair_chars(c: Column) -> Column:
    return F.translate(c, CONFUSED, DIGITS)


def strip_edges(c: Column) -> Column:
    return F.btrim(c, F.lit(EDGES))


def is_clean_number(token: Column) -> Column:
    return strip_edges(token).rlike(CLEAN)


def shape_ok(core: Column) -> Column:
    return core.rlike(SHAPE)


def is_identifier(core: Column) -> Column:
    """A run or sample name: a letter, two digits or more, no separator."""
    return ~core.rlike("[.,]") & (F.regexp_count(core, F.lit(r"\d")) >= 2) & core.rlike(IDENTIFIER)


def has_element(core: Column) -> Column:
    return core.rlike(ELEMENT_2) | core.rlike(ELEMENT_1)


def needs_context(core: Column) -> Column:
    return ~core.rlike(r"[0-9.,]")


def is_candidate(core: Column) -> Column:
    """Looks like a number whose letters are misread digits."""
    return (
        (core != "")
        & ((F.length(core) > 1) | (core == "O"))
        & ~F.upper(core).isin(*CHEMICAL, *LEXICAL)
        & ~core.rlike(CPC)
        & ~is_identifier(core)
        & ~core.rlike(INITIAL)
        & core.rlike(f"[{CONFUSED}]")
        & shape_ok(core)
        & repair_chars(core).rlike(CLEAN)
    )


def candidates(cores: Column) -> Column:
    """0-based places of candidate tokens."""
    marked = F.transform(cores, lambda c, i: F.when(c.rlike(SUSPECT) & is_candidate(c), i))
    return F.filter(marked, lambda i: i.isNotNull())


def in_formula(cores: Column, i: Column) -> Column:
    """Whether an O at place ``i`` is oxygen: an element stands to its right, or to its left with
    at most three subscripts between."""
    right = F.coalesce(has_element(F.get(cores, i + 1)), F.lit(False))
    left = F.reverse(F.filter(F.slice(cores, F.lit(1), i), lambda c: c != ""))
    stop = F.get(F.filter(F.slice(left, 1, 4), lambda c: ~c.rlike(SUBSCRIPT)), F.lit(0))
    return right | F.coalesce(has_element(stop), F.lit(False))


def is_citation(line: Column) -> Column:
    out = F.lit(False)
    for pattern in CITATION:
        out = out | line.rlike(pattern)
    return out


def classify_line(line: Column) -> Column:
    """struct (kind, places, suspects, repaired) or null where nothing on the line is damaged.

    kind is DATA, CITATION or PROSE. places are the damaged tokens' 0-based places.
    """

    def read(tokens: Column) -> Column:
        return let(F.struct(tokens.alias("tokens"), F.transform(tokens, strip_edges).alias("cores")), found)

    def found(x: Column) -> Column:
        return let(F.struct(x["tokens"].alias("tokens"), x["cores"].alias("cores"), candidates(x["cores"]).alias("found")), counted)

    def counted(x: Column) -> Column:
        clean = F.transform(x["cores"], lambda c: c.rlike(CLEAN))
        y = F.struct(x["tokens"].alias("tokens"), x["cores"].alias("cores"), x["found"].alias("found"), clean.alias("clean"))
        return F.when(F.size(x["found"]) > 0, let(y, weighed))

    def weighed(x: Column) -> Column:
        n_clean = F.size(F.filter(x["clean"], lambda c: c))
        mass = n_clean + F.size(x["found"])
        data = (n_clean >= 1) & (mass >= 3) & (mass / F.size(x["tokens"]) >= 0.5)
        return let(F.struct(x.alias("x"), data.alias("data"), (line.rlike(FORMULA) & ~data).alias("formula")), confirmed)

    def confirmed(y: Column) -> Column:
        x = y["x"]
        number = lambda j: F.coalesce(F.get(x["clean"], j), F.lit(False)) | F.array_contains(x["found"], j)

        def real(i: Column) -> Column:
            core = F.get(x["cores"], i)
            label = ~y["data"] & core.rlike(PANEL)
            oxygen = core.contains("O") & in_formula(x["cores"], i)
            beside = y["data"] & (((i > 0) & number(i - 1)) | number(i + 1))
            return ~label & ~oxygen & F.when(needs_context(core), beside).otherwise(~y["formula"])

        return let(F.struct(y.alias("y"), F.filter(x["found"], real).alias("places")), verdict)

    def verdict(z: Column) -> Column:
        y, places = z["y"], z["places"]
        kind = F.when(is_citation(line), F.lit("CITATION")).when(y["data"], F.lit("DATA")).otherwise(F.lit("PROSE"))
        out = F.struct(
            kind.alias("kind"),
            places.alias("places"),
            F.transform(places, lambda i: F.get(y["x"]["tokens"], i)).alias("suspects"),
            F.transform(places, lambda i: repair_chars(F.get(y["x"]["cores"], i))).alias("repaired"),
        )
        return F.when(F.size(places) > 0, out)

    return F.when(line.rlike(WORTH), let(words(line), read))


def leading_zero(repaired: Column) -> Column:
    """``0ddd`` as ``0.ddd``; null where that doesn't apply."""
    return F.when(repaired.rlike(r"^0\d{1,4}$"), F.regexp_replace(repaired, r"^0(\d{1,4})$", "0.$1"))


def one_decimal_row(tokens: Column, places: Column) -> Column:
    """Whether the row's sound numbers (its label and damaged ones aside) show one decimal each."""
    ok = F.filter(tokens, lambda t, i: (i != 0) & ~F.array_contains(places, i) & is_clean_number(t))

    def judged(v: Column) -> Column:
        below = F.forall(v, lambda t: F.coalesce(F.regexp_replace(t, r"[.,;:%)]+$", "").try_cast("double") < 100, F.lit(False)))
        ones = F.size(F.filter(v, lambda t: t.rlike(r"^\d{1,2}\.\d$")))
        return (F.size(v) >= 4) & below & (ones / F.size(v) >= 0.6)

    return F.coalesce(let(F.transform(ok, strip_edges), judged), F.lit(False))


def by_consensus(repaired: Column, place: Column, consensus: Column) -> Column:
    """``ddd`` as ``dd.d`` in a row of one-decimal numbers; never its label."""
    fits = (place != 0) & repaired.rlike(r"^[1-9]\d{2}$") & consensus
    return F.when(fits, F.concat(F.substring(repaired, 1, 2), F.lit("."), F.substring(repaired, 3, 1)))


def repair_line(line: Column, scope: str = "data", use_d1: bool = True, use_d2: bool = False) -> Column:
    """struct (text, kind, changes): the line with damaged tokens repaired in place, spacing kept;
    changes hold place, before, after and tier (T1 characters, D1 leading zero, D2 consensus)."""

    none = F.expr("cast(array() as array<struct<place:int,before:string,after:string,tier:string>>)")

    def fix(x: Column) -> Column:
        v, tokens = x["verdict"], x["tokens"]

        def change(i: Column) -> Column:
            raw = F.get(tokens, i)
            core = strip_edges(raw)
            t1 = repair_chars(core)
            d1 = leading_zero(t1) if use_d1 else F.lit(None).cast("string")
            d2 = by_consensus(t1, i, x["consensus"]) if use_d2 else F.lit(None).cast("string")
            fixed = F.coalesce(d1, d2, t1)
            at = F.position(core, raw)
            after = F.concat(F.substring(raw, F.lit(1), at - 1), fixed, raw.substr(at + F.length(core), F.length(raw)))
            tier = F.when(d1.isNotNull(), F.lit("D1")).when(d2.isNotNull(), F.lit("D2")).otherwise(F.lit("T1"))
            return F.struct(i.alias("place"), raw.alias("before"), after.alias("after"), tier.alias("tier"), (fixed != core).alias("new"))

        changes = F.filter(F.transform(v["places"], change), lambda c: c["new"])
        return let(F.struct(x.alias("x"), changes.alias("changes")), rebuilt)

    def rebuilt(y: Column) -> Column:
        x, changes = y["x"], y["changes"]
        gaps = F.split(line, NOT_WS + "+", -1)  # one more than there are tokens
        new = F.transform(x["tokens"], lambda t, i: F.coalesce(F.get(F.filter(changes, lambda c: c["place"] == i), F.lit(0))["after"], t))
        parts = F.zip_with(gaps, new, lambda g, t: F.concat(g, F.coalesce(t, F.lit(""))))
        text = F.when(F.size(changes) > 0, F.array_join(parts, "")).otherwise(line)
        shown = F.transform(changes, lambda c: F.struct(c["place"].alias("place"), c["before"].alias("before"), c["after"].alias("after"), c["tier"].alias("tier")))
        return F.struct(text.alias("text"), x["verdict"]["kind"].alias("kind"), shown.alias("changes"))

    def start(verdict: Column) -> Column:
        untouched = F.struct(line.alias("text"), verdict["kind"].alias("kind"), none.alias("changes"))
        wanted = verdict.isNotNull() & (F.lit(scope != "data") | (verdict["kind"] == "DATA"))
        return F.when(wanted, let(F.struct(words(line).alias("tokens"), verdict.alias("verdict")), agreed)).otherwise(untouched)

    def agreed(x: Column) -> Column:
        same = one_decimal_row(x["tokens"], x["verdict"]["places"]) if use_d2 else F.lit(False)
        return let(F.struct(x["tokens"].alias("tokens"), x["verdict"].alias("verdict"), same.alias("consensus")), fix)

    return let(classify_line(line), start)


def parseable(line: Column) -> Column:
    """Tokens of a line that a parser reads as numbers."""
    return F.size(F.filter(words(line), is_clean_number))


def num_eq(a: Column, b: Column) -> Column:
    """Equal as numbers, trailing punctuation of ``a`` aside; else equal as text."""
    x, y = F.regexp_replace(a, r"[.,;:%)]+$", "").try_cast("double"), b.try_cast("double")
    return F.when(x.isNotNull() & y.isNotNull(), F.abs(x - y) < 1e-9).otherwise(a == b)


def changed_positions(before: Column, after: Column) -> Column:
    """1-based places at which two strings differ, over the shorter one."""
    n = F.least(F.length(before), F.length(after))
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.expr("cast(array() as array<int>)"))
    return F.filter(places, lambda i: before.substr(i, F.lit(1)) != after.substr(i, F.lit(1)))
