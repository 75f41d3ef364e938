"""Catalyst names as compositions: loading, promoters, base, support and base ratio.

``parse_catalyst`` gives a struct; all steps are Catalyst expressions over the name, so a name
is parsed once per row, before rows are paired.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, let, strip
from .units import whole_or_decimal

# Element roles, aliases and the patterns of names.
PROMOTERS = ("cu", "ni", "co", "mn", "fe", "ru", "pd", "pt", "ag")
BASE_SYSTEMS = (("mg", "al"), ("zn", "al"), ("li", "al"))
CARBON = ("c", "ac", "activatedcarbon", "activated carbon")
FAMILIES = ("pmo", "ht", "ldh", "hydrotalcite")  # each stands for Mg-Al
OXIDES = ("o", "ox")
ELEMENT = r"([A-Z][a-z]?)(?:(\d+(?:\.\d*)?|\.\d+))?"
LOADING = rf"(?i)^{WS}*(\d+\.?\d*){WS}*(?:wt)?{WS}*%{WS}*"
RATIO_PREFIX = rf"^{WS}*\d+(?:\.\d+)?{WS}*:{WS}*\d+(?:\.\d+)?{WS}+"
BRACKETS = rf"(?d){WS}*[\(\[].*$"
NOUN = rf"(?i){WS}+(?:mixed{WS}+oxide|catalyst|pellets?|powder|bulk){WS}*$"
PHASE = rf"(?iu)^{WS}*(?:c|comm|commercial|[γgα]){WS}*[-–]{WS}*"

COMPOSITION = "struct<loading:double,promoters:array<string>,base:array<string>,support:string,base_ratio:array<double>,raw:string>"


def squash(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, rf"[\-_]|{WS}", ""))


def elements(c: Column) -> Column:
    """Element symbols (lower case) and their numbers, in order."""
    symbols = F.regexp_extract_all(c, F.lit(ELEMENT), F.lit(1))
    numbers = F.regexp_extract_all(c, F.lit(ELEMENT), F.lit(2))
    return F.zip_with(symbols, numbers, lambda s, n: F.struct(F.lower(s).alias("e"), n.try_cast("double").alias("n")))


def _symbols(pairs: Column) -> Column:
    return F.transform(pairs, lambda x: x["e"])


def _more(have: Column, symbols: Column) -> Column:
    """``have`` and the promoters among ``symbols`` that it lacks, each once."""
    new = F.filter(symbols, lambda e: e.isin(*PROMOTERS) & ~F.array_contains(have, e))
    return F.concat(have, F.array_distinct(new))


def parse_catalyst(name: Column) -> Column:
    none = F.array().cast("array<string>")

    def unwrapped(raw: Column) -> Column:
        s = strip(F.regexp_replace(F.regexp_replace(raw, RATIO_PREFIX, ""), BRACKETS, ""))
        return let(F.struct(raw.alias("raw"), F.regexp_replace(s, NOUN, "").alias("s")), loaded)

    def loaded(x: Column) -> Column:
        stem = strip(F.regexp_replace(F.regexp_replace(x["s"], LOADING, ""), PHASE, ""))
        loading = F.regexp_extract(x["s"], LOADING, 1).try_cast("double")
        return let(F.struct(x["raw"].alias("raw"), loading.alias("loading"), stem.alias("s"), F.instr(stem, "/").alias("at")), halved)

    def halved(x: Column) -> Column:
        left, right = strip(F.substring_index(x["s"], "/", 1)), strip(x["s"].substr(x["at"] + 1, F.length(x["s"])))
        sides = F.struct(x.alias("x"), left.alias("left"), right.alias("right"), ((x["at"] > 0) & squash(right).isin(*CARBON)).alias("carbon"), _symbols(elements(left)).alias("lead"))
        return let(sides, split)

    def split(y: Column) -> Column:
        """The decorating metals left of a slash, and the stem that is left to read."""
        slash, lead = y["x"]["at"] > 0, y["lead"]
        decorated = slash & ~y["carbon"] & (F.size(lead) > 0) & F.forall(lead, lambda e: e.isin(*PROMOTERS))
        stem = F.when(~slash, y["x"]["s"]).when(y["carbon"], y["left"]).otherwise(y["right"])
        parts = F.struct(
            y["x"]["raw"].alias("raw"), y["x"]["loading"].alias("loading"), y["carbon"].alias("carbon"), F.when(decorated, lead).otherwise(none).alias("first"), stem.alias("stem")
        )
        return let(parts, read)

    def read(x: Column) -> Column:
        stem = x["stem"]
        family = F.coalesce(*[F.when(stem.rlike(rf"(?iU)\b{f}\b"), F.lit(f)) for f in FAMILIES])
        before = F.coalesce(*[F.when(stem.rlike(rf"(?iU)\b{f}\b"), F.element_at(F.split(stem, rf"(?iU)\b{f}\b", 2), 1)) for f in FAMILIES])
        plain = F.replace(F.replace(stem, F.lit("-"), F.lit("")), F.lit(" "), F.lit(""))
        found = F.filter(elements(plain), lambda p: ~p["e"].isin(*OXIDES))
        seen = F.struct(x.alias("x"), family.alias("family"), _symbols(elements(before)).alias("ahead"), found.alias("found"))
        return let(seen, lambda y: let(F.struct(y.alias("y"), F.filter(y["found"], lambda p: ~p["e"].isin(*PROMOTERS)).alias("rest")), sorted_out))

    def sorted_out(z: Column) -> Column:
        y, rest = z["y"], z["rest"]
        x, family = y["x"], y["family"].isNotNull()
        symbols, numbers = _symbols(rest), F.transform(rest, lambda p: p["n"])
        system = F.lit(False)
        for pair in BASE_SYSTEMS:
            system = system | (symbols == F.array(*[F.lit(e) for e in pair]))
        active = ~system & x["carbon"] & (F.size(rest) > 0)  # on carbon the rest is the active phase
        return F.struct(
            x["loading"].alias("loading"),
            F.when(family, _more(x["first"], y["ahead"])).when(active, symbols).otherwise(_more(x["first"], _symbols(y["found"]))).alias("promoters"),
            F.when(family, F.array(F.lit("mg"), F.lit("al"))).when((F.size(rest) > 0) & ~active, symbols).alias("base"),
            F.when(x["carbon"], F.lit("c")).alias("support"),
            F.when(~family & system & F.forall(numbers, lambda n: n.isNotNull()), numbers).alias("base_ratio"),
            x["raw"].alias("raw"),
        )

    return F.when(strip(name) != "", let(strip(name), unwrapped))


def _caps(symbols: Column, sep: str) -> Column:
    return F.array_join(F.transform(symbols, lambda e: F.concat(F.upper(F.substring(e, 1, 1)), e.substr(2, 9))), sep)


def canonical(c: Column, with_ratio: bool = False) -> Column:
    """One spelling for a composition; null for null."""
    metals = _caps(c["promoters"], "")
    base = _caps(c["base"], "-")
    if with_ratio:
        shown = F.concat(F.lit("("), F.array_join(F.transform(c["base_ratio"], whole_or_decimal), ":"), F.lit(")"))
        base = F.concat(base, F.coalesce(shown, F.lit("")))
    stem = (
        F.when(c["base"].isNotNull(), F.when(metals != "", F.concat(metals, F.lit("-"), base)).otherwise(base))
        .when(c["support"].isNotNull(), F.concat(F.when(metals != "", metals).otherwise(F.lit("Mg")), F.lit("O/C")))
        .otherwise(metals)
    )
    return F.when(c.isNotNull(), F.concat(F.coalesce(F.concat(whole_or_decimal(c["loading"]), F.lit("% ")), F.lit("")), stem))


def comparable(name: Column) -> Column:
    """What a comparison of names needs, null where a name is: the one spelling, and the ratio if stated
    (``stated`` without a number is a ratio to zero)."""
    ratio = lambda c: F.try_divide(c["base_ratio"][0], c["base_ratio"][1])
    made = lambda c: F.when(c.isNotNull(), F.struct(canonical(c).alias("spelling"), c["base_ratio"].isNotNull().alias("stated"), ratio(c).alias("ratio")))
    return let(parse_catalyst(name), made)


def composition_match(a: Column, b: Column) -> Column:
    """Whether two comparable names are one material. A ratio counts where both state one; the
    difference is relative to ``b``. A ratio to zero matches nothing."""
    agree = F.coalesce(F.abs(a["ratio"] - b["ratio"]) / F.greatest(b["ratio"], F.lit(1e-9)) <= 0.05, F.lit(False))
    same = (a["spelling"] == b["spelling"]) & (~a["stated"] | ~b["stated"] | agree)
    return F.when(a.isNull() & b.isNull(), True).when(a.isNull() | b.isNull(), False).otherwise(same)


def catalyst_match(a: Column, b: Column) -> Column:
    both = F.struct(comparable(a).alias("a"), comparable(b).alias("b"))
    return let(both, lambda x: composition_match(x["a"], x["b"]))


def canonical_catalyst(name: Column, with_ratio: bool = False) -> Column:
    return let(parse_catalyst(name), lambda c: canonical(c, with_ratio))
