"""Text basics: trimming and splitting by Unicode white space, and the null vocabularies.

Spark's ``trim`` removes spaces only and Java's ``\\s`` is ASCII; records carry no-break spaces
and other separators from documents, so the white space class is spelled out here.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space, and the dashes that documents print for "-".
WS = r"[\t-\r\x1c-\x20\x85\xa0  -     　]"
NOT_WS = r"[^\t-\r\x1c-\x20\x85\xa0  -     　]"
WS_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
DASHES = "‐‑‒–—―−"
LINE_END = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85  ]"

# What counts as empty, by place. They differ on purpose.
NULL_CSV = ("", "None")  # exact
NULL_CELL = ("", "none", "null", "nan", "n/a")  # trimmed, lower case
NULL_COMPARED = ("null", "none", "")  # lower case, not trimmed
NULL_QUANTITY = ("", "none", "null", "n/a", "na", "-", "—", "nan")  # trimmed, lower case
NULL_INGEST = ("null", "none", "n/a", "not reported", "")  # trimmed, lower case


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which stands in the plan once however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))


def words(c: Column) -> Column:
    """White-space separated tokens, none of them empty."""
    return F.filter(F.split(c, WS + "+"), lambda x: x != "")


def lines(c: Column) -> Column:
    """Lines by every line boundary; a final boundary starts no line."""
    parts = F.split(c, LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def quoted(c: str) -> str:
    return "`" + c.replace("`", "``") + "`"


def null_csv(c: Column) -> Column:
    return F.when(c.isin(*NULL_CSV), F.lit(None)).otherwise(c)


def is_null(c: Column) -> Column:
    """A cell with nothing in it."""
    return c.isNull() | F.coalesce(F.lower(strip(c)).isin(*NULL_CELL), F.lit(False))


def is_null_ingest(c: Column) -> Column:
    return c.isNull() | F.coalesce(F.lower(strip(c)).isin(*NULL_INGEST), F.lit(False))


def normalised(c: Column) -> Column:
    """The form in which words are compared; null where there is nothing to compare."""
    s = F.replace(F.replace(F.lower(strip(c)), F.lit(" "), F.lit("")), F.lit(","), F.lit("."))
    s = F.replace(F.replace(s, F.lit("/ac"), F.lit("/c")), F.lit("mgo/ac"), F.lit("mgo/c"))
    return F.when(F.lower(c).isin(*NULL_COMPARED), F.lit(None)).otherwise(s)


def alnum_count(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))


def any_of(values: Sequence[str]) -> str:
    """A regular expression group of literals."""
    return "(?:" + "|".join("".join("\\" + ch if not ch.isalnum() and ch != "_" else ch for ch in v) for v in values) + ")"
