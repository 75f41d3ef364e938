"""Documents into chunks: tail matter, sections, tables, and packing of pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, alnum_count, let, lines, strip

# Headings, markers and limits.
TAIL = rf"(?md)^{WS}*(?:\d+\.?{WS}*)?(?:References|Bibliography|Acknowledg(?:e?ments?|ments)){WS}*$"
HEADING = (
    r"(?mdi)^[ \t]*(?:(\d+(?:\.\d+)*)\.?[ \t]+)?"
    r"(Abstract|Introduction|Experimental(?:\s+Section)?|Materials\s+and\s+Methods|Methods?|Methodology|Results\s+and\s+Discussion|Results|Discussion|"
    r"Conclusions?|References|Bibliography|Acknowledg(?:e?ments?|ments)|Supporting\s+Information|Supplementary\s+Material)[ \t]*:?[ \t]*$"
)
TABLE = r"\[Table on page \d+\]"
PAGE = "[Page "
FRONT_MAX = 8000
TABLE_MIN_ALNUM = 200
SECTIONED_VERSIONS = ("V3", "V4", "V6", "V7")
KINDS = ("methods", "results", "front")

NO_TEXTS = "cast(array() as array<string>)"
NO_CHUNKS = "cast(array() as array<struct<label:string,text:string>>)"


def strip_tail(text: Column) -> Column:
    """The text before its first reference or thanks heading, if that stands past a fifth."""
    before = F.element_at(F.split(text, TAIL, 2), 1)
    return F.when((F.size(F.split(text, TAIL, 2)) > 1) & (F.length(before) > F.length(text) * 0.2), before).otherwise(text)


def section_kind(name: Column) -> Column:
    n = F.lower(name)
    has = lambda *ws: n.rlike("|".join(ws))
    return (
        F.when(has("method", "experimental", "material"), F.lit("methods"))
        .when(has("result", "discussion", "conclusion"), F.lit("results"))
        .when(has("abstract", "introduction"), F.lit("front"))
        .otherwise(F.lit("back"))
    )


def split_sections(text: Column, preamble: bool = False) -> Column:
    """array of (kind, heading, body) below detected headings; empty with fewer than two.

    What stands before the first heading belongs to no section, unless ``preamble`` asks for it.
    """
    names = F.regexp_extract_all(text, F.lit(HEADING), F.lit(2))

    def cut(x: Column) -> Column:
        bodies = F.transform(F.slice(x["parts"], F.lit(2), F.size(x["names"])), strip)
        made = F.zip_with(x["names"], bodies, lambda n, b: F.struct(section_kind(n).alias("kind"), strip(n).alias("heading"), b.alias("body")))
        large = lambda s: F.when((s["kind"] == "front") & (F.length(s["body"]) > FRONT_MAX), F.lit("results")).otherwise(s["kind"])
        kept = F.transform(F.filter(made, lambda s: s["body"] != ""), lambda s: F.struct(large(s).alias("kind"), s["heading"].alias("heading"), s["body"].alias("body")))
        if preamble:
            head = F.array(F.struct(F.lit("front").alias("kind"), F.lit("").alias("heading"), strip(F.element_at(x["parts"], 1)).alias("body")))
            kept = F.concat(F.filter(head, lambda s: s["body"] != ""), kept)
        return F.when(F.size(x["names"]) >= 2, kept).otherwise(F.expr("cast(array() as array<struct<kind:string,heading:string,body:string>>)"))

    return let(F.struct(names.alias("names"), F.split(text, HEADING, -1).alias("parts")), cut)


def collect_tables(text: Column) -> Column:
    """Marked tables with their rows that hold letters or digits, joined by empty lines."""

    def block(own: Column) -> Column:
        """A marker's line and the pipe rows and empty lines that follow it without a break."""
        stop = F.get(F.filter(F.transform(own, lambda x, i: F.when((i > 0) & ~x.contains("|") & (strip(x) != ""), i)), lambda i: i.isNotNull()), F.lit(0))
        kept = F.slice(own, F.lit(1), F.coalesce(stop, F.size(own)))
        rows = F.filter(F.slice(kept, 2, 1_000_000), lambda x: alnum_count(x) > 0)
        return F.when(F.size(rows) > 0, F.array_join(F.concat(F.slice(kept, 1, 1), rows), "\n"))

    marks, parts = F.regexp_extract_all(text, F.lit(TABLE), F.lit(0)), F.split(text, TABLE, -1)
    blocks = F.zip_with(marks, F.slice(parts, F.lit(2), F.size(marks)), lambda m, p: let(lines(F.concat(m, p)), block))
    return strip(F.array_join(F.filter(blocks, lambda b: b.isNotNull()), "\n\n"))


def pack_pages(text: Column, max_chars: int = 12000) -> Column:
    """Chunks of whole pages below ``max_chars``. A longer page is a chunk of its own, and a piece
    without a page marker gets one, as in the packing that runs were made with."""
    start = F.struct(F.lit("").alias("cur"), F.expr(NO_TEXTS).alias("out"))
    marked = lambda p: F.concat(F.lit(PAGE), p)

    def add(s: Column, p: Column) -> Column:
        fits = F.length(s["cur"]) + F.length(p) < max_chars
        out = F.when(fits | (s["cur"] == ""), s["out"]).otherwise(F.concat(s["out"], F.array(s["cur"])))
        cur = F.when(fits, F.concat(s["cur"], F.when(p != "", marked(p)).otherwise(F.lit("")))).otherwise(marked(p))
        return F.struct(cur.alias("cur"), out.alias("out"))

    last = lambda s: F.when(s["cur"] != "", F.concat(s["out"], F.array(s["cur"]))).otherwise(s["out"])
    return F.when(F.length(text) <= max_chars, F.array(text)).otherwise(F.aggregate(F.split(text, r"\[Page ", -1), start, add, last))


def _labelled(pieces: Column, name: str, always: bool = False) -> Column:
    number = lambda i: F.concat(F.lit(f"{name}["), (i + 1).cast("string"), F.lit("]"))
    label = lambda i: number(i) if always else F.when(F.size(pieces) == 1, F.lit(name)).otherwise(number(i))
    return F.transform(pieces, lambda p, i: F.struct(label(i).alias("label"), p.alias("text")))


def chunk_by_section(text: Column, max_chars: int = 12000, preamble: bool = False) -> Column:
    """array of (label, text): methods, results and front matter, then tables; pages of the body
    where no headings are found."""

    def made(x: Column) -> Column:
        own = []
        for kind in KINDS:
            bodies = F.transform(F.filter(x["sections"], lambda s: s["kind"] == kind), lambda s: s["body"])  # noqa: B023
            joined = strip(F.array_join(bodies, "\n\n"))
            own.append(F.when(joined != "", let(pack_pages(joined, max_chars), lambda p: _labelled(p, kind))).otherwise(F.expr(NO_CHUNKS)))  # noqa: B023
        body = let(pack_pages(x["body"], max_chars), lambda p: _labelled(p, "body", True))
        return let(F.concat(*own), lambda c: F.when(F.size(c) > 0, c).otherwise(body))

    body = strip_tail(text)
    main = let(body, lambda b: let(F.struct(b.alias("body"), split_sections(b, preamble).alias("sections")), made))
    tables = let(collect_tables(text), lambda t: F.when(alnum_count(t) >= TABLE_MIN_ALNUM, let(pack_pages(t, max_chars), lambda p: _labelled(p, "tables"))).otherwise(F.expr(NO_CHUNKS)))
    return F.concat(main, tables)


def chunks_for(version: Column, text: Column, max_chars: int = 12000) -> Column:
    """Sections for the versions that are told of them, packed pages for the others."""
    plain = let(pack_pages(text, max_chars), lambda p: _labelled(p, "chars", True))
    return F.when(version.isin(*SECTIONED_VERSIONS), chunk_by_section(text, max_chars)).otherwise(plain)
