"""Documents by line: damage, repair, coverage, and where a text layer comes from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fidelity as fx
from ..functions import lines as fl
from ..functions.text import strip
from .tables import top_n

# Base fonts that are referenced without embedding, and the shape of subset names.
BASE_FONTS = ("Courier", "Courier-Bold", "Courier-Oblique", "Helvetica", "Helvetica-Bold", "Times-Roman", "Arial", "ArialMT")
SUBSET = r"^[A-Z]{6}\+"


def text_lines(pages: DataFrame, text: str = "text") -> DataFrame:
    """Rows (doc, page, line_no, line) of pages (doc, page, text), split at line feeds only."""
    return pages.select("doc", "page", F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n", -1)).alias("line_no", "line"))


def repaired_lines(lines: DataFrame, scope: str = "data", use_d1: bool = True, use_d2: bool = False) -> DataFrame:
    """``lines`` with fixed (text), kind, changes, and whether the row counts as data."""
    x = lines.withColumn("r", fl.repair_line(F.col("line"), scope, use_d1, use_d2))
    data = (F.col("r.kind") == "DATA") | ((F.col("r.n") >= 4) & (F.col("r.ok") >= 3))
    return x.select(
        *lines.columns, F.col("r.text").alias("fixed"), F.col("r.kind").alias("kind"), F.col("r.changes").alias("changes"),
        F.coalesce(data, F.lit(False)).alias("is_data"), F.col("r.n").alias("n_tokens"), F.col("r.ok").alias("n_parseable"), F.col("r.ok_after").alias("n_parseable_after"),
    )


def changes(repaired: DataFrame) -> DataFrame:
    """One row per edit, in reading order."""
    x = repaired.select("doc", "page", "line_no", "kind", "line", "fixed", F.posexplode("changes").alias("n", "c"))
    return x.select(
        "doc", "page", "line_no", "n", "kind", F.col("c.before").alias("before"), F.col("c.after").alias("after"), F.col("c.tier").alias("tier"),
        strip(F.col("line")).alias("line_before"), strip(F.col("fixed")).alias("line_after"),
    )


def repair_coverage(repaired: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Parseable tokens in data rows before and after, per document."""
    on = lambda c: F.sum(F.when(F.col("is_data"), F.col(c)).otherwise(0)).cast("long")
    x = repaired.groupBy(*(by or ["doc"])).agg(
        on("n_parseable").alias("parseable_before"), on("n_parseable_after").alias("parseable_after"), on("n_tokens").alias("data_tokens_total"),
        F.sum(F.size("changes")).cast("long").alias("tokens_modified"),
    )
    share = lambda c: F.round(F.coalesce(F.try_divide(100.0 * F.col(c), F.col("data_tokens_total")), F.lit(0.0)), 2)
    return x.withColumns(
        {"rescued": F.col("parseable_after") - F.col("parseable_before"), "coverage_before_pct": share("parseable_before"), "coverage_after_pct": share("parseable_after")}
    )


def tier_counts(edits: DataFrame) -> DataFrame:
    return edits.groupBy("doc", "tier").agg(F.count("*").alias("n"))


def line_verdicts(lines: DataFrame) -> DataFrame:
    """The damaged lines: kind, suspects, repaired."""
    x = lines.withColumn("v", fl.classify_line(F.col("line"))).where("v is not null")
    return x.select(*lines.columns, "v.kind", "v.suspects", "v.repaired")


def char_hits(verdicts: DataFrame) -> DataFrame:
    """How often each confusable letter stands in damaged tokens."""
    chars = F.filter(F.split(fx.strip_edges(F.col("s")), ""), lambda c: c.isin(*fx.CONFUSED))
    x = verdicts.select("doc", F.explode("suspects").alias("s")).select("doc", F.explode(chars).alias("char"))
    return x.groupBy("doc", "char").agg(F.count("*").alias("n"))


def line_statistics(pages: DataFrame) -> DataFrame:
    """Per document: pages, characters, the word example, damaged lines and tokens by kind."""
    sizes = pages.groupBy("doc").agg(
        F.count("*").alias("pages"),
        F.sum(F.length(F.coalesce("text", F.lit("")))).alias("n_chars"),
        F.sum(F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"(?i)\bexamples?\b"))).alias("n_example_kw"),
    )
    v = line_verdicts(text_lines(pages))
    n = F.size("suspects")
    of = lambda k: F.sum(F.when(F.col("kind") == k, n).otherwise(0))
    stats = v.groupBy("doc").agg(
        F.count("*").alias("n_suspect_lines"), F.sum(n).alias("n_suspect_tokens"),
        F.count_if(F.col("kind") == "DATA").alias("lines_data"), F.count_if(F.col("kind") == "CITATION").alias("lines_citation"), F.count_if(F.col("kind") == "PROSE").alias("lines_prose"),
        of("DATA").alias("suspects_in_data"), of("CITATION").alias("suspects_in_citation"), of("PROSE").alias("suspects_in_prose"),
    )
    counts = [c for c in stats.columns if c != "doc"]
    x = sizes.join(stats, "doc", "left").fillna(0, counts)
    density = F.round(F.coalesce(F.try_divide(1000.0 * F.col("n_suspect_tokens"), F.col("n_chars")), F.lit(0.0)), 3)
    return x.withColumn("corruption_per_1k", density)


def structure(fonts: DataFrame, images: DataFrame) -> DataFrame:
    """Per document, from glyph counts (doc, font, n) and image covers (doc, page, cover): the share
    of glyphs in subset fonts, the fonts by use, and the mean over pages of the largest image."""
    f = fonts.groupBy("doc", "font").agg(F.sum("n").alias("n"))
    total = f.groupBy("doc").agg(
        F.round(F.try_divide(F.sum(F.when(F.col("font").rlike(SUBSET), F.col("n")).otherwise(0)), F.sum("n")), 3).alias("subset_font_frac"),
        F.count("*").alias("n_distinct_fonts"),
    )
    top = top_n(f, ["doc"], [F.desc("n"), "font"], 6).groupBy("doc").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("k"), "font"))).alias("x"))
    top = top.select("doc", F.col("x.font").alias("fonts"))
    cover = images.groupBy("doc", "page").agg(F.least(F.lit(1.0), F.max("cover")).alias("c")).groupBy("doc").agg(F.round(F.avg("c"), 3).alias("page_image_cover"))
    return total.join(top, "doc").join(cover, "doc", "left").fillna(0.0, ["page_image_cover"])


def provenance(subset: Column, n_fonts: Column, cover: Column, fonts: Column, density: Column) -> Column:
    """Scanned or native, by structure and by density of damage."""
    base = F.exists(fonts, lambda f: F.element_at(F.split(f, r"\+"), -1).isin(*BASE_FONTS))
    structural = (subset < 0.05) & (n_fonts <= 3) & (cover > 0.80) & base
    statistical = density >= 0.5
    return (
        F.when(structural & statistical, F.lit("SCANNED_OCR"))
        .when(structural, F.lit("SCANNED_OCR (clean)"))
        .when(statistical, F.lit("NATIVE (corruption flagged)"))
        .otherwise(F.lit("NATIVE_TEXT"))
    )


def document_report(pages: DataFrame, fonts: DataFrame, images: DataFrame) -> DataFrame:
    x = line_statistics(pages).join(structure(fonts, images), "doc", "left")
    verdict = provenance(*[F.coalesce(c, d) for c, d in ((F.col("subset_font_frac"), F.lit(0.0)), (F.col("n_distinct_fonts"), F.lit(0)), (F.col("page_image_cover"), F.lit(0.0)))], F.coalesce("fonts", F.array().cast("array<string>")), F.col("corruption_per_1k"))
    return x.withColumn("verdict", verdict)


def samples(verdicts: DataFrame, n: int = 12) -> DataFrame:
    """Damaged lines to look at, data rows first, in reading order."""
    first = top_n(verdicts, ["doc"], [F.col("kind") != "DATA", "page", "line_no"], n)
    return first.withColumn("raw", F.substring(strip(F.col("line")), 1, 120))


def markdown_row(report: DataFrame) -> DataFrame:
    f = lambda c: F.format_string("%,d", F.col(c).cast("long"))
    parts = [F.concat(F.lit("`"), F.col("doc").cast("string"), F.lit("`")), F.col("pages").cast("string"), f("n_chars"), F.col("n_example_kw").cast("string"), F.col("n_suspect_tokens").cast("string")]
    kinds = F.concat_ws(" / ", F.col("lines_data").cast("string"), F.col("lines_citation").cast("string"), F.col("lines_prose").cast("string"))
    return report.select("doc", F.concat(F.lit("| "), F.concat_ws(" | ", *parts, kinds, F.col("corruption_per_1k").cast("string"), F.col("verdict")), F.lit(" |")).alias("md"))
