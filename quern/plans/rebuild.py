"""Records of a run made anew from its saved replies, without asking an extractor again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import ingest

CELL = ["slug", "version", "rep"]


def rebuild(replies: DataFrame, corpus: DataFrame | None = None) -> DataFrame:
    """``replies``: slug, version, rep, label, failed, path, text. Harmonised rows without exact
    repeats: slug, version, rep, pred_ord, the columns and their metadata.

    ``corpus`` (slug, paper) names papers; others are named by their slug.
    """
    used = ingest.usable_attempts(replies, [*CELL, "label"])
    x = used.select(*CELL, "failed", "path", F.posexplode("rows").alias("row", "entries"))
    if corpus is not None:
        names = corpus.select(F.col("slug").alias("c_slug"), F.col("paper").alias("c_paper"))
        x = x.join(names, F.col("slug") == F.col("c_slug"), "left").withColumn("c_paper", F.coalesce("c_paper", "slug")).drop("c_slug")
    else:
        x = x.withColumn("c_paper", F.col("slug"))
    x = ingest.harmonise(x, "entries", F.col("c_paper")).drop("c_paper")
    order = ["failed", "path", "row"]
    x = ingest.dedupe_keep_first(x, CELL, order)
    place = F.row_number().over(Window.partitionBy(*CELL).orderBy(*order)) - 1
    return x.withColumn("pred_ord", place.cast("bigint")).drop(*order)


def cells_with_rows(replies: DataFrame, rows: DataFrame) -> DataFrame:
    """Every cell that has a reply file, with its number of rows; zero if nothing was usable."""
    counts = rows.groupBy(*CELL).agg(F.count("*").alias("n_rows"))
    return replies.select(*CELL).distinct().join(counts, CELL, "left").fillna(0, ["n_rows"])


def summary(replies: DataFrame) -> DataFrame:
    """chunks, parsed_first_attempt, recovered_from_rejected, still_unparseable and the rate."""
    chunk = [*CELL, "label"]
    used = ingest.usable_attempts(replies, chunk).select(*chunk, "failed", "form")
    x = replies.select(*chunk).distinct().join(used, chunk, "left")
    out = x.agg(
        F.count("*").alias("chunks"),
        F.count_if(F.col("form").isNotNull() & ~F.col("failed")).alias("parsed_first_attempt"),
        F.count_if(F.col("form").isNotNull() & F.col("failed")).alias("recovered_from_rejected"),
        F.count_if(F.col("form").isNull()).alias("still_unparseable"),
    )
    return out.withColumn("true_parse_failure_rate", F.round(F.try_divide("still_unparseable", "chunks"), 4))


def reply_forms(replies: DataFrame) -> DataFrame:
    used = ingest.usable_attempts(replies, [*CELL, "label"]).where("form is not null")
    return used.groupBy("form").agg(F.count("*").alias("n"))
