"""Replies to records: key names, harmonised rows, keep-first dedupe, first usable attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.replies import parsed
from ..functions.text import WS, is_null_ingest, let, strip
from ..schema import ALIASES, ALL_COLS, VELOCITY_KEYS, VELOCITY_ROUTES

UNCERTAIN = rf"^{WS}*[~≈]{WS}*"


def canonical_key(key: Column, value: Column) -> Column:
    """The schema column that a field name stands for; null drops the field. A bare space velocity
    goes where its value says."""
    names = {c.lower(): c for c in ALL_COLS} | ALIASES
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    k = F.regexp_replace(F.lower(strip(key)), rf"(?:-|{WS})+", "_")
    route = F.coalesce(*[F.when(F.lower(value).contains(t), F.lit(c)) for t, c in VELOCITY_ROUTES])
    return F.when(k.isin(*VELOCITY_KEYS), route).otherwise(F.try_element_at(table, k))


def harmonise(rows: DataFrame, entries: str, paper: Column) -> DataFrame:
    """Replace ``entries`` (array of key, value, nested) by the schema's columns, ``_uncertain`` and
    ``_raw_values``. The first value that says something wins; a leading ~ is noted and dropped."""

    def read(e: Column) -> Column:
        text = strip(e["value"])
        shown = F.when(e["nested"], e["value"]).when(is_null_ingest(e["value"]), F.lit(None)).otherwise(F.regexp_replace(text, UNCERTAIN, ""))
        plain = ~e["nested"] & ~is_null_ingest(e["value"])
        return F.struct(
            canonical_key(e["key"], e["value"]).alias("col"),
            shown.alias("value"),
            F.when(plain, text).alias("raw"),
            (plain & text.rlike(UNCERTAIN)).alias("unsure"),
        )

    x = rows.withColumn("h_read", F.transform(entries, read)).drop(entries)

    def chosen(c: str) -> Column:
        def pick(own: Column) -> Column:
            said = F.filter(own, lambda e: e["value"].isNotNull() & (e["value"] != ""))
            return F.coalesce(F.get(said, F.lit(0)), F.try_element_at(own, F.lit(-1)))

        return let(F.filter("h_read", lambda e: e["col"] == c), pick)

    x = x.withColumn("h_cells", F.struct(*[chosen(c).alias(c) for c in ALL_COLS])).drop("h_read")
    cells = F.array(*[F.struct(F.lit(c).alias("key"), F.col("h_cells")[c].alias("cell")) for c in ALL_COLS])
    unsure = F.filter(cells, lambda z: F.coalesce(z["cell"]["unsure"], F.lit(False)))
    raws = F.filter(cells, lambda z: z["cell"]["raw"].isNotNull())
    some = F.size(unsure) > 0
    x = x.withColumns(
        {
            "_uncertain": F.when(some, F.map_from_entries(F.transform(unsure, lambda z: F.struct(z["key"], F.lit(True))))),
            "_raw_values": F.when(some, F.map_from_entries(F.transform(raws, lambda z: F.struct(z["key"], z["cell"]["raw"])))),
        }
    )
    values = {c: F.col("h_cells")[c]["value"] for c in ALL_COLS if c != "paper"}
    return x.withColumns(values | {"paper": paper}).drop("h_cells")


def dedupe_keep_first(rows: DataFrame, by: list[str], order: list[str], cols: tuple[str, ...] = ALL_COLS) -> DataFrame:
    """Of rows equal in all ``cols`` (trimmed, any case, null as empty) the first by ``order``."""
    same = [F.coalesce(F.lower(strip(F.col(c).cast("string"))), F.lit("")) for c in cols]
    w = Window.partitionBy(*by, *same).orderBy(*order)
    return rows.withColumn("d_place", F.row_number().over(w)).where("d_place = 1").drop("d_place")


def usable_attempts(replies: DataFrame, chunk: list[str]) -> DataFrame:
    """Per chunk the reply that counts: its accepted one, else the first rejected attempt, by path,
    that parses. ``replies`` has the chunk's keys, path, failed and text; adds form and rows."""
    x = replies.withColumn("u_parsed", parsed(F.col("text"))).withColumns({"form": F.col("u_parsed.form"), "rows": F.col("u_parsed.rows")}).drop("u_parsed")
    accepted = x.where("not failed")
    # Of several accepted files of a chunk the last by path stands, as later writes replace it.
    accepted = accepted.withColumn("u_n", F.row_number().over(Window.partitionBy(*chunk).orderBy(F.desc("path")))).where("u_n = 1").drop("u_n")
    rejected = x.where("failed").join(accepted.select(*chunk), chunk, "left_anti").where("form is not null")
    rejected = rejected.withColumn("u_n", F.row_number().over(Window.partitionBy(*chunk).orderBy("path"))).where("u_n = 1").drop("u_n")
    return accepted.unionByName(rejected)


def latest_success(attempts: DataFrame, chunk: list[str]) -> DataFrame:
    """The last successful attempt of each chunk."""
    w = Window.partitionBy(*chunk).orderBy(F.desc("attempt"))
    return attempts.where("status = 'ok'").withColumn("l_n", F.row_number().over(w)).where("l_n = 1").drop("l_n")


# Errors that another attempt can't cure.
FINAL_ERRORS = ("not logged in", "authentication", "invalid model", "unknown model", "permission denied", "usage limit")


def retryable(error: Column) -> Column:
    final = F.lit(False)
    for e in FINAL_ERRORS:
        final = final | F.lower(error).contains(e)
    return ~F.coalesce(final, F.lit(False))
