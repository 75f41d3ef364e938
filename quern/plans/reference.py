"""Reference tables from curated sheets, and the accuracy of repairs against printed values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fidelity, units
from ..operators import metrics, tables
from ..schema import ALL_COLS

# The sheet's column names for the schema's columns.
SHEET = {
    "catalyst": "Catalyst", "loading_g": "Loading / g", "temperature_K": "Temperature / deg C", "gas_mix": "Gas Mix", "flow_rate_mL_min": "Flow rate / mL min-1",
    "LHSV_h": "LHSV / h-1", "WHSV_h": "WHSV / h-1", "GHSV_h": "GHSV / h-1", "pressure": "Pressure /atm", "conversion_pct": "Conversion / %", "selectivity_pct": "Selectivity / %",
}


def truth_from_sheet(cells: DataFrame, papers: dict[str, str], key: str = "Patent") -> DataFrame:
    """Records of a sheet given as (row_no, col_no, value), in row order. ``papers`` names those that
    are kept; temperatures become kelvins and pressures kPa, half to even, words stay."""
    named = tables.header_row(cells, key)
    wide = named.groupBy("row_no").pivot("header", [key, *SHEET.values()]).agg(F.first("value"))
    names = F.create_map(*[F.lit(x) for pair in papers.items() for x in pair])
    wide = wide.withColumn("paper", F.try_element_at(names, F.col(f"`{key}`"))).where("paper is not null")
    own = {c: F.coalesce(F.col(f"`{h}`"), F.lit("")) for c, h in SHEET.items()}
    own["temperature_K"], own["pressure"] = units.celsius_cell(own["temperature_K"]), units.atm_cell(own["pressure"])
    return wide.select("row_no", *[F.col("paper") if c == "paper" else own[c].alias(c) for c in ALL_COLS])


def repair_judgements(edits: DataFrame, truth: DataFrame) -> DataFrame:
    """Edits (doc, page, line_no, n, before, after) beside printed values (doc, idx, ocr_token, truth),
    place by place over the shorter list: drift (other token) and correct (equal as numbers)."""
    x = tables.positional_join(edits, truth, ["page", "line_no", "n"], ["idx"], ["doc"])
    got = fidelity.strip_edges(F.col("after"))
    return x.select(
        "doc", "place", "before", "after", "tier", F.col("b_truth").alias("truth"), (F.col("b_ocr_token") != F.col("before")).alias("drift"), fidelity.num_eq(got, F.col("b_truth")).alias("correct")
    )


def repair_counts(edits: DataFrame, truth: DataFrame) -> DataFrame:
    """Per document what a warning says: edits and printed values, pairs whose tokens drifted apart, and
    whether the lists differ in length."""
    n = lambda x, name: x.groupBy("doc").agg(F.count("*").alias(name))
    drift = repair_judgements(edits, truth).groupBy("doc").agg(F.count_if("drift").alias("n_drift"))
    x = n(edits, "n_edits").join(n(truth, "n_truth"), "doc", "full").join(drift, "doc", "left").fillna(0)
    return x.withColumn("mismatch", F.col("n_edits") != F.col("n_truth"))


def repair_accuracy(edits: DataFrame, truth: DataFrame) -> DataFrame:
    return metrics.accuracy(repair_judgements(edits, truth), F.col("correct"))
