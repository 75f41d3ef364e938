"""Score predictions against truth: pairs, one-to-one alignment, cells, pooled counts, repeats."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import align, metrics
from ..schema import Protocol, protocol_table

KEYS = ["paper", "version", "rep"]


def score_run(
    truth: DataFrame, preds: DataFrame, protocols: list[Protocol] | None = None, keys: list[str] | None = None, match: Callable = align.greedy, **kw
) -> dict[str, DataFrame]:
    """``truth``: paper, gt_ord and the columns; ``preds``: the ``keys``, pred_ord and the columns.

    All protocols are scored in one plan. A paper without predictions in a run is scored, as misses.
    Gives rows, matches, cells, columns (pooled per column), scores (pooled per run) and summary (over repeats).
    """
    keys = keys or KEYS
    table = protocols or [Protocol()]
    rows = match(truth, preds, table, keys, **kw)
    cells = align.cell_outcomes(rows, table, keys)
    run = [k for k in keys if k != "paper"]
    fixed = ["protocol", *run]
    scores = metrics.with_prf(metrics.pooled(cells, fixed))
    by = ["protocol", *[k for k in run if k != "rep"]]
    return {
        "rows": rows,
        "matches": align.matches(rows, keys),
        "cells": cells,
        "columns": metrics.with_prf(metrics.pooled(cells, [*fixed, "column"])),
        "papers": metrics.with_prf(metrics.pooled(cells, [*fixed, "paper"])),
        "scores": scores,
        "summary": metrics.over_repeats(scores, by),
    }


def score_present(truth: DataFrame, preds: DataFrame, **kw) -> dict[str, DataFrame]:
    """As ``score_run`` over papers that have predictions only."""
    return score_run(truth, preds, present=True, **kw)


def with_version(rows: DataFrame, version: str, rep: int = 1) -> DataFrame:
    """An extra prediction set, such as a manual one, as a version of its own."""
    return rows.withColumns({"version": F.lit(version), "rep": F.lit(rep)})


def audit(truth: DataFrame, preds: DataFrame, protocols: list[Protocol], keys: list[str] | None = None) -> DataFrame:
    """One row per protocol: pooled scores, the catalyst column's f1, and changes of f1 against the
    step before and the first. Configurations share one scan and one job."""
    out = score_run(truth, preds, protocols, keys)
    table = protocol_table(truth.sparkSession, protocols).select("protocol", "step")
    x = metrics.with_catalyst(out["cells"], ["protocol"]).join(F.broadcast(table), "protocol")
    return metrics.with_deltas(metrics.with_deltas(x, "step"), "step", value="f1_text")
