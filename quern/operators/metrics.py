"""Counts to precision, recall and F1; pooling, repeats, pivots and deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

COUNTS = ("tp", "tp_rng", "fp", "fp_un", "fn", "fn_fig")


def sums() -> list[Column]:
    return [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in COUNTS]


def f1_of(p: Column, r: Column) -> Column:
    """Null where either is; zero where both are zero."""
    return F.when(p.isNotNull() & r.isNotNull(), F.when(p + r == 0, F.lit(0.0)).otherwise(F.try_divide(2 * p * r, p + r)))


def with_prf(df: DataFrame) -> DataFrame:
    """p, r, f1 and the text-recoverable r_text, f1_text (figure-only misses left out)."""
    p = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))
    r = F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    r_text = F.try_divide(F.col("tp"), F.col("tp") + F.col("fn") - F.col("fn_fig"))
    df = df.withColumns({"p": p, "r": r, "r_text": r_text})
    return df.withColumns({"f1": f1_of(F.col("p"), F.col("r")), "f1_text": f1_of(F.col("p"), F.col("r_text"))})


def pooled(cells: DataFrame, by: list[str]) -> DataFrame:
    return cells.groupBy(*by).agg(*sums())


def with_catalyst(cells: DataFrame, by: list[str]) -> DataFrame:
    """Pooled counts and scores, beside the f1 of the column catalyst; the cells are read once."""
    x = pooled(cells, [*by, "column"])
    named = F.col("column") == "catalyst"
    x = x.groupBy(*by).agg(*sums(), *[F.coalesce(F.sum(F.when(named, F.col(c))), F.lit(0)).cast("long").alias(f"c_{c}") for c in ("tp", "fp", "fn")], F.max(named).alias("c_any"))
    p, r = (F.try_divide(F.col("c_tp"), F.col("c_tp") + F.col(f"c_{c}")) for c in ("fp", "fn"))
    x = x.withColumn("catalyst_f1", F.when(F.col("c_any"), f1_of(p, r)))
    return with_prf(x.drop("c_tp", "c_fp", "c_fn", "c_any"))


def grouping_sets(cells: DataFrame, fixed: list[str], inner: tuple[str, str] = ("paper", "column")) -> DataFrame:
    """Counts per (paper, column), per column, per paper, and in all, in one pass; ``level`` says
    which. Rolled-up keys are null."""
    a, b = inner
    # The finest sums first: cells are counted once, not once a set.
    cells = pooled(cells, [*fixed, a, b])
    x = cells.groupingSets([[*fixed, a, b], [*fixed, b], [*fixed, a], [*fixed]], *fixed, a, b)
    out = x.agg(*sums(), F.grouping(a).alias("g_a"), F.grouping(b).alias("g_b"))
    level = F.when((F.col("g_a") == 0) & (F.col("g_b") == 0), F.lit(f"{a},{b}")).when(F.col("g_b") == 0, F.lit(b)).when(F.col("g_a") == 0, F.lit(a)).otherwise(F.lit("all"))
    return out.withColumn("level", level).drop("g_a", "g_b")


def over_repeats(scores: DataFrame, by: list[str]) -> DataFrame:
    """Means over repeats (nulls left out), and the sample deviation of f1, 0 for a single one."""
    return scores.groupBy(*by).agg(
        F.avg("f1").alias("f1_mean"),
        F.coalesce(F.stddev_samp("f1"), F.lit(0.0)).alias("f1_sd"),
        F.avg("p").alias("p_mean"),
        F.avg("r").alias("r_mean"),
        F.avg("f1_text").alias("f1_text_mean"),
        F.count("*").alias("n_reps"),
    )


def report_lines(summary: DataFrame, by: str = "version") -> DataFrame:
    """A line of text per row of ``over_repeats``: the numbers of a console report, without its layout."""
    part = lambda name, c: F.concat(F.lit(name), F.coalesce(F.format_number(F.round(F.col(c), 3), 3), F.lit("-")))
    line = F.concat_ws("  ", F.col(by), part("F1 ", "f1_mean"), part("sd ", "f1_sd"), part("P ", "p_mean"), part("R ", "r_mean"), F.concat(F.lit("n "), F.col("n_reps").cast("string")))
    return summary.select(by, line.alias("line"))


def per_paper_pivot(scores: DataFrame, versions: list[str]) -> DataFrame:
    return scores.groupBy("paper").pivot("version", versions).agg(F.avg("f1"))


def row_counts(truth: DataFrame, preds: DataFrame, matches: DataFrame, keys: list[str]) -> DataFrame:
    """n_gt, n_pred, n_matched, n_unmatched_pred per group and protocol of ``matches``."""
    shared = [k for k in keys if k in truth.columns]
    m = matches.groupBy(*keys, "protocol").agg(F.count("*").alias("n_matched"))
    p = preds.groupBy(*keys).agg(F.count("*").alias("n_pred"))
    t = truth.groupBy(*shared).agg(F.count("*").alias("n_gt"))
    x = p.join(t, shared, "inner").join(m, keys, "left").withColumn("n_matched", F.coalesce("n_matched", F.lit(0)))
    return x.select(*keys, "protocol", "n_gt", "n_pred", "n_matched", (F.col("n_pred") - F.col("n_matched")).alias("n_unmatched_pred"))


def with_deltas(scores: DataFrame, order: str, by: list[str] | None = None, value: str = "f1") -> DataFrame:
    """Change against the step before and against the first."""
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(order)
    first = F.first(value).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return scores.withColumn(f"d_{value}", F.col(value) - F.lag(value).over(w)).withColumn(f"d_{value}_base", F.col(value) - first)


def accuracy(pairs: DataFrame, ok: Column) -> DataFrame:
    """n, correct and the share; null for no rows."""
    return pairs.agg(F.count("*").alias("n"), F.count_if(ok).alias("correct"), F.try_divide(F.count_if(ok), F.count("*")).alias("accuracy"))


def merge_totals(parts: DataFrame, by: list[str], sums_of: list[str], ratio: tuple[str, str, str] | None = None) -> DataFrame:
    """Add partial totals; a ratio (name, part, whole) is made anew from the merged sums."""
    x = parts.groupBy(*by).agg(*[F.sum(c).alias(c) for c in sums_of])
    if ratio:
        name, part, whole = ratio
        x = x.withColumn(name, F.round(F.try_divide(F.col(part), F.col(whole)), 4))
    return x
