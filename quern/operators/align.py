"""One-to-one alignment of predicted rows with truth rows, greedy in truth order.

Truth row by truth row takes the free prediction with the highest overlap (the first of equals) if
it reaches the floor. Rows of both sides are exchanged once, by the keys that they share, and sorted; pairs
are formed, scored and chosen from in blocks (``pairing``), so they are never rows of a plan unless asked for.

A row that comes out carries a ``code``, three bits a column, that says what became of each of its cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from ..schema import ALL_COLS, Protocol
from . import pairing

# What a cell's three bits stand for; 0 is a cell that neither side fills.
OUTCOMES = pairing.OUTCOMES


def _sorted_sides(truth: DataFrame, preds: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str], list[str], list[tuple]]:
    """Rows of both sides by their shared keys, truth rows first; those keys, the others, and the runs of the grid
    (versions and repeats), which are collected."""
    shared = [k for k in keys if k in truth.columns and k in preds.columns]
    groups = [k for k in keys if k not in shared]
    own = [F.col(c).cast("string").alias(c) for c in ALL_COLS if c not in shared]
    hidden = F.lit(0)
    if "_text_recoverable" in preds.columns:
        for i, c in enumerate(ALL_COLS):
            hidden = hidden + F.when(F.try_element_at("_text_recoverable", F.lit(c)) == F.lit(False), 1 << i).otherwise(0)
    absent = [F.lit(None).cast(preds.schema[k].dataType).alias(k) for k in groups]
    t = truth.select(*shared, *absent, F.lit(0).alias("side"), F.col("gt_ord").cast("bigint").alias("ord"), *own, F.lit(0).alias("hidden"))
    p = preds.select(*keys, F.lit(1).alias("side"), F.col("pred_ord").cast("bigint").alias("ord"), *own, hidden.alias("hidden"))
    x = t.unionByName(p).repartition(*shared).sortWithinPartitions(*shared, "side", *groups, "ord")
    runs = [tuple(r) for r in preds.select(*groups).distinct().collect()] if groups else [()]
    return x, shared, groups, runs


def _schema(x: DataFrame, keys: list[str], *more: tuple) -> StructType:
    return StructType([*[StructField(k, x.schema[k].dataType) for k in keys], *[StructField(n, t) for n, t in more]])


def score_pairs(truth: DataFrame, preds: DataFrame, protocols: list[Protocol], keys: list[str], codes: bool = True) -> DataFrame:
    """keys, protocol, floor, gt_ord, pred_ord, score, and code if wanted; a gated pair has score -1.

    ``truth`` and ``preds`` hold the ``keys`` they share, gt_ord or pred_ord, and the columns; ``preds``
    may have a _text_recoverable map. Pairs are formed once. What a protocol says of a cell depends on
    few of its rules, so protocols share those comparisons.
    """
    x, shared, groups, runs = _sorted_sides(truth, preds, keys)
    by = [*shared, *groups]
    fields = ["pred_ord bigint", "score int"] + (["code bigint"] if codes else [])
    pairs = StructType.fromDDL(f"s array<struct<{', '.join(f.replace(' ', ': ') for f in fields)}>>")["s"].dataType
    schema = _schema(x, by, ("protocol", StringType()), ("floor", IntegerType()), ("gt_ord", LongType()), ("s", pairs))
    x = x.mapInArrow(pairing.scored(protocols, shared, groups, runs, codes), schema)
    x = x.select(*by, "protocol", "floor", "gt_ord", F.explode("s").alias("s"))
    return x.select(*keys, "protocol", "floor", "gt_ord", *[f"s.{f.split()[0]}" for f in fields])


def greedy(
    truth: DataFrame, preds: DataFrame, protocols: list[Protocol], keys: list[str], present: bool = False, texts: bool = False, block: int = pairing.BLOCK
) -> DataFrame:
    """A row for each truth row in each run, with the prediction that it is paired with or none, and for
    each surplus prediction where the protocol penalises them: keys, protocol, side (gt or pred), gt_ord, pred_ord, code.

    ``truth`` must hold every group that is scored, also those without predictions; with ``present`` these are
    passed over. With ``texts`` the cells of both rows come along, as t__ and p__ columns. ``block`` bounds the pairs held.
    """
    x, shared, groups, runs = _sorted_sides(truth, preds, keys)
    by = [*shared, *groups]
    more = [("protocol", StringType()), ("side", StringType()), ("gt_ord", LongType()), ("pred_ord", LongType()), ("code", LongType())]
    more += [(f"{s}__{c}", StringType()) for s in "tp" for c in ALL_COLS] if texts else []
    return x.mapInArrow(pairing.outcomes(protocols, shared, groups, runs, present, texts, block), _schema(x, by, *more))


def greedy_large(truth: DataFrame, preds: DataFrame, protocols: list[Protocol], keys: list[str], **kw) -> DataFrame:
    """As ``greedy`` for groups of very many pairs: fewer are held at once, a group's truth rows come in parts."""
    return greedy(truth, preds, protocols, keys, block=pairing.BLOCK // 4, **kw)


def matches(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, protocol, gt_ord, pred_ord, code of the rows that were paired."""
    return rows.where("side = 'gt' and pred_ord is not null").select(*keys, "protocol", "gt_ord", "pred_ord", "code")


def cell_outcomes(x: DataFrame, protocols: list[Protocol], keys: list[str]) -> DataFrame:
    """One row per scored cell of the rows of ``greedy``: keys, protocol, side (gt or pred), gt_ord, pred_ord, column
    and the counts tp, tp_rng, fp, fp_un, fn, fn_fig."""
    by = [*keys, "protocol"]
    digit = lambda i: F.shiftright("code", 3 * i).bitwiseAND(F.lit(7)).cast("int")
    cells = F.array(*[F.struct(F.lit(c).alias("column"), digit(i).alias("digit")) for i, c in enumerate(ALL_COLS)])
    x = x.select(*by, "side", "gt_ord", "pred_ord", F.explode(cells).alias("c"))
    paper = [q.name for q in protocols if "no_paper" not in q]
    scored = (F.col("c.column") != "paper") | F.col("protocol").isin(*paper) if paper else F.col("c.column") != "paper"
    x = x.where(scored).select(*by, "side", "gt_ord", "pred_ord", "c.column", F.get(F.array(*[F.lit(o) for o in OUTCOMES]), F.col("c.digit")).alias("outcome"), "c.digit")
    count = lambda *o: F.col("digit").isin(*[OUTCOMES.index(y) for y in o]).cast("long")
    return x.select(
        "*",
        count("exact", "range").alias("tp"),
        count("range").alias("tp_rng"),
        count("fp", "miss", "fp_un").alias("fp"),
        count("fp_un").alias("fp_un"),
        count("fn", "fn_fig", "miss").alias("fn"),
        count("fn_fig").alias("fn_fig"),
    ).drop("digit")


def side_by_side(x: DataFrame, protocols: list[Protocol], keys: list[str], texts: bool = True) -> DataFrame:
    """Per cell of each truth row: truth, prediction and a mark; then the surplus predictions with
    their number of filled cells (column null). ``x`` are rows of ``greedy``, with their texts where these are wanted."""
    by = [*keys, "protocol"]
    paper = [q.name for q in protocols if "no_paper" not in q]
    digit = lambda i: F.shiftright("code", 3 * i).bitwiseAND(F.lit(7)).cast("int")
    scored = lambda c: F.lit(True) if c != "paper" else F.col("protocol").isin(*paper) if paper else F.lit(False)
    marks = F.array(*[F.lit({None: None, "exact": "✓", "range": "≈"}.get(o, "✗")) for o in OUTCOMES])
    cell = lambda c: [F.lit(c).alias("column"), *[F.col(f"{s}__{c}").alias(n) for s, n in (("t", "truth"), ("p", "pred")) if texts], F.get(marks, digit(ALL_COLS.index(c))).alias("mark"), scored(c).alias("scored")]
    own = x.where("side = 'gt'").select(*by, "gt_ord", "pred_ord", F.explode(F.array(*[F.struct(*cell(c)) for c in ALL_COLS])).alias("c")).where("c.scored")
    shown = ["column", *(["truth", "pred"] if texts else []), "mark"]
    own = own.select(*by, "gt_ord", "pred_ord", *[f"c.{c}" for c in shown], F.lit(None).cast("long").alias("n_filled"))
    filled = sum(F.when((digit(i) != 0) & scored(c), 1).otherwise(0) for i, c in enumerate(ALL_COLS))
    extra = x.where("side = 'pred'").groupBy(*by, "pred_ord").agg(F.sum(filled).alias("n_filled"))
    null = lambda c, t: F.lit(None).cast(t).alias(c)
    return own.unionByName(extra.select(*by, null("gt_ord", "bigint"), "pred_ord", *[null(c, "string") for c in shown], "n_filled"))
