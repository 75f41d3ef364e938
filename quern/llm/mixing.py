"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight schedule over training time 0..1, piecewise linear between knots. Its
integral is the source's cumulative token demand; scaled to the source's target it says how many
of its words are wanted by time t. Documents of a source stand in a seeded hash order, repeated
while the demand lasts (at most ``max_repeats`` times), and a document's training position is the
time at which the demand reaches its middle word: the inverse of the integrated schedule. The mix
is the documents range-sorted by position.

Targets: shares by weight of the total; a source stops at ``max_repeats`` times its size and the
excess is reshared by weight until none is above. The document at which a source's demand ends is
taken in part, so a source's words meet its target to within a word.

Cumulative sizes are two-level: sums per (source, hash range), then within a range, so a source
with a third of all rows is spread over many tasks. Driver state: one row per source.

Defined cases: null or empty texts have size 0 and are taken 0 words; a null source is a source of
its own, last; repeated rows are placed one by one; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_broadcast, staged

WORD = r"[^\x20\x09-\x0D]+"
PLAN_SCHEMA = "source string, source_size long, target double, knot_t array<double>, knot_w array<double>, knot_c array<double>"


def targets(sizes: Sequence[int], weights: Sequence[float], max_repeats: float = 3.0, total: float | None = None) -> list[float]:
    """Water-fill ``total`` (by default all sizes) over sources by weight under the repeat limit."""
    total = float(sum(sizes) if total is None else total)
    caps = [max_repeats * s for s in sizes]
    out = [0.0] * len(sizes)
    free = list(range(len(sizes)))
    while free:
        left = total - sum(out[i] for i in range(len(sizes)) if i not in set(free))
        share = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / share > caps[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / share
            break
        for i in over:
            out[i] = float(caps[i])
        gone = set(over)
        free = [i for i in free if i not in gone]
    return out


def default_schedule(k: int) -> list[tuple[float, float]]:
    """Sources fade out, stay level or come in, in turn."""
    return [[(0.0, 1.5), (0.5, 1.0), (1.0, 0.5)], [(0.0, 1.0), (1.0, 1.0)], [(0.0, 0.5), (0.5, 1.0), (1.0, 1.5)]][k % 3]


def integrate(knots: list[tuple[float, float]]) -> tuple[list[float], list[float], list[float]]:
    """Knot times, weights, and the share of the integral before each knot."""
    ts, ws = [float(t) for t, _ in knots], [float(w) for _, w in knots]
    c = [0.0]
    for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
        c.append(c[-1] + (t1 - t0) * (w0 + w1) / 2)
    if c[-1] <= 0:
        raise ValueError("a schedule needs a positive integral")
    return ts, [w / c[-1] for w in ws], [x / c[-1] for x in c]


def invert(u: Column) -> Column:
    """The time at which the share ``u`` of a source's demand is reached; a stable quadratic."""
    seg = F.greatest(F.lit(1), F.least(F.size("knot_c") - 1, F.size(F.filter("knot_c", lambda c: c <= u))))
    t0, t1 = F.element_at("knot_t", seg), F.element_at("knot_t", seg + 1)
    w0, w1 = F.element_at("knot_w", seg), F.element_at("knot_w", seg + 1)
    d = F.greatest(u - F.element_at("knot_c", seg), F.lit(0.0))
    slope = F.try_divide(w1 - w0, t1 - t0)
    root = w0 + F.sqrt(F.greatest(w0 * w0 + 2 * slope * d, F.lit(0.0)))
    return F.least(t1, t0 + F.coalesce(F.try_divide(2 * d, root), F.lit(0.0)))


def schedule(
    docs: DataFrame,
    weights: Sequence[float] = (1.0, 2.0, 3.0),
    max_repeats: int = 3,
    seed: int = 11,
    range_rows: int = 100_000,
    keep: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """One row per document: the ``keep`` columns, m_source, m_size, source_size, target, taken,
    copies (whole or part) and positions (array, one per copy, in 0..1)."""
    light = docs.select(
        *[F.col(f"`{c}`") for c in keep],
        F.col("source").alias("m_source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("m_size"),
        F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")).alias("m_hash"),
    )
    x = staged(light, "mix-sizes")
    spark = x.sparkSession
    found = x.groupBy("m_source").agg(F.sum("m_size").alias("s"), F.count("*").alias("n")).collect()
    found.sort(key=lambda r: (r[0] is None, r[0] or ""))
    wanted = targets([r[1] for r in found], [weights[k % len(weights)] for k in range(len(found))], max_repeats)
    plan = [
        (r[0], int(r[1]), float(t), *integrate(default_schedule(k))) for k, (r, t) in enumerate(zip(found, wanted, strict=True))
    ]
    plan_df = spark.createDataFrame(plan, PLAN_SCHEMA).withColumnRenamed("source", "p_source")
    ranges = max(64, -(-sum(r[2] for r in found) // range_rows))
    x = x.withColumn("m_range", F.pmod(F.shiftrightunsigned("m_hash", 20), F.lit(ranges)))
    sums = x.groupBy("m_source", "m_range").agg(F.sum("m_size").alias("r_size"))
    before = F.sum("r_size").over(Window.partitionBy("m_source").orderBy("m_range")) - F.col("r_size")
    sums = sums.select(F.col("m_source").alias("r_source"), F.col("m_range").alias("r_range"), before.alias("r_before"))
    x = x.join(
        bounded_broadcast(sums, 200_000), F.col("m_source").eqNullSafe(F.col("r_source")) & (F.col("m_range") == F.col("r_range"))
    ).drop("r_source", "r_range")
    w = Window.partitionBy("m_source", "m_range").orderBy("m_hash", "m_size")
    within = F.sum("m_size").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("m_size")
    x = x.withColumn("m_before", F.col("r_before") + within)
    # One row per source, gathered above: its size is known.
    x = x.join(F.broadcast(plan_df) if len(plan) <= 100_000 else plan_df, F.col("m_source").eqNullSafe(F.col("p_source")))
    size, total = F.col("m_size"), F.col("source_size")
    words = F.round(F.col("target")).cast("long")
    full = F.when(total > 0, F.expr("cast(round(target) as bigint) div source_size")).otherwise(F.lit(0)).cast("long")
    part = F.greatest(F.lit(0), F.least(size, words - full * total - F.col("m_before")))
    taken = F.least(F.lit(max_repeats) * size, full * size + part)
    x = x.withColumn("m_full", full).withColumn("m_part", part).withColumn("taken", F.when(size > 0, taken).otherwise(F.lit(0)).cast("long"))
    copies = F.when(size > 0, F.least(F.lit(max_repeats), F.col("m_full") + (F.col("m_part") > 0).cast("long"))).otherwise(0).cast("int")
    x = x.withColumn("copies", copies)
    middle = lambda e: F.least(F.lit(1.0), F.try_divide(e * total + F.col("m_before") + size / 2, F.col("target")))
    epochs = F.when(F.col("copies") > 0, F.sequence(F.lit(0), F.col("copies") - 1)).otherwise(F.array().cast("array<int>"))
    x = x.withColumn("positions", F.transform(epochs, lambda e: invert(middle(e))))
    return x.select(*[F.col(f"`{c}`") for c in keep], "m_source", "m_size", "source_size", "target", "taken", "copies", "m_full", "m_part", "positions")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix in training order, with the columns of ``docs``: repeated as
    scheduled, range-sorted by position. A document of which less than half is wanted at the end
    of its source's demand stays out, and one without words comes once, at the start."""
    wrapped = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("m_row"), "doc_id", "text", "source")
    plan = schedule(wrapped, keep=("m_row", "doc_id"), **options)
    whole = F.col("m_full") + F.when(F.col("m_part") * 2 >= F.col("m_size"), 1).otherwise(0)
    plan = plan.withColumn("m_copies", F.when(F.col("m_size") > 0, F.least(whole, F.col("copies"))).otherwise(F.lit(1)))
    at = F.when(F.col("m_size") > 0, F.slice("positions", F.lit(1), F.greatest(F.col("m_copies"), F.lit(0)).cast("int"))).otherwise(F.array(F.lit(0.0)))
    out = plan.select("m_row", "doc_id", F.explode(at).alias("position"))
    return out.orderBy("position", "doc_id").select("m_row.*")


def mix_documents(docs: DataFrame) -> DataFrame:
    """One row per document, range-sorted by the first training position (those not taken last): doc_id, size,
    source_size, target, taken, positions."""
    x = staged(schedule(docs).select("doc_id", F.col("m_size").alias("size"), "source_size", "target", "taken", "positions"), "mix-plan")
    return x.orderBy(F.asc_nulls_last(F.get("positions", F.lit(0))), "doc_id")
