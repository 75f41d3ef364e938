"""Connected components by alternating large-star and small-star steps.

Each step is a grouped minimum and a join, so no component is gathered in one task; every round
is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, staged_at


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b: long); root is the smallest node reachable.

    Self-loops and repeated edges are harmless, null ends are ignored; no edges give no rows.
    """
    spark = edges.sparkSession
    e = edges.where("a is not null and b is not null and a <> b")
    e = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e, path = staged_at(e, "edges")
    before = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(low, F.col("a") == F.col("u")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        # All neighbours in ``large`` are smaller; each is tied to the smallest.
        tied = large.join(low, F.col("a") == F.col("u"))
        small = tied.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        e2, path2 = staged_at(small.distinct(), "edges")
        state = tuple(e2.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        drop_staged(spark, path)
        e, path = e2, path2
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    nodes = e.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return nodes.unionByName(roots.join(nodes.select("node"), "node", "left_anti"))
