"""Grids, ordinals, top rows, samples and key sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import strip
from ..sources import files


def slug(paper: Column) -> Column:
    """A document's name in files: lower case, no spaces or slashes."""
    return F.replace(F.replace(F.lower(paper), F.lit(" "), F.lit("")), F.lit("/"), F.lit(""))


def small_side(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``df`` to be broadcast if it has at most ``rows`` rows, which is counted; else as Spark chooses."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def grid(*dims: DataFrame) -> DataFrame:
    """Every combination of small dimensions (documents, versions, repeats)."""
    out = dims[0]
    for d in dims[1:]:
        out = out.crossJoin(small_side(d))
    return out


def missing_cells(expected: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    return expected.join(present.select(*keys).distinct(), keys, "left_anti")


def zero_filled(keys: DataFrame, grouped: DataFrame, on: list[str], counts: list[str]) -> DataFrame:
    """Every key with its counts, zero where nothing was grouped."""
    return keys.distinct().join(grouped, on, "left").fillna(0, counts)


def top_n(df: DataFrame, by: list[str], order: list[Column | str], n: int) -> DataFrame:
    """The first ``n`` rows of each group; ``order`` ends in a tie-break."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("t_n", F.row_number().over(w)).where(F.col("t_n") <= n).drop("t_n")


def systematic_sample(df: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """Every k-th row of each group, k = rows div n (at least 1), ``n`` rows at most.

    Groups may be few and very large, so none is held by one task: rows are sorted over all tasks and kept with
    their place, and a group's places before a task's first row are counted by task."""
    spark, path = df.sparkSession, files.scratch(df.sparkSession, "sorted")
    # Written, so that both readings meet the same places.
    x = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("s_z", F.monotonically_increasing_id())
    x.write.parquet(path)
    x = spark.read.parquet(path).withColumn("s_p", F.shiftright("s_z", 33))
    parts = x.groupBy(*[F.col(c).alias(f"s__{c}") for c in by], F.col("s_p").alias("s__p")).agg(F.min("s_z").alias("s_first"), F.count("*").alias("s_m"))
    w = Window.partitionBy(*[f"s__{c}" for c in by])
    before = F.coalesce(F.sum("s_m").over(w.orderBy("s__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumns({"s_before": before, "s_n": F.sum("s_m").over(w)})
    same = F.col("s_p") == F.col("s__p")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"s__{c}"))
    i = F.col("s_z") - F.col("s_first") + F.col("s_before")
    step = F.greatest(F.lit(1), F.floor(F.col("s_n") / n).cast("long"))
    return x.join(parts, same).where((i % step == 0) & (F.floor(i / step) < n)).select(*df.columns)


def key_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Keys of either, with ``only``: a or b where one side alone has the key, null where both do."""
    x = a.distinct().withColumn("k_a", F.lit(True)).join(b.distinct().withColumn("k_b", F.lit(True)), a.columns, "full")
    return x.withColumn("only", F.when(F.col("k_b").isNull(), "a").when(F.col("k_a").isNull(), "b")).drop("k_a", "k_b")


def key_mismatch(union: DataFrame) -> DataFrame:
    """What a warning about two key sets says: n_keys, only_a, only_b, warning."""
    x = union.agg(F.count("*").alias("n_keys"), F.count_if(F.col("only") == "a").alias("only_a"), F.count_if(F.col("only") == "b").alias("only_b"))
    said = F.concat(F.lit("keys differ: "), F.col("only_a").cast("string"), F.lit(" in the first only, "), F.col("only_b").cast("string"), F.lit(" in the second only"))
    return x.withColumn("warning", F.when((F.col("only_a") > 0) | (F.col("only_b") > 0), said))


def positional_join(a: DataFrame, b: DataFrame, order_a: list[str], order_b: list[str], by: list[str]) -> DataFrame:
    """Rows of two lists side by side, over the shorter one; columns of ``b`` get a prefix."""
    x = a.withColumn("z_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order_a)))
    y = b.withColumn("z_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order_b)))
    y = y.select(*by, "z_n", *[F.col(c).alias(f"b_{c}") for c in b.columns if c not in by])
    return x.join(y, [*by, "z_n"]).withColumnRenamed("z_n", "place")


def header_row(cells: DataFrame, name: str) -> DataFrame:
    """Named cells of a sheet given as (row_no, col_no, value): its header is the first row with a
    cell ``name``; rows above it are dropped."""
    v = strip(F.col("value"))
    first = cells.where(v == name).agg(F.min("row_no").alias("h_row"))
    x = cells.join(F.broadcast(first), F.col("row_no") >= F.col("h_row"))  # one row
    head = x.where("row_no = h_row").select(F.col("col_no"), strip(F.col("value")).alias("header")).where("header <> ''")
    return x.where("row_no > h_row").join(head, "col_no").select("row_no", "header", strip(F.col("value")).alias("value"))


def map_merge(old: Column, new: Column) -> Column:
    """Entries of both maps; ``new`` wins."""
    kept = F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k))
    return F.map_concat(kept, new)
