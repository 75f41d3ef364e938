"""Integrity: content hashes, checks against a manifest, completeness before finishing a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import missing_cells


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def file_hashes(spark: SparkSession, path: str, skip: tuple[str, ...] = ("manifest_SHA256.txt", "DO_NOT_RERUN")) -> DataFrame:
    """sha256 and name of every file below ``path``, hashed where it is read."""
    x = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    root = path.rstrip("/").removeprefix("file://")
    relative = F.regexp_replace(F.col("path"), r"^\w+:/*(?=/)", "")
    return x.where(~name.isin(*skip)).select(content_hash(F.col("content")).alias("sha256"), relative.substr(F.lit(len(root) + 2), F.length(relative)).alias("file"))


def manifest_lines(hashes: DataFrame) -> DataFrame:
    return hashes.select("file", F.concat("sha256", F.lit("  "), "file").alias("line"))


def changed_files(hashes: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that are new, gone or different: file, state."""
    a, b = hashes.select("file", F.col("sha256").alias("now")), manifest.select("file", F.col("sha256").alias("then"))
    x = a.join(b, "file", "full").where(~F.col("now").eqNullSafe(F.col("then")))
    return x.select("file", F.when(F.col("then").isNull(), "new").when(F.col("now").isNull(), "gone").otherwise("changed").alias("state"))


def finalised_cells(expected: DataFrame, present: DataFrame, replies: DataFrame) -> DataFrame:
    """Per cell its rows and its accepted and rejected reply files. A missing cell is an error: a
    run that isn't whole is not finished."""
    keys = ["slug", "version", "rep"]
    gaps = missing_cells(expected, present, keys).limit(5).collect()
    if gaps:
        raise ValueError(f"cells are missing, such as {[tuple(g) for g in gaps]}")
    counts = replies.groupBy(*keys).agg(F.count_if(~F.col("failed")).alias("n_calls"), F.count_if("failed").alias("n_failed_calls"))
    rows = present.groupBy(*keys).agg(F.count("pred_ord").alias("n_rows")) if "pred_ord" in present.columns else present.groupBy(*keys).agg(F.max("n_rows").alias("n_rows"))
    return expected.join(rows, keys).join(counts, keys, "left").fillna(0, ["n_calls", "n_failed_calls"])
