"""Sinks. Tables are written by Spark; a run's folder is never written over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.tables import systematic_sample
from . import files


def write_records(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Rows as JSON, partitioned by the cell they belong to; never into a run that is finished."""
    if files.exists(rows.sparkSession, f"{path.rstrip('/')}/DO_NOT_RERUN"):
        raise ValueError(f"{path} is finished")
    rows.write.mode(mode).partitionBy("slug", "version", "rep").json(path)


def append_attempts(attempts: DataFrame, path: str) -> None:
    attempts.write.mode("append").json(path)


def write_csv(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    rows.write.mode(mode).option("header", True).csv(path)


def write_lines(rows: DataFrame, line: Column, path: str, order: list[str], mode: str = "errorifexists") -> None:
    """One text line per row, in order over the part files."""
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select(line.alias("value")).write.mode(mode).text(path)


def write_repaired(repaired: DataFrame, path: str, mode: str = "errorifexists") -> None:
    write_lines(repaired, F.col("fixed"), path, ["doc", "page", "line_no"], mode)


def as_json(df: DataFrame, keys: list[str]) -> DataFrame:
    """Each row as a JSON text; nulls are spelled out."""
    return df.select(*keys, F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def verification_sheet(edits: DataFrame, n: int) -> DataFrame:
    """A spread of edits to check by eye: page, tier, token before and after, the line."""
    x = systematic_sample(edits, ["doc"], ["page", "line_no", "n"], n)
    return x.select("doc", "page", "tier", F.col("before").alias("ocr_token"), F.col("after").alias("repaired_token"), F.substring("line_before", 1, 80).alias("ocr_line"))
