"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def work_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; one of our own only where it is unset and
    the driver is the only executor."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.conf.get("quern.work.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        path = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("quern.work.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A new folder for a table; all of an application's are below one, see ``clean``."""
    return f"{work_dir(spark)}/quern/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}/{name}"


def clean(spark: SparkSession) -> None:
    """Delete all tables and archives that this application has staged, once no result is read any more."""
    drop_staged(spark, f"{work_dir(spark)}/quern/{spark.sparkContext.applicationId}")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: cuts lineage, survives
    lost executors, and fixes the partition layout for what follows."""
    out, out.staged_at = staged_at(df, name)
    return out


def drop(*tables: DataFrame) -> None:
    """Delete staged tables whose last reader has been written."""
    for t in tables:
        drop_staged(t.sparkSession, t.staged_at)


def staged_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = new_path(spark, name)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path), path


def drop_staged(spark: SparkSession, path: str) -> None:
    """Delete a staged table that nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, UPPER, UPPER.lower())


def small(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than it must."""
    return df.limit(rows + 1).count() <= rows


def bounded_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint only if its size was checked; else Spark chooses a shuffle join."""
    return F.broadcast(df) if small(df, rows) else df


def skew_join(x: DataFrame, y: DataFrame, on: list[str], how: str = "inner", counted: str | None = None, parts: int = 64, shares: int = 100_000, least: int = 10_000) -> DataFrame:
    """``x`` joined with ``y`` on the columns ``on`` of both. Keys with over ``least`` rows and over 1 / ``shares`` of
    ``x`` (so ``shares`` keys at most, which are broadcast) are dealt to ``parts`` tasks by the rest of the row, and
    their rows of ``y``, of which there should be few, go to each. ``counted``: a column of ``y`` that has the rows of
    ``x`` by key already; it is dropped."""
    least = max(least, x.count() // shares)
    n = y.select(*on, F.col(counted).alias("j_n")) if counted else x.groupBy(*on).agg(F.count("*").alias("j_n"))
    hot = staged(n.where(F.col("j_n") > least).select(*on, F.lit(True).alias("j_hot")), "hot")
    y = y.drop(counted) if counted else y
    if not hot.limit(1).count():
        return x.join(y, on, how)
    hot = F.broadcast(hot)
    x = x.join(hot, on, "left").withColumn("j_salt", F.when(F.col("j_hot"), F.pmod(F.xxhash64(*x.columns), F.lit(parts)).cast("int")).otherwise(0)).drop("j_hot")
    every = F.sequence(F.lit(0), F.lit(parts - 1))
    y = y.join(hot, on, "left").withColumn("j_salt", F.explode(F.when(F.col("j_hot"), every).otherwise(F.array(F.lit(0))))).drop("j_hot")
    return x.join(y, [*on, "j_salt"], how).drop("j_salt")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
