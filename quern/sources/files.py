"""Small files and folders through Hadoop's file systems, so that any store works."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _place(spark, path)
    return fs.exists(at)


def write_text(spark: SparkSession, path: str, text: str, overwrite: bool = False) -> None:
    """One small file; an existing one is an error unless it may be replaced."""
    fs, at = _place(spark, path)
    out = fs.create(at, overwrite)
    out.write(bytearray(text.encode("utf-8")))
    out.close()


def names(spark: SparkSession, path: str) -> list[tuple[str, str, int, int]]:
    """(name, path, bytes, time of change in ms) of the files of a folder or glob; nothing is opened."""
    fs, at = _place(spark, path)
    found = fs.globStatus(at) or []
    out = []
    for status in found:
        for f in fs.listStatus(status.getPath()) if status.isDirectory() else [status]:
            if f.isFile():
                out.append((f.getPath().getName(), f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(out)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path: below ``spark.checkpoint.dir``, which all executors share, or a local one
    where that is unset and there is only the driver."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        base = "file://" + tempfile.mkdtemp(prefix="quern-")
    return f"{base.rstrip('/')}/quern/{uuid.uuid4().hex}/{name}"
