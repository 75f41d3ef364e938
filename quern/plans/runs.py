"""A run's metadata: totals of its attempts, merging of invocations, and finishing it for good."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import manifest
from ..sources import files, readers

# The files that finish a run.
MANIFEST, MARKER = "manifest_SHA256.txt", "DO_NOT_RERUN"
ADDED = ("cells", "calls", "failed_calls", "wall_clock_s", "notional_cost_usd")
UNITED = ("versions", "papers", "models_observed")


def _rate() -> Column:
    return F.round(F.try_divide(F.col("failed_calls"), F.col("calls")), 4)


def run_metadata(attempts: DataFrame) -> DataFrame:
    """One row per run_id of an attempts table (run_id, slug, version, rep, status, elapsed_s, models,
    cost_usd): totals, and the sorted versions, papers and models that were seen."""
    distinct = lambda c: F.array_sort(F.collect_set(c))
    x = attempts.groupBy("run_id").agg(
        F.count_distinct("slug", "version", "rep").alias("cells"),
        F.count("*").alias("calls"),
        F.count_if(F.col("status") != "ok").alias("failed_calls"),
        F.round(F.sum("elapsed_s"), 1).alias("wall_clock_s"),
        F.round(F.sum("cost_usd"), 2).alias("notional_cost_usd"),
        distinct("version").alias("versions"),
        distinct("slug").alias("papers"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("models")))).alias("models_observed"),
    )
    return x.withColumns({"call_failure_rate": _rate(), "merged_invocations": F.lit(1).cast("long")})


def merge_metadata(*parts: DataFrame) -> DataFrame:
    """Metadata of invocations that share run ids: totals add up, sets unite, rates are made anew."""
    x = parts[0]
    for p in parts[1:]:
        x = x.unionByName(p)
    added = [F.round(F.sum(c), 2).alias(c) if c in ADDED[3:] else F.sum(c).alias(c) for c in ADDED]
    united = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in UNITED]
    x = x.groupBy("run_id").agg(*added, *united, F.sum("merged_invocations").alias("merged_invocations"))
    return x.withColumn("call_failure_rate", _rate())


def write_metadata(meta: DataFrame, path: str) -> None:
    """Merge one run's row into ``path``/meta.json, which may be missing, damaged or of another run
    (it is replaced then)."""
    spark = meta.sparkSession
    at = f"{path.rstrip('/')}/meta.json"
    if files.exists(spark, at):
        old = spark.read.schema(meta.schema).json(at).where("run_id is not null").join(F.broadcast(meta.select("run_id")), "run_id", "left_semi")
        meta = merge_metadata(old, meta)
    line = meta.select(F.to_json(F.struct(*sorted(meta.columns)))).first()  # one run is one row
    files.write_text(spark, at, line[0] + "\n", overwrite=True)


def is_frozen(spark: SparkSession, path: str) -> bool:
    return files.exists(spark, f"{path.rstrip('/')}/{MARKER}")


def finalise(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """Finish the run in folder ``path``: every expected cell (slug, version, rep) must have its file, all
    files are hashed into the manifest, and a marker is left that forbids writing into the folder.
    Gives rows and reply files per cell. A frozen run is an error."""
    root = path.rstrip("/")
    if is_frozen(spark, root):
        raise ValueError(f"{root} is finished")
    keys = ["slug", "version", "rep"]
    present = readers.discover(spark, f"{root}/*.json").select(*keys)
    rows = readers.read_predictions(spark, f"{root}/*.json").select(*keys, "pred_ord")
    present = present.join(rows, keys, "left")
    replies = readers.reply_files(spark, f"{root}/raw/*.txt")
    cells = manifest.finalised_cells(expected, present, replies)
    lines = manifest.manifest_lines(manifest.file_hashes(spark, root, (MANIFEST, MARKER))).orderBy("file")
    text = "\n".join(r[0] for r in lines.select("line").toLocalIterator())  # a line per file of one run
    files.write_text(spark, f"{root}/{MANIFEST}", text + "\n")
    files.write_text(spark, f"{root}/{MARKER}", "finished; not to be written into\n")
    return cells
