"""Sources. Keys that stand in file names become columns; list order becomes an ordinal column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import null_csv
from ..schema import ALL_COLS, PREDICTION_SCHEMA, TRUTH_SCHEMA
from . import files

# The file layouts of a run.
EXTRACTED = r"^(.+?)_(B0|V\d)_r(\d+)_extracted\.json$"
FLAT = r"^(.+)_extracted\.json$"
REPLY = r"^(.+?)_(B0|V\d)_r(\d+)_(.+?)(?:_a(\d+))?(?:\.FAILED)?\.txt$"
ATTEMPT_SCHEMA = (
    "slug string, version string, rep int, chunk string, attempt int, elapsed_s double, models array<string>, cost_usd double, status string, "
    "reply_form string, n_rows int, error string"
)


def file_name() -> Column:
    """The plain name; Spark's is escaped, as in ``results%5B2%5D``, but for a plus sign."""
    return F.url_decode(F.replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), F.lit("+"), F.lit("%2B")))


def read_truth(spark: SparkSession, path: str, paper: str | None = None) -> DataFrame:
    """A reference table with gt_ord, its order in the file, or over the files of a folder by their names; rows
    without a paper are dropped."""
    x = spark.read.schema(TRUTH_SCHEMA).option("header", True).option("multiLine", True).option("ignoreLeadingWhiteSpace", False).csv(path)
    many = len(x.inputFiles()) > 1
    own = [null_csv(F.regexp_replace(F.col(c), "\r$", "")).alias(c) for c in ALL_COLS]
    # A whole file is one task (multiLine), and ids rise within it.
    x = x.select(*own, F.monotonically_increasing_id().alias("gt_ord"), *([F.col("_metadata.file_path").alias("t_file")] if many else []))
    if many:  # a file's rows are counted from its first one on, after those of the files before it: one row a file
        found = sorted(x.groupBy("t_file").agg(F.min("gt_ord"), F.count("*")).collect())
        starts, at = [], 0
        for name, first, n in found:
            starts.append((name, at - first))
            at += n
        starts = spark.createDataFrame(starts, "t_file string, t_shift long")
        x = x.join(F.broadcast(starts), "t_file").withColumn("gt_ord", F.col("gt_ord") + F.col("t_shift")).drop("t_file", "t_shift")
    x = x.where("paper is not null")
    return x.where(F.col("paper") == paper) if paper is not None else x


def read_predictions(spark: SparkSession, path: str, layout: str = EXTRACTED) -> DataFrame:
    """Prediction rows of ``*_extracted.json`` files: slug (and version, rep), pred_ord, columns."""
    rows = spark.read.text(path, wholetext=True).select(file_name().alias("file"), F.from_json("value", f"array<struct<{_struct()}>>").alias("rows"))
    x = rows.select("file", F.posexplode("rows").alias("pred_ord", "r")).where(F.col("file").rlike(layout))
    keys = [F.regexp_extract("file", layout, 1).alias("slug")]
    if layout == EXTRACTED:
        keys += [F.regexp_extract("file", layout, 2).alias("version"), F.regexp_extract("file", layout, 3).cast("int").alias("rep")]
    return x.select(*keys, F.col("pred_ord").cast("bigint").alias("pred_ord"), "r.*")


def _struct() -> str:
    return ", ".join(f"{n}: {t}" for n, t in (c.strip().split(" ", 1) for c in PREDICTION_SCHEMA.replace("map<string,", "map<string;").split(","))).replace("map<string;", "map<string,")


def _listed(spark: SparkSession, path: str, layout: str) -> DataFrame:
    """The files of a folder or glob whose names fit; listed, not opened."""
    names = [(n,) for n, *_ in files.names(spark, path)]
    return spark.createDataFrame(names, "file string").where(F.col("file").rlike(layout))


def _cell(layout: str, file: str = "file") -> list[Column]:
    part = lambda k: F.regexp_extract(file, layout, k)
    return [part(1).alias("slug"), part(2).alias("version"), part(3).cast("int").alias("rep")]


def discover(spark: SparkSession, path: str) -> DataFrame:
    """The cells (slug, version, rep) that a run has files for, told by the names in a folder or glob."""
    return _listed(spark, path, EXTRACTED).select(*_cell(EXTRACTED), "file")


def reply_files(spark: SparkSession, path: str) -> DataFrame:
    """The reply files of a folder or glob, by their names: slug, version, rep, label, failed, path."""
    x = _listed(spark, path, REPLY)
    return x.select(*_cell(REPLY), F.regexp_extract("file", REPLY, 4).alias("label"), F.col("file").endswith(".FAILED.txt").alias("failed"), F.col("file").alias("path"))


def read_replies(spark: SparkSession, path: str) -> DataFrame:
    """Saved replies: slug, version, rep, label, failed, path, text."""
    x = spark.read.text(path, wholetext=True).select(file_name().alias("path"), F.col("value").alias("text"))
    x = x.where(F.col("path").rlike(REPLY))
    part = lambda k: F.regexp_extract("path", REPLY, k)
    return x.select(part(1).alias("slug"), part(2).alias("version"), part(3).cast("int").alias("rep"), part(4).alias("label"), F.col("path").endswith(".FAILED.txt").alias("failed"), "path", "text")


def read_attempts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ATTEMPT_SCHEMA).json(path)


def read_digit_truth(spark: SparkSession, path: str) -> DataFrame:
    """Tokens and their printed values: idx, page, ocr_token, truth; comments are skipped."""
    x = spark.read.schema("idx string, page string, ocr_token string, truth string").option("sep", "\t").option("comment", "#").option("quote", "").csv(path)
    return x.where("idx <> 'idx'").select(F.col("idx").cast("int"), F.col("page").cast("int"), "ocr_token", "truth")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Metadata files as (file, value); what isn't JSON has a null value."""
    x = spark.read.text(path, wholetext=True)
    return x.select(file_name().alias("file"), F.try_parse_json("value").alias("value"))


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A sheet saved as CSV in cells: row_no, col_no, value. Its header is found later."""
    x = spark.read.text(path).withColumn("row_no", F.monotonically_increasing_id())
    # A row's width is bounded by its commas, so a schema of the widest row holds every cell.
    width = 1 + (x.agg(F.max(F.length("value") - F.length(F.replace("value", F.lit(","), F.lit(""))))).first()[0] or 0)
    cells = F.from_csv("value", F.lit(", ".join(f"c{i} string" for i in range(width))))
    x = x.select("row_no", cells.alias("c")).select("row_no", F.posexplode(F.array(*[F.col(f"c.c{i}") for i in range(width)])).alias("col_no", "value"))
    return x.where("value is not null")


def read_page_texts(spark: SparkSession, path: str) -> DataFrame:
    """Texts with ``[Page N]`` markers as pages: doc, page, text. Table markers stay in the text."""
    x = spark.read.text(path, wholetext=True).select(F.regexp_replace(file_name(), r"\.[^.]*$", "").alias("doc"), F.col("value").alias("text"))
    pages = F.regexp_extract_all("text", F.lit(r"\[Page (\d+)\]"), F.lit(1))
    bodies = F.slice(F.split("text", r"\[Page \d+\]", -1), F.lit(2), F.size(pages))
    x = x.select("doc", F.explode(F.arrays_zip(pages.alias("page"), bodies.alias("text"))).alias("p"))
    return x.select("doc", F.col("p.page").cast("int").alias("page"), F.regexp_replace(F.col("p.text"), "^\n|\n+$", "").alias("text"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    x = spark.read.text(path).where("value <> ''")
    return x.select(F.regexp_extract("value", r"^([0-9a-f]{64})  (.*)$", 1).alias("sha256"), F.regexp_extract("value", r"^([0-9a-f]{64})  (.*)$", 2).alias("file"))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Name, path, length and time of change of a folder's or glob's files; none is opened."""
    x = spark.createDataFrame(files.names(spark, path), "file string, path string, length long, millis long")
    return x.select("file", "path", "length", F.timestamp_millis("millis").alias("modificationTime"))
