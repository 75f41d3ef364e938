"""Record processing has no streaming semantics: runs are closed sets of files. Attempt logs are
append-only JSON lines and can be followed with ``readStream``; every operator of this package that
works row by row (units, compositions, line repair, reply parsing) applies to such a stream as is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.readers import ATTEMPT_SCHEMA


def follow_attempts(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(ATTEMPT_SCHEMA).json(path)
