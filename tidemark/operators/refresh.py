"""Tables that are refreshed whole: each answer is staged as a version, checked, and published by one appended row."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.intervals import keeps_enough

_LOG = "number long, version string"


def _published(spark: SparkSession, path: str):
    """The newest row of the log, or None before the first publication."""
    try:
        log = spark.read.schema(_LOG).parquet(f"{path}/log")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None
    return log.agg(F.max(F.struct("number", "version")).alias("r")).first()["r"]


def current(spark: SparkSession, path: str) -> DataFrame:
    """The version that was published last. Readers that opened an earlier one keep reading it."""
    newest = _published(spark, path)
    if newest is None:
        raise ValueError(f"nothing has been published in {path}")
    return spark.read.parquet(f"{path}/versions/{newest.version}")


def refresh(path: str, answer: DataFrame, min_share: float = 0.5) -> bool:
    """Replace the table by ``answer`` unless that is empty or keeps less than ``min_share`` of the rows it replaces.

    The answer is written beside the table and counted there, so it is computed once. Publication is one small file that
    appears at once: a job that dies before it leaves the old table, one that dies after it leaves the new one. Returns
    whether it was published. Of two answers published at the same moment the one with the larger version name stays.
    """
    spark = answer.sparkSession
    version = uuid.uuid4().hex
    answer.write.parquet(f"{path}/versions/{version}")
    staged = spark.read.schema(answer.schema).parquet(f"{path}/versions/{version}")
    newest = _published(spark, path)
    kept = current(spark, path) if newest is not None else answer.limit(0)
    if not keeps_enough(kept, staged, min_share):
        return False
    number = 1 if newest is None else newest.number + 1
    spark.createDataFrame([(number, version)], _LOG).coalesce(1).write.mode("append").parquet(f"{path}/log")
    return True
