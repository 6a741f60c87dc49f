"""Keyed and append-only tables: upsert, insert-if-absent, forecasts and their record."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import kickoff_instant, stamp_instant
from tidemark.session import stage


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows replace rows of the same key; other rows stay.

    With keys only, an existing row stays as it is. Within a batch the row with the highest
    ``_order`` (if the column is there) wins.
    """
    values = [c for c in existing.columns if c not in keys]
    order = F.col("_order") if "_order" in incoming.columns else F.lit(0)
    old = existing.select(*existing.columns, F.struct(F.lit(0).alias("b"), F.lit(0).cast("bigint").alias("o")).alias("_v"))
    new = incoming.select(
        *existing.columns, F.struct(F.lit(1).alias("b"), order.cast("bigint").alias("o")).alias("_v")
    )
    if not values:
        return old.unionByName(new).groupBy(*keys).agg(F.lit(1).alias("_n")).drop("_n")
    return (
        old.unionByName(new)
        .groupBy(*keys)
        .agg(F.max_by(F.struct(*values), "_v").alias("r"))
        .select(*[F.col(c) if c in keys else F.col(f"r.{c}").alias(c) for c in existing.columns])
    )


def insert_absent(
    existing: DataFrame, incoming: DataFrame, keys: list[str], known: DataFrame | None = None,
    known_key: str = "match_id", order: str | None = None,
) -> DataFrame:
    """Existing rows plus incoming ones whose key is new and whose match is known. First writer wins.

    Of incoming rows with one key the first in the batch's ``order`` column wins, or without one the least by all
    values: the same whichever way the rows arrive.
    """
    fresh = incoming.join(existing.select(*keys), keys, "left_anti")
    if known is not None:
        fresh = fresh.join(known.select(known_key).distinct(), known_key, "left_semi")
    rest = [c for c in existing.columns if c not in keys]
    if rest:
        fresh = (
            fresh.groupBy(*keys).agg(F.min(F.struct(*([F.col(order).alias("_order")] if order else []), *rest)).alias("r"))
            .select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])
        )
    else:
        fresh = fresh.select(*keys).distinct()
    return existing.unionByName(fresh.select(*existing.columns))


def upsert_table(
    spark: SparkSession, path: str, incoming: DataFrame, keys: list[str], partition: str = "season"
) -> None:
    """Upsert into a stored table, rewriting only the partitions the batch touches.

    The partition column must be part of the row's identity (a key never moves between partitions).
    The merged rows are staged before the overwrite, since they are read from the same table.
    """
    try:
        existing = spark.read.parquet(path)
    except Exception as error:  # first write
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        columns = [c for c in incoming.columns if c != "_order"]
        upsert(incoming.select(*columns).limit(0), incoming, keys).write.partitionBy(partition).parquet(path)
        return
    incoming = stage(incoming, "incoming")
    touched = existing.join(incoming.select(partition).distinct(), partition, "left_semi")
    merged = stage(upsert(touched.select(*[c for c in incoming.columns if c != "_order"]), incoming, keys), "merged")
    (
        merged.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition)
        .parquet(path)
    )


def record_of_forecast(predictions: DataFrame) -> DataFrame:
    """The forecast of record per match: the one of the latest run. A view; nothing is updated."""
    rest = [c for c in predictions.columns if c != "match_id"]
    return (
        predictions.groupBy("match_id")
        .agg(F.max_by(F.struct(*rest), F.struct("created_at", "run_id")).alias("r"))
        .select("match_id", "r.*")
    )


def record_before_kickoff(predictions: DataFrame, matches: DataFrame) -> DataFrame:
    """As above, but only runs published no later than the match's own kick-off count."""
    starts = matches.select(
        "match_id", kickoff_instant(F.col("match_date"), F.col("kickoff")).alias("_kickoff")
    )
    timely = predictions.join(starts, "match_id").filter(
        stamp_instant(F.col("created_at")) <= F.col("_kickoff")
    )
    return record_of_forecast(timely.drop("_kickoff"))


def latest_run(runs: DataFrame, season: str | None = None) -> DataFrame:
    """Newest run of a season, or of every season; metrics JSON as a map of text."""
    rows = runs if season is None else runs.filter(F.col("target_season") == season)
    rest = [c for c in runs.columns if c != "target_season"]
    return (
        rows.groupBy("target_season")
        .agg(F.max_by(F.struct(*rest), F.struct("created_at", "target_matchday")).alias("r"))
        .select("target_season", "r.*")
        .withColumn("metrics", F.coalesce(F.from_json("metrics", "map<string,string>"),
                                          F.create_map().cast("map<string,string>")))
    )
