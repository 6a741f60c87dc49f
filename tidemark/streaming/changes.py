"""Streaming twins of the change log, the keyed sink, the retrain gate and the lateness check."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.functions.scalars import stamp_instant
from tidemark.operators.changes import TRACKED
from tidemark.operators.ledger import upsert_table
from tidemark.operators.schedule import changed_leagues


def change_stream(
    observations: DataFrame,
    keys: tuple[str, ...] = ("season", "player_code"),
    tracked: tuple[str, ...] = TRACKED,
    order: tuple[str, ...] = ("observed_at",),
) -> DataFrame:
    """Emit an observation when its key is new or a tracked field differs from the last one seen.

    The state of a key is its last tracked fields. A key's rows of one micro-batch are ordered before
    they are compared, so bound the batch at the source (``maxFilesPerTrigger``); across batches rows
    are taken as they arrive.
    """
    schema = observations.schema
    state_schema = T.StructType([T.StructField(c, T.StringType()) for c in tracked])
    names = schema.fieldNames()

    def step(_key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = tuple(state.get) if state.exists else None
        rows = pd.concat(list(frames)).sort_values(list(order), kind="stable")
        fields = rows[list(tracked)].astype(object).where(rows[list(tracked)].notna(), None)
        keep = []
        for now in fields.itertuples(index=False, name=None):
            now = tuple(None if v is None else str(v) for v in now)
            keep.append(last is None or now != last)
            last = now
        state.update(last)
        yield rows.loc[pd.Series(keep, index=rows.index), names]

    return observations.groupBy(*keys).applyInPandasWithState(
        step, schema, state_schema, "append", GroupStateTimeout.NoTimeout
    )


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process everything available and append it to a table; restarts continue where they stopped."""
    job = (
        stream.writeStream.outputMode("append").format("parquet")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    job.awaitTermination()


def upsert_sink(
    stream: DataFrame, path: str, keys: list[str], checkpoint: str, partition: str = "season",
    after: Callable[[DataFrame, int], None] | None = None,
) -> None:
    """Keyed sink: each micro-batch rewrites only the partitions it touches.

    A replayed batch writes the same rows again, so the sink is idempotent. ``after`` runs once per
    batch, for instance to recompute the touched league seasons when a fixture has moved.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        upsert_table(batch.sparkSession, path, batch, keys, partition)
        if after is not None:
            after(batch, batch_id)

    job = (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    job.awaitTermination()


def retrain_gate(
    fingerprints: Callable[[SparkSession], DataFrame],
    published: Callable[[SparkSession], DataFrame],
    retrain: Callable[[DataFrame], None],
) -> Callable[[DataFrame, int], None]:
    """A batch hook that retrains only the leagues whose fingerprint moved."""

    def gate(batch: DataFrame, _batch_id: int) -> None:
        spark = batch.sparkSession
        moved = changed_leagues(fingerprints(spark), published(spark))
        if not moved.isEmpty():
            retrain(moved)

    return gate


GATE = "pool string, season string, n_played long, next_matchday int, batch_id long"


def firings(spark: SparkSession, path: str) -> DataFrame:
    """Every league that a recorded gate has let through, with its fingerprint and the batch."""
    try:
        return spark.read.schema(GATE).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], GATE)


def recorded_gate(
    fingerprints: Callable[[SparkSession], DataFrame], path: str, retrain: Callable[[DataFrame], None] | None = None
) -> Callable[[DataFrame, int], None]:
    """A batch hook that keeps the published fingerprints itself, each with the batch that published it.

    A league fires when its fingerprint differs from the newest one of earlier batches. A batch's firings are one folder
    that is overwritten when the batch is replayed, so a replay fires the same leagues and records them once.
    """

    def gate(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = firings(spark, path).filter(F.col("batch_id") < batch_id)
        known = before.groupBy("pool", "season").agg(F.max_by(F.struct("n_played", "next_matchday"), "batch_id").alias("r"))
        moved = changed_leagues(fingerprints(spark), known.select("pool", "season", "r.*"))
        target = f"{path}/batch_id={batch_id}"
        moved.select("pool", "season", "n_played", F.col("next_matchday").cast("int").alias("next_matchday")).write.mode("overwrite").parquet(target)
        if retrain is not None:
            fired = spark.read.schema(GATE.rsplit(",", 1)[0]).parquet(target)
            if not fired.isEmpty():
                retrain(fired)

    return gate


def late_forecasts(predictions: DataFrame, starts: DataFrame) -> DataFrame:
    """Forecasts stamped after their block's first kick-off. ``predictions`` may be a stream.

    ``starts`` is ``season, matchday, first_kickoff`` (and ``pool`` where both sides have it).
    """
    keys = [c for c in ("pool", "season", "matchday") if c in predictions.columns and c in starts.columns]
    return predictions.join(starts.select(*keys, "first_kickoff"), keys).filter(
        stamp_instant(F.col("created_at")) > F.col("first_kickoff")
    )
