"""Change logs: emit on change, and state as of an instant."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.timeline import half_year

TRACKED = ("fpl_team", "status", "chance_next", "chance_this", "news")


def emit_changes(
    observations: DataFrame,
    keys: tuple[str, ...] = ("season", "player_code"),
    tracked: tuple[str, ...] = TRACKED,
    order: tuple[str, ...] = ("observed_at",),
) -> DataFrame:
    """Keep an observation if it is the key's first or differs in a tracked field from the one before.

    Rows compare with their predecessor inside (key, day); a day's first row compares with the last
    row of the key's previous day, taken from one summary row per key and day. A window group is one
    day of a key, or one row per day. Null keys are keys like others; rows without a stamp are the earliest.
    """
    state = F.struct(*[F.col(c) for c in tracked])
    at = F.struct(*[F.col(c) for c in order])
    rows = observations.withColumn("_state", state).withColumn("_day", F.to_date(order[0]))
    ends = rows.groupBy(*keys, "_day").agg(F.max(F.struct(at.alias("at"), F.col("_state").alias("s")))["s"].alias("_end"))
    ends = ends.withColumn("_before", F.lag("_end").over(Window.partitionBy(*keys).orderBy("_day")))
    inside = Window.partitionBy(*keys, "_day").orderBy(*order)
    numbered = rows.withColumn("_prev", F.lag("_state").over(inside)).withColumn("_first", F.row_number().over(inside) == 1)
    same = [numbered[k].eqNullSafe(ends[k]) for k in [*keys, "_day"]]
    joined = numbered.join(ends, reduce(and_, same)).select(*[numbered[c] for c in numbered.columns], ends["_before"])
    previous = F.when(F.col("_first"), F.col("_before")).otherwise(F.col("_prev"))
    return joined.filter(~F.col("_state").eqNullSafe(previous)).select(*observations.columns)


def append_changes(log: DataFrame, snapshot: DataFrame, keys=("season", "player_code"), tracked=TRACKED) -> DataFrame:
    """Rows of a new snapshot that differ from the log's latest state of their key."""
    known = latest_state(log, keys).select(
        *keys, F.struct(*[F.col(c) for c in tracked]).alias("_known"), F.lit(True).alias("_seen")
    )
    now = F.struct(*[F.col(c) for c in tracked])
    return (
        snapshot.join(known, list(keys), "left")
        .filter(F.col("_seen").isNull() | ~now.eqNullSafe(F.col("_known")))
        .select(*snapshot.columns)
    )


def latest_state(
    log: DataFrame, keys: tuple[str, ...] = ("season", "player_code"), as_of: Column | None = None,
    order: tuple[str, ...] = ("observed_at",),
) -> DataFrame:
    """Last row of each key at or before an instant; on equal stamps the later row (``order``) wins."""
    rows = log if as_of is None else log.filter(F.col(order[0]) <= as_of)
    rest = [c for c in log.columns if c not in keys]
    return (
        rows.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct(*[F.col(c) for c in order])).alias("r"))
        .select(*keys, "r.*")
    )


def state_at(log: DataFrame, asks: DataFrame, key: str, value: str, at: str = "ts") -> DataFrame:
    """State of a key at many instants: the last ``value`` at or before each ask.

    Log and asks are put into one order per (key, half-year); the last value of earlier half-years
    comes from one summary row each. Both inputs need ``key`` and ``at``.
    """
    rows = (
        log.select(key, at, F.lit(0).alias("_ask"), F.struct(value).alias("_v"), F.lit(None).cast("string").alias("ask_id"))
        .unionByName(
            asks.select(key, at, F.lit(1).alias("_ask"), F.lit(None).cast(f"struct<{value}:string>").alias("_v"), "ask_id")
        )
        .withColumn("_chunk", half_year(F.col(at)))
    )
    inside = Window.partitionBy(key, "_chunk").orderBy(at, "_ask").rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.groupBy(key, "_chunk").agg(
        F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col(at))).alias("_end")
    )
    before = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_carry", F.last("_end", ignorenulls=True).over(before))
    return (
        rows.withColumn("_local", F.last("_v", ignorenulls=True).over(inside))
        .filter("_ask = 1")
        .join(ends.select(key, "_chunk", "_carry"), [key, "_chunk"], "left")
        .select("ask_id", key, at, F.coalesce("_local", "_carry")[value].alias(value))
    )


def status_counts(snapshot: DataFrame) -> DataFrame:
    """Rows per status and how many are not simply available."""
    return snapshot.groupBy("status").agg(F.count("*").alias("n")).withColumn(
        "not_available", F.when(F.col("status") != "a", F.col("n")).otherwise(0)
    )
