"""Read-side queries over matches and the forecast ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import TARGET_COMPETITION
from tidemark.functions.names import display_name
from tidemark.functions.scalars import kickoff_instant, stamp_instant
from tidemark.operators.ledger import record_of_forecast
from tidemark.operators.schedule import LEAGUE, next_to_play

FORECAST_COLUMNS = [
    "predicted_outcome", "p_home", "p_draw", "p_away", "pred_home_goals", "pred_away_goals",
    "exp_home_goals", "exp_away_goals", "scoreline_prob", "run_id",
]
BLOCK = [*LEAGUE, "matchday"]
# Result labels.
LABELS = {"H": "Home win", "D": "Draw", "A": "Away win"}


def _label(code: Column) -> Column:
    result = F.lit(None).cast("string")
    for key, text in LABELS.items():
        result = F.when(code == key, text).otherwise(result)
    return result


def with_record(matches: DataFrame, predictions: DataFrame, target: str = TARGET_COMPETITION) -> DataFrame:
    """Target matches with their forecast of record, where there is one."""
    record = record_of_forecast(
        predictions.select("match_id", *FORECAST_COLUMNS, "created_at")
    ).withColumnRenamed("created_at", "predicted_at")
    return matches.filter(F.col("competition") == target).join(record, "match_id", "left")


def block_starts(matches: DataFrame) -> DataFrame:
    """First kick-off instant of every block, read as UTC."""
    return matches.groupBy(*BLOCK).agg(
        F.min(kickoff_instant(F.col("match_date"), F.col("kickoff"))).alias("first_kickoff")
    )


def match_view(matches: DataFrame, predictions: DataFrame) -> DataFrame:
    """The block page's rows: one per match, shaped for reading."""
    rows = with_record(matches, predictions)
    rows = rows.join(block_starts(rows), BLOCK, "left")
    played = F.col("home_goals").isNotNull() & F.col("away_goals").isNotNull()
    predicted = F.col("predicted_outcome").isNotNull()
    return rows.select(
        *BLOCK, "match_id", F.col("match_date").alias("date"), "kickoff", "home_team", "away_team",
        display_name(F.col("home_team")).alias("home_short"),
        display_name(F.col("away_team")).alias("away_short"),
        played.alias("played"), "home_goals", "away_goals", "result",
        _label(F.col("result")).alias("result_label"),
        predicted.alias("has_prediction"), "predicted_outcome",
        _label(F.col("predicted_outcome")).alias("predicted_label"),
        *[F.when(predicted, F.col(c)).alias(c) for c in ("p_home", "p_draw", "p_away")],
        F.when(predicted, F.greatest("p_home", "p_draw", "p_away")).alias("confidence"),
        "pred_home_goals", "pred_away_goals", "exp_home_goals", "exp_away_goals", "scoreline_prob",
        F.when(played & predicted, F.col("predicted_outcome") == F.col("result")).alias("outcome_correct"),
        "run_id", "predicted_at",
        (stamp_instant(F.col("predicted_at")) <= F.col("first_kickoff")).alias("published_before_kickoff"),
        F.when(F.col("original_matchday") != F.col("matchday"), F.col("original_matchday")).alias(
            "rearranged_from"
        ),
        "first_kickoff",
    )


def block_summary(view: DataFrame) -> DataFrame:
    """One row per block over ``match_view``."""
    correct = F.col("outcome_correct")
    exact = (F.col("pred_home_goals") == F.col("home_goals")) & (
        F.col("pred_away_goals") == F.col("away_goals")
    )
    return view.groupBy(*BLOCK).agg(
        F.count("*").alias("n_matches"),
        F.bool_and("played").alias("is_complete"),
        F.bool_or("played").alias("any_played"),
        F.count_if(correct.isNotNull()).alias("n_scored"),
        F.count_if(correct).alias("n_correct"),
        F.count_if(correct.isNotNull() & exact).alias("n_exact_scores"),
        F.avg(correct.cast("double")).alias("accuracy"),
        F.array_join(F.sort_array(F.collect_set(F.col("date").cast("string"))), ",").alias("dates"),
        F.coalesce(F.bool_or(~F.col("published_before_kickoff")), F.lit(False)).alias("published_late"),
        F.min("first_kickoff").alias("first_kickoff"),
    )


def season_rollup(matches: DataFrame, predictions: DataFrame) -> DataFrame:
    """One row per block for the season navigator. Lateness compares stamps as text, to the minute."""
    rows = with_record(matches, predictions)
    done, told = F.col("result").isNotNull(), F.col("predicted_outcome").isNotNull()
    start = F.concat_ws(" ", F.col("match_date").cast("string"), F.coalesce("kickoff", F.lit("00:00")))
    out = rows.groupBy(*BLOCK).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("status") == "played").alias("played"),
        F.min("match_date").alias("first_date"),
        F.max("match_date").alias("last_date"),
        F.count_if(told).alias("predicted"),
        F.count_if(done & told).alias("n_scored"),
        F.count_if(done & (F.col("predicted_outcome") == F.col("result"))).alias("n_correct"),
        F.min(F.when(F.col("match_date").isNotNull(), start)).alias("first_kickoff"),
        F.min("predicted_at").alias("first_predicted_at"),
    )
    minute = lambda c: F.translate(F.substring(c, 1, 16), "T", " ")
    return out.select(
        *BLOCK, "n", "played", (F.col("played") == F.col("n")).alias("is_complete"),
        "first_date", "last_date", (F.col("predicted") > 0).alias("has_predictions"),
        "n_scored", "n_correct", F.try_divide("n_correct", "n_scored").alias("accuracy"),
        F.coalesce(minute("first_predicted_at") > F.substring("first_kickoff", 1, 16), F.lit(False)).alias(
            "published_late"
        ),
    )


def season_record(matches: DataFrame, predictions: DataFrame) -> DataFrame:
    """Running hit rates per league season over matches with a result and a forecast."""
    rows = with_record(matches, predictions).filter(
        F.col("result").isNotNull() & F.col("run_id").isNotNull()
    )
    exact = (F.col("pred_home_goals") == F.col("home_goals")) & (
        F.col("pred_away_goals") == F.col("away_goals")
    )
    return rows.groupBy(*LEAGUE).agg(
        F.count("*").alias("scored"),
        F.count_if(F.col("predicted_outcome") == F.col("result")).alias("correct"),
        F.count_if(exact).alias("exact"),
    ).select(
        "*", F.try_divide("correct", "scored").alias("accuracy"), F.try_divide("exact", "scored").alias("exact_rate")
    )


def available_seasons(matches: DataFrame, target: str = TARGET_COMPETITION) -> DataFrame:
    return (
        matches.filter(F.col("competition") == target).select("season").distinct().orderBy(F.desc("season"))
    )


def freshness(matches: DataFrame, target: str = TARGET_COMPETITION) -> DataFrame:
    done = (F.col("competition") == target) & (F.col("status") == "played")
    return matches.agg(
        F.max("updated_at").alias("ingested_at"),
        F.count("*").alias("n_matches"),
        F.max(F.when(done, F.col("match_date"))).alias("latest_result_date"),
    )


def publication_problems(
    matches: DataFrame, predictions: DataFrame, target: str = TARGET_COMPETITION
) -> DataFrame:
    """Blocks that should carry a forecast and do not: started ones, and the next one to play."""
    rows = matches.filter(F.col("competition") == target)
    told = (
        rows.join(predictions.select("match_id").distinct(), "match_id", "left_semi").select(*BLOCK).distinct()
    )
    started = rows.filter((F.col("status") == "played") & F.col("matchday").isNotNull()).select(*BLOCK).distinct()
    upcoming = next_to_play(rows, tuple(LEAGUE)).filter("next_matchday is not null").select(
        *LEAGUE, F.col("next_matchday").alias("matchday")
    )
    return (
        started.withColumn("problem", F.lit("played without a forecast"))
        .unionByName(upcoming.withColumn("problem", F.lit("next to play and not forecast")))
        .join(told, BLOCK, "left_anti")
    )


MART_MATCH_COLUMNS = [
    "match_id", "season", "competition", "matchday", "original_matchday", "match_date", "kickoff",
    "home_team", "away_team", "home_goals", "away_goals", "result", "status", "updated_at",
]


def mart_tables(
    matches: DataFrame, runs: DataFrame, predictions: DataFrame, season: str | None = None
) -> dict[str, DataFrame]:
    """The slim serving tables: target competition only, features left out."""
    tables = {
        "matches": matches.filter(F.col("competition") == TARGET_COMPETITION).select(*MART_MATCH_COLUMNS),
        "model_runs": runs,
        "predictions": predictions,
        "current_predictions": record_of_forecast(predictions).select("match_id", "run_id", "season", "matchday"),
    }
    if season is None:
        return tables
    return {
        name: frame.filter(F.col("target_season" if name == "model_runs" else "season") == season)
        for name, frame in tables.items()
    }


def export_mart(folder: str, tables: dict[str, DataFrame]) -> None:
    """One folder per table, partitioned by season where there is one."""
    for name, frame in tables.items():
        by = ["season"] if "season" in frame.columns else ["target_season"]
        frame.write.mode("overwrite").partitionBy(*by).parquet(f"{folder}/{name}")
