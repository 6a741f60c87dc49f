"""Which round a fixture is played in, which round is next, and whether anything moved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import TARGET_COMPETITION

CORE_DAYS = 4
LEAGUE = ["pool", "season"]


def round_cores(fixtures: DataFrame, round_col: str = "matchday") -> DataFrame:
    """Lower-median date of each (pool, season, round) and the first date within four days of it.

    Dates are counted first, so the median works on distinct days and a crowded round stays small.
    """
    days = (
        fixtures.filter(F.col(round_col).isNotNull() & F.col("match_date").isNotNull())
        .groupBy(*LEAGUE, F.col(round_col).alias("round"), "match_date")
        .agg(F.count("*").alias("n"))
    )
    medians = days.groupBy(*LEAGUE, "round").agg(
        F.expr("sort_array(collect_list(struct(match_date, n)))").alias("days"), F.sum("n").alias("total")
    )
    # Lower median: the first day whose running count reaches (total + 1) div 2.
    walked = F.aggregate(
        "days",
        F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("date").alias("at")),
        lambda acc, d: F.struct(
            (acc.seen + d.n).alias("seen"),
            F.when(
                acc["at"].isNull() & (acc.seen + d.n >= F.floor((F.col("total") + 1) / 2)), d.match_date
            ).otherwise(acc["at"]).alias("at"),
        ),
    )
    return medians.withColumn("median_date", walked["at"]).select(
        *LEAGUE, "round", "median_date",
        F.array_min(
            F.transform(
                F.filter("days", lambda d: F.abs(F.datediff(d.match_date, F.col("median_date"))) <= CORE_DAYS),
                lambda d: d.match_date,
            )
        ).alias("core_start"),
    )


def assign_rounds(
    matches: DataFrame, scheduled: str = "original_matchday", target: str = TARGET_COMPETITION
) -> DataFrame:
    """Set ``matchday`` to the round a target fixture is played in; keep ``original_matchday``.

    Core fixtures keep their round. Others go to the last round window that starts on or before their
    date, the first one if none does. The windows of a league season are one short sorted array.
    Rows of other competitions, and undated ones, keep what they have.
    """
    applies = (
        (F.col("competition") == target) & F.col(scheduled).isNotNull() & F.col("match_date").isNotNull()
    )
    flagged = matches.withColumn("_round", F.when(applies, F.col(scheduled)))
    cores = round_cores(flagged, "_round")
    windows = cores.groupBy(*LEAGUE).agg(
        F.sort_array(F.collect_list(F.struct("core_start", "round"))).alias("_windows"),
        F.map_from_entries(F.collect_list(F.struct("round", "median_date"))).alias("_medians"),
    )
    joined = flagged.join(windows, LEAGUE, "left")
    median = F.try_element_at("_medians", F.col("_round"))
    started = F.filter("_windows", lambda w: w.core_start <= F.col("match_date"))
    window = F.coalesce(F.get(started, F.size(started) - 1), F.get("_windows", F.lit(0)))
    moved_to = F.when(
        F.col("_round").isNotNull(),
        F.when(F.abs(F.datediff("match_date", median)) <= CORE_DAYS, F.col("_round")).otherwise(window["round"]),
    )
    return joined.select(
        *[c for c in matches.columns if c not in ("matchday", "original_matchday")],
        F.col(scheduled).alias("original_matchday"),
        F.coalesce(moved_to, F.col(scheduled)).alias("matchday"),
    )


def next_to_play(matches: DataFrame, keys: tuple[str, ...] = ("pool", "season", "competition")) -> DataFrame:
    """Lowest round with a fixture still to come; null when none is.

    An unplayed match dated before some played one was postponed and does not count; an undated one
    does. One aggregation finds the last played date per round candidate set: per (keys, round) only
    the latest unplayed date matters.
    """
    unplayed = F.col("status") != "played"
    rounds = matches.groupBy(*keys, "matchday").agg(
        F.max(F.when(~unplayed, F.col("match_date"))).alias("last_played"),
        F.max(F.when(unplayed, F.col("match_date"))).alias("latest_open"),
        F.bool_or(unplayed & F.col("match_date").isNull()).alias("undated"),
    )
    league = rounds.groupBy(*keys).agg(
        F.max("last_played").alias("last_played"),
        F.collect_list(F.struct("matchday", "latest_open", "undated")).alias("rounds"),
    )
    ahead = F.filter(
        "rounds",
        lambda r: r.undated
        | (r.latest_open.isNotNull()
           & (F.col("last_played").isNull() | (r.latest_open >= F.col("last_played")))),
    )
    return league.select(*keys, F.array_min(F.transform(ahead, lambda r: r.matchday)).alias("next_matchday"))


def progress(matches: DataFrame, target: str = TARGET_COMPETITION) -> DataFrame:
    """Per (pool, season): last completed, next and current round."""
    rows = matches.filter(F.col("competition") == target)
    totals = rows.groupBy(*LEAGUE).agg(
        F.max(F.when(F.col("status") == "played", F.col("matchday"))).alias("last_completed"),
        F.max("matchday").alias("last_round"),
    )
    return totals.join(next_to_play(rows, ("pool", "season")), LEAGUE).select(
        *LEAGUE, "last_completed", "next_matchday",
        F.coalesce("next_matchday", "last_round", F.lit(1)).alias("current_matchday"),
    )


def cutoffs(matches: DataFrame, target: str = TARGET_COMPETITION) -> DataFrame:
    """First kick-off date of every block."""
    return (
        matches.filter((F.col("competition") == target) & F.col("matchday").isNotNull())
        .groupBy(*LEAGUE, "matchday")
        .agg(F.min("match_date").alias("cutoff"))
        .filter("cutoff is not null")
    )


def fingerprint(matches: DataFrame, target: str = TARGET_COMPETITION) -> DataFrame:
    """Per (pool, season): matches played and the next round; equal prints mean nothing happened."""
    rows = matches.filter(F.col("competition") == target)
    played = rows.groupBy(*LEAGUE).agg(
        F.sum(F.when(F.col("status") == "played", 1).otherwise(0)).cast("bigint").alias("n_played")
    )
    return played.join(next_to_play(rows, ("pool", "season")), LEAGUE)


def changed_leagues(current: DataFrame, published: DataFrame) -> DataFrame:
    """Leagues whose fingerprint differs from the published one, or that were never published."""
    old = published.select(
        *LEAGUE, F.col("n_played").alias("_n"), F.col("next_matchday").alias("_next"), F.lit(1).alias("_known")
    )
    return (
        current.join(old, LEAGUE, "left")
        .filter(
            "_known is null or not (n_played <=> _n) or not (next_matchday <=> _next)"
        )
        .select(*current.columns)
    )
