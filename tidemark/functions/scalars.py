"""Scalar expressions: labels, keys, calendar, loss terms, display text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.config import EUROPEAN_TIERS


def season_of(date: Column) -> Column:
    """Season label ``YYYY-YY``; a season starts on 1 August."""
    start = F.year(date) - F.when(F.month(date) >= 8, 0).otherwise(1)
    return season_label(start)


def season_label(start: Column) -> Column:
    return F.format_string("%d-%02d", start.cast("int"), F.pmod(start + 1, F.lit(100)).cast("int"))


def season_of_edition(version: Column) -> Column:
    """A game edition describes the season it ships into: 20 gives 2019-20."""
    return season_label(version.cast("int") + 1999)


def season_of_file(path: Column) -> Column:
    """``season-2526.csv`` gives ``2025-26``; two-digit years from 90 on are 19xx."""
    start = F.regexp_extract(path, r"season-(\d{2})(\d{2})\.csv$", 1)
    end = F.regexp_extract(path, r"season-(\d{2})(\d{2})\.csv$", 2)
    code = start.try_cast("int")
    return F.when(
        start != "",
        F.concat_ws("-", (code + F.when(code >= 90, 1900).otherwise(2000)).cast("string"), end),
    )


def padded(number: Column, width: int) -> Column:
    """A number's digits with leading zeros up to a width. A longer number stays whole, unlike with a plain lpad."""
    text = number.cast("string")
    return F.lpad(text, F.greatest(F.length(text), F.lit(width)), F.lit("0"))


def outcome(home: Column, away: Column) -> Column:
    return F.when(home > away, "H").when(home < away, "A").when(home == away, "D")


def points(scored: Column, conceded: Column) -> Column:
    return F.when(scored > conceded, 3).when(scored == conceded, 1).when(scored < conceded, 0)


def match_key(season, competition, matchday, stage, home, away) -> Column:
    """Stable id from the fixture's identity. Built on the scheduled round, so it survives a move."""
    scheduled = F.when(matchday != 0, matchday.cast("string"))
    slot = F.coalesce(scheduled, F.when(stage != "", stage), F.lit("?"))
    digest = F.sha1(F.concat_ws("|", season, competition, slot, home, away).cast("binary"))
    return F.concat_ws("-", season, F.substring(competition, 1, 3), F.substring(digest, 1, 16))


def is_midweek(date: Column) -> Column:
    return F.weekday(date).isin(1, 2, 3).cast("double")


def is_weekend(date: Column) -> Column:
    return (F.weekday(date) >= 5).cast("double")


def season_progress(matchday: Column, total: Column) -> list[Column]:
    """Share of the season gone, the round number, and the rounds left; 38 rounds if unknown."""
    day = F.coalesce(matchday, F.lit(0))
    rounds = F.coalesce(F.when(total != 0, total), F.lit(38))
    return [
        (day / rounds).alias("season_progress"),
        day.cast("double").alias("matchday_number"),
        (rounds - day).cast("double").alias("matchdays_remaining"),
    ]


def european_tier(competition: Column) -> Column:
    tiers = F.create_map(*[F.lit(x) for pair in EUROPEAN_TIERS.items() for x in pair])
    return F.coalesce(F.try_element_at(tiers, competition), F.lit(0.0))


def position_group(positions: Column) -> Column:
    """Unit of a player's first listed position, or null."""
    # Positions by unit.
    groups = {
        "GK": "GK",
        "DEF": "CB LCB RCB LB RB LWB RWB SW",
        "MID": "CDM LDM RDM CM LCM RCM CAM LAM RAM LM RM",
        "ATT": "ST LS RS CF LF RF LW RW",
    }
    first = F.upper(F.trim(F.split(F.trim(positions), "[/,]").getItem(0)))
    result = F.lit(None).cast("string")
    for unit, names in groups.items():
        result = F.when(first.isin(*names.split()), unit).otherwise(result)
    return result


def decay_weight(age_days: Column, rate: float) -> Column:
    return F.exp(F.lit(-rate) * F.greatest(age_days, F.lit(0)))


def kickoff_instant(date: Column, kickoff: Column) -> Column:
    """Kick-off read as UTC; a missing or malformed time counts as midnight, a missing date as null."""
    hour = F.regexp_extract(kickoff, r"^\s*(\d{1,2})\s*:\s*(\d{1,2})\s*(:|$)", 1).try_cast("int")
    minute = F.regexp_extract(kickoff, r"^\s*(\d{1,2})\s*:\s*(\d{1,2})\s*(:|$)", 2).try_cast("int")
    usable = (hour < 24) & (minute < 60)
    seconds = F.when(usable, hour * 3600 + minute * 60).otherwise(0)
    return (F.unix_timestamp(date.cast("timestamp")) + F.coalesce(seconds, F.lit(0))).cast("timestamp")


def stamp_instant(text: Column) -> Column:
    """An ISO stamp as an instant; a stamp without an offset is UTC, a bad one null."""
    return F.try_to_timestamp(text)


def percent(value: Column, places: int = 0) -> Column:
    return F.when(value.isNull(), "-").otherwise(F.format_string(f"%.{places}f%%", value * 100))


def pretty_date(text: Column) -> Column:
    """``Sat 9 Aug``; unreadable text is returned as it is, a blank one as an empty string."""
    parsed = F.try_to_date(text, "yyyy-MM-dd")
    return F.when(text.isNull() | (text == ""), "").otherwise(
        F.coalesce(F.date_format(parsed, "EEE d MMM"), text)
    )


def capped(value: Column, limit: int) -> Column:
    """The smaller of the two; null stays null (``least`` would skip it)."""
    return F.when(value > limit, F.lit(limit)).otherwise(value)


def bounded_tail(items: Column, depth: int) -> Column:
    """The last ``depth`` elements of an array."""
    return F.slice(items, F.greatest(F.size(items) - depth + 1, F.lit(1)), depth)


def mean_of(items: Column, value) -> Column:
    """Mean of ``value(x)`` over the elements where it is not null; null when there is none."""
    total = F.aggregate(
        items,
        F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")),
        lambda acc, x: F.struct(
            (acc.s + F.coalesce(value(x).cast("double"), F.lit(0.0))).alias("s"),
            (acc.n + value(x).isNotNull().cast("int")).alias("n"),
        ),
    )
    return F.try_divide(total.s, total.n)
