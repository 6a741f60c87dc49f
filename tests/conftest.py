import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidemark.session import build_session  # noqa: E402

TEAMS = ["Alpha", "Bravo", "Charlie", "Delta", "Echo", "Foxtrot"]
MATCH_SCHEMA = (
    "pool string, match_id string, season string, competition string, matchday int, original_matchday int, "
    "match_date date, kickoff string, home_team string, away_team string, home_goals int, away_goals int, "
    "result string, status string, updated_at string"
)


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", 4, 4)
    session.sparkContext.setLogLevel("ERROR")
    return session


def row(match_id, season, matchday, date, home, away, goals=None, competition="premier_league", original=None,
        pool="p", kickoff="15:00"):
    h, a = goals if goals else (None, None)
    result = None if goals is None else "H" if h > a else "A" if h < a else "D"
    return (pool, match_id, season, competition, matchday, original or matchday, date, kickoff, home, away, h, a,
            result, "played" if goals else "scheduled", "2026-01-01T00:00:00+00:00")


def pairings():
    """Double round robin by the circle method: each club once per round."""
    ring, first = list(TEAMS), []
    for number in range(len(TEAMS) - 1):
        games = [(ring[i], ring[-1 - i]) for i in range(len(TEAMS) // 2)]
        first.append(games if number % 2 == 0 else [(b, a) for a, b in games])
        ring = [ring[0], ring[-1], *ring[1:-1]]
    return first + [[(b, a) for a, b in games] for games in first]


def league_rows(seasons=6):
    out = []
    for year in range(2021, 2021 + seasons):
        season = f"{year}-{(year + 1) % 100:02d}"
        for number, games in enumerate(pairings(), start=1):
            day = dt.date(year, 8, 10) + dt.timedelta(days=7 * (number - 1))
            for home, away in games:
                gap = TEAMS.index(away) - TEAMS.index(home)
                h, a = min(4, max(0, 1 + gap)), min(4, max(0, 1 - gap))
                if (number + TEAMS.index(home)) % 4 == 0:
                    a = h
                open_ = year == 2026 and number >= 9
                out.append(row(f"{season}-{number:02d}-{home}", season, number, day, home, away, None if open_ else (h, a)))
    return out


@pytest.fixture(scope="session")
def league(spark):
    return spark.createDataFrame(league_rows(), MATCH_SCHEMA)


def frame(spark, rows):
    return spark.createDataFrame(rows, MATCH_SCHEMA)
