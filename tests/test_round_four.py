"""Histories are shuffled and sorted nowhere, context is joined to narrow rows, open spells end where a later one starts."""

from __future__ import annotations

import datetime as dt

from tidemark.operators import form as forms
from tidemark.operators.intervals import by_month, in_force
from tidemark.operators.timeline import sides, team_state, timeline
from tidemark.plans.features import build_features

MATCH = (
    "pool string, match_id string, season string, competition string, matchday int, match_date date, "
    "kickoff string, home_team string, away_team string, home_goals int, away_goals int, status string"
)
SPELL = "team string, manager string, start_date date, end_date date"
DAY = dt.date(2023, 8, 1)


def season(spark, days=30):
    clubs = "ABCD"
    rows = [
        ("p", f"m{d}-{i}", "2023-24", "premier_league" if d % 4 else "fa_cup", 1 + d // 3 if d % 4 else None,
         DAY + dt.timedelta(days=4 * d), None, clubs[(d + i) % 4], clubs[(d + i + 1) % 4],
         None if d % 7 == 3 else (d + i) % 4, None if d % 7 == 3 else d % 3, "played")
        for d in range(days) for i in (0, 2)
    ]
    return spark.createDataFrame(rows, MATCH)


def nodes(plan):
    yield plan
    if plan.nodeName() == "AdaptiveSparkPlan":
        yield from nodes(plan.initialPlan())
    for i in range(plan.children().size()):
        yield from nodes(plan.children().apply(i))


def names(plan):
    return {plan.output().apply(i).name(): plan.output().apply(i).dataType().simpleString()
            for i in range(plan.output().size())}


def joined_with_history(frame):
    plan = frame._jdf.queryExecution().optimizedPlan()
    return [p for p in nodes(plan) if p.nodeName() == "Join" and "history" in names(p.left())]


def test_no_sort_holds_a_history_of_each_row(spark):
    state = team_state(sides(timeline(season(spark)))).select("match_id", "team", "history")
    sorts = [names(p) for p in nodes(state._jdf.queryExecution().executedPlan()) if p.nodeName() == "Sort"]
    assert sorts
    assert not [s for s in sorts if "seq_key" in s and any(t.startswith("array") for t in s.values())]


def test_history_is_the_last_played_before_the_block(spark):
    """Blocks of several matches, more in one block than are kept, and open matches in between."""
    rows = [(r.match_id, r.team, r.block_key, r.seq_key, r.match_date, r.goals_for, r.played, [g.gf for g in r.history], r.rec_played)
            for r in team_state(sides(timeline(season(spark, 60))), 3).collect()]
    for _, team, block, _, _, _, _, got, _ in rows:
        past = sorted((r for r in rows if r[1] == team and r[2] < block and r[6]), key=lambda r: r[3])
        assert got == [r[5] for r in past[-3:]]


def test_congestion_joins_no_history(spark):
    rows = sides(timeline(season(spark)))
    state = forms.add_congestion(team_state(rows).filter("in_block"), rows)
    assert not joined_with_history(state.select("match_id", "team", "rest_days", "matches_last_21d"))
    narrow = forms.add_congestion(team_state(forms.with_fixture_lists(rows, rows)).filter("in_block"))
    assert sorted(map(str, narrow.collect())) == sorted(map(str, state.select(*narrow.columns).collect()))


def test_features_join_no_history(spark):
    spells = spark.createDataFrame([("A", "x", DAY, None)], SPELL)
    built = build_features(season(spark), spells=spells)
    assert not joined_with_history(built)
    assert built.filter("home_team = 'A'").agg({"home_manager_days": "max"}).first()[0] > 50


def test_open_spells_are_laid_out_to_the_next_one(spark):
    """One open spell a month for five years: two months each, not all that follow."""
    starts = [dt.date(2000 + m // 12, m % 12 + 1, 15) for m in range(60)]
    rows = [("A", f"c{i}", s, None) for i, s in enumerate(starts)]
    rows += [("A", "short", starts[20], starts[20] + dt.timedelta(days=5)), ("A", "long", starts[5], starts[50])]
    spells = spark.createDataFrame(rows, SPELL)
    days = [starts[0] + dt.timedelta(days=9 * i) for i in range(200)]
    dates = spark.createDataFrame([("A", d) for d in days], "team string, match_date date")
    assert by_month(spells, dates).count() <= 2 * len(rows) + 2
    for r in in_force(spells, dates).collect():
        live = [x for x in rows if x[2] <= r.match_date and (x[3] is None or r.match_date <= x[3])]
        assert (r.start_date, r.manager) == max((x[2], x[1]) for x in live)
