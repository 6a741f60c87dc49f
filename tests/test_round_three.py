"""Guarded refresh, the recorded gate, decayed sums against a join."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.config import RateSettings
from tidemark.models.rates import pair_sums
from tidemark.operators.refresh import current, refresh
from tidemark.streaming.changes import firings, recorded_gate


def test_refused_refresh_leaves_the_old_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(10)
    with pytest.raises(ValueError):
        current(spark, path)
    assert not refresh(path, rows.limit(0))
    assert refresh(path, rows) and current(spark, path).count() == 10
    opened = current(spark, path)
    assert not refresh(path, rows.filter("id < 4")) and not refresh(path, rows.limit(0))
    assert current(spark, path).count() == 10
    assert refresh(path, rows.filter("id < 5"))
    assert sorted(r.id for r in current(spark, path).collect()) == [0, 1, 2, 3, 4] and opened.count() == 10
    assert refresh(path, rows.filter("id = 1"), min_share=0.0) and current(spark, path).count() == 1


def test_replayed_batch_fires_once(spark, tmp_path):
    path, state, fired = str(tmp_path / "fired"), {}, []
    schema = "pool string, season string, n_played long, next_matchday int"
    gate = recorded_gate(lambda s: s.createDataFrame(state["now"], schema), path, lambda moved: fired.append(sorted(r.pool for r in moved.collect())))
    batch = spark.range(1)
    state["now"] = [("p", "s", 1, 2), ("q", "s", 1, None)]
    gate(batch, 0)
    gate(batch, 1)
    state["now"] = [("p", "s", 2, 2), ("q", "s", 1, None)]
    gate(batch, 2)
    gate(batch, 2)
    got = sorted((r.batch_id, r.pool, r.n_played) for r in firings(spark, path).collect())
    assert got == [(0, "p", 1), (0, "q", 1), (2, "p", 2)] and fired == [["p", "q"], ["p"], ["p"]]


def test_decayed_sums_equal_a_join(spark):
    draw, rows = random.Random(2), []
    for i in range(500):
        day = dt.date(2019, 1, 1) + dt.timedelta(days=draw.randrange(900))
        home, away = draw.sample("abcd", 2)
        goals = (draw.randrange(3), draw.randrange(3)) if i % 9 else (None, None)
        rows.append((draw.choice("ppq"), draw.choice(["premier_league", "championship", "fa_cup"]), day, home, away, *goals))
    matches = spark.createDataFrame(rows, "pool string, competition string, match_date date, home_team string, away_team string, home_goals int, away_goals int")
    cuts = [(p, dt.date(2019, 1, 1) + dt.timedelta(days=k)) for p in "pqr" for k in (0, 1, 17, 18, 300, 301, 650, 899, 900, 2000)]
    settings = RateSettings(max_history_days=250)
    got = {(r.pool, r.cutoff, r.competition, r.home_team, r.away_team): r for r in pair_sums(
        matches, spark.createDataFrame(cuts, "pool string, cutoff date"), settings).collect()}
    use = matches.filter("competition <> 'fa_cup' and home_goals is not null")
    age = F.datediff("cutoff", "match_date")
    want = use.join(spark.createDataFrame(cuts, "pool string, cutoff date"), "pool").filter((age > 0) & (age <= 250)).withColumn(
        "w", F.exp(-settings.time_decay * age)).groupBy("pool", "cutoff", "competition", "home_team", "away_team").agg(
        F.sum("w").alias("w"), F.sum(F.col("w") * F.col("home_goals")).alias("wh"),
        F.sum(F.when((F.col("home_goals") == 1) & (F.col("away_goals") == 0), F.col("w")).otherwise(0.0)).alias("w10"), F.count("*").alias("n")).collect()
    assert len(want) == len(got) > 50
    for r in want:
        mine = got[r.pool, r.cutoff, r.competition, r.home_team, r.away_team]
        assert mine.n == r.n and all(abs(mine[c] - r[c]) < 1e-9 for c in ("w", "wh", "w10"))
    assert pair_sums(matches.limit(0), spark.createDataFrame(cuts, "pool string, cutoff date")).count() == 0


def test_pair_sums_are_dealt_out_by_the_number_of_matches(spark, league, monkeypatch):
    from tidemark.models import rates

    cuts = league.groupBy("pool", "season", "matchday").agg(F.min("match_date").alias("cutoff"))
    told = lambda rows: sorted((r.cutoff, r.home_team, r.away_team, r.n, round(r.w, 9)) for r in rows.collect())
    few = told(pair_sums(league, cuts))
    monkeypatch.setattr(rates, "TASK_MATCHES", 10)
    many = pair_sums(league, cuts)
    assert many.rdd.getNumPartitions() >= league.filter("home_goals is not null").count() // 10 and told(many) == few
