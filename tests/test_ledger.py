import datetime as dt

from conftest import frame, row
from pyspark.sql import functions as F

from tidemark.operators.ledger import (
    insert_absent, latest_run, record_before_kickoff, record_of_forecast, upsert, upsert_table,
)
from tidemark.plans import serving as SV

P = (
    "run_id string, match_id string, season string, matchday int, p_home double, p_draw double, p_away double, "
    "predicted_outcome string, exp_home_goals double, exp_away_goals double, pred_home_goals int, "
    "pred_away_goals int, scoreline_prob double, created_at string"
)
DAY = dt.date(2030, 8, 10)


def told(run, match, at, pick="H", score=(1, 0), matchday=1):
    return (run, match, "2030-31", matchday, 0.5, 0.3, 0.2, pick, 1.5, 0.9, *score, 0.1, at)


def matches(spark):
    return frame(spark, [
        row("a", "2030-31", 1, DAY, "Manchester United", "B", (1, 0)), row("b", "2030-31", 1, DAY + dt.timedelta(1), "C", "D", (0, 2)),
        row("c", "2030-31", 2, DAY + dt.timedelta(7), "A", "C"), row("x", "2030-31", None, DAY, "A", "C", (1, 1), competition="fa_cup"),
    ])


def ledger(spark):
    return spark.createDataFrame([
        told("r1", "a", "2030-08-09T10:00:00+00:00"), told("r2", "a", "2030-08-10T16:00:00+00:00", "D"),
        told("r1", "b", "2030-08-09T10:00:00", "A", (0, 1)),
    ], P)


def test_record_is_the_latest_run_and_the_timely_one_is_kept_apart(spark):
    latest = {r.match_id: r.run_id for r in record_of_forecast(ledger(spark)).collect()}
    timely = {r.match_id: r.run_id for r in record_before_kickoff(ledger(spark), matches(spark)).collect()}
    assert latest == {"a": "r2", "b": "r1"} and timely == {"a": "r1", "b": "r1"}


def test_upsert_keeps_absent_rows_and_replaces_present_ones(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", None), ("c", 4)], "k string, v int")
    assert sorted(map(tuple, upsert(old, new, ["k"]).collect())) == [("a", 1), ("b", None), ("c", 4)]
    assert upsert(old.select("k"), new.select("k"), ["k"]).count() == 3


def test_stored_upsert_touches_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = "k string, season string, v int"
    upsert_table(spark, path, spark.createDataFrame([("a", "s1", 1), ("b", "s2", 2)], schema), ["k"])
    before = {f.name for f in (tmp_path / "t" / "season=s1").glob("*.parquet")}
    upsert_table(spark, path, spark.createDataFrame([("b", "s2", 9), ("c", "s2", 3)], schema), ["k"])
    rows = sorted((r.k, r.season, r.v) for r in spark.read.parquet(path).collect())
    assert rows == [("a", "s1", 1), ("b", "s2", 9), ("c", "s2", 3)]
    assert {f.name for f in (tmp_path / "t" / "season=s1").glob("*.parquet")} == before


def test_restore_never_rewrites(spark):
    old = spark.createDataFrame([("a", "r1")], "match_id string, run_id string")
    new = spark.createDataFrame([("a", "r9"), ("b", "r9"), ("gone", "r9")], "match_id string, run_id string")
    got = insert_absent(old, new, ["match_id"], matches(spark))
    assert sorted(map(tuple, got.collect())) == [("a", "r1"), ("b", "r9")]


def test_block_page(spark):
    view = SV.match_view(matches(spark), ledger(spark))
    a = {r.match_id: r for r in view.collect()}
    assert a["a"].home_short == "Man United" and a["a"].outcome_correct is False and a["b"].outcome_correct is True
    assert a["c"].outcome_correct is None and a["c"].confidence is None and a["c"].published_before_kickoff is None
    assert a["a"].published_before_kickoff is False and a["b"].published_before_kickoff is True
    s = {r.matchday: r for r in SV.block_summary(view).collect()}
    assert (s[1].n_scored, s[1].n_correct, s[1].n_exact_scores, s[1].accuracy, s[1].is_complete) == (2, 1, 1, 0.5, True)
    assert s[1].published_late is True and s[2].accuracy is None and s[2].is_complete is False
    assert s[1].dates == "2030-08-10,2030-08-11"
    roll = {r.matchday: r for r in SV.season_rollup(matches(spark), ledger(spark)).collect()}
    assert (roll[1].n, roll[1].played, roll[1].n_correct, roll[1].n_scored) == (2, 2, 1, 2)
    assert roll[2].has_predictions is False and roll[2].published_late is False
    rec = SV.season_record(matches(spark), ledger(spark)).first()
    assert (rec.scored, rec.correct, rec.accuracy) == (2, 1, 0.5)


def test_missing_forecasts_are_reported(spark):
    got = {(r.matchday, r.problem) for r in SV.publication_problems(matches(spark), ledger(spark)).collect()}
    assert got == {(2, "next to play and not forecast")}
    none = ledger(spark).limit(0)
    got = {(r.matchday, r.problem) for r in SV.publication_problems(matches(spark), none).collect()}
    assert got == {(1, "played without a forecast"), (2, "next to play and not forecast")}


def test_mart_and_latest_run(spark, tmp_path):
    runs = spark.createDataFrame(
        [("r1", "2030-31", 1, "t1", '{"n": 3}'), ("r2", "2030-31", 2, "t1", None)],
        "run_id string, target_season string, target_matchday int, created_at string, metrics string")
    latest = latest_run(runs, "2030-31").first()
    assert latest.run_id == "r2" and latest.metrics == {}
    tables = SV.mart_tables(matches(spark), runs, ledger(spark), "2030-31")
    SV.export_mart(str(tmp_path), tables)
    assert spark.read.parquet(f"{tmp_path}/matches").count() == 3
    assert spark.read.parquet(f"{tmp_path}/current_predictions").count() == 2
    fresh = SV.freshness(matches(spark)).first()
    assert fresh.n_matches == 4 and fresh.latest_result_date == DAY + dt.timedelta(1)
    assert [r.season for r in SV.available_seasons(matches(spark)).collect()] == ["2030-31"]


def test_display_helpers(spark):
    from tidemark.functions.scalars import percent, pretty_date

    r = spark.range(1).select(
        percent(F.lit(0.523), 1).alias("a"), percent(F.lit(None).cast("double")).alias("b"),
        pretty_date(F.lit("2025-08-09")).alias("c"), pretty_date(F.lit("soon")).alias("d"), pretty_date(F.lit(None).cast("string")).alias("e"),
    ).first()
    assert tuple(r) == ("52.3%", "-", "Sat 9 Aug", "soon", "")
