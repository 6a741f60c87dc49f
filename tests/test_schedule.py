import datetime as dt

from conftest import frame, row
from pyspark.sql import functions as F

from tidemark.functions.scalars import season_of
from tidemark.operators.schedule import assign_rounds, changed_leagues, fingerprint, next_to_play, progress
from tidemark.plans.serving import match_view

SEASON = "2030-31"


def day(offset):
    return dt.date(2030, 8, 10) + dt.timedelta(days=offset)


def rounds(n, per_round=3):
    return {
        f"r{r}m{m}": [r, day(7 * (r - 1) + m % 2)] for r in range(1, n + 1) for m in range(per_round)
    }


def assigned(spark, fixtures):
    rows = [row(k, SEASON, r, d, f"H{k}", f"A{k}") for k, (r, d) in fixtures.items()]
    return {r.match_id: r.matchday for r in assign_rounds(frame(spark, rows)).collect()}


def test_ordinary_season_is_left_alone(spark):
    fixtures = rounds(6)
    assert assigned(spark, fixtures) == {k: r for k, (r, _) in fixtures.items()}


def test_postponed_match_moves_to_the_round_it_is_played_in(spark):
    fixtures = rounds(8)
    fixtures["r2m2"] = [2, day(7 * 5 + 3)]
    got = assigned(spark, fixtures)
    assert got["r2m2"] == 6 and got["r2m0"] == 2 and got["r2m1"] == 2


def test_match_brought_forward_moves_back(spark):
    fixtures = rounds(5)
    fixtures["r5m2"] = [5, day(7 * 2 + 3)]
    assert assigned(spark, fixtures)["r5m2"] == 3


def test_match_before_the_first_window_is_clamped(spark):
    fixtures = rounds(5)
    fixtures["r5m2"] = [5, day(-20)]
    assert assigned(spark, fixtures)["r5m2"] == 1


def test_other_competitions_keep_their_round(spark):
    rows = [row("c", SEASON, 7, day(0), "A", "B", competition="championship"), row("n", SEASON, None, day(0), "A", "C")]
    got = {r.match_id: r.matchday for r in assign_rounds(frame(spark, rows)).collect()}
    assert got == {"c": 7, "n": None}


def test_postponed_match_does_not_pin_the_next_round(spark):
    rows = [
        row("a", SEASON, 1, day(0), "A", "B", (1, 0)), row("b", SEASON, 1, day(0), "C", "D"),
        row("c", SEASON, 1, day(1), "E", "F", (2, 2)), row("d", SEASON, 2, day(7), "A", "C"),
    ]
    assert next_to_play(frame(spark, rows)).first().next_matchday == 2


def test_round_in_progress_is_still_next(spark):
    rows = [
        row("a", SEASON, 1, day(0), "A", "B", (1, 0)), row("b", SEASON, 1, day(1), "C", "D"),
        row("c", SEASON, 2, day(7), "A", "C"),
    ]
    assert next_to_play(frame(spark, rows)).first().next_matchday == 1


def test_undated_fixture_counts_and_a_finished_season_has_no_next(spark):
    rows = [row("a", SEASON, 1, day(0), "A", "B", (1, 0)), row("b", SEASON, 3, None, "C", "D")]
    assert next_to_play(frame(spark, rows)).first().next_matchday == 3
    done = frame(spark, rows[:1])
    assert next_to_play(done).first().next_matchday is None
    assert progress(done).first().current_matchday == 1


def test_fingerprint_moves_with_a_result(spark):
    before = frame(spark, [row("a", SEASON, 1, day(0), "A", "B"), row("b", SEASON, 2, day(7), "A", "B")])
    after = frame(spark, [row("a", SEASON, 1, day(0), "A", "B", (1, 0)), row("b", SEASON, 2, day(7), "A", "B")])
    assert changed_leagues(fingerprint(before), fingerprint(before)).count() == 0
    moved = changed_leagues(fingerprint(after), fingerprint(before)).first()
    assert (moved.n_played, moved.next_matchday) == (1, 2)


def test_rearranged_label(spark):
    rows = frame(spark, [row("a", SEASON, 5, day(28), "A", "B"), row("b", SEASON, 5, day(30), "C", "D", original=2)])
    none = spark.createDataFrame(
        [], "match_id string, predicted_outcome string, p_home double, p_draw double, p_away double, "
        "pred_home_goals int, pred_away_goals int, exp_home_goals double, exp_away_goals double, "
        "scoreline_prob double, run_id string, created_at string")
    got = {r.match_id: r.rearranged_from for r in match_view(rows, none).collect()}
    assert got == {"a": None, "b": 2}


def test_season_rolls_over_on_1_august(spark):
    days = {"2026-10-09": "2026-27", "2027-05-23": "2026-27", "2027-07-31": "2026-27", "2027-08-01": "2027-28", "2099-09-01": "2099-00"}
    rows = spark.createDataFrame([(d,) for d in days], "d string").select("d", season_of(F.to_date("d")).alias("s"))
    assert {r.d: r.s for r in rows.collect()} == days
