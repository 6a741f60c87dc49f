"""Keys of any length, duplicates, null keys and early stopping."""

import datetime as dt
import random

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tidemark import adapters as A
from tidemark.config import OutcomeSettings
from tidemark.models.outcome import OutcomeModel, split_day, stopping_round
from tidemark.operators.changes import emit_changes
from tidemark.operators.ledger import insert_absent
from tidemark.operators.squads import carry_forward

ORDERS = "o_orderkey long, o_custkey long, o_orderdate timestamp, o_orderpriority string, o_totalprice double"


def test_long_keys_stay_apart(spark):
    day = dt.datetime(2000, 9, 1)
    customers = [123456 * 200, 1234560 * 200 + 3, 1234561 * 200, 5]
    rows = [(10**13 + i, c, day, "1-URGENT", 1.0) for i, c in enumerate(customers)]
    got = A.matches_of(spark.createDataFrame(rows, ORDERS)).collect()
    assert [r.pool for r in got] == ["123456", "1234560", "1234561", "000000"]
    assert len({r.match_id for r in got}) == 4 and got[0].match_id == "M10000000000000"
    assert len({r.home_team for r in got}) == 4


def test_carried_ratings_never_come_from_later_seasons(spark):
    ratings = spark.createDataFrame(
        [("2021-22", "T", "a", 1.0), ("2021-22", "T", "b", 2.0), ("2021-22", "T", "b", 1.5), ("2023-24", "T", "a", 9.0)],
        "season string, team string, source string, overall double")
    seasons = spark.createDataFrame([("2020-21",), ("2022-23",), ("2024-25",)], "season string")
    got = sorted((r.season, r.edition, r.overall, r.rating_age_seasons) for r in carry_forward(ratings, seasons).collect())
    assert got == [("2021-22", "2021-22", 2.0, 0.0), ("2022-23", "2021-22", 2.0, 1.0), ("2023-24", "2023-24", 9.0, 0.0),
                   ("2024-25", "2023-24", 9.0, 1.0)]


def test_changes_of_null_keys_are_kept(spark):
    at = dt.datetime(2026, 1, 1)
    rows = [(None, "p", at, "a"), (None, "p", at + dt.timedelta(1), "a"), (None, "p", at + dt.timedelta(2), "b"), ("s", None, None, "a"), ("s", None, at, "b")]
    frame = spark.createDataFrame(rows, "season string, player_code string, observed_at timestamp, status string")
    got = emit_changes(frame, tracked=("status",)).collect()
    assert len(got) == 4 and not [r for r in got if r.season is None and r.observed_at == at + dt.timedelta(1)]


def test_first_writer_of_a_batch_wins(spark):
    old = spark.createDataFrame([("a", "old")], "match_id string, v string")
    batch = spark.createDataFrame([("b", "z", 1), ("b", "y", 2), ("a", "new", 0)], "match_id string, v string, n int")
    assert sorted(map(tuple, insert_absent(old, batch, ["match_id"], order="n").collect())) == [("a", "old"), ("b", "z")]
    assert sorted(map(tuple, insert_absent(old, batch, ["match_id"]).collect())) == [("a", "old"), ("b", "y")]


def test_stopping_round(spark):
    curve = [5, 4, 3, 3.5, 3.4, 3.3, 2, 6]
    losses = spark.createDataFrame([("m", i, float(x)) for i, x in enumerate(curve, 1)], "model string, round int, loss double")
    assert stopping_round(losses, ["model"], 3).first().best_round == 3
    assert stopping_round(losses, ["model"], 5).first().best_round == 7


def test_early_stopping_uses_more_rounds_where_there_is_signal(spark):
    rnd, rows = random.Random(1), []
    for i in range(1500):
        x, y = rnd.gauss(0, 1), rnd.gauss(0, 1)
        score = x * y + x + rnd.gauss(0, 0.4)
        label = "H" if score > 0.4 else "A" if score < -0.4 else "D"
        rows.append((dt.date(2020, 1, 1) + dt.timedelta(i // 3), x, y, *(float(label == c) for c in "HDA")))
    frame = spark.createDataFrame(rows, "match_date date, x double, y double, _is_H double, _is_D double, _is_A double")
    boosted = VectorAssembler(inputCols=["x", "y"], outputCol="_boosted").transform(frame).cache()
    settings = OutcomeSettings(learning_rate=0.1, max_depth=3, min_rows_per_leaf=10, min_rounds=3, max_rounds=24, patience=6)
    assert 3 < OutcomeModel(settings).choose_rounds(boosted, 1500) <= 24
    assert split_day(boosted, 0.5) == dt.date(2020, 1, 1) + dt.timedelta(249)
