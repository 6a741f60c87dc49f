import datetime as dt
import random

from tidemark.operators import changes as C
from tidemark.operators.rating import rate_matches
from tidemark.operators.timeline import timeline
from tidemark.streaming.changes import change_stream, late_forecasts, retrain_gate, run_to_table, upsert_sink
from tidemark.streaming.ratings import closing_rows, rating_stream

SCHEMA = "season string, player_code string, observed_at timestamp, status string, news string"


def observations(n=400, seed=5):
    rnd = random.Random(seed)
    start = dt.datetime(2026, 9, 1)
    rows = []
    for i in range(n):
        # One player holds two thirds of the rows.
        player = "p0" if rnd.random() < 0.66 else f"p{rnd.randrange(1, 6)}"
        rows.append(("s1" if i < 300 else "s2", player, start + dt.timedelta(hours=7 * i), rnd.choice("ad"), rnd.choice(["", None, "x"])))
    return rows


def brute(rows):
    last, out = {}, []
    for r in sorted(rows, key=lambda r: r[2]):
        if (r[0], r[1]) not in last or last[r[0], r[1]] != r[3:]:
            out.append(r)
        last[r[0], r[1]] = r[3:]
    return sorted(out, key=lambda r: r[2])


def test_emit_on_change_matches_a_plain_loop(spark):
    rows = observations()
    got = C.emit_changes(spark.createDataFrame(rows, SCHEMA), tracked=("status", "news"))
    assert sorted(map(tuple, got.collect()), key=lambda r: r[2]) == brute(rows)


def test_snapshot_against_log(spark):
    log = spark.createDataFrame([("s", "1", dt.datetime(2026, 9, 1), "a", ""), ("s", "2", dt.datetime(2026, 9, 1), "d", "n")], SCHEMA)
    same = spark.createDataFrame([("s", "1", dt.datetime(2026, 9, 2), "a", ""), ("s", "2", dt.datetime(2026, 9, 2), "i", "n")], SCHEMA)
    keys, tracked = ("season", "player_code"), ("status", "news")
    assert [r.player_code for r in C.append_changes(log, same, keys, tracked).collect()] == ["2"]
    later = spark.createDataFrame([("t", "1", dt.datetime(2026, 9, 2), "a", "")], SCHEMA)
    assert C.append_changes(log, later, keys, tracked).count() == 1


def test_state_as_of(spark):
    from pyspark.sql import functions as F

    log = spark.createDataFrame([
        ("s", "1", dt.datetime(2026, 9, 24), "d", ""), ("s", "1", dt.datetime(2026, 9, 27), "a", "")], SCHEMA)
    at = lambda t: C.latest_state(log, as_of=F.lit(t).cast("timestamp")).collect()
    assert at("2026-09-26 12:00:00")[0].status == "d" and at("2026-09-28 12:00:00")[0].status == "a"
    assert at("2026-09-01 00:00:00") == []


def write_in_parts(spark, rows, schema, folder, parts=3):
    size = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * size:(i + 1) * size], schema).coalesce(1).write.mode("append").parquet(folder)


def test_change_stream_over_micro_batches_equals_the_batch(spark, tmp_path):
    rows = sorted(observations(), key=lambda r: r[2])
    source = str(tmp_path / "in")
    write_in_parts(spark, rows, SCHEMA, source)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    run_to_table(change_stream(stream, tracked=("status", "news")), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(map(tuple, got), key=lambda r: r[2]) == brute(rows)
    # A second start has nothing left to do.
    run_to_table(change_stream(stream, tracked=("status", "news")), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(got)


def test_streamed_ratings_equal_the_batch_fold(spark, league, tmp_path):
    from pyspark.sql import functions as F

    ordered = timeline(league.withColumn("kickoff", F.lit(None).cast("string")))
    keep = ["pool", "match_id", "season", "competition", "home_team", "away_team", "home_goals", "away_goals", "seq_key"]
    rows = ordered.select(*keep, F.col("match_date").cast("timestamp").alias("event_time"))
    source = str(tmp_path / "in")
    for season in ("2021-22", "2022-23", "2023-24", "2024-25", "2025-26", "2026-27"):
        rows.filter(F.col("season") == season).coalesce(1).write.mode("append").parquet(source)
    closing_rows(rows).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    run_to_table(rating_stream(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {r.match_id: (r.home_elo, r.away_elo) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r.match_id: (r.home_elo, r.away_elo) for r in rate_matches(ordered).collect()}
    assert got == want


def test_moved_match_is_upserted_by_the_stream(spark, tmp_path):
    schema = "match_id string, season string, matchday int"
    source = str(tmp_path / "in")
    spark.createDataFrame([("a", "s1", 2), ("b", "s1", 2)], schema).coalesce(1).write.parquet(source)
    touched = []
    stream = spark.readStream.schema(schema).parquet(source)
    args = (str(tmp_path / "out"), ["match_id"], str(tmp_path / "cp"))
    upsert_sink(stream, *args, after=lambda batch, _: touched.extend(r.season for r in batch.select("season").distinct().collect()))
    spark.createDataFrame([("b", "s1", 5)], schema).coalesce(1).write.mode("append").parquet(source)
    upsert_sink(stream, *args)
    rows = sorted((r.match_id, r.matchday) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert rows == [("a", 2), ("b", 5)] and touched == ["s1"]


def test_gate_fires_only_when_a_fingerprint_moves(spark):
    schema = "pool string, season string, n_played long, next_matchday int"
    now = spark.createDataFrame([("p", "s", 3, 2), ("q", "s", 3, None)], schema)
    fired = []
    gate = retrain_gate(lambda _: now, lambda _: now, lambda moved: fired.append(moved.count()))
    gate(now, 0)
    assert fired == []
    older = spark.createDataFrame([("p", "s", 2, 2), ("q", "s", 3, None)], schema)
    retrain_gate(lambda _: now, lambda _: older, lambda moved: fired.append(moved.count()))(now, 1)
    assert fired == [1]


def test_late_flag(spark):
    told = spark.createDataFrame(
        [("a", "s", 1, "2030-08-10T11:00:00+00:00"), ("b", "s", 1, "2030-08-10T12:31:00")],
        "match_id string, season string, matchday int, created_at string")
    starts = spark.createDataFrame([("s", 1, dt.datetime(2030, 8, 10, 12, 30))], "season string, matchday int, first_kickoff timestamp")
    assert [r.match_id for r in late_forecasts(told, starts).collect()] == ["b"]
