import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions.names import canonical_names, display_name
from tidemark.functions.scalars import match_key, season_of_edition, season_of_file
from tidemark.sources import archive as AR
from tidemark.sources import feeds as FD
from tidemark.sources import tables as TB
from tidemark.operators.squads import latest_source, squad_ratings

LEAGUE = """
= Invented League 2022/23

# every line kind once

▪ Matchday 4
  Sun Sep 4 2022
    13:45  Harbour Town FC    v Quarry Lane FC    3-2 (1-2)
  Mon Sep 5
    19:30  Old Mill FC        v Lantern Street Rangers FC   0-4 (0-3)
           Northgate FC       v Dale & Ferry United FC   1-1 (1-0)

▪ Matchday 5
  Sun Sep 11
    16:15  Fen Side FC        v Castle Works FC
  Fri Nov 25 2022
    19:30  Old Mill FC  v Tin Bridge FC  2-5 (2-2)
  Tue Jan 3
    19:30  Northgate FC  v Quarry Lane FC   0-0 (0-0)
"""
MIDDLE = """
▪ Regular Season - 7
Sat Sep 30 2023
  18:10   Tin Bridge  5-1 (3-0)  Harbour Town
                  (Ada BELL 3', Cy DUNN 31';
                   Eve FARR 44', 80')
Sun Oct 1
  11:45   Castle Works  1-2 (1-1)  Fen Side
"""
CUP = """
▪ Semi-finals
Thu Apr 6 2023
  Lantern Street Rangers  v Cobble Hill FC  4-3 pen. (2-2, 1-0)
  Salt Quay  v Weir End  0-1 a.e.t. (3-3, 1-2)
  Tram Park v Peat Moor FC  [abandoned]
  First Row  v Second Row  3-0  [awarded]
  Sun Apr 31
  No Day v No Way
"""
ALIASES = [
    ("Harbour", "Harbour Town"), ("Dale & Ferry", "Dale & Ferry United"), ("The Lanterns", "Lantern Street Rangers"),
    ("O'Fen", "Fen Side"), ("Milly", "Old Mill"),
]


@pytest.fixture(scope="module")
def aliases(spark):
    return spark.createDataFrame(ALIASES, "alias string, canonical string")


@pytest.fixture(scope="module")
def checkout(tmp_path_factory):
    root = tmp_path_factory.mktemp("archive")
    for season, name, text in (
        ("2022-23", "1-premierleague.txt", LEAGUE), ("2023-24", "1-premierleague.txt", MIDDLE),
        ("2022-23", "facup.txt", CUP), ("2022-23", "notes.txt", LEAGUE), ("misc", "facup.txt", CUP),
    ):
        (root / season).mkdir(exist_ok=True)
        (root / season / name).write_text(text, encoding="utf-8")
    return str(root)


def test_seasons_are_discovered(spark, checkout):
    found = AR.seasons_between(AR.season_folders(spark, checkout), "2023-24", "2030-31")
    assert [r.season for r in found.collect()] == ["2023-24"]
    assert AR.season_folders(spark, checkout).count() == 2


def test_archive(spark, checkout, aliases):
    rows = AR.parse_lines(AR.archive_lines(spark, checkout)).collect()
    of = lambda season, competition: sorted(
        (r for r in rows if (r.season, r.competition) == (season, competition)), key=lambda r: r.line_no)
    league = of("2022-23", "premier_league")
    assert [(r.home_team, r.home_goals, r.away_goals, r.away_team) for r in league] == [
        ("Harbour Town FC", 3, 2, "Quarry Lane FC"), ("Old Mill FC", 0, 4, "Lantern Street Rangers FC"),
        ("Northgate FC", 1, 1, "Dale & Ferry United FC"), ("Fen Side FC", None, None, "Castle Works FC"),
        ("Old Mill FC", 2, 5, "Tin Bridge FC"), ("Northgate FC", 0, 0, "Quarry Lane FC")]
    assert [r.matchday for r in league] == [4, 4, 4, 5, 5, 5]
    assert [r.kickoff for r in league] == ["13:45", "19:30", "19:30", "16:15", "19:30", "19:30"]
    assert [str(r.match_date) for r in league] == DATES
    assert (league[0].ht_home_goals, league[0].ht_away_goals) == (1, 2)
    assert [(r.home_team, r.home_goals, r.away_goals, r.away_team) for r in of("2023-24", "premier_league")] == [
        ("Tin Bridge", 5, 1, "Harbour Town"), ("Castle Works", 1, 2, "Fen Side")]
    cup = {r.home_team: r for r in of("2022-23", "fa_cup")}
    assert set(cup) == {"Lantern Street Rangers", "Salt Quay", "First Row", "No Day"}, "the abandoned match is left out"
    shootout, extra, awarded = cup["Lantern Street Rangers"], cup["Salt Quay"], cup["First Row"]
    assert (shootout.home_goals, shootout.away_goals, shootout.ht_home_goals) == (2, 2, 1)
    assert (extra.home_goals, extra.away_goals, extra.ht_away_goals) == (3, 3, 2)
    assert awarded.stage == "Semi-finals" and awarded.matchday is None and cup["No Day"].match_date is None
    table = AR.standardise(AR.parse_lines(AR.archive_lines(spark, checkout)), aliases).filter("competition = 'premier_league'")
    status = {(r.season, r.home_team): r.status for r in table.collect()}
    assert status["2022-23", "Harbour Town"] == "played" and status["2022-23", "Fen Side"] == "scheduled"


DATES = ["2022-09-04", "2022-09-05", "2022-09-05", "2022-09-11", "2022-11-25", "2023-01-03"]


def test_long_file_is_cut_into_chunks_without_losing_context(spark, monkeypatch):
    monkeypatch.setattr(AR, "LINES_PER_CHUNK", 3)
    rows = [("2022-23", "premier_league", "f", i, line) for i, line in enumerate(LEAGUE.splitlines())]
    lines = spark.createDataFrame(rows, "season string, competition string, file string, line_no int, line string")
    got = AR.parse_lines(lines).orderBy("line_no").collect()
    assert [str(r.match_date) for r in got] == DATES and [r.matchday for r in got] == [4, 4, 4, 5, 5, 5]


NAMES = [
    ("Harbour Town FC", "Harbour Town"), ("Harbour", "Harbour Town"), ("AFC Quarry Lane", "Quarry Lane"), ("Tin Bridge AFC", "Tin Bridge"),
    ("Dale & Ferry", "Dale & Ferry United"), ("Dale & Ferry United FC", "Dale & Ferry United"), ("  milly  f.c. ", "Old Mill"),
    ("Mílly", "Old Mill"), ("O'Fen", "Fen Side"), ("Peat Moor", "Peat Moor"), ("", ""), (None, ""), ("FC", "FC"),
]


def test_names_collapse_and_stay(spark, aliases):
    got = {r.name: r.canonical for r in canonical_names(spark.createDataFrame([(n,) for n, _ in NAMES], "name string"), aliases).collect()}
    assert got == dict(NAMES)
    again = canonical_names(spark.createDataFrame([(c,) for c in set(got.values())], "name string"), aliases).collect()
    assert all(r.name == r.canonical for r in again)


def test_labels(spark):
    row = spark.range(1).select(
        display_name(F.lit("Manchester United")).alias("a"), display_name(F.lit("Arsenal")).alias("b"),
        season_of_edition(F.lit(20)).alias("c"), season_of_edition(F.lit(0)).alias("c0"),
        season_of_file(F.lit("/x/season-2526.csv")).alias("d"), season_of_file(F.lit("season-9394.csv")).alias("e"),
        match_key(F.lit("2024-25"), F.lit("fa_cup"), F.lit(0), F.lit("Final"), F.lit("A"), F.lit("B")).alias("k0"),
        match_key(F.lit("2024-25"), F.lit("fa_cup"), F.lit(None).cast("int"), F.lit("Final"), F.lit("A"), F.lit("B")).alias("k1"),
    ).first()
    assert (row.a, row.b, row.c, row.d, row.e) == ("Man United", "Arsenal", "2019-20", "2025-26", "1993-94")
    assert row.k0 == row.k1 and row.k0.startswith("2024-25-fa_-")


def test_statistics_files_with_different_headers(spark, tmp_path, aliases):
    (tmp_path / "season-2425.csv").write_text("Date,HomeTeam,AwayTeam,FTHG,FTAG,HS,AS,Referee\n17/08/2024,Dale & Ferry,Tin Bridge FC,1,0,14,x,A Ref\n,No,Date,1,1,1,1,\n")
    (tmp_path / "season-9394.csv").write_text("HomeTeam,Date,AwayTeam,HC\nMilly,14/08/93,Harbour,5\n")
    (tmp_path / "other.csv").write_text("a\n1\n")
    raw = TB.read_statistics(spark, str(tmp_path))
    rows = {r.season: r for r in TB.match_statistics(raw, aliases).collect()}
    assert set(rows) == {"2024-25", "1993-94"}
    new, old = rows["2024-25"], rows["1993-94"]
    assert (new.home_team, new.home_shots, new.away_shots, new.referee, new.home_corners) == ("Dale & Ferry United", 14.0, None, "A Ref", None)
    assert (old.match_date, old.home_corners, old.away_team) == (dt.date(1993, 8, 14), 5.0, "Harbour Town")
    matches = spark.createDataFrame(
        [("m1", "2024-25", "premier_league", "Dale & Ferry United", "Tin Bridge"), ("m2", "2024-25", "fa_cup", "Dale & Ferry United", "Tin Bridge")],
        "match_id string, season string, competition string, home_team string, away_team string")
    assert [r.match_id for r in TB.attach_statistics(matches, TB.match_statistics(raw, aliases)).collect()] == ["m1"]


def test_commented_files(spark, tmp_path, aliases):
    path = tmp_path / "unavailability.csv"
    path.write_text('# note\n  # more\nseason,matchday,team,players_out,key_players_out,notes,source\n2026-27, 3 ,Milly,2,,"a, b",\n2026-27,,Milly,1,1,,\n')
    got = TB.unavailability(TB.commented_csv(spark, str(path), TB.UNAVAILABILITY), aliases).collect()
    assert [tuple(r) for r in got] == [("2026-27", 3, "Old Mill", 2, 0, "a, b", "manual")]
    path = tmp_path / "managers.csv"
    path.write_text("# c\nteam,manager,start_date,end_date,source\nO'Fen,,2024-07-01,,manual\n,x,2024-01-01,,\n")
    got = TB.manual_spells(TB.commented_csv(spark, str(path), TB.SPELLS), aliases).drop("row_no").collect()
    assert [tuple(r) for r in got] == [("Fen Side", "unknown", dt.date(2024, 7, 1), None, "manual")]


def test_missing_and_empty_files_are_empty_tables(spark, tmp_path):
    (tmp_path / "blank.csv").write_text("# nothing yet\n")
    for name in ("absent.csv", "blank.csv"):
        path = str(tmp_path / name)
        assert TB.unavailability(TB.commented_csv(spark, path, TB.UNAVAILABILITY)).count() == 0
        assert TB.squad_rating_rows(TB.commented_csv(spark, path, TB.SQUAD_RATINGS)).count() == 0
        assert TB.european_rows(TB.commented_csv(spark, path, TB.EUROPEAN)).count() == 0
        assert TB.manual_spells(TB.commented_csv(spark, path, TB.SPELLS)).count() == 0


def test_player_dumps(spark, tmp_path):
    lines = ["club_name,overall,player_positions,value_eur,league_level"]
    lines += [f'Ars FC,{70 + i},"{p}",{1000 * i},1' for i, p in enumerate(["ST", "CM", "CB", "GK", "LW, ST"] * 5)]
    lines += ["Low,80,ST,1,3", "Ars FC,,ST,1,1", "None,50,ST,1,"]
    (tmp_path / "players_22.csv").write_text("\n".join(lines) + "\n")
    raw = TB.read_player_dumps(spark, str(tmp_path), "players_*.csv")
    got = squad_ratings(TB.player_dump(raw)).collect()
    assert len(got) == 1
    r = got[0]
    top = sorted(range(70, 95), reverse=True)
    assert (r.season, r.team, r.source) == ("2021-22", "Ars", "sofifa:players_22.csv")
    assert r.overall == round(0.7 * sum(top[:11]) / 11 + 0.3 * sum(top[:20]) / 20, 3)
    assert r.midfield == (71 + 76 + 81 + 86 + 91) / 5
    assert r.attack == (94 + 90 + 89 + 85 + 84) / 5
    assert r.squad_value == 1000 * sum(range(5, 25))
    with pytest.raises(ValueError):
        TB.player_dump(spark.createDataFrame([("a", "b")], "x string, _file string"))
    two = spark.createDataFrame([("s", "T", "a", 1.0), ("s", "T", "b", 2.0)], "season string, team string, source string, overall double")
    assert latest_source(two).first().overall == 2.0


PAYLOAD = json.dumps({
    "teams": [{"id": 31, "name": "Harbour"}, {"id": 47, "name": "Quarry"}],
    "events": [{"id": 20, "is_next": True}, {"id": 21, "is_next": False}],
    "elements": [
        {"code": 70, "id": 700, "web_name": "Ostrow", "element_type": 2, "team": 47, "status": "i", "chance_of_playing_next_round": 0,
         "chance_of_playing_this_round": None, "news": "\tankle; says: \"two weeks\" ", "news_added": "2031-02-11T17:45:30Z"},
        {"code": 71, "id": 710, "web_name": "Lindqvist", "element_type": 3, "team": 31, "status": "a", "chance_of_playing_next_round": None, "news": ""},
        {"code": 72, "id": 720, "web_name": "Coach Brandt", "element_type": 5, "team": 31, "status": "a", "news": ""},
    ]})


def test_availability_snapshot_and_log_round_trip(spark, tmp_path):
    raw = spark.createDataFrame([("2030-31", dt.datetime(2031, 2, 12, 21, 15), PAYLOAD)], "season string, observed_at timestamp, payload string")
    rows = FD.availability_rows(raw)
    got = {r.web_name: r for r in rows.collect()}
    assert set(got) == {"Ostrow", "Lindqvist"}
    hurt, well = got["Ostrow"], got["Lindqvist"]
    assert (hurt.fpl_team, hurt.position, hurt.chance_next, hurt.fpl_next_event, hurt.observed_at) == ("Quarry", "DEF", "0", "20", "2031-02-12T21:15:00Z")
    assert (well.position, well.chance_next, well.news_added) == ("MID", "", "")
    path = str(tmp_path / "log")
    rows.select(*TB.LOG_COLUMNS).write.csv(path, header=True, escape='"')
    back = {r.web_name: r for r in TB.read_log(spark, path).collect()}
    assert back["Ostrow"].news == 'ankle; says: "two weeks"' and back["Lindqvist"].news == ""


def test_feed_files_and_documents(spark, tmp_path):
    stories = [("Quarry name interim coach", "Until the summer break", "Sat, 15 Feb 2031 08:20:00 GMT"), ("Ticket office opens early", "", "")]
    items = "".join(f"<item><title>{t}</title><description>{d}</description><pubDate>{p}</pubDate></item>" for t, d, p in stories)
    document = f"<rss><channel>{items}</channel></rss>"
    (tmp_path / "news.xml").write_text(document)
    want = [("Quarry name interim coach", "Until the summer break", dt.date(2031, 2, 15))]
    assert [tuple(r) for r in FD.headlines(spark.createDataFrame([(document,)], "xml string")).collect()] == want
    assert [tuple(r) for r in FD.headlines_from_files(spark, str(tmp_path)).collect()] == want


def test_spell_files(spark, tmp_path):
    rows = spark.createDataFrame([("A", "M, Jr", dt.date(2020, 1, 1), None)], "team string, manager string, start_date date, end_date date")
    TB.write_spells(rows, str(tmp_path / "s"))
    assert TB.read_spells(spark, str(tmp_path / "s")).collect() == rows.collect()
