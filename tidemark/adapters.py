"""Driver tables seen as match data, so the operators have whole tables to run on.

A club is ten neighbouring customers, a pool is a league of twenty clubs, and every order is a match
of the customer's club against another club of its league. Orders after the closing date are not yet
played. More data gives more leagues, not larger ones. Integer arithmetic only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import COMPETITION_FILES
from tidemark.functions.scalars import outcome, padded, season_of

PLAYED_BEFORE = "2001-06-01"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def club_name(number: Column) -> Column:
    return F.concat(F.lit("Club "), padded(number, 9))


def matches(spark: SparkSession, folder: str) -> DataFrame:
    return matches_of(table(spark, folder, "orders"))


def matches_of(orders: DataFrame) -> DataFrame:
    """One match per order; two of the five priorities are cups, the others the league."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    club = F.floor(customer / 10)
    league = F.floor(club / 20)
    rival = league * 20 + (club % 20 + 1 + key % 19) % 20
    day = F.to_date("o_orderdate")
    played = day < F.lit(PLAYED_BEFORE).cast("date")
    season = season_of(day)
    start = F.make_date(F.substring(season, 1, 4).cast("int"), F.lit(8), F.lit(1))
    round_no = (F.floor(F.datediff(day, start) / 10) + 1).cast("int")
    competition = (
        F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "fa_cup")
        .when(F.col("o_orderpriority") == "5-LOW", "efl_cup")
        .otherwise("premier_league")
    )
    in_league = competition == "premier_league"
    scheduled = F.when(key % 29 == 0, (round_no + 4) % 37 + 1).otherwise(round_no)
    kickoff = F.when(key % 11 == 0, None).otherwise(
        F.element_at(F.array(*[F.lit(t) for t in ("12:30", "15:00", "17:30", "20:00")]),
                     (key % 4 + 1).cast("int"))
    )
    home_goals = F.when(played, ((key * 31 + customer) % 5).cast("int"))
    away_goals = F.when(played, ((key * 17 + customer * 3) % 4).cast("int"))
    return orders.select(
        padded(league, 6).alias("pool"),
        F.concat(F.lit("M"), padded(key, 12)).alias("match_id"),
        season.alias("season"),
        competition.alias("competition"),
        F.when(in_league, round_no).alias("matchday"),
        F.when(in_league, scheduled.cast("int")).alias("original_matchday"),
        day.alias("match_date"),
        kickoff.alias("kickoff"),
        club_name(club).alias("home_team"),
        club_name(rival).alias("away_team"),
        home_goals.alias("home_goals"),
        away_goals.alias("away_goals"),
        outcome(home_goals, away_goals).alias("result"),
        F.when(played, "played").otherwise("scheduled").alias("status"),
        key.alias("order_no"),
    )


def match_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Shots per match from the order's lines; orders without lines have no statistics."""
    return (
        table(spark, folder, "lineitem")
        .groupBy("l_orderkey")
        .agg(F.sum("l_quantity").alias("q"), F.count("*").alias("n"))
        .select(
            F.concat(F.lit("M"), padded(F.col("l_orderkey"), 12)).alias("match_id"),
            F.floor(F.col("q") / 8).cast("double").alias("home_shots"),
            (F.col("n") * 3).cast("double").alias("away_shots"),
            F.floor(F.col("q") / 16).cast("double").alias("home_shots_on_target"),
            F.col("n").cast("double").alias("away_shots_on_target"),
        )
    )


def spells(spark: SparkSession, folder: str) -> DataFrame:
    """Appointments: every order puts one of seven coaches in charge of the club."""
    key = F.col("o_orderkey")
    day = F.to_date("o_orderdate")
    imprecise = key % 10 == 0
    start = F.when(imprecise, F.trunc(day, "year")).otherwise(day)
    return (
        table(spark, folder, "orders")
        .select(
            club_name(F.floor(F.col("o_custkey") / 10)).alias("team"),
            F.concat(F.lit("Coach "), (key % 7).cast("string")).alias("manager"),
            start.alias("start_date"),
            F.when(key % 3 == 0, None).otherwise(
                F.date_add(start, (key % 300 + 20).cast("int"))
            ).alias("end_date"),
            imprecise.alias("year_only"),
            key.alias("row_no"),
        )
    )


def status_changes(spark: SparkSession, folder: str) -> DataFrame:
    """The event stream as observations of an entity's state."""
    return table(spark, folder, "events").select(
        "event_id",
        F.date_format("ts", "yyyy-MM").alias("season"),
        F.col("user_id").cast("string").alias("player_code"),
        F.col("ts").alias("observed_at"),
        F.col("event_type").alias("status"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def players(spark: SparkSession, folder: str) -> DataFrame:
    """Every shipped part as a rated player of the supplier, in the year it shipped."""
    # A playing position for each part size remainder.
    positions = "GK CB LB RB CDM CM LM RW ST CF".split()
    lines = table(spark, folder, "lineitem").select(
        "l_partkey", "l_suppkey", F.year("l_shipdate").alias("year"), "l_orderkey", "l_linenumber"
    )
    parts = table(spark, folder, "part").select("p_partkey", "p_size", "p_retailprice")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.concat(F.lit("Supplier "), F.col("l_suppkey").cast("string")).alias("team"),
        F.concat_ws("-", F.col("year").cast("string"),
                    F.lpad(F.pmod(F.col("year") + 1, F.lit(100)).cast("string"), 2, "0")).alias("season"),
        F.lit("lines").alias("source"),
        F.col("p_retailprice").alias("rating"),
        (F.col("p_retailprice") * 100).alias("value"),
        F.element_at(F.array(*[F.lit(p) for p in positions]),
                     (F.col("p_size") % 10 + 1).cast("int")).alias("positions"),
    )


def club_players(spark: SparkSession, folder: str) -> DataFrame:
    """Every line of an order as a rated player of its home club, from two sources; every third season has no edition."""
    lines = table(spark, folder, "lineitem").select(
        F.concat(F.lit("M"), padded(F.col("l_orderkey"), 12)).alias("match_id"), "l_partkey", "l_suppkey")
    parts = table(spark, folder, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.col("p_retailprice").alias("rating"), "p_size")
    edited = F.substring("season", 1, 4).cast("int") % 3 != 0
    clubs = matches(spark, folder).filter(edited).select("match_id", "season", F.col("home_team").alias("team"))
    position = F.when(F.col("p_size") % 3 == 0, "CB").when(F.col("p_size") % 3 == 1, "CM").otherwise("ST")
    return lines.join(parts, "l_partkey").join(clubs, "match_id").select(
        "team", "season", F.when(F.col("l_suppkey") % 5 == 0, "sofifa:late").otherwise("fifa_model:early").alias("source"),
        "rating", (F.col("rating") * 100).alias("value"), position.alias("positions"))


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Two forecast runs per league match: one before the match date, one around it."""
    rows = matches(spark, folder).filter("competition = 'premier_league'")
    k = F.col("order_no")
    run = F.explode(F.array(F.lit(1), F.lit(2)))
    staged = rows.select("*", run.alias("run"))
    ph = 20 + (k * 7 + F.col("run")) % 41
    pd = 15 + (k * 3 + F.col("run")) % 13
    lead = F.when(F.col("run") == 1, 3).otherwise((k % 5).cast("int") - 3)
    stamp = F.concat(F.date_sub("match_date", lead).cast("string"), F.lit("T12:30:00+00:00"))
    p = [ph / 100.0, pd / 100.0, (100 - ph - pd) / 100.0]
    pick = F.when((p[0] >= p[1]) & (p[0] >= p[2]), "H").when(p[1] >= p[2], "D").otherwise("A")
    return staged.select(
        F.concat(F.lit("run"), F.col("run").cast("string"), F.lit("-"), F.col("pool"), F.lit("-"),
                 F.col("season"), F.lit("-"), F.col("matchday").cast("string")).alias("run_id"),
        "match_id", "season", "matchday",
        p[0].alias("p_home"), p[1].alias("p_draw"), p[2].alias("p_away"),
        pick.alias("predicted_outcome"),
        ((k % 30) / 10.0).alias("exp_home_goals"), ((k % 20) / 10.0).alias("exp_away_goals"),
        ((k * 5) % 4).cast("int").alias("pred_home_goals"), ((k * 7) % 3).cast("int").alias("pred_away_goals"),
        ((k % 17) / 100.0).alias("scoreline_prob"),
        stamp.alias("created_at"),
    )


def model_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The runs those forecasts belong to, with metrics as JSON."""
    return (
        predictions(spark, folder)
        .groupBy("run_id", F.col("season").alias("target_season"), F.col("matchday").alias("target_matchday"))
        .agg(F.max("created_at").alias("created_at"), F.count("*").alias("n"))
        .withColumn("metrics", F.to_json(F.struct(F.col("n").alias("n_predictions"))))
        .drop("n")
    )


def unavailability(spark: SparkSession, folder: str) -> DataFrame:
    """Players out of a club's squad in a round, from the lines of its home orders."""
    lines = table(spark, folder, "lineitem").select(
        F.concat(F.lit("M"), padded(F.col("l_orderkey"), 12)).alias("match_id"), "l_linenumber"
    )
    league = matches(spark, folder).filter("competition = 'premier_league'")
    return (
        lines.join(league.select("match_id", "season", "matchday", F.col("home_team").alias("team")), "match_id")
        .groupBy("season", "matchday", "team")
        .agg(F.count("*").cast("int").alias("players_out"),
             F.count_if(F.col("l_linenumber") == 1).cast("int").alias("key_players_out"))
    )


def european(spark: SparkSession, folder: str) -> DataFrame:
    """A cup entry per club and season, from the club's first customer segment."""
    clubs = table(spark, folder, "customer").groupBy(
        club_name(F.floor(F.col("c_custkey") / 10)).alias("team")
    ).agg(F.min("c_mktsegment").alias("segment"), F.max("c_mktsegment").alias("last"))
    cup = (
        F.when(F.col("last") == "MACHINERY", "champions_league")
        .when(F.col("segment") == "AUTOMOBILE", "europa_league")
        .when(F.col("segment") == "BUILDING", "conference_league").otherwise("none")
    )
    entries = clubs.select("team", cup.alias("competition"))
    both = matches(spark, folder).select("season", F.col("home_team").alias("team")).distinct()
    return both.join(entries, "team").select("season", "team", "competition")


def archive_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The league's matches written in the archive's line format, one file per league.

    Not every match repeats its heading, date or time, so a reader has to carry them.
    """
    key = F.col("order_no")
    rows = matches(spark, folder)
    months = F.array(*[F.lit(m) for m in "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()])
    heading = F.when(key % 5 == 0, F.concat(F.lit("▪ Matchday "), (key % 38 + 1).cast("string")))
    heading = F.when(key % 35 == 5, F.lit("▪ Semi-finals")).otherwise(heading)
    month = F.element_at(months, F.month("match_date"))
    day = F.dayofmonth("match_date").cast("string")
    dated = F.when(
        key % 3 == 0,
        F.concat(F.lit("  Sat "), F.when(key % 2 == 0, F.concat_ws(" ", month, day)).otherwise(F.concat_ws(" ", day, month)),
                 F.when(key % 12 == 0, F.concat(F.lit(" "), F.year("match_date").cast("string"))).otherwise("")),
    )
    score = F.concat_ws("-", F.col("home_goals").cast("string"), F.col("away_goals").cast("string"))
    played = F.col("status") == "played"
    time = F.when(key % 4 == 1, "    15:00  ").when(key % 4 == 2, "   9.30  ").otherwise("      ")
    home = F.concat(F.col("home_team"), F.when(key % 2 == 0, " FC").otherwise(""))
    line = F.when(
        (key % 7 == 3) & played,
        F.concat(time, home, F.lit("  "), score, F.lit(" (0-0)  "), F.col("away_team")),
    ).otherwise(
        F.concat(time, home, F.lit("  v "), F.col("away_team"),
                 F.when(played & (key % 13 == 1), F.concat(F.lit("  5-4 pen. ("), score, F.lit(", 1-0)")))
                 .when(played, F.concat(F.lit("  "), score, F.lit(" (0–1)"))).otherwise(""),
                 F.when(key % 41 == 0, F.lit("  [abandoned]")).otherwise("")),
    )
    parts = F.array(heading, dated, F.when(key % 6 == 0, F.lit("# note")), line)
    return rows.select(
        F.lit("1994-95").alias("season"), F.lit("premier_league").alias("competition"),
        F.col("pool").alias("file"), "order_no", F.posexplode(parts).alias("part", "line"),
    ).filter("line is not null").select(
        "season", "competition", "file", (F.col("order_no") * 4 + F.col("part")).alias("line_no"), "line"
    )


#: States of the growing archive: the first day without results, and whether corrections and moves are in.
ARCHIVE_STATES = (("1999-06-01", False), ("1999-06-01", True), (PLAYED_BEFORE, True))


def growing_archive(spark: SparkSession, folder: str) -> DataFrame:
    """All matches as archive lines of their league, season and competition, as the archive stood at each of its states.

    Later states know more results, correct some of February 1999 and put some matches of early 2000 a month later.
    """
    states = F.array(*[F.struct(F.lit(i).alias("state"), F.lit(until).cast("date").alias("until"), F.lit(late).alias("late"))
                       for i, (until, late) in enumerate(ARCHIVE_STATES, 1)])
    key, day = F.col("order_no"), F.col("match_date")
    corrected = F.col("late") & (key % 5 == 0) & day.between("1999-02-01", "1999-02-28")
    moved = F.col("late") & (key % 53 == 0) & day.between("2000-01-01", "2000-02-29")
    home_goals = F.col("home_goals") + F.when(corrected, 1).otherwise(0)
    date = F.when(moved, F.date_add(day, 30)).otherwise(day)
    heading = F.coalesce(F.concat(F.lit("▪ Matchday "), F.col("original_matchday").cast("string")), F.lit("▪ Cup"))
    score = F.when(day < F.col("until"), F.concat(
        F.lit("  "), home_goals.cast("string"), F.lit("-"), F.col("away_goals").cast("string"))).otherwise("")
    time = F.coalesce(F.concat(F.lit("  "), F.col("kickoff"), F.lit("  ")), F.lit("  "))
    parts = F.array(heading, F.date_format(date, "EEE d MMM yyyy"),
                    F.concat(time, F.col("home_team"), F.lit(" v "), F.col("away_team"), score))
    place = ("state", "pool", "season", "competition")
    return (
        matches(spark, folder).select("*", F.inline(states))
        .select(*place, "order_no", F.posexplode(parts).alias("part", "line"))
        .select(*place, (key * 4 + F.col("part")).alias("line_no"), "line")
    )


def availability_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """Every event as a one-player snapshot in the nested JSON layout."""
    kinds = {"view": 1, "click": 2, "purchase": 3, "signup": 4, "error": 5}
    kind = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    null = F.lit(None).cast("string")
    k = F.get_json_object("props", "$.k").cast("int")
    payload = F.struct(
        F.array(F.struct((F.col("user_id") % 20).alias("id"),
                         F.concat(F.lit("Team "), (F.col("user_id") % 20).cast("string")).alias("name"))).alias("teams"),
        F.array(F.struct(k.alias("id"), (k % 2 == 0).alias("is_next"))).alias("events"),
        F.array(
            F.struct(
                F.col("user_id").alias("code"), F.col("event_id").alias("id"), F.col("event_type").alias("web_name"),
                kind[F.col("event_type")].alias("element_type"), (F.col("user_id") % 20).alias("team"),
                F.substring("event_type", 1, 1).alias("status"),
                F.when(k % 4 == 0, null).otherwise(k.cast("string")).alias("chance_of_playing_next_round"),
                F.concat(F.lit("  knock, \"minor\" "), k.cast("string"), F.lit(" ")).alias("news"),
            )
        ).alias("elements"),
    )
    return table(spark, folder, "events").select(
        F.date_format("ts", "yyyy").alias("season"), F.col("ts").alias("observed_at"),
        F.to_json(payload).alias("payload"),
    )


def spell_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Appointments as query answers in the bindings layout."""
    value = lambda c: F.struct(c.cast("string").alias("value"))
    row = F.struct(
        value(F.concat(F.lit("http://example.org/entity/Q"), F.regexp_extract("team", "([0-9]+)$", 1))).alias("club"),
        value(F.col("manager")).alias("coachLabel"),
        value(F.concat(F.col("start_date").cast("string"), F.lit("T00:00:00Z"))).alias("start"),
        value(F.when(F.col("year_only"), 9).otherwise(11)).alias("startPrecision"),
        F.when(F.col("end_date").isNotNull(),
               value(F.concat(F.col("end_date").cast("string"), F.lit("T00:00:00Z")))).alias("end"),
    )
    return spells(spark, folder).select(
        F.to_json(F.struct(F.struct(F.array(row).alias("bindings")).alias("results"))).alias("answer")
    )


def feeds(spark: SparkSession, folder: str) -> DataFrame:
    """Every page as a one-item feed document."""
    clean = lambda c: F.regexp_replace(c, "[<>&]", " ")
    stamp = F.when(F.col("page_id") % 6 == 0, "").otherwise(
        F.concat(F.lit("Tue, "), F.date_format(F.date_add(F.lit("2026-01-01").cast("date"), (F.col("page_id") % 200).cast("int")), "d MMM yyyy"),
                 F.lit(" 10:00:00 GMT"))
    )
    return table(spark, folder, "pages").select(
        F.concat(F.lit("<rss><channel><item><title>"), clean(F.col("url")), F.lit("</title><description>"),
                 clean(F.regexp_extract("html", "<title>([^<]*)</title>", 1)),
                 F.lit("</description><pubDate>"), stamp, F.lit("</pubDate></item></channel></rss>")).alias("xml")
    )


def headed(rows: DataFrame, header: Column) -> DataFrame:
    """Lines of ``folder, season, name`` with each file's header before them; ``header`` may differ by file."""
    place = ["folder", "season", "name"]
    heads = rows.select(*place, header.alias("line")).distinct().withColumn("line_no", F.lit(-1).cast("bigint"))
    return rows.select(*place, "line_no", "line").unionByName(heads)


def archive_files(spark: SparkSession, folder: str) -> DataFrame:
    """The archive at its first state as files: a folder per league, in it one per season, a file per competition."""
    names = F.create_map(*[F.lit(x) for pair in COMPETITION_FILES.items() for x in pair])
    return growing_archive(spark, folder).filter("state = 1").select(
        F.col("pool").alias("folder"), "season", names[F.col("competition")].alias("name"), "line_no", "line")


def statistics_files(spark: SparkSession, folder: str) -> DataFrame:
    """League statistics as CSV files, a folder per league; leagues differ in header, date form and cells."""
    rows = matches(spark, folder).filter("competition = 'premier_league'").join(match_stats(spark, folder), "match_id")
    text = lambda c: F.coalesce(F.col(c).cast("int").cast("string"), F.lit(""))
    shots = [text(c) for c in ("home_shots", "away_shots", "home_shots_on_target", "away_shots_on_target")]
    clubs = F.concat(F.col("home_team"), F.lit(" FC")), F.col("away_team")
    date = lambda form: F.date_format("match_date", form)
    kind = F.col("pool").cast("bigint") % 3
    judge = F.concat(F.lit('"Judge, '), (F.col("order_no") % 9).cast("string"), F.lit(' ""J"""'))
    lines = rows.select(
        F.col("pool").alias("folder"), "season",
        F.concat(F.lit("season-"), F.substring("season", 3, 2), F.substring("season", 6, 2), F.lit(".csv")).alias("name"),
        F.col("order_no").alias("line_no"),
        F.when(kind == 0, F.concat_ws(",", date("yyyy-MM-dd"), *clubs, text("home_goals"), text("away_goals"), *shots))
        .when(kind == 1, F.concat_ws(",", clubs[0], date("dd/MM/yyyy"), clubs[1], shots[0], shots[1], F.lit("junk")))
        .otherwise(F.concat_ws(",", judge, date("d/M/yy"), *clubs, shots[3], shots[2], shots[1], shots[0])).alias("line"),
    )
    at = F.col("folder").cast("bigint") % 3
    return headed(lines, F.when(at == 0, "Date,HomeTeam,AwayTeam,FTHG,FTAG,HS,AS,HST,AST")
                  .when(at == 1, "HomeTeam,Date,AwayTeam,HS,AS,Junk").otherwise("Referee,Date,HomeTeam,AwayTeam,AST,HST,AS,HS"))


def player_dump_files(spark: SparkSession, folder: str) -> DataFrame:
    """Players as dump files, a folder per hundred suppliers; seasons of even years in one layout, the others in the other."""
    start = F.substring("season", 1, 4).cast("int")
    number = F.regexp_extract("team", "([0-9]+)$", 1).cast("bigint")
    even, rating = start % 2 == 0, F.col("rating").cast("string")
    listed = F.concat(F.lit('"'), F.col("positions"), F.lit(', CAM"'))
    lines = players(spark, folder).select(
        F.concat(F.lit("block-"), padded(F.floor(number / 100), 3)).alias("folder"), "season",
        F.when(even, F.concat(F.lit("players_"), F.substring("season", 6, 2), F.lit(".csv")))
        .otherwise(F.concat(F.lit("ratings"), (start + 1).cast("string"), F.lit(".csv"))).alias("name"),
        F.xxhash64("team", "rating", "positions").alias("line_no"),
        F.when(even, F.concat_ws(",", "team", rating, listed, F.col("value").cast("string"), (number % 4).cast("string")))
        .otherwise(F.concat_ws(",", listed, rating, "team")).alias("line"),
    ).withColumn("line_no", F.abs("line_no"))
    return headed(lines, F.when(F.col("name").startswith("players"), "club_name,overall,player_positions,value_eur,league_level")
                  .otherwise("preferred_positions,rating,club"))


def unavailability_files(spark: SparkSession, folder: str) -> DataFrame:
    """Players out as hand-kept files with notes between the rows, one file per season."""
    number = F.regexp_extract("team", "([0-9]+)$", 1).cast("bigint")
    odd = F.substring("season", 4, 1).cast("int") % 2 == 1
    counts = [F.col("players_out").cast("string"), F.col("key_players_out").cast("string")]
    note = F.concat(F.lit('"out, '), counts[0], F.lit('"'))
    row = F.when(odd, F.concat_ws(", ", "season", F.col("matchday").cast("string"), "team", *counts)).otherwise(
        F.concat_ws(",", "team", "season", F.col("matchday").cast("string"), *counts, note, F.lit("club")))
    parts = F.array(F.when(number % 5 == 0, F.lit("  # checked, by hand")), row, F.when(number % 7 == 0, F.lit("")))
    lines = unavailability(spark, folder).select(
        F.lit("").alias("folder"), "season", F.lit("unavailability.csv").alias("name"),
        (number * 1000 + F.col("matchday")).alias("_at"), F.posexplode(parts).alias("_part", "line"),
    ).filter("line is not null").withColumn("line_no", F.col("_at") * 3 + F.col("_part"))
    at = F.substring("season", 4, 1).cast("int") % 2 == 1
    return headed(lines, F.when(at, "season, matchday, team, players_out, key_players_out").otherwise(
        "team,season,matchday,players_out,key_players_out,notes,source"))
