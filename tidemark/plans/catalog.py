"""Named queries over the driver's tables, each with its SQL twin where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import adapters as A
from tidemark.config import OUTCOME, RATES
from tidemark.functions import names as N
from tidemark.functions import scalars as S
from tidemark.models import evaluate as E
from tidemark.models import outcome as O
from tidemark.models import rates as R
from tidemark.models import softmax as SM
from tidemark.operators import changes as C
from tidemark.operators import form as FM
from tidemark.operators import intervals as I
from tidemark.operators import ledger as L
from tidemark.operators import refresh as RF
from tidemark.operators import schedule as SC
from tidemark.operators import squads as SQ
from tidemark.operators import standings as ST
from tidemark.operators import text as TX
from tidemark.operators.rating import expected_home, rate_matches
from tidemark.operators.timeline import sides, team_state, timeline
from tidemark.plans import features as FT
from tidemark.plans import forecast as FC
from tidemark.plans import oracle_base as B
from tidemark.plans import run as RN
from tidemark.plans import serving as SV
from tidemark.session import stage
from tidemark.sources import archive as AR
from tidemark.sources import feeds as FD
from tidemark.sources import files as FI
from tidemark.sources import tables as TB
from tidemark.streaming import changes as SCH
from tidemark.streaming import ratings as SRT

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
_STAGED: dict[tuple, DataFrame] = {}


def query(sql: str | None = None):
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


def staged(spark: SparkSession, folder: str, name: str, make: Callable[[], DataFrame], inside: bool = False) -> DataFrame:
    """Intermediate tables several queries read, stored once per session and data folder."""
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _STAGED:
        _STAGED[key] = stage(make(), name, inside=inside)
    return _STAGED[key]


def _rated(spark, d):
    return staged(spark, d, "rated", lambda: rate_matches(timeline(
        A.matches(spark, d).select(*FT.CORE_COLUMNS).join(A.match_stats(spark, d), "match_id", "left"))))


def _club_ratings(spark, d):
    playing = A.matches(spark, d).select("season", F.col("home_team").alias("team"))
    return SQ.playing_only(SQ.latest_source(SQ.squad_ratings(A.club_players(spark, d))), playing)


def _features(spark, d):
    return staged(spark, d, "features", lambda: FT.build_features(
        A.matches(spark, d), A.match_stats(spark, d), spells=I.tidy(A.spells(spark, d)),
        unavailability=A.unavailability(spark, d), european=A.european(spark, d), ratings=_club_ratings(spark, d)), inside=True)


def _sides(spark, d):
    return sides(timeline(A.matches(spark, d)))


def r6(frame: DataFrame, *columns: str) -> DataFrame:
    return frame.withColumns({c: F.round(c, 6) for c in columns})


# --- match table, names, labels -----------------------------------------------------------------

@query("WITH " + B.MATCHES + """
SELECT pool, match_id, season, competition, matchday, original_matchday, match_date, kickoff, home_team,
 away_team, home_goals, away_goals, result, status FROM matches""")
def match_table(spark, d):
    return A.matches(spark, d).drop("order_no")


@query("WITH " + B.MATCHES + "," + B.STATS + """
SELECT m.match_id, m.match_date, s.home_shots, s.away_shots, s.home_shots_on_target, s.away_shots_on_target
FROM matches m LEFT JOIN match_stats s USING (match_id) WHERE m.match_date IS NOT NULL""")
def matches_with_stats(spark, d):
    return TB.with_stats(A.matches(spark, d).select("match_id", "match_date"), A.match_stats(spark, d))


@query("WITH " + B.MATCHES + """
SELECT pool, season, competition, matchday, match_date, home_team, away_team, home_goals, away_goals
FROM matches WHERE competition IN ('premier_league', 'championship') AND status = 'played'""")
def goal_model_rows(spark, d):
    return TB.goal_model_matches(A.matches(spark, d))


_NAMES = """
raw AS (SELECT c_custkey, CASE c_nationkey % 5 WHEN 0 THEN 'AFC ' || c_name WHEN 1 THEN c_name || '  F.C.'
  WHEN 2 THEN ' Fc ' || c_name || ' A.F.C. fc' WHEN 3 THEN 'St. ' || c_name || '''s' ELSE c_name END AS spelled FROM customer)
"""


@query("WITH " + _NAMES + """
SELECT c_custkey, CASE WHEN spelled LIKE 'St.%' THEN 'St ' || substr(spelled, 5, length(spelled) - 6) || 's'
 ELSE regexp_extract(spelled, '(Customer#[0-9]+)', 1) END AS canonical,
 lower(CASE WHEN spelled LIKE 'St.%' THEN 'St ' || substr(spelled, 5, length(spelled) - 6) || 's'
 ELSE regexp_extract(spelled, '(Customer#[0-9]+)', 1) END) AS folded FROM raw""")
def canonical_club_names(spark, d):
    customer = A.table(spark, d, "customer")
    n, name = F.col("c_nationkey") % 5, F.col("c_name")
    spelled = (
        F.when(n == 0, F.concat(F.lit("AFC "), name)).when(n == 1, F.concat(name, F.lit("  F.C.")))
        .when(n == 2, F.concat(F.lit(" Fc "), name, F.lit(" A.F.C. fc")))
        .when(n == 3, F.concat(F.lit("St. "), name, F.lit("'s"))).otherwise(name)
    )
    rows = N.canonicalise(customer.select("c_custkey", spelled.alias("canonical")), ["canonical"])
    return rows.withColumn("folded", F.lower("canonical"))


@query("""SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'Man United' WHEN 1 THEN 'QPR' ELSE n_name END AS shown
FROM nation""")
def display_names(spark, d):
    k = F.col("n_nationkey") % 3
    full = F.when(k == 0, "Manchester United").when(k == 1, "Queens Park Rangers").otherwise(F.col("n_name"))
    return A.table(spark, d, "nation").select("n_nationkey", N.display_name(full).alias("shown"))


@query("WITH " + B.MATCHES + """
SELECT match_id, season || '-' || substr(competition, 1, 3) || '-' || substr(sha1(season || '|' || competition || '|'
 || coalesce(CAST(nullif(original_matchday, 0) AS VARCHAR), '?') || '|' || home_team || '|' || away_team), 1, 16) AS stable_id
FROM matches""")
def stable_match_ids(spark, d):
    m = A.matches(spark, d)
    return m.select("match_id", S.match_key(
        F.col("season"), F.col("competition"), F.col("original_matchday"), F.lit(None).cast("string"),
        F.col("home_team"), F.col("away_team")).alias("stable_id"))


@query("WITH " + B.PLAYERS + """
SELECT positions, CASE WHEN positions = 'GK' THEN 'GK' WHEN positions IN ('CB', 'LB', 'RB') THEN 'DEF'
 WHEN positions IN ('CDM', 'CM', 'LM') THEN 'MID' ELSE 'ATT' END AS unit, count(*) AS n FROM players GROUP BY ALL""")
def position_units(spark, d):
    p = A.players(spark, d).withColumn("listed", F.concat("positions", F.lit(" / CAM")))
    return p.groupBy("positions", S.position_group(F.col("listed")).alias("unit")).agg(F.count("*").alias("n"))


@query("WITH " + B.MATCHES + """,
t AS (SELECT season, pool, max(coalesce(matchday, 0)) AS total FROM matches WHERE competition = 'premier_league' GROUP BY ALL)
SELECT m.match_id, CAST(isodow(match_date) IN (2, 3, 4) AS DOUBLE) AS is_midweek, CAST(isodow(match_date) >= 6 AS DOUBLE) AS is_weekend,
 round(coalesce(matchday, 0) / coalesce(nullif(total, 0), 38), 6) AS season_progress, CAST(coalesce(matchday, 0) AS DOUBLE) AS matchday_number,
 CAST(coalesce(nullif(total, 0), 38) - coalesce(matchday, 0) AS DOUBLE) AS matchdays_remaining
FROM matches m LEFT JOIN t USING (season, pool)""")
def calendar_flags(spark, d):
    m = A.matches(spark, d)
    rows = m.join(ST.matchdays_per_season(m), ["pool", "season"], "left")
    return r6(rows.select(
        "match_id", S.is_midweek(F.col("match_date")).alias("is_midweek"),
        S.is_weekend(F.col("match_date")).alias("is_weekend"),
        *S.season_progress(F.col("matchday"), F.col("total_matchdays"))), "season_progress")


# --- timeline and state ---------------------------------------------------------------------------

@query("WITH " + B.TIMELINE + "SELECT match_id, in_block, block_date, block_key, seq_key FROM tl")
def timeline_blocks(spark, d):
    return timeline(A.matches(spark, d)).select("match_id", "in_block", "block_date", "block_key", "seq_key")


@query("WITH " + B.SIDES + "SELECT match_id, team, opponent, is_home, gf AS goals_for, ga AS goals_against, played FROM sides")
def two_sided_rows(spark, d):
    return _sides(spark, d).select(
        "match_id", "team", "opponent", "is_home", "goals_for", "goals_against", "played")


@query("WITH " + B.HISTORY + """
SELECT q.match_id, q.team, count(h.o_id) AS games, CAST(coalesce(sum(h.gf), 0) AS BIGINT) AS scored,
 max(h.o_date) FILTER (h.age_rank = 1) AS newest, min(h.o_date) AS oldest_date
FROM sides q LEFT JOIN hist h ON h.match_id = q.match_id AND h.team = q.team WHERE q.in_block GROUP BY ALL""")
def bounded_history(spark, d):
    state = team_state(_sides(spark, d)).filter("in_block")
    return state.select(
        "match_id", "team", F.size("history").cast("bigint").alias("games"),
        F.aggregate("history", F.lit(0).cast("bigint"), lambda a, g: a + g.gf).alias("scored"),
        F.try_element_at("history", F.lit(-1))["date"].alias("newest"),
        F.array_min(F.transform("history", lambda g: g.date)).alias("oldest_date"))


_FORM = "WITH " + B.HISTORY + """,
young AS (SELECT *, row_number() OVER (PARTITION BY match_id, team ORDER BY seq_key DESC) AS rn
  FROM hist WHERE today - o_date <= 120),
wins AS (SELECT unnest([4, 6, 10]) AS w),
f AS (SELECT match_id, team, w, avg(pts) AS ppg, avg(gf) AS goals_for, avg(ga) AS goals_against, avg(gf - ga) AS goal_difference,
  avg(CAST(pts = 3 AS INTEGER)) AS win_rate, avg(CAST(ga = 0 AS INTEGER)) AS clean_sheet_rate, count(*) AS games
  FROM young, wins WHERE rn <= w GROUP BY ALL)
SELECT q.match_id, q.team, wins.w AS form_window, round(ppg, 6) AS ppg, round(goals_for, 6) AS goals_for,
 round(goals_against, 6) AS goals_against, round(goal_difference, 6) AS goal_difference, round(win_rate, 6) AS win_rate,
 round(clean_sheet_rate, 6) AS clean_sheet_rate, CAST(coalesce(games, 0) AS DOUBLE) AS games
FROM sides q, wins LEFT JOIN f ON f.match_id = q.match_id AND f.team = q.team AND f.w = wins.w WHERE q.in_block"""


@query(_FORM)
def rolling_form(spark, d):
    state = FM.add_form(team_state(_sides(spark, d)).filter("in_block"))
    keep = ["ppg", "goals_for", "goals_against", "goal_difference", "win_rate", "clean_sheet_rate", "games"]
    long = state.select("match_id", "team", F.explode(F.array(*[
        F.struct(F.lit(w).alias("form_window"), *[F.col(f"form{w}_{n}").alias(n) for n in keep])
        for w in (4, 6, 10)])).alias("f")).select("match_id", "team", "f.*")
    return r6(long, *keep[:-1])


@query("WITH " + B.HISTORY + "," + B.STATS + """,
young AS (SELECT *, row_number() OVER (PARTITION BY match_id, team ORDER BY seq_key DESC) AS rn FROM hist WHERE today - o_date <= 120)
SELECT match_id, team, round(avg(CASE WHEN o_home THEN home_shots ELSE away_shots END), 6) AS shots_for,
 round(avg(CASE WHEN o_home THEN away_shots ELSE home_shots END), 6) AS shots_against,
 round(avg(CASE WHEN o_home THEN home_shots_on_target ELSE away_shots_on_target END), 6) AS on_target_for,
 round(avg(CASE WHEN o_home THEN away_shots_on_target ELSE home_shots_on_target END), 6) AS on_target_against
FROM (SELECT y.match_id, y.team, y.o_home, s.* EXCLUDE (match_id) FROM young y LEFT JOIN match_stats s ON s.match_id = y.o_id WHERE y.rn <= 6)
GROUP BY ALL""")
def rolling_shots(spark, d):
    rows = sides(timeline(A.matches(spark, d).join(A.match_stats(spark, d), "match_id", "left")))
    state = FM.add_form(team_state(rows).filter("in_block"))
    return r6(state.filter("form6_games > 0").select(
        "match_id", "team", F.col("form6_shots_for").alias("shots_for"), F.col("form6_shots_against").alias("shots_against"),
        F.col("form6_shots_on_target_for").alias("on_target_for"),
        F.col("form6_shots_on_target_against").alias("on_target_against")),
        "shots_for", "shots_against", "on_target_for", "on_target_against")


_RECORD = "WITH " + B.SIDES + """,
rec AS (SELECT q.match_id, q.team, q.is_home, count(o.match_id) AS played, count(*) FILTER (o.pts = 3) AS won, count(*) FILTER (o.pts = 1) AS drawn,
 count(*) FILTER (o.pts = 0) AS lost, CAST(coalesce(sum(o.gf), 0) AS BIGINT) AS gf, CAST(coalesce(sum(o.ga), 0) AS BIGINT) AS ga,
 count(*) FILTER (o.is_home = q.is_home) AS v_n, sum(o.pts) FILTER (o.is_home = q.is_home) AS v_pts,
 sum(o.gf) FILTER (o.is_home = q.is_home) AS v_gf, sum(o.ga) FILTER (o.is_home = q.is_home) AS v_ga
 FROM sides q LEFT JOIN sides o ON o.pool = q.pool AND o.team = q.team AND o.season = q.season AND o.played
  AND o.competition = 'premier_league' AND o.block_key < q.block_key WHERE q.in_block GROUP BY ALL)
"""


@query(_RECORD + "SELECT match_id, team, played, won, drawn, lost, gf, ga FROM rec")
def season_to_date(spark, d):
    state = team_state(_sides(spark, d)).filter("in_block")
    return state.select("match_id", "team", *[
        F.col(f"rec_{n}").cast("bigint").alias(n) for n in ("played", "won", "drawn", "lost", "gf", "ga")])


@query(_RECORD + """SELECT match_id, team, round(v_pts / nullif(v_n, 0), 6) AS venue_ppg, round(v_gf / nullif(v_n, 0), 6) AS venue_goals_for,
 round(v_ga / nullif(v_n, 0), 6) AS venue_goals_against FROM rec""")
def venue_splits(spark, d):
    state = team_state(_sides(spark, d)).filter("in_block")
    return r6(state.select("match_id", "team", *ST.venue_record(F.col("is_home"))),
              "venue_ppg", "venue_goals_for", "venue_goals_against")


@query("WITH " + B.SIDES + """,
t AS (SELECT pool, team, season, count(*) FILTER (played) AS n, sum(pts) AS pts, sum(gf - ga) AS gd FROM sides WHERE competition = 'premier_league' GROUP BY ALL)
SELECT pool, team, season, round(last_value(CASE WHEN n > 0 THEN pts / n END IGNORE NULLS) OVER w, 6) AS previous_season_ppg,
 round(last_value(CASE WHEN n > 0 THEN gd / n END IGNORE NULLS) OVER w, 6) AS previous_season_gd_per_game,
 CAST(coalesce(sum(CAST(n > 0 AS INTEGER)) OVER w, 0) AS DOUBLE) AS seasons_tracked,
 CAST(coalesce(max(CAST(n > 0 AS INTEGER)) OVER w, 0) AS DOUBLE) AS previous_season_was_top_flight
FROM t WINDOW w AS (PARTITION BY pool, team ORDER BY season ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def previous_season(spark, d):
    return r6(ST.previous_season(_sides(spark, d)).drop("top_flight_seasons"),
              "previous_season_ppg", "previous_season_gd_per_game")


_STANDINGS = "WITH " + B.SIDES + """,
lg AS (SELECT * FROM sides WHERE in_block),
grid AS (SELECT * FROM (SELECT DISTINCT pool, season, team FROM lg) JOIN (SELECT DISTINCT pool, season, block_key FROM lg) USING (pool, season)),
tab0 AS (SELECT g.pool, g.season, g.block_key, g.team, count(o.match_id) AS played, CAST(coalesce(sum(o.pts), 0) AS BIGINT) AS points,
 CAST(coalesce(sum(o.gf - o.ga), 0) AS BIGINT) AS gd, CAST(coalesce(sum(o.gf), 0) AS BIGINT) AS gf
 FROM grid g LEFT JOIN lg o ON o.pool = g.pool AND o.season = g.season AND o.team = g.team AND o.played AND o.block_key < g.block_key GROUP BY ALL),
tab AS (SELECT *, row_number() OVER (PARTITION BY pool, season, block_key ORDER BY points DESC, gd DESC, gf DESC, team) AS position,
 count(*) OVER (PARTITION BY pool, season, block_key) AS size FROM tab0)
"""


@query(_STANDINGS + "SELECT pool, season, block_key, team, played, points, gd, gf, position FROM tab")
def standings_before_block(spark, d):
    return ST.standings(_sides(spark, d))


@query(_STANDINGS + """, anchors AS (SELECT pool, season, block_key, max(points) FILTER (position = 1) AS p1, max(points) FILTER (position = 4) AS p4,
 max(points) FILTER (position = 6) AS p6, max(points) FILTER (position = size - 2) AS safe FROM tab GROUP BY ALL)
SELECT pool, season, block_key, team, CAST(position AS DOUBLE) AS table_position, CAST(played AS DOUBLE) AS table_played, CAST(points AS DOUBLE) AS table_points,
 round(points / nullif(played, 0), 6) AS table_ppg, CAST(p1 - points AS DOUBLE) AS points_off_top, CAST(p4 - points AS DOUBLE) AS points_off_top4,
 CAST(p6 - points AS DOUBLE) AS points_off_top6, CAST(points - safe AS DOUBLE) AS points_above_drop FROM tab JOIN anchors USING (pool, season, block_key)""")
def table_context(spark, d):
    return r6(ST.table_context(ST.standings(_sides(spark, d))), "table_ppg")


@query("WITH " + B.SIDES + """,
mem AS (SELECT DISTINCT pool, season, team FROM sides WHERE competition = 'premier_league'),
sea AS (SELECT pool, season, lag(season) OVER (PARTITION BY pool ORDER BY season) AS prev FROM (SELECT DISTINCT pool, season FROM mem))
SELECT m.pool, m.season, m.team, CAST(s.prev IS NOT NULL AND p.team IS NULL AS DOUBLE) AS is_promoted FROM mem m JOIN sea s ON s.pool = m.pool AND s.season = m.season
LEFT JOIN mem p ON p.pool = m.pool AND p.season = s.prev AND p.team = m.team""")
def promoted_clubs(spark, d):
    return ST.promoted(ST.members(A.matches(spark, d)))


@query("WITH " + B.SIDES + """
SELECT pool, season, count(DISTINCT team) AS clubs, CAST(max(matchday) AS INTEGER) AS total_matchdays FROM sides WHERE competition = 'premier_league' GROUP BY ALL""")
def season_membership(spark, d):
    m = A.matches(spark, d)
    clubs = ST.members(m).groupBy("pool", "season").agg(F.count("*").alias("clubs"))
    return clubs.join(ST.matchdays_per_season(m), ["pool", "season"])


@query("WITH " + B.HISTORY + """,
lst AS (SELECT match_id, team, max(o_date) FILTER (age_rank = 1) AS last_played,
  count(*) FILTER (o_date >= today - 14 AND o_date < today) AS n14, count(*) FILTER (o_date >= today - 21 AND o_date < today) AS n21 FROM hist GROUP BY ALL),
blk AS (SELECT q.match_id, q.team, count(*) AS fixtures, max(o.match_date) FILTER (o.match_date < q.match_date) AS last_listed,
  count(*) FILTER (o.match_date < q.match_date AND o.match_date >= q.match_date - 14) AS e14,
  count(*) FILTER (o.match_date < q.match_date AND o.match_date >= q.match_date - 21) AS e21
  FROM sides q JOIN sides o ON o.pool = q.pool AND o.team = q.team AND o.block_key = q.block_key WHERE q.in_block GROUP BY ALL),
nxt AS (SELECT q.match_id, q.team, min(o.match_date) AS next_date FROM sides q JOIN sides o ON o.pool = q.pool AND o.team = q.team AND o.match_date > q.match_date WHERE q.in_block GROUP BY ALL)
SELECT q.match_id, q.team, CASE WHEN greatest(l.last_played, b.last_listed) IS NOT NULL THEN CAST(least(q.match_date - greatest(l.last_played, b.last_listed), 21) AS DOUBLE) END AS rest_days,
 CAST(coalesce(n14, 0) + e14 AS DOUBLE) AS matches_last_14d, CAST(coalesce(n21, 0) + e21 AS DOUBLE) AS matches_last_21d,
 CAST(fixtures AS DOUBLE) AS gameweek_fixtures, CAST(CASE WHEN next_date IS NOT NULL THEN least(next_date - q.match_date, 21) END AS DOUBLE) AS days_to_next_match
FROM sides q LEFT JOIN lst l USING (match_id, team) LEFT JOIN blk b USING (match_id, team) LEFT JOIN nxt n USING (match_id, team)
WHERE q.in_block""")
def congestion(spark, d):
    rows = _sides(spark, d)
    state = FM.add_congestion(team_state(rows).filter("in_block"), rows)
    return state.select("match_id", "team", "rest_days", "matches_last_14d", "matches_last_21d",
                        "gameweek_fixtures", "days_to_next_match")


@query("WITH " + B.TIMELINE + """,
pairs AS (SELECT *, least(home_team, away_team) AS a, greatest(home_team, away_team) AS b FROM tl),
met AS (SELECT q.match_id, q.match_date AS today, o.match_date AS o_date, CASE WHEN o.home_team = q.home_team THEN o.home_goals - o.away_goals ELSE o.away_goals - o.home_goals END AS gd,
  row_number() OVER (PARTITION BY q.match_id ORDER BY o.seq_key DESC) AS rn
  FROM pairs q JOIN pairs o ON o.pool = q.pool AND o.a = q.a AND o.b = q.b AND o.home_goals IS NOT NULL AND o.block_key < q.block_key WHERE q.in_block QUALIFY rn <= 6)
SELECT q.match_id, CAST(count(m.rn) AS DOUBLE) AS h2h_games, round(avg(CASE WHEN gd > 0 THEN 3 WHEN gd = 0 THEN 1 WHEN gd < 0 THEN 0 END), 6) AS h2h_home_ppg,
 round(avg(gd), 6) AS h2h_goal_difference, CAST(max(today - o_date) FILTER (rn = 1) AS DOUBLE) AS h2h_days_since
FROM tl q LEFT JOIN met m USING (match_id) WHERE q.in_block GROUP BY ALL""")
def head_to_head(spark, d):
    rows = FM.head_to_head(timeline(A.matches(spark, d))).drop("pool")
    return r6(rows, "h2h_home_ppg", "h2h_goal_difference")


_ELO = "WITH RECURSIVE " + B.TIMELINE + """,
ord AS (SELECT pool, match_id, season, competition, home_team, away_team, home_goals AS hg, away_goals AS ag, in_block, block_key,
  row_number() OVER (PARTITION BY pool ORDER BY seq_key) AS pos FROM tl),
tm AS (SELECT pool, team, row_number() OVER (PARTITION BY pool ORDER BY team) AS ix FROM
  (SELECT pool, home_team AS team FROM tl UNION SELECT pool, away_team FROM tl)),
ev AS (SELECT o.*, h.ix AS hi, a.ix AS ai, CAST(CASE competition WHEN 'premier_league' THEN 1500 ELSE 1250 END AS DOUBLE) AS entry,
  CASE competition WHEN 'premier_league' THEN 1.0::DOUBLE WHEN 'fa_cup' THEN 0.6::DOUBLE ELSE 0.5::DOUBLE END AS wt,
  CAST(CASE WHEN abs(hg - ag) < 2 THEN 1 WHEN abs(hg - ag) = 2 THEN 1.5 ELSE (11 + abs(hg - ag)) / 8 END AS DOUBLE) AS mg
  FROM ord o JOIN tm h ON h.pool = o.pool AND h.team = o.home_team JOIN tm a ON a.pool = o.pool AND a.team = o.away_team),
st(pool, pos, rt, ls, match_id, he, ae) AS (
  SELECT pool, 0::BIGINT, list_transform(range(count(*)::BIGINT), lambda x: NULL::DOUBLE), list_transform(range(count(*)::BIGINT), lambda x: NULL::VARCHAR),
    NULL::VARCHAR, NULL::DOUBLE, NULL::DOUBLE FROM tm GROUP BY pool
  UNION ALL
  SELECT pool, pos, list_transform(rt, lambda r, i: CASE WHEN i = hi THEN he + coalesce(ch, 0) WHEN i = ai THEN ae - coalesce(ch, 0) ELSE r END),
    list_transform(ls, lambda s, i: CASE WHEN i = hi OR i = ai THEN season ELSE s END), match_id, he, ae FROM (
   SELECT *, 20.0::DOUBLE * mg * wt * (CAST(CASE WHEN hg > ag THEN 1 WHEN hg < ag THEN 0 WHEN hg = ag THEN 0.5 END AS DOUBLE) - 1 / (1 + pow(10.0::DOUBLE, -(he + 60 - ae) / 400))) AS ch FROM (
    SELECT s.pool, e.pos, s.rt, s.ls, e.match_id, e.hi, e.ai, e.hg, e.ag, e.mg, e.wt, e.season,
     CASE WHEN s.rt[e.hi] IS NULL THEN e.entry WHEN s.ls[e.hi] <> e.season THEN 0.75::DOUBLE * s.rt[e.hi] + 375 ELSE s.rt[e.hi] END AS he,
     CASE WHEN s.rt[e.ai] IS NULL THEN e.entry WHEN s.ls[e.ai] <> e.season THEN 0.75::DOUBLE * s.rt[e.ai] + 375 ELSE s.rt[e.ai] END AS ae
     FROM st s JOIN ev e ON e.pool = s.pool AND e.pos = s.pos + 1)))
"""


@query(_ELO + "SELECT match_id, round(he, 6) AS home_elo, round(ae, 6) AS away_elo FROM st WHERE match_id IS NOT NULL")
def rating_fold(spark, d):
    rated = rate_matches(timeline(A.matches(spark, d)).select(
        "pool", "match_id", "season", "competition", "home_team", "away_team", "home_goals", "away_goals", "seq_key"))
    return r6(rated.select("match_id", "home_elo", "away_elo"), "home_elo", "away_elo")


@query(_ELO + """,
sd AS (SELECT o.pool, o.block_key, o.pos, o.in_block, o.match_id, home_team AS team, he AS elo FROM ord o JOIN st USING (match_id)
  UNION ALL SELECT o.pool, o.block_key, o.pos, o.in_block, o.match_id, away_team, ae FROM ord o JOIN st USING (match_id)),
b AS (SELECT pool, team, block_key, arg_min(elo, pos) AS elo FROM sd WHERE in_block GROUP BY ALL)
SELECT o.match_id, round(h.elo, 6) AS home_elo, round(a.elo, 6) AS away_elo, round(1 / (1 + pow(10.0::DOUBLE, -(h.elo + 60 - a.elo) / 400)), 6) AS elo_expected_home
FROM ord o JOIN b h ON h.pool = o.pool AND h.block_key = o.block_key AND h.team = o.home_team
JOIN b a ON a.pool = o.pool AND a.block_key = o.block_key AND a.team = o.away_team WHERE o.in_block""")
def rating_at_block_start(spark, d):
    return r6(_features(spark, d).select("match_id", "home_elo", "away_elo", "elo_expected_home"),
              "home_elo", "away_elo", "elo_expected_home")


# --- context ----------------------------------------------------------------------------------------

@query("WITH " + B.HISTORY + "," + B.SPELLS + """,
cur AS (SELECT q.match_id, q.team, q.match_date, max(s.start_date) AS since FROM sides q LEFT JOIN spells s ON s.team = q.team AND s.start_date <= q.match_date
  AND (s.end_date IS NULL OR q.match_date <= s.end_date) WHERE q.in_block GROUP BY ALL),
u AS (SELECT c.match_id, c.team, c.match_date, c.since, count(h.o_id) FILTER (h.o_date >= since) AS n, avg(h.pts) FILTER (h.o_date >= since) AS now_ppg,
  avg(h.pts) FILTER (h.o_date < since) AS was FROM cur c LEFT JOIN hist h ON h.match_id = c.match_id AND h.team = c.team GROUP BY ALL)
SELECT match_id, team, CASE WHEN since IS NOT NULL THEN CAST(least(match_date - since, 2000) AS DOUBLE) END AS manager_days, CASE WHEN since IS NOT NULL THEN CAST(n AS DOUBLE) END AS manager_matches,
 CASE WHEN since IS NOT NULL THEN CAST(n < 6 AS DOUBLE) END AS manager_is_new, round(now_ppg - was, 6) AS manager_ppg_delta FROM u""")
def manager_tenure(spark, d):
    rows = FT.add_manager(team_state(FT.with_manager_start(_sides(spark, d), A.spells(spark, d))).filter("in_block"))
    return r6(rows.select("match_id", "team", "manager_days", "manager_matches", "manager_is_new", "manager_ppg_delta"),
              "manager_ppg_delta")


_SQUADS = "WITH " + B.PLAYERS + """,
best AS (SELECT season, team, source, avg(rating) FILTER (rn <= 11) AS top11, avg(rating) AS depth, count(*) AS n FROM
 (SELECT *, row_number() OVER (PARTITION BY season, team, source ORDER BY rating DESC) AS rn FROM players) WHERE rn <= 20 GROUP BY ALL),
val AS (SELECT season, team, source, sum(value) AS v FROM
 (SELECT *, row_number() OVER (PARTITION BY season, team, source ORDER BY value DESC) AS rn FROM players) WHERE rn <= 20 GROUP BY ALL),
unt AS (SELECT season, team, source, avg(rating) FILTER (u = 'ATT') AS attack, avg(rating) FILTER (u = 'MID') AS midfield, avg(rating) FILTER (u = 'DEF') AS defence FROM
 (SELECT *, row_number() OVER (PARTITION BY season, team, source, u ORDER BY rating DESC) AS rn FROM
  (SELECT *, CASE WHEN positions = 'GK' THEN 'GK' WHEN positions IN ('CB', 'LB', 'RB') THEN 'DEF' WHEN positions IN ('CDM', 'CM', 'LM') THEN 'MID' ELSE 'ATT' END AS u FROM players)) WHERE rn <= 5 GROUP BY ALL),
sq AS (SELECT b.season, b.team, b.source, round(0.7::DOUBLE * top11 + 0.3::DOUBLE * depth, 3) AS overall, attack, midfield, defence, round(top11, 3) AS top11_mean,
 CASE WHEN v <> 0 THEN v END AS squad_value FROM best b LEFT JOIN val USING (season, team, source) LEFT JOIN unt USING (season, team, source) WHERE n >= 8)
"""


@query(_SQUADS + """SELECT season, team, source, overall, round(attack, 6) AS attack, round(midfield, 6) AS midfield, round(defence, 6) AS defence, top11_mean,
 round(squad_value, 3) AS squad_value FROM sq""")
def squad_ratings(spark, d):
    return r6(SQ.squad_ratings(A.players(spark, d)), "attack", "midfield", "defence").withColumn(
        "squad_value", F.round("squad_value", 3))


_CARRY = _SQUADS + """,
rt AS (SELECT * FROM sq),
sn AS (SELECT season, row_number() OVER (ORDER BY season) AS ix FROM (SELECT season FROM rt UNION SELECT season FROM matches)),
cf AS (SELECT s.season, r.team, arg_max(r.season, e.ix) AS edition, arg_max(r.overall, e.ix) AS overall, s.ix - max(e.ix) AS age
 FROM sn s JOIN sn e ON e.ix <= s.ix JOIN rt r ON r.season = e.season GROUP BY s.season, s.ix, r.team)
"""


@query(_CARRY.replace("WITH ", "WITH " + B.MATCHES + ",", 1) + """, sc AS (SELECT season AS edition, avg(overall) AS mean, coalesce(nullif(stddev_samp(overall), 0), 1) AS sd FROM cf GROUP BY ALL)
SELECT season, team, round((overall - mean) / sd, 5) AS squad_overall_z, CAST(age AS DOUBLE) AS squad_rating_age FROM cf JOIN sc USING (edition)""")
def rating_carry_forward(spark, d):
    ratings = SQ.squad_ratings(A.players(spark, d))
    carried = SQ.carry_forward(ratings, A.matches(spark, d).select("season").distinct())
    return SQ.squad_features(carried).select(
        "season", "team", F.round("squad_overall_z", 5).alias("squad_overall_z"), "squad_rating_age")


_CLUB_SQUADS = _SQUADS.replace(B.PLAYERS, B.TIMELINE + "," + B.CLUB_PLAYERS) + """,
one AS (SELECT * FROM sq QUALIFY row_number() OVER (PARTITION BY season, team ORDER BY source DESC) = 1)
"""


@query(_CLUB_SQUADS + """SELECT season, team, source, overall, round(attack, 5) AS attack, round(defence, 5) AS defence, top11_mean, round(squad_value, 3) AS squad_value FROM one""")
def squad_source_precedence(spark, d):
    """Squads rated by two sources: the later one where it rates enough players, else the earlier."""
    return r6(_club_ratings(spark, d).select(
        "season", "team", "source", "overall", F.round("attack", 5).alias("attack"), F.round("defence", 5).alias("defence"),
        "top11_mean", F.round("squad_value", 3).alias("squad_value")), "overall")


@query(_CLUB_SQUADS + """, sn AS (SELECT season, row_number() OVER (ORDER BY season) AS ix FROM (SELECT season FROM one UNION SELECT season FROM matches)),
cf AS (SELECT s.season, r.team, arg_max(r.season, e.ix) AS edition, arg_max(r.overall, e.ix) AS overall, arg_max(coalesce(r.attack, -1), e.ix) AS attack,
  arg_max(coalesce(r.defence, -1), e.ix) AS defence, s.ix - max(e.ix) AS age FROM sn s JOIN sn e ON e.ix <= s.ix JOIN one r ON r.season = e.season GROUP BY s.season, s.ix, r.team),
sc AS (SELECT season AS edition, avg(overall) AS mean, coalesce(nullif(stddev_samp(overall), 0), 1) AS sd FROM cf GROUP BY ALL),
z AS (SELECT season, team, (overall - mean) / sd AS z, nullif(attack, -1) AS attack, nullif(defence, -1) AS defence, CAST(age AS DOUBLE) AS age FROM cf JOIN sc USING (edition))
SELECT m.match_id, round(h.z, 5) AS home_squad_overall_z, round(a.z, 5) AS away_squad_overall_z, round(h.z - a.z, 5) AS diff_squad_overall_z,
 round(h.attack, 5) AS home_squad_attack, round(a.defence, 5) AS away_squad_defence, h.age AS home_squad_rating_age, a.age AS away_squad_rating_age
FROM tl m LEFT JOIN z h ON h.season = m.season AND h.team = m.home_team LEFT JOIN z a ON a.season = m.season AND a.team = m.away_team WHERE m.in_block""")
def feature_squads(spark, d):
    """The squad columns of the feature table: ratings by source precedence, carried forward, scaled in their edition."""
    rounded = ["home_squad_overall_z", "away_squad_overall_z", "diff_squad_overall_z", "home_squad_attack", "away_squad_defence"]
    return _features(spark, d).select("match_id", *[F.round(c, 5).alias(c) for c in rounded],
                                      "home_squad_rating_age", "away_squad_rating_age")


@query("WITH " + B.SIDES + """,
una AS (SELECT m.season, m.matchday, m.home_team AS team, count(*) AS players_out, count(*) FILTER (l_linenumber = 1) AS key_players_out
 FROM lineitem JOIN matches m ON m.match_id = 'M' || lpad(CAST(l_orderkey AS VARCHAR), greatest(12, length(CAST(l_orderkey AS VARCHAR)))::INT, '0') WHERE competition = 'premier_league' GROUP BY ALL)
SELECT match_id, team, CAST(players_out AS DOUBLE) AS players_out, CAST(key_players_out AS DOUBLE) AS key_players_out
FROM sides LEFT JOIN una USING (season, matchday, team) WHERE in_block""")
def availability_lookup(spark, d):
    out = A.unavailability(spark, d)
    return _sides(spark, d).filter("in_block").join(out, ["season", "matchday", "team"], "left").select(
        "match_id", "team", F.col("players_out").cast("double"), F.col("key_players_out").cast("double"))


@query("WITH " + B.SIDES + """,
cl AS (SELECT 'Club ' || lpad(CAST(c_custkey // 10 AS VARCHAR), greatest(9, length(CAST(c_custkey // 10 AS VARCHAR)))::INT, '0') AS team, min(c_mktsegment) AS a, max(c_mktsegment) AS z FROM customer GROUP BY ALL),
eu AS (SELECT DISTINCT m.season, m.home_team AS team, CASE WHEN z = 'MACHINERY' THEN 3.0::DOUBLE WHEN a = 'AUTOMOBILE' THEN 2.0::DOUBLE WHEN a = 'BUILDING' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS tier
 FROM matches m JOIN cl ON cl.team = m.home_team)
SELECT match_id, team, coalesce(tier, 0.0::DOUBLE) AS european_tier FROM sides LEFT JOIN eu USING (season, team)""")
def european_tiers(spark, d):
    entries = A.european(spark, d).withColumnRenamed("competition", "cup")
    return _sides(spark, d).join(entries, ["season", "team"], "left").select(
        "match_id", "team", S.european_tier(F.col("cup")).alias("european_tier"))


@query(_RECORD + """
SELECT h.match_id, round(h.v_pts / nullif(h.v_n, 0), 6) AS home_venue_ppg, round(a.v_pts / nullif(a.v_n, 0), 6) AS away_venue_ppg,
 round(h.v_pts / nullif(h.v_n, 0) - a.v_pts / nullif(a.v_n, 0), 6) AS diff_venue_ppg
FROM rec h JOIN rec a ON a.match_id = h.match_id AND NOT a.is_home WHERE h.is_home""")
def side_pivot(spark, d):
    state = team_state(_sides(spark, d)).filter("in_block")
    rows = state.select("pool", "match_id", "is_home", *ST.venue_record(F.col("is_home")))
    wide = FT.pivot_sides(rows, ["venue_ppg"]).drop("pool")
    return r6(wide, "home_venue_ppg", "away_venue_ppg", "diff_venue_ppg")


@query()
def feature_table(spark, d):
    return _features(spark, d)


@query("WITH " + B.TIMELINE + """SELECT match_id, season, matchday, match_date, '2026.10.1' AS feature_version, 222::BIGINT AS n_keys FROM tl WHERE in_block""")
def feature_payload(spark, d):
    rows = FT.to_payload(_features(spark, d), "2026-01-01T00:00:00+00:00")
    size = F.size(F.map_keys(F.from_json("payload", "map<string,double>"))).cast("bigint")
    return rows.select("match_id", "season", "matchday", "match_date", "feature_version", size.alias("n_keys"))


# --- schedule -----------------------------------------------------------------------------------------

_CORES = "WITH " + B.MATCHES + """,
fx AS (SELECT *, original_matchday AS rnd FROM matches WHERE competition = 'premier_league'),
med AS (SELECT pool, season, rnd, median_date FROM (SELECT pool, season, rnd, match_date AS median_date,
  row_number() OVER (PARTITION BY pool, season, rnd ORDER BY match_date) AS rn, count(*) OVER (PARTITION BY pool, season, rnd) AS n FROM fx) WHERE rn = (n + 1) // 2),
core AS (SELECT f.pool, f.season, f.rnd, m.median_date, min(f.match_date) AS core_start FROM fx f JOIN med m USING (pool, season, rnd)
  WHERE abs(f.match_date - m.median_date) <= 4 GROUP BY ALL)
"""


@query(_CORES + "SELECT pool, season, rnd AS round, median_date, core_start FROM core")
def round_cores(spark, d):
    return SC.round_cores(A.matches(spark, d).filter("competition = 'premier_league'"), "original_matchday")


@query(_CORES + """,
win AS (SELECT f.match_id, c.rnd, row_number() OVER (PARTITION BY f.match_id ORDER BY c.core_start DESC, c.rnd DESC) AS rn
  FROM fx f JOIN core c ON c.pool = f.pool AND c.season = f.season AND c.core_start <= f.match_date),
fst AS (SELECT pool, season, rnd, row_number() OVER (PARTITION BY pool, season ORDER BY core_start, rnd) AS rn FROM core)
SELECT m.match_id, m.original_matchday, CASE WHEN m.competition <> 'premier_league' THEN m.original_matchday WHEN abs(m.match_date - md.median_date) <= 4 THEN m.original_matchday
  ELSE coalesce(w.rnd, f.rnd) END AS matchday FROM matches m LEFT JOIN med md ON md.pool = m.pool AND md.season = m.season AND md.rnd = m.original_matchday
 LEFT JOIN win w ON w.match_id = m.match_id AND w.rn = 1 LEFT JOIN fst f ON f.pool = m.pool AND f.season = m.season AND f.rn = 1""")
def round_assignment(spark, d):
    return SC.assign_rounds(A.matches(spark, d)).select("match_id", "original_matchday", "matchday")


_NEXT = "WITH " + B.MATCHES + """,
nx AS (SELECT k.pool, k.season, k.competition, min(m.matchday) AS next_matchday FROM (SELECT DISTINCT pool, season, competition FROM matches) k
 LEFT JOIN matches m ON m.pool = k.pool AND m.season = k.season AND m.competition = k.competition AND m.status <> 'played' AND NOT EXISTS (
  SELECT 1 FROM matches l WHERE l.pool = m.pool AND l.season = m.season AND l.competition = m.competition AND l.status = 'played' AND l.match_date > m.match_date)
 GROUP BY ALL)
"""


@query(_NEXT + "SELECT pool, season, competition, next_matchday FROM nx")
def next_block(spark, d):
    return SC.next_to_play(A.matches(spark, d))


@query(_NEXT + """SELECT pool, season, last_completed, next_matchday, coalesce(next_matchday, last_round, 1) AS current_matchday FROM
 (SELECT pool, season, max(matchday) FILTER (status = 'played') AS last_completed, max(matchday) AS last_round FROM matches WHERE competition = 'premier_league' GROUP BY ALL)
 JOIN nx USING (pool, season) WHERE competition = 'premier_league'""")
def league_progress(spark, d):
    return SC.progress(A.matches(spark, d))


@query("WITH " + B.MATCHES + "SELECT pool, season, matchday, min(match_date) AS cutoff FROM matches WHERE competition = 'premier_league' GROUP BY ALL")
def block_cutoffs(spark, d):
    return SC.cutoffs(A.matches(spark, d))


@query(_NEXT + """SELECT pool, season, n_played, next_matchday FROM (SELECT pool, season, count(*) FILTER (status = 'played') AS n_played FROM matches
 WHERE competition = 'premier_league' GROUP BY ALL) JOIN nx USING (pool, season) WHERE competition = 'premier_league'""")
def league_fingerprints(spark, d):
    return SC.fingerprint(A.matches(spark, d))


@query("WITH " + B.MATCHES + """SELECT pool, season, count(*) FILTER (status = 'played') AS n_played FROM matches WHERE competition = 'premier_league'
 GROUP BY ALL HAVING bool_or(match_date >= DATE '2001-01-01' AND match_date < DATE '2001-06-01')""")
def leagues_with_news(spark, d):
    now = A.matches(spark, d)
    before = now.withColumn("status", F.when(F.col("match_date") < "2001-01-01", F.col("status")).otherwise("scheduled"))
    return SC.changed_leagues(SC.fingerprint(now), SC.fingerprint(before)).drop("next_matchday")


# --- training frames, models --------------------------------------------------------------------------

@query("WITH " + B.MATCHES + """,
cut AS (SELECT pool, season, matchday, min(match_date) AS cutoff FROM matches WHERE competition = 'premier_league' GROUP BY ALL),
lab AS (SELECT pool, match_date FROM matches WHERE competition = 'premier_league' AND result IS NOT NULL)
SELECT c.pool, c.season, c.matchday, c.cutoff, count(l.pool) AS n_train FROM cut c LEFT JOIN lab l ON l.pool = c.pool AND l.match_date < c.cutoff GROUP BY ALL""")
def training_sizes(spark, d):
    league = A.matches(spark, d).filter("competition = 'premier_league'")
    return O.training_sizes(league, SC.cutoffs(league))


_ADMIT_COLUMNS = ["home_shots", "away_shots", "home_goals", "matchday"]


@query("WITH " + B.MATCHES + "," + B.STATS + """,
f AS (SELECT m.*, s.home_shots, s.away_shots FROM matches m LEFT JOIN match_stats s USING (match_id)),
a AS (SELECT 'train' AS part, * FROM f WHERE match_date < DATE '2001-03-01' AND result IS NOT NULL UNION ALL SELECT 'target', * FROM f WHERE match_date >= DATE '2001-06-01'),
l AS (SELECT part, unnest(['home_shots', 'away_shots', 'home_goals', 'matchday']) AS "column", unnest([count(home_shots), count(away_shots), count(home_goals), count(matchday)]) AS n,
  count(*) AS total FROM a GROUP BY part)
SELECT t."column", t.n AS n_train, g.n AS n_target, t.n >= 50 AND (g.total = 0 OR g.n / g.total >= 0.5) AS admitted
FROM l t JOIN l g ON g."column" = t."column" AND g.part = 'target' WHERE t.part = 'train'""")
def column_admission(spark, d):
    rows = A.matches(spark, d).join(A.match_stats(spark, d), "match_id", "left")
    train = rows.filter("match_date < date'2001-03-01' and result is not null")
    return O.column_admission(train, rows.filter("match_date >= date'2001-06-01'"), _ADMIT_COLUMNS)


@query("""WITH l AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS round, o_totalprice AS loss FROM orders),
b AS (SELECT *, arg_min(round, (loss, round)) OVER (PARTITION BY o_custkey ORDER BY round ROWS UNBOUNDED PRECEDING) AS best FROM l)
SELECT o_custkey, coalesce(min_by(best, round) FILTER (round - best >= 4), max_by(best, round)) AS best_round FROM b GROUP BY o_custkey""")
def early_stopping_round(spark, d):
    """A customer's orders as a model's rounds, their prices as losses; patience of four."""
    order = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    losses = A.table(spark, d, "orders").select(
        "o_custkey", F.row_number().over(order).cast("long").alias("round"), F.col("o_totalprice").alias("loss"))
    return O.stopping_round(losses, ["o_custkey"], 4)


@query("WITH " + B.PREDICTIONS + """,
mx AS (SELECT run_id, match_id, 0.6::DOUBLE * p_home + 0.4::DOUBLE * p_away AS h, 0.6::DOUBLE * p_draw + 0.4::DOUBLE * p_home AS d,
 0.6::DOUBLE * p_away + 0.4::DOUBLE * p_draw AS a FROM predictions),
nm AS (SELECT run_id, match_id, h / (h + d + a) AS h, d / (h + d + a) AS d, a / (h + d + a) AS a FROM mx)
SELECT run_id, match_id, round(h, 6) AS p_home, round(d, 6) AS p_draw, round(a, 6) AS p_away, round(greatest(h, d, a), 6) AS confidence,
 CASE WHEN h >= d AND h >= a THEN 'H' WHEN d >= a THEN 'D' ELSE 'A' END AS predicted_outcome FROM nm""")
def blended_outcomes(spark, d):
    """The mix of two forecasts: the given probabilities as the boosted half, the same ones turned round as the other."""
    p = ["p_home", "p_draw", "p_away"]
    rows = A.predictions(spark, d).select("run_id", "match_id", *[F.col(c).alias(f"b{i}") for i, c in enumerate(p)])
    mixed = O.blend(rows, [F.col(f"b{i}") for i in range(3)], [F.col(f"b{i}") for i in (2, 0, 1)], OUTCOME.blend_weight)
    return r6(mixed.select("run_id", "match_id", *p, "confidence", "predicted_outcome"), *p, "confidence")


@query()
def outcome_forecasts(spark, d):
    rows = _features(spark, d)
    train = rows.filter("match_date < date'2001-03-01' and result is not null")
    target = rows.filter("match_date >= date'2001-03-01'")
    columns = O.usable_columns(train, target, FT.FEATURE_COLUMNS)
    model = O.OutcomeModel().fit(train, columns, rounds=OUTCOME.min_rounds)
    return model.predict(target).select("match_id", "p_home", "p_draw", "p_away", "predicted_outcome", "confidence")


@query()
def feature_importance(spark, d):
    rows = _features(spark, d).filter("result is not null")
    model = O.OutcomeModel().fit(rows, O.usable_columns(rows, rows.limit(0), FT.FEATURE_COLUMNS))
    return spark.createDataFrame(model.importance(15), "feature string, importance double")


@query("WITH " + B.MATCHES + """,
cut AS (SELECT DISTINCT pool, min(match_date) AS cutoff FROM matches WHERE competition = 'premier_league' GROUP BY pool, season, matchday),
w AS (SELECT m.*, c.cutoff, exp(-0.0011::DOUBLE * (c.cutoff - m.match_date)) AS w FROM matches m JOIN cut c USING (pool)
 WHERE m.competition = 'premier_league' AND m.home_goals IS NOT NULL AND m.match_date < c.cutoff AND c.cutoff - m.match_date <= 1500)
SELECT pool, cutoff, competition, home_team, away_team, round(sum(w), 6) AS w, round(sum(w * home_goals), 6) AS wh, round(sum(w * away_goals), 6) AS wa,
 round(coalesce(sum(w) FILTER (home_goals = 0 AND away_goals = 0), 0), 6) AS w00, round(coalesce(sum(w) FILTER (home_goals = 1 AND away_goals = 0), 0), 6) AS w10, round(coalesce(sum(w) FILTER (home_goals = 0 AND away_goals = 1), 0), 6) AS w01, round(coalesce(sum(w) FILTER (home_goals = 1 AND away_goals = 1), 0), 6) AS w11, count(*) AS n FROM w GROUP BY ALL""")
def goal_sums_by_cutoff(spark, d):
    m = A.matches(spark, d)
    rows = R.pair_sums(m, SC.cutoffs(m))
    return r6(rows, "w", "wh", "wa", "w00", "w10", "w01", "w11")


@query()
def goal_rate_fit(spark, d):
    m = A.matches(spark, d)
    cuts = m.groupBy("pool").agg((F.max("match_date")).alias("cutoff"))
    return R.fit_rates(m, cuts)


@query()
def walk_forward_goals(spark, d):
    rows = FC.walk_forward_goals(A.matches(spark, d))
    p = {"H": "poisson_p_home", "D": "poisson_p_draw", "A": "poisson_p_away"}
    scored = rows.select(
        "season", *[F.col(c).alias(E.PROBABILITIES[k]) for k, c in p.items()], F.col("result").alias("actual"),
        "home_goals", "away_goals", "pred_home_goals", "pred_away_goals", "exp_home_goals", "exp_away_goals"
    ).withColumn("predicted", O.pick())
    return E.summarise(scored)


@query()
def walk_forward_outcomes(spark, d):
    """Every league block forecast by a softmax on what lay before it, scored by season and over all."""
    told = SM.replay(_features(spark, d), SC.cutoffs(A.matches(spark, d)))
    scored = told.select(
        "season", *E.PROBABILITIES.values(), F.col("result").alias("actual"), F.col("predicted_outcome").alias("predicted"),
        "elo_expected_home")
    return E.summarise(scored)


def _simple_params(spark, d):
    """Strengths from plain averages, so the grid has a SQL twin."""
    rows = _sides(spark, d).filter("played")
    club = rows.groupBy("pool", F.col("team").alias("name")).agg(
        ((F.avg("goals_for") - 1.5) / 4).alias("attack"), ((1.5 - F.avg("goals_against")) / 4).alias("defence"))
    cutoff = F.lit("2001-06-01").cast("date").alias("cutoff")
    strengths = club.select("pool", cutoff, "name", F.expr("stack(2, 'attack', attack, 'defence', defence) as (kind, value)"))
    general = rows.select("pool").distinct().select(
        "pool", cutoff, F.lit("").alias("name"), F.expr("stack(3, 'base', 0.3D, 'home', 0.25D, 'rho', -0.05D) as (kind, value)"))
    return strengths.unionByName(general)


_RATES = "WITH " + B.SIDES + """,
cs AS (SELECT pool, team, (avg(gf) - 1.5) / 4 AS att, (1.5 - avg(ga)) / 4 AS def FROM sides WHERE played GROUP BY ALL),
pr AS (SELECT m.match_id, m.order_no, m.result,
 greatest(least(exp(0.3 + coalesce(h.att, 0) - coalesce(a.def, 0) + 0.25), 8), 0.05) AS hr,
 greatest(least(exp(0.3 + coalesce(a.att, 0) - coalesce(h.def, 0)), 8), 0.05) AS ar
 FROM matches m LEFT JOIN cs h ON h.pool = m.pool AND h.team = m.home_team LEFT JOIN cs a ON a.pool = m.pool AND a.team = m.away_team WHERE competition = 'premier_league'),
g AS (SELECT unnest(range(9)) AS n),
c0 AS (SELECT match_id, order_no, hr, ar, h.n AS h, a.n AS a, exp(-hr) * pow(hr, h.n) / factorial(CAST(h.n AS INTEGER)) * exp(-ar) * pow(ar, a.n) / factorial(CAST(a.n AS INTEGER))
  * greatest(CASE WHEN h.n = 0 AND a.n = 0 THEN 1 + 0.05 * hr * ar WHEN h.n = 1 AND a.n = 0 THEN 1 - 0.05 * ar WHEN h.n = 0 AND a.n = 1 THEN 1 - 0.05 * hr
    WHEN h.n = 1 AND a.n = 1 THEN 1.05 ELSE 1 END, 1e-9) AS raw FROM pr, g h, g a),
cells AS (SELECT *, raw / sum(raw) OVER (PARTITION BY match_id) AS p FROM c0)
"""


def _rate_rows(spark, d):
    fixtures = A.matches(spark, d).filter("competition = 'premier_league'").select(
        "pool", F.lit("2001-06-01").cast("date").alias("cutoff"), "match_id", "home_team", "away_team",
        F.element_at(F.array(F.lit("H"), F.lit("D"), F.lit("A")), (F.col("order_no") % 3 + 1).cast("int")).alias("pick"))
    return R.expected_rates(fixtures, _simple_params(spark, d))


@query(_RATES + "SELECT match_id, round(hr, 6) AS home_rate, round(ar, 6) AS away_rate FROM pr")
def expected_goals(spark, d):
    return r6(_rate_rows(spark, d).select("match_id", "home_rate", "away_rate"), "home_rate", "away_rate")


@query(_RATES + "SELECT h, a, count(*) AS n, round(avg(p), 6) AS mean_p, round(max(p), 6) AS max_p FROM cells GROUP BY ALL")
def score_grid(spark, d):
    cells = R.score_grid(_rate_rows(spark, d)).select(
        F.col("h").cast("bigint").alias("h"), F.col("a").cast("bigint").alias("a"), "p")
    return cells.groupBy("h", "a").agg(
        F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("mean_p"), F.round(F.max("p"), 6).alias("max_p"))


@query(_RATES + """, best AS (SELECT match_id, h, a, p FROM cells WHERE CASE order_no % 3 WHEN 0 THEN h > a WHEN 1 THEN h = a ELSE h < a END
  QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY round(p, 12) DESC, h, a) = 1),
t AS (SELECT match_id, sum(h * p) AS eh, sum(a * p) AS ea, sum(p) FILTER (h > a) AS ph, sum(p) FILTER (h = a) AS pd, sum(p) FILTER (h < a) AS pa FROM cells GROUP BY ALL)
SELECT match_id, round(eh, 3) AS exp_home_goals, round(ea, 3) AS exp_away_goals, CAST(best.h AS INTEGER) AS pred_home_goals, CAST(best.a AS INTEGER) AS pred_away_goals,
 round(best.p, 6) AS scoreline_prob, round(ph, 6) AS poisson_p_home, round(pd, 6) AS poisson_p_draw, round(pa, 6) AS poisson_p_away FROM t JOIN best USING (match_id)""")
def score_reductions(spark, d):
    rows = R.reduce_scores(_rate_rows(spark, d), "pick")
    return r6(rows.drop("pool", "cutoff", "home_team", "away_team", "pick", "home_rate", "away_rate", "rho"),
              "scoreline_prob", "poisson_p_home", "poisson_p_draw", "poisson_p_away")


# --- evaluation ---------------------------------------------------------------------------------------

_SCORED = "WITH " + B.PREDICTIONS + """,
sc AS (SELECT r.*, m.result AS actual, m.home_goals, m.away_goals, r.p_home + 0.5::DOUBLE * r.p_draw AS e FROM record r JOIN matches m USING (match_id) WHERE m.result IS NOT NULL)
"""


def _scored(spark, d):
    rows = SV.with_record(A.matches(spark, d), A.predictions(spark, d)).filter("result is not null")
    return rows.select(
        "season", "p_home", "p_draw", "p_away", F.col("result").alias("actual"),
        F.col("predicted_outcome").alias("predicted"), "home_goals", "away_goals", "pred_home_goals",
        "pred_away_goals", "exp_home_goals", "exp_away_goals",
        (F.col("p_home") + 0.5 * F.col("p_draw")).alias("elo_expected_home"))


@query(_SCORED + """, b AS (SELECT *, greatest(least(0.30::DOUBLE - 0.22::DOUBLE * abs(e - 0.5) * 2, 0.32), 0.08) AS dr FROM sc)
SELECT season, count(*) AS n_matches, round(avg(CAST(predicted_outcome = actual AS INTEGER)), 6) AS accuracy,
 round(avg(-ln(CASE actual WHEN 'H' THEN p_home WHEN 'D' THEN p_draw ELSE p_away END)), 6) AS log_loss,
 round(avg(pow(p_home - CAST(actual = 'H' AS INTEGER), 2) + pow(p_draw - CAST(actual = 'D' AS INTEGER), 2) + pow(p_away - CAST(actual = 'A' AS INTEGER), 2)), 6) AS brier,
 round(avg(CAST(actual = 'H' AS INTEGER)), 6) AS baseline_home_accuracy,
 round(avg(-ln(CASE actual WHEN 'H' THEN (1 - dr) * e WHEN 'D' THEN dr ELSE (1 - dr) * (1 - e) END)), 6) AS baseline_elo_log_loss,
 round(avg(CAST(pred_home_goals = home_goals AND pred_away_goals = away_goals AS INTEGER)), 6) AS exact_scoreline_rate,
 round(avg(abs(exp_home_goals - home_goals) + abs(exp_away_goals - away_goals)) / 2, 6) AS mean_absolute_goal_error
FROM b GROUP BY GROUPING SETS ((season), ())""")
def forecast_scores(spark, d):
    rows = E.summarise(_scored(spark, d))
    return r6(rows, *[c for c in rows.columns if c not in ("season", "n_matches")])


@query(_SCORED + """, p AS (SELECT p_home AS p, CAST(actual = 'H' AS INTEGER) AS hit FROM sc UNION ALL SELECT p_draw, CAST(actual = 'D' AS INTEGER) FROM sc
 UNION ALL SELECT p_away, CAST(actual = 'A' AS INTEGER) FROM sc),
b AS (SELECT p, hit, least(len(list_filter(range(1, 10), lambda i: p >= i * 0.1::DOUBLE)), 9) AS bin FROM p)
SELECT round(bin / 10, 2) AS bin_low, round((bin + 1) / 10, 2) AS bin_high, round(avg(p), 4) AS predicted, round(avg(hit), 4) AS observed, count(*) AS n FROM b GROUP BY bin""")
def calibration_table(spark, d):
    return E.calibration(_scored(spark, d))


@query(_SCORED + """SELECT c.actual, count(*) FILTER (predicted_outcome = 'H') AS "pred_H", count(*) FILTER (predicted_outcome = 'D') AS "pred_D", count(*) FILTER (predicted_outcome = 'A') AS "pred_A"
 FROM (VALUES ('H'), ('D'), ('A')) c(actual) LEFT JOIN sc USING (actual) GROUP BY ALL""")
def confusion_matrix(spark, d):
    return E.confusion(_scored(spark, d))


# --- ledger and serving -------------------------------------------------------------------------------

@query("WITH " + B.PREDICTIONS + "SELECT match_id, run_id, season, matchday, predicted_outcome, created_at FROM record")
def forecast_of_record(spark, d):
    return L.record_of_forecast(A.predictions(spark, d)).select(
        "match_id", "run_id", "season", "matchday", "predicted_outcome", "created_at")


_KICK = "CAST(CAST(m.match_date AS VARCHAR) || ' ' || coalesce(m.kickoff, '00:00') || ':00' AS TIMESTAMP)"
_STAMP = "CAST(replace(substr(p.created_at, 1, 19), 'T', ' ') AS TIMESTAMP)"


@query("WITH " + B.PREDICTIONS + f"""SELECT p.match_id, p.run_id, p.created_at FROM predictions p JOIN matches m USING (match_id) WHERE {_STAMP} <= {_KICK}
 QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY created_at DESC, run_id DESC) = 1""")
def forecast_before_kickoff(spark, d):
    rows = L.record_before_kickoff(A.predictions(spark, d), A.matches(spark, d))
    return rows.select("match_id", "run_id", "created_at")


_PAGE = "WITH " + B.PREDICTIONS + f""",
kick AS (SELECT pool, season, matchday, min({_KICK}) AS first_kickoff FROM matches m WHERE competition = 'premier_league' GROUP BY ALL),
page AS (SELECT m.pool, m.season, m.matchday, m.original_matchday, m.match_id, m.match_date, m.home_goals, m.away_goals, m.result, m.status,
 m.home_goals IS NOT NULL AS played, p.predicted_outcome, p.pred_home_goals, p.pred_away_goals, greatest(p_home, p_draw, p_away) AS confidence,
 CASE WHEN m.home_goals IS NOT NULL AND p.predicted_outcome IS NOT NULL THEN p.predicted_outcome = m.result END AS outcome_correct,
 {_STAMP} <= k.first_kickoff AS published_before_kickoff, k.first_kickoff, p.created_at, m.kickoff,
 CASE WHEN m.original_matchday <> m.matchday THEN m.original_matchday END AS rearranged_from
 FROM matches m JOIN kick k USING (pool, season, matchday) LEFT JOIN record p USING (match_id) WHERE m.competition = 'premier_league')
"""


@query(_PAGE + """SELECT pool, season, matchday, match_id, played, CASE result WHEN 'H' THEN 'Home win' WHEN 'D' THEN 'Draw' WHEN 'A' THEN 'Away win' END AS result_label,
 CASE predicted_outcome WHEN 'H' THEN 'Home win' WHEN 'D' THEN 'Draw' WHEN 'A' THEN 'Away win' END AS predicted_label, round(confidence, 6) AS confidence,
 outcome_correct, published_before_kickoff, rearranged_from FROM page""")
def block_page(spark, d):
    view = SV.match_view(A.matches(spark, d), A.predictions(spark, d))
    return r6(view.select(*SV.BLOCK, "match_id", "played", "result_label", "predicted_label", "confidence",
                          "outcome_correct", "published_before_kickoff", "rearranged_from"), "confidence")


@query(_PAGE + """SELECT pool, season, matchday, count(*) AS n_matches, bool_and(played) AS is_complete, bool_or(played) AS any_played, count(outcome_correct) AS n_scored,
 count(*) FILTER (outcome_correct) AS n_correct, count(*) FILTER (outcome_correct IS NOT NULL AND pred_home_goals = home_goals AND pred_away_goals = away_goals) AS n_exact_scores,
 round(avg(CAST(outcome_correct AS INTEGER)), 6) AS accuracy, string_agg(DISTINCT CAST(match_date AS VARCHAR), ',' ORDER BY CAST(match_date AS VARCHAR)) AS dates,
 coalesce(bool_or(NOT published_before_kickoff), FALSE) AS published_late, strftime(min(first_kickoff), '%Y-%m-%d %H:%M') AS first_kickoff FROM page GROUP BY ALL""")
def block_summary(spark, d):
    rows = SV.block_summary(SV.match_view(A.matches(spark, d), A.predictions(spark, d)))
    return r6(rows, "accuracy").withColumn("first_kickoff", F.date_format("first_kickoff", "yyyy-MM-dd HH:mm"))


@query(_PAGE + """SELECT pool, season, matchday, count(*) AS n, count(*) FILTER (status = 'played') AS played, count(*) FILTER (status = 'played') = count(*) AS is_complete,
 min(match_date) AS first_date, max(match_date) AS last_date, count(predicted_outcome) > 0 AS has_predictions, count(*) FILTER (result IS NOT NULL AND predicted_outcome IS NOT NULL) AS n_scored,
 count(*) FILTER (result = predicted_outcome) AS n_correct, round(count(*) FILTER (result = predicted_outcome) / nullif(count(*) FILTER (result IS NOT NULL AND predicted_outcome IS NOT NULL), 0), 6) AS accuracy,
 coalesce(replace(substr(min(created_at), 1, 16), 'T', ' ') > substr(min(CAST(match_date AS VARCHAR) || ' ' || coalesce(kickoff, '00:00')), 1, 16), FALSE) AS published_late
FROM page GROUP BY ALL""")
def season_rollup(spark, d):
    return r6(SV.season_rollup(A.matches(spark, d), A.predictions(spark, d)), "accuracy")


@query(_PAGE + """SELECT pool, season, count(*) AS scored, count(*) FILTER (predicted_outcome = result) AS correct, count(*) FILTER (pred_home_goals = home_goals AND pred_away_goals = away_goals) AS exact,
 round(count(*) FILTER (predicted_outcome = result) / count(*), 6) AS accuracy, round(count(*) FILTER (pred_home_goals = home_goals AND pred_away_goals = away_goals) / count(*), 6) AS exact_rate
FROM page WHERE result IS NOT NULL AND predicted_outcome IS NOT NULL GROUP BY ALL""")
def season_hit_rate(spark, d):
    return r6(SV.season_record(A.matches(spark, d), A.predictions(spark, d)), "accuracy", "exact_rate")


@query("WITH " + B.PREDICTIONS + """, runs AS (SELECT run_id, season, matchday, max(created_at) AS created_at, count(*) AS n FROM predictions GROUP BY ALL)
SELECT season AS target_season, run_id, created_at, matchday AS target_matchday, CAST(n AS VARCHAR) AS n_predictions FROM runs
QUALIFY row_number() OVER (PARTITION BY season ORDER BY created_at DESC, matchday DESC, run_id DESC) = 1""")
def latest_model_run(spark, d):
    # The run id breaks ties so that both sides name the same run.
    runs = A.model_runs(spark, d).withColumn("created_at", F.concat_ws("|", "created_at", F.lpad(F.col("target_matchday").cast("string"), 3, "0"), "run_id"))
    return L.latest_run(runs).select(
        "target_season", "run_id", F.substring_index("created_at", "|", 1).alias("created_at"), "target_matchday",
        F.col("metrics")["n_predictions"].alias("n_predictions"))


@query("WITH " + B.MATCHES + """SELECT CAST(max(match_date) AS VARCHAR) AS ingested_at, count(*) AS n_matches,
 max(match_date) FILTER (competition = 'premier_league' AND status = 'played') AS latest_result_date FROM matches""")
def data_freshness(spark, d):
    return SV.freshness(A.matches(spark, d).withColumn("updated_at", F.col("match_date").cast("string")))


@query("WITH " + B.MATCHES + "SELECT DISTINCT season FROM matches WHERE competition = 'premier_league' ORDER BY season DESC")
def season_list(spark, d):
    return SV.available_seasons(A.matches(spark, d))


@query(_NEXT.replace(B.MATCHES, B.PREDICTIONS) + """,
early AS (SELECT * FROM predictions WHERE created_at < '2001-01-01'),
told AS (SELECT DISTINCT pool, season, matchday FROM matches WHERE competition = 'premier_league' AND match_id IN (SELECT match_id FROM early)),
need AS (SELECT DISTINCT pool, season, matchday, 'played without a forecast' AS problem FROM matches WHERE competition = 'premier_league' AND status = 'played'
 UNION ALL SELECT pool, season, next_matchday, 'next to play and not forecast' FROM nx WHERE competition = 'premier_league' AND next_matchday IS NOT NULL)
SELECT * FROM need ANTI JOIN told USING (pool, season, matchday)""")
def publication_problems(spark, d):
    early = A.predictions(spark, d).filter("created_at < '2001-01-01'")
    return SV.publication_problems(A.matches(spark, d), early)


@query("WITH " + B.PREDICTIONS + """SELECT 'matches' AS mart, season, count(*) AS n FROM matches WHERE competition = 'premier_league' GROUP BY ALL
 UNION ALL SELECT 'predictions', season, count(*) FROM predictions GROUP BY ALL UNION ALL SELECT 'current_predictions', season, count(*) FROM record GROUP BY ALL
 UNION ALL SELECT 'model_runs', season, count(DISTINCT run_id) FROM predictions GROUP BY ALL""")
def serving_mart(spark, d):
    m = A.matches(spark, d).withColumn("updated_at", F.col("match_date").cast("string"))
    tables = SV.mart_tables(m, A.model_runs(spark, d).withColumnRenamed("target_season", "target_season"), A.predictions(spark, d))
    out = None
    for name, frame in tables.items():
        season = "target_season" if name == "model_runs" else "season"
        part = frame.groupBy(F.lit(name).alias("mart"), F.col(season).alias("season")).agg(F.count("*").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


@query("WITH " + B.MATCHES + """, old AS (SELECT match_id, season, home_goals FROM matches WHERE season < '2000-01'),
new AS (SELECT match_id, season, home_goals + 1 AS home_goals FROM matches WHERE season >= '1999-00')
SELECT coalesce(n.match_id, o.match_id) AS match_id, coalesce(n.season, o.season) AS season, CASE WHEN n.match_id IS NOT NULL THEN n.home_goals ELSE o.home_goals END AS home_goals
FROM old o FULL JOIN new n USING (match_id)""")
def upserted_matches(spark, d):
    m = A.matches(spark, d).select("match_id", "season", "home_goals")
    new = m.filter("season >= '1999-00'").withColumn("home_goals", F.col("home_goals") + 1)
    return L.upsert(m.filter("season < '2000-01'"), new, ["match_id"])


@query("WITH " + B.PREDICTIONS + """, old AS (SELECT match_id, run_id FROM predictions WHERE run_id LIKE 'run1%' AND season < '1999-00'),
new AS (SELECT match_id, run_id FROM predictions WHERE run_id LIKE 'run2%')
SELECT * FROM old UNION ALL SELECT n.* FROM new n WHERE match_id NOT IN (SELECT match_id FROM old) AND match_id IN (SELECT match_id FROM matches WHERE status = 'played')""")
def restored_forecasts(spark, d):
    p = A.predictions(spark, d).select("match_id", "run_id", "season")
    old = p.filter("run_id like 'run1%' and season < '1999-00'").select("match_id", "run_id")
    new = p.filter("run_id like 'run2%'").select("match_id", "run_id")
    return L.insert_absent(old, new, ["match_id"], A.matches(spark, d).filter("status = 'played'"))


@query("WITH " + B.MATCHES + "," + B.SPELLS + """SELECT 'matches' AS item, count(*) AS n FROM matches UNION ALL SELECT 'played', count(*) FROM matches WHERE status = 'played'
 UNION ALL SELECT 'scheduled', count(*) FROM matches WHERE status <> 'played' UNION ALL SELECT 'spells', count(*) FROM spells""")
def load_report(spark, d):
    return TB.load_report(A.matches(spark, d), spells=A.spells(spark, d))


@query("WITH " + B.MATCHES + "SELECT season, home_team AS team FROM matches WHERE competition <> 'fa_cup' UNION SELECT season, away_team FROM matches WHERE competition <> 'fa_cup'")
def club_seasons(spark, d):
    m = A.matches(spark, d).filter("competition <> 'fa_cup'")
    return m.select("season", F.col("home_team").alias("team")).union(m.select("season", "away_team")).distinct()


# --- spells -------------------------------------------------------------------------------------------

_EXACT = "WITH RECURSIVE " + B.SPELLS + """,
kept AS (SELECT team, manager, start_date, end_date FROM spells WHERE NOT year_only UNION ALL
 SELECT team, manager, start_date, end_date FROM spells v WHERE year_only AND NOT EXISTS (SELECT 1 FROM spells e WHERE NOT e.year_only AND e.team = v.team AND e.manager = v.manager
  AND (year(e.start_date) = year(v.start_date) OR (e.start_date <= coalesce(v.end_date, DATE '9999-12-31') AND v.start_date <= coalesce(e.end_date, DATE '9999-12-31')))))
"""
_MERGED = _EXACT + """,
dd AS (SELECT team, manager, start_date, max(end_date) AS end_date, row_number() OVER (PARTITION BY team, manager ORDER BY start_date) AS rn FROM kept GROUP BY team, manager, start_date),
an(team, manager, rn, anchor) AS (SELECT team, manager, rn, start_date FROM dd WHERE rn = 1 UNION ALL
 SELECT d.team, d.manager, d.rn, CASE WHEN d.start_date - a.anchor <= 45 THEN a.anchor ELSE d.start_date END FROM an a JOIN dd d ON d.team = a.team AND d.manager = a.manager AND d.rn = a.rn + 1),
mg AS (SELECT team, manager, anchor AS start_date, max(end_date) AS end_date FROM an JOIN dd USING (team, manager, rn) GROUP BY ALL)
"""


@query(_EXACT + "SELECT * FROM kept")
def precise_spells(spark, d):
    return I.drop_imprecise(A.spells(spark, d)).select("team", "manager", "start_date", "end_date")


@query("WITH " + B.SPELLS + "SELECT team, manager, start_date, end_date FROM spells WHERE NOT year_only")
def refreshed_spells(spark, d):
    """All spells, then an answer with a third of them, which is refused, then one with nine tenths, which replaces them."""
    path, spells = _fresh(spark, "spells"), A.spells(spark, d)
    columns = ["team", "manager", "start_date", "end_date"]
    RF.refresh(path, spells.select(*columns))
    RF.refresh(path, spells.filter("row_no % 3 = 0").select(*columns))
    RF.refresh(path, spells.filter("not year_only").select(*columns))
    return RF.current(spark, path)


@query(_MERGED + "SELECT * FROM mg")
def merged_spells(spark, d):
    return I.merge_near(I.drop_imprecise(A.spells(spark, d)))


@query(_MERGED + """SELECT team, manager, start_date, coalesce(end_date, (SELECT min(n.start_date) FROM mg n WHERE n.team = m.team AND n.manager <> m.manager
 AND (n.start_date > m.start_date OR (n.start_date = m.start_date AND n.manager > m.manager))) - 1) AS end_date FROM mg m""")
def tidy_spells(spark, d):
    return I.tidy(A.spells(spark, d))


@query("WITH " + B.SIDES + "," + B.SPELLS + """, t AS (SELECT team, match_date FROM sides WHERE competition = 'premier_league')
SELECT count(*) AS pairs, count(*) FILTER (c) AS covered, round(avg(CAST(c AS INTEGER)), 6) AS share FROM (SELECT EXISTS (SELECT 1 FROM spells s WHERE s.team = t.team
 AND s.start_date <= t.match_date AND (s.end_date IS NULL OR t.match_date <= s.end_date)) AS c FROM t)""")
def spell_coverage(spark, d):
    dates = _sides(spark, d).filter("competition = 'premier_league'").select("team", "match_date")
    return r6(I.coverage(A.spells(spark, d), dates), "share")


@query("WITH RECURSIVE " + B.SPELLS + """,
pri AS (SELECT team, manager, start_date, end_date FROM spells WHERE NOT year_only),
cand AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY row_no) AS rn FROM spells s WHERE year_only AND NOT EXISTS (SELECT 1 FROM pri p WHERE p.team = s.team AND p.start_date <= s.start_date AND s.start_date <= coalesce(p.end_date, DATE '9999-12-31'))),
acc(team, rn, taken, ok) AS (SELECT team, 0::BIGINT, CAST([] AS STRUCT(s DATE, e DATE)[]), FALSE FROM cand GROUP BY team UNION ALL
 SELECT c.team, c.rn, CASE WHEN covered THEN taken ELSE list_append(taken, {'s': c.start_date, 'e': coalesce(c.end_date, DATE '9999-12-31')}) END, NOT covered FROM (
  SELECT a.taken, c.*, len(list_filter(a.taken, lambda t: t.s <= c.start_date AND c.start_date <= t.e)) > 0 AS covered FROM acc a JOIN cand c ON c.team = a.team AND c.rn = a.rn + 1) c)
SELECT team, manager, start_date, end_date, 'primary' AS source FROM pri UNION ALL SELECT c.team, c.manager, c.start_date, c.end_date, 'manual' FROM cand c JOIN acc a ON a.team = c.team AND a.rn = c.rn AND a.ok""")
def gap_filled_spells(spark, d):
    s = A.spells(spark, d)
    primary = s.filter("not year_only").withColumn("source", F.lit("primary"))
    return I.fill_gaps(primary, s.filter("year_only").withColumn("source", F.lit("manual")))


@query("""WITH r AS (SELECT 'Club ' || lpad(CAST(o_custkey // 10 AS VARCHAR), greatest(9, length(CAST(o_custkey // 10 AS VARCHAR)))::INT, '0') AS team, o_orderpriority AS item, count(*) AS n, min(o_orderkey) AS row_no FROM orders GROUP BY ALL)
SELECT team, arg_max(item, n * 1000000000 - row_no) AS item, max(n) AS n FROM r GROUP BY team""")
def best_items(spark, d):
    rows = A.table(spark, d, "orders").groupBy(
        A.club_name(F.floor(F.col("o_custkey") / 10)).alias("team"), F.col("o_orderpriority").alias("item")
    ).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("row_no"))
    return I.best_item(rows)


@query("WITH " + B.SPELLS + "SELECT team, max(start_date) AS appointed FROM spells GROUP BY team")
def latest_appointments(spark, d):
    return TX.latest_appointment(A.spells(spark, d))


# --- text ---------------------------------------------------------------------------------------------

# Everyday words of three languages stand in for club names.
_WORDS = {"en": ["the", "and", "with"], "fr": ["dans", "elle", "que"], "de": ["und", "der", "nicht"]}
_HAS = lambda words: ("regexp_matches(text, '(?i)(^|[^\\p{L}\\p{M}\\p{N}_])(" + "|".join(words)
                      + ")($|[^\\p{L}\\p{M}\\p{N}_])')")
_TAGGED = "WITH tg AS (SELECT doc_id, text, source, " + ", ".join(f"{_HAS(w)} AS {k}" for k, w in _WORDS.items()) + " FROM documents)\n"


@query(_TAGGED + """SELECT doc_id, CASE WHEN de THEN 'de' ELSE '' END || CASE WHEN en THEN 'en' ELSE '' END || CASE WHEN fr THEN 'fr' ELSE '' END AS entities FROM tg""")
def entity_tags(spark, d):
    docs = A.table(spark, d, "documents")
    return docs.select("doc_id", F.array_join(TX.tag_entities(F.col("text"), _WORDS), "").alias("entities"))


_W = "[\\p{L}\\p{M}\\p{N}_]"


@query(f"""WITH p AS (SELECT doc_id, lang, regexp_extract_all(lower(regexp_replace(text, '^[^{_W[1:]}+|[^{_W[1:]}+$', '', 'g')), '({_W}+|[^{_W[1:]}+)') AS p FROM documents),
al AS (SELECT DISTINCT lang || '-' || (doc_id % 7) AS entity, k AS n, array_to_string(list_slice(p, 3, 2 + k), '') AS alias FROM p, (VALUES (1), (3), (5)) s(k) WHERE len(p) >= 2 + k),
gr AS (SELECT doc_id, k AS n, array_to_string(list_slice(p, i, i + k - 1), '') AS alias FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1, 2)) AS i FROM p), (VALUES (1), (3), (5)) s(k) WHERE i + k - 1 <= len(p))
SELECT doc_id, string_agg(entity, ' ' ORDER BY entity) AS entities FROM (SELECT DISTINCT doc_id, entity FROM gr JOIN al USING (n, alias)) GROUP BY doc_id""")
def alias_tags(spark, d):
    """The second word of every text, the second two and the second three, as names of one of seven entities of its language."""
    docs = A.table(spark, d, "documents")
    # No name needs more of a text than its first four words and what stands between them.
    head = F.regexp_extract("text", r"(?U)(\w+(?:\W+\w+){0,3})", 1)
    words = F.regexp_extract_all(head, F.lit(r"(?U)(\w+|\W+)"), F.lit(1))
    heads = docs.select(F.concat_ws("-", "lang", (F.col("doc_id") % 7).cast("string")).alias("entity"), words.alias("w"))
    names = heads.select("entity", "w", F.explode(F.array(*[F.lit(k) for k in (1, 3, 5)])).alias("k")).filter(
        "size(w) >= 2 + k").select("entity", F.array_join(F.slice("w", F.lit(3), F.col("k")), "").alias("alias"))
    tagged = TX.tag_by_names(docs, names)
    return tagged.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("entity")), " ").alias("entities"))


@query(_TAGGED + f"""SELECT doc_id, CASE WHEN de THEN 'de' WHEN en THEN 'en' ELSE 'fr' END AS team FROM tg
WHERE CAST(de AS INTEGER) + CAST(en AS INTEGER) + CAST(fr AS INTEGER) = 1 AND {_HAS(["of", "ou", "zu", "main"])} AND source NOT IN ('src3', 'src5')""")
def attributed_headlines(spark, d):
    docs = A.table(spark, d, "documents").select(
        "doc_id", F.col("text").alias("title"), F.col("source").alias("summary"))
    # The exclusion looks at the summary; texts never hold these source labels.
    return TX.attributed_changes(docs, _WORDS, r"\b(of|ou|zu|main)\b", r"\b(src3|src5)\b").select("doc_id", "team")


@query("WITH " + B.SPELLS + """, ap AS (SELECT team, max(start_date) AS appointed FROM spells GROUP BY team),
ch AS (SELECT c_custkey, 'Club ' || lpad(CAST(c_custkey // 10 AS VARCHAR), greatest(9, length(CAST(c_custkey // 10 AS VARCHAR)))::INT, '0') AS team, DATE '2001-01-01' + CAST(c_custkey % 230 AS INTEGER) AS published FROM customer)
SELECT c_custkey, team, published FROM ch LEFT JOIN ap USING (team) WHERE DATE '2001-07-01' - published >= 3 AND (appointed IS NULL OR appointed < published - 7)""")
def unconfirmed_changes(spark, d):
    told = A.table(spark, d, "customer").select(
        "c_custkey", A.club_name(F.floor(F.col("c_custkey") / 10)).alias("team"),
        F.date_add(F.lit("2001-01-01").cast("date"), (F.col("c_custkey") % 230).cast("int")).alias("published"))
    rows = TX.unconfirmed(told, TX.latest_appointment(A.spells(spark, d)), "2001-07-01")
    return rows.select("c_custkey", "team", "published")


# --- change logs --------------------------------------------------------------------------------------

_CHANGES = """SELECT event_id, status FROM (SELECT event_id, event_type AS status, lag(event_type) OVER (PARTITION BY strftime(ts, '%Y-%m'), user_id ORDER BY ts, event_id) AS prev FROM events)
 WHERE prev IS NULL OR prev <> status"""


@query(_CHANGES)
def emit_on_change(spark, d):
    rows = C.emit_changes(A.status_changes(spark, d), ("season", "player_code"), ("status",), ("observed_at", "event_id"))
    return rows.select("event_id", "status")


@query("""SELECT CAST(user_id AS VARCHAR) AS player_code, arg_max(event_type, row(ts, event_id)) AS status, max(ts) AS observed_at FROM events WHERE ts <= TIMESTAMP '2024-01-15 12:00:00' GROUP BY user_id""")
def state_as_of_instant(spark, d):
    rows = C.latest_state(A.status_changes(spark, d), ("player_code",), F.lit("2024-01-15 12:00:00").cast("timestamp"),
                          ("observed_at", "event_id"))
    return rows.select("player_code", "status", "observed_at")


@query("""WITH a AS (SELECT user_id, ts, event_id AS ask_id FROM events WHERE event_type = 'error'), l AS (SELECT user_id, ts, event_type FROM events WHERE event_type <> 'error')
SELECT CAST(a.ask_id AS VARCHAR) AS ask_id, a.user_id, l.event_type FROM a ASOF LEFT JOIN l ON l.user_id = a.user_id AND l.ts <= a.ts""")
def state_as_of_many(spark, d):
    events = A.table(spark, d, "events")
    log = events.filter("event_type <> 'error'").select("user_id", "ts", "event_type")
    asks = events.filter("event_type = 'error'").select("user_id", "ts", F.col("event_id").cast("string").alias("ask_id"))
    return C.state_at(log, asks, "user_id", "event_type").drop("ts")


@query("""WITH s AS (SELECT user_id, arg_max(event_type, row(ts, event_id)) AS status FROM events GROUP BY user_id)
SELECT status, count(*) AS n, CASE WHEN status <> 'a' THEN count(*) ELSE 0 END AS not_available FROM s GROUP BY status""")
def status_counts(spark, d):
    return C.status_counts(C.latest_state(A.status_changes(spark, d), ("player_code",), None, ("observed_at", "event_id")))


def _fresh(spark, label: str) -> str:
    import uuid

    from tidemark.session import shared_folder
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


@query(_CHANGES)
def stream_emit_on_change(spark, d):
    schema = A.table(spark, d, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    seen = events.select(
        F.date_format("ts", "yyyy-MM").alias("season"), F.col("user_id").cast("string").alias("player_code"),
        F.col("ts").alias("observed_at"), "event_id", F.col("event_type").alias("status"))
    base = _fresh(spark, "changes")
    SCH.run_to_table(SCH.change_stream(seen, tracked=("status",), order=("observed_at", "event_id")), f"{base}/table", f"{base}/offsets")
    return spark.read.parquet(f"{base}/table").select("event_id", "status")


@query(_ELO + "SELECT match_id, round(he, 6) AS home_elo, round(ae, 6) AS away_elo FROM st WHERE match_id IS NOT NULL")
def stream_ratings(spark, d):
    """The matches as a stream of one season a micro-batch, a block's start as event time, then the rows that close it."""
    base, files = _fresh(spark, "ratings"), 4
    rows = stage(timeline(A.matches(spark, d)).select(
        "pool", "match_id", "season", "competition", "home_team", "away_team", "home_goals", "away_goals", "seq_key",
        F.col("block_date").cast("timestamp").alias("event_time")), "stream")
    for year in sorted(r[0] for r in rows.select(F.year("event_time")).distinct().collect()):
        rows.filter(F.year("event_time") == year).repartition(files).write.mode("append").parquet(f"{base}/in")
    SRT.closing_rows(rows).coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{base}/in")
    SCH.run_to_table(SRT.rating_stream(stream), f"{base}/table", f"{base}/offsets")
    return r6(spark.read.parquet(f"{base}/table").select("match_id", "home_elo", "away_elo"), "home_elo", "away_elo")


_NEWS_DAYS = ("1997-01-01", "1999-06-01", "2001-06-01")


@query("WITH " + B.MATCHES + """, d(batch_id, until) AS (VALUES """ + ", ".join(f"({i}, DATE '{x}')" for i, x in enumerate(_NEWS_DAYS)) + """),
c AS (SELECT batch_id, pool, season, count(*) FILTER (match_date < until AND status = 'played') AS n_played FROM matches, d WHERE competition = 'premier_league' GROUP BY ALL)
SELECT CAST(batch_id AS BIGINT) AS batch_id, pool, season, n_played FROM (SELECT *, lag(n_played) OVER (PARTITION BY pool, season ORDER BY batch_id) AS was FROM c)
WHERE was IS NULL OR was <> n_played""")
def stream_gate_firings(spark, d):
    """League matches as a stream of what is known on three days; the leagues each micro-batch lets through, the last one replayed."""
    base, files = _fresh(spark, "gate"), 4
    league = stage(A.matches(spark, d).filter("competition = 'premier_league'").select(
        "pool", "match_id", "season", "competition", "matchday", "match_date", "status"), "league")
    for i, day in enumerate(_NEWS_DAYS):
        known = F.when(F.col("match_date") < day, F.col("status")).otherwise("scheduled")
        news = league.withColumn("status", known)
        if i:
            news = news.filter((F.col("match_date") >= _NEWS_DAYS[i - 1]) & (F.col("match_date") < day))
        news.repartition(files).write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema(league.schema).option("maxFilesPerTrigger", files).parquet(f"{base}/in")
    gate = SCH.recorded_gate(lambda s: SC.fingerprint(s.read.schema(league.schema).parquet(f"{base}/table")), f"{base}/fired")
    SCH.upsert_sink(stream, f"{base}/table", ["match_id"], f"{base}/offsets", after=gate)
    gate(league, len(_NEWS_DAYS) - 1)
    return SCH.firings(spark, f"{base}/fired").select("batch_id", "pool", "season", "n_played")


@query("WITH " + B.PREDICTIONS + f""", kick AS (SELECT season, matchday, min({_KICK}) AS fk FROM matches m WHERE competition = 'premier_league' GROUP BY ALL)
SELECT p.match_id, p.run_id FROM predictions p JOIN kick USING (season, matchday) WHERE {_STAMP} > fk""")
def late_forecasts(spark, d):
    league = A.matches(spark, d).filter("competition = 'premier_league'")
    starts = SV.block_starts(league).groupBy("season", "matchday").agg(F.min("first_kickoff").alias("first_kickoff"))
    return SCH.late_forecasts(A.predictions(spark, d), starts).select("match_id", "run_id")


# --- semi-structured sources ----------------------------------------------------------------------------

@query("""WITH k AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
SELECT strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS observed_at, CASE WHEN k % 2 = 0 THEN CAST(k AS VARCHAR) ELSE '' END AS fpl_next_event, CAST(user_id AS VARCHAR) AS player_code, CAST(event_id AS VARCHAR) AS player_id,
 CASE event_type WHEN 'view' THEN 'GKP' WHEN 'click' THEN 'DEF' WHEN 'purchase' THEN 'MID' ELSE 'FWD' END AS position, 'Team ' || (user_id % 20) AS fpl_team, substr(event_type, 1, 1) AS status,
 CASE WHEN k % 4 = 0 THEN '' ELSE CAST(k AS VARCHAR) END AS chance_next, 'knock, "minor" ' || k AS news FROM k WHERE event_type <> 'error'""")
def availability_from_json(spark, d):
    return FD.availability_rows(A.availability_payloads(spark, d)).select(
        "observed_at", "fpl_next_event", "player_code", "player_id", "position", "fpl_team", "status", "chance_next", "news")


@query("WITH " + B.SPELLS + "SELECT team, manager, start_date, end_date, year_only FROM spells")
def spells_from_bindings(spark, d):
    clubs = A.table(spark, d, "customer").select(A.club_name(F.floor(F.col("c_custkey") / 10)).alias("team")).distinct()
    ids = clubs.withColumn("wikidata_id", F.concat(F.lit("Q"), F.regexp_extract("team", "([0-9]+)$", 1)))
    return FD.spell_rows(A.spell_answers(spark, d), ids)


@query("""SELECT regexp_replace(url, '[<>&]', ' ', 'g') AS title, DATE '2026-01-01' + CAST(page_id % 200 AS INTEGER) AS published FROM pages WHERE page_id % 6 <> 0""")
def headlines_from_xml(spark, d):
    return FD.headlines(A.feeds(spark, d)).select("title", "published")


@query("WITH " + B.MATCHES + """,
ln AS (SELECT pool AS file, order_no, match_id, status, match_date, home_team, away_team, home_goals, away_goals,
  CASE WHEN order_no % 35 = 5 THEN 'S' WHEN order_no % 5 = 0 THEN 'R' END AS head, order_no % 3 = 0 AS dated, order_no % 12 = 0 AS yr,
  CASE order_no % 4 WHEN 1 THEN '15:00' WHEN 2 THEN '09:30' END AS kt FROM matches),
a AS (SELECT *, last_value(CASE WHEN head IS NOT NULL THEN order_no END IGNORE NULLS) OVER w AS h_no, last_value(CASE WHEN dated THEN order_no END IGNORE NULLS) OVER w AS d_no,
  last_value(CASE WHEN head IS NOT NULL OR dated THEN order_no END IGNORE NULLS) OVER w AS c_no, last_value(CASE WHEN kt IS NOT NULL THEN order_no END IGNORE NULLS) OVER w AS k_no
  FROM ln WINDOW w AS (PARTITION BY file ORDER BY order_no)),
dl AS (SELECT file, order_no, yr, month(match_date) AS mo, day(match_date) AS dy, year(match_date) AS y, lag(month(match_date)) OVER (PARTITION BY file ORDER BY order_no) AS pm FROM ln WHERE dated),
dt AS (SELECT *, CAST(sum(CASE WHEN NOT yr AND mo < pm THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY order_no) AS BIGINT) AS turns FROM dl),
dy AS (SELECT file, order_no, coalesce(last_value(CASE WHEN yr THEN y - turns END IGNORE NULLS) OVER (PARTITION BY file ORDER BY order_no), 1994) + turns AS yy, mo, dy FROM dt)
SELECT a.file, a.order_no AS order_no, CASE WHEN h.head = 'R' THEN CAST(h.order_no % 38 + 1 AS INTEGER) END AS matchday, CASE WHEN h.head = 'S' THEN 'Semi-finals' END AS stage,
 try_cast(y.yy || '-' || lpad(CAST(y.mo AS VARCHAR), 2, '0') || '-' || lpad(CAST(y.dy AS VARCHAR), 2, '0') AS DATE) AS match_date, CASE WHEN a.k_no IS NOT NULL AND (a.c_no IS NULL OR a.k_no >= a.c_no) THEN k.kt END AS kickoff,
 a.home_team || CASE WHEN a.order_no % 2 = 0 THEN ' FC' ELSE '' END AS home_team, a.away_team, a.home_goals, a.away_goals,
 CASE WHEN a.status = 'played' THEN CASE WHEN a.order_no % 7 = 3 THEN 0 WHEN a.order_no % 13 = 1 THEN 1 ELSE 0 END END AS ht_home_goals,
 CASE WHEN a.status = 'played' THEN CASE WHEN a.order_no % 7 = 3 THEN 0 WHEN a.order_no % 13 = 1 THEN 0 ELSE 1 END END AS ht_away_goals
FROM a LEFT JOIN ln h ON h.file = a.file AND h.order_no = a.h_no LEFT JOIN dy y ON y.file = a.file AND y.order_no = a.d_no LEFT JOIN ln k ON k.file = a.file AND k.order_no = a.k_no
WHERE NOT (a.order_no % 41 = 0 AND NOT (a.order_no % 7 = 3 AND a.status = 'played'))""")
def archive_grammar(spark, d):
    rows = AR.parse_lines(A.archive_lines(spark, d))
    return rows.select("file", F.floor(F.col("line_no") / 4).alias("order_no"), *[
        c for c in rows.columns if c not in ("file", "season", "competition", "line_no")])


# --- files --------------------------------------------------------------------------------------------

_FILES = "WITH " + B.MATCHES + """,
ln AS (SELECT pool AS folder, season, CASE competition WHEN 'premier_league' THEN '1-premierleague.txt' WHEN 'fa_cup' THEN 'facup.txt' ELSE 'eflcup.txt' END AS name,
  competition, order_no, unnest([1, 2, 3]) AS part, unnest([coalesce('▪ Matchday ' || original_matchday, '▪ Cup'), strftime(match_date, '%a %-d %b %Y'),
   coalesce('  ' || kickoff || '  ', '  ') || home_team || ' v ' || away_team || CASE WHEN match_date < DATE '1999-06-01' THEN '  ' || home_goals || '-' || away_goals ELSE '' END]) AS line FROM matches)
"""


@query(_FILES + """SELECT season, count(DISTINCT folder || '/' || name) AS files FROM ln WHERE season BETWEEN '1995-96' AND '1999-00' GROUP BY season""")
def archive_seasons(spark, d):
    """Seasons found in a written archive, no file opened."""
    root = _fresh(spark, "archive")
    FI.write_lines(A.archive_files(spark, d), root)
    return AR.seasons_between(AR.season_folders(spark, root), "1995-96", "1999-00")


@query(_FILES + """SELECT folder, season, competition, row_number() OVER (PARTITION BY folder, season, name ORDER BY order_no, part) - 1 AS line_no, line
FROM ln WHERE season BETWEEN '1995-96' AND '1999-00'""")
def archive_scan(spark, d):
    """Lines of some seasons of a written archive, with their place."""
    root = _fresh(spark, "archive")
    FI.write_lines(A.archive_files(spark, d), root)
    return AR.archive_lines(spark, root, "1995-96", "1999-00").drop("file")


@query("WITH " + B.MATCHES + "," + B.STATS + """,
k AS (SELECT match_id, season, home_team, away_team FROM matches WHERE competition = 'premier_league'),
s AS (SELECT m.season, m.home_team, m.away_team, CAST(m.pool AS BIGINT) % 3 AS kind, m.order_no, t.* EXCLUDE (match_id) FROM matches m JOIN match_stats t USING (match_id) WHERE m.competition = 'premier_league')
SELECT k.match_id, k.season, s.home_shots, s.away_shots, CASE WHEN kind <> 1 THEN s.home_shots_on_target END AS home_shots_on_target,
 CASE WHEN kind <> 1 THEN s.away_shots_on_target END AS away_shots_on_target, CASE WHEN kind = 2 THEN 'Judge, ' || order_no % 9 || ' "J"' END AS referee
FROM s JOIN k USING (season, home_team, away_team)""")
def statistics_files(spark, d):
    """Statistics read from files of three headers and put to the matches of their season and clubs."""
    root = _fresh(spark, "statistics")
    FI.write_lines(A.statistics_files(spark, d), root)
    rows = TB.attach_statistics(A.matches(spark, d), TB.match_statistics(TB.read_statistics(spark, root)))
    return rows.select("match_id", "season", "home_shots", "away_shots", "home_shots_on_target", "away_shots_on_target", "referee")


@query("WITH " + B.PLAYERS + """,
p AS (SELECT *, CAST(substr(season, 1, 4) AS INTEGER) AS y, CAST(regexp_extract(team, '([0-9]+)$', 1) AS BIGINT) % 4 AS level FROM players)
SELECT CAST(1999 + (y + 1) % 100 AS VARCHAR) || '-' || lpad(CAST((2000 + (y + 1) % 100) % 100 AS VARCHAR), 2, '0') AS season, team, CASE WHEN y % 2 = 0 THEN 'sofifa:players_' || substr(season, 6, 2) ELSE 'fifa_model:ratings' || (y + 1) END || '.csv' AS source, positions || ', CAM' AS positions,
 count(*) AS n, round(CAST(sum(rating) AS DOUBLE), 4) AS rating, round(CAST(sum(CASE WHEN y % 2 = 0 THEN value END) AS DOUBLE), 2) AS value FROM p WHERE y % 2 = 1 OR level <= 2 GROUP BY y, season, team, positions""")
def player_dump_files(spark, d):
    """Players read from dumps of both layouts; the season comes from the file's name."""
    root = _fresh(spark, "players")
    FI.write_lines(A.player_dump_files(spark, d), root)
    rows = TB.player_dump(TB.read_player_dumps(spark, root))
    return rows.groupBy("season", "team", "source", "positions").agg(
        F.count("*").alias("n"), F.round(F.sum("rating"), 4).alias("rating"), F.round(F.sum("value"), 2).alias("value"))


@query("WITH " + B.MATCHES + """,
u AS (SELECT m.season, m.matchday, m.home_team AS team, CAST(count(*) AS INTEGER) AS players_out, CAST(count(*) FILTER (l_linenumber = 1) AS INTEGER) AS key_players_out
 FROM lineitem JOIN matches m ON m.order_no = l_orderkey WHERE m.competition = 'premier_league' GROUP BY ALL)
SELECT *, CASE WHEN CAST(substr(season, 4, 1) AS INTEGER) % 2 = 0 THEN 'out, ' || players_out END AS notes,
 CASE WHEN CAST(substr(season, 4, 1) AS INTEGER) % 2 = 0 THEN 'club' ELSE 'manual' END AS source FROM u""")
def unavailability_files(spark, d):
    """Players out read from hand-kept files with notes and two headers."""
    root = _fresh(spark, "unavailability")
    FI.write_lines(A.unavailability_files(spark, d), root)
    return TB.unavailability(TB.context_files(spark, root, TB.UNAVAILABILITY))


@query("WITH " + B.SPELLS + "SELECT team, manager, start_date, end_date FROM spells")
def spell_file(spark, d):
    """Spells written as CSV and read back."""
    path = _fresh(spark, "spells") + "/csv"
    TB.write_spells(A.spells(spark, d), path)
    return TB.read_spells(spark, path)


@query(ORACLES["availability_from_json"])
def availability_log(spark, d):
    """Snapshot rows appended to the log and read back as text, an absent value an empty one."""
    path = _fresh(spark, "log") + "/csv"
    FD.availability_rows(A.availability_payloads(spark, d)).select(*TB.LOG_COLUMNS).write.csv(path, header=True, escape='"')
    return TB.read_log(spark, path).select(
        "observed_at", "fpl_next_event", "player_code", "player_id", "position", "fpl_team", "status", "chance_next", "news")


# --- the run ------------------------------------------------------------------------------------------

_STATES = ", ".join(f"({i}, DATE '{until}', {late})" for i, (until, late) in enumerate(A.ARCHIVE_STATES, 1))
_RUN = "WITH " + B.MATCHES + f""",
st(n, until, late) AS (VALUES {_STATES}),
rw AS (SELECT st.n, m.pool, m.season, m.competition, m.original_matchday AS rnd, m.home_team, m.away_team, m.order_no,
  CASE WHEN late AND order_no % 53 = 0 AND match_date BETWEEN DATE '2000-01-01' AND DATE '2000-02-29' THEN match_date + 30 ELSE match_date END AS match_date,
  CASE WHEN match_date < until THEN home_goals + CASE WHEN late AND order_no % 5 = 0 AND match_date BETWEEN DATE '1999-02-01' AND DATE '1999-02-28' THEN 1 ELSE 0 END END AS hg,
  CASE WHEN match_date < until THEN away_goals END AS ag,
  season || '-' || substr(competition, 1, 3) || '-' || substr(sha1(season || '|' || competition || '|' || coalesce(CAST(original_matchday AS VARCHAR), 'Cup') || '|' || home_team || '|' || away_team), 1, 16) AS match_id
  FROM matches m, st),
v AS (SELECT * FROM rw QUALIFY row_number() OVER (PARTITION BY n, pool, match_id ORDER BY order_no DESC) = 1),
fx AS (SELECT * FROM v WHERE competition = 'premier_league'),
med AS (SELECT n, pool, season, rnd, match_date AS median_date FROM (SELECT *, row_number() OVER (PARTITION BY n, pool, season, rnd ORDER BY match_date) AS rn,
  count(*) OVER (PARTITION BY n, pool, season, rnd) AS c FROM fx) WHERE rn = (c + 1) // 2),
core AS (SELECT f.n, f.pool, f.season, f.rnd, min(f.match_date) AS core_start FROM fx f JOIN med m USING (n, pool, season, rnd) WHERE abs(f.match_date - m.median_date) <= 4 GROUP BY ALL),
win AS (SELECT f.n, f.pool, f.match_id, arg_max(c.rnd, row(c.core_start, c.rnd)) AS rnd FROM fx f JOIN core c ON c.n = f.n AND c.pool = f.pool AND c.season = f.season AND c.core_start <= f.match_date GROUP BY ALL),
fst AS (SELECT n, pool, season, arg_min(rnd, row(core_start, rnd)) AS rnd FROM core GROUP BY ALL),
pl AS (SELECT f.* EXCLUDE (rnd), CASE WHEN abs(f.match_date - md.median_date) <= 4 THEN f.rnd ELSE coalesce(w.rnd, fst.rnd) END AS matchday FROM fx f
  LEFT JOIN med md USING (n, pool, season, rnd) LEFT JOIN win w ON w.n = f.n AND w.pool = f.pool AND w.match_id = f.match_id LEFT JOIN fst ON fst.n = f.n AND fst.pool = f.pool AND fst.season = f.season),
bl AS (SELECT n, pool, season, matchday, min(match_date) AS cutoff, string_agg(match_id, ',' ORDER BY match_id) AS ids FROM pl GROUP BY ALL),
mv AS (SELECT n, pool, least(a.cutoff, b.cutoff) AS day FROM (SELECT * REPLACE (n + 1 AS n) FROM bl WHERE n < {len(A.ARCHIVE_STATES)}) a FULL JOIN bl b USING (n, pool, season, matchday)
  WHERE a.cutoff IS DISTINCT FROM b.cutoff OR a.ids IS DISTINCT FROM b.ids),
ch AS (SELECT b.n, b.pool, least(a.match_date, b.match_date) + 1 AS day FROM v b LEFT JOIN v a ON a.n = b.n - 1 AND a.pool = b.pool AND a.match_id = b.match_id
  WHERE (a.hg IS NOT NULL OR b.hg IS NOT NULL) AND (a.hg IS DISTINCT FROM b.hg OR a.ag IS DISTINCT FROM b.ag OR a.match_date IS DISTINCT FROM b.match_date)),
sta AS (SELECT n, pool, min(day) AS start FROM (SELECT * FROM mv UNION ALL SELECT * FROM ch) GROUP BY ALL),
dirty AS (SELECT bl.* FROM bl JOIN sta USING (n, pool) WHERE cutoff >= start),
cut AS (SELECT DISTINCT n, pool, cutoff FROM dirty),
w AS (SELECT m.*, c.cutoff, exp(-0.0011::DOUBLE * (c.cutoff - m.match_date)) AS w FROM fx m JOIN cut c USING (n, pool) WHERE m.hg IS NOT NULL AND m.match_date < c.cutoff AND c.cutoff - m.match_date <= 1500),
cl AS (SELECT n, pool, cutoff, team, sum(w * gf) / sum(w) AS s, sum(w * ga) / sum(w) AS c FROM (SELECT n, pool, cutoff, w, home_team AS team, hg AS gf, ag AS ga FROM w
  UNION ALL SELECT n, pool, cutoff, w, away_team, ag, hg FROM w) GROUP BY ALL),
mn AS (SELECT n, pool, cutoff, nullif(sum(w * (hg + ag)) / (2 * sum(w)), 0) AS mean FROM w GROUP BY ALL),
fr AS (SELECT f.n, f.pool, f.match_id, f.season, f.matchday, d.cutoff, f.home_team, f.away_team, coalesce(mn.mean, 1.35) AS mean FROM pl f JOIN dirty d USING (n, pool, season, matchday) LEFT JOIN mn ON mn.n = f.n AND mn.pool = f.pool AND mn.cutoff = d.cutoff),
rt AS (SELECT f.*, greatest(least(coalesce(h.s, mean) * coalesce(a.c, mean) / mean, 8), 0.05) AS hr, greatest(least(coalesce(a.s, mean) * coalesce(h.c, mean) / mean, 8), 0.05) AS ar
  FROM fr f LEFT JOIN cl h ON h.n = f.n AND h.pool = f.pool AND h.cutoff = f.cutoff AND h.team = f.home_team LEFT JOIN cl a ON a.n = f.n AND a.pool = f.pool AND a.cutoff = f.cutoff AND a.team = f.away_team),
g AS (SELECT unnest(range(9)) AS k),
cells AS (SELECT n, pool, match_id, h.k AS h, a.k AS a, pow(hr, h.k) / factorial(CAST(h.k AS INTEGER)) * pow(ar, a.k) / factorial(CAST(a.k AS INTEGER)) AS p FROM rt, g h, g a),
ps AS (SELECT n, pool, match_id, sum(p) FILTER (h > a) / sum(p) AS ph, sum(p) FILTER (h = a) / sum(p) AS pd, sum(p) FILTER (h < a) / sum(p) AS pa FROM cells GROUP BY ALL)
"""


def _growing_lines(spark, d):
    return staged(spark, d, "growing_lines", lambda: AR.parse_lines(
        A.growing_archive(spark, d), ("state", "pool", "season", "competition")))


@query(_RUN + """SELECT CAST(n AS INTEGER) AS run, pool, match_id, season, matchday, cutoff, round(hr, 6) AS home_rate, round(ar, 6) AS away_rate,
 round(ph, 6) AS p_home, round(pd, 6) AS p_draw, round(pa, 6) AS p_away FROM rt JOIN ps USING (n, pool, match_id)""")
def incremental_run(spark, d):
    """The archive taken in at three states, each twice: the ledger of the runs that had news."""
    root = _fresh(spark, "run")
    lines = _growing_lines(spark, d)
    for state in range(1, len(A.ARCHIVE_STATES) + 1):
        rows = AR.standardise(lines.filter(F.col("state") == state))
        if RN.advance(root, rows, RN.average_forecasts) != state or RN.advance(root, rows, RN.average_forecasts) is not None:
            raise ValueError("a run wrote without news, or did not write its news")
    told = RN.ledger(spark, root).select("run", "pool", "match_id", "season", "matchday", "cutoff", "home_rate", "away_rate", "p_home", "p_draw", "p_away")
    return r6(told, "home_rate", "away_rate", "p_home", "p_draw", "p_away")


_DIRTY = "dirty AS (SELECT bl.* FROM bl JOIN sta USING (n, pool) WHERE cutoff >= start)"


@query(_RUN.replace(_DIRTY, f"dirty AS (SELECT * FROM bl WHERE n = {len(A.ARCHIVE_STATES)})") + """SELECT pool, match_id, season, matchday, cutoff,
 round(hr, 6) AS home_rate, round(ar, 6) AS away_rate FROM rt""")
def stream_moved_fixtures(spark, d):
    """The archive's states as a stream; the newest forecast of each match is that of a rebuild from the last state."""
    base, files = _fresh(spark, "moved"), 4
    lines = _growing_lines(spark, d)
    for state in range(1, len(A.ARCHIVE_STATES) + 1):
        rows = AR.standardise(lines.filter(F.col("state") == state)).select("pool", "match_id", "season", "competition", *RN.VALUES)
        rows.repartition(files).write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{base}/in")
    RN.advance_stream(stream, f"{base}/store", f"{base}/offsets", RN.average_forecasts)
    told = RN.newest_forecasts(spark, f"{base}/store").select(
        "pool", "match_id", "season", "matchday", "cutoff", "home_rate", "away_rate")
    return r6(told, "home_rate", "away_rate")
