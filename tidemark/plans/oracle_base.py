"""SQL twins of the adapters, shared by the check queries."""

MATCHES = """
m0 AS (SELECT o_orderkey AS k, o_custkey AS c, CAST(o_orderdate AS DATE) AS d, o_orderpriority AS pr FROM orders),
m1 AS (SELECT *, c // 10 AS club, (c // 10) // 20 AS lg,
  CASE WHEN month(d) >= 8 THEN year(d) ELSE year(d) - 1 END AS sy FROM m0),
m2 AS (SELECT *, lg * 20 + (club % 20 + 1 + k % 19) % 20 AS rival,
  CAST((d - make_date(sy, 8, 1)) // 10 + 1 AS INTEGER) AS rnd,
  pr NOT IN ('4-NOT SPECIFIED', '5-LOW') AS league, d < DATE '2001-06-01' AS done FROM m1),
matches AS (SELECT
  lpad(CAST(lg AS VARCHAR), greatest(6, length(CAST(lg AS VARCHAR)))::INT, '0') AS pool,
  'M' || lpad(CAST(k AS VARCHAR), greatest(12, length(CAST(k AS VARCHAR)))::INT, '0') AS match_id,
  CAST(sy AS VARCHAR) || '-' || lpad(CAST((sy + 1) % 100 AS VARCHAR), 2, '0') AS season,
  CASE pr WHEN '4-NOT SPECIFIED' THEN 'fa_cup' WHEN '5-LOW' THEN 'efl_cup' ELSE 'premier_league' END AS competition,
  CASE WHEN league THEN rnd END AS matchday,
  CASE WHEN league THEN CASE WHEN k % 29 = 0 THEN (rnd + 4) % 37 + 1 ELSE rnd END END AS original_matchday,
  d AS match_date,
  CASE WHEN k % 11 = 0 THEN NULL ELSE ['12:30', '15:00', '17:30', '20:00'][k % 4 + 1] END AS kickoff,
  'Club ' || lpad(CAST(club AS VARCHAR), greatest(9, length(CAST(club AS VARCHAR)))::INT, '0') AS home_team,
  'Club ' || lpad(CAST(rival AS VARCHAR), greatest(9, length(CAST(rival AS VARCHAR)))::INT, '0') AS away_team,
  CASE WHEN done THEN CAST((k * 31 + c) % 5 AS INTEGER) END AS home_goals,
  CASE WHEN done THEN CAST((k * 17 + c * 3) % 4 AS INTEGER) END AS away_goals,
  CASE WHEN NOT done THEN NULL WHEN (k * 31 + c) % 5 > (k * 17 + c * 3) % 4 THEN 'H'
       WHEN (k * 31 + c) % 5 < (k * 17 + c * 3) % 4 THEN 'A' ELSE 'D' END AS result,
  CASE WHEN done THEN 'played' ELSE 'scheduled' END AS status,
  k AS order_no FROM m2)
"""

STATS = """
match_stats AS (SELECT 'M' || lpad(CAST(l_orderkey AS VARCHAR), greatest(12, length(CAST(l_orderkey AS VARCHAR)))::INT, '0') AS match_id,
  floor(sum(l_quantity) / 8) AS home_shots, CAST(count(*) * 3 AS DOUBLE) AS away_shots,
  floor(sum(l_quantity) / 16) AS home_shots_on_target, CAST(count(*) AS DOUBLE) AS away_shots_on_target
  FROM lineitem GROUP BY l_orderkey)
"""

TIMELINE = MATCHES + """,
starts AS (SELECT pool, season, matchday, min(match_date) AS round_start FROM matches
  WHERE competition = 'premier_league' AND matchday IS NOT NULL GROUP BY ALL),
tl0 AS (SELECT m.*, m.competition = 'premier_league' AND m.matchday IS NOT NULL AS in_block, s.round_start
  FROM matches m LEFT JOIN starts s ON m.competition = 'premier_league'
   AND s.pool = m.pool AND s.season = m.season AND s.matchday = m.matchday),
tl1 AS (SELECT *, coalesce(round_start, match_date) AS block_date,
  CASE WHEN in_block THEN CAST(round_start AS VARCHAR) || '|0|' || season || '|' || lpad(CAST(matchday AS VARCHAR), greatest(4, length(CAST(matchday AS VARCHAR)))::INT, '0')
   ELSE CAST(match_date AS VARCHAR) || '|1|' || coalesce(kickoff, '') || '|' || match_id END AS block_key FROM tl0),
tl AS (SELECT *, block_key || '|' || CAST(match_date AS VARCHAR) || '|' || coalesce(kickoff, '') || '|' || match_id AS seq_key FROM tl1)
"""

SIDES = TIMELINE + """,
sides0 AS (
 SELECT pool, match_id, season, competition, matchday, match_date, block_key, seq_key, in_block,
  home_team AS team, away_team AS opponent, TRUE AS is_home, home_goals AS gf, away_goals AS ga FROM tl
 UNION ALL
 SELECT pool, match_id, season, competition, matchday, match_date, block_key, seq_key, in_block,
  away_team, home_team, FALSE, away_goals, home_goals FROM tl),
sides AS (SELECT *, gf IS NOT NULL AND ga IS NOT NULL AS played,
  CASE WHEN gf > ga THEN 3 WHEN gf = ga THEN 1 WHEN gf < ga THEN 0 END AS pts FROM sides0)
"""

HISTORY = SIDES + """,
hist AS (SELECT q.pool, q.team, q.match_id, q.match_date AS today, q.is_home,
  o.match_id AS o_id, o.match_date AS o_date, o.gf, o.ga, o.pts, o.is_home AS o_home, o.seq_key,
  row_number() OVER (PARTITION BY q.pool, q.team, q.match_id ORDER BY o.seq_key DESC) AS age_rank
  FROM sides q JOIN sides o ON o.pool = q.pool AND o.team = q.team AND o.played AND o.block_key < q.block_key
  WHERE q.in_block QUALIFY age_rank <= 20)
"""

SPELLS = """
spells AS (SELECT 'Club ' || lpad(CAST(o_custkey // 10 AS VARCHAR), greatest(9, length(CAST(o_custkey // 10 AS VARCHAR)))::INT, '0') AS team,
  'Coach ' || CAST(o_orderkey % 7 AS VARCHAR) AS manager,
  CASE WHEN o_orderkey % 10 = 0 THEN make_date(year(o_orderdate), 1, 1) ELSE CAST(o_orderdate AS DATE) END AS start_date,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE
   (CASE WHEN o_orderkey % 10 = 0 THEN make_date(year(o_orderdate), 1, 1) ELSE CAST(o_orderdate AS DATE) END)
   + CAST(o_orderkey % 300 + 20 AS INTEGER) END AS end_date,
  o_orderkey % 10 = 0 AS year_only, o_orderkey AS row_no FROM orders)
"""

PLAYERS = """
players AS (SELECT 'Supplier ' || CAST(l_suppkey AS VARCHAR) AS team,
  CAST(year(l_shipdate) AS VARCHAR) || '-' || lpad(CAST((year(l_shipdate) + 1) % 100 AS VARCHAR), 2, '0') AS season,
  'lines' AS source, p_retailprice AS rating, p_retailprice * 100 AS value,
  ['GK', 'CB', 'LB', 'RB', 'CDM', 'CM', 'LM', 'RW', 'ST', 'CF'][p_size % 10 + 1] AS positions
  FROM lineitem JOIN part ON l_partkey = p_partkey)
"""

#: Players by their home clubs under the name ``players``, as PLAYERS; needs MATCHES before it.
CLUB_PLAYERS = """
players AS (SELECT home_team AS team, season, CASE WHEN l_suppkey % 5 = 0 THEN 'sofifa:late' ELSE 'fifa_model:early' END AS source,
  p_retailprice AS rating, p_retailprice * 100 AS value, ['CB', 'CM', 'ST'][p_size % 3 + 1] AS positions
  FROM lineitem JOIN matches ON order_no = l_orderkey JOIN part ON l_partkey = p_partkey WHERE CAST(substr(season, 1, 4) AS INTEGER) % 3 <> 0)
"""

PREDICTIONS = MATCHES + """,
pr0 AS (SELECT m.*, r.run, 20 + (order_no * 7 + run) % 41 AS ph, 15 + (order_no * 3 + run) % 13 AS pd
  FROM matches m, (VALUES (1), (2)) r(run) WHERE competition = 'premier_league'),
predictions AS (SELECT 'run' || run || '-' || pool || '-' || season || '-' || matchday AS run_id,
  match_id, season, matchday, ph / 100.0::DOUBLE AS p_home, pd / 100.0::DOUBLE AS p_draw, (100 - ph - pd) / 100.0::DOUBLE AS p_away,
  CASE WHEN ph >= pd AND ph >= 100 - ph - pd THEN 'H' WHEN pd >= 100 - ph - pd THEN 'D' ELSE 'A' END AS predicted_outcome,
  (order_no % 30) / 10.0::DOUBLE AS exp_home_goals, (order_no % 20) / 10.0::DOUBLE AS exp_away_goals,
  CAST((order_no * 5) % 4 AS INTEGER) AS pred_home_goals, CAST((order_no * 7) % 3 AS INTEGER) AS pred_away_goals,
  (order_no % 17) / 100.0::DOUBLE AS scoreline_prob,
  CAST(match_date - CASE WHEN run = 1 THEN 3 ELSE CAST(order_no % 5 AS INTEGER) - 3 END AS VARCHAR) || 'T12:30:00+00:00' AS created_at
  FROM pr0),
record AS (SELECT * FROM predictions QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY created_at DESC, run_id DESC) = 1)
"""
