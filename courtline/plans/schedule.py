"""Schedule fatigue on orders (games) and lineitem (player rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from courtline.operators import schedule as ops
from courtline.plans import bindings as b
from courtline.plans.registry import query

TEAM_DAYS_SQL = """team_rows AS (
  SELECT home_team_id AS team_id, game_date, game_id, TRUE AS is_home, home_team_id AS venue FROM games
  UNION ALL SELECT away_team_id, game_date, game_id, FALSE, home_team_id FROM games),
days AS (
  SELECT team_id, game_date, is_home, venue, CAST(date_diff('day', DATE '1970-01-01', game_date) AS INTEGER) AS d,
    CASE WHEN venue % 50 <> 0 THEN CAST(25 AS DOUBLE) + CAST((venue * 7) % 240 AS DOUBLE) / 10 END AS lat,
    CASE WHEN venue % 50 <> 0 THEN -(CAST(70 AS DOUBLE) + CAST((venue * 13) % 520 AS DOUBLE) / 10) END AS lon
  FROM (SELECT *, row_number() OVER (PARTITION BY team_id, game_date ORDER BY game_id, is_home) AS rn FROM team_rows)
  WHERE rn = 1)"""

FLAGS_SQL = f"""{TEAM_DAYS_SQL},
known AS (
  SELECT team_id, d, lag(d) OVER w AS pd, lat, lon, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon
  FROM days WHERE lat IS NOT NULL WINDOW w AS (PARTITION BY team_id ORDER BY d)),
legs AS (
  SELECT team_id, d, pd, 2 * 3958.7613::DOUBLE * asin(sqrt(pow(sin((radians(lat) - radians(plat)) / 2), 2) +
    cos(radians(plat)) * cos(radians(lat)) * pow(sin((radians(lon) - radians(plon)) / 2), 2))) AS miles
  FROM known WHERE pd IS NOT NULL),
travel AS (
  SELECT x.team_id, x.d, sum(l.miles) AS miles FROM days x JOIN legs l
    ON l.team_id = x.team_id AND l.d <= x.d AND l.pd > x.d - 7 GROUP BY 1, 2),
w AS (
  SELECT *, lag(d) OVER o AS pd,
    count(*) OVER (PARTITION BY team_id ORDER BY d RANGE BETWEEN 3 PRECEDING AND CURRENT ROW) AS in4,
    count(*) OVER (PARTITION BY team_id ORDER BY d RANGE BETWEEN 4 PRECEDING AND CURRENT ROW) AS in5,
    row_number() OVER o - row_number() OVER (PARTITION BY team_id, is_home ORDER BY d) AS grp
  FROM days WINDOW o AS (PARTITION BY team_id ORDER BY d)),
flags AS (
  SELECT w.team_id, w.game_date, w.d, w.pd, is_home,
    CASE WHEN pd IS NULL THEN 7 ELSE greatest(0, w.d - pd - 1) END AS rest_days, in4, in5,
    row_number() OVER (PARTITION BY w.team_id, is_home, grp ORDER BY w.d) AS streak,
    coalesce(miles, 0) AS miles
  FROM w LEFT JOIN travel t ON t.team_id = w.team_id AND t.d = w.d)"""


@query(
    "schedule_flags",
    "W01 W02 W03 W04 W05 W06 X10",
    b.with_ctes(b.GAMES_SQL, FLAGS_SQL)
    + """SELECT team_id, CAST(game_date AS VARCHAR) AS game_date, CAST(rest_days AS INTEGER) AS rest_days,
  CAST(rest_days = 0 AS INTEGER) AS back_to_back, CAST(in4 >= 3 AS INTEGER) AS three_in_four,
  CAST(in5 >= 4 AS INTEGER) AS four_in_five, round(miles, 1) AS travel_miles,
  CAST(CASE WHEN is_home THEN streak ELSE 0 END AS INTEGER) AS home_stand,
  CAST(CASE WHEN is_home THEN 0 ELSE streak END AS INTEGER) AS road_trip FROM flags""",
)
def schedule_flags(spark, sf_dir):
    lat, lon = b.venue(F.col("venue_team"))
    flags = ops.schedule_flags(ops.team_days(b.games(spark, sf_dir)), lat, lon)
    return flags.select(
        "team_id",
        F.col("game_date").cast("string").alias("game_date"),
        "rest_days",
        *[F.col(c).cast("int").alias(c) for c in ("back_to_back", "three_in_four", "four_in_five")],
        "travel_miles",
        "home_stand",
        "road_trip",
    )


@query(
    "player_load",
    "W07",
    """WITH days AS (SELECT l_suppkey AS player_id, CAST(l_shipdate AS DATE) AS game_date, sum(l_quantity) AS minutes,
    sum(l_tax * 10) AS dist FROM lineitem GROUP BY 1, 2),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY player_id ORDER BY game_date) AS DOUBLE) AS n FROM days),
j AS (SELECT a.player_id, a.game_date, avg(p.minutes) AS am, sum(p.dist) AS td,
    regr_slope(p.minutes, a.n - p.n) AS slope, count(p.n) AS c
  FROM n a LEFT JOIN n p ON p.player_id = a.player_id AND p.n BETWEEN a.n - 5 AND a.n - 1 GROUP BY 1, 2)
SELECT player_id, CAST(game_date AS VARCHAR) AS game_date, round(coalesce(am, 0), 1) AS avg_minutes,
  round(coalesce(td, 0), 1) AS total_distance_miles,
  round(CASE WHEN c < 2 THEN 0 ELSE slope END, 2) + 0 AS minutes_trend FROM j""",
)
def player_load(spark, sf_dir):
    rows = b.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("player_id"),
        F.to_date("l_shipdate").alias("game_date"),
        F.col("l_quantity").alias("minutes"),
        (F.col("l_tax") * 10).alias("distance_miles"),
    )
    load = ops.player_load(rows)
    return load.select(
        "player_id", F.col("game_date").cast("string").alias("game_date"),
        "avg_minutes", "total_distance_miles",
        (F.col("minutes_trend") + 0.0).alias("minutes_trend"),
    )


@query(
    "context_rest",
    "J07",
    b.with_ctes(b.GAMES_SQL, FLAGS_SQL)
    + """SELECT team_id, CAST(game_date AS VARCHAR) AS game_date,
  CAST(coalesce(least(7, d - pd), 3) AS DOUBLE) AS gap_days,
  CAST(coalesce(least(7, d - pd), 3) <= 1 AS INTEGER) AS played_yesterday, round(miles, 1) AS travel_miles FROM flags""",
)
def context_rest(spark, sf_dir):
    lat, lon = b.venue(F.col("venue_team"))
    flags = ops.schedule_flags(ops.team_days(b.games(spark, sf_dir)), lat, lon)
    return ops.context_rest(flags).select(
        "team_id", F.col("game_date").cast("string").alias("game_date"), "gap_days",
        F.col("played_yesterday").cast("int").alias("played_yesterday"), "travel_miles",
    )
