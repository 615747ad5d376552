"""League-shaped views of the given tables.

The given tables are an order book and an event log, so each league table is
derived from one of them by row-wise arithmetic; its size follows the table it
comes from. Every view is stated twice: as a DataFrame and as a SQL common table
expression for the side-by-side check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from courtline.functions import clock

PHRASES = [
    "3PT Jump Shot (AST: Adams)",
    "Driving Layup",
    "Pull-Up Jumper Contested",
    "Step Back 3PT",
    "Tip-In Shot",
    "Slam Dunk Fast Break",
    "Bad Pass Turnover (STL: Baker)",
    "Lost Ball Turnover",
    "Traveling Turnover",
    "MISS Free Throw",
    "OFF Rebound",
    "Catch and Shoot",
    "Hook Shot",
    "Fadeaway Jumper (BLK: Clark)",
    "Finger Roll",
    "SUB: Davis FOR Evans",
]
TEAMS = 300
CLUBS = 30


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _mod(c: Column, n: int) -> Column:
    return F.pmod(c, F.lit(n))


def _div(c: Column, n: int) -> Column:
    return F.floor(c / n).cast("bigint")


# --- plays: events; one user's log is a game, five stretches of days its periods ---

def plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    day = F.dayofmonth("ts")
    period = F.least(F.lit(5), 1 + F.floor((day - 1) / 7).cast("int"))
    second = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.floor(F.second("ts")).cast("int")
    e = e.select(
        F.lpad(F.col("user_id").cast("string"), 10, "0").alias("game_id"),
        F.col("event_id").alias("event_num"),
        F.to_date("ts").alias("day"),
        period.alias("period"),
        ((day - 1 - 7 * (period - 1)) * 86400 + second).cast("bigint").alias("offset"),
        F.when(period <= 4, 720).otherwise(300).alias("length"),
        k.alias("k"),
        "event_type",
        "user_id",
    )
    left = (F.col("length") - _div(F.col("offset") * F.col("length"), 604800)).cast("int")
    code = (
        F.when(F.col("event_type") == "view", 1)
        .when(F.col("event_type") == "click", 2)
        .when((F.col("event_type") == "error") & (F.col("k") % 3 != 0), 5)
        .when(F.col("event_type") == "error", 6)
        .when((F.col("event_type") == "purchase") & (F.col("k") % 2 == 0), 3)
        .when(F.col("event_type") == "purchase", 4)
        .otherwise(8)
    )
    home_side = _mod(F.col("event_num") + F.col("k"), 2) == 0
    home = 1 + _mod(F.col("user_id"), CLUBS)
    away = 1 + _mod(F.col("user_id") + 7, CLUBS)
    phrase = F.element_at(F.array(*[F.lit(p) for p in PHRASES]), 1 + F.col("k") % 16)
    e = e.select(
        "game_id", "event_num", "day", "period", "k",
        left.alias("clock_left"),
        F.concat(_div(left, 60).cast("string"), F.lit(":"), F.lpad((left % 60).cast("string"), 2, "0")).alias("pc_time"),
        code.alias("event_type"),
        home.alias("home_team_id"),
        away.alias("away_team_id"),
        F.when(home_side, home).otherwise(away).alias("team_id"),
        F.when(home_side, phrase).alias("home_description"),
        F.when(~home_side, phrase).alias("away_description"),
        F.when(F.col("k") % 11 == 0, phrase).alias("neutral_description"),
    )
    return e.select(
        *e.columns,
        (F.col("team_id") * 100 + _mod(_div(F.col("event_num"), 2), 8)).alias("player1_id"),
        (F.col("team_id") * 100 + _mod(_div(F.col("event_num"), 16), 8)).alias("player2_id"),
        F.when(F.col("event_type") == 1, F.col("k")).alias("score_home"),
        F.when(F.col("event_type") == 1, 100 - F.col("k")).alias("score_away"),
    )


_PHRASE_LIST = "[" + ", ".join(f"'{p}'" for p in PHRASES) + "]"

PLAYS_SQL = f"""plays AS (
  SELECT *, team_id * 100 + (event_num // 2) % 8 AS player1_id,
    team_id * 100 + (event_num // 16) % 8 AS player2_id,
    CASE WHEN event_type = 1 THEN k END AS score_home,
    CASE WHEN event_type = 1 THEN 100 - k END AS score_away
  FROM (
    SELECT game_id, event_num, day, period, k, clock_left,
      CAST(clock_left // 60 AS VARCHAR) || ':' || lpad(CAST(clock_left % 60 AS VARCHAR), 2, '0') AS pc_time,
      CASE WHEN event_type = 'view' THEN 1 WHEN event_type = 'click' THEN 2
        WHEN event_type = 'error' AND k % 3 <> 0 THEN 5 WHEN event_type = 'error' THEN 6
        WHEN event_type = 'purchase' AND k % 2 = 0 THEN 3 WHEN event_type = 'purchase' THEN 4
        ELSE 8 END AS event_type,
      home_team_id, away_team_id,
      CASE WHEN hs THEN home_team_id ELSE away_team_id END AS team_id,
      CASE WHEN hs THEN phrase END AS home_description,
      CASE WHEN NOT hs THEN phrase END AS away_description,
      CASE WHEN k % 11 = 0 THEN phrase END AS neutral_description
    FROM (
      SELECT game_id, event_num, day, period, k, event_type,
        len0 - (((dd - 1 - 7 * (period - 1)) * 86400 + sec) * len0) // 604800 AS clock_left,
        1 + user_id % {CLUBS} AS home_team_id, 1 + (user_id + 7) % {CLUBS} AS away_team_id,
        (event_num + k) % 2 = 0 AS hs, ({_PHRASE_LIST})[1 + k % 16] AS phrase
      FROM (
        SELECT lpad(CAST(user_id AS VARCHAR), 10, '0') AS game_id, event_id AS event_num,
          CAST(ts AS DATE) AS day, event_type, user_id,
          CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
          dayofmonth(ts) AS dd, least(5, 1 + (dayofmonth(ts) - 1) // 7) AS period,
          CASE WHEN least(5, 1 + (dayofmonth(ts) - 1) // 7) <= 4 THEN 720 ELSE 300 END AS len0,
          hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS sec
        FROM events))))"""


# --- games and their two team rows: orders ---

def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    home = _mod(F.col("o_custkey"), TEAMS)
    return o.select(
        F.col("o_orderkey").alias("game_id"),
        F.to_date("o_orderdate").alias("game_date"),
        clock.season_label(F.to_date("o_orderdate")).alias("season_id"),
        home.alias("home_team_id"),
        _mod(home + 1 + _mod(F.col("o_orderkey"), TEAMS - 1), TEAMS).alias("away_team_id"),
        (80 + _mod(F.col("o_orderkey") * 7 + F.col("o_custkey"), 60)).alias("home_score"),
        (80 + _mod(F.col("o_orderkey") * 11 + F.col("o_custkey") * 3, 60)).alias("away_score"),
        F.when(F.col("o_orderstatus").isin("F", "O"), "completed").otherwise("scheduled").alias("status"),
        F.col("o_totalprice").alias("price"),
    )


GAMES_SQL = f"""games AS (
  SELECT o_orderkey AS game_id, CAST(o_orderdate AS DATE) AS game_date,
    CAST(year(o_orderdate) - CASE WHEN month(o_orderdate) >= 10 THEN 0 ELSE 1 END AS VARCHAR) || '-' ||
      lpad(CAST((year(o_orderdate) - CASE WHEN month(o_orderdate) >= 10 THEN 0 ELSE 1 END + 1) % 100 AS VARCHAR), 2, '0') AS season_id,
    o_custkey % {TEAMS} AS home_team_id,
    (o_custkey % {TEAMS} + 1 + o_orderkey % {TEAMS - 1}) % {TEAMS} AS away_team_id,
    80 + (o_orderkey * 7 + o_custkey) % 60 AS home_score,
    80 + (o_orderkey * 11 + o_custkey * 3) % 60 AS away_score,
    CASE WHEN o_orderstatus IN ('F', 'O') THEN 'completed' ELSE 'scheduled' END AS status,
    o_totalprice AS price
  FROM orders)"""


def venue(team: Column) -> tuple[Column, Column]:
    """Arena coordinates by team; every 50th team has none."""
    known = team % 50 != 0
    return (
        F.when(known, 25.0 + (team * 7) % 240 / 10.0),
        F.when(known, -(70.0 + (team * 13) % 520 / 10.0)),
    )


# --- bets: lineitem ---

BET_ORDER = ["bet_date", "game_id", "line_no", "part_id", "supplier_id"]
BET_LEVELS = ["bet_date", "id_range"]
ID_RANGE = 10_000_000


def bets(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    odds = 1.5 + 10 * F.col("l_discount")
    prob = 0.35 + _mod(F.col("l_partkey"), 60) / 100.0
    return li.select(
        F.to_date("l_shipdate").alias("bet_date"),
        F.col("l_orderkey").alias("game_id"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_partkey").alias("part_id"),
        F.col("l_suppkey").alias("supplier_id"),
        _div(F.col("l_orderkey"), ID_RANGE).alias("id_range"),
        F.when(F.col("l_linenumber") % 3 == 0, "total")
        .when(F.col("l_linestatus") == "O", "moneyline")
        .otherwise("spread").alias("bet_type"),
        F.when(F.col("l_suppkey") % 2 == 0, "home").otherwise("away").alias("side"),
        prob.alias("model_prob"),
        odds.alias("market_odds"),
        (prob - 1.0 / odds).alias("edge"),
        F.col("l_quantity").alias("bet_amount"),
        F.when(F.col("l_returnflag") == "A", "win")
        .when(F.col("l_returnflag") == "R", "loss")
        .otherwise("push").alias("result"),
        F.when(F.col("l_returnflag") == "A", F.col("l_quantity") * (odds - 1))
        .when(F.col("l_returnflag") == "R", -F.col("l_quantity"))
        .otherwise(0.0).alias("profit"),
    )


BETS_SQL = """bets AS (
  SELECT *, model_prob - 1.0 / market_odds AS edge,
    CASE result WHEN 'win' THEN bet_amount * (market_odds - 1) WHEN 'loss' THEN -bet_amount ELSE 0.0 END AS profit
  FROM (SELECT CAST(l_shipdate AS DATE) AS bet_date, l_orderkey AS game_id, l_linenumber AS line_no,
    l_partkey AS part_id, l_suppkey AS supplier_id,
    CASE WHEN l_linenumber % 3 = 0 THEN 'total' WHEN l_linestatus = 'O' THEN 'moneyline' ELSE 'spread' END AS bet_type,
    CASE WHEN l_suppkey % 2 = 0 THEN 'home' ELSE 'away' END AS side,
    CAST(0.35 AS DOUBLE) + CAST(l_partkey % 60 AS DOUBLE) / 100 AS model_prob,
    CAST(1.5 AS DOUBLE) + 10 * l_discount AS market_odds,
    l_quantity AS bet_amount,
    CASE l_returnflag WHEN 'A' THEN 'win' WHEN 'R' THEN 'loss' ELSE 'push' END AS result
  FROM lineitem))"""


# --- two-way prices: part ---

def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    first = (
        F.when(F.col("p_partkey") % 89 == 1, F.lit(1.1))
        .otherwise(1.2 + F.col("p_partkey") % 300 / 100.0)
    )
    second = (
        F.when(F.col("p_partkey") % 97 == 0, F.lit(0.9))
        .when(F.col("p_partkey") % 89 == 1, F.lit(1.1))
        .otherwise(1.0 / (1.05 - 1.0 / first))
    )
    return p.select(
        F.col("p_partkey").alias("game_id"),
        first.alias("first_odds"),
        second.alias("second_odds"),
        (F.col("p_size") / 51.0).alias("model_prob"),
        "p_size",
        "p_retailprice",
    )


PRICES_SQL = """prices AS (
  SELECT game_id, first_odds, p_size, p_retailprice, p_size / CAST(51 AS DOUBLE) AS model_prob,
    CASE WHEN game_id % 97 = 0 THEN CAST(0.9 AS DOUBLE) WHEN game_id % 89 = 1 THEN CAST(1.1 AS DOUBLE)
      ELSE 1.0 / (CAST(1.05 AS DOUBLE) - 1.0 / first_odds) END AS second_odds
  FROM (SELECT p_partkey AS game_id, p_size, p_retailprice,
    CASE WHEN p_partkey % 89 = 1 THEN CAST(1.1 AS DOUBLE)
      ELSE CAST(1.2 AS DOUBLE) + CAST(p_partkey % 300 AS DOUBLE) / 100 END AS first_odds FROM part))"""


# --- shots: lineitem ---

def shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_suppkey").alias("player_id"),
        (_mod(F.col("l_partkey") * 37, 501) - 250).cast("int").alias("loc_x"),
        (_mod(F.col("l_orderkey") * 53, 451) - 50).cast("int").alias("loc_y"),
        (F.col("l_returnflag") == "A").alias("made"),
        F.col("l_orderkey").alias("game_id"),
        F.year("l_shipdate").alias("season"),
    )


SHOTS_SQL = """shots AS (
  SELECT l_suppkey AS player_id, CAST((l_partkey * 37) % 501 - 250 AS INTEGER) AS loc_x,
    CAST((l_orderkey * 53) % 451 - 50 AS INTEGER) AS loc_y, l_returnflag = 'A' AS made,
    l_orderkey AS game_id, year(l_shipdate) AS season FROM lineitem)"""


def lineups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five supplier ids per supplier, as home or away lineup by parity."""
    s = table(spark, sf_dir, "supplier")
    ids = F.array(*[
        (F.col("s_suppkey") - F.col("s_suppkey") % 10 + (F.col("s_suppkey") + 3 * i) % 10)
        for i in range(5)
    ])
    return s.select(F.col("s_suppkey").alias("lineup_id"), F.sort_array(ids).alias("lineup"))


LINEUPS_SQL = """lineups AS (
  SELECT s_suppkey AS lineup_id, list_sort([
    s_suppkey - s_suppkey % 10 + s_suppkey % 10, s_suppkey - s_suppkey % 10 + (s_suppkey + 3) % 10,
    s_suppkey - s_suppkey % 10 + (s_suppkey + 6) % 10, s_suppkey - s_suppkey % 10 + (s_suppkey + 9) % 10,
    s_suppkey - s_suppkey % 10 + (s_suppkey + 12) % 10]) AS lineup FROM supplier)"""


# --- stints with ten players each: orders ---

def stints(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    home = _mod(F.col("o_custkey"), CLUBS)
    away = _mod(home + 1 + _mod(F.col("o_orderkey"), CLUBS - 1), CLUBS)

    def five(team: Column) -> Column:
        return F.sort_array(F.array(*[
            team * 10 + _mod(F.col("o_orderkey") + 3 * i, 10) for i in range(5)
        ]))

    return o.select(
        F.col("o_orderkey").alias("stint_id"),
        F.col("o_orderkey").alias("game_id"),
        F.to_date("o_orderdate").alias("game_date"),
        clock.season_label(F.to_date("o_orderdate")).alias("season_id"),
        five(home).alias("home_lineup"),
        five(away).alias("away_lineup"),
        _mod(_div(F.col("o_totalprice"), 1000), 30).alias("home_points"),
        _mod(F.col("o_orderkey") * 7, 25).alias("away_points"),
        F.when(F.col("o_orderkey") % 41 == 0, 0.0)
        .otherwise(5.0 + _mod(F.col("o_orderkey"), 20)).alias("possessions"),
        (60 + _mod(F.col("o_orderkey"), 300)).cast("int").alias("duration_seconds"),
    )


def _five_sql(team: str) -> str:
    return "list_sort([" + ", ".join(
        f"({team}) * 10 + (o_orderkey + {3 * i}) % 10" for i in range(5)
    ) + "])"


_HOME = f"o_custkey % {CLUBS}"
_AWAY = f"(o_custkey % {CLUBS} + 1 + o_orderkey % {CLUBS - 1}) % {CLUBS}"

STINTS_SQL = f"""stints AS (
  SELECT o_orderkey AS stint_id, o_orderkey AS game_id, CAST(o_orderdate AS DATE) AS game_date,
    CAST(year(o_orderdate) - CASE WHEN month(o_orderdate) >= 10 THEN 0 ELSE 1 END AS VARCHAR) || '-' ||
      lpad(CAST((year(o_orderdate) - CASE WHEN month(o_orderdate) >= 10 THEN 0 ELSE 1 END + 1) % 100 AS VARCHAR), 2, '0') AS season_id,
    {_five_sql(_HOME)} AS home_lineup, {_five_sql(_AWAY)} AS away_lineup,
    CAST(floor(o_totalprice / 1000) AS BIGINT) % 30 AS home_points, (o_orderkey * 7) % 25 AS away_points,
    CASE WHEN o_orderkey % 41 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(5 + o_orderkey % 20 AS DOUBLE) END AS possessions,
    CAST(60 + o_orderkey % 300 AS INTEGER) AS duration_seconds
  FROM orders)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
