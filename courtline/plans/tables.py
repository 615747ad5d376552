"""Ingest, joins, table maintenance and quality checks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from courtline.functions import misc
from courtline.operators import quality
from courtline.plans import bindings as b
from courtline.plans.registry import query
from courtline.plans.sinks import _folder
from courtline.sources import maintenance, payloads, teams
from courtline.sources.payloads import rename_headers

_day = lambda c: F.col(c).cast("string").alias(c)


# --- payloads: customers as player documents, orders as schedule rows ---

_CUST = "c_custkey"


def player_payloads(spark, sf_dir):
    """One document text per customer, with two result sets."""
    k = F.col(_CUST)
    values = F.array(
        k.cast("string"), F.col("c_name"),
        F.when(k % 4 != 0, F.format_string("19%02d-03-%02dT00:00:00", (70 + k % 30).cast("int"), (1 + k % 28).cast("int"))),
        F.when(k % 5 != 0, F.concat((5 + k % 3).cast("string"), F.lit("-"), (k % 12).cast("string"))).otherwise(""),
        F.when(k % 6 != 0, (170 + k % 90).cast("string")).otherwise(""),
        F.when(k % 7 != 0, (1990 + k % 30).cast("string")).otherwise("Undrafted"),
        F.when(k % 7 != 0, (1 + k % 2).cast("string")).otherwise("Undrafted"),
        F.when(k % 7 != 0, (1 + k % 60).cast("string")).otherwise("Undrafted"),
    )
    headers = ["PERSON_ID", "DISPLAY_FIRST_LAST", "BIRTHDATE", "HEIGHT", "WEIGHT", "DRAFT_YEAR", "DRAFT_ROUND", "DRAFT_NUMBER"]
    sets = F.array(
        F.struct(F.lit("CommonPlayerInfo").alias("name"), F.array(*[F.lit(h) for h in headers]).alias("headers"), F.array(values).alias("rowSet")),
        F.struct(F.lit("AvailableSeasons").alias("name"), F.array(F.lit("SEASON_ID")).alias("headers"), F.array(F.array(k.cast("string"))).alias("rowSet")),
    )
    return b.table(spark, sf_dir, "customer").select(F.to_json(F.struct(sets.alias("resultSets"))).alias("document"))


@query(
    "player_details",
    "S01 S13",
    """SELECT c_custkey AS player_id, c_name AS full_name, CAST(CASE WHEN c_custkey % 5 <> 0 THEN (5 + c_custkey % 3) * 12 + c_custkey % 12 END AS INTEGER) AS height_inches,
  CAST(CASE WHEN c_custkey % 6 <> 0 THEN 170 + c_custkey % 90 END AS INTEGER) AS weight_lbs,
  CASE WHEN c_custkey % 4 <> 0 THEN printf('19%d-03-%02d', 70 + c_custkey % 30, 1 + c_custkey % 28) END AS birth_date,
  CAST(CASE WHEN c_custkey % 7 <> 0 THEN 1990 + c_custkey % 30 END AS INTEGER) AS draft_year, CAST(CASE WHEN c_custkey % 7 <> 0 THEN 1 + c_custkey % 2 END AS INTEGER) AS draft_round,
  CAST(CASE WHEN c_custkey % 7 <> 0 THEN 1 + c_custkey % 60 END AS INTEGER) AS draft_number FROM customer""",
)
def player_details(spark, sf_dir):
    rows = payloads.result_set(player_payloads(spark, sf_dir), "document", payloads.SET_NAMES["player_info"])
    return payloads.player_details(rows).withColumn("birth_date", F.col("birth_date").cast("string"))


def finder_rows(spark, sf_dir):
    """Two team rows per order; some lack the matchup text, some the second row."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    side = F.explode(F.when(k % 23 == 0, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("away")
    rows = b.table(spark, sf_dir, "orders").select("*", side)
    away = F.col("away") == 1
    home_id, away_id = 1 + c % 30, 31 + k % 30
    margin = k % 31 - 15
    return rows.select(
        rename_headers(
            {
                "GAME_ID": k, "TEAM_ID": F.when(away, away_id).otherwise(home_id),
                "GAME_DATE": F.date_format("o_orderdate", "yyyy-MM-dd"),
                "MATCHUP": F.when(k % 19 == 0, "").when(away, "BBB @ AAA").otherwise("AAA vs. BBB"),
                "WL": F.when(F.col("o_orderstatus") == "P", "").when(away, "L").otherwise("W"),
                "PTS": F.when(k % 29 != 0, 100 + F.when(away, 0).otherwise(margin)),
                "PLUS_MINUS": F.when(away, -margin + 0.5).otherwise(margin),
            }
        )
    )


@query(
    "finder_games",
    "S02",
    b.with_ctes(b.GAMES_SQL)
    + """, x AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d, season_id, 1 + o_custkey % 30 AS h, 31 + o_orderkey % 30 AS a, o_orderkey % 31 - 15 AS m,
  o_orderstatus = 'P' AS p, o_orderkey % 19 = 0 AND o_orderkey % 31 - 15 < -(o_orderkey % 31 - 15) + 0.5 AS sw FROM orders JOIN games ON game_id = o_orderkey WHERE o_orderkey % 23 <> 0)
SELECT CAST(k AS VARCHAR) AS game_id, season_id, CAST(d AS VARCHAR) AS game_date, CASE WHEN sw THEN a ELSE h END AS home_team_id, CASE WHEN sw THEN h ELSE a END AS away_team_id,
  CAST(CASE WHEN k % 29 <> 0 THEN 100 + CASE WHEN sw THEN 0 ELSE m END END AS INTEGER) AS home_score, CAST(CASE WHEN k % 29 <> 0 THEN 100 + CASE WHEN sw THEN m ELSE 0 END END AS INTEGER) AS away_score,
  CASE WHEN p THEN 'scheduled' ELSE 'completed' END AS status FROM x""",
)
def finder_games(spark, sf_dir):
    return payloads.games(finder_rows(spark, sf_dir)).drop("attendance").withColumn(
        "game_date", F.col("game_date").cast("string")
    )


@query(
    "games_in_range",
    "S03 S04 P01",
    b.with_ctes(b.GAMES_SQL)
    + "SELECT DISTINCT game_id, season_id, CAST(game_date AS VARCHAR) AS game_date FROM games WHERE status = 'completed' AND game_date BETWEEN DATE '1997-05-01' AND DATE '1998-11-15'",
)
def games_in_range(spark, sf_dir):
    games = b.games(spark, sf_dir).filter("status = 'completed'")
    found = payloads.in_date_range(games, F.lit(dt.date(1997, 5, 1)), F.lit(dt.date(1998, 11, 15)))
    return found.select("game_id", "season_id", _day("game_date")).distinct()


@query(
    "parsed_plays",
    "S05",
    b.with_ctes(b.PLAYS_SQL)
    + """SELECT game_id, CAST(event_num AS INTEGER) AS event_num, CAST(period AS INTEGER) AS period, pc_time, CAST(event_type AS INTEGER) AS event_type, home_description, away_description,
  CAST(CASE WHEN event_num % 3 = 0 THEN score_home END AS INTEGER) AS score_home, CAST(CASE WHEN event_num % 3 = 0 THEN score_away END AS INTEGER) AS score_away,
  CASE WHEN event_num % 4 <> 0 THEN player1_id END AS player1_id, CASE WHEN event_num % 7 <> 0 THEN team_id END AS team_id FROM plays""",
)
def parsed_plays(spark, sf_dir):
    n = F.col("event_num")
    raw = b.plays(spark, sf_dir).select(
        rename_headers(
            {
                "GAME_ID": F.col("game_id"), "EVENTNUM": n, "PERIOD": F.col("period"),
                "PCTIMESTRING": F.concat(F.lit(" "), "pc_time"), "WCTIMESTRING": F.lit(""),
                "EVENTMSGTYPE": F.col("event_type"), "EVENTMSGACTIONTYPE": F.lit("0"),
                "HOMEDESCRIPTION": F.coalesce("home_description", F.lit("")),
                "VISITORDESCRIPTION": F.col("away_description"), "NEUTRALDESCRIPTION": F.lit(None),
                "SCORE": F.when(n % 3 == 0, F.concat_ws(" - ", "score_away", "score_home")).otherwise("TIE"),
                "PLAYER1_ID": F.when(n % 4 != 0, F.col("player1_id")).otherwise(0),
                "PLAYER2_ID": F.lit("x"), "PLAYER3_ID": F.lit(None),
                "PLAYER1_TEAM_ID": F.when(n % 7 != 0, F.col("team_id").cast("string")).otherwise(""),
            }
        )
    )
    return payloads.plays(raw).select(
        "game_id", "event_num", "period", "pc_time", "event_type", "home_description",
        "away_description", "score_home", "score_away", "player1_id", "team_id",
    )


_SHOT_TYPES = ["3PT Field Goal", "2PT Field Goal", "Field Goal", "dunk"]


@query(
    "parsed_shots",
    "S07 S08",
    """SELECT CAST(l_orderkey AS VARCHAR) AS game_id, l_suppkey AS player_id, 1 + l_partkey % 30 AS team_id, (['3PT', '2PT', '2PT', 'dunk'])[1 + l_linenumber % 4] AS shot_type,
  CAST((l_partkey * 37) % 501 - 250 AS INTEGER) AS loc_x, CAST(l_returnflag = 'A' AS INTEGER) AS made, count(*) AS shots
FROM lineitem WHERE l_suppkey <> 0 AND l_partkey % 50 <> 0 GROUP BY ALL""",
)
def parsed_shots(spark, sf_dir):
    kinds = F.array(*[F.lit(t) for t in _SHOT_TYPES])
    raw = b.table(spark, sf_dir, "lineitem").select(
        rename_headers(
            {
                "GAME_ID": F.col("l_orderkey"), "PLAYER_ID": F.col("l_suppkey"),
                "TEAM_ID": F.when(F.col("l_partkey") % 50 != 0, 1 + F.col("l_partkey") % 30),
                "PERIOD": F.lit("1"), "MINUTES_REMAINING": F.lit("3"), "SECONDS_REMAINING": F.lit("20"),
                "ACTION_TYPE": F.lit(""), "SHOT_TYPE": F.element_at(kinds, 1 + F.col("l_linenumber") % 4),
                "SHOT_ZONE_BASIC": F.lit("Mid"), "SHOT_ZONE_AREA": F.lit("L"), "SHOT_ZONE_RANGE": F.lit("8-16"),
                "SHOT_DISTANCE": F.lit("12"), "LOC_X": F.pmod(F.col("l_partkey") * 37, F.lit(501)) - 250,
                "LOC_Y": F.lit("5"), "SHOT_MADE_FLAG": (F.col("l_returnflag") == "A").cast("int"),
            }
        )
    )
    keys = ["game_id", "player_id", "team_id", "shot_type", "loc_x"]
    return payloads.shots(raw).groupBy(*keys, F.col("made").cast("int").alias("made")).agg(
        F.count(F.lit(1)).alias("shots")
    )


@query(
    "team_box_scores",
    "S09",
    """WITH t AS (SELECT o_orderkey AS g, o_custkey % 30 AS team_id, TRUE AS h, o_orderkey AS k, o_custkey AS c FROM orders UNION ALL SELECT o_orderkey, 30 + o_orderkey % 30, FALSE, o_orderkey, o_custkey FROM orders)
SELECT CAST(g AS VARCHAR) AS game_id, team_id, CAST(h AS INTEGER) AS is_home, CAST(80 + k % 50 AS INTEGER) AS points,
  CASE WHEN k % 3 = 0 THEN 101.5::DOUBLE WHEN k % 5 <> 0 THEN CAST(90 + c % 40 AS DOUBLE) END AS offensive_rating, CASE WHEN k % 5 <> 0 THEN CAST(95 + k % 11 AS DOUBLE) END AS pace FROM t""",
)
def team_box_scores(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    side = F.explode(F.array(F.lit(True), F.lit(False))).alias("h")
    rows = b.table(spark, sf_dir, "orders").select("*", side).withColumn(
        "t", F.when(F.col("h"), c % 30).otherwise(30 + k % 30)
    )
    key = {"GAME_ID": k, "TEAM_ID": F.col("t")}
    trad = rows.select(rename_headers({**key, "PTS": 80 + k % 50, "OFF_RATING": F.when(k % 3 == 0, "101.5")}))
    adv = rows.filter("o_orderkey % 5 <> 0").select(
        rename_headers({**key, "OFF_RATING": 90 + c % 40, "PACE": 95 + k % 11})
    )
    schedule = b.table(spark, sf_dir, "orders").select(
        k.cast("string").alias("game_id"), (c % 30).alias("home_team_id")
    )
    out = payloads.team_box(trad, adv, schedule)
    return out.select(
        "game_id", "team_id", F.col("is_home").cast("int").alias("is_home"), "points", "offensive_rating", "pace"
    )


@query(
    "player_box_scores",
    "S10 S11 P03",
    b.with_ctes(b.STINTS_SQL)
    + """, p AS (SELECT game_id AS g, unnest(list_concat(home_lineup, away_lineup)) AS p FROM stints)
SELECT CAST(g AS VARCHAR) AS game_id, p AS player_id, p // 10 AS team_id, round(CASE p % 3 WHEN 0 THEN 5 + g % 30 + (p % 60) / 60.0::DOUBLE WHEN 1 THEN CAST(p % 48 AS DOUBLE) END, 6) AS minutes,
  CAST(g % 30 AS INTEGER) AS points, round(CASE WHEN (g + p) % 4 <> 0 THEN CASE WHEN p % 9 > 0 THEN (g % 7) / CAST(p % 9 AS DOUBLE) END END, 6) AS fg3a_rate,
  CASE WHEN p % 2 = 0 THEN CAST(g % 5 AS DOUBLE) END AS distance_miles FROM p""",
)
def player_box_scores(spark, sf_dir):
    g, p = F.col("game_id"), F.col("player_id")
    rows = b.stints(spark, sf_dir).select(
        "game_id", F.explode(F.concat("home_lineup", "away_lineup")).alias("player_id")
    )
    key = {"GAME_ID": g, "PLAYER_ID": p, "TEAM_ID": F.floor(p / 10)}
    mins = (
        F.when(p % 3 == 0, F.concat((5 + g % 30).cast("string"), F.lit(":"), F.lpad((p % 60).cast("string"), 2, "0")))
        .when(p % 3 == 1, (p % 48).cast("string")).otherwise("DNP")
    )
    trad = rows.select(rename_headers({
        **key, "MIN": mins, "PTS": g % 30, "FG3A": F.when((g + p) % 4 != 0, g % 7), "FGA": F.when((g + p) % 4 != 0, p % 9),
    }))
    adv = rows.filter("player_id % 5 <> 0").select(rename_headers({**key, "PACE": g % 100}))
    track = rows.filter("player_id % 2 = 0").select(rename_headers({**key, "DIST": g % 5, "SPD": p % 4}))
    out = payloads.player_box(trad, adv, track)
    rate = F.when(F.col("fga") > 0, F.col("fg3a") / F.col("fga"))
    return out.select(
        "game_id", "player_id", "team_id", F.round("minutes", 6).alias("minutes"), "points",
        F.round(rate, 6).alias("fg3a_rate"), "distance_miles",
    )


def roster_rows(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return b.table(spark, sf_dir, "orders").select(
        F.year("o_orderdate").cast("string").alias("season_id"), (k % 30).alias("team_id"), k.alias("entry"),
        rename_headers({
            "PLAYER_ID": c, "PLAYER": F.concat(F.lit("P"), k.cast("string")), "NUM": F.lit("7"),
            "POSITION": F.when(c % 5 != 0, "G").otherwise(""), "HEIGHT": F.when(k % 2 == 0, "6-8").otherwise("tall"),
            "WEIGHT": 180 + k % 50, "BIRTH_DATE": F.when(k % 3 != 0, "MAR 03, 1998").otherwise("unknown"),
        }),
    )


@query(
    "roster_players",
    "S12",
    """SELECT o_custkey AS player_id, 'P' || CAST(o_orderkey AS VARCHAR) AS full_name, CAST(CASE WHEN o_orderkey % 2 = 0 THEN 80 END AS INTEGER) AS height_inches,
  CAST(180 + o_orderkey % 50 AS INTEGER) AS weight_lbs, CASE WHEN o_orderkey % 3 <> 0 THEN '1998-03-03' END AS birth_date
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY year(o_orderdate), o_orderkey % 30, o_orderkey) AS rn FROM orders) WHERE rn = 1""",
)
def roster_players(spark, sf_dir):
    out = payloads.roster_players(roster_rows(spark, sf_dir), ["season_id", "team_id", "entry"])
    return out.withColumn("birth_date", F.col("birth_date").cast("string"))


@query(
    "roster_seasons",
    "S12",
    """SELECT DISTINCT o_custkey AS player_id, CAST(year(o_orderdate) AS VARCHAR) AS season_id, o_orderkey % 30 AS team_id, CASE WHEN o_custkey % 5 <> 0 THEN 'G' END AS position, '7' AS jersey_number FROM orders""",
)
def roster_seasons(spark, sf_dir):
    return payloads.roster_seasons(roster_rows(spark, sf_dir))


_TRICODES = [t[0] for t in teams.TEAMS]


@query(
    "injury_feed",
    "S14 S15 X29",
    f"""SELECT c_custkey AS player_id, c_name || ' Jr' AS player_name, CASE WHEN c_custkey % 31 < 30 THEN {teams.FIRST_TEAM_ID} + c_custkey % 31 ELSE 0 END AS team_id,
  CASE WHEN c_custkey % 3 = 1 THEN 'out' ELSE 'questionable' END AS status, c_mktsegment AS injury_description,
  CASE WHEN c_custkey % 4 = 0 THEN '2024-02-01' ELSE '2024-01-1' || CAST(c_custkey % 10 AS VARCHAR) END AS report_date FROM customer WHERE c_custkey % 3 <> 0""",
)
def injury_feed(spark, sf_dir):
    k = F.col(_CUST)
    codes = F.array(*[F.lit(t) for t in [*_TRICODES, "???"]])
    statuses = F.array(F.lit(""), F.lit("Out"), F.lit("Game Time Decision"))
    player = F.struct(
        k.alias("personId"), F.col("c_name").alias("firstName"), F.lit("Jr").alias("lastName"),
        F.element_at(statuses, (1 + k % 3).cast("int")).alias("injuryStatus"), F.col("c_mktsegment").alias("comment"),
        F.when(k % 4 == 0, "soon").otherwise(F.concat(F.lit("2024-01-1"), (k % 10).cast("string"))).alias("reportDate"),
    )
    team = F.struct(F.element_at(codes, (1 + k % 31).cast("int")).alias("teamTricode"), F.array(player).alias("players"))
    feed = b.table(spark, sf_dir, "customer").select(
        F.to_json(F.struct(F.struct(F.array(team).alias("teams")).alias("league"))).alias("document")
    )
    out = payloads.injury_reports(feed, "document", teams.team_dimension(spark), F.lit(dt.date(2024, 2, 1)))
    return out.withColumn("report_date", F.col("report_date").cast("string"))


_TEAM_VALUES = ", ".join(f"({teams.FIRST_TEAM_ID + i}, '{t[0]}')" for i, t in enumerate(teams.TEAMS))


@query(
    "matchups",
    "P05 P04 P07 P10 S14",
    f"""WITH t AS (SELECT * FROM (VALUES {_TEAM_VALUES}) v(id, ab))
SELECT o_orderkey AS game_id, coalesce(a.ab, 'UNK') || ' @ ' || coalesce(h.ab, 'UNK') AS matchup, CAST(o_custkey % 60 > o_orderkey % 60 AS INTEGER) AS win, o_custkey % 60 - o_orderkey % 60 AS margin,
  o_custkey % 60 + o_orderkey % 60 AS total, round(abs((o_orderkey % 97) / 97.0::DOUBLE - 0.5) * 2, 3) AS confidence
FROM orders LEFT JOIN t h ON h.id = {teams.FIRST_TEAM_ID} + o_custkey % 32 LEFT JOIN t a ON a.id = {teams.FIRST_TEAM_ID} + o_orderkey % 33""",
)
def matchups(spark, sf_dir):
    names = teams.team_dimension(spark).select("team_id", "abbreviation")
    games = b.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("game_id"),
        (teams.FIRST_TEAM_ID + F.col("o_custkey") % 32).alias("home_team_id"),
        (teams.FIRST_TEAM_ID + F.col("o_orderkey") % 33).alias("away_team_id"),
        (F.col("o_custkey") % 60).alias("h"), (F.col("o_orderkey") % 60).alias("a"),
        (F.col("o_orderkey") % 97 / 97.0).alias("p"),
    )
    # the dimension is the literal list of teams.py
    for side in ("home", "away"):
        games = games.join(
            F.broadcast(names.select(F.col("team_id").alias(f"{side}_team_id"), F.col("abbreviation").alias(f"{side}_code"))),
            f"{side}_team_id", "left",
        )
    code = lambda s: F.coalesce(f"{s}_code", F.lit("UNK"))
    return games.select(
        "game_id", F.concat(code("away"), F.lit(" @ "), code("home")).alias("matchup"),
        (F.col("h") > F.col("a")).cast("int").alias("win"), (F.col("h") - F.col("a")).alias("margin"),
        (F.col("h") + F.col("a")).alias("total"), F.round(misc.prediction_confidence(F.col("p")), 3).alias("confidence"),
    )


# --- joins and sets ---

@query(
    "season_facts",
    "J01 J05 A31",
    b.with_ctes(b.GAMES_SQL)
    + """SELECT season_id, count(*) AS line_count, count(DISTINCT game_id) AS games_with_lines, round(sum(l_quantity), 4) AS quantity
FROM lineitem JOIN games ON game_id = l_orderkey WHERE game_id IN (SELECT game_id FROM games WHERE status = 'completed') GROUP BY 1""",
)
def season_facts(spark, sf_dir):
    games = b.games(spark, sf_dir)
    done = games.filter("status = 'completed'").select("game_id")
    lines = b.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("game_id"), "l_quantity")
    # one row per game before the season level, so no season key is shuffled raw
    per_game = lines.groupBy("game_id").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"))
    kept = per_game.join(done, "game_id", "left_semi").join(games.select("game_id", "season_id"), "game_id")
    return kept.groupBy("season_id").agg(
        F.sum("n").alias("line_count"), F.count(F.lit(1)).alias("games_with_lines"),
        F.round(F.sum("q"), 4).alias("quantity"),
    )


@query(
    "bucketed_season_facts",
    "J01 W23",
    b.with_ctes(b.GAMES_SQL)
    + """SELECT season_id, count(*) AS line_count, count(DISTINCT game_id) AS games_with_lines, round(sum(l_quantity), 4) AS quantity
FROM lineitem JOIN games ON game_id = l_orderkey WHERE status = 'completed' GROUP BY 1""",
)
def bucketed_season_facts(spark, sf_dir):
    """The facts of each season from tables stored in the same buckets of game_id."""
    root = _folder(spark)
    lines = b.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("game_id"), F.col("l_linenumber").alias("event_num"), "l_quantity")
    games = b.games(spark, sf_dir).filter("status = 'completed'").select("game_id", "season_id")
    facts = maintenance.join_stored(
        maintenance.store_bucketed(lines, f"{root}/lines", "game_id", ["event_num"]),
        maintenance.store_bucketed(games, f"{root}/games", "game_id", []), "game_id",
    )
    # a game lies in one bucket, so its lines are added up before anything moves
    per_game = facts.groupBy("game_id", "season_id").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"))
    return per_game.groupBy("season_id").agg(
        F.sum("n").alias("line_count"), F.count(F.lit(1)).alias("games_with_lines"), F.round(F.sum("q"), 4).alias("quantity")
    )


@query(
    "season_distinct_sketches",
    "A31",
    b.with_ctes(b.GAMES_SQL)
    + "SELECT season_id, count(DISTINCT game_id) AS games, true AS close FROM lineitem JOIN games ON game_id = l_orderkey GROUP BY 1",
)
def season_distinct_sketches(spark, sf_dir):
    """Games with lines per season, exactly and from the stored sketches of seven loads."""
    lines = b.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("game_id"), F.col("l_linenumber").alias("load"))
    rows = lines.join(b.games(spark, sf_dir).select("game_id", "season_id"), "game_id")
    path = _folder(spark)
    quality.distinct_sketches(rows, ["season_id", "load"], "game_id").write.parquet(path)
    told = quality.distinct_estimates(quality.merged_sketches(spark.read.parquet(path), ["season_id"]), ["season_id"])
    exact = rows.select("season_id", "game_id").distinct().groupBy("season_id").agg(F.count(F.lit(1)).alias("games"))
    near = F.abs(F.col("estimate") - F.col("games")) <= 0.03 * F.col("games")
    return exact.join(told, "season_id").select("season_id", "games", near.alias("close"))


@query(
    "orphan_rows",
    "J03",
    """SELECT 'orders_customer' AS "check", count(*) AS orphans FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0)
UNION ALL SELECT 'lines_supplier', count(*) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 7 <> 0)
UNION ALL SELECT 'lines_part', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)
UNION ALL SELECT 'lines_order', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)""",
)
def orphan_rows(spark, sf_dir):
    t = lambda n: b.table(spark, sf_dir, n)
    return quality.orphans({
        "orders_customer": (t("orders"), "o_custkey", t("customer").filter("c_custkey % 10 <> 0"), "c_custkey"),
        "lines_supplier": (t("lineitem"), "l_suppkey", t("supplier").filter("s_suppkey % 7 <> 0"), "s_suppkey"),
        "lines_part": (t("lineitem"), "l_partkey", t("part"), "p_partkey"),
        "lines_order": (t("lineitem"), "l_orderkey", t("orders"), "o_orderkey"),
    })


@query(
    "new_games",
    "J04 U02 Z01 Z02 N01",
    b.with_ctes(b.GAMES_SQL)
    + """, stored AS (SELECT game_id, game_date FROM games WHERE game_date < DATE '2001-06-01' OR game_id % 5 = 0)
SELECT game_id, CAST(game_date AS VARCHAR) AS game_date FROM games WHERE status = 'completed' AND game_date >= (SELECT max(game_date) - 60 FROM stored) AND game_id NOT IN (SELECT game_id FROM stored)""",
)
def new_games(spark, sf_dir):
    from courtline.streaming.increments import unprocessed

    games = b.games(spark, sf_dir)
    stored = games.filter((F.col("game_date") < F.lit(dt.date(2001, 6, 1))) | (F.col("game_id") % 5 == 0))
    since = stored.agg(F.date_sub(F.max("game_date"), 60)).scalar()
    fresh = games.filter("status = 'completed'").filter(F.col("game_date") >= since)
    return unprocessed(fresh, stored).select("game_id", _day("game_date"))


# --- maintenance ---

@query(
    "upserted_orders",
    "K01 K02",
    """WITH fresh AS (SELECT o_custkey AS k, arg_max(o_totalprice, o_orderkey) AS v FROM orders WHERE o_custkey % 2 = 0 GROUP BY 1)
SELECT coalesce(k, c_custkey) AS customer_id, coalesce(v, c_acctbal) AS amount FROM customer FULL JOIN fresh ON k = c_custkey""",
)
def upserted_orders(spark, sf_dir):
    existing = b.table(spark, sf_dir, "customer").select(
        F.col(_CUST).alias("customer_id"), F.col("c_acctbal").alias("amount"), F.lit(-1).cast("bigint").alias("version")
    )
    new = b.table(spark, sf_dir, "orders").filter("o_custkey % 2 = 0").select(
        F.col("o_custkey").alias("customer_id"), F.col("o_totalprice").alias("amount"), F.col("o_orderkey").alias("version")
    )
    return maintenance.upsert(existing, new, ["customer_id"], ["version"]).select("customer_id", "amount")


# --- quality ---

def _quality_tables(spark, sf_dir):
    li = b.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("game_id"), "l_linestatus", "l_returnflag")
    games = b.games(spark, sf_dir).filter("game_id % 50 <> 0")
    return games, li, li.filter("l_linestatus = 'F'"), li.filter("l_returnflag <> 'N'"), li.filter("l_returnflag = 'A'")


@query(
    "game_validation",
    "C01",
    """WITH g AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 50 <> 0),
c AS (SELECT l_orderkey AS id, count(*) AS p, count(*) FILTER (l_linestatus = 'F') AS t, count(*) FILTER (l_returnflag <> 'N') AS b, count(*) FILTER (l_returnflag = 'A') AS s FROM lineitem GROUP BY 1),
j AS (SELECT coalesce(g.id, c.id) AS id, g.id IS NOT NULL AS k, coalesce(p, 0) AS p, coalesce(t, 0) AS t, coalesce(b, 0) AS b, coalesce(s, 0) AS s FROM g FULL JOIN c ON g.id = c.id)
SELECT id AS game_id, CAST(k AND p > 0 AND t >= 2 AS INTEGER) AS valid,
  concat_ws(';', CASE WHEN NOT k THEN 'game not found' END, CASE WHEN k AND p = 0 THEN 'no play-by-play data' END, CASE WHEN k AND t < 2 THEN 'missing team box scores' END) AS errors,
  concat_ws(';', CASE WHEN k AND p > 0 AND p < 3 THEN 'low play count' END, CASE WHEN k AND p > 6 THEN 'high play count' END, CASE WHEN k AND b < 2 THEN 'low player stats count' END, CASE WHEN k AND s = 0 THEN 'no shot data' END) AS warnings FROM j""",
)
def game_validation(spark, sf_dir):
    out = quality.validate_games(*_quality_tables(spark, sf_dir), plays_range=(3, 6), min_player_rows=2)
    return out.select(
        "game_id", F.col("valid").cast("int").alias("valid"),
        F.array_join("errors", ";").alias("errors"), F.array_join("warnings", ";").alias("warnings"),
    )


@query(
    "season_validation",
    "C02 A31",
    b.with_ctes(b.GAMES_SQL)
    + """, s AS (SELECT DISTINCT season_id FROM games UNION ALL SELECT '2030-31'),
c AS (SELECT season_id, count(*) AS n, count(*) FILTER (game_id IN (SELECT l_orderkey FROM lineitem)) AS p, count(*) FILTER (game_id IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F')) AS t FROM games WHERE game_id % 50 <> 0 GROUP BY 1)
SELECT s.season_id, CASE WHEN n IS NULL THEN 'no games' ELSE '' END AS errors,
  concat_ws(';', CASE WHEN n < 1000 THEN 'only ' || n || ' games' END, CASE WHEN p < n THEN (n - p) || ' games missing play-by-play data' END, CASE WHEN t < n THEN (n - t) || ' games missing box scores' END) AS warnings
FROM s LEFT JOIN c ON c.season_id = s.season_id""",
)
def season_validation(spark, sf_dir):
    games, plays, box, _, _ = _quality_tables(spark, sf_dir)
    seasons = b.games(spark, sf_dir).select("season_id").distinct().union(
        spark.range(1).select(F.lit("2030-31").alias("season_id"))
    )
    out = quality.validate_seasons(seasons, quality.season_coverage(games, plays, box))
    return out.select(
        "season_id", F.array_join("errors", ";").alias("errors"), F.array_join("warnings", ";").alias("warnings")
    )


@query(
    "missing_fields",
    "C03",
    """SELECT entity, game_id, rule, 'error' AS severity, count(*) AS row_count FROM (
  SELECT 'plays' AS entity, CAST(l_orderkey AS VARCHAR) AS game_id, 'missing event_num' AS rule FROM lineitem WHERE l_linenumber = 4
  UNION ALL SELECT 'shots', CAST(nullif(l_orderkey, 17) AS VARCHAR), 'missing player_id' FROM lineitem WHERE l_suppkey = 0
  UNION ALL SELECT 'shots', NULL, 'missing game_id' FROM lineitem WHERE l_orderkey = 17
  UNION ALL SELECT 'shots', '0', 'missing game_id' FROM lineitem WHERE l_orderkey = 0
  UNION ALL SELECT 'plays', '0', 'missing game_id' FROM lineitem WHERE l_orderkey = 0
  UNION ALL SELECT 'game_stats', '0', 'missing game_id' FROM orders WHERE o_orderkey = 0
  UNION ALL SELECT 'game_stats', CAST(o_orderkey AS VARCHAR), 'missing team_id' FROM orders WHERE o_custkey % 30 = 0
  UNION ALL SELECT 'player_game_stats', '0', 'missing game_id' FROM orders WHERE o_orderkey = 0
  UNION ALL SELECT 'player_game_stats', CAST(o_orderkey AS VARCHAR), 'missing player_id' FROM orders WHERE o_custkey = 0) GROUP BY ALL""",
)
def missing_fields(spark, sf_dir):
    li, o = b.table(spark, sf_dir, "lineitem"), b.table(spark, sf_dir, "orders")
    k = F.col("l_orderkey")
    found = quality.missing_fields({
        "plays": li.select(k.alias("game_id"), F.nullif("l_linenumber", F.lit(4)).alias("event_num")),
        "shots": li.select(F.nullif(k, F.lit(17).cast("bigint")).alias("game_id"), F.col("l_suppkey").alias("player_id")),
        "game_stats": o.select(F.col("o_orderkey").alias("game_id"), (F.col("o_custkey") % 30).alias("team_id")),
        "player_game_stats": o.select(F.col("o_orderkey").alias("game_id"), F.col("o_custkey").alias("player_id")),
    })
    return found.groupBy(*found.columns).agg(F.count(F.lit(1)).alias("row_count"))


@query(
    "stint_problems",
    "W19",
    b.with_ctes(b.PLAYS_SQL)
    + """, s AS (SELECT DISTINCT game_id, clock_left AS a, clock_left + 40 AS z FROM plays),
w AS (SELECT *, lead(a) OVER (PARTITION BY game_id ORDER BY a, z) AS nx FROM s)
SELECT game_id, a AS start_sec, z AS end_sec, 'overlaps next stint' AS problem FROM w WHERE z > nx
UNION ALL SELECT game_id, a, z, 'away lineup is not five' FROM w WHERE a % 3 = 0""",
)
def stint_problems(spark, sf_dir):
    s = b.plays(spark, sf_dir).select(
        "game_id", F.col("clock_left").cast("bigint").alias("start_sec"), (F.col("clock_left") + 40).cast("bigint").alias("end_sec")
    ).distinct()
    five = F.sequence(F.lit(1), F.lit(5))
    out = quality.stint_problems(
        s.withColumns({"home_lineup": five, "away_lineup": F.when(F.col("start_sec") % 3 != 0, five).otherwise(F.slice(five, 1, 4))})
    )
    return out


@query(
    "table_statistics",
    "A30",
    "\nUNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS rows, {f'CAST(CAST(min({d}) AS DATE) AS VARCHAR)' if d else 'NULL'} AS first_day, {f'CAST(CAST(max({d}) AS DATE) AS VARCHAR)' if d else 'NULL'} AS last_day FROM {t}"
        for t, d in [("customer", None), ("events", "ts"), ("lineitem", "l_shipdate"), ("orders", "o_orderdate"), ("part", None)]
    ),
)
def table_statistics(spark, sf_dir):
    names = ["customer", "events", "lineitem", "orders", "part"]
    out = quality.table_statistics(
        {n: b.table(spark, sf_dir, n) for n in names},
        {"events": "ts", "lineitem": "l_shipdate", "orders": "o_orderdate"},
    )
    return out.select("table_name", "rows", _day("first_day"), _day("last_day"))
