"""Descriptions, shot clock, stints and sequences on events; text rules on documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from courtline.functions import clock, misc, text
from courtline.operators import plays as ops
from courtline.operators import stints as st
from courtline.plans import bindings as b
from courtline.plans.registry import query

LEVELS = ["day"]


def _chain_sql(rules, body, default):
    arms = " ".join(f"WHEN regexp_matches({body}, '{p}', 'i') THEN '{v}'" for p, v in rules)
    return f"CASE {arms} ELSE '{default}' END"


def _flag_sql(pattern, body):
    return f"CAST(regexp_matches({body}, '{pattern}', 'i') AS INTEGER)"


def _classes(d):
    turnover, shot = text.turnover_context(d), text.shot_context(d)
    return [
        turnover["turnover_type"].alias("turnover_type"),
        turnover["is_steal"].cast("int").alias("is_steal"),
        turnover["handler_error"].cast("int").alias("handler_error"),
        shot["shot_type"].alias("shot_type"),
        shot["is_transition"].cast("int").alias("is_transition"),
        shot["is_contested"].cast("int").alias("is_contested"),
        shot["is_assisted"].cast("int").alias("is_assisted"),
    ]


def _classes_sql(body):
    return f"""{_chain_sql(text.TURNOVER_RULES, body, 'unknown')} AS turnover_type, {_flag_sql(text.STEAL, body)} AS is_steal,
  {_flag_sql(text.HANDLER_ERROR, body)} AS handler_error, {_chain_sql(text.SHOT_RULES, body, 'other')} AS shot_type,
  {_flag_sql(text.TRANSITION, body)} AS is_transition, {_flag_sql(text.CONTESTED, body)} AS is_contested,
  {_flag_sql(text.ASSISTED, body)} AS is_assisted"""


@query(
    "play_descriptions",
    "X01 X02 X03 X04 X05 X06",
    b.with_ctes(b.PLAYS_SQL)
    + f"""SELECT game_id, event_num, d AS combined_description, {_classes_sql('d')}
FROM (SELECT game_id, event_num, concat_ws(' | ', nullif(home_description, ''), nullif(away_description, ''), nullif(neutral_description, '')) AS d FROM plays)""",
)
def play_descriptions(spark, sf_dir):
    parsed = ops.parse_descriptions(b.plays(spark, sf_dir))
    return parsed.select(
        "game_id", "event_num", "combined_description", *_classes(F.col("combined_description"))
    )


@query(
    "document_text_rules",
    "X02 X03 X04 X05",
    f"SELECT doc_id, {_classes_sql('text')} FROM documents",
)
def document_text_rules(spark, sf_dir):
    docs = b.table(spark, sf_dir, "documents")
    return docs.select("doc_id", *_classes(F.col("text")))


@query(
    "game_clock",
    "X07 X12 X13 X14 X16",
    b.with_ctes(b.PLAYS_SQL)
    + """, c AS (SELECT *, CAST(split_part(pc_time, ':', 1) AS INTEGER) * 60 + CAST(split_part(pc_time, ':', 2) AS INTEGER) AS s FROM plays)
SELECT game_id, event_num, CAST(CASE WHEN period <= 4 THEN period * 720 - s ELSE 2880 + (period - 4) * 300 - s END AS INTEGER) AS elapsed,
  round((greatest(0, 4 - period) * 720 + s) / 2880.0::DOUBLE, 6) AS time_remaining,
  CAST(CASE WHEN event_type BETWEEN 0 AND 14 THEN event_type ELSE 14 END AS INTEGER) AS event_token,
  CASE WHEN player1_id > 0 THEN player1_id % 9999 + 1 ELSE 0 END AS player_bucket,
  round((coalesce(score_home, 0) - coalesce(score_away, 0)) / 8.5::DOUBLE, 6) AS score_diff FROM c""",
)
def game_clock(spark, sf_dir):
    return b.plays(spark, sf_dir).select(
        "game_id", "event_num",
        clock.elapsed_seconds(F.col("period"), F.col("pc_time")).cast("int").alias("elapsed"),
        F.round(clock.time_remaining(F.col("period"), F.col("pc_time")), 6).alias("time_remaining"),
        misc.event_token(F.col("event_type")).alias("event_token"),
        misc.player_bucket(F.col("player1_id")).alias("player_bucket"),
        F.round(clock.score_difference(F.col("score_home"), F.col("score_away")), 6).alias("score_diff"),
    )


@query(
    "shot_clock",
    "W10",
    b.with_ctes(b.PLAYS_SQL)
    + """, t AS (SELECT *, clock_left AS t, CASE WHEN event_type IN (1, 3, 4, 5) THEN clock_left END AS st FROM plays),
u AS (SELECT *, greatest(0, last_value(st IGNORE NULLS) OVER w - t) AS used, last_value(st IGNORE NULLS) OVER w AS s
  FROM t WINDOW w AS (PARTITION BY game_id, period ORDER BY event_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT game_id, event_num, CASE WHEN event_type NOT IN (1, 2) OR s IS NULL THEN 'unknown' WHEN used < 8 THEN 'early'
  WHEN used <= 16 THEN 'mid' ELSE 'late' END AS shot_clock_category FROM u""",
)
def shot_clock(spark, sf_dir):
    out = ops.shot_clock(b.plays(spark, sf_dir), LEVELS)
    return out.select("game_id", "event_num", "shot_clock_category")


# --- stints ---

STINT_SQL = """sec AS (SELECT *, CAST(CASE WHEN period <= 4 THEN period * 720 - clock_left ELSE 2880 + (period - 4) * 300 - clock_left END AS INTEGER) AS sec FROM plays),
seen AS (SELECT game_id, team_id, player1_id AS player_id, min(event_num) AS fe FROM plays WHERE period = 1 AND player1_id <> 0 GROUP BY 1, 2, 3),
starters AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY game_id, team_id ORDER BY fe) AS rn FROM seen) WHERE rn <= 5),
subs AS (SELECT * FROM sec WHERE event_type = 8 AND player1_id <> 0 AND player2_id <> 0),
cuts AS (SELECT game_id, sec AS cut, min(event_num) AS ev, arg_min(period, event_num) AS period, arg_min(pc_time, event_num) AS pc FROM subs GROUP BY 1, 2
  UNION ALL SELECT game_id, -1, min(event_num), 1, '12:00' FROM plays GROUP BY 1),
fin AS (SELECT game_id, max(event_num) AS ev, arg_max(sec, event_num) AS sec, arg_max(pc_time, event_num) AS pc FROM sec GROUP BY 1),
spans AS (
  SELECT c.game_id, row_number() OVER w - 1 AS stint_no, c.period, c.cut, greatest(c.cut, 0) AS start_sec, c.ev AS start_event, c.pc AS start_time,
    coalesce(lead(c.cut) OVER w, fin.sec) AS end_sec, coalesce(lead(c.ev) OVER w, fin.ev) AS end_event, coalesce(lead(c.pc) OVER w, fin.pc) AS end_time
  FROM cuts c JOIN fin ON fin.game_id = c.game_id WINDOW w AS (PARTITION BY c.game_id ORDER BY c.cut)),
edits AS (
  SELECT game_id, team_id, player2_id AS player_id, sec, event_num * 2 AS o, 0 AS is_in FROM subs
  UNION ALL SELECT game_id, team_id, player1_id, sec, event_num * 2 + 1, 1 FROM subs
  UNION ALL SELECT game_id, team_id, player_id, -1, -1, 1 FROM starters),
state AS (
  SELECT s.game_id, s.stint_no, e.team_id, e.player_id, arg_max(e.is_in, (e.sec::BIGINT + 10) * 1000000000000 + e.o) AS on_court
  FROM spans s JOIN edits e ON e.game_id = s.game_id AND e.sec <= s.cut GROUP BY 1, 2, 3, 4),
lineups AS (SELECT game_id, stint_no, team_id, list_sort(list(player_id)) AS lineup FROM state WHERE on_court = 1 GROUP BY 1, 2, 3),
teams AS (SELECT DISTINCT game_id, home_team_id, away_team_id FROM plays),
full_games AS (SELECT game_id FROM starters GROUP BY 1 HAVING count(*) = 10),
val AS (
  SELECT game_id, event_num, CASE WHEN coalesce(home_description, '') <> '' THEN p ELSE 0 END AS hp, CASE WHEN coalesce(home_description, '') <> '' THEN 0 ELSE p END AS ap, q
  FROM (SELECT game_id, event_num, home_description,
    CASE WHEN event_type = 1 THEN CASE WHEN contains(upper(coalesce(home_description, '') || coalesce(away_description, '')), '3PT') THEN 3 ELSE 2 END
      WHEN event_type = 3 AND NOT contains(upper(coalesce(home_description, '') || coalesce(away_description, '')), 'MISS') THEN 1 ELSE 0 END AS p,
    CASE event_type WHEN 1 THEN 100 WHEN 2 THEN 100 WHEN 3 THEN 44 WHEN 5 THEN 100
      WHEN 4 THEN CASE WHEN contains(upper(coalesce(home_description, '') || coalesce(away_description, '')), 'OFF') THEN -100 ELSE 0 END ELSE 0 END AS q FROM plays)),
stints AS (
  SELECT s.game_id, s.stint_no, any_value(s.period) AS period, any_value(start_sec) AS start_sec, any_value(end_sec) AS end_sec,
    any_value(start_time) AS start_time, any_value(end_time) AS end_time, any_value(h.lineup) AS home_lineup, any_value(a.lineup) AS away_lineup,
    CAST(sum(hp) AS BIGINT) AS home_points, CAST(sum(ap) AS BIGINT) AS away_points, greatest(0, sum(q)) / 100.0::DOUBLE AS possessions
  FROM spans s JOIN full_games f ON f.game_id = s.game_id JOIN teams t ON t.game_id = s.game_id
    JOIN lineups h ON h.game_id = s.game_id AND h.stint_no = s.stint_no AND h.team_id = home_team_id AND len(h.lineup) = 5
    JOIN lineups a ON a.game_id = s.game_id AND a.stint_no = s.stint_no AND a.team_id = away_team_id AND len(a.lineup) = 5
    JOIN val v ON v.game_id = s.game_id AND v.event_num BETWEEN s.start_event AND s.end_event
  WHERE start_sec < end_sec GROUP BY 1, 2)"""


@query(
    "starting_five",
    "W22",
    b.with_ctes(b.PLAYS_SQL, STINT_SQL)
    + """SELECT s.game_id, CASE WHEN team_id = home_team_id THEN 'home' ELSE 'away' END AS side, list_sort(list(player_id)) AS players
FROM starters s JOIN teams t ON t.game_id = s.game_id GROUP BY 1, 2""",
)
def starting_five(spark, sf_dir):
    return st.starting_five(b.plays(spark, sf_dir)).groupBy("game_id", "side").agg(
        F.sort_array(F.collect_list("player_id")).alias("players")
    )


@query(
    "stint_lineups",
    "W20 W21",
    b.with_ctes(b.PLAYS_SQL, STINT_SQL)
    + """SELECT l.game_id, CASE WHEN team_id = home_team_id THEN 'home' ELSE 'away' END AS side, stint_no, lineup
FROM lineups l JOIN teams t ON t.game_id = l.game_id""",
)
def stint_lineups(spark, sf_dir):
    plays = b.plays(spark, sf_dir)
    return st.stint_lineups(plays, st.stint_spans(plays)).select(
        "game_id", "side", F.col("stint_no").cast("bigint").alias("stint_no"), "lineup"
    )


@query(
    "derived_stints",
    "W23 J10 A14 A15 F06",
    b.with_ctes(b.PLAYS_SQL, STINT_SQL)
    + """SELECT game_id, stint_no, CAST(period AS INTEGER) AS period, start_sec, end_sec, start_time, end_time, end_sec - start_sec AS duration_seconds,
  home_lineup, away_lineup, home_points, away_points, round(possessions, 6) AS possessions FROM stints""",
)
def derived_stints(spark, sf_dir):
    out = st.derive_stints(b.plays(spark, sf_dir), LEVELS)
    return out.withColumn("stint_no", F.col("stint_no").cast("bigint")).withColumn(
        "possessions", F.round("possessions", 6)
    ).drop("start_clock", "end_clock")


LINEUP_AT_SQL = """clocked AS (SELECT *, CAST(split_part(start_time, ':', 1) AS INTEGER) * 60 + CAST(split_part(start_time, ':', 2) AS INTEGER) AS sc,
  CAST(split_part(end_time, ':', 1) AS INTEGER) * 60 + CAST(split_part(end_time, ':', 2) AS INTEGER) AS ec FROM stints),
hit AS (SELECT p.game_id, p.event_num, arg_min(home_lineup, stint_no) AS h, arg_min(away_lineup, stint_no) AS a
  FROM plays p JOIN clocked c ON c.game_id = p.game_id AND c.period = p.period AND p.clock_left BETWEEN ec AND sc GROUP BY 1, 2)"""


@query(
    "lineups_at_plays",
    "J09",
    b.with_ctes(b.PLAYS_SQL, STINT_SQL, LINEUP_AT_SQL)
    + """SELECT p.game_id, p.event_num, coalesce(h, [0, 0, 0, 0, 0]::BIGINT[]) AS home_five, coalesce(a, [0, 0, 0, 0, 0]::BIGINT[]) AS away_five
FROM plays p LEFT JOIN hit ON hit.game_id = p.game_id AND hit.event_num = p.event_num""",
)
def lineups_at_plays(spark, sf_dir):
    plays = b.plays(spark, sf_dir)
    stints = st.derive_stints(plays, LEVELS)
    return ops.lineups_at_plays(plays, stints).select("game_id", "event_num", "home_five", "away_five")


_SAMPLE_SQL = """idx AS (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY event_num) - 1 AS r, count(*) OVER (PARTITION BY game_id) AS n FROM plays),
kept AS (SELECT idx.* FROM idx WHERE n <= 50 OR r IN (SELECT CASE WHEN i = 49 THEN n - 1 ELSE CAST(floor(i * ((n - 1) / 49.0::DOUBLE)) AS BIGINT) END FROM (SELECT unnest(range(50)) AS i)))"""


@query(
    "even_sample",
    "W18",
    b.with_ctes(b.PLAYS_SQL, _SAMPLE_SQL) + "SELECT game_id, event_num, r + 1 AS seq FROM kept",
)
def even_sample(spark, sf_dir):
    return ops.even_sample(b.plays(spark, sf_dir), LEVELS).select("game_id", "event_num", "seq")


@query(
    "token_sequences",
    "X15 X14 S18",
    b.with_ctes(b.PLAYS_SQL, STINT_SQL, LINEUP_AT_SQL, _SAMPLE_SQL)
    + """, ff AS (SELECT game_id, event_num, last_value(score_home IGNORE NULLS) OVER w AS sh, last_value(score_away IGNORE NULLS) OVER w AS sa
  FROM plays WINDOW w AS (PARTITION BY game_id ORDER BY event_num ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
tok AS (SELECT k.game_id, k.event_num, k.event_type AS e, round((greatest(0, 4 - k.period) * 720 + k.clock_left) / 2880.0::DOUBLE, 6) AS t,
  round((coalesce(sh, 0) - coalesce(sa, 0)) / 8.5::DOUBLE, 6) AS s,
  list_concat(coalesce(h, [0, 0, 0, 0, 0]::BIGINT[]), coalesce(a, [0, 0, 0, 0, 0]::BIGINT[])) AS p
  FROM kept k JOIN ff ON ff.game_id = k.game_id AND ff.event_num = k.event_num LEFT JOIN hit ON hit.game_id = k.game_id AND hit.event_num = k.event_num)
SELECT game_id, array_to_string(list(e ORDER BY event_num), ',') || repeat(',0', 50 - CAST(count(*) AS INTEGER)) AS events,
  round(sum(t), 4) AS time_sum, round(list(t ORDER BY event_num)[1], 6) AS first_time, round(list(s ORDER BY event_num)[CAST(count(*) AS INTEGER)], 6) AS last_score,
  array_to_string(flatten(list(p ORDER BY event_num)), ',') AS players, 50 - count(*) AS masked FROM tok GROUP BY game_id""",
)
def token_sequences(spark, sf_dir):
    plays = b.plays(spark, sf_dir)
    out = ops.token_sequences(plays, st.derive_stints(plays, LEVELS), LEVELS)
    used = F.size(F.filter("mask", lambda m: ~m))
    rounded = F.transform("time", lambda t: F.round(t, 6))
    return out.select(
        "game_id",
        F.array_join(F.transform("event", lambda e: e.cast("string")), ",").alias("events"),
        F.round(F.aggregate(rounded, F.lit(0.0), lambda a, x: a + x), 4).alias("time_sum"),
        F.round(F.col("time")[0], 6).alias("first_time"),
        F.round(F.element_at("score", used), 6).alias("last_score"),
        F.array_join(
            F.transform(F.flatten(F.slice("players", 1, used)), lambda p: p.cast("string")), ","
        ).alias("players"),
        F.size(F.filter("mask", lambda m: m)).cast("bigint").alias("masked"),
    )


NAMES = ["Adams", "Baker", "Clark", "Davis", "Evans"]


@query(
    "player_references",
    "S06",
    b.with_ctes(b.PLAYS_SQL)
    + """, dim AS (SELECT nm AS name, min(c_custkey) AS id FROM (SELECT (['Adams', 'baker', 'Clark', 'Davis', 'Evans'])[1 + c_custkey % 5] AS nm, c_custkey FROM customer) GROUP BY 1),
body AS (SELECT game_id, event_num, CASE WHEN event_num % 3 = 0 THEN NULL ELSE player1_id END AS p1, player2_id AS p2, coalesce(home_description, away_description) AS d FROM plays),
ref AS (SELECT game_id, event_num, p1, p2, regexp_extract(d, '\\((?:Assist|AST):\\s*([A-Z][a-z]+)\\)', 1) AS a, regexp_extract(d, '\\((?:Block|BLK):\\s*([A-Z][a-z]+)\\)', 1) AS bl,
  regexp_extract(d, '\\((?:Steal|STL):\\s*([A-Z][a-z]+)\\)', 1) AS s, regexp_extract(d, 'SUB:\\s*([A-Z][a-z]+)\\s+FOR\\s+([A-Z][a-z]+)', 1) AS s1,
  regexp_extract(d, 'SUB:\\s*([A-Z][a-z]+)\\s+FOR\\s+([A-Z][a-z]+)', 2) AS s2 FROM body),
ids AS (SELECT r.*, coalesce(x.id, y.id) AS one, z.id AS two FROM ref r
  LEFT JOIN dim x ON lower(x.name) = lower(CASE WHEN a <> '' THEN a WHEN bl <> '' THEN bl WHEN s <> '' THEN s END)
  LEFT JOIN dim y ON lower(y.name) = lower(nullif(s1, '')) LEFT JOIN dim z ON lower(z.name) = lower(nullif(s2, '')))
SELECT game_id, event_num, coalesce(p1, one) AS player1_id, CASE WHEN p2 % 5 = 0 THEN CASE WHEN p1 IS NULL THEN two END ELSE p2 END AS player2_id FROM ids""",
)
def player_references(spark, sf_dir):
    raw = b.plays(spark, sf_dir).select(
        "game_id", "event_num", "home_description", "away_description", "neutral_description",
        F.when(F.col("event_num") % 3 != 0, F.col("player1_id")).alias("player1_id"),
        F.when(F.col("player2_id") % 5 != 0, F.col("player2_id")).alias("player2_id"),
        F.lit(None).cast("bigint").alias("player3_id"),
    )
    spelled = F.array(*[F.lit(n if n != "Baker" else "baker") for n in NAMES])
    dim = b.table(spark, sf_dir, "customer").groupBy(
        F.element_at(spelled, (1 + F.col("c_custkey") % 5).cast("int")).alias("name")
    ).agg(F.min("c_custkey").alias("player_id"))
    return ops.resolve_references(raw, dim).select("game_id", "event_num", "player1_id", "player2_id")
