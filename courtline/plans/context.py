"""Context features, expected lineups and lineup graphs on orders and supplier."""

from __future__ import annotations

from pyspark.sql import functions as F

from courtline.functions import misc
from courtline.operators import context as ops
from courtline.operators import normalize, schedule
from courtline.operators.ordered import as_of
from courtline.plans import bindings as b
from courtline.plans.registry import query
from courtline.plans.schedule import FLAGS_SQL

METRICS = list(ops.FORM_METRICS.values())
_PRIMES = [7, 11, 13, 17, 19, 23, 29]


def team_stats(spark, sf_dir):
    rows = schedule.team_rows(b.games(spark, sf_dir))
    return rows.select(
        "game_id", "team_id", "season_id", "game_date",
        *[
            (50.0 + F.pmod(F.col("game_id") * p + F.col("team_id"), F.lit(60))).alias(m)
            for m, p in zip(METRICS, _PRIMES)
        ],
    )


_METRIC_LIST = ", ".join(METRICS)
_STATS_SQL = """tr AS (SELECT home_team_id AS team_id, season_id, game_date, game_id, TRUE AS is_home FROM games
  UNION ALL SELECT away_team_id, season_id, game_date, game_id, FALSE FROM games),
ts AS (SELECT *, """ + ", ".join(
    f"CAST(50 + (game_id * {p} + team_id) % 60 AS DOUBLE) AS {m}" for m, p in zip(METRICS, _PRIMES)
) + """ FROM tr),
ss AS (SELECT season_id, """ + ", ".join(f"avg({m}) AS {m}_m, stddev_samp({m}) AS {m}_s" for m in METRICS) + """ FROM ts GROUP BY 1),
td AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY team_id, season_id, game_date ORDER BY game_id DESC) AS rn FROM ts) WHERE rn = 1),
tl AS (SELECT team_id, season_id, game_date, """ + ", ".join(f"lag({m}) OVER w AS {m}" for m in METRICS) + """ FROM td WINDOW w AS (PARTITION BY team_id, season_id ORDER BY game_date)),
form AS (SELECT tr.game_id, tr.team_id, tr.is_home, """ + ", ".join(
    f"coalesce((tl.{m} - {m}_m) / {m}_s, 0) AS {s}_z" for s, m in ops.FORM_METRICS.items()
) + """ FROM tr JOIN tl ON tl.team_id = tr.team_id AND tl.season_id = tr.season_id AND tl.game_date = tr.game_date JOIN ss ON ss.season_id = tr.season_id)"""


def form(spark, sf_dir):
    stats = team_stats(spark, sf_dir)
    return ops.previous_form(
        b.games(spark, sf_dir), stats, normalize.season_stats(stats, "season_id", METRICS)
    )


_Z = [f"{s}_z" for s in ops.FORM_METRICS]


@query(
    "previous_form",
    "J06",
    b.with_ctes(b.GAMES_SQL, _STATS_SQL)
    + "SELECT game_id, team_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in _Z) + " FROM form",
)
def previous_form(spark, sf_dir):
    return form(spark, sf_dir).select("game_id", "team_id", *[F.round(c, 6).alias(c) for c in _Z])


@query(
    "as_of_values",
    "J06",
    """WITH v AS (SELECT * FROM events WHERE event_type = 'view'), p AS (SELECT * FROM events WHERE event_type = 'purchase')
SELECT p.event_id, v.event_id AS seen_event, v.value AS seen_value FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts > v.ts""",
)
def as_of_values(spark, sf_dir):
    e = b.table(spark, sf_dir, "events")
    asks = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    views = e.filter("event_type = 'view'").select(
        F.col("event_id").alias("seen_event"), "user_id", "ts", F.col("value").alias("seen_value")
    )
    out = as_of(
        asks, views, ["user_id"], "ts", "ts", ["seen_event", "seen_value"],
        {"__day": F.to_date("__t")},
    )
    return out.select("event_id", "matched.seen_event", "matched.seen_value")


def ratings(spark, sf_dir):
    players = b.stints(spark, sf_dir).select(
        "season_id", F.explode(F.concat("home_lineup", "away_lineup")).alias("player_id")
    ).distinct().filter("player_id % 13 <> 0")
    o = (F.pmod(F.col("player_id") * 37, F.lit(100)) - 50) / 10.0
    d = (F.pmod(F.col("player_id") * 53, F.lit(80)) - 40) / 10.0
    return players.select("season_id", "player_id", o.alias("orapm"), d.alias("drapm"), (o + d).alias("rapm"))


_RATING_SQL = """mem AS (SELECT game_id, season_id, 'home' AS side, unnest(home_lineup) AS player_id FROM stints
  UNION ALL SELECT game_id, season_id, 'away', unnest(away_lineup) FROM stints),
rs AS (SELECT game_id, side, sum(CASE WHEN player_id % 13 <> 0 THEN ((player_id * 37) % 100 - 50) / 10.0::DOUBLE ELSE 0 END) AS o,
  sum(CASE WHEN player_id % 13 <> 0 THEN ((player_id * 53) % 80 - 40) / 10.0::DOUBLE ELSE 0 END) AS d FROM mem GROUP BY 1, 2)"""


@query(
    "lineup_rating_sums",
    "J12",
    b.with_ctes(b.STINTS_SQL, _RATING_SQL)
    + "SELECT game_id, side, round(o + d, 6) AS rapm_sum, round(o, 6) AS orapm_sum, round(d, 6) AS drapm_sum FROM rs",
)
def lineup_rating_sums(spark, sf_dir):
    out = ops.lineup_rating_sums(b.stints(spark, sf_dir), ratings(spark, sf_dir))
    return out.select("game_id", "side", *[F.round(c, 6).alias(c) for c in ("rapm_sum", "orapm_sum", "drapm_sum")])


def hull_table(spark, sf_dir):
    from courtline.operators.spacing import distinct_lineups

    each = distinct_lineups(b.stints(spark, sf_dir), ["season_id"]).filter(F.col("lineup")[0] % 7 != 0)
    area = F.pmod(F.col("lineup")[0] * 1009, F.lit(60000)).cast("double")
    return each.select("season_id", misc.lineup_hash(F.col("lineup")).alias("lineup_hash"), area.alias("hull_area"))


_HULL_SQL = """hu AS (SELECT game_id, CASE WHEN home_lineup[1] % 7 <> 0 THEN CAST((home_lineup[1] * 1009) % 60000 AS DOUBLE) ELSE 0 END AS home_area,
  CASE WHEN away_lineup[1] % 7 <> 0 THEN CAST((away_lineup[1] * 1009) % 60000 AS DOUBLE) ELSE 0 END AS away_area FROM stints)"""


@query(
    "lineup_hulls",
    "J13",
    b.with_ctes(b.STINTS_SQL, _HULL_SQL) + "SELECT game_id, home_area, away_area FROM hu",
)
def lineup_hulls(spark, sf_dir):
    return ops.lineup_hulls(b.stints(spark, sf_dir), hull_table(spark, sf_dir))


def _context(spark, sf_dir):
    games = b.games(spark, sf_dir)
    lat, lon = b.venue(F.col("venue_team"))
    rest = schedule.context_rest(schedule.day_gaps(schedule.team_days(games)))
    by = ("team_id", "season_id")
    travel = schedule.travel(schedule.team_days(games, by), lat, lon, by=by)
    lineups = b.stints(spark, sf_dir)
    return ops.context_features(
        games, form(spark, sf_dir), rest, travel,
        ops.lineup_rating_sums(lineups, ratings(spark, sf_dir)),
        ops.lineup_hulls(lineups, hull_table(spark, sf_dir)),
    )


def _context_select_sql():
    cols = []
    for s, a in (("home", "h"), ("away", "a")):
        for short in ops.FORM_METRICS:
            cols.append(f"round(f{a}.{short}_z, 6) AS {s}_{short}_z")
        cols.append(f"round(g{a} / 7, 6) AS {s}_rest_days")
        cols.append(f"CAST(g{a} <= 1 AS INTEGER)::DOUBLE AS {s}_back_to_back")
        cols.append(f"round(least(t{a} / 5000, 1), 6) AS {s}_travel_miles")
        cols.append(f"round((r{a}.o + r{a}.d) / 10, 6) AS {s}_rapm_sum")
        cols.append(f"round(r{a}.o / 10, 6) AS {s}_orapm_sum")
        cols.append(f"round(r{a}.d / 10, 6) AS {s}_drapm_sum")
        cols.append(f"round({s}_area / 50000, 6) AS {s}_spacing_area")
    cols += [
        "round((gh - ga) / 7, 6) AS rest_diff",
        "round((rh.o + rh.d - ra.o - ra.d) / 10, 6) AS rapm_diff",
        "0.0::DOUBLE AS is_playoff", "0.0::DOUBLE AS is_neutral_site",
    ]
    return ", ".join(cols)


_SEASON_TRAVEL_SQL = """sdays AS (SELECT * FROM (SELECT team_id, season_id, game_date, game_id, venue, CAST(date_diff('day', DATE '1970-01-01', game_date) AS INTEGER) AS d,
    CASE WHEN venue % 50 <> 0 THEN CAST(25 AS DOUBLE) + CAST((venue * 7) % 240 AS DOUBLE) / 10 END AS lat,
    CASE WHEN venue % 50 <> 0 THEN -(CAST(70 AS DOUBLE) + CAST((venue * 13) % 520 AS DOUBLE) / 10) END AS lon,
    row_number() OVER (PARTITION BY team_id, season_id, game_date ORDER BY game_id, is_home) AS rn
  FROM (SELECT home_team_id AS team_id, season_id, game_date, game_id, TRUE AS is_home, home_team_id AS venue FROM games
    UNION ALL SELECT away_team_id, season_id, game_date, game_id, FALSE, home_team_id FROM games)) WHERE rn = 1),
sknown AS (SELECT team_id, season_id, d, lag(d) OVER w AS pd, lat, lon, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM sdays WHERE lat IS NOT NULL
  WINDOW w AS (PARTITION BY team_id, season_id ORDER BY d)),
slegs AS (SELECT team_id, season_id, d, pd, 2 * 3958.7613::DOUBLE * asin(sqrt(pow(sin((radians(lat) - radians(plat)) / 2), 2) +
    cos(radians(plat)) * cos(radians(lat)) * pow(sin((radians(lon) - radians(plon)) / 2), 2))) AS miles FROM sknown WHERE pd IS NOT NULL),
strav AS (SELECT x.team_id, x.season_id, x.game_date, round(coalesce(sum(l.miles), 0), 1) AS miles FROM sdays x LEFT JOIN slegs l
  ON l.team_id = x.team_id AND l.season_id = x.season_id AND l.d <= x.d AND l.pd > x.d - 7 GROUP BY 1, 2, 3),
gap AS (SELECT team_id, game_date, CAST(coalesce(least(7, d - pd), 3) AS DOUBLE) AS g FROM flags)"""


@query(
    "context_features",
    "C04 J06 J07 J12 J13 W05 W08",
    b.with_ctes(b.GAMES_SQL, b.STINTS_SQL, _STATS_SQL, FLAGS_SQL, _SEASON_TRAVEL_SQL, _RATING_SQL, _HULL_SQL)
    + f"""SELECT game_id, {_context_select_sql()} FROM (
  SELECT g.game_id, home_team_id, away_team_id, gh.g AS gh, ga.g AS ga, th.miles AS th, ta.miles AS ta
  FROM games g JOIN gap gh ON gh.team_id = home_team_id AND gh.game_date = g.game_date JOIN gap ga ON ga.team_id = away_team_id AND ga.game_date = g.game_date
  JOIN strav th ON th.team_id = home_team_id AND th.season_id = g.season_id AND th.game_date = g.game_date
  JOIN strav ta ON ta.team_id = away_team_id AND ta.season_id = g.season_id AND ta.game_date = g.game_date) g
JOIN form fh ON fh.game_id = g.game_id AND fh.is_home JOIN form fa ON fa.game_id = g.game_id AND NOT fa.is_home
JOIN rs rh ON rh.game_id = g.game_id AND rh.side = 'home' JOIN rs ra ON ra.game_id = g.game_id AND ra.side = 'away' JOIN hu ON hu.game_id = g.game_id""".replace(
        "SELECT game_id, round", "SELECT g.game_id, round"
    ),
)
def context_features(spark, sf_dir):
    out = _context(spark, sf_dir)
    return out.select("game_id", *[F.round(c, 6).alias(c) for c in ops.CONTEXT_FEATURES])


@query(
    "context_vectors",
    "P08 P09",
    b.with_ctes(b.STINTS_SQL, _RATING_SQL, _HULL_SQL)
    + """, v AS (SELECT h.game_id, (rh.o + rh.d) / 10 AS x, h.home_area / 50000 AS y FROM hu h JOIN rs rh ON rh.game_id = h.game_id AND rh.side = 'home'),
s AS (SELECT avg(x) AS mx, stddev_samp(x) AS sx FROM v)
SELECT game_id, round((x - mx) / sx, 6) AS first, round(y, 6) AS second, 0.0::DOUBLE AS third, 4::BIGINT AS size FROM v, s""",
)
def context_vectors(spark, sf_dir):
    lineups = b.stints(spark, sf_dir)
    sums = ops.lineup_rating_sums(lineups, ratings(spark, sf_dir)).filter("side = 'home'")
    rows = ops.lineup_hulls(lineups, hull_table(spark, sf_dir)).join(sums, "game_id").select(
        "game_id", (F.col("rapm_sum") / 10.0).alias("x"), (F.col("home_area") / 50000.0).alias("y")
    )
    mean, spread = rows.agg(F.avg("x")).scalar(), rows.agg(F.stddev_samp("x")).scalar()
    fitted = rows.withColumns({"m": mean, "s": spread})
    scaled = fitted.withColumns(
        {"x": misc.standardise(F.col("x"), F.col("m"), F.col("s")), "word": F.lit("not a number")}
    )
    vector = misc.numeric_vector([F.col("x"), F.col("y"), F.col("word")], 4)
    return scaled.select("game_id", vector.alias("v")).select(
        "game_id", F.round(F.col("v")[0], 6).alias("first"), F.round(F.col("v")[1], 6).alias("second"),
        F.col("v")[2].alias("third"), F.size("v").cast("bigint").alias("size"),
    )


def opening(spark, sf_dir):
    known = b.stints(spark, sf_dir).filter("game_id % 3 <> 0").withColumns(
        {"period": F.lit(1), "start_sec": F.lit(0)}
    )
    return ops.first_stints(known)


@query(
    "expected_lineups",
    "N01 N05",
    b.with_ctes(b.GAMES_SQL, b.STINTS_SQL)
    + """, tr AS (SELECT g.game_id, g.game_date, home_team_id AS team_id, 'home' AS side, CASE WHEN g.game_id % 3 <> 0 THEN home_lineup END AS lineup FROM games g JOIN stints s ON s.game_id = g.game_id
  UNION ALL SELECT g.game_id, g.game_date, away_team_id, 'away', CASE WHEN g.game_id % 3 <> 0 THEN away_lineup END FROM games g JOIN stints s ON s.game_id = g.game_id),
kd AS (SELECT team_id, game_date, arg_max(lineup, game_id) AS lineup FROM tr WHERE lineup IS NOT NULL GROUP BY 1, 2)
SELECT t.game_id, t.team_id, t.side, coalesce(t.lineup, kd.lineup) AS lineup FROM tr t ASOF LEFT JOIN kd ON kd.team_id = t.team_id AND t.game_date > kd.game_date""",
)
def expected_lineups(spark, sf_dir):
    return ops.expected_lineups(b.games(spark, sf_dir), opening(spark, sf_dir))


@query(
    "lineup_names",
    "N05",
    b.with_ctes(b.LINEUPS_SQL)
    + """, m AS (SELECT lineup_id, unnest(lineup) + 3 AS p FROM lineups)
SELECT lineup_id AS game_id, 'home' AS side, list(coalesce(s_name, 'Player ' || CAST(p AS VARCHAR)) ORDER BY p) AS names
FROM m LEFT JOIN supplier ON s_suppkey = p GROUP BY 1""",
)
def lineup_names(spark, sf_dir):
    lineups = b.lineups(spark, sf_dir).select(
        F.col("lineup_id").alias("game_id"), F.lit("home").alias("side"),
        F.transform("lineup", lambda p: p + 3).alias("lineup"),
    )
    players = b.table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("player_id"), F.col("s_name").alias("full_name")
    )
    return ops.lineup_names(lineups, players)


def matchups(spark, sf_dir):
    return b.lineups(spark, sf_dir).select(
        F.col("lineup_id").alias("game_id"), F.col("lineup").alias("home_lineup"),
        F.transform("lineup", lambda p: p + 10).alias("away_lineup"),
    )


@query(
    "graph_edges",
    "J17",
    b.with_ctes(b.LINEUPS_SQL)
    + """, n AS (SELECT lineup_id, list_concat(lineup, list_transform(lineup, lambda x: x + 10)) AS n FROM lineups)
SELECT lineup_id AS game_id, CAST(i AS INTEGER) AS src, CAST(j AS INTEGER) AS dst, n[i + 1] AS source, n[j + 1] AS target,
  coalesce(CASE WHEN n[j + 1] = n[i + 1] + 3 THEN s_acctbal / 1000 END, 0) AS weight
FROM n, (SELECT unnest(range(10)) AS i) a, (SELECT unnest(range(10)) AS j) c LEFT JOIN supplier ON s_suppkey = n[i + 1] WHERE i <> j""",
)
def graph_edges(spark, sf_dir):
    chemistry = b.table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("source"), (F.col("s_suppkey") + 3).alias("target"),
        (F.col("s_acctbal") / 1000).alias("weight"),
    )
    return ops.graph_edges(matchups(spark, sf_dir), chemistry).select(
        "game_id", "src", "dst", "source", "target", "weight"
    )


_NODE_SQL = """SELECT lineup_id AS game_id, CAST(node - 1 AS INTEGER) AS node, n[node] AS player_id,
  CASE WHEN k THEN (p % 50) / 10.0::DOUBLE ELSE 0 END AS orapm, CASE WHEN k THEN -(p % 30) / 10.0::DOUBLE ELSE 0 END AS drapm,
  CASE WHEN k THEN (p % 50) / 10.0::DOUBLE - (p % 30) / 10.0::DOUBLE ELSE 0 END AS total_rapm,
  CASE WHEN k THEN round((70 + p % 20 - 79) / 3.5::DOUBLE, 6) ELSE 0 END AS height, CASE WHEN k THEN round((180 + p % 80 - 215) / 25.0::DOUBLE, 6) ELSE 0 END AS weight,
  CAST(k AND p % 6 = 0 AS INTEGER)::DOUBLE AS pos_pg, CAST(k AND p % 6 = 1 AS INTEGER)::DOUBLE AS pos_sg, CAST(NOT k OR p % 6 IN (2, 5) AS INTEGER)::DOUBLE AS pos_sf,
  CAST(k AND p % 6 = 3 AS INTEGER)::DOUBLE AS pos_pf, CAST(k AND p % 6 = 4 AS INTEGER)::DOUBLE AS pos_c, 0.45::DOUBLE AS fg_pct, 0.35::DOUBLE AS fg3_pct,
  CASE WHEN k THEN (p % 100) / 100.0::DOUBLE ELSE 0.75::DOUBLE END AS ft_pct, round(20 / 48.0::DOUBLE, 6) AS mpg, 0.2::DOUBLE AS usg_pct, CAST(node <= 5 AS INTEGER)::DOUBLE AS is_home
FROM (SELECT *, n[node] AS p, n[node] IN (SELECT s_suppkey FROM supplier) AS k FROM (SELECT lineup_id, list_concat(lineup, list_transform(lineup, lambda x: x + 10)) AS n FROM lineups), (SELECT unnest(range(1, 11)) AS node))"""


@query("graph_nodes", "J18", b.with_ctes(b.LINEUPS_SQL) + _NODE_SQL)
def graph_nodes(spark, sf_dir):
    k = F.col("s_suppkey")
    place = F.array(*[F.lit(p) for p in ("pg", "SG", "SF", "PF", "C", "??")])
    players = b.table(spark, sf_dir, "supplier").select(
        k.alias("player_id"), (k % 50 / 10.0).alias("orapm"), (-(k % 30) / 10.0).alias("drapm"),
        (70 + k % 20).alias("height_inches"), (180 + k % 80).alias("weight_lbs"),
        F.element_at(place, (1 + k % 6).cast("int")).alias("position"),
        F.lit(None).cast("double").alias("fg_pct"), F.lit(None).cast("double").alias("fg3_pct"),
        (k % 100 / 100.0).alias("ft_pct"), F.lit(None).cast("double").alias("mpg"),
        F.lit(None).cast("double").alias("usg_pct"),
    )
    out = ops.graph_nodes(matchups(spark, sf_dir), players)
    return out.withColumns({c: F.round(c, 6) for c in ("height", "weight", "mpg")})
