"""Plus-minus ratings on orders and shot spacing on lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from courtline.functions import misc
from courtline.operators import ridge, spacing
from courtline.plans import bindings as b
from courtline.plans.registry import query

LAM, TAU, MIN_MINUTES = 50.0, 180.0, 100.0


def _stints(spark, sf_dir):
    return b.stints(spark, sf_dir)

_EXPOSURE_SQL = """expo AS (SELECT season_id, player_id, sum(duration_seconds) / 60.0::DOUBLE AS minutes, count(*) AS sample_stints
  FROM (SELECT season_id, duration_seconds, unnest(list_concat(home_lineup, away_lineup)) AS player_id FROM stints) GROUP BY 1, 2)"""

_LONG_SQL = """ref AS (SELECT season_id, max(game_date) AS ref FROM stints GROUP BY 1),
base AS (SELECT s.*, CASE WHEN possessions > 0 THEN possessions ELSE 1 END AS poss, exp(-date_diff('day', game_date, ref) / 180.0::DOUBLE) AS decay
  FROM stints s JOIN ref ON ref.season_id = s.season_id),
long AS (
  SELECT season_id, stint_id, unnest(home_lineup) AS player_id, 1 AS value, decay * sqrt(poss) AS w, home_points * 100 / poss AS y_off, -away_points * 100 / poss AS y_def FROM base
  UNION ALL SELECT season_id, stint_id, unnest(away_lineup), -1, decay * sqrt(poss), home_points * 100 / poss, -away_points * 100 / poss FROM base)"""


@query(
    "player_exposure",
    "A03 A04 A05",
    b.with_ctes(b.STINTS_SQL, _EXPOSURE_SQL)
    + "SELECT season_id, player_id, round(minutes, 6) AS minutes, sample_stints FROM expo WHERE minutes >= 100",
)
def player_exposure(spark, sf_dir):
    expo = ridge.player_exposure(b.stints(spark, sf_dir), "season_id")
    kept = ridge.eligible_players(expo, MIN_MINUTES)
    return kept.select("season_id", "player_id", F.round("minutes", 6).alias("minutes"), "sample_stints")


@query(
    "design_matrix",
    "A06 X11",
    b.with_ctes(b.STINTS_SQL, _LONG_SQL)
    + "SELECT season_id, stint_id, player_id, value, round(w, 6) AS w, round(y_off, 6) AS y_off, round(y_def, 6) AS y_def FROM long",
)
def design_matrix(spark, sf_dir):
    m = ridge.design_matrix(b.stints(spark, sf_dir), "season_id", TAU)
    return m.select(
        "season_id", "stint_id", "player_id", "value",
        *[F.round(c, 6).alias(c) for c in ("w", "y_off", "y_def")],
    )


@query(
    "gram_matrix",
    "A07",
    b.with_ctes(b.STINTS_SQL, _LONG_SQL)
    + """SELECT x.season_id, x.player_id AS p, y.player_id AS q, round(sum(x.w * x.value * y.value), 6) AS wvv,
  CAST(sum(x.value * y.value) AS BIGINT) AS vv FROM long x JOIN long y ON x.stint_id = y.stint_id AND x.player_id <= y.player_id GROUP BY 1, 2, 3""",
)
def gram_matrix(spark, sf_dir):
    w = ridge._weighted(_stints(spark, sf_dir), "season_id", TAU)
    g = ridge.gram(w, ["season_id"])
    return g.select("season_id", "p", "q", F.round("wvv", 6).alias("wvv"), F.col("vv").cast("bigint").alias("vv"))


@query("plus_minus_ratings", "A07")
def plus_minus_ratings(spark, sf_dir):
    return ridge.rounded(ridge.fit(_stints(spark, sf_dir), lam=LAM, min_minutes=MIN_MINUTES, tau=TAU))


_RATED_SQL = """rated AS (SELECT season_id, player_id FROM expo WHERE minutes >= 100 AND season_id IN (SELECT season_id FROM stints GROUP BY 1 HAVING count(*) >= 100)
  QUALIFY count(*) OVER (PARTITION BY season_id) >= 10)"""


@query(
    "rating_residuals",
    "A07",
    b.with_ctes(b.STINTS_SQL, _EXPOSURE_SQL, _RATED_SQL)
    + "SELECT season_id, player_id, 0.0::DOUBLE AS off_left, 0.0::DOUBLE AS def_left FROM rated",
)
def rating_residuals(spark, sf_dir):
    stints = _stints(spark, sf_dir)
    ratings = ridge.fit(stints, lam=LAM, min_minutes=MIN_MINUTES, tau=TAU)
    left = ridge.residuals(stints, ratings, lam=LAM, tau=TAU)
    # 0.0 turns a negative zero into a plain one
    return left.select("season_id", "player_id", *((F.round(c, 4) + 0.0).alias(c) for c in ("off_left", "def_left")))


_FOLD_LAMBDAS = ", ".join(f"{x}::DOUBLE" for x in ridge.LAMBDAS)


@query(
    "held_out_errors",
    "A08 J19",
    b.with_ctes(
        b.STINTS_SQL, _EXPOSURE_SQL,
        """y AS (SELECT season_id, CAST(stint_id % 5 AS INTEGER) AS fold, CAST(home_points * 100 AS DOUBLE) / (CASE WHEN possessions > 0 THEN possessions ELSE 1 END) AS y
  FROM stints WHERE season_id IN (SELECT season_id FROM stints GROUP BY 1 HAVING count(*) >= 100) AND season_id IN (SELECT season_id FROM expo WHERE minutes >= 100))""",
    )
    + f"""SELECT season_id, fold, unnest([{_FOLD_LAMBDAS}]) AS lambda, n, sst, true AS agrees
  FROM (SELECT season_id, fold, count(*) AS n, round(sum(y * y) - sum(y) * sum(y) / count(*), 3) AS sst FROM y GROUP BY 1, 2)""",
)
def held_out_errors(spark, sf_dir):
    stints, fold = _stints(spark, sf_dir), F.col("stint_id") % ridge.CV_FOLDS
    errors, beta = ridge.held_out(stints, min_minutes=MIN_MINUTES, tau=TAU, fold=fold)
    direct = ridge.held_out_direct(stints, errors, beta, fold, tau=TAU)
    return errors.join(direct, ["season_id", "fold", "lambda"]).select(
        "season_id", "fold", "lambda", "n", F.round("sst", 3).alias("sst"),
        (F.abs(F.col("sse") - F.col("direct")) <= 1e-9 * F.col("sst")).alias("agrees"),
    )


@query("rating_extremes", "N02")
def rating_extremes(spark, sf_dir):
    return ridge.extremes(plus_minus_ratings(spark, sf_dir))


@query("lambda_scores", "A08 J19")
def lambda_scores(spark, sf_dir):
    return ridge.cross_validate(_stints(spark, sf_dir), min_minutes=MIN_MINUTES, tau=TAU)


@query("best_lambda", "A08 N07")
def best_lambda(spark, sf_dir):
    return ridge.best_lambda(lambda_scores(spark, sf_dir))


# --- spacing ---

_HULL_SQL = """member AS (SELECT lineup_id, lineup, unnest(lineup) AS player_id FROM lineups),
pts AS (SELECT DISTINCT lineup_id, CAST(loc_x AS DOUBLE) AS x, CAST(loc_y AS DOUBLE) AS y FROM member JOIN shots USING (player_id)),
col AS (SELECT lineup_id, x, min(y) AS lo, max(y) AS hi FROM pts GROUP BY 1, 2),
lowv AS (
  SELECT a.lineup_id, a.x, a.lo AS y, min((c.lo - a.lo) / (c.x - a.x)) FILTER (c.x > a.x) AS r, max((c.lo - a.lo) / (c.x - a.x)) FILTER (c.x < a.x) AS l
  FROM col a JOIN col c ON c.lineup_id = a.lineup_id AND c.x <> a.x GROUP BY 1, 2, 3),
upv AS (
  SELECT a.lineup_id, a.x, a.hi AS y, max((c.hi - a.hi) / (c.x - a.x)) FILTER (c.x > a.x) AS r, min((c.hi - a.hi) / (c.x - a.x)) FILTER (c.x < a.x) AS l
  FROM col a JOIN col c ON c.lineup_id = a.lineup_id AND c.x <> a.x GROUP BY 1, 2, 3),
lowh AS (SELECT lineup_id, x, y, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM lowv WHERE r IS NULL OR l IS NULL OR l < r WINDOW w AS (PARTITION BY lineup_id ORDER BY x)),
uph AS (SELECT lineup_id, x, y, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM upv WHERE r IS NULL OR l IS NULL OR l > r WINDOW w AS (PARTITION BY lineup_id ORDER BY x)),
area AS (SELECT lineup_id, sum(s) AS hull FROM (SELECT lineup_id, (nx - x) * (y + ny) / 2 AS s FROM uph WHERE nx IS NOT NULL
  UNION ALL SELECT lineup_id, -(nx - x) * (y + ny) / 2 FROM lowh WHERE nx IS NOT NULL) GROUP BY 1),
mean AS (SELECT lineup_id, avg(loc_x) AS cx, avg(loc_y) AS cy, avg(sqrt(loc_x * loc_x + loc_y * loc_y)) AS d, count(*) AS n,
  avg(CASE WHEN (loc_x < -220 OR loc_x > 220) AND loc_y < 90 THEN 1.0::DOUBLE ELSE 0 END) AS c FROM member JOIN shots USING (player_id) GROUP BY 1),
named AS (SELECT DISTINCT lineup_id, left(sha256(array_to_string(lineup, ',')), 16) AS lineup_hash FROM lineups)"""


@query(
    "lineup_spacing",
    "A09 A10 A11 J11 X08 F05",
    b.with_ctes(b.SHOTS_SQL, b.LINEUPS_SQL, _HULL_SQL)
    + """SELECT DISTINCT lineup_hash, round(hull, 2) AS hull_area, round(cx, 2) AS centroid_x, round(cy, 2) AS centroid_y,
  round(d, 2) AS avg_distance, round(c, 4) AS corner_density, n AS shot_count FROM named JOIN mean USING (lineup_id) JOIN area USING (lineup_id)""",
)
def lineup_spacing(spark, sf_dir):
    summary = spacing.player_summary(b.shots(spark, sf_dir), ["player_id"])
    lineups = b.lineups(spark, sf_dir).select("lineup").distinct()
    return spacing.lineup_spacing(lineups, summary, [])


@query(
    "season_player_hulls",
    "A10 A11",
    b.with_ctes(
        b.SHOTS_SQL,
        "lineups AS (SELECT DISTINCT season * 100000000 + player_id AS lineup_id, [player_id] AS lineup, season FROM shots)",
        _HULL_SQL.replace("member JOIN shots USING (player_id)", "member JOIN shots ON shots.player_id = member.player_id AND shots.season = member.lineup_id // 100000000"),
    )
    + """SELECT lineup_id // 100000000 AS season, lineup_id % 100000000 AS player_id, round(coalesce(hull, 0), 6) AS hull_area, n AS shot_count
FROM mean LEFT JOIN area USING (lineup_id)""",
)
def season_player_hulls(spark, sf_dir):
    shots = b.shots(spark, sf_dir).withColumn("season", F.col("season").cast("bigint"))
    busy = spacing.busy_seasons(shots, "season")
    summary = spacing.player_summary(shots.join(busy, "season", "left_semi"), ["season", "player_id"])
    area = spacing.hull_area(F.col("lower"), F.col("upper"))
    return summary.select(
        "season", "player_id", F.round(area, 6).alias("hull_area"), F.col("n").cast("bigint").alias("shot_count")
    )


@query(
    "distinct_lineups",
    "U01 X09",
    b.with_ctes(b.STINTS_SQL)
    + """SELECT season_id, '[' || array_to_string(lineup, ',') || ']' AS lineup_json, left(sha256(array_to_string(lineup, ',')), 16) AS lineup_hash
FROM (SELECT season_id, home_lineup AS lineup FROM stints UNION SELECT season_id, away_lineup FROM stints)""",
)
def distinct_lineups(spark, sf_dir):
    each = spacing.distinct_lineups(b.stints(spark, sf_dir), ["season_id"])
    text = misc.lineup_to_json(F.col("lineup"))
    back = misc.lineup_from_json(F.col("lineup_json"))
    return each.select("season_id", text.alias("lineup_json")).select(
        "season_id", "lineup_json", misc.lineup_hash(back).alias("lineup_hash")
    )


_DENSITY_SQL = """shape AS (SELECT player_id, count(*) AS n, var_samp(loc_x) AS xx, var_samp(loc_y) AS yy, covar_samp(loc_x, loc_y) AS xy FROM shots GROUP BY 1 HAVING count(*) >= 10),
kern AS (SELECT player_id, n, pow(n, -1.0::DOUBLE / 3) AS f, xx, yy, xy, xx * yy - xy * xy AS det FROM shape),
pt AS (SELECT player_id, loc_x, loc_y, count(*) AS k FROM shots GROUP BY 1, 2, 3),
gx AS (SELECT unnest(range(50)) AS i), gy AS (SELECT unnest(range(50)) AS j),
density AS (
  SELECT pt.player_id, i * 50 + j AS cell, sum(k * exp(-0.5::DOUBLE * (yy * dx * dx - 2 * xy * dx * dy + xx * dy * dy) / det / f)) / any_value(n * 2 * pi() * sqrt(det) * f) AS density
  FROM (SELECT *, -250 + i * (500 / 49.0::DOUBLE) - loc_x AS dx, -50 + j * (450 / 49.0::DOUBLE) - loc_y AS dy FROM pt, gx, gy) pt JOIN kern USING (player_id) GROUP BY 1, 2)"""


@query(
    "shot_density",
    "A12 J19 F05",
    b.with_ctes(b.SHOTS_SQL, _DENSITY_SQL)
    + "SELECT player_id, cell, round(density * 1000, 8) AS density FROM density",
)
def shot_density(spark, sf_dir):
    d = spacing.shot_density(b.shots(spark, sf_dir))
    return d.select("player_id", F.col("cell").cast("bigint").alias("cell"), F.round(F.col("density") * 1000, 8).alias("density"))


@query(
    "gravity_overlap",
    "A13 J16",
    b.with_ctes(b.SHOTS_SQL, b.LINEUPS_SQL, _DENSITY_SQL)
    + """, d2 AS MATERIALIZED (SELECT * FROM density), m AS (SELECT lineup, left(sha256(array_to_string(lineup, ',')), 16) AS h, unnest(lineup) AS p FROM (SELECT DISTINCT lineup FROM lineups)),
mass AS (SELECT player_id, sum(density) AS mass FROM d2 GROUP BY 1),
pr AS (SELECT DISTINCT a.p AS p, c.p AS q FROM m a JOIN m c ON a.h = c.h AND a.p < c.p),
ov AS (SELECT p, q, sum(least(x.density, y.density)) AS o FROM pr JOIN d2 x ON x.player_id = p JOIN d2 y ON y.player_id = q AND y.cell = x.cell GROUP BY 1, 2),
mm AS (SELECT h, avg(mass) AS mass FROM m JOIN mass ON player_id = p GROUP BY 1),
oo AS (SELECT a.h, avg(o) AS o FROM m a JOIN m c ON a.h = c.h AND a.p < c.p JOIN ov ON ov.p = a.p AND ov.q = c.p GROUP BY 1)
SELECT h AS lineup_hash, round(least(o / mass, 1), 6) AS overlap FROM mm JOIN oo USING (h)""",
)
def gravity_overlap(spark, sf_dir):
    density = spacing.density_rows(b.shots(spark, sf_dir))
    lineups = b.lineups(spark, sf_dir).select("lineup").distinct()
    out = spacing.gravity_overlap(lineups, density)
    return out.select("lineup_hash", F.round("overlap", 6).alias("overlap"))
