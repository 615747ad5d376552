"""Injury adjustment, drift, triggers, versions and model metrics."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from courtline.functions import availability as av
from courtline.operators import drift as dr
from courtline.operators import injuries as inj
from courtline.operators import metrics, reports
from courtline.operators import versions as vs
from courtline.plans import bindings as b
from courtline.plans.registry import query
from courtline.plans.sinks import _folder

_r = lambda c, name=None: F.round(c, 6).alias(name or c)

STATUSES = ["Out", "Doubtful ", "questionable", "GTD", "probable", "Game Time Decision - illness", "day-to-day", "available", "o", "unsure", "Active roster"]
INJURIES = ["left ankle sprain", "rest", "Load Management", "knee soreness", "Back spasms", "Illness", "hamstring", "finger", "sprain"]


def injury_reports(spark, sf_dir):
    c = F.col("c_custkey")
    pick = lambda words: F.element_at(F.array(*[F.lit(w) for w in words]), (1 + c % len(words)).cast("int"))
    return b.table(spark, sf_dir, "customer").select(
        c.alias("player_id"), (c % b.TEAMS).alias("team_id"),
        pick(STATUSES).alias("status"), pick(INJURIES).alias("description"),
    )


def _list_sql(words):
    return "([" + ", ".join(f"'{w}'" for w in words) + f"])[1 + c_custkey % {len(words)}]"


_REPORT_SQL = f"""rep AS (SELECT c_custkey AS player_id, c_custkey % {b.TEAMS} AS team_id, {_list_sql(STATUSES)} AS status, {_list_sql(INJURIES)} AS description FROM customer)"""
_PRIOR_SQL = "CASE lower(trim(status)) " + " ".join(f"WHEN '{k}' THEN {v!r}::DOUBLE" for k, v in av.STATUS_PRIORS.items()) + " ELSE 0.55::DOUBLE END"
_MOD_SQL = "CASE " + " ".join(f"WHEN contains(lower(description), '{k}') THEN {v!r}::DOUBLE" for k, v in av.INJURY_MODIFIERS.items()) + " ELSE 1.0::DOUBLE END"
_NORMAL_SQL = "CASE " + " ".join(f"WHEN lower(trim(status)) = '{k}' THEN '{v}'" for k, v in av.STATUS_EXACT.items()) + " " + " ".join(
    f"WHEN contains(lower(trim(status)), '{k}') THEN '{v}'" for k, v in av.STATUS_CONTAINED
) + " ELSE 'questionable' END"
_HISTORY_SQL = """hist AS (SELECT player_id, count(*) AS n, avg(minutes) AS m FROM (
  SELECT o_custkey AS player_id, CAST(o_totalprice / 15000 AS DOUBLE) AS minutes, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders) WHERE rn <= 82 GROUP BY 1)"""
_PROB_SQL = f"""prob AS (SELECT rep.*, {_PRIOR_SQL} AS prior, {_NORMAL_SQL} AS normal,
  greatest(0, least(1, {_PRIOR_SQL} * {_MOD_SQL} * CASE WHEN n >= 20 AND m > 32 THEN 1.1::DOUBLE WHEN n >= 20 AND m < 20 THEN 0.9::DOUBLE ELSE 1 END)) AS p
  FROM rep LEFT JOIN hist ON hist.player_id = rep.player_id)"""


def history(spark, sf_dir):
    rows = b.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("player_id"), "o_orderkey", (F.col("o_totalprice") / 15000).alias("minutes")
    )
    return inj.history_modifiers(rows, ["o_orderkey"])


def probabilities(spark, sf_dir):
    return inj.play_probabilities(injury_reports(spark, sf_dir), history(spark, sf_dir))


@query(
    "play_probabilities",
    "A38 X29 X30",
    b.with_ctes(_REPORT_SQL, _HISTORY_SQL, _PROB_SQL)
    + "SELECT player_id, normal AS normal_status, round(prior, 6) AS prior_probability, round(p, 6) AS play_probability FROM prob",
)
def play_probabilities(spark, sf_dir):
    return probabilities(spark, sf_dir).select(
        "player_id", av.normal_status(F.col("status")).alias("normal_status"),
        _r("prior_probability"), _r("play_probability"),
    )


def player_ratings(spark, sf_dir):
    rows = b.table(spark, sf_dir, "orders").filter("o_custkey % 17 <> 0").select(
        F.col("o_custkey").alias("player_id"), F.to_date("o_orderdate").alias("calculation_date"),
        "o_orderkey", (F.sqrt(F.pmod(F.col("o_orderkey") * 31, F.lit(100)) + 0.5) - 5.0).alias("rapm"),
    )
    return inj.latest_ratings(rows, ["calculation_date", "o_orderkey"])


_RATING_SQL = "rat AS (SELECT o_custkey AS player_id, arg_max(sqrt((o_orderkey * 31) % 100 + 0.5::DOUBLE) - 5, (date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)))::HUGEINT * 1000000000000 + o_orderkey) AS rapm FROM orders WHERE o_custkey % 17 <> 0 GROUP BY 1)"


@query(
    "latest_ratings",
    "J08 X31",
    b.with_ctes(_RATING_SQL)
    + """SELECT c_custkey AS player_id, round(coalesce(rapm, 0), 6) AS rapm, round((coalesce(rapm, 0) + 2) * 0.003, 6) AS impact,
  78 + 0 * coalesce(c_nationkey, 0) AS height_inches FROM customer LEFT JOIN rat ON player_id = c_custkey""",
)
def latest_ratings(spark, sf_dir):
    players = b.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("player_id"))
    joined = players.join(player_ratings(spark, sf_dir), "player_id", "left")
    return joined.select(
        "player_id", _r(F.coalesce("rapm", F.lit(0.0)), "rapm"),
        _r(av.replacement_impact(F.col("rapm")), "impact"), F.lit(78).alias("height_inches"),
    )


@query(
    "injury_adjustment",
    "C13 X31 S16 P06",
    b.with_ctes(b.GAMES_SQL, _REPORT_SQL, _HISTORY_SQL, _PROB_SQL, _RATING_SQL)
    + """, t AS (SELECT team_id, sum(-(1 - p) * (coalesce(rapm, 0) + 2) * 0.003::DOUBLE) AS w, sum(-(1 - p) * coalesce(rapm, 0) * 0.5::DOUBLE) AS pts,
  least(1, 10 * sqrt(sum(p * (1 - p) * pow((coalesce(rapm, 0) + 2) * 0.003::DOUBLE, 2)))) AS u FROM prob LEFT JOIN rat ON rat.player_id = prob.player_id GROUP BY 1),
g AS (SELECT game_id, 0.05::DOUBLE + 0.9::DOUBLE * (game_id * 7 % 101) / 100.0::DOUBLE AS hp, (game_id % 81 - 40)::DOUBLE AS pm, (165 + game_id % 120)::DOUBLE AS pt,
  coalesce(h.w, 0) - coalesce(a.w, 0) AS s, coalesce(h.pts, 0) + coalesce(a.pts, 0) AS pp, (coalesce(h.u, 0) + coalesce(a.u, 0)) / 2 AS u, h.team_id IS NOT NULL OR a.team_id IS NOT NULL AS rep
  FROM games LEFT JOIN t h ON h.team_id = home_team_id LEFT JOIN t a ON a.team_id = away_team_id)
SELECT game_id, round(CASE WHEN rep THEN greatest(0.01::DOUBLE, least(0.99::DOUBLE, hp + s)) ELSE hp END, 6) AS home_win_prob_adjusted,
  round(CASE WHEN rep THEN greatest(-35, least(35, pm + s * 30)) ELSE pm END, 6) AS predicted_margin_adjusted,
  round(CASE WHEN rep THEN greatest(175, least(270, pt + pp)) ELSE pt END, 6) AS predicted_total_adjusted, round(u, 6) AS injury_uncertainty FROM g""",
)
def injury_adjustment(spark, sf_dir):
    games = b.games(spark, sf_dir).select(
        "game_id", "home_team_id", "away_team_id",
        (0.05 + 0.9 * (F.col("game_id") * 7 % 101) / 100.0).alias("home_win_prob"),
        (F.col("game_id") % 81 - 40.0).alias("predicted_margin"),
        (165.0 + F.col("game_id") % 120).alias("predicted_total"),
    )
    teams = inj.team_expectations(probabilities(spark, sf_dir), player_ratings(spark, sf_dir))
    out = inj.adjust_predictions(games, teams)
    return out.select("game_id", *[_r(c) for c in (
        "home_win_prob_adjusted", "predicted_margin_adjusted", "predicted_total_adjusted", "injury_uncertainty")])


def player_games(spark, sf_dir):
    return b.stints(spark, sf_dir).select(
        "game_id", F.explode(F.concat("home_lineup", "away_lineup")).alias("player_id")
    ).select(
        "game_id", "player_id", F.floor(F.col("player_id") / 10).alias("team_id"),
        (5.0 + F.pmod(F.col("game_id") * 3 + F.col("player_id"), F.lit(35))).alias("minutes"),
    )


_PG_SQL = """pg AS (SELECT game_id, player_id, player_id // 10 AS team_id, CAST(5 + (game_id * 3 + player_id) % 35 AS DOUBLE) AS minutes
  FROM (SELECT game_id, unnest(list_concat(home_lineup, away_lineup)) AS player_id FROM stints)),
mem AS (SELECT game_id, 'home' AS side, home_lineup AS lineup, unnest(home_lineup) AS player_id FROM stints
  UNION ALL SELECT game_id, 'away', away_lineup, unnest(away_lineup) FROM stints),
unc AS (SELECT m.*, p FROM mem m JOIN prob ON prob.player_id = m.player_id WHERE lower(status) IN ('questionable', 'doubtful', 'probable', 'gtd') AND p < 0.99),
recent AS (SELECT * FROM (SELECT player_id, game_id, team_id, row_number() OVER (PARTITION BY player_id ORDER BY game_id DESC) AS rn FROM pg) WHERE rn <= 10),
cand AS (SELECT r.player_id, g.player_id AS c, max(g.minutes) AS m FROM recent r JOIN pg g ON g.game_id = r.game_id AND g.team_id = r.team_id WHERE g.minutes > 10 GROUP BY 1, 2),
best AS (SELECT u.game_id, u.player_id, arg_max(c, m * 100000 - c) AS sub FROM unc u JOIN cand ON cand.player_id = u.player_id WHERE NOT list_contains(u.lineup, c) GROUP BY 1, 2)"""


@query(
    "best_replacements",
    "N06",
    b.with_ctes(b.STINTS_SQL, _REPORT_SQL, _HISTORY_SQL, _PROB_SQL, _PG_SQL)
    + "SELECT game_id, player_id, sub AS replacement_id FROM best",
)
def best_replacements(spark, sf_dir):
    sides = F.explode(F.array("home_lineup", "away_lineup")).alias("lineup")
    members = b.stints(spark, sf_dir).select("game_id", sides).select(
        "game_id", "lineup", F.explode("lineup").alias("player_id")
    )
    doubtful = probabilities(spark, sf_dir).filter(
        F.lower("status").isin(av.UNCERTAIN_STATUSES) & (F.col("play_probability") < 0.99)
    ).select("player_id")
    wanted = inj.listed(members, doubtful).select("game_id", "player_id", "lineup")
    return inj.best_replacements(wanted, player_games(spark, sf_dir), ["game_id"])


@query(
    "two_scenario_adjustment",
    "C14 F04 N06",
    b.with_ctes(b.STINTS_SQL, _REPORT_SQL, _HISTORY_SQL, _PROB_SQL, _RATING_SQL, _PG_SQL)
    + """, base AS (SELECT game_id, sum(CASE side WHEN 'home' THEN 1 ELSE -1 END * coalesce(rapm, 0)) AS mg, sum(coalesce(rapm, 0)) AS st FROM mem LEFT JOIN rat ON rat.player_id = mem.player_id GROUP BY 1),
d AS (SELECT u.game_id, p, CASE u.side WHEN 'home' THEN 1 ELSE -1 END * (coalesce(rs.rapm, 0) - coalesce(rp.rapm, 0)) AS dm, coalesce(rs.rapm, 0) - coalesce(rp.rapm, 0) AS ds
  FROM unc u LEFT JOIN best ON best.game_id = u.game_id AND best.player_id = u.player_id LEFT JOIN rat rs ON rs.player_id = sub LEFT JOIN rat rp ON rp.player_id = u.player_id),
c AS (SELECT game_id, sum((1 - p) * dm) AS dm, sum((1 - p) * ds) AS ds, sum(p * (1 - p) * pow(dm * 0.003::DOUBLE, 2)) AS v FROM d GROUP BY 1)
SELECT game_id, round(greatest(0.01::DOUBLE, least(0.99::DOUBLE, 0.5 + 0.003 * (mg + c.dm))), 6) AS home_win_prob_adjusted,
  round(greatest(-35, least(35, mg + c.dm)), 6) AS predicted_margin_adjusted, round(greatest(175, least(270, 220 + 0.5 * (st + c.ds))), 6) AS predicted_total_adjusted,
  round(least(1, 5 * sqrt(v)), 6) AS injury_uncertainty FROM c JOIN base USING (game_id)""",
)
def two_scenario_adjustment(spark, sf_dir):
    out = inj.two_scenario_adjustment(
        b.stints(spark, sf_dir).select("game_id", "home_lineup", "away_lineup"),
        probabilities(spark, sf_dir), player_games(spark, sf_dir), ["game_id"],
        inj.linear_scorer(player_ratings(spark, sf_dir)),
    )
    return out.select("game_id", *[_r(c) for c in out.columns if c != "game_id"])


# --- drift ---

FEATURES = ["l_quantity", "l_discount", "l_extendedprice", "rising", "constant"]


def _samples(spark, sf_dir):
    rows = b.table(spark, sf_dir, "lineitem").select(
        "l_quantity", "l_discount", "l_extendedprice", F.to_date("l_shipdate").alias("day"),
        (F.col("l_quantity") + 3 * (F.year("l_shipdate") - 1995)).alias("rising"),
        F.lit(1.0).alias("constant"),
    )
    cut = F.lit(dt.date(1998, 6, 1))
    return rows.filter(F.col("day") < cut), rows.filter(F.col("day") >= cut)


def _long_sql(where_ref, where_rec, source):
    parts = []
    for f in FEATURES:
        expr = {"rising": "l_quantity + 3 * (year(l_shipdate) - 1995)", "constant": "1.0::DOUBLE"}.get(f, f)
        parts.append(f"SELECT '{f}' AS feature, CAST({expr} AS DOUBLE) AS v, {where_ref} AS is_ref FROM {source} WHERE ({where_ref}) OR ({where_rec})")
    return "long AS (" + " UNION ALL ".join(parts) + ")"


_CUT = "CAST(l_shipdate AS DATE) < DATE '1998-06-01'"
_DRIFT_SQL = """n AS (SELECT feature, count(*) FILTER (is_ref) AS n1, count(*) FILTER (NOT is_ref) AS n2 FROM long GROUP BY 1),
vc AS (SELECT feature, v, count(*) FILTER (is_ref) AS a, count(*) FILTER (NOT is_ref) AS b FROM long GROUP BY 1, 2),
cu AS (SELECT feature, v, sum(a) OVER w AS ca, sum(b) OVER w AS cb FROM vc WINDOW w AS (PARTITION BY feature ORDER BY v)),
ks AS (SELECT cu.feature, max(abs(ca / n1::DOUBLE - cb / n2::DOUBLE)) AS d, any_value(sqrt(n1::DOUBLE * n2 / (n1 + n2))) AS en FROM cu JOIN n USING (feature) GROUP BY 1),
kp AS (SELECT feature, d, CASE WHEN d * en < 0.2 THEN 1 ELSE greatest(0, least(1, (SELECT sum(CASE WHEN k % 2 = 1 THEN 2 ELSE -2 END * exp(-2.0::DOUBLE * k * k * d * d * en * en)) FROM (SELECT unnest(range(1, 101)) AS k)))) END AS p FROM ks),
q AS (SELECT feature, list_distinct(quantile_cont(v, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1])) AS e0 FROM long WHERE is_ref GROUP BY 1),
mm AS (SELECT feature, min(v) AS lo, max(v) AS hi FROM long GROUP BY 1),
ed AS (SELECT feature, CASE WHEN len(e0) < 3 THEN list_transform(range(11), lambda i: lo + (hi - lo) * i / 10) ELSE list_sort(e0) END AS e FROM q JOIN mm USING (feature)),
bn AS (SELECT feature, least(len(list_filter(e, lambda x: x <= v)), len(e) - 1) AS slot, sum(a) AS a, sum(b) AS b FROM vc JOIN ed USING (feature) WHERE v >= e[1] AND v <= e[len(e)] GROUP BY 1, 2),
ps AS (SELECT feature, sum((y - x) * ln(y / x)) AS psi FROM (SELECT feature, greatest(1e-10::DOUBLE, a / n1::DOUBLE) AS x, greatest(1e-10::DOUBLE, b / n2::DOUBLE) AS y FROM bn JOIN n USING (feature)) GROUP BY 1),
drift AS (SELECT feature, d AS ks_stat, p AS p_value, psi, p < 0.05 OR psi > 0.2 AS drifted FROM kp JOIN ps USING (feature))"""
_DRIFT_OUT = "SELECT feature, round(ks_stat, 6) AS ks_stat, round(p_value, 6) AS p_value, round(psi, 6) AS psi, CAST(drifted AS INTEGER) AS is_drifted FROM drift"


def _drift_out(df):
    return df.select("feature", _r("ks_stat"), _r("p_value"), _r("psi"), F.col("is_drifted").cast("int").alias("is_drifted"))


@query(
    "feature_drift",
    "A32 A33 A34",
    b.with_ctes(_long_sql(_CUT, f"NOT ({_CUT})", "lineitem"), _DRIFT_SQL) + _DRIFT_OUT,
)
def feature_drift(spark, sf_dir):
    return _drift_out(dr.drift_check(*_samples(spark, sf_dir), [*FEATURES, "absent"]))


def _segments(spark, sf_dir):
    """Balances of two market segments, a sample pair per nation."""
    rows = b.table(spark, sf_dir, "customer").filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))
    return rows.select(
        F.col("c_nationkey").cast("string").alias("feature"), F.col("c_acctbal").cast("double").alias("value"),
        (F.col("c_mktsegment") == "BUILDING").cast("int").alias("r"),
    )


@query(
    "exact_drift_p_values",
    "A33",
    """WITH RECURSIVE v AS (SELECT CAST(c_nationkey AS VARCHAR) AS feature, CAST(c_acctbal AS DOUBLE) AS x, c_mktsegment = 'BUILDING' AS ref
  FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal IS NOT NULL),
n AS (SELECT feature, count(*) FILTER (ref) AS m, count(*) FILTER (NOT ref) AS n FROM v GROUP BY 1),
c AS (SELECT DISTINCT feature, x, count(*) FILTER (ref) OVER w AS a, count(*) FILTER (NOT ref) OVER w AS b FROM v WINDOW w AS (PARTITION BY feature ORDER BY x)),
k AS (SELECT feature, m, n, max(abs(a * n - b * m)) AS h FROM c JOIN n USING (feature) WHERE m >= 5 AND n >= 5 GROUP BY ALL),
r AS (
  SELECT feature, m, n, h, 0 AS s, list_transform(range(0, m + 1), lambda i: CASE WHEN i = 0 THEN 1.0::DOUBLE ELSE 0 END) AS p FROM k
  UNION ALL
  SELECT feature, m, n, h, s + 1, list_transform(range(0, m + 1), lambda i: CASE WHEN s + 1 - i BETWEEN 0 AND n AND abs(i * n - (s + 1 - i) * m) < h
    THEN coalesce(p[i], 0) * (m - i + 1) / (m + n - s) + p[i + 1] * (n - (s - i)) / (m + n - s) ELSE 0 END) FROM r WHERE s < m + n)
SELECT feature, m AS n_ref, n AS n_rec, round(h / (m::DOUBLE * n), 6) AS ks_stat, round(1 - p[m + 1], 6) AS p_value FROM r WHERE s = m + n""",
)
def exact_drift_p_values(spark, sf_dir):
    return dr.exact_p_values(dr.counted(_segments(spark, sf_dir))).select("feature", "n_ref", "n_rec", _r("ks_stat"), _r("p_value"))


@query(
    "sketched_feature_drift",
    "A32 C20",
    b.with_ctes(_long_sql(_CUT, f"NOT ({_CUT})", "lineitem"))
    + "SELECT feature, count(*) AS n, true AS near FROM long WHERE is_ref AND v IS NOT NULL GROUP BY 1",
)
def sketched_feature_drift(spark, sf_dir):
    """Shares of the reference's bins by its stored sketches, one a year, against its rows."""
    reference, _ = _samples(spark, sf_dir)
    path = _folder(spark)
    dr.reference_sketches(reference.withColumn("load", F.year("day")), ["load"], FEATURES).write.parquet(path)
    bins = dr.sketched_bins(spark.read.parquet(path))
    told = dr.bin_shares(reference, bins, FEATURES)
    near = F.max(F.abs(F.col("expected") - F.col("share"))) <= dr.SHARE_ERROR
    return told.groupBy("feature").agg(near.alias("near")).join(bins.select("feature", "n"), "feature").select("feature", "n", "near")


@query(
    "recent_window_drift",
    "C20 P01 P02",
    b.with_ctes(
        "src AS (SELECT *, date_diff('day', CAST(l_shipdate AS DATE), (SELECT max(CAST(l_shipdate AS DATE)) FROM lineitem)) AS age FROM lineitem)",
        _long_sql("age >= 365 AND age < 730", "age < 365", "src"), _DRIFT_SQL,
    ) + _DRIFT_OUT,
)
def recent_window_drift(spark, sf_dir):
    before, after = _samples(spark, sf_dir)
    return _drift_out(dr.drift_windows(before.unionByName(after), "day", FEATURES, 365))


_CONCEPT_SQL = """cd AS (SELECT avg(CASE WHEN (model_prob >= 0.5) = (result = 'win') THEN 1.0::DOUBLE ELSE 0 END) AS acc,
  avg(pow(model_prob - CASE WHEN result = 'win' THEN 1 ELSE 0 END, 2)) AS br FROM (SELECT * FROM bets ORDER BY bet_date DESC, game_id DESC, line_no DESC, part_id DESC, supplier_id DESC LIMIT 100))"""


def _concept(spark, sf_dir):
    rows = b.bets(spark, sf_dir).withColumns(
        {"prob": F.col("model_prob"), "actual": (F.col("result") == "win").cast("int")}
    )
    return dr.concept_drift(rows, b.BET_ORDER)


@query(
    "concept_drift",
    "A35",
    b.with_ctes(b.BETS_SQL, _CONCEPT_SQL)
    + """SELECT round(acc, 6) AS recent_accuracy, round(br, 6) AS recent_brier_score, CAST(acc < 0.48 AS INTEGER) AS accuracy_degraded,
  CAST(br > 0.35 AS INTEGER) AS calibration_degraded FROM cd""",
)
def concept_drift(spark, sf_dir):
    return _concept(spark, sf_dir).select(
        _r("recent_accuracy"), _r("recent_brier_score"),
        *[F.col(c).cast("int").alias(c) for c in ("accuracy_degraded", "calibration_degraded")],
    )


@query(
    "retrain_triggers",
    "C16",
    b.with_ctes(_long_sql(_CUT, f"NOT ({_CUT})", "lineitem"), _DRIFT_SQL, b.BETS_SQL, b.GAMES_SQL)
    + """, x AS (SELECT (SELECT bool_or(drifted) FROM drift) AS dr,
  (SELECT count(*) >= 50 AND (sum(profit) / sum(bet_amount) < -0.05 OR count(*) FILTER (result = 'win') / count(*) FILTER (result <> 'push')::DOUBLE < 0.48) FROM bets WHERE bet_date >= DATE '2001-01-01') AS pf,
  (SELECT count(*) >= 50 FROM games WHERE status = 'completed' AND game_date > DATE '2001-07-01' AND game_date <= DATE '2001-08-01') AS dt)
SELECT 1 AS scheduled, CAST(dr AS INTEGER) AS drift, CAST(pf AS INTEGER) AS performance, CAST(dt AS INTEGER) AS data, 1 AS should_retrain,
  CASE WHEN dr THEN 'drift_detected' WHEN pf THEN 'performance_degraded' ELSE 'scheduled' END AS reason, CASE WHEN dr OR pf THEN 'high' ELSE 'medium' END AS priority FROM x""",
)
def retrain_triggers(spark, sf_dir):
    drift = dr.drift_check(*_samples(spark, sf_dir), FEATURES)
    recent = b.bets(spark, sf_dir).filter(F.col("bet_date") >= F.lit(dt.date(2001, 1, 1)))
    out = dr.retrain_triggers(
        recent, b.games(spark, sf_dir), drift, dt.date(2001, 7, 1), dt.date(2001, 8, 1)
    )
    flags = ["scheduled", "drift", "performance", "data", "should_retrain"]
    return out.select(*[F.col(c).cast("int").alias(c) for c in flags], "reason", "priority")


@query(
    "health_status",
    "C17",
    b.with_ctes(_long_sql(_CUT, f"NOT ({_CUT})", "lineitem"), _DRIFT_SQL, b.BETS_SQL, _CONCEPT_SQL)
    + """, f AS (SELECT coalesce(list_sort(list(feature) FILTER (drifted)), []) AS fs FROM drift), r AS (SELECT sum(profit) / sum(bet_amount) AS roi FROM bets),
x AS (SELECT fs, len(fs) AS n, acc, br, roi FROM f, cd, r)
SELECT CASE WHEN n >= 3 OR acc < 0.48 OR br > 0.30 THEN 'critical' WHEN n > 0 OR acc < 0.52 OR br > 0.26 THEN 'warning' ELSE 'healthy' END AS status,
  CAST(n > 0 AS INTEGER) AS drift_detected, array_to_string(fs, ',') AS features_drifted, CAST(n > 0 OR acc < 0.48 OR br > 0.28 OR roi < -0.05 AS INTEGER) AS retraining_recommended,
  coalesce(nullif(concat_ws('; ', CASE WHEN n >= 2 THEN printf('Significant covariate drift in %d features', n) WHEN n = 1 THEN 'Covariate drift detected in: ' || fs[1] END,
    CASE WHEN acc < 0.48 THEN printf('Accuracy degraded to %.1f%%', acc * 100) END, CASE WHEN br > 0.28 THEN printf('Calibration degraded (Brier: %.3f)', br) END,
    CASE WHEN roi < -0.05 THEN printf('Negative ROI: %.1f%%', roi * 100) END), ''), 'Model performance within acceptable thresholds') AS recommendation_reason FROM x""",
)
def health_status(spark, sf_dir):
    drift = dr.drift_check(*_samples(spark, sf_dir), FEATURES)
    recent = _concept(spark, sf_dir).select(
        F.col("recent_accuracy").alias("accuracy"), F.col("recent_brier_score").alias("brier_score")
    )
    roi = b.bets(spark, sf_dir).agg(F.sum("profit") / F.sum("bet_amount")).scalar()
    out = reports.health_status(drift, recent.withColumn("roi", roi))
    return out.withColumns({c: F.col(c).cast("int") for c in ("drift_detected", "retraining_recommended")})


# --- model metrics and versions ---

def model_predictions(spark, sf_dir):
    li = b.table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_linenumber").alias("version"), F.year("l_shipdate").alias("fold"),
        (F.col("l_partkey") % 101 / 100.0).alias("win_prob"), (F.col("l_suppkey") % 41 - 20.0).alias("margin"),
        (190.0 + F.col("l_partkey") % 60).alias("total"),
        (F.col("l_returnflag") == "A").cast("int").alias("actual_win"),
        (F.col("l_orderkey") % 51 - 25.0).alias("actual_margin"), (185.0 + F.col("l_orderkey") % 70).alias("actual_total"),
    )


_MODEL_SQL = """mp AS (SELECT l_linenumber AS version, CAST(year(l_shipdate) AS INTEGER) AS fold, CAST(l_partkey % 101 AS DOUBLE) / 100 AS w, l_suppkey % 41 - 20.0::DOUBLE AS m, 190.0::DOUBLE + l_partkey % 60 AS t,
  CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS aw, l_orderkey % 51 - 25.0::DOUBLE AS am, 185.0::DOUBLE + l_orderkey % 70 AS tt FROM lineitem)"""
_LL = "avg(-(aw * ln(least(greatest(w, 1e-7::DOUBLE), 1 - 1e-7::DOUBLE)) + (1 - aw) * ln(1 - least(greatest(w, 1e-7::DOUBLE), 1 - 1e-7::DOUBLE))))"


def _eval_sql(keys, op):
    return f"""SELECT {keys}, count(*) AS games, round(avg(CASE WHEN (w {op} 0.5) = (aw = 1) THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy, round(avg(abs(m - am)), 6) AS margin_mae,
  round(avg(abs(t - tt)), 6) AS total_mae, round(avg(pow(w - aw, 2)), 6) AS brier_score, round({_LL}, 6) AS log_loss FROM mp GROUP BY {keys}"""


def _evaluate(spark, sf_dir, keys, strict):
    out = model_predictions(spark, sf_dir).groupBy(*keys).agg(*metrics.prediction_aggregates(strict))
    return out.select(*keys, "games", *[_r(c) for c in ("accuracy", "margin_mae", "total_mae", "brier_score", "log_loss")])


@query("model_metrics", "A36", b.with_ctes(_MODEL_SQL) + _eval_sql("version, fold", ">"))
def model_metrics(spark, sf_dir):
    return _evaluate(spark, sf_dir, ["version", "fold"], strict=True)


@query("version_metrics", "A37", b.with_ctes(_MODEL_SQL) + _eval_sql("version", ">="))
def version_metrics(spark, sf_dir):
    return _evaluate(spark, sf_dir, ["version"], strict=False)


@query(
    "multitask_loss",
    "A39",
    b.with_ctes(_MODEL_SQL)
    + f"""SELECT version, round(a, 6) AS win_loss, round(h, 6) AS margin_loss, round(g, 6) AS total_loss, round(a + 0.5 * h + 0.25 * g, 6) AS combined_loss FROM (
  SELECT version, {_LL} AS a, avg(CASE WHEN abs(m - am) <= 1 THEN 0.5 * pow(m - am, 2) ELSE abs(m - am) - 0.5 END) AS h,
    avg(CASE WHEN abs(t - tt) <= 1 THEN 0.5 * pow(t - tt, 2) ELSE abs(t - tt) - 0.5 END) AS g FROM mp GROUP BY 1)""",
)
def multitask_loss(spark, sf_dir):
    out = model_predictions(spark, sf_dir).groupBy("version").agg(*metrics.multitask_loss(1.0, 0.5, 0.25))
    return out.select("version", *[_r(c) for c in out.columns if c != "version"])


def model_versions(spark, sf_dir):
    k = F.col("p_partkey")
    return b.table(spark, sf_dir, "part").select(
        k.alias("version"), F.when(k > 0, F.floor(k / 2)).alias("parent_version"),
        F.date_add(F.lit(dt.date(2024, 1, 1)), (k * 7 % 365).cast("int")).alias("created_at"),
    )


def version_values(spark, sf_dir):
    k = F.col("p_partkey")
    metric = F.explode(F.map_from_arrays(
        F.array(*[F.lit(m) for m in ("accuracy", "brier_score", "margin_mae", "loss", "roi")]),
        F.array(
            F.when(k % 4 != 0, 0.5 + k % 3 / 100.0), F.when(k % 5 != 0, 0.2 + k % 7 / 100.0),
            F.when(k % 6 != 0, 9.0 + k % 11 / 10.0), 1.0 + k % 13 / 10.0, F.when(k % 2 == 0, k % 9 / 100.0),
        ),
    )).alias("metric", "value")
    return b.table(spark, sf_dir, "part").select(k.alias("version"), metric).filter("value IS NOT NULL")


def version_pairs(spark, sf_dir):
    return model_versions(spark, sf_dir).filter("parent_version IS NOT NULL").select(
        F.col("parent_version").alias("version_a"), F.col("version").alias("version_b")
    )


_VERSION_SQL = """vm AS (SELECT p_partkey AS version, 'accuracy' AS metric, 0.5::DOUBLE + CAST(p_partkey % 3 AS DOUBLE) / 100 AS value FROM part WHERE p_partkey % 4 <> 0
  UNION ALL SELECT p_partkey, 'brier_score', 0.2::DOUBLE + CAST(p_partkey % 7 AS DOUBLE) / 100 FROM part WHERE p_partkey % 5 <> 0
  UNION ALL SELECT p_partkey, 'margin_mae', 9.0::DOUBLE + CAST(p_partkey % 11 AS DOUBLE) / 10 FROM part WHERE p_partkey % 6 <> 0
  UNION ALL SELECT p_partkey, 'loss', 1.0::DOUBLE + CAST(p_partkey % 13 AS DOUBLE) / 10 FROM part
  UNION ALL SELECT p_partkey, 'roi', CAST(p_partkey % 9 AS DOUBLE) / 100 FROM part WHERE p_partkey % 2 = 0),
pr AS (SELECT p_partkey // 2 AS a, p_partkey AS b FROM part WHERE p_partkey > 0)"""


@query(
    "version_changes",
    "C18 U03",
    b.with_ctes(_VERSION_SQL)
    + """SELECT a AS version_a, b AS version_b, m AS metric, round(CASE WHEN m IN ('brier_score', 'margin_mae', 'loss') THEN -1 ELSE 1 END * (coalesce(y.value, 0) - coalesce(x.value, 0)), 6) AS improvement
FROM pr CROSS JOIN (SELECT DISTINCT metric AS m FROM vm) LEFT JOIN vm x ON x.version = a AND x.metric = m LEFT JOIN vm y ON y.version = b AND y.metric = m WHERE x.value IS NOT NULL OR y.value IS NOT NULL""",
)
def version_changes(spark, sf_dir):
    out = vs.metric_changes(version_pairs(spark, sf_dir), version_values(spark, sf_dir))
    return out.select("version_a", "version_b", "metric", _r("improvement"))


@query(
    "version_winners",
    "C18",
    b.with_ctes(_VERSION_SQL)
    + """, w AS (SELECT version, max(value) FILTER (metric = 'accuracy') AS ac, max(value) FILTER (metric = 'brier_score') AS br, max(value) FILTER (metric = 'margin_mae') AS mae, max(value) FILTER (metric = 'loss') AS ls FROM vm GROUP BY 1),
j AS (SELECT a, b, coalesce(x.ac, 0) AS a1, coalesce(y.ac, 0) AS a2, coalesce(x.br, 1) AS b1, coalesce(y.br, 1) AS b2, coalesce(x.mae, 1e300::DOUBLE) AS m1, coalesce(y.mae, 1e300::DOUBLE) AS m2, x.ls AS l1, y.ls AS l2
  FROM pr LEFT JOIN w x ON x.version = a LEFT JOIN w y ON y.version = b)
SELECT a AS version_a, b AS version_b, CASE WHEN abs(a1 - a2) > 0.001::DOUBLE THEN CASE WHEN a2 > a1 THEN b ELSE a END WHEN abs(b1 - b2) > 0.001::DOUBLE THEN CASE WHEN b2 < b1 THEN b ELSE a END
  WHEN abs(m1 - m2) > 0.001::DOUBLE THEN CASE WHEN m2 < m1 THEN b ELSE a END ELSE b END AS winner, CASE WHEN l1 < l2 THEN a ELSE b END AS lower_loss FROM j""",
)
def version_winners(spark, sf_dir):
    return vs.winners(version_pairs(spark, sf_dir), version_values(spark, sf_dir))


@query(
    "version_lineage",
    "C19",
    """WITH RECURSIVE r AS (SELECT p_partkey AS version, p_partkey AS ancestor, 0 AS steps FROM part WHERE p_size = 7
  UNION ALL SELECT version, ancestor // 2, steps + 1 FROM r WHERE ancestor > 0) SELECT version, ancestor, steps FROM r""",
)
def version_lineage(spark, sf_dir):
    """Ancestors of the versions that someone asks for: those of one size."""
    asked = b.table(spark, sf_dir, "part").filter("p_size = 7").select(F.col("p_partkey").alias("version"))
    return vs.lineage(model_versions(spark, sf_dir), asked)


@query(
    "versions_newest_first",
    "N08",
    "SELECT p_partkey AS version, CAST(DATE '2024-01-01' + CAST(p_partkey * 7 % 365 AS INTEGER) AS VARCHAR) AS created_at FROM part",
)
def versions_newest_first(spark, sf_dir):
    return vs.newest_first(model_versions(spark, sf_dir)).select(
        "version", F.col("created_at").cast("string").alias("created_at")
    )
