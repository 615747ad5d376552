"""Prices, stake sizing, folds, backtests and signals on part, orders, lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from courtline.functions import misc
from courtline.functions import odds as o
from courtline.operators import backtest as bt
from courtline.operators import markets
from courtline.operators import metrics
from courtline.plans import bindings as b
from courtline.plans.registry import query

# --- devig ---

_K_SQL = """valid AS (SELECT game_id, 1.0 / first_odds AS p1, 1.0 / second_odds AS p2 FROM prices WHERE first_odds > 1 AND second_odds > 1),
steps AS (
  WITH RECURSIVE r AS (
    SELECT game_id, p1, p2, 0.5::DOUBLE AS lo, 2.0::DOUBLE AS hi, 0 AS i FROM valid
    WHERE pow(p1, 0.5) + pow(p2, 0.5) >= 1 AND pow(p1, 2) + pow(p2, 2) <= 1
    UNION ALL
    SELECT game_id, p1, p2,
      CASE WHEN pow(p1, (lo + hi) / 2) + pow(p2, (lo + hi) / 2) > 1 THEN (lo + hi) / 2 ELSE lo END,
      CASE WHEN pow(p1, (lo + hi) / 2) + pow(p2, (lo + hi) / 2) > 1 THEN hi ELSE (lo + hi) / 2 END, i + 1
    FROM r WHERE i < 52)
  SELECT game_id, (lo + hi) / 2 AS k FROM r WHERE i = 52),
fair AS (
  SELECT p.game_id, first_odds, second_odds, model_prob, p1, p2, p1 + p2 - 1 AS vig, k,
    CASE WHEN p1 + p2 - 1 <= 0 THEN 0 ELSE least(greatest(p1 + p2 - 1, 0.001::DOUBLE), 0.5::DOUBLE) END AS z
  FROM prices p LEFT JOIN valid v ON v.game_id = p.game_id LEFT JOIN steps s ON s.game_id = p.game_id)"""


def _r(c, name):
    return F.round(c, 6).alias(name)


@query(
    "devig_methods",
    "X17 X18 X19 X20 X21",
    b.with_ctes(b.PRICES_SQL, _K_SQL)
    + """SELECT game_id, round(p1, 6) AS implied_first, round(vig, 6) AS overround, round(p1 / (p1 + p2), 6) AS multiplicative_home,
  round(k, 6) AS power_k, round(pow(p1, k), 6) AS power_home, round(pow(p2, k), 6) AS power_away,
  round(CASE WHEN z = 0 THEN p1 / (p1 + p2) ELSE
    (sqrt(z * z + 4 * (1 - z) * p1) - z) / ((sqrt(z * z + 4 * (1 - z) * p1) - z) + (sqrt(z * z + 4 * (1 - z) * p2) - z)) END, 6) AS shin_home
  FROM fair""",
)
def devig_methods(spark, sf_dir):
    first, second = F.col("first_odds"), F.col("second_odds")
    valid = o.implied(second).isNotNull()
    power = o.devig(first, second, "power")
    return b.prices(spark, sf_dir).select(
        "game_id",
        _r(F.when(valid, o.implied(first)), "implied_first"),
        _r(o.overround(first, second), "overround"),
        _r(o.devig(first, second, "multiplicative")["home"], "multiplicative_home"),
        _r(o.power_exponent(first, second), "power_k"),
        _r(power["home"], "power_home"),
        _r(power["away"], "power_away"),
        _r(o.devig(first, second, "shin")["home"], "shin_home"),
    )


@query(
    "stake_sizes",
    "X22 X23 X24 X25",
    b.with_ctes(b.PRICES_SQL, _K_SQL)
    + """, s AS (SELECT game_id, first_odds AS o, model_prob AS p, pow(p1, k) AS m FROM fair WHERE k IS NOT NULL)
SELECT game_id, round(p - m, 6) AS edge, round(((o - 1) * p - (1 - p)) / (o - 1), 6) AS full_kelly,
  round(CASE WHEN p - m >= 0.02 AND ((o - 1) * p - (1 - p)) > 0 THEN least(0.25 * ((o - 1) * p - (1 - p)) / (o - 1), 0.02::DOUBLE) ELSE 0 END, 6) AS bet_fraction,
  CAST(p - m >= 0.02 AND ((o - 1) * p - (1 - p)) > 0 AS INTEGER) AS has_edge,
  round(1 / o + 0.02, 6) AS min_probability,
  CASE WHEN p - 0.02 <= 0 THEN NULL ELSE round(1 / (p - 0.02), 6) END AS min_odds,
  CAST(CASE WHEN o >= 2 THEN round_even((o - 1) * 100, 0) ELSE round_even(-100 / (o - 1), 0) END AS INTEGER) AS american
FROM s""",
)
def stake_sizes(spark, sf_dir):
    price, prob = F.col("first_odds"), F.col("model_prob")
    fair = o.devig_power(price, F.col("second_odds"))
    rows = b.prices(spark, sf_dir).withColumn("fair", fair).filter("fair IS NOT NULL")
    size = o.kelly(prob, price, F.col("fair.home"))
    least_odds = o.min_odds(prob)
    return rows.select(
        "game_id",
        _r(o.edge(prob, F.col("fair.home")), "edge"),
        _r(size["full_kelly"], "full_kelly"),
        _r(size["bet_fraction"], "bet_fraction"),
        size["has_edge"].cast("int").alias("has_edge"),
        _r(o.min_probability(price), "min_probability"),
        _r(F.when(least_odds < 1e300, least_odds), "min_odds"),
        o.decimal_to_american(price).alias("american"),
    )


@query(
    "american_odds",
    "X23",
    """SELECT o_orderkey, round(CASE WHEN a > 0 THEN 1 + a / 100.0::DOUBLE ELSE 1 - 100.0::DOUBLE / a END, 6) AS decimal_odds FROM
  (SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN 100 + o_custkey % 400 ELSE -(100 + o_custkey % 400) END AS a FROM orders)""",
)
def american_odds(spark, sf_dir):
    size = 100 + F.col("o_custkey") % 400
    american = F.when(F.col("o_custkey") % 2 == 0, size).otherwise(-size)
    return b.table(spark, sf_dir, "orders").select(
        "o_orderkey", _r(o.american_to_decimal(american), "decimal_odds")
    )


_TOP = o._TAIL_TOP
_BOTTOM = o._TAIL_BOTTOM


def _horner_sql(x: str, coefficients: list[float]) -> str:
    acc = f"{coefficients[0]!r}::DOUBLE"
    for c in coefficients[1:]:
        acc = f"({acc} * {x} + {c!r}::DOUBLE)"
    return acc


def cdf_sql(z: str) -> str:
    x = f"abs({z})"
    tail = f"(exp(-{x} * {x} / 2) * {_horner_sql(x, _TOP)} / {_horner_sql(x, _BOTTOM)})"
    return f"(CASE WHEN {z} > 0 THEN 1 - {tail} ELSE {tail} END)"


@query(
    "cover_probability",
    "X26 X27 X28",
    f"""SELECT o_orderkey, round({cdf_sql('(d / 12)')}, 6) AS spread_cover, round({cdf_sql('(d / 15)')}, 6) AS total_cover,
  round(greatest(0.01::DOUBLE, least(0.99::DOUBLE, 1 / (1 + exp(-1.7::DOUBLE * d / 13)))), 6) AS logistic_cover,
  CASE WHEN e >= 0.05 AND c * (1 - u * 0.5) >= 0.6 THEN 'high' WHEN e >= 0.03 AND c * (1 - u * 0.5) >= 0.4 THEN 'medium' ELSE 'low' END AS confidence
FROM (SELECT o_orderkey, CAST(o_orderkey % 81 - 40 AS DOUBLE) AS d, CAST(o_custkey % 12 AS DOUBLE) / 100 AS e,
  CAST(o_orderkey % 101 AS DOUBLE) / 101 AS c, CAST(o_custkey % 19 AS DOUBLE) / 19 AS u FROM orders)""",
)
def cover_probability(spark, sf_dir):
    d = (F.col("o_orderkey") % 81 - 40).cast("double")
    return b.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        _r(o.cover_normal(d, o.SPREAD_SIGMA), "spread_cover"),
        _r(o.cover_normal(d, o.TOTAL_SIGMA), "total_cover"),
        _r(o.cover_logistic(d), "logistic_cover"),
        o.signal_confidence(
            F.col("o_custkey") % 12 / 100.0, F.col("o_orderkey") % 101 / 101.0,
            F.col("o_custkey") % 19 / 19.0,
        ).alias("confidence"),
    )


# --- folds ---

GAME_ORDER = ["game_date", "game_id"]
GAME_LEVELS = ["game_date", "id_range"]


def ordered_games(spark, sf_dir):
    return b.games(spark, sf_dir).withColumn("id_range", F.floor(F.col("game_id") / b.ID_RANGE))


_RANK_SQL = "ranked AS (SELECT *, row_number() OVER (ORDER BY game_date, game_id) - 1 AS pos, count(*) OVER () AS n FROM games)"
_FOLD_SQL = """f AS (SELECT k + 1 AS fold_num, 500 + k * 50 AS tg FROM (SELECT unnest(range(0, (SELECT CAST(max(n) AS BIGINT) FROM ranked) // 50 + 1)) AS k)
  WHERE 500 + k * 50 + 100 <= (SELECT max(n) FROM ranked))"""


@query(
    "walk_forward_folds",
    "W16",
    b.with_ctes(b.GAMES_SQL, _RANK_SQL, _FOLD_SQL)
    + """SELECT fold_num, tg AS train_games, CAST(min(v.game_date) AS VARCHAR) AS val_start, CAST(max(v.game_date) AS VARCHAR) AS val_end,
  count(*) AS val_games, CAST((SELECT min(game_date) FROM games) AS VARCHAR) AS train_start,
  CAST(max(t.game_date) AS VARCHAR) AS train_end
FROM f JOIN ranked v ON v.pos >= tg AND v.pos < tg + 100 JOIN ranked t ON t.pos = tg - 1 GROUP BY fold_num, tg""",
)
def walk_forward_folds(spark, sf_dir):
    out = bt.folds(ordered_games(spark, sf_dir), GAME_LEVELS, GAME_ORDER, "game_date")
    dates = ["val_start", "val_end", "train_start", "train_end"]
    return out.select(
        "fold_num", "train_games", "val_games", *[F.col(c).cast("string").alias(c) for c in dates]
    )


@query(
    "fold_validation_games",
    "W16",
    b.with_ctes(b.GAMES_SQL, _RANK_SQL, _FOLD_SQL)
    + "SELECT fold_num, game_id, pos AS position FROM f JOIN ranked v ON v.pos >= tg AND v.pos < tg + 100",
)
def fold_validation_games(spark, sf_dir):
    return bt.validation_rows(ordered_games(spark, sf_dir), GAME_LEVELS, GAME_ORDER).select(
        "fold_num", "game_id", "position"
    )


@query(
    "temporal_split",
    "W17",
    b.with_ctes(b.GAMES_SQL, _RANK_SQL)
    + "SELECT game_id, pos AS position, CASE WHEN pos >= n - floor(n * 0.2::DOUBLE) THEN 'validation' ELSE 'train' END AS role FROM ranked",
)
def temporal_split(spark, sf_dir):
    out = bt.temporal_split(ordered_games(spark, sf_dir), GAME_LEVELS, GAME_ORDER)
    return out.select("game_id", "position", "role")


# --- backtest ---

def priced_games(spark, sf_dir):
    """Games with predictions; prices come from part where the ids meet."""
    prices = b.prices(spark, sf_dir).select(
        "game_id",
        F.col("first_odds").alias("home_ml"),
        F.col("second_odds").alias("away_ml"),
        (F.col("p_size") % 15 - 7.5).alias("spread"),
        (1.7 + F.col("p_size") % 9 / 20.0).alias("spread_home_odds"),
        F.when(F.col("p_size") % 4 != 0, 1.75 + F.col("p_size") % 7 / 20.0).alias("spread_away_odds"),
        (190.0 + F.col("p_size")).alias("total"),
        F.when(F.col("p_size") % 3 != 0, 1.8 + F.col("p_size") % 5 / 20.0).alias("over_odds"),
        F.when(F.col("p_size") % 5 != 0, 1.85 + F.col("p_size") % 6 / 20.0).alias("under_odds"),
    )
    games = ordered_games(spark, sf_dir).select(
        "game_id", "game_date", "id_range", "home_score", "away_score",
        (0.05 + 0.9 * (F.col("game_id") * 7 % 101) / 100.0).alias("home_win_prob"),
        (F.col("game_id") % 41 - 20.0).alias("predicted_margin"),
        (195.0 + F.col("game_id") % 50).alias("predicted_total"),
    )
    return games.join(prices, "game_id", "left")


_PRICED_SQL = """priced AS (
  SELECT g.game_id, game_date, home_score - away_score AS mar, home_score + away_score AS pts,
    0.05::DOUBLE + 0.9::DOUBLE * (g.game_id * 7 % 101) / 100.0::DOUBLE AS hp, (g.game_id % 41 - 20)::DOUBLE AS pm, (195 + g.game_id % 50)::DOUBLE AS pt,
    coalesce(first_odds, 1.91::DOUBLE) AS o1, coalesce(second_odds, 1.91::DOUBLE) AS o2,
    coalesce(p_size % 15 - 7.5::DOUBLE, -3.5::DOUBLE) AS sp,
    coalesce(1.7::DOUBLE + (p_size % 9)::DOUBLE / 20, 1.91::DOUBLE) AS s1,
    coalesce(CASE WHEN p_size % 4 <> 0 THEN 1.75::DOUBLE + (p_size % 7)::DOUBLE / 20 END, 1.91::DOUBLE) AS s2,
    coalesce((190 + p_size)::DOUBLE, 220::DOUBLE) AS tl,
    coalesce(CASE WHEN p_size % 3 <> 0 THEN 1.8::DOUBLE + (p_size % 5)::DOUBLE / 20 END, 1.91::DOUBLE) AS t1,
    coalesce(CASE WHEN p_size % 5 <> 0 THEN 1.85::DOUBLE + (p_size % 6)::DOUBLE / 20 END, 1.91::DOUBLE) AS t2
  FROM games g LEFT JOIN prices p ON p.game_id = g.game_id)"""

_MARKET_SQL = f"""m AS (
  SELECT game_id, game_date, 'moneyline' AS bet_type, hp AS p, o1 AS a, o2 AS b, mar > 0 AS w1, mar <= 0 AS w2 FROM priced
  UNION ALL SELECT game_id, game_date, 'spread', {cdf_sql('((pm - sp) / 12)')}, s1, s2, mar > sp, mar < sp FROM priced
  UNION ALL SELECT game_id, game_date, 'total', 1 - {cdf_sql('((tl - pt) / 15)')}, t1, t2, pts > tl, pts < tl FROM priced),
pairs AS (SELECT DISTINCT a, b, 1.0 / a AS p1, 1.0 / b AS p2 FROM m WHERE a > 1 AND b > 1),
ks AS (
  WITH RECURSIVE r AS (
    SELECT a, b, p1, p2, 0.5::DOUBLE AS lo, 2.0::DOUBLE AS hi, 0 AS i FROM pairs
    WHERE pow(p1, 0.5) + pow(p2, 0.5) >= 1 AND pow(p1, 2) + pow(p2, 2) <= 1
    UNION ALL
    SELECT a, b, p1, p2,
      CASE WHEN pow(p1, (lo + hi) / 2) + pow(p2, (lo + hi) / 2) > 1 THEN (lo + hi) / 2 ELSE lo END,
      CASE WHEN pow(p1, (lo + hi) / 2) + pow(p2, (lo + hi) / 2) > 1 THEN hi ELSE (lo + hi) / 2 END, i + 1
    FROM r WHERE i < 52)
  SELECT a, b, pow(p1, (lo + hi) / 2) AS f1, pow(p2, (lo + hi) / 2) AS f2 FROM r WHERE i = 52),
e AS (
  SELECT m.*, coalesce(f1, CASE WHEN bet_type <> 'moneyline' THEN 0.5::DOUBLE END) AS f1, coalesce(f2, CASE WHEN bet_type <> 'moneyline' THEN 0.5::DOUBLE END) AS f2
  FROM m LEFT JOIN ks ON ks.a = m.a AND ks.b = m.b),
s AS (
  SELECT *, CASE WHEN p - f1 >= 0.02 AND p - f1 >= 1 - p - f2 THEN 1 WHEN 1 - p - f2 >= 0.02 THEN 2 END AS pick FROM e),
c AS (
  SELECT game_id, game_date, bet_type, CASE WHEN bet_type = 'total' THEN CASE pick WHEN 1 THEN 'over' ELSE 'under' END
      ELSE CASE pick WHEN 1 THEN 'home' ELSE 'away' END END AS side,
    CASE pick WHEN 1 THEN p ELSE 1 - p END AS model_prob, CASE pick WHEN 1 THEN a ELSE b END AS market_odds,
    CASE pick WHEN 1 THEN f1 ELSE f2 END AS market_prob, CASE pick WHEN 1 THEN w1 ELSE w2 END AS won
  FROM s WHERE pick IS NOT NULL),
placed AS (
  SELECT *, model_prob - market_prob AS edge, model_prob - (1 - model_prob) / (market_odds - 1) AS full_kelly,
    least(0.25 * (model_prob - (1 - model_prob) / (market_odds - 1)), 0.02::DOUBLE) AS bet_fraction,
    CASE WHEN won THEN market_odds - 1 ELSE -1 END AS unit_profit
  FROM c WHERE model_prob - (1 - model_prob) / (market_odds - 1) > 0)"""


@query(
    "game_bets",
    "C06 C07 C08 C09 F03 F06",
    b.with_ctes(b.GAMES_SQL, b.PRICES_SQL, _PRICED_SQL, _MARKET_SQL)
    + """SELECT game_id, bet_type, side, round(model_prob, 6) AS model_prob, round(market_odds, 6) AS market_odds,
  round(market_prob, 6) AS market_prob, round(edge, 6) AS edge, round(bet_fraction, 6) AS bet_fraction,
  CASE WHEN won THEN 'win' ELSE 'loss' END AS result, round(unit_profit, 6) AS unit_profit FROM placed""",
)
def game_bets(spark, sf_dir):
    bets = markets.game_bets(priced_games(spark, sf_dir))
    return bets.select(
        "game_id", "bet_type", "side", *[_r(F.col(c), c) for c in ("model_prob", "market_odds", "market_prob", "edge", "bet_fraction")],
        "result", _r(F.col("unit_profit"), "unit_profit"),
    )


def fold_bets(spark, sf_dir):
    """Each game's bets are made once and then repeated for the folds that hold it."""
    held = bt.validation_rows(
        ordered_games(spark, sf_dir).select("game_id", "game_date", "id_range"), GAME_LEVELS, GAME_ORDER
    ).select("game_id", "fold_num")
    return markets.game_bets(priced_games(spark, sf_dir)).join(held, "game_id")


BACKTEST_ORDER = ["fold_num", "game_date", "game_id", "bet_type"]


#: Folds of a block; folds grow with the games, so their prefix has a level above.
FOLD_BLOCK = 64


def backtest_curve(spark, sf_dir):
    bets = fold_bets(spark, sf_dir).select(
        *BACKTEST_ORDER, "bet_fraction", "unit_profit", F.floor(F.col("fold_num") / FOLD_BLOCK).alias("fold_block")
    )
    return bt.equity_curve(
        bets, [], ["fold_block", "fold_num"], BACKTEST_ORDER,
        F.col("bet_fraction"), F.col("unit_profit"), same_stake=["fold_num", "game_date", "game_id"],
    )


_WALK_SQL = b.with_ctes(b.GAMES_SQL, b.PRICES_SQL, _RANK_SQL, _FOLD_SQL, _PRICED_SQL, _MARKET_SQL) + """,
fb AS (SELECT f.fold_num, p.* FROM f JOIN ranked v ON v.pos >= tg AND v.pos < tg + 100 JOIN placed p ON p.game_id = v.game_id),
gf AS (SELECT fold_num, game_date, game_id, ln(1 + sum(bet_fraction * unit_profit)) AS lf FROM fb GROUP BY 1, 2, 3),
gs AS (SELECT *, coalesce(sum(lf) OVER (ORDER BY fold_num, game_date, game_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM gf),
curve AS (
  SELECT fb.*, row_number() OVER (ORDER BY fb.fold_num, fb.game_date, fb.game_id, bet_type) AS bet_no,
    before + ln(1 + sum(bet_fraction * unit_profit) OVER (PARTITION BY fb.fold_num, fb.game_id ORDER BY bet_type ROWS UNBOUNDED PRECEDING)) AS lg,
    before AS lb
  FROM fb JOIN gs ON gs.fold_num = fb.fold_num AND gs.game_id = fb.game_id)"""


@query(
    "walk_forward_equity",
    "C10 W11 W15",
    _WALK_SQL + "\nSELECT bet_no, fold_num, game_id, bet_type, round(lg, 6) AS log_growth FROM curve",
)
def walk_forward_equity(spark, sf_dir):
    return backtest_curve(spark, sf_dir).select(
        "bet_no", "fold_num", "game_id", "bet_type", _r(F.col("log_growth"), "log_growth")
    )


@query(
    "walk_forward_summary",
    "C10 A22",
    _WALK_SQL + """
SELECT bet_type, count(*) AS bets, round(avg(CASE WHEN won THEN 1.0::DOUBLE ELSE 0 END), 6) AS win_rate,
  round(avg(edge), 6) AS avg_edge, round(sum(bet_fraction * unit_profit) / sum(bet_fraction), 6) AS unit_roi,
  round(avg(pow(model_prob - CASE WHEN won THEN 1 ELSE 0 END, 2)), 6) AS brier_score FROM curve GROUP BY 1""",
)
def walk_forward_summary(spark, sf_dir):
    bets = fold_bets(spark, sf_dir)
    won = (F.col("result") == "win").cast("double")
    return bets.groupBy("bet_type").agg(
        F.count(F.lit(1)).alias("bets"),
        _r(F.avg(won), "win_rate"),
        _r(F.avg("edge"), "avg_edge"),
        _r(F.sum(F.col("bet_fraction") * F.col("unit_profit")) / F.sum("bet_fraction"), "unit_roi"),
        _r(F.avg(F.pow(F.col("model_prob") - won, 2)), "brier_score"),
    )


def rated_games(spark, sf_dir):
    """Games with two stand-in ratings as features, and what is to be told."""
    return ordered_games(spark, sf_dir).select(
        "game_id", "game_date", "id_range", "home_score", "away_score",
        (F.col("game_id") * 7 % 101 / 100.0).alias("form"), (F.col("game_id") % 41 - 20.0).alias("gap"),
        (F.col("home_score") - F.col("away_score")).cast("double").alias("margin"),
        (F.col("home_score") + F.col("away_score")).cast("double").alias("points"),
    )


def _cramer(right: str) -> str:
    """Solution of the fold's three equations for the right side of one target."""
    m = [["n", "s1", "s2"], ["s1", "s11 + 1", "s12"], ["s2", "s12", "s22 + 1"]]

    def det(rows):
        (a, b_, c), (d, e, f), (g, h, i) = [[f"({x})" for x in row] for row in rows]
        return f"({a} * ({e} * {i} - {f} * {h}) - {b_} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"

    y = [f"{right}0", f"{right}1", f"{right}2"]
    return ", ".join(
        f"{det([[y[r] if c == k else m[r][c] for c in range(3)] for r in range(3)])} / {det(m)} AS {right}_beta{k}" for k in range(3)
    )


@query(
    "walk_forward_predictions",
    "C10 F02",
    b.with_ctes(b.GAMES_SQL, _RANK_SQL, _FOLD_SQL)
    + f""", x AS (SELECT game_id, pos, (game_id * 7 % 101) / 100.0::DOUBLE AS f1, (game_id % 41 - 20)::DOUBLE AS f2,
  (home_score - away_score)::DOUBLE AS mar, (home_score + away_score)::DOUBLE AS pts FROM ranked),
train AS (SELECT fold_num, tg, count(*)::DOUBLE AS n, sum(f1) AS s1, sum(f2) AS s2, sum(f1 * f1) AS s11, sum(f1 * f2) AS s12, sum(f2 * f2) AS s22,
  sum(mar) AS m0, sum(f1 * mar) AS m1, sum(f2 * mar) AS m2, sum(pts) AS p0, sum(f1 * pts) AS p1, sum(f2 * pts) AS p2
  FROM f JOIN x ON x.pos < tg WHERE mar IS NOT NULL GROUP BY 1, 2),
beta AS (SELECT fold_num, tg, {_cramer("m")}, {_cramer("p")} FROM train)
SELECT fold_num, game_id, round(m_beta0 + m_beta1 * f1 + m_beta2 * f2, 5) AS margin, round(p_beta0 + p_beta1 * f1 + p_beta2 * f2, 5) AS points
FROM beta JOIN x ON x.pos >= tg AND x.pos < tg + 100""",
)
def walk_forward_predictions(spark, sf_dir):
    made = bt.fold_predictions(rated_games(spark, sf_dir), GAME_LEVELS, GAME_ORDER, ["form", "gap"], ["margin", "points"])
    return made.select(
        "fold_num", "game_id", F.round("predicted_margin", 5).alias("margin"), F.round("predicted_points", 5).alias("points")
    )


_BET_EQUITY_SQL = b.with_ctes(b.BETS_SQL) + """, eq AS (
  SELECT *, row_number() OVER o AS bet_no, sum(ln(1 + r)) OVER (o ROWS UNBOUNDED PRECEDING) AS lg FROM (
    SELECT *, CASE WHEN edge >= 0.02 AND k > 0 THEN least(0.25 * k, 0.02::DOUBLE) ELSE 0 END *
      CASE result WHEN 'win' THEN market_odds - 1 WHEN 'loss' THEN -1 ELSE 0 END AS r
    FROM (SELECT *, model_prob - (1 - model_prob) / (market_odds - 1) AS k FROM bets))
  WINDOW o AS (ORDER BY bet_date, game_id, line_no, part_id, supplier_id))"""


def bet_curve(spark, sf_dir):
    grid = bt.fraction_grid(b.bets(spark, sf_dir), [o.KELLY_FRACTION])
    return bt.equity_curve(grid, [], b.BET_LEVELS, b.BET_ORDER, F.col("stake"), F.col("unit"))


@query(
    "equity_curve",
    "W11 W15",
    _BET_EQUITY_SQL + "\nSELECT bet_no, game_id, round(lg, 6) AS log_growth FROM eq",
)
def equity_curve(spark, sf_dir):
    return bet_curve(spark, sf_dir).select("bet_no", "game_id", _r(F.col("log_growth"), "log_growth"))


@query(
    "max_drawdown",
    "W12",
    _BET_EQUITY_SQL + """,
v AS (SELECT bet_no, round(10000 * exp(lg), 6) AS v FROM eq),
p AS (SELECT *, greatest(10000, max(v) OVER (ORDER BY bet_no)) AS peak FROM v),
q AS (SELECT *, coalesce(max(CASE WHEN v >= peak THEN bet_no END) OVER (ORDER BY bet_no), 0) AS peak_no FROM p)
SELECT round(max((peak - v) / peak), 6) AS max_drawdown,
  CAST(coalesce(max(bet_no - peak_no + 1) FILTER (v < peak), 0) AS BIGINT) AS max_drawdown_steps FROM q""",
)
def max_drawdown(spark, sf_dir):
    curve = bet_curve(spark, sf_dir).withColumn("bankroll", F.round("bankroll", 6))
    out = bt.drawdown(curve, [], b.BET_LEVELS, b.BET_ORDER)
    return out.select(
        _r(F.col("max_drawdown"), "max_drawdown"),
        F.col("max_drawdown_steps").cast("bigint").alias("max_drawdown_steps"),
    )


_GRID_SQL = b.with_ctes(b.BETS_SQL) + """, g AS (
  SELECT f.fraction, edge >= 0.02 AND k > 0 AS placed,
    CASE WHEN edge >= 0.02 AND k > 0 THEN least(f.fraction * k, 0.02::DOUBLE) ELSE 0 END *
      CASE result WHEN 'win' THEN market_odds - 1 WHEN 'loss' THEN -1 ELSE 0 END AS r
  FROM (SELECT *, model_prob - (1 - model_prob) / (market_odds - 1) AS k FROM bets),
    (SELECT unnest([0.05::DOUBLE, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5]) AS fraction) f),
scores AS (SELECT fraction, count(*) FILTER (placed) AS bets_placed, sum(ln(1 + r)) AS lg,
  avg(r) FILTER (placed) / stddev_pop(r) FILTER (placed) * sqrt(count(*) FILTER (placed)) AS sharpe,
  exp(sum(ln(1 + r)) / count(*)) - 1 AS growth FROM g GROUP BY fraction)"""


@query(
    "kelly_grid",
    "C11 J19",
    _GRID_SQL + "\nSELECT fraction, bets_placed, round(lg, 6) AS log_growth, round(sharpe, 6) AS sharpe, round(growth, 9) AS growth FROM scores",
)
def kelly_grid(spark, sf_dir):
    scores = bt.fraction_scores(bt.fraction_grid(b.bets(spark, sf_dir)))
    return scores.select(
        "fraction", "bets_placed", _r(F.col("log_growth"), "log_growth"),
        _r(F.col("sharpe"), "sharpe"), F.round("growth", 9).alias("growth"),
    )


@query(
    "best_kelly_fraction",
    "N07 C11",
    _GRID_SQL + "\nSELECT fraction AS best_fraction, round(sharpe, 6) AS best_metric FROM scores ORDER BY sharpe DESC, fraction LIMIT 1",
)
def best_kelly_fraction(spark, sf_dir):
    best = bt.best_fraction(bt.fraction_scores(bt.fraction_grid(b.bets(spark, sf_dir))))
    return best.select("best_fraction", _r(F.col("best_metric"), "best_metric"))


# --- signals ---

def predictions(spark, sf_dir):
    orders = b.table(spark, sf_dir, "orders")
    p = 0.05 + 0.9 * (F.col("o_orderkey") * 7 % 101) / 100.0
    return orders.select(
        F.col("o_orderkey").alias("game_id"),
        F.to_date("o_orderdate").alias("game_date"),
        misc.clamp(p, misc.WIN_BOUNDS).alias("home_win_prob_adjusted"),
        (F.col("o_orderkey") % 41 - 20.0).alias("predicted_margin_adjusted"),
        (195.0 + F.col("o_orderkey") % 50).alias("predicted_total_adjusted"),
        misc.prediction_confidence(p).alias("confidence"),
        (F.col("o_custkey") % 10 / 20.0).alias("injury_uncertainty"),
    )


def market_odds(spark, sf_dir):
    return b.prices(spark, sf_dir).select(
        "game_id", F.col("first_odds").alias("home_ml"), F.col("second_odds").alias("away_ml"),
        (F.col("p_size") % 15 - 7.5).alias("spread_home"),
        (1.7 + F.col("p_size") % 9 / 20.0).alias("spread_home_odds"),
        F.when(F.col("p_size") % 4 != 0, 1.75 + F.col("p_size") % 7 / 20.0).alias("spread_away_odds"),
        F.when(F.col("p_size") % 6 != 0, 190.0 + F.col("p_size")).alias("total"),
        F.when(F.col("p_size") % 3 != 0, 1.8 + F.col("p_size") % 5 / 20.0).alias("over_odds"),
        F.when(F.col("p_size") % 5 != 0, 1.85 + F.col("p_size") % 6 / 20.0).alias("under_odds"),
    )


_SIGNAL_SQL = b.with_ctes(b.PRICES_SQL) + """, j AS (
  SELECT o_orderkey AS game_id, CAST(o_orderdate AS DATE) AS game_date, 0.05::DOUBLE + 0.9::DOUBLE * (o_orderkey * 7 % 101) / 100.0::DOUBLE AS hp,
    (o_orderkey % 41 - 20)::DOUBLE AS pm, (195 + o_orderkey % 50)::DOUBLE AS pt, (o_custkey % 10)::DOUBLE / 20 AS unc,
    first_odds AS o1, second_odds AS o2, p_size % 15 - 7.5::DOUBLE AS sp, 1.7::DOUBLE + (p_size % 9)::DOUBLE / 20 AS s1,
    coalesce(CASE WHEN p_size % 4 <> 0 THEN 1.75::DOUBLE + (p_size % 7)::DOUBLE / 20 END, 1.91::DOUBLE) AS s2,
    coalesce(CASE WHEN p_size % 6 <> 0 THEN (190 + p_size)::DOUBLE END, 224.5::DOUBLE) AS tl,
    coalesce(CASE WHEN p_size % 3 <> 0 THEN 1.8::DOUBLE + (p_size % 5)::DOUBLE / 20 END, 1.91::DOUBLE) AS t1,
    coalesce(CASE WHEN p_size % 5 <> 0 THEN 1.85::DOUBLE + (p_size % 6)::DOUBLE / 20 END, 1.91::DOUBLE) AS t2
  FROM orders JOIN prices ON game_id = o_orderkey),
m AS (
  SELECT game_id, game_date, unc, abs(hp - 0.5) * 2 AS conf, 'moneyline' AS bet_type, least(0.99::DOUBLE, greatest(0.01::DOUBLE, hp)) AS p, o1 AS a, o2 AS b, NULL::DOUBLE AS l1, NULL::DOUBLE AS l2 FROM j
  UNION ALL SELECT game_id, game_date, unc, abs(hp - 0.5) * 2, 'spread', greatest(0.01::DOUBLE, least(0.99::DOUBLE, 1 / (1 + exp(-1.7::DOUBLE * (pm - sp) / 13)))), s1, s2, sp, -sp FROM j
  UNION ALL SELECT game_id, game_date, unc, abs(hp - 0.5) * 2, 'total', greatest(0.01::DOUBLE, least(0.99::DOUBLE, 1 / (1 + exp(-1.7::DOUBLE * (pt - tl) / 13)))), t1, t2, tl, tl FROM j),
pairs AS (SELECT DISTINCT a, b, 1.0 / a AS p1, 1.0 / b AS p2 FROM m WHERE a > 1 AND b > 1),
ks AS (
  WITH RECURSIVE r AS (
    SELECT a, b, p1, p2, 0.5::DOUBLE AS lo, 2.0::DOUBLE AS hi, 0 AS i FROM pairs
    WHERE pow(p1, 0.5) + pow(p2, 0.5) >= 1 AND pow(p1, 2) + pow(p2, 2) <= 1
    UNION ALL
    SELECT a, b, p1, p2,
      CASE WHEN pow(p1, (lo + hi) / 2) + pow(p2, (lo + hi) / 2) > 1 THEN (lo + hi) / 2 ELSE lo END,
      CASE WHEN pow(p1, (lo + hi) / 2) + pow(p2, (lo + hi) / 2) > 1 THEN hi ELSE (lo + hi) / 2 END, i + 1
    FROM r WHERE i < 52)
  SELECT a, b, pow(p1, (lo + hi) / 2) AS f1, pow(p2, (lo + hi) / 2) AS f2 FROM r WHERE i = 52),
sides AS (
  SELECT game_id, game_date, unc, conf, bet_type, CASE bet_type WHEN 'total' THEN 'over' ELSE 'home' END AS side, l1 AS line, p AS model_prob, f1 AS market_prob, m.a AS odds FROM m JOIN ks ON ks.a = m.a AND ks.b = m.b
  UNION ALL
  SELECT game_id, game_date, unc, conf, bet_type, CASE bet_type WHEN 'total' THEN 'under' ELSE 'away' END, l2, 1 - p, f2, m.b FROM m JOIN ks ON ks.a = m.a AND ks.b = m.b),
sig AS (
  SELECT *, model_prob - market_prob AS edge, model_prob - (1 - model_prob) / (odds - 1) AS full_kelly FROM sides WHERE model_prob - market_prob >= 0.02)"""

_SIGNAL_CONF = "CASE WHEN edge >= 0.05 AND conf * (1 - unc * 0.5) >= 0.6 THEN 'high' WHEN edge >= 0.03 AND conf * (1 - unc * 0.5) >= 0.4 THEN 'medium' ELSE 'low' END"


@query(
    "signals",
    "C12 J14 X32 X28 X24",
    _SIGNAL_SQL + f"""
SELECT game_id, bet_type, side, line, round(model_prob, 6) AS model_prob, round(market_prob, 6) AS market_prob, round(edge, 6) AS edge,
  round(odds, 6) AS recommended_odds, round(full_kelly, 6) AS kelly_fraction,
  round(CASE WHEN full_kelly > 0 THEN least(0.25 * full_kelly, 0.02::DOUBLE) ELSE 0 END, 6) AS recommended_stake_pct,
  {_SIGNAL_CONF} AS signal_confidence FROM sig""",
)
def signals(spark, sf_dir):
    found = markets.signals(predictions(spark, sf_dir), market_odds(spark, sf_dir))
    numbers = ["model_prob", "market_prob", "edge", "recommended_odds", "kelly_fraction", "recommended_stake_pct"]
    return found.select(
        "game_id", "bet_type", "side", "line", *[_r(F.col(c), c) for c in numbers], "signal_confidence"
    )


@query(
    "strongest_signals",
    "N03",
    _SIGNAL_SQL + "\nSELECT game_id, bet_type, side, round(edge, 6) AS edge FROM sig ORDER BY sig.edge DESC, game_id, bet_type, side LIMIT 3",
)
def strongest_signals(spark, sf_dir):
    found = markets.signals(predictions(spark, sf_dir), market_odds(spark, sf_dir))
    return markets.strongest(found).select("game_id", "bet_type", "side", _r(F.col("edge"), "edge"))


@query(
    "daily_summary",
    "A28",
    _SIGNAL_SQL + f""", t AS (SELECT *, {_SIGNAL_CONF} AS confidence FROM sig),
d AS (SELECT game_date, count(*) AS n, count(*) FILTER (confidence = 'high') AS h, count(*) FILTER (confidence = 'medium') AS md, avg(edge) AS a, max(edge) AS mx FROM t GROUP BY 1)
SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS game_date, count(*) AS total_games, coalesce(max(n), 0) AS total_signals,
  coalesce(max(h), 0) AS high_confidence_signals, coalesce(max(md), 0) AS medium_confidence_signals,
  round(coalesce(max(a), 0), 6) AS avg_edge, round(coalesce(max(mx), 0), 6) AS max_edge
FROM orders LEFT JOIN d ON d.game_date = CAST(o_orderdate AS DATE) GROUP BY CAST(o_orderdate AS DATE)""",
)
def daily_summary(spark, sf_dir):
    from courtline.operators.reports import daily_summary as summary

    made = predictions(spark, sf_dir)
    found = markets.signals(made, market_odds(spark, sf_dir)).drop("confidence").withColumnRenamed(
        "signal_confidence", "confidence"
    )
    out = summary(made, found, "game_date")
    return out.select(
        F.col("game_date").cast("string").alias("game_date"), "total_games",
        *[F.col(c).cast("bigint").alias(c) for c in ("total_signals", "high_confidence_signals", "medium_confidence_signals")],
        _r(F.col("avg_edge").cast("double"), "avg_edge"), _r(F.col("max_edge").cast("double"), "max_edge"),
    )
