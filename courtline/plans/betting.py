"""Betting metrics and report series on bets (lineitem)."""

from __future__ import annotations

from pyspark.sql import functions as F

from courtline.operators import metrics, reports
from courtline.plans import bindings as b
from courtline.plans.registry import query

BET_COLUMNS = [
    "total_bets", "win_count", "loss_count", "push_count", "win_rate", "total_wagered",
    "total_profit", "avg_edge", "avg_odds", "roi", "total_return", "avg_bet_return", "cagr",
    "volatility", "sharpe_ratio", "sortino_ratio", "brier_score", "log_loss",
]
COUNTS = {"total_bets", "win_count", "loss_count", "push_count", "bet_count", "total_predictions", "priced_bets", "bin_count"}


def tidy(df, keys):
    """Counts as bigint, everything else rounded to six places."""
    return df.select(*keys, *[
        (F.col(c).cast("bigint") if c in COUNTS else F.round(F.col(c).cast("double"), 6)).alias(c)
        for c in df.columns if c not in keys
    ])


_METRIC_SQL = """SELECT {key} AS bet_type, count(*) AS total_bets,
  count(*) FILTER (result = 'win') AS win_count, count(*) FILTER (result = 'loss') AS loss_count,
  count(*) FILTER (result = 'push') AS push_count,
  round(count(*) FILTER (result = 'win') / CAST(count(*) FILTER (result <> 'push') AS DOUBLE), 6) AS win_rate,
  round(sum(bet_amount), 6) AS total_wagered, round(sum(profit), 6) AS total_profit,
  round(avg(edge), 6) AS avg_edge, round(avg(market_odds), 6) AS avg_odds,
  round(sum(profit) / sum(bet_amount), 6) AS roi, round(sum(profit) / 10000, 6) AS total_return,
  round(avg(profit / bet_amount), 6) AS avg_bet_return,
  round(CASE WHEN 10000 + sum(profit) > 0 THEN pow((10000 + sum(profit)) / 10000, 365.25 / date_diff('day', min(bet_date), max(bet_date))) - 1 ELSE 0 END, 6) AS cagr,
  round(stddev_pop(profit / bet_amount), 6) AS volatility,
  round(avg(profit / bet_amount) / stddev_pop(profit / bet_amount) * sqrt(least(count(*), 252)), 6) AS sharpe_ratio,
  round(CASE WHEN stddev_pop(profit / bet_amount) FILTER (profit < 0) > 0 THEN
    avg(profit / bet_amount) / stddev_pop(profit / bet_amount) FILTER (profit < 0) * sqrt(least(count(*), 252)) ELSE 0 END, 6) AS sortino_ratio,
  round(avg(pow(model_prob - CASE result WHEN 'win' THEN 1 ELSE 0 END, 2)) FILTER (result <> 'push'), 6) AS brier_score,
  round(avg(-ln(CASE result WHEN 'win' THEN model_prob ELSE 1 - model_prob END)) FILTER (result <> 'push'), 6) AS log_loss
FROM bets {group}"""


@query(
    "betting_metrics",
    "A16 A17 A18 A19 A21 A22 S19",
    b.with_ctes(b.BETS_SQL)
    + _METRIC_SQL.format(key="bet_type", group="GROUP BY bet_type")
    + "\nUNION ALL " + _METRIC_SQL.format(key="'all'", group=""),
)
def betting_metrics(spark, sf_dir):
    return tidy(metrics.betting_metrics(b.bets(spark, sf_dir)), ["bet_type"])


def closing(spark, sf_dir):
    o = b.table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("game_id"),
        F.when(F.col("o_custkey") % 7 != 0, 1.3 + F.col("o_custkey") % 200 / 100.0).alias("home_ml"),
        F.when(F.col("o_custkey") % 11 != 0, 1.4 + F.col("o_custkey") % 150 / 100.0).alias("away_ml"),
        F.when(F.col("o_orderkey") % 5 != 0, 1.8 + F.col("o_orderkey") % 20 / 100.0).alias("spread_odds"),
        F.when(F.col("o_orderkey") % 3 != 0, 1.7 + F.col("o_orderkey") % 40 / 100.0).alias("total_odds"),
    ).filter(F.col("game_id") % 13 != 0)


@query(
    "closing_line_value",
    "A20 J15",
    b.with_ctes(b.BETS_SQL)
    + """SELECT bet_type, count(*) AS priced_bets, round(avg(clv), 6) AS avg_clv,
  round(avg(CASE WHEN clv > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS clv_positive_rate FROM (
  SELECT bet_type, (1.0 / close - 1.0 / market_odds) / (1.0 / market_odds) AS clv FROM (
    SELECT bet_type, market_odds, CASE
      WHEN bet_type = 'spread' THEN CASE WHEN o_orderkey % 5 <> 0 THEN 1.8::DOUBLE + (o_orderkey % 20)::DOUBLE / 100 ELSE 1.91::DOUBLE END
      WHEN bet_type = 'total' THEN CASE WHEN o_orderkey % 3 <> 0 THEN 1.7::DOUBLE + (o_orderkey % 40)::DOUBLE / 100 ELSE 1.91::DOUBLE END
      WHEN side = 'home' THEN CASE WHEN o_custkey % 7 <> 0 THEN 1.3::DOUBLE + (o_custkey % 200)::DOUBLE / 100 END
      ELSE CASE WHEN o_custkey % 11 <> 0 THEN 1.4::DOUBLE + (o_custkey % 150)::DOUBLE / 100 END END AS close
    FROM bets JOIN orders ON game_id = o_orderkey WHERE o_orderkey % 13 <> 0)
  WHERE close > 1 AND market_odds > 1) GROUP BY bet_type""",
)
def closing_line_value(spark, sf_dir):
    return tidy(metrics.clv_metrics(b.bets(spark, sf_dir), closing(spark, sf_dir)), ["bet_type"])


_DECIDED = "(SELECT *, CASE result WHEN 'win' THEN 1.0::DOUBLE ELSE 0 END AS won FROM bets WHERE result <> 'push')"


def decided(spark, sf_dir):
    return b.bets(spark, sf_dir).filter("result <> 'push'").withColumn(
        "won", (F.col("result") == "win").cast("double")
    )


@query(
    "calibration_curve",
    "A23",
    b.with_ctes(b.BETS_SQL)
    + f"""SELECT CAST(floor(model_prob * 10) AS BIGINT) AS bin, round((floor(model_prob * 10) + 0.5) / 10, 6) AS bin_center,
  round(avg(won), 6) AS actual_rate, count(*) AS bin_count FROM {_DECIDED} WHERE model_prob < 1 GROUP BY floor(model_prob * 10)""",
)
def calibration_curve(spark, sf_dir):
    return tidy(metrics.calibration_curve(decided(spark, sf_dir), "model_prob", "won"), ["bin"])


@query(
    "calibration_bins",
    "A24",
    b.with_ctes(b.BETS_SQL)
    + f"""SELECT r.bin, (r.bin + 0.5::DOUBLE) / 10 AS bin_center, round(avg(won), 6) AS actual_rate, count(won) AS bin_count
FROM (SELECT unnest(range(10)) AS bin) r LEFT JOIN {_DECIDED} d ON least(floor(d.model_prob * 10), 9) = r.bin GROUP BY r.bin""",
)
def calibration_bins(spark, sf_dir):
    return tidy(metrics.calibration_bins(decided(spark, sf_dir), "model_prob", "won"), ["bin"])


@query(
    "monthly_roi",
    "A25",
    b.with_ctes(b.BETS_SQL)
    + """SELECT strftime(bet_date, '%Y-%m') AS month, round(sum(bet_amount), 6) AS wagered, round(sum(profit), 6) AS profit,
  count(*) AS bet_count, round(sum(profit) / sum(bet_amount), 6) AS roi FROM bets GROUP BY 1""",
)
def monthly_roi(spark, sf_dir):
    return tidy(reports.monthly_roi(b.bets(spark, sf_dir)), ["month"])


@query(
    "edge_histogram",
    "A26",
    b.with_ctes(b.BETS_SQL)
    + """SELECT r.bin, count(e.edge) AS bet_count FROM (SELECT unnest(range(15)) AS bin) r LEFT JOIN
  (SELECT edge FROM bets WHERE edge >= 0 AND edge <= 0.15::DOUBLE) e
  ON e.edge >= 0.15::DOUBLE * r.bin / 15 AND (e.edge < 0.15::DOUBLE * (r.bin + 1) / 15 OR r.bin = 14) GROUP BY r.bin""",
)
def edge_histogram(spark, sf_dir):
    return reports.edge_histogram(b.bets(spark, sf_dir))


@query(
    "bet_type_counts",
    "A27",
    b.with_ctes(b.BETS_SQL) + "SELECT bet_type, count(*) AS bet_count FROM bets GROUP BY 1",
)
def bet_type_counts(spark, sf_dir):
    return reports.bet_type_counts(b.bets(spark, sf_dir))


_PERIOD_SQL = """SELECT {key} AS bet_type, count(*) AS total_predictions,
  round(count(*) FILTER (result = 'win') / CAST(count(*) AS DOUBLE), 6) AS accuracy, round(sum(profit) / sum(bet_amount), 6) AS roi,
  round(avg(edge), 6) AS clv, round(sum(bet_amount), 6) AS total_wagered, round(sum(profit), 6) AS total_profit,
  count(*) FILTER (result = 'win') AS win_count, count(*) FILTER (result = 'loss') AS loss_count,
  count(*) FILTER (result = 'push') AS push_count FROM bets {group}"""


@query(
    "period_report",
    "A29",
    b.with_ctes(b.BETS_SQL)
    + _PERIOD_SQL.format(key="bet_type", group="GROUP BY bet_type")
    + "\nUNION ALL " + _PERIOD_SQL.format(key="'all'", group=""),
)
def period_report(spark, sf_dir):
    return tidy(reports.period_report(b.bets(spark, sf_dir)), ["bet_type"])


@query(
    "rolling_win_rate",
    "W13",
    b.with_ctes(b.BETS_SQL)
    + """SELECT bet_no, round(win_rate, 6) AS win_rate FROM (
  SELECT row_number() OVER o AS bet_no, avg(CASE result WHEN 'win' THEN 1.0::DOUBLE ELSE 0 END) OVER (o ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS win_rate
  FROM bets WINDOW o AS (ORDER BY bet_date, game_id, line_no, part_id, supplier_id)) WHERE bet_no >= 50""",
)
def rolling_win_rate(spark, sf_dir):
    out = reports.rolling_win_rate(b.bets(spark, sf_dir), b.BET_LEVELS, b.BET_ORDER)
    return out.select("bet_no", F.round("win_rate", 6).alias("win_rate"))


@query(
    "cumulative_roi",
    "W14",
    b.with_ctes(b.BETS_SQL)
    + """SELECT row_number() OVER o AS bet_no, CAST(bet_date AS VARCHAR) AS bet_day,
  round(100 * sum(profit) OVER o / sum(bet_amount) OVER o, 6) AS roi_pct
  FROM bets WINDOW o AS (ORDER BY bet_date, game_id, line_no, part_id, supplier_id)""",
)
def cumulative_roi(spark, sf_dir):
    out = reports.cumulative_roi(b.bets(spark, sf_dir), b.BET_LEVELS, b.BET_ORDER)
    return out.select(
        "bet_no", F.col("bet_date").cast("string").alias("bet_day"),
        F.round("roi_pct", 6).alias("roi_pct"),
    )


@query(
    "bet_history",
    "P11",
    b.with_ctes(b.BETS_SQL)
    + """SELECT strftime(bet_date, '%Y-%m-%d') AS bet_day, game_id, line_no, part_id, supplier_id, bet_type,
  coalesce(CASE WHEN result <> 'push' THEN result END, 'pending') AS result,
  round(CASE WHEN bet_amount > 0 THEN profit / bet_amount ELSE 0 END, 6) AS profit_pct FROM bets""",
)
def bet_history(spark, sf_dir):
    raw = b.bets(spark, sf_dir).withColumn("result", F.nullif("result", F.lit("push")))
    return reports.bet_history(raw).select(
        "bet_day", "game_id", "line_no", "part_id", "supplier_id", "bet_type", "result",
        F.round("profit_pct", 6).alias("profit_pct"),
    )
