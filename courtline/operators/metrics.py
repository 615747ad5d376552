"""Betting, calibration and prediction metrics, each one aggregate pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtline.functions.misc import ratio_or
from courtline.functions.odds import LINE_ODDS, closing_line_value

# Sample minimum for risk figures, annual periods, clip bounds.
MIN_RISK_BETS = 10
PERIODS_PER_YEAR = 252
DAYS_PER_YEAR = 365.25
BET_CLIP = 1e-15
MODEL_CLIP = 1e-7
INITIAL_BANKROLL = 10000.0


def log_loss(prob: Column, outcome: Column, clip: float) -> Column:
    p = F.greatest(F.lit(clip), F.least(F.lit(1 - clip), prob))
    return -F.avg(outcome * F.ln(p) + (1 - outcome) * F.ln(1 - p))


def betting_aggregates(bankroll: float = INITIAL_BANKROLL) -> list[Column]:
    """Aggregates over columns bet_date, result, bet_amount, profit, edge,
    market_odds, model_prob."""
    won, lost = F.col("result") == "win", F.col("result") == "loss"
    profit = F.coalesce("profit", F.lit(0.0))
    back = ratio_or(profit, F.col("bet_amount"))
    n, wins, losses = F.count(F.lit(1)), F.count_if(won), F.count_if(lost)
    staked, gained = F.sum("bet_amount"), F.sum(profit)
    days = F.datediff(F.max("bet_date"), F.min("bet_date"))
    years = F.when(days > 0, days / DAYS_PER_YEAR).otherwise(1.0)
    enough = n >= MIN_RISK_BETS
    spread = F.stddev_pop(back)
    downside = F.stddev_pop(F.when(back < 0, back))
    scale = F.sqrt(F.least(n, F.lit(PERIODS_PER_YEAR)))
    outcome = F.when(won, 1.0).when(lost, 0.0)
    decided_prob = F.when(won | lost, F.col("model_prob"))
    return [
        n.alias("total_bets"),
        wins.alias("win_count"),
        losses.alias("loss_count"),
        F.count_if(F.col("result") == "push").alias("push_count"),
        ratio_or(wins, wins + losses).alias("win_rate"),
        staked.alias("total_wagered"),
        gained.alias("total_profit"),
        F.avg("edge").alias("avg_edge"),
        F.avg("market_odds").alias("avg_odds"),
        ratio_or(gained, staked).alias("roi"),
        (gained / bankroll).alias("total_return"),
        F.avg(back).alias("avg_bet_return"),
        F.when(gained + bankroll > 0, F.pow((gained + bankroll) / bankroll, 1 / years) - 1)
        .otherwise(0.0).alias("cagr"),
        F.when(enough, spread).otherwise(0.0).alias("volatility"),
        F.when(enough & (spread > 0), F.avg(back) / spread * scale).otherwise(0.0).alias("sharpe_ratio"),
        F.when(enough & (downside > 0), F.avg(back) / downside * scale)
        .otherwise(0.0).alias("sortino_ratio"),
        F.coalesce(F.avg(F.pow(decided_prob - outcome, 2)), F.lit(0.0)).alias("brier_score"),
        F.coalesce(log_loss(decided_prob, outcome, BET_CLIP), F.lit(0.0)).alias("log_loss"),
    ]


def betting_metrics(bets: DataFrame, bankroll: float = INITIAL_BANKROLL) -> DataFrame:
    """Every metric per bet type and, in the same pass, over all bets ("all")."""
    return (
        bets.rollup("bet_type")
        .agg(F.grouping("bet_type").alias("__all"), *betting_aggregates(bankroll))
        .withColumn("bet_type", F.when(F.col("__all") == 1, "all").otherwise(F.col("bet_type")))
        .drop("__all")
    )


def with_closing_odds(bets: DataFrame, closing: DataFrame) -> DataFrame:
    """Bets of games that have a closing row, with that side's closing price.

    ``closing`` is one row per game: home_ml, away_ml, spread_odds, total_odds.
    """
    price = (
        F.when((F.col("bet_type") == "moneyline") & (F.col("side") == "home"), F.col("home_ml"))
        .when((F.col("bet_type") == "moneyline") & (F.col("side") == "away"), F.col("away_ml"))
        .when(F.col("bet_type") == "spread", F.coalesce("spread_odds", F.lit(LINE_ODDS)))
        .when(F.col("bet_type") == "total", F.coalesce("total_odds", F.lit(LINE_ODDS)))
    )
    joined = bets.join(closing, "game_id").withColumn("closing_odds", price)
    return joined.select(*bets.columns, "closing_odds")


def clv_metrics(bets: DataFrame, closing: DataFrame) -> DataFrame:
    value = closing_line_value(F.col("market_odds"), F.col("closing_odds"))
    priced = with_closing_odds(bets, closing).select("bet_type", value.alias("clv"))
    return priced.filter(F.col("clv").isNotNull()).groupBy("bet_type").agg(
        F.count("clv").alias("priced_bets"),
        F.avg("clv").alias("avg_clv"),
        F.avg((F.col("clv") > 0).cast("double")).alias("clv_positive_rate"),
    )


def full_metrics(bets: DataFrame, closing: DataFrame, fall: DataFrame, bankroll: float = INITIAL_BANKROLL) -> DataFrame:
    """One row: betting, return, risk and calibration figures, drawdown and closing-line value.

    ``fall`` is the one-row drawdown of the same bets' equity curve. Every part is an
    aggregate of one row, joined as scalar subqueries.
    """
    row = bets.agg(*betting_aggregates(bankroll))
    value = closing_line_value(F.col("market_odds"), F.col("closing_odds"))
    priced = with_closing_odds(bets, closing).select(value.alias("clv")).filter("clv is not null").agg(
        F.count("clv").alias("priced_bets"), F.avg("clv").alias("avg_clv"),
        F.avg((F.col("clv") > 0).cast("double")).alias("clv_positive_rate"),
    )
    sides = {c: side.select(c).scalar() for side in (priced, fall) for c in side.columns}
    return row.withColumns(sides)


def calibration_curve(df: DataFrame, prob: str, outcome: str, bins: int = 10) -> DataFrame:
    """Non-empty half-open bins of [0, 1): centre, hit rate, size."""
    slot = F.floor(F.col(prob) * bins)
    return (
        df.filter((F.col(prob) >= 0) & (F.col(prob) < 1))
        .groupBy(slot.alias("bin"))
        .agg(F.avg(outcome).alias("actual_rate"), F.count(F.lit(1)).alias("bin_count"))
        .withColumn("bin_center", (F.col("bin") + 0.5) / bins)
    )


def calibration_bins(df: DataFrame, prob: str, outcome: str, bins: int = 10) -> DataFrame:
    """All bins; a probability of 1 falls into the last, an empty bin has a null rate."""
    slot = F.least(F.floor(F.col(prob) * bins), F.lit(bins - 1))
    filled = df.groupBy(slot.alias("bin")).agg(
        F.avg(outcome).alias("actual_rate"), F.count(F.lit(1)).alias("bin_count")
    )
    frame = df.sparkSession.range(bins).select(F.col("id").alias("bin"))
    return frame.join(filled, "bin", "left").select(
        "bin",
        ((F.col("bin") + 0.5) / bins).alias("bin_center"),
        "actual_rate",
        F.coalesce("bin_count", F.lit(0)).alias("bin_count"),
    )


def prediction_aggregates(strict: bool) -> list[Column]:
    """Model metrics over win_prob, margin, total and the actual win, margin, total.

    ``strict`` counts a win as predicted only above one half, else from one half on.
    """
    called = F.col("win_prob") > 0.5 if strict else F.col("win_prob") >= 0.5
    hit = (called.cast("int") == F.col("actual_win")).cast("double")
    return [
        F.count(F.lit(1)).alias("games"),
        F.avg(hit).alias("accuracy"),
        F.avg(F.abs(F.col("margin") - F.col("actual_margin"))).alias("margin_mae"),
        F.avg(F.abs(F.col("total") - F.col("actual_total"))).alias("total_mae"),
        F.avg(F.pow(F.col("win_prob") - F.col("actual_win"), 2)).alias("brier_score"),
        log_loss(F.col("win_prob"), F.col("actual_win"), MODEL_CLIP).alias("log_loss"),
    ]


def huber(error: Column, delta: float = 1.0) -> Column:
    size = F.abs(error)
    return F.when(size <= delta, 0.5 * error * error).otherwise(delta * (size - 0.5 * delta))


def multitask_loss(
    win: float = 1.0, margin: float = 1.0, total: float = 1.0, delta: float = 1.0
) -> list[Column]:
    parts = {
        "win_loss": log_loss(F.col("win_prob"), F.col("actual_win"), MODEL_CLIP),
        "margin_loss": F.avg(huber(F.col("margin") - F.col("actual_margin"), delta)),
        "total_loss": F.avg(huber(F.col("total") - F.col("actual_total"), delta)),
    }
    combined = (
        parts["win_loss"] * win + parts["margin_loss"] * margin + parts["total_loss"] * total
    )
    return [*[c.alias(n) for n, c in parts.items()], combined.alias("combined_loss")]
