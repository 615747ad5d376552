"""Report tables over bets, signals and predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtline.functions.misc import ratio_or
from courtline.operators.ordered import running

# Edge histogram range, health and retraining bounds.
EDGE_HIGH, EDGE_BINS = 0.15, 15
CRITICAL_FEATURES, CRITICAL_ACCURACY, CRITICAL_BRIER = 3, 0.48, 0.30
WARNING_ACCURACY, WARNING_BRIER = 0.52, 0.26
RETRAIN_ACCURACY, RETRAIN_BRIER, RETRAIN_ROI = 0.48, 0.28, -0.05
ASSUMED_ACCURACY, ASSUMED_BRIER = 0.55, 0.22
PERIODS = ("week", "month", "season", "all")
# Decimals and list lengths of shown rows, sentences of the health report.
PREDICTION_PLACES = {
    "home_win_prob": 4, "predicted_margin": 1, "predicted_total": 1, "home_win_prob_adjusted": 4,
    "predicted_margin_adjusted": 1, "predicted_total_adjusted": 1, "confidence": 3, "injury_uncertainty": 3,
}
PREDICTION_FIRSTS = {"top_factors": 5}
SIGNAL_PLACES = {
    "model_prob": 4, "market_prob": 4, "edge": 4, "recommended_odds": 3, "kelly_fraction": 4, "recommended_stake_pct": 4,
}
SIGNAL_FIRSTS = {"key_factors": 3, "injury_notes": 3}
REASONS = {
    "many": "Significant covariate drift in %d features",
    "one": "Covariate drift detected in: ",
    "accuracy": "Accuracy degraded to %.1f%%",
    "brier": "Calibration degraded (Brier: %.3f)",
    "roi": "Negative ROI: %.1f%%",
    "none": "Model performance within acceptable thresholds",
}


def _money() -> tuple[Column, Column]:
    return F.sum("bet_amount"), F.sum(F.coalesce("profit", F.lit(0.0)))


def monthly_roi(bets: DataFrame) -> DataFrame:
    staked, gained = _money()
    return bets.groupBy(F.date_format("bet_date", "yyyy-MM").alias("month")).agg(
        staked.alias("wagered"),
        gained.alias("profit"),
        F.count(F.lit(1)).alias("bet_count"),
        ratio_or(gained, staked).alias("roi"),
    )


def edge_histogram(bets: DataFrame, high: float = EDGE_HIGH, bins: int = EDGE_BINS) -> DataFrame:
    """Equal bins on [0, high]; other edges are left out, the last bin is closed."""
    marks = F.array(*[F.lit(high * i / bins) for i in range(bins + 1)])
    slot = F.least(F.size(F.filter(marks, lambda m: m <= F.col("edge"))) - 1, F.lit(bins - 1))
    counted = (
        bets.filter(F.col("edge").between(0, high))
        .groupBy(slot.cast("bigint").alias("bin"))
        .agg(F.count(F.lit(1)).alias("bet_count"))
    )
    frame = bets.sparkSession.range(bins).select(F.col("id").alias("bin"))
    return frame.join(counted, "bin", "left").select(
        "bin", F.coalesce("bet_count", F.lit(0)).alias("bet_count")
    )


def bet_type_counts(bets: DataFrame) -> DataFrame:
    return bets.groupBy("bet_type").agg(F.count(F.lit(1)).alias("bet_count")).orderBy(
        F.desc("bet_count"), "bet_type"
    )


def period_report(bets: DataFrame) -> DataFrame:
    """Accuracy counts pushes in its base; the clv figure is the mean edge."""
    staked, gained = _money()
    n, wins = F.count(F.lit(1)), F.count_if(F.col("result") == "win")
    return (
        bets.rollup("bet_type")
        .agg(
            F.grouping("bet_type").alias("__all"),
            n.alias("total_predictions"),
            ratio_or(wins, n).alias("accuracy"),
            ratio_or(gained, staked).alias("roi"),
            F.avg("edge").alias("clv"),
            staked.alias("total_wagered"),
            gained.alias("total_profit"),
            wins.alias("win_count"),
            F.count_if(F.col("result") == "loss").alias("loss_count"),
            F.count_if(F.col("result") == "push").alias("push_count"),
        )
        .withColumn("bet_type", F.when(F.col("__all") == 1, "all").otherwise(F.col("bet_type")))
        .drop("__all")
    )


def daily_summary(predictions: DataFrame, signals: DataFrame, day: str) -> DataFrame:
    games = predictions.groupBy(day).agg(F.count(F.lit(1)).alias("total_games"))
    found = signals.groupBy(day).agg(
        F.count(F.lit(1)).alias("total_signals"),
        F.count_if(F.col("confidence") == "high").alias("high_confidence_signals"),
        F.count_if(F.col("confidence") == "medium").alias("medium_confidence_signals"),
        F.avg("edge").alias("avg_edge"),
        F.max("edge").alias("max_edge"),
    )
    zero = [c for c in found.columns if c != day]
    return games.join(found, day, "left").select(
        day, "total_games", *[F.coalesce(c, F.lit(0)).alias(c) for c in zero]
    )


def rolling_win_rate(
    bets: DataFrame, levels: list[str], order: list[str], window: int = 50
) -> DataFrame:
    """Win share of each full window of ``window`` bets in order.

    The share is a difference of two running counts that meet on the bet number,
    so no task holds more than its share of the bets.
    """
    counted = running(
        bets.select(*order, *[c for c in levels if c not in order], (F.col("result") == "win").cast("int").alias("w")),
        [], levels, order, rank="bet_no", sums={"wins": F.col("w")},
    ).select("bet_no", "wins")
    earlier = counted.select(
        (F.col("bet_no") + window).alias("bet_no"), F.col("wins").alias("wins_before")
    )
    return (
        counted.filter(F.col("bet_no") >= window)
        .join(earlier, "bet_no", "left")
        .select(
            "bet_no",
            ((F.col("wins") - F.coalesce("wins_before", F.lit(0))) / window).alias("win_rate"),
        )
    )


def cumulative_roi(bets: DataFrame, levels: list[str], order: list[str]) -> DataFrame:
    """Profit over stake so far, in percent, at every bet."""
    summed = running(
        bets, [], levels, order, rank="bet_no",
        sums={
            "wagered_so_far": F.col("bet_amount"),
            "profit_so_far": F.coalesce("profit", F.lit(0.0)),
        },
    )
    share = ratio_or(F.col("profit_so_far"), F.col("wagered_so_far"))
    return summed.select(
        "bet_no", F.col("bet_date"), (share * 100).alias("roi_pct")
    )


def _shown(rows: DataFrame, places: dict[str, int], firsts: dict[str, int]) -> DataFrame:
    """Rows with some columns rounded and some lists cut to their first entries."""
    rounded = {c: F.round(c, n) for c, n in places.items() if c in rows.columns}
    cut = {c: F.slice(c, 1, n) for c, n in firsts.items() if c in rows.columns}
    return rows.withColumns(rounded | cut)


def formatted_predictions(predictions: DataFrame) -> DataFrame:
    return _shown(predictions, PREDICTION_PLACES, PREDICTION_FIRSTS)


def formatted_signals(signals: DataFrame) -> DataFrame:
    return _shown(signals, SIGNAL_PLACES, SIGNAL_FIRSTS)


def bet_history(bets: DataFrame) -> DataFrame:
    return bets.select(
        F.date_format("bet_date", "yyyy-MM-dd").alias("bet_day"),
        *[c for c in bets.columns if c not in ("bet_date", "result")],
        F.coalesce("result", F.lit("pending")).alias("result"),
        F.coalesce(ratio_or(F.col("profit"), F.col("bet_amount")), F.lit(0.0)).alias("profit_pct"),
    )


def health_status(drift: DataFrame, recent: DataFrame) -> DataFrame:
    """One row: status, whether to retrain, and why.

    ``drift`` has feature and is_drifted; ``recent`` is one row with accuracy,
    brier_score and roi, or none. Features are few, being a list of columns.
    """
    names = F.array_sort(F.collect_list(F.when(F.col("is_drifted"), F.col("feature"))))
    both = drift.agg(names.alias("features")).withColumns(
        {c: recent.agg(F.max(c)).scalar() for c in ("accuracy", "brier_score", "roi")}
    )
    accuracy = F.coalesce("accuracy", F.lit(ASSUMED_ACCURACY))
    brier = F.coalesce("brier_score", F.lit(ASSUMED_BRIER))
    roi = F.coalesce("roi", F.lit(0.0))
    n = F.size("features")
    status = (
        F.when(
            (n >= CRITICAL_FEATURES) | (accuracy < CRITICAL_ACCURACY) | (brier > CRITICAL_BRIER),
            "critical",
        )
        .when((n > 0) | (accuracy < WARNING_ACCURACY) | (brier > WARNING_BRIER), "warning")
        .otherwise("healthy")
    )
    reasons = F.array_compact(
        F.array(
            F.when(n >= 2, F.format_string(REASONS["many"], n))
            .when(n == 1, F.concat(F.lit(REASONS["one"]), F.array_join("features", ", "))),
            F.when(accuracy < RETRAIN_ACCURACY, F.format_string(REASONS["accuracy"], accuracy * 100)),
            F.when(brier > RETRAIN_BRIER, F.format_string(REASONS["brier"], brier)),
            F.when(roi < RETRAIN_ROI, F.format_string(REASONS["roi"], roi * 100)),
        )
    )
    return both.select(
        status.alias("status"),
        (n > 0).alias("drift_detected"),
        F.array_join("features", ",").alias("features_drifted"),
        (F.size(reasons) > 0).alias("retraining_recommended"),
        F.when(F.size(reasons) > 0, F.array_join(reasons, "; "))
        .otherwise(REASONS["none"])
        .alias("recommendation_reason"),
    )
