"""Composite jobs on the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtline.operators import jobs
from courtline.plans import bindings as b
from courtline.plans import context, odds, ratings
from courtline.plans.registry import query


@query(
    "performance_series",
    "C21",
    b.with_ctes(b.BETS_SQL)
    + """, m AS (SELECT strftime(bet_date, '%Y-%m') AS k, sum(profit) / sum(bet_amount) AS v FROM bets GROUP BY 1)
SELECT 'monthly_roi' AS series, k AS label, round(v, 6) AS value FROM m
UNION ALL SELECT 'bet_types', bet_type, CAST(count(*) AS DOUBLE) FROM bets GROUP BY 2
UNION ALL SELECT 'calibration', CAST(r.bin AS VARCHAR), round(avg(CASE result WHEN 'win' THEN 1.0::DOUBLE WHEN 'loss' THEN 0 END), 6)
  FROM (SELECT unnest(range(10)) AS bin) r LEFT JOIN (SELECT * FROM bets WHERE result <> 'push') d ON least(floor(model_prob * 10), 9) = r.bin GROUP BY r.bin
UNION ALL SELECT 'win_rate_rows', 'all', CAST(count(*) - 49 AS DOUBLE) FROM bets
UNION ALL SELECT 'final_roi', 'all', round(100 * sum(profit) / sum(bet_amount), 6) FROM bets""",
)
def performance_series(spark, sf_dir):
    s = jobs.performance_series(b.bets(spark, sf_dir), b.BET_LEVELS, b.BET_ORDER)
    row = lambda df, series, label, value: df.select(
        F.lit(series).alias("series"), label.cast("string").alias("label"),
        F.round(value.cast("double"), 6).alias("value"),
    )
    last = s["cumulative_roi"].agg(F.max_by("roi_pct", "bet_no").alias("v"))
    parts = [
        row(s["monthly_roi"], "monthly_roi", F.col("month"), F.col("roi")),
        row(s["bet_types"], "bet_types", F.col("bet_type"), F.col("bet_count")),
        row(s["calibration"], "calibration", F.col("bin"), F.col("actual_rate")),
        row(s["win_rate"].agg(F.count(F.lit(1)).alias("n")), "win_rate_rows", F.lit("all"), F.col("n")),
        row(last, "final_roi", F.lit("all"), F.col("v")),
    ]
    return reduce(DataFrame.unionByName, parts)


@query(
    "feature_build",
    "C05 K02 K03",
    b.with_ctes(b.GAMES_SQL, b.STINTS_SQL, ratings._EXPOSURE_SQL, ratings._RATED_SQL)
    + f""", team_days AS (SELECT home_team_id AS team_id, game_date FROM games UNION SELECT away_team_id, game_date FROM games),
fives AS (SELECT season_id, list_sort(home_lineup) AS lineup FROM stints UNION SELECT season_id, list_sort(away_lineup) FROM stints)
SELECT 'season_stats' AS feature_table, CAST(season_id AS VARCHAR) AS part, CAST({len(context.METRICS)} AS BIGINT) AS rows FROM (SELECT DISTINCT season_id FROM games)
UNION ALL SELECT 'player_rapm', CAST(season_id AS VARCHAR), count(*) FROM rated GROUP BY 2
UNION ALL SELECT 'lineup_spacing', CAST(season_id AS VARCHAR), count(*) FROM fives GROUP BY 2
UNION ALL SELECT 'team_game_fatigue', CAST(team_id AS VARCHAR), count(*) FROM team_days GROUP BY 2""",
)
def feature_build(spark, sf_dir):
    """Row counts of the four feature tables per season or team."""
    shots = b.shots(spark, sf_dir).withColumn("season_id", F.col("season").cast("string"))
    lat, lon = b.venue(F.col("venue_team"))
    built = jobs.build_features(
        context.team_stats(spark, sf_dir), context.METRICS, b.stints(spark, sf_dir), shots,
        b.games(spark, sf_dir), lat, lon, ratings.LAM, ratings.MIN_MINUTES, ratings.TAU,
    )
    return reduce(
        DataFrame.unionByName,
        [
            df.groupBy(F.lit(name).alias("feature_table"), F.col("season_id" if "season_id" in df.columns else "team_id").cast("string").alias("part"))
            .agg(F.count(F.lit(1)).alias("rows"))
            for name, df in built.items()
        ],
    )


FEATURES = ["home_rapm_sum", "away_rapm_sum", "home_off_rating_z", "away_off_rating_z", "home_rest_days", "away_rest_days"]


@query("scored_games", "C15 F02 P06 P07 W17")
def scored_games(spark, sf_dir):
    """Model trained on the earlier games, predictions for the last fifth by date."""
    from courtline.operators import backtest

    split = backtest.temporal_split(odds.ordered_games(spark, sf_dir), odds.GAME_LEVELS, odds.GAME_ORDER)
    rows = split.join(context._context(spark, sf_dir).select("game_id", *FEATURES), "game_id").persist()
    train = jobs.GameModel.labels(rows.filter("role = 'train' AND status = 'completed'"))
    made = jobs.GameModel.fit(train, FEATURES).predict(rows.filter("role = 'validation'"))
    return made.select("game_id", "home_win_prob", "predicted_margin", "predicted_total", "confidence")
