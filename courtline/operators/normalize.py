"""Season statistics and z-scores, fitted once and applied by join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtline.sources import maintenance


def season_stats(df: DataFrame, season: str, metrics: list[str]) -> DataFrame:
    """Mean, sample deviation, min and max per (season, metric).

    Nulls are left out; a deviation of zero, or of a single value, becomes 1. A
    metric that ``df`` lacks is skipped. One hash aggregate with map-side partials.
    """
    present = [m for m in metrics if m in df.columns]
    long = df.select(season, *[F.col(m).cast("double").alias(m) for m in present]).unpivot(
        [season], present, "metric_name", "value"
    )
    spread = F.stddev_samp("value")
    return (
        long.filter(F.col("value").isNotNull())
        .groupBy(season, "metric_name")
        .agg(
            F.avg("value").alias("mean_value"),
            F.when((F.count("value") < 2) | (spread == 0), 1.0).otherwise(spread).alias("std_value"),
            F.min("value").alias("min_value"),
            F.max("value").alias("max_value"),
        )
    )


def team_rates(box: DataFrame) -> DataFrame:
    """Three-point share of attempts per (game, season, team), on the sums of its players.

    Null where a team has no attempts or none are recorded.
    """
    threes, attempts = F.sum("fg3a"), F.sum("fga")
    return box.groupBy("game_id", "season_id", "team_id").agg(
        F.when(attempts > 0, threes / attempts).alias("fg3a_rate")
    )


def store_stats(path: str, stats: DataFrame, season: str = "season_id") -> None:
    """Upsert statistics by (season, metric) into a stored table, partitioned by season."""
    values = [c for c in stats.columns if c not in (season, "metric_name")]
    maintenance.upsert_table(path, stats, [season, "metric_name"], values, season)


def wide_stats(stats: DataFrame, season: str, metrics: list[str]) -> DataFrame:
    """One row per season with ``<metric>__mean`` and ``<metric>__std``."""
    picks = []
    for m in metrics:
        here = F.col("metric_name") == m
        picks.append(F.max(F.when(here, F.col("mean_value"))).alias(f"{m}__mean"))
        picks.append(F.max(F.when(here, F.col("std_value"))).alias(f"{m}__std"))
    return stats.groupBy(season).agg(*picks)


def z_scores(
    df: DataFrame, stats: DataFrame, season: str, metrics: list[str], check: bool = True
) -> DataFrame:
    """Add ``<metric>_z``. With ``check`` a season without statistics is an error."""
    present = [m for m in metrics if m in df.columns]
    side = wide_stats(stats, season, present).withColumn("__seen", F.lit(True))
    joined = df.join(side, season, "left")

    def score(m: str):
        z = (F.col(m) - F.col(f"{m}__mean")) / F.col(f"{m}__std")
        if not check:
            return z
        unseen = F.raise_error(F.concat(F.lit("no statistics for season "), F.col(season).cast("string")))
        return F.when(F.col("__seen").isNull(), unseen.cast("double")).otherwise(z)

    return joined.select(*df.columns, *[score(m).alias(f"{m}_z") for m in present])


def inverse_z(df: DataFrame, stats: DataFrame, season: str, metric: str, name: str) -> DataFrame:
    """Turn ``<metric>_z`` back into values."""
    side = wide_stats(stats, season, [metric])
    value = F.col(f"{metric}_z") * F.col(f"{metric}__std") + F.col(f"{metric}__mean")
    return df.join(side, season, "left").select(*df.columns, value.alias(name))
