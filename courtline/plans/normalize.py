"""Season statistics and z-scores on orders and lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from courtline.operators import normalize as ops
from courtline.plans import bindings as b
from courtline.plans.registry import query

METRICS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

_STATS_SQL = "\nUNION ALL ".join(
    f"""SELECT year(l_shipdate) AS season, '{m}' AS metric_name, round(avg({m}), 6) AS mean_value,
  round(CASE WHEN count({m}) < 2 OR stddev_samp({m}) = 0 THEN 1 ELSE stddev_samp({m}) END, 6) AS std_value,
  min({m}) AS min_value, max({m}) AS max_value FROM lineitem GROUP BY 1"""
    for m in METRICS
)


def _lines(spark, sf_dir):
    return b.table(spark, sf_dir, "lineitem").withColumn("season", F.year("l_shipdate").cast("bigint"))


@query(
    "season_stats",
    "A01 F01",
    f"SELECT CAST(season AS BIGINT) AS season, * EXCLUDE (season) FROM ({_STATS_SQL})",
)
def season_stats(spark, sf_dir):
    s = ops.season_stats(_lines(spark, sf_dir), "season", [*METRICS, "absent_metric"])
    return s.select(
        "season", "metric_name", F.round("mean_value", 6).alias("mean_value"),
        F.round("std_value", 6).alias("std_value"), "min_value", "max_value",
    )


@query(
    "season_stats_filter",
    "A02",
    f"SELECT CAST(season AS BIGINT) AS season, * EXCLUDE (season) FROM ({_STATS_SQL}) WHERE season = 1998",
)
def season_stats_filter(spark, sf_dir):
    return season_stats(spark, sf_dir).filter("season = 1998")


@query(
    "season_z_scores",
    "W08 J02",
    """WITH s AS (SELECT season_id, avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM orders
  JOIN games ON game_id = o_orderkey GROUP BY 1)
SELECT o_orderkey, g.season_id, round((o_totalprice - m) / s, 6) AS o_totalprice_z
FROM orders JOIN games g ON game_id = o_orderkey JOIN s ON s.season_id = g.season_id""".replace(
        "WITH s AS", b.with_ctes(b.GAMES_SQL).rstrip() + ", s AS"
    ),
)
def season_z_scores(spark, sf_dir):
    seasons = b.games(spark, sf_dir).select(F.col("game_id").alias("o_orderkey"), "season_id")
    rows = b.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").join(
        seasons, "o_orderkey", "left"
    )
    stats = ops.season_stats(rows, "season_id", ["o_totalprice"])
    z = ops.z_scores(rows, stats, "season_id", ["o_totalprice"])
    return z.select("o_orderkey", "season_id", F.round("o_totalprice_z", 6).alias("o_totalprice_z"))


@query(
    "inverse_z_scores",
    "W09",
    "SELECT l_returnflag, CAST(count(*) AS BIGINT) AS row_count, round(sum(l_quantity), 4) AS restored_sum FROM lineitem GROUP BY 1",
)
def inverse_z_scores(spark, sf_dir):
    rows = _lines(spark, sf_dir).select("season", "l_returnflag", "l_quantity")
    stats = ops.season_stats(rows, "season", ["l_quantity"])
    z = ops.z_scores(rows, stats, "season", ["l_quantity"]).drop("l_quantity")
    back = ops.inverse_z(z, stats, "season", "l_quantity", "restored")
    return back.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("row_count"), F.round(F.sum("restored"), 4).alias("restored_sum")
    )
