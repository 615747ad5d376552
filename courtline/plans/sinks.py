"""Table writes read back: repair, archive, JSON reports; and top factors."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from courtline.functions import misc
from courtline.operators import jobs, normalize, reports
from courtline.plans import bindings as b
from courtline.plans.registry import query
from courtline.session import ensure_checkpoint_dir
from courtline.sources import maintenance
from courtline.streaming import increments


def _folder(spark) -> str:
    """A fresh table folder in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/sink-{uuid.uuid4().hex}"


@query(
    "repaired_orders",
    "K03 K04",
    """SELECT CAST(year(o_orderdate) AS VARCHAR) AS season_id, count(*) AS orders, round(sum(CASE WHEN o_orderkey % 97 = 0 THEN 1 ELSE o_totalprice END), 4) AS amount
FROM orders WHERE o_orderkey % 97 <> 0 OR o_orderkey % 2 = 0 GROUP BY 1""",
)
def repaired_orders(spark, sf_dir):
    """Seasons written whole, then some games dropped and half of them put back."""
    path = _folder(spark)
    rows = b.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("game_id"), F.col("o_totalprice").alias("amount"),
        F.year("o_orderdate").cast("string").alias("season_id"),
    )
    maintenance.replace_partitions(path, rows, "season_id")
    broken = rows.filter("game_id % 97 = 0")
    fresh = broken.filter("game_id % 2 = 0").withColumn("amount", F.lit(1.0))
    maintenance.repair_games(path, broken.select("season_id", "game_id"), fresh, "season_id")
    table = spark.read.schema(rows.schema).parquet(path)
    return table.groupBy("season_id").agg(
        F.count(F.lit(1)).alias("orders"), F.round(F.sum("amount"), 4).alias("amount")
    )


@query(
    "archived_predictions",
    "K07",
    """SELECT strftime(o_orderdate, '%Y-%m') AS prediction_month, count(*) AS predictions, round(avg(CAST(o_orderkey % 101 AS DOUBLE) / 101), 6) AS mean_prob FROM orders GROUP BY 1""",
)
def archived_predictions(spark, sf_dir):
    """Predictions archived by month; a second run of the same months changes nothing."""
    path = _folder(spark)
    rows = b.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("game_id"), (F.col("o_orderkey") % 101 / 101.0).alias("prob"),
        F.date_format("o_orderdate", "yyyy-MM").alias("prediction_month"),
    )
    for _ in range(2):
        maintenance.archive_predictions(path, rows, "prediction_month")
    table = spark.read.schema(rows.schema).parquet(path)
    return table.groupBy("prediction_month").agg(
        F.count(F.lit(1)).alias("predictions"), F.round(F.avg("prob"), 6).alias("mean_prob")
    )


@query(
    "json_reports",
    "K06 K08 S19",
    b.with_ctes(b.BETS_SQL)
    + """SELECT 'roi' AS report, strftime(bet_date, '%Y-%m') AS label, round(sum(profit) / sum(bet_amount), 6) AS value FROM bets GROUP BY 2
UNION ALL SELECT 'edge_mean', CAST(year(bet_date) AS VARCHAR), round(avg(edge), 6) FROM bets GROUP BY 2""",
)
def json_reports(spark, sf_dir):
    """A report and a normaliser's statistics, written as JSON and read back."""
    bets = b.bets(spark, sf_dir)
    monthly = reports.monthly_roi(bets).select("month", "roi")
    stats = normalize.season_stats(
        bets.withColumn("season", F.year("bet_date").cast("string")), "season", ["edge"]
    )
    root = _folder(spark)
    maintenance.write_json(f"{root}/performance", monthly)
    maintenance.write_json(f"{root}/normaliser", stats)
    roi = maintenance.read_json(spark, f"{root}/performance", monthly.schema)
    state = maintenance.read_json(spark, f"{root}/normaliser", stats.schema)
    return roi.select(
        F.lit("roi").alias("report"), F.col("month").alias("label"), F.round("roi", 6).alias("value")
    ).unionByName(
        state.select(
            F.lit("edge_mean").alias("report"), F.col("season").alias("label"),
            F.round("mean_value", 6).alias("value"),
        )
    )


@query(
    "top_factors",
    "N04",
    """WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, unnest([{'n': 'discount', 'v': l_discount * 100 - 5}, {'n': 'part', 'v': CAST(l_partkey % 13 - 6 AS DOUBLE)},
  {'n': 'quantity', 'v': l_quantity - 25}, {'n': 'supplier', 'v': CAST(l_suppkey % 9 - 4 AS DOUBLE)}, {'n': 'tax', 'v': l_tax * 100 - 4}, {'n': 'zero', 'v': 0.0::DOUBLE}]) AS f FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate ORDER BY round(abs(f.v), 9) DESC, f.n) AS rn FROM f)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, string_agg(f.n, ',' ORDER BY rn) AS factors FROM r WHERE rn <= 3 GROUP BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate""",
)
def top_factors(spark, sf_dir):
    values = {
        "discount": F.col("l_discount") * 100 - 5, "part": F.col("l_partkey") % 13 - 6.0,
        "quantity": F.col("l_quantity") - 25, "supplier": F.col("l_suppkey") % 9 - 4.0,
        "tax": F.col("l_tax") * 100 - 4, "zero": F.lit(0.0),
    }
    factors = F.array(*[F.struct(F.lit(n).alias("name"), F.round(v, 9).alias("value")) for n, v in values.items()])
    best = misc.top_factors(factors, 3)
    return b.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.array_join(F.transform(best, lambda f: f["name"]), ",").alias("factors"),
    )


_MOVED = "o_orderkey % 10 = 1"


@query(
    "loaded_history",
    "K05 K01 K02",
    """WITH first AS (SELECT o_orderkey AS g, year(o_orderdate) AS s, 'scheduled' AS st FROM orders WHERE o_orderkey % 3 <> 0),
second AS (SELECT o_orderkey AS g, year(o_orderdate) + CASE WHEN o_orderkey % 10 = 1 THEN 1 ELSE 0 END AS s, 'completed' AS st FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 10 = 1),
games AS (SELECT * FROM second UNION ALL SELECT * FROM first WHERE g NOT IN (SELECT g FROM second)),
players AS (SELECT c_custkey AS p, CASE WHEN c_custkey % 2 = 1 OR c_custkey % 10 = 0 THEN 'second' ELSE 'first' END AS st FROM customer)
SELECT 'games' AS name, CAST(s AS VARCHAR) AS season_id, st AS status, count(*) AS stored, CAST(sum(g) AS BIGINT) AS ids FROM games GROUP BY 2, 3
UNION ALL SELECT 'players', NULL, st, count(*), CAST(sum(p) AS BIGINT) FROM players GROUP BY 3""",
)
def loaded_history(spark, sf_dir):
    """Two loads: the second brings other players, repeated ones, and games whose season moved."""
    root = _folder(spark)
    orders, people = b.table(spark, sf_dir, "orders"), b.table(spark, sf_dir, "customer")

    def games(rows, status, loaded, season):
        return rows.select(
            F.col("o_orderkey").alias("game_id"), season.cast("string").alias("season_id"),
            F.lit(status).alias("status"), F.lit(loaded).alias("loaded_at"), F.lit(1).alias("home_team_id"), F.lit(2).alias("away_team_id"),
        )

    def players(rows, loaded):
        return rows.select(F.col("c_custkey").alias("player_id"), F.lit(loaded).alias("full_name"))

    year = F.year("o_orderdate")
    jobs.load_history({
        "games": games(orders.filter("o_orderkey % 3 <> 0"), "scheduled", 1, year),
        "players": players(people.filter("c_custkey % 2 = 0"), "first"),
    }, root)
    moved = year + F.expr(_MOVED).cast("int")
    jobs.load_history({
        "games": games(orders.filter(f"o_orderkey % 3 = 0 OR {_MOVED}"), "completed", 2, moved),
        "players": players(people.filter("c_custkey % 2 = 1 OR c_custkey % 10 = 0"), "second"),
    }, root)
    schema = games(orders, "", 0, year).schema
    stored = spark.read.schema(schema).parquet(f"{root}/games").select(
        F.lit("games").alias("name"), "season_id", "status", F.col("game_id").alias("id")
    ).union(spark.read.parquet(f"{root}/players").select(
        F.lit("players"), F.lit(None).cast("string"), "full_name", "player_id"
    ))
    return stored.groupBy("name", "season_id", "status").agg(F.count(F.lit(1)).alias("stored"), F.sum("id").alias("ids"))


@query(
    "late_games",
    "Z01 Z02 K01",
    """SELECT year(o_orderdate) AS season_id, count(*) AS games, CAST(sum(o_orderkey) AS BIGINT) AS ids FROM orders WHERE o_orderstatus = 'F' GROUP BY 1""",
)
def late_games(spark, sf_dir):
    """A stream that brings the newer games first and the older ones, with repeats, later."""
    root = _folder(spark)
    rows = b.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("game_id"), F.year("o_orderdate").alias("season_id"),
        F.col("o_orderdate").cast("timestamp").alias("played_at"),
        F.when(F.col("o_orderstatus") == "F", "completed").otherwise("scheduled").alias("status"),
    )
    for part in (rows.filter("season_id >= 1998 OR game_id % 7 = 0"), rows.filter("season_id < 1998")):
        part.write.mode("append").parquet(f"{root}/landed")
        stream = increments.new_completed_games(increments.file_stream(spark, f"{root}/landed", rows.schema))
        increments.upsert_stream(
            stream, f"{root}/games", ["game_id"], ["played_at"], "season_id", f"{root}/progress"
        ).awaitTermination()
    table = spark.read.schema(rows.schema).parquet(f"{root}/games")
    return table.groupBy("season_id").agg(F.count(F.lit(1)).alias("games"), F.sum("game_id").alias("ids"))
