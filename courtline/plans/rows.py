"""Full metric row, shown rows, player defaults, stored statistics and filtered or broken input."""

from __future__ import annotations

from pyspark.sql import functions as F

from courtline.operators import backtest as bt
from courtline.operators import injuries, metrics, normalize, reports
from courtline.plans import bindings as b
from courtline.plans import betting, monitor, odds
from courtline.plans.registry import query
from courtline.plans.sinks import _folder
from courtline.sources import maintenance, payloads

_CLOSE_SQL = """SELECT market_odds, CASE
      WHEN bet_type = 'spread' THEN CASE WHEN o_orderkey % 5 <> 0 THEN 1.8::DOUBLE + (o_orderkey % 20)::DOUBLE / 100 ELSE 1.91::DOUBLE END
      WHEN bet_type = 'total' THEN CASE WHEN o_orderkey % 3 <> 0 THEN 1.7::DOUBLE + (o_orderkey % 40)::DOUBLE / 100 ELSE 1.91::DOUBLE END
      WHEN side = 'home' THEN CASE WHEN o_custkey % 7 <> 0 THEN 1.3::DOUBLE + (o_custkey % 200)::DOUBLE / 100 END
      ELSE CASE WHEN o_custkey % 11 <> 0 THEN 1.4::DOUBLE + (o_custkey % 150)::DOUBLE / 100 END END AS close
    FROM bets JOIN orders ON game_id = o_orderkey WHERE o_orderkey % 13 <> 0"""


@query(
    "full_metrics",
    "A22",
    odds._BET_EQUITY_SQL + ", m AS (" + betting._METRIC_SQL.format(key="'all'", group="") + f"""),
v AS (SELECT bet_no, round(10000 * exp(lg), 6) AS v FROM eq),
p AS (SELECT *, greatest(10000, max(v) OVER (ORDER BY bet_no)) AS peak FROM v),
q AS (SELECT *, coalesce(max(CASE WHEN v >= peak THEN bet_no END) OVER (ORDER BY bet_no), 0) AS peak_no FROM p),
c AS (SELECT (1.0 / close - 1.0 / market_odds) / (1.0 / market_odds) AS clv FROM ({_CLOSE_SQL}) WHERE close > 1 AND market_odds > 1)
SELECT m.* EXCLUDE (bet_type), (SELECT count(*) FROM c) AS priced_bets, (SELECT round(avg(clv), 6) FROM c) AS avg_clv,
  (SELECT round(avg(CASE WHEN clv > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) FROM c) AS clv_positive_rate,
  (SELECT round(max((peak - v) / peak), 6) FROM q) AS max_drawdown,
  (SELECT CAST(coalesce(max(bet_no - peak_no + 1) FILTER (v < peak), 0) AS BIGINT) FROM q) AS max_drawdown_steps FROM m""",
)
def full_metrics(spark, sf_dir):
    curve = odds.bet_curve(spark, sf_dir).withColumn("bankroll", F.round("bankroll", 6))
    fall = bt.drawdown(curve, [], b.BET_LEVELS, b.BET_ORDER)
    out = metrics.full_metrics(b.bets(spark, sf_dir), betting.closing(spark, sf_dir), fall)
    return betting.tidy(out.withColumn("max_drawdown_steps", F.col("max_drawdown_steps").cast("double")), []).withColumn(
        "max_drawdown_steps", F.col("max_drawdown_steps").cast("bigint")
    )


_FACTORS = "['rest', 'travel', 'form', 'lineup', 'spacing', 'injury', 'home']"


@query(
    "formatted_predictions",
    "P10",
    f"""SELECT o_orderkey AS game_id, round(x / 1000003::DOUBLE, 4) AS home_win_prob, round(x / 50021::DOUBLE - 10, 1) AS predicted_margin,
  round(200 + x / 50021::DOUBLE, 1) AS predicted_total, round(x / 1000033::DOUBLE, 3) AS confidence,
  array_to_string(({_FACTORS})[1 : least(5, o_orderkey % 8)], ',') AS top_factors
FROM (SELECT o_orderkey, (o_orderkey * 7919) % 1000003 AS x FROM orders)""",
)
def formatted_predictions(spark, sf_dir):
    x = F.pmod(F.col("o_orderkey") * 7919, F.lit(1000003))
    factors = F.array(*map(F.lit, ["rest", "travel", "form", "lineup", "spacing", "injury", "home"]))
    rows = b.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("game_id"), (x / 1000003).alias("home_win_prob"), (x / 50021 - 10).alias("predicted_margin"),
        (200 + x / 50021).alias("predicted_total"), (x / 1000033).alias("confidence"),
        F.slice(factors, F.lit(1), (F.col("o_orderkey") % 8).cast("int")).alias("top_factors"),
    )
    return reports.formatted_predictions(rows).withColumn("top_factors", F.array_join("top_factors", ","))


@query(
    "formatted_signals",
    "P10",
    f"""SELECT o_orderkey AS game_id, round(x / 1000003::DOUBLE, 4) AS model_prob, round(x / 1000033::DOUBLE, 4) AS edge,
  round(1 + x / 500009::DOUBLE, 3) AS recommended_odds, array_to_string(({_FACTORS})[1 : least(3, o_orderkey % 8)], ',') AS key_factors
FROM (SELECT o_orderkey, (o_orderkey * 104729) % 1000003 AS x FROM orders)""",
)
def formatted_signals(spark, sf_dir):
    x = F.pmod(F.col("o_orderkey") * 104729, F.lit(1000003))
    factors = F.array(*map(F.lit, ["rest", "travel", "form", "lineup", "spacing", "injury", "home"]))
    rows = b.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("game_id"), (x / 1000003).alias("model_prob"), (x / 1000033).alias("edge"),
        (1 + x / 500009).alias("recommended_odds"),
        F.slice(factors, F.lit(1), (F.col("o_orderkey") % 8).cast("int")).alias("key_factors"),
    )
    return reports.formatted_signals(rows).withColumn("key_factors", F.array_join("key_factors", ","))


@query(
    "player_defaults",
    "J08",
    b.with_ctes(monitor._RATING_SQL)
    + """SELECT c_custkey AS player_id, CASE WHEN c_custkey % 4 <> 0 AND c_custkey % 3 <> 0 THEN 70 + c_custkey % 15 ELSE 78 END AS height_inches,
  CASE WHEN c_custkey % 4 <> 0 AND c_custkey % 5 <> 0 THEN 180 + c_custkey % 90 ELSE 210 END AS weight_lbs, round(coalesce(rapm, 0), 6) AS rapm
FROM customer LEFT JOIN rat ON player_id = c_custkey""",
)
def player_defaults(spark, sf_dir):
    """Details that lack players, heights and weights; ratings that lack players."""
    k = F.col("c_custkey")
    people = b.table(spark, sf_dir, "customer")
    details = people.filter(k % 4 != 0).select(
        k.alias("player_id"), F.when(k % 3 != 0, 70 + k % 15).alias("height_inches"), F.when(k % 5 != 0, 180 + k % 90).alias("weight_lbs")
    )
    out = injuries.with_defaults(people.select(k.alias("player_id")), details, monitor.player_ratings(spark, sf_dir))
    return out.withColumn("rapm", F.round("rapm", 6))


_BOX_SQL = """box AS (SELECT l_orderkey AS game_id, year(o_orderdate) AS season_id, l_suppkey % 2 AS team_id,
  CASE WHEN l_linenumber % 3 <> 0 THEN l_partkey % 7 END AS fg3a, CASE WHEN l_linenumber % 3 <> 0 THEN l_partkey % 7 + l_suppkey % 9 END AS fga
FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
rates AS (SELECT game_id, season_id, team_id, CASE WHEN sum(fga) > 0 THEN sum(fg3a) / CAST(sum(fga) AS DOUBLE) END AS r FROM box GROUP BY 1, 2, 3)"""


def _team_rates(spark, sf_dir):
    played = F.col("l_linenumber") % 3 != 0
    rows = b.table(spark, sf_dir, "lineitem").join(
        b.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.year("o_orderdate").alias("season_id")), "l_orderkey"
    ).select(
        F.col("l_orderkey").alias("game_id"), "season_id", (F.col("l_suppkey") % 2).alias("team_id"),
        F.when(played, F.col("l_partkey") % 7).alias("fg3a"), F.when(played, F.col("l_partkey") % 7 + F.col("l_suppkey") % 9).alias("fga"),
    )
    return normalize.team_rates(rows)


@query(
    "team_three_rates",
    "P03",
    b.with_ctes(_BOX_SQL) + "SELECT game_id, team_id, round(r, 6) AS fg3a_rate FROM rates",
)
def team_three_rates(spark, sf_dir):
    return _team_rates(spark, sf_dir).select("game_id", "team_id", F.round("fg3a_rate", 6).alias("fg3a_rate"))


@query(
    "stored_season_stats",
    "K02 P03 A01",
    b.with_ctes(_BOX_SQL)
    + """SELECT season_id, 'fg3a_rate' AS metric_name, round(avg(r), 6) AS mean_value, round(max(r), 6) AS max_value
FROM rates WHERE season_id % 2 = 1 OR game_id % 3 <> 0 GROUP BY 1""",
)
def stored_season_stats(spark, sf_dir):
    """Statistics of some games stored, then those of all games put over them for odd seasons."""
    path = _folder(spark)
    rates = _team_rates(spark, sf_dir)
    for part in (rates.filter("game_id % 3 <> 0"), rates.filter("season_id % 2 = 1")):
        normalize.store_stats(path, normalize.season_stats(part, "season_id", ["fg3a_rate"]))
    table = maintenance._read(spark, path)
    return table.select("season_id", "metric_name", F.round("mean_value", 6).alias("mean_value"), F.round("max_value", 6).alias("max_value"))


@query(
    "player_season_shots",
    "S08",
    """SELECT l_orderkey AS game_id, l_linenumber AS shot_no, CAST((l_partkey * 37) % 501 - 250 AS BIGINT) AS loc_x
FROM lineitem WHERE l_suppkey = 3 AND l_returnflag = 'A'""",
)
def player_season_shots(spark, sf_dir):
    shots = b.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("game_id"), F.col("l_linenumber").alias("shot_no"), F.col("l_suppkey").alias("player_id"),
        F.col("l_returnflag").alias("season_id"), (F.pmod(F.col("l_partkey") * 37, F.lit(501)) - 250).cast("bigint").alias("loc_x"),
    )
    return payloads.player_season_shots(shots, 3, "A").select("game_id", "shot_no", "loc_x")


@query(
    "quarantined_rows",
    "S17",
    """SELECT CASE WHEN c_custkey % 10 = 3 THEN 'quarantine' ELSE 'kept' END AS outcome, c_nationkey AS nation, count(*) AS lines FROM customer GROUP BY 1, 2
UNION ALL SELECT 'skipped', c_nationkey, count(*) FROM customer WHERE c_custkey % 10 <> 3 GROUP BY 2""",
)
def quarantined_rows(spark, sf_dir):
    """Customers landed as JSON lines, one in ten of them cut off; once logged, once skipped."""
    path = _folder(spark)
    k = F.col("c_custkey")
    line = F.to_json(F.struct(k.alias("id"), F.col("c_nationkey").alias("nation")))
    cut = F.concat(F.lit("nation "), F.col("c_nationkey").cast("string"), F.lit(" {"))
    b.table(spark, sf_dir, "customer").select(F.when(k % 10 == 3, cut).otherwise(line).alias("value")).write.text(path)
    schema = "id bigint, nation bigint"
    kept, broken = payloads.read_landed(spark, path, schema, "log")
    skipped, _ = payloads.read_landed(spark, path, schema, "skip")
    rows = (
        kept.select(F.lit("kept").alias("outcome"), "nation")
        .union(broken.select(F.lit("quarantine"), F.regexp_extract("line", r"nation (\d+)", 1).cast("bigint")))
        .union(skipped.select(F.lit("skipped"), "nation"))
    )
    return rows.groupBy("outcome", "nation").agg(F.count(F.lit(1)).alias("lines"))


@query(
    "collection_counts",
    "S17",
    """WITH c AS (SELECT count(*) AS lines, count(*) FILTER (c_custkey % 10 = 3) AS dropped FROM customer)
SELECT policy, lines, lines - dropped AS kept, dropped, lines - dropped AS stored, CASE WHEN policy = 'log' THEN dropped ELSE 0 END AS quarantined
FROM c, (SELECT unnest(['log', 'skip']) AS policy)""",
)
def collection_counts(spark, sf_dir):
    """Customers landed as JSON lines, one in ten cut off: what each policy saw, kept and dropped."""
    root = _folder(spark)
    k = F.col("c_custkey")
    line = F.to_json(F.struct(k.alias("id"), F.col("c_nationkey").alias("nation")))
    b.table(spark, sf_dir, "customer").select(F.when(k % 10 == 3, F.lit("{cut")).otherwise(line).alias("value")).write.text(f"{root}/landed")
    out = None
    for policy in ("log", "skip"):
        counts = payloads.collect_landed(spark, f"{root}/landed", "id bigint, nation bigint", f"{root}/{policy}", policy)
        rows = spark.read.parquet(f"{root}/{policy}").agg(
            F.lit(policy).alias("policy"), *(F.lit(v).cast("bigint").alias(n) for n, v in counts.items()),
            F.count_if(F.col("outcome") == "kept").alias("stored"), F.count_if(F.col("outcome") == "quarantine").alias("quarantined"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out
