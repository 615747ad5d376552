import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from courtline.operators import backtest, drift, injuries, jobs, markets, metrics, versions

DAY = dt.date(2024, 1, 1)


def day(n):
    return DAY + dt.timedelta(days=n)


@pytest.fixture(scope="module")
def bets(spark):
    rng = np.random.default_rng(42)
    rows = []
    for i in range(200):
        result = rng.choice(["win", "loss", "push"], p=[0.5, 0.4, 0.1])
        odds, stake = float(1.7 + rng.random() / 2), float(50 + rng.integers(100))
        profit = {"win": stake * (odds - 1), "loss": -stake, "push": 0.0}[result]
        rows.append((i, day(i // 3), ["moneyline", "spread", "total"][i % 3], "home", float(0.3 + rng.random() / 2), odds, 0.05, stake, str(result), profit))
    return spark.createDataFrame(
        rows, "game_id bigint, bet_date date, bet_type string, side string, model_prob double, market_odds double, "
        "edge double, bet_amount double, result string, profit double",
    )


def test_metrics_against_numpy(bets):
    rows = bets.orderBy("game_id").toPandas()
    got = metrics.betting_metrics(bets).filter("bet_type = 'all'").first()
    r = (rows.profit / rows.bet_amount).to_numpy()
    assert got["total_bets"] == 200 and got["win_count"] == (rows.result == "win").sum()
    assert got["volatility"] == pytest.approx(r.std())
    assert got["sharpe_ratio"] == pytest.approx(r.mean() / r.std() * np.sqrt(200))
    assert got["roi"] == pytest.approx(rows.profit.sum() / rows.bet_amount.sum())
    assert got["sortino_ratio"] == 0.0  # every loss is the whole stake
    small = metrics.betting_metrics(bets.filter("game_id < 9")).filter("bet_type = 'all'").first()
    assert small["volatility"] == 0.0 and small["sharpe_ratio"] == 0.0


@pytest.mark.parametrize(
    "path, depth, steps",
    [([100, 110, 120], 0.0, 0), ([100, 90, 95, 101], 0.1, 3), ([100, 120, 60, 90], 0.5, 3), ([100, 110, 110, 99, 120, 130], 0.1, 2)],
)
def test_drawdown(spark, path, depth, steps):
    rows = [(0, i, float(v)) for i, v in enumerate(path[1:], 1)]
    df = spark.createDataFrame(rows, "chunk int, bet_no int, bankroll double")
    got = backtest.drawdown(df, [], ["chunk"], ["bet_no"], start=float(path[0])).first()
    assert got["max_drawdown"] == pytest.approx(depth) and got["max_drawdown_steps"] == steps


@pytest.mark.parametrize("seed", range(4))
def test_drawdown_summaries_merge(spark, seed):
    """Random curves with ties, cut into many chunks of two levels, against one pass per key."""
    rng = np.random.default_rng(seed)
    rows = []
    for key in ("a", "b"):
        value = 100.0
        for i in range(1, 150):
            value = max(1.0, value + float(rng.integers(-6, 7)))
            rows.append((key, i // 40, i // 7, i, value))
    df = spark.createDataFrame(rows, "k string, month int, week int, bet_no int, bankroll double").repartition(5)
    got = {r["k"]: r for r in backtest.drawdown(df, ["k"], ["month", "week"], ["bet_no"], start=100.0).collect()}
    for key in ("a", "b"):
        peak, at, depth, steps = 100.0, 0, 0.0, 0
        for _, _, _, i, v in (r for r in rows if r[0] == key):
            if v >= peak:
                peak, at = v, i
            else:
                depth, steps = max(depth, (peak - v) / peak), max(steps, i - at + 1)
        assert got[key]["max_drawdown"] == pytest.approx(depth) and got[key]["max_drawdown_steps"] == steps


def test_drawdown_summaries_list_only_rising_records(spark):
    path = [5.0, 7.0] + [0.0] * 40 + [7.0] * 100 + [9.0]
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate(path, 1)], "chunk int, bet_no int, bankroll double")
    row = backtest.curve_summaries(df, ["chunk"], ["bet_no"], "bankroll", "bet_no").first()
    assert [tuple(r) for r in row["records"]] == [(1, 5.0), (2, 7.0), (143, 9.0)]
    assert (row["inner"], row["last"], row["end"], row["own_fall"]) == (41, 143, 143, 1.0)
    got = backtest.drawdown(df, [], ["chunk"], ["bet_no"], start=6.0).first()
    assert (got["max_drawdown"], got["max_drawdown_steps"]) == (1.0, 41)
    zeros = df.union(spark.createDataFrame([(1, 144, 0.0), (1, 145, 0.0)], df.schema))  # a chunk that never leaves zero
    assert backtest.drawdown(zeros, [], ["chunk"], ["bet_no"], start=6.0).first()["max_drawdown"] == 1.0


def test_equity_shares_start_within_a_game(spark):
    rows = [(0, "a", 1, 0.02, 1.0), (0, "a", 2, 0.02, -1.0), (0, "b", 1, 0.01, 0.5)]
    df = spark.createDataFrame(rows, "chunk int, game string, n int, f double, u double")
    out = backtest.equity_curve(df, [], ["chunk"], ["game", "n"], F.col("f"), F.col("u"), same_stake=["game"], bankroll=100.0)
    got = [r["bankroll"] for r in out.orderBy("bet_no").collect()]
    assert got == pytest.approx([102.0, 100.0, 100.5])


def test_equity_makes_the_bets_of_shared_games_once(spark):
    bets = spark.range(6).select(
        F.lit(0).alias("chunk"), F.floor(F.col("id") / 2).alias("game"), "id", F.lit(0.02).alias("f"), F.lit(1.0).alias("u")
    )
    out = backtest.equity_curve(bets, [], ["chunk"], ["game", "id"], F.col("f"), F.col("u"), same_stake=["game"])
    assert "Range (" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert [r["bet_no"] for r in out.orderBy("game", "id").collect()] == [1, 2, 3, 4, 5, 6]


def test_folds_do_not_leak(spark):
    games = spark.range(730).select(
        F.col("id").alias("game_id"), F.date_add(F.lit(DAY), (F.col("id") / 4).cast("int")).alias("game_date")
    )
    got = backtest.folds(games, ["game_date"], ["game_date", "game_id"], "game_date").orderBy("fold_num").collect()
    assert [(r["fold_num"], r["train_games"], r["val_games"]) for r in got] == [(1, 500, 100), (2, 550, 100), (3, 600, 100)]
    assert all(r["train_end"] <= r["val_start"] for r in got)
    held = backtest.validation_rows(games, ["game_date"], ["game_date", "game_id"])
    assert held.filter("position < train_games").count() == 0 and held.count() == 300
    assert backtest.folds(games.limit(550), ["game_date"], ["game_date", "game_id"], "game_date").count() == 0


def test_game_bets(spark):
    cols = "game_id int, home_score int, away_score int, home_win_prob double, predicted_margin double, predicted_total double, home_ml double, away_ml double, spread double, spread_home_odds double, spread_away_odds double, total double, over_odds double, under_odds double"
    none = [None] * 6
    rows = [
        (1, 110, 100, 0.7, 10.0, 210.0, 2.0, 1.9, -3.5, None, None, 220.0, None, None),
        (2, 100, 100, 0.2, 0.0, 220.0, 1.91, 1.91, *none),
        (3, 90, 100, 0.5, -3.5, 220.0, 1.91, 1.91, *none),
    ]
    got = {(r["game_id"], r["bet_type"]): r for r in markets.game_bets(spark.createDataFrame(rows, cols)).collect()}
    assert got[(1, "moneyline")]["side"] == "home" and got[(1, "moneyline")]["unit_profit"] == 1.0
    assert got[(1, "spread")]["result"] == "win" and got[(1, "total")]["side"] == "under"
    assert got[(1, "total")]["result"] == "win"
    assert got[(2, "moneyline")]["side"] == "away" and got[(2, "moneyline")]["result"] == "win"  # a tie is no home win
    assert (3, "moneyline") not in got and (3, "total") not in got
    assert all(r["bet_fraction"] <= 0.02 for r in got.values())


def test_drift(spark):
    rng = np.random.default_rng(0)
    base, same, moved = rng.normal(100, 5, 400), rng.normal(100, 5, 400), rng.normal(108, 5, 400)
    frame = lambda v: spark.createDataFrame([(float(x), 1.0) for x in v], "pace double, flat double")
    still = drift.drift_check(frame(base), frame(same), ["pace", "flat", "absent"])
    got = {r["feature"]: r for r in still.collect()}
    assert set(got) == {"pace", "flat"} and not got["flat"]["is_drifted"] and got["pace"]["psi"] < 0.2
    row = drift.drift_check(frame(base), frame(moved), ["pace"]).first()
    assert row["is_drifted"] and row["p_value"] < 1e-6
    grid = np.sort(np.concatenate([base, moved]))
    cdf = lambda v: np.searchsorted(np.sort(v), grid, side="right") / len(v)
    assert row["ks_stat"] == pytest.approx(np.abs(cdf(base) - cdf(moved)).max())
    edges = np.unique(np.percentile(base, np.linspace(0, 100, 11)))
    e = np.clip(np.histogram(base, edges)[0] / 400, 1e-10, 1)
    a = np.clip(np.histogram(moved, edges)[0] / 400, 1e-10, 1)
    assert row["psi"] == pytest.approx(((a - e) * np.log(a / e)).sum())
    assert drift.drift_check(frame(base[:4]), frame(moved), ["pace"]).count() == 0


def test_concept_drift_window(spark):
    rows = [(i, 0.9, 1) for i in range(50)] + [(i, 0.9, 0) for i in range(50, 150)]
    df = spark.createDataFrame(rows, "t int, prob double, actual int")
    got = drift.concept_drift(df, ["t"]).first()
    assert got["recent_accuracy"] == 0.0 and got["accuracy_degraded"] and got["calibration_degraded"]
    assert drift.concept_drift(df.filter("t < 9"), ["t"]).count() == 0


def test_lineage_handles_cycles(spark):
    rows = [("a", None), ("b", "a"), ("c", "b"), ("d", "c"), ("x", "y"), ("y", "x")]
    asked = spark.createDataFrame([(v,) for v in ("a", "d", "x", "none")], "version string")
    got = versions.lineage(spark.createDataFrame(rows, "version string, parent_version string"), asked)
    chains = {}
    for r in got.collect():
        chains.setdefault(r["version"], []).append((-r["steps"], r["ancestor"]))
    order = {v: [a for _, a in sorted(c)] for v, c in chains.items()}
    assert order == {"d": ["a", "b", "c", "d"], "a": ["a"], "x": ["y", "x"]}


def test_lineage_doubles_its_paths(spark, monkeypatch):
    """A chain of a thousand versions takes eleven rounds; a version may have two parents."""
    rounds = []
    frame = type(spark.range(1))
    counted = frame.count
    monkeypatch.setattr(frame, "count", lambda self: rounds.append(1) or counted(self))
    chain = spark.range(1, 1001).selectExpr("id version", "if(id > 1, id - 1, null) parent_version").union(spark.createDataFrame([(1000, 998)], "v bigint, p bigint"))
    got = versions.lineage(chain, spark.createDataFrame([(1000,), (3,)], "version bigint")).collect()
    assert len(rounds) - 1 <= 11
    steps = {(r["version"], r["ancestor"]): r["steps"] for r in got}
    assert len(steps) == 1003 and steps[1000, 999] == 1 and steps[1000, 998] == 1 and steps[1000, 1] == 998 and steps[3, 1] == 2


def test_winner_rules(spark):
    m = spark.createDataFrame(
        [("a", "accuracy", 0.60), ("b", "accuracy", 0.6005), ("a", "brier_score", 0.2), ("b", "brier_score", 0.25), ("a", "loss", 1.0)],
        "version string, metric string, value double",
    )
    pairs = spark.createDataFrame([("a", "b"), ("b", "z"), ("q", "z")], "version_a string, version_b string")
    got = {(r["version_a"], r["version_b"]): (r["winner"], r["lower_loss"]) for r in versions.winners(pairs, m).collect()}
    assert got == {("a", "b"): ("a", "a"), ("b", "z"): ("b", "z"), ("q", "z"): ("z", "z")}


def test_no_injuries_no_change(spark):
    p = spark.createDataFrame([("g", 1, 2, 0.999, 50.0, 300.0)], "game_id string, home_team_id int, away_team_id int, home_win_prob double, predicted_margin double, predicted_total double")
    teams = spark.createDataFrame([(9, 0.1, 0.1, 0.1)], "team_id int, win_change double, total_change double, uncertainty double")
    row = injuries.adjust_predictions(p, teams).first()
    assert row["home_win_prob_adjusted"] == 0.999 and row["injury_uncertainty"] == 0.0


def test_exploded_lineups_are_never_broadcast(spark):
    """The planner takes them for as small as the games; at 900,000 games they filled the driver."""
    ids = lambda *p: F.array(*[F.lit(x).cast("bigint") for x in p])
    games = spark.range(300).select(F.col("id").alias("game_id"), ids(*range(5)).alias("home_lineup"), ids(*range(5, 10)).alias("away_lineup"))
    played = spark.range(300).select(F.col("id").alias("game_id"), F.explode(ids(*range(10), 11)).alias("player_id")).select(
        "game_id", "player_id", F.when(F.col("player_id").between(5, 9), 1).otherwise(0).alias("team_id"), F.lit(20.0).alias("minutes")
    )
    reports = spark.range(12).select(F.col("id").alias("player_id"), F.when(F.col("id") == 2, "gtd").otherwise("out").alias("status"), F.lit(0.4).alias("play_probability"))
    ratings = spark.range(12).select(F.col("id").alias("player_id"), F.col("id").cast("double").alias("rapm"))
    planned = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    members = games.select("game_id", F.col("home_lineup").alias("lineup"), F.explode("home_lineup").alias("player_id"))
    assert "Broadcast" not in planned(injuries.listed(members, reports))
    wanted = members.filter("player_id = 2").select("game_id", "player_id", "lineup")
    assert "ShuffledHashJoin" in planned(injuries.best_replacements(wanted, played, ["game_id"]))
    out = injuries.two_scenario_adjustment(games, reports, played, ["game_id"], injuries.linear_scorer(ratings))
    rows = out.groupBy(F.round("predicted_margin_adjusted", 6), F.round("predicted_total_adjusted", 6)).count().collect()
    # player 11 would stand in for 2: margin -25 + 0.6 * 9, total 242.5 + 0.6 * 4.5
    assert [tuple(r) for r in rows] == [(-19.6, 245.2, 300)]


def test_walk_forward_with_trainer(spark):
    n = 140
    games = spark.range(n).select(
        F.col("id").alias("game_id"), F.date_add(F.lit(DAY), (F.col("id") / 2).cast("int")).alias("game_date"),
        (F.col("id") % 7).cast("double").alias("x"),
        (100 + F.col("id") % 7 * 3).cast("int").alias("home_score"), F.lit(109).alias("away_score"),
    )
    seen = []

    def trainer(train, val):
        seen.append((train.count(), val.count()))
        return jobs.model_trainer(["x"])(train, val)

    out = jobs.walk_forward(games, None, trainer, ["game_date"], ["game_date", "game_id"], min_train=80, window=40, step=20)
    assert seen == [(80, 40), (100, 40)]
    rows = out.groupBy("fold_num", "result").count().collect()
    assert {r["fold_num"] for r in rows} == {1, 2}
    won = sum(r["count"] for r in rows if r["result"] == "win")
    assert won > 0.8 * sum(r["count"] for r in rows)


def test_drift_buckets_ignore_an_outlier(spark):
    from courtline.operators import drift

    ref = spark.range(20_000).selectExpr("cast(id as double) AS x").union(spark.createDataFrame([(1e18,)], "x double"))
    counts = drift.value_counts(ref, spark.range(5_000).selectExpr("cast(id * 3 as double) AS x"), ["x"])
    sizes = [r["count"] for r in counts.groupBy("bucket").count().collect()]
    assert len(sizes) > drift.VALUE_BUCKETS / 2 and max(sizes) <= 2 * sum(sizes) / len(sizes)
