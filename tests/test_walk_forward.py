"""Models of all folds from prefix sums against a solve per fold."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from courtline.operators import backtest, jobs

LEVELS, ORDER = ["game_date", "id_range"], ["game_date", "game_id"]
GEOMETRY = {"min_train": 20, "window": 10, "step": 5}


@pytest.fixture(scope="module")
def games(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(83):
        a, b = rng.normal(size=2)
        home = int(100 + 5 * a - 3 * b + rng.normal())
        rows.append((i, dt.date(2024, 1, 1) + dt.timedelta(i // 7), i // 3, home, 100, float(a), float(b) if i != 11 else None))
    schema = "game_id bigint, game_date date, id_range bigint, home_score int, away_score int, a double, b double"
    df = spark.createDataFrame(rows, schema).withColumn("margin", (F.col("home_score") - F.col("away_score")).cast("double"))
    return df, rows


def expected(rows, penalty=1.0):
    out = {}
    for fold, cut in enumerate(range(20, len(rows) - 10 + 1, 5), 1):
        train = [r for r in rows[:cut] if r[6] is not None]
        x = np.array([[1.0, r[5], r[6]] for r in train])
        y = np.array([r[3] - r[4] for r in train], float)
        beta = np.linalg.solve(x.T @ x + penalty * np.diag([0, 1, 1]), x.T @ y)
        for r in rows[cut : cut + 10]:
            out[fold, r[0]] = beta @ [1.0, r[5], r[6]]
    return out


@pytest.mark.parametrize("group", [1024, 2])
def test_predictions_equal_a_solve_per_fold(games, monkeypatch, group):
    monkeypatch.setattr(backtest, "BLOCK_GROUP", group)
    df, rows = games
    got = backtest.fold_predictions(df, LEVELS, ORDER, ["a", "b"], ["margin"], **GEOMETRY).collect()
    want = expected(rows)
    assert {(r["fold_num"], r["game_id"]) for r in got} == set(want) and len(got) == len(want)
    for r in got:
        assert r["predicted_margin"] == pytest.approx(want[r["fold_num"], r["game_id"]], abs=1e-9)


def test_too_few_games_give_no_fold(games):
    df, _ = games
    few = df.filter("game_id < 25")
    assert backtest.fold_predictions(few, LEVELS, ORDER, ["a", "b"], ["margin"], **GEOMETRY).count() == 0
    assert backtest.fold_models(df.limit(0), LEVELS, ORDER, ["a"], ["margin"], **GEOMETRY).count() == 0


def test_linear_walk_forward_bets_as_the_loop_does(games):
    """The same linear trainer by the hook, fold by fold."""
    df, _ = games
    df = df.na.fill(0.0)

    def trainer(train, val):
        rows = [(1.0, r["a"], r["b"], float(r["home_score"] > r["away_score"]), r["home_score"] - r["away_score"], r["home_score"] + r["away_score"]) for r in train.collect()]
        data = np.array(rows, float)
        x = data[:, :3]
        beta = np.linalg.solve(x.T @ x + np.diag([0, 1, 1]), x.T @ data[:, 3:])

        def told(t, low, high):
            value = float(beta[0, t]) + float(beta[1, t]) * F.col("a") + float(beta[2, t]) * F.col("b")
            return F.least(F.greatest(value, F.lit(low)), F.lit(high))

        from courtline.functions import misc

        names = (("home_win_prob", misc.WIN_BOUNDS), ("predicted_margin", misc.MARGIN_BOUNDS), ("predicted_total", misc.TOTAL_BOUNDS))
        return val.withColumns({n: told(t, float(b[0]), float(b[1])) for t, (n, b) in enumerate(names)})

    loop = jobs.walk_forward(df, None, trainer, LEVELS, ORDER, **GEOMETRY)
    one = jobs.walk_forward_linear(df, None, ["a", "b"], LEVELS, ORDER, **GEOMETRY)
    columns = ["fold_num", "game_id", "bet_type", "side", F.round("model_prob", 8), F.round("bet_fraction", 8), "result"]
    key = lambda df: sorted(tuple(r) for r in df.select(columns).collect())
    assert key(one) == key(loop) and one.count() > 0
