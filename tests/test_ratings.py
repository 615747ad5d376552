import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from courtline.operators import ridge, spacing

SCHEMA = (
    "season_id string, stint_id bigint, game_date date, home_lineup array<bigint>, away_lineup array<bigint>, "
    "home_points bigint, away_points bigint, possessions double, duration_seconds int"
)


@pytest.fixture(scope="module")
def stints(spark):
    import datetime as dt

    rng = random.Random(3)
    rows = []
    for i in range(160):
        ten = rng.sample(range(1, 25), 10)
        rows.append(
            ("s", i, dt.date(2024, 1, 1 + i % 28), ten[:5], ten[5:], rng.randrange(12), rng.randrange(12),
             float(rng.randrange(0, 12)), rng.randrange(200, 900))
        )
    return spark.createDataFrame(rows, SCHEMA), rows


def dense(rows, tau):
    ids = sorted({p for r in rows for p in r[3] + r[4]})
    x = np.zeros((len(rows), len(ids)))
    for i, r in enumerate(rows):
        for p in r[3]:
            x[i, ids.index(p)] += 1
        for p in r[4]:
            x[i, ids.index(p)] -= 1
    poss = np.array([r[7] if r[7] > 0 else 1.0 for r in rows])
    ref = max(r[2] for r in rows)
    w = np.exp([-(ref - r[2]).days / tau for r in rows]) * np.sqrt(poss)
    y = np.array([r[5] * 100 for r in rows]) / poss
    z = -np.array([r[6] * 100 for r in rows]) / poss
    return ids, x, w, y, z


def solve(x, w, y, lam):
    mx, my = w @ x / w.sum(), w @ y / w.sum()
    c = x - mx
    beta = np.linalg.solve(c.T @ (c * w[:, None]) + lam * np.eye(x.shape[1]), c.T @ (w * (y - my)))
    return beta, my - mx @ beta


def test_fit_matches_dense_ridge(stints):
    df, rows = stints
    ids, x, w, y, z = dense(rows, 30.0)
    want = dict(zip(ids, zip(solve(x, w, y, 5.0)[0], solve(x, w, z, 5.0)[0])))
    got = ridge.fit(df, lam=5.0, min_minutes=0.0, tau=30.0).collect()
    assert len(got) == len(ids)
    for r in got:
        assert r["orapm"] == pytest.approx(want[r["player_id"]][0], abs=1e-5)
        assert r["drapm"] == pytest.approx(want[r["player_id"]][1], abs=1e-5)
        assert r["rapm"] == pytest.approx(r["orapm"] + r["drapm"])


@pytest.mark.parametrize("block", [768, 7])
def test_seasons_of_all_widths_are_solved_together(stints, monkeypatch, block):
    """In one block or many; a short season gives nothing."""
    monkeypatch.setattr(ridge, "BLOCK_PLAYERS", block)
    df, rows = stints
    other = df.withColumn("season_id", F.lit("t")).withColumn("home_lineup", F.transform("home_lineup", lambda p: p * 100))
    short = df.filter("stint_id < 50").withColumn("season_id", F.lit("u"))
    got = ridge.fit(df.union(other).union(short), lam=2.0, min_minutes=0.0, tau=30.0)
    ids, x, w, y, _ = dense(rows, 30.0)
    want = dict(zip(ids, solve(x, w, y, 2.0)[0]))
    by = {}
    for r in got.collect():
        by.setdefault(r["season_id"], {})[r["player_id"]] = r["orapm"]
    assert set(by) == {"s", "t"} and len(by["t"]) > len(by["s"]) == len(ids)
    assert all(by["s"][p] == pytest.approx(want[p], abs=1e-5) for p in ids)
    left = ridge.residuals(df.union(other), got.filter("season_id <> 'u'"), lam=2.0, tau=30.0).collect()
    assert len(left) == len(by["s"]) + len(by["t"])
    assert max(max(abs(r["off_left"]), abs(r["def_left"])) for r in left) < 1e-5


def test_cross_validation_matches_dense(stints):
    df, rows = stints
    ids, x, w, y, _ = dense(rows, 30.0)
    fold = np.array([r[1] % 5 for r in rows])
    got = {
        r["lambda"]: r["mean_r2"]
        for r in ridge.cross_validate(df, lambdas=[1.0, 50.0], min_minutes=0.0, tau=30.0, fold=F.col("stint_id") % 5).collect()
    }
    for lam, value in got.items():
        scores = []
        for f in range(5):
            t, v = fold != f, fold == f
            beta, base = solve(x[t], w[t], y[t], lam)
            e = y[v] - base - x[v] @ beta
            scores.append(1 - (e @ e) / ((y[v] - y[v].mean()) ** 2).sum())
        assert value == pytest.approx(np.mean(scores), abs=1e-9)


def test_too_few_stints_give_nothing(stints):
    df, _ = stints
    assert ridge.fit(df.filter("stint_id < 50"), lam=5.0, min_minutes=0.0).count() == 0


def hull(spark, points):
    df = spark.createDataFrame([(1, x, y) for x, y in points], "player_id bigint, loc_x int, loc_y int")
    s = spacing.player_summary(df, ["player_id"])
    return s.select(spacing.hull_area(F.col("lower"), F.col("upper")).alias("a")).first()["a"]


def test_hull_shapes(spark):
    square = [(-100, 0), (100, 0), (100, 200), (-100, 200), (0, 100), (50, 50)]
    assert hull(spark, square) == 40000.0
    assert hull(spark, [(0, 0), (100, 0), (0, 100)]) == 5000.0
    assert hull(spark, [(0, 0), (50, 50), (100, 100)]) == 0.0
    assert hull(spark, [(5, 0), (5, 50), (5, 90)]) == 0.0
    assert hull(spark, [(1, 1)]) == 0.0


def monotone_chain(points):
    pts = sorted(set(points))

    def half(seq):
        out = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    ring = half(pts) + half(pts[::-1])
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1]))) / 2


@pytest.mark.parametrize("seed", range(4))
def test_hull_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    pts = [(rng.randrange(-250, 251), rng.randrange(-50, 300)) for _ in range(60)]
    assert hull(spark, pts) == pytest.approx(monotone_chain(pts))


def test_parts_of_summaries_grow_with_the_shots(spark, monkeypatch):
    monkeypatch.setattr(spacing, "TASK_SHOTS", 50)
    shots = spark.range(2000).selectExpr("id % 7 as player_id", "cast(id % 101 as int) as loc_x", "cast(id % 53 as int) as loc_y")
    summary = spacing.player_summary(shots, ["player_id"])
    plan = summary._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 2 and summary.rdd.getNumPartitions() == 40
    assert {r["player_id"]: r["n"] for r in summary.collect()} == {i: len(range(i, 2000, 7)) for i in range(7)}


def test_lineup_needs_enough_shots(spark):
    shots = spark.createDataFrame([(1, 10, 20)] * 5, "player_id bigint, loc_x int, loc_y int")
    lineups = spark.createDataFrame([([1, 2, 3, 4, 5],)], "lineup array<bigint>")
    row = spacing.lineup_spacing(lineups, spacing.player_summary(shots, ["player_id"]), []).first()
    assert row["shot_count"] == 5 and row["hull_area"] == 0.0 and row["centroid_x"] == 0.0


def test_density_of_several_blocks_of_points():
    rng = np.random.default_rng(2)
    at = rng.integers([-250, -50], [251, 401], (3 * spacing.POINT_BLOCK + 5, 2)).astype(float)
    k = rng.integers(1, 4, len(at))
    rows = pd.DataFrame({"player_id": 1, "loc_x": at[:, 0], "loc_y": at[:, 1], "k": k})
    got = np.array(spacing._density_of_player("player_id", 50)(rows)["density"][0])
    every = np.repeat(at, k, axis=0)
    cov = np.cov(every.T) * len(every) ** (-1 / 3)
    gap = np.array([[x, y] for x in np.linspace(-250, 250, 50) for y in np.linspace(-50, 400, 50)])[:, None] - every
    want = np.exp(-0.5 * np.einsum("cij,jk,cik->ci", gap, np.linalg.inv(cov), gap)).sum(1) / (2 * math.pi * math.sqrt(np.linalg.det(cov)) * len(every))
    assert got == pytest.approx(want, rel=1e-9)


def test_density_closed_form(spark):
    rng = random.Random(1)
    pts = [(rng.randrange(-200, 200), rng.randrange(0, 300)) for _ in range(30)]
    shots = spark.createDataFrame([(1, x, y) for x, y in pts] + [(2, 0, 0)] * 20 + [(3, 1, 2)], "player_id bigint, loc_x int, loc_y int")
    rows = spacing.shot_density(shots).collect()
    assert {r["player_id"] for r in rows} == {1}
    a = np.array(pts, dtype=float)
    cov = np.cov(a.T) * len(a) ** (-1 / 3)
    inv, height = np.linalg.inv(cov), 1 / (2 * math.pi * math.sqrt(np.linalg.det(cov)) * len(a))
    gx, gy = np.linspace(-250, 250, 50), np.linspace(-50, 400, 50)
    got = {r["cell"]: r["density"] for r in rows}
    for i, j in [(0, 0), (25, 20), (49, 49), (10, 33)]:
        gap = np.array([gx[i], gy[j]]) - a
        want = height * np.exp(-0.5 * np.einsum("ij,jk,ik->i", gap, inv, gap)).sum()
        assert got[i * 50 + j] == pytest.approx(want, rel=1e-9)
