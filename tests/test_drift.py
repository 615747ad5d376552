"""Exact two-sample p-values and the placing of values."""

from itertools import combinations

import numpy as np
import pytest

from courtline.operators import drift


def every_order(a, b):
    """Share of all ways to deal the pooled values whose distance is as large or larger."""
    pooled = sorted(a + b)
    values = sorted(set(pooled))

    def apart(first, second):
        return max(abs(sum(x <= v for x in first) * len(second) - sum(x <= v for x in second) * len(first)) for v in values)

    n, m = len(a), len(b)
    # ties in the pool only lower distances: paths are counted over distinct places
    places = list(range(n + m))

    def apart_places(chosen):
        chosen, i, worst = set(chosen), 0, 0
        for step in places:
            i += step in chosen
            worst = max(worst, abs(i * m - (step + 1 - i) * n))
        return worst

    seen = apart(a, b)
    deals = list(combinations(places, n))
    return sum(apart_places(d) >= seen for d in deals) / len(deals), seen


@pytest.mark.parametrize("seed", range(6))
def test_paths_equal_all_orders(seed):
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 9, 5 + seed % 3).tolist()
    b = (rng.integers(0, 9, 6) + seed).tolist()
    want, distance = every_order(a, b)
    assert drift.path_p_value(len(a), len(b), distance) == pytest.approx(want, abs=1e-12)
    assert drift.path_p_value(len(b), len(a), distance) == pytest.approx(want, abs=1e-12)


def test_known_values():
    # two samples of 5 that do not overlap: 2 of C(10, 5) orders
    assert drift.path_p_value(5, 5, 25) == pytest.approx(2 / 252)
    assert drift.path_p_value(7, 9, 0) == 1.0
    assert drift.path_p_value(6, 10_000, 60_000) == pytest.approx(2 / float(np.prod([(10_000 + i) / i for i in range(1, 7)])), rel=1e-9)


def test_exact_values_of_features(spark):
    rng = np.random.default_rng(3)
    rows = [("few", float(v), int(r)) for r in (0, 1) for v in rng.integers(0, 6, 7)]
    rows += [("scarce", 1.0, 1)] * 9 + [("scarce", 2.0, 0)] * 4 + [("few", None, 1), ("few", float("nan"), 0)]
    got = {r["feature"]: r for r in drift.exact_p_values(drift.counted(spark.createDataFrame(rows, "feature string, value double, r int"))).collect()}
    assert set(got) == {"few"}
    a, b = ([v for f, v, r in rows if f == "few" and r == k and v is not None and v == v] for k in (1, 0))
    want, distance = every_order(a, b)
    assert got["few"]["p_value"] == pytest.approx(want) and got["few"]["ks_stat"] == pytest.approx(distance / 49)


def test_drift_check_takes_exact_values(spark):
    rng = np.random.default_rng(5)
    ref = spark.createDataFrame([(float(x),) for x in rng.normal(size=12)], "x double")
    rec = spark.createDataFrame([(float(x),) for x in rng.normal(1.5, size=11)], "x double")
    series, exact = (drift.drift_check(ref, rec, ["x", "absent"], exact=e).first() for e in (False, True))
    assert series["ks_stat"] == exact["ks_stat"] and series["p_value"] != exact["p_value"]
    assert exact["p_value"] == pytest.approx(drift.path_p_value(12, 11, round(exact["ks_stat"] * 132)))


def test_values_keep_their_order_over_buckets(spark):
    values = [float(x) for x in np.random.default_rng(1).normal(size=3_000)]
    rows = [("x", v, i % 2) for i, v in enumerate(values)]
    counts = drift.counted(spark.createDataFrame(rows, "feature string, value double, r int")).orderBy("value").collect()
    order = sorted(rows, key=lambda r: r[1])
    assert [r["cum_ref"] for r in counts] == np.cumsum([r[2] for r in order]).tolist()
    assert len({r["bucket"] for r in counts}) > 200


def test_sketches_stand_for_the_reference(spark):
    rng = np.random.default_rng(8)
    rows = [(i % 4, float(x), float(rng.integers(0, 12))) for i, x in enumerate(rng.normal(size=20_000))]
    ref = spark.createDataFrame(rows, "load int, x double, level double")
    sketches = drift.reference_sketches(ref, ["load"], ["x", "level"])
    assert sketches.count() == 8
    bins = drift.sketched_bins(sketches)
    assert all(r["n"] == 20_000 and abs(sum(r["expected"]) - 1) < 1e-9 for r in bins.collect())
    for r in drift.bin_shares(ref, bins, ["x", "level"]).collect():
        assert abs(r["expected"] - r["share"]) <= drift.SHARE_ERROR
    moved = ref.withColumns({"x": ref.x + 1, "level": ref.level})
    got = {r["feature"]: r["psi"] for r in drift.sketched_psi(sketches, moved, ["x", "level"]).collect()}
    exact = {r["feature"]: r["psi"] for r in drift.psi(drift.value_counts(ref, moved, ["x", "level"])).collect()}
    assert got["level"] < 0.01 and got["x"] == pytest.approx(exact["x"], rel=0.1)
