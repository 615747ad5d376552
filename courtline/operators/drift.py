"""Feature drift, concept drift and retraining triggers.

Both samples are reduced to counts per (feature, value). One running sum over
those counts gives the distribution functions for the two-sample test and the
exact quantiles for the stability index; it is cut into buckets at approximate
quantiles of the distinct values, so that no outlier leaves a whole feature to one task.
"""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtline.functions.misc import ratio_or
from courtline.operators.ordered import running
from courtline.session import ensure_checkpoint_dir

# Thresholds, sample minimums and clips.
P_VALUE, PSI_LIMIT, PSI_BINS, PSI_CLIP = 0.05, 0.2, 10, 1e-10
MIN_KS, MIN_PSI = 5, 10
MIN_ACCURACY, BASE_BRIER, BRIER_MARGIN = 0.48, 0.25, 0.1
RECENT_PREDICTIONS = 100
RETRAIN_DAYS, RETRAIN_GAMES, RETRAIN_BETS, RETRAIN_ROI = 7, 50, 50, -0.05
SERIES_TERMS = 100
# Fixed value: samples of at most this size have an exact p-value.
EXACT_ROWS = 10_000
#: Buckets of values: groups of as many cuts, so that a value is placed by two short looks.
CUT_GROUP = 16
VALUE_BUCKETS = CUT_GROUP * CUT_GROUP


def value_counts(reference: DataFrame, recent: DataFrame, features: list[str]) -> DataFrame:
    """Counts of both samples per (feature, value), running counts and sample sizes.

    Features that either side lacks are skipped.
    """
    present = [f for f in features if f in reference.columns and f in recent.columns]

    def long(df: DataFrame, is_ref: int) -> DataFrame:
        picked = df.select(*[F.col(f).cast("double").alias(f) for f in present])
        return picked.unpivot([], present, "feature", "value").withColumn("r", F.lit(is_ref))

    return counted(long(reference, 1).unionByName(long(recent, 0)))


def _bucket(value: Column) -> Column:
    """Number of ``cuts`` up to the value: whole groups of them first, then inside one group."""
    tops = F.filter(F.transform(F.sequence(F.lit(1), F.lit(CUT_GROUP - 1)), lambda g: F.get("cuts", g * CUT_GROUP - 1)), lambda c: c <= value)
    groups = F.size(tops) * CUT_GROUP
    return groups + F.size(F.filter(F.slice("cuts", groups + 1, F.lit(CUT_GROUP)), lambda c: c <= value))


def counted(both: DataFrame) -> DataFrame:
    """The counts of ``value_counts`` from rows (feature, value, r), r = 1 for the reference.

    The counts per value are stored once, and so are the running counts, as each of them is
    read several times; nothing goes back to the rows.
    """
    ensure_checkpoint_dir(both.sparkSession)
    both = both.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    counts = both.groupBy("feature", "value").agg(
        F.sum("r").alias("ref"), F.sum(1 - F.col("r")).alias("rec")
    ).checkpoint()
    sizes = counts.groupBy("feature").agg(
        F.sum("ref").alias("n_ref"), F.sum("rec").alias("n_rec"),
        F.min("value").alias("low"), F.max("value").alias("high"),
        F.percentile_approx("value", [i / VALUE_BUCKETS for i in range(1, VALUE_BUCKETS)], 16 * VALUE_BUCKETS).alias("cuts"),
    )
    # one row per feature in the list, so broadcasting it is bounded by the list
    placed = counts.join(F.broadcast(sizes), "feature").withColumn("bucket", _bucket(F.col("value"))).drop("cuts")
    return running(
        placed, ["feature"], ["bucket"], ["value"],
        sums={"cum_ref": F.col("ref"), "cum_rec": F.col("rec")},
    ).checkpoint()


def kolmogorov_tail(scaled: Column) -> Column:
    """Asymptotic p-value of the scaled two-sample distance."""
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(SERIES_TERMS)),
        F.lit(0.0),
        lambda acc, k: acc
        + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * scaled * scaled),
    )
    return F.when(scaled < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series)))


def ks_test(counts: DataFrame) -> DataFrame:
    """Distance and asymptotic p-value per feature with at least five values a side."""
    n, m = F.first("n_ref"), F.first("n_rec")
    apart = F.max(F.abs(F.col("cum_ref") / F.col("n_ref") - F.col("cum_rec") / F.col("n_rec")))
    return (
        counts.filter((F.col("n_ref") >= MIN_KS) & (F.col("n_rec") >= MIN_KS))
        .groupBy("feature")
        .agg(apart.alias("ks_stat"), n.alias("n_ref"), m.alias("n_rec"))
        .select(
            "feature", "ks_stat",
            kolmogorov_tail(
                F.col("ks_stat") * F.sqrt(F.col("n_ref") * F.col("n_rec") / (F.col("n_ref") + F.col("n_rec")))
            ).alias("p_value"),
            (F.least("n_ref", "n_rec") < 30).alias("small_sample"),
        )
    )


def path_p_value(n_ref: int, n_rec: int, distance: int) -> float:
    """Exact chance of two samples of these sizes to be ``distance`` / (n_ref n_rec) apart or more.

    All orders of the pooled values are equally likely, each a lattice path that takes a step
    for every value. The mass of the paths that have stayed closer than the distance is carried
    over one anti-diagonal to the next; what leaves is added up.
    """
    if n_ref > n_rec:
        n_ref, n_rec = n_rec, n_ref
    i = np.arange(n_ref + 1)
    mass = (i == 0).astype(float)
    out = 0.0
    for step in range(1, n_ref + n_rec + 1):
        left = n_ref + n_rec - step + 1
        stay = mass * np.maximum(n_rec - (step - 1 - i), 0) / left
        stay[1:] += mass[:-1] * (n_ref - i[:-1]) / left
        far = np.abs(i * n_rec - (step - i) * n_ref) >= distance
        out += stay[far].sum()
        mass = np.where(far, 0.0, stay)
    return float(min(1.0, out))


def exact_p_values(counts: DataFrame) -> DataFrame:
    """(feature, n_ref, n_rec, ks_stat, p_value) per feature with at least five values a side.

    The p-value is exact where neither sample is larger than EXACT_ROWS, else the series. One
    row per feature reaches Python.
    """

    @F.pandas_udf("double")
    def paths(n_ref: pd.Series, n_rec: pd.Series, distance: pd.Series) -> pd.Series:
        rows = zip(n_ref, n_rec, distance, strict=True)
        return pd.Series([path_p_value(*map(int, r)) if max(r[:2]) <= EXACT_ROWS else None for r in rows], dtype=float)

    # whole numbers: n_ref n_rec times the distance
    apart = F.max(F.abs(F.col("cum_ref") * F.col("n_rec") - F.col("cum_rec") * F.col("n_ref")))
    rows = (
        counts.filter((F.col("n_ref") >= MIN_KS) & (F.col("n_rec") >= MIN_KS))
        .groupBy("feature", "n_ref", "n_rec").agg(apart.alias("distance"))
        .withColumn("ks_stat", F.col("distance") / (F.col("n_ref").cast("double") * F.col("n_rec")))
        .withColumn("exact", paths("n_ref", "n_rec", "distance"))
    )
    scale = F.sqrt(F.col("n_ref") * F.col("n_rec") / (F.col("n_ref") + F.col("n_rec")))
    large = F.greatest("n_ref", "n_rec") > EXACT_ROWS
    return rows.select(
        "feature", "n_ref", "n_rec", "ks_stat",
        F.when(large, kolmogorov_tail(F.col("ks_stat") * scale)).otherwise(F.col("exact")).alias("p_value"),
    )


def quantile_edges(counts: DataFrame, bins: int = PSI_BINS) -> DataFrame:
    """Exact reference quantiles (linear interpolation) as distinct bin edges.

    Fewer than three distinct edges fall back to equal widths over both samples.
    """
    picks = []
    for j in range(bins + 1):
        at = (F.col("n_ref") - 1) * j / bins
        low, high = F.floor(at) + 1, F.least(F.floor(at) + 2, F.col("n_ref"))
        picks += [
            F.min(F.when(F.col("cum_ref") >= low, F.col("value"))).alias(f"lo{j}"),
            F.min(F.when(F.col("cum_ref") >= high, F.col("value"))).alias(f"hi{j}"),
        ]
    rows = counts.groupBy("feature").agg(
        *picks, F.first("n_ref").alias("n_ref"), F.first("low").alias("low"), F.first("high").alias("high")
    )

    def edge(j: int) -> Column:
        at = (F.col("n_ref") - 1) * j / bins
        return F.col(f"lo{j}") + (F.col(f"hi{j}") - F.col(f"lo{j}")) * (at - F.floor(at))

    exact = F.array_distinct(F.array(*[edge(j) for j in range(bins + 1)]))
    even = F.array(*[
        F.col("low") + (F.col("high") - F.col("low")) * (j / bins) for j in range(bins + 1)
    ])
    return rows.select("feature", exact.alias("exact"), even.alias("even")).select(
        "feature", F.when(F.size("exact") < 3, F.col("even")).otherwise(F.col("exact")).alias("edges")
    )


def psi(counts: DataFrame, bins: int = PSI_BINS) -> DataFrame:
    """Stability index per feature with at least ``bins`` values a side.

    Recent values outside the reference range count in the total but in no bin.
    """
    usable = counts.filter((F.col("n_ref") >= bins) & (F.col("n_rec") >= bins))
    edges = quantile_edges(usable, bins)
    # one row per feature in the list
    inside = usable.join(F.broadcast(edges), "feature").filter(
        F.col("value").between(F.col("edges")[0], F.element_at("edges", -1))
    )
    slot = F.least(
        F.size(F.filter("edges", lambda e: e <= F.col("value"))), F.size("edges") - 1
    )
    clip = lambda c: F.greatest(F.lit(PSI_CLIP), F.least(F.lit(1.0), c))
    binned = inside.groupBy("feature", slot.alias("slot")).agg(
        clip(F.sum("ref") / F.first("n_ref")).alias("e"), clip(F.sum("rec") / F.first("n_rec")).alias("a")
    )
    return binned.groupBy("feature").agg(
        F.sum((F.col("a") - F.col("e")) * F.ln(F.col("a") / F.col("e"))).alias("psi")
    )


def drift_check(
    reference: DataFrame,
    recent: DataFrame,
    features: list[str],
    p_value: float = P_VALUE,
    psi_limit: float = PSI_LIMIT,
    exact: bool = False,
) -> DataFrame:
    """Both tests per feature and whether it drifted; ``exact`` takes exact p-values of small samples."""
    counts = value_counts(reference, recent, features)
    tested = ks_test(counts)
    if exact:
        tested = tested.drop("p_value").join(exact_p_values(counts).select("feature", "p_value"), "feature")
    joined = tested.join(psi(counts), "feature")
    return joined.withColumn(
        "is_drifted", (F.col("p_value") < p_value) | (F.col("psi") > psi_limit)
    )


def drift_windows(
    rows: DataFrame, day: str, features: list[str], days: int, trained: tuple | None = None
) -> DataFrame:
    """Drift of the last ``days`` against the training dates, or else the days before."""
    last = rows.agg(F.max(day)).scalar()
    dated = rows.withColumn("__age", F.datediff(last, F.col(day)))
    age = F.col("__age")
    recent = dated.filter(age < days)
    if trained is not None:
        reference = dated.filter(F.col(day).between(*[F.lit(d) for d in trained]))
    else:
        reference = dated.filter((age >= days) & (age < 2 * days))
    return drift_check(reference, recent, features)


#: Accuracy of the stored sketches: about 0.4 per cent of the rank.
KLL_SIZE, KLL_GRID = 800, 1000
#: A share is the difference of two ranks, each within the sketch's error and a step of the grid.
SHARE_ERROR = 2 * (0.004 + 1 / KLL_GRID)


def reference_sketches(reference: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """(keys, feature, sketch, n): the reference as a fixed-size sketch per feature and load, to be stored."""
    picked = reference.select(*keys, *[F.col(f).cast("double").alias(f) for f in features])
    long = picked.unpivot(keys, features, "feature", "value").filter(F.col("value").isNotNull() & ~F.isnan("value"))
    return long.groupBy(*keys, "feature").agg(
        F.kll_sketch_agg_double("value", F.lit(KLL_SIZE)).alias("sketch"), F.count(F.lit(1)).alias("n")
    )


def sketched_bins(sketches: DataFrame, bins: int = PSI_BINS) -> DataFrame:
    """(feature, n, inner, expected): inner bin edges and the reference's share of each bin.

    The sketches of all loads are merged per feature and read once, at KLL_GRID even ranks:
    edges are some of these values, and shares count the others between them, so that values
    that repeat keep their weight.
    """
    merged = sketches.groupBy("feature").agg(F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("n").alias("n"))
    grid = F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(j / KLL_GRID) for j in range(1, KLL_GRID + 1)]))
    cut = merged.withColumn("grid", grid).withColumn(
        "inner", F.array_distinct(F.array(*[F.col("grid")[j * KLL_GRID // bins - 1] for j in range(1, bins)]))
    )
    ranks = F.transform("inner", lambda e: F.size(F.filter("grid", lambda g: g <= e)) / KLL_GRID)
    below = F.concat(F.array(F.lit(0.0)), ranks, F.array(F.lit(1.0)))
    steps = F.size("below") - 1
    shares = F.zip_with(F.slice("below", F.lit(2), steps), F.slice("below", F.lit(1), steps), lambda high, low: high - low)
    return cut.withColumn("below", below).select("feature", "n", "inner", shares.alias("expected"))


def bin_shares(rows: DataFrame, bins: DataFrame, features: list[str]) -> DataFrame:
    """(feature, slot, expected, share): of every bin what the reference and what ``rows`` have."""
    picked = rows.select(*[F.col(f).cast("double").alias(f) for f in features])
    long = picked.unpivot([], features, "feature", "value").filter(F.col("value").isNotNull() & ~F.isnan("value"))
    # one row per feature in the list
    placed = long.join(F.broadcast(bins.select("feature", "inner")), "feature").select(
        "feature", F.size(F.filter("inner", lambda e: e < F.col("value"))).alias("slot")
    )
    counts = placed.groupBy("feature", "slot").agg(F.count(F.lit(1)).alias("k"))
    total = counts.groupBy("feature").agg(F.sum("k").alias("total"))
    every = bins.select("feature", F.posexplode("expected").alias("slot", "expected"))
    return every.join(total, "feature").join(counts, ["feature", "slot"], "left").select(
        "feature", "slot", "expected", (F.coalesce("k", F.lit(0)) / F.col("total")).alias("share")
    )


def sketched_psi(sketches: DataFrame, recent: DataFrame, features: list[str], bins: int = PSI_BINS) -> DataFrame:
    """(feature, psi) from stored reference sketches: only the recent rows are read."""
    clip = lambda c: F.greatest(F.lit(PSI_CLIP), F.least(F.lit(1.0), c))
    a, e = clip(F.col("share")), clip(F.col("expected"))
    return bin_shares(recent, sketched_bins(sketches, bins), features).groupBy("feature").agg(F.sum((a - e) * F.ln(a / e)).alias("psi"))


def concept_drift(
    predictions: DataFrame,
    order: list[str],
    window: int = RECENT_PREDICTIONS,
    min_accuracy: float = MIN_ACCURACY,
    margin: float = BRIER_MARGIN,
) -> DataFrame:
    """Accuracy and Brier score of the latest predictions; no row below ten of them."""
    latest = predictions.orderBy(*[F.col(c).desc() for c in order]).limit(window)
    hit = ((F.col("prob") >= 0.5).cast("int") == F.col("actual")).cast("double")
    out = latest.agg(
        F.count(F.lit(1)).alias("n"), F.avg(hit).alias("recent_accuracy"),
        F.avg(F.pow(F.col("prob") - F.col("actual"), 2)).alias("recent_brier_score"),
    )
    return out.filter("n >= 10").select(
        "recent_accuracy", "recent_brier_score",
        (F.col("recent_accuracy") < min_accuracy).alias("accuracy_degraded"),
        (F.col("recent_brier_score") > BASE_BRIER + margin).alias("calibration_degraded"),
    )


def retrain_triggers(
    bets: DataFrame,
    games: DataFrame,
    drift: DataFrame,
    trained_on: dt.date,
    as_of: dt.date,
    days: int = RETRAIN_DAYS,
    new_games: int = RETRAIN_GAMES,
    roi: float = RETRAIN_ROI,
    accuracy: float = MIN_ACCURACY,
) -> DataFrame:
    """The four triggers, the leading reason and its priority, as one row.

    ``bets`` are the recent ones, ``games`` has game_date and status, ``drift`` the
    output of ``drift_check``. Each input is one aggregate row before they meet.
    """
    decided = F.count_if(F.col("result").isin("win", "loss"))
    wins = F.count_if(F.col("result") == "win")
    staked = F.sum("bet_amount")
    loss = ratio_or(F.sum(F.coalesce("profit", F.lit(0.0))), staked)
    poor = (
        (F.count(F.lit(1)) >= RETRAIN_BETS) & (staked > 0) & (decided > 0)
        & ((loss < roi) | (ratio_or(wins, decided) < accuracy))
    )
    fresh = games.filter(
        (F.col("status") == "completed") & (F.col("game_date") > F.lit(trained_on))
        & (F.col("game_date") <= F.lit(as_of))
    )
    row = bets.agg(F.coalesce(poor, F.lit(False)).alias("performance")).withColumns(
        {
            "data": fresh.agg(F.count(F.lit(1)) >= new_games).scalar(),
            "drift": drift.agg(F.coalesce(F.bool_or("is_drifted"), F.lit(False))).scalar(),
            "scheduled": F.lit((as_of - trained_on).days >= days),
        }
    )
    return row.select(
        "scheduled", "drift", "performance", "data",
        F.greatest("scheduled", "drift", "performance", "data").alias("should_retrain"),
        F.when(F.col("drift"), "drift_detected")
        .when(F.col("performance"), "performance_degraded")
        .when(F.col("scheduled"), "scheduled")
        .when(F.col("data"), "new_data").otherwise("").alias("reason"),
        F.when(F.col("drift") | F.col("performance"), "high")
        .when(F.col("scheduled"), "medium").otherwise("low").alias("priority"),
    )
