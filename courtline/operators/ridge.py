"""Regularised plus-minus from stints by weighted ridge regression.

A stint row carries its ten players, so the normal equations are sums over pairs
taken inside the row: one pass with map-side aggregation and a shuffle of at
most players squared keys. Only these sums reach the solver, which is one
iteration of conjugate gradients on tables for all seasons, folds, penalties and
targets at once: a row per player, a column per system. Blocks of players are
solved directly to precondition it, so a season of one block takes one round.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtline.functions.misc import decay_weight
from courtline.session import ensure_checkpoint_dir

# Sample minimums, scale and penalties.
MIN_STINTS, MIN_PLAYERS, PER_POSSESSIONS = 100, 10, 100.0
LAMBDAS = [1000.0, 2000.0, 5000.0, 10000.0]
CV_FOLDS = 5
#: A system is solved when its squared residual has fallen to this share of its first one, or
#: stays where doubles leave it: no lower for STALLED rounds.
TOLERANCE, STALLED = 1e-22, 30
#: Players of a preconditioner's block, about: the bound of what one task factorises.
BLOCK_PLAYERS = 768


def player_exposure(stints: DataFrame, season: str) -> DataFrame:
    """Minutes and number of stints per (season, player)."""
    return (
        stints.select(
            season, "duration_seconds",
            F.explode(F.concat("home_lineup", "away_lineup")).alias("player_id"),
        )
        .groupBy(season, "player_id")
        .agg(
            (F.sum("duration_seconds") / 60.0).alias("minutes"),
            F.count(F.lit(1)).alias("sample_stints"),
        )
    )


def eligible_players(exposure: DataFrame, min_minutes: float) -> DataFrame:
    return exposure.filter(F.col("minutes") >= min_minutes)


def _weighted(stints: DataFrame, season: str, tau: float) -> DataFrame:
    """Stints with weight, both targets and the players, home ones first."""
    latest = stints.groupBy(season).agg(F.max("game_date").alias("__ref"))
    poss = F.when(F.col("possessions") > 0, F.col("possessions")).otherwise(1.0)
    # one row per season, so this side is bounded by the calendar
    return stints.join(F.broadcast(latest), season).select(
        season,
        "stint_id",
        (decay_weight(F.col("game_date"), F.col("__ref"), tau) * F.sqrt(poss)).alias("w"),
        (F.col("home_points") * PER_POSSESSIONS / poss).alias("y_off"),
        (-F.col("away_points") * PER_POSSESSIONS / poss).alias("y_def"),
        F.concat("home_lineup", "away_lineup").alias("players"),
        F.size("home_lineup").alias("at_home"),
    )


def _sign(place: Column) -> Column:
    return F.when(place < F.col("at_home"), 1).otherwise(-1)


def design_matrix(stints: DataFrame, season: str, tau: float) -> DataFrame:
    """The sparse matrix as rows (stint, player, value) with targets and weight."""
    return _weighted(stints, season, tau).select(
        season, "stint_id", "w", "y_off", "y_def", "at_home",
        F.posexplode("players").alias("place", "player_id"),
    ).select(season, "stint_id", "player_id", _sign(F.col("place")).alias("value"), "w", "y_off", "y_def")


def gram(weighted: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted and plain sums of v_p * v_q for p <= q."""
    upper = F.flatten(F.transform(
        F.sequence(F.lit(0), F.size("players") - 1),
        lambda i: F.transform(F.sequence(i, F.size("players") - 1), lambda j: F.struct(i.alias("i"), j.alias("j"))),
    ))
    slots = weighted.select(*keys, "w", "players", "at_home", F.explode(upper).alias("slot"))
    i, j = F.col("slot.i"), F.col("slot.j")
    first, second = F.get("players", i), F.get("players", j)
    twice = F.when((i < j) & (first == second), 2).otherwise(1)
    return (
        slots.select(
            *keys, "w", F.least(first, second).alias("p"), F.greatest(first, second).alias("q"),
            (_sign(i) * _sign(j) * twice).alias("vv"),
        )
        .groupBy(*keys, "p", "q")
        .agg(F.sum(F.col("w") * F.col("vv")).alias("wvv"), F.sum("vv").alias("vv"))
    )


def moments(weighted: DataFrame, keys: list[str]) -> DataFrame:
    """Per player: sums of v against weight and targets."""
    long = weighted.select(
        *keys, "w", "y_off", "y_def", "at_home", F.posexplode("players").alias("place", "p")
    )
    v = _sign(F.col("place"))
    return long.groupBy(*keys, "p").agg(
        F.sum(F.col("w") * v).alias("wv"),
        F.sum(F.col("w") * v * F.col("y_off")).alias("wvo"),
        F.sum(F.col("w") * v * F.col("y_def")).alias("wvd"),
        F.sum(v).alias("sv"),
        F.sum(v * F.col("y_off")).alias("svo"),
    )


def totals(weighted: DataFrame, keys: list[str]) -> DataFrame:
    w, o, d = F.col("w"), F.col("y_off"), F.col("y_def")
    return weighted.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(w).alias("tw"), F.sum(w * o).alias("two"),
        F.sum(w * d).alias("twd"), F.sum(o).alias("so"), F.sum(o * o).alias("soo"),
    )


# --- solver: systems that share the pairs of players and differ in base, target and penalty ---


@dataclass(frozen=True)
class System:
    """One linear system of a season: sums of base ``base``, right side ``target``, penalty."""

    base: int
    target: str
    lam: float


def _sum(of: Column) -> Column:
    return F.coalesce(F.sum(of), F.lit(0.0))


def _factors(half: DataFrame, members: DataFrame, totals: DataFrame, bases: list[int], season: str) -> DataFrame:
    """(season, block, f): eigenvectors and values of each block of the centred sums, per base.

    A block of the sums does not depend on the penalty, so one factorisation serves them all.
    """
    def factorise(key: tuple, rows: pd.DataFrame, crowd: pd.DataFrame) -> pd.DataFrame:
        ids = np.sort(crowd["p"].to_numpy())
        crowd = crowd.set_index("p").loc[ids]
        i, j = np.searchsorted(ids, rows["p"]), np.searchsorted(ids, rows["q"])
        out = [ids.astype("<i8").tobytes()]
        for b in bases:
            g = np.zeros((len(ids), len(ids)))
            g[i, j] = g[j, i] = rows[f"g{b}"]
            m = crowd[f"m{b}"].to_numpy()
            values, vectors = np.linalg.eigh(g - np.outer(m, m) / crowd[f"tw{b}"].iloc[0])
            out += [np.maximum(values, 0.0).tobytes(), vectors.tobytes()]
        return pd.DataFrame({season: [key[0]], "block": [key[1]], "f": [out]})

    side = members.select(season, "p", "block")
    other = side.select(season, F.col("p").alias("q"), F.col("block").alias("other"))
    inside = half.join(side, [season, "p"]).join(other, [season, "q"]).filter("block = other").drop("other")
    crowd = members.join(F.broadcast(totals), season).select(
        # new names for the columns: both sides of the cogroup come from ``members``
        *(F.col(c).alias(c) for c in (season, "block", "p", *(f"{c}{b}" for b in bases for c in ("m", "tw"))))
    )
    kind = members.select(season).schema[0].dataType.simpleString()
    return inside.groupBy(season, "block").cogroup(crowd.groupBy(season, "block")).applyInPandas(
        factorise, f"{season} {kind}, block int, f array<binary>"
    )


def _preconditioned(state: DataFrame, factors: DataFrame, systems: list[System], bases: list[int], season: str) -> DataFrame:
    """The state with z<k>: each block's residual r<k> solved by the block's own system."""
    place = {b: i for i, b in enumerate(bases)}

    def apply(rows: pd.DataFrame, factor: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return rows
        f = factor["f"].iloc[0]
        rows = rows.sort_values("p")  # as the factors
        for k, y in enumerate(systems):
            at = 1 + 2 * place[y.base]
            values = np.frombuffer(f[at])
            vectors = np.frombuffer(f[at + 1]).reshape(len(values), -1)
            rows[f"z{k}"] = vectors @ ((vectors.T @ rows[f"r{k}"].to_numpy()) / (values + y.lam))
        return rows

    return state.groupBy(season, "block").cogroup(factors.groupBy(season, "block")).applyInPandas(apply, state.schema)


def solve(pairs: DataFrame, singles: DataFrame, totals: DataFrame, systems: list[System], season: str) -> DataFrame:
    """(season, p, x0, x1, ...): the centred ridge systems of all seasons, solved together.

    ``pairs`` (season, p, q, g<b>) with p <= q, ``singles`` (season, p, m<b>, <target><b>) and
    ``totals`` (season, tw<b>, t<target><b>) hold the sums of each base b. The matrix of a system
    is G - m m' / tw + lam I with a penalty above zero, its right side o - m t / tw.

    Conjugate gradients. A round is one join of the pairs with the state by player, summed over
    pairs for all columns at once, and one grouped map over blocks of about BLOCK_PLAYERS
    players that solves each block by itself (the preconditioner). Only step lengths, one row
    per season, pass through the driver. A system stops by its own tolerance, and rounds end
    when none is left: there is no bound on players or rounds.
    """
    spark = pairs.sparkSession
    ensure_checkpoint_dir(spark)
    ks = range(len(systems))
    bases = sorted({y.base for y in systems})
    half = pairs.select(season, "p", "q", *(f"g{b}" for b in bases)).checkpoint()
    mirror = half.filter("p <> q").select(season, F.col("q").alias("p"), F.col("p").alias("q"), *(f"g{b}" for b in bases))
    full = half.unionByName(mirror)
    # one row per season: bounded by the calendar
    blocks = F.broadcast(singles.groupBy(season).agg(F.ceil(F.count(F.lit(1)) / BLOCK_PLAYERS).alias("blocks")))
    members = singles.join(F.broadcast(totals.select(season)), season, "left_semi").join(blocks, season)
    members = members.withColumn("block", F.pmod(F.xxhash64("p"), F.col("blocks")).cast("int")).checkpoint()
    factors = _factors(half, members, totals, bases, season).checkpoint()

    def start(k: int, y: System) -> list[Column]:
        right = F.col(f"{y.target}{y.base}") - F.col(f"m{y.base}") * F.col(f"t{y.target}{y.base}") / F.col(f"tw{y.base}")
        return [F.lit(0.0).alias(f"x{k}"), right.alias(f"r{k}"), F.lit(0.0).alias(f"s{k}"), F.lit(0.0).alias(f"z{k}")]

    shared = [season, "block", "p", *(f"{c}{b}" for b in bases for c in ("m", "tw"))]

    def ready(state: DataFrame) -> DataFrame:
        return _preconditioned(state, factors, systems, bases, season).checkpoint()

    state = ready(members.join(F.broadcast(totals), season).select(*shared, *(c for k, y in enumerate(systems) for c in start(k, y))))

    def sizes(of: DataFrame) -> dict:
        rows = of.groupBy(season).agg(*(_sum(F.col(f"r{k}") * F.col(f"z{k}")).alias(f"rz{k}") for k in ks)).collect()
        return {(r[season], k): r[f"rz{k}"] for r in rows for k in ks}

    kind = state.select(season).schema[0].dataType.simpleString()
    steps_schema = f"{season} {kind}, " + ", ".join(f"turn{k} double, on{k} double" for k in ks)
    rz = sizes(state)
    first, best, since, turn = dict(rz), dict(rz), dict.fromkeys(rz, 0), dict.fromkeys(rz, 0.0)
    while live := {key for key, v in rz.items() if v > TOLERANCE * first[key] and since[key] < STALLED}:
        rows = [(s, *(v for k in ks for v in (turn[s, k], float((s, k) in live)))) for s in {s for s, _ in live}]
        steps = F.broadcast(spark.createDataFrame(rows, steps_schema))
        # seasons that are solved drop out of the products, and keep their state
        walking = state.join(steps, season).withColumns({f"s{k}": F.col(f"z{k}") + F.col(f"turn{k}") * F.col(f"s{k}") for k in ks})
        resting = state.join(steps.select(season), season, "left_anti")
        product = (
            full.join(walking.select(season, F.col("p").alias("q"), *(f"s{k}" for k in ks)), [season, "q"])
            .groupBy(season, "p").agg(*(F.sum(F.col(f"g{y.base}") * F.col(f"s{k}")).alias(f"h{k}") for k, y in enumerate(systems)))
        )
        moved = walking.join(product, [season, "p"], "left").na.fill(0.0, [f"h{k}" for k in ks])
        dots = moved.groupBy(season).agg(*(
            c for k, y in enumerate(systems) for c in (
                _sum(F.col(f"m{y.base}") * F.col(f"s{k}")).alias(f"ms{k}"),
                _sum(F.col(f"s{k}") * (F.col(f"h{k}") + y.lam * F.col(f"s{k}"))).alias(f"sh{k}"),
                _sum(F.col(f"r{k}") * F.col(f"z{k}")).alias(f"rz{k}"), F.first(f"tw{y.base}").alias(f"w{k}"),
            )
        ))
        curve = {k: F.col(f"sh{k}") - F.col(f"ms{k}") * F.col(f"ms{k}") / F.col(f"w{k}") for k in ks}
        lengths = dots.select(season, *(f"ms{k}" for k in ks), *(F.when(curve[k] > 0, F.col(f"rz{k}") / curve[k]).otherwise(0.0).alias(f"len{k}") for k in ks))

        def after(k: int, y: System) -> list[Column]:
            length = F.col(f"len{k}") * F.col(f"on{k}")
            along = F.col(f"h{k}") - F.col(f"m{y.base}") * F.col(f"ms{k}") / F.col(f"tw{y.base}") + y.lam * F.col(f"s{k}")
            return [
                (F.col(f"x{k}") + length * F.col(f"s{k}")).alias(f"x{k}"), (F.col(f"r{k}") - length * along).alias(f"r{k}"),
                F.col(f"s{k}"), F.col(f"z{k}"),
            ]

        walked = moved.join(F.broadcast(lengths), season).select(*shared, *(c for k, y in enumerate(systems) for c in after(k, y)))
        state = ready(walked.unionByName(resting))
        new = sizes(state)
        turn = {key: new[key] / rz[key] if rz[key] > 0 else 0.0 for key in new}
        for key in live:
            since[key] = 0 if new[key] < best[key] else since[key] + 1
            best[key] = min(best[key], new[key])
        rz = new
    return state.select(season, "p", *(f"x{k}" for k in ks))


def fit(
    stints: DataFrame,
    season: str = "season_id",
    lam: float = 5000.0,
    min_minutes: float = 100.0,
    tau: float = 180.0,
) -> DataFrame:
    """Offence, defence and total rating per (season, player), unrounded.

    Seasons with fewer than 100 stints or 10 eligible players give no rows.
    """
    players = eligible_players(player_exposure(stints, season), min_minutes)
    weighted = _weighted(stints, season, tau)
    total = totals(weighted, [season]).filter(F.col("n") >= MIN_STINTS).select(
        season, F.col("tw").alias("tw0"), F.col("two").alias("toff0"), F.col("twd").alias("tdef0")
    )
    crowd = players.groupBy(season).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= MIN_PLAYERS).select(season)
    total = total.join(crowd, season, "left_semi")
    keep = players.join(F.broadcast(total.select(season)), season, "left_semi").select(season, F.col("player_id").alias("p"), "sample_stints").checkpoint()
    pairs = _between(gram(weighted, [season]), keep.select(season, "p"), season).select(season, "p", "q", F.col("wvv").alias("g0"))
    singles = moments(weighted, [season]).join(keep.select(season, "p"), [season, "p"], "left_semi").select(
        season, "p", F.col("wv").alias("m0"), F.col("wvo").alias("off0"), F.col("wvd").alias("def0")
    )
    beta = solve(pairs, singles, total, [System(0, "off", lam), System(0, "def", lam)], season)
    return beta.join(keep, [season, "p"]).select(
        season, F.col("p").alias("player_id"), F.col("x0").alias("orapm"), F.col("x1").alias("drapm"),
        (F.col("x0") + F.col("x1")).alias("rapm"), "sample_stints",
    )


def _between(pairs: DataFrame, keep: DataFrame, season: str) -> DataFrame:
    """Pairs of kept players only."""
    return pairs.join(keep, [season, "p"], "left_semi").join(keep.withColumnRenamed("p", "q"), [season, "q"], "left_semi")


def residuals(stints: DataFrame, ratings: DataFrame, season: str = "season_id", lam: float = 5000.0, tau: float = 180.0) -> DataFrame:
    """Per (season, player) of ``ratings`` what its two normal equations leave over.

    Taken from the stints, not from the sums the solver saw: each stint's error under the
    ratings, weighted, summed over the player's stints, less the penalty.
    """
    weighted = _weighted(stints, season, tau)
    seasons = ratings.select(season).distinct()
    lines = design_matrix(stints, season, tau).join(seasons, season, "left_semi")
    rated = lines.join(ratings.select(season, "player_id", "orapm", "drapm"), [season, "player_id"])
    told = rated.groupBy(season, "stint_id").agg(
        F.sum(F.col("value") * F.col("orapm")).alias("off"), F.sum(F.col("value") * F.col("drapm")).alias("def")
    )
    errors = (
        weighted.join(seasons, season, "left_semi").select(season, "stint_id", "w", "y_off", "y_def")
        .join(told, [season, "stint_id"], "left").na.fill(0.0, ["off", "def"])
        .select(season, "stint_id", "w", (F.col("y_off") - F.col("off")).alias("e_off"), (F.col("y_def") - F.col("def")).alias("e_def"))
    )
    base = errors.groupBy(season).agg(
        (F.sum(F.col("w") * F.col("e_off")) / F.sum("w")).alias("b_off"), (F.sum(F.col("w") * F.col("e_def")) / F.sum("w")).alias("b_def")
    )
    left = errors.join(F.broadcast(base), season).select(
        season, "stint_id", (F.col("e_off") - F.col("b_off")).alias("e_off"), (F.col("e_def") - F.col("b_def")).alias("e_def")
    )
    # the intercept's equation holds, so the centring of a player's column adds nothing
    return rated.join(left, [season, "stint_id"]).groupBy(season, "player_id").agg(
        (F.sum(F.col("w") * F.col("value") * F.col("e_off")) - lam * F.first("orapm")).alias("off_left"),
        (F.sum(F.col("w") * F.col("value") * F.col("e_def")) - lam * F.first("drapm")).alias("def_left"),
    )


def rounded(ratings: DataFrame) -> DataFrame:
    return ratings.withColumns({c: F.bround(c, 3) for c in ("orapm", "drapm", "rapm")})


def _pick(name: str, fold: int) -> Column:
    return _sum(F.when(F.col("fold") == fold, F.col(name)))


def held_out(
    stints: DataFrame,
    season: str = "season_id",
    lambdas: list[float] = LAMBDAS,
    folds: int = CV_FOLDS,
    min_minutes: float = 100.0,
    tau: float = 180.0,
    fold: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Held-out errors of the offence target, and the ratings behind them.

    Errors: (season, fold, lambda, n, sse, sst) of each fold that holds stints, for seasons of
    100 stints or more. Ratings: (season, p, x<k>) with k = fold * len(lambdas) + place of lambda.

    Every fold needs only its own sums: training sums are the whole less the fold, and the
    held-out error is a quadratic form in the fold's plain sums. One pass makes the sums, all
    systems are solved together, and one pass over the pairs makes all errors.
    """
    if fold is None:
        fold = F.pmod(F.xxhash64("stint_id", F.lit(42)), F.lit(folds))
    keys = [season, "fold"]
    weighted = _weighted(stints, season, tau).withColumn("fold", fold.cast("int"))
    each = range(folds)
    total = totals(weighted, keys).groupBy(season).agg(
        F.sum("n").alias("n"),
        *(c for f in each for c in (
            (F.sum("tw") - _pick("tw", f)).alias(f"tw{f}"), (F.sum("two") - _pick("two", f)).alias(f"toff{f}"),
            _pick("n", f).alias(f"n{f}"), _pick("so", f).alias(f"so{f}"), _pick("soo", f).alias(f"soo{f}"),
        ))
    ).filter(F.col("n") >= MIN_STINTS).checkpoint()
    keep = eligible_players(player_exposure(stints, season), min_minutes).select(season, F.col("player_id").alias("p"))
    keep = keep.join(F.broadcast(total.select(season)), season, "left_semi").checkpoint()
    pairs = _between(gram(weighted, keys), keep, season).groupBy(season, "p", "q").agg(*(
        c for f in each for c in ((F.sum("wvv") - _pick("wvv", f)).alias(f"g{f}"), _pick("vv", f).alias(f"v{f}"))
    )).checkpoint()
    singles = moments(weighted, keys).join(keep, [season, "p"], "left_semi").groupBy(season, "p").agg(*(
        c for f in each for c in (
            (F.sum("wv") - _pick("wv", f)).alias(f"m{f}"), (F.sum("wvo") - _pick("wvo", f)).alias(f"off{f}"),
            _pick("sv", f).alias(f"sv{f}"), _pick("svo", f).alias(f"svo{f}"),
        )
    )).checkpoint()
    systems = [System(f, "off", lam) for f in each for lam in lambdas]
    beta = solve(pairs, singles, total, systems, season)
    ks = range(len(systems))
    own = singles.join(beta, [season, "p"]).groupBy(season).agg(*(
        F.sum(F.col(f"{c}{y.base}") * F.col(f"x{k}")).alias(f"{c}x{k}") for k, y in enumerate(systems) for c in ("m", "sv", "svo")
    ))
    other = beta.select(season, F.col("p").alias("q"), *(F.col(f"x{k}").alias(f"z{k}") for k in ks))
    twice = F.when(F.col("p") == F.col("q"), 1).otherwise(2)
    forms = pairs.join(beta, [season, "p"]).join(other, [season, "q"]).groupBy(season).agg(*(
        F.sum(F.col(f"v{y.base}") * twice * F.col(f"x{k}") * F.col(f"z{k}")).alias(f"form{k}") for k, y in enumerate(systems)
    ))

    def row(k: int, y: System) -> Column:
        f = y.base
        n, so, soo = (F.col(f"{c}{f}") for c in ("n", "so", "soo"))
        base = (F.col(f"toff{f}") - F.col(f"mx{k}")) / F.col(f"tw{f}")
        sse = soo - 2 * (base * so + F.col(f"svox{k}")) + n * base * base + 2 * base * F.col(f"svx{k}") + F.col(f"form{k}")
        return F.struct(
            F.lit(f).alias("fold"), F.lit(float(y.lam)).alias("lambda"), n.cast("bigint").alias("n"), sse.alias("sse"),
            (soo - so * so / n).alias("sst"), base.alias("base"),
        )

    # one row per season on each side
    errors = total.join(own, season).join(forms, season).select(season, F.explode(F.array(*(row(k, y) for k, y in enumerate(systems)))).alias("e"))
    return errors.select(season, "e.*").filter("n > 0"), beta


def held_out_direct(
    stints: DataFrame, errors: DataFrame, beta: DataFrame, fold: Column, season: str = "season_id",
    lambdas: list[float] = LAMBDAS, tau: float = 180.0,
) -> DataFrame:
    """(season, fold, lambda, direct): the errors of ``held_out`` summed over the held-out stints."""
    steps = len(lambdas)
    ks = range(sum(c.startswith("x") for c in beta.columns))
    lines = design_matrix(stints, season, tau).withColumn("fold", fold.cast("int")).withColumnRenamed("player_id", "p")
    told = lines.join(beta, [season, "p"]).groupBy(season, "fold", "stint_id").agg(*(F.sum(F.col("value") * F.col(f"x{k}")).alias(f"t{k}") for k in ks))
    every = F.array(*(F.struct(F.lit(float(v)).alias("lambda"), F.get(F.array(*(f"t{k}" for k in ks)), F.col("fold") * steps + i).alias("told")) for i, v in enumerate(lambdas)))
    own = _weighted(stints, season, tau).withColumn("fold", fold.cast("int")).select(season, "fold", "stint_id", "y_off")
    each = own.join(told, [season, "fold", "stint_id"], "left").select(season, "fold", "y_off", F.explode(every).alias("e"))
    gap = F.col("y_off") - F.col("base") - F.coalesce("told", F.lit(0.0))
    return (
        each.select(season, "fold", "y_off", "e.*").join(F.broadcast(errors.select(season, "fold", "lambda", "base")), [season, "fold", "lambda"])
        .groupBy(season, "fold", "lambda").agg(F.sum(gap * gap).alias("direct"))
    )


def cross_validate(stints: DataFrame, season: str = "season_id", **options) -> DataFrame:
    """Mean held-out R2 of the offence target per (season, lambda); options as ``held_out``."""
    errors, _ = held_out(stints, season, **options)
    return errors.groupBy(season, "lambda").agg(F.avg(1 - F.col("sse") / F.col("sst")).alias("mean_r2"))


def best_lambda(scores: DataFrame, season: str = "season_id") -> DataFrame:
    return scores.groupBy(season).agg(
        F.max_by("lambda", F.struct("mean_r2", -F.col("lambda"))).alias("best_lambda"),
        F.max("mean_r2").alias("best_r2"),
    )


def extremes(ratings: DataFrame, k: int = 10) -> DataFrame:
    """The k highest and k lowest ratings."""
    top = ratings.orderBy(F.desc("rapm"), "player_id").limit(k).withColumn("end", F.lit("top"))
    low = ratings.orderBy(F.asc("rapm"), "player_id").limit(k).withColumn("end", F.lit("bottom"))
    return top.unionByName(low)
