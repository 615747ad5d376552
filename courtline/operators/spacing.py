"""Lineup spacing: hull area, centroid, corner share, shot density and overlap.

Court coordinates are integers, so a player's shots reduce to at most one row
per court column before anything is collected; the hull of a lineup is the hull
of its players' hulls.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtline.functions.misc import lineup_hash
from courtline.session import ensure_checkpoint_dir

# Court marks (tenths of feet), sample minimums, density grid.
CORNER_X, CORNER_Y = 220, 90
MIN_LINEUP_SHOTS, MIN_DENSITY_SHOTS, MIN_SEASON_SHOTS = 20, 10, 100
GRID = 50
X_RANGE, Y_RANGE = (-250, 250), (-50, 400)
#: Points that are laid over the whole lattice at a time: their terms stay in a core's cache.
POINT_BLOCK = 64

#: Shots that one task sums up: parts grow with the shots, so a task's memory does not.
TASK_SHOTS = 1_000_000

_POINTS = "array<struct<x:double,y:double>>"


def lower_chain(points: Column) -> Column:
    """Lower hull of points sorted by x then y.

    A new point keeps the chain up to the vertex it sees under the steepest slope
    and follows it; of equal slopes the leftmost, so collinear points fall away.
    """

    def add(chain: Column, p: Column) -> Column:
        seen = F.transform(
            chain,
            lambda s, i: F.struct(
                ((p["y"] - s["y"]) / F.nullif(p["x"] - s["x"], F.lit(0.0))).alias("slope"), (-i).alias("i")
            ),
        )
        keep = 1 - F.array_max(seen)["i"]
        return (
            F.when(F.size(chain) == 0, F.array(p))
            .when(F.element_at(chain, -1)["x"] == p["x"], chain)
            .otherwise(F.concat(F.slice(chain, 1, keep), F.array(p)))
        )

    return F.aggregate(points, F.array().cast(_POINTS), add)


def _area_under(chain: Column) -> Column:
    step = F.zip_with(
        F.slice(chain, 1, F.greatest(F.size(chain) - 1, F.lit(0))),
        F.slice(chain, 2, F.size(chain)),
        lambda a, b: (b["x"] - a["x"]) * (a["y"] + b["y"]) / 2.0,
    )
    return F.aggregate(step, F.lit(0.0), lambda acc, v: acc + v)


def hull_area(lower: Column, upper: Column) -> Column:
    """Area between a lower chain and an upper chain given with y negated."""
    return F.greatest(F.lit(0.0), -_area_under(lower) - _area_under(upper))


def player_summary(shots: DataFrame, keys: list[str]) -> DataFrame:
    """Per player: hull chains and the sums behind the lineup means.

    Shots are dealt by player and court column before they are summed, columns by player before
    they are listed, both to parts of about TASK_SHOTS shots: nearly each shot has a column of
    its own, so sums ahead of the exchange would only hold all of them in memory.
    """
    least = int(shots.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least, -(-shots.count() // TASK_SHOTS))
    corner = ((F.col("loc_x") < -CORNER_X) | (F.col("loc_x") > CORNER_X)) & (F.col("loc_y") < CORNER_Y)
    x, y = F.col("loc_x").cast("double"), F.col("loc_y").cast("double")
    columns = shots.repartition(parts, *keys, "loc_x").groupBy(*keys, "loc_x").agg(
        F.min(y).alias("low"), F.max(y).alias("high"), F.count(F.lit(1)).alias("n"),
        F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(F.sqrt(x * x + y * y)).alias("sd"),
        F.count_if(corner).alias("sc"),
    )
    at = F.col("loc_x").cast("double").alias("x")
    return (
        columns.repartition(parts, *keys).groupBy(*keys)
        .agg(
            F.array_sort(F.collect_list(F.struct(at, F.col("low").alias("y")))).alias("lows"),
            F.array_sort(F.collect_list(F.struct(at, (-F.col("high")).alias("y")))).alias("highs"),
            *[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sd", "sc")],
        )
        .select(
            *keys, "n", "sx", "sy", "sd", "sc",
            lower_chain(F.col("lows")).alias("lower"), lower_chain(F.col("highs")).alias("upper"),
        )
    )


def lineup_spacing(
    lineups: DataFrame, summary: DataFrame, keys: list[str], min_shots: int = MIN_LINEUP_SHOTS
) -> DataFrame:
    """Spacing of every lineup; zeros (but the true count) below ``min_shots``.

    ``lineups`` has the array column ``lineup`` and ``keys`` (such as a season)
    that ``summary`` shares.
    """
    named = lineups.select(*keys, "lineup", lineup_hash(F.col("lineup")).alias("lineup_hash"))
    spread = named.select(*keys, "lineup_hash", F.explode("lineup").alias("player_id"))
    merged = spread.join(summary, [*keys, "player_id"], "left").groupBy(*keys, "lineup_hash").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "sx", "sy", "sd", "sc")],
        F.array_sort(F.flatten(F.collect_list("lower"))).alias("lows"),
        F.array_sort(F.flatten(F.collect_list("upper"))).alias("highs"),
    )
    n = F.col("n")
    enough = n >= min_shots
    shown = lambda c, digits: F.when(enough, F.round(c, digits)).otherwise(0.0)
    chained = merged.withColumns(
        {"lower": lower_chain(F.col("lows")), "upper": lower_chain(F.col("highs"))}
    )
    return chained.select(
        *keys,
        "lineup_hash",
        shown(hull_area(F.col("lower"), F.col("upper")), 2).alias("hull_area"),
        shown(F.col("sx") / n, 2).alias("centroid_x"),
        shown(F.col("sy") / n, 2).alias("centroid_y"),
        shown(F.col("sd") / n, 2).alias("avg_distance"),
        shown(F.col("sc") / n, 4).alias("corner_density"),
        n.cast("bigint").alias("shot_count"),
    )


def distinct_lineups(stints: DataFrame, keys: list[str]) -> DataFrame:
    """Home and away lineups of all stints, each once per key."""
    home = stints.select(*keys, F.sort_array("home_lineup").alias("lineup"))
    away = stints.select(*keys, F.sort_array("away_lineup").alias("lineup"))
    return home.unionByName(away).distinct()


def busy_seasons(shots: DataFrame, season: str, least: int = MIN_SEASON_SHOTS) -> DataFrame:
    return shots.groupBy(season).count().filter(F.col("count") >= least).select(season)


def _density_of_player(player: str, grid: int):
    """Grouped map: distinct points of one player with counts -> one lattice row."""
    gx, gy = np.linspace(*X_RANGE, grid), np.linspace(*Y_RANGE, grid)

    def estimate(rows: pd.DataFrame) -> pd.DataFrame:
        k = rows["k"].to_numpy(dtype=float)
        at = rows[["loc_x", "loc_y"]].to_numpy(dtype=float)
        n = k.sum()
        empty = rows[[player]].head(0).assign(density=pd.Series([], dtype=object))
        if n < MIN_DENSITY_SHOTS:
            return empty
        centred = at - (at * k[:, None]).sum(0) / n
        cov = (centred * k[:, None]).T @ centred / (n - 1) * n ** (-1.0 / 3.0)
        det = np.linalg.det(cov)
        if det <= 1e-9:
            return empty
        # whitened, the second coordinate depends on y alone: its factor is taken once per lattice column
        whiten = np.linalg.cholesky(np.linalg.inv(cov)) * np.sqrt(0.5)
        at = at @ whiten
        first, second = gy[:, None] * whiten[1, 0] + gx * whiten[0, 0], gy * whiten[1, 1]
        total = np.zeros((grid, grid))
        for lo in range(0, len(at), POINT_BLOCK):
            block, weight = at[lo : lo + POINT_BLOCK], k[lo : lo + POINT_BLOCK]
            gap = first[:, :, None] - block[:, 0]
            np.multiply(gap, gap, out=gap)
            np.negative(gap, out=gap)
            np.exp(gap, out=gap)
            share = np.exp(-((second[:, None] - block[:, 1]) ** 2)) * weight
            total += np.einsum("jik,jk->ji", gap, share)
        total = total.T.ravel()
        total /= n * 2 * np.pi * np.sqrt(det)
        return pd.DataFrame({player: rows[player].iloc[:1], "density": [total]})

    return estimate


def density_rows(shots: DataFrame, player: str = "player_id", grid: int = GRID) -> DataFrame:
    """Gaussian density of each player's shots as one array over a grid x grid lattice.

    Bandwidth n^(-1/6) on the full sample covariance. Players with fewer than ten
    shots, or with shots on a line, have no row (a density of zero). Shots are
    counted per court point first, so a group is at most the points of the half
    court, however many shots a player has. The partition count is given because
    the work per input byte is far above what adaptive coalescing assumes.
    """
    spark = shots.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    points = shots.groupBy(player, "loc_x", "loc_y").agg(F.count(F.lit(1)).alias("k"))
    kind = shots.select(player).schema[0].dataType.simpleString()
    return points.repartition(parts, player).groupBy(player).applyInPandas(
        _density_of_player(player, grid), f"{player} {kind}, density array<double>"
    )


def shot_density(shots: DataFrame, player: str = "player_id", grid: int = GRID) -> DataFrame:
    """The density lattice as one row per (player, cell)."""
    return density_rows(shots, player, grid).select(
        player, F.posexplode("density").alias("cell", "density")
    )


def gravity_overlap(lineups: DataFrame, density: DataFrame) -> DataFrame:
    """Mean pairwise overlap of the players' densities over their mean mass, at most 1.

    ``density`` is the output of ``density_rows``; it is checkpointed because it is read
    for both members of a pair. Teammate pairs are taken inside the lineup array (ten at most); each distinct
    pair of players is overlapped once, however many lineups it is in.
    """
    ensure_checkpoint_dir(density.sparkSession)
    density = density.checkpoint()
    named = lineups.select("lineup", lineup_hash(F.col("lineup")).alias("lineup_hash"))
    ordered = F.sort_array("lineup")
    pairs = named.select(
        "lineup_hash",
        F.explode(
            F.flatten(
                F.transform(
                    ordered,
                    lambda p, i: F.transform(
                        F.slice(ordered, i + 2, F.size(ordered)),
                        lambda q: F.struct(p.alias("p"), q.alias("q")),
                    ),
                )
            )
        ).alias("pair"),
    ).select("lineup_hash", "pair.p", "pair.q")
    one = density.select(F.col("player_id").alias("p"), F.col("density").alias("dp"))
    two = density.select(F.col("player_id").alias("q"), F.col("density").alias("dq"))
    both = F.zip_with("dp", "dq", lambda a, b: F.least(a, b))
    shared = pairs.select("p", "q").distinct().join(one, "p").join(two, "q").select(
        "p", "q", F.aggregate(both, F.lit(0.0), lambda acc, v: acc + v).alias("overlap")
    )
    mass = density.select(
        "player_id", F.aggregate("density", F.lit(0.0), lambda acc, v: acc + v).alias("mass")
    )
    members = named.select("lineup_hash", F.explode("lineup").alias("player_id"))
    mean_mass = members.join(mass, "player_id").groupBy("lineup_hash").agg(F.avg("mass").alias("mass"))
    met = pairs.join(shared, ["p", "q"]).groupBy("lineup_hash").agg(F.avg("overlap").alias("overlap"))
    ratio = F.when(F.col("mass") > 0, F.least(F.col("overlap") / F.col("mass"), F.lit(1.0)))
    return (
        named.select("lineup_hash").distinct()
        .join(met, "lineup_hash", "left").join(mean_mass, "lineup_hash", "left")
        .select("lineup_hash", F.coalesce(ratio, F.lit(0.0)).alias("overlap"))
    )
