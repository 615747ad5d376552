"""Walk-forward folds, equity curves, drawdown and stake-fraction search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtline.functions import odds as o
from courtline.operators.metrics import INITIAL_BANKROLL
from courtline.operators.ordered import chunk_prefix, running
from courtline.session import ensure_checkpoint_dir

# Fold geometry, fractions to try, held-out share.
MIN_TRAIN, WINDOW, STEP = 500, 100, 50
FRACTIONS = [0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5]


def ranked(games: DataFrame, levels: list[str], order: list[str]) -> DataFrame:
    """Games with their 0-based position in date order and the number of games."""
    placed = running(games, [], levels, order, rank="position")
    size = games.agg(F.count(F.lit(1))).scalar()
    return placed.withColumns({"position": F.col("position") - 1, "total_games": size})


def validation_rows(
    games: DataFrame,
    levels: list[str],
    order: list[str],
    min_train: int = MIN_TRAIN,
    window: int = WINDOW,
    step: int = STEP,
) -> DataFrame:
    """Each game once per fold that validates on it, with fold_num.

    Fold k trains on positions below ``train_games`` and validates on the next
    ``window``. Training rows are not repeated per fold: they are the rows with
    position < train_games, a filter on the ranked table.
    """
    rows = ranked(games, levels, order)
    past = F.col("position") - min_train
    newest = F.floor(past / step)
    oldest = F.greatest(F.lit(0), F.ceil((past - window + 1) / step))
    last_full = F.floor((F.col("total_games") - min_train - window) / step)
    high = F.least(newest, last_full)
    return (
        rows.filter((past >= 0) & (F.col("total_games") >= min_train + window))
        .withColumn("__low", oldest)
        .withColumn("__high", high)
        .filter("__low <= __high")
        .withColumn("__fold", F.explode(F.sequence("__low", "__high")))
        .select(
            *games.columns,
            "position",
            (F.col("__fold") + 1).alias("fold_num"),
            (F.col("__fold") * step + min_train).alias("train_games"),
        )
    )


def folds(
    games: DataFrame,
    levels: list[str],
    order: list[str],
    date: str,
    min_train: int = MIN_TRAIN,
    window: int = WINDOW,
    step: int = STEP,
) -> DataFrame:
    """One row per fold with its sizes and date bounds."""
    held = validation_rows(games, levels, order, min_train, window, step)
    val = held.groupBy("fold_num", "train_games").agg(
        F.min(date).alias("val_start"),
        F.max(date).alias("val_end"),
        F.count(F.lit(1)).alias("val_games"),
    )
    edge_rows = (
        ranked(games, levels, order)
        .filter(F.pmod(F.col("position") + 1 - min_train, F.lit(step)) == 0)
        .select((F.col("position") + 1).alias("train_games"), F.col(date).alias("train_end"))
    )
    start = games.agg(F.min(date)).scalar()
    return val.join(edge_rows, "train_games").withColumn("train_start", start)


#: Blocks whose sums are prefixed in one window; their totals are prefixed above.
BLOCK_GROUP = 1024


def fold_models(
    games: DataFrame,
    levels: list[str],
    order: list[str],
    features: list[str],
    targets: list[str],
    penalty: float = 1.0,
    min_train: int = MIN_TRAIN,
    window: int = WINDOW,
    step: int = STEP,
) -> DataFrame:
    """(fold_num, train_games, beta): ridge regressions of all folds, trained without a loop.

    Fold k trains on all rows before its cut, so its normal equations are a prefix sum over
    blocks of ``step`` rows: one pass sums the products per block, a running sum over the blocks
    gives every fold's sums, and batches of folds are solved side by side. ``beta`` holds one
    list per target, the intercept first; the intercept has no penalty. Rows with a null
    feature or target train nothing.
    """
    past = F.col("position") - min_train
    block = F.when(past < 0, 0).otherwise(F.floor(past / step) + 1).cast("bigint")
    x = [F.lit(1.0), *(F.col(c).cast("double") for c in features)]
    n = len(x)
    whole = F.lit(True)
    for c in (*features, *targets):
        whole = whole & F.col(c).isNotNull()
    products = {f"a{i}_{j}": x[i] * x[j] for i in range(n) for j in range(i, n)}
    products |= {f"b{i}_{t}": x[i] * F.col(name).cast("double") for i in range(n) for t, name in enumerate(targets)}
    placed = ranked(games, levels, order).withColumn("block", block)
    sums = placed.groupBy("block").agg(
        F.max("total_games").alias("total_games"),
        *(F.coalesce(F.sum(F.when(whole, c)), F.lit(0.0)).alias(name) for name, c in products.items()),
    )
    prefix = running(
        sums.withColumn("block_group", F.floor(F.col("block") / BLOCK_GROUP)), [], ["block_group"], ["block"],
        sums={name: F.col(name) for name in products},
    ).withColumns({"fold_num": F.col("block") + 1, "train_games": F.col("block") * step + min_train})

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            a = np.zeros((len(rows), n, n))
            for i in range(n):
                for j in range(i, n):
                    a[:, i, j] = a[:, j, i] = rows[f"a{i}_{j}"]
                if i:
                    a[:, i, i] += penalty
            b = np.stack([[rows[f"b{i}_{t}"].to_numpy() for t in range(len(targets))] for i in range(n)], axis=0).transpose(2, 0, 1)
            beta = np.linalg.solve(a, b).transpose(0, 2, 1)
            yield pd.DataFrame({"fold_num": rows["fold_num"], "train_games": rows["train_games"], "beta": [x.tolist() for x in beta]})

    full = prefix.filter(F.col("train_games") + window <= F.col("total_games"))
    return full.mapInPandas(solve, "fold_num bigint, train_games bigint, beta array<array<double>>")


def fold_predictions(
    games: DataFrame,
    levels: list[str],
    order: list[str],
    features: list[str],
    targets: list[str],
    penalty: float = 1.0,
    min_train: int = MIN_TRAIN,
    window: int = WINDOW,
    step: int = STEP,
) -> DataFrame:
    """Each game once per fold that validates on it, with ``predicted_<target>`` of that fold's model.

    One plan whatever the number of folds; a null feature gives a null prediction.
    """
    models = fold_models(games, levels, order, features, targets, penalty, min_train, window, step).select("fold_num", "beta")
    held = validation_rows(games, levels, order, min_train, window, step).join(models, "fold_num")
    made = {}
    for t, name in enumerate(targets):
        beta = F.col("beta")[t]
        value = beta[0]
        for i, c in enumerate(features, 1):
            value = value + beta[i] * F.col(c)
        made[f"predicted_{name}"] = value
    return held.withColumns(made).drop("beta")


def temporal_split(
    games: DataFrame, levels: list[str], order: list[str], ratio: float = 0.2
) -> DataFrame:
    """Mark the last int(n * ratio) games by date as validation."""
    rows = ranked(games, levels, order)
    held = F.floor(F.col("total_games") * ratio)
    role = F.when(F.col("position") >= F.col("total_games") - held, "validation").otherwise("train")
    return rows.withColumn("role", role).drop("total_games")


def equity_curve(
    bets: DataFrame,
    keys: list[str],
    levels: list[str],
    order: list[str],
    fraction: Column,
    unit_profit: Column,
    same_stake: list[str] | None = None,
    bankroll: float = INITIAL_BANKROLL,
) -> DataFrame:
    """Add bet_no, log_growth and bankroll after each bet.

    A stake is a fraction of the bankroll, so the bankroll is a running product,
    kept as a running sum of logarithms. With ``same_stake`` (columns that name a
    game) the few bets of one game are sized on the bankroll before that game; the
    bets are stored then, as every level of the sum would make them anew.
    """
    change = bets.withColumn("__r", fraction * unit_profit)
    if same_stake:
        group = Window.partitionBy(*keys, *same_stake)
        stepwise = group.orderBy(*[c for c in order if c not in same_stake])
        change = change.withColumns(
            {
                "__within": F.sum("__r").over(
                    stepwise.rowsBetween(Window.unboundedPreceding, 0)
                ),
                "__log": F.when(
                    F.row_number().over(stepwise) == F.count(F.lit(1)).over(group),
                    F.log1p(F.sum("__r").over(group)),
                ).otherwise(0.0),
            }
        )
        ensure_checkpoint_dir(bets.sparkSession)
        change = change.checkpoint()
    else:
        change = change.withColumns({"__within": F.col("__r"), "__log": F.log1p("__r")})
    walked = running(
        change, keys, levels, order, rank="bet_no", sums={"__before": F.col("__log")},
        inclusive=False,
    )
    growth = F.col("__before") + F.log1p("__within")
    return walked.withColumn("log_growth", growth).select(
        *bets.columns, "bet_no", "log_growth",
        (F.exp("log_growth") * bankroll).alias("bankroll"),
    )


def curve_summaries(curve: DataFrame, group: list[str], order: list[str], value: str, rank: str) -> DataFrame:
    """One row per chunk: peak, low, end, own_fall, inner (longest stay), last and rising records."""
    inside = Window.partitionBy(*group).orderBy(*order, rank)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    rows = (
        curve.select(*dict.fromkeys([*group, *order, rank, value])).withColumn("__before", F.max(value).over(earlier))
        .withColumn("__top", F.greatest("__before", F.col(value)))
        .withColumn("__record", F.when(F.col(value) >= F.col("__top"), F.col(rank)))
        .withColumn("__gap", F.col("__record") - F.max("__record").over(earlier))
    )
    above = F.col("__before").isNull() | (F.col(value) > F.col("__before"))
    record = F.when(F.col("__record").isNotNull() & above, F.struct(F.col("__record").alias("n"), F.col(value).alias("v")))
    return rows.groupBy(*group).agg(
        F.max(value).alias("peak"), F.min(value).alias("low"), F.max(rank).alias("end"),
        F.max(F.try_divide(F.col("__top") - F.col(value), F.col("__top"))).alias("own_fall"),
        F.max(F.when(F.col("__gap") > 1, F.col("__gap"))).alias("inner"), F.max("__record").alias("last"),
        F.sort_array(F.collect_list(record)).alias("records"),
    )


def drawdown(
    curve: DataFrame,
    keys: list[str],
    levels: list[str],
    order: list[str],
    value: str = "bankroll",
    rank: str = "bet_no",
    start: float = INITIAL_BANKROLL,
) -> DataFrame:
    """Deepest fall from a peak and longest stay below one, in steps, per key.

    A stay lasts from a peak to the next row at or above it. Each chunk of the curve becomes a
    summary: its peak and low, its own deepest fall and longest stay, its end, and of its records
    (rows at or above all before them in the chunk) the last one and those above all before. Rows
    that only equal the peak, as all do on a curve that is at zero, are not listed. Summaries
    merge: under an earlier peak P the low falls (P - low) / P, records under P are none, and
    what they hid is part of a longer stay. So the rows are read once, and only summaries are
    stored and prefixed.
    """
    ensure_checkpoint_dir(curve.sparkSession)
    group = [*keys, *levels]
    chunks = curve_summaries(curve, group, [c for c in order if c not in levels], value, rank).checkpoint()

    peak = F.greatest(F.lit(start), F.col("peak__before"))
    placed = chunks.join(chunk_prefix(chunks.select(*group, "peak"), keys, levels, {"peak": "max"}), group).select(
        *group, "end", "inner",
        F.greatest("own_fall", (peak - F.col("low")) / peak).alias("fall"),
        F.get(F.filter("records", lambda r: r["v"] >= peak), 0)["n"].alias("first_at"),
        F.when(F.col("peak") >= peak, F.col("last")).alias("last_at"),
    )
    lasts = chunk_prefix(placed.select(*group, "last_at"), keys, levels, {"last_at": "last"})
    since = F.coalesce("last_at__before", F.lit(0))
    head = F.when(F.col("first_at").isNull(), F.col("end") - since + 1).when(F.col("first_at") - since > 1, F.col("first_at") - since)
    tail = F.when(F.col("end") > F.col("last_at"), F.col("end") - F.col("last_at") + 1)
    return placed.join(lasts, group).groupBy(*keys).agg(
        F.max("fall").alias("max_drawdown"),
        F.coalesce(F.max(F.greatest(head, tail, "inner")), F.lit(0)).alias("max_drawdown_steps"),
    )


def fraction_grid(
    bets: DataFrame,
    fractions: list[float] = FRACTIONS,
    cap: float = o.MAX_BET_FRACTION,
    min_edge: float = o.MIN_EDGE,
) -> DataFrame:
    """Bets times stake fractions, with the stake and return of each.

    The grid is a short literal list exploded inside the row. The edge is taken
    against the raw price, margin included.
    """
    unit = (
        F.when(F.col("result") == "win", F.col("market_odds") - 1)
        .when(F.col("result") == "loss", -1.0)
        .otherwise(0.0)
    )
    grid = bets.withColumn("fraction", F.explode(F.array(*[F.lit(f) for f in fractions])))
    size = o.kelly(
        F.col("model_prob"), F.col("market_odds"), fraction=F.col("fraction"), cap=cap,
        min_edge=min_edge,
    )
    return grid.withColumns(
        {"stake": size["bet_fraction"], "placed": size["has_edge"], "unit": unit}
    ).withColumn("bet_return", F.col("stake") * F.col("unit"))


def fraction_scores(grid: DataFrame, bankroll: float = INITIAL_BANKROLL) -> DataFrame:
    """Sharpe and growth per fraction, by aggregation alone."""
    taken = F.when(F.col("placed"), F.col("bet_return"))
    spread = F.stddev_pop(taken)
    log_final = F.sum(F.log1p("bet_return"))
    return grid.groupBy("fraction").agg(
        F.count(taken).alias("bets_placed"),
        log_final.alias("log_growth"),
        F.when(spread > 0, F.avg(taken) / spread * F.sqrt(F.count(taken)))
        .otherwise(0.0).alias("sharpe"),
        (F.exp(log_final / F.count(F.lit(1))) - 1).alias("growth"),
    )


def best_fraction(scores: DataFrame, metric: str = "sharpe") -> DataFrame:
    """The fraction with the best metric; the smallest of equals."""
    if metric not in ("sharpe", "growth"):
        raise ValueError(f"unknown metric {metric!r}")
    best = F.max_by(F.struct("fraction", metric), F.struct(F.col(metric), -F.col("fraction")))
    return scores.agg(best.alias("best")).select(
        F.col("best.fraction").alias("best_fraction"),
        F.col(f"best.{metric}").alias("best_metric"),
    )
