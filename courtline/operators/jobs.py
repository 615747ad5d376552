"""User-level jobs: load history, build features, train and score, report series."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtline.functions import misc
from courtline.operators import backtest, markets, metrics, normalize, reports, ridge, schedule, spacing
from courtline.operators.stints import derive_stints
from courtline.sources import maintenance
from courtline.sources.schemas import NATURAL_KEYS

# Order in which the tables of a history load depend on each other.
LOAD_ORDER = ["seasons", "teams", "players", "player_seasons", "games", "plays", "shots", "game_stats", "player_game_stats"]

Trainer = Callable[[DataFrame, DataFrame], DataFrame]


def load_history(
    landed: Mapping[str, DataFrame], root: str, partition: str = "season_id", version: str = "loaded_at"
) -> None:
    """Upsert landed tables in dependency order, then derive and store stints.

    One set-based job per table over all its games; what is stored already stays. Of repeated
    keys the row with the latest ``version`` wins, then the largest in its other columns.
    Facts without a season take it from games, so every fact is partitioned by season;
    dimensions are stored whole. The stints of a landed game replace all it had.
    """
    games = landed["games"].select("game_id", partition)
    for name in LOAD_ORDER:
        if name not in landed:
            continue
        rows = landed[name]
        keys = NATURAL_KEYS[name]
        if partition not in rows.columns and "game_id" in rows.columns:
            rows = rows.join(games, "game_id")
        rest = [c for c in rows.columns if c not in keys and c != version]
        order = [c for c in (version,) if c in rows.columns] + rest
        fact = partition in rows.columns and name != "seasons"
        maintenance.upsert_table(f"{root}/{name}", rows, keys, order or keys, partition if fact else None)
    if "plays" in landed:
        teams = landed["games"].select("game_id", "home_team_id", "away_team_id", partition).distinct()
        plays = landed["plays"].join(teams, "game_id")
        stints = derive_stints(plays, ["period"]).join(games.distinct(), "game_id")
        maintenance.repair_games(f"{root}/stints", plays.select("game_id").distinct(), stints, partition)


def build_features(
    game_stats: DataFrame,
    metric_columns: list[str],
    stints: DataFrame,
    shots: DataFrame,
    games: DataFrame,
    lat: Column,
    lon: Column,
    lam: float,
    min_minutes: float,
    tau: float,
) -> dict[str, DataFrame]:
    """The four feature tables, for all seasons at once and keyed by season.

    ``game_stats`` and ``stints`` have season_id; ``shots`` has season_id,
    player_id, loc_x and loc_y; ``games`` is the schedule.
    """
    keys = ["season_id"]
    busy = spacing.busy_seasons(shots, "season_id")
    summary = spacing.player_summary(
        shots.join(F.broadcast(busy), "season_id", "left_semi"), ["season_id", "player_id"]
    )
    return {
        "season_stats": normalize.season_stats(game_stats, "season_id", metric_columns),
        "player_rapm": ridge.rounded(ridge.fit(stints, "season_id", lam, min_minutes, tau)),
        "lineup_spacing": spacing.lineup_spacing(
            spacing.distinct_lineups(stints, keys), summary, keys
        ),
        "team_game_fatigue": schedule.schedule_flags(schedule.team_days(games), lat, lon),
    }


@dataclass
class GameModel:
    """Win probability, margin and total from a feature table."""

    features: list[str]
    win: LogisticRegressionModel
    margin: LinearRegressionModel
    total: LinearRegressionModel

    @staticmethod
    def labels(games: DataFrame) -> DataFrame:
        """Win, margin and total of played games."""
        home, away = F.col("home_score"), F.col("away_score")
        return games.withColumns(
            {
                "actual_win": (home > away).cast("int"),
                "actual_margin": (home - away).cast("double"),
                "actual_total": (home + away).cast("double"),
            }
        )

    @classmethod
    def fit(cls, rows: DataFrame, features: list[str], reg: float = 0.01) -> GameModel:
        data = _assemble(rows, features)
        logistic = LogisticRegression(featuresCol="__x", labelCol="actual_win", regParam=reg)
        linear = {
            c: LinearRegression(featuresCol="__x", labelCol=f"actual_{c}", regParam=reg).fit(data)
            for c in ("margin", "total")
        }
        return cls(features, logistic.fit(data), linear["margin"], linear["total"])

    def predict(self, rows: DataFrame) -> DataFrame:
        """Rows with clamped predictions and the confidence of the win probability."""
        made = self.win.transform(_assemble(rows, self.features)).withColumn(
            "__p", vector_to_array("probability")[1]
        ).drop("rawPrediction", "probability", "prediction")
        for name, model in (("margin", self.margin), ("total", self.total)):
            made = model.setPredictionCol(f"__{name}").transform(made)
        return made.select(
            *rows.columns,
            misc.clamp(F.col("__p"), misc.WIN_BOUNDS).alias("home_win_prob"),
            misc.clamp(F.col("__margin"), misc.MARGIN_BOUNDS).alias("predicted_margin"),
            misc.clamp(F.col("__total"), misc.TOTAL_BOUNDS).alias("predicted_total"),
            misc.prediction_confidence(F.col("__p")).alias("confidence"),
        )


def _assemble(rows: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="__x", handleInvalid="keep").transform(rows)


def model_trainer(features: list[str]) -> Trainer:
    """A trainer for ``walk_forward``: fits on the first table, predicts the second."""
    return lambda train, val: GameModel.fit(GameModel.labels(train), features).predict(val)


def walk_forward(
    games: DataFrame,
    odds: DataFrame | None,
    trainer: Trainer,
    levels: list[str],
    order: list[str],
    date: str = "game_date",
    min_train: int = backtest.MIN_TRAIN,
    window: int = backtest.WINDOW,
    step: int = backtest.STEP,
    **betting,
) -> DataFrame:
    """Train and predict fold by fold, then bet on every validation game.

    The loop is over folds, each of which is a training run; training and
    validation rows are position filters on one ranked table. Returns settled bets
    with fold_num, ready for ``equity_curve``. Missing odds take default prices.
    """
    ranked = backtest.ranked(games, levels, order).persist()
    plan = backtest.folds(games, levels, order, date, min_train, window, step)
    # fold numbers only: one small row per training run
    bounds = sorted((r["fold_num"], r["train_games"]) for r in plan.select("fold_num", "train_games").toLocalIterator())
    if not bounds:
        raise ValueError(f"need at least {min_train + window} games for one fold")
    out = None
    for fold, size in bounds:
        train = ranked.filter(F.col("position") < size).drop("position", "total_games")
        val = ranked.filter(F.col("position").between(size, size + window - 1)).drop("position", "total_games")
        made = trainer(train, val).withColumn("fold_num", F.lit(fold))
        out = made if out is None else out.unionByName(made)
    return _settled(out, odds, **betting)


def walk_forward_linear(
    games: DataFrame,
    odds: DataFrame | None,
    features: list[str],
    levels: list[str],
    order: list[str],
    penalty: float = 1.0,
    min_train: int = backtest.MIN_TRAIN,
    window: int = backtest.WINDOW,
    step: int = backtest.STEP,
    **betting,
) -> DataFrame:
    """``walk_forward`` with linear models: all folds are trained from prefix sums in one plan.

    Win probability, margin and total are regressions on the features, clamped as by
    ``GameModel``. ``games`` has home_score and away_score. Returns settled bets with fold_num.
    """
    labelled = GameModel.labels(games)
    made = backtest.fold_predictions(
        labelled, levels, order, features, ["actual_win", "actual_margin", "actual_total"], penalty, min_train, window, step
    ).select(
        *games.columns, "fold_num",
        misc.clamp(F.col("predicted_actual_win"), misc.WIN_BOUNDS).alias("home_win_prob"),
        misc.clamp(F.col("predicted_actual_margin"), misc.MARGIN_BOUNDS).alias("predicted_margin"),
        misc.clamp(F.col("predicted_actual_total"), misc.TOTAL_BOUNDS).alias("predicted_total"),
    )
    return _settled(made, odds, **betting)


def _settled(made: DataFrame, odds: DataFrame | None, **betting) -> DataFrame:
    prices = ["home_ml", "away_ml", "spread", "spread_home_odds", "spread_away_odds", "total", "over_odds", "under_odds"]
    priced = made if odds is None else made.join(odds, "game_id", "left")
    missing = {c: F.lit(None).cast("double") for c in prices if c not in priced.columns}
    return markets.game_bets(priced.withColumns(missing), **betting)


def performance_series(bets: DataFrame, levels: list[str], order: list[str]) -> dict[str, DataFrame]:
    """The report tables over one cached bet table."""
    kept = bets.persist()
    decided = kept.filter(F.col("result").isin("win", "loss")).withColumn(
        "won", (F.col("result") == "win").cast("double")
    )
    return {
        "calibration": metrics.calibration_bins(decided, "model_prob", "won"),
        "monthly_roi": reports.monthly_roi(kept),
        "bet_types": reports.bet_type_counts(kept),
        "win_rate": reports.rolling_win_rate(kept, levels, order),
        "cumulative_roi": reports.cumulative_roi(kept, levels, order),
    }
