"""Injury adjustment of whole prediction tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtline.functions import availability as av
from courtline.functions.misc import MARGIN_BOUNDS, TOTAL_BOUNDS, WIN_BOUNDS, clamp
from courtline.session import ensure_checkpoint_dir

# History lengths, margin per win probability, uncertainty scales.
HISTORY_GAMES, REPLACEMENT_GAMES, REPLACEMENT_MINUTES = 82, 10, 10
MARGIN_PER_WIN = 30.0
TEAM_UNCERTAINTY_SCALE, SCENARIO_UNCERTAINTY_SCALE = 10.0, 5.0
CERTAIN_TO_PLAY = 0.99
SMALLEST_LINEUP = 4

Scorer = Callable[[DataFrame], DataFrame]


def latest_ratings(ratings: DataFrame, order: list[str]) -> DataFrame:
    """Newest rating row per player."""
    values = [c for c in ratings.columns if c != "player_id"]
    newest = F.max_by(F.struct(*values), F.struct(*order))
    return ratings.groupBy("player_id").agg(newest.alias("r")).select("player_id", "r.*")


# What a player without details or rating counts as.
DEFAULT_HEIGHT, DEFAULT_WEIGHT, DEFAULT_RATING = 78, 210, 0.0


def with_defaults(players: DataFrame, details: DataFrame, ratings: DataFrame) -> DataFrame:
    """``players`` (player_id) with height, weight and latest rating, each with its default."""
    return (
        players.join(details.select("player_id", "height_inches", "weight_lbs"), "player_id", "left")
        .join(ratings.select("player_id", "rapm"), "player_id", "left")
        .select(
            *[c for c in players.columns],
            F.coalesce("height_inches", F.lit(DEFAULT_HEIGHT)).alias("height_inches"),
            F.coalesce("weight_lbs", F.lit(DEFAULT_WEIGHT)).alias("weight_lbs"),
            F.coalesce("rapm", F.lit(DEFAULT_RATING)).alias("rapm"),
        )
    )


def history_modifiers(rows: DataFrame, recency: list[str]) -> DataFrame:
    """Play-history modifier per player from the newest 82 rows.

    The row-number bound is applied before the shuffle, so a player with very many
    rows sends at most that many per task.
    """
    newest = Window.partitionBy("player_id").orderBy(*[F.col(c).desc() for c in recency])
    recent = rows.withColumn("__n", F.row_number().over(newest)).filter(
        F.col("__n") <= HISTORY_GAMES
    )
    return recent.groupBy("player_id").agg(
        F.count(F.lit(1)).alias("games"),
        F.avg(F.coalesce("minutes", F.lit(0.0))).alias("mean_minutes"),
    ).select(
        "player_id", av.history_modifier(F.col("games"), F.col("mean_minutes")).alias("history")
    )


def play_probabilities(
    injuries: DataFrame, history: DataFrame, context: Column | None = None
) -> DataFrame:
    """Injury reports with prior and play_probability."""
    joined = injuries.join(history, "player_id", "left")
    return joined.withColumns(
        {
            "prior_probability": av.prior_probability(F.col("status")),
            "play_probability": av.play_probability(
                F.col("status"), F.col("description"), context,
                F.coalesce("history", F.lit(1.0)),
            ),
        }
    ).drop("history")


def team_expectations(injuries: DataFrame, ratings: DataFrame) -> DataFrame:
    """Expected win and points change and uncertainty per team.

    ``injuries`` has team_id, player_id and play_probability; ``ratings`` one row
    per player with rapm.
    """
    rated = injuries.join(ratings.select("player_id", "rapm"), "player_id", "left")
    sits = 1 - F.col("play_probability")
    impact = av.replacement_impact(F.col("rapm"))
    points = F.coalesce("rapm", F.lit(0.0)) * av.POINTS_PER_RATING
    return rated.groupBy("team_id").agg(
        F.sum(-sits * impact).alias("win_change"),
        F.sum(-sits * points).alias("total_change"),
        F.least(
            F.lit(1.0),
            F.sqrt(F.sum(F.col("play_probability") * sits * impact * impact)) * TEAM_UNCERTAINTY_SCALE,
        ).alias("uncertainty"),
    )


def adjust_predictions(predictions: DataFrame, teams: DataFrame) -> DataFrame:
    """Predictions adjusted by both teams' expectations; none injured, no change.

    ``predictions`` has home_team_id, away_team_id, home_win_prob,
    predicted_margin and predicted_total.
    """
    joined = predictions
    for side in ("home", "away"):
        joined = joined.join(
            teams.select(
                F.col("team_id").alias(f"{side}_team_id"),
                *[F.col(c).alias(f"__{side}_{c}") for c in ("win_change", "total_change", "uncertainty")],
            ),
            f"{side}_team_id", "left",
        )
    part = lambda side, c: F.coalesce(f"__{side}_{c}", F.lit(0.0))
    shift = part("home", "win_change") - part("away", "win_change")
    points = part("home", "total_change") + part("away", "total_change")
    reported = F.col("__home_uncertainty").isNotNull() | F.col("__away_uncertainty").isNotNull()
    adjusted = {
        "home_win_prob_adjusted": clamp(F.col("home_win_prob") + shift, WIN_BOUNDS),
        "predicted_margin_adjusted": clamp(F.col("predicted_margin") + shift * MARGIN_PER_WIN, MARGIN_BOUNDS),
        "predicted_total_adjusted": clamp(F.col("predicted_total") + points, TOTAL_BOUNDS),
    }
    raw = ["home_win_prob", "predicted_margin", "predicted_total"]
    return joined.select(
        *predictions.columns,
        *[F.when(reported, c).otherwise(F.col(r)).alias(n) for (n, c), r in zip(adjusted.items(), raw)],
        ((part("home", "uncertainty") + part("away", "uncertainty")) / 2.0).alias("injury_uncertainty"),
    )


def listed(members: DataFrame, players: DataFrame) -> DataFrame:
    """Lineup rows of ``members`` whose player is in ``players``, with that row's columns.

    Spark takes exploded rows for as small as the table they came from and would send them whole
    through the driver. The join hashes ``players``, a row per player, by player in the tasks.
    """
    return members.join(players.hint("shuffle_hash"), "player_id")


def best_replacements(
    wanted: DataFrame, player_games: DataFrame, recency: list[str], same_team: bool = True
) -> DataFrame:
    """Best bench player per (game, player) row of ``wanted`` with its ``lineup``.

    Candidates shared one of the player's last ten games, are not in the lineup and
    played more than ten minutes; the most minutes wins. ``same_team`` keeps
    opponents out.
    """
    newest = Window.partitionBy("player_id").orderBy(*[F.col(c).desc() for c in recency])
    starters = wanted.select("player_id").distinct()
    recent = (
        player_games.join(starters, "player_id", "left_semi")
        .withColumn("__n", F.row_number().over(newest))
        .filter(F.col("__n") <= REPLACEMENT_GAMES)
        .select("player_id", "game_id", F.col("team_id").alias("own_team"))
    )
    mates = player_games.select(
        "game_id", "team_id", "minutes", F.col("player_id").alias("replacement_id")
    ).filter(F.col("minutes") > REPLACEMENT_MINUTES)
    # hashed by game in the tasks, ten rows a starter at most; mates may be exploded rows (see ``listed``)
    met = mates.withColumnRenamed("game_id", "seen_in").join(
        recent.withColumnRenamed("game_id", "seen_in").hint("shuffle_hash"), "seen_in"
    )
    if same_team:
        met = met.filter("team_id = own_team")
    candidates = met.groupBy("player_id", "replacement_id").agg(F.max("minutes").alias("minutes"))
    options = wanted.join(candidates, "player_id").filter(
        ~F.array_contains("lineup", F.col("replacement_id"))
    )
    best = F.max_by("replacement_id", F.struct("minutes", -F.col("replacement_id")))
    return options.groupBy("game_id", "player_id").agg(best.alias("replacement_id"))


def linear_scorer(ratings: DataFrame) -> Scorer:
    """A scorer on lineup ratings: adds win, margin and total to scenario rows.

    Any callable from scenarios (scenario_id, home_lineup, away_lineup) to the same
    rows with win, margin and total can stand in its place.
    """

    def score(scenarios: DataFrame) -> DataFrame:
        members = scenarios.select(
            "scenario_id",
            F.explode(
                F.concat(
                    F.transform("home_lineup", lambda p: F.struct(p.alias("player_id"), F.lit(1).alias("sign"))),
                    F.transform("away_lineup", lambda p: F.struct(p.alias("player_id"), F.lit(-1).alias("sign"))),
                )
            ).alias("m"),
        ).select("scenario_id", "m.player_id", "m.sign")
        strength = (
            members.join(ratings.select("player_id", "rapm"), "player_id", "left")
            .groupBy("scenario_id")
            .agg(
                F.sum(F.coalesce("rapm", F.lit(0.0)) * F.col("sign")).alias("margin"),
                F.sum(F.coalesce("rapm", F.lit(0.0))).alias("strength"),
            )
        )
        return scenarios.join(strength, "scenario_id").select(
            *scenarios.columns,
            (0.5 + F.col("margin") * av.WIN_PER_RATING).alias("win"),
            "margin",
            (220.0 + F.col("strength") * av.POINTS_PER_RATING).alias("total"),
        )

    return score


def two_scenario_adjustment(
    games: DataFrame,
    injuries: DataFrame,
    player_games: DataFrame,
    recency: list[str],
    scorer: Scorer,
) -> DataFrame:
    """Expected values from scoring each uncertain player as sitting.

    ``games`` has game_id, home_lineup and away_lineup; ``injuries`` player_id,
    status and play_probability. All scenarios of all games are one table that the
    scorer sees once; effects of several players add up.
    """
    doubtful = injuries.filter(F.lower("status").isin(av.UNCERTAIN_STATUSES)).select(
        "player_id", "play_probability"
    )
    sides = F.explode(
        F.array(
            F.struct(F.lit("home").alias("side"), F.col("home_lineup").alias("lineup")),
            F.struct(F.lit("away").alias("side"), F.col("away_lineup").alias("lineup")),
        )
    ).alias("s")
    members = games.select("game_id", "home_lineup", "away_lineup", sides).select(
        "game_id", "home_lineup", "away_lineup", "s.side", "s.lineup",
        F.explode("s.lineup").alias("player_id"),
    )
    # both are read by several branches below, and are small beside their inputs
    ensure_checkpoint_dir(games.sparkSession)
    uncertain = listed(members, doubtful).filter(
        F.col("play_probability") < CERTAIN_TO_PLAY
    ).checkpoint()
    spare = best_replacements(
        uncertain.select("game_id", "player_id", "lineup"), player_games, recency
    )
    swapped = F.when(
        F.col("replacement_id").isNotNull(),
        F.transform(
            "lineup", lambda p: F.when(p == F.col("player_id"), F.col("replacement_id")).otherwise(p)
        ),
    ).otherwise(F.array_remove("lineup", F.col("player_id")))
    sits = (
        uncertain.join(spare, ["game_id", "player_id"], "left")
        .withColumn("swapped", swapped)
        .filter(F.size("swapped") >= SMALLEST_LINEUP)
        .select(
            "game_id",
            F.concat_ws("|", "game_id", "side", "player_id").alias("scenario_id"),
            F.when(F.col("side") == "home", F.col("swapped")).otherwise(F.col("home_lineup")).alias("home_lineup"),
            F.when(F.col("side") == "away", F.col("swapped")).otherwise(F.col("away_lineup")).alias("away_lineup"),
            F.col("play_probability").alias("p"),
        )
    )
    base = games.join(uncertain.select("game_id").distinct(), "game_id", "left_semi").select(
        "game_id", F.concat_ws("|", "game_id").alias("scenario_id"),
        "home_lineup", "away_lineup", F.lit(None).cast("double").alias("p"),
    )
    scored = scorer(base.unionByName(sits)).checkpoint()
    plays = scored.filter("p IS NULL").select(
        "game_id", *[F.col(c).alias(f"base_{c}") for c in ("win", "margin", "total")]
    )
    out = (1 - F.col("p"))
    change = scored.filter("p IS NOT NULL").join(plays, "game_id").groupBy("game_id").agg(
        *[F.sum(out * (F.col(c) - F.col(f"base_{c}"))).alias(f"{c}_change") for c in ("win", "margin", "total")],
        F.sum(F.col("p") * out * F.pow(F.col("win") - F.col("base_win"), 2)).alias("variance"),
    )
    joined = plays.join(change, "game_id", "left")
    moved = lambda c: F.col(f"base_{c}") + F.coalesce(f"{c}_change", F.lit(0.0))
    return joined.select(
        "game_id",
        clamp(moved("win"), WIN_BOUNDS).alias("home_win_prob_adjusted"),
        clamp(moved("margin"), MARGIN_BOUNDS).alias("predicted_margin_adjusted"),
        clamp(moved("total"), TOTAL_BOUNDS).alias("predicted_total_adjusted"),
        F.least(
            F.lit(1.0), F.sqrt(F.coalesce("variance", F.lit(0.0))) * SCENARIO_UNCERTAINTY_SCALE
        ).alias("injury_uncertainty"),
    )
