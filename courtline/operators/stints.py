"""Lineup stints from play-by-play, as set operations over all games at once.

Substitutions of one game second form a boundary, so a game has at most as many
boundaries as seconds; windows per game run on those, never on raw plays. Points
and possessions of a stint come from running sums over the plays, read at its
two end events, so no stint meets its plays in a range join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from courtline.functions import clock
from courtline.operators.ordered import running
from courtline.operators.plays import (
    FREE_THROW, MADE, MISSED, REBOUND, SUBSTITUTION, TURNOVER,
)
from courtline.session import ensure_checkpoint_dir

# Lineup size, free-throw weight, opening clock.
FIVE = 5
FREE_THROW_WEIGHT = 0.44
OPENING_CLOCK = "12:00"


def _sided(plays: DataFrame) -> DataFrame:
    side = F.when(F.col("team_id") == F.col("home_team_id"), "home").when(
        F.col("team_id") == F.col("away_team_id"), "away"
    )
    return plays.withColumn("side", side).filter(F.col("side").isNotNull())


def starting_five(plays: DataFrame) -> DataFrame:
    """First five players of each side seen in period 1: game_id, side, player_id."""
    seen = (
        _sided(plays)
        .filter((F.col("period") == 1) & (F.coalesce("player1_id", F.lit(0)) != 0))
        .groupBy("game_id", "side", F.col("player1_id").alias("player_id"))
        .agg(F.min("event_num").alias("first_event"))
    )
    place = F.row_number().over(Window.partitionBy("game_id", "side").orderBy("first_event"))
    return seen.withColumn("place", place).filter(F.col("place") <= FIVE).drop("place")


def infer_teams(plays: DataFrame) -> DataFrame:
    """Home and away id where the schedule is missing: lowest two team ids."""
    teams = plays.filter(F.coalesce("team_id", F.lit(0)) != 0).groupBy("game_id").agg(
        F.min("team_id").alias("home_team_id"), F.max("team_id").alias("away_team_id")
    )
    return teams.filter("home_team_id < away_team_id")


def substitutions(plays: DataFrame) -> DataFrame:
    moved = (
        (F.col("event_type") == SUBSTITUTION)
        & (F.coalesce("player1_id", F.lit(0)) != 0)
        & (F.coalesce("player2_id", F.lit(0)) != 0)
        & (F.coalesce("team_id", F.lit(0)) != 0)
    )
    time = F.coalesce("pc_time", F.lit("0:00"))
    return plays.filter(moved).select(
        "game_id", "event_num", "period", "team_id", "home_team_id", "away_team_id",
        time.alias("pc_time"),
        clock.elapsed_seconds(F.col("period"), time).alias("sec"),
        F.col("player1_id").alias("player_in"),
        F.col("player2_id").alias("player_out"),
    )


def stint_spans(plays: DataFrame) -> DataFrame:
    """Candidate stints by number: start and end second, event, period and clock."""
    time = F.coalesce("pc_time", F.lit("0:00"))
    ends = plays.groupBy("game_id").agg(
        F.min("event_num").alias("first_event"),
        F.max(F.struct("event_num", "period", time.alias("pc_time"))).alias("last"),
    )
    cuts = (
        substitutions(plays)
        .groupBy("game_id", "sec")
        .agg(F.min(F.struct("event_num", "period", "pc_time")).alias("cut"))
        .select("game_id", "sec", "cut.*")
    )
    opening = ends.select(
        "game_id", F.lit(-1).alias("sec"), F.col("first_event").alias("event_num"),
        F.lit(1).alias("period"), F.lit(OPENING_CLOCK).alias("pc_time"),
    )
    by_game = Window.partitionBy("game_id").orderBy("sec")
    spans = cuts.unionByName(opening).withColumns(
        {
            "stint_no": F.row_number().over(by_game) - 1,
            "next": F.lead(F.struct("sec", "event_num", "period", "pc_time")).over(by_game),
        }
    )
    close = F.struct(
        clock.elapsed_seconds(F.col("last.period"), F.col("last.pc_time")).alias("sec"),
        F.col("last.event_num").alias("event_num"),
        F.col("last.period").alias("period"),
        F.col("last.pc_time").alias("pc_time"),
    )
    stop = F.coalesce("next", close)
    return spans.join(ends, "game_id").select(
        "game_id", "stint_no", "period",
        F.col("sec").alias("cut_sec"),
        F.greatest(F.col("sec"), F.lit(0)).alias("start_sec"),
        stop["sec"].alias("end_sec"),
        F.col("event_num").alias("start_event"),
        stop["event_num"].alias("end_event"),
        F.col("pc_time").alias("start_time"),
        stop["pc_time"].alias("end_time"),
    )


def stint_lineups(plays: DataFrame, spans: DataFrame) -> DataFrame:
    """Sorted lineup per (game_id, side, stint_no).

    A player is on court in a stint when the latest edit at or before its start is
    an entry. Each run of stints between two edits is one explode of its numbers.
    """
    subs = _sided(substitutions(plays))
    edit = F.explode(
        F.array(
            F.struct(F.col("player_out").alias("player_id"), F.lit(0).alias("is_in")),
            F.struct(F.col("player_in").alias("player_id"), F.lit(1).alias("is_in")),
        )
    ).alias("e")
    edits = (
        subs.select("game_id", "side", "sec", "event_num", edit)
        .groupBy("game_id", "side", "e.player_id", "sec")
        .agg(F.max(F.struct("event_num", "e.is_in")).alias("last"))
        .select("game_id", "side", "player_id", "sec", F.col("last.is_in").alias("is_in"))
    )
    starters = starting_five(plays).select(
        "game_id", "side", "player_id", F.lit(-1).alias("sec"), F.lit(1).alias("is_in")
    )
    numbers = spans.select("game_id", F.col("cut_sec").alias("sec"), "stint_no")
    count = spans.groupBy("game_id").agg((F.max("stint_no") + 1).alias("stints"))
    by_player = Window.partitionBy("game_id", "side", "player_id").orderBy("stint_no")
    runs = (
        edits.unionByName(starters)
        .join(numbers, ["game_id", "sec"])
        .withColumn("until", F.lead("stint_no").over(by_player))
        .filter("is_in = 1")
        .join(count, "game_id")
    )
    last = F.coalesce("until", F.col("stints")) - 1
    return (
        runs.select("game_id", "side", "player_id", F.explode(F.sequence("stint_no", last)).alias("stint_no"))
        .groupBy("game_id", "side", "stint_no")
        .agg(F.sort_array(F.collect_list("player_id")).alias("lineup"))
    )


def play_outcomes(plays: DataFrame) -> DataFrame:
    """Points and possession parts of every play."""
    body = F.upper(
        F.concat(F.coalesce("home_description", F.lit("")), F.coalesce("away_description", F.lit("")))
    )
    points = (
        F.when(F.col("event_type") == MADE, F.when(body.contains("3PT"), 3).otherwise(2))
        .when((F.col("event_type") == FREE_THROW) & ~body.contains("MISS"), 1)
        .otherwise(0)
    )
    at_home = F.coalesce(F.col("home_description") != "", F.lit(False))
    code = F.col("event_type")
    return plays.withColumns(
        {
            "home_scored": F.when(at_home, points).otherwise(0),
            "away_scored": F.when(at_home, 0).otherwise(points),
            "shots_taken": code.isin(MADE, MISSED).cast("int"),
            "free_throws": (code == FREE_THROW).cast("int"),
            "turnovers": (code == TURNOVER).cast("int"),
            "kept_rebounds": ((code == REBOUND) & body.contains("OFF")).cast("int"),
        }
    )


PARTS = ["home_scored", "away_scored", "shots_taken", "free_throws", "turnovers", "kept_rebounds"]


def stint_outcomes(
    plays: DataFrame, spans: DataFrame, levels: list[str], half_open: bool = False
) -> DataFrame:
    """Points and possessions between the end events of each span.

    Both end events count, so a boundary play counts in the stints on both sides of
    it; ``half_open`` leaves the opening play out except in the first stint.
    """
    scored = play_outcomes(plays)
    summed = running(
        scored, ["game_id"], levels, ["event_num"],
        sums={f"to_{p}": F.col(p) for p in PARTS},
    ).select("game_id", "event_num", *PARTS, *[f"to_{p}" for p in PARTS])
    # both end events of a span meet the sums in one join and fold back to one row
    ends = spans.select(
        *spans.columns,
        F.explode(
            F.array(
                F.struct(F.lit("start").alias("kind"), F.col("start_event").alias("event_num")),
                F.struct(F.lit("end").alias("kind"), F.col("end_event").alias("event_num")),
            )
        ).alias("end_point"),
    ).select(*spans.columns, "end_point.*")
    met = ends.join(summed, ["game_id", "event_num"]).groupBy(*spans.columns)
    at = lambda kind, c: F.max(F.when(F.col("kind") == kind, c))
    joined = met.agg(
        *[at("end", F.col(f"to_{p}")).alias(f"hi_{p}") for p in PARTS],
        *[at("start", F.col(f"to_{p}")).alias(f"to_{p}") for p in PARTS],
        *[at("start", F.col(p)).alias(p) for p in PARTS],
    )

    def within(p: str):
        low = F.col(f"to_{p}") - F.when(F.lit(not half_open) | (F.col("stint_no") == 0), F.col(p)).otherwise(0)
        ordered = F.col("end_event") >= F.col("start_event")
        return F.when(ordered, F.col(f"hi_{p}") - low).otherwise(0)

    possessions = F.greatest(
        F.lit(0.0),
        within("shots_taken") + FREE_THROW_WEIGHT * within("free_throws")
        + within("turnovers") - within("kept_rebounds"),
    )
    return joined.select(
        *spans.columns,
        within("home_scored").cast("bigint").alias("home_points"),
        within("away_scored").cast("bigint").alias("away_points"),
        possessions.alias("possessions"),
    )


def derive_stints(plays: DataFrame, levels: list[str], half_open: bool = False) -> DataFrame:
    """Stints of every game with five players a side and a positive length.

    The spans are a small table read several times, so they are checkpointed. A
    game counts only if its opening stint is complete on both sides.
    """
    ensure_checkpoint_dir(plays.sparkSession)
    spans = stint_spans(plays).checkpoint()
    sides = stint_lineups(plays, spans).groupBy("game_id", "stint_no").agg(
        *[F.max(F.when(F.col("side") == s, F.col("lineup"))).alias(f"{s}_lineup") for s in ("home", "away")]
    )
    five = (F.size("home_lineup") == FIVE) & (F.size("away_lineup") == FIVE)
    opened = F.bool_or(five & (F.col("stint_no") == 0)).over(Window.partitionBy("game_id"))
    complete = sides.withColumns({"five": five, "opened": opened}).filter("five AND opened")
    valid = spans.filter("start_sec < end_sec").join(
        complete.drop("five", "opened"), ["game_id", "stint_no"]
    )
    return stint_outcomes(plays, valid, levels, half_open).select(
        "game_id", "stint_no", "period", "start_sec", "end_sec", "start_time", "end_time",
        (F.col("end_sec") - F.col("start_sec")).alias("duration_seconds"),
        "home_lineup", "away_lineup", "home_points", "away_points", "possessions",
        clock.clock_or_full(F.col("start_time")).alias("start_clock"),
        clock.clock_or_full(F.col("end_time")).alias("end_clock"),
    )
