"""Play-by-play: descriptions, shot clock, token sequences, player references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtline.functions import clock, misc, text
from courtline.operators.ordered import interval_join, running

# Event codes and shot-clock bounds in seconds.
MADE, MISSED, FREE_THROW, REBOUND, TURNOVER, SUBSTITUTION = 1, 2, 3, 4, 5, 8
EARLY_BELOW, MID_UP_TO = 8, 16
SEQUENCE_LENGTH = 50
STINT_BUCKET_SECONDS = 60


def parse_descriptions(plays: DataFrame) -> DataFrame:
    """Add the combined description and its turnover and shot classes."""
    whole = text.combined_description(
        F.col("home_description"), F.col("away_description"), F.col("neutral_description")
    )
    read = plays.withColumn("combined_description", whole)
    d = F.col("combined_description")
    return read.select(
        *read.columns,
        text.turnover_context(d).alias("turnover"),
        text.shot_context(d).alias("shot"),
    )


def shot_clock(plays: DataFrame, levels: list[str]) -> DataFrame:
    """Add shot_clock_category: time since the possession began, for shots.

    A possession begins at the last free throw, rebound, turnover or made shot of
    the same game and period that has a readable clock.
    """
    seconds = clock.clock_seconds(F.col("pc_time"))
    starts = F.when(
        F.col("event_type").isin(MADE, FREE_THROW, REBOUND, TURNOVER) & F.col("__t").isNotNull(),
        F.col("__t"),
    )
    held = running(
        plays.withColumn("__t", seconds),
        ["game_id", "period"], levels, ["event_num"], lasts={"__start": starts}, inclusive=False,
    )
    used = F.greatest(F.lit(0), F.col("__start") - F.col("__t"))
    judged = (
        F.col("event_type").isin(MADE, MISSED)
        & F.col("__t").isNotNull()
        & F.col("__start").isNotNull()
    )
    label = (
        F.when(~judged, "unknown")
        .when(used < EARLY_BELOW, "early")
        .when(used <= MID_UP_TO, "mid")
        .otherwise("late")
    )
    return held.withColumn("shot_clock_category", label).drop("__t", "__start")


def even_sample(
    plays: DataFrame, levels: list[str], length: int = SEQUENCE_LENGTH
) -> DataFrame:
    """Keep ``length`` evenly spaced plays of each longer game, with their index.

    Row r is kept if some i < length has int(i * (n-1) / (length-1)) = r; that i can
    only be next to r / step, so it is a test on the row and not a join.
    """
    placed = running(plays, ["game_id"], levels, ["event_num"], rank="seq")
    sizes = plays.groupBy("game_id").agg(F.count(F.lit(1)).alias("n"))
    r = F.col("seq") - 1
    step = (F.col("n") - 1) / F.lit(float(length - 1))
    near = F.floor(r / step)

    def lands(i: Column) -> Column:
        point = F.when(i == length - 1, F.col("n") - 1).otherwise(F.floor(i * step))
        return (i >= 0) & (i < length) & (point == r)

    kept = (F.col("n") <= length) | lands(near - 1) | lands(near) | lands(near + 1)
    return placed.join(sizes, "game_id").filter(kept).drop("n")


def lineups_at_plays(plays: DataFrame, stints: DataFrame) -> DataFrame:
    """Add home_five and away_five: the lineups of the first stint whose clock span
    holds the play; five zeros where no stint does.

    ``stints`` has game_id, period, stint_no, start_clock and end_clock (seconds
    left, counting down) and the two lineups.
    """
    met = interval_join(
        plays.withColumn("__left", clock.clock_or_full(F.col("pc_time"))),
        stints, ["game_id", "period"], "__left", "end_clock", "start_clock",
        STINT_BUCKET_SECONDS, ["stint_no"],
        ["home_lineup", "away_lineup"],
    )

    def five(name: str) -> Column:
        found = F.coalesce(F.col(f"matched.{name}"), F.array().cast("array<bigint>"))
        padded = F.concat(found, F.array_repeat(F.lit(0).cast("bigint"), 5))
        return F.slice(padded, 1, 5)

    return met.withColumns(
        {"home_five": five("home_lineup"), "away_five": five("away_lineup")}
    ).drop("matched", "__left")


def token_sequences(
    plays: DataFrame, stints: DataFrame, levels: list[str], length: int = SEQUENCE_LENGTH
) -> DataFrame:
    """One training row per game: token, time, score, lineup and mask arrays.

    Plays are thinned to ``length`` before they are collected, so no array is
    longer than that. A missing score takes the last known one, then 0.
    """
    scored = running(
        plays, ["game_id"], levels, ["event_num"],
        lasts={"__home": F.col("score_home"), "__away": F.col("score_away")},
    )
    thin = lineups_at_plays(even_sample(scored, levels, length), stints)
    item = F.struct(
        "event_num",
        misc.event_token(F.col("event_type")).alias("event"),
        clock.time_remaining(F.col("period"), F.col("pc_time")).alias("time"),
        clock.score_difference(F.col("__home"), F.col("__away")).alias("score"),
        F.concat("home_five", "away_five").alias("players"),
    )
    games = thin.groupBy("game_id").agg(F.array_sort(F.collect_list(item)).alias("s"))
    pad = F.lit(length) - F.size("s")

    def padded(field: str, filler: Column) -> Column:
        return F.concat(F.transform("s", lambda x: x[field]), F.array_repeat(filler, pad)).alias(field)

    return games.select(
        "game_id",
        padded("event", F.lit(0)),
        padded("time", F.lit(0.0)),
        padded("score", F.lit(0.0)),
        padded("players", F.array_repeat(F.lit(0).cast("bigint"), 10)),
        F.concat(
            F.array_repeat(F.lit(False), F.size("s")), F.array_repeat(F.lit(True), pad)
        ).alias("mask"),
    )


def resolve_references(plays: DataFrame, players: DataFrame) -> DataFrame:
    """Fill player1..3 from the first description that names a known player.

    Applies to plays without player1. ``players`` has name and player_id; an
    exact spelling wins over one that differs in case.
    """
    named = plays.filter(F.col("player1_id").isNull()).select(
        "game_id", "event_num",
        F.posexplode(F.array("home_description", "away_description", "neutral_description")).alias("source", "body"),
    )
    mentions = named.select(
        "game_id", "event_num", "source",
        F.posexplode(text.player_references(F.col("body"))).alias("place", "name"),
    ).withColumn("folded", F.lower("name"))
    known = players.select(
        F.lower("name").alias("folded"), F.col("name").alias("spelling"), F.col("player_id").alias("hit")
    )
    preference = F.struct((F.col("spelling") != F.col("name")).alias("differs"), "hit")
    resolved = (
        mentions.join(known, "folded")
        .groupBy("game_id", "event_num", "source", "place")
        .agg(F.min_by("hit", preference).alias("hit"))
        .groupBy("game_id", "event_num")
        .agg(F.array_sort(F.collect_list(F.struct("source", "place", "hit"))).alias("hits"))
    )
    ids = F.transform(
        F.filter("hits", lambda h: h["source"] == F.col("hits")[0]["source"]), lambda h: h["hit"]
    )
    found = resolved.select("game_id", "event_num", ids.alias("ids"))
    joined = plays.join(found, ["game_id", "event_num"], "left")
    fill = {
        f"player{i}_id": F.coalesce(f"player{i}_id", F.try_element_at("ids", F.lit(i)))
        for i in (1, 2, 3)
    }
    return joined.withColumns(fill).drop("ids")
