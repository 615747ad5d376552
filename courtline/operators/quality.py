"""Completeness, integrity and field checks over whole tables."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Expected sizes of a game and a season.
PLAYS_RANGE, TEAM_ROWS, PLAYER_ROWS, SEASON_GAMES, EXPECTED_SEASON = (100, 700), 2, 10, 1000, 1230
# Fields that must be present per entity.
REQUIRED_FIELDS = {
    "plays": ["game_id", "event_num"],
    "shots": ["game_id", "player_id"],
    "game_stats": ["game_id", "team_id"],
    "player_game_stats": ["game_id", "player_id"],
}
ZERO_ALLOWED = {"event_num"}


def _counts(children: Mapping[str, DataFrame]) -> DataFrame:
    """Row counts per game of several tables: one union, one aggregate."""
    tagged = [
        df.select("game_id", F.lit(name).alias("source")) for name, df in children.items()
    ]
    rows = reduce(DataFrame.unionByName, tagged)
    return rows.groupBy("game_id").agg(
        *[F.count_if(F.col("source") == name).alias(name) for name in children]
    )


def validate_games(
    games: DataFrame,
    plays: DataFrame,
    team_box: DataFrame,
    player_box: DataFrame,
    shots: DataFrame,
    plays_range: tuple[int, int] = PLAYS_RANGE,
    min_player_rows: int = PLAYER_ROWS,
) -> DataFrame:
    """Errors and warnings of every game, and of ids that only the children have."""
    counts = _counts({"plays": plays, "team_box": team_box, "player_box": player_box, "shots": shots})
    known = games.select("game_id", F.lit(True).alias("known"))
    both = known.join(counts, "game_id", "full").select(
        "game_id", F.coalesce("known", F.lit(False)).alias("known"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("plays", "team_box", "player_box", "shots")],
    )
    low, high = plays_range
    say = lambda test, label: F.when(F.col("known") & test, label)
    errors = F.array_compact(
        F.array(
            F.when(~F.col("known"), "game not found"),
            say(F.col("plays") == 0, "no play-by-play data"),
            say(F.col("team_box") < TEAM_ROWS, "missing team box scores"),
        )
    )
    warnings = F.array_compact(
        F.array(
            say((F.col("plays") > 0) & (F.col("plays") < low), "low play count"),
            say(F.col("plays") > high, "high play count"),
            say(F.col("player_box") < min_player_rows, "low player stats count"),
            say(F.col("shots") == 0, "no shot data"),
        )
    )
    return both.select(
        "game_id", (F.size(errors) == 0).alias("valid"), errors.alias("errors"), warnings.alias("warnings")
    )


def season_coverage(games: DataFrame, plays: DataFrame, team_box: DataFrame) -> DataFrame:
    """Games per season, and how many of them have plays and box scores."""
    marks = _counts({"plays": plays, "team_box": team_box})
    joined = games.select("season_id", "game_id").join(marks, "game_id", "left")
    return joined.groupBy("season_id").agg(
        F.count(F.lit(1)).alias("games"),
        F.count_if(F.col("plays") > 0).alias("games_with_plays"),
        F.count_if(F.col("team_box") > 0).alias("games_with_box_scores"),
    )


def validate_seasons(seasons: DataFrame, coverage: DataFrame, least: int = SEASON_GAMES) -> DataFrame:
    joined = seasons.select("season_id").join(coverage, "season_id", "left")
    n = F.coalesce("games", F.lit(0))
    short = lambda c, label: F.when(
        (n > 0) & (F.col(c) < n), F.format_string(f"%d games missing {label}", n - F.col(c))
    )
    return joined.select(
        "season_id",
        F.array_compact(F.array(F.when(n == 0, "no games"))).alias("errors"),
        F.array_compact(
            F.array(
                F.when((n > 0) & (n < least), F.format_string("only %d games", n)),
                short("games_with_plays", "play-by-play data"),
                short("games_with_box_scores", "box scores"),
            )
        ).alias("warnings"),
    )


def missing_fields(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per missing required field: entity, game_id, rule, severity."""
    found = []
    for entity, df in tables.items():
        rules = F.array(*[
            F.when(_absent(df, f), f"missing {f}") for f in REQUIRED_FIELDS[entity]
        ])
        found.append(
            df.select(
                F.lit(entity).alias("entity"),
                F.col("game_id").cast("string").alias("game_id"),
                F.explode(F.array_compact(rules)).alias("rule"),
                F.lit("error").alias("severity"),
            )
        )
    return reduce(DataFrame.unionByName, found)


def _absent(df: DataFrame, field: str) -> Column:
    empty = F.col(field).isNull()
    if field in ZERO_ALLOWED:
        return empty
    return empty | F.col(field).cast("string").isin("", "0")


def orphans(checks: Mapping[str, tuple[DataFrame, str, DataFrame, str]]) -> DataFrame:
    """Rows without a parent per named check (child, key, parent, key)."""
    parts = []
    for name, (child, key, parent, parent_key) in checks.items():
        keys = parent.select(F.col(parent_key).alias(key)).distinct()
        lost = child.select(key).join(keys, key, "left_anti")
        parts.append(lost.agg(F.count(F.lit(1)).alias("orphans")).select(F.lit(name).alias("check"), "orphans"))
    return reduce(DataFrame.unionByName, parts)


def stint_problems(stints: DataFrame) -> DataFrame:
    """Stints that run past the next one's start, or lack five players a side.

    A game has at most one stint start per second, so its window is short.
    """
    after = F.lead("start_sec").over(Window.partitionBy("game_id").orderBy("start_sec", "end_sec"))
    checked = stints.withColumn("next_start", after)
    problem = F.array_compact(
        F.array(
            F.when(F.col("end_sec") > F.col("next_start"), "overlaps next stint"),
            F.when(F.coalesce(F.size("home_lineup"), F.lit(0)) != 5, "home lineup is not five"),
            F.when(F.coalesce(F.size("away_lineup"), F.lit(0)) != 5, "away lineup is not five"),
        )
    )
    return checked.select("game_id", "start_sec", "end_sec", F.explode(problem).alias("problem"))


def table_statistics(tables: Mapping[str, DataFrame], dated: Mapping[str, str]) -> DataFrame:
    """Row count per table, and first and last day of the dated ones."""
    parts = []
    for name, df in tables.items():
        day = F.to_date(dated[name]) if name in dated else F.lit(None).cast("date")
        parts.append(
            df.agg(F.count(F.lit(1)).alias("rows"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))
            .select(F.lit(name).alias("table_name"), "rows", "first_day", "last_day")
        )
    return reduce(DataFrame.unionByName, parts)


#: Log of the sketch's slots: a standard error of 0.8 per cent.
SKETCH_SIZE = 14


def distinct_sketches(rows: DataFrame, keys: list[str], value: str, size: int = SKETCH_SIZE) -> DataFrame:
    """(keys, sketch): a fixed-size sketch of the distinct values of each key, to be stored per load."""
    return rows.groupBy(*keys).agg(F.hll_sketch_agg(value, F.lit(size)).alias("sketch"))


def merged_sketches(stored: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of several loads put together; values that several loads hold count once."""
    return stored.groupBy(*keys).agg(F.hll_union_agg("sketch").alias("sketch"))


def distinct_estimates(sketches: DataFrame, keys: list[str]) -> DataFrame:
    return sketches.select(*keys, F.hll_sketch_estimate("sketch").alias("estimate"))
