"""Schedule fatigue per team and day.

A team plays at most one game a day, so rows are first reduced to one per
(team, day). That bounds every window partition by the length of the calendar,
however many raw rows a team has, and all windows share one shuffle on team.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtline.functions.misc import haversine_miles

# Rest of a team with no earlier game, and look-back lengths.
OPENER_REST = 7
TRAVEL_DAYS = 7
LOAD_GAMES = 5
CONTEXT_REST_DEFAULT, CONTEXT_REST_CAP = 3.0, 7.0


def team_rows(games: DataFrame) -> DataFrame:
    """Two rows per game: the home and the away view."""
    side = F.explode(
        F.array(
            F.struct(
                F.col("home_team_id").alias("team_id"),
                F.col("away_team_id").alias("opponent_id"),
                F.lit(True).alias("is_home"),
            ),
            F.struct(
                F.col("away_team_id").alias("team_id"),
                F.col("home_team_id").alias("opponent_id"),
                F.lit(False).alias("is_home"),
            ),
        )
    ).alias("side")
    keep = [c for c in games.columns if c != "away_team_id"]
    return games.select(*keep, side).select(*keep, "side.*")


def team_days(games: DataFrame, by: tuple[str, ...] = ("team_id",)) -> DataFrame:
    """One row per (team, day): the venue of that day's game, lowest game id first."""
    extra = [c for c in by if c != "team_id"]
    rows = team_rows(games.select("game_id", "game_date", "home_team_id", "away_team_id", *extra))
    first = F.min(F.struct("game_id", "is_home", F.col("home_team_id").alias("venue_team")))
    return rows.groupBy(*by, "game_date").agg(first.alias("g")).select(
        *by, "game_date", "g.is_home", "g.venue_team"
    )


def schedule_flags(
    days: DataFrame,
    lat: Column,
    lon: Column,
    travel_days: int = TRAVEL_DAYS,
    by: tuple[str, ...] = ("team_id",),
) -> DataFrame:
    """Rest, density, streak and travel columns for every (team, day).

    ``lat`` and ``lon`` locate ``venue_team``; null where the venue is unknown.
    ``by`` may add a season, so that look-backs stay inside it.
    """
    by_team = _by_day(by)

    def games_in(nights: int) -> Column:
        return F.count(F.lit(1)).over(by_team.rangeBetween(-(nights - 1), 0))

    stepped = _numbered(days).withColumns({"lat": lat, "lon": lon}).withColumns(
        {
            "previous_day": F.lag("day_no").over(by_team),
            "turn": F.coalesce(
                (F.lag("is_home").over(by_team) != F.col("is_home")).cast("int"), F.lit(1)
            ),
            "games_in_4": games_in(4),
            "games_in_5": games_in(5),
        }
    )
    walked = _with_miles(stepped, by_team, travel_days).withColumn(
        "streak_no", F.sum("turn").over(by_team.rowsBetween(Window.unboundedPreceding, 0))
    )
    streak = F.row_number().over(Window.partitionBy(*by, "streak_no").orderBy("day_no"))
    gap = F.col("day_no") - F.col("previous_day") - 1
    rest = F.when(gap.isNull(), OPENER_REST).when(gap < 0, 0).otherwise(gap)
    return (
        walked.withColumns({"rest_days": rest, "streak": streak})
        .select(
            *by,
            "game_date",
            F.col("rest_days"),
            (F.col("rest_days") == 0).alias("back_to_back"),
            (F.col("games_in_4") >= 3).alias("three_in_four"),
            (F.col("games_in_5") >= 4).alias("four_in_five"),
            F.round("miles", 1).alias("travel_miles"),
            F.when(F.col("is_home"), F.col("streak")).otherwise(0).alias("home_stand"),
            F.when(F.col("is_home"), 0).otherwise(F.col("streak")).alias("road_trip"),
            F.col("previous_day"),
            F.col("day_no"),
        )
    )


def _by_day(by: tuple[str, ...]):
    return Window.partitionBy(*by).orderBy("day_no")


def _numbered(days: DataFrame) -> DataFrame:
    return days.withColumn("day_no", F.unix_date("game_date"))


def _with_miles(numbered: DataFrame, by_team, travel_days: int) -> DataFrame:
    """Add ``miles``: legs between known venues that began within the last ``travel_days``."""
    known_before = by_team.rowsBetween(Window.unboundedPreceding, -1)
    place = F.when(F.col("lat").isNotNull(), F.struct("day_no", "lat", "lon"))
    came = numbered.withColumn("came_from", F.last(place, ignorenulls=True).over(known_before))
    leg = F.when(
        F.col("lat").isNotNull() & F.col("came_from").isNotNull(),
        F.struct(
            F.col("came_from.day_no").alias("left_on"),
            haversine_miles(
                F.col("came_from.lat"), F.col("came_from.lon"), F.col("lat"), F.col("lon")
            ).alias("miles"),
        ),
    )
    recent = by_team.rangeBetween(-(travel_days - 1), 0)
    legs = came.withColumn("leg", leg).withColumn("legs", F.collect_list("leg").over(recent))
    in_reach = F.filter(
        F.col("legs"), lambda x: x["left_on"] > F.col("day_no") - F.lit(travel_days)
    )
    return legs.withColumn("miles", F.aggregate(in_reach, F.lit(0.0), lambda acc, x: acc + x["miles"]))


def day_gaps(days: DataFrame) -> DataFrame:
    """Day number and previous day of every (team, day): what ``context_rest`` asks for, and no more."""
    return _numbered(days).select(
        "team_id", "game_date", "day_no", F.lag("day_no").over(_by_day(("team_id",))).alias("previous_day")
    )


def travel(days: DataFrame, lat: Column, lon: Column, travel_days: int = TRAVEL_DAYS, by: tuple[str, ...] = ("team_id",)) -> DataFrame:
    """The travel miles of ``schedule_flags`` alone."""
    placed = _numbered(days).withColumns({"lat": lat, "lon": lon})
    return _with_miles(placed, _by_day(by), travel_days).select(*by, "game_date", F.round("miles", 1).alias("travel_miles"))


def context_rest(flags: DataFrame) -> DataFrame:
    """Raw day gap to the previous game, capped, with its own back-to-back rule."""
    gap = F.least(
        F.lit(CONTEXT_REST_CAP), (F.col("day_no") - F.col("previous_day")).cast("double")
    )
    gap = F.coalesce(gap, F.lit(CONTEXT_REST_DEFAULT))
    return flags.select(
        "team_id", "game_date", gap.alias("gap_days"), (gap <= 1).alias("played_yesterday"),
        *(c for c in ("travel_miles",) if c in flags.columns),
    )


def player_load(rows: DataFrame, games: int = LOAD_GAMES) -> DataFrame:
    """Load of the previous games for every (player, day).

    ``rows`` has player_id, game_date, minutes and distance_miles; it is reduced to
    one row per (player, day) first. The trend is the slope against recency, so a
    player whose minutes grow has a negative trend.
    """
    days = rows.groupBy("player_id", "game_date").agg(
        F.sum(F.coalesce("minutes", F.lit(0.0))).alias("minutes"),
        F.sum(F.coalesce("distance_miles", F.lit(0.0))).alias("distance_miles"),
    )
    ordered = Window.partitionBy("player_id").orderBy("game_date")
    before = ordered.rowsBetween(-games, -1)
    return (
        days.withColumn("n", F.row_number().over(ordered).cast("double"))
        .withColumns(
            {
                "avg_minutes": F.avg("minutes").over(before),
                "total_distance_miles": F.sum("distance_miles").over(before),
                "slope": F.regr_slope("minutes", "n").over(before),
            }
        )
        .select(
            "player_id",
            "game_date",
            F.round(F.coalesce("avg_minutes", F.lit(0.0)), 1).alias("avg_minutes"),
            F.round(F.coalesce("total_distance_miles", F.lit(0.0)), 1).alias(
                "total_distance_miles"
            ),
            F.round(-F.coalesce("slope", F.lit(0.0)), 2).alias("minutes_trend"),
        )
    )
