"""Landed payloads to typed tables.

Payload rows come as text, so every cast here is a ``try`` cast and an
unreadable value becomes null.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from courtline.functions import availability, clock

RESULT_SETS = (
    "resultSets array<struct<name:string,headers:array<string>,rowSet:array<array<string>>>>"
)
INJURY_FEED = (
    "league struct<teams:array<struct<teamTricode:string,players:array<struct<personId:bigint,"
    "firstName:string,lastName:string,injuryStatus:string,comment:string,reportDate:string>>>>>"
)
# The result set of each payload kind.
SET_NAMES = {
    "games": "LeagueGameFinderResults",
    "plays": "PlayByPlay",
    "shots": "Shot_Chart_Detail",
    "team_box": "TeamStats",
    "player_box": "PlayerStats",
    "roster": "CommonTeamRoster",
    "player_info": "CommonPlayerInfo",
}
POLICIES = {"raise": "FAILFAST", "skip": "DROPMALFORMED", "log": "PERMISSIVE"}


def result_set(payloads: DataFrame, text: str, set_name: str) -> DataFrame:
    """Rows of one named result set: the other columns plus map ``row`` header -> text."""
    others = [c for c in payloads.columns if c != text]
    parsed = payloads.select(*others, F.explode(F.from_json(text, RESULT_SETS)["resultSets"]).alias("rs"))
    return (
        parsed.filter(F.col("rs.name") == set_name)
        .select(*others, F.col("rs.headers").alias("h"), F.explode("rs.rowSet").alias("v"))
        .select(*others, F.map_from_arrays("h", "v").alias("row"))
    )


def read_result_set(spark: SparkSession, path: str, set_name: str) -> DataFrame:
    """One payload per file; every file is one task's small document."""
    return result_set(spark.read.text(path, wholetext=True), "value", set_name)


def read_landed(
    spark: SparkSession, path: str, schema: str, policy: str = "log"
) -> tuple[DataFrame, DataFrame | None]:
    """JSON-lines rows under an error policy, and the quarantined lines for "log"."""
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy!r}; have {sorted(POLICIES)}")
    if policy != "log":
        return spark.read.option("mode", POLICIES[policy]).schema(schema).json(path), None
    options = {"mode": POLICIES[policy], "columnNameOfCorruptRecord": "_corrupt_record"}
    parsed = spark.read.text(path).select(
        "value", F.from_json("value", schema + ", _corrupt_record string", options).alias("r")
    )
    broken = F.col("r._corrupt_record").isNotNull()
    return (
        parsed.filter(~broken).select("r.*").drop("_corrupt_record"),
        parsed.filter(broken).select(F.col("value").alias("line")),
    )


def collect_landed(spark: SparkSession, source: str, schema: str, target: str, policy: str = "log") -> dict[str, int]:
    """Store the good JSON lines of ``source`` under ``target`` and count in the same pass.

    Rows go to ``target/outcome=kept``; with "log" the broken lines go to
    ``target/outcome=quarantine``, with "skip" they are dropped, with "raise" they end the write.
    Returns lines, kept and dropped as the write observed them; nothing is read twice.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy!r}; have {sorted(POLICIES)}")
    options = {"mode": "FAILFAST" if policy == "raise" else "PERMISSIVE"}
    if policy != "raise":
        options["columnNameOfCorruptRecord"] = "_corrupt_record"
        schema += ", _corrupt_record string"
    parsed = spark.read.text(source).select("value", F.from_json("value", schema, options).alias("r"))
    broken = F.col("r._corrupt_record").isNotNull() if policy != "raise" else F.lit(False)
    seen = Observation()
    rows = parsed.withColumn("broken", broken).observe(seen, F.count(F.lit(1)).alias("lines"), F.count_if("broken").alias("dropped"))
    if policy == "skip":
        rows = rows.filter(~F.col("broken"))
    good = F.col("r") if policy == "raise" else F.col("r").dropFields("_corrupt_record")
    rows.select(
        good.alias("r"), F.when(F.col("broken"), F.col("value")).alias("line"),
        F.when(F.col("broken"), "quarantine").otherwise("kept").alias("outcome"),
    ).write.partitionBy("outcome").parquet(target)
    got = seen.get
    return {"lines": got["lines"], "kept": got["lines"] - got["dropped"], "dropped": got["dropped"]}


def _cell(name: str) -> Column:
    return F.col("row")[name]


def _int(name: str) -> Column:
    return _cell(name).try_cast("double").try_cast("int")


def _text(name: str) -> Column:
    return clock.blank_to_null(_cell(name))


def games(rows: DataFrame, season: Column | None = None) -> DataFrame:
    """Two team rows per game to one game row.

    The " vs. " row is home and the " @ " row away; if either is missing the higher
    plus-minus is home. Games with fewer than two rows drop out.
    """
    team = F.struct(
        _cell("PLUS_MINUS").try_cast("double").alias("plus_minus"),
        _cell("TEAM_ID").try_cast("bigint").alias("team_id"),
        _int("PTS").alias("points"),
        _cell("WL").alias("wl"),
        F.substring(_cell("GAME_DATE"), 1, 10).try_cast("date").alias("day"),
    )
    matchup = _cell("MATCHUP")
    sides = rows.groupBy(_cell("GAME_ID").alias("game_id")).agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.when(matchup.contains(" vs. "), team)).alias("vs"),
        F.max(F.when(matchup.contains(" @ ") & ~matchup.contains(" vs. "), team)).alias("at"),
        F.max(team).alias("high"),
        F.min(team).alias("low"),
    ).filter("n >= 2")
    named = F.col("vs").isNotNull() & F.col("at").isNotNull()
    picked = sides.withColumns(
        {
            "home": F.when(named, F.col("vs")).otherwise(F.col("high")),
            "away": F.when(named, F.col("at")).otherwise(F.col("low")),
        }
    )
    day = F.col("home.day")
    return picked.select(
        "game_id",
        (season if season is not None else clock.season_label(day)).alias("season_id"),
        day.alias("game_date"),
        F.col("home.team_id").alias("home_team_id"),
        F.col("away.team_id").alias("away_team_id"),
        F.col("home.points").alias("home_score"),
        F.col("away.points").alias("away_score"),
        F.when(F.col("home.wl").isin("W", "L"), "completed").otherwise("scheduled").alias("status"),
        F.lit(None).cast("int").alias("attendance"),
    )


def in_date_range(table: DataFrame, start: Column, end: Column) -> DataFrame:
    """Rows of the seasons the range touches, then of the range itself.

    The season filter prunes partitions; the labels sort as the seasons do.
    """
    return table.filter(
        F.col("season_id").between(clock.season_label(start), clock.season_label(end))
        & F.col("game_date").between(start, end)
    )


def plays(rows: DataFrame) -> DataFrame:
    score = clock.score_pair(_cell("SCORE"))
    return rows.select(
        _cell("GAME_ID").alias("game_id"),
        F.coalesce(_int("EVENTNUM"), F.lit(0)).alias("event_num"),
        F.coalesce(_int("PERIOD"), F.lit(1)).alias("period"),
        F.trim(_text("PCTIMESTRING")).alias("pc_time"),
        _text("WCTIMESTRING").alias("wc_time"),
        F.coalesce(_int("EVENTMSGTYPE"), F.lit(0)).alias("event_type"),
        F.nullif(_int("EVENTMSGACTIONTYPE"), F.lit(0)).alias("event_action"),
        _text("HOMEDESCRIPTION").alias("home_description"),
        _text("VISITORDESCRIPTION").alias("away_description"),
        _text("NEUTRALDESCRIPTION").alias("neutral_description"),
        score["home"].alias("score_home"),
        score["away"].alias("score_away"),
        *[clock.positive_or_null(_cell(f"PLAYER{i}_ID")).alias(f"player{i}_id") for i in (1, 2, 3)],
        clock.positive_or_null(_cell("PLAYER1_TEAM_ID")).alias("team_id"),
    )


def shots(rows: DataFrame) -> DataFrame:
    """Shots with game, player and team; type reduced to 2PT or 3PT where it says so."""
    kind = _text("SHOT_TYPE")
    shot_type = (
        F.when(F.upper(kind).contains("3PT"), "3PT")
        .when(F.upper(kind).contains("2PT") | kind.contains("Field Goal"), "2PT")
        .otherwise(kind)
    )
    whole = lambda name: F.coalesce(_int(name), F.lit(0))
    out = rows.select(
        _text("GAME_ID").alias("game_id"),
        clock.positive_or_null(_cell("PLAYER_ID")).alias("player_id"),
        clock.positive_or_null(_cell("TEAM_ID")).alias("team_id"),
        F.coalesce(_int("PERIOD"), F.lit(1)).alias("period"),
        whole("MINUTES_REMAINING").alias("minutes_remaining"),
        whole("SECONDS_REMAINING").alias("seconds_remaining"),
        _text("ACTION_TYPE").alias("action_type"),
        shot_type.alias("shot_type"),
        _text("SHOT_ZONE_BASIC").alias("shot_zone_basic"),
        _text("SHOT_ZONE_AREA").alias("shot_zone_area"),
        _text("SHOT_ZONE_RANGE").alias("shot_zone_range"),
        _int("SHOT_DISTANCE").alias("shot_distance"),
        whole("LOC_X").alias("loc_x"),
        whole("LOC_Y").alias("loc_y"),
        (F.coalesce(_int("SHOT_MADE_FLAG"), F.lit(0)) == 1).alias("made"),
    )
    return out.dropna(subset=["game_id", "player_id", "team_id"])


# Payload header of each box-score column.
TEAM_COUNTS = {
    "points": "PTS", "rebounds": "REB", "assists": "AST", "steals": "STL", "blocks": "BLK",
    "turnovers": "TO",
}
TEAM_RATES = {
    "offensive_rating": "OFF_RATING", "defensive_rating": "DEF_RATING", "pace": "PACE",
    "efg_pct": "EFG_PCT", "tov_pct": "TM_TOV_PCT", "orb_pct": "OREB_PCT", "ft_rate": "FTA_RATE",
}
PLAYER_COUNTS = {
    **TEAM_COUNTS, "fgm": "FGM", "fga": "FGA", "fg3m": "FG3M", "fg3a": "FG3A", "ftm": "FTM",
    "fta": "FTA", "plus_minus": "PLUS_MINUS",
}
TRACKING = {"distance_miles": ("DIST_MILES", "DIST"), "speed_avg": ("AVG_SPEED", "SPD")}


def _keyed(rows: DataFrame, keys: dict[str, str], name: str) -> DataFrame:
    return rows.select(
        _cell("GAME_ID").alias("game_id"),
        *[_cell(h).try_cast("bigint").alias(k) for k, h in keys.items()],
        F.col("row").alias(name),
    )


def _either(first: str, second: str, header: str) -> Column:
    """A value from the first payload, or the second where it is missing or 0."""
    value = lambda side: F.col(side)[header].try_cast("double")
    return F.coalesce(F.nullif(value(first), F.lit(0.0)), value(second))


def team_box(
    traditional: DataFrame, advanced: DataFrame, schedule: DataFrame
) -> DataFrame:
    """Team box score; home or away comes from the schedule."""
    keys = {"team_id": "TEAM_ID"}
    joined = _keyed(traditional, keys, "t").join(_keyed(advanced, keys, "a"), ["game_id", "team_id"], "left")
    homes = schedule.select("game_id", "home_team_id")
    return joined.join(homes, "game_id", "left").select(
        "game_id", "team_id",
        (F.col("team_id") == F.col("home_team_id")).alias("is_home"),
        *[F.col("t")[h].try_cast("int").alias(n) for n, h in TEAM_COUNTS.items()],
        *[_either("t", "a", h).alias(n) for n, h in TEAM_RATES.items()],
    )


def player_box(traditional: DataFrame, advanced: DataFrame, tracking: DataFrame) -> DataFrame:
    """Player box score with tracking distance and speed under either header."""
    keys = {"player_id": "PLAYER_ID", "team_id": "TEAM_ID"}
    on = ["game_id", "player_id", "team_id"]
    joined = (
        _keyed(traditional, keys, "t")
        .join(_keyed(advanced, keys, "a"), on, "left")
        .join(_keyed(tracking, keys, "k"), on, "left")
    )
    moved = {
        n: F.coalesce(*[F.col("k")[h].try_cast("double") for h in headers]).alias(n)
        for n, headers in TRACKING.items()
    }
    return joined.select(
        *on,
        clock.minutes_played(F.col("t")["MIN"]).alias("minutes"),
        *[F.col("t")[h].try_cast("double").try_cast("int").alias(n) for n, h in PLAYER_COUNTS.items()],
        *moved.values(),
    )


def roster_players(rows: DataFrame, order: list[str]) -> DataFrame:
    """One row per player, from its first roster row by ``order``."""
    person = F.struct(
        _cell("PLAYER").alias("full_name"),
        clock.height_inches(_cell("HEIGHT")).alias("height_inches"),
        _int("WEIGHT").alias("weight_lbs"),
        clock.birth_date(_cell("BIRTH_DATE")).alias("birth_date"),
    )
    first = F.min_by(person, F.struct(*order))
    return rows.groupBy(_cell("PLAYER_ID").try_cast("bigint").alias("player_id")).agg(
        first.alias("p")
    ).select("player_id", "p.*")


def roster_seasons(rows: DataFrame) -> DataFrame:
    """One row per (player, season, team); ``rows`` has season_id and team_id."""
    entry = F.min(F.struct(_text("POSITION").alias("position"), _text("NUM").alias("jersey_number")))
    return rows.groupBy(
        _cell("PLAYER_ID").try_cast("bigint").alias("player_id"), "season_id", "team_id"
    ).agg(entry.alias("e")).select("player_id", "season_id", "team_id", "e.*")


def player_details(rows: DataFrame) -> DataFrame:
    return rows.select(
        _cell("PERSON_ID").try_cast("bigint").alias("player_id"),
        _cell("DISPLAY_FIRST_LAST").alias("full_name"),
        clock.height_inches(_cell("HEIGHT")).alias("height_inches"),
        _int("WEIGHT").alias("weight_lbs"),
        clock.birth_date(_cell("BIRTHDATE")).alias("birth_date"),
        *[_int(f"DRAFT_{h}").alias(f"draft_{h.lower()}") for h in ("YEAR", "ROUND", "NUMBER")],
    )


def injury_reports(feed: DataFrame, text: str, teams: DataFrame, today: Column) -> DataFrame:
    """Rows with a status from the nested feed; an unreadable date becomes ``today``."""
    team = F.explode(F.from_json(text, INJURY_FEED)["league"]["teams"]).alias("t")
    player = feed.select(team).select(
        F.col("t.teamTricode").alias("abbreviation"), F.explode("t.players").alias("p")
    ).filter(F.coalesce("p.injuryStatus", F.lit("")) != "")
    ids = teams.select("abbreviation", "team_id")
    name = F.trim(F.concat_ws(" ", "p.firstName", "p.lastName"))
    return player.join(ids, "abbreviation", "left").select(
        F.coalesce("p.personId", F.lit(0)).alias("player_id"),
        name.alias("player_name"),
        F.coalesce("team_id", F.lit(0)).alias("team_id"),
        availability.normal_status(F.col("p.injuryStatus")).alias("status"),
        F.coalesce("p.comment", F.lit("")).alias("injury_description"),
        F.coalesce(F.try_to_date("p.reportDate", "yyyy-MM-dd"), today).alias("report_date"),
    )


def player_season_shots(shots: DataFrame, player_id: int, season_id: str) -> DataFrame:
    """Shots of one player and season; both conditions reach the file scan."""
    return shots.filter((F.col("season_id") == season_id) & (F.col("player_id") == player_id))


def rename_headers(row: Mapping[str, Column]) -> Column:
    """A payload row as a header -> text map, for rows already in columns."""
    parts: list[Column] = []
    for header, value in row.items():
        parts += [F.lit(header), value.cast("string")]
    return F.create_map(*parts).alias("row")
