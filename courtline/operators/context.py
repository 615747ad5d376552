"""Pre-game context: previous form, rest, lineup ratings and spacing, graph tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtline.functions import misc
from courtline.operators.normalize import wide_stats
from courtline.operators.ordered import as_of
from courtline.operators.schedule import team_rows

# The context columns in order, and their scales.
FORM_METRICS = {
    "off_rating": "offensive_rating",
    "def_rating": "defensive_rating",
    "pace": "pace",
    "efg": "efg_pct",
    "tov": "tov_pct",
    "orb": "orb_pct",
    "ft_rate": "ft_rate",
}
CONTEXT_FEATURES = [
    "home_off_rating_z", "home_def_rating_z", "home_pace_z", "home_efg_z", "home_tov_z",
    "home_orb_z", "home_ft_rate_z",
    "away_off_rating_z", "away_def_rating_z", "away_pace_z", "away_efg_z", "away_tov_z",
    "away_orb_z", "away_ft_rate_z",
    "home_rest_days", "away_rest_days", "rest_diff", "home_back_to_back", "away_back_to_back",
    "home_travel_miles", "away_travel_miles",
    "home_rapm_sum", "away_rapm_sum", "rapm_diff", "home_orapm_sum", "home_drapm_sum",
    "away_orapm_sum", "away_drapm_sum",
    "home_spacing_area", "away_spacing_area", "is_playoff", "is_neutral_site",
]
REST_SCALE, TRAVEL_SCALE, RATING_SCALE, HULL_SCALE = 7.0, 5000.0, 10.0, 50000.0
# Node defaults and body-size scales of the lineup graph.
POSITIONS = ["PG", "SG", "SF", "PF", "C"]
DEFAULT_POSITION = "SF"
HEIGHT_SCALE, WEIGHT_SCALE = (79.0, 3.5), (215.0, 25.0)
NODE_DEFAULTS = {
    "fg_pct": 0.45, "fg3_pct": 0.35, "ft_pct": 0.75, "mpg": 20.0, "usg_pct": 0.20,
}


def previous_form(
    games: DataFrame, team_stats: DataFrame, season_stats: DataFrame
) -> DataFrame:
    """z-scored metrics of each team's latest earlier game of the season, per team row.

    ``team_stats`` has game_id, team_id, season_id, game_date and the metrics; it is
    reduced to one row per (team, day).
    """
    metrics = list(FORM_METRICS.values())
    latest = team_stats.groupBy("team_id", "season_id", "game_date").agg(
        F.max(F.struct("game_id", *metrics)).alias("m")
    ).select("team_id", "season_id", "game_date", *[F.col(f"m.{m}").alias(m) for m in metrics])
    asks = team_rows(games.select("game_id", "season_id", "game_date", "home_team_id", "away_team_id"))
    asks = asks.select("game_id", "season_id", "game_date", "team_id", "is_home")
    found = as_of(
        asks, latest, ["team_id", "season_id"], "game_date", "game_date", metrics,
        {"__month": F.trunc("__t", "month")}, name="form",
    )
    stats = wide_stats(season_stats, "season_id", metrics)
    scored = found.join(stats, "season_id", "left")

    def z(metric: str) -> Column:
        value, std = F.col(f"form.{metric}"), F.col(f"{metric}__std")
        return F.coalesce(F.when(std > 0, (value - F.col(f"{metric}__mean")) / std), F.lit(0.0))

    return scored.select(
        "game_id", "team_id", "is_home", *[z(m).alias(f"{short}_z") for short, m in FORM_METRICS.items()]
    )


def lineup_rating_sums(lineups: DataFrame, ratings: DataFrame) -> DataFrame:
    """Sum of the five ratings per (game, side); an unrated player counts 0.

    ``lineups`` has game_id, season_id, home_lineup and away_lineup.
    """
    sides = F.explode(
        F.array(
            F.struct(F.lit("home").alias("side"), F.col("home_lineup").alias("lineup")),
            F.struct(F.lit("away").alias("side"), F.col("away_lineup").alias("lineup")),
        )
    ).alias("s")
    members = lineups.select("game_id", "season_id", sides).select(
        "game_id", "season_id", "s.side", F.explode("s.lineup").alias("player_id")
    )
    joined = members.join(
        ratings.select("season_id", "player_id", "rapm", "orapm", "drapm"),
        ["season_id", "player_id"], "left",
    )
    return joined.groupBy("game_id", "side").agg(
        *[F.sum(F.coalesce(c, F.lit(0.0))).alias(f"{c}_sum") for c in ("rapm", "orapm", "drapm")]
    )


def lineup_hulls(lineups: DataFrame, spacing: DataFrame) -> DataFrame:
    """Home and away hull area by (season, lineup hash); 0 where unknown."""
    hashed = lineups.select(
        "game_id", "season_id",
        misc.lineup_hash(F.col("home_lineup")).alias("home_hash"),
        misc.lineup_hash(F.col("away_lineup")).alias("away_hash"),
    )
    for side in ("home", "away"):
        area = spacing.select(
            "season_id", F.col("lineup_hash").alias(f"{side}_hash"), F.col("hull_area").alias(f"{side}_area")
        )
        hashed = hashed.join(area, ["season_id", f"{side}_hash"], "left")
    return hashed.select(
        "game_id", *[F.coalesce(f"{s}_area", F.lit(0.0)).alias(f"{s}_area") for s in ("home", "away")]
    )


def first_stints(stints: DataFrame, start: str = "start_sec") -> DataFrame:
    """The opening stint of every game, by period and numeric start."""
    first = F.min(F.struct("period", start, "home_lineup", "away_lineup"))
    return stints.groupBy("game_id").agg(first.alias("s")).select(
        "game_id", "s.home_lineup", "s.away_lineup"
    )


def expected_lineups(games: DataFrame, opening: DataFrame) -> DataFrame:
    """Lineup per (game, side): this game's opening stint, else the team's in its
    latest earlier game that has one."""
    rows = team_rows(games.select("game_id", "game_date", "home_team_id", "away_team_id"))
    known = rows.join(opening, "game_id", "left").select(
        "game_id", "game_date", "team_id", "is_home",
        F.when(F.col("is_home"), F.col("home_lineup")).otherwise(F.col("away_lineup")).alias("lineup"),
    )
    days = known.filter("lineup IS NOT NULL").groupBy("team_id", "game_date").agg(
        F.max(F.struct("game_id", "lineup")).alias("l")
    ).select("team_id", "game_date", F.col("l.lineup").alias("earlier"))
    found = as_of(
        known, days, ["team_id"], "game_date", "game_date", ["earlier"],
        {"__month": F.trunc("__t", "month")}, name="prior",
    )
    return found.select(
        "game_id", "team_id", F.when(F.col("is_home"), "home").otherwise("away").alias("side"),
        F.coalesce("lineup", "prior.earlier").alias("lineup"),
    )


def lineup_names(lineups: DataFrame, players: DataFrame) -> DataFrame:
    """Player names in lineup order; an unknown id shows as "Player <id>"."""
    spread = lineups.select("game_id", "side", F.posexplode("lineup").alias("place", "player_id"))
    name = F.coalesce("full_name", F.concat(F.lit("Player "), F.col("player_id").cast("string")))
    return (
        spread.join(players.select("player_id", "full_name"), "player_id", "left")
        .groupBy("game_id", "side")
        .agg(F.array_sort(F.collect_list(F.struct("place", name.alias("name")))).alias("n"))
        .select("game_id", "side", F.transform("n", lambda x: x["name"]).alias("names"))
    )


def context_features(
    games: DataFrame,
    form: DataFrame,
    rest: DataFrame,
    travel: DataFrame,
    rating_sums: DataFrame,
    hulls: DataFrame,
) -> DataFrame:
    """The 32 context columns of every game.

    ``form`` is per (game, team); ``rest`` has team_id, game_date and gap_days;
    ``travel`` has team_id, season_id, game_date and travel_miles.
    """
    rows = team_rows(games.select("game_id", "season_id", "game_date", "home_team_id", "away_team_id"))
    z = [f"{short}_z" for short in FORM_METRICS]
    sided = (
        rows.select("game_id", "season_id", "game_date", "team_id", "is_home")
        .join(form.drop("is_home"), ["game_id", "team_id"], "left")
        .join(rest.select("team_id", "game_date", "gap_days"), ["team_id", "game_date"], "left")
        .join(travel.select("team_id", "season_id", "game_date", "travel_miles"), ["team_id", "season_id", "game_date"], "left")
    )
    item = F.struct(*z, "gap_days", "travel_miles")
    paired = sided.groupBy("game_id").agg(
        F.max(F.when(F.col("is_home"), item)).alias("home"),
        F.max(F.when(~F.col("is_home"), item)).alias("away"),
    )
    sums = rating_sums.groupBy("game_id").agg(
        *[
            F.max(F.when(F.col("side") == s, F.struct("rapm_sum", "orapm_sum", "drapm_sum"))).alias(f"{s}_r")
            for s in ("home", "away")
        ]
    )
    joined = paired.join(sums, "game_id", "left").join(hulls, "game_id", "left")
    out: dict[str, Column] = {}
    for s in ("home", "away"):
        for c in z:
            out[f"{s}_{c}"] = F.coalesce(f"{s}.{c}", F.lit(0.0))
        gap = F.col(f"{s}.gap_days")
        out[f"{s}_rest_days"] = gap / REST_SCALE
        out[f"{s}_back_to_back"] = (gap <= 1).cast("double")
        out[f"{s}_travel_miles"] = F.least(F.col(f"{s}.travel_miles") / TRAVEL_SCALE, F.lit(1.0))
        for c in ("rapm", "orapm", "drapm"):
            out[f"{s}_{c}_sum"] = F.coalesce(f"{s}_r.{c}_sum", F.lit(0.0)) / RATING_SCALE
        out[f"{s}_spacing_area"] = F.coalesce(f"{s}_area", F.lit(0.0)) / HULL_SCALE
    out["rest_diff"] = out["home_rest_days"] - out["away_rest_days"]
    out["rapm_diff"] = out["home_rapm_sum"] - out["away_rapm_sum"]
    out["is_playoff"] = out["is_neutral_site"] = F.lit(0.0)
    return joined.select("game_id", *[out[c].alias(c) for c in CONTEXT_FEATURES])


def graph_edges(lineups: DataFrame, chemistry: DataFrame | None = None) -> DataFrame:
    """The 90 directed edges of each game's ten-player graph.

    Nodes 0-4 are home, 5-9 away; the edge list is a fixed template exploded in the
    row. With ``chemistry`` (source, target, weight) each edge gets its weight or 0.
    """
    template = F.array(*[
        F.struct(F.lit(i).alias("src"), F.lit(j).alias("dst"))
        for i in range(10) for j in range(10) if i != j
    ])
    both = F.concat("home_lineup", "away_lineup")
    edges = lineups.select("game_id", both.alias("n"), F.explode(template).alias("e")).select(
        "game_id", "e.src", "e.dst",
        F.element_at("n", F.col("e.src") + 1).alias("source"),
        F.element_at("n", F.col("e.dst") + 1).alias("target"),
    )
    if chemistry is None:
        return edges
    return edges.join(chemistry, ["source", "target"], "left").withColumn(
        "weight", F.coalesce("weight", F.lit(0.0))
    )


def graph_nodes(lineups: DataFrame, players: DataFrame) -> DataFrame:
    """Sixteen features per (game, node); unknown players take the defaults."""
    nodes = lineups.select(
        "game_id", F.posexplode(F.concat("home_lineup", "away_lineup")).alias("node", "player_id")
    )
    joined = nodes.join(players.withColumn("__known", F.lit(True)), "player_id", "left")
    known = F.col("__known").isNotNull()

    def scaled(c: str, scale: tuple[float, float]) -> Column:
        value = F.coalesce(F.col(c).cast("double"), F.lit(scale[0]))
        return F.when(known, (value - scale[0]) / scale[1]).otherwise(0.0)

    def or_default(c: str) -> Column:
        return F.coalesce(c, F.lit(NODE_DEFAULTS[c]))

    o, d = F.coalesce("orapm", F.lit(0.0)), F.coalesce("drapm", F.lit(0.0))
    place = F.upper(F.coalesce("position", F.lit(DEFAULT_POSITION)))
    place = F.when(place.isin(POSITIONS), place).otherwise(DEFAULT_POSITION)
    features: Mapping[str, Column] = {
        "orapm": o, "drapm": d, "total_rapm": o + d,
        "height": scaled("height_inches", HEIGHT_SCALE),
        "weight": scaled("weight_lbs", WEIGHT_SCALE),
        **{f"pos_{p.lower()}": (place == p).cast("double") for p in POSITIONS},
        "fg_pct": or_default("fg_pct"), "fg3_pct": or_default("fg3_pct"),
        "ft_pct": or_default("ft_pct"), "mpg": or_default("mpg") / 48.0,
        "usg_pct": or_default("usg_pct"), "is_home": (F.col("node") < 5).cast("double"),
    }
    return joined.select("game_id", "node", "player_id", *[c.alias(n) for n, c in features.items()])
