"""Table schemas, natural keys and partition columns of the league model."""

from __future__ import annotations

from pyspark.sql.types import StructType


DDL: dict[str, str] = {
    "seasons": "season_id string not null, start_date date, end_date date, games_count int",
    "teams": "team_id bigint not null, abbreviation string, full_name string, city string, "
    "arena_name string, arena_lat double, arena_lon double",
    "players": "player_id bigint not null, full_name string, height_inches int, weight_lbs int, "
    "birth_date date, draft_year int, draft_round int, draft_number int",
    "player_seasons": "player_id bigint not null, season_id string not null, team_id bigint not null, "
    "position string, jersey_number string",
    "games": "game_id string not null, season_id string not null, game_date date, "
    "home_team_id bigint, away_team_id bigint, home_score int, away_score int, status string, attendance int",
    "game_stats": "game_id string not null, team_id bigint not null, is_home boolean, points int, "
    "rebounds int, assists int, steals int, blocks int, turnovers int, offensive_rating double, "
    "defensive_rating double, pace double, efg_pct double, tov_pct double, orb_pct double, ft_rate double",
    "player_game_stats": "game_id string not null, player_id bigint not null, team_id bigint, minutes double, "
    "points int, rebounds int, assists int, steals int, blocks int, turnovers int, fgm int, fga int, "
    "fg3m int, fg3a int, ftm int, fta int, plus_minus int, distance_miles double, speed_avg double",
    "plays": "game_id string not null, event_num int not null, period int, pc_time string, wc_time string, "
    "event_type int, event_action int, home_description string, away_description string, "
    "neutral_description string, score_home int, score_away int, player1_id bigint, player2_id bigint, "
    "player3_id bigint, team_id bigint",
    "shots": "game_id string not null, player_id bigint not null, team_id bigint, period int, "
    "minutes_remaining int, seconds_remaining int, action_type string, shot_type string, "
    "shot_zone_basic string, shot_zone_area string, shot_zone_range string, shot_distance int, "
    "loc_x int, loc_y int, made boolean",
    "stints": "game_id string not null, stint_no int, period int, start_sec int, end_sec int, start_time string, "
    "end_time string, duration_seconds int, home_lineup array<bigint>, away_lineup array<bigint>, "
    "home_points bigint, away_points bigint, possessions double",
    "odds": "game_id string not null, source string not null, timestamp timestamp, home_ml double, "
    "away_ml double, spread_home double, spread_home_odds double, spread_away_odds double, total double, "
    "over_odds double, under_odds double",
    "player_rapm": "player_id bigint not null, season_id string not null, calculation_date date not null, "
    "orapm double, drapm double, rapm double, sample_stints int",
    "lineup_spacing": "season_id string not null, lineup_hash string not null, player_ids array<bigint>, "
    "hull_area double, centroid_x double, centroid_y double, shot_count int",
    "season_stats": "season_id string not null, metric_name string not null, mean_value double, "
    "std_value double, min_value double, max_value double",
    "bets": "game_id string not null, timestamp timestamp, bet_type string, side string, model_prob double, "
    "market_odds double, market_prob double, edge double, kelly_fraction double, bet_amount double, "
    "result string, profit double",
    "predictions": "game_id string not null, prediction_date date, matchup string, home_win_prob double, "
    "predicted_margin double, predicted_total double, home_win_prob_adjusted double, "
    "predicted_margin_adjusted double, predicted_total_adjusted double, confidence double, "
    "injury_uncertainty double, top_factors array<struct<name:string,value:double>>, model_version string",
    "signals": "game_id string not null, game_date date, matchup string, bet_type string, side string, "
    "line double, model_prob double, market_prob double, edge double, recommended_odds double, "
    "kelly_fraction double, recommended_stake_pct double, confidence string",
    "injury_reports": "player_id bigint not null, player_name string, team_id bigint, status string, "
    "injury_description string, report_date date not null",
    "model_versions": "version string not null, parent_version string, created_at timestamp, status string, "
    "metrics map<string,double>",
    "folds": "fold_num bigint not null, train_start date, train_end date, val_start date, val_end date, "
    "train_games bigint, val_games bigint",
}


def schema(table: str) -> StructType:
    """Schema of a table; needs an active session, which parses the DDL."""
    return StructType.fromDDL(DDL[table])


NATURAL_KEYS: dict[str, list[str]] = {
    "seasons": ["season_id"],
    "teams": ["team_id"],
    "players": ["player_id"],
    "player_seasons": ["player_id", "season_id", "team_id"],
    "games": ["game_id"],
    "game_stats": ["game_id", "team_id"],
    "player_game_stats": ["game_id", "player_id"],
    "plays": ["game_id", "event_num"],
    "shots": ["game_id", "player_id", "period", "minutes_remaining", "seconds_remaining", "loc_x", "loc_y"],
    "stints": ["game_id", "stint_no"],
    "odds": ["game_id", "source", "timestamp"],
    "player_rapm": ["player_id", "season_id", "calculation_date"],
    "lineup_spacing": ["season_id", "lineup_hash"],
    "season_stats": ["season_id", "metric_name"],
    "bets": ["game_id", "bet_type", "side"],
    "predictions": ["game_id", "prediction_date"],
    "signals": ["game_id", "bet_type", "side"],
    "injury_reports": ["player_id", "report_date"],
    "model_versions": ["version"],
    "folds": ["fold_num"],
}
