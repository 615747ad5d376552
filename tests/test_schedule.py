import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from courtline.operators import schedule


def d(n):
    return dt.date(2024, 1, n)


def games(spark):
    rows = [("g1", d(1), 1, 2), ("g2", d(2), 1, 3), ("g3", d(3), 2, 1), ("g4", d(4), 3, 1), ("g5", d(9), 1, 2)]
    return spark.createDataFrame(rows, "game_id string, game_date date, home_team_id bigint, away_team_id bigint")


def flags(spark):
    lat = F.when(F.col("venue_team") != 3, F.col("venue_team") * 10.0)
    lon = F.when(F.col("venue_team") != 3, F.lit(-80.0))
    out = schedule.schedule_flags(schedule.team_days(games(spark)), lat, lon)
    return {(r["team_id"], r["game_date"].day): r for r in out.collect()}


def test_rest_density_and_streaks(spark):
    f = flags(spark)
    assert f[(1, 1)]["rest_days"] == 7 and not f[(1, 1)]["back_to_back"]
    assert [f[(1, n)]["rest_days"] for n in (2, 3, 4, 9)] == [0, 0, 0, 4]
    assert f[(1, 2)]["back_to_back"]
    assert [f[(1, n)]["three_in_four"] for n in (1, 2, 3, 4, 9)] == [False, False, True, True, False]
    assert [f[(1, n)]["four_in_five"] for n in (3, 4, 9)] == [False, True, False]
    assert [f[(1, n)]["home_stand"] for n in (1, 2, 3, 4, 9)] == [1, 2, 0, 0, 1]
    assert [f[(1, n)]["road_trip"] for n in (1, 2, 3, 4, 9)] == [0, 0, 1, 2, 0]


def test_travel_skips_unknown_venues_and_old_legs(spark):
    f = flags(spark)
    leg = 10 * np.pi / 180 * 3958.7613
    assert f[(1, 2)]["travel_miles"] == 0.0
    assert abs(f[(1, 3)]["travel_miles"] - leg) < 0.06
    assert abs(f[(1, 4)]["travel_miles"] - leg) < 0.06
    # on the 9th only the 3rd and the 4th (unknown) are inside the week
    assert abs(f[(1, 9)]["travel_miles"] - leg) < 0.06


def test_player_load(spark):
    rows = [(1, d(n), m, 1.5) for n, m in [(1, 20.0), (2, None), (3, 30.0), (5, 40.0), (6, 10.0), (7, 12.0), (8, 0.0)]]
    out = schedule.player_load(spark.createDataFrame(rows, "player_id int, game_date date, minutes double, distance_miles double"))
    got = {r["game_date"].day: r for r in out.collect()}
    assert got[1]["avg_minutes"] == 0.0 and got[2]["minutes_trend"] == 0.0
    recent = [12.0, 10.0, 40.0, 30.0, 0.0]
    assert got[8]["avg_minutes"] == round(np.mean(recent), 1)
    assert got[8]["minutes_trend"] == round(np.polyfit(range(5), recent, 1)[0], 2)
    assert got[8]["total_distance_miles"] == 7.5
