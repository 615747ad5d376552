"""The static team dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Abbreviation and arena latitude and longitude, by ascending team id.
FIRST_TEAM_ID = 1610612737
TEAMS = [
    ("ATL", 33.7573, -84.3963),
    ("BOS", 42.3662, -71.0621),
    ("CLE", 41.4965, -81.6882),
    ("NOP", 29.9490, -90.0821),
    ("CHI", 41.8807, -87.6742),
    ("DAL", 32.7905, -96.8103),
    ("DEN", 39.7487, -105.0077),
    ("GSW", 37.7680, -122.3877),
    ("HOU", 29.7508, -95.3621),
    ("LAC", 34.0430, -118.2673),
    ("LAL", 34.0430, -118.2673),
    ("MIA", 25.7814, -80.1870),
    ("MIL", 43.0451, -87.9175),
    ("MIN", 44.9795, -93.2760),
    ("BKN", 40.6826, -73.9754),
    ("NYK", 40.7505, -73.9934),
    ("ORL", 28.5392, -81.3839),
    ("IND", 39.7640, -86.1555),
    ("PHI", 39.9012, -75.1720),
    ("PHX", 33.4457, -112.0712),
    ("POR", 45.5316, -122.6668),
    ("SAC", 38.5802, -121.4997),
    ("SAS", 29.4270, -98.4375),
    ("OKC", 35.4634, -97.5151),
    ("TOR", 43.6435, -79.3791),
    ("UTA", 40.7683, -111.9011),
    ("MEM", 35.1382, -90.0505),
    ("WAS", 38.8981, -77.0209),
    ("DET", 42.3410, -83.0551),
    ("CHA", 35.2251, -80.8392),
]


def team_dimension(spark: SparkSession) -> DataFrame:
    rows = [(FIRST_TEAM_ID + i, *t) for i, t in enumerate(TEAMS)]
    return spark.createDataFrame(
        rows, "team_id bigint, abbreviation string, arena_lat double, arena_lon double"
    )
