"""Geography, lineup, clamp and prediction expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Earth radius, prediction bounds, event codes known to the tokens.
EARTH_RADIUS_MILES = 3958.7613
WIN_BOUNDS = (0.01, 0.99)
MARGIN_BOUNDS = (-35.0, 35.0)
TOTAL_BOUNDS = (175.0, 270.0)
UNKNOWN_EVENT = 14
PLAYER_VOCABULARY = 10000


def haversine_miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a1, a2 = F.radians(lat1), F.radians(lat2)
    half_lat = F.sin((a2 - a1) / 2.0)
    half_lon = F.sin((F.radians(lon2) - F.radians(lon1)) / 2.0)
    chord = half_lat * half_lat + F.cos(a1) * F.cos(a2) * half_lon * half_lon
    return 2 * EARTH_RADIUS_MILES * F.asin(F.sqrt(chord))


def clamp(value: Column, bounds: tuple[float, float]) -> Column:
    return F.greatest(F.lit(bounds[0]), F.least(F.lit(bounds[1]), value))


def lineup_hash(lineup: Column) -> Column:
    """First 16 hex digits of SHA-256 over the ascending ids joined by commas."""
    ids = F.array_join(F.transform(F.sort_array(lineup), lambda x: x.cast("string")), ",")
    return F.substring(F.sha2(ids, 256), 1, 16)


def lineup_to_json(lineup: Column) -> Column:
    return F.to_json(F.sort_array(lineup))


def lineup_from_json(text: Column) -> Column:
    return F.sort_array(F.from_json(text, "array<bigint>"))


def decay_weight(day: Column, reference: Column, tau: float) -> Column:
    return F.exp(-F.datediff(reference, day) / F.lit(float(tau)))


def event_token(event_type: Column) -> Column:
    """Vocabulary slot of an event code; anything unknown takes the last slot."""
    code = event_type.cast("int")
    return F.when(code.between(0, UNKNOWN_EVENT), code).otherwise(UNKNOWN_EVENT)


def player_bucket(player_id: Column, vocabulary: int = PLAYER_VOCABULARY) -> Column:
    return F.when(player_id > 0, F.pmod(player_id, F.lit(vocabulary - 1)) + 1).otherwise(0)


def prediction_confidence(prob: Column) -> Column:
    return F.abs(prob - 0.5) * 2


def ratio_or(top: Column, bottom: Column, default: float = 0.0) -> Column:
    """top / bottom where bottom > 0, else the default."""
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(default))


def numeric_vector(columns: list[Column], size: int) -> Column:
    """Fixed-length double array; unreadable entries are 0, short rows are padded."""
    values = [F.coalesce(c.try_cast("double"), F.lit(0.0)) for c in columns[:size]]
    return F.array(*values, *[F.lit(0.0)] * (size - len(values)))


def standardise(value: Column, mean: Column, std: Column) -> Column:
    """(value - mean) / std where std > 0, else the value unchanged."""
    return F.when(std > 0, (value - mean) / std).otherwise(value)


def top_factors(factors: Column, k: int = 5) -> Column:
    """Largest k of an array of (name, value) structs by absolute value."""
    ordered = F.array_sort(
        factors,
        lambda a, b: F.when(F.abs(a["value"]) > F.abs(b["value"]), F.lit(-1))
        .when(F.abs(a["value"]) < F.abs(b["value"]), F.lit(1))
        .when(a["name"] < b["name"], F.lit(-1))
        .when(a["name"] > b["name"], F.lit(1))
        .otherwise(F.lit(0)),
    )
    return F.slice(ordered, 1, k)
