"""Game clock, season label and unit parsing expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lengths of play in seconds and the score scale.
PERIOD_SECONDS = 720
OVERTIME_SECONDS = 300
REGULATION_PERIODS = 4
GAME_SECONDS = 2880
SCORE_SCALE = 8.5


def _parts(clock: Column) -> tuple[Column, Column, Column]:
    pieces = F.split(clock, ":")
    return (
        F.size(pieces),
        F.try_element_at(pieces, F.lit(1)).try_cast("int"),
        F.try_element_at(pieces, F.lit(2)).try_cast("int"),
    )


def clock_seconds(clock: Column) -> Column:
    """Seconds left on an "MM:SS" clock; null where the text is no such clock."""
    n, minutes, seconds = _parts(clock)
    return F.when(n == 2, minutes * 60 + seconds)


def elapsed_seconds(period: Column, clock: Column) -> Column:
    """Seconds since tip-off; a bad clock counts as 0:00."""
    left = F.coalesce(clock_seconds(clock), F.lit(0))
    regulation = period * PERIOD_SECONDS - left
    overtime = (
        F.lit(GAME_SECONDS) + (period - REGULATION_PERIODS) * OVERTIME_SECONDS - left
    )
    return F.when(period <= REGULATION_PERIODS, regulation).otherwise(overtime)


def clock_or_full(clock: Column) -> Column:
    """Seconds left in the period; a bad clock counts as a full period."""
    n, minutes, seconds = _parts(clock)
    parsed = minutes * 60 + F.when(n > 1, seconds).otherwise(0)
    return F.coalesce(parsed, F.lit(PERIOD_SECONDS))


def time_remaining(period: Column, clock: Column) -> Column:
    """Share of regulation time left, 1 at tip-off."""
    whole = F.greatest(F.lit(0), F.lit(REGULATION_PERIODS) - period) * PERIOD_SECONDS
    return (whole + clock_or_full(clock)) / F.lit(float(GAME_SECONDS))


def score_difference(home: Column, away: Column) -> Column:
    return (F.coalesce(home, F.lit(0)) - F.coalesce(away, F.lit(0))) / F.lit(SCORE_SCALE)


def season_label(day: Column) -> Column:
    """"2023-24" for any day from October 2023 on to September 2024."""
    start = F.year(day) - F.when(F.month(day) >= 10, 0).otherwise(1)
    return F.concat_ws("-", start.cast("string"), F.lpad(F.pmod(start + 1, F.lit(100)).cast("string"), 2, "0"))


def minutes_played(text: Column) -> Column:
    """Minutes from a number or "MM:SS" text, else null."""
    pieces = F.split(text, ":")
    minutes = F.try_element_at(pieces, F.lit(1)).try_cast("int")
    seconds = F.try_element_at(pieces, F.lit(2)).try_cast("int")
    return F.coalesce(
        text.try_cast("double"),
        F.when(text.contains(":"), minutes + seconds / F.lit(60.0)),
    )


def height_inches(text: Column) -> Column:
    """Inches from "feet-inches" text, else null."""
    pieces = F.split(text, "-")
    feet = F.try_element_at(pieces, F.lit(1)).try_cast("int")
    inches = F.try_element_at(pieces, F.lit(2)).try_cast("int")
    return F.when(F.size(pieces) == 2, feet * 12 + inches)


def birth_date(text: Column) -> Column:
    """Date from "MAR 03, 1998" or ISO text, else null."""
    return F.coalesce(
        F.try_to_date(F.initcap(F.trim(text)), "MMM dd, yyyy"),
        F.substring(text, 1, 10).try_cast("date"),
    )


def score_pair(score: Column) -> Column:
    """Struct (home, away) from "AWAY - HOME" text; both null where unreadable."""
    pieces = F.split(score, " - ")
    away = F.try_element_at(pieces, F.lit(1)).try_cast("int")
    home = F.try_element_at(pieces, F.lit(2)).try_cast("int")
    readable = (F.size(pieces) == 2) & home.isNotNull() & away.isNotNull()
    return F.struct(
        F.when(readable, home).alias("home"), F.when(readable, away).alias("away")
    )


def positive_or_null(value: Column) -> Column:
    """Integer id; zero and unreadable become null."""
    number = value.try_cast("bigint")
    return F.nullif(number, F.lit(0).cast("bigint"))


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))
