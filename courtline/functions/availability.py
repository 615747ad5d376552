"""Injury status and play-probability expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Play priors by status, and modifiers by injury text and context.
STATUS_PRIORS = {
    "probable": 0.93,
    "questionable": 0.55,
    "doubtful": 0.03,
    "out": 0.00,
    "available": 1.00,
    "healthy": 1.00,
    "day-to-day": 0.55,
    "gtd": 0.55,
}
DEFAULT_PRIOR = 0.55
INJURY_MODIFIERS = {
    "rest": 0.8,
    "load management": 0.7,
    "ankle": 1.0,
    "knee": 0.95,
    "back": 0.9,
    "illness": 0.85,
    "hamstring": 0.9,
    "calf": 0.9,
    "quad": 0.9,
    "shoulder": 1.0,
    "wrist": 1.0,
    "finger": 1.05,
    "toe": 1.0,
}
CONTEXT_MODIFIERS = {
    "back_to_back": 0.85,
    "playoff_race": 1.15,
    "tanking": 0.75,
    "playoff_game": 1.20,
}
# Exact status texts, then texts looked for in this order.
STATUS_EXACT = {
    "out": "out",
    "o": "out",
    "doubtful": "doubtful",
    "d": "doubtful",
    "questionable": "questionable",
    "q": "questionable",
    "gtd": "questionable",
    "probable": "probable",
    "p": "probable",
    "available": "available",
    "active": "available",
    "healthy": "available",
}
STATUS_CONTAINED = [
    ("doubtful", "doubtful"),
    ("questionable", "questionable"),
    ("game time decision", "questionable"),
    ("day-to-day", "questionable"),
    ("probable", "probable"),
    ("available", "available"),
    ("active", "available"),
    ("healthy", "available"),
    ("out", "out"),
]
UNCERTAIN_STATUSES = ["questionable", "doubtful", "probable", "gtd"]
# Rating points to win probability and to points; unknown replacements.
WIN_PER_RATING = 0.003
POINTS_PER_RATING = 0.5
UNKNOWN_REPLACEMENT = -2.0
UNRATED_REPLACEMENT = -1.0


def _literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def _first_contained(text: Column, rules: list[tuple[str, object]], default: object) -> Column:
    chain = reduce(
        lambda acc, rule: acc.when(text.contains(rule[0]), F.lit(rule[1])),
        rules[1:],
        F.when(text.contains(rules[0][0]), F.lit(rules[0][1])),
    )
    return chain.otherwise(F.lit(default))


def normal_status(status: Column) -> Column:
    text = F.lower(F.trim(status))
    return F.coalesce(
        F.try_element_at(_literal_map(STATUS_EXACT), text),
        _first_contained(text, STATUS_CONTAINED, "questionable"),
    )


def prior_probability(status: Column) -> Column:
    text = F.lower(F.trim(status))
    return F.coalesce(
        F.try_element_at(_literal_map(STATUS_PRIORS), text), F.lit(DEFAULT_PRIOR)
    )


def injury_modifier(description: Column) -> Column:
    text = F.lower(F.trim(description))
    return _first_contained(text, list(INJURY_MODIFIERS.items()), 1.0)


def context_modifier(flags: dict[str, Column]) -> Column:
    """Product of the modifiers whose flag is set."""
    out = F.lit(1.0)
    for name, flag in flags.items():
        if name in CONTEXT_MODIFIERS:
            out = out * F.when(flag, CONTEXT_MODIFIERS[name]).otherwise(1.0)
    return out


def history_modifier(games: Column, mean_minutes: Column) -> Column:
    """From a player's last 82 rows: heavy minutes raise, light minutes lower."""
    return (
        F.when((games >= 20) & (mean_minutes > 32), 1.1)
        .when((games >= 20) & (mean_minutes < 20), 0.9)
        .otherwise(1.0)
    )


def play_probability(
    status: Column,
    description: Column,
    context: Column | None = None,
    history: Column | None = None,
) -> Column:
    raw = prior_probability(status) * injury_modifier(description)
    for factor in (context, history):
        if factor is not None:
            raw = raw * factor
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


def replacement_impact(
    rating: Column, replacement_id: Column | None = None, replacement: Column | None = None
) -> Column:
    """Win-probability value of a player over the replacement."""
    base = F.lit(UNKNOWN_REPLACEMENT)
    if replacement_id is not None:
        base = F.when(replacement_id.isNull(), base).otherwise(
            F.coalesce(replacement, F.lit(UNRATED_REPLACEMENT))
        )
    return (F.coalesce(rating, F.lit(0.0)) - base) * WIN_PER_RATING
