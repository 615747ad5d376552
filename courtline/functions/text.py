"""Play description classifiers as ordered pattern chains.

Each chain is one CASE over RLIKE inside code generation, so a whole play
table is classified in a single projection.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, matched without regard to case, in order of priority.
TURNOVER_RULES = [
    ("Bad Pass", "unforced"),
    ("Traveling|Travel Violation", "unforced"),
    ("Offensive Foul|Charge", "unforced"),
    ("Double Dribble|Discontinue Dribble", "unforced"),
    ("Shot Clock", "unforced"),
    ("Out of Bounds", "unforced"),
    ("Lost Ball", "forced"),
    ("STEAL|STL", "forced"),
]
SHOT_RULES = [
    (r"Tip Shot|Tip[-\s]?In|Putback", "tip"),
    ("Dunk|Slam", "dunk"),
    ("Driving|Drive", "driving"),
    (r"Pull[-\s]?Up", "pullup"),
    (r"Step[-\s]?Back", "stepback"),
    ("Catch and Shoot|C&S", "catch_shoot"),
    ("Floating|Floater|Float", "floating"),
    (r"Fade[-\s]?Away|Fade", "fadeaway"),
    ("Hook Shot|Hook", "hook"),
    (r"Turn[-\s]?Around", "turnaround"),
    (r"Layup|Lay[-\s]?Up|Finger Roll", "layup"),
]
STEAL = "STEAL|STL"
HANDLER_ERROR = "Bad Pass|Lost Ball"
TRANSITION = "Fast Break|Transition|In Transition"
CONTESTED = "Contested"
ASSISTED = "AST|Assist"

# Player references inside a description (these do regard case).
NAME = r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)"
REFERENCE_RULES = [
    (r"\((?:Assist|AST):\s*" + NAME + r"\)", 1),
    (r"\((?:Block|BLK):\s*" + NAME + r"\)", 1),
    (r"\((?:Steal|STL):\s*" + NAME + r"\)", 1),
    (r"SUB:\s*" + NAME + r"\s+FOR\s+" + NAME, 1),
    (r"SUB:\s*" + NAME + r"\s+FOR\s+" + NAME, 2),
]
LEADING_NAME = r"^([A-Z][a-z]+(?:\.\s[A-Z][a-z]+)?)\s"
LEADING_PREFIX = r"(?i)^(MISS |MISSED |REBOUND )"
NOT_NAMES = ["FREE", "TURNOVER", "FOUL", "JUMP", "OFFENSIVE", "DEFENSIVE"]


def matches(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike("(?i)" + pattern), F.lit(False))


def _first_rule(text: Column, rules: list[tuple[str, str]], default: str) -> Column:
    chain = reduce(
        lambda acc, rule: acc.when(matches(text, rule[0]), F.lit(rule[1])),
        rules[1:],
        F.when(matches(text, rules[0][0]), F.lit(rules[0][1])),
    )
    return chain.otherwise(F.lit(default))


def turnover_type(text: Column) -> Column:
    return _first_rule(text, TURNOVER_RULES, "unknown")


def turnover_context(text: Column) -> Column:
    return F.struct(
        turnover_type(text).alias("turnover_type"),
        matches(text, STEAL).alias("is_steal"),
        matches(text, HANDLER_ERROR).alias("handler_error"),
    )


def shot_type(text: Column) -> Column:
    return _first_rule(text, SHOT_RULES, "other")


def shot_context(text: Column) -> Column:
    return F.struct(
        shot_type(text).alias("shot_type"),
        matches(text, TRANSITION).alias("is_transition"),
        matches(text, CONTESTED).alias("is_contested"),
        matches(text, ASSISTED).alias("is_assisted"),
    )


def combined_description(home: Column, away: Column, neutral: Column) -> Column:
    parts = [F.nullif(c, F.lit("")) for c in (home, away, neutral)]
    return F.concat_ws(" | ", *parts)


def player_references(text: Column) -> Column:
    """Names in a description, in reading order of the rules."""
    found = [
        F.nullif(F.trim(F.regexp_extract(text, pattern, group)), F.lit(""))
        for pattern, group in REFERENCE_RULES
    ]
    lead = F.regexp_extract(
        F.regexp_replace(F.trim(text), LEADING_PREFIX, ""), LEADING_NAME, 1
    )
    lead = F.when((lead != "") & ~F.upper(lead).isin(NOT_NAMES), lead)
    return F.array_compact(F.array(*found, lead))
