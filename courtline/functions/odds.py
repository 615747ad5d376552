"""Market odds as Column expressions: devig, stake sizing, cover probability."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sizing defaults, market defaults, scales and thresholds.
KELLY_FRACTION = 0.25
MAX_BET_FRACTION = 0.02
MIN_EDGE = 0.02
LINE_ODDS = 1.91
DEFAULT_TOTAL_LINE = 224.5
BACKTEST_SPREAD_LINE = -3.5
BACKTEST_TOTAL_LINE = 220.0
SPREAD_SIGMA = 12.0
TOTAL_SIGMA = 15.0
LOGISTIC_SIGMA = 13.0
LOGISTIC_SLOPE = 1.7
HIGH_EDGE, HIGH_CONFIDENCE = 0.05, 0.6
MEDIUM_EDGE, MEDIUM_CONFIDENCE = 0.03, 0.4
POWER_BOUNDS = (0.5, 2.0)
SHIN_BOUNDS = (0.001, 0.5)
NEWTON_STEPS = 12

# The published double-precision rational form of the normal tail.
_TAIL_TOP = [
    0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
]
_TAIL_BOTTOM = [
    0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
]


def implied(odds: Column) -> Column:
    """1/odds; null for odds that are not above 1."""
    return F.when(odds > 1, F.lit(1.0) / odds)


def overround(first: Column, second: Column) -> Column:
    return implied(first) + implied(second) - 1.0


def _fair(home: Column, away: Column, vig: Column) -> Column:
    """Fair pair as a struct, null unless the two probabilities sum to about one."""
    total = home + away
    return F.when(
        total.between(0.99, 1.01),
        F.struct(home.alias("home"), away.alias("away"), vig.alias("vig")),
    )


def devig_multiplicative(first: Column, second: Column) -> Column:
    total = implied(first) + implied(second)
    return _fair(implied(first) / total, implied(second) / total, total - 1.0)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``use``."""
    return F.transform(F.array(value), use)[0]


def _power_root(logs: Column) -> Column:
    low, high = POWER_BOUNDS
    log1, log2 = logs["a"], logs["b"]

    def newton(k: Column, _: Column) -> Column:
        u, v = F.exp(k * log1), F.exp(k * log2)
        return k - (u + v - 1.0) / (log1 * u + log2 * v)

    def excess(k: float) -> Column:
        return F.exp(k * log1) + F.exp(k * log2) - 1.0

    root = F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON_STEPS)), F.lit(low), newton)
    return F.when((excess(low) >= 0) & (excess(high) <= 0), root)


def _logs(first: Column, second: Column) -> Column:
    return F.struct(F.ln(implied(first)).alias("a"), F.ln(implied(second)).alias("b"))


def power_exponent(first: Column, second: Column) -> Column:
    """The k in [.5, 2] with p1^k + p2^k = 1, else null.

    The sum is convex and falls in k, so Newton steps from the low bound climb
    to the root without overshooting.
    """
    return _let(_logs(first, second), _power_root)


def devig_power(first: Column, second: Column) -> Column:
    vig = overround(first, second)
    return _let(
        _logs(first, second),
        lambda logs: _let(
            _power_root(logs),
            lambda k: _fair(F.exp(k * logs["a"]), F.exp(k * logs["b"]), vig),
        ),
    )


def shin_share(first: Column, second: Column) -> Column:
    vig = overround(first, second)
    low, high = SHIN_BOUNDS
    return F.when(vig <= 0, F.lit(0.0)).otherwise(
        F.least(F.greatest(vig, F.lit(low)), F.lit(high))
    )


def devig_shin(first: Column, second: Column) -> Column:
    z = shin_share(first, second)

    def raw(p: Column) -> Column:
        curved = (F.sqrt(z * z + 4.0 * (1.0 - z) * p) - z) / (2.0 * (1.0 - z))
        return F.when(z <= 1e-10, p).otherwise(curved)

    home, away = raw(implied(first)), raw(implied(second))
    return _fair(home / (home + away), away / (home + away), overround(first, second))


DEVIG_METHODS: dict[str, Callable[[Column, Column], Column]] = {
    "multiplicative": devig_multiplicative,
    "power": devig_power,
    "shin": devig_shin,
}


def devig(first: Column, second: Column, method: str = "power") -> Column:
    if method not in DEVIG_METHODS:
        raise ValueError(f"unknown devig method {method!r}; have {sorted(DEVIG_METHODS)}")
    return DEVIG_METHODS[method](first, second)


def edge(model: Column, market: Column) -> Column:
    return model - market


def american_to_decimal(american: Column) -> Column:
    return F.when(american > 0, 1 + american / 100.0).otherwise(1 - 100.0 / american)


def decimal_to_american(odds: Column) -> Column:
    return F.when(odds >= 2.0, F.bround((odds - 1) * 100)).otherwise(
        F.bround(-100 / (odds - 1))
    ).cast("int")


def full_kelly(prob: Column, odds: Column) -> Column:
    return F.when(odds > 1, prob - (1 - prob) / (odds - 1))


def kelly(
    prob: Column,
    odds: Column,
    market: Column | None = None,
    fraction: float | Column = KELLY_FRACTION,
    cap: float = MAX_BET_FRACTION,
    min_edge: float = MIN_EDGE,
) -> Column:
    """Struct (full_kelly, adjusted_kelly, bet_fraction, edge, has_edge)."""
    fraction = fraction if isinstance(fraction, Column) else F.lit(fraction)
    gain = prob - (market if market is not None else 1.0 / odds)
    full = full_kelly(prob, odds)
    has_edge = (gain >= min_edge) & (full > 0)
    adjusted = F.when(has_edge, full * fraction).otherwise(0.0)
    return F.struct(
        full.alias("full_kelly"),
        adjusted.alias("adjusted_kelly"),
        F.least(adjusted, F.lit(cap)).alias("bet_fraction"),
        gain.alias("edge"),
        has_edge.alias("has_edge"),
    )


def min_probability(odds: Column, min_edge: float = MIN_EDGE) -> Column:
    return 1.0 / odds + min_edge


def min_odds(prob: Column, min_edge: float = MIN_EDGE) -> Column:
    need = prob - min_edge
    return F.when(need <= 0, F.lit(math.inf)).otherwise(1.0 / need)


def _horner(x: Column, coefficients: list[float]) -> Column:
    acc = F.lit(coefficients[0])
    for c in coefficients[1:]:
        acc = acc * x + c
    return acc


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function, exact to about 1e-14 for |z| < 7."""
    x = F.abs(z)
    tail = F.exp(-x * x / 2.0) * _horner(x, _TAIL_TOP) / _horner(x, _TAIL_BOTTOM)
    tail = F.when(x < 7.07, tail).otherwise(0.0)
    return F.when(z > 0, 1.0 - tail).otherwise(tail)


def cover_normal(diff: Column, sigma: float) -> Column:
    return normal_cdf(diff / sigma)


def cover_logistic(diff: Column) -> Column:
    prob = 1.0 / (1.0 + F.exp(-LOGISTIC_SLOPE * diff / LOGISTIC_SIGMA))
    return F.greatest(F.lit(0.01), F.least(F.lit(0.99), prob))


def signal_confidence(gain: Column, confidence: Column, uncertainty: Column) -> Column:
    effective = confidence * (1 - uncertainty * 0.5)
    return (
        F.when((gain >= HIGH_EDGE) & (effective >= HIGH_CONFIDENCE), "high")
        .when((gain >= MEDIUM_EDGE) & (effective >= MEDIUM_CONFIDENCE), "medium")
        .otherwise("low")
    )


def closing_line_value(odds: Column, closing: Column) -> Column:
    """Relative gain of the taken price over the closing price; null if either is bad."""
    taken = implied(odds)
    return (implied(closing) - taken) / taken


def settle(won: Column, odds: Column) -> Column:
    """Profit per unit staked."""
    return F.when(won, odds - 1).otherwise(-1.0)
