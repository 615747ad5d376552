"""Bets and signals for whole prediction tables.

One game fans out to its candidate bets by exploding an array of structs, so a
table of games becomes a table of bets in one projection without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtline.functions import odds as o

MARKETS = ("moneyline", "spread", "total")


def with_default_odds(odds: DataFrame) -> DataFrame:
    """Fill missing line prices and the total line."""
    filled = {c: F.coalesce(c, F.lit(o.LINE_ODDS)) for c in (
        "spread_home_odds", "spread_away_odds", "over_odds", "under_odds")}
    filled["total"] = F.coalesce("total", F.lit(o.DEFAULT_TOTAL_LINE))
    return odds.withColumns(filled)


def _best_side(
    market: str, sides: tuple[str, str], min_edge: float, fraction: float, cap: float
) -> Column:
    """The bet of one market as a struct: its better side, or null without an edge.

    Reads the struct column ``__<market>`` with the prices, the model and market
    probabilities of both sides and whether each side won.
    """
    m = F.col(f"__{market}")

    def bet(i: int) -> Column:
        prob, price, fair = m[f"prob{i}"], m[f"price{i}"], m[f"fair{i}"]
        size = o.kelly(prob, price, fair, fraction, cap, min_edge)
        return F.when(
            size["has_edge"],
            F.struct(
                F.lit(market).alias("bet_type"),
                F.lit(sides[i]).alias("side"),
                prob.alias("model_prob"),
                price.alias("market_odds"),
                fair.alias("market_prob"),
                (prob - fair).alias("edge"),
                size["full_kelly"].alias("kelly_fraction"),
                size["bet_fraction"].alias("bet_fraction"),
                F.when(m[f"won{i}"], "win").otherwise("loss").alias("result"),
                o.settle(m[f"won{i}"], price).alias("unit_profit"),
            ),
        )

    gain = [m[f"prob{i}"] - m[f"fair{i}"] for i in (0, 1)]
    first = (gain[0] >= min_edge) & (gain[0] >= gain[1])
    return F.when(first, bet(0)).when(gain[1] >= min_edge, bet(1))


def game_bets(
    games: DataFrame,
    markets: tuple[str, ...] = MARKETS,
    method: str = "power",
    min_edge: float = o.MIN_EDGE,
    fraction: float = o.KELLY_FRACTION,
    cap: float = o.MAX_BET_FRACTION,
) -> DataFrame:
    """Settled bets of every game.

    ``games`` has the keys, home_score, away_score, home_win_prob,
    predicted_margin, predicted_total and the prices home_ml, away_ml, spread,
    spread_home_odds, spread_away_odds, total, over_odds, under_odds; a missing
    price or prediction takes its default. Stakes are fractions of the bankroll.
    """
    defaults = {
        "home_win_prob": 0.5, "predicted_margin": 0.0, "predicted_total": o.BACKTEST_TOTAL_LINE,
        "spread": o.BACKTEST_SPREAD_LINE, "total": o.BACKTEST_TOTAL_LINE,
        "home_ml": o.LINE_ODDS, "away_ml": o.LINE_ODDS, "spread_home_odds": o.LINE_ODDS,
        "spread_away_odds": o.LINE_ODDS, "over_odds": o.LINE_ODDS, "under_odds": o.LINE_ODDS,
    }
    margin = F.col("home_score") - F.col("away_score")
    points = F.col("home_score") + F.col("away_score")
    cover = o.cover_normal(F.col("predicted_margin") - F.col("spread"), o.SPREAD_SIGMA)
    over = 1 - o.cover_normal(F.col("total") - F.col("predicted_total"), o.TOTAL_SIGMA)
    views = {
        "moneyline": (("home", "away"), F.col("home_win_prob"), ("home_ml", "away_ml"),
                      (margin > 0, margin <= 0), None),
        "spread": (("home", "away"), cover, ("spread_home_odds", "spread_away_odds"),
                   (margin > F.col("spread"), margin < F.col("spread")), 0.5),
        "total": (("over", "under"), over, ("over_odds", "under_odds"),
                  (points > F.col("total"), points < F.col("total")), 0.5),
    }
    filled = games.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})
    solved = filled.withColumns(
        {
            **{f"__p_{m}": views[m][1] for m in markets},
            **{f"__f_{m}": o.devig(*[F.col(c) for c in views[m][2]], method) for m in markets},
        }
    )

    def view(m: str) -> Column:
        _, _, prices, won, fallback = views[m]
        fair = [F.col(f"__f_{m}")["home"], F.col(f"__f_{m}")["away"]]
        if fallback is not None:
            fair = [F.coalesce(f, F.lit(fallback)) for f in fair]
        prob = (F.col(f"__p_{m}"), 1 - F.col(f"__p_{m}"))
        parts = []
        for i in (0, 1):
            parts += [
                prob[i].alias(f"prob{i}"), F.col(prices[i]).alias(f"price{i}"),
                fair[i].alias(f"fair{i}"), won[i].alias(f"won{i}"),
            ]
        return F.struct(*parts)

    kept = [c for c in games.columns if c not in {*defaults, "home_score", "away_score"}]
    offers = solved.select(*kept, *[view(m).alias(f"__{m}") for m in markets])
    bets = F.array(*[_best_side(m, views[m][0], min_edge, fraction, cap) for m in markets])
    return offers.select(*kept, F.explode(F.array_compact(bets)).alias("bet")).select(
        *kept, "bet.*"
    )


def signals(
    predictions: DataFrame,
    odds: DataFrame,
    min_edge: float = o.MIN_EDGE,
    fraction: float = o.KELLY_FRACTION,
    cap: float = o.MAX_BET_FRACTION,
) -> DataFrame:
    """Every side with enough edge over the devigged price; games without odds drop out.

    ``predictions`` has game_id, home_win_prob_adjusted, predicted_margin_adjusted,
    predicted_total_adjusted, confidence and injury_uncertainty.
    """
    priced = predictions.join(with_default_odds(odds), "game_id").withColumns(
        {
            "__ml": o.devig_power(F.col("home_ml"), F.col("away_ml")),
            "__sp": o.devig_power(F.col("spread_home_odds"), F.col("spread_away_odds")),
            "__to": o.devig_power(F.col("over_odds"), F.col("under_odds")),
            "__cover": o.cover_logistic(F.col("predicted_margin_adjusted") - F.col("spread_home")),
            "__over": o.cover_logistic(F.col("predicted_total_adjusted") - F.col("total")),
        }
    )
    win, cover, over = F.col("home_win_prob_adjusted"), F.col("__cover"), F.col("__over")
    nothing = F.lit(None).cast("double")
    sides = [
        ("moneyline", "home", nothing, win, "__ml.home", "home_ml"),
        ("moneyline", "away", nothing, 1 - win, "__ml.away", "away_ml"),
        ("spread", "home", F.col("spread_home"), cover, "__sp.home", "spread_home_odds"),
        ("spread", "away", -F.col("spread_home"), 1 - cover, "__sp.away", "spread_away_odds"),
        ("total", "over", F.col("total"), over, "__to.home", "over_odds"),
        ("total", "under", F.col("total"), 1 - over, "__to.away", "under_odds"),
    ]
    options = F.array(*[
        F.struct(
            F.lit(market).alias("bet_type"), F.lit(side).alias("side"),
            line.cast("double").alias("line"), prob.alias("model_prob"),
            F.col(fair).alias("market_prob"), F.col(price).alias("recommended_odds"),
        )
        for market, side, line, prob, fair, price in sides
    ])
    hit = priced.select(*predictions.columns, F.explode(options).alias("s")).select(
        *predictions.columns, "s.*"
    )
    gain = F.col("model_prob") - F.col("market_prob")
    size = o.kelly(
        F.col("model_prob"), F.col("recommended_odds"), F.col("market_prob"), fraction, cap, min_edge
    )
    return (
        hit.withColumn("edge", gain)
        .filter(F.col("edge") >= min_edge)
        .withColumns({
            "kelly_fraction": size["full_kelly"],
            "recommended_stake_pct": size["bet_fraction"],
            "signal_confidence": o.signal_confidence(
                F.col("edge"), F.col("confidence"), F.col("injury_uncertainty")
            ),
        })
    )


def strongest(found: DataFrame, k: int = 3) -> DataFrame:
    """Top k signals by edge."""
    return found.orderBy(F.desc("edge"), "game_id", "bet_type", "side").limit(k)
