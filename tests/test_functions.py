import math

import pytest
from pyspark.sql import functions as F

from courtline.functions import availability as av
from courtline.functions import clock, misc, odds, text

L = F.lit


@pytest.mark.parametrize(
    "period, left, want",
    [(1, "12:00", 0), (1, "0:00", 720), (2, "6:30", 720 + 330), (4, "0:00", 2880), (5, "5:00", 2880), (6, "2:30", 3330), (1, "bad", 720), (1, "1:2:3", 720)],
)
def test_elapsed_seconds(one, period, left, want):
    assert one(clock.elapsed_seconds(L(period), L(left))) == want


def test_clock_texts(one):
    assert one(clock.minutes_played(L("34:30"))) == 34.5
    assert one(clock.minutes_played(L("12.25"))) == 12.25
    assert one(clock.minutes_played(L("DNP"))) is None
    assert one(clock.height_inches(L("6-8"))) == 80
    assert one(clock.height_inches(L("tall"))) is None
    assert str(one(clock.birth_date(L("MAR 03, 1998")))) == "1998-03-03"
    assert tuple(one(clock.score_pair(L("98 - 101")))) == (101, 98)
    assert tuple(one(clock.score_pair(L("TIE")))) == (None, None)
    assert one(clock.season_label(L("2023-10-01").cast("date"))) == "2023-24"
    assert one(clock.season_label(L("2000-03-01").cast("date"))) == "1999-00"
    assert one(clock.time_remaining(L(1), L("12:00"))) == 1.0
    assert one(clock.time_remaining(L(5), L("x"))) == 0.25


@pytest.mark.parametrize(
    "body, kind",
    [("Bad Pass Turnover", "unforced"), ("traveling", "unforced"), ("Lost Ball (STL)", "forced"), ("Out of Bounds Lost Ball", "unforced"), ("jump ball", "unknown"), (None, "unknown")],
)
def test_turnover_type(one, body, kind):
    assert one(text.turnover_type(L(body).cast("string"))) == kind


@pytest.mark.parametrize(
    "body, kind",
    [("Driving Layup", "driving"), ("Driving Dunk", "dunk"), ("tip-in", "tip"), ("Pull Up", "pullup"), ("Step-Back 3PT", "stepback"), ("Finger Roll", "layup"), ("Turnaround Hook", "hook"), ("C&S three", "catch_shoot"), ("pass", "other"), (None, "other")],
)
def test_shot_type(one, body, kind):
    assert one(text.shot_type(L(body).cast("string"))) == kind


def test_references_and_combination(one):
    refs = text.player_references(L("MISS Jones 3PT (Assist: Al Baker) (BLK: Clark)"))
    assert one(refs) == ["Al Baker", "Clark", "Jones"]
    assert one(text.player_references(L("SUB: Davis FOR Evans"))) == ["Davis", "Evans"]
    assert one(text.player_references(L("Free Throw 1"))) == []
    assert one(text.combined_description(L("a"), L(""), L("c"))) == "a | c"


@pytest.mark.parametrize("a, b", [(1.91, 1.91), (1.5, 2.8), (1.2, 5.0), (2.05, 1.8)])
@pytest.mark.parametrize("method", ["multiplicative", "power", "shin"])
def test_devig_sums_to_one(one, a, b, method):
    fair = one(odds.devig(L(a), L(b), method))
    assert math.isclose(fair["home"] + fair["away"], 1.0, abs_tol=1e-9)
    assert math.isclose(fair["vig"], 1 / a + 1 / b - 1, abs_tol=1e-12)
    if a == b:
        assert math.isclose(fair["home"], 0.5, abs_tol=1e-9)


def test_devig_edges(one):
    assert one(odds.devig(L(0.9), L(2.0))) is None
    assert one(odds.devig_power(L(1.1), L(1.1))) is None
    k = one(odds.power_exponent(L(1.5), L(2.8)))
    assert math.isclose((1 / 1.5) ** k + (1 / 2.8) ** k, 1.0, abs_tol=1e-12)
    with pytest.raises(ValueError):
        odds.devig(L(2.0), L(2.0), "none")


@pytest.mark.parametrize("z", [-8.0, -3.2, -1.0, -0.1, 0.0, 0.4, 1.96, 5.0])
def test_normal_cdf(one, z):
    assert math.isclose(one(odds.normal_cdf(L(z))), 0.5 * math.erfc(-z / math.sqrt(2)), abs_tol=1e-13)


def test_kelly(one):
    bet = one(odds.kelly(L(0.55), L(2.0)))
    assert math.isclose(bet["full_kelly"], 0.1) and math.isclose(bet["bet_fraction"], 0.02)
    assert bet["has_edge"] and math.isclose(bet["adjusted_kelly"], 0.025)
    assert not one(odds.kelly(L(0.5), L(2.0)))["has_edge"]
    assert one(odds.min_odds(L(0.01))) == math.inf
    assert math.isclose(one(odds.american_to_decimal(L(-110))), 1 + 100 / 110)
    assert one(odds.decimal_to_american(L(2.5))) == 150
    assert one(odds.decimal_to_american(L(1.909))) == -110


def test_geography_and_lineups(one):
    miles = one(misc.haversine_miles(L(42.3662), L(-71.0621), L(34.0430), L(-118.2673)))
    assert 2550 < miles < 2650
    import hashlib

    assert one(misc.lineup_hash(F.array(*[L(i) for i in (5, 3, 1, 4, 2)]))) == hashlib.sha256(b"1,2,3,4,5").hexdigest()[:16]
    assert one(misc.player_bucket(L(9999))) == 1 and one(misc.player_bucket(L(0))) == 0
    assert one(misc.event_token(L(77))) == 14
    top = F.array(*[F.struct(L(n).alias("name"), L(v).alias("value")) for n, v in [("a", 1.0), ("b", -5.0), ("c", 3.0)]])
    assert [r["name"] for r in one(misc.top_factors(top, 2))] == ["b", "c"]


@pytest.mark.parametrize(
    "status, normal", [("O", "out"), ("Game Time Decision", "questionable"), ("Out (knee)", "out"), ("???", "questionable"), ("Active", "available")]
)
def test_status(one, status, normal):
    assert one(av.normal_status(L(status))) == normal


def test_play_probability(one):
    p = one(av.play_probability(L("Questionable"), L("sore knee"), av.context_modifier({"back_to_back": L(True), "tanking": L(False)})))
    assert math.isclose(p, 0.55 * 0.95 * 0.85)
    assert one(av.play_probability(L("available"), L("finger"))) == 1.0
    assert math.isclose(one(av.replacement_impact(L(4.0))), 0.018)
    assert math.isclose(one(av.replacement_impact(L(4.0), L(7), L(None).cast("double"))), 0.015)
