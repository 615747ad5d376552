import pytest
from pyspark.sql import functions as F

from courtline.operators import plays as pl
from courtline.operators import stints as st

SCHEMA = (
    "game_id string, event_num int, period int, pc_time string, event_type int, home_description string, "
    "away_description string, player1_id bigint, player2_id bigint, team_id bigint, home_team_id bigint, away_team_id bigint"
)
HOME, AWAY = 10, 20


def play(n, left, kind, team=HOME, text=None, p1=None, p2=None, period=1, game="g"):
    home = text if team == HOME else None
    away = text if team == AWAY else None
    return (game, n, period, left, kind, home, away, p1, p2, team, HOME, AWAY)


@pytest.fixture(scope="module")
def plays(spark):
    opening = [play(i, "12:00", 10, HOME, "jump", i) for i in range(1, 6)]
    opening += [play(5 + i, "12:00", 10, AWAY, "jump", 10 + i) for i in range(1, 6)]
    rows = opening + [
        play(11, "11:00", 1, HOME, "3PT Jump Shot", 1),
        play(12, "10:40", 2, AWAY, "MISS Layup", 11),
        play(13, "10:38", 4, AWAY, "OFF Rebound", 11),
        play(14, "10:30", 3, AWAY, "Free Throw 1 of 2", 11),
        play(15, "10:30", 3, AWAY, "MISS Free Throw 2 of 2", 11),
        play(16, "10:00", 8, HOME, "SUB", 6, 1),
        play(17, "10:00", 8, AWAY, "SUB", 16, 11),
        play(18, "9:00", 1, AWAY, "Dunk", 12),
        play(19, "8:00", 5, HOME, "Bad Pass Turnover", 2),
        play(20, "0:00", 13, HOME, None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_stints(plays):
    got = sorted(st.derive_stints(plays, ["period"]).collect(), key=lambda r: r["stint_no"])
    assert [(r["start_sec"], r["end_sec"]) for r in got] == [(0, 120), (120, 720)]
    assert got[0]["home_lineup"] == [1, 2, 3, 4, 5] and got[1]["home_lineup"] == [2, 3, 4, 5, 6]
    assert got[1]["away_lineup"] == [12, 13, 14, 15, 16]
    assert (got[0]["home_points"], got[0]["away_points"]) == (3, 1)
    assert got[0]["possessions"] == pytest.approx(2 + 0.44 * 2 - 1)
    assert (got[1]["home_points"], got[1]["away_points"]) == (0, 2)
    assert got[1]["possessions"] == pytest.approx(2.0)
    assert [r["start_time"] for r in got] == ["12:00", "10:00"]


def test_too_few_starters_give_no_stints(plays):
    few = plays.filter("event_num > 3 AND event_num <> 19")
    assert st.derive_stints(few, ["period"]).count() == 0


def test_last_edit_wins(spark, plays):
    """Out and straight back in during one stoppage leaves the lineup as it was."""
    extra = spark.createDataFrame(
        [play(21, "5:00", 8, HOME, "SUB", 7, 2), play(22, "5:00", 8, HOME, "SUB", 2, 7), play(23, "1:00", 1, HOME, "Layup", 2)],
        SCHEMA,
    )
    got = st.derive_stints(plays.unionByName(extra), ["period"]).orderBy("stint_no").collect()
    assert got[-1]["home_lineup"] == [2, 3, 4, 5, 6] and got[-1]["start_sec"] == 420


def test_half_open_counts_boundary_once(spark, plays):
    extra = spark.createDataFrame([play(0, "12:00", 1, HOME, "Layup", 1)], SCHEMA)
    both = plays.unionByName(extra)
    closed = st.derive_stints(both, ["period"]).agg(F.sum("possessions")).first()[0]
    half = st.derive_stints(both, ["period"], half_open=True).agg(F.sum("possessions")).first()[0]
    assert closed == pytest.approx(half)  # the boundary play is a substitution


def test_inferred_teams(plays):
    row = st.infer_teams(plays.drop("home_team_id", "away_team_id")).first()
    assert (row["home_team_id"], row["away_team_id"]) == (HOME, AWAY)


def test_shot_clock(spark):
    rows = [
        play(1, "12:00", 4), play(2, "11:55", 1), play(3, "11:45", 2), play(4, "11:35", 2),
        play(5, None, 4), play(6, "11:30", 1), play(7, "10:00", 9), play(8, "11:59", 1, period=2),
    ]
    out = pl.shot_clock(spark.createDataFrame(rows, SCHEMA), ["period"])
    got = {r["event_num"]: r["shot_clock_category"] for r in out.collect()}
    assert got == {1: "unknown", 2: "early", 3: "mid", 4: "late", 5: "unknown", 6: "late", 7: "unknown", 8: "unknown"}


def test_even_sample_matches_numpy(spark):
    import numpy as np

    for n in (3, 10, 11, 37, 100):
        df = spark.range(n).selectExpr("'g' AS game_id", "cast(id AS int) AS event_num", "1 AS period")
        got = sorted(r["event_num"] for r in pl.even_sample(df, ["period"], 10).collect())
        want = list(range(n)) if n <= 10 else np.linspace(0, n - 1, 10, dtype=int).tolist()
        assert got == want


def test_token_sequence_is_padded(spark, plays):
    scored = plays.withColumns({"score_home": F.when(F.col("event_num") == 11, 3), "score_away": F.when(F.col("event_num") == 11, 0)})
    stints = st.derive_stints(plays, ["period"])
    row = pl.token_sequences(scored, stints, ["period"], 30).first()
    assert all(len(row[c]) == 30 for c in ("event", "time", "score", "players", "mask"))
    assert row["mask"].count(True) == 10 and row["event"][10] == 1 and row["event"][25] == 0
    assert row["score"][10] == pytest.approx(3 / 8.5) and row["score"][9] == 0.0
    assert row["players"][11] == [1, 2, 3, 4, 5, 11, 12, 13, 14, 15]
    assert row["players"][18] == [2, 3, 4, 5, 6, 12, 13, 14, 15, 16]
