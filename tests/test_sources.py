import json

import pytest
from pyspark.sql import functions as F

from courtline.operators import jobs, quality
from courtline.sources import maintenance as mt
from courtline.sources import payloads, schemas, teams
from courtline.streaming import increments as inc


def write(path, documents):
    path.mkdir()
    for i, d in enumerate(documents):
        (path / f"{i}.json").write_text(json.dumps(d, indent=1))
    return str(path)


def doc(name, headers, rows):
    return {"resource": "x", "resultSets": [{"name": "Other", "headers": ["A"], "rowSet": [[1]]}, {"name": name, "headers": headers, "rowSet": rows}]}


def test_game_finder_files(spark, tmp_path):
    head = ["TEAM_ID", "GAME_ID", "GAME_DATE", "MATCHUP", "WL", "PTS", "PLUS_MINUS"]
    path = write(tmp_path / "f", [doc("LeagueGameFinderResults", head, [
        [1, "001", "2024-01-05", "AAA vs. BBB", "W", 110, 8.0], [2, "001", "2024-01-05", "BBB @ AAA", "L", 102, -8.0],
        [3, "002", "2023-11-05", "", None, None, -3], [4, "002", "2023-11-05", "", None, 99, 3], [5, "003", "2024-01-05", "CCC @ DDD", "W", 1, 1],
    ])])
    rows = payloads.read_result_set(spark, path, payloads.SET_NAMES["games"])
    got = {r["game_id"]: r for r in payloads.games(rows).collect()}
    assert set(got) == {"001", "002"}
    assert (got["001"]["home_team_id"], got["001"]["home_score"], got["001"]["status"]) == (1, 110, "completed")
    assert (got["002"]["home_team_id"], got["002"]["away_score"], got["002"]["status"]) == (4, None, "scheduled")
    assert got["001"]["season_id"] == "2023-24"


def test_play_and_shot_files(spark, tmp_path):
    head = ["GAME_ID", "EVENTNUM", "PERIOD", "PCTIMESTRING", "EVENTMSGTYPE", "HOMEDESCRIPTION", "SCORE", "PLAYER1_ID", "PLAYER1_TEAM_ID"]
    path = write(tmp_path / "p", [doc("PlayByPlay", head, [["g", 2, 1, " 11:30 ", 1, "Jumper", "2 - 5", 77, 9], ["g", 3, 1, None, 4, "", None, 0, None]])])
    a, b = payloads.plays(payloads.read_result_set(spark, path, "PlayByPlay")).orderBy("event_num").collect()
    assert (a["pc_time"], a["score_home"], a["score_away"], a["player1_id"]) == ("11:30", 5, 2, 77)
    assert b["pc_time"] is None and b["home_description"] is None and b["player1_id"] is None
    head = ["GAME_ID", "PLAYER_ID", "TEAM_ID", "SHOT_TYPE", "LOC_X", "LOC_Y", "SHOT_MADE_FLAG"]
    path = write(tmp_path / "s", [doc("Shot_Chart_Detail", head, [["g", 1, 2, "3PT Field Goal", -5, 7, 1], ["g", None, 2, "x", 0, 0, 0], ["g", 1, 2, "2PT Field Goal", 1, 1, 0]])])
    got = payloads.shots(payloads.read_result_set(spark, path, "Shot_Chart_Detail")).collect()
    assert sorted((r["shot_type"], r["loc_x"], r["made"]) for r in got) == [("2PT", 1, False), ("3PT", -5, True)]


def test_error_policies(spark, tmp_path):
    p = tmp_path / "rows.json"
    p.write_text('{"a": 1}\n{broken\n{"a": 2}\n')
    good, bad = payloads.read_landed(spark, str(p), "a int", "log")
    assert sorted(r["a"] for r in good.collect()) == [1, 2] and bad.count() == 1
    skipped, _ = payloads.read_landed(spark, str(p), "a int", "skip")
    assert sorted(r["a"] for r in skipped.collect()) == [1, 2]
    failing, _ = payloads.read_landed(spark, str(p), "a int", "raise")
    with pytest.raises(Exception):
        failing.collect()
    with pytest.raises(ValueError):
        payloads.read_landed(spark, str(p), "a int", "other")


def test_collection_counts_as_it_stores(spark, tmp_path):
    p = tmp_path / "rows.json"
    p.write_text('{"a": 1}\n{broken\n{"a": 2}\n{"a": "x"}\n')
    want = {"lines": 4, "kept": 2, "dropped": 2}
    for policy in ("log", "skip"):
        target = str(tmp_path / policy)
        assert payloads.collect_landed(spark, str(p), "a int", target, policy) == want
        rows = spark.read.parquet(target)
        assert sorted(r["a"] for r in rows.filter("outcome = 'kept'").select("r.a").collect()) == [1, 2]
        lines = [r["line"] for r in rows.filter("outcome = 'quarantine'").collect()]
        assert sorted(lines) == (['{"a": "x"}', "{broken"] if policy == "log" else [])
    with pytest.raises(Exception):
        payloads.collect_landed(spark, str(p), "a int", str(tmp_path / "raise"), "raise")
    with pytest.raises(ValueError):
        payloads.collect_landed(spark, str(p), "a int", str(tmp_path / "x"), "other")


def test_sketches_of_loads_equal_a_full_build(spark, tmp_path):
    rows = spark.range(60_000).selectExpr("id % 3 season", "id % 4 load", "id % 20011 game")
    loads = quality.distinct_sketches(rows, ["season", "load"], "game")
    loads.filter("load < 3").write.parquet(str(tmp_path / "s"))
    loads.filter("load = 3").write.mode("append").parquet(str(tmp_path / "s"))  # an increment
    grown = quality.distinct_estimates(quality.merged_sketches(spark.read.parquet(str(tmp_path / "s")), ["season"]), ["season"])
    whole = quality.distinct_estimates(quality.merged_sketches(loads, ["season"]), ["season"])
    assert sorted(map(tuple, grown.collect())) == sorted(map(tuple, whole.collect()))
    for r in grown.collect():
        exact = rows.filter(f"season = {r['season']}").select("game").distinct().count()
        assert abs(r["estimate"] - exact) <= 0.03 * exact


def test_stored_buckets_join_without_an_exchange(spark, tmp_path):
    plays = spark.range(4_000).selectExpr("id % 250 game_id", "id event_num", "id * 2 v")
    games = spark.range(240).selectExpr("id game_id", "id % 3 season")
    facts = mt.join_stored(
        mt.store_bucketed(plays, str(tmp_path / "plays"), "game_id", ["event_num"], 6),
        mt.store_bucketed(games, str(tmp_path / "games"), "game_id", [], 6), "game_id",
    )
    plan = facts._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    per_game = facts.groupBy("game_id", "season").count()
    assert "Exchange" not in per_game._jdf.queryExecution().executedPlan().toString()
    assert facts.count() == 240 * 16 and per_game.count() == 240


def test_late_rows_complete_finished_windows(spark, tmp_path):
    """In any order of the files the windows are those of a batch; a replayed batch changes nothing."""
    schema = "k string, ts timestamp, v int"
    rows = spark.createDataFrame([("a" if i % 3 else "b", i * 7200, i) for i in range(400)], "k string, t bigint, v int").selectExpr("k", "timestamp_seconds(t) ts", "v")
    sums = {"n": F.count(F.lit(1)), "v": F.sum("v")}
    reduce = lambda r: inc.rolling_sums(r, "ts", ["k"], sums, "2 days", None)
    want = sorted(map(tuple, inc.merged_sums(reduce(rows), ["k"], ["n", "v"]).collect()))
    for order in ((0, 1, 2), (2, 0, 1)):
        root = str(tmp_path / "".join(map(str, order)))
        for part in order:
            rows.filter(f"v >= {part} * 150 and v < ({part} + 1) * 150").coalesce(1).write.mode("append").parquet(f"{root}/in")
            stream = inc.file_stream(spark, f"{root}/in", spark.createDataFrame([], schema).schema)
            inc.collect_bounded(stream, "ts", "2 days", reduce, "1 day", f"{root}/out", f"{root}/progress")
        late = spark.read.parquet(f"{root}/out/late")
        both = spark.read.parquet(f"{root}/out/shares").unionByName(late)
        assert sorted(map(tuple, inc.merged_sums(both, ["k"], ["n", "v"]).collect())) == want
        behind = late.agg(F.sum("n")).first()[0]
        assert behind is None if order == (0, 1, 2) else behind > 200


def test_team_dimension(spark):
    rows = teams.team_dimension(spark).collect()
    assert len(rows) == 30 and len({r["abbreviation"] for r in rows}) == 30


def frame(spark, rows):
    return spark.createDataFrame(rows, "season_id string, game_id string, v int, at int")


def table(spark, path):
    return {r["game_id"]: (r["season_id"], r["v"]) for r in spark.read.parquet(path).collect()}


def test_upsert_replace_repair(spark, tmp_path):
    path = str(tmp_path / "t")
    put = lambda rows: mt.upsert_table(path, frame(spark, rows), ["game_id"], ["at"], "season_id")
    put([("s1", "a", 1, 1), ("s1", "b", 1, 1), ("s2", "c", 1, 1)])
    put([("s1", "a", 5, 1), ("s1", "a", 9, 2), ("s1", "d", 3, 1)])
    want = {"a": ("s1", 9), "b": ("s1", 1), "c": ("s2", 1), "d": ("s1", 3)}
    assert table(spark, path) == want
    assert not mt.replace_partitions(path, frame(spark, [("s2", "z", 0, 0)]), "season_id", force=False)
    assert table(spark, path) == want
    assert mt.replace_partitions(path, frame(spark, [("s2", "z", 0, 0)]), "season_id")
    assert table(spark, path) == {"a": ("s1", 9), "b": ("s1", 1), "d": ("s1", 3), "z": ("s2", 0)}
    ids = spark.createDataFrame([("s1", "a"), ("s1", "b")], "season_id string, game_id string")
    mt.repair_games(path, ids, frame(spark, [("s1", "a", 7, 7)]), "season_id")
    assert table(spark, path) == {"a": ("s1", 7), "d": ("s1", 3), "z": ("s2", 0)}


def test_archive_and_json(spark, tmp_path):
    rows = lambda v: spark.createDataFrame([("d1", "g", v)], "prediction_date string, game_id string, p double")
    mt.archive_predictions(str(tmp_path / "h"), rows(0.1))
    mt.archive_predictions(str(tmp_path / "h"), rows(0.2))
    assert [r["p"] for r in spark.read.parquet(str(tmp_path / "h")).collect()] == [0.2]
    mt.write_json(str(tmp_path / "j"), rows(0.3))
    back = mt.read_json(spark, str(tmp_path / "j"), rows(0.3).schema)
    assert back.first()["p"] == 0.3


def test_load_history_then_update(spark, tmp_path):
    root = str(tmp_path)
    games = spark.createDataFrame([("g", "s", 10, 20, "completed")], "game_id string, season_id string, home_team_id bigint, away_team_id bigint, status string")
    rows = [("g", i, 1, "12:00", 10, "j", None, i, None, 10) for i in range(1, 6)]
    rows += [("g", 5 + i, 1, "12:00", 10, None, "j", 10 + i, None, 20) for i in range(1, 6)]
    rows += [("g", 11, 1, "6:00", 1, "Layup", None, 1, None, 10), ("g", 12, 1, "0:00", 13, None, None, None, None, 10)]
    plays = spark.createDataFrame(rows, "game_id string, event_num int, period int, pc_time string, event_type int, home_description string, away_description string, player1_id bigint, player2_id bigint, team_id bigint")
    for _ in range(2):
        jobs.load_history({"games": games, "plays": plays}, root)
    assert spark.read.parquet(f"{root}/plays").count() == 12
    stint = spark.read.parquet(f"{root}/stints").collect()
    assert len(stint) == 1 and stint[0]["home_points"] == 2 and stint[0]["duration_seconds"] == 720


def test_schemas_parse(spark):
    assert set(schemas.DDL) == set(schemas.NATURAL_KEYS)
    for name, keys in schemas.NATURAL_KEYS.items():
        assert set(keys) <= set(schemas.schema(name).fieldNames())


def test_stream_resumes_and_equals_batch(spark, tmp_path):
    src, out, progress = (str(tmp_path / n) for n in ("src", "out", "progress"))
    rows = spark.range(40).select(
        F.col("id").cast("string").alias("game_id"), F.when(F.col("id") % 2 == 0, "s1").otherwise("s2").alias("season_id"),
        F.when(F.col("id") % 5 != 0, "completed").otherwise("scheduled").alias("status"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 3600).alias("played_at"),
    )

    def run():
        stream = inc.new_completed_games(inc.file_stream(spark, src, rows.schema))
        inc.upsert_stream(stream, out, ["game_id"], ["played_at"], "season_id", progress).awaitTermination()
        return spark.read.parquet(out).count()

    rows.filter("cast(game_id AS int) < 20").coalesce(1).write.parquet(src)
    assert run() == 16
    rows.coalesce(1).write.mode("append").parquet(src)
    assert run() == 32
    assert run() == 32
    done = spark.read.parquet(out)
    assert inc.unprocessed(rows.filter("status = 'completed'"), done).count() == 0


def test_stream_reads_a_file_or_a_folder(spark, tmp_path):
    from courtline import catalog

    given = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    given.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    for name in ("rolling_event_metrics", "event_sessions", "closing_lines", "streamed_new_games"):
        run = catalog.entries()[name].run
        one, parts = (sorted(map(str, run(spark, d).collect())) for d in ("/root/testdata/sf0.001", str(tmp_path)))
        assert one and one == parts


def test_shares_of_batches_add_up(spark, tmp_path):
    src = str(tmp_path / "src")
    rows = [("a", t) for t in (0, 50, 90, 400, 1000)] + [("b", t) for t in (10, 300, 120)]
    for key, t in rows:  # one file and so one batch each, late ones last
        spark.createDataFrame([(key, t)], "k string, t bigint").selectExpr("k", "timestamp_seconds(t) AS ts").coalesce(1).write.mode("append").parquet(src)
    stream = inc.file_stream(spark, src, spark.read.parquet(src).schema, files_per_batch=1)
    inc.collect_shares(stream, lambda e: inc.sessions(e, "ts", ["k"], "100 seconds"), str(tmp_path / "s"), str(tmp_path / "p1"))
    got = inc.merged_sessions(spark.read.parquet(str(tmp_path / "s")), ["k"])
    assert spark.read.parquet(str(tmp_path / "s")).select("batch").distinct().count() == len(rows)
    want = inc.sessions(spark.read.parquet(src), "ts", ["k"], "100 seconds")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))


def test_history_keeps_stored_rows_and_moves_changed_ones(spark, tmp_path):
    root = str(tmp_path)
    games = lambda *rows: spark.createDataFrame(list(rows), "game_id string, season_id string, home_team_id bigint, away_team_id bigint, status string, loaded_at int")
    players = lambda *rows: spark.createDataFrame(list(rows), "player_id bigint, full_name string, loaded_at int")
    jobs.load_history({"games": games(("g1", "s1", 1, 2, "completed", 1), ("g2", "s2", 1, 2, "scheduled", 1)), "players": players((1, "A", 1), (2, "B", 1))}, root)
    jobs.load_history({"games": games(("g2", "s1", 1, 2, "completed", 2), ("g3", "s3", 1, 2, "x", 1), ("g3", "s3", 1, 2, "y", 2)), "players": players((2, "b", 2), (4, "D", 2))}, root)
    assert {(r["player_id"], r["full_name"]) for r in spark.read.parquet(f"{root}/players").collect()} == {(1, "A"), (2, "b"), (4, "D")}
    got = [(r["game_id"], r["season_id"], r["status"]) for r in spark.read.schema(games(("g", "s", 1, 2, "x", 1)).schema).parquet(f"{root}/games").collect()]
    assert sorted(got) == [("g1", "s1", "completed"), ("g2", "s1", "completed"), ("g3", "s3", "y")]
