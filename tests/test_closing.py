"""Closing lines with keyed state: batches, late quotes and a replay."""

import datetime as dt
import os

from courtline.streaming import closing
from courtline.streaming import increments as inc

QUOTES = "game_id bigint, source string, quoted_at timestamp, price double, tip_off timestamp"


def at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


BATCHES = [
    [(1, "a", at(1), 1.5, at(10)), (1, "a", at(5), 1.6, at(10)), (2, "a", at(2), 2.0, at(50))],
    [(1, "a", at(9), 1.7, at(10)), (1, "a", at(9), 1.8, at(10)), (1, "a", at(11), 9.9, at(10)), (2, "a", at(30), 2.1, at(50))],
    [(9, "z", at(40), 5.0, at(500))],
    [(1, "a", at(45), 7.0, at(10)), (9, "z", at(100), 5.5, at(500))],
    [(9, "z", at(110), 5.6, at(500))],
]


def test_lines_close_once_and_late_quotes_go_aside(spark, tmp_path):
    landed, table, progress = (str(tmp_path / n) for n in ("landed", "lines", "progress"))
    for batch in BATCHES:
        spark.createDataFrame(batch, QUOTES).coalesce(1).write.mode("append").parquet(landed)
        stream = inc.file_stream(spark, landed, spark.createDataFrame([], QUOTES).schema)
        closing.store_lines(closing.closed_lines(stream, "5 minutes"), table, progress)
    closed, late = closing.split(spark.read.parquet(table))
    assert sorted((r["game_id"], r["quoted_at"], r["price"]) for r in closed.collect()) == [(1, at(9), 1.8), (2, at(30), 2.1)]
    assert sorted((r["game_id"], r["price"]) for r in late.collect()) == [(1, 7.0), (1, 9.9)]
    before = spark.read.parquet(table).count()
    # a driver lost before the last commit runs that batch again
    commits = f"{progress}/commits"
    newest = max(int(n) for n in os.listdir(commits) if n.isdigit())
    for name in (str(newest), f".{newest}.crc"):
        if os.path.exists(f"{commits}/{name}"):
            os.remove(f"{commits}/{name}")
    closing.store_lines(closing.closed_lines(stream, "5 minutes"), table, progress)
    assert spark.read.parquet(table).count() == before


class Calls:
    """A key's state that counts the calls; each is a round trip to the JVM."""

    def __init__(self):
        self.value, self.calls, self.timers = None, [], []

    def getValueState(self, *_):
        return self

    def registerTimer(self, at):
        self.timers.append(at)

    def exists(self):
        self.calls.append("exists")
        return self.value is not None

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value

    def clear(self):
        self.calls.append("clear")
        self.value = None


def test_a_batch_looks_at_the_state_of_a_key_once():
    import pandas as pd

    state, line = Calls(), closing.ClosingLine()
    line.init(state)
    frames = [pd.DataFrame(b, columns=["game_id", "source", "quoted_at", "price", "tip_off"]) for b in BATCHES[:2]]
    frames = [f[f["game_id"] == 1] for f in frames]
    assert list(line.handleInputRows((1, "a"), iter(frames[:1]), None)) == []
    assert state.calls == ["get", "update"] and len(state.timers) == 1
    late = list(line.handleInputRows((1, "a"), iter(frames[1:]), None))
    assert [x["price"].tolist() for x in late] == [[9.9]] and state.value == (at(9), 1.8, at(10))
    before = len(state.calls)
    assert list(line.handleInputRows((1, "a"), iter(frames[:1]), None)) == []
    assert state.calls[before:] == ["get"] and len(state.timers) == 1  # nothing new, nothing written
    closed = list(line.handleExpiredTimer((1, "a"), None, None))
    assert [x.values.tolist() for x in closed] == [[[1, "a", "closed", pd.Timestamp(at(9)), 1.8, pd.Timestamp(at(10))]]]
    assert state.value is None and list(line.handleExpiredTimer((1, "a"), None, None)) == []


def test_lines_of_a_bucket_are_those_of_each_line(spark, tmp_path):
    """Several lines a state, closing at different times, late and tied quotes, a tip-off that moves, a null source."""
    import random

    draw = random.Random(5)
    rows = []
    for _ in range(400):
        game, minute = draw.randrange(12), draw.randrange(300)
        tip = at(20 * game + (30 if game == 7 and minute > 60 else 0) + draw.choice([0, 0.25]) * (game == 3))
        rows.append((game, draw.choice(["a", "b", None]), at(minute), float(draw.randrange(4)), tip))
    rows.sort(key=lambda r: r[2])
    found = {}
    for buckets in (None, 2):
        landed, table, progress = (str(tmp_path / f"{n}-{buckets}") for n in ("landed", "lines", "progress"))
        for k in range(4):
            spark.createDataFrame(rows[k * 100 : k * 100 + 100], QUOTES).coalesce(1).write.mode("append").parquet(landed)
            stream = inc.file_stream(spark, landed, spark.createDataFrame([], QUOTES).schema)
            closing.store_lines(closing.closed_lines(stream, "40 minutes", buckets), table, progress)
        found[buckets] = sorted(map(str, spark.read.parquet(table).collect()))
    assert found[2] == found[None]
    assert sum("closed" in r for r in found[2]) > 20 and sum("late" in r for r in found[2]) > 100


class Lists(Calls):
    def getListState(self, *_):
        return self

    def get(self):
        self.calls.append("get")
        return iter(self.value or ())

    def put(self, value):
        self.calls.append("put")
        self.value = value


class Passed:
    def __init__(self, time):
        self.time = time

    def getCurrentWatermarkInMs(self):
        return int(self.time.replace(tzinfo=dt.UTC).timestamp() * 1000)


def test_a_bucket_is_read_and_written_once_for_all_its_lines():
    import pandas as pd

    state, lines = Lists(), closing.ClosingLines()
    lines.init(state)
    frame = pd.DataFrame([(g, "a", at(1), float(g), at(10 + g)) for g in range(100)], columns=[*closing.LINE, "quoted_at", "price", "tip_off"])
    assert list(lines.handleInputRows((0,), iter([frame[:60], frame[60:]]), None)) == []
    assert state.calls == ["get", "put"] and len(state.value) == 100 and len(state.timers) == 1
    assert list(lines.handleInputRows((0,), iter([frame.assign(quoted_at=at(0))]), None)) == []
    assert state.calls[2:] == ["get"] and len(state.timers) == 1  # nothing new, nothing written
    (closed,) = lines.handleExpiredTimer((0,), Passed(at(40)), None)
    assert closed["price"].tolist() == [float(g) for g in range(30)] and len(state.value) == 70
    assert state.calls[3:] == ["get", "put"] and len(state.timers) == 2
    (closed,) = lines.handleExpiredTimer((0,), Passed(at(400)), None)
    assert len(closed) == 70 and state.value is None
