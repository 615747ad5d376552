"""Chunked windows against plain ones, with one key holding most rows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from courtline.operators.ordered import as_of, interval_join, running


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    data = [
        ("hot" if i % 3 else f"k{i % 5}", rng.randrange(6), rng.randrange(4), i, rng.choice([None, *range(9)]))
        for i in range(400)
    ]
    return spark.createDataFrame(data, "key string, day int, part int, id int, v int")


@pytest.mark.parametrize("keys", [["key"], []])
@pytest.mark.parametrize("levels", [["day"], ["day", "part"]])
@pytest.mark.parametrize("inclusive", [True, False])
def test_running_equals_plain_window(rows, keys, levels, inclusive):
    order = [*levels, "id"]
    got = running(
        rows, keys, levels, ["id"], rank="n", sums={"s": F.coalesce("v", F.lit(0))},
        maxes={"m": F.col("v")}, lasts={"l": F.col("v")}, inclusive=inclusive,
    )
    w = Window.partitionBy(*keys).orderBy(*order)
    frame = w.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    want = rows.select(
        "*", F.row_number().over(w).alias("n"),
        F.coalesce(F.sum(F.coalesce("v", F.lit(0))).over(frame), F.lit(0)).alias("s"),
        F.max("v").over(frame).alias("m"), F.last("v", True).over(frame).alias("l"),
    )
    cols = ["id", "n", "s", "m", "l"]
    assert sorted(map(tuple, got.select(cols).collect()), key=repr) == sorted(map(tuple, want.select(cols).collect()), key=repr)


def test_running_ignores_input_partitioning(rows):
    sums = lambda df: sorted(map(tuple, running(df, ["key"], ["day"], ["id"], sums={"s": F.col("id")}).select("id", "s").collect()))
    assert sums(rows.repartition(1)) == sums(rows.repartition(13, "id"))


def test_as_of_is_strict(spark):
    left = spark.createDataFrame([("a", 5, 1), ("a", 3, 2), ("b", 9, 3), ("a", 1, 4)], "k string, t int, id int")
    right = spark.createDataFrame([("a", 1, 10.0), ("a", 3, 30.0), ("a", 4, 40.0)], "k string, t int, v double")
    level = {"chunk": F.floor(F.col("__t") / 2)}
    strict = as_of(left, right, ["k"], "t", "t", ["v"], level)
    assert dict(strict.select("id", "matched.v").collect()) == {1: 40.0, 2: 10.0, 3: None, 4: None}
    loose = as_of(left, right, ["k"], "t", "t", ["v"], level, strict=False)
    assert dict(loose.select("id", "matched.v").collect()) == {1: 40.0, 2: 30.0, 3: None, 4: 10.0}


def test_interval_join_takes_first(spark):
    points = spark.createDataFrame([(1, 1, 50), (1, 2, 100), (1, 3, 500), (2, 4, 50)], "g int, id int, t int")
    spans = spark.createDataFrame([(1, 0, 0, 100), (1, 1, 100, 300)], "g int, no int, lo int, hi int")
    out = interval_join(points, spans, ["g"], "t", "lo", "hi", 64, ["no"], ["lo"])
    assert dict(out.select("id", "matched.no").collect()) == {1: 0, 2: 0, 3: None, 4: None}
    plan = out._jdf.queryExecution().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("width", [5, 64, 1000])
def test_interval_join_equals_brute_force(spark, width):
    rng = random.Random(width)
    # points and bounds in halves, many at equal places; intervals nest, overlap, touch and end before they start
    points = [(rng.randrange(3), i, rng.randrange(400) / 2) for i in range(500)] + [(0, 900, None), (9, 901, 1.0)]
    spans = []
    for i in range(120):
        low = rng.randrange(400) / 2
        spans.append((rng.randrange(3), rng.randrange(40), low, low + rng.randrange(-2, 60) / 2, i))
    out = interval_join(
        spark.createDataFrame(points, "g int, id int, t double"), spark.createDataFrame(spans, "g int, no int, lo double, hi double, v int"),
        ["g"], "t", "lo", "hi", width, ["no", "v"], ["lo"],
    )
    got = {r["id"]: r["matched"] and tuple(r["matched"]) for r in out.collect()}
    for g, i, t in points:
        hits = [(no, v, lo) for h, no, lo, hi, v in spans if h == g and t is not None and lo <= t <= hi]
        assert got.pop(i) == (min(hits) if hits else None)
    assert not got


def test_interval_join_of_one_hot_value(spark):
    points = spark.range(5_000).select(F.lit(1).alias("g"), "id", F.lit(7).alias("t"))
    spans = spark.createDataFrame([(1, n, 0, 10 + n) for n in range(30)], "g int, no int, lo int, hi int")
    out = interval_join(points, spans, ["g"], "t", "lo", "hi", 64, ["no"], [])
    assert out.groupBy("matched.no").count().collect()[0] == (0, 5_000)
