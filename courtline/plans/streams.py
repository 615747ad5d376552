"""Streaming jobs over the event files, compared with the same sums in batch."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from courtline.plans import bindings as b
from courtline.plans.registry import query
from courtline.session import ensure_checkpoint_dir
from courtline.streaming import closing
from courtline.streaming import increments as inc


def _folders(spark) -> tuple[str, str]:
    """Fresh table and progress folders in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    root = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    return f"{root}/table", f"{root}/progress"


def _events(spark, sf_dir):
    schema = b.table(spark, sf_dir, "events").schema
    raw = inc.file_stream(spark, f"{sf_dir}/events.parquet", schema)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def _second(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@query(
    "rolling_event_metrics",
    "Z03",
    """SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS events, round(avg(value), 6) AS mean_value
FROM (SELECT event_type, value, unnest(generate_series(date_trunc('day', ts) - INTERVAL 6 DAY, date_trunc('day', ts), INTERVAL 1 DAY)) AS w FROM events) GROUP BY 1, 2""",
)
def rolling_event_metrics(spark, sf_dir):
    shares, progress = _folders(spark)
    sums = {"events": F.count(F.lit(1)), "valued": F.count("value"), "total": F.sum("value")}
    inc.collect_shares(_events(spark, sf_dir), lambda e: inc.rolling_sums(e, "ts", ["event_type"], sums), shares, progress)
    merged = inc.merged_sums(spark.read.parquet(shares), ["event_type"], list(sums))
    return merged.select(
        _second("window_start").alias("window_start"), "event_type", "events",
        F.round(F.col("total") / F.nullif("valued", F.lit(0)), 6).alias("mean_value"),
    )


@query(
    "late_event_metrics",
    "Z03",
    """WITH bound AS (SELECT max(ts) - INTERVAL 10 DAY AS b FROM events WHERE event_id % 10 <> 0),
w AS (SELECT *, time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS s FROM events)
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS events, round(sum(value), 4) AS total,
  CAST(count(*) FILTER (event_id % 10 = 0 AND s + INTERVAL 7 DAY <= b) AS BIGINT) AS late FROM w, bound GROUP BY 1, 2""",
)
def late_event_metrics(spark, sf_dir):
    """Events in two loads, one in ten of them in the second: those of finished weeks are late."""
    path, progress = _folders(spark)
    e = b.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).select("event_id", "event_type", "ts", "value")
    sums = {"events": F.count(F.lit(1)), "total": F.sum("value")}
    for part in (F.col("event_id") % 10 != 0, F.col("event_id") % 10 == 0):
        e.filter(part).write.mode("append").parquet(f"{path}-landed")
        inc.collect_bounded(
            inc.file_stream(spark, f"{path}-landed", e.schema), "ts", "7 days",
            lambda rows: inc.rolling_sums(rows, "ts", ["event_type"], sums, "7 days", None), "10 days", path, progress,
        )
    shares, late = (spark.read.parquet(f"{path}/{name}") for name in ("shares", "late"))
    both = shares.withColumn("late", F.lit(0)).unionByName(late.withColumn("late", F.col("events")))
    merged = inc.merged_sums(both, ["event_type"], ["events", "total", "late"])
    return merged.select(
        _second("window_start").alias("window_start"), "event_type", "events", F.round("total", 4).alias("total"), F.col("late").cast("bigint").alias("late")
    )


@query(
    "event_sessions",
    "Z04",
    """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, strftime(max(ts) + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S') AS ended, count(*) AS events FROM s GROUP BY user_id, n""",
)
def event_sessions(spark, sf_dir):
    parts, progress = _folders(spark)
    inc.collect_shares(_events(spark, sf_dir), lambda e: inc.sessions(e, "ts", ["user_id"], "6 hours"), parts, progress)
    return inc.merged_sessions(spark.read.parquet(parts), ["user_id"]).select(
        "user_id", _second("started").alias("started"), _second("ended").alias("ended"), "events"
    )


@query(
    "closing_lines",
    "Z05",
    """SELECT user_id AS game_id, event_type AS source, arg_max(value, ts) AS home_ml, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS closed_at FROM events GROUP BY 1, 2""",
)
def closing_lines(spark, sf_dir):
    shares, progress = _folders(spark)
    odds = _events(spark, sf_dir).select(
        F.col("user_id").alias("game_id"), F.col("event_type").alias("source"),
        F.col("ts").alias("timestamp"), F.col("value").alias("home_ml"),
    )
    inc.collect_shares(odds, lambda o: inc.closing_lines(o, None, ["home_ml"]), shares, progress)
    last = spark.read.parquet(shares).withColumnRenamed("closed_at", "timestamp")
    out = inc.closing_lines(last, None, ["home_ml"])
    return out.select("game_id", "source", "home_ml", _second("closed_at").alias("closed_at"))


@query(
    "closing_lines_batch",
    "Z05",
    """WITH tips AS (SELECT user_id, max(ts) - INTERVAL 10 DAY AS tip FROM events GROUP BY 1)
SELECT e.user_id AS game_id, event_type AS source, arg_max(value, ts) AS home_ml, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS closed_at FROM events e JOIN tips t ON t.user_id = e.user_id AND ts <= tip GROUP BY 1, 2""",
)
def closing_lines_batch(spark, sf_dir):
    odds = b.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("game_id"), F.col("event_type").alias("source"),
        F.col("ts").alias("timestamp"), F.col("value").alias("home_ml"),
    )
    tips = odds.groupBy("game_id").agg((F.max("timestamp") - F.expr("interval 10 days")).alias("tip_off"))
    out = inc.closing_lines(odds, tips, ["home_ml"])
    return out.select("game_id", "source", "home_ml", _second("closed_at").alias("closed_at"))


@query(
    "closed_lines_stream",
    "Z05",
    """WITH tips AS (SELECT user_id, max(ts) - INTERVAL 10 DAY AS tip FROM events GROUP BY 1),
q AS (SELECT e.user_id AS game_id, event_type AS source, value, ts, tip FROM events e JOIN tips t ON t.user_id = e.user_id WHERE value IS NOT NULL)
SELECT game_id, source, 'closed' AS kind, 1 AS quotes, round(arg_max(value, (ts, value)) FILTER (ts <= tip), 6) AS price,
  strftime(max(ts) FILTER (ts <= tip), '%Y-%m-%d %H:%M:%S') AS last_at FROM q GROUP BY 1, 2 HAVING count(*) FILTER (ts <= tip) > 0
UNION ALL SELECT game_id, source, 'late', count(*), round(max(value), 6), strftime(max(ts), '%Y-%m-%d %H:%M:%S') FROM q WHERE ts > tip GROUP BY 1, 2""",
)
def closed_lines_stream(spark, sf_dir):
    """Quotes that land in two halves of time; the stream runs after each and resumes where it stopped."""
    table, progress = _folders(spark)
    e = b.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    tips = e.groupBy("user_id").agg((F.max("ts") - F.expr("interval 10 days")).alias("tip_off"))
    quotes = e.filter("value is not null").join(tips, "user_id").select(
        F.col("user_id").cast("bigint").alias("game_id"), F.col("event_type").alias("source"), F.col("ts").alias("quoted_at"),
        F.col("value").cast("double").alias("price"), "tip_off",
    )
    middle = e.agg(F.timestamp_seconds((F.unix_timestamp(F.min("ts")) + F.unix_timestamp(F.max("ts"))) / 2)).scalar()
    landed = f"{table}-landed"
    for half in (F.col("quoted_at") < middle, F.col("quoted_at") >= middle):
        quotes.filter(half).write.mode("append").parquet(landed)
        closing.store_lines(closing.closed_lines(inc.file_stream(spark, landed, quotes.schema), "1 day"), table, progress)
    out = spark.read.parquet(table)
    last = F.date_format(F.max("quoted_at"), "yyyy-MM-dd HH:mm:ss")
    return out.groupBy("game_id", "source", "kind").agg(
        F.count(F.lit(1)).alias("quotes"), F.round(F.max("price"), 6).alias("price"), last.alias("last_at")
    )


@query(
    "streamed_new_games",
    "Z01 K01",
    """SELECT user_id AS game_id, CAST(min(ts) AS DATE)::VARCHAR AS first_day, count(*) AS purchases FROM events WHERE event_type = 'purchase' GROUP BY 1""",
)
def streamed_new_games(spark, sf_dir):
    """Streamed purchases kept once per event id, upserted by day, then counted."""
    table, progress = _folders(spark)
    rows = _events(spark, sf_dir).select(
        F.col("event_id").alias("game_id"), "user_id", F.col("ts").alias("played_at"),
        F.to_date("ts").alias("day"),
        F.when(F.col("event_type") == "purchase", "completed").otherwise("scheduled").alias("status"),
    )
    inc.upsert_stream(
        inc.new_completed_games(rows), table, ["game_id"], ["played_at"], "day", progress
    ).awaitTermination()
    return spark.read.parquet(table).groupBy(F.col("user_id").alias("game_id")).agg(
        F.to_date(F.min("played_at")).cast("string").alias("first_day"), F.count(F.lit(1)).alias("purchases")
    )
