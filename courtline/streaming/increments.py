"""Incremental jobs as Structured Streaming.

Sources are folders of files with a given schema; progress lives in the
checkpoint folder of each query, so a restart resumes where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from courtline.sources import maintenance


def file_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    """Stream of a table stored as one Parquet file or as a folder of part files.

    A plain path of a stream has to be a folder; a pattern, here of that one name, may be either.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", str(files_per_batch))
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def new_completed_games(games: DataFrame) -> DataFrame:
    """Completed games, however late they come; the keyed upsert takes each once."""
    return games.filter(F.col("status") == "completed")


def upsert_stream(
    stream: DataFrame, path: str, keys: list[str], order: list[str], partition: str, checkpoint: str
) -> StreamingQuery:
    """Upsert every micro-batch into a table.

    A batch that is replayed after a failure upserts the same keys again, so the
    table stays exact.
    """

    def write(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            maintenance.upsert_table(path, batch, keys, order, partition)

    return _run(stream.writeStream.foreachBatch(write), checkpoint)


def _run(writer, checkpoint: str) -> StreamingQuery:
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def unprocessed(games: DataFrame, processed: DataFrame) -> DataFrame:
    """Batch resume: games whose id has not been processed."""
    return games.join(processed.select("game_id"), "game_id", "left_anti")


def rolling_sums(
    events: DataFrame, time: str, keys: list[str], sums: Mapping[str, Column], length: str = "7 days", slide: str | None = "1 day"
) -> DataFrame:
    """Tumbling (``slide`` None) or sliding sums and counts, such as can be added up later.

    Over a micro-batch it gives that batch's share of each window; ``merged_sums`` adds the
    shares, so a late row changes every window it belongs to and no state is kept.
    """
    window = F.window(time, length, slide) if slide else F.window(time, length)
    return (
        events.groupBy(window.alias("w"), *keys)
        .agg(*[c.alias(n) for n, c in sums.items()])
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, *sums)
    )


def collect_bounded(
    stream: DataFrame, time: str, length: str, reduce: Callable[[DataFrame], DataFrame], delay: str, path: str, checkpoint: str
) -> None:
    """Window shares of a stream with a bound on late rows.

    The bound of a micro-batch is the newest time of all earlier ones less ``delay``; windows of
    ``length`` that end before it are finished. Shares go to ``path/shares``, those of rows that
    come for a finished window to ``path/late``, each batch into its own folder, so a replayed
    batch overwrites itself. ``path/bounds`` holds one row per batch. Shares and late shares
    together are exact in any order of arrival.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        schema = "batch bigint, newest timestamp"
        newest = batch.agg(F.lit(batch_id).cast("bigint").alias("id"), F.max(time).cast("timestamp").alias("newest"))
        bounds = spark.read.schema(schema).parquet(f"{path}/bounds") if batch_id else spark.createDataFrame([], schema)
        bound = bounds.filter(F.col("batch") < batch_id).agg((F.max("newest") - F.expr(f"interval {delay}")).alias("b")).first()["b"]
        late = F.coalesce(F.window(time, length)["end"] <= F.lit(bound).cast("timestamp"), F.lit(False))
        for name, rows in (("shares", batch.filter(~late)), ("late", batch.filter(late))):
            reduce(rows).write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")
        newest.drop("id").write.mode("overwrite").parquet(f"{path}/bounds/batch={batch_id}")

    _run(stream.writeStream.foreachBatch(save), checkpoint).awaitTermination()


def merged_sums(shares: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    return shares.groupBy("window_start", "window_end", *keys).agg(*[F.sum(n).alias(n) for n in sums])


def sessions(events: DataFrame, time: str, keys: list[str], gap: str) -> DataFrame:
    """Runs of events no further apart than ``gap``: keys, started, ended, events."""
    return (
        events.groupBy(F.session_window(time, gap).alias("s"), *keys)
        .agg(F.count(F.lit(1)).alias("events"))
        .select(*keys, F.col("s.start").alias("started"), F.col("s.end").alias("ended"), "events")
    )


def merged_sessions(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Sessions of several batches put together where they meet.

    A part ends one gap after its last event, so two parts are one session exactly if one
    starts before the other's end. The window runs over a key's parts, not its events.
    """
    by_key = Window.partitionBy(*keys).orderBy("started", "ended")
    before = by_key.rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.coalesce(F.col("started") >= F.max("ended").over(before), F.lit(True)).cast("int")
    return (
        parts.withColumn("__fresh", fresh)
        .withColumn("__no", F.sum("__fresh").over(by_key.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "__no")
        .agg(F.min("started").alias("started"), F.max("ended").alias("ended"), F.sum("events").alias("events"))
        .drop("__no")
    )


def closing_lines(odds: DataFrame, tips: DataFrame | None, prices: list[str], time: str = "timestamp") -> DataFrame:
    """Last prices per (game, source) no later than tip-off.

    Applied to micro-batches, the last of each is a candidate, and the last of the candidates
    is the closing line; a tie in time goes to the larger prices.
    """
    rows = odds
    if tips is not None:
        rows = odds.join(tips, "game_id").filter(F.col(time) <= F.col("tip_off"))
    last = F.max(F.struct(time, *prices))
    return rows.groupBy("game_id", "source").agg(last.alias("c")).select(
        "game_id", "source", F.col(f"c.{time}").alias("closed_at"), *[F.col(f"c.{p}").alias(p) for p in prices]
    )


def collect_shares(stream: DataFrame, reduce: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> None:
    """Reduce every micro-batch by itself and keep the result in the batch's own folder.

    No state is carried from batch to batch. A batch that is replayed after a failure
    overwrites its own folder, so the shares are exact.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        reduce(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    _run(stream.writeStream.foreachBatch(save), checkpoint).awaitTermination()
