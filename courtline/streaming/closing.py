"""Closing lines with keyed state: one line per game and source, sent at tip-off and then forgotten.

Each look at a state is a round trip from Python to the JVM, so lines of many games share one.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows of the result: the closing line, or a quote that came after it.
CLOSED, LATE = "closed", "late"
OUTPUT = "game_id bigint, source string, kind string, quoted_at timestamp, price double, tip_off timestamp"
LINE = ["game_id", "source"]
#: An open line in a bucket's state; times in microseconds, ``closes`` in milliseconds.
STATE = "game_id bigint, source string, quoted_at bigint, price double, tip_off bigint, closes bigint"
#: Buckets that the lines of a stream are dealt to. Fixed for a stream's lifetime, as its state is.
BUCKETS = 1024


@contextmanager
def rocks_state(spark: SparkSession):
    """Keyed state needs the RocksDB store; the session gets its own back afterwards."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


class ClosingLine(StatefulProcessor):
    """Keeps the last quote up to tip-off of one (game, source); a timer at tip-off sends it.

    Quotes later than tip-off are sent on at once as late ones. Of equal times the larger price
    counts, so the order of arrival does not.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getValueState("best", "quoted_at timestamp, price double, tip_off timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # one look at the state per key and batch, and plain columns: frames cost more than their few rows
        before = best = self.best.get()
        for part in rows:
            quoted, price, tip = (part[c].to_numpy() for c in ("quoted_at", "price", "tip_off"))
            late = quoted > tip
            if late.any():
                yield self._rows(key, LATE, quoted[late], price[late], tip[late])
            if not late.all():
                on_time = np.flatnonzero(~late)
                last = on_time[np.lexsort((price[on_time], quoted[on_time]))[-1]]
                row = (pd.Timestamp(quoted[last]).to_pydatetime(), float(price[last]), pd.Timestamp(tip[last]).to_pydatetime())
                best = row if best is None or row[:2] > (best[0], best[1]) else best
        if best is not before:
            self.best.update(tuple(best))
            if before is None:
                self.handle.registerTimer(int(pd.Timestamp(best[2]).tz_localize("UTC").timestamp() * 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        best = self.best.get()
        if best is not None:
            self.best.clear()
            yield self._rows(key, CLOSED, *([x] for x in best))

    @staticmethod
    def _rows(key, kind: str, quoted_at, price, tip_off) -> pd.DataFrame:
        return pd.DataFrame({
            "game_id": key[0], "source": key[1], "kind": kind, "quoted_at": quoted_at, "price": price, "tip_off": tip_off,
        })

    def close(self) -> None:
        pass


class ClosingLines(ClosingLine):
    """``ClosingLine`` for all lines of a bucket: a list of the open ones, read and written as one.

    One timer stands at the time the first of them closes; it sends all that the watermark has
    passed and moves on to the next. Rows are taken a frame at a time, whatever their lines.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lines = handle.getListState("lines", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        opened = self._open()
        best = opened.drop(columns="closes").assign(new=False)
        for part in rows:
            late = (part["quoted_at"] > part["tip_off"]).to_numpy()
            if late.any():
                yield self._sent(part[late], LATE)
            if not late.all():
                fresh = part.loc[~late, [*LINE, "quoted_at", "price", "tip_off"]].assign(new=True)
                for c in ("quoted_at", "tip_off"):
                    fresh[c] = fresh[c].to_numpy().astype("datetime64[us]").astype("int64")
                both = pd.concat([best, fresh]) if len(best) else fresh
                best = both.sort_values(["quoted_at", "price"], kind="stable").drop_duplicates(LINE, keep="last")
        if best["new"].any():
            # a line closes at the tip-off it was opened with
            best = best.drop(columns="new").merge(opened[[*LINE, "closes"]], "left", LINE)
            best["closes"] = best["closes"].astype("Int64").fillna(best["tip_off"] // 1000).astype("int64")
            self._keep(best)
            if not len(opened) or best["closes"].min() < opened["closes"].min():
                self.handle.registerTimer(int(best["closes"].min()))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        opened = self._open()
        closed = opened["closes"] < timerValues.getCurrentWatermarkInMs()
        if closed.any():
            left = opened[~closed]
            if len(left):
                self._keep(left)
                self.handle.registerTimer(int(left["closes"].min()))
            else:
                self.lines.clear()
            times = {c: opened[c].to_numpy().astype("datetime64[us]") for c in ("quoted_at", "tip_off")}
            yield self._sent(opened.assign(**times)[closed], CLOSED)

    def _open(self) -> pd.DataFrame:
        names = [c.split()[0] for c in STATE.split(", ")]
        columns = zip(*self.lines.get(), strict=True)
        lines = pd.DataFrame(dict(zip(names, columns, strict=False)), columns=names)
        return lines.astype({c: "int64" for c in ("quoted_at", "tip_off", "closes")})

    def _keep(self, lines: pd.DataFrame) -> None:
        columns = [lines[c].astype(object).where(lines[c].notna(), None).tolist() for c in LINE]
        columns += [lines[c].tolist() for c in ("quoted_at", "price", "tip_off", "closes")]
        self.lines.put(list(zip(*columns, strict=True)))

    @staticmethod
    def _sent(rows: pd.DataFrame, kind: str) -> pd.DataFrame:
        return rows.assign(kind=kind)[[*LINE, "kind", "quoted_at", "price", "tip_off"]]


def closed_lines(quotes: DataFrame, delay: str, buckets: int | None = BUCKETS) -> DataFrame:
    """Stream of closing lines and late quotes of a stream of quotes.

    ``quotes`` has game_id, source, quoted_at, price and tip_off. A line is sent once the
    watermark, ``delay`` behind the newest quote, has passed its tip-off; its state is freed
    then. A quote behind the watermark is later than all that is still open.

    Lines share a state by hash, ``buckets`` states in all; None keeps one for each line.
    """
    quotes = quotes.withWatermark("quoted_at", delay)
    if buckets is None:
        grouped, processor = quotes.groupBy(*LINE), ClosingLine()
    else:
        grouped, processor = quotes.withColumn("bucket", F.pmod(F.xxhash64(*LINE), F.lit(buckets))).groupBy("bucket"), ClosingLines()
    return grouped.transformWithStateInPandas(processor, OUTPUT, "Append", "EventTime")


def store_lines(lines: DataFrame, path: str, checkpoint: str) -> None:
    """Run the stream over what has landed and store its rows; a replayed batch stores them once."""
    with rocks_state(lines.sparkSession):
        (
            lines.writeStream.outputMode("append").format("parquet").option("path", path)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        )


def split(out: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Closing lines, and the side table of late quotes."""
    return tuple(out.filter(F.col("kind") == k).drop("kind") for k in (CLOSED, LATE))
