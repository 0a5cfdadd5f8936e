"""Structured Streaming forms of the request monitoring and of its alerts."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from labelflow.operators.monitoring import event_sums


def read_requests(spark: SparkSession, path: str, schema: T.StructType, **options) -> DataFrame:
    """Parquet files as a stream, ``ts`` as an instant (session zone UTC) so it can carry a watermark."""
    rows = spark.readStream.schema(schema).options(**options).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def streaming_windows(
    requests: DataFrame,
    width: int,
    slide: int | None = None,
    by: Sequence[str] = (),
    delay: str = "10 minutes",
    buckets: bool = False,
    value: str = "latency_s",
) -> DataFrame:
    """(start, by..., sums, closed_at) as windows close; rows whose step closed ``delay`` ago are dropped.

    Overlapping windows are two chained aggregations: events are summed per step (the longest one that all
    windows are made of), and only these few sums enter the windows that cover their step, so an event is
    counted once however many windows cover it. State is one row per open step or window and group: it is bounded by
    the delay and the width, not by the traffic. ``closed_at`` carries the watermark on.
    """
    step = math.gcd(width, slide or width)
    sums = event_sums(buckets, value)
    steps = (
        requests.withWatermark("ts", delay).groupBy(F.window("ts", f"{step} seconds").alias("w"), *by).agg(*sums)
    )
    if slide and slide != width or step != width:
        names = [c for c in steps.columns if c != "w" and c not in by]
        cover = F.window(F.window_time("w"), f"{width} seconds", f"{slide or width} seconds")
        steps = steps.groupBy(cover.alias("w"), *by).agg(*[F.sum(c).alias(c) for c in names])
    return steps.select(
        *[c for c in steps.columns if c != "w"], F.col("w.start").alias("start"), F.window_time("w").alias("closed_at")
    )


def write_closed_windows(
    windows: DataFrame, path: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    writer = (
        windows.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _alert_processor(hold: int, step: int, keys: Sequence[str]):
    """Processor of one group's closed windows; nested, so that it is shipped to the workers by value."""

    class Alerts(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            # the last true window of the open stretch, where the stretch began, whether it has fired
            self.open = handle.getValueState("stretch", "start long, since long, fired boolean")

        def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
            stretch = self.open.get() if self.open.exists() else None
            last = stretch
            for start, hit in sorted((r["start_s"], r["hit"]) for r in rows):
                if not hit:
                    stretch = None
                    continue
                going_on = stretch is not None and start - stretch[0] == step
                since, fired = (stretch[1], stretch[2]) if going_on else (start, False)
                if not fired and start - since >= hold:
                    fired = True
                    yield Row(**dict(zip(keys, key)), since=since, fired_at=since + hold)
                stretch = (start, since, fired)
            if stretch == last:
                return
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if stretch is None:
                self.open.clear()
                return
            self.open.update(stretch)
            # the next window closes two steps on; past that, nothing can continue the stretch
            self.handle.registerTimer((stretch[0] + 2 * step) * 1000 + 1)

        def handleExpiredTimer(
            self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo
        ) -> Iterator[Row]:
            self.open.clear()
            yield from ()

        def close(self) -> None:
            pass

    return Alerts()


def alert_rows(windows: DataFrame, condition: Column, hold: int, step: int, by: Sequence[str] = ("endpoint",)) -> DataFrame:
    """(by..., since, fired_at) of alerts as they start firing, from a stream of closed windows.

    Each group keeps the stretch of true windows that is still open as keyed state. Windows of a group arrive in
    order, as a watermark guarantees. A timer in event time removes the state of a group as soon as no window can
    continue its stretch, so groups that stop sending leave nothing behind.
    """
    keys = list(by) or ["__all"]
    rows = windows if by else windows.withColumn("__all", F.lit(""))
    rows = rows.select(
        *keys,
        F.col("start").cast("long").alias("start_s"),
        F.coalesce(condition, F.lit(False)).alias("hit"),
        "closed_at",
    )
    fields = [T.StructField(c, rows.schema[c].dataType) for c in keys]
    fields += [T.StructField("since", T.LongType()), T.StructField("fired_at", T.LongType())]
    fired = rows.groupBy(*keys).transformWithState(
        _alert_processor(hold, step, keys), T.StructType(fields), "Append", "EventTime"
    )
    return fired.select(*by, *[F.timestamp_seconds(c).alias(c) for c in ("since", "fired_at")])


def alert_stream(
    windows: DataFrame,
    folder: str,
    condition: Column,
    hold: int,
    step: int,
    by: Sequence[str] = ("endpoint",),
    available_now: bool = True,
) -> StreamingQuery:
    """Alerts over closed windows, written to ``folder/alerts``; a restart goes on from ``folder/checkpoint``.

    State lives in RocksDB under the checkpoint, which keeps the versions a recovery needs and removes older
    ones; each batch's alerts are committed once.
    """
    conf = windows.sparkSession.conf
    key = "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(key, None)
    conf.set(key, ROCKSDB)  # the query takes its settings when it starts
    try:
        fired = alert_rows(windows, condition, hold, step, by)
        return write_closed_windows(fired, f"{folder}/alerts", f"{folder}/checkpoint", available_now)
    finally:
        conf.set(key, before) if before else conf.unset(key)
