"""Structured Streaming forms of ingest, roll-ups, events and checks."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from loomline.operators import ingest

DELAY = "10 minutes"


def kafka_messages(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """Bus messages from Kafka, for ingest.explode_metrics."""
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()


def collapse(routed: DataFrame, delay: str = DELAY) -> DataFrame:
    """One row per equipment and nearest second, emitted once no earlier metric can come."""
    second = routed.withColumn("at", ingest.nearest_second()).withWatermark("at", delay)
    rows = second.groupBy("id_equipment", F.window("at", "1 second").alias("w")).agg(*ingest.wide_columns())
    return rows.select("id_equipment", F.col("w.start").alias("ts_value"), *ingest.COLUMNS.values())


def rollup_hour(values: DataFrame, delay: str = DELAY) -> DataFrame:
    """Minutes, and hours from the minutes, in one query."""
    minute = values.withWatermark("ts_value", delay).groupBy("id_equipment", F.window("ts_value", "1 minute").alias("w")).agg(F.sum("net_production_incr").alias("net"), F.count("*").alias("rows"))
    hour = minute.select("id_equipment", F.window_time("w").alias("t"), "net", "rows").groupBy("id_equipment", F.window("t", "1 hour").alias("w")).agg(F.sum("net").alias("net"), F.sum("rows").alias("rows"))
    return hour.select("id_equipment", F.col("w.start").alias("time"), "net", "rows")


def dedup(rows: DataFrame, keys: list[str], ts: str, delay: str = "1 day") -> DataFrame:
    return rows.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def state_events(values: DataFrame, delay: str = DELAY) -> DataFrame:
    """An event whenever an equipment's state changes, across batches, in order of event time. For sinks.rocksdb.

    Ticks wait, a row each, in the state of an aggregation until the watermark has passed them, so those that come late,
    within the delay, fall into their place. What a trigger lets out is later than all that went before: only the run in
    progress is kept for it, read and written once per equipment. The newest ticks and the open run are not
    written. Ticks of one instant count once, with the greatest state.
    """

    class Runs(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.run = handle.getValueState("run", "state int, start long")

        def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
            before = self.run.get()
            state, start = before if before is not None else (None, None)
            found = start
            for us, new in sorted((row.us, row.state) for row in rows):
                if new != state:
                    if state is not None:
                        yield Row(id_equipment=key[0], status=state, start=start, end=us)
                    state, start = new, us
            if start != found:
                self.run.update((state, start))

        def close(self) -> None:
            pass

    ticks = values.where("state IS NOT NULL").withWatermark("ts_value", delay).groupBy("id_equipment", "ts_value").agg(F.max("state").alias("state"))
    passed = ticks.select("id_equipment", F.unix_micros("ts_value").alias("us"), "state")
    runs = passed.groupBy("id_equipment").transformWithState(Runs(), "id_equipment long, status int, start long, end long", "Append", "None")
    ends = F.timestamp_micros("start").alias("ts_event"), F.timestamp_micros("end").alias("ts_end")
    return runs.select("id_equipment", "status", *ends, F.floor((F.col("end") - F.col("start")) / 1_000_000).cast("int").alias("duration"))


def idle(values: DataFrame, seconds: int, delay: str = DELAY) -> DataFrame:
    """A row when an equipment has been silent for so many seconds of event time. For sinks.rocksdb."""

    class Silence(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.last = handle.getValueState("last", "us long")

        def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
            newest = max(row.us for row in rows)
            if self.last.exists():
                before = self.last.get()[0]
                if before >= newest:
                    return iter(())
                self.handle.deleteTimer(before // 1000 + 1000 * seconds)
            self.last.update((newest,))
            self.handle.registerTimer(newest // 1000 + 1000 * seconds)
            return iter(())

        def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
            yield Row(id_equipment=key[0], us=self.last.get()[0])
            self.last.clear()

        def close(self) -> None:
            pass

    ticks = values.withWatermark("ts_value", delay).select("id_equipment", "ts_value", F.unix_micros("ts_value").alias("us"))
    silent = ticks.groupBy("id_equipment").transformWithState(Silence(), "id_equipment long, us long", "Append", "EventTime")
    return silent.select("id_equipment", F.timestamp_micros("us").alias("last_seen"))


def late(values: DataFrame, delay: str = DELAY) -> DataFrame:
    """(id_equipment, ts_value) of each tick that comes behind the watermark its stream has reached, for orders.touched_by. For sinks.rocksdb.

    Spark drops late rows in front of an operator that sees the event-time column; this one is given its
    microseconds alone, and tells the late from the others itself. It keeps no state.
    """

    class Behind(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            pass

        def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
            reached = 1000 * timerValues.getCurrentWatermarkInMs()
            for row in rows:
                if row.us < reached:
                    yield Row(id_equipment=key[0], us=row.us)

        def close(self) -> None:
            pass

    ticks = values.withWatermark("ts_value", delay).select("id_equipment", F.unix_micros("ts_value").alias("us"))
    behind = ticks.groupBy("id_equipment").transformWithState(Behind(), "id_equipment long, us long", "Append", "EventTime")
    return behind.select("id_equipment", F.timestamp_micros("us").alias("ts_value"))


def sessions(values: DataFrame, gap: str, delay: str = DELAY) -> DataFrame:
    rows = values.withWatermark("ts_value", delay).groupBy("id_equipment", F.session_window("ts_value", gap).alias("w")).agg(F.count("*").alias("ticks"))
    return rows.select("id_equipment", F.col("w.start").alias("ts_start"), F.col("w.end").alias("ts_end"), "ticks")


def sliding_rows(values: DataFrame, length: str = "5 minutes", slide: str = "1 minute", delay: str = DELAY) -> DataFrame:
    """Rows in each sliding window, from panes of one slide each: a tick is counted once, and a pane goes into the windows over it."""
    panes = values.withWatermark("ts_value", delay).groupBy(F.window("ts_value", slide).alias("w")).agg(F.count("*").alias("rows"))
    rows = panes.select(F.window_time("w").alias("t"), "rows").groupBy(F.window("t", length, slide).alias("w")).agg(F.sum("rows").alias("rows"))
    return rows.select(F.col("w.end").alias("time"), "rows")


def publish_receive(sent: DataFrame, received: DataFrame, bound: str = "2 hours", delay: str = DELAY) -> DataFrame:
    """Each publication with its reception within the bound; those without one come out once the bound has passed."""
    a = sent.select("key", F.col("ts").alias("sent_at")).withWatermark("sent_at", delay).alias("a")
    b = received.select(F.col("key").alias("rkey"), F.col("ts").alias("received_at")).withWatermark("received_at", delay).alias("b")
    on = F.expr(f"key = rkey AND received_at >= sent_at AND received_at <= sent_at + INTERVAL {bound}")
    return a.join(b, on, "left_outer").select("key", "sent_at", "received_at")
