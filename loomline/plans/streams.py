"""Streaming queries: each runs over all files there are and returns what it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.operators import ingest, orders
from loomline.plans.ingest import LETTERS, ROUTED, WIDE, counted_letters, damaged, messages
from loomline.plans.registry import add_stream
from loomline.sources import sinks
from loomline.sources.tables import Tables
from loomline.streaming import flows


def passed(ts: str) -> str:
    """SQL for the last watermark of a stream that has read all rows: whole milliseconds, less the delay."""
    return f"date_trunc('millisecond', max({ts})) - INTERVAL {flows.DELAY.upper().removesuffix('S')}"


PASSED = f"(SELECT {passed('ts_value')} FROM equipment_values)"


def live(spark: SparkSession, path: str) -> Tables:
    return Tables(spark, path, streaming=True)


def values(spark: SparkSession, path: str) -> DataFrame:
    return live(spark, path).equipment_values


def routed(spark: SparkSession, path: str) -> DataFrame:
    t = live(spark, path)
    return ingest.route(ingest.parse_topic(t.raw_metrics), Tables(spark, path).packml_register)


def base(spark: SparkSession) -> str:
    return f"{sinks.work_dir(spark)}/sink-{uuid.uuid4().hex}"


def bus(spark: SparkSession, path: str) -> DataFrame:
    return sinks.drained(ingest.explode_metrics(messages(live(spark, path))))


def upserted(spark: SparkSession, path: str) -> DataFrame:
    top = base(spark)
    rows = values(spark, path).select("ts_value", "id_equipment", *sinks.METRICS, F.unix_micros("ts_value").alias("seq"))
    sinks.upsert_stream(rows, f"{top}/out", f"{top}/checkpoint").awaitTermination()
    return sinks.zoneless(sinks.upserted(spark, f"{top}/out"))


def current(spark: SparkSession, path: str) -> DataFrame:
    top = base(spark)
    query = sinks.current_stream(values(spark, path), f"{top}/out", f"{top}/checkpoint")
    query.awaitTermination()
    return sinks.zoneless(spark.read.parquet(f"{top}/out/{query.lastProgress['batchId']}"))


def published(spark: SparkSession, path: str) -> DataFrame:
    """Clicks as publications, views of the same user as receptions."""
    events = lambda kind: live(spark, path).events.where(F.col("event_type") == kind).select(F.col("user_id").alias("key"), "ts")
    return sinks.drained(flows.publish_receive(events("click"), events("view")))


def stateful(spark: SparkSession, stream: DataFrame) -> DataFrame:
    with sinks.rocksdb(spark):
        return sinks.drained(stream)


#: Ticks of these minutes reach the bus only after all others.
HELD_BACK = "minute(ts_value) % 10 = 7"


def to_recalc(spark: SparkSession, path: str) -> DataFrame:
    """Runtimes touched by late ticks: those of some minutes come in a second run of the stream, whose watermark the first has moved."""
    t, top = Tables(spark, path), base(spark)
    ticks = t.equipment_values.select("id_equipment", F.col("ts_value").cast("timestamp").alias("ts_value"))
    with sinks.rocksdb(spark):
        for part in (f"NOT ({HELD_BACK})", HELD_BACK):
            ticks.where(part).write.mode("append").parquet(f"{top}/in")
            stream = flows.late(spark.readStream.schema(ticks.schema).parquet(f"{top}/in"))
            sinks.append_stream(stream, f"{top}/late", f"{top}/checkpoint").awaitTermination()
    found = sinks.zoneless(spark.read.schema("id_equipment long, ts_value timestamp").parquet(f"{top}/late"))
    return orders.touched_by(found, t.production_orders_runtime)


def letters(spark: SparkSession, path: str) -> DataFrame:
    """What the bus stream could not use, of messages some of which are damaged."""
    top = base(spark)
    read = ingest.read_messages(damaged(live(spark, path)))
    sinks.letters_stream(read, f"{top}/good", f"{top}/dead", f"{top}/checkpoint").awaitTermination()
    good, dead = spark.read.parquet(f"{top}/good"), spark.read.parquet(f"{top}/dead")
    return counted_letters(good, dead)


def deduplicated(spark: SparkSession, path: str) -> DataFrame:
    once = live(spark, path).events.select("event_id", "ts", "event_type")
    again = live(spark, path).events.select("event_id", "ts", "event_type")
    return sinks.drained(flows.dedup(once.union(again), ["event_id"], "ts", "40 days"))


add_stream(
    "src_bus_messages",
    bus,
    """SELECT 'edge' AS gateway, name, ts_metric, value, CAST(NULL AS BIGINT) AS counter, CAST(NULL AS DOUBLE) AS curspeed FROM raw_metrics
    UNION ALL SELECT 'edge', name || '/late', ts_metric + INTERVAL 1 SECOND, value, NULL, NULL FROM raw_metrics""",
)
add_stream(
    "sink_upsert_values",
    upserted,
    f"SELECT ts_value, id_equipment, {', '.join(f'max({c}) AS {c}' for c in sinks.METRICS)} FROM equipment_values GROUP BY 1, 2",
)
add_stream("sink_append_uns", lambda s, p: sinks.drained(live(s, p).uns_metrics), "SELECT * FROM uns_metrics")
add_stream("sink_current_metrics", current, "SELECT id_equipment, m.b AS speed, m.a AS last_update FROM (SELECT id_equipment, max(struct_pack(a := ts_value, b := speed)) AS m FROM equipment_values WHERE speed IS NOT NULL GROUP BY 1)")
add_stream(
    "st_collapse",
    lambda s, p: sinks.drained(flows.collapse(routed(s, p))),
    f"""WITH seconds AS (SELECT *, date_trunc('second', ts_metric + INTERVAL 500 MILLISECOND) AS ts_value FROM ({ROUTED}))
    SELECT id_equipment, ts_value, {WIDE} FROM seconds WHERE ts_value + INTERVAL 1 SECOND <= (SELECT {passed("ts_value")} FROM seconds) GROUP BY 1, 2""",
)
add_stream(
    "st_rollup_1m_1h",
    lambda s, p: sinks.drained(flows.rollup_hour(values(s, p))),
    f"""SELECT id_equipment, date_trunc('hour', ts_value) AS time, sum(net_production_incr) AS net, count(*) AS rows FROM equipment_values
    WHERE date_trunc('hour', ts_value) + INTERVAL 1 HOUR <= {PASSED} GROUP BY 1, 2""",
)
add_stream("st_dedup", deduplicated, "SELECT event_id, ts, event_type FROM events")
add_stream(
    "st_state_events",
    lambda s, p: stateful(s, flows.state_events(values(s, p))),
    f"""WITH ticks AS (SELECT id_equipment, ts_value, max(state) AS state FROM equipment_values WHERE state IS NOT NULL GROUP BY 1, 2),
    changes AS (SELECT *, lag(state) OVER (PARTITION BY id_equipment ORDER BY ts_value) AS before FROM ticks WHERE ts_value <= (SELECT {passed("ts_value")} FROM ticks)),
    runs AS (SELECT id_equipment, state AS status, ts_value AS ts_event, lead(ts_value) OVER (PARTITION BY id_equipment ORDER BY ts_value) AS ts_end FROM changes WHERE before IS DISTINCT FROM state)
    SELECT *, CAST(floor((epoch_us(ts_end) - epoch_us(ts_event)) / 1000000) AS INT) AS duration FROM runs WHERE ts_end IS NOT NULL""",
)
add_stream(
    "st_idle_timeout",
    lambda s, p: stateful(s, flows.idle(values(s, p), 86_400)),
    f"SELECT id_equipment, max(ts_value) AS last_seen FROM equipment_values GROUP BY 1 HAVING date_trunc('millisecond', max(ts_value)) + INTERVAL 86400 SECOND < {PASSED}",
)
add_stream(
    "st_sessions",
    lambda s, p: sinks.drained(flows.sessions(values(s, p), "6 hours")),
    f"""WITH marked AS (SELECT id_equipment, ts_value, CASE WHEN ts_value - lag(ts_value) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens FROM equipment_values WINDOW w AS (PARTITION BY id_equipment ORDER BY ts_value)),
    numbered AS (SELECT *, sum(opens) OVER (PARTITION BY id_equipment ORDER BY ts_value RANGE UNBOUNDED PRECEDING) AS session FROM marked)
    SELECT id_equipment, min(ts_value) AS ts_start, max(ts_value) + INTERVAL 6 HOUR AS ts_end, count(*) AS ticks FROM numbered GROUP BY id_equipment, session HAVING max(ts_value) + INTERVAL 6 HOUR <= {PASSED}""",
)
add_stream(
    "st_sliding_rows_5min",
    lambda s, p: sinks.drained(flows.sliding_rows(values(s, p))),
    f"""SELECT time, count(*) AS rows FROM (SELECT date_trunc('minute', ts_value) + k * INTERVAL 1 MINUTE AS time FROM equipment_values CROSS JOIN (SELECT unnest(range(1, 6)) AS k))
    WHERE time <= {PASSED} GROUP BY 1""",
)
add_stream(
    "st_route",
    lambda s, p: sinks.drained(routed(s, p).select("seq", "topic", "id_equipment", "metric_type")),
    "SELECT m.seq, pr.packml_topic AS topic, pr.id_equipment, string_split(m.name, '/')[6] AS metric_type FROM raw_metrics m JOIN packml_register pr ON pr.active AND pr.packml_topic = array_to_string(string_split(m.name, '/')[1:4], '/')",
)
add_stream(
    "st_publish_receive",
    published,
    f"""WITH pairs AS (SELECT a.event_id, a.user_id AS key, a.ts AS sent_at, b.ts AS received_at FROM (SELECT * FROM events WHERE event_type = 'click') a
        LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') b ON b.user_id = a.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 2 HOUR),
    reached AS (SELECT min(w) AS w FROM (SELECT {passed("ts")} AS w FROM events WHERE event_type IN ('click', 'view') GROUP BY event_type))
    SELECT key, sent_at, received_at FROM pairs WHERE received_at IS NOT NULL OR sent_at + INTERVAL 2 HOUR < (SELECT w FROM reached)""",
)
add_stream(
    "st_late_to_recalc",
    to_recalc,
    f"""SELECT DISTINCT r.id_production_order_runtime FROM production_orders_runtime r JOIN equipment_values v ON v.id_equipment = r.id_equipment
    AND v.ts_value >= r.ts_start AND (r.ts_end IS NULL OR v.ts_value < r.ts_end) WHERE {HELD_BACK} AND v.ts_value < (SELECT {passed("ts_value")} FROM equipment_values WHERE NOT ({HELD_BACK}))""",
)
add_stream("src_dead_letters", letters, LETTERS)
