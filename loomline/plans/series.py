"""Time series queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loomline.functions.columns import bucket, within
from loomline.operators import series
from loomline.plans.params import DEFAULT as P
from loomline.plans.params import ORDERS
from loomline.plans.registry import PLACES, add
from loomline.sources.sinks import work_dir

RANGE = f"BETWEEN TIMESTAMP '{P.t0}' AND TIMESTAMP '{P.t1}'"
NAMED = f"FROM equipment_values AS ev JOIN {PLACES} USING (id_equipment)"


def labelled(column: str, value: str) -> str:
    return f"SELECT time_bucket(INTERVAL 1 HOUR, ev.ts_value) AS time, concat_ws(' › ', nm_enterprise, nm_equipment) AS metric, {value} AS value {NAMED} WHERE ev.ts_value {RANGE} AND ev.{column} IS NOT NULL GROUP BY 1, 2"


add("ts_production", lambda t: series.series(t, "net_production_incr", F.sum("net_production_incr"), P), labelled("net_production_incr", "sum(ev.net_production_incr)"))
add("ts_speed", lambda t: series.series(t, "speed", F.round(F.avg("speed"), 4), P), labelled("speed", "round(avg(ev.speed), 4)"))
add("ts_scrap", lambda t: series.series(t, "scrap_incr", F.sum("scrap_incr"), P), labelled("scrap_incr", "sum(ev.scrap_incr)"))
add("ts_state_last", lambda t: series.series(t, "state", F.max(F.struct("ts_value", "state"))["state"], P), labelled("state", "max(struct_pack(a := ev.ts_value, b := ev.state)).b"))
add(
    "ts_state_timeline",
    lambda t: series.state_timeline(t.equipment_values),
    """WITH ticks AS (SELECT id_equipment, ts_value, max(state) AS state FROM equipment_values WHERE state IS NOT NULL GROUP BY 1, 2),
    marked AS (SELECT *, CASE WHEN state IS DISTINCT FROM lag(state) OVER (PARTITION BY id_equipment ORDER BY ts_value) THEN 1 ELSE 0 END AS changed FROM ticks),
    runs AS (SELECT *, sum(changed) OVER (PARTITION BY id_equipment ORDER BY ts_value) AS island FROM marked)
    SELECT id_equipment, state, min(ts_value) AS ts_start, max(ts_value) AS ts_last, count(*) AS ticks FROM runs GROUP BY id_equipment, island, state""",
)
add(
    "ts_rows_per_minute",
    lambda t: t.equipment_values.where(within("ts_value", P)).groupBy(bucket("ts_value", "1 minute").alias("time")).agg(F.count("*").alias("rows")),
    f"SELECT date_trunc('minute', ts_value) AS time, count(*) AS rows FROM equipment_values WHERE ts_value {RANGE} GROUP BY 1",
)
add(
    "ts_metric_breakdown",
    lambda t: series.metric_breakdown(t.equipment_values, P),
    f"""SELECT date_trunc('minute', ts_value) AS time, count(net_production_incr) AS prod_processed, count(scrap_incr) AS prod_defective, count(state) AS state_current, count(mode) AS unit_mode,
    count(*) FILTER (WHERE speed IS NOT NULL AND net_production_incr IS NULL) AS mach_speed FROM equipment_values WHERE ts_value {RANGE} GROUP BY 1""",
)
add(
    "ts_metric_exclusive",
    lambda t: series.metric_exclusive(t.equipment_values),
    """SELECT CASE WHEN net_production_incr IS NOT NULL THEN 'ProdProcessed' WHEN scrap_incr IS NOT NULL THEN 'ProdDefective' WHEN state IS NOT NULL THEN 'StateCurrent'
    WHEN mode IS NOT NULL THEN 'UnitMode' WHEN speed IS NOT NULL THEN 'MachSpeed' ELSE 'other' END AS metric, count(*) AS rows, max(ts_value) AS latest FROM equipment_values GROUP BY 1""",
)


def filled(table: str, column: str, p, unit: str, **conditions: str) -> str:
    counts = ", ".join(f"count(*) FILTER (WHERE {c}) AS {n}" for n, c in conditions.items())
    shown = ", ".join(f"CAST(coalesce(c.{n}, 0) AS BIGINT) AS {n}" for n in conditions)
    return f"""SELECT s.time, {shown} FROM (SELECT unnest(generate_series(date_trunc('{unit}', TIMESTAMP '{p.t0}'), date_trunc('{unit}', TIMESTAMP '{p.t1}'), INTERVAL 1 {unit.upper()})) AS time) s
    LEFT JOIN (SELECT date_trunc('{unit}', {column}) AS time, {counts} FROM {table} WHERE {column} BETWEEN TIMESTAMP '{p.t0}' AND TIMESTAMP '{p.t1}' GROUP BY 1) c ON c.time = s.time"""


add(
    "ts_operator_actions",
    lambda t: series.zero_filled(t.user_logs, "ts_log", P, po_actions=F.col("category").isin("order-started", "order-stopped"), justifications=F.col("category").isin("event-justified", "event-edited"), manual_events=F.col("category") == "manual-event-created"),
    filled("user_logs", "ts_log", P, "hour", po_actions="category IN ('order-started', 'order-stopped')", justifications="category IN ('event-justified', 'event-edited')", manual_events="category = 'manual-event-created'"),
)
add(
    "ts_pending_vs_justified",
    lambda t: series.zero_filled(t.equipment_events, "ts_end", ORDERS, pending=(F.col("status") == 10) & F.col("cd_category").isNull(), justified=(F.col("status") == 10) & F.col("cd_category").isNotNull()),
    filled("equipment_events", "ts_end", ORDERS, "day", pending="status = 10 AND cd_category IS NULL", justified="status = 10 AND cd_category IS NOT NULL"),
)
add(
    "ts_orders_started_finished",
    lambda t: series.zero_filled(t.production_orders, "ts_start", ORDERS, started=F.col("status") >= 2).join(series.zero_filled(t.production_orders, "ts_end", ORDERS, finished=F.col("status") == 3), "time", "full"),
    f"SELECT a.time, a.started, b.finished FROM ({filled('production_orders', 'ts_start', ORDERS, 'day', started='status >= 2')}) a FULL JOIN ({filled('production_orders', 'ts_end', ORDERS, 'day', finished='status = 3')}) b ON a.time = b.time",
)
def rolled(unit: str) -> str:
    return f"""SELECT id_equipment, date_trunc('{unit}', ts_value) AS time, sum(net_production_incr) AS net, sum(scrap_incr) AS scrap, round(sum(speed), 2) AS speed_sum, count(speed) AS speed_n,
        count(*) FILTER (WHERE state = 6) AS running, count(state) AS stated, count(*) AS rows, (max(struct_pack(a := ts_value, b := state)) FILTER (WHERE state IS NOT NULL)).b AS last_state
        FROM equipment_values GROUP BY 1, 2"""


for level, unit in (("1m", "minute"), ("1h", "hour"), ("1d", "day")):
    add(f"rollup_{level}", lambda t, n=level: series.shown(series.rollup(t.equipment_values, n)), rolled(unit))
CASCADED = """WITH minutes AS (SELECT id_equipment, date_trunc('minute', ts_value) AS time, sum(net_production_incr) AS net, sum(scrap_incr) AS scrap, round(sum(speed), 2) AS speed_sum, count(speed) AS speed_n,
        count(*) FILTER (WHERE state = 6) AS running, count(state) AS stated, count(*) AS rows FROM equipment_values GROUP BY 1, 2),
    hours AS (SELECT id_equipment, date_trunc('hour', time) AS time, sum(net) AS net, sum(scrap) AS scrap, round(sum(speed_sum), 2) AS speed_sum, sum(speed_n) AS speed_n, sum(running) AS running, sum(stated) AS stated, sum(rows) AS rows FROM minutes GROUP BY 1, 2),
    days AS (SELECT id_equipment, date_trunc('day', time) AS time, sum(net) AS net, sum(scrap) AS scrap, round(sum(speed_sum), 2) AS speed_sum, sum(speed_n) AS speed_n, sum(running) AS running, sum(stated) AS stated, sum(rows) AS rows FROM hours GROUP BY 1, 2),
    direct AS (SELECT id_equipment, date_trunc('day', ts_value) AS time, sum(net_production_incr) AS net, sum(scrap_incr) AS scrap, round(sum(speed), 2) AS speed_sum, count(speed) AS speed_n,
        count(*) FILTER (WHERE state = 6) AS running, count(state) AS stated, count(*) AS rows FROM equipment_values GROUP BY 1, 2)
    SELECT CAST((SELECT count(*) FROM (SELECT * FROM days EXCEPT ALL SELECT * FROM direct)) + (SELECT count(*) FROM (SELECT * FROM direct EXCEPT ALL SELECT * FROM days)) AS BIGINT) AS differing"""
add("rollup_consistency", lambda t: series.consistency(t.equipment_values), CASCADED)


def incremental(t, level: str):
    """Stored levels of nine tenths of the ticks, refreshed for the buckets that the rest falls in."""
    top = f"{work_dir(t.spark)}/rollup-{uuid.uuid4().hex}"
    late = F.pmod(F.xxhash64("ts_value", "id_equipment"), F.lit(10)) == 0
    for rows in (t.equipment_values.where(~late), t.equipment_values.where(late)):
        series.store_values(rows, f"{top}/values")
        series.refresh(f"{top}/levels", t.spark.read.parquet(f"{top}/values"), rows)
    return series.shown(t.spark.read.parquet(f"{top}/levels/{level}"))


add("rollup_incremental", lambda t: incremental(t, "1d"), rolled("day"))
add("rollup_incremental_1h", lambda t: incremental(t, "1h"), rolled("hour"))
add("rollup_incremental_1m", lambda t: incremental(t, "1m"), rolled("minute"))


def sketched(t):
    """Equipment that reports per day, exactly and from merged five-minute sketches: whether these lie within 5 percent."""
    day = F.date_trunc("day", "ts_value")
    exact = t.equipment_values.groupBy(day.alias("time")).agg(F.count_distinct("id_equipment").alias("equipment"))
    about = series.reported(series.reporting_up(series.reporting_up(series.reporting(t.equipment_values), "1 hour"), "1 day")).withColumnRenamed("equipment", "about")
    return exact.join(about, "time").select("time", "equipment", (F.abs(F.col("about") - F.col("equipment")) <= 0.05 * F.col("equipment")).alias("close"))


add("agg_distinct_sketched", sketched, "SELECT date_trunc('day', ts_value) AS time, count(DISTINCT id_equipment) AS equipment, true AS close FROM equipment_values GROUP BY 1")
