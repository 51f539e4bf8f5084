"""Downtime event queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline.operators import events
from loomline.plans.params import DEFAULT as P
from loomline.plans.params import ORDERS
from loomline.plans.registry import PLACES, add

RANGE = f"BETWEEN TIMESTAMP '{ORDERS.t0}' AND TIMESTAMP '{ORDERS.t1}'"
AS_OF = f"TIMESTAMP '{P.as_of}'"
OPEN_CATEGORY = "(cd_category IS NULL OR cd_category = '')"
TYPE = "if(planned_downtime, 'Planned', if(change_over, 'Changeover', {other})) AS type"
NAMED = f"equipment_events LEFT JOIN {PLACES} USING (id_equipment)"
TIMELINE = """WITH ticks AS (SELECT id_equipment, ts_value, max(state) AS state FROM equipment_values WHERE state IS NOT NULL GROUP BY 1, 2),
    marked AS (SELECT *, CASE WHEN state IS DISTINCT FROM lag(state) OVER (PARTITION BY id_equipment ORDER BY ts_value) THEN 1 ELSE 0 END AS changed FROM ticks)"""

add(
    "ev_from_states",
    lambda t: events.from_states(t.equipment_values),
    f"""{TIMELINE} SELECT id_equipment, status, ts_event, ts_end, CAST(floor(epoch(ts_end - ts_event)) AS INTEGER) AS duration FROM
    (SELECT id_equipment, state AS status, ts_value AS ts_event, lead(ts_value) OVER (PARTITION BY id_equipment ORDER BY ts_value) AS ts_end FROM marked WHERE changed = 1)""",
)
add(
    "ev_recent",
    events.recent,
    f"""SELECT id_equipment_event, ts_event, nm_enterprise, nm_equipment, status, ts_end, duration, {TYPE.format(other="if(status = 6, 'Running', 'Unplanned')")}
    FROM {NAMED} ORDER BY ts_event DESC, id_equipment_event DESC LIMIT 30""",
)
add(
    "ev_downtime",
    lambda t: events.downtime(t, P),
    f"""SELECT id_equipment_event, nm_enterprise, nm_equipment, ts_event AS ts_start, ts_end, round(coalesce(duration, floor(epoch({AS_OF} - ts_event))) / 60.0, 1) AS duration_min,
    {TYPE.format(other="'Unplanned'")} FROM {NAMED} WHERE status <> 6 ORDER BY ts_event DESC, id_equipment_event DESC LIMIT 30""",
)
add("ev_count", lambda t: t.equipment_events.agg(F.count("*").alias("value")), "SELECT count(*) AS value FROM equipment_events")
for key, closed in (("ev_justifiable", False), ("ev_auto_justifiable", True)):
    add(
        key,
        lambda t, c=closed: events.justifiable(t.equipment_events, c),
        f"""SELECT id_equipment_event, id_equipment, id_enterprise, ts_event FROM equipment_events WHERE status = 10 AND {OPEN_CATEGORY} AND NOT coalesce(forced_creation_system, false)
        {"AND ts_end IS NOT NULL" * closed} ORDER BY ts_event, id_equipment_event LIMIT 10""",
    )
add(
    "ev_open_or_forced",
    lambda t: events.open_or_forced(t.equipment_events),
    "SELECT id_equipment_event, id_equipment, ts_event, ts_end FROM equipment_events WHERE status = 10 AND (ts_end IS NULL OR forced_creation_system) ORDER BY ts_event, id_equipment_event LIMIT 10",
)
add("ev_pending_now", lambda t: t.equipment_events.where("ts_end IS NULL").agg(F.count("*").alias("value")), "SELECT count(*) AS value FROM equipment_events WHERE ts_end IS NULL")
add(
    "ev_backlog",
    lambda t: events.backlog(t, P),
    f"""SELECT id_equipment_event, id_equipment, coalesce(packml_topic, nm_equipment) AS topic, CAST(round(floor(epoch({AS_OF} - ts_event)) / 60.0) AS DOUBLE) AS open_min, ts_event
    FROM (SELECT * FROM equipment_events WHERE status = 10 AND ts_end IS NOT NULL AND {OPEN_CATEGORY}) JOIN (SELECT id_equipment, nm_equipment FROM equipments) USING (id_equipment)
    LEFT JOIN (SELECT id_equipment, packml_topic FROM packml_register) USING (id_equipment) ORDER BY ts_event, id_equipment_event, topic LIMIT 20""",
)
add(
    "ev_justification_rate",
    lambda t: events.justification_rate(t.equipment_events, ORDERS),
    f"""SELECT round(CAST(count(*) FILTER (WHERE cd_category IS NOT NULL AND cd_category <> '') AS DOUBLE) / nullif(count(*) FILTER (WHERE ts_end IS NOT NULL), 0) * 100, 1) AS value
    FROM equipment_events WHERE ts_event {RANGE}""",
)
add(
    "ev_justification_rate_strict",
    lambda t: events.justification_rate(t.equipment_events, ORDERS, strict=True),
    f"""SELECT round(CAST(count(*) FILTER (WHERE cd_category <> '') AS DOUBLE) / nullif(count(*), 0) * 100, 1) AS value FROM equipment_events WHERE ts_event {RANGE} AND ts_end IS NOT NULL AND status = 10""",
)
MAN = "SELECT id_equipment_event, id_equipment, ts_event, ts_end, duration FROM equipment_events_man WHERE ts_end IS NOT NULL AND duration > 60 AND date_trunc('second', ts_event) = ts_event AND date_trunc('second', ts_end) = ts_end AND NOT coalesce(forced_creation_system, false)"
STD = "SELECT id_equipment_event, id_equipment, ts_event, ts_end, duration FROM equipment_events WHERE ts_end IS NOT NULL AND duration > 60 AND status <> 6 AND epoch_us(ts_end) % 1000000 = epoch_us(ts_event) % 1000000"
add("ev_splittable_man", lambda t: events.splittable_manual(t.equipment_events_man), MAN)
add("ev_splittable_std", lambda t: events.splittable_standard(t.equipment_events), STD)
add("ev_split_candidates", lambda t: events.split_candidates(t.equipment_events, t.equipment_events_man), f"SELECT *, 'standard' AS source FROM ({STD}) UNION ALL SELECT *, 'manual' AS source FROM ({MAN})")
add(
    "ev_split",
    lambda t: events.split(t.equipment_events, "QUA"),
    """SELECT id_equipment_event, piece, CASE piece WHEN 'A' THEN ts_event ELSE cut END AS ts_event, CASE piece WHEN 'A' THEN cut ELSE ts_end END AS ts_end,
    CASE piece WHEN 'A' THEN half ELSE total - half END AS duration, CASE piece WHEN 'A' THEN cd_category ELSE 'QUA' END AS cd_category
    FROM (SELECT *, ts_event + half * INTERVAL 1 SECOND AS cut FROM (SELECT *, CAST(floor(total / 2) AS BIGINT) AS half FROM
    (SELECT *, CAST(floor(epoch(ts_end - ts_event)) AS BIGINT) AS total FROM equipment_events WHERE ts_end IS NOT NULL))) CROSS JOIN (SELECT unnest(['A', 'B']) AS piece)""",
)
add(
    "ev_closed_manual",
    lambda t: events.closed_manual(t.equipment_events_man),
    """SELECT id_equipment_event, id_equipment, ts_event, ts_end, duration FROM equipment_events_man WHERE ts_end IS NOT NULL AND NOT coalesce(forced_creation_system, false)
    ORDER BY ts_event DESC, id_equipment_event DESC, id_equipment DESC, ts_end DESC, duration DESC LIMIT 10""",
)
add(
    "ev_short_unjustified",
    lambda t: events.without_short(t.equipment_events, 600).select("id_equipment_event", "duration", "cd_category"),
    f"SELECT id_equipment_event, duration, cd_category FROM equipment_events WHERE NOT coalesce(ts_end IS NOT NULL AND {OPEN_CATEGORY} AND (duration IS NULL OR duration < 600), false)",
)
add(
    "ev_reset_scope",
    lambda t: events.without_scope(t.equipment_events, t.enterprises, ["ASIA", "EUROPE"]).select("id_equipment_event", "id_enterprise"),
    "SELECT id_equipment_event, id_enterprise FROM equipment_events WHERE id_enterprise NOT IN (SELECT id_enterprise FROM enterprises WHERE nm_enterprise IN ('ASIA', 'EUROPE'))",
)
add(
    "ev_pending_deficit",
    lambda t: events.pending_deficit(t.equipment_events, 1_000_000),
    f"SELECT greatest(0, 1000000 - count(*)) AS value FROM equipment_events WHERE ts_end IS NOT NULL AND status = 10 AND {OPEN_CATEGORY} AND NOT coalesce(forced_creation_system, false)",
)
LAST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id_equipment_event ORDER BY ts_action DESC, seq DESC) AS k FROM event_actions) WHERE k = 1)"
add(
    "ev_apply_justify",
    lambda t: events.apply_justify(t.equipment_events, t.event_actions),
    f"SELECT e.id_equipment_event, coalesce(a.cd_category, e.cd_category) AS cd_category, a.cd_subcategory FROM equipment_events e LEFT JOIN {LAST} a ON a.id_equipment_event = e.id_equipment_event",
)


def edits(t):
    """Every action also moves its event: start to the action's time, end to ten minutes later."""
    return t.event_actions.withColumn("new_start", F.col("ts_action")).withColumn("new_end", F.col("ts_action") + F.expr("INTERVAL 10 MINUTES"))


add(
    "ev_apply_edit",
    lambda t: events.apply_edit(t.equipment_events, edits(t)),
    f"""SELECT id_equipment_event, cd_category, ts_event, ts_end, CAST(floor(epoch(ts_end - ts_event)) AS INTEGER) AS duration FROM (SELECT e.id_equipment_event, coalesce(a.cd_category, e.cd_category) AS cd_category,
    coalesce(a.ts_action, e.ts_event) AS ts_event, coalesce(a.ts_action + INTERVAL 10 MINUTE, e.ts_end) AS ts_end FROM equipment_events e LEFT JOIN {LAST} a ON a.id_equipment_event = e.id_equipment_event)""",
)
add(
    "ev_add_manual",
    lambda t: events.add_manual(t.equipment_events_man, t.equipment_values.where("state = 10").select("id_equipment", (F.col("ts_value") + F.expr("INTERVAL 250 MILLISECONDS")).alias("ts_event"), (F.col("ts_value") + F.expr("INTERVAL 90 SECONDS")).alias("ts_end"), F.lit("OP").alias("cd_category"))),
    """SELECT id_equipment, ts_event, ts_end, cd_category, CAST(floor(epoch(ts_end - ts_event)) AS INTEGER) AS duration FROM (SELECT id_equipment, ts_event, ts_end, cd_category FROM equipment_events_man
    UNION ALL SELECT id_equipment, date_trunc('second', ts_value + INTERVAL 250 MILLISECOND), date_trunc('second', ts_value + INTERVAL 90 SECOND), 'OP' FROM equipment_values WHERE state = 10)""",
)
add(
    "ev_pareto",
    lambda t: events.pareto(t.equipment_events),
    f"""SELECT category, round(seconds / 60.0, 1) AS minutes, round(seconds / CAST(sum(seconds) OVER () AS DOUBLE) * 100, 1) AS share,
    round(sum(seconds) OVER (ORDER BY seconds DESC, category ROWS UNBOUNDED PRECEDING) / CAST(sum(seconds) OVER () AS DOUBLE) * 100, 1) AS cumulative
    FROM (SELECT CASE WHEN {OPEN_CATEGORY} THEN 'unjustified' ELSE cd_category END AS category, sum(duration) AS seconds FROM equipment_events WHERE status = 10 AND ts_end IS NOT NULL GROUP BY 1)""",
)
