"""KPI queries."""

from __future__ import annotations


from loomline.functions.columns import ntz, within
from loomline.operators import joins, kpi
from loomline.plans.params import DEFAULT as P
from loomline.plans.registry import add

IN_RANGE = f"ev.ts_value BETWEEN TIMESTAMP '{P.t0}' AND TIMESTAMP '{P.t1}'"
QUALITY = "round(sum(ev.net_production_incr) FILTER (WHERE ev.net_production_incr IS NOT NULL) / nullif(sum(ev.net_production_incr) + sum(ev.scrap_incr) FILTER (WHERE ev.net_production_incr IS NOT NULL), 0) * 100, 1)"
PERFORMANCE = "round(sum(ev.speed) FILTER (WHERE ev.speed > 0 AND e.production_speed > 0) / nullif(sum(e.production_speed) FILTER (WHERE ev.speed > 0 AND e.production_speed > 0), 0) * 100, 1)"
AVAILABILITY = "round(CAST(count(*) FILTER (WHERE ev.state = 6) AS DOUBLE) / nullif(count(ev.state), 0) * 100, 1)"
JOINT = "ev.net_production_incr IS NOT NULL AND ev.state IS NOT NULL AND e.production_speed > 0"
PANEL = f"""round(sum(ev.net_production_incr) FILTER (WHERE {JOINT}) / nullif(sum(ev.net_production_incr) FILTER (WHERE {JOINT}) + sum(ev.scrap_incr) FILTER (WHERE {JOINT}), 0)
    * (sum(CASE WHEN ev.speed > 0 THEN ev.speed ELSE 0 END) FILTER (WHERE {JOINT}) / nullif(sum(CASE WHEN ev.speed > 0 THEN e.production_speed ELSE 0 END) FILTER (WHERE {JOINT}), 0))
    * (CAST(count(*) FILTER (WHERE ev.state = 6 AND {JOINT}) AS DOUBLE) / nullif(count(*) FILTER (WHERE {JOINT}), 0)) * 100, 1)"""
PRODUCT = """round(sum(ev.net_production_incr) / nullif(sum(ev.net_production_incr) + sum(ev.scrap_incr) FILTER (WHERE ev.net_production_incr IS NOT NULL), 0)
    * (sum(ev.speed) FILTER (WHERE ev.speed > 0 AND e.production_speed > 0) / nullif(sum(e.production_speed) FILTER (WHERE ev.speed > 0 AND e.production_speed > 0), 0))
    * (CAST(count(*) FILTER (WHERE ev.state = 6) AS DOUBLE) / nullif(count(ev.state), 0)) * 100, 1)"""
ALL = f"{QUALITY} AS quality, {PERFORMANCE} AS performance, {AVAILABILITY} AS availability, {PANEL} AS oee_panel, {PRODUCT} AS oee_product"
SOURCE = "FROM equipment_values ev JOIN equipments e ON e.id_equipment = ev.id_equipment"


def values(t):
    return t.equipment_values.where(within("ts_value", P))


for name, column, sql in (("quality", "quality", QUALITY), ("performance", "performance", PERFORMANCE), ("availability", "availability", AVAILABILITY), ("oee_panel", "oee_panel", PANEL), ("oee_product", "oee_product", PRODUCT)):
    add(f"kpi_{name}", lambda t, c=column: kpi.one(values(t), t.equipments, c), f"SELECT {sql} AS value {SOURCE} WHERE {IN_RANGE}")

add("kpi_by_equipment", lambda t: kpi.by(values(t), t.equipments, "id_equipment"), f"SELECT ev.id_equipment, {ALL} {SOURCE} WHERE {IN_RANGE} GROUP BY ev.id_equipment")

BANDS = ", ".join(f"CASE WHEN {c} >= {kpi.BANDS[b][1]} THEN 'green' WHEN {c} >= {kpi.BANDS[b][0]} THEN 'yellow' WHEN {c} IS NOT NULL THEN 'red' END AS {b}_band" for c, b in (("quality", "quality"), ("performance", "performance"), ("availability", "availability"), ("oee_panel", "oee")))
add(
    "kpi_band",
    lambda t: kpi.banded(kpi.by(values(t), t.equipments, "id_equipment")),
    f"SELECT id_equipment, {BANDS} FROM (SELECT ev.id_equipment, {ALL} {SOURCE} WHERE {IN_RANGE} GROUP BY ev.id_equipment)",
)
add(
    "kpi_by_hierarchy",
    lambda t: kpi.by_hierarchy(values(t), t.equipments),
    f"""SELECT CAST(4 - bit_count(grouping(ev.id_enterprise, ev.id_site, ev.id_area, ev.id_equipment)) AS INTEGER) AS level, ev.id_enterprise, ev.id_site, ev.id_area, ev.id_equipment, {ALL}
    {SOURCE} WHERE {IN_RANGE} GROUP BY ROLLUP (ev.id_enterprise, ev.id_site, ev.id_area, ev.id_equipment)""",
)
add(
    "kpi_by_shift",
    lambda t: kpi.by(joins.values_in_shifts(values(t), t.shifts, t.shift_hours), t.equipments, "id_shift"),
    f"""SELECT sh.id_shift, {ALL} {SOURCE} JOIN shifts sh ON sh.id_site = ev.id_site JOIN shift_hours h ON h.id_shift = sh.id_shift
    WHERE {IN_RANGE} AND CASE WHEN h.begin_time < h.end_time
        THEN epoch(ev.ts_value - date_trunc('week', ev.ts_value)) >= h.begin_time AND epoch(ev.ts_value - date_trunc('week', ev.ts_value)) < h.end_time
        ELSE epoch(ev.ts_value - date_trunc('week', ev.ts_value)) >= h.begin_time OR epoch(ev.ts_value - date_trunc('week', ev.ts_value)) < h.end_time END GROUP BY sh.id_shift""",
)
LAST_HOUR = "2024-01-30 00:30:00"
add(
    "kpi_minute_aggregate",
    lambda t: kpi.minute_aggregate(t.equipment_values, ntz(LAST_HOUR)),
    f"""SELECT id_equipment, date_trunc('minute', ts_value) AS bucket, sum(net_production_incr) AS net, sum(scrap_incr) AS scrap, round(avg(speed), 1) AS avg_speed,
    round(CAST(count(*) FILTER (WHERE state = 6) AS DOUBLE) / count(*) * 100, 1) AS avail_pct
    FROM equipment_values WHERE ts_value > TIMESTAMP '{LAST_HOUR}' - INTERVAL 1 HOUR GROUP BY id_equipment, bucket ORDER BY id_equipment, bucket DESC LIMIT 30""",
)
