"""Configuration listings, operator activity and health checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline.functions.columns import newest, ntz, within
from loomline.operators import activity, health, joins
from loomline.plans.joins import LEAD_SQL, ROUTING_SQL
from loomline.plans.params import DEFAULT as P
from loomline.plans.registry import PLACES, WHERE_IT_STANDS, add

RANGE = f"BETWEEN TIMESTAMP '{P.t0}' AND TIMESTAMP '{P.t1}'"

add("cfg_enterprises", lambda t: t.enterprises.orderBy("nm_enterprise"), "SELECT id_enterprise, nm_enterprise, active FROM enterprises")
add(
    "cfg_sites",
    lambda t: joins.named(t.sites, t, "enterprise").select("id_site", "nm_enterprise", "nm_site").orderBy("nm_enterprise", "nm_site"),
    "SELECT id_site, nm_enterprise, nm_site FROM sites JOIN enterprises USING (id_enterprise)",
)
add(
    "cfg_areas",
    lambda t: joins.named(t.areas, t, "site", "enterprise").select("id_area", "nm_enterprise", "nm_site", "nm_area", "day_begin").orderBy("nm_enterprise", "nm_site", "nm_area"),
    "SELECT id_area, nm_enterprise, nm_site, nm_area, day_begin FROM areas JOIN sites USING (id_site, id_enterprise) JOIN enterprises USING (id_enterprise)",
)
add("cfg_equipments", lambda t: joins.lead_machines(t).orderBy("nm_enterprise", "nm_site", "nm_area", "nm_equipment"), LEAD_SQL)
add("cfg_packml", lambda t: joins.routing_table(t).orderBy("nm_enterprise", "nm_site", "nm_area", "nm_equipment"), ROUTING_SQL)


def shift_listing(t):
    monday = F.date_trunc("week", ntz(P.as_of)).cast("timestamp_ntz")
    at = lambda c: F.date_format(monday + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col(c).cast("decimal(18,6)")), "E HH:mm")
    wide = t.shifts.join(t.sites.select("id_site", "nm_site"), "id_site").join(t.areas.select("id_area", "nm_area"), "id_area", "left").join(t.shift_hours, "id_shift")
    return wide.select("id_shift", "nm_site", "nm_area", "cd_shift", "nm_shift", at("begin_time").alias("begin_day_time"), at("end_time").alias("end_day_time"), "begin_time", "end_time").orderBy("id_shift", "begin_time")


MONDAY = f"(date_trunc('week', TIMESTAMP '{P.as_of}')"
add(
    "cfg_shifts",
    shift_listing,
    f"""SELECT id_shift, nm_site, nm_area, cd_shift, nm_shift, strftime({MONDAY} + begin_time * INTERVAL 1 SECOND), '%a %H:%M') AS begin_day_time, strftime({MONDAY} + end_time * INTERVAL 1 SECOND), '%a %H:%M') AS end_day_time,
    begin_time, end_time FROM shifts JOIN shift_hours USING (id_shift) JOIN sites USING (id_site) LEFT JOIN areas USING (id_area)""",
)
add(
    "cfg_machines",
    lambda t: t.equipments.where("tp_equipment = 1").select("id_equipment", "nm_equipment", "id_enterprise", "id_site", "id_area").orderBy("id_equipment"),
    "SELECT id_equipment, nm_equipment, id_enterprise, id_site, id_area FROM equipments WHERE tp_equipment = 1",
)
add(
    "cfg_any_site_area",
    lambda t: t.sites.groupBy("id_enterprise").agg(F.min("id_site").alias("id_site")).join(t.areas.groupBy("id_enterprise").agg(F.min("id_area").alias("id_area")), "id_enterprise"),
    "SELECT s.id_enterprise, min(s.id_site) AS id_site, min(a.id_area) AS id_area FROM sites s JOIN areas a ON a.id_enterprise = s.id_enterprise GROUP BY 1",
)
add(
    "cfg_topics",
    lambda t: joins.named(t.packml_register.where("active"), t, "equipment", "enterprise").select("id_packml_register", "packml_topic", "id_equipment", "nm_equipment", "nm_enterprise").orderBy("id_packml_register"),
    f"SELECT id_packml_register, packml_topic, id_equipment, nm_equipment, nm_enterprise FROM packml_register JOIN {PLACES} USING (id_equipment) WHERE active",
)
add(
    "cfg_uns_recent",
    lambda t: joins.named(newest(t.uns_metrics, 30, F.col("ts_value").desc(), F.col("seq").desc()), t, "equipment", "area", "site", "enterprise", how="left").select("seq", "ts_value", "nm_enterprise", "nm_site", "nm_area", "nm_equipment", "metric_name", "metric_value", "metric_type"),
    f"SELECT seq, ts_value, {WHERE_IT_STANDS}, metric_name, metric_value, metric_type FROM uns_metrics LEFT JOIN {PLACES} USING (id_equipment) ORDER BY ts_value DESC, seq DESC LIMIT 30",
)
for key, table, order in (("cfg_last20_values", "equipment_values", "ts_value DESC, id_equipment DESC, speed DESC, state DESC, net_production_incr DESC"), ("cfg_last20_uns", "uns_metrics", "ts_value DESC, seq DESC"), ("cfg_last20", "production_orders", "id_production_order DESC")):
    names = tuple(c.removesuffix(" DESC") for c in order.split(", "))
    add(key, lambda t, n=table, o=names: newest(getattr(t, n), 20, *(F.col(c).desc_nulls_last() for c in o)), f"SELECT * FROM {table} ORDER BY {order.replace(' DESC', ' DESC NULLS LAST')} LIMIT 20")

add("act_active_users", lambda t: t.user_logs.where(within("ts_log", P)).agg(F.count_distinct("nm_user").alias("value")), f"SELECT count(DISTINCT nm_user) AS value FROM user_logs WHERE ts_log {RANGE}")
for key, categories in (("act_po_actions", ("order-started", "order-stopped")), ("act_justified", ("event-justified", "event-edited")), ("act_manual", ("manual-event-created",))):
    add(
        key,
        lambda t, c=categories: joins.by_names(t.user_logs.where(within("ts_log", P) & F.col("category").isin(*c)), t.enterprises, "AFRICA,AMERICA,EUROPE").agg(F.count("*").alias("value")),
        f"SELECT count(*) AS value FROM user_logs WHERE ts_log {RANGE} AND category IN ({', '.join(repr(c) for c in categories)}) AND id_enterprise IN (SELECT id_enterprise FROM enterprises WHERE nm_enterprise IN ('AFRICA', 'AMERICA', 'EUROPE'))",
    )
add("act_per_user", lambda t: activity.per_user(t.user_logs, P), f"SELECT nm_user, count(*) AS actions FROM user_logs WHERE ts_log {RANGE} GROUP BY 1 ORDER BY actions DESC, nm_user LIMIT 20")
add("act_distribution", lambda t: activity.distribution(t.user_logs, P), f"SELECT coalesce(category, 'unknown') AS action, count(*) AS n FROM user_logs WHERE ts_log {RANGE} GROUP BY 1")
JSON = "json_extract_string(payload, '$.{}')"
add(
    "act_log",
    lambda t: activity.log(t.user_logs, P),
    f"""SELECT ts_log, nm_user, category, coalesce({JSON.format('nmProductionOrder')}, '') AS product, coalesce({JSON.format('descCategory')}, '') AS desc_category, coalesce({JSON.format('cdSubcategory')}, '') AS subcategory,
    coalesce({JSON.format('descSubcategory')}, {JSON.format('txtDowntimeNotes')}, {JSON.format('txtProductionOrderNotes')}, '') AS detail, id_equipment FROM user_logs WHERE ts_log {RANGE}
    ORDER BY ts_log DESC, id_equipment, category, payload LIMIT 500""",
)
add(
    "act_json_match",
    lambda t: activity.json_match(t.user_logs, "order-started", "txtProductionOrderNotes", "note"),
    "SELECT ts_log, nm_user, id_equipment, json_extract_string(payload, '$.idProductionOrder') AS matched_id FROM user_logs WHERE category = 'order-started' AND json_extract_string(payload, '$.txtProductionOrderNotes') = 'note'",
)

AS_OF, AGE = "2024-01-29 12:00:00", 86_400
add(
    "health_freshness",
    lambda t: health.freshness(t.equipment_values, AS_OF, AGE),
    f"""SELECT 'freshness' AS "check", coalesce(CAST(id_equipment AS VARCHAR), 'all') AS scope, floor(epoch(TIMESTAMP '{AS_OF}' - max(ts_value))) <= {AGE} AS ok,
    CAST(floor(epoch(TIMESTAMP '{AS_OF}' - max(ts_value))) AS BIGINT) AS detail FROM equipment_values WHERE ts_value <= TIMESTAMP '{AS_OF}' GROUP BY ROLLUP (id_equipment)""",
)
add(
    "health_stale_equipment",
    lambda t: health.stale(t.packml_register, t.equipment_values, AS_OF, AGE),
    f"""SELECT pr.id_equipment, max(v.ts_value) AS last_seen FROM packml_register pr LEFT JOIN (SELECT * FROM equipment_values WHERE ts_value <= TIMESTAMP '{AS_OF}') v ON v.id_equipment = pr.id_equipment
    WHERE pr.active GROUP BY 1 HAVING max(v.ts_value) IS NULL OR floor(epoch(TIMESTAMP '{AS_OF}' - max(v.ts_value))) > {AGE}""",
)
add(
    "health_unresolved",
    lambda t: health.unresolved(t.packml_register, t.equipments.where("tp_equipment = 1")),
    """SELECT pr.id_packml_register, pr.packml_topic FROM packml_register pr LEFT JOIN (SELECT id_equipment FROM equipments WHERE tp_equipment = 1) e ON e.id_equipment = pr.id_equipment
    WHERE pr.active AND e.id_equipment IS NULL""",
)
add(
    "health_sentinel",
    lambda t: health.sentinel(t.uns_metrics.where("metric_name = 'purchase'").select("id_equipment", "ts_value", "metric_value"), t.equipment_values),
    """SELECT u.id_equipment, u.ts_value, u.metric_value, EXISTS (SELECT 1 FROM equipment_values v WHERE v.id_equipment = u.id_equipment AND v.ts_value = u.ts_value AND v.net_production_incr = u.metric_value) AS found
    FROM uns_metrics u WHERE u.metric_name = 'purchase'""",
)
