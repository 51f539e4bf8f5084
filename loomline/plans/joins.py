"""Queries of join shapes, scopes, aggregates and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline.functions.columns import ntz, within
from loomline.operators import joins
from loomline.plans.params import DEFAULT as P
from loomline.plans.registry import PLACES, WHERE_IT_STANDS, add

RANGE = f"BETWEEN TIMESTAMP '{P.t0}' AND TIMESTAMP '{P.t1}'"
NAMES = "AFRICA,ASIA"
AS_OF = "2024-01-29 12:00:00"

add(
    "join_fact_dim",
    lambda t: t.equipment_values.where(within("ts_value", P)).join(t.equipments.select("id_equipment", "production_speed"), "id_equipment").groupBy("id_equipment", "production_speed").agg(F.count("*").alias("n")),
    f"SELECT e.id_equipment, e.production_speed, count(*) AS n FROM equipment_values ev JOIN equipments e ON e.id_equipment = ev.id_equipment WHERE ev.ts_value {RANGE} GROUP BY ALL",
)
add(
    "join_latest_rows",
    joins.latest_rows,
    f"""SELECT ts_value, {WHERE_IT_STANDS}, net_production_incr, scrap_incr, state, mode, speed, signal_quality, id_equipment FROM equipment_values JOIN {PLACES} USING (id_equipment)
    ORDER BY ts_value DESC, id_equipment NULLS FIRST, state NULLS FIRST, speed NULLS FIRST, net_production_incr NULLS FIRST LIMIT 50""",
)
add(
    "join_orders_left",
    lambda t: joins.named(t.production_orders, t, "equipment", "area", "site", "enterprise", how="left").select("id_production_order", "nm_enterprise", "nm_site", "nm_area", "nm_equipment", "status"),
    f"SELECT id_production_order, {WHERE_IT_STANDS}, status FROM production_orders LEFT JOIN {PLACES} USING (id_equipment)",
)
LEAD_SQL = f"""SELECT places.*, coalesce(MAP {{1: 'Machine', 2: 'Sector', 3: 'Line'}}[x.tp_equipment], CAST(x.tp_equipment AS VARCHAR)) AS tp_equipment, x.lead_machine, y.nm_equipment AS nm_lead_machine
    FROM equipments AS x JOIN {PLACES} USING (id_equipment) LEFT JOIN equipments AS y ON x.lead_machine = y.id_equipment"""
ROUTING_SQL = f"""SELECT id_packml_register, {WHERE_IT_STANDS}, packml_topic, active, if(active, 'Active', 'Inactive') AS active_label, id_unit, signal_quality
    FROM packml_register JOIN {PLACES} USING (id_equipment)"""
add("join_lead_machine", joins.lead_machines, LEAD_SQL)
add("join_routing_table", joins.routing_table, ROUTING_SQL)
add(
    "join_free_equipment",
    joins.free_equipment,
    "SELECT id_equipment, nm_equipment FROM equipments e WHERE tp_equipment = 1 AND NOT EXISTS (SELECT 1 FROM production_orders po WHERE po.status = 2 AND po.id_equipment = e.id_equipment)",
)
for key, how, word in (("join_available_orders", "left_anti", "NOT EXISTS"), ("join_replaceable_orders", "left_semi", "EXISTS")):
    add(
        key,
        lambda t, h=how: joins.orders_by_running(t, h),
        f"SELECT id_production_order, id_equipment, nm_production_order FROM production_orders p WHERE status = 1 AND {word} (SELECT 1 FROM production_orders r WHERE r.status = 2 AND r.id_equipment = p.id_equipment)",
    )
for key, how, word in (("join_running_runtime", "inner", "JOIN"), ("join_running_state", "left", "LEFT JOIN")):
    add(
        key,
        lambda t, h=how: joins.open_runtimes(t, h),
        f"""SELECT po.id_production_order, po.id_equipment, rt.id_production_order_runtime, rt.ts_start AS runtime_start FROM production_orders po
        {word} production_orders_runtime rt ON rt.id_production_order = po.id_production_order AND rt.ts_end IS NULL WHERE po.status = 2""",
    )
add(
    "join_value_runtime",
    lambda t: joins.values_in_runtimes(t.equipment_values.select("id_equipment", "ts_value", "speed"), t.production_orders_runtime).select("id_equipment", "ts_value", "id_production_order_runtime"),
    """SELECT ev.id_equipment, ev.ts_value, rt.id_production_order_runtime FROM equipment_values ev JOIN production_orders_runtime rt ON rt.id_equipment = ev.id_equipment
    AND ev.ts_value >= rt.ts_start AND (rt.ts_end IS NULL OR ev.ts_value < rt.ts_end)""",
)
SECOND = "epoch(ev.ts_value - date_trunc('week', ev.ts_value))"
add(
    "join_value_shift",
    lambda t: joins.values_in_shifts(t.equipment_values, t.shifts, t.shift_hours).groupBy("id_shift").agg(F.count("*").alias("n"), F.sum("net_production_incr").alias("net")),
    f"""SELECT sh.id_shift, count(*) AS n, sum(ev.net_production_incr) AS net FROM equipment_values ev JOIN shifts sh ON sh.id_site = ev.id_site JOIN shift_hours h ON h.id_shift = sh.id_shift
    WHERE CASE WHEN h.begin_time < h.end_time THEN {SECOND} >= h.begin_time AND {SECOND} < h.end_time ELSE {SECOND} >= h.begin_time OR {SECOND} < h.end_time END GROUP BY sh.id_shift""",
)
add(
    "join_topic_prefix",
    joins.topic_prefix,
    "SELECT m.seq, pr.packml_topic AS topic, pr.id_equipment FROM raw_metrics m JOIN packml_register pr ON pr.packml_topic = array_to_string(string_split(m.name, '/')[1:4], '/')",
)
add(
    "join_asof_state",
    lambda t: joins.asof_state(t.equipment_values),
    """SELECT v.id_equipment, v.ts_value, max(struct_pack(a := s.ts_value, b := s.state)).b AS state FROM equipment_values v
    LEFT JOIN (SELECT id_equipment, ts_value, state FROM equipment_values WHERE state IS NOT NULL) s ON s.id_equipment = v.id_equipment AND s.ts_value <= v.ts_value GROUP BY v.rowid_, v.id_equipment, v.ts_value""".replace(
        "FROM equipment_values v\n", "FROM (SELECT *, row_number() OVER () AS rowid_ FROM equipment_values) v\n"
    ),
)
FACTS = ("equipment_values", "equipment_events", "uns_metrics", "production_orders", "packml_register")
add("join_scalar_counts", lambda t: joins.counts({n: getattr(t, n) for n in FACTS}), "SELECT " + ", ".join(f"(SELECT count(*) FROM {n}) AS {n}" for n in FACTS))
add(
    "set_table_counts",
    lambda t: joins.table_counts({n: getattr(t, n) for n in (*FACTS, "equipments")}),
    " UNION ALL ".join(f"SELECT '{n}' AS tbl, count(*) AS n FROM {n}" for n in (*FACTS, "equipments")),
)

add(
    "scope_cascade",
    lambda t: joins.cascade(t, [1, 2]),
    """SELECT 'site' AS level, CAST(id_site AS BIGINT) AS id, nm_site AS name FROM sites WHERE id_enterprise IN (1, 2)
    UNION ALL SELECT 'area', CAST(id_area AS BIGINT), nm_area FROM areas WHERE id_site IN (SELECT id_site FROM sites WHERE id_enterprise IN (1, 2))
    UNION ALL SELECT 'equipment', CAST(id_equipment AS BIGINT), nm_equipment FROM equipments WHERE id_area IN (SELECT id_area FROM areas WHERE id_site IN (SELECT id_site FROM sites WHERE id_enterprise IN (1, 2)))""",
)
add(
    "scope_ids",
    lambda t: joins.scope_ids(t.equipments, enterprise=[0, 1, 3], site=list(range(0, 20)), area=list(range(0, 40, 3)), equipment=None).select("id_equipment", "nm_equipment"),
    "SELECT id_equipment, nm_equipment FROM equipments WHERE id_enterprise IN (0, 1, 3) AND id_site < 20 AND id_area % 3 = 0 AND id_area < 40",
)
add(
    "scope_by_name",
    lambda t: joins.by_names(t.user_logs, t.enterprises, NAMES).groupBy("id_enterprise").agg(F.count("*").alias("n")),
    "SELECT id_enterprise, count(*) AS n FROM user_logs WHERE id_enterprise IN (SELECT id_enterprise FROM enterprises WHERE nm_enterprise IN ('AFRICA', 'ASIA')) GROUP BY id_enterprise",
)
add("scope_active_enterprises", lambda t: t.enterprises.where("active").select("id_enterprise", "nm_enterprise").orderBy("nm_enterprise"), "SELECT id_enterprise, nm_enterprise FROM enterprises WHERE active")
add("scope_users", lambda t: t.user_logs.select("nm_user").distinct().orderBy("nm_user"), "SELECT DISTINCT nm_user FROM user_logs")
add("scope_categories", lambda t: t.user_logs.select("category").distinct().orderBy("category"), "SELECT DISTINCT category FROM user_logs")
add(
    "filter_topic_depth",
    joins.topic_depth,
    """SELECT id_enterprise, packml_topic, id_equipment FROM (SELECT pr.id_enterprise, pr.packml_topic, pr.id_equipment,
    row_number() OVER (PARTITION BY pr.id_enterprise ORDER BY e.tp_equipment = 1, pr.packml_topic, pr.id_equipment) AS k FROM packml_register pr JOIN equipments e ON e.id_equipment = pr.id_equipment
    WHERE pr.active AND len(string_split(pr.packml_topic, '/')) = 4) WHERE k = 1""",
)

recent = lambda t, span: t.equipment_values.where(F.col("ts_value") > ntz(AS_OF) - F.expr(f"INTERVAL {span}"))
add("agg_total_rows", lambda t: t.equipment_values.agg(F.count("*").alias("value")), "SELECT count(*) AS value FROM equipment_values")
for key, span in (("agg_rows_5min", "5 MINUTE"), ("agg_rows_1h", "1 HOUR")):
    add(key, lambda t, s=span: recent(t, s).agg(F.count("*").alias("value")), f"SELECT count(*) AS value FROM equipment_values WHERE ts_value > TIMESTAMP '{AS_OF}' - INTERVAL {span}")
add(
    "agg_last_message",
    lambda t: t.equipment_values.agg(F.unix_millis(F.max("ts_value").cast("timestamp")).alias("value")),
    "SELECT epoch_us(max(ts_value)) // 1000 AS value FROM equipment_values",
)
add("agg_active_registrations", lambda t: t.packml_register.where("active").agg(F.count("*").alias("value")), "SELECT count(*) AS value FROM packml_register WHERE active")
add(
    "agg_distinct_reporting",
    lambda t: recent(t, "1 DAY").agg(F.count_distinct("id_equipment").alias("value")),
    f"SELECT count(DISTINCT id_equipment) AS value FROM equipment_values WHERE ts_value > TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY",
)
add("agg_uns_count", lambda t: t.uns_metrics.agg(F.count("*").alias("value")), "SELECT count(*) AS value FROM uns_metrics")
add(
    "agg_runtime_floor",
    lambda t: joins.runtime_floor(t.production_orders_runtime),
    """SELECT r.id_production_order_runtime, r.id_equipment, max(o.ts_end) AS floor FROM production_orders_runtime r LEFT JOIN production_orders_runtime o
    ON o.id_equipment = r.id_equipment AND o.id_production_order_runtime <> r.id_production_order_runtime AND o.ts_end IS NOT NULL GROUP BY ALL""",
)
add(
    "set_consistency",
    lambda t: joins.consistent(t.packml_register.select("packml_topic"), t.packml_register.where("active").select("packml_topic")),
    """SELECT (SELECT count(*) FROM packml_register) AS n_left, (SELECT count(*) FROM packml_register WHERE active) AS n_right,
    (SELECT count(*) FROM (SELECT packml_topic FROM packml_register EXCEPT ALL SELECT packml_topic FROM packml_register WHERE active)) AS only_left, CAST(0 AS BIGINT) AS only_right,
    (SELECT count(*) FROM packml_register) = (SELECT count(*) FROM packml_register WHERE active) AS ok""",
)
add(
    "set_unused_products",
    lambda t: joins.unused(t.equipments.select(F.col("nm_equipment").alias("nm")), t.production_orders.where("status = 2").join(t.equipments, "id_equipment").select(F.col("nm_equipment").alias("nm")).distinct()),
    """SELECT nm_equipment AS nm FROM equipments WHERE nm_equipment NOT IN (SELECT e.nm_equipment FROM production_orders po JOIN equipments e ON e.id_equipment = po.id_equipment WHERE po.status = 2)""",
)
