"""The factory tables as views over the raw tables, one SELECT each, in order of dependence.

The texts run unchanged on Spark and DuckDB.
"""

from __future__ import annotations

VIEWS: dict[str, str] = {
    "enterprises": r"""
        SELECT r_regionkey AS id_enterprise, r_name AS nm_enterprise, (r_regionkey <> 4) AS active FROM region""",
    "sites": r"""
        SELECT n_nationkey AS id_site, n_regionkey AS id_enterprise, n_name AS nm_site FROM nation""",
    "areas": r"""
        SELECT CAST(n.n_nationkey * 2 + k.k AS INT) AS id_area, n.n_nationkey AS id_site, n.n_regionkey AS id_enterprise, CONCAT('Area', CAST(k.k AS STRING))
        AS nm_area, 21600 AS day_begin FROM nation n CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k) k""",
    "equipments": r"""
        SELECT c.c_custkey AS id_equipment, n.n_regionkey AS id_enterprise, n.n_nationkey AS id_site, CAST(n.n_nationkey * 2 + c.c_custkey % 2 AS INT) AS
        id_area, c.c_name AS nm_equipment, CAST(1 + c.c_custkey % 3 AS INT) AS tp_equipment, CAST(CASE WHEN c.c_custkey % 7 = 0 THEN 0 ELSE 60 + (c.c_custkey
        % 5) * 20 END AS DOUBLE) AS production_speed, CASE WHEN c.c_custkey % 3 = 2 THEN c.c_custkey - 2 END AS lead_machine FROM customer c JOIN nation n ON
        n.n_nationkey = c.c_nationkey""",
    "packml_register": r"""
        SELECT e.id_equipment AS id_packml_register, e.id_enterprise, e.id_site, e.id_area, e.id_equipment, CONCAT(ent.nm_enterprise, '/', s.nm_site, '/',
        a.nm_area, '/', e.nm_equipment) AS packml_topic, (e.id_equipment % 10 <> 9) AS active, e.id_equipment AS id_unit, CAST(e.id_equipment % 101 AS INT) AS
        signal_quality FROM equipments e JOIN areas a ON a.id_area = e.id_area JOIN sites s ON s.id_site = e.id_site JOIN enterprises ent ON ent.id_enterprise
        = e.id_enterprise""",
    "raw_metrics": r"""
        SELECT ev.event_id AS seq, date_trunc('day', ev.ts) + INTERVAL 250 MILLISECONDS * CAST(ev.event_id % 4 AS INT) AS ts_metric, CONCAT(pr.packml_topic,
        '/Status/', CASE ev.event_type WHEN 'purchase' THEN 'ProdProcessedCount' WHEN 'signup' THEN 'ProdDefectiveCount' WHEN 'click' THEN 'CurMachSpeed' ELSE
        'StateCurrent' END) AS name, CASE ev.event_type WHEN 'view' THEN CAST(6.0 AS DOUBLE) WHEN 'error' THEN CAST(10.0 AS DOUBLE) WHEN 'signup' THEN
        CAST(1.0 AS DOUBLE) WHEN 'purchase' THEN CAST(floor(ev.value) AS DOUBLE) ELSE ev.value END AS value FROM events ev JOIN packml_register pr ON
        pr.id_equipment = ev.user_id""",
    "equipment_values": r"""
        SELECT ev.ts AS ts_value, e.id_enterprise, e.id_site, e.id_area, e.id_equipment, CASE WHEN ev.event_type IN ('purchase','view') THEN
        CAST(floor(ev.value) AS DOUBLE) END AS net_production_incr, CASE WHEN ev.event_type = 'purchase' THEN CAST(CAST(floor(ev.value) AS INT) % 3 AS DOUBLE)
        END AS scrap_incr, CASE WHEN ev.event_type = 'error' THEN 10 WHEN ev.event_type <> 'signup' AND ev.event_id % 11 = 0 THEN 10 WHEN ev.event_type <>
        'signup' THEN 6 END AS state, CASE WHEN ev.event_type = 'error' THEN 3 WHEN ev.event_type <> 'signup' THEN 1 END AS mode, CASE WHEN ev.event_type =
        'error' THEN CAST(0 AS DOUBLE) WHEN ev.event_type <> 'signup' THEN ev.value END AS speed, 100 AS signal_quality FROM events ev JOIN equipments e ON
        e.id_equipment = ev.user_id""",
    "uns_metrics": r"""
        SELECT ev.event_id AS seq, ev.ts AS ts_value, e.id_enterprise, e.id_site, e.id_area, e.id_equipment, ev.event_type AS metric_name,
        CAST(floor(ev.value) AS DOUBLE) AS metric_value, 'double' AS metric_type FROM events ev JOIN equipments e ON e.id_equipment = ev.user_id""",
    "equipment_events": r"""
        SELECT o.o_orderkey AS id_equipment_event, e.id_enterprise, e.id_equipment, o.o_orderdate AS ts_event, CASE WHEN o.o_orderstatus <> 'O' THEN
        o.o_orderdate + INTERVAL '1' SECOND * CAST(60 + o.o_orderkey % 7200 AS INT) END AS ts_end, CASE WHEN o.o_orderstatus <> 'O' THEN CAST(60 +
        o.o_orderkey % 7200 AS INT) END AS duration, CASE WHEN o.o_orderkey % 4 = 0 THEN 6 ELSE 10 END AS status, CASE SUBSTR(o.o_orderpriority, 1, 1) WHEN
        '1' THEN 'MEC' WHEN '2' THEN 'ELE' WHEN '3' THEN 'OP' WHEN '4' THEN '' END AS cd_category, (o.o_orderkey % 17 = 0) AS planned_downtime, (o.o_orderkey
        % 13 = 0) AS change_over, (o.o_orderkey % 19 = 0) AS forced_creation_system FROM orders o JOIN equipments e ON e.id_equipment = o.o_custkey""",
    "equipment_events_man": r"""
        SELECT l.l_orderkey AS id_equipment_event, e.id_enterprise, e.id_equipment, l.l_shipdate AS ts_event, CASE WHEN l.l_linestatus = 'F' THEN l.l_shipdate
        + INTERVAL '1' SECOND * CAST(l.l_quantity * 10 AS INT) + INTERVAL 250 MILLISECONDS * CAST(l.l_linenumber % 2 AS INT) END AS ts_end, CASE WHEN
        l.l_linestatus = 'F' THEN CAST(l.l_quantity * 10 AS INT) END AS duration, CASE l.l_returnflag WHEN 'A' THEN 'MEC' WHEN 'R' THEN '' END AS cd_category,
        (l.l_linenumber = 7) AS forced_creation_system FROM lineitem l JOIN equipments e ON e.id_equipment = l.l_suppkey WHERE l.l_linenumber <= 7 AND
        l.l_orderkey % 10 = 0""",
    "production_orders": r"""
        SELECT o.o_orderkey AS id_production_order, e.id_enterprise, e.id_site, e.id_area, e.id_equipment, CASE WHEN o.o_orderkey % 8 = 0 THEN 1 WHEN
        o.o_orderstatus = 'O' THEN 2 WHEN o.o_orderstatus = 'F' THEN 3 ELSE 4 END AS status, CONCAT('PO-', CAST(o.o_orderkey AS STRING)) AS
        nm_production_order, CASE WHEN o.o_orderkey % 8 <> 0 THEN o.o_orderdate END AS ts_start, CASE WHEN o.o_orderkey % 8 <> 0 AND o.o_orderstatus = 'F'
        THEN o.o_orderdate + INTERVAL '1' DAY END AS ts_end, o.o_totalprice AS production_final FROM orders o JOIN equipments e ON e.id_equipment =
        o.o_custkey""",
    "production_orders_runtime": r"""
        SELECT ev.event_id AS id_production_order_runtime, ev.event_id AS id_production_order, ev.user_id AS id_equipment, ev.ts AS ts_start, LEAD(ev.ts) OVER
        (PARTITION BY ev.user_id ORDER BY ev.ts, ev.event_id) AS ts_end FROM events ev WHERE ev.event_type = 'signup'""",
    "shifts": r"""
        SELECT CAST(s.id_site * 3 + k.k AS INT) AS id_shift, s.id_site, CAST(NULL AS INT) AS id_area, CONCAT('S', CAST(k.k AS STRING)) AS cd_shift,
        CONCAT('Shift ', CAST(k.k AS STRING)) AS nm_shift FROM sites s CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k UNION ALL SELECT 2 AS k) k""",
    "shift_hours": r"""
        SELECT sh.id_shift, CAST(d.d * 86400 + 21600 + (sh.id_shift % 3) * 28800 AS INT) AS begin_time, CAST((d.d * 86400 + 21600 + (sh.id_shift % 3 + 1) *
        28800) % 604800 AS INT) AS end_time FROM shifts sh CROSS JOIN (SELECT 0 AS d UNION ALL SELECT 1 AS d UNION ALL SELECT 2 AS d UNION ALL SELECT 3 AS d
        UNION ALL SELECT 4 AS d UNION ALL SELECT 5 AS d UNION ALL SELECT 6 AS d) d""",
    "user_logs": r"""
        SELECT ev.ts AS ts_log, CONCAT('user.', CAST(ev.user_id % 7 AS STRING)) AS nm_user, e.id_enterprise, e.id_equipment, CASE ev.event_type WHEN 'click'
        THEN 'event-justified' WHEN 'view' THEN 'event-edited' WHEN 'purchase' THEN 'order-started' WHEN 'signup' THEN 'order-stopped' ELSE
        'manual-event-created' END AS category, CASE ev.event_type WHEN 'purchase' THEN CONCAT('{"idProductionOrder": ', CAST(ev.event_id AS STRING), ',
        "nmProductionOrder": "PO-', CAST(ev.event_id AS STRING), '", "txtProductionOrderNotes": "note"}') WHEN 'click' THEN '{"descCategory": "Mechanical",
        "cdSubcategory": "JAM", "descSubcategory": "Conveyor jam"}' WHEN 'error' THEN '{"descCategory": null, "txtDowntimeNotes": "manual entry"}' ELSE
        ev.props END AS payload FROM events ev JOIN equipments e ON e.id_equipment = ev.user_id""",
    "event_actions": r"""
        SELECT ev.event_id AS seq, ev.ts AS ts_action, CAST(ev.event_id % 1500 AS BIGINT) AS id_equipment_event, CASE WHEN ev.event_type IN ('click','view')
        THEN 'MEC' ELSE 'ELE' END AS cd_category, ev.event_type AS cd_subcategory FROM events ev WHERE ev.event_id % 3 = 0""",
    "order_actions": r"""
        SELECT ev.event_id AS seq, ev.ts AS ts_action, CAST(ev.event_id % 400 AS BIGINT) AS id_production_order, CASE ev.event_type WHEN 'signup' THEN 'start'
        WHEN 'error' THEN 'start' WHEN 'purchase' THEN 'stop-finish' WHEN 'click' THEN 'stop-pause' ELSE 'change-status' END AS action FROM events ev""",
    "service_logs": r"""
        SELECT ev.ts AS ts, CASE CAST(ev.user_id % 4 AS INT) WHEN 0 THEN 'edge-nodered' WHEN 1 THEN 'oeecloud' WHEN 2 THEN 'edge-api' ELSE 'simulator' END AS
        service, CONCAT('{"level": "', CASE WHEN ev.event_type = 'error' THEN 'ERROR' ELSE 'info' END, '", "msg": "', CASE ev.event_type WHEN 'click' THEN
        'pubsub_pub' WHEN 'view' THEN 'pubsub_rcv' WHEN 'error' THEN 'Exception raised' ELSE 'tick' END, '"}') AS line FROM events ev""",
}
