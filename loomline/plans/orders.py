"""Order and runtime queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loomline.operators import orders
from loomline.plans.params import DEFAULT as P
from loomline.plans.registry import PLACES, WHERE_IT_STANDS, add
from loomline.sources.sinks import work_dir

INSIDE = "ev.id_equipment = rt.id_equipment AND ev.ts_value >= rt.ts_start AND (rt.ts_end IS NULL OR ev.ts_value < rt.ts_end)"
TOTALS = f"SELECT rt.id_production_order_runtime, sum(ev.net_production_incr) AS net_production, sum(ev.scrap_incr) AS scrap, count(*) AS ticks FROM production_orders_runtime rt JOIN equipment_values ev ON {INSIDE} GROUP BY rt.id_production_order_runtime"

add(
    "po_recent",
    orders.recent,
    f"""SELECT id_production_order, {WHERE_IT_STANDS}, status, ['Available', 'Running', 'Finished', 'Paused'][status] AS status_label, nm_production_order, ts_start, ts_end, production_final
    FROM production_orders LEFT JOIN {PLACES} USING (id_equipment) ORDER BY id_production_order DESC LIMIT 100""",
)
add(
    "po_runtimes_recent",
    orders.recent_runtimes,
    """SELECT id_production_order_runtime, nm_production_order, o.status AS po_status, nm_equipment, r.ts_start, r.ts_end FROM production_orders_runtime AS r
    JOIN production_orders AS o USING (id_production_order) LEFT JOIN equipments AS m ON m.id_equipment = r.id_equipment ORDER BY id_production_order_runtime DESC LIMIT 100""",
)
for key, status in (("po_running", 2), ("po_paused", 4), ("po_available", 1)):
    add(
        key,
        lambda t, s=status: orders.by_status(t.production_orders, s),
        f"SELECT id_production_order, id_equipment, nm_production_order, coalesce(production_final, 0.0) AS production_final FROM production_orders WHERE status = {status} ORDER BY id_production_order LIMIT 20",
    )
add(
    "po_running_hierarchy",
    orders.running_hierarchy,
    f"SELECT id_production_order, {WHERE_IT_STANDS}, id_equipment FROM production_orders JOIN {PLACES} USING (id_equipment) WHERE status = 2 ORDER BY id_production_order LIMIT 20",
)
add(
    "po_fold_actions",
    lambda t: orders.fold_actions(t.production_orders, t.order_actions),
    """WITH RECURSIVE steps AS (SELECT id_production_order, action, row_number() OVER (PARTITION BY id_production_order ORDER BY ts_action, seq, action) AS k FROM order_actions),
    allowed(status, action, new) AS (VALUES (1, 'start', 2), (2, 'stop-finish', 3), (2, 'stop-pause', 4), (4, 'change-status', 3)),
    fold AS (SELECT id_production_order, id_equipment, status AS before, status AS after, 0 AS illegal, 0 AS n_actions FROM production_orders
        UNION ALL SELECT f.id_production_order, f.id_equipment, f.before, coalesce(a.new, f.after), f.illegal + CASE WHEN a.new IS NULL THEN 1 ELSE 0 END, f.n_actions + 1
        FROM fold f JOIN steps s ON s.id_production_order = f.id_production_order AND s.k = f.n_actions + 1 LEFT JOIN allowed a ON a.status = f.after AND a.action = s.action)
    SELECT f.* FROM fold f JOIN (SELECT id_production_order, max(k) AS k FROM steps GROUP BY 1) m ON m.id_production_order = f.id_production_order AND m.k = f.n_actions""",
)
add(
    "po_changeover",
    lambda t: orders.changeover(t.production_orders, t.order_actions),
    """SELECT a.seq, a.ts_action, o.id_equipment, x.position, CASE x.position WHEN 0 THEN a.id_production_order ELSE -a.seq END AS order_id, CASE x.position WHEN 0 THEN 'stop-finish' ELSE 'start' END AS step
    FROM order_actions a JOIN production_orders o ON o.id_production_order = a.id_production_order CROSS JOIN (SELECT unnest([0, 1]) AS position) x WHERE a.action = 'change-status'""",
)


def replacements(t):
    """The lowest available order of each equipment takes over."""
    return t.production_orders.where("status = 1").groupBy("id_equipment").agg(F.min("id_production_order").alias("new_order"))


add(
    "po_replace",
    lambda t: orders.replace(t.production_orders_runtime, replacements(t)),
    """SELECT r.id_production_order_runtime, r.id_equipment, CASE WHEN r.k = 1 AND n.id_equipment IS NOT NULL THEN n.new_order ELSE r.id_production_order END AS id_production_order
    FROM (SELECT *, row_number() OVER (PARTITION BY id_equipment ORDER BY ts_start DESC, id_production_order_runtime DESC) AS k FROM production_orders_runtime) r
    LEFT JOIN (SELECT id_equipment, min(id_production_order) AS new_order FROM production_orders WHERE status = 1 GROUP BY 1) n ON n.id_equipment = r.id_equipment""",
)
add(
    "po_change_time",
    lambda t: orders.change_time(t.production_orders_runtime, P),
    f"""SELECT id_production_order_runtime, id_equipment, new_start, new_start <= TIMESTAMP '{P.as_of}' - INTERVAL 1 MINUTE AS accepted FROM
    (SELECT r.id_production_order_runtime, r.id_equipment, CASE WHEN max(o.ts_end) IS NOT NULL THEN max(o.ts_end) + INTERVAL 1 SECOND ELSE r.ts_start + INTERVAL 5 MINUTE END AS new_start
    FROM production_orders_runtime r LEFT JOIN production_orders_runtime o ON o.id_equipment = r.id_equipment AND o.id_production_order_runtime <> r.id_production_order_runtime AND o.ts_end IS NOT NULL
    GROUP BY r.id_production_order_runtime, r.id_equipment, r.ts_start)""",
)
add("po_runtime_totals", lambda t: orders.totals(t.equipment_values, t.production_orders_runtime), TOTALS)


def recalculated(t):
    """Totals of nine tenths of the ticks, stored by day, brought up to date for the runtimes that the rest falls into."""
    path = f"{work_dir(t.spark)}/totals-{uuid.uuid4().hex}"
    late = F.pmod(F.xxhash64("ts_value", "id_equipment"), F.lit(10)) == 0
    orders.store_totals(orders.totals(t.equipment_values.where(~late), t.production_orders_runtime), t.production_orders_runtime, path)
    orders.recalc_stored(path, t.equipment_values, t.production_orders_runtime, t.equipment_values.where(late))
    return t.spark.read.parquet(path).drop("day")


add("po_recalc", recalculated, TOTALS)
add(
    "po_overlaps",
    lambda t: orders.overlaps(t.production_orders_runtime),
    """SELECT id_production_order_runtime, id_equipment, ts_start, earlier_end FROM (SELECT *, max(coalesce(ts_end, TIMESTAMP '9999-12-31')) OVER
    (PARTITION BY id_equipment ORDER BY ts_start, id_production_order_runtime ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier_end FROM production_orders_runtime) WHERE ts_start < earlier_end""",
)
add(
    "po_progress",
    lambda t: orders.progress(t.production_orders, orders.totals(t.equipment_values, t.production_orders_runtime), t.production_orders_runtime),
    f"""SELECT po.id_production_order, x.produced, round(x.produced / nullif(po.production_final, 0) * 100, 1) AS progress FROM production_orders po JOIN
    (SELECT rt.id_production_order, sum(y.net_production) AS produced FROM ({TOTALS}) y JOIN production_orders_runtime rt ON rt.id_production_order_runtime = y.id_production_order_runtime GROUP BY 1) x
    ON x.id_production_order = po.id_production_order""",
)
