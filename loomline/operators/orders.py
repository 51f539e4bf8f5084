"""Production orders and their runtimes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomline.functions.columns import newest, ntz
from loomline.operators.joins import named, runtime_floor, values_in_runtimes
from loomline.plans.params import Params

STATUS = {1: "Available", 2: "Running", 3: "Finished", 4: "Paused"}  # fixed values
#: (status, action) -> status (fixed values)
STEPS = {(1, "start"): 2, (2, "stop-finish"): 3, (2, "stop-pause"): 4, (4, "change-status"): 3}


def label(column: str = "status"):
    found = None
    for code, name in STATUS.items():
        found = F.when(F.col(column) == code, name) if found is None else found.when(F.col(column) == code, name)
    return found


def recent(t, n: int = 100) -> DataFrame:
    rows = newest(t.production_orders, n, F.col("id_production_order").desc())
    wide = named(rows, t, "equipment", "area", "site", "enterprise", how="left")
    return wide.select("id_production_order", "nm_enterprise", "nm_site", "nm_area", "nm_equipment", "status", label().alias("status_label"), "nm_production_order", "ts_start", "ts_end", "production_final")


def recent_runtimes(t, n: int = 100) -> DataFrame:
    po = t.production_orders.select("id_production_order", "nm_production_order", F.col("status").alias("po_status"))
    rows = newest(t.production_orders_runtime.join(po, "id_production_order"), n, F.col("id_production_order_runtime").desc())
    wide = rows.join(t.equipments.select("id_equipment", "nm_equipment"), "id_equipment", "left")
    return wide.select("id_production_order_runtime", "nm_production_order", "po_status", "nm_equipment", "ts_start", "ts_end")


def by_status(orders: DataFrame, status: int, n: int = 20) -> DataFrame:
    rows = orders.where(F.col("status") == status)
    shown = rows.select("id_production_order", "id_equipment", "nm_production_order", F.coalesce("production_final", F.lit(0.0)).alias("production_final"))
    return newest(shown, n, F.col("id_production_order"))


def running_hierarchy(t, n: int = 20) -> DataFrame:
    rows = newest(t.production_orders.where("status = 2"), n, F.col("id_production_order"))
    return named(rows, t, "equipment", "area", "site", "enterprise").select("id_production_order", "nm_enterprise", "nm_site", "nm_area", "nm_equipment", "id_equipment")


def fold_actions(orders: DataFrame, actions: DataFrame) -> DataFrame:
    """Status of each order after its actions in order of time, and how many steps were illegal.

    An order's actions, a few in its life, are gathered per order and folded in an expression.
    """
    step = F.struct("ts_action", "seq", "action")
    per_order = actions.groupBy("id_production_order").agg(F.array_sort(F.collect_list(step)).alias("steps"))

    def apply(acc, s):
        to = F.lit(None).cast("int")
        for (status, action), new in STEPS.items():
            to = F.when((acc["status"] == status) & (s["action"] == action), F.lit(new)).otherwise(to)
        return F.struct(F.coalesce(to, acc["status"]).alias("status"), (acc["illegal"] + to.isNull().cast("int")).alias("illegal"))

    joined = orders.select("id_production_order", "id_equipment", "status").join(per_order, "id_production_order")
    folded = joined.withColumn("end", F.aggregate("steps", F.struct(F.col("status").cast("int").alias("status"), F.lit(0).alias("illegal")), apply))
    return folded.select("id_production_order", "id_equipment", F.col("status").alias("before"), F.col("end.status").alias("after"), F.col("end.illegal").alias("illegal"), F.size("steps").alias("n_actions"))


def several_running(folded: DataFrame) -> DataFrame:
    """Equipment that would run more than one order at once."""
    return folded.where("after = 2").groupBy("id_equipment").agg(F.count("*").alias("running")).where("running > 1")


def changeover(orders: DataFrame, actions: DataFrame) -> DataFrame:
    """Each change-status action as two transitions: the order stops, and a new one starts on its equipment."""
    act = actions.where("action = 'change-status'").join(orders.select("id_production_order", "id_equipment"), "id_production_order")
    stop = F.struct(F.lit(0).alias("position"), F.col("id_production_order").alias("order_id"), F.lit("stop-finish").alias("step"))
    start = F.struct(F.lit(1).alias("position"), (-F.col("seq")).alias("order_id"), F.lit("start").alias("step"))
    return act.select("seq", "ts_action", "id_equipment", F.explode(F.array(stop, start)).alias("x")).select("seq", "ts_action", "id_equipment", "x.position", "x.order_id", "x.step")


def replace(runtimes: DataFrame, replacements: DataFrame) -> DataFrame:
    """Runtimes where the newest of an equipment is given to the order in replacements(id_equipment, new_order)."""
    newest_of = runtimes.groupBy("id_equipment").agg(F.max_by("id_production_order_runtime", F.struct("ts_start", "id_production_order_runtime")).alias("newest"))
    marked = runtimes.join(newest_of.join(replacements, "id_equipment"), "id_equipment", "left")
    order = F.when(F.col("id_production_order_runtime") == F.col("newest"), F.col("new_order")).otherwise(F.col("id_production_order"))
    return marked.select("id_production_order_runtime", "id_equipment", order.alias("id_production_order"))


def change_time(runtimes: DataFrame, p: Params, seconds: int = 1, minutes: int = 5) -> DataFrame:
    """A new start for each runtime: just after the floor, or later than its own start if there is no floor.

    Rejected, and kept with the reason, if it is less than a minute before as_of.
    """
    moved = runtimes.join(runtime_floor(runtimes).select("id_production_order_runtime", "floor"), "id_production_order_runtime")
    start = F.when(F.col("floor").isNotNull(), F.col("floor") + F.expr(f"INTERVAL {seconds} SECONDS")).otherwise(F.col("ts_start") + F.expr(f"INTERVAL {minutes} MINUTES"))
    shown = moved.select("id_production_order_runtime", "id_equipment", start.alias("new_start"))
    return shown.withColumn("accepted", F.col("new_start") <= ntz(p.as_of) - F.expr("INTERVAL 1 MINUTE"))


def totals(values: DataFrame, runtimes: DataFrame) -> DataFrame:
    """Net production and scrap of each runtime that covers a tick."""
    ticks = values.select("id_equipment", "ts_value", "net_production_incr", "scrap_incr")
    return values_in_runtimes(ticks, runtimes).groupBy("id_production_order_runtime").agg(F.sum("net_production_incr").alias("net_production"), F.sum("scrap_incr").alias("scrap"), F.count("*").alias("ticks"))


def touched_by(late: DataFrame, runtimes: DataFrame) -> DataFrame:
    """Ids of runtimes that late ticks fall into."""
    return values_in_runtimes(late.select("id_equipment", "ts_value"), runtimes).select("id_production_order_runtime").distinct()


def store_totals(totals_: DataFrame, runtimes: DataFrame, path: str) -> None:
    """Writes totals of runtimes as a table by the day they start."""
    days = runtimes.select("id_production_order_runtime", F.to_date("ts_start").alias("day"))
    totals_.join(days, "id_production_order_runtime").hint("rebalance", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def recalc_stored(path: str, values: DataFrame, runtimes: DataFrame, late: DataFrame) -> None:
    """Brings stored totals up to date with values for the runtimes that late ticks (id_equipment, ts_value) fall into.

    Only the days on which such a runtime starts are read and overwritten; ticks outside the span of these runtimes are
    left out by the scan. The same call again changes nothing.
    """
    spark = values.sparkSession
    dirty = runtimes.join(touched_by(late, runtimes), "id_production_order_runtime", "left_semi")
    spans = dirty.groupBy(F.to_date("ts_start").alias("day")).agg(F.min("ts_start").alias("first"), F.max(F.coalesce("ts_end", ntz("9999-12-31 00:00:00"))).alias("last")).collect()  # a row a day
    if not spans:
        return
    days, first, last = [r["day"] for r in spans], min(r["first"] for r in spans), max(r["last"] for r in spans)
    ids = dirty.select("id_production_order_runtime")
    stays = spark.read.parquet(path).where(F.col("day").isin(days)).join(ids, "id_production_order_runtime", "left_anti")
    ticks = values.where((F.col("ts_value") >= ntz(str(first))) & (F.col("ts_value") < ntz(str(last)))).join(dirty.select("id_equipment").distinct(), "id_equipment", "left_semi")
    fresh = totals(ticks, dirty).join(dirty.select("id_production_order_runtime", F.to_date("ts_start").alias("day")), "id_production_order_runtime")
    stays.unionByName(fresh).hint("rebalance", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def overlaps(runtimes: DataFrame) -> DataFrame:
    """Runtimes that begin before an earlier one of their equipment has ended; an open one never ends."""
    w = Window.partitionBy("id_equipment").orderBy("ts_start", "id_production_order_runtime").rowsBetween(Window.unboundedPreceding, -1)
    end = F.coalesce("ts_end", ntz("9999-12-31 00:00:00"))
    return runtimes.withColumn("earlier_end", F.max(end).over(w)).where("ts_start < earlier_end").select("id_production_order_runtime", "id_equipment", "ts_start", "earlier_end")


def progress(orders: DataFrame, totals_: DataFrame, runtimes: DataFrame) -> DataFrame:
    """Produced over planned, in percent, for orders with a plan; production_final stands for the plan where no other is known."""
    made = totals_.join(runtimes.select("id_production_order_runtime", "id_production_order"), "id_production_order_runtime").groupBy("id_production_order").agg(F.sum("net_production").alias("produced"))
    both = orders.join(made, "id_production_order")
    return both.select("id_production_order", "produced", F.round(F.col("produced") / F.nullif("production_final", F.lit(0.0)) * 100, 1).alias("progress"))
