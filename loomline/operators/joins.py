"""Join shapes, scopes and counts over facts and the small hierarchy tables.

Hierarchy tables are small by nature, but none is marked for broadcast: Spark chooses by their size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomline.functions.columns import newest

WEEK = 604_800


def named(df: DataFrame, t, *levels: str, how: str = "inner") -> DataFrame:
    """df with the names of its hierarchy ids, by joins of how."""
    tables = {"equipment": t.equipments, "area": t.areas, "site": t.sites, "enterprise": t.enterprises}
    for level in levels:
        df = df.join(tables[level].select(f"id_{level}", f"nm_{level}"), f"id_{level}", how)
    return df


def latest_rows(t, n: int = 50) -> DataFrame:
    wide = named(t.equipment_values, t, "equipment", "area", "site", "enterprise")
    kept = wide.select("ts_value", "nm_enterprise", "nm_site", "nm_area", "nm_equipment", "net_production_incr", "scrap_incr", "state", "mode", "speed", "signal_quality", "id_equipment")
    rest = [F.col(c) for c in ("id_equipment", "state", "speed", "net_production_incr")]
    return newest(kept, n, F.col("ts_value").desc(), *rest)


def lead_machines(t) -> DataFrame:
    lead = t.equipments.select(F.col("id_equipment").alias("lead_machine"), F.col("nm_equipment").alias("nm_lead_machine"))
    kind = F.when(F.col("tp_equipment") == 1, "Machine").when(F.col("tp_equipment") == 2, "Sector").when(F.col("tp_equipment") == 3, "Line").otherwise(F.col("tp_equipment").cast("string"))
    wide = named(t.equipments, t, "area", "site", "enterprise").join(lead, "lead_machine", "left")
    return wide.select("id_equipment", "nm_enterprise", "nm_site", "nm_area", "nm_equipment", kind.alias("tp_equipment"), "lead_machine", "nm_lead_machine")


def routing_table(t) -> DataFrame:
    register = t.packml_register.select("id_packml_register", "id_equipment", "packml_topic", "active", "id_unit", "signal_quality")
    wide = named(register.join(t.equipments.select("id_equipment", "nm_equipment", "id_area", "id_site", "id_enterprise"), "id_equipment"), t, "area", "site", "enterprise")
    label = F.when(F.col("active"), "Active").otherwise("Inactive")
    return wide.select("id_packml_register", "nm_enterprise", "nm_site", "nm_area", "nm_equipment", "packml_topic", "active", label.alias("active_label"), "id_unit", "signal_quality")


def running(orders: DataFrame) -> DataFrame:
    """Equipment with a running order; null keys left out, so that NOT IN and anti-join agree."""
    return orders.where("status = 2 AND id_equipment IS NOT NULL").select("id_equipment").distinct()


def free_equipment(t) -> DataFrame:
    machines = t.equipments.where("tp_equipment = 1")
    return machines.join(running(t.production_orders), "id_equipment", "left_anti").select("id_equipment", "nm_equipment")


def orders_by_running(t, how: str) -> DataFrame:
    """Available orders whose equipment has (left_semi) or has not (left_anti) a running order."""
    return t.production_orders.where("status = 1").join(running(t.production_orders), "id_equipment", how).select("id_production_order", "id_equipment", "nm_production_order")


def open_runtimes(t, how: str) -> DataFrame:
    """Running orders with their open runtime; left keeps those without one, as the open end is part of the join."""
    po = t.production_orders.where("status = 2").alias("po")
    rt = t.production_orders_runtime.alias("rt")
    on = (F.col("rt.id_production_order") == F.col("po.id_production_order")) & F.col("rt.ts_end").isNull()
    return po.join(rt, on, how).select("po.id_production_order", "po.id_equipment", "rt.id_production_order_runtime", F.col("rt.ts_start").alias("runtime_start"))


def values_in_runtimes(values: DataFrame, runtimes: DataFrame) -> DataFrame:
    """Each tick with every runtime of its equipment that covers it, [ts_start, ts_end), open ends included.

    Both sides meet per equipment and day: a runtime counts for each day it touches, so an equipment
    with many ticks is many keys, and no task pairs an equipment's whole history.
    """
    last = values.agg(F.max("ts_value").alias("last"))
    spans = runtimes.crossJoin(last).where("ts_start <= last")  # one row on the right
    until = F.least(F.coalesce("ts_end", "last"), F.col("last"))
    days = F.explode(F.sequence(F.to_date("ts_start"), F.greatest(F.to_date(until), F.to_date("ts_start")))).alias("day")
    rt = spans.select("id_production_order_runtime", "id_equipment", "ts_start", "ts_end", days)
    inside = (F.col("ts_value") >= F.col("ts_start")) & (F.col("ts_end").isNull() | (F.col("ts_value") < F.col("ts_end")))
    return values.withColumn("day", F.to_date("ts_value")).join(rt, ["id_equipment", "day"]).where(inside).drop("day")


def values_in_shifts(values: DataFrame, shifts: DataFrame, shift_hours: DataFrame) -> DataFrame:
    """Each tick with the shifts of its site that cover its second of the week; a shift that wraps the week's end is two ranges."""
    wraps = F.col("begin_time") >= F.col("end_time")
    ranges = F.when(wraps, F.array(F.struct(F.col("begin_time").alias("s"), F.lit(WEEK).alias("e")), F.struct(F.lit(0).alias("s"), F.col("end_time").alias("e"))))
    ranges = ranges.otherwise(F.array(F.struct(F.col("begin_time").alias("s"), F.col("end_time").alias("e"))))
    hours = shifts.join(shift_hours, "id_shift").select("id_site", "id_shift", F.explode(ranges).alias("r"))
    # one key per hour that a range touches keeps the join an equi-join
    keyed = hours.select("id_site", "id_shift", "r", F.explode(F.sequence(F.floor(F.col("r.s") / 3600), F.floor((F.col("r.e") - 1) / 3600))).alias("hour"))
    second = F.timestamp_diff("SECOND", F.date_trunc("week", "ts_value").cast("timestamp_ntz"), F.col("ts_value"))
    ticks = values.withColumn("second", second).withColumn("hour", F.floor(F.col("second") / 3600))
    return ticks.join(keyed, ["id_site", "hour"]).where("second >= r.s AND second < r.e").drop("second", "hour", "r")


def topic_prefix(t) -> DataFrame:
    """Metric names joined to the registration of their first four segments."""
    prefix = F.array_join(F.slice(F.split("name", "/"), 1, 4), "/")
    topics = t.packml_register.select(F.col("packml_topic").alias("topic"), "id_equipment")
    return t.raw_metrics.withColumn("topic", prefix).join(topics, "topic").select("seq", "topic", "id_equipment")


def asof_state(values: DataFrame) -> DataFrame:
    """For each tick the state in force: that of the last tick at or before it that carries one.

    A window per equipment and day; each day starts from the last state of the days before.
    """
    day = F.to_date("ts_value")
    ticks = values.select("id_equipment", "ts_value", "state", day.alias("day"))
    w = Window.partitionBy("id_equipment", "day").orderBy("ts_value").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.max_by("state", F.when(F.col("state").isNotNull(), F.struct("ts_value", "state")))
    per_day = ticks.groupBy("id_equipment", "day").agg(last.alias("closing"))
    before = Window.partitionBy("id_equipment").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    opening = per_day.withColumn("opening", F.last("closing", ignorenulls=True).over(before)).drop("closing")
    inside = F.max(F.when(F.col("state").isNotNull(), F.struct("ts_value", "state"))).over(w)["state"]
    return ticks.withColumn("inside", inside).join(opening, ["id_equipment", "day"]).select("id_equipment", "ts_value", F.coalesce("inside", "opening").alias("state"))


def counts(frames: dict[str, DataFrame]) -> DataFrame:
    """One row with the number of rows of each frame; the cross joins are of single rows."""
    ones = [df.agg(F.count("*").alias(name)) for name, df in frames.items()]
    return reduce(lambda a, b: a.crossJoin(b), ones)


def table_counts(frames: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("tbl"), "n") for name, df in frames.items()]
    return reduce(DataFrame.unionByName, parts).orderBy("tbl")


def by_names(df: DataFrame, enterprises: DataFrame, names: str) -> DataFrame:
    """Rows of the enterprises in a comma list; `All` and `.*` mean every row, the unnamed too."""
    if names in ("All", ".*"):
        return df
    wanted = enterprises.where(F.col("nm_enterprise").isin(names.split(","))).select("id_enterprise")
    return df.join(wanted, "id_enterprise", "left_semi")


def scope_ids(df: DataFrame, **ids: list[int] | None) -> DataFrame:
    """Rows whose enterprise, site, area and equipment are in the lists given by level; None means every row, an empty list none."""
    for level, wanted in ids.items():
        if level not in ("enterprise", "site", "area", "equipment"):
            raise ValueError(f"no such level: {level}")
        if wanted is not None:
            df = df.where(F.col(f"id_{level}").isin(wanted))
    return df


def cascade(t, enterprises: list[int]) -> DataFrame:
    """Sites, areas and equipment under the enterprises, by level and name."""
    sites = t.sites.where(F.col("id_enterprise").isin(enterprises))
    areas = t.areas.join(sites.select("id_site"), "id_site", "left_semi")
    equipment = t.equipments.join(areas.select("id_area"), "id_area", "left_semi")
    row = lambda df, level: df.select(F.lit(level).alias("level"), F.col(f"id_{level}").cast("long").alias("id"), F.col(f"nm_{level}").alias("name"))
    return row(sites, "site").union(row(areas, "area")).union(row(equipment, "equipment")).orderBy("level", "name", "id")


def topic_depth(t, depth: int = 4) -> DataFrame:
    """One registered topic of exactly so many segments per enterprise, lines and sectors before machines."""
    deep = t.packml_register.where(F.size(F.split("packml_topic", "/")) == depth).where("active")
    ranked = deep.join(t.equipments.select("id_equipment", "tp_equipment"), "id_equipment")
    pick = F.min(F.struct((F.col("tp_equipment") == 1).alias("machine"), "packml_topic", "id_equipment"))
    return ranked.groupBy("id_enterprise").agg(pick.alias("p")).select("id_enterprise", "p.packml_topic", "p.id_equipment")


def runtime_floor(runtimes: DataFrame) -> DataFrame:
    """For each runtime the latest end of the other closed runtimes of its equipment.

    The two largest closed ends of an equipment are enough: a runtime that holds the first gets the second.
    """
    closed = runtimes.where("ts_end IS NOT NULL").select("id_equipment", F.struct("ts_end", "id_production_order_runtime").alias("e"))
    top = closed.groupBy("id_equipment").agg(F.max("e").alias("first"))
    rest = closed.join(top, "id_equipment").where("e <> first").groupBy("id_equipment").agg(F.max("e").alias("second"))
    ends = top.join(rest, "id_equipment", "left")
    floor = F.when(F.col("first.id_production_order_runtime") == F.col("id_production_order_runtime"), F.col("second.ts_end")).otherwise(F.col("first.ts_end"))
    return runtimes.join(ends, "id_equipment", "left").select("id_production_order_runtime", "id_equipment", floor.alias("floor"))


def consistent(left: DataFrame, right: DataFrame) -> DataFrame:
    """Whether two copies of a one-column table agree in count and in rows, and how many rows each lacks: one pass, one shuffle of distinct rows."""
    marked = lambda df, n, m: df.toDF("row").select("row", F.lit(n).alias("n"), F.lit(m).alias("m"))
    each = marked(left, 1, 0).union(marked(right, 0, 1)).groupBy("row").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    more, less = F.greatest(F.col("n") - F.col("m"), F.lit(0)), F.greatest(F.col("m") - F.col("n"), F.lit(0))
    one = each.agg(total(F.col("n"), "n_left"), total(F.col("m"), "n_right"), total(more, "only_left"), total(less, "only_right"))
    return one.withColumn("ok", (F.col("only_left") == 0) & (F.col("only_right") == 0))


def unused(products: DataFrame, in_use: DataFrame) -> DataFrame:
    """products(nm) not in in_use(nm); all of them if none is left."""
    rest = products.join(in_use.where("nm IS NOT NULL"), "nm", "left_anti")
    left = rest.agg(F.count("*").alias("left"))
    return products.crossJoin(left).where("left = 0").select("nm").union(rest.select("nm"))
