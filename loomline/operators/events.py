"""Downtime events: deriving, listing, classifying, splitting and editing them.

The four notions of "pending" differ on purpose and share no predicate: open now; the backlog
(closed, null or empty category); null category only in the series; and, for justification, null or
empty and not forced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomline.functions.columns import count_where, minutes_open, newest, not_forced, ntz, percent, seconds_between, uncategorised, within
from loomline.operators.series import state_changes
from loomline.plans.params import Params


def from_states(values: DataFrame) -> DataFrame:
    """State runs as events: a run ends when the next begins, the last one is open."""
    runs = state_changes(values).select("id_equipment", F.col("state").alias("status"), F.col("ts_start").alias("ts_event"), "ts_end")
    return runs.withColumn("duration", seconds_between(F.col("ts_event"), F.col("ts_end")).cast("int"))


def kind(running: bool = True) -> Column:
    found = F.when(F.col("planned_downtime"), "Planned").when(F.col("change_over"), "Changeover")
    return (found.when(F.col("status") == 6, "Running") if running else found).otherwise("Unplanned")


def _named(events: DataFrame, t) -> DataFrame:
    wide = events.join(t.equipments.select("id_equipment", "nm_equipment"), "id_equipment", "left")
    return wide.join(t.enterprises.select("id_enterprise", "nm_enterprise"), "id_enterprise", "left")


def recent(t, n: int = 30) -> DataFrame:
    rows = newest(t.equipment_events, n, F.col("ts_event").desc(), F.col("id_equipment_event").desc())
    return _named(rows, t).select("id_equipment_event", "ts_event", "nm_enterprise", "nm_equipment", "status", "ts_end", "duration", kind().alias("type"))


def downtime(t, p: Params, n: int = 30) -> DataFrame:
    rows = newest(t.equipment_events.where("status <> 6"), n, F.col("ts_event").desc(), F.col("id_equipment_event").desc())
    seconds = F.coalesce(F.col("duration").cast("long"), seconds_between(F.col("ts_event"), ntz(p.as_of)))
    return _named(rows, t).select("id_equipment_event", "nm_enterprise", "nm_equipment", F.col("ts_event").alias("ts_start"), "ts_end", F.round(seconds / F.lit(60.0), 1).alias("duration_min"), kind(False).alias("type"))


def justifiable(events: DataFrame, closed: bool = False, n: int = 10) -> DataFrame:
    rows = events.where((F.col("status") == 10) & uncategorised() & not_forced())
    rows = rows.where("ts_end IS NOT NULL") if closed else rows
    return newest(rows.select("id_equipment_event", "id_equipment", "id_enterprise", "ts_event"), n, F.col("ts_event"), F.col("id_equipment_event"))


def open_or_forced(events: DataFrame, n: int = 10) -> DataFrame:
    rows = events.where((F.col("status") == 10) & (F.col("ts_end").isNull() | F.col("forced_creation_system")))
    return newest(rows.select("id_equipment_event", "id_equipment", "ts_event", "ts_end"), n, F.col("ts_event"), F.col("id_equipment_event"))


def backlog(t, p: Params, n: int = 20) -> DataFrame:
    """Oldest closed events without a category; an equipment with several topics repeats its events."""
    rows = t.equipment_events.where(F.col("ts_end").isNotNull() & uncategorised() & (F.col("status") == 10))
    wide = rows.join(t.packml_register.select("id_equipment", "packml_topic"), "id_equipment", "left").join(t.equipments.select("id_equipment", "nm_equipment"), "id_equipment")
    shown = wide.select("id_equipment_event", "id_equipment", F.coalesce("packml_topic", "nm_equipment").alias("topic"), minutes_open(F.col("ts_event"), p).alias("open_min"), "ts_event")
    return newest(shown, n, F.col("ts_event"), F.col("id_equipment_event"), F.col("topic"))


def justification_rate(events: DataFrame, p: Params, strict: bool = False) -> DataFrame:
    """Categorised events in percent of closed ones. Only the strict form counts both among closed stops, so only it stays within 100."""
    done = F.col("cd_category").isNotNull() & (F.col("cd_category") != "")
    closed = F.col("ts_end").isNotNull()
    if strict:
        closed = closed & (F.col("status") == 10)
        done = done & closed
    return events.where(within("ts_event", p)).agg(percent(count_where(done), count_where(closed)).alias("value"))


def splittable_manual(events: DataFrame) -> DataFrame:
    whole = lambda c: F.date_trunc("second", c).cast("timestamp_ntz") == F.col(c)
    rows = events.where(F.col("ts_end").isNotNull() & (F.col("duration") > 60) & whole("ts_event") & whole("ts_end") & not_forced())
    return rows.select("id_equipment_event", "id_equipment", "ts_event", "ts_end", "duration")


def splittable_standard(events: DataFrame) -> DataFrame:
    length = F.timestamp_diff("MICROSECOND", "ts_event", "ts_end")
    rows = events.where(F.col("ts_end").isNotNull() & (F.col("duration") > 60) & (F.col("status") != 6) & (length % 1_000_000 == 0))
    return rows.select("id_equipment_event", "id_equipment", "ts_event", "ts_end", "duration")


def split_candidates(standard: DataFrame, manual: DataFrame) -> DataFrame:
    return splittable_standard(standard).withColumn("source", F.lit("standard")).unionByName(splittable_manual(manual).withColumn("source", F.lit("manual")))


def split(events: DataFrame, new_category: str) -> DataFrame:
    """Each closed event as two pieces cut at half its whole seconds: A keeps the category, B gets the new one."""
    total = seconds_between(F.col("ts_event"), F.col("ts_end"))
    half = F.floor(total / 2)
    cut = F.col("ts_event") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), half.cast("decimal(18,6)"))
    pieces = events.where("ts_end IS NOT NULL").withColumn("total", total).withColumn("half", half).withColumn("cut", cut)
    a = F.struct(F.lit("A").alias("piece"), F.col("ts_event").alias("s"), F.col("cut").alias("e"), F.col("half").cast("long").alias("d"), F.col("cd_category").alias("c"))
    b = F.struct(F.lit("B").alias("piece"), F.col("cut").alias("s"), F.col("ts_end").alias("e"), (F.col("total") - F.col("half")).cast("long").alias("d"), F.lit(new_category).alias("c"))
    cut_up = pieces.select("id_equipment_event", F.explode(F.array(a, b)).alias("p"))
    return cut_up.select("id_equipment_event", "p.piece", F.col("p.s").alias("ts_event"), F.col("p.e").alias("ts_end"), F.col("p.d").alias("duration"), F.col("p.c").alias("cd_category"))


def closed_manual(events: DataFrame, n: int = 10) -> DataFrame:
    rows = events.where(F.col("ts_end").isNotNull() & not_forced()).select("id_equipment_event", "id_equipment", "ts_event", "ts_end", "duration")
    return newest(rows, n, *(F.col(c).desc() for c in ("ts_event", "id_equipment_event", "id_equipment", "ts_end", "duration")))


def without_short(events: DataFrame, floor_seconds: int) -> DataFrame:
    """Events but for closed, uncategorised ones that are shorter than the floor or have no length; a null test keeps its row."""
    short = F.col("ts_end").isNotNull() & uncategorised() & (F.col("duration").isNull() | (F.col("duration") < floor_seconds))
    return events.where(~F.coalesce(short, F.lit(False)))


def without_scope(events: DataFrame, enterprises: DataFrame, names: list[str]) -> DataFrame:
    return events.join(enterprises.where(F.col("nm_enterprise").isin(names)).select("id_enterprise"), "id_enterprise", "left_anti")


def pending_deficit(events: DataFrame, floor: int) -> DataFrame:
    pending = count_where(F.col("ts_end").isNotNull() & (F.col("status") == 10) & uncategorised() & not_forced())
    return events.agg(F.greatest(F.lit(0).cast("long"), F.lit(floor) - pending).alias("value"))


def apply_justify(events: DataFrame, actions: DataFrame) -> DataFrame:
    """Events with the category of their latest action, by time and then sequence."""
    last = actions.groupBy("id_equipment_event").agg(F.max_by(F.struct(F.col("cd_category").alias("cat"), "cd_subcategory"), F.struct("ts_action", "seq")).alias("a"))
    folded = events.join(last, "id_equipment_event", "left")
    return folded.select("id_equipment_event", F.coalesce("a.cat", "cd_category").alias("cd_category"), F.col("a.cd_subcategory").alias("cd_subcategory"))


def apply_edit(events: DataFrame, edits: DataFrame) -> DataFrame:
    """Events with category, start and end of their latest edit, and the duration anew."""
    last = edits.groupBy("id_equipment_event").agg(F.max_by(F.struct(F.col("cd_category").alias("cat"), "new_start", "new_end"), F.struct("ts_action", "seq")).alias("a"))
    moved = events.join(last, "id_equipment_event", "left").select(
        "id_equipment_event", F.coalesce("a.cat", "cd_category").alias("cd_category"), F.coalesce("a.new_start", "ts_event").alias("ts_event"), F.coalesce("a.new_end", "ts_end").alias("ts_end")
    )
    return moved.withColumn("duration", seconds_between(F.col("ts_event"), F.col("ts_end")).cast("int"))


def add_manual(events: DataFrame, new: DataFrame) -> DataFrame:
    """events and new ones (id_equipment, ts_event, ts_end, cd_category), cut to whole seconds."""
    at = lambda c: F.date_trunc("second", c).cast("timestamp_ntz")
    whole = new.select("id_equipment", at("ts_event").alias("ts_event"), at("ts_end").alias("ts_end"), "cd_category")
    both = events.select(*whole.columns).unionByName(whole)
    return both.withColumn("duration", seconds_between(F.col("ts_event"), F.col("ts_end")).cast("int"))


def pareto(events: DataFrame) -> DataFrame:
    """Closed stop minutes per category, their share and the share so far, largest first. One row per category reaches the window."""
    name = F.when(uncategorised(), "unjustified").otherwise(F.col("cd_category"))
    summed = events.where("status = 10 AND ts_end IS NOT NULL").groupBy(name.alias("category")).agg(F.sum("duration").cast("long").alias("seconds"))
    all_ = F.sum("seconds").over(Window.partitionBy())
    so_far = F.sum("seconds").over(Window.orderBy(F.col("seconds").desc(), "category").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return summed.select("category", F.round(F.col("seconds") / 60.0, 1).alias("minutes"), F.round(F.col("seconds") / all_ * 100, 1).alias("share"), F.round(so_far / all_ * 100, 1).alias("cumulative"))
