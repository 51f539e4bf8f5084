"""Time series, zero-filled spines, state timelines and cascaded roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomline.functions.columns import bucket, count_where, ntz, within
from loomline.plans.params import Params

KEY = "id_equipment"


def series(t, column: str, value: Column, p: Params) -> DataFrame:
    """value per step and equipment over rows that carry column, labelled enterprise › equipment."""
    rows = t.equipment_values.where(within("ts_value", p) & F.col(column).isNotNull())
    summed = rows.groupBy(bucket("ts_value", p.step).alias("time"), KEY, "id_enterprise").agg(value.alias("value"))
    wide = summed.join(t.equipments.select(KEY, "nm_equipment"), KEY).join(t.enterprises.select("id_enterprise", "nm_enterprise"), "id_enterprise")
    return wide.select("time", F.concat("nm_enterprise", F.lit(" › "), "nm_equipment").alias("metric"), "value")


def spine(like: DataFrame, p: Params) -> DataFrame:
    """Every bucket from that of t0 to that of t1, both included."""
    ends = like.sparkSession.range(1).select(F.window(ntz(p.t0), p.step).alias("first"))
    ends = ends.select("first", F.window(ntz(p.t1), p.step).alias("last"))
    return ends.select(F.explode(F.sequence("first.start", "last.start", F.expr(f"INTERVAL {p.step}"))).alias("time"))


def zero_filled(df: DataFrame, column: str, p: Params, **conditions: Column) -> DataFrame:
    """Rows per bucket of column that meet each condition, 0 where there are none."""
    counted = df.where(within(column, p)).groupBy(bucket(column, p.step).alias("time")).agg(*(count_where(c).alias(n) for n, c in conditions.items()))
    filled = spine(df, p).join(counted, "time", "left")
    return filled.select("time", *(F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in conditions))


def metric_breakdown(values: DataFrame, p: Params) -> DataFrame:
    c = F.col
    return (
        values.where(within("ts_value", p))
        .groupBy(bucket("ts_value", "1 minute").alias("time"))
        .agg(
            F.count("net_production_incr").alias("prod_processed"),
            F.count("scrap_incr").alias("prod_defective"),
            F.count("state").alias("state_current"),
            F.count("mode").alias("unit_mode"),
            count_where(c("speed").isNotNull() & c("net_production_incr").isNull()).alias("mach_speed"),
        )
    )


def metric_exclusive(values: DataFrame) -> DataFrame:
    """Each row under its first metric only, which undercounts the others."""
    c = F.col
    name = F.when(c("net_production_incr").isNotNull(), "ProdProcessed").when(c("scrap_incr").isNotNull(), "ProdDefective").when(c("state").isNotNull(), "StateCurrent")
    name = name.when(c("mode").isNotNull(), "UnitMode").when(c("speed").isNotNull(), "MachSpeed").otherwise("other")
    return values.groupBy(name.alias("metric")).agg(F.count("*").alias("rows"), F.max("ts_value").alias("latest"))


def beside(df: DataFrame, name: str, value: str, ts: str, *more: str, ahead: bool = False) -> DataFrame:
    """df with column name: value in the equipment's row before (ahead: after) in order of ts and more.

    Rows are sorted per equipment and day; the first and last of each day alone are then sorted over all days of an equipment.
    """
    step = F.lead if ahead else F.lag
    by_day = df.withColumn("day_", F.coalesce(F.to_date(ts), F.lit("0001-01-01").cast("date")))
    w = Window.partitionBy(KEY, "day_").orderBy(ts, *more)
    edges = {"first_": F.lag(F.lit(True)).over(w).isNull(), "last_": F.lead(F.lit(True)).over(w).isNull()}
    placed = by_day.withColumns({name: step(value).over(w), **edges}).withColumn("inside_", F.when(~(F.col("first_") | F.col("last_")), F.col("day_")))
    over = step(value).over(Window.partitionBy(KEY, "inside_").orderBy(ts, *more))
    return placed.withColumn(name, F.when(F.col("last_" if ahead else "first_"), over).otherwise(F.col(name))).drop("day_", "inside_", "first_", "last_")


def _day_runs(values: DataFrame) -> DataFrame:
    """Runs of equal states per equipment and day, with opens: 0 where a run goes on from the day before, and ends: when the next run starts.

    Ticks of one instant count once, with the greatest state. Ticks are shuffled once, by equipment and day. What lies
    between a day's first and last run is whole; those two alone are sorted over all days of an equipment.
    """
    ticks = values.where("state IS NOT NULL").select(KEY, "ts_value", "state", F.to_date("ts_value").alias("day")).repartition(KEY, "day")
    ticks = ticks.groupBy(KEY, "day", "ts_value").agg(F.max("state").alias("state"))
    w = Window.partitionBy(KEY, "day").orderBy("ts_value")
    changed = (F.col("state") != F.coalesce(F.lag("state").over(w), F.lit(-1))).cast("int")
    islands = ticks.withColumn("changed", changed).withColumn("island", F.sum("changed").over(w))
    runs = islands.groupBy(KEY, "day", "island", "state").agg(F.min("ts_value").alias("ts_start"), F.max("ts_value").alias("ts_last"), F.count("*").alias("ticks"))
    back = Window.partitionBy(KEY, "day").orderBy(F.col("island").desc())
    runs = runs.withColumn("next", F.lag("ts_start").over(back))
    inside = (F.col("island") > 1) & F.col("next").isNotNull()
    runs = runs.withColumn("inside", F.when(inside, F.col("day")))
    later = Window.partitionBy(KEY, "inside").orderBy(F.col("ts_start").desc())
    runs = runs.withColumn("opens", F.when((F.col("island") == 1) & (F.col("state") == F.lead("state").over(later)), 0).otherwise(1))
    # the first start of a new state that a row's day has, seen from the days before
    first = F.when(F.col("opens") == 1, F.col("ts_start")).otherwise(F.col("next"))
    after = F.last(first, ignorenulls=True).over(later.rowsBetween(Window.unboundedPreceding, -1))
    return runs.withColumn("ends", F.coalesce("next", after))


def state_timeline(values: DataFrame) -> DataFrame:
    """Runs of equal states per equipment, each from its first to its last tick, over midnights."""
    runs = _day_runs(values)
    later = Window.partitionBy(KEY, "inside").orderBy(F.col("ts_start").desc())
    # a run that opens closes its chain, read from the last one back
    chained = runs.withColumn("chain", F.sum("opens").over(later) - F.col("opens"))
    whole = chained.groupBy(KEY, "inside", "chain", "state").agg(F.min("ts_start").alias("ts_start"), F.max("ts_last").alias("ts_last"), F.sum("ticks").alias("ticks"))
    return whole.select(KEY, "state", "ts_start", "ts_last", "ticks")


def state_changes(values: DataFrame) -> DataFrame:
    """(id_equipment, state, ts_start, ts_end) of the same runs, each until the next one starts; the last one has no end."""
    return _day_runs(values).where("opens = 1").select(KEY, "state", "ts_start", F.col("ends").alias("ts_end"))


# roll-ups carry sums, counts and the last state, never ratios

SUMS = ("net", "scrap", "speed_sum", "speed_n", "running", "stated", "rows")


def rollup_rows(values: DataFrame, step: str, *more: str) -> DataFrame:
    """A bucket's row per equipment; more: columns that are grouped by besides, such as the day that values are dealt out by."""
    state_at = F.struct("ts_value", "state")
    return values.groupBy(KEY, *more, bucket("ts_value", step).alias("time")).agg(
        F.sum("net_production_incr").alias("net"),
        F.sum("scrap_incr").alias("scrap"),
        F.round(F.sum("speed"), 2).alias("speed_sum"),
        F.count("speed").alias("speed_n"),
        count_where(F.col("state") == 6).alias("running"),
        F.count("state").alias("stated"),
        F.count("*").alias("rows"),
        F.max(F.when(F.col("state").isNotNull(), state_at)).alias("last"),
    )


def rollup_up(finer: DataFrame, step: str, *more: str) -> DataFrame:
    """The next coarser level from a finer one."""
    summed = [F.round(F.sum(c), 2).alias(c) if c == "speed_sum" else F.sum(c).alias(c) for c in SUMS]
    return finer.groupBy(KEY, *more, bucket("time", step).alias("time")).agg(*summed, F.max("last").alias("last"))


def rollup(values: DataFrame, level: str, *more: str) -> DataFrame:
    """1m from rows, 1h from 1m, 1d from 1h."""
    found = rollup_rows(values, "1 minute", *more)
    for name, step in (("1h", "1 hour"), ("1d", "1 day")):
        if level == "1m" or (level == "1h" and name == "1d"):
            break
        found = rollup_up(found, step, *more)
    return found


def shown(rolled: DataFrame) -> DataFrame:
    return rolled.select(KEY, "time", *SUMS, F.col("last.state").alias("last_state"))


#: Parts that consistency deals ticks out to, at least: a task holds the minutes of its part.
PARTS = 200


def consistency(values: DataFrame) -> DataFrame:
    """How many daily buckets differ between the cascade and a roll-up straight from rows: none if all is well.

    Ticks are dealt out once, by equipment and day, for all levels of both; no partition is merged with others, so that
    the buckets that a task holds are a PARTS-th of all.
    """
    keep = ["day", KEY, "time", *SUMS]
    parts = max(PARTS, int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ticks = values.select(KEY, "ts_value", "net_production_incr", "scrap_incr", "speed", "state", F.to_date("ts_value").alias("day")).repartition(parts, KEY, "day")
    cascade, direct = rollup(ticks, "1d", "day").select(keep), rollup_rows(ticks, "1 day", "day").select(keep)
    # one pass: a row that both sides have as often adds up to nothing
    both = cascade.withColumn("side", F.lit(1)).unionByName(direct.withColumn("side", F.lit(-1)))
    return both.groupBy(keep).agg(F.sum("side").alias("more")).agg(F.coalesce(F.sum(F.abs("more")), F.lit(0)).alias("differing"))


def reporting(values: DataFrame, step: str = "5 minutes") -> DataFrame:
    """(time, sketch): a HyperLogLog sketch of the equipment that reports in each bucket; a row of some KB, whatever the number of equipment."""
    return values.groupBy(bucket("ts_value", step).alias("time")).agg(F.hll_sketch_agg(KEY).alias("sketch"))


def reporting_up(finer: DataFrame, step: str) -> DataFrame:
    """The sketches of coarser buckets, merged from finer ones: ticks aren't read again."""
    return finer.groupBy(bucket("time", step).alias("time")).agg(F.hll_union_agg("sketch").alias("sketch"))


def reported(sketches: DataFrame) -> DataFrame:
    return sketches.select("time", F.hll_sketch_estimate("sketch").alias("equipment"))


#: Stored levels of a roll-up, each from the one before.
LEVELS = (("1m", "1 minute"), ("1h", "1 hour"), ("1d", "1 day"))


def store_values(values: DataFrame, path: str) -> None:
    """Adds ticks to a table by day of ts_value, which refresh reads by days."""
    values.withColumn("day", F.to_date("ts_value")).hint("rebalance", "day").write.mode("append").partitionBy("day").parquet(path)


def refresh(target: str, source: DataFrame, touched: DataFrame) -> None:
    """Brings the stored levels target/1m, /1h and /1d up to date with source for the buckets that touched rows fall in.

    source: all ticks with a column day, best a table stored by it; touched: the new ones among them (id_equipment, ts_value).
    Dirty minutes are computed from rows, dirty hours from stored minutes, dirty days from stored hours. Only the
    days touched are read, as their partitions are named in the plan (a calendar's worth at most), and only their partitions are
    overwritten, each with the buckets that stay. A level whose writing dies is repaired by the same call again.
    """
    spark = source.sparkSession
    dirty = touched.select(KEY, F.to_date("ts_value").alias("day"), "ts_value")
    days = [r["day"] for r in dirty.select("day").distinct().where("day is not null").collect()]
    if not days:
        return
    finer, ts = source.where(F.col("day").isin(days)), "ts_value"
    for name, step in LEVELS:
        keys = dirty.select(KEY, "day", bucket("ts_value", step).alias("time")).distinct()
        rows = finer.withColumn("bucket_", bucket(ts, step)).join(keys.withColumnRenamed("time", "bucket_"), [KEY, "day", "bucket_"], "left_semi").drop("bucket_")
        fresh = (rollup_rows(rows, step) if name == "1m" else rollup_up(rows, step)).withColumn("day", F.to_date("time"))
        path = f"{target}/{name}"
        if _stored(spark, path):
            fresh = spark.read.parquet(path).where(F.col("day").isin(days)).join(keys, [KEY, "day", "time"], "left_anti").unionByName(fresh)
        fresh.hint("rebalance", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
        finer, ts = spark.read.parquet(path).where(F.col("day").isin(days)), "time"


def _stored(spark, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
