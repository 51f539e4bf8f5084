"""From bus messages to one wide row per equipment and second."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.operators.series import beside

MESSAGE = "timestamp LONG, gateway STRING, metrics ARRAY<STRUCT<name: STRING, timestamp: LONG, value: DOUBLE, counter: LONG, curspeed: DOUBLE>>"
#: Metric type -> column of the wide row (fixed values).
COLUMNS = {"ProdProcessedCount": "net_production_incr", "ProdDefectiveCount": "scrap_incr", "StateCurrent": "state", "UnitModeCurrent": "mode", "CurMachSpeed": "speed"}


def read_messages(messages: DataFrame, column: str = "value") -> DataFrame:
    """(raw, m, why) of JSON messages: why is null where m can be used, else what is wrong with the whole message.

    `null`: no message; `malformed`: not JSON of the expected types; `no metrics`: without any.
    """
    raw = F.col(column).cast("string")
    parsed = messages.select(raw.alias("raw"), F.from_json(raw, f"{MESSAGE}, broken STRING", {"columnNameOfCorruptRecord": "broken"}).alias("m"))
    why = F.when(F.col("raw").isNull(), "null").when(F.col("m").isNull() | F.col("m.broken").isNotNull(), "malformed").when(F.coalesce(F.size("m.metrics"), F.lit(0)) <= 0, "no metrics")
    return parsed.withColumn("why", why)


def verdicts(read: DataFrame) -> DataFrame:
    """Each metric of usable messages, and each other message, in one pass: (why, gateway, raw, x, ts_metric), why null where it can be used.

    A metric without a timestamp takes its message's; what is wrong with one is `no name` or `no time`. x is null, and raw is the
    message, where the whole message is wrong.
    """
    at = F.timestamp_millis(F.coalesce(F.col("x.timestamp"), F.col("m.timestamp")))
    rows = read.select("why", "m", "raw", F.explode_outer(F.when(F.col("why").isNull(), F.col("m.metrics"))).alias("x"))
    wrong = F.coalesce("why", F.when(F.col("x.name").isNull(), "no name").when(at.isNull(), "no time"))
    return rows.select(wrong.alias("why"), "m.gateway", F.when(F.col("why").isNull(), F.to_json("x")).otherwise(F.col("raw")).alias("raw"), "x", at.alias("ts_metric"))


def metrics_of(read: DataFrame) -> DataFrame:
    """One row per metric that can be used; one without a timestamp takes its message's."""
    return verdicts(read).where("why is null").select("gateway", F.col("x.name").alias("name"), "ts_metric", F.col("x.value").alias("value"), F.col("x.counter").alias("counter"), F.col("x.curspeed").alias("curspeed"))


def dead_letters(read: DataFrame) -> DataFrame:
    """(why, gateway, raw) of each message, and of each metric in a usable one, that metrics_of leaves out."""
    return verdicts(read).where("why is not null").select("why", "gateway", "raw")


def explode_metrics(messages: DataFrame, column: str = "value") -> DataFrame:
    """One row per usable metric of JSON messages; what is left out is told by dead_letters(read_messages(messages))."""
    return metrics_of(read_messages(messages, column))


def parse_topic(metrics: DataFrame) -> DataFrame:
    """base topic, shape, metric type, unit and machine of each name.

    `<topic>/Status/<Type>` keeps the whole topic, of any depth; `<4 segments>/Admin/<Type>/<unit>/<machine>`
    may end in a trigger mark, which is dropped. Other names have a null shape.
    """
    parts = F.split("name", "/")
    n = F.size("parts")
    status = F.element_at("parts", -2) == "Status"
    admin = (n >= 8) & (F.get("parts", F.lit(4)) == "Admin")
    at = lambda k: F.get("parts", F.lit(k))
    split = metrics.withColumn("parts", parts)
    base = F.when(admin, F.slice("parts", 1, 4)).when(status, F.slice("parts", F.lit(1), n - 2))
    return split.select(
        *metrics.columns,
        F.array_join(base, "/").alias("topic"),
        F.when(admin, "admin").when(status, "status").alias("shape"),
        F.when(admin, at(5)).when(status, F.element_at("parts", -1)).alias("metric_type"),
        F.when(admin, at(6)).alias("unit"),
        F.when(admin, F.regexp_replace(at(7), r"\*\*\*TRIG_C=I$", "")).alias("machine"),
    )


def route(parsed: DataFrame, register: DataFrame) -> DataFrame:
    """Parsed rows with the equipment of their topic's active registration; the rest falls out."""
    active = register.where("active").select(F.col("packml_topic").alias("topic"), "id_equipment")
    return parsed.join(active, "topic")


def unrouted(parsed: DataFrame, register: DataFrame) -> DataFrame:
    active = register.where("active").select(F.col("packml_topic").alias("topic"))
    return parsed.join(active, "topic", "left_anti")


def nearest_second(column: str = "ts_metric") -> Column:
    """The nearest whole second, halves up."""
    return F.date_trunc("second", F.col(column) + F.expr("INTERVAL 500 MILLISECONDS"))


def wide_columns() -> list[Column]:
    """The last value of each metric type in order of time and sequence; nulls and other types don't compete."""
    return [F.max_by("value", F.when((F.col("metric_type") == kind) & F.col("value").isNotNull(), F.struct("ts_metric", "seq"))).alias(name) for kind, name in COLUMNS.items()]


def pivot_wide(routed: DataFrame, at: Column | None = None) -> DataFrame:
    """Tall rows as one row per equipment and time."""
    return routed.groupBy("id_equipment", (F.col("ts_metric") if at is None else at).alias("ts_value")).agg(*wide_columns())


def collapse(routed: DataFrame) -> DataFrame:
    """A burst as one row per equipment and nearest second, last non-null value per column."""
    return pivot_wide(routed, nearest_second())


def unpivot(values: DataFrame) -> DataFrame:
    """Wide rows as tall ones, nulls dropped."""
    wide = values.select("ts_value", "id_equipment", *(F.col(c).cast("double").alias(c) for c in COLUMNS.values()))
    return wide.unpivot(["ts_value", "id_equipment"], list(COLUMNS.values()), "metric_name", "metric_value").where("metric_value IS NOT NULL")


def insert_new(target: DataFrame, rows: DataFrame, *keys: str) -> DataFrame:
    """target and those rows whose key it does not hold; the same rows again change nothing."""
    return target.unionByName(rows.dropDuplicates(list(keys)).join(target, list(keys), "left_anti").select(*target.columns))


def counter_check(counted: DataFrame) -> DataFrame:
    """Growth of counter against value per equipment, in order of time; a counter that falls is a reset."""
    grown = F.col("counter") - F.col("before")
    kind = F.when(grown.isNull(), "first").when(grown < 0, "reset").when(grown == F.col("value"), "ok").otherwise("gap")
    return beside(counted, "before", "counter", "ts_metric", "seq").select("seq", "id_equipment", "ts_metric", "value", "counter", kind.alias("verdict"))
