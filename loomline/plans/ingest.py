"""Ingest queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomline.operators import ingest
from loomline.plans.registry import add


def named(t):
    """Metrics, every third one renamed to the Admin shape."""
    unit = F.regexp_extract("name", "#0*([0-9]+)/", 1)
    admin = F.concat(F.array_join(F.slice(F.split("name", "/"), 1, 4), "/"), F.lit("/Admin/"), F.element_at(F.split("name", "/"), -1), F.lit("/"), unit, F.lit("/M"), unit, F.lit("***TRIG_C=I"))
    return t.raw_metrics.withColumn("name", F.when(F.col("seq") % 3 == 0, admin).otherwise(F.col("name")))


def routed(t):
    return ingest.route(ingest.parse_topic(named(t)), t.packml_register)


UNIT = "regexp_extract(name, '#0*([0-9]+)/', 1)"
PARSED = f"""SELECT seq, ts_metric, value, array_to_string(string_split(name, '/')[1:4], '/') AS topic, CASE WHEN seq % 3 = 0 THEN 'admin' ELSE 'status' END AS shape,
    string_split(name, '/')[6] AS metric_type, CASE WHEN seq % 3 = 0 THEN {UNIT} END AS unit, CASE WHEN seq % 3 = 0 THEN 'M' || {UNIT} END AS machine FROM raw_metrics"""
ROUTED = f"SELECT p.*, pr.id_equipment FROM ({PARSED}) p JOIN packml_register pr ON pr.packml_topic = p.topic AND pr.active"
WIDE = ", ".join(f"(max(struct_pack(t := ts_metric, s := seq, v := value)) FILTER (WHERE metric_type = '{k}')).v AS {c}" for k, c in ingest.COLUMNS.items())

add("ingest_parse_topic", lambda t: ingest.parse_topic(named(t)).select("seq", "topic", "shape", "metric_type", "unit", "machine"), f"SELECT seq, topic, shape, metric_type, unit, machine FROM ({PARSED})")
add("ingest_route_topic", lambda t: routed(t).select("seq", "topic", "id_equipment", "metric_type"), f"SELECT seq, topic, id_equipment, metric_type FROM ({ROUTED})")
add(
    "ingest_unrouted",
    lambda t: ingest.unrouted(ingest.parse_topic(named(t)), t.packml_register).select("seq", "topic"),
    f"SELECT seq, topic FROM ({PARSED}) WHERE topic NOT IN (SELECT packml_topic FROM packml_register WHERE active)",
)
add("ingest_collapse", lambda t: ingest.collapse(routed(t)).withColumn("ts_value", F.col("ts_value").cast("timestamp_ntz")), f"SELECT id_equipment, date_trunc('second', ts_metric + INTERVAL 500 MILLISECOND) AS ts_value, {WIDE} FROM ({ROUTED}) GROUP BY 1, 2")
add("ingest_pivot_wide", lambda t: ingest.pivot_wide(routed(t)).withColumn("ts_value", F.col("ts_value").cast("timestamp_ntz")), f"SELECT id_equipment, ts_metric AS ts_value, {WIDE} FROM ({ROUTED}) GROUP BY 1, 2")
add(
    "ingest_unpivot_uns",
    lambda t: ingest.unpivot(t.equipment_values),
    " UNION ALL ".join(f"SELECT ts_value, id_equipment, '{c}' AS metric_name, CAST({c} AS DOUBLE) AS metric_value FROM equipment_values WHERE {c} IS NOT NULL" for c in ingest.COLUMNS.values()),
)
add(
    "ingest_idempotent",
    lambda t: ingest.insert_new(t.uns_metrics.where("seq % 2 = 0"), t.uns_metrics.union(t.uns_metrics), "seq").select("seq", "metric_name"),
    "SELECT seq, metric_name FROM uns_metrics",
)


def counted(t):
    """Processed counts with a running total that starts anew each week."""
    rows = routed(t).where("metric_type = 'ProdProcessedCount'")
    w = Window.partitionBy("id_equipment", F.date_trunc("week", "ts_metric")).orderBy("ts_metric", "seq")
    return rows.withColumn("counter", F.sum("value").over(w).cast("long"))


add(
    "ingest_counter_check",
    lambda t: ingest.counter_check(counted(t)).withColumn("ts_metric", F.col("ts_metric").cast("timestamp_ntz")),
    f"""SELECT seq, id_equipment, ts_metric, value, counter, CASE WHEN grown IS NULL THEN 'first' WHEN grown < 0 THEN 'reset' WHEN grown = value THEN 'ok' ELSE 'gap' END AS verdict
    FROM (SELECT *, counter - lag(counter) OVER (PARTITION BY id_equipment ORDER BY ts_metric, seq) AS grown FROM (SELECT *, CAST(sum(value) OVER
    (PARTITION BY id_equipment, date_trunc('week', ts_metric) ORDER BY ts_metric, seq) AS BIGINT) AS counter FROM ({ROUTED}) WHERE metric_type = 'ProdProcessedCount'))""",
)


def messages(t, *more: str):
    """A message per metric, which it holds twice: without a timestamp, and a second later with one."""
    ms = F.unix_millis(F.col("ts_metric").cast("timestamp"))
    metric = lambda name, at: F.struct(name.alias("name"), at.cast("long").alias("timestamp"), F.col("value").alias("value"))
    pair = F.array(metric(F.col("name"), F.lit(None)), metric(F.concat("name", F.lit("/late")), ms + 1000))
    return t.raw_metrics.select(F.to_json(F.struct(ms.alias("timestamp"), F.lit("edge").alias("gateway"), pair.alias("metrics"))).alias("value"), *more)


add(
    "src_explode_metrics",
    lambda t: ingest.explode_metrics(messages(t)).select("gateway", "name", F.col("ts_metric").cast("timestamp_ntz").alias("ts_metric"), "value"),
    "SELECT 'edge' AS gateway, name, ts_metric, value FROM raw_metrics UNION ALL SELECT 'edge', name || '/late', ts_metric + INTERVAL 1 SECOND, value FROM raw_metrics",
)


def damaged(t):
    """Messages as above, in the order of seq % 12: cut off, missing, without metrics, metrics without names or times, a time that is no number; the rest whole."""
    value, kind = F.col("value"), F.col("seq") % 12
    cut = F.when(kind == 0, F.substring(value, F.lit(1), F.length(value) - 5)).when(kind == 1, F.lit(None)).when(kind == 2, F.regexp_replace(value, r'"metrics":.*', '"metrics":[]}'))
    named = cut.when(kind == 3, F.replace(value, F.lit('"name":'), F.lit('"title":'))).when(kind == 4, F.replace(value, F.lit('"timestamp":'), F.lit('"clock":')))
    timed = named.when(kind == 5, F.regexp_replace(value, r'^\{"timestamp":[0-9]+', '{"timestamp":"soon"'))
    return messages(t, "seq").select(timed.otherwise(value).alias("value"))


def counted_letters(good, dead):
    """How many metrics were used, and how many letters are dead for each reason."""
    used = good.agg(F.count("*").alias("n")).select(F.lit("used").alias("why"), "n")
    return used.union(dead.groupBy("why").agg(F.count("*").alias("n")))


LETTERS = """SELECT why, CAST(sum(k) AS BIGINT) AS n FROM (SELECT CASE seq % 12 WHEN 0 THEN 'malformed' WHEN 1 THEN 'null' WHEN 2 THEN 'no metrics' WHEN 3 THEN 'no name' WHEN 4 THEN 'no time' WHEN 5 THEN 'malformed' ELSE 'used' END AS why,
    CASE WHEN seq % 12 IN (0, 1, 2, 5) THEN 1 ELSE 2 END AS k FROM raw_metrics) GROUP BY 1"""


def letters(t):
    """The same counts from one pass over the messages."""
    found = ingest.verdicts(ingest.read_messages(damaged(t)))
    return found.groupBy(F.coalesce("why", F.lit("used")).alias("why")).agg(F.count("*").alias("n"))


add("ingest_dead_letters", letters, LETTERS)
