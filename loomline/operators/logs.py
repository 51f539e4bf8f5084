"""Log analytics: label patterns match whole labels, line filters match anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.columns import bucket, ntz, within
from loomline.plans.params import Params

ERRORS = "(?i)(error|exception|failed|critical)"  # fixed value
TROUBLE = "(?i)(error|warn)"  # fixed value


def label(pattern: str, column: str = "service") -> Column:
    return F.col(column).rlike(f"^(?:{pattern})$")


def volume(logs: DataFrame, p: Params, condition: Column, *keys: str) -> DataFrame:
    rows = logs.where(within("ts", p) & condition)
    return rows.groupBy(bucket("ts", p.step).alias("time"), *keys).agg(F.count("*").alias("n"))


def last_bucket(series: DataFrame) -> DataFrame:
    return series.agg(F.max_by("n", "time").alias("value"))


def trailing(logs: DataFrame, marker: str, as_of: str, minutes: int = 5) -> DataFrame:
    """Lines with the marker in (as_of - minutes, as_of]."""
    end = ntz(as_of)
    rows = logs.where((F.col("ts") > end - F.expr(f"INTERVAL {minutes} MINUTES")) & (F.col("ts") <= end) & F.col("line").contains(marker))
    return rows.agg(F.count("*").alias("value"))


def flow(logs: DataFrame, p: Params, sent: str = "pubsub_pub", received: str = "pubsub_rcv") -> DataFrame:
    """Lines published and received per bucket; a bucket with one of them only has 0 of the other."""
    one = lambda marker, name: volume(logs, p, F.col("line").contains(marker)).withColumnRenamed("n", name)
    both = one(sent, "sent").join(one(received, "received"), "time", "full")
    return both.select("time", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("sent", "received")))


def search(logs: DataFrame, p: Params, service: str, pattern: str) -> DataFrame:
    return logs.where(within("ts", p) & label(service) & F.col("line").rlike(pattern))


def from_containers(lines: DataFrame, project: str) -> DataFrame:
    """Container lines (project, name, service, stream, ts, line) of one project, labels renamed and JSON level and msg read."""
    kept = lines.where(F.col("project") == project)
    return kept.select("ts", F.regexp_extract("name", "/(.*)", 1).alias("container"), "service", F.col("stream").alias("logstream"), F.get_json_object("line", "$.level").alias("level"), F.get_json_object("line", "$.msg").alias("msg"))
