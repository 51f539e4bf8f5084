"""Data checks with the clock as an argument."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.functions.columns import ntz, seconds_between


def freshness(values: DataFrame, as_of: str, max_age_seconds: int = 120) -> DataFrame:
    """Age of the newest tick at as_of, over all and per equipment."""
    newest = values.where(F.col("ts_value") <= ntz(as_of)).rollup("id_equipment").agg(F.max("ts_value").alias("last"))
    age = seconds_between(F.col("last"), ntz(as_of))
    return newest.select(F.lit("freshness").alias("check"), F.coalesce(F.col("id_equipment").cast("string"), F.lit("all")).alias("scope"), (age <= max_age_seconds).alias("ok"), age.alias("detail"))


def stale(register: DataFrame, values: DataFrame, as_of: str, max_age_seconds: int = 120) -> DataFrame:
    """Equipment with an active registration that has been silent too long, or always."""
    last = values.where(F.col("ts_value") <= ntz(as_of)).groupBy("id_equipment").agg(F.max("ts_value").alias("last_seen"))
    active = register.where("active").select("id_equipment").distinct().join(last, "id_equipment", "left")
    return active.where(F.col("last_seen").isNull() | (seconds_between(F.col("last_seen"), ntz(as_of)) > max_age_seconds))


def unresolved(register: DataFrame, equipments: DataFrame) -> DataFrame:
    """Active topics that lead to no known equipment; a null id leads to none."""
    return register.where("active").join(equipments.select("id_equipment"), "id_equipment", "left_anti").select("id_packml_register", "packml_topic")


def sentinel(published: DataFrame, values: DataFrame) -> DataFrame:
    """Whether each published (id_equipment, ts_value, metric_value) is found at its equipment."""
    seen = values.select("id_equipment", "ts_value", F.col("net_production_incr").alias("metric_value")).distinct().withColumn("seen", F.lit(True))
    return published.join(seen, ["id_equipment", "ts_value", "metric_value"], "left").select("id_equipment", "ts_value", "metric_value", F.coalesce("seen", F.lit(False)).alias("found"))
