"""What operators did, from the audit log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.columns import newest, within
from loomline.plans.params import Params


def field(name: str) -> Column:
    """A payload field as text; a JSON null is null."""
    return F.get_json_object("payload", f"$.{name}")


def per_user(logs: DataFrame, p: Params, n: int = 20) -> DataFrame:
    counted = logs.where(within("ts_log", p)).groupBy("nm_user").agg(F.count("*").alias("actions"))
    return newest(counted, n, F.col("actions").desc(), F.col("nm_user"))


def distribution(logs: DataFrame, p: Params) -> DataFrame:
    counted = logs.where(within("ts_log", p)).groupBy(F.coalesce("category", F.lit("unknown")).alias("action")).agg(F.count("*").alias("n"))
    return counted.orderBy(F.col("n").desc(), "action")


def log(logs: DataFrame, p: Params, n: int = 500) -> DataFrame:
    """The newest rows; fields are taken from the payload after the cut."""
    rows = newest(logs.where(within("ts_log", p)), n, F.col("ts_log").desc(), F.col("id_equipment"), F.col("category"), F.col("payload"))
    empty = F.lit("")
    return rows.select(
        "ts_log",
        "nm_user",
        "category",
        F.coalesce(field("nmProductionOrder"), empty).alias("product"),
        F.coalesce(field("descCategory"), empty).alias("desc_category"),
        F.coalesce(field("cdSubcategory"), empty).alias("subcategory"),
        F.coalesce(field("descSubcategory"), field("txtDowntimeNotes"), field("txtProductionOrderNotes"), empty).alias("detail"),
        "id_equipment",
    )


def json_match(logs: DataFrame, category: str, name: str, value: str) -> DataFrame:
    rows = logs.where((F.col("category") == category) & (field(name) == value))
    return rows.select("ts_log", "nm_user", "id_equipment", field("idProductionOrder").alias("matched_id"))
