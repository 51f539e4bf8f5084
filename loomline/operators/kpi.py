"""Quality, performance, availability and OEE, always from summed parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.columns import STATE_RUNNING, count_where, percent, ratio, rounded, total

#: Lower ends of yellow and of green (fixed values).
BANDS = {"quality": (90, 97), "performance": (80, 94), "availability": (80, 90), "oee": (65, 85)}
HIERARCHY = ("id_enterprise", "id_site", "id_area", "id_equipment")


def with_speed(values: DataFrame, equipments: DataFrame) -> DataFrame:
    return values.join(equipments.select("id_equipment", "production_speed"), "id_equipment")


def parts() -> list[Column]:
    """Sums and counts from which every KPI follows at any level; the sums don't depend on the order of rows, as a KPI may lie on a tie."""
    net, scrap, speed, rated, state = (F.col(c) for c in ("net_production_incr", "scrap_incr", "speed", "production_speed", "state"))
    runs = (speed > 0) & (rated > 0)
    joint = net.isNotNull() & state.isNotNull() & (rated > 0)
    return [
        total(net).alias("net"),
        total(F.when(net.isNotNull(), scrap)).alias("scrap"),
        total(F.when(runs, speed)).alias("speed"),
        total(F.when(runs, rated)).alias("rated"),
        count_where(state == STATE_RUNNING).alias("running"),
        F.count(state).alias("stated"),
        total(F.when(joint, net)).alias("j_net"),
        total(F.when(joint, scrap)).alias("j_scrap"),
        total(F.when(joint, F.when(speed > 0, speed).otherwise(0.0))).alias("j_speed"),
        total(F.when(joint, F.when(speed > 0, rated).otherwise(0.0))).alias("j_rated"),
        count_where(joint & (state == STATE_RUNNING)).alias("j_running"),
        count_where(joint).alias("j_rows"),
    ]


def from_parts() -> dict[str, Column]:
    c = F.col
    product = ratio(c("net"), c("net") + c("scrap")) * ratio(c("speed"), c("rated")) * ratio(c("running"), c("stated"))
    panel = ratio(c("j_net"), c("j_net") + c("j_scrap")) * ratio(c("j_speed"), c("j_rated")) * ratio(c("j_running"), c("j_rows"))
    return {
        "quality": percent(c("net"), c("net") + c("scrap")),
        "performance": percent(c("speed"), c("rated")),
        "availability": percent(c("running"), c("stated")),
        "oee_panel": rounded(panel * 100),
        "oee_product": rounded(product * 100),
    }


def by(values: DataFrame, equipments: DataFrame, *keys: str) -> DataFrame:
    """All KPIs per keys. A state or speed that no row of a key carries leaves the KPI null.

    oee_panel keeps only rows that carry production and a state, which drops stopped machines that
    report no production; oee_product multiplies the three panel factors and is the sound one.
    """
    summed = with_speed(values, equipments).groupBy(*keys).agg(*parts())
    return summed.select(*keys, *(v.alias(k) for k, v in from_parts().items()))


def one(values: DataFrame, equipments: DataFrame, name: str) -> DataFrame:
    return by(values, equipments).select(F.col(name).alias("value"))


def by_hierarchy(values: DataFrame, equipments: DataFrame) -> DataFrame:
    """KPIs at each level of enterprise, site, area, equipment and over all; level counts the keys in use."""
    summed = with_speed(values, equipments).rollup(*HIERARCHY).agg(*parts(), F.grouping_id().alias("g"))
    level = F.lit(len(HIERARCHY)) - F.bit_count("g")
    return summed.select(level.cast("int").alias("level"), *HIERARCHY, *(v.alias(k) for k, v in from_parts().items()))


def banded(kpis: DataFrame) -> DataFrame:
    """red, yellow or green for each KPI; null where it is null."""

    def band(value: Column, low: int, high: int) -> Column:
        return F.when(value >= high, "green").when(value >= low, "yellow").when(value.isNotNull(), "red")

    names = {"quality": "quality", "performance": "performance", "availability": "availability", "oee_panel": "oee"}
    return kpis.select("id_equipment", *(band(F.col(c), *BANDS[b]).alias(f"{b}_band") for c, b in names.items()))


def minute_aggregate(values: DataFrame, as_of: Column) -> DataFrame:
    """Per equipment and minute of the hour before as_of, 30 rows by equipment and newest minute."""
    recent = values.where(F.col("ts_value") > as_of - F.expr("INTERVAL 1 HOUR"))
    minute = F.date_trunc("minute", "ts_value").cast("timestamp_ntz").alias("bucket")
    summed = recent.groupBy("id_equipment", minute).agg(
        F.sum("net_production_incr").alias("net"),
        F.sum("scrap_incr").alias("scrap"),
        F.round(F.avg("speed"), 1).alias("avg_speed"),
        percent(count_where(F.col("state") == STATE_RUNNING), F.count("*")).alias("avail_pct"),
    )
    return summed.orderBy("id_equipment", F.col("bucket").desc()).limit(30)
