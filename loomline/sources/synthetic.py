"""Made-up ticks for timing writes and aggregates; no registered query reads them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions.columns import ntz


def ticks(spark: SparkSession, n: int, as_of: str, equipments: int = 2) -> DataFrame:
    """n ticks, a second apart and back from as_of, of equipment in turn; numbers come from a hash, so they are the same on every run."""
    draw = lambda name, most: F.pmod(F.xxhash64(F.lit(name), "id"), F.lit(most))
    ago = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("id").cast("decimal(18,6)"))
    return spark.range(n).select(
        (ntz(as_of) - ago).alias("ts_value"),
        (F.col("id") % equipments + 1).alias("id_equipment"),
        draw("net", 20).cast("double").alias("net_production_incr"),
        draw("scrap", 3).cast("double").alias("scrap_incr"),
        F.when(draw("state", 10) == 0, 10).otherwise(6).alias("state"),
        F.lit(1).alias("mode"),
        (draw("speed", 400) / 10.0).alias("speed"),
    )
