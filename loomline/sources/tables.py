"""Tables by name: raw Parquet, and the factory views over them as DataFrames."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.sources.views import VIEWS

RAW = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def used(sql: str) -> list[str]:
    """Names of the views that a query needs, those they need themselves included, in order."""
    found: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for name in VIEWS:
            if name not in found and re.search(rf"(?:FROM|JOIN|,)\s+{name}\b", text):
                found.add(name)
                todo.append(VIEWS[name])
    return [name for name in VIEWS if name in found]


def with_views(sql: str) -> str:
    """The query behind a WITH chain of the views that it needs, for an engine that knows the raw tables only."""
    names = used(sql)
    chain = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in names)
    body = sql.strip()
    if not names:
        return body
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(start):
            return f"{start}{chain},\n{body[len(start):]}"
    return f"WITH {chain}\n{body}"


class Tables:
    """Raw tables and views as attributes, each a DataFrame made once; streaming: `events` is read as a stream."""

    def __init__(self, spark: SparkSession, path: str, streaming: bool = False, frames: dict[str, DataFrame] | None = None):
        self.spark, self.path, self.streaming = spark, path.rstrip("/"), streaming
        self._made: dict[str, DataFrame] = dict(frames or {})

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or (name not in VIEWS and name not in RAW):
            raise AttributeError(name)
        if name not in self._made:
            self._made[name] = self._view(name) if name in VIEWS else self._raw(name)
        return self._made[name]

    def _raw(self, name: str) -> DataFrame:
        file = f"{self.path}/{name}.parquet"
        if not (self.streaming and name == "events"):
            return self.spark.read.parquet(file)
        schema = self.spark.read.parquet(file).schema
        path = self.spark._jvm.org.apache.hadoop.fs.Path(file)
        reader = self.spark.readStream.schema(schema)
        if path.getFileSystem(self.spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
            stream = reader.parquet(file)
        else:  # a stream reads folders
            stream = reader.option("pathGlobFilter", f"{name}.parquet").parquet(self.path)
        return stream.withColumn("ts", F.col("ts").cast("timestamp"))

    def _view(self, name: str) -> DataFrame:
        text = VIEWS[name].replace("{", "{{").replace("}", "}}")
        frames: dict[str, DataFrame] = {}

        def put(m: re.Match) -> str:
            if m[2] not in VIEWS and m[2] not in RAW:
                return m[0]
            frames[m[2]] = getattr(self, m[2])
            return f"{m[1]}{{{m[2]}}}"

        return self.spark.sql(re.sub(r"((?:FROM|JOIN)\s+)(\w+)\b", put, text), **frames)


def load_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A relational table read over JDBC in parts by ranges of a numeric key."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts))
    return reader.options(**options).load()
