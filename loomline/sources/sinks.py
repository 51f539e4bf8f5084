"""Writers: upsert by parts that a manifest names and levels merge, append, current value, dead letters, logs by hour."""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

METRICS = ("net_production_incr", "scrap_incr", "state", "mode", "speed")


def work_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); one of our own only in local mode, where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="loomline-work-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


#: Parts of one level that are merged into one of the next.
FANOUT = 8


def _path(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, folder: str) -> list[str]:
    place, fs = _path(spark, folder)
    return sorted(f.getPath().getName() for f in fs.listStatus(place)) if fs.exists(place) else []


def delete(spark: SparkSession, path: str) -> None:
    place, fs = _path(spark, path)
    fs.delete(place, True)


def manifest(spark: SparkSession, target: str) -> dict:
    """The newest state of an upsert target: version, number of the last batch (-1 before any), and its parts as [level, name]."""
    found = [n for n in _names(spark, f"{target}/_manifest") if n.endswith(".json")]
    if not found:
        return {"version": 0, "last": -1, "parts": []}
    place, fs = _path(spark, f"{target}/_manifest/{found[-1]}")
    stream = fs.open(place)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _commit(spark: SparkSession, target: str, state: dict) -> None:
    """Makes a state the newest, by a rename that fails if another writer was faster."""
    final = f"{target}/_manifest/{state['version']:012d}.json"
    draft, fs = _path(spark, f"{target}/_manifest/.{uuid.uuid4().hex}")
    stream = fs.create(draft)
    stream.write(bytearray(json.dumps(state).encode()))
    stream.close()
    if not fs.rename(draft, _path(spark, final)[0]):
        fs.delete(draft, False)
        raise RuntimeError(f"another writer has committed version {state['version']} of {target}")


def _vacuum(spark: SparkSession, target: str, *kept: dict) -> None:
    """Deletes what neither of the newest two states names: parts that were merged, and left-overs of batches that died."""
    parts, versions = {name for state in kept for _, name in state["parts"]}, {f"{state['version']:012d}.json" for state in kept}
    for name in _names(spark, target):
        if name != "_manifest" and name not in parts:
            delete(spark, f"{target}/{name}")
    for name in _names(spark, f"{target}/_manifest"):
        if name not in versions:
            delete(spark, f"{target}/_manifest/{name}")


def upsert(batch: DataFrame, target: str, number: int) -> None:
    """Stores a batch of rows (ts_value, id_equipment, metrics, seq) in target, as batch of that number.

    A batch is a part of level 0; FANOUT parts of a level are merged into one of the next, so few are ever
    live, and a row is rewritten once a level. What counts is what the newest manifest names: a batch that dies
    before its commit has changed nothing, and one that is committed already is not stored again. Readers that
    began with the state before still find its parts.
    """
    spark = batch.sparkSession
    before = manifest(spark, target)
    if number <= before["last"]:
        return
    name = f"part-0-{number}"
    merged(batch).write.mode("overwrite").parquet(f"{target}/{name}")
    parts, level = [*before["parts"], [0, name]], 0
    while len(full := [n for k, n in parts if k == level]) >= FANOUT:
        level += 1
        name = f"part-{level}-{number}"
        merged(spark.read.parquet(*(f"{target}/{n}" for n in full))).write.mode("overwrite").parquet(f"{target}/{name}")
        parts = [[k, n] for k, n in parts if k != level - 1] + [[level, name]]
    after = {"version": before["version"] + 1, "last": number, "parts": parts}
    _commit(spark, target, after)
    _vacuum(spark, target, before, after)


def merged(rows: DataFrame) -> DataFrame:
    """One row per ts_value and id_equipment: each metric's last non-null value by seq, the greatest of one seq, and the seq of each."""
    newest = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct((F.col(f"{c}_seq") if f"{c}_seq" in rows.columns else F.col("seq")).alias("seq"), c)))
    found = rows.groupBy("ts_value", "id_equipment").agg(*(newest(c).alias(f"last_{c}") for c in METRICS))
    return found.select("ts_value", "id_equipment", *(F.col(f"last_{c}")[c].alias(c) for c in METRICS), *(F.col(f"last_{c}")["seq"].alias(f"{c}_seq") for c in METRICS))


def upserted(spark: SparkSession, target: str) -> DataFrame:
    """What a target holds by its newest manifest; one that no batch was committed to is an error."""
    parts = manifest(spark, target)["parts"]
    if not parts:
        raise ValueError(f"no batch was committed to {target}")
    return merged(spark.read.parquet(*(f"{target}/{name}" for _, name in parts))).select("ts_value", "id_equipment", *METRICS)


def upsert_stream(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.foreachBatch(lambda df, number: upsert(df, target, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_stream(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def latest(values: DataFrame) -> DataFrame:
    """The newest speed and its time per equipment."""
    spoken = values.where("speed IS NOT NULL")
    return spoken.groupBy("id_equipment").agg(F.max(F.struct("ts_value", "speed")).alias("last")).select("id_equipment", F.col("last.speed").alias("speed"), F.col("last.ts_value").alias("last_update"))


def current_stream(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Keeps one row per equipment: what a batch brings is compared with what is stored."""

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = latest(batch)
        if number:
            old = spark.read.parquet(f"{target}/{number - 1}").select("id_equipment", "speed", F.col("last_update").alias("ts_value"))
            fresh = latest(old.unionByName(fresh.withColumnRenamed("last_update", "ts_value")))
        fresh.write.mode("overwrite").parquet(f"{target}/{number}")
        if number > 1:  # the version before stays, for a replay of this batch
            delete(spark, f"{target}/{number - 2}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def zoneless(df: DataFrame) -> DataFrame:
    """Streams need TIMESTAMP for watermarks; what they wrote is returned as the batch tables have it."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c, kind in df.dtypes if kind == "timestamp"})


STORE = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, as transformWithState asks for."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all there is and returns what it wrote; its checkpoint goes."""
    spark = stream.sparkSession
    base = f"{work_dir(spark)}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        query = append_stream(stream, f"{base}/out", f"{base}/checkpoint")
    else:
        writer = stream.writeStream.outputMode(mode).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{base}/out"))
        query = writer.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    delete(spark, f"{base}/checkpoint")
    return zoneless(spark.read.schema(stream.schema).parquet(f"{base}/out"))


def letters_stream(read: DataFrame, good: str, dead: str, checkpoint: str) -> StreamingQuery:
    """Messages as ingest.read_messages gives them, each batch to two places: metrics to good, dead letters to dead.

    Both are folders by batch, written anew if the batch is: a replay doubles nothing.
    """
    from loomline.operators import ingest

    def put(batch: DataFrame, number: int) -> None:
        batch = batch.persist()  # both writes read the source once
        try:
            ingest.metrics_of(batch).write.mode("overwrite").parquet(f"{good}/batch={number}")
            ingest.dead_letters(batch).write.mode("overwrite").parquet(f"{dead}/batch={number}")
        finally:
            batch.unpersist()

    return read.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


HOUR = "%Y-%m-%d-%H"


def store_logs(logs: DataFrame, path: str) -> None:
    """Adds log lines to a table by hour of ts."""
    logs.withColumn("hour", F.date_format("ts", "yyyy-MM-dd-HH")).hint("rebalance", "hour").write.mode("append").partitionBy("hour").parquet(path)


def drop_old_logs(spark: SparkSession, path: str, as_of: str, hours: int = 72) -> list[str]:
    """Deletes the hours that lie wholly before the retention; returns their names. No line of another hour is read or written."""
    oldest = f"hour={(datetime.fromisoformat(as_of) - timedelta(hours=hours)).strftime(HOUR)}"
    gone = [n for n in _names(spark, path) if n.startswith("hour=") and n < oldest]
    for name in gone:
        delete(spark, f"{path}/{name}")
    return gone


def stored_logs(spark: SparkSession, path: str, as_of: str, hours: int = 72) -> DataFrame:
    """The lines within the retention: older hours are pruned, and of the oldest hour left only the later lines are kept."""
    oldest = datetime.fromisoformat(as_of) - timedelta(hours=hours)
    kept = spark.read.parquet(path).where(F.col("hour") >= oldest.strftime(HOUR))
    return kept.where(F.col("ts") > F.lit(str(oldest)).cast("timestamp_ntz")).drop("hour")
