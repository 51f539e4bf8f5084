"""What the text operators share: inputs, written intermediate tables, batches and components."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are long, so Arrow batches hold few rows.
BATCH_ROWS = "1000"
#: Stands for a null id where ids are joined or ordered; row_key tells it from a row of that very id.
NO_ID = -(2**63)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def prepare(spark: SparkSession) -> None:
    """Small Arrow batches, and this package on the executors unless their PYTHONPATH has it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    root, context = Path(__file__).resolve().parents[2], spark.sparkContext
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(context, "loomline_sent", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="loomline-code-")) / "loomline.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted((root / "loomline").rglob("*.py")):
            out.write(file, file.relative_to(root))
    context.addPyFile(str(archive))  # Spark hands it from the driver to every executor
    context.loomline_sent = True


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) alone, so that no other column of the caller can clash with ours."""
    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; one of our own only in local mode, where the session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="loomline-shared-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


#: Folders of the jobs that are open here, the innermost last. Each thread has its own: queries side by side share no folder.
_JOBS: ContextVar[tuple[str, ...]] = ContextVar("loomline_jobs", default=())


def _folder(spark: SparkSession, outer: bool = False) -> str:
    """Where intermediate tables go: the open job's folder (outer: that of the job around it), else the application's."""
    jobs = _JOBS.get()[:-1] if outer else _JOBS.get()
    return jobs[-1] if jobs else f"{shared_dir(spark)}/loomline-{spark.sparkContext.applicationId}"


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder in whatever store it lies."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def job(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables written inside are deleted at the end; what shall last is written with outer."""
    folder = f"{_folder(spark)}/job-{uuid.uuid4().hex}"
    before = _JOBS.set((*_JOBS.get(), folder))
    try:
        yield
    finally:
        _JOBS.reset(before)
        delete(spark, folder)


def clean(spark: SparkSession) -> None:
    """Deletes all that this application has written between steps; results not yet written can't be read any more."""
    delete(spark, _folder(spark))


def written(df: DataFrame, label: str, outer: bool = False) -> DataFrame:
    """df written to the shared folder and read back: lineage ends there, and a lost executor costs no rerun."""
    spark = df.sparkSession
    path = f"{_folder(spark, outer)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


#: Bytes up to which a table is broadcast; beyond, it is joined by a shuffle.
BROADCAST_BYTES = 64 << 20


def _bytes_of(name: str, kind: str) -> Column:
    """About how many bytes a value takes in memory."""
    c = F.col(f"`{name}`")
    if kind in ("string", "binary"):
        return F.octet_length(c) + 24
    if kind == "array<string>":
        return F.aggregate(c, F.lit(24).cast("long"), lambda total, x: total + F.coalesce(F.octet_length(x), F.lit(0)) + 24)
    if kind.startswith("array"):
        return F.size(c).cast("long") * 16 + 24
    return F.lit(16 * (1 + kind.count(",")))


def if_small(df: DataFrame, label: str, most: int | None = None) -> DataFrame:
    """df, written once and measured: marked for broadcast if its values take at most so many bytes, BROADCAST_BYTES if not said."""
    df = written(df, label)
    row = sum((F.coalesce(_bytes_of(n, k).cast("long"), F.lit(24)) for n, k in df.dtypes), F.lit(16).cast("long"))
    size = df.agg(F.coalesce(F.sum(row), F.lit(0)).alias("n")).first()["n"]
    return F.broadcast(df) if size <= (BROADCAST_BYTES if most is None else most) else df


#: What a Python worker keeps from task to task: the tables of one operator at most.
_HELD: dict = {}


def held(key: tuple, make: Callable):
    """make(), kept by the worker for the next task that asks for the same key; others' tables go."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def drop_held() -> None:
    """Forgets what the worker keeps. A function of the module, as Spark sends inner functions with copies of the module's values."""
    _HELD.clear()


def give_back() -> None:
    """Returns freed memory to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def lean(run: Callable, keeps: bool = False) -> Callable:
    """run for mapInArrow, whose worker gives memory back at its end, and keeps tables of earlier steps only if it uses held()."""

    def guarded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            drop_held()
        try:
            yield from run(batches)
        finally:
            give_back()

    return guarded


class Remembered:
    """Values by key in two generations of at most size keys each: what is asked for again outlives what is not."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def missing(self, keys: Iterable) -> set:
        """Those of keys that have no value yet; the values of all others are in young from now on."""
        if len(self.young) > self.size:
            self.young, self.old = {}, self.young
        new = set(keys).difference(self.young)
        if self.old:
            again = {k: self.old[k] for k in new if k in self.old}
            self.young.update(again)
            new.difference_update(again)
        return new


def row_key(doc_id: str = "doc_id", text: str = "text") -> tuple[Column, Column]:
    """What rows are joined and ordered by: did, the id with NO_ID for null, and th, a hash of the text (null: empty).

    Under NO_ID th is negative for null ids, and not for rows of that very id: (did, th) tells them
    apart and has null ids first. no_id() reads it back.
    """
    given, hashed = F.col(doc_id).cast("long"), F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))
    low = hashed.bitwiseAND(F.lit(2**63 - 1))
    th = F.when(given.isNull(), low.bitwiseOR(F.lit(NO_ID))).when(given == NO_ID, low).otherwise(hashed)
    return F.coalesce(given, F.lit(NO_ID)).alias("did"), th.alias("th")


def no_id() -> Column:
    """Whether the id of a (did, th) of row_key is null."""
    return (F.col("did") == NO_ID) & (F.col("th") < 0)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows no classifier may learn from: crc32 of the id as text leaves 2 on division by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def whole_groups(batches: Iterable[pa.RecordBatch], key: str, at_least: int = 65536) -> Iterator[pa.Table]:
    """Tables of at_least rows out of batches sorted by key, none of which splits a key."""
    kept: list[pa.Table] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(pa.Table.from_batches([batch]))
        rows += batch.num_rows
        if rows < at_least:
            continue
        table = pa.concat_tables(kept).combine_chunks()
        keys = table.column(key).to_numpy()
        last = int(np.searchsorted(keys, keys[-1]))
        if last:
            yield table.slice(0, last)
        kept = [table.slice(last)]
        rows = table.num_rows - last
    if rows:
        yield pa.concat_tables(kept).combine_chunks()


def components(edges: DataFrame, label: str) -> DataFrame:
    """Connected components of undirected edges (a, b): rows (node, root), root the smallest node.

    Alternating large-star and small-star rounds. A node's minimum is a map-side-combined
    aggregate joined back, so a hub of any degree is never gathered in a task. Each round is
    written to the shared folder. Nodes without an edge are not returned.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = written(small.select("e.*").where("a <> b").distinct(), label)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
