"""Resharding by minimum-cost flow.

Documents of each old shard fall into blocks. Only the blocks' sizes reach the driver, a number
fixed by the layout. A minimum-cost flow from old shards (their bytes) to new shards (equal
capacities), free where a byte stays and one per byte that moves, says how many bytes each shard
hands to each other; whole blocks are then picked to carry those amounts, and the files of the
shards that change are written.
"""

from __future__ import annotations

import uuid
from bisect import bisect_right
from collections import defaultdict, deque
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomline.llm.common import NO_ID, _folder, if_small, job, written

OLD_SHARDS, SHARDS, BLOCKS, ROW_BYTES = 32, 40, 256, 16
#: Bytes of documents that one task writes, about.
PART_BYTES = 256 << 20
#: A group of equal texts is kept on one shard up to this part of a shard's share of all bytes.
GROUP_PART = 0.25


def min_cost_flow(supply: list[int], capacity: list[int]) -> dict[tuple[int, int], int]:
    """Bytes from each old to each new shard, at the fewest bytes that change shard.

    Successive shortest paths; totals of supply and capacity are equal.
    """
    source, sink = -1, -2
    left: dict[tuple, int] = {}
    cost: dict[tuple, int] = {}
    near: dict = defaultdict(list)

    def arc(a, b, room: int, price: int) -> None:
        left[a, b], left[b, a], cost[a, b], cost[b, a] = room, 0, price, -price
        near[a].append(b)
        near[b].append(a)

    for i, s in enumerate(supply):
        arc(source, ("old", i), s, 0)
        for j in range(len(capacity)):
            arc(("old", i), ("new", j), s, int(i != j))
    for j, c in enumerate(capacity):
        arc(("new", j), sink, c, 0)
    while True:
        best, before, queue, queued = {source: 0}, {}, deque([source]), {source}
        while queue:
            a = queue.popleft()
            queued.discard(a)
            for b in near[a]:
                if left[a, b] > 0 and best[a] + cost[a, b] < best.get(b, 1 << 60):
                    best[b], before[b] = best[a] + cost[a, b], a
                    if b not in queued:
                        queue.append(b)
                        queued.add(b)
        if sink not in best:
            break
        path, b = [], sink
        while b != source:
            path.append((before[b], b))
            b = before[b]
        room = min(left[e] for e in path)
        for a, b in path:
            left[a, b] -= room
            left[b, a] += room
    return {(i, j): n for i in range(len(supply)) for j in range(len(capacity)) if (n := left[("new", j), ("old", i)])}


def flow_of(sizes: dict[tuple[int, int], int], shards: int) -> dict[tuple[int, int], int]:
    """The flow from the old shards' bytes, by blocks (old shard, number), to equal capacities."""
    supply = [0] * (1 + max((i for i, _ in sizes), default=-1))
    for (i, _), n in sizes.items():
        supply[i] += n
    total = sum(supply)
    return min_cost_flow(supply, [total // shards + (j < total % shards) for j in range(shards)])


def place_blocks(sizes: dict[tuple[int, int], int], shards: int, flow: dict[tuple[int, int], int]) -> dict[tuple[int, int], int]:
    """New shard of each block (old shard, number): whole blocks that come closest to the flow's amounts."""
    olds = 1 + max((i for i, _ in sizes), default=-1)
    placed: dict[tuple[int, int], int] = {}
    for i in range(olds):
        free = sorted((n, b) for (k, b), n in sizes.items() if k == i)
        for j, amount in sorted(((j, n) for (k, j), n in flow.items() if k == i and j != i), key=lambda x: -x[1]):
            while free and (at := bisect_right(free, (amount, 1 << 60))):
                n, b = free.pop(at - 1)
                placed[i, b] = j
                amount -= n
        for _, b in free:
            placed[i, b] = i if i < shards else min(range(shards), key=lambda j: sum(n for k, n in sizes.items() if placed.get(k) == j))
    held = [0] * shards
    inside: dict[int, set] = defaultdict(set)
    for k, j in placed.items():
        held[j] += sizes[k]
        inside[j].add(k)
    for _ in range(4 * len(sizes)):  # what whole blocks left uneven: one block at a time from the fullest to the emptiest
        high, low = max(range(shards), key=lambda j: (held[j], -j)), min(range(shards), key=lambda j: (held[j], j))
        gap = held[high] - held[low]
        fit = [(abs(2 * sizes[k] - gap), k) for k in inside[high] if 0 < sizes[k] < gap]
        if not fit:
            break
        k = min(fit)[1]
        inside[high].remove(k)
        inside[low].add(k)
        placed[k], held[high], held[low] = low, held[high] - sizes[k], held[low] + sizes[k]
    return placed


def hashed_layout(shards: int) -> Column:
    """An old layout for documents that have none yet: by a hash of the text, and of the id where a group is spread."""
    return F.pmod(F.xxhash64(F.lit("old"), "same", "spread"), F.lit(shards)).cast("int")


class Resharded(NamedTuple):
    """files: the shards' rows; path: where they lie; moved, fewest: bytes that changed shard, and that had to by the flow."""

    files: DataFrame
    path: str
    moved: int
    fewest: int


def reshard(docs: DataFrame, shards: int = SHARDS, old_shard: Column | None = None, blocks: int = BLOCKS, unchanged: bool = False, part_bytes: int = PART_BYTES) -> Resharded:
    """Shard files of docs(doc_id, text) under the shared folder, read back.

    Rows: doc_id, text (null: empty), size (UTF-8 bytes plus ROW_BYTES), shard, slot (gapless from 0 in each shard).
    old_shard is an expression over did (doc_id, NO_ID for null) and text that gives the present
    shard from 0 on, 0 where it is null; hashed_layout(OLD_SHARDS) if none. Equal texts of one old shard come
    to one shard; a group of more than GROUP_PART of a shard is spread by its ids, as the shards' sizes come first. Shards that neither gain nor lose a block
    are skipped unless unchanged is true or the layout is new. Rows with equal or null doc_id are
    placed each on their own; other columns are ignored; an empty table gives empty files.

    A task writes about part_bytes of one shard. Only blocks' sizes reach the driver; where they
    are larger than that, they are split further, and those pieces are placed in Spark.
    """
    spark = docs.sparkSession
    fresh = old_shard is None
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("did"), "text", (F.octet_length("text") + ROW_BYTES).cast("long").alias("size"), F.xxhash64("text").alias("same"))
    with job(spark):
        groups = written(rows.groupBy("same").agg(F.sum("size").alias("size")), "shard-groups")
        total = groups.agg(F.sum("size").alias("n")).first()["n"] or 0
        # fewer than shards / GROUP_PART by their size
        large = [r["same"] for r in groups.where(F.col("size") > GROUP_PART * total / shards).collect()]
        rows = rows.withColumn("spread", F.when(F.col("same").isin(large), F.col("did")).otherwise(0) if large else F.lit(0).cast("long"))
        old = hashed_layout(OLD_SHARDS) if fresh else F.coalesce(old_shard, F.lit(0))
        rows = rows.withColumns({"old": old.cast("int"), "block": F.pmod(F.xxhash64(F.lit("block"), "same", "spread"), F.lit(blocks)).cast("int")})
        found = written(rows.groupBy("old", "block").agg(F.sum("size").alias("size"), F.count("*").alias("n")), "shard-blocks")
        sizes = {(r["old"], r["block"]): r["size"] for r in found.collect()}  # old shards times blocks
        flow = flow_of(sizes, shards)
        placed = place_blocks(sizes, shards, flow)
        changed = {j for (i, _), j in placed.items() if i != j} | {i for (i, _), j in placed.items() if i != j} | {j for j in range(shards) if fresh or unchanged}
        held: dict[int, int] = defaultdict(int)
        for k, j in placed.items():
            held[j] += sizes[k]
        first, tasks = {}, 0  # of each shard's tasks
        for j in sorted(held):
            if j in changed:
                first[j] = tasks
                tasks += 1 + held[j] // part_bytes
        plan = spark.createDataFrame([(i, b, j, first[j]) for (i, b), j in sorted(placed.items()) if j in changed], "old int, block int, shard int, first int")
        pieces = 1 + max(sizes.values(), default=0) // part_bytes
        rows = rows.withColumn("piece", F.pmod(F.xxhash64(F.lit("piece"), "did", "text"), F.lit(pieces)).cast("int"))
        if pieces > 1:
            found = rows.groupBy("old", "block", "piece").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
        else:
            found = found.withColumn("piece", F.lit(0))
        before = Window.partitionBy("shard").orderBy("old", "block", "piece").rowsBetween(Window.unboundedPreceding, -1)
        sum_before = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
        starts = found.join(F.broadcast(plan), ["old", "block"])  # plan: old shards times blocks rows
        starts = starts.select("old", "block", "piece", "shard", (F.col("first") + F.floor(sum_before("size") / part_bytes)).cast("int").alias("task"), sum_before("n").alias("start"))
        dealt = rows.join(if_small(starts, "shard-starts"), ["old", "block", "piece"])
        order = Window.partitionBy("task", "old", "block", "piece").orderBy("doc_id", "text")
        slotted = dealt.repartitionById(max(1, tasks), "task").withColumn("slot", F.col("start") + F.row_number().over(order) - 1)
        path = f"{_folder(spark, outer=True)}/shards-{uuid.uuid4().hex}"
        slotted.select("doc_id", "text", "size", "slot", "shard").write.mode("overwrite").option("compression", "zstd").partitionBy("shard").parquet(path)
    back = spark.read.schema("doc_id long, text string, size long, slot long, shard int").parquet(path)
    moved = sum(n for k, n in sizes.items() if placed[k] != k[0])
    return Resharded(back, path, moved, sum(n for (i, j), n in flow.items() if i != j))
