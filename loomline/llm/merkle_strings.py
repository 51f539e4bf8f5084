"""A Merkle manifest of a corpus: a tree of threes per source, a tree over the sources, a proof for every document.

Nodes in order are cut into aligned blocks of 3^6. Each block is one row that keeps a level as one
string of hex digests: fixed-width substrings of it are hashed to the level above, and those that
flank a node are its siblings. The blocks' tops are the nodes of the next tier, until one is left.
No row holds more than a block, so a source of any size is spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomline.llm.common import if_small, job, written

#: Children of a node, levels that a block of nodes climbs, and hex characters of a digest.
ARITY, LEVELS, HEX = 3, 6, 64
BLOCK = ARITY**LEVELS
#: What a leaf is hashed from, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_PARENTS = f"""encode(array_join(transform(sequence(0, (octet_length(element_at(up, -1)) - 1) div {ARITY * HEX}),
    i -> sha2(substring(element_at(up, -1), i * {ARITY * HEX} + 1, {ARITY * HEX}), 256)), ''), 'utf-8')"""
#: The levels of a block, from its nodes to its top; a block that is all of its group stops where one node is left.
_CLIMB = f"""aggregate(sequence(1, {LEVELS}), array(encode(array_join(items.node, ''), 'utf-8')),
    (up, k) -> if(total <= {BLOCK} and octet_length(element_at(up, -1)) <= {HEX}, up, array_append(up, {_PARENTS})))"""
_AT = f"(item.pos div element_at(array({', '.join(str(ARITY**k) for k in range(LEVELS + 1))}), level + 1))"
#: The siblings left and right of an item's node on each level below the block's top.
_FLANKS = f"""transform(slice(levels, 1, size(levels) - 1), (nodes, level) -> struct(
    cast(substring(nodes, int(({_AT} - {_AT} % {ARITY}) * {HEX} + 1), int({_AT} % {ARITY} * {HEX})) as string) as left,
    cast(substring(nodes, int(({_AT} + 1) * {HEX} + 1), int(({ARITY - 1} - {_AT} % {ARITY}) * {HEX})) as string) as right))"""
_NO_PATH = "cast(array() as array<struct<left: string, right: string>>)"


def leaf(**values: Column) -> Column:
    """The digest of one document's fields: each its UTF-8 byte count, a colon and its value; a dash for null."""
    field = lambda c: F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))
    return F.sha2(F.concat(*(field(values[name].cast("string")) for name in FIELDS)), 256)


def folded(node: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, node, lambda below, s: F.sha2(F.concat(s["left"], below, s["right"]), 256))


def _ranked(nodes: DataFrame, order: list[str], label: str) -> DataFrame:
    """nodes with rank, their place from 0 in their grp by order, and total, the nodes of the grp.

    Sorted by ranges over all tasks; a task's rows are numbered as they lie, and only one row per task and
    grp is added up. order must have no long ties: rows equal in it can't be spread.
    """
    key = ["grp", *order]
    lying = written(nodes.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("lies", F.monotonically_increasing_id()), f"{label}-sorted")
    placed = lying.withColumns({"task": F.shiftright("lies", 33), "row": F.col("lies").bitwiseAND((1 << 33) - 1)}).drop("lies")
    runs = placed.groupBy("grp", "task").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("grp").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumns({"before": F.coalesce(F.sum("n").over(before), F.lit(0)), "total": F.sum("n").over(Window.partitionBy("grp"))}).drop("n")
    return placed.join(if_small(runs, f"{label}-runs"), ["grp", "task"]).withColumn("rank", F.col("row") - F.col("first") + F.col("before")).drop("task", "row", "first", "before")


def _blocks(nodes: DataFrame, label: str, *kept: str) -> DataFrame:
    """(grp, block, total, items, levels) of nodes (grp, rank, total, node, kept)."""
    item = F.struct((F.col("rank") % BLOCK).cast("int").alias("pos"), "node", *kept)
    dealt = nodes.groupBy("grp", F.expr(f"rank div {BLOCK}").alias("block"), "total").agg(F.array_sort(F.collect_list(item)).alias("items"))
    return written(dealt.withColumn("levels", F.expr(_CLIMB)), label)


def _tiers(nodes: DataFrame, label: str, *kept: str) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of each tier, and (grp, top) of each grp."""
    tiers, tops = [], []
    while True:
        tiers.append(_blocks(nodes, f"{label}-tier", *kept))
        up = tiers[-1].select("grp", F.col("block").alias("rank"), F.expr(f"(total + {BLOCK - 1}) div {BLOCK}").alias("total"), F.element_at("levels", -1).cast("string").alias("node"))
        tops.append(up.where("total = 1").select("grp", F.col("node").alias("top")))
        if tiers[-1].where(F.col("total") > BLOCK).isEmpty():
            break
        nodes, kept = up.where("total > 1"), ()
    whole = tops[0]
    for t in tops[1:]:
        whole = whole.union(t)
    return tiers, whole


def _paths(tiers: list[DataFrame], above: DataFrame, label: str, *kept: str) -> DataFrame:
    """(kept, path, and what above has) of each node of the lowest tier; above: (grp, path, ...) goes on from the top of each grp.

    A path goes down tier by tier to the blocks below, each joined by its own block: no grp meets in one task.
    """
    more = [c for c in above.columns if c not in ("grp", "path")]
    carried = None
    for tier in reversed(tiers):
        ends = tier.where(F.col("total") <= BLOCK).select("grp", "block").join(if_small(above, f"{label}-above"), "grp")
        known = ends if carried is None else ends.unionByName(carried.select(*ends.columns))
        met = tier.select("grp", "block", "items", "levels").join(if_small(known, f"{label}-known"), ["grp", "block"])
        one = met.select("grp", "block", "levels", "path", *more, F.explode("items").alias("item"))
        whole = one.select("grp", F.expr(f"block * {BLOCK} + item.pos").alias("rank"), F.concat(F.expr(_FLANKS), F.col("path")).alias("path"), *more, "item")
        carried = whole.withColumnRenamed("rank", "block")
    return carried.select(*(F.col("item")[c].alias(c) for c in kept), "path", *more)


def manifest(docs: DataFrame, beside: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, path, and what beside names) of each row of docs (doc_id, source, lang, n_chars, text).

    path lists, from the leaf to the root, the siblings left and right of the node on the way, each as joined
    hex digests, empty where there are none. beside: columns computed from a row of docs that are carried along.
    Leaves ascend by doc_id in their source, null first, rows of one doc_id by their leaf; repeated rows are leaves
    of their own. A null source is a source, the first. No rows have no root. Columns not named here are not read.
    """
    beside = beside or {}
    spark = docs.sparkSession
    with job(spark):
        # a null source before all others, and all others bytewise
        group = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
        leaves = docs.select(group.alias("grp"), F.col("doc_id").cast("long").alias("doc_id"), leaf(**{c: F.col(c) for c in FIELDS}).alias("node"), *(c.alias(n) for n, c in beside.items()), F.monotonically_increasing_id().alias("read"))
        kept = ["doc_id", "node", *beside]
        tiers, tops = _tiers(_ranked(written(leaves, "merkle-leaves"), ["doc_id", "node", "read"], "merkle"), "merkle", *kept[:1], *beside)
        tops = written(tops, "merkle-tops")
        sources = tops.select(F.lit("").alias("grp"), F.col("grp").alias("source"), F.col("top").alias("node"))
        over, root = _tiers(_ranked(sources, ["source"], "merkle-sources"), "merkle-sources", "source")
        above = _paths(over, root.select("grp", F.expr(_NO_PATH).alias("path"), F.col("top").alias("root")), "merkle-sources", "source", "node")
        above = above.select(F.col("source").alias("grp"), "path", F.col("node").alias("subroot"), "root")
        found = _paths(tiers, above, "merkle", *kept)
        return written(found.select("doc_id", F.col("node").alias("leaf"), "subroot", "root", "path", *beside), "merkle-manifest", outer=True)


def proof_digest(path: Column) -> Column:
    """One digest of all siblings on a path, from the leaf up and left to right."""
    return F.sha2(F.array_join(F.flatten(F.transform(path, lambda s: F.array(s["left"], s["right"]))), ""), 256)
