"""SimHash near-duplicates by pivot distance tables.

A fingerprint's row in the pivot table holds its Hamming distances to fixed reference
fingerprints: the zero reference, 64 references of one bit each, and 32 pseudo-random ones. A
changed bit moves one one-bit coordinate relative to the zero reference and leaves the other 63
alone. So when two fingerprints differ in at most three bits, at least three of six bands of
one-bit coordinates are equal, and the pair meets under one of the 20 choices of three bands: this
finds every link. Pairs that meet are discarded as soon as any coordinate of their rows differs by
more than three (the triangle inequality); survivors are verified on the fingerprints themselves.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import components, job, lean, texts, whole_groups, written

SEED, SHINGLE_WORDS, MAX_BITS = 42, 3, 3
#: Fingerprints of a key that one task compares; a larger key is dealt out in pairs of blocks of this size.
BLOCK_ROWS = 4096
BANDS, EQUAL_BANDS, BAND_BITS = 6, 3, 11
BIT_REFERENCES = np.array([1 << i for i in range(64)], dtype=np.uint64)
RANDOM_REFERENCES = np.array([xxhash.xxh64_intdigest(str(i).encode(), SEED) for i in range(32)], dtype=np.uint64)
REFERENCES = np.concatenate([RANDOM_REFERENCES, np.zeros(1, dtype=np.uint64), BIT_REFERENCES])
BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
BYTE_OFFSETS = np.arange(8, dtype=np.int64) * 256


def shingle_hashes(text: str | None, size: int = SHINGLE_WORDS) -> np.ndarray:
    """The hash of each shingle of a text, repeats included; of all its words where it has fewer than size, none for no words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    n = max(1, len(words) - size + 1)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[:n].tolist(), ends[min(size, len(words)) - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[s:e], SEED) for s, e in spans), dtype=np.uint64, count=n)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    per_byte = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + BYTE_OFFSETS).ravel(), minlength=2048).reshape(8, 256)
    bits = (2 * (per_byte @ BITS_OF_BYTE) > len(hashes)).ravel().astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of a text's three-word shingles; zero for a text without words."""
    return majority(shingle_hashes(text))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long) per row of docs; fp holds the unsigned bits."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return texts(docs).mapInArrow(lean(run), "doc_id long, fp long")


def pivot_table(fps: np.ndarray) -> np.ndarray:
    """Distances of each fingerprint (rows) to each reference (columns)."""
    return np.bitwise_count(fps[:, None] ^ REFERENCES[None, :]).astype(np.int8)


def band_keys(table: np.ndarray) -> np.ndarray:
    """For each row, one key for every choice of EQUAL_BANDS bands of one-bit coordinates."""
    zero = table[:, len(RANDOM_REFERENCES)].astype(np.int64)
    bits = (zero[:, None] + 1 - table[:, len(RANDOM_REFERENCES) + 1 :]) // 2  # the reference's bit is set in the fingerprint or not
    bands = np.array_split(np.arange(64), BANDS)
    values = [bits[:, b] @ (1 << np.arange(len(b), dtype=np.int64)) for b in bands]
    keys = []
    for choice, picked in enumerate(combinations(range(BANDS), EQUAL_BANDS)):
        key = np.full(len(table), choice, dtype=np.int64)
        for b in picked:
            key = key << BAND_BITS | values[b]
        keys.append(key)
    return np.stack(keys, axis=1)


def _near_pairs(units: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that span, unit by unit, all links of at most MAX_BITS bits; rows are sorted by unit."""
    table, root = pivot_table(fps), np.arange(len(fps))
    left: list[int] = []
    right: list[int] = []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    at = np.arange(len(fps))
    for off in range(1, len(fps)):
        at = at[at + off < len(fps)]
        at = at[units[at] == units[at + off]]
        if not len(at):
            break
        i = at[root[at] != root[at + off]]
        for columns in (slice(0, 8), slice(8, None)):
            i = i[np.abs(table[i, columns] - table[i + off, columns]).max(axis=1) <= MAX_BITS] if len(i) else i
        i = i[np.bitwise_count(fps[i] ^ fps[i + off]) <= MAX_BITS]
        for x in i.tolist():
            if (a := find(x)) != (b := find(x + off)):
                root[max(a, b)] = min(a, b)
                left.append(x)
                right.append(x + off)
        if len(i):
            while not np.array_equal(flat := root[root], root):
                root[:] = flat
    return np.array(left, dtype=np.int64), np.array(right, dtype=np.int64)


def links(fps: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Edges (a, b) between the distinct fingerprints in fps(fp), whose components are those of all links.

    A key under which more than block_rows fingerprints meet is dealt out as pairs of blocks, so a
    task never holds more than two blocks, and a block pair yields a spanning forest, not all pairs.
    """
    spark = fps.sparkSession

    def keyed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
            keys = band_keys(pivot_table(x.view(np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(x, keys.shape[1]))], names=["key", "fp"])

    def compared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, "unit"):
            x = group.column("fp").to_numpy()
            i, j = _near_pairs(group.column("unit").to_numpy(), x.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(x[i]), pa.array(x[j])], names=["a", "b"])

    keys = fps.mapInArrow(lean(keyed), "key long, fp long")
    sizes = keys.groupBy("key").count().where(F.col("count") > block_rows)
    sizes = sizes.select("key", F.ceil(F.col("count") / block_rows).cast("int").alias("n"))
    own = F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")
    dealt = keys.join(sizes, "key", "left").withColumn("own", own)
    dealt = dealt.withColumn("other", F.explode(F.when(F.col("n").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("n") - 1))))
    dealt = dealt.where(F.col("n").isNull() | (F.col("own") != F.col("other")))
    unit = F.when(F.col("n").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")))
    units = dealt.select(unit.alias("unit"), "fp")
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return units.repartition(width, "unit").sortWithinPartitions("unit", "fp").mapInArrow(lean(compared), "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) per row of docs.

    component_id is the smallest doc_id that links of at most MAX_BITS differing fingerprint bits
    reach, the document itself included. Null and empty texts have fingerprint zero and link like
    any other; repeated rows are returned as often as they occur; a null doc_id is never the
    smallest unless its whole component has none. Equal fingerprints are merged before any pair is
    formed. Other columns of docs are ignored. An empty table gives an empty result.
    """
    with job(docs.sparkSession):
        marked = written(fingerprints(docs), "simhash-fingerprints", outer=True)
        distinct = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
        roots = components(links(distinct.select("fp")), "simhash-links")
        named = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
        lowest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
        classes = written(named.join(lowest, "root").select("fp", "component_id"), "simhash-classes", outer=True)
    return marked.join(classes, "fp").select("doc_id", "fp", "component_id")
