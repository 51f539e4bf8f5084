"""Line deduplication by pairwise alignment.

Lines are hashed. A least block (a shortest run of lines with MIN_WORDS words) that occurs in two documents at least
links each later document to the first that holds it: pairs grow with the lines in common, not with the square of a
group. Rare blocks, of RARE documents at most, link first; what their alignments delete needs no other link, and only
documents that hold more of what others hold are linked through common blocks after that. Each pair is aligned by
patience diff (lines unique on both sides, in their longest common order, then outwards and in between). What stands
elsewhere in the earlier document, moved or repeated, is aligned with that place in turn. The aligned common blocks
are deleted from the later document, so that no block of MIN_WORDS words that an earlier document holds is left. Blocks of fewer words stay.
As a deleted line always has an earlier document that holds it, its first copy is never lost.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import if_small, job, lean, prepare, row_key, written

#: Words of the shortest common block that is deleted.
MIN_WORDS = 5
#: Documents that hold a rare block, at most. It orders the links and loses none.
RARE = 16
TRIM = " \t\r\x0b\x0c"
#: Of the hash of a run of lines.
PRIME, BASE = (1 << 61) - 1, 0x1B873593CC9E2D5


def _line_hash(line: str) -> int:
    """A line's hash without white space at its ends; 0 for a blank line."""
    body = line.strip(TRIM)
    return xxhash.xxh64_intdigest(body.encode("utf-8", "replace")) >> 1 | 1 if body else 0


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Matched positions (i, j), ascending, of a patience diff of a and b."""
    matched: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            matched.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            matched.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        once_a, once_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {h: j for j, h in enumerate(b[b0:b1], b0) if once_b[h] == 1}
        pairs = [(i, where[h]) for i, h in enumerate(a[a0:a1], a0) if once_a[h] == 1 and h in where]
        # longest ascending run of j, by piles
        tops: list[int] = []
        piles: list[int] = []
        back: list[int] = []
        for k, (_, j) in enumerate(pairs):
            at = bisect_left(tops, j)
            back.append(piles[at - 1] if at else -1)
            tops[at : at + 1], piles[at : at + 1] = [j], [k]
        anchors, k = [], piles[-1] if piles else -1
        while k >= 0:
            anchors.append(pairs[k])
            k = back[k]
        if not anchors:
            continue
        last = (a0, b0)
        for i, j in anchors[::-1]:
            matched.append((i, j))
            todo.append((last[0], i, last[1], j))
            last = (i + 1, j + 1)
        todo.append((last[0], a1, last[1], b1))
    return sorted(matched)


def _least_blocks(hashes: list[int], words: list[int], min_words: int) -> list[tuple[int, int, int]]:
    """(start, end, key) of each shortest run of lines with at least min_words words from a line on, and up to a line.

    Whatever block of so many words a line lies in, one of these that lies in the block holds the line too.
    """
    sums, powers, counts = [0], [1], [0]
    for h, n in zip(hashes, words, strict=True):
        sums.append((sums[-1] * BASE + h + 1) % PRIME)
        powers.append(powers[-1] * BASE % PRIME)
        counts.append(counts[-1] + n)
    spans, n, end, start = set(), len(hashes), 0, 0
    for k in range(n):
        while end < n and counts[end] - counts[k] < min_words:
            end += 1
        if counts[end] - counts[k] >= min_words:
            spans.add((k, end))
        while counts[k + 1] - counts[start + 1] >= min_words and start < k:
            start += 1
        if counts[k + 1] - counts[start] >= min_words:
            spans.add((start, k + 1))
    return [(s, e, (sums[e] - sums[s] * powers[e - s]) % PRIME) for s, e in spans]


def common_blocks(earlier: list[int], later: list[int], words: list[int], min_words: int = MIN_WORDS) -> list[int]:
    """Positions of later in aligned common blocks of at least min_words words; words counts each of its lines' words.

    After the patience diff of both, runs of lines that it leaves and that earlier holds elsewhere (repeated lines,
    blocks in another order, ranges without a line of their own) are aligned each with the range where earlier has them.
    """
    found: set[int] = set()

    def align(a0: int, a1: int, b0: int, b1: int) -> None:
        block: list[int] = []
        last = None
        for i, j in [*patience(earlier[a0:a1], later[b0:b1]), (None, None)]:
            if last is None or (i, j) != (last[0] + 1, last[1] + 1):
                if sum(words[k] for k in block) >= min_words:
                    found.update(block)
                block = []
            if i is not None:
                block.append(b0 + j)
                last = (i, j)

    align(0, len(earlier), 0, len(later))
    known = set(earlier)
    if all(k in found or h not in known for k, h in enumerate(later)):
        return sorted(found)
    words_of = dict(zip(later, words, strict=True))
    at: dict[int, int] = {}
    for s, _, key in sorted(_least_blocks(earlier, [words_of.get(h, min_words) for h in earlier], min_words)):
        at.setdefault(key, s)
    ranges: list[list[int]] = []  # start and end in later, and how far ahead earlier has the same lines
    for s, e, key in sorted(_least_blocks(later, words, min_words)):
        if key in at and not found.issuperset(range(s, e)):
            if ranges and s <= ranges[-1][1] and ranges[-1][2] == at[key] - s:
                ranges[-1][1] = max(e, ranges[-1][1])
            else:
                ranges.append([s, e, at[key] - s])
    for s, e, ahead in ranges:
        align(s + ahead, e + ahead, s, e)
    return sorted(found)


def _keyed(docs: DataFrame) -> DataFrame:
    prepare(docs.sparkSession)
    return docs.select(*row_key(), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def line_hashes(docs: DataFrame) -> DataFrame:
    """(did, th, hashes, words) per distinct document: hash and number of words of each line."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [t.split("\n") for t in batch.column("text").to_pylist()]
            hashes = pa.array([[_line_hash(x) for x in found] for found in lines], type=pa.list_(pa.int64()))
            words = pa.array([[len(x.split()) for x in found] for found in lines], type=pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("did"), batch.column("th"), hashes, words], names=["did", "th", "hashes", "words"])

    return _keyed(docs).mapInArrow(lean(run), "did long, th long, hashes array<long>, words array<int>")


def deletions(docs: DataFrame, min_words: int = MIN_WORDS, rare: int = RARE) -> DataFrame:
    """(did, th, gone): line positions to delete from each later document that has any.

    A document is aligned with the first document of each of its rare blocks, then with that of each common block
    that is not deleted as a whole by then. The result is the same for every value of rare.
    """
    with job(docs.sparkSession):
        return written(_deletions(docs, min_words, rare), "line-gone", outer=True)


def _deletions(docs: DataFrame, min_words: int, rare: int) -> DataFrame:
    lines = written(line_hashes(docs).dropDuplicates(["did", "th"]), "line-hashes")

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for hashes, words, gone in zip(*(batch.column(c).to_pylist() for c in ("hashes", "words", "gone")), strict=True):
                done = set(gone or ())
                found.append({key for s, e, key in _least_blocks(hashes, words, min_words) if not done.issuperset(range(s, e))})
            sizes = [len(x) for x in found]
            ids = [pa.array(np.repeat(batch.column(c).to_numpy(), sizes)) for c in ("did", "th")]
            yield pa.RecordBatch.from_arrays([*ids, pa.array([key for x in found for key in x], type=pa.int64())], names=["did", "th", "h"])

    def align(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = [common_blocks(a, b, w, min_words) for a, b, w in zip(*(batch.column(c).to_pylist() for c in ("early", "hashes", "words")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("did"), batch.column("th"), pa.array(gone, type=pa.list_(pa.int32()))], names=["did", "th", "gone"])

    def held_by(of: DataFrame) -> DataFrame:
        return of.select("did", "th", "hashes", "words", "gone").mapInArrow(lean(blocks), "did long, th long, h long")

    early = lines.select(F.col("did").alias("adid"), F.col("th").alias("ath"), F.col("hashes").alias("early"))

    def aligned(held: DataFrame, first: DataFrame) -> DataFrame:
        pairs = held.join(first, "h").where("struct(did, th) <> first").select("did", "th", F.col("first.did").alias("adid"), F.col("first.th").alias("ath")).distinct()
        both = pairs.join(lines, ["did", "th"]).join(early, ["adid", "ath"]).select("did", "th", "early", "hashes", "words")
        return both.mapInArrow(lean(align), "did long, th long, gone array<int>").where("size(gone) > 0")

    def merged(found: DataFrame) -> DataFrame:
        return found.groupBy("did", "th").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("gone")))).alias("gone"))

    none = lines.withColumn("gone", F.lit(None).cast("array<int>"))
    # written, so that the joins read plain shuffles, whose hot lines and documents Spark can split
    held = written(held_by(none), "line-held")
    first = written(held.groupBy("h").agg(F.min(F.struct("did", "th")).alias("first"), F.count("*").alias("n")).where("n > 1"), "line-first")
    by_rare = written(merged(aligned(held, first.where(F.col("n") <= rare))), "line-rare")
    common = first.where(F.col("n") > rare)
    # what rare links have left of the documents they touched; all others as they are
    rest = held.join(by_rare, ["did", "th"], "left_anti").unionByName(held_by(by_rare.join(lines, ["did", "th"])))
    return merged(by_rare.unionByName(aligned(rest, common)))


def _placed(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs with the lines of each text, joined with its deletions where it has any; no Python touches the texts."""
    found = found.select(F.struct("did", "th").alias("__key"), F.col("gone").alias("__gone"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.struct(*row_key())
    # split before the join, so that no expression above it splits the text anew for every line
    lined = docs.withColumns({"__own": key, "__lines": F.split(text, "\n")})
    return lined.join(found, F.col("__own") == F.col("__key"), "left")


def _left() -> Column:
    """The text of the lines that stay."""
    stay = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__gone"))
    return F.array_join(F.transform(stay, lambda k: F.get(F.col("__lines"), k)), "\n")


def deduplicate(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text, n_lines, n_removed) per row of docs, aligned common blocks deleted from later documents.

    Later means a greater doc_id; a null doc_id is before all others, rows with equal doc_id are
    ordered by a hash of their texts, and repeated rows are one document and get the same result.
    Lines are compared without white space at their ends; blank lines link nothing but are deleted
    inside a block. A null or empty text has one empty line and stays empty. Other columns of docs
    are ignored; an empty table gives an empty result.
    """
    found = if_small(deletions(docs, min_words), "line-deletions")
    joined = _placed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), found)
    return joined.select(
        "doc_id",
        F.when(F.col("__gone").isNull(), F.col("text")).otherwise(_left()).alias("text"),
        F.size("__lines").cast("long").alias("n_lines"),
        F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone")).cast("long").alias("n_removed"),
    )


def apply_to_rows(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs, all columns, with shortened texts (and n_chars, where there is one); rows of which nothing is left go.

    Rows that lose no line are returned as they are, null and empty texts among them.
    """
    found = if_small(deletions(docs, min_words), "line-deletions")
    cut = _placed(docs, found).withColumn("__cut", F.when(F.col("__gone").isNotNull(), _left()))
    left = cut.where(F.col("__gone").isNull() | F.col("__cut").rlike(r"[^\s]"))
    shorter = {"text": F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.col("__cut"))}
    if "n_chars" in docs.columns:
        shorter["n_chars"] = F.when(F.col("__gone").isNull(), F.col("n_chars")).otherwise(F.length("__cut").cast("long"))
    return left.withColumns(shorter).select(*docs.columns)
