"""Spelling variants: words of a corpus one code point apart, found in a trie of letter-group counts.

Letters fall into 12 groups; a word's frequency vector says how many letters of each it has. The trie
branches by one group's count after the other. An inserted letter makes one count greater by one (a
surplus), a replaced one may make another less by one (a deficit), so a depth-first search with a
budget of one each meets every word at distance one; the words of the leaves it meets are verified.

The trie's upper levels are table keys: a subtree of at most UNIT_WORDS words is a unit, which one task
builds and searches; a larger one is parted by the next four levels, and the searches that reach it go on
into the parts. Words of one vector that are still too many share the first or the last half with any
neighbour, and are parted by these.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import job, lean, prepare, whole_groups, written

LEAST_LETTERS, LEAST_COUNT = 6, 5
#: A form must be so many times as frequent as the word.
FORM_FACTOR = 5
#: A run whose hash with the document's id this number divides loses a code point (the given corruption rule).
EVERY = 199
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "[a-zÀ-ÿ]+"
LETTERS = LOWER + "".join(chr(c) for c in range(0xC0, 0x100))
#: Groups of letters, by code point, and the levels of the trie where its tables are parted.
GROUPS, CUTS = 12, (4, 8, 12)
#: Words of a subtree that is searched as a whole, and searches that one task makes in it.
UNIT_WORDS, UNIT_PROBES = 10_000, 50_000
#: Words that a node of the trie keeps as a list.
LEAF_WORDS = 8


def corrupted(run: Column, doc_id: Column) -> Column:
    """run without the code point that its hash with doc_id points at, where EVERY divides the hash; a null id is empty text."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = (h % F.length(run)).cast("int")
    return F.when(h % EVERY == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def words(docs: DataFrame, every: int | None = EVERY) -> DataFrame:
    """(word, n) of each word of enough letters and occurrences; every=None counts the runs as they are."""
    runs = F.regexp_extract_all(F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER, LOWER), F.lit(RUN), F.lit(0))
    # the outer form, as Catalyst would copy the whole expression into a filter below an inner one
    each = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode_outer(runs).alias("run")).where(F.length("run") >= LEAST_LETTERS)
    word = F.col("run") if every is None else corrupted(F.col("run"), F.col("doc_id"))
    return each.select(word.alias("word")).where(F.length("word") >= LEAST_LETTERS).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _counts() -> list[Column]:
    size = F.length("word")
    return [size - F.length(F.translate("word", "".join(c for c in LETTERS if ord(c) % GROUPS == g), "")) for g in range(GROUPS)]


def _key(counts: list[Column]) -> Column:
    return F.concat_ws(",", *(c.cast("string") for c in counts))


def _steps(levels: range) -> Iterator[tuple[int, int, dict[int, int]]]:
    """(surplus spent, deficit spent, changes of the counts) of each way over some levels; a deficit comes after the surplus."""
    yield 0, 0, {}
    for i in levels:
        yield 1, 0, {i: 1}
        yield 0, 1, {i: -1}
        for j in range(i + 1, levels.stop):
            yield 1, 1, {i: 1, j: -1}


def _onward(probes: DataFrame, levels: range) -> DataFrame:
    """The searches probes (word, n, counts, key, surplus, deficit), taken over some more levels."""
    ways = []
    for more, less, change in _steps(levels):
        counts = [F.col("counts")[i] + change.get(i, 0) for i in levels]
        ways.append(F.struct(F.lit(more).alias("more"), F.lit(less).alias("less"), F.concat_ws(",", F.nullif(F.col("key"), F.lit("")), _key(counts)).alias("to")))
    after = F.col("surplus") + F.col("way.more"), F.col("deficit") + F.col("way.less")
    gone = probes.select("word", "n", "counts", "surplus", "deficit", F.explode(F.array(*ways)).alias("way"))
    # a deficit is spent only where the surplus is: of two words of one length, the one with the greater vector is looked for
    gone = gone.where((after[0] <= 1) & (after[1] <= after[0]))
    return gone.select("word", "n", "counts", F.col("way.to").alias("key"), after[0].alias("surplus"), after[1].alias("deficit"))


def _halves(word: Column, at: Column, key: Column) -> list[Column]:
    """Keys of a word by the first and the last half of at letters."""
    first = F.floor(at / 2).cast("int")
    part = lambda side, text: F.concat(key, F.lit(side), at.cast("string"), F.lit(":"), text)
    return [part("|first", F.substring(word, F.lit(1), first)), part("|last", F.substring(word, F.length(word) - at + first + 1, at - first))]


def _units(vocabulary: DataFrame) -> DataFrame:
    """(unit, depth, searched, word, n, surplus, deficit): what each unit's trie holds, and the words to be searched for in it."""
    held = written(vocabulary.select("word", "n", F.array(*_counts()).alias("counts")), "trie-words")
    probes = held.select("*", F.lit("").alias("key"), F.lit(0).alias("surplus"), F.lit(0).alias("deficit"))
    done = []
    row = lambda df, depth, searched: df.select(F.col("key").alias("unit"), F.lit(depth).alias("depth"), F.lit(searched).alias("searched"), "word", "n", *([F.col("surplus"), F.col("deficit")] if searched else [F.lit(0).alias("surplus"), F.lit(0).alias("deficit")]))
    start = 0
    for cut in CUTS:
        keyed = held.withColumn("key", _key([F.col("counts")[i] for i in range(cut)]))
        sizes = written(keyed.groupBy("key").agg(F.count("*").alias("size")), "trie-sizes")
        keyed, probes = keyed.join(sizes, "key"), _onward(probes, range(start, cut)).join(sizes, "key")
        if sizes.where(F.col("size") > UNIT_WORDS).isEmpty():
            return _all([*done, row(keyed, cut, False), row(probes, cut, True)])
        keyed, probes = written(keyed, "trie-keyed"), written(probes, "trie-probes")
        small = F.col("size") <= UNIT_WORDS
        done += [row(keyed.where(small), cut, False), row(probes.where(small), cut, True)]
        held, probes = keyed.where(~small).drop("key", "size"), probes.where(~small).drop("size")
        start = cut
    # words of one vector: whatever is near shares the first or the last half of the shorter word's letters
    size = F.length("word")
    keyed = held.withColumn("key", _key([F.col("counts")[i] for i in range(GROUPS)]))
    both = [*_halves(F.col("word"), size, F.col("key")), *_halves(F.col("word"), size - 1, F.col("key"))]
    keyed = keyed.select("word", "n", F.explode(F.array(*both)).alias("key"))
    blocks = F.ceil(F.count("*") / UNIT_WORDS).alias("blocks")
    sizes = written(keyed.groupBy("key").agg(blocks), "trie-halves")
    block = lambda at: F.concat(F.col("key"), F.lit("|"), at.cast("string"))
    keyed = keyed.join(sizes, "key").withColumn("key", block(F.pmod(F.xxhash64("word"), F.col("blocks"))))
    probes = probes.withColumn("key", F.explode(F.array(*_halves(F.col("word"), size, F.col("key"))))).join(sizes, "key")
    probes = probes.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumn("key", block(F.col("at")))
    return _all([*done, row(keyed, GROUPS, False), row(probes, GROUPS, True)])


def _all(frames: list[DataFrame]) -> DataFrame:
    whole = frames[0]
    for f in frames[1:]:
        whole = whole.union(f)
    return whole


def _dealt(units: DataFrame) -> DataFrame:
    """units, where one with many searches is several units, each with all its words and a part of the searches."""
    searches = units.where("searched").groupBy("unit").agg(F.ceil(F.count("*") / UNIT_PROBES).alias("parts"))
    of = units.join(searches, "unit")
    part = F.when(F.col("searched"), F.array(F.pmod(F.xxhash64("word"), F.col("parts")))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    return of.withColumn("part", F.explode(part)).withColumn("unit", F.concat("unit", F.lit("#"), F.col("part").cast("string"))).drop("part", "parts")


def vector(word: str) -> tuple[int, ...]:
    counts = [0] * GROUPS
    for c in word:
        counts[ord(c) % GROUPS] += 1
    return tuple(counts)


def near(a: str, b: str) -> bool:
    """Whether b is a with exactly one code point replaced or inserted."""
    n, i = len(a), 0
    while i < n and a[i] == b[i]:
        i += 1
    if len(b) == n:
        return i < n and a[i + 1 :] == b[i + 1 :]
    return len(b) == n + 1 and a[i:] == b[i + 1 :]


class Leaf:
    """Words of one node that are told apart no further; many are looked up by halves."""

    def __init__(self, words: list):
        self.words, self.halves = words, None

    def like(self, word: str) -> Iterable:
        if len(self.words) <= 4 * LEAF_WORDS:
            return self.words
        n = len(word)
        if self.halves is None:
            self.halves = defaultdict(dict)
            for w in self.words:
                for m in (len(w[0]), len(w[0]) - 1):
                    self.halves[m, 0, w[0][: m // 2]][w[0]] = w
                    self.halves[m, 1, w[0][len(w[0]) - m + m // 2 :]][w[0]] = w
        return {**self.halves.get((n, 0, word[: n // 2]), {}), **self.halves.get((n, 1, word[n // 2 :]), {})}.values()


def trie(words: list[tuple], level: int) -> dict | Leaf:
    """A node over words (word, n, vector): branches by the count of a letter group, from level on."""
    if len(words) <= LEAF_WORDS or level == GROUPS:
        return Leaf(words)
    parts = defaultdict(list)
    for w in words:
        parts[w[2][level]].append(w)
    return {count: trie(part, level + 1) for count, part in parts.items()}


def leaves(node: dict | Leaf, level: int, counts: tuple, surplus: int, deficit: int) -> Iterator[Leaf]:
    """The leaves below node that a search with what is left of its budget meets, depth first."""
    todo = [(node, level, surplus, deficit)]
    while todo:
        node, level, surplus, deficit = todo.pop()
        if isinstance(node, Leaf):
            yield node
            continue
        count = counts[level]
        for spent, left, at in ((surplus, deficit, count), (surplus + 1, deficit, count + 1), (surplus, deficit + 1, count - 1)):
            if spent <= 1 and left <= spent and (below := node.get(at)) is not None:
                todo.append((below, level + 1, spent, left))


PAIR = "word string, n long, other string, other_n long"


def _search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of near words of each unit, each pair once: the shorter one first, or the one of the lesser vector or text."""
    for table in whole_groups(batches, "unit"):
        units: dict = {}
        for unit, depth, searched, word, n, surplus, deficit in zip(*(table.column(c).to_pylist() for c in ("unit", "depth", "searched", "word", "n", "surplus", "deficit")), strict=True):
            held, probes = units.setdefault((unit, depth), ([], defaultdict(list)))
            if searched:
                probes[vector(word), surplus, deficit].append((word, n))
            else:
                held.append((word, n, vector(word)))
        found: list[tuple] = []
        for (_, depth), (held, probes) in units.items():
            root = trie(held, depth)
            for (counts, surplus, deficit), asked in probes.items():
                for leaf in leaves(root, depth, counts, surplus, deficit):
                    for word, n in asked:
                        for other, m, those in leaf.like(word):
                            if (len(other) > len(word) or (len(other) == len(word) and (those, other) > (counts, word))) and near(word, other):
                                found.append((word, n, other, m))
        if found:
            columns = list(zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.int64())], names=["word", "n", "other", "other_n"])


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """(word, n, other, other_n): each pair of words of vocabulary (word, n) at distance one, once."""
    prepare(vocabulary.sparkSession)
    units = written(_units(vocabulary), "trie-units")
    dealt = _dealt(units).repartition("unit").sortWithinPartitions("unit")
    found = dealt.mapInArrow(lean(_search), PAIR)
    return written(found.distinct(), "trie-pairs")


def variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of docs (doc_id, text).

    Null and empty texts have no words, and no documents have no rows. A word that is near to none, or to none
    frequent enough, has a null form and is its own root. Forms grow FORM_FACTOR-fold on each step, so the way
    to a root has few steps; it is halved round by round. Repeated documents count repeatedly; columns
    not named here are not read.
    """
    with job(docs.sparkSession):
        vocabulary = written(words(docs), "trie-vocabulary")
        pairs = near_pairs(vocabulary)
        both = pairs.union(pairs.select("other", "other_n", "word", "n"))
        # the greatest count first, of equal ones the smallest in code-point order
        best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form")))
        met = both.groupBy("word", "n").agg(F.count("*").alias("n_near"), best.alias("best"))
        formed = F.when(-F.col("best.less") >= FORM_FACTOR * F.col("n"), F.struct(F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n")))
        met = written(met.select("word", "n_near", formed.alias("f")), "trie-met")
        roots = written(met.where("f is not null").select("word", F.col("f.form").alias("root")), "trie-roots")
        while True:
            on = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
            stepped = written(roots.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "trie-roots")
            roots = stepped.select("word", "root")
            if stepped.where("moved").isEmpty():
                break
        shown = vocabulary.join(met, "word", "left").join(roots, "word", "left")
        shown = shown.select("word", F.col("f.form").alias("form"), F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("f.form_n").alias("form_n"))
        return written(shown, "trie-variants", outer=True)
