"""Benchmark decontamination in DataFrame operations only.

The test set's normalised word windows go out as a broadcast hash table; every training window is
looked up in it by a 64-bit hash of its words in any case, and each hit is verified on the window's
own text. Then the words of verified windows, or the documents that hold them, are removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import if_small, job, no_id, row_key, written

WINDOW_WORDS = 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII but for digits and letters; all else, and every other character, belongs to words.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def _plain(words: Column, start: Column, size: Column) -> Column:
    """The normalised text of size words from start (from 1) on: A-Z in lower case, single spaces."""
    return F.translate(F.array_join(F.slice(words, start, size), " "), UPPER, LOWER)


def _hashed(words: Column) -> Column:
    """A hash of each word in any case; folded words agree wherever normalised ones do."""
    return F.transform(words, lambda w: F.xxhash64(F.lower(w)))


def _windows(hashes: Column, size: int) -> Column:
    """(start, hash, n) of each window of size words, by the hashes of its words and its size; n is null."""
    last = F.size(hashes) - (size - 1)
    of = lambda i: F.struct(i.alias("start"), F.xxhash64(F.slice(hashes, i, size), F.lit(size)).alias("hash"), F.lit(None).cast("int").alias("n"))
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), of)).otherwise(F.array().cast("array<struct<start:int,hash:bigint,n:int>>"))


def test_windows(benchmark: DataFrame, window_words: int = WINDOW_WORDS) -> tuple[DataFrame, DataFrame, list[int]]:
    """The distinct windows of benchmark(item_id, text), the items of each set of items, and the window sizes in use.

    A window's row: hash, size, plain text and the digest of the set of items that hold it; the
    sets' rows: digest and item id as a string. An item of fewer words than window_words is one
    window of its own size; one without words has none.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).where("item is not null")
    sized = written(items.select("item", _words(F.col("text")).alias("words")).withColumn("n", F.least(F.size("words"), F.lit(window_words))).where("n > 0"), "decontam-items")
    sizes = sorted(r["n"] for r in sized.select("n").distinct().collect()) or [window_words]  # at most window_words numbers
    hashed = sized.select("item", "words", "n", _hashed(F.col("words")).alias("hashes"))
    parts = [hashed.where(F.col("n") == k).select("item", "words", F.col("n").alias("size"), F.inline_outer(_windows(F.col("hashes"), k))) for k in sizes]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.union(p)
    plain = whole.where("hash is not null").select("item", "hash", "size", _plain(F.col("words"), F.col("start"), F.col("size")).alias("plain"))
    sets = plain.groupBy("hash", "size", "plain").agg(F.array_sort(F.collect_set("item")).alias("items")).withColumn("held_by", F.md5(F.to_json("items")))
    sets = written(sets, "decontam-sets")
    return sets.drop("items"), sets.select("held_by", F.explode("items").alias("item")).distinct(), sizes


def _keyed(docs: DataFrame) -> DataFrame:
    """(did, th, text): rows with equal did and th have equal texts and share their verdict."""
    return docs.select(*row_key(), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _scanned(docs: DataFrame, tests: DataFrame, sizes: list[int], outer: bool = False) -> DataFrame:
    """One pass over the texts: of each row (did, th, n), n its number of words, and of each window met (did, th, start, size, plain, held_by)."""
    worded = _keyed(docs).select("did", "th", _words(F.col("text")).alias("words"))
    # words, and then hashes, are named twice, so that Catalyst keeps them as columns and makes them once
    hashed = worded.select("did", "th", F.size("words").alias("n"), _hashed(F.col("words")).alias("hashes"))
    mark = F.array(F.struct(F.lit(0).alias("start"), F.lit(None).cast("long").alias("hash"), F.col("n")))
    # the outer form, as Catalyst would copy the whole expression into a filter below an inner one
    found = hashed.select("did", "th", F.inline_outer(F.concat(mark, *[_windows(F.col("hashes"), k) for k in sizes])))
    met = found.join(if_small(tests, "decontam-tests"), "hash", "left").where("start = 0 or plain is not null")
    return written(met.select("did", "th", "n", "start", "size", "plain", "held_by"), "decontam-scan", outer)


def _verified(docs: DataFrame, scanned: DataFrame) -> DataFrame:
    """(did, th, met) of each document in which a test window occurs; met: start, size and held_by of each such window."""
    met = scanned.where("start > 0").groupBy("did", "th").agg(F.collect_set(F.struct("start", "size", "plain", "held_by")).alias("met"))
    met = written(met, "decontam-met")
    # only the texts of documents that were met are fetched and split, before the join, so that no condition above it splits them anew
    fetched = _keyed(docs).join(if_small(met.select("did", "th"), "decontam-keys"), ["did", "th"], "left_semi").distinct()
    worded = fetched.select("did", "th", _words(F.col("text")).alias("words"))
    holds = lambda m: (m["start"] <= F.size("words")) & (_plain(F.col("words"), m["start"], m["size"]) == m["plain"])
    sure = worded.join(met, ["did", "th"]).select("did", "th", F.filter("met", holds).alias("met"))
    return sure.select("did", "th", F.transform("met", lambda m: m.dropFields("plain")).alias("met")).where(F.size("met") > 0)


def hits(docs: DataFrame, benchmark: DataFrame, window_words: int = WINDOW_WORDS) -> DataFrame:
    """(did, th, positions) of each document in which a test window occurs.

    positions are the hit words, counted from 0 and in order. (did, th) is the row's key, as row_key makes it.
    """
    with job(docs.sparkSession):
        tests, _, sizes = test_windows(benchmark, window_words)
        sure = _verified(docs, _scanned(docs, tests, sizes))
        return written(sure.select("did", "th", _positions().alias("positions")), "decontam-hits", outer=True)


def _positions() -> Column:
    spans = F.transform("met", lambda m: F.sequence(m["start"] - 1, m["start"] + m["size"] - 2))
    return F.array_sort(F.array_distinct(F.flatten(spans)))


def report(docs: DataFrame, benchmark: DataFrame, window_words: int = WINDOW_WORDS) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items, contaminated) per row of docs.

    Null and empty texts have no words and are clean, as is every document against an empty
    benchmark; test items with a null id or no words are ignored. Repeated rows are returned as
    often as they occur, rows that share a doc_id are judged each by its own text. Other columns of
    docs are ignored; an empty table gives an empty result. Documents in which nothing occurs meet
    the hits in a left join of narrow rows.
    """
    with job(docs.sparkSession):
        tests, sets, sizes = test_windows(benchmark, window_words)
        scanned = _scanned(docs, tests, sizes, outer=True)
        sure = written(_verified(docs, scanned), "decontam-sure")
        # items join by sets of items, so that a passage that many items share costs a document one set
        named = sure.select("did", "th", F.explode(F.array_distinct(F.transform("met", lambda m: m["held_by"]))).alias("held_by")).join(sets, "held_by")
        named = named.groupBy("did", "th").agg(F.array_sort(F.collect_set("item")).alias("items"))
        found = sure.select("did", "th", F.size(_positions()).cast("long").alias("n_hit")).join(named, ["did", "th"])
        found = written(found, "decontam-found", outer=True)
    rows = scanned.where("start = 0").select("did", "th", F.col("n").cast("long").alias("n_words"))
    return rows.join(found, ["did", "th"], "left").select(
        F.when(~no_id(), F.col("did")).alias("doc_id"),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, window_words: int = WINDOW_WORDS) -> DataFrame:
    """The rows of docs, all columns, in which no test window occurs."""
    found = if_small(hits(docs, benchmark, window_words).select(F.struct("did", "th").alias("hit")), "decontam-dirty")
    key = F.struct(*row_key())
    return docs.join(found, key == found.hit, "left_anti")


def without_spans(docs: DataFrame, benchmark: DataFrame, window_words: int = WINDOW_WORDS) -> DataFrame:
    """(doc_id, text) per row of docs, hit words taken out and all else left as it is; a null text becomes empty."""
    found = _keyed(docs).join(hits(docs, benchmark, window_words), ["did", "th"], "left")
    gaps = F.split("text", WORDS)
    kept = F.transform(_words(F.col("text")), lambda w, i: F.when(F.array_contains("positions", i), F.lit("")).otherwise(w))
    rebuilt = F.array_join(F.zip_with(gaps, kept, lambda g, w: F.concat(g, F.coalesce(w, F.lit("")))), "")
    return found.select(F.when(~no_id(), F.col("did")).alias("doc_id"), F.when(F.col("positions").isNull(), F.col("text")).otherwise(rebuilt).alias("text"))
