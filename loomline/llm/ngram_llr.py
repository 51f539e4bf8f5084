"""Quality rules: base counts of a text, and a hashed n-gram log-likelihood ratio.

Words and word pairs of every document are hashed into a fixed number of bins. The bins' counts over
all documents are the raw-corpus multinomial; those over trusted documents are the target
multinomial. A document's verdict is the mean over its n-grams of log(target / raw), held against a
fixed threshold: the same document and counts always get the same verdict.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import Remembered, held, if_small, lean, texts

BINS = 1 << 16
#: Added to every bin of both multinomials.
SMOOTHING = 1.0
#: Documents whose mean log ratio (nats per n-gram) is lower are not kept.
THRESHOLD = -0.15
PAIR = np.uint64(0x9E3779B97F4A7C15)  # fixed odd multiplier that tells a pair's first word from its second
WORD = re.compile("[^\x20\x09-\x0d]+")
SYMBOLS = re.compile(r"[#*$%&|<>]")
#: Hashes of words a worker remembers, in each of two generations.
REMEMBERED = 200_000


class Hasher:
    """64-bit hashes of words, remembered."""

    def __init__(self) -> None:
        self.known = Remembered(REMEMBERED)

    def __call__(self, words: list[str]) -> np.ndarray:
        for w in self.known.missing(words):
            self.known.young[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "replace"))
        return np.fromiter(map(self.known.young.__getitem__, words), dtype=np.uint64, count=len(words))


def hasher() -> Hasher:
    return held(("word hashes",), Hasher)


def bins(words: list[str], size: int = BINS) -> np.ndarray:
    """The bins of a document's words and of its pairs of neighbouring words."""
    h = hasher()(words)
    return np.concatenate([h, h[:-1] * PAIR + h[1:]]) % np.uint64(size)


def base_counts(text: str | None, words: list[str]) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words of a text and its words."""
    text = text or ""
    seen: set[str] = set()
    dup_lines = 0
    for line in text.split("\n"):
        if line in seen:
            dup_lines += 1
        elif WORD.search(line):
            seen.add(line)
    return sum(map(len, words)), len(SYMBOLS.findall(text)), dup_lines, repeat_words(words)


def repeat_words(words: list[str]) -> int:
    """Words that lie in a three-word window found at least twice in the text."""
    n = len(words) - 2
    if n < 2:
        return 0
    number = dict(zip(dict.fromkeys(words), range(len(words)), strict=False))
    if len(number) == len(words):
        return 0
    x = np.fromiter(map(number.__getitem__, words), dtype=np.int64, count=len(words))
    pair = np.unique(x[:-1] * len(number) + x[1:], return_inverse=True)[1] if len(number) > 2_000_000 else x[:-1] * len(number) + x[1:]
    window = pair[:-1] * len(number) + x[2:]
    _, at, count = np.unique(window, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(count[at] > 1)
    covered = np.zeros(len(words), dtype=bool)
    for k in range(3):
        covered[starts + k] = True
    return int(covered.sum())


def count_bins(docs: DataFrame, trusted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """n-grams per bin over all rows of docs, and over those whose doc_id is in trusted(doc_id).

    Each task adds up its own rows; only sums per bin are shuffled, and what reaches the driver is
    two numbers per bin, however large the corpus. No text is joined to be counted but those of
    trusted documents.
    """
    good = if_small(trusted.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "llr-trusted")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BINS, dtype=np.int64)
        for batch in batches:
            found = [bins(words) for text in batch.column("text").to_pylist() if text and (words := WORD.findall(text))]
            if found:
                total += np.bincount(np.concatenate(found).astype(np.int64), minlength=BINS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["bin", "n"])

    def counts(rows: DataFrame) -> np.ndarray:
        sums = rows.select("text").mapInArrow(lean(count, keeps=True), "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()
        found = np.zeros(BINS)
        found[sums.column("bin").to_numpy()] = sums.column("n").to_numpy()
        return found

    rows = texts(docs)
    return counts(rows), counts(rows.join(good, "doc_id", "left_semi"))


def log_ratios(raw: np.ndarray, target: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    """log(target share / raw share) of each bin; zero everywhere if nothing is trusted."""
    if not target.sum():
        return np.zeros(len(raw))
    share = lambda x: (x + smoothing) / (x.sum() + smoothing * len(x))
    return np.log(share(target)) - np.log(share(raw))


def judge(docs: DataFrame, ratios: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr, kept) per row of docs.

    llr is the mean log ratio of the text's words and word pairs, 0 for a text without words. A null
    or empty text has no words and fails the base rules. Repeated rows are returned as often as they
    occur; other columns of docs are ignored; an empty table gives an empty result.
    """
    table = docs.sparkSession.sparkContext.broadcast(ratios)  # one number per bin

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = table.value
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                words = WORD.findall(text) if text else []
                llr = float(ratio[bins(words).astype(np.int64)].mean()) if words else 0.0
                counts = base_counts(text, words)
                failed = len(words) < 50 or 100 * counts[3] > 50 * len(words)
                rows.append((len(words), *counts, failed, llr, not failed and llr >= threshold))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 8
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept"])

    kinds = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, llr double, kept boolean"
    return texts(docs).mapInArrow(lean(run, keeps=True), kinds)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_ids that labels(doc_id, quality, toxic) marks as good: quality 1 and not toxic."""
    return labels.where("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id")
