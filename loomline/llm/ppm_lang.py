"""Language identification by prediction by partial matching.

For each language a context tree over bytes, up to three deep, holds how often each byte followed
each context. A byte's code length is -log2 of count / (n + q) in the longest context of the tree
that has seen it; each longer context that has not costs an escape of q / (n + q), with n the
context's total and q its number of different followers; below order 0 all bytes are alike. The
statistics are frozen after training, so code lengths are exact table look-ups, held in 1/1024 bit
integers: sums don't depend on order or batches. The language with the shortest code wins.
"""

from __future__ import annotations

import io
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.common import held, held_out, lean, prepare, texts

UNDETERMINED = "und"
#: Bytes of labelled text from which a language is learned, about; rows are chosen by a hash of doc_id and text.
TRAIN_BYTES = 4_000_000
ORDER = 3
#: A deepest context seen less often in every language is left out of the trees.
MIN_CONTEXT = 8
UNIT = 1024
#: Bits a byte takes without any model.
MAX_BITS = 8.0
#: Bytes coded at once; longer texts are coded in pieces that know the bytes before them.
STEP = 1 << 18
#: Contexts whose code lengths are computed at once.
ROWS_AT_ONCE = 2048
PAD = b"\n" * ORDER
LETTER = regex.compile(r"\p{L}")


def _bytes(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "replace")


def _context_and_byte(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position from ORDER on: the three bytes before it as one number, and its byte."""
    x = data.astype(np.int32)
    return x[:-3] << 16 | x[1:-2] << 8 | x[2:-1], x[3:]


def _grams(data: list[bytes]) -> np.ndarray:
    """Every byte with the three before it, as one number each; texts start after newlines."""
    if not data:
        return np.zeros(0, dtype=np.int64)
    parts = [_context_and_byte(np.frombuffer(PAD + d, dtype=np.uint8)) for d in data]
    return np.concatenate([c.astype(np.int64) << 8 | b for c, b in parts])


def _shares(of: list[int], data: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Texts of one language at a time, about STEP bytes together."""
    for k in sorted(set(of)):
        some, size = [], 0
        for d, x in zip(data, of, strict=True):
            if x == k:
                some.append(d)
                size += len(d)
                if size >= STEP:
                    yield k, some
                    some, size = [], 0
        if some:
            yield k, some


def train(docs: DataFrame, train_bytes: int = TRAIN_BYTES) -> bytes:
    """Languages and their counts, packed: learned from rows of docs(doc_id, text, lang) with a text and a lang.

    About train_bytes of text per language are used, whole texts chosen by a hash of doc_id and text, so
    the model's size has a bound that doesn't depend on the corpus.
    """
    spark = docs.sparkSession
    prepare(spark)
    usable = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where("text is not null and lang is not null")
    sizes = {r["lang"]: r["size"] for r in usable.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("size")).collect()}
    langs = sorted(sizes)
    if not langs:
        return _pack([], np.zeros((0, 3), dtype=np.int64))
    share = spark.createDataFrame([(x, k, min(1.0, train_bytes / max(1, sizes[x]))) for k, x in enumerate(langs)], "lang string, k int, share double")
    draw = F.pmod(F.xxhash64(F.lit("ppm"), "doc_id", "text"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = usable.join(F.broadcast(share), "lang").where(draw < F.col("share"))  # one row per language

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = batch.column("k").to_numpy()
            data = [_bytes(t) for t in batch.column("text").to_pylist()]
            for k, some in _shares(of.tolist(), data):
                gram, n = np.unique(_grams(some), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), k, dtype=np.int32)), pa.array(gram), pa.array(n.astype(np.int64))], names=["k", "gram", "n"])

    counts = sample.select("text", "k").mapInArrow(lean(count), "k int, gram long, n long").groupBy("k", "gram").agg(F.sum("n").alias("n"))
    table = counts.toArrow()
    rows = np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("k", "gram", "n")], axis=1)
    return _pack(langs, rows[np.lexsort((rows[:, 1], rows[:, 0]))])


def _pack(langs: list[str], rows: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez_compressed(out, langs=np.array(langs, dtype=object).astype("U"), rows=rows)
    return out.getvalue()


class Coder:
    """Code length tables of all languages, from packed counts."""

    def __init__(self, packed: bytes):
        held = np.load(io.BytesIO(packed))
        self.langs = [str(x) for x in held["langs"]]
        rows = held["rows"]
        per = [(rows[rows[:, 0] == k][:, 1], rows[rows[:, 0] == k][:, 2]) for k in range(len(self.langs))]
        two = np.unique(np.concatenate([g >> 8 & 0xFFFF for g, _ in per] or [np.zeros(0, dtype=np.int64)]))
        three = np.zeros(0, dtype=np.int64)
        for gram, n in per:
            context, at = np.unique(gram >> 8, return_inverse=True)
            three = np.union1d(three, context[np.bincount(at, weights=n) >= MIN_CONTEXT])
        three = three.astype(np.int64)
        # rows of the tables: 256 contexts of one byte, then those of two, then those of three
        kind = np.uint16 if 256 + len(two) + len(three) <= 65536 else np.int32
        self.row = np.tile(np.arange(256, dtype=kind), 65536).reshape(256, 256, 256)
        self.row[:, two >> 8, two & 255] = (256 + np.arange(len(two))).astype(kind)
        self.row = self.row.reshape(-1)
        self.row[three] = (256 + len(two) + np.arange(len(three))).astype(kind)
        self.tables = []
        for gram, n in per:
            byte = gram & 255
            cost0 = self._mixed(np.zeros(len(gram), dtype=np.int64), byte, n, 1, np.full((1, 256), 8.0))
            cost1 = self._mixed(gram >> 8 & 255, byte, n, 256, np.repeat(cost0, 256, axis=0))
            at = np.searchsorted(two, gram >> 8 & 0xFFFF)
            cost2 = self._mixed(at, byte, n, len(two), cost1[two & 255])
            table = np.empty((256 + len(two) + len(three), 256), dtype=np.uint16)
            table[:256], table[256 : 256 + len(two)] = self._units(cost1), self._units(cost2)
            for k in range(0, len(three), ROWS_AT_ONCE):  # grams ascend, so a slice of contexts is a slice of grams
                contexts = three[k : k + ROWS_AT_ONCE]
                s, e = np.searchsorted(gram >> 8, [contexts[0], contexts[-1] + 1])
                at = np.searchsorted(contexts, gram[s:e] >> 8)
                seen = contexts[at] == gram[s:e] >> 8
                cost3 = self._mixed(at[seen], byte[s:e][seen], n[s:e][seen], len(contexts), cost2[np.searchsorted(two, contexts & 0xFFFF)])
                table[256 + len(two) + k : 256 + len(two) + k + len(contexts)] = self._units(cost3)
            self.tables.append(table.reshape(-1))

    @staticmethod
    def _units(bits: np.ndarray) -> np.ndarray:
        return np.minimum(np.rint(bits * UNIT), 65535).astype(np.uint16)

    @staticmethod
    def _mixed(context: np.ndarray, byte: np.ndarray, n: np.ndarray, size: int, below: np.ndarray) -> np.ndarray:
        """Bits of each byte in each of size contexts; below: bits in the next shorter context."""
        counts = np.bincount(context * 256 + byte, weights=n, minlength=size * 256).reshape(size, 256)
        total, kinds = counts.sum(axis=1, keepdims=True), (counts > 0).sum(axis=1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            own = np.log2(total + kinds) - np.log2(counts)
            escape = np.log2(total + kinds) - np.log2(kinds)
        return np.where(total == 0, below, np.where(counts > 0, own, below + np.where(total == 0, 0, escape)))

    def lengths(self, data: list[bytes]) -> np.ndarray:
        """Code length of each text under each language, in 1/UNIT bits."""
        found = np.zeros((len(data), len(self.tables)), dtype=np.int64)
        parts: list[bytes] = []
        of: list[int] = []
        size = 0
        for k, d in enumerate(data):
            for start in range(0, len(d), STEP):
                parts.append((PAD if not start else d[start - ORDER : start]) + d[start : start + STEP])
                of.append(k)
                size += len(parts[-1])
                if size >= STEP:
                    self._add(found, parts, of)
                    parts, of, size = [], [], 0
        if parts:
            self._add(found, parts, of)
        return found

    def _add(self, found: np.ndarray, parts: list[bytes], of: list[int]) -> None:
        ends = np.cumsum([len(p) for p in parts])
        context, byte = _context_and_byte(np.frombuffer(b"".join(parts), dtype=np.uint8))
        where = self.row[context].astype(np.int32) * 256 + byte
        starts = np.concatenate([[0], ends[:-1]])
        stops = ends - ORDER  # the last positions code the next part's first bytes and belong to none
        cuts = np.stack([starts, stops], axis=1).ravel()
        cuts, drop = (cuts[:-1], True) if cuts[-1] >= len(where) else (cuts, False)
        for k, table in enumerate(self.tables):
            sums = np.add.reduceat(table[where], cuts, dtype=np.int64)
            np.add.at(found[:, k], of, np.append(sums, 0)[::2][: len(of)] if drop else sums[::2])


def coder(packed: bytes) -> Coder:
    return held(("language tables", packed), lambda: Coder(packed))


def predict(docs: DataFrame, packed: bytes) -> DataFrame:
    """(doc_id, lang_pred, score, bits_per_byte) per row of docs, from whole texts alone.

    lang_pred is the language of the shortest code, ties to the first by name; score is its share of
    the languages' total probability. A text that is null or has no letter is `und` with score 0 and
    null bits_per_byte; so is every text if nothing was learned. Repeated rows are returned as often
    as they occur; other columns of docs are ignored; an empty table gives an empty result.
    """
    model = docs.sparkSession.sparkContext.broadcast(packed)  # bounded by TRAIN_BYTES per language

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred, score, rate, said = _told(coder(model.value), batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pred, type=pa.string()), pa.array(score), pa.array(rate, mask=~said)], names=["doc_id", "lang_pred", "score", "bits_per_byte"])

    return texts(docs).mapInArrow(lean(run, keeps=True), "doc_id long, lang_pred string, score double, bits_per_byte double")


def _told(code: Coder, batch: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Language, score and bits per byte of each text, and whether anything was said of it."""
    data = [_bytes(t) if t and LETTER.search(t) else b"" for t in batch]
    said = np.array([bool(d) for d in data], dtype=bool) & bool(code.langs)
    bits = code.lengths(data) / UNIT if code.langs else np.zeros((len(data), 1))
    best = bits.argmin(axis=1)
    score = 1 / np.exp2(np.minimum(0, bits.min(axis=1)[:, None] - bits)).sum(axis=1)
    pred = [code.langs[b] if s else UNDETERMINED for b, s in zip(best.tolist(), said.tolist(), strict=True)]
    rate = bits.min(axis=1) / np.maximum(1, [len(d) for d in data])
    return pred, np.where(said, score, 0.0), rate, said


def identified(docs: DataFrame, packed: bytes, min_score: float, max_bits: float = MAX_BITS) -> DataFrame:
    """The rows of docs, all columns, that have a language; each row by its own text, without a shuffle.

    The best language must hold min_score of the total probability, and its code must take at most
    max_bits a byte: a longer one than the bytes themselves means that the text is in no language learned.
    """
    prepare(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(packed)

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, score, rate, said = _told(coder(model.value), batch.column("text").to_pylist())
            yield batch.filter(pa.array(said & (score >= min_score) & (rate <= max_bits)))

    return docs.mapInArrow(lean(keep, keeps=True), docs.schema)


def identify(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Languages of all rows of docs, learned from its labelled rows that are not held out."""
    packed = train(docs.where(~held_out()))
    return predict(docs, packed).withColumn("held_out", held_out())
