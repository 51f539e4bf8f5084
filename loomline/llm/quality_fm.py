"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

score = sigmoid(b + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j). The pair sum is
half the sum over factors of (sum v_if x_i)^2 - sum (v_if x_i)^2, so a text is scored in
time linear in its features.
"""

from __future__ import annotations

import io
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import held_out, if_small, lean, prepare
from loomline.llm.ngram_llr import WORD, hasher

WORD_BINS, FACTORS = 1 << 13, 8
#: Labelled documents the machine is fitted on, about, chosen by a hash of doc_id; the model's size depends on none of the tables.
TRAIN_ROWS = 6000
EPOCHS, BATCH, RATE, DECAY, SEED = 12, 128, 0.05, 1e-5, 20
KEEP = 0.7
#: Share of the text's bytes that belongs to each class.
BYTE_CLASSES = [bytes(range(65, 91)), bytes(range(48, 58)), b"#*$%&<>", b"|", b"!", b".,;:?'\"()-", b"\n", bytes(range(128, 256))]
STRUCTURE = 4 + len(BYTE_CLASSES) + 2


def _class_table() -> np.ndarray:
    table = np.zeros((256, len(BYTE_CLASSES)))
    for k, members in enumerate(BYTE_CLASSES):
        table[list(members), k] = 1
    return table


CLASS_TABLE = _class_table()


def features(texts: list[str | None], n_chars: list[int | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, word bin, value) entries of a batch of texts, sorted by row, and a row of structure values for each text.

    Word values are counts per bin, scaled to length one. n_chars is the metadata; where it is null,
    the text's own length stands in.
    """
    rows, bins = [], []
    structure = np.zeros((len(texts), STRUCTURE))
    for k, (text, told) in enumerate(zip(texts, n_chars, strict=True)):
        text = text or ""
        words = WORD.findall(text)
        found = (hasher()(words) % np.uint64(WORD_BINS)).astype(np.int64)
        rows.append(np.full(len(found), k))
        bins.append(found)
        n = max(1, len(words))
        by_byte = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8), minlength=256)
        lines = text.split("\n")
        chars = len(text) if told is None or told < 0 else told
        structure[k, :4] = np.log1p(len(words)), np.log1p(chars), len(text) / n, len(set(lines)) / len(lines)
        structure[k, 4:-2] = by_byte @ CLASS_TABLE / max(1, by_byte.sum())
        structure[k, -2:] = len(set(words)) / n, np.log1p(len(words) / max(1, len(set(words))))
    code, count = np.unique(np.concatenate(rows) * WORD_BINS + np.concatenate(bins), return_counts=True) if rows else (np.zeros(0, dtype=np.int64), np.zeros(0))
    row = code // WORD_BINS
    norm = np.sqrt(np.bincount(row, weights=count.astype(float) ** 2, minlength=len(texts)))
    return row, code % WORD_BINS, count / norm[row], structure


class Machine:
    """Weights, factors and the scale of the structure values."""

    def __init__(self, w: np.ndarray, v: np.ndarray, mean: np.ndarray, std: np.ndarray, bias: float):
        self.w, self.v, self.mean, self.std, self.bias = w, v, mean, std, bias

    def entries(self, row: np.ndarray, bin_: np.ndarray, x: np.ndarray, structure: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word and structure entries together, by row; each row has STRUCTURE entries at least."""
        scaled = np.clip((structure - self.mean) / self.std, -5, 5)
        n = len(structure)
        row = np.concatenate([row, np.repeat(np.arange(n), STRUCTURE)])
        bin_ = np.concatenate([bin_, np.tile(WORD_BINS + np.arange(STRUCTURE), n)])
        x = np.concatenate([x, scaled.ravel()])
        order = np.argsort(row, kind="stable")
        return row[order], bin_[order], x[order]

    def margins(self, row: np.ndarray, bin_: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Margin of each row, the factor sums of each row, and v x of each entry."""
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        vx = self.v[bin_] * x[:, None]
        sums = np.add.reduceat(vx, starts, axis=0)
        squares = np.add.reduceat(vx * vx, starts, axis=0)
        linear = np.add.reduceat(self.w[bin_] * x, starts)
        return self.bias + linear + 0.5 * (sums * sums - squares).sum(axis=1), sums, vx

    def score(self, texts: list[str | None], n_chars: list[int | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        margin = self.margins(*self.entries(*features(texts, n_chars)))[0]
        return 1 / (1 + np.exp(-np.clip(margin, -40, 40)))

    def pack(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, w=self.w, v=self.v, mean=self.mean, std=self.std, bias=self.bias)
        return out.getvalue()

    @staticmethod
    def unpack(packed: bytes) -> Machine:
        held = np.load(io.BytesIO(packed))
        return Machine(held["w"], held["v"], held["mean"], held["std"], float(held["bias"]))


def fit(row: np.ndarray, bin_: np.ndarray, x: np.ndarray, structure: np.ndarray, label: np.ndarray) -> Machine:
    """A machine for the labelled rows, by AdaGrad on the log loss in a fixed order."""
    rng = np.random.default_rng(SEED)
    size = WORD_BINS + STRUCTURE
    mean, std = (structure.mean(axis=0), structure.std(axis=0)) if len(structure) else (np.zeros(STRUCTURE), np.zeros(STRUCTURE))
    share = (label.sum() + 1) / (len(label) + 2)
    m = Machine(np.zeros(size), rng.normal(0, 0.02, (size, FACTORS)), mean, np.where(std > 1e-9, std, 1.0), float(np.log(share / (1 - share))))
    if not len(label) or label.min() == label.max():
        m.v[:] = 0
        return m
    row, bin_, x = m.entries(row, bin_, x, structure)
    starts = np.searchsorted(row, np.arange(len(label) + 1))
    gw, gv, gb = np.full(size, 1e-3), np.full((size, FACTORS), 1e-3), 1e-3
    for _ in range(EPOCHS):
        order = rng.permutation(len(label))
        for k in range(0, len(order), BATCH):
            picked = order[k : k + BATCH]
            counts = starts[picked + 1] - starts[picked]
            at = np.repeat(starts[picked] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
            r, b, xs = np.repeat(np.arange(len(picked)), counts), bin_[at], x[at]
            margin, sums, vx = m.margins(r, b, xs)
            slope = (1 / (1 + np.exp(-np.clip(margin, -40, 40))) - label[picked]) / len(picked)
            used, where = np.unique(b, return_inverse=True)
            dw = np.bincount(where, weights=slope[r] * xs, minlength=len(used)) + DECAY * m.w[used]
            dv = np.zeros((len(used), FACTORS))
            np.add.at(dv, where, (slope[r] * xs)[:, None] * (sums[r] - vx))
            dv += DECAY * m.v[used]
            gw[used] += dw * dw
            gv[used] += dv * dv
            gb += slope.sum() ** 2
            m.w[used] -= RATE * dw / np.sqrt(gw[used])
            m.v[used] -= RATE * dv / np.sqrt(gv[used])
            m.bias -= RATE * slope.sum() / np.sqrt(gb)
    return m


def _inputs(docs: DataFrame, *more: str) -> DataFrame:
    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("n_chars").cast("long").alias("n_chars"), *more)


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> bytes:
    """A packed machine for labels(doc_id, quality), learned from rows that are not held out.

    About train_rows labelled documents are drawn by a hash of doc_id. Their features are made where
    their texts are; one task fits the machine on that bounded sample.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)")
    known = known.where(~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    draw = F.pmod(F.xxhash64(F.lit("fm"), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = if_small(known.where(draw < min(1.0, train_rows / max(1, known.count()))), "fm-sample")
    sample = _inputs(docs).join(chosen, "doc_id")

    def extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, bin_, x, structure = features(batch.column("text").to_pylist(), batch.column("n_chars").to_pylist())
            ends = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v)) for v in (bin_.astype(np.int32), x)]
            flat = pa.ListArray.from_arrays(pa.array((np.arange(batch.num_rows + 1) * STRUCTURE).astype(np.int32)), pa.array(structure.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), *lists, flat], names=["doc_id", "quality", "bins", "xs", "structure"])

    def learn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [x for b in batches for x in zip(*(b.column(c).to_pylist() for c in ("doc_id", "quality", "bins", "xs", "structure")), strict=True)]
        held.sort(key=lambda r: (r[0], r[1], r[4], r[2]))
        row = np.repeat(np.arange(len(held)), [len(r[2]) for r in held])
        flat = [np.array([y for r in held for y in r[k]], dtype=t) for k, t in ((2, np.int64), (3, float))]
        machine = fit(row, *flat, np.array([r[4] for r in held], dtype=float).reshape(-1, STRUCTURE), np.array([r[1] for r in held], dtype=float))
        yield pa.RecordBatch.from_arrays([pa.array([machine.pack()], type=pa.binary())], names=["machine"])

    drawn = sample.mapInArrow(lean(extract, keeps=True), "doc_id long, quality int, bins array<int>, xs array<double>, structure array<double>")
    return bytes(drawn.repartition(1).mapInArrow(lean(learn), "machine binary").first()["machine"])


def score(docs: DataFrame, packed: bytes) -> DataFrame:
    """(doc_id, score) per row of docs(doc_id, text, n_chars), over whole texts.

    A null or empty text is scored by its structure alone, a null n_chars is the text's length.
    labels, lang, source and doc_id play no part. Repeated rows are returned as often as they occur;
    other columns of docs are ignored; an empty table gives an empty result.
    """
    model = docs.sparkSession.sparkContext.broadcast(packed)  # size fixed by WORD_BINS and FACTORS

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Machine.unpack(model.value)
        for batch in batches:
            found = machine.score(batch.column("text").to_pylist(), batch.column("n_chars").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, type=pa.float64())], names=["doc_id", "score"])

    return _inputs(docs).mapInArrow(lean(run, keeps=True), "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of docs: predicted is 1 from a score of KEEP on."""
    found = score(docs, train(docs, labels))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= KEEP).cast("int").alias("predicted"))
