"""Token ids in files coded by a static range asymmetric numeral system (rANS).

A file row is a segment: whole documents, one frequency table shared by the segment's blocks, and
blocks that each code up to BLOCK ids in interleaved lanes. A block starts from its own checkpoint
(the lanes' states) and carries a checksum of its ids, so a block decodes without the others.
"""

from __future__ import annotations

import codecs
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from loomline.llm.bpe_codec import splitter
from loomline.llm.common import Remembered, held, lean, texts, written

SCALE_BITS, LOW_BITS, WORD_BITS = 20, 31, 32
LANES, BLOCK, SEGMENT = 2048, 1 << 18, 1 << 21
END_ID = 2
DAMAGED = "a block of token ids does not match its checksum"
#: Words and pieces that a worker remembers in each of two generations.
REMEMBERED = 200_000
#: The library's byte level: bytes that are no visible character, soft hyphen included, are named by the code points from 256 on.
UNSEEN = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD)]
BYTE_NAMES = "".join(chr(256 + UNSEEN.index(b) if b in UNSEEN else b) for b in range(256))
#: Pieces of a text as the tokenizer's own pre-tokenizer cuts them, white space dropped (fixed by its file).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Texts of these characters only are normalised by lower-casing alone, and their pieces are independent.
SIMPLE = re.compile("[\t\n\r\x20-\x7e\xa1-įı-ɏ‐-‧€]*")


# --- the code ---------------------------------------------------------------------------------


def frequency_table(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids in use, ascending, and their frequencies, at least 1 each and 2**SCALE_BITS in all."""
    symbols, counts = np.unique(ids, return_counts=True)
    whole = 1 << SCALE_BITS
    freqs = np.maximum(1, counts * (whole - len(symbols)) // counts.sum())
    freqs[np.argmax(freqs)] += whole - freqs.sum()
    return symbols, freqs


def encode_block(which: np.ndarray, freqs: np.ndarray) -> tuple[bytes, bytes]:
    """States after coding and the words, for indexes into the frequency table."""
    f_all, n = freqs.astype(np.uint64), len(which)
    starts = (np.cumsum(freqs) - freqs).astype(np.uint64)
    x = np.full(LANES, 1 << LOW_BITS, dtype=np.uint64)
    out = []
    limit = f_all << np.uint64(LOW_BITS - SCALE_BITS + WORD_BITS)
    for t in range((n - 1) // LANES, -1, -1):
        s = which[t * LANES : (t + 1) * LANES]
        lane, f = x[: len(s)], f_all[s]
        full = lane >= limit[s]
        if full.any():
            out.append((lane[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
            lane[full] >>= np.uint64(WORD_BITS)
        q = lane // f
        x[: len(s)] = (q << np.uint64(SCALE_BITS)) + (lane - q * f) + starts[s]
    words = np.concatenate(out[::-1]) if out else np.zeros(0, dtype="<u4")
    return x.astype("<u8").tobytes(), words.tobytes()


def decode_block(states: bytes, words: bytes, n: int, freqs: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """The n indexes that encode_block coded; slots names the index of each of the 2**SCALE_BITS slots."""
    f_all = freqs.astype(np.uint64)
    starts = (np.cumsum(freqs) - freqs).astype(np.uint64)
    x = np.frombuffer(states, dtype="<u8").astype(np.uint64)
    w = np.frombuffer(words, dtype="<u4").astype(np.uint64)
    found, at, mask = np.empty(n, dtype=np.int64), 0, np.uint64((1 << SCALE_BITS) - 1)
    for t in range(0, n, LANES):
        lane = x[: min(LANES, n - t)]
        slot = lane & mask
        s = slots[slot.astype(np.int64)]
        found[t : t + len(lane)] = s
        lane = f_all[s] * (lane >> np.uint64(SCALE_BITS)) + slot - starts[s]
        low = np.flatnonzero(lane < np.uint64(1 << LOW_BITS))
        if at + len(low) > len(w):
            raise ValueError(DAMAGED)
        if len(low):
            lane[low] = lane[low] << np.uint64(WORD_BITS) | w[at : at + len(low)]
            at += len(low)
        x[: len(lane)] = lane
    return found


# --- tokens -----------------------------------------------------------------------------------


class Encoder:
    """Packed ids of whole texts by the library; words and pieces that recur are encoded once and remembered.

    A word, between white space, is cut into pieces, and a piece goes to the library's model on its
    own, its bytes named as the library's byte level does. A piece as a word is cut into itself, so
    both are remembered as one, and a word of letters alone is its piece. Texts that hold an added
    token, in any case, go to the library whole.
    """

    def __init__(self, file: str, special_as_text: bool = True):
        self.library = Tokenizer.from_str(file)
        if special_as_text:
            self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        self.tokenize, self.split = self.library.model.tokenize, splitter(PIECES)
        self.words = Remembered(REMEMBERED)
        added = [re.escape(t.content) for t in self.library.get_added_tokens_decoder().values() if t.content]
        self.added = re.compile("|".join(added) or r"(?!)", re.IGNORECASE)

    def __call__(self, batch: list[str | None]) -> list[bytes]:
        simple = [bool(t) and SIMPLE.fullmatch(t) is not None and self.added.search(t) is None for t in batch]
        words = [t.lower().split() if s else [] for t, s in zip(batch, simple, strict=True)]
        new = self.words.missing(chain.from_iterable(words))
        cut = {w: self.cut(w) for w in new if not w.isalpha()}
        known, tokenize = self.words.young, self.tokenize
        pieces = new.difference(cut)
        pieces.update(p for p in chain.from_iterable(cut.values()) if p not in known)
        for piece in pieces:
            named = piece if piece.isascii() else codecs.charmap_decode(piece.encode(), "strict", BYTE_NAMES)[0]
            known[piece] = array("I", [t.id for t in tokenize(named)]).tobytes()
        of_word = known.__getitem__
        known.update({w: b"".join(map(of_word, p)) for w, p in cut.items()})
        return [b"".join(map(of_word, w)) if s or not t else self.whole(t) for t, s, w in zip(batch, simple, words, strict=True)]

    def cut(self, word: str) -> list[str] | tuple[str, ...]:
        """The pieces of a word that isn't letters alone: letters and one mark after them, or what the pattern finds."""
        body, mark = word[:-1], word[-1]
        return (body, mark) if body.isalpha() and not mark.isalnum() else self.split(word)

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def _encoder(file: str, special_as_text: bool) -> Encoder:
    return held(("token encoder", file, special_as_text), lambda: Encoder(file, special_as_text))


SEGMENT_ROW = "part int, segment int, n_tokens long, doc_ids array<long>, lengths array<int>, symbols binary, freqs binary, blocks array<struct<n:int,crc:long,states:binary,words:binary>>"


def _segment(part: int, number: int, doc_ids: list, docs: list[bytes]) -> pa.RecordBatch:
    ids = np.frombuffer(b"".join(docs), dtype="<u4")
    symbols, freqs = frequency_table(ids)
    number_of = np.zeros(int(symbols[-1]) + 1, dtype=np.int64)
    number_of[symbols] = np.arange(len(symbols))
    blocks = []
    for k in range(0, len(ids), BLOCK):
        part_ids = ids[k : k + BLOCK]
        states, words = encode_block(number_of[part_ids], freqs)
        blocks.append({"n": len(part_ids), "crc": zlib.crc32(part_ids.tobytes()), "states": states, "words": words})
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.list_(pa.struct([("n", pa.int32()), ("crc", pa.int64()), ("states", pa.binary()), ("words", pa.binary())]))]
    row = [part, number, len(ids), doc_ids, [len(d) // 4 for d in docs], symbols.astype("<u4").tobytes(), freqs.astype("<u4").tobytes(), blocks]
    return pa.RecordBatch.from_arrays([pa.array([v], type=k) for v, k in zip(row, kinds, strict=True)], names=["part", "segment", "n_tokens", "doc_ids", "lengths", "symbols", "freqs", "blocks"])


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, special_as_text: bool = True) -> DataFrame:
    """Segments of all rows of docs(doc_id, text) in ascending doc_id order, written to the shared folder and read back.

    Each document is its ids and end_id. A null or empty text is end_id alone; a null doc_id comes
    first; rows with equal doc_id are in the order of a hash of their texts; other columns of docs
    are ignored. special_as_text encodes the strings of special tokens as ordinary text; without it
    they are their ids, as by the library's default. Rows are dealt out by ranges of doc_id, so part numbers ascend with it.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as held:
        file = spark.sparkContext.broadcast(held.read())  # one tokenizer file
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, number = _encoder(file.value, special_as_text), TaskContext.get().partitionId(), 0
        doc_ids, held, size = [], [], 0
        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder(batch.column("text").to_pylist()), strict=True):
                doc_ids.append(doc_id)
                held.append(ids + end)
                size += len(held[-1]) // 4
                if size >= SEGMENT:
                    yield _segment(part, number, doc_ids, held)
                    doc_ids, held, size, number = [], [], 0, number + 1
        if held:
            yield _segment(part, number, doc_ids, held)

    ordered = texts(docs).withColumn("th", F.xxhash64("text"))
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = ordered.repartitionByRange(width, "doc_id", "th").sortWithinPartitions("doc_id", "th").select("doc_id", "text")
    return written(ordered.mapInArrow(lean(run, keeps=True), SEGMENT_ROW), "rans-tokens")


def read_tokens(segments: DataFrame) -> DataFrame:
    """(doc_id, start, ids) of each document of the segments: ids as little-endian unsigned 32-bit integers.

    start is the number of ids of all documents before it. A block whose checksum fails raises.
    """
    spark = segments.sparkSession
    sums = {r["part"]: r["n"] for r in segments.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}  # one row per file
    before, rows = 0, []
    for part in sorted(sums):
        rows.append((part, before))
        before += sums[part]
    parts = spark.createDataFrame(rows, "part int, part_start long")
    earlier = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    starts = segments.select("part", "segment", "n_tokens").join(F.broadcast(parts), "part")
    starts = starts.select("part", "segment", (F.col("part_start") + F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0))).alias("start"))
    placed = segments.join(F.broadcast(starts), ["part", "segment"])  # a row per segment of 2 million ids

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in ("start", "doc_ids", "lengths", "symbols", "freqs", "blocks")}
                symbols, freqs = (np.frombuffer(row[c], dtype="<u4") for c in ("symbols", "freqs"))
                freqs = freqs.astype(np.int64)
                slots = np.repeat(np.arange(len(freqs)), freqs)
                parts = []
                for b in row["blocks"]:
                    ids = symbols[decode_block(b["states"], b["words"], b["n"], freqs, slots)].astype("<u4")
                    if zlib.crc32(ids.tobytes()) != b["crc"]:
                        raise ValueError(DAMAGED)
                    parts.append(ids)
                flat = np.concatenate(parts).tobytes()
                lengths = np.array(row["lengths"], dtype=np.int64)
                ends = np.cumsum(lengths)
                cut = [flat[4 * s : 4 * e] for s, e in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], type=pa.int64()), pa.array(row["start"] + ends - lengths), pa.array(cut, type=pa.binary())], names=["doc_id", "start", "ids"])

    return placed.mapInArrow(lean(run), "doc_id long, start long, ids binary")
