"""Byte-level BPE encoding by a segment tree of pair ranks, and decoding.

The pattern splits a text into pieces; a piece's leaves are its byte positions, each with the rank
of the pair that starts there (and the position, so that ties go to the left). The root of the tree
is the leftmost pair of lowest rank. A merge writes three leaves (the merged token, the live
neighbour before it, the position that died) and climbs from each, in logarithmic time. Trees of
many short pieces of like length are merged side by side as rows of one array; long pieces get a
tree of their own. A piece that is a token as a whole is that token.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import Remembered, held, lean, texts

#: No pair: above every rank with its position.
NONE = np.int32(2**31 - 1)
#: Pieces of more bytes get a tree of their own; a position in a row takes POSITION_BITS bits beside the rank.
ROW_BYTES, POSITION_BITS = 256, 8
#: Trees side by side hold about so many leaves.
ROW_LEAVES = 1 << 17
#: Encoded pieces a worker remembers, in each of two generations.
REMEMBERED = 60_000
#: Code points of texts that are split into pieces at once, about.
SPLIT_AT_ONCE = 1 << 19


class Vocabulary:
    """Ranks by token bytes, and the merged token of every pair of tokens as sorted arrays."""

    def __init__(self, file: bytes):
        ranks = _ranks_of(file)
        if max(ranks.values()) >= NONE >> POSITION_BITS:
            raise ValueError("too many tokens for a row's 32-bit leaves")
        self.single = {token: np.array([rank], dtype="<i4").tobytes() for token, rank in ranks.items()}
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        codes, merged = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    codes.append(left << 32 | right)
                    merged.append(rank)
        order = np.argsort(np.array(codes, dtype=np.int64))
        self.codes = np.append(np.array(codes, dtype=np.int64)[order], 2**62)
        self.merged = np.append(np.array(merged, dtype=np.int32)[order], NONE)
        self.one_code, self.one_merged = memoryview(self.codes), memoryview(self.merged)
        self.tokens = _token_array(ranks)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        code = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.codes, code)
        return np.where(self.codes[at] == code, self.merged[at], NONE)

    def pair_rank(self, left: int, right: int) -> int | None:
        code = left << 32 | right
        at = bisect_left(self.one_code, code)
        return self.one_merged[at] if self.one_code[at] == code else None


def _ranks_of(file: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file.splitlines() if line.strip())}


def _token_array(ranks: dict[bytes, int]) -> pa.Array:
    """Bytes of the token of each rank, all that decoding needs."""
    tokens: list[bytes | None] = [None] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return pa.array(tokens, type=pa.binary())


def vocabulary(file: bytes) -> Vocabulary:
    return held(("byte ranks", file), lambda: Vocabulary(file))


def _merge_rows(vocab: Vocabulary, pieces: list[bytes]) -> list[bytes]:
    """Ids of each piece as packed int32; every piece has at most ROW_BYTES bytes, and at least two."""
    lengths = np.fromiter(map(len, pieces), dtype=np.int32, count=len(pieces))
    rows, width = np.arange(len(pieces), dtype=np.int32), int(lengths.max())
    inside = np.arange(width)[None, :] < lengths[:, None]
    ids = np.zeros((len(pieces), width + 1), dtype=np.int32)
    ids[:, :width][inside] = vocab.bytes[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
    after = np.minimum(np.arange(1, width + 2, dtype=np.int32)[None, :], lengths[:, None])  # position of the next live token; the length if none
    before = np.repeat(np.arange(-1, width, dtype=np.int32)[None, :], len(pieces), axis=0)
    leaves = 1 << (width - 1).bit_length()
    tree = np.full((len(pieces), 2 * leaves), NONE)

    def joined(rank: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.where(rank < NONE, rank << POSITION_BITS | at, NONE).astype(np.int32)

    starts = np.arange(width - 1)[None, :] + 1 < lengths[:, None]
    r, c = np.nonzero(starts)
    tree[r, leaves + c] = joined(vocab.pair_ranks(ids[r, c], ids[r, c + 1]), c)
    level = leaves
    while level > 1:
        tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
        level //= 2

    def write(which: np.ndarray, at: np.ndarray, value: np.ndarray | np.int32) -> None:
        node = leaves + at
        tree[which, node] = value
        for _ in range(leaves.bit_length() - 1):
            node = node >> 1
            tree[which, node] = np.minimum(tree[which, 2 * node], tree[which, 2 * node + 1])

    def leaf(which: np.ndarray, at: np.ndarray, following: np.ndarray) -> np.ndarray:
        rank = np.where(following < lengths[which], vocab.pair_ranks(ids[which, at], ids[which, following]), NONE)
        return joined(rank, at)

    live = rows[tree[:, 1] < NONE]
    while len(live):
        best = tree[live, 1]
        at = best & ((1 << POSITION_BITS) - 1)
        ids[live, at] = best >> POSITION_BITS
        gone = after[live, at]
        following = after[live, gone]
        after[live, at] = following
        before[live, following] = at
        inside[live, gone] = False
        write(live, gone, NONE)
        write(live, at, leaf(live, at, following))
        previous = before[live, at]
        has = previous >= 0
        if has.any():
            write(live[has], previous[has], leaf(live[has], previous[has], at[has]))
        live = live[tree[live, 1] < NONE]
    flat = ids[:, :width][inside].astype("<i4").tobytes()
    ends = np.cumsum(inside.sum(axis=1) * 4).tolist()
    return [flat[s:e] for s, e in zip([0, *ends], ends, strict=False)]


def _merge_long(vocab: Vocabulary, piece: bytes) -> bytes:
    """Ids of one piece as packed int32."""
    n, none = len(piece), 2**62
    ids = vocab.bytes[np.frombuffer(piece, dtype=np.uint8)].tolist()
    after, before = list(range(1, n + 1)), list(range(-1, n))
    leaves = 1 << (n - 1).bit_length()
    tree = [none] * (2 * leaves)

    def leaf(at: int) -> int:
        following = after[at]
        rank = vocab.pair_rank(ids[at], ids[following]) if following < n else None
        return none if rank is None else rank << 32 | at

    for at in range(n):
        tree[leaves + at] = leaf(at)
    for node in range(leaves - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])

    def write(at: int, value: int) -> None:
        node = leaves + at
        tree[node] = value
        while node > 1:
            node >>= 1
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

    while tree[1] < none:
        at = tree[1] & 0xFFFFFFFF
        ids[at] = tree[1] >> 32
        gone = after[at]
        after[at] = after[gone]
        before[after[at]] = at
        write(gone, none)
        write(at, leaf(at))
        if before[at] >= 0:
            write(before[at], leaf(before[at]))
    found, at = [], 0
    while at < n:
        found.append(ids[at])
        at = after[at]
    return np.array(found, dtype="<i4").tobytes()


def encode_pieces(vocab: Vocabulary, pieces: list[bytes]) -> list[bytes]:
    """Packed int32 ids of each piece, none of which is empty."""
    found = list(map(vocab.single.get, pieces))
    left = [k for k, ids in enumerate(found) if ids is None]
    lengths = np.fromiter((len(pieces[k]) for k in left), dtype=np.int64, count=len(left))
    order = np.argsort(lengths, kind="stable")  # rows side by side are of like length
    lengths, left = lengths[order], np.array(left, dtype=np.int64)[order].tolist()
    at, rows_end = 0, int(np.searchsorted(lengths, ROW_BYTES, side="right"))
    while at < rows_end:
        width = 1 << (int(lengths[at]) - 1).bit_length()
        end = min(at + max(1, ROW_LEAVES // width), int(np.searchsorted(lengths, width, side="right")), rows_end)
        some = left[at:end]
        for k, ids in zip(some, _merge_rows(vocab, [pieces[k] for k in some]), strict=True):
            found[k] = ids
        at = end
    for k in left[rows_end:]:
        found[k] = _merge_long(vocab, pieces[k])
    return found


#: Code points of the first Unicode blocks, of general punctuation and of the euro sign: a text of these alone is split by explicit ranges, which is faster.
NARROW = re.compile("[\\x00-\u024f\u2010-\u2027\u20ac]*")


def _ranges(inside: str) -> str:
    """The code points below U+0250 that inside matches, as ranges of a character class."""
    same = regex.compile(inside)
    points = [c for c in range(0x250) if same.match(chr(c))]
    starts = [c for c in points if c - 1 not in points]
    return "".join(f"\\u{s:04x}-\\u{next(c for c in range(s, 0x251) if c + 1 not in points):04x}" for s in starts)


@lru_cache(maxsize=8)
def splitter(pattern: str) -> Callable[[str], list[str]]:
    r"""A function from a text to its pieces; \s and \S mean Unicode white space, as for the ranks' own library."""
    general = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
    explicit, in_class = "", False
    for part in re.findall(r"\\p\{\w+\}|\\.|.", pattern, re.DOTALL):
        if part in (r"\s", r"\S") or part.startswith(r"\p"):
            ranges = _ranges(r"\p{White_Space}" if part.lower() == r"\s" else part)
            part = ranges if in_class and part != r"\S" else f"[{'^' * (part == chr(92) + 'S')}{ranges}]"
        in_class = part == "[" or in_class and part != "]"
        explicit += part
    narrow = re.compile(explicit).findall
    return lambda text: narrow(text) if NARROW.fullmatch(text) else general(text)


def broadcast_ranks(docs: DataFrame, ranks_path: str) -> Broadcast:
    with open(ranks_path, "rb") as file:
        return docs.sparkSession.sparkContext.broadcast(file.read())  # one vocabulary file: its size doesn't depend on the data


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>, n_tokens long) per row of docs, over whole texts.

    A null or empty text has no ids. Rows with equal or null doc_id are encoded each on their own;
    other columns of docs are ignored; an empty table gives an empty result. A piece may be as long
    as the text: its merges take time n log n.
    """
    file = broadcast_ranks(docs, ranks_path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, packed in _encoded(batches, Encoder(vocabulary(file.value), splitter(pattern))):
            lists, counts = _ids_column(packed)
            yield pa.RecordBatch.from_arrays([doc_ids, lists, counts], names=["doc_id", "ids", "n_tokens"])

    return texts(docs).mapInArrow(lean(run, keeps=True), "doc_id long, ids array<int>, n_tokens long")


class Encoder:
    """Packed int32 ids of texts; pieces that recur are encoded once and remembered."""

    def __init__(self, vocab: Vocabulary, split: Callable[[str], list[str]]):
        self.vocab, self.split, self.known = vocab, split, Remembered(REMEMBERED)

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        done, some, size = [], [], 0
        for text in texts:
            some.append(text)
            size += len(text or "")
            if size >= SPLIT_AT_ONCE:
                done += self._encoded(some)
                some, size = [], 0
        return done + self._encoded(some)

    def _encoded(self, texts: list[str | None]) -> list[bytes]:
        pieces = [self.split(text) if text else [] for text in texts]
        new = list(self.known.missing(chain.from_iterable(pieces)))
        self.known.young.update(zip(new, encode_pieces(self.vocab, [p.encode() for p in new]), strict=True))
        of = self.known.young.__getitem__
        return [b"".join(map(of, p)) for p in pieces]


def _encoded(batches: Iterable[pa.RecordBatch], encoder: Encoder) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """doc_ids and packed ids of each batch of (doc_id, text)."""
    for batch in batches:
        yield batch.column("doc_id"), encoder(batch.column("text").to_pylist())


def _ids_column(packed: list[bytes]) -> tuple[pa.ListArray, pa.Array]:
    counts = np.fromiter(map(len, packed), dtype=np.int64, count=len(packed)) // 4
    flat = pa.array(np.frombuffer(b"".join(packed), dtype="<i4"))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), flat), pa.array(counts)


def decode_lists(tokens: pa.Array, lists: pa.ListArray) -> pa.Array:
    """The bytes of each list of ids."""
    flat = tokens.take(lists.flatten())
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    return pc.binary_join(pa.ListArray.from_arrays(ends, flat), pa.scalar(b"", pa.binary()))


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """encode() and decode() in one pass, so that a task needs one Python worker: (doc_id, ids, n_tokens, decoded)."""
    file = broadcast_ranks(docs, ranks_path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(file.value)
        for doc_ids, packed in _encoded(batches, Encoder(vocab, splitter(pattern))):
            lists, counts = _ids_column(packed)
            yield pa.RecordBatch.from_arrays([doc_ids, lists, counts, decode_lists(vocab.tokens, lists)], names=["doc_id", "ids", "n_tokens", "decoded"])

    return texts(docs).mapInArrow(lean(run, keeps=True), "doc_id long, ids array<int>, n_tokens long, decoded binary")


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """encoded (doc_id, ids, n_tokens) with the bytes of its ids as column decoded."""
    file = broadcast_ranks(encoded, ranks_path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = held(("tokens of ranks", file.value), lambda: _token_array(_ranks_of(file.value)))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, decode_lists(tokens, batch.column("ids"))], names=["doc_id", "ids", "n_tokens", "decoded"])

    return encoded.select("doc_id", "ids", "n_tokens").mapInArrow(lean(run, keeps=True), "doc_id long, ids array<int>, n_tokens long, decoded binary")


def digests(decoded: DataFrame) -> DataFrame:
    """The ids and the decoded bytes as SHA-256 digests."""
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decoded.select("doc_id", "n_tokens", F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
