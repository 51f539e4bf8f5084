"""Chat formatting as prefix trees.

Conversations are put in the order of their turns' chained digests, which is the depth-first order
of the forest that merges equal initial turns; conversations that share a first turn, however many,
spread over tasks by range. Each task emits packs of token ids: the formatted turns of a subtree,
each once in a pack, with the position id of a turn's first token along its own branch, the
intervals of its ancestors in the pack (what it may attend to besides itself), and the spans that
carry loss. The template's marks are tokens of their own, after those of the vocabulary.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm import bpe_codec
from loomline.llm.common import lean, prepare, written

#: Control strings of the template; every one starts with "<|", which escaped text never holds.
TURN, BODY, END = "<|turn|>", "<|text|>", "<|end|>"
#: A pack is closed at so many tokens or conversations.
PACK_TOKENS, PACK_CONVERSATIONS = 1 << 16, 1024
LEARNED_ROLE = "assistant"
PARSED = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>", re.DOTALL)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\([\\|])", r"\1", text)


class Template:
    """Token ids of formatted turns, and back."""

    def __init__(self, file: bytes, pattern: str):
        vocab = bpe_codec.vocabulary(file)
        self.encode = bpe_codec.Encoder(vocab, bpe_codec.splitter(pattern))
        marks = range(len(vocab.tokens), len(vocab.tokens) + 3)
        self.turn, self.body, self.end = (np.array([k], dtype="<i4").tobytes() for k in marks)
        self.tokens = pa.concat_arrays([vocab.tokens, pa.array([m.encode() for m in (TURN, BODY, END)], type=pa.binary())])

    def parts(self, texts: list[str]) -> dict[str, bytes]:
        """Packed ids of the escaped form of each text."""
        new = list(dict.fromkeys(texts))
        return dict(zip(new, self.encode([escape(t) for t in new]), strict=True))

    def decode(self, ids: np.ndarray, spans: list[tuple[int, int]]) -> list[str]:
        """The text of each span (start, end) of ids."""
        flat = np.concatenate([ids[s:e] for s, e in spans]) if spans else ids[:0]
        ends = np.concatenate([[0], np.cumsum([e - s for s, e in spans])]).astype(np.int32)
        found = bpe_codec.decode_lists(self.tokens, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
        return [b.decode() for b in found.to_pylist()]


def _chain(parent: str, role: str, text: str) -> str:
    key = f"{parent}\0{len(role)}\0{role}{text}".encode("utf-8", "replace")
    return hashlib.blake2b(key, digest_size=12).hexdigest()


def paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, path, roles, texts) per conversation; path joins the digests of its prefixes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        now: list = []  # conv_id, digests, roles, texts

        def out() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string())]
            columns = list(zip(*((c, "".join(d), r, t) for c, d, r, t in held), strict=True)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", "path", "roles", "texts"])

        for batch in batches:
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if not now or now[0] != conv:
                    if now:
                        held.append(now)
                    now = [conv, [], [], []]
                now[1].append(_chain(now[1][-1] if now[1] else "", role, text))
                now[2].append(role)
                now[3].append(text)
            if len(held) >= 1000:
                yield out()
                held = []
        if now:
            held.append(now)
            yield out()

    prepare(conversations.sparkSession)
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), empty("role"), empty("text"))
    width = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(width, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return dealt.mapInArrow(lean(run), "conv_id long, path string, roles array<string>, texts array<string>")


PACK = "part int, pack int, ids array<int>, nodes array<struct<start:int,size:int,position:int,parent:int,loss_start:int,loss_end:int,attends:array<int>>>, leaves array<struct<conv_id:bigint,node:int>>"
NODE_TYPE = pa.struct([("start", pa.int32()), ("size", pa.int32()), ("position", pa.int32()), ("parent", pa.int32()), ("loss_start", pa.int32()), ("loss_end", pa.int32()), ("attends", pa.list_(pa.int32()))])
LEAF_TYPE = pa.struct([("conv_id", pa.int64()), ("node", pa.int32())])


class _Pack:
    """The trie of the conversations of one pack, in depth-first order."""

    def __init__(self, template: Template) -> None:
        self.template = template
        self.ids: list[bytes] = []
        self.size = 0
        self.nodes: list[dict] = []
        self.leaves: list[dict] = []
        self.branch: list[tuple[str, int]] = []  # digest and node of each turn of the last conversation

    def add(self, conv_id: int | None, digests: list[str], roles: list[bytes], texts: list[bytes], learned: list[bool]) -> None:
        """One more conversation; roles and texts as packed ids."""
        depth = 0
        while depth < min(len(digests), len(self.branch)) and self.branch[depth][0] == digests[depth]:
            depth += 1
        del self.branch[depth:]
        for k in range(depth, len(digests)):
            parent = self.branch[-1][1] if self.branch else -1
            above = self.nodes[parent] if self.branch else None
            attends = list(above["attends"]) if above else []
            if above:
                if attends and attends[-1] == above["start"]:
                    attends[-1] += above["size"]
                else:
                    attends += [above["start"], above["start"] + above["size"]]
            head = self.template.turn + roles[k] + self.template.body
            body = self.size + len(head) // 4
            body_end = body + len(texts[k]) // 4
            size = body_end + 1 - self.size
            self.nodes.append({"start": self.size, "size": size, "position": above["position"] + above["size"] if above else 0, "parent": parent, "loss_start": body if learned[k] else 0, "loss_end": body_end if learned[k] else 0, "attends": attends})
            self.branch.append((digests[k], len(self.nodes) - 1))
            self.ids.append(head + texts[k] + self.template.end)
            self.size += size
        self.leaves.append({"conv_id": conv_id, "node": self.branch[-1][1]})

    def row(self, part: int, number: int) -> pa.RecordBatch:
        ids = pa.array(np.frombuffer(b"".join(self.ids), dtype="<i4"))
        lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], type=pa.int32()), ids)
        kinds = [pa.list_(NODE_TYPE), pa.list_(LEAF_TYPE)]
        rest = [pa.array([v], type=k) for v, k in zip([self.nodes, self.leaves], kinds, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([part], type=pa.int32()), pa.array([number], type=pa.int32()), lists, *rest], names=["part", "pack", "ids", "nodes", "leaves"])


def packs(conversations: DataFrame, ranks_path: str, pattern: str, pack_tokens: int = PACK_TOKENS) -> DataFrame:
    """Packs of conversations(conv_id, turn, role, text), rows taken by turn, in ids of a byte-level vocabulary.

    ids: the formatted turns, each shared one once in the pack (a prefix that goes on in the next
    pack is written there again). nodes, in order: where a turn lies, the position id of its first
    token (those of the others follow), its parent turn, its loss span (empty unless the role is
    assistant) and, as start, end pairs, its ancestors' intervals. leaves: each conversation's last
    turn. A null text or role is empty; ties of turn are taken by role and text; repeated rows are
    repeated turns; rows with a null conv_id are one conversation. Other columns are ignored; an
    empty table gives no pack.
    """
    file = bpe_codec.broadcast_ranks(conversations, ranks_path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = Template(file.value, pattern)
        part, number, pack = TaskContext.get().partitionId(), 0, _Pack(template)
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "path", "roles", "texts")]
            ids = template.parts([t for turns in (*columns[2], *columns[3]) for t in turns])
            for conv, path, roles, texts in zip(*columns, strict=True):
                pack.add(conv, [path[k : k + 24] for k in range(0, len(path), 24)], [ids[r] for r in roles], [ids[t] for t in texts], [r == LEARNED_ROLE for r in roles])
                if pack.size >= pack_tokens or len(pack.leaves) >= PACK_CONVERSATIONS:
                    yield pack.row(part, number)
                    number, pack = number + 1, _Pack(template)
        if pack.leaves:
            yield pack.row(part, number)

    width = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = written(paths(conversations), "chat-paths")  # so that dealing out by ranges, which samples them, doesn't make them twice
    ordered = found.repartitionByRange(width, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    return ordered.mapInArrow(lean(run, keeps=True), PACK)


def read_back(packed: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(conv_id, roles, texts, learned, formatted) of each conversation, from the packs alone.

    learned: the unescaped texts under the loss spans; formatted: the conversation as one string.
    """
    file = bpe_codec.broadcast_ranks(packed, ranks_path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = Template(file.value, pattern)
        for batch in batches:
            for k in range(batch.num_rows):
                nodes, leaves = (batch.column(c)[k].as_py() for c in ("nodes", "leaves"))
                ids = batch.column("ids")[k].values.to_numpy()
                whole = template.decode(ids, [(n["start"], n["start"] + n["size"]) for n in nodes])
                loss = template.decode(ids, [(n["loss_start"], n["loss_end"]) for n in nodes])
                rows = []
                for leaf in leaves:
                    branch, at = [], leaf["node"]
                    while at >= 0:
                        branch.append(at)
                        at = nodes[at]["parent"]
                    branch.reverse()
                    formatted = "".join(whole[n] for n in branch)
                    turns = [(unescape(r), unescape(t)) for r, t in PARSED.findall(formatted)]
                    rows.append((leaf["conv_id"], [r for r, _ in turns], [t for _, t in turns], "".join(unescape(loss[n]) for n in branch), formatted))
                kinds = [pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["conv_id", "roles", "texts", "learned", "formatted"])

    return packed.mapInArrow(lean(run, keeps=True), "conv_id long, roles array<string>, texts array<string>, learned string, formatted string")
