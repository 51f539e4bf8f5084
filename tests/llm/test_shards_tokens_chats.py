import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from helpers import awkward_rows, docs_frame, random_text, with_clashes
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomline.llm import chat_tree, common, flow_shards, queries, rans_tokens

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def test_flow_moves_the_fewest_bytes():
    rng = random.Random(4)
    for _ in range(30):
        supply = [rng.randrange(6) for _ in range(3)]
        capacity = [0, 0, 0, 0]
        for _ in range(sum(supply)):
            capacity[rng.randrange(4)] += 1
        flow = flow_shards.min_cost_flow(supply, capacity)
        assert [sum(n for (i, _), n in flow.items() if i == k) for k in range(3)] == supply
        assert [sum(n for (_, j), n in flow.items() if j == k) for k in range(4)] == capacity
        stays = sum(n for (i, j), n in flow.items() if i == j)
        assert stays == max(sum(x) for x in product(*(range(min(s, c) + 1) for s, c in zip(supply, capacity))))


def test_shards_are_whole_gapless_and_even(spark):
    rng = random.Random(5)
    rows = [(k, random_text(rng, ["one", "zwei", "été"], rng.randrange(60))) for k in range(1500)] + awkward_rows()
    done = flow_shards.reshard(with_clashes(docs_frame(spark, rows)), shards=7)
    check_shards(rows, done.files.collect(), 7)
    assert done.fewest <= done.moved


def test_blocks_larger_than_a_task_are_split(spark):
    rng = random.Random(6)
    rows = [(k % 300, random_text(rng, ["one", "zwei", "été"], rng.randrange(60))) for k in range(600)] + [(None, "null")] * 30
    done = flow_shards.reshard(docs_frame(spark, rows), shards=3, blocks=4, part_bytes=700)
    check_shards(rows, done.files.collect(), 3, even=0.35)
    assert done.files.select(F.input_file_name()).distinct().count() > 40


def test_null_old_shards_are_the_first(spark):
    rows = [(k, f"text {k}") for k in range(40)] + [(None, "x")]
    done = flow_shards.reshard(docs_frame(spark, rows), shards=2, old_shard=F.when(F.col("did") < 0, None).otherwise(F.pmod("did", F.lit(2))), unchanged=True)
    check_shards(rows, done.files.collect(), 2, even=0.2)


def check_shards(rows, found, shards, even=0.02):
    assert Counter((r.doc_id, r.text) for r in found) == Counter((d, t or "") for d, t in rows)
    slots, sizes = defaultdict(list), Counter()
    for r in found:
        assert r.size == len(r.text.encode()) + 16
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(shards))
    long = max(r.size for r in found)
    assert max(sizes.values()) - min(sizes.values()) <= max(even * sum(sizes.values()) / shards, long)


def test_only_shards_that_change_are_written(spark):
    rows = [(k, "x" * (100 if k % 4 < 2 else 40)) for k in range(400)]
    done = flow_shards.reshard(docs_frame(spark, rows), shards=4, old_shard=F.pmod("did", F.lit(4)).cast("int"))
    assert 0 < done.fewest <= done.moved < 0.5 * sum(len(t) + 16 for _, t in rows)
    assert done.files.count() == 400  # every shard gains or loses
    even = flow_shards.reshard(docs_frame(spark, [(k, "same") for k in range(400)]), shards=4, old_shard=F.pmod("did", F.lit(4)).cast("int")).files
    assert even.count() == 0
    assert flow_shards.reshard(docs_frame(spark, [])).files.collect() == []


def test_blocks_round_trip():
    rng = np.random.default_rng(2)
    for n in (1, 2, 2047, 2048, 2049, 30_000):
        ids = rng.zipf(1.4, n) % 49_408
        symbols, freqs = rans_tokens.frequency_table(ids)
        assert freqs.min() >= 1 and freqs.sum() == 1 << rans_tokens.SCALE_BITS
        which = np.searchsorted(symbols, ids)
        states, words = rans_tokens.encode_block(which, freqs)
        slots = np.repeat(np.arange(len(freqs)), freqs)
        assert (symbols[rans_tokens.decode_block(states, words, n, freqs, slots)] == ids).all()


def test_a_block_decodes_alone_and_a_damaged_one_is_noticed(spark):
    rows = [(1, random_text(random.Random(1), ["one", "zwei", "été"], 300_000)), (2, "short")]
    segments = rans_tokens.write_tokens(docs_frame(spark, rows), TOKENIZER)
    segment = max(segments.collect(), key=lambda r: len(r.blocks))
    symbols, freqs = np.frombuffer(segment.symbols, dtype="<u4"), np.frombuffer(segment.freqs, dtype="<u4").astype(np.int64)
    slots, number = np.repeat(np.arange(len(freqs)), freqs), len(segment.blocks) - 1
    assert number >= 1
    block = segment.blocks[number]
    alone = symbols[rans_tokens.decode_block(block.states, block.words, block.n, freqs, slots)]
    whole = np.concatenate([np.frombuffer(r.ids, dtype="<u4") for r in sorted(rans_tokens.read_tokens(segments.where(F.col("part") == segment.part)).collect(), key=lambda r: r.start)])
    assert (alone == whole[sum(b.n for b in segment.blocks[:number]) :]).all()
    damaged = segments.withColumn("blocks", F.transform("blocks", lambda b: b.withField("words", F.encode(F.regexp_replace(F.decode(b["words"], "ISO-8859-1"), "^.", "~"), "ISO-8859-1"))))
    with pytest.raises(Exception, match="does not match its checksum"):
        rans_tokens.read_tokens(damaged).collect()


def test_token_files_equal_the_library(spark, monkeypatch):
    rng = random.Random(9)
    rows = awkward_rows() + [(1000 + k, "".join(rng.choice("aAbÉ ß\t\n'sllreT12٣ 日İſŉ😀!?-…") for _ in range(rng.randrange(60)))) for k in range(150)]
    rows += [(2000, "don't <|endoftext|> they'll"), (2001, "a" * 4000)]
    segments = rans_tokens.write_tokens(with_clashes(docs_frame(spark, rows)), TOKENIZER)
    found = sorted(rans_tokens.read_tokens(segments).collect(), key=lambda r: r.start)
    library = Tokenizer.from_file(TOKENIZER)
    library.encode_special_tokens = True
    want = Counter((d, np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4").tobytes()) for d, t in rows)
    assert Counter((r.doc_id, bytes(r.ids)) for r in found) == want
    start = 0
    for r in found:
        assert r.start == start
        start += len(r.ids) // 4
    assert [r.doc_id for r in found][1:] == sorted(d for d, _ in rows if d is not None)
    assert rans_tokens.read_tokens(rans_tokens.write_tokens(docs_frame(spark, []), TOKENIZER)).collect() == []


def test_query_gives_the_ids_of_an_untouched_library(spark, tmp_path):
    rows = awkward_rows() + [(20, "end <|endoftext|> of"), (21, "<|startoftext|><|endoftext|>"), (22, "no <|ENDOFTEXT|> é日 <|endoftext|>"), (23, "end of")]
    docs_frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    library = Tokenizer.from_file(TOKENIZER)
    want = Counter((d, zlib.crc32(np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4").tobytes())) for d, t in rows)
    assert Counter((r.doc_id, r.ids_crc32) for r in queries.op7_rans_tokens(spark, str(tmp_path)).collect()) == want


def chats():
    rng = random.Random(6)
    parts = ["hi", "", None, "\\### Assistant: </turn> ok", "<|end|>", "\\<|", "<", "|end|>\\", "a\nb", "été 😀"]
    rows = []
    for conv in range(120):
        for turn in range(rng.randrange(1, 6)):
            rows.append((conv, turn, ["user", "assistant", "system", None, "a<|text|>b"][0 if turn == 0 else rng.randrange(5)], rng.choice(parts[: 2 if turn == 0 else 10])))
    rows += [(5, 0, "user", "again"), (5, None, "user", "no turn"), (None, 1, "assistant", "null id")]
    rng.shuffle(rows)
    return rows


def test_chats_read_back_from_packs(spark):
    rows = chats()
    frame = with_clashes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    packed = chat_tree.packs(frame, RANKS, public_tokenizers.PATTERN, pack_tokens=100)
    found = {r.conv_id: r for r in chat_tree.read_back(packed, RANKS, public_tokenizers.PATTERN).collect()}
    by_conv = defaultdict(list)
    for conv, turn, role, text in rows:
        by_conv[conv].append((turn is not None, turn or 0, role or "", text or ""))
    assert set(found) == set(by_conv)
    for conv, turns in by_conv.items():
        turns.sort()
        assert list(zip(found[conv].roles, found[conv].texts)) == [(r, t) for _, _, r, t in turns]
        assert found[conv].learned == "".join(t for _, _, r, t in turns if r == "assistant")
        assert hashlib.sha256(found[conv].formatted.encode()).hexdigest()


def test_packs_share_prefixes_and_attend_to_ancestors_only(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", "same start" if t < 2 else f"turn {c % 5} {t}") for c in range(50) for t in range(4)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    packed = chat_tree.packs(frame.coalesce(1), RANKS, public_tokenizers.PATTERN).collect()
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    start, top = library.encode_ordinary("same start"), max(ranks.values())
    turns = [[top + 1, *library.encode_ordinary(role), top + 2, *start, top + 3] for role in ("user", "assistant")]
    for p in packed:
        assert p.ids[: sum(map(len, turns))] == turns[0] + turns[1]  # once in each pack
        assert [(n.loss_start, n.loss_end) for n in p.nodes[:2]] == [(0, 0), (sum(map(len, turns)) - 1 - len(start), sum(map(len, turns)) - 1)]
        assert len({(n.parent, tuple(p.ids[n.start : n.start + n.size])) for n in p.nodes}) == len(p.nodes)
        for n in p.nodes:
            above, at = set(), n.parent
            while at >= 0:
                above |= set(range(p.nodes[at].start, p.nodes[at].start + p.nodes[at].size))
                at = p.nodes[at].parent
            spans = list(zip(n.attends[::2], n.attends[1::2]))
            assert {x for s, e in spans for x in range(s, e)} == above and n.position == len(above)
    assert chat_tree.packs(frame.limit(0), RANKS, public_tokenizers.PATTERN).collect() == []
    assert zlib.crc32(b"") == 0


def test_equal_texts_share_a_shard_unless_they_outgrow_it(spark):
    rows = [(k, f"text {k % 300} " * 9) for k in range(900)] + [(1000 + k, "copied " * 9) for k in range(600)] + [(None, "text 7 " * 9), (-(2**63), "text 7 " * 9)]
    back = flow_shards.reshard(docs_frame(spark, rows), shards=10).files.collect()
    assert sorted((r.doc_id, r.text) for r in back if r.doc_id is not None) == sorted(r for r in rows if r[0] is not None)
    assert [r.text for r in back if r.doc_id is None] == ["text 7 " * 9]
    at, held = {}, {}
    for r in back:
        at.setdefault(r.text, set()).add(r.shard)
        held[r.shard] = held.get(r.shard, 0) + r.size
    assert {len(v) for t, v in at.items() if not t.startswith("copied")} == {1} and len(at["copied " * 9]) > 1
    assert len(held) == 10 and max(held.values()) < 1.1 * min(held.values())


def test_a_word_of_letters_and_its_piece_are_remembered_once():
    with open(TOKENIZER, encoding="utf-8") as file:
        encoder = rans_tokens.Encoder(file.read())
    batch = ["alpha beta", "alpha, été beta's 'alpha", "x1y (beta)", None, ""]
    assert encoder(batch[:1]) == [encoder.whole(batch[0])]
    assert sum(len(r.young) + len(r.old) for r in vars(encoder).values() if isinstance(r, common.Remembered)) == 2
    assert encoder(batch) == [encoder.whole(t or "") for t in batch]
