import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from helpers import awkward_rows, docs_frame, with_clashes

from loomline.llm import bpe_codec

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_whole_texts_equal_the_library(spark, library):
    rng = random.Random(11)
    rows = awkward_rows() + [(100 + i, "".join(rng.choice("aAbé ß\x1c\x85 \t\n'sllrestd12٣ 日本😀́!?-") for _ in range(rng.randrange(80)))) for i in range(200)]
    rows += [(500, "abcdefgh" * 3000), (501, " " * 5000 + "x"), (502, "don't they'll we've <|endoftext|>")]
    docs = with_clashes(docs_frame(spark, rows))
    found = bpe_codec.digests(bpe_codec.decode(bpe_codec.encode(docs, PATH, public_tokenizers.PATTERN), PATH)).collect()
    together = bpe_codec.digests(bpe_codec.round_trip(docs, PATH, public_tokenizers.PATTERN)).collect()
    assert sorted(map(tuple, found), key=str) == sorted(map(tuple, together), key=str)
    want = []
    for doc_id, text in rows:
        ids = library.encode_ordinary(text or "")
        want.append((doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)


def test_trees_of_one_piece_and_of_many_agree(library):
    with open(PATH, "rb") as file:
        vocab = bpe_codec.vocabulary(file.read())
    rng = random.Random(2)
    for _ in range(200):
        piece = "".join(rng.choice("abcdenstioré") for _ in range(rng.randrange(2, 60))).encode()
        assert bpe_codec._merge_rows(vocab, [piece])[0] == bpe_codec._merge_long(vocab, piece)


def test_empty_table(spark):
    assert bpe_codec.encode(docs_frame(spark, []), PATH, public_tokenizers.PATTERN).collect() == []
