import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from helpers import awkward_rows, docs_frame, random_text, with_clashes

from loomline.llm import ppm_lang

VOCAB = {"aa": ["the", "and", "of", "stone", "river"], "bb": ["der", "und", "von", "straße", "über"], "cc": ["le", "été", "dans", "où", "çà"]}


def labelled(rng, n):
    rows = []
    for i in range(n):
        lang = rng.choice(list(VOCAB))
        rows.append((1000 + i, random_text(rng, VOCAB[lang], 60), lang))
    return rows


def plain_bits(train, text):
    """Code length by walking the context tree byte by byte; train: lower-cased texts of one language."""
    seen = [defaultdict(Counter) for _ in range(4)]
    for t in train:
        data = b"\n\n\n" + t.encode()
        for i in range(3, len(data)):
            for k in range(4):
                seen[k][data[i - k : i]][data[i]] += 1
    data, bits = b"\n\n\n" + text.lower().encode(), 0.0
    for i in range(3, len(data)):
        for k in (3, 2, 1, 0):
            here = seen[k].get(data[i - k : i])
            if here is None or k == 3 and sum(here.values()) < ppm_lang.MIN_CONTEXT:
                continue
            all_ = sum(here.values()) + len(here)
            if data[i] in here:
                bits -= math.log2(here[data[i]] / all_)
                break
            bits -= math.log2(len(here) / all_)
        else:
            bits += 8
    return bits


def test_code_lengths_equal_a_walk_of_the_tree(spark):
    train = [random_text(random.Random(k), VOCAB["cc"], 30) for k in range(12)]
    packed = ppm_lang.train(docs_frame(spark, [(k, t, "cc") for k, t in enumerate(train)]))
    texts = ["le été", "x\x00!", "Straße où où", "z" * 50, random_text(random.Random(99), VOCAB["cc"], 200)]
    coder = ppm_lang.Coder(packed)
    got = coder.lengths([t.lower().encode() for t in texts])[:, 0] / ppm_lang.UNIT
    want = [plain_bits([t.lower() for t in train], t) for t in texts]
    assert np.allclose(got, want, atol=[0.001 * (len(t.encode()) + 1) for t in texts])


def test_pieces_of_a_long_text_add_up(spark, monkeypatch):
    packed = ppm_lang.train(docs_frame(spark, labelled(random.Random(1), 60)))
    coder = ppm_lang.Coder(packed)
    data = [b"the river of stone " * 40, b"", b"der", b"von und " * 70]
    whole = coder.lengths(data)
    monkeypatch.setattr(ppm_lang, "STEP", 37)
    assert (coder.lengths(data) == whole).all()


def test_held_out_accuracy_and_awkward_rows(spark):
    rows = labelled(random.Random(4), 400) + awkward_rows() + [(5000, "the river", None), (5001, "no lang text " * 3, None)]
    found = ppm_lang.identify(spark, with_clashes(docs_frame(spark, rows))).collect()
    assert len(found) == len(rows)
    truth = {r[0]: r[2] for r in rows if r[0] and 1000 <= r[0] < 5000}
    held = [r for r in found if r.doc_id in truth and r.held_out]
    assert len(held) > 60 and all(r.lang_pred == truth[r.doc_id] for r in held)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    assert all(0 <= r.score <= 1 for r in found)
    by_id = {r.doc_id: r for r in found}
    assert all(by_id[k].lang_pred == "und" for k in (1, 2, 3, 9))


def test_nothing_learned_and_empty_table(spark):
    empty = docs_frame(spark, [])
    assert ppm_lang.identify(spark, empty).collect() == []
    unlabelled = docs_frame(spark, [(1, "some words", None)])
    assert [r.lang_pred for r in ppm_lang.identify(spark, unlabelled).collect()] == ["und"]
