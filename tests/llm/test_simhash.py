import random
from collections import Counter

import numpy as np
import xxhash
from helpers import awkward_rows, docs_frame, with_clashes

from loomline.llm import simhash


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    prints = [simhash.fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[max(find(i), find(j))] = min(find(i), find(j))
    low = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            low[find(i)] = min(low.get(find(i), doc_id), doc_id)
    return Counter((d, prints[i], low.get(find(i))) for i, (d, _) in enumerate(rows))


def test_fingerprint_equals_plain_definition():
    rng = random.Random(1)
    for _ in range(40):
        text = "".join(rng.choice("aBcÉß  \n\t.") for _ in range(rng.randrange(200)))
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_every_close_pair_shares_a_band_key():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2**64, 500, dtype=np.uint64)
    y = x.copy()
    for _ in range(3):
        y ^= np.uint64(1) << rng.integers(0, 64, 500, dtype=np.uint64)
    kx, ky = (simhash.band_keys(simhash.pivot_table(v)) for v in (x, y))
    assert (kx == ky).any(axis=1).all()


def test_components_equal_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(50)]
    rows = awkward_rows()
    for i in range(60):
        base = [rng.choice(words) for _ in range(rng.choice([2, 20, 200]))]
        for copy in range(rng.choice([1, 1, 2, 6])):
            text = list(base)
            if copy:
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((100 + 10 * i + copy, " ".join(text)))
    found = simhash.near_duplicates(with_clashes(docs_frame(spark, rows))).collect()
    assert Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in found) == plain_components(rows)


def test_large_keys_are_dealt_in_blocks_without_losing_links(spark):
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2**63, dtype=np.uint64)
    near = base ^ (np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64))
    far = rng.integers(0, 2**64, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([near, far, [base]])).view(np.int64)
    edges = simhash.links(spark.createDataFrame([(int(x),) for x in fps], "fp long"), block_rows=8).collect()
    reached, grown = {int(base.view(np.int64))}, True
    while grown:
        grown = False
        for e in edges:
            if (e.a in reached) != (e.b in reached):
                reached |= {e.a, e.b}
                grown = True
    linked, grown = {int(base)}, True
    while grown:
        new = {int(x) for x in fps.view(np.uint64) if int(x) not in linked and any((int(x) ^ y).bit_count() <= 3 for y in linked)}
        grown = bool(new)
        linked |= new
    assert {x % 2**64 for x in reached} == linked
    assert len(linked) > 50


def test_empty_table(spark):
    assert simhash.near_duplicates(docs_frame(spark, [])).collect() == []
