import os
import random
from collections import Counter

import corpus_pipeline
import numpy as np
from helpers import docs_frame, random_text, with_clashes

from loomline.llm import near_copies


def plain_shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def plain_first(rows):
    """The lowest doc_id of each id's group by all pairs."""
    sets, root = [plain_shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return {d: low[find(i)] for i, (d, _) in enumerate(rows)}


def near_rows():
    """Copies of about 100 words with a few of them changed, chains of them, short texts and a common passage."""
    rng = random.Random(31)
    words = [f"w{i}" for i in range(300)]
    passage = random_text(rng, words, 40)
    rows = [(1, "one two"), (2, "One  TWO"), (3, "one two three"), (4, ""), (5, " \n")]
    for i in range(50):
        text = random_text(rng, words, rng.choice([8, 100, 250])).split() + (passage.split() if i % 3 == 0 else [])
        for copy in range(rng.choice([1, 1, 2, 3, 12])):
            rows.append((1000 - 20 * i + copy, " ".join(text)))
            for _ in range(rng.randrange(5)):
                text[rng.randrange(len(text))] = rng.choice(words)
    return rows


def test_every_pair_at_four_fifths_is_linked(spark, monkeypatch):
    rows = near_rows()
    want = plain_first(rows)
    for pairs_a_member, block in ((4, 512), (0, 512), (4, 2)):  # without and with rounds of links through one set per shingle; hot shingles as many blocks
        monkeypatch.setattr(near_copies, "PAIRS_A_MEMBER", pairs_a_member)
        monkeypatch.setattr(near_copies, "BLOCK_MEMBERS", block)
        found = {r.did: r.first_did for r in near_copies.groups(with_clashes(docs_frame(spark, rows))).collect()}
        assert {d: found.get(d, d) for d, _ in rows} == want
    assert 30 < sum(want[d] != d for d in want) < len(rows) - 30
    kept = [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs_frame(spark, rows), "").collect()]
    assert sorted(kept) == sorted(d for d in want if want[d] == d)
    assert near_copies.groups(docs_frame(spark, [])).collect() == []


def test_prefix_holds_a_shingle_of_every_linked_set():
    for n in range(1, 300):
        fewest = min(o for o in range(1, n + 1) if 5 * o >= 4 * n)
        assert near_copies.prefix_size(n) == n - fewest + 1


def test_null_and_repeated_ids_are_judged_by_their_own_texts(spark):
    rng = random.Random(8)
    a, b, c, d, e, f = (random_text(rng, [f"w{i}" for i in range(200)], 30) for _ in range(6))
    rows = [(None, a), (None, b), (None, c), (1, d), (1, e), (2, d), (2, f), (3, b), (4, f), (4, f)]
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs_frame(spark, rows), "").collect()]
    assert sorted(kept, key=str) == sorted([(None, a), (None, c), (1, d), (1, e), (2, f), (3, b)], key=str)
    again = [(None, a), (None, a), (5, c), (5, c + " more")]
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs_frame(spark, again), "").collect()]
    assert len(kept) == 2 and (None, a) in kept
    least = -(2**63)  # an id as any other, and the first of all
    for rows, want in (([(None, a), (least, a), (7, a)], [(least, a)]), ([(None, a), (least, b), (None, b), (least, c)], [(None, a), (least, b), (least, c)])):
        kept = [(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs_frame(spark, rows), "").collect()]
        assert sorted(kept, key=str) == sorted(want, key=str)


def test_counted_shingles_are_gone_when_whole_sets_are_written_and_settle_the_same_sets(spark, monkeypatch):
    rng, tables, seen = random.Random(5), {}, []
    words = [f"w{k}" for k in range(400)]
    rows = [(k, random_text(rng, words, rng.randrange(4, 60))) for k in range(300)]
    rows += [(k + 300, f"{t} more") for k, t in rows[:40]] + [(1000, rows[50][1]), (1001, None)]
    write = near_copies.written

    def noted(df, label, outer=False):
        if label == "near-whole":
            seen.append([t for t in tables if os.path.exists(tables[t])])
        out = write(df, label, outer)
        tables[label] = os.path.dirname(out.inputFiles()[0].removeprefix("file://")) if out.inputFiles() else ""
        if label == "near-unsettled":
            seen.append({r.sid for r in out.collect()})
        return out

    monkeypatch.setattr(near_copies, "PACK_KEYS", 500)
    monkeypatch.setattr(near_copies, "written", noted)
    near_copies.groups(docs_frame(spark, rows)).collect()
    sets = [set(near_copies.shingle_hashes(t).tolist()) for _, t in rows]
    counted = [{h for h in s if h & 0xFFFFFFFF < near_copies.COUNTED} for s in sets]
    held = Counter(h for s in counted for h in s)
    as_id = lambda s: near_copies._id_of(np.unique(np.array(list(s), dtype=np.uint64).view(np.int64)))
    want = {as_id(s) for s, c in zip(sets, counted, strict=True) if s and sum(held[h] == 1 for h in c) < near_copies.prefix_size(len(s))}
    assert seen[0] == {int(np.uint64(x).view(np.int64)) for x in want} and 80 < len(want)
    assert sorted(seen[1]) == ["near-close", "near-narrow", "near-prints", "near-sets", "near-unsettled"]
