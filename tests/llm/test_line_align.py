import random
from collections import defaultdict

from helpers import awkward_rows, docs_frame, with_clashes

from loomline.llm import line_align


def test_patience_matches_are_common_and_ascending():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.randrange(1, 12) for _ in range(rng.randrange(20))] for _ in range(2))
        found = line_align.patience(a, b)
        assert all(a[i] == b[j] for i, j in found)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(found, found[1:]))
    assert line_align.patience([1, 2, 3, 9, 4], [7, 1, 2, 3, 4]) == [(0, 1), (1, 2), (2, 3), (4, 4)]
    assert line_align.patience(list(range(5000)), list(range(5000))) == [(k, k) for k in range(5000)]


def plain(rows):
    """Every later document aligned with every earlier one."""
    docs = sorted({(d if d is not None else -(2**63), t or "") for d, t in rows})
    gone = defaultdict(set)
    hashes = {d: [line_align._line_hash(x) for x in d[1].split("\n")] for d in docs}
    for k, d in enumerate(docs):
        words = [len(x.split()) for x in d[1].split("\n")]
        for a in docs[:k]:
            gone[d] |= set(line_align.common_blocks(hashes[a], hashes[d], words))
    return {d: "\n".join(x for k, x in enumerate(d[1].split("\n")) if k not in gone[d]) for d in docs}


def table():
    rng = random.Random(3)
    lines = [" ".join(rng.choice(["aa", "bb", "cc", "dd", "é"]) for _ in range(rng.choice([1, 2, 4, 9]))) for _ in range(40)] + ["", "  "]
    passage = "\n".join(" ".join(f"p{k}{j}" for j in range(10)) for k in range(6))
    rows = []
    for k in range(60):
        own = [f"own {k} {j} words of it" for j in range(rng.randrange(4))]
        body = own + [rng.choice(lines) for _ in range(rng.randrange(8))]
        rng.shuffle(body)
        rows.append((100 + k, "\n".join(body + [passage] * (k % 3 == 0))))
    return rows + [(500, rows[0][1]), (501, rows[3][1] + "\nnew line at the end of it"), (501, rows[3][1] + "\nnew line at the end of it")]


def test_equals_brute_force(spark):
    rows = table() + awkward_rows()
    want = plain(rows)
    found = line_align.deduplicate(with_clashes(docs_frame(spark, rows))).collect()
    assert sorted(((r.doc_id, r.text) for r in found), key=str) == sorted(((d, want[d if d is not None else -(2**63), t or ""]) for d, t in rows), key=str)
    assert all(r.n_removed == 0 or r.n_lines >= r.n_removed for r in found)
    assert [r.text for r in found if r.doc_id == 501] == ["new line at the end of it"] * 2


def test_applied_to_rows(spark):
    rows = table() + awkward_rows()
    docs = with_clashes(docs_frame(spark, rows))
    found = line_align.apply_to_rows(docs)
    assert found.columns == docs.columns
    kept = {r.doc_id: r for r in found.collect()}
    assert 500 not in kept and kept[501].n_chars == len(kept[501].text)
    assert {1, 2, 3, 4, 5, 9} <= set(kept) and kept[1].text is None
    assert line_align.apply_to_rows(docs.limit(0)).collect() == []


def blocks_of_earlier(rows):
    """The texts without any line that lies in a run of lines of 5 words or more that an earlier document holds, by all runs."""
    docs = sorted({(d if d is not None else -(2**63), t or "") for d, t in rows}, key=lambda d: (d[0], d[1]))
    runs, cut = set(), {}
    for d in docs:
        lines = d[1].split("\n")
        own = [(s, e, tuple(x.strip() for x in lines[s:e])) for s in range(len(lines)) for e in range(s + 1, len(lines) + 1)]
        own = [r for r in own if sum(len(x.split()) for x in r[2]) >= 5]
        gone = {k for s, e, r in own if r in runs for k in range(s, e)}
        runs |= {r for _, _, r in own}
        cut[d] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return cut


def test_no_block_of_an_earlier_document_is_left(spark):
    rng = random.Random(21)
    lines = [f"line {k} has five words" for k in range(12)] + [f"w{k}" for k in range(6)] + ["two words", "", "  "]
    rows = [(1, "line 1 has five words\nline 2 has five words"), (2, "line 2 has five words\nmine\nline 1 has five words\nline 2 has five words")]
    rows += [(3, "a b\nown3 x"), (4, "own4 y\nc d"), (5, "e\nz"), (6, "a b\nc d\ne"), (7, "seven\na b\nc d\ne\nends")]
    rows += [(10, "hot line with five words\n" * 3 + "x"), (11, "mine\nhot line with five words\nyours\nhot line with five words")]
    rows += [(100 + k, "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 9)))) for k in range(80)]
    want = blocks_of_earlier(rows)
    found = {r.doc_id: r.text for r in line_align.deduplicate(docs_frame(spark, rows)).collect()}
    assert found == {d: want[d, t] for d, t in rows}
    assert found[2] == "mine" and found[7] == "seven\nends" and found[11] == "mine\nyours"


def test_all_that_is_deleted_is_aligned(monkeypatch):
    rng = random.Random(8)
    for _ in range(300):
        words = {h: rng.choice([1, 2, 3, 5, 9]) for h in range(1, 9)} | {0: 0}
        a, b = ([rng.randrange(9) for _ in range(rng.randrange(14))] for _ in range(2))
        runs = {tuple(a[s:e]) for s in range(len(a)) for e in range(s + 1, len(a) + 1)}
        spans = [range(s, e) for s in range(len(b)) for e in range(s + 1, len(b) + 1) if tuple(b[s:e]) in runs and sum(words[h] for h in b[s:e]) >= 5]
        assert line_align.common_blocks(a, b, [words[h] for h in b]) == sorted(set().union(*spans))
    moved = ([1, 2, 3, 4], [3, 4, 1, 2], [5, 5, 5, 5])
    assert line_align.common_blocks(*moved) == [0, 1, 2, 3]
    monkeypatch.setattr(line_align, "patience", lambda a, b: [])
    assert line_align.common_blocks(*moved) == [] == line_align.common_blocks([1, 2], [1, 2], [9, 9])


def test_rare_and_common_links_find_the_same(spark):
    """Passages in 2 documents, in some and in all, so that each bound parts them in another way."""
    rng = random.Random(9)
    passages = [f"passage {k} has some six words" for k in range(12)]
    rows = [(k, "\n".join([passages[0], *rng.sample(passages, k % 4), f"own {k}", *([passages[k % 12] + " more"] * (k < 24))])) for k in range(70)]
    want = blocks_of_earlier(rows)
    for rare in (1, 2, 10, 1000):
        gone = {(r.did, r.th): set(r.gone) for r in line_align.deletions(docs_frame(spark, rows), rare=rare).collect()}
        kept = {d: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get((d, th), ())) for d, t, th in docs_frame(spark, rows).selectExpr("doc_id", "text", "xxhash64(text) th").collect()}
        assert kept == {d: want[d, t] for d, t in rows}


def test_the_least_id_of_all_is_no_null(spark):
    one, two = "a line of more than five words", "and another line of as many words"
    rows = [(-(2**63), f"{two}\n{one}\nfirst"), (None, f"{one}\nnull"), (-(2**63), f"{two}\n{one}\nfirst"), (5, f"{two}\nfive")]
    kept = [(r.doc_id, r.text) for r in line_align.deduplicate(docs_frame(spark, rows)).collect()]
    assert sorted(kept, key=str) == sorted([(-(2**63), f"{two}\nfirst")] * 2 + [(None, f"{one}\nnull"), (5, "five")], key=str)
