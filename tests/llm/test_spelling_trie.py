import random
import zlib
from collections import Counter

import pytest
from helpers import awkward_rows, docs_frame, with_clashes

from loomline.llm import spelling_trie


def is_near(a, b):
    """By trying every deletion, insertion and replacement position."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def brute_words(rows):
    """Counts of words by the rule of the query, in plain Python."""
    counts = Counter()
    for doc_id, text in rows:
        run = ""
        for c in (text or "") + " ":
            if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c.lower() if c <= "Z" else c
                continue
            if len(run) >= 6:
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                if h % 199 == 0:
                    at = h % len(run)
                    run = run[:at] + run[at + 1 :]
                if len(run) >= 6:
                    counts[run] += 1
            run = ""
    return {w: n for w, n in counts.items() if n >= 5}


def brute(rows):
    words = brute_words(rows)
    near = {w: [v for v in words if is_near(w, v)] for w in words}
    forms = {}
    for w, those in near.items():
        best = min(those, key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= 5 * words[w]:
            forms[w] = best
    found = set()
    for w, n in words.items():
        root = w
        while root in forms:
            root = forms[root]
        found.add((w, forms.get(w), root, n, len(near[w]), words[forms[w]] if w in forms else None))
    return found


def columns(df):
    return [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]


@pytest.mark.parametrize(("unit_words", "unit_probes"), [(10_000, 50_000), (20, 7), (2, 3)])
def test_pairs_equal_brute_force_however_the_trie_is_parted(spark, monkeypatch, unit_words, unit_probes):
    monkeypatch.setattr(spelling_trie, "UNIT_WORDS", unit_words)
    monkeypatch.setattr(spelling_trie, "UNIT_PROBES", unit_probes)
    rng = random.Random(unit_words)
    # few letters of few groups: many words share a vector; é and m fall into the group of a, and a word may end in ×
    words = {"".join(rng.choice("ambyé×") for _ in range(rng.choice((6, 6, 7, 8)))) for _ in range(180)}
    for w in list(words)[:60]:
        k = rng.randrange(len(w))
        words |= {w[:k] + rng.choice("amb") + w[k:], w[:k] + rng.choice("amzb") + w[k + 1 :]}
    words |= {"aaaaaa", "aaaaaaa", "aaaaaaaa", "abababab", "babababa", "amamam", "mamama"}
    words = sorted(words)
    found = [frozenset((r.word, r.other)) for r in spelling_trie.near_pairs(spark.createDataFrame([(w, 5) for w in words], "word string, n long")).collect()]
    want = {frozenset((a, b)) for k, a in enumerate(words) for b in words[:k] if is_near(a, b)}
    assert len(found) == len(set(found)) and set(found) == want and len(want) > 60


def test_variants_equal_brute_force_with_chains_ties_and_corrupted_runs(spark):
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice(["Letters", "lettres", "lettters", "Zürich×", "zurich×a", "short", "Écoleée"]) for _ in range(rng.randrange(30)))) for k in range(60)]
    # a chain by factors of five, and two forms of one count
    rows += [(100, "chains " * 5 + "chainz " * 30 + "chainzz " * 200), (101, "tieone " * 5 + "tiefone " * 25 + "tieoned " * 25), (None, "letters LETTERS lÉtters " * 6)]
    rows += [r[:2] for r in awkward_rows()]
    want = brute(rows)
    found = columns(spelling_trie.variants(with_clashes(docs_frame(spark, rows))))
    assert len(found) == len(set(found)) and set(found) == want
    by_word = {r[0]: r for r in want}
    assert by_word["chains"][1:3] == ("chainz", "chainzz") and by_word["tieone"][1] == "tiefone"
    plain = Counter(w for _, t in rows for w in (t or "").lower().split())
    assert any(plain[w] != n for w, _, _, n, _, _ in want if w in plain)  # some runs lost a code point


def test_no_documents_and_none_with_words(spark):
    assert columns(spelling_trie.variants(docs_frame(spark, [(1, "a b c"), (2, None)]))) == []
    assert columns(spelling_trie.variants(docs_frame(spark, [(1, "x")]).limit(0))) == []


def test_a_search_meets_only_leaves_within_its_budget():
    words = [(w, 1, spelling_trie.vector(w)) for w in ("abcdefgh", "abcdefgi", "abcdefghi", "zzzzzzzz", "abcdefg")] + [(w * 2, 1, spelling_trie.vector(w * 2)) for w in ("stone", "plumb", "grain", "query", "windy", "fjord")]
    root = spelling_trie.trie(words, 0)
    met = [w for leaf in spelling_trie.leaves(root, 0, spelling_trie.vector("abcdefgh"), 0, 0) for w, _, _ in leaf.words]
    assert isinstance(root, dict) and {"abcdefgh", "abcdefghi"} <= set(met) and "querquery" not in met and "zzzzzzzz" not in met
