import math
import random
import re
from collections import Counter

import numpy as np
import xxhash
from helpers import awkward_rows, docs_frame, random_text, with_clashes

from loomline.llm import ngram_llr

MASK = 2**64 - 1


def plain(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    repeat = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    dup, seen = 0, []
    for line in (text or "").split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.append(line)
    return words, (sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(repeat))


def plain_bins(words):
    h = [xxhash.xxh64_intdigest(w.encode()) for w in words]
    return [x % ngram_llr.BINS for x in h] + [((a * int(ngram_llr.PAIR) + b) & MASK) % ngram_llr.BINS for a, b in zip(h, h[1:])]


def table():
    rng = random.Random(8)
    good, bad = ["river", "stone", "été", "and", "the"], ["buy###", "now***", "win|", "<cheap>", "the"]
    rows = [(100 + i, random_text(rng, good if i % 3 else bad, rng.choice([10, 60, 200]))) for i in range(90)]
    rows += [(300, "same line here\n" * 30), (301, "a b c d " * 20), (302, "\n\n \n"), (303, "x y z\nx y z\n q\n q")]
    return rows + awkward_rows()


def test_equals_brute_force(spark):
    rows = table()
    trusted = [r[0] for r in rows if r[0] and r[0] >= 100 and r[0] % 3 == 2 and r[0] < 300]
    labels = spark.createDataFrame([(d, 1, 0) for d in trusted] + [(100, 1, 1), (101, 0, 0), (None, 1, 0), (trusted[0], 1, 0)], "doc_id long, quality int, toxic int")
    docs = with_clashes(docs_frame(spark, rows))
    raw, target = ngram_llr.count_bins(docs, ngram_llr.trusted_ids(labels))
    want_raw, want_target = np.zeros(ngram_llr.BINS), np.zeros(ngram_llr.BINS)
    for doc_id, text in rows:
        for b in plain_bins(plain(text)[0]):
            want_raw[b] += 1
            want_target[b] += doc_id in trusted
    assert (raw == want_raw).all() and (target == want_target).all()
    found = {(r.doc_id, r.n_words): r for r in ngram_llr.judge(docs, ngram_llr.log_ratios(raw, target)).collect()}
    total = [x.sum() + ngram_llr.BINS for x in (want_raw, want_target)]
    for doc_id, text in rows:
        words, counts = plain(text)
        r = found[doc_id, len(words)]
        assert (r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts
        failed = len(words) < 50 or 100 * counts[3] > 50 * len(words)
        ratios = [math.log((want_target[b] + 1) / total[1]) - math.log((want_raw[b] + 1) / total[0]) for b in plain_bins(words)]
        llr = sum(ratios) / len(ratios) if ratios else 0.0
        assert r.base_failed == failed and abs(r.llr - llr) < 1e-9
        assert r.kept == (not failed and llr >= ngram_llr.THRESHOLD)


def test_nothing_trusted_and_empty_table(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    raw, target = ngram_llr.count_bins(docs_frame(spark, []), ngram_llr.trusted_ids(labels))
    assert not raw.any() and not target.any()
    assert ngram_llr.judge(docs_frame(spark, []), ngram_llr.log_ratios(raw, target)).collect() == []
