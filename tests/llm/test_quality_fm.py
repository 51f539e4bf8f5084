import random
import zlib

import numpy as np
from helpers import awkward_rows, docs_frame, random_text, with_clashes

from loomline.llm import quality_fm


def table(rng, n=600):
    good, bad = ["river", "stone", "été", "and", "the"], ["BUY!!", "now***", "win|", "<cheap>", "CLICK!!"]
    rows, labels = [], []
    for i in range(n):
        quality = int(rng.random() < 0.7)
        rows.append((1000 + i, random_text(rng, good if quality else bad, rng.choice([5, 40, 120]))))
        labels.append((1000 + i, quality, 0))
    return rows, labels


def test_margin_equals_the_pairwise_sum():
    rng = np.random.default_rng(1)
    size = quality_fm.WORD_BINS + quality_fm.STRUCTURE
    m = quality_fm.Machine(rng.normal(size=size), rng.normal(size=(size, quality_fm.FACTORS)), np.zeros(quality_fm.STRUCTURE), np.ones(quality_fm.STRUCTURE), 0.3)
    entries = m.entries(*quality_fm.features(["one two three two", "", None, "x | y!"], [None, 0, None, 99]))
    margins = m.margins(*entries)[0]
    for k in range(4):
        mine = entries[0] == k
        b, x = entries[1][mine], entries[2][mine]
        pairs = sum(m.v[b[i]] @ m.v[b[j]] * x[i] * x[j] for i in range(len(b)) for j in range(i))
        assert np.isclose(margins[k], 0.3 + m.w[b] @ x + pairs)


def test_held_out_accuracy_and_awkward_rows(spark):
    rows, labels = table(random.Random(3))
    rows += awkward_rows()
    labels += [(None, 1, 0), (1000, None, 0), (999_999, 1, 1)]
    truth = {d: q for d, q, _ in labels if q is not None}
    frame = with_clashes(docs_frame(spark, rows)).withColumnRenamed("n_chars", "n0").selectExpr("*", "case when doc_id % 5 = 0 then null else n0 end as n_chars")
    found = quality_fm.classify(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    held = [r for r in found if r.held_out and r.doc_id and 1000 <= r.doc_id < 2000]
    assert len(held) > 100 and sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95


def test_held_out_labels_are_not_learned(spark):
    rows, labels = table(random.Random(6), 200)
    turned = [(d, 1 - q if zlib.crc32(str(d).encode()) % 4 == 2 else q, t) for d, q, t in labels]
    docs = docs_frame(spark, rows)
    one, two = (quality_fm.train(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (labels, turned))
    assert np.array_equal(quality_fm.Machine.unpack(one).w, quality_fm.Machine.unpack(two).w)


def test_no_labels_and_empty_table(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_fm.classify(docs_frame(spark, []), labels).collect() == []
    assert [r.score for r in quality_fm.classify(docs_frame(spark, [(1, "text")]), labels).collect()] == [0.5]
