import random
import re

from helpers import awkward_rows, docs_frame, random_text, with_clashes

from loomline.llm import common, decontam


def plain_words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def plain_report(rows, items):
    out = []
    for doc_id, text in rows:
        words, hit, found = plain_words(text), set(), set()
        for item, body in items:
            w = plain_words(body)
            k = min(10, len(w))
            if item is None or not k:
                continue
            windows = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
            for i in range(len(words) - k + 1):
                if tuple(words[i : i + k]) in windows:
                    hit |= set(range(i, i + k))
                    found.add(str(item))
        out.append((doc_id, len(words), len(hit), len(found), sorted(found), bool(hit)))
    return sorted(out, key=str)


def tables():
    rng = random.Random(12)
    words = ["Alpha", "beta", "gämma", "delta", "Été", "x1", "σς", "ΣΑΣ", "K"]
    items = [(k, random_text(rng, words, rng.choice([1, 2, 3, 10, 12, 25]))) for k in range(12)] + [(20, None), (21, ""), (22, "?!"), (None, "alpha beta"), (3, "été delta x1"), (30, items_text := "Alpha, BETA; gämma\ndelta x1 x1 x1 beta beta Alpha Été")]
    rows = [(100 + k, random_text(rng, words, 40)) for k in range(40)]
    rows += [(200, "pre " + items_text.replace("Alpha", "aLPHA") + " post"), (200, "same id, other text"), (201, items_text), (201, items_text), (202, items_text.replace("Été", "été"))]
    rows += [(-(2**63), text := "in between " + items_text), (None, text), (-(2**63), "clean"), (None, "clean")]
    return rows + awkward_rows(), items


def test_equals_brute_force(spark):
    rows, items = tables()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.report(with_clashes(docs_frame(spark, rows)), benchmark).collect()
    assert sorted((tuple(r) for r in found), key=str) == plain_report(rows, items)


def test_large_test_sets_are_joined_by_shuffle_with_the_same_result(spark, monkeypatch):
    rows, items = tables()
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.report(docs_frame(spark, rows), benchmark).collect()
    assert sorted((tuple(r) for r in found), key=str) == plain_report(rows, items)


def test_removal_of_documents_and_of_spans(spark):
    rows, items = tables()
    long = [i for i in items if len(plain_words(i[1])) >= 10]
    benchmark = spark.createDataFrame(long, "item_id long, text string")
    docs = docs_frame(spark, rows)
    dirty = {(r[0], t) for r, t in zip([(d,) for d, _ in rows], [t for _, t in rows]) if plain_report([(r[0], t)], long)[0][5]}
    kept = decontam.clean_documents(docs, benchmark)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([r for r in rows if r not in dirty], key=str)
    cut = decontam.without_spans(docs, benchmark).collect()
    assert len(cut) == len(rows)
    gaps = re.sub(decontam.WORDS, "", items[-1][1])
    assert {r.text for r in cut if r.doc_id == 201} == {gaps}
    assert {r.text for r in cut if r.doc_id == 200} == {f"pre {gaps} post", "same id, other text"}


def test_main_path_is_native_and_splits_each_text_once(spark, monkeypatch):
    rows, items = tables()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    plans = []
    keep = lambda df, label, outer=False: (plans.append((label, df._jdf.queryExecution())), common.written(df, label, outer))[1]
    monkeypatch.setattr(decontam, "written", keep)
    plans.append(("report", decontam.report(docs_frame(spark, rows), benchmark)._jdf.queryExecution()))
    assert not any(re.search("Python|Pandas|Arrow", plan.executedPlan().toString()) for _, plan in plans)
    # a text is split once to be scanned, and once more to be verified where it was met
    splits = {label: plan.optimizedPlan().toString().count("split(") for label, plan in plans}
    assert splits["decontam-scan"] == 1 and splits["decontam-sure"] == 1 and splits["report"] == 0


def test_empty_tables(spark):
    rows, items = tables()
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated for r in decontam.report(docs_frame(spark, rows), nothing).collect())
    assert decontam.report(docs_frame(spark, []), spark.createDataFrame(items, "item_id long, text string")).collect() == []
