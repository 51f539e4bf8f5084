import base64
import random
from collections import Counter, defaultdict
from pathlib import Path

import corpus_pipeline
import public_tokenizers
import tiktoken
from helpers import awkward_rows, docs_frame, random_text
from test_decontam import plain_report
from test_line_align import blocks_of_earlier
from test_near_copies import plain_shingles

from loomline.llm import common, ppm_lang


def write_tables(spark, top):
    rng = random.Random(14)
    words = {"en": ["the", "and", "river", "stone", "of", "hand"], "de": ["der", "und", "straße", "über", "von"]}
    rows = [(100 + k, "\n".join(random_text(rng, words[lang := rng.choice(["en", "de"])], 12) for _ in range(4)), lang) for k in range(80)]
    rows += [(300 + k, rows[k][1], rows[k][2]) for k in range(5)] + [(400 + k, rows[k][1] + " more", rows[k][2]) for k in range(8)]
    item = random_text(rng, words["en"], 30)
    rows += [(500, random_text(rng, words["en"], 9) + " " + item, "en"), (501, "???", None)] + awkward_rows()
    rows += [(600, "ein ganz anderer Text und von über der straße"), (600, "and one more text of the river and of the stone"), (None, "null as well but not the same of the hand and river"), (601, "Это совсем другой язык, и ни одного слова из него никто не видел.", None)]
    docs_frame(spark, rows).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return rows, [(1, item)]


def test_pipeline_equals_plain_python(spark, tmp_path):
    rows, items = write_tables(spark, tmp_path)
    packed = ppm_lang.train(spark.read.parquet(f"{tmp_path}/documents.parquet").where(ppm_lang.held_out() == False))  # noqa: E712
    told = {k: ppm_lang.predict(docs_frame(spark, [(k, r[1])]), packed) for k, r in enumerate(rows) if r[0] is None or r[0] in (600, 601)}
    told = {k: found.first() for k, found in told.items()}
    by_id = {r.doc_id: r for r in ppm_lang.predict(docs_frame(spark, rows), packed).collect()}
    told = [told.get(k, by_id[r[0]]) for k, r in enumerate(rows)]
    docs = [(r[0], r[1]) for r, x in zip(rows, told) if x.lang_pred != "und" and x.score >= corpus_pipeline.MIN_LANGUAGE_SCORE and x.bits_per_byte <= ppm_lang.MAX_BITS]
    assert 501 not in dict(docs) and 601 not in dict(docs) and 500 in dict(docs) and [d for d, _ in docs].count(600) == 2
    cut = blocks_of_earlier(docs)
    key = lambda d, t: (d if d is not None else -(2**63), t or "")
    docs = [(d, cut[key(d, t)]) for d, t in docs if cut[key(d, t)] == (t or "") or cut[key(d, t)].strip()]
    docs = plain_near_dedup(docs)
    docs = [(d, t) for d, t in docs if not plain_report([(d, t)], items)[0][5]]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(corpus_pipeline.RANKS), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = Counter((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert found == Counter((d, tuple(library.encode_ordinary(t or ""))) for d, t in docs)
    assert 60 < len(docs) < len(rows) - 5 and 500 not in dict(docs)


def plain_near_dedup(docs):
    """The first row, null ids last, of each group of texts that Jaccard similarities of 0.8 over five-word shingles join."""
    sets, root = [plain_shingles(t) for _, t in docs], list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and root[i] != root[j]:
                root = [root[j] if x == root[i] else x for x in root]
    groups = defaultdict(list)
    for (d, t), x in zip(docs, root):
        groups[x].append((d is None, d or 0, t))
    return [(None if null else d, t) for null, d, t in map(min, groups.values())]


def test_rows_without_an_id_or_with_a_shared_one_stay_on_any_partitioning(spark):
    texts = ["the river and the stone of it", "a hand of the other stone", "von der straße und über", "one more of these texts here", "and the last of them is this"]
    for parts in (1, 7):
        docs = docs_frame(spark, list(zip([None, None, None, 7, 7], texts))).repartition(parts)
        kept = corpus_pipeline.near_dedup(spark, docs, "").collect()
        assert sorted((str(r.doc_id), r.text) for r in kept) == sorted(zip(["None", "None", "None", "7", "7"], texts))


def test_what_stages_need_besides_is_deleted(spark, tmp_path):
    write_tables(spark, tmp_path)
    corpus_pipeline.run(spark, str(tmp_path)).count()
    top = Path(common._folder(spark).removeprefix("file:"))
    assert not list(top.glob("job-*"))


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    write_tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    nothing = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, str(tmp_path)).collect() == []
