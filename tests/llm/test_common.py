import random
from concurrent.futures import ThreadPoolExecutor
from types import SimpleNamespace

import pyarrow as pa
import pytest
from helpers import docs_frame, random_text

from loomline.llm import common, decontam, flow_shards, line_align, simhash


def test_remembered_values_outlive_a_turn_only_if_asked_for_again():
    known = common.Remembered(2)
    for turn, keys in enumerate((["a", "b", "c"], ["a"], ["d", "e"], ["a", "b"])):
        new = known.missing(keys)
        known.young.update((k, turn) for k in new)
        assert set(keys) <= set(known.young)
    assert known.young == {"a": 0, "b": 3}  # a was asked for in between, b was not
    assert known.missing(["c", "d"]) == {"c"} and known.young["d"] == 2


def test_workers_drop_what_earlier_steps_held(spark):
    docs = spark.range(4).coalesce(1)

    def hold(batches):
        for batch in batches:
            common.held(("numbers",), lambda: [1, 2, 3])
            yield pa.RecordBatch.from_arrays([pa.array([len(common._HELD)] * batch.num_rows)], names=["n"])

    def look(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(common._HELD)] * batch.num_rows)], names=["n"])

    assert {r.n for r in docs.mapInArrow(common.lean(hold, keeps=True), "n long").collect()} == {1}
    assert {r.n for r in docs.mapInArrow(common.lean(look), "n long").collect()} == {0}


def test_broadcasts_are_measured_in_bytes(spark):
    long = spark.createDataFrame([(1, "x" * 5000, ["y" * 3000], [1, 2])], "a long, s string, l array<string>, n array<long>")
    marked = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert marked(common.if_small(long, "few", 9000)) and not marked(common.if_small(long, "many", 8000))
    assert marked(common.if_small(long.limit(0), "none", 0))


def test_outside_local_mode_the_shared_folder_must_be_named():
    made = {}
    session = lambda master, named=None: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: named, set=made.__setitem__), sparkContext=SimpleNamespace(master=master))
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            common.shared_dir(session(master))
    assert common.shared_dir(session("yarn", "hdfs://shared/")) == "hdfs://shared"
    assert common.shared_dir(session("local[4]")) == made["spark.checkpoint.dir"]


def test_tables_of_a_job_go_at_its_end_but_for_those_written_outside(spark):
    with common.job(spark):
        inner = common.written(spark.range(3), "inner")
        with common.job(spark):
            kept = common.written(inner, "kept", outer=True)
            common.written(inner, "gone")
        last = common.written(kept, "last", outer=True)
        assert kept.count() == 3
    assert last.count() == 3
    assert "/job-" not in last.inputFiles()[0]


def test_queries_side_by_side_keep_their_own_tables(spark):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(60)]
    texts = [random_text(rng, words, 40) for _ in range(20)]
    docs = docs_frame(spark, [(k, texts[k % 20] + "\n" + texts[(k * 7) % 20]) for k in range(50)])
    tests = spark.createDataFrame([(1, texts[3]), (2, texts[5])], "item_id long, text string")
    runs = [
        lambda: simhash.near_duplicates(docs).select("doc_id", "component_id"),
        lambda: line_align.deduplicate(docs).select("doc_id", "text"),
        lambda: flow_shards.reshard(docs).files.select("doc_id", "shard", "slot"),
        lambda: decontam.report(docs, tests).select("doc_id", "n_hit"),
    ]
    shown = lambda run: sorted(map(str, run().collect()))
    alone = [shown(run) for run in runs]
    with ThreadPoolExecutor(4) as pool:
        assert list(pool.map(shown, runs)) == alone
