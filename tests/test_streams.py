"""A stream over the files gives the batch answer, but for what is still open."""

import os
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loomline.operators import events, ingest, series
from loomline.plans import registry
from loomline.sources import sinks
from loomline.sources.tables import Tables
from loomline.streaming import flows

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="the test tables are not here")


@pytest.fixture(scope="module")
def batch(spark):
    return Tables(spark, DATA)


def run(spark, name):
    return registry.queries()[name](spark, DATA)


def rows(df, *columns):
    return {tuple(str(r[c]) for c in columns) for r in df.select(*columns).collect()}


def test_collapse(spark, batch):
    routed = ingest.route(ingest.parse_topic(batch.raw_metrics), batch.packml_register)
    columns = ("id_equipment", "ts_value", *ingest.COLUMNS.values())
    got, want = rows(run(spark, "st_collapse"), *columns), rows(ingest.collapse(routed), *columns)
    assert got <= want and len(got) > 0.8 * len(want)
    newest = max(x[1] for x in want)
    assert all(x[1] > min(newest[:8] + "29", newest) or x in got for x in want if x[1] < "2024-01-29")


def test_hours_from_minutes(spark, batch):
    want = rows(series.shown(series.rollup(batch.equipment_values, "1h")), "id_equipment", "time", "net", "rows")
    got = rows(run(spark, "st_rollup_1m_1h"), "id_equipment", "time", "net", "rows")
    assert got <= want and len(want) - len(got) < 0.1 * len(want)


def test_state_events(spark, batch):
    columns = ("id_equipment", "status", "ts_event", "ts_end", "duration")
    want = rows(events.from_states(batch.equipment_values).where("ts_end IS NOT NULL"), *columns)
    got = rows(run(spark, "st_state_events"), *columns)
    assert got <= want and len(want) - len(got) < 0.05 * len(want)


def test_state_events_put_late_ticks_in_their_place(spark, tmp_path):
    minute = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    files = [[(0, 6), (5, 10), (8, 10)], [(2, 6), (3, 10), (9, 6)], [(4, 6), (30, 10), (30, 6)], [(60, 6)], [(10, 10), (90, 10)]]  # 10 is behind the watermark
    for k, ticks in enumerate(files):
        frame = spark.createDataFrame([(1, minute(m), s) for m, s in ticks] + [(2, minute(m), 6) for m, _ in ticks], "id_equipment long, ts_value timestamp, state int")
        frame.coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    paths = sorted((tmp_path / "in").glob("*/part*"))
    (tmp_path / "all").mkdir()
    for k, path in enumerate(paths):
        (path.rename(tmp_path / "all" / f"{k}.parquet"))
        os.utime(tmp_path / "all" / f"{k}.parquet", (1_700_000_000 + 60 * k,) * 2)
    stream = spark.readStream.schema("id_equipment long, ts_value timestamp, state int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/all")
    with sinks.rocksdb(spark):
        got = rows(sinks.drained(flows.state_events(stream)), "id_equipment", "status", "ts_event", "ts_end", "duration")
    ticks = spark.createDataFrame([(1, minute(m), s) for f in files[:4] for m, s in f], "id_equipment long, ts_value timestamp_ntz, state int")
    want = rows(events.from_states(ticks).where("ts_end <= '2024-01-01 01:20:00'"), "id_equipment", "status", "ts_event", "ts_end", "duration")
    assert got == want and len(got) >= 5


def test_state_events_keep_one_run_per_equipment_and_no_timer(spark, tmp_path):
    first = datetime(2024, 1, 1)
    ticks = [(e, first + timedelta(minutes=30 * k), 6 + k % 2) for e in (1, 2) for k in range(40)]
    spark.createDataFrame(ticks, "id_equipment long, ts_value timestamp, state int").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id_equipment long, ts_value timestamp, state int").parquet(f"{tmp_path}/in")
    with sinks.rocksdb(spark):
        query = sinks.append_stream(flows.state_events(stream), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
        query.awaitTermination()
    kept = [o for p in query.recentProgress for o in p.stateOperators if o.operatorName.startswith("transformWithState")]
    assert max(o.numRowsTotal for o in kept) == 2 and all(o.customMetrics["numRegisteredTimers"] == 0 for o in kept)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2 * 38


def test_sliding_counts(spark, batch):
    want = batch.equipment_values.groupBy(F.window("ts_value", "5 minutes", "1 minute")["end"].alias("time")).agg(F.count("*").alias("rows"))
    got = rows(run(spark, "st_sliding_rows_5min"), "time", "rows")
    assert got <= rows(want, "time", "rows") and len(got) > 0.9 * want.count()


def test_idle_equipment_was_last_seen_then(spark, batch):
    last = rows(batch.equipment_values.groupBy("id_equipment").agg(F.max("ts_value").alias("last_seen")), "id_equipment", "last_seen")
    assert rows(run(spark, "st_idle_timeout"), "id_equipment", "last_seen") <= last


def test_sessions_hold_every_closed_tick(spark, batch):
    got = run(spark, "st_sessions").agg(F.sum("ticks")).first()[0]
    assert 0.8 * batch.equipment_values.count() < got <= batch.equipment_values.count()


def test_upsert_holds_each_key_once(spark, batch):
    assert run(spark, "sink_upsert_values").count() == batch.equipment_values.select("ts_value", "id_equipment").distinct().count()


def test_losses_show_as_unreceived(spark):
    found = run(spark, "st_publish_receive")
    assert found.where("received_at IS NULL").count() > 0 and found.where("received_at < sent_at").count() == 0
