"""Stored targets: what is written anew, what stays, what a reader prunes, and what a crash leaves."""

from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loomline.operators import ingest, joins, orders, series
from loomline.sources import sinks
from loomline.sources.tables import load_jdbc
from loomline.streaming import flows

ROWS = "ts_value timestamp_ntz, id_equipment long, net_production_incr double, scrap_incr double, state int, mode int, speed double, seq long"
TICKS = "id_equipment long, ts_value timestamp_ntz, net_production_incr double, scrap_incr double, state int, speed double"


def at(day, hour=0, minute=0):
    return datetime(2024, 1, day, hour, minute)


def files(top):
    """Data files below a folder with their sizes and times of change."""
    return {str(p.relative_to(top)): p.stat().st_mtime_ns for p in Path(top).rglob("*.parquet")}


def parts_changed(before, after):
    return {name.split("/")[0] for name, _ in set(before.items()) ^ set(after.items())}


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


# upserts


def batch(spark, k):
    rows = [(at(1) + timedelta(seconds=k % 7), 1, float(k), None, None, 1, None, k), (at(2), k, None, 1.0, 6, 1, 2.0, k)]
    return spark.createDataFrame(rows, ROWS).coalesce(1)


def test_fifty_batches_leave_few_parts_and_every_last_value(spark, tmp_path):
    target = str(tmp_path / "values")
    for k in range(50):
        sinks.upsert(batch(spark, k), target, k)
        assert len(sinks.manifest(spark, target)["parts"]) <= 2 * sinks.FANOUT
    live = {name for _, name in sinks.manifest(spark, target)["parts"]}
    assert len(live) == 50 // 8 + 50 % 8
    assert {p.name for p in Path(target).iterdir() if p.name.startswith("part-")} == live
    found = {(r.ts_value, r.id_equipment): r for r in sinks.upserted(spark, target).collect()}
    assert len(found) == 57
    assert all(found[at(1) + timedelta(seconds=s), 1].net_production_incr == max(k for k in range(50) if k % 7 == s) for s in range(7))


def test_a_batch_that_dies_before_its_commit_changes_nothing_and_can_come_again(spark, tmp_path, monkeypatch):
    target = str(tmp_path / "values")
    for k in range(sinks.FANOUT - 1):
        sinks.upsert(batch(spark, k), target, k)
    before = sorted(map(tuple, sinks.upserted(spark, target).collect()))
    with monkeypatch.context() as m:
        m.setattr(sinks, "_commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            sinks.upsert(batch(spark, 7), target, 7)
    assert sorted(map(tuple, sinks.upserted(spark, target).collect())) == before
    for _ in range(2):  # the replay stores it, another one does nothing
        sinks.upsert(batch(spark, 7), target, 7)
    assert len(sinks.manifest(spark, target)["parts"]) == 1 and sinks.upserted(spark, target).count() == 15
    state = sinks.manifest(spark, target)
    with pytest.raises(RuntimeError, match="another writer"):
        sinks._commit(spark, target, state)
    assert sinks.manifest(spark, target) == state


def test_a_target_without_a_commit_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError, match="no batch"):
        sinks.upserted(spark, str(tmp_path / "none"))


# roll-ups and totals


def ticks(spark, *rows):
    return spark.createDataFrame([(e, t, n, 0.0, 6, n) for e, t, n in rows], TICKS)


def test_a_refresh_reads_and_overwrites_the_days_touched_alone(spark, tmp_path):
    source, levels = str(tmp_path / "values"), str(tmp_path / "levels")
    first = ticks(spark, *((e, at(d, h, m), 1.0) for e in (1, 2) for d in range(1, 6) for h in (0, 9) for m in (0, 1)))
    series.store_values(first, source)
    series.refresh(levels, spark.read.parquet(source), first)
    before = {n: files(f"{levels}/{n}") for n, _ in series.LEVELS}
    late = ticks(spark, (1, at(3, 9, 1), 5.0), (1, at(3, 9, 30), 7.0))
    series.store_values(late, source)
    series.refresh(levels, spark.read.parquet(source), late)
    whole = spark.read.parquet(source)
    for name, _ in series.LEVELS:
        assert parts_changed(before[name], files(f"{levels}/{name}")) == {"day=2024-01-03"}
        shown = lambda df: sorted(map(tuple, series.shown(df).collect()))
        assert shown(spark.read.parquet(f"{levels}/{name}")) == shown(series.rollup(whole, name))
    again = {n: spark.read.parquet(f"{levels}/{n}").collect() for n, _ in series.LEVELS}
    series.refresh(levels, spark.read.parquet(source), late)  # the same again
    assert all(sorted(map(str, spark.read.parquet(f"{levels}/{n}").collect())) == sorted(map(str, rows)) for n, rows in again.items())
    series.refresh(levels, spark.read.parquet(source), late.limit(0))


def test_a_refresh_prunes_the_source(spark, tmp_path, monkeypatch):
    source = str(tmp_path / "values")
    rows = ticks(spark, *((1, at(d), 1.0) for d in range(1, 8)))
    series.store_values(rows, source)
    plans = []
    make = series.rollup_rows
    monkeypatch.setattr(series, "rollup_rows", lambda df, step: plans.append(planned(df)) or make(df, step))
    series.refresh(str(tmp_path / "levels"), spark.read.parquet(source), rows.where("ts_value = '2024-01-04'"))
    scan = next(line for line in plans[0].splitlines() if "PartitionFilters" in line and "values" in line)
    assert "day" in scan.split("PartitionFilters: [")[1].split("]")[0]
    assert [p.name for p in (tmp_path / "levels" / "1d").glob("day=*")] == ["day=2024-01-04"]


def test_consistency_deals_all_levels_out_by_equipment_and_day(spark):
    found = series.consistency(ticks(spark, *((e, at(d, h, 1), 0.1 * h) for e in (1, 2) for d in (1, 2) for h in range(24))))
    plan = planned(found)
    assert plan.count("REPARTITION_BY_NUM") == 2 and f", {series.PARTS}), REPARTITION_BY_NUM" in plan and plan.count("Exchange") == 3
    assert found.first().differing == 0


def test_a_recalculation_overwrites_the_touched_days_alone(spark, tmp_path):
    path = str(tmp_path / "totals")
    runtimes = spark.createDataFrame([(10 * e + d, 1, e, at(d, 6), at(d + 1, 6) if d < 4 else None) for e in (1, 2) for d in range(1, 5)], "id_production_order_runtime long, id_production_order long, id_equipment long, ts_start timestamp_ntz, ts_end timestamp_ntz")
    first = ticks(spark, *((e, at(d, 12), 2.0) for e in (1, 2) for d in range(1, 5)))
    orders.store_totals(orders.totals(first, runtimes), runtimes, path)
    before = files(path)
    late = ticks(spark, (1, at(2, 13), 5.0), (2, at(3, 5), 7.0), (3, at(2), 1.0), (1, at(1, 2), 9.0))  # the last two are in no runtime
    whole = first.union(late)
    orders.recalc_stored(path, whole, runtimes, late)
    assert parts_changed(before, files(path)) == {"day=2024-01-02"}
    want = {r.id_production_order_runtime: (r.net_production, r.ticks) for r in orders.totals(whole, runtimes).collect()}
    assert {r.id_production_order_runtime: (r.net_production, r.ticks) for r in spark.read.parquet(path).collect()} == want
    assert want[12] == (7.0, 2) and want[22] == (9.0, 2)
    after = files(path)
    orders.recalc_stored(path, whole, runtimes, late.where("id_equipment = 3"))
    assert files(path) == after


# late ticks


def test_ticks_behind_the_watermark_are_told_by_the_stream(spark, tmp_path):
    stamped = "id_equipment long, ts_value timestamp"
    late = []
    with sinks.rocksdb(spark):
        for rows in ([(1, at(1, 10)), (2, at(1, 9, 55))], [(1, at(1, 9, 40)), (1, at(1, 9, 52)), (2, at(1, 8)), (2, at(1, 12))], [(2, at(1, 11)), (2, at(1, 11, 55))]):
            spark.createDataFrame(rows, stamped).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = flows.late(spark.readStream.schema(stamped).parquet(f"{tmp_path}/in"))
            sinks.append_stream(stream, f"{tmp_path}/late", f"{tmp_path}/checkpoint").awaitTermination()
            late.append(sorted(tuple(r) for r in spark.read.schema(stamped).parquet(f"{tmp_path}/late").collect()))
    assert late[0] == []
    assert late[1] == [(1, at(1, 9, 40)), (2, at(1, 8))]
    assert late[2] == sorted([*late[1], (2, at(1, 11))])
    runtimes = spark.createDataFrame([(7, 1, 1, at(1, 9), at(1, 10)), (8, 1, 2, at(1, 10), None), (9, 1, 1, at(1, 10), None)], "id_production_order_runtime long, id_production_order long, id_equipment long, ts_start timestamp_ntz, ts_end timestamp_ntz")
    told = sinks.zoneless(spark.createDataFrame(late[2], stamped))
    assert {r[0] for r in orders.touched_by(told, runtimes).collect()} == {7, 8}


# dead letters

LETTERS = [
    '{"timestamp": 1704067200000, "gateway": "edge", "metrics": [{"name": "a", "value": 6.0}, {"value": 1.0}, {"name": "b", "timestamp": 1704067201500}]}',
    '{"timestamp": 1704067200000, "gateway": "edge", "metrics": [{"name": "a"',
    "not json",
    "",
    None,
    '{"timestamp": 1704067200000, "gateway": "edge"}',
    '{"timestamp": 1704067200000, "metrics": []}',
    '{"gateway": "edge", "metrics": [{"name": "a", "value": 6.0}]}',
    '{"timestamp": 1704067200000, "metrics": [{"name": "a", "value": "six"}]}',
    '{"timestamp": 1704067200000, "metrics": "none"}',
]
DEAD = {"malformed": 5, "null": 1, "no metrics": 2, "no name": 1, "no time": 1}


def test_every_metric_and_every_message_without_any_is_used_or_a_dead_letter(spark):
    read = ingest.read_messages(spark.createDataFrame([(x,) for x in LETTERS], "value string"))
    used = sorted((r.name, r.value) for r in ingest.metrics_of(read).select("name", F.coalesce("value", F.lit(-1.0)).alias("value")).collect())
    dead = ingest.dead_letters(read).collect()
    assert used == [("a", 6.0), ("b", -1.0)]
    assert {w: sum(r.why == w for r in dead) for w in DEAD} == DEAD and len(dead) == sum(DEAD.values())
    assert {r.raw for r in dead if r.why in ("malformed", "no metrics")} == {LETTERS[k] for k in (1, 2, 3, 5, 6, 8, 9)}


def test_a_stream_of_messages_goes_to_two_places_and_a_replay_doubles_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.txt").write_text("\n".join(x for x in LETTERS if x) + "\n")
    read = lambda: ingest.read_messages(spark.readStream.text(str(tmp_path / "in")))
    for checkpoint in ("a", "b"):  # another checkpoint: the same batch number anew
        sinks.letters_stream(read(), f"{tmp_path}/good", f"{tmp_path}/dead", f"{tmp_path}/{checkpoint}").awaitTermination()
        assert spark.read.parquet(f"{tmp_path}/good").count() == 2
        assert {r.why: r["count"] for r in spark.read.parquet(f"{tmp_path}/dead").groupBy("why").count().collect()} == {k: v for k, v in (DEAD | {"malformed": 4}).items() if k != "null"}


# logs, sketches, scopes, relational source


def test_old_hours_go_from_disk_and_a_reader_prunes(spark, tmp_path):
    path = str(tmp_path / "logs")
    lines = spark.createDataFrame([(at(d, h, 30), f"{d}-{h}") for d in range(1, 6) for h in (0, 5, 23)], "ts timestamp_ntz, line string")
    sinks.store_logs(lines, path)
    as_of = "2024-01-05 05:45:00"
    kept = sinks.stored_logs(spark, path, as_of)
    scan = next(line for line in planned(kept).splitlines() if "PartitionFilters" in line)
    assert "2024-01-02-05" in scan.split("PartitionFilters: [")[1].split("]")[0]
    want = {f"{d}-{h}" for d in range(1, 6) for h in (0, 5, 23) if at(d, h, 30) > at(2, 5, 45)}
    assert {r.line for r in kept.collect()} == want
    before = files(path)
    gone = sinks.drop_old_logs(spark, path, as_of)
    assert gone == ["hour=2024-01-01-00", "hour=2024-01-01-05", "hour=2024-01-01-23", "hour=2024-01-02-00"]
    assert parts_changed(before, files(path)) == set(gone)
    assert {r.line for r in sinks.stored_logs(spark, path, as_of).collect()} == want
    assert sinks.drop_old_logs(spark, path, as_of) == []


def test_sketches_merge_upwards_within_their_error(spark):
    n = 20_000
    values = spark.range(3 * n).select((F.col("id") % n).alias("id_equipment"), (F.lit(at(1)).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("id").cast("decimal(18,6)"))).alias("ts_value"))
    fine = series.reporting(values)
    day = series.reported(series.reporting_up(series.reporting_up(fine, "1 hour"), "1 day")).collect()
    assert len(day) == 1 and abs(day[0].equipment - n) < 0.05 * n
    direct = series.reported(series.reporting(values, "1 day")).collect()
    assert abs(day[0].equipment - direct[0].equipment) < 0.05 * n


def test_scopes_by_ids(spark):
    rows = spark.createDataFrame([(1, 10, 100, 1000), (1, 11, 101, 1001), (2, 20, 200, 2000), (None, 10, 100, 1003)], "id_enterprise int, id_site int, id_area int, id_equipment int")
    found = lambda **ids: {r.id_equipment for r in joins.scope_ids(rows, **ids).collect()}
    assert found() == found(site=None) == {1000, 1001, 2000, 1003}
    assert found(enterprise=[1]) == {1000, 1001} and found(enterprise=[1, 2], site=[10, 20]) == {1000, 2000}
    assert found(area=[100], equipment=[1003]) == {1003} and found(equipment=[]) == set()
    with pytest.raises(ValueError, match="no such level"):
        found(planet=[1])


def test_a_relational_table_is_read_in_parts_and_filters_reach_it(spark):
    url, driver = "jdbc:derby:memory:factory;create=true", "org.apache.derby.jdbc.EmbeddedDriver"
    made = spark.range(1, 101).select(F.col("id").cast("int").alias("ID_EQUIPMENT"), (F.col("id") * 1.5).alias("SPEED"))
    made.write.jdbc(url, "EQUIPMENTS", "overwrite", {"driver": driver})
    read = load_jdbc(spark, url, "EQUIPMENTS", "ID_EQUIPMENT", 1, 101, 4, driver=driver)
    assert read.rdd.getNumPartitions() == 4
    fast = read.where("SPEED > 120").select("ID_EQUIPMENT")
    assert "*GreaterThan(SPEED,120.0)" in planned(fast) and "ReadSchema: struct<ID_EQUIPMENT:int>" in planned(fast)
    assert sorted(r[0] for r in fast.collect()) == list(range(81, 101)) and read.count() == 100
