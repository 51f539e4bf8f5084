"""Rows that the test tables lack."""

import random
from datetime import datetime as dt
from datetime import timedelta
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from loomline.operators import events, ingest, joins, kpi, logs, orders, series
from loomline.plans.params import Params
from loomline.sources import sinks, synthetic
from loomline.sources.tables import Tables

VALUES = "ts_value timestamp_ntz, id_equipment long, id_site int, net_production_incr double, scrap_incr double, state int, mode int, speed double"
RUNTIMES = "id_production_order_runtime long, id_production_order long, id_equipment long, ts_start timestamp_ntz, ts_end timestamp_ntz"


def at(day, hour=0, minute=0, second=0, micro=0):
    return dt(2024, 1, day, hour, minute, second, micro)


def values(spark, *rows):
    return spark.createDataFrame([(t, e, 1, n, s, st, 1, v) for t, e, n, s, st, v in rows], VALUES)


def equipment(spark, *rows):
    return spark.createDataFrame(list(rows), "id_equipment long, production_speed double")


def test_no_scrap_leaves_quality_null_and_zero_rate_is_left_out(spark):
    v = values(spark, (at(1), 1, 5.0, None, 6, 10.0), (at(2), 1, 5.0, None, 10, 0.0), (at(1), 2, 9.0, 1.0, 6, 10.0))
    found = {r.id_equipment: r for r in kpi.by(v, equipment(spark, (1, 20.0), (2, 0.0)), "id_equipment").collect()}
    assert found[1].quality is None and found[1].performance == 50.0 and found[1].availability == 50.0
    assert found[2].quality == 90.0 and found[2].performance is None and found[2].oee_panel is None


def on_a_tie(spark, seed):
    """Forty ticks of each of two equipments in an order by seed; the speeds are 57.55 % of the rated 3600 (40 times 90)."""
    cents = random.Random(1).choices(range(1, 9000), k=39)
    cents = [c * 200_000 // sum(cents) for c in cents]
    speeds = [c / 100 for c in [*cents, 207_180 - sum(cents)]]
    random.Random(seed).shuffle(speeds)
    v = values(spark, *((at(1, 0, 0, k), e, 1.0, 0.0, 6, s) for e in (1, 2) for k, s in enumerate(speeds)))
    places = {"id_enterprise": F.lit(0), "id_area": F.lit(0)}
    return v.withColumns(places).coalesce(1), equipment(spark, (1, 90.0), (2, 90.0))


@pytest.mark.parametrize("seed", range(6))
def test_a_kpi_on_a_tie_is_the_same_in_every_order_of_rows(spark, seed):
    assert {r.performance for r in kpi.by(*on_a_tie(spark, seed), "id_equipment").collect()} == {57.6}


@pytest.mark.parametrize("seed", range(6))
def test_every_level_of_the_hierarchy_is_the_same_in_every_order_of_rows(spark, seed):
    assert {(r.level, r.performance) for r in kpi.by_hierarchy(*on_a_tie(spark, seed)).collect()} == {(k, 57.6) for k in range(5)}


def test_panel_and_product_differ_where_stopped_rows_carry_no_production(spark):
    v = values(spark, (at(1), 1, 9.0, 1.0, 6, 10.0), (at(2), 1, None, None, 10, None))
    r = kpi.by(v, equipment(spark, (1, 10.0)), "id_equipment").first()
    assert (r.oee_panel, r.oee_product) == (90.0, 45.0)


def test_topics_of_five_segments_and_admin_shape(spark):
    names = ["A/B/C/D/Status/StateCurrent", "A/B/C/D/E/Status/StateCurrent", "A/B/C/D/Admin/CurMachSpeed/7/M7***TRIG_C=I", "A/B", None]
    found = ingest.parse_topic(spark.createDataFrame([(n,) for n in names], "name string")).collect()
    assert [(r.topic, r.shape, r.metric_type, r.unit, r.machine) for r in found[:3]] == [
        ("A/B/C/D", "status", "StateCurrent", None, None),
        ("A/B/C/D/E", "status", "StateCurrent", None, None),
        ("A/B/C/D", "admin", "CurMachSpeed", "7", "M7"),
    ]
    assert [r["shape"] for r in found[3:]] == [None, None]


def test_collapse_rounds_half_up_and_keeps_the_last_value_that_is_not_null(spark):
    rows = [(1, 1, "CurMachSpeed", at(1, micro=400_000), 3.0), (2, 1, "CurMachSpeed", at(1, micro=400_000), 4.0), (3, 1, "CurMachSpeed", at(1, micro=450_000), None), (4, 1, "StateCurrent", at(1, micro=100_000), 6.0), (5, 1, "CurMachSpeed", at(1, micro=500_000), 9.0)]
    routed = spark.createDataFrame(rows, "seq long, id_equipment long, metric_type string, ts_metric timestamp_ntz, value double")
    found = sorted((r.ts_value, r.speed, r.state) for r in ingest.collapse(routed).collect())
    assert found == [(at(1), 4.0, 6.0), (at(1, second=1), 9.0, None)]


def test_split_of_an_odd_length_adds_up(spark):
    e = spark.createDataFrame([(1, at(1), at(1, minute=1, second=1), "MEC")], "id_equipment_event long, ts_event timestamp_ntz, ts_end timestamp_ntz, cd_category string")
    a, b = sorted(events.split(e, "QUA").collect(), key=lambda r: r.piece)
    assert (a.duration, b.duration, a.ts_end, b.ts_event, a.cd_category, b.cd_category) == (30, 31, b.ts_event, at(1, second=30), "MEC", "QUA")


def test_timeline_covers_its_span_and_ties_count_once(spark):
    v = values(spark, (at(1), 1, None, None, 6, None), (at(1), 1, None, None, 10, None), (at(2), 1, None, None, 10, None), (at(3), 1, None, None, 6, None), (at(4), 1, None, None, None, None))
    found = sorted((r.status, r.ts_event, r.ts_end) for r in events.from_states(v).collect())
    assert found == [(6, at(3), None), (10, at(1), at(3))]


def test_overlapping_and_open_runtimes(spark):
    r = spark.createDataFrame([(1, 1, 1, at(1), at(5)), (2, 1, 1, at(2), at(3)), (3, 1, 1, at(4), None), (4, 1, 1, at(9), at(10)), (5, 1, 2, at(1), at(2)), (6, 1, 2, at(2), None)], RUNTIMES)
    assert sorted(x.id_production_order_runtime for x in orders.overlaps(r).collect()) == [2, 3, 4]
    floor = {x.id_production_order_runtime: x.floor for x in joins.runtime_floor(r).collect()}
    assert floor == {1: at(10), 2: at(10), 3: at(10), 4: at(5), 5: None, 6: at(2)}


def test_interval_join_is_half_open_and_crosses_days(spark):
    r = spark.createDataFrame([(1, 1, 1, at(1, 12), at(3, 6)), (2, 1, 1, at(3, 6), None)], RUNTIMES)
    v = values(spark, *((t, 1, 1.0, 0.0, 6, 1.0) for t in (at(1, 11), at(1, 12), at(2, 23), at(3, 6), at(30))), (at(2), 2, 1.0, 0.0, 6, 1.0))
    found = sorted((x.ts_value, x.id_production_order_runtime) for x in joins.values_in_runtimes(v, r).collect())
    assert found == [(at(1, 12), 1), (at(2, 23), 1), (at(3, 6), 2), (at(30), 2)]


def test_shift_that_wraps_the_week(spark):
    shifts = spark.createDataFrame([(1, 1)], "id_shift int, id_site int")
    hours = spark.createDataFrame([(1, 604_800 - 3_600, 7_200)], "id_shift int, begin_time int, end_time int")
    v = values(spark, *((t, 1, 1.0, 0.0, 6, 1.0) for t in (at(7, 22, 59), at(7, 23), at(8, 1, 59), at(8, 2))))  # the 8th is a Monday
    assert sorted(x.ts_value for x in joins.values_in_shifts(v, shifts, hours).collect()) == [at(7, 23), at(8, 1, 59)]


def test_backlog_repeats_an_event_for_each_topic(spark):
    frames = {
        "equipment_events": spark.createDataFrame([(1, 1, at(1), at(2), 10, "")], "id_equipment_event long, id_equipment long, ts_event timestamp_ntz, ts_end timestamp_ntz, status int, cd_category string"),
        "packml_register": spark.createDataFrame([(1, "a"), (1, "b")], "id_equipment long, packml_topic string"),
        "equipments": spark.createDataFrame([(1, "m")], "id_equipment long, nm_equipment string"),
    }
    assert [r.topic for r in events.backlog(Tables(spark, "", frames=frames), Params()).collect()] == ["a", "b"]


def test_null_category_and_null_flags(spark):
    e = spark.createDataFrame(
        [(1, at(1), at(2), 5, None, 10, None), (2, at(1), at(2), None, "", 10, True), (3, at(1), None, None, None, 10, False), (4, at(1), at(2), 5, "MEC", 10, None)],
        "id_equipment_event long, ts_event timestamp_ntz, ts_end timestamp_ntz, duration int, cd_category string, status int, forced_creation_system boolean",
    )
    assert [r.id_equipment_event for r in events.without_short(e, 60).orderBy("id_equipment_event").collect()] == [3, 4]
    assert events.pending_deficit(e, 3).first().value == 2 and events.pending_deficit(e, 0).first().value == 0


def test_free_equipment_ignores_null_keys(spark):
    frames = {
        "equipments": spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id_equipment long, nm_equipment string, tp_equipment int"),
        "production_orders": spark.createDataFrame([(1, 2), (None, 2)], "id_equipment long, status int"),
    }
    assert [r.id_equipment for r in joins.free_equipment(Tables(spark, "", frames=frames)).collect()] == [2]


def test_actions_fold_in_order_and_illegal_steps_are_counted(spark):
    po = spark.createDataFrame([(1, 7, 1), (2, 7, 1)], "id_production_order long, id_equipment long, status int")
    acts = spark.createDataFrame([(1, at(2), 1, "stop-pause"), (2, at(1), 1, "start"), (3, at(3), 1, "start"), (4, at(4), 1, "change-status"), (5, at(1), 2, "start")], "seq long, ts_action timestamp_ntz, id_production_order long, action string")
    found = {r.id_production_order: (r.before, r.after, r.illegal, r.n_actions) for r in orders.fold_actions(po, acts).collect()}
    assert found == {1: (1, 3, 1, 4), 2: (1, 2, 0, 1)}


def test_unused_products_fall_back_to_the_whole_list(spark):
    products = spark.createDataFrame([("a",), ("b",)], "nm string")
    assert {r.nm for r in joins.unused(products, products).collect()} == {"a", "b"}
    assert {r.nm for r in joins.unused(products, spark.createDataFrame([("a",), (None,)], "nm string")).collect()} == {"b"}


def test_label_patterns_are_anchored_and_line_patterns_are_not(spark):
    rows = spark.createDataFrame([("loki",), ("loki-2",)], "service string")
    assert [r.service for r in rows.where(~logs.label("loki|hasura-init")).collect()] == ["loki-2"]


def test_upsert_twice_changes_nothing_and_nulls_keep_what_is_stored(spark, tmp_path):
    target = str(tmp_path / "values")
    make = lambda *rows: spark.createDataFrame(rows, "ts_value timestamp_ntz, id_equipment long, net_production_incr double, scrap_incr double, state int, mode int, speed double, seq long")
    first, second = make((at(1), 1, 5.0, None, 6, 1, 2.0, 1), (at(2), 1, 7.0, None, 6, 1, 2.0, 2)), make((at(1), 1, None, 1.0, 10, None, None, 3))
    for number, batch in ((0, first), (1, second), (1, second)):
        sinks.upsert(batch, target, number)
    shown = lambda path: sorted(tuple(r) for r in sinks.upserted(spark, path).select("ts_value", "net_production_incr", "scrap_incr", "state", "speed").collect())
    want = [(at(1), 5.0, 1.0, 10, 2.0), (at(2), 7.0, None, 6, 2.0)]
    assert shown(target) == want
    late = make((at(1), 1, 9.0, 2.0, 3, 3, 3.0, 2))  # older than what is stored of some metrics, newer than others
    sinks.upsert(late, target, 2)
    assert shown(target) == [(at(1), 9.0, 1.0, 10, 3.0), (at(2), 7.0, None, 6, 2.0)]


def test_upsert_tells_ties_apart(spark, tmp_path):
    rows = spark.createDataFrame([(at(1), 1, 5.0, None, 6, 1, 2.0, 1), (at(1), 1, 4.0, 1.0, 10, 1, 3.0, 1)], "ts_value timestamp_ntz, id_equipment long, net_production_incr double, scrap_incr double, state int, mode int, speed double, seq long")
    for number, batch in enumerate((rows.orderBy("state"), rows.orderBy(F.desc("state")))):
        sinks.upsert(batch.coalesce(1), str(tmp_path / str(number)), 0)
        assert [tuple(r)[2:] for r in sinks.upserted(spark, str(tmp_path / str(number))).collect()] == [(5.0, 1.0, 10, 1, 3.0)]


def test_counter_resets_are_told_from_gaps(spark):
    rows = [(1, 1, at(1), 5.0, 5), (2, 1, at(2), 5.0, 10), (3, 1, at(3), 5.0, 5), (4, 1, at(4), 5.0, 99)]
    counted = spark.createDataFrame(rows, "seq long, id_equipment long, ts_metric timestamp_ntz, value double, counter long")
    assert [r.verdict for r in ingest.counter_check(counted).orderBy("seq").collect()] == ["first", "ok", "reset", "gap"]


def test_spine_includes_both_ends(spark):
    p = Params(t0="2024-01-01 00:30:00", t1="2024-01-01 03:00:00")
    found = series.zero_filled(spark.createDataFrame([(at(1, 1, 15),)], "t timestamp_ntz"), "t", p, n=F.lit(True)).orderBy("time").collect()
    assert [(r.time.hour, r.n) for r in found] == [(0, 0), (1, 1), (2, 0), (3, 0)]
    with pytest.raises(AttributeError):
        Tables(spark, "").nothing


def test_timelines_are_stitched_over_midnights(spark):
    rng = random.Random(4)
    ticks = []
    for equipment in range(12):
        for _ in range(rng.choice([0, 1, 3, 40])):
            ticks.append((equipment, dt(2024, 1, 1) + timedelta(minutes=rng.randrange(6 * 1440)), rng.choice([6, 6, 10] if equipment % 2 else [6])))
    ticks += [(50, dt(2024, 1, 2), 6), (50, dt(2024, 1, 2), 10), (51, dt(2024, 1, 1, 23), 6), (51, dt(2024, 1, 4), 6), (51, dt(2024, 1, 4, 1), 10), (51, dt(2024, 1, 5), 6)]
    runs = []
    for (equipment, at_), group in groupby(sorted(ticks), key=lambda x: x[:2]):
        state = max(x[2] for x in group)
        if runs and runs[-1][:2] == [equipment, state]:
            runs[-1][3], runs[-1][4] = at_, runs[-1][4] + 1
        else:
            runs.append([equipment, state, at_, at_, 1])
    values = spark.createDataFrame(ticks, "id_equipment long, ts_value timestamp_ntz, state int")
    assert sorted(tuple(r) for r in series.state_timeline(values).collect()) == sorted(map(tuple, runs))
    ends = {(r[0], r[2]): after[2] if after[0] == r[0] else None for r, after in zip(runs, [*runs[1:], [None] * 3])}
    found = {(r.id_equipment, r.ts_event): r.ts_end for r in events.from_states(values).collect()}
    assert found == ends


def test_synthetic_ticks_are_repeatable_and_go_back_from_their_end(spark):
    found = sorted(synthetic.ticks(spark, 1000, "2024-01-31 00:00:00").collect())
    assert found == sorted(synthetic.ticks(spark, 1000, "2024-01-31 00:00:00").collect())
    assert found[-1].ts_value == at(31) and found[0].ts_value == at(31) - timedelta(seconds=999) and {r.id_equipment for r in found} == {1, 2}


def test_bus_messages_of_a_file_are_read_as_those_of_a_broker(spark, tmp_path):
    message = '{"timestamp": 1704067200000, "gateway": "edge", "metrics": [{"name": "a/Status/StateCurrent", "value": 6.0}, {"name": "b", "timestamp": 1704067201500, "value": 1.5, "counter": 7}]}'
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.txt").write_text(message + "\nnot json\n")
    stream = spark.readStream.text(str(tmp_path / "in")).select(F.col("value").cast("binary").alias("value"))
    found = sorted(tuple(r) for r in sinks.drained(ingest.explode_metrics(stream)).collect())
    assert found == [("edge", "a/Status/StateCurrent", at(1), 6.0, None, None), ("edge", "b", at(1, 0, 0, 1, 500_000), 1.5, 7, None)]


def test_verdicts_parse_each_message_once_and_tell_what_the_two_parts_hold(spark):
    texts = ['{"timestamp": 1, "metrics": [{"name": "a", "value": 1.5}, null, {"value": 2.0}]}', '{"metrics": [{"name": "b"}, {"name": "c", "timestamp": 5}]}', '{"metrics": []}', "{", None]
    read = ingest.read_messages(spark.createDataFrame([(x,) for x in texts], "value string"))
    found = ingest.verdicts(read)
    assert sorted(str(r.why) for r in found.collect()) == sorted(["None", "None", "no name", "no name", "no time", "no metrics", "malformed", "null"])
    assert {(r.name, r.value) for r in ingest.metrics_of(read).collect()} == {("a", 1.5), ("c", None)}
    dead = {(r.why, r.raw) for r in ingest.dead_letters(read).collect()}
    assert dead == {("no name", None), ("no name", '{"value":2.0}'), ("no time", '{"name":"b"}'), ("no metrics", '{"metrics": []}'), ("malformed", "{"), ("null", None)}
    for df in (found, ingest.metrics_of(read), ingest.dead_letters(read)):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1
