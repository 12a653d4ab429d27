"""Brute-force agreement, invariants, skew and plan shape on the driver's tables."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from tests.frames import at, fleet, rows, table
from wakeline.functions import sizing
from wakeline.functions.spine import spine
from wakeline.operators import (
    consumption,
    fleet as fleet_ops,
    positions,
    reports,
    series,
    snapshot,
    status,
    weather,
)
from wakeline.plans import inventory as inv
from wakeline.sources.fixtures import FixtureTables


def plan(frame) -> str:
    return frame._jdf.queryExecution().toString().split("== Physical Plan ==")[-1]


# Track against brute force


def nearest_headings(points, headings):
    """The definition, one point at a time."""
    by_vessel = defaultdict(dict)
    for vessel, moment, ident, course in sorted(headings, key=lambda h: h[2]):
        by_vessel[vessel][moment] = float(course)
    found = []
    for vessel, moment, lat, long in points:
        known = by_vessel[vessel]
        times = sorted(known)
        back = bisect_right(times, moment) - 1
        ahead = bisect_left(times, moment)
        if back < 0 and ahead == len(times):
            course = 0.0
        elif back < 0:
            course = known[times[ahead]]
        elif ahead == len(times) or moment - times[back] <= times[ahead] - moment:
            course = known[times[back]]
        else:
            course = known[times[ahead]]
        found.append((vessel, moment, float(lat), float(long), course))
    return found


@pytest.mark.parametrize("slice_minutes", [11, 60, 1440])
def test_track_agrees_with_brute_force(tables, slice_minutes):
    start, end = at("09 12:34"), at("13 03:21")
    everything = tables.interp.select(
        "vessel_id", "nr_time", "id", "latitude", "longitude", "course"
    ).collect()
    inside = [r for r in everything if start <= r["nr_time"] <= end]
    points = {
        (r["vessel_id"], r["nr_time"], r["latitude"], r["longitude"], r["course"])
        for r in inside
        if r["latitude"] is not None and r["longitude"] is not None
    }
    headings = [
        (r["vessel_id"], r["nr_time"], r["id"], r["course"])
        for r in inside
        if r["course"] is not None
    ]
    before = {}
    for r in everything:
        if r["course"] is not None and r["nr_time"] < start:
            key = (r["nr_time"], r["id"])
            if r["vessel_id"] not in before or key > before[r["vessel_id"]][0]:
                before[r["vessel_id"]] = (key, r["course"])
    headings += [(v, k[0], k[1], course) for v, (k, course) in before.items()]
    expected = sorted(nearest_headings([p[:4] for p in points], headings))
    found = positions.track(tables.interp, start, end, slice_minutes=slice_minutes)
    assert rows(found, "vessel_id", "timestamp", "lat", "long", "direction") == expected
    assert expected


# Invariants


def test_spine_length(tables):
    found = series.main_series(tables.interp, tables.vessel, inv.START, inv.END, 60)
    points = (inv.END - inv.START) // timedelta(minutes=60) + 1
    per_vessel = found.where("engine = 'total'").groupBy("vessel_id").count()
    assert {r["count"] for r in per_vessel.collect()} == {points}
    assert per_vessel.count() == tables.vessel.count()


def test_series_keep_every_drop_of_fuel(tables):
    found = series.main_series(tables.interp, tables.vessel, inv.START, inv.END, 6)
    total = found.where("engine = 'total'").agg(F.sum(F.col("fuel_cons") * 6)).collect()[0][0]
    window = tables.interp.where(F.col("nr_time").between(inv.START, inv.END))
    fuel = sum((F.coalesce(f"me{n}_consumption", F.lit(0)) for n in (1, 2, 3)), F.lit(0))
    assert total == pytest.approx(float(window.agg(F.sum(fuel)).collect()[0][0]))


def test_utilisation_adds_up(tables):
    found = status.utilisation(tables.vps, tables.position_status, inv.START, inv.END)
    for row in found.collect():
        assert sum(row[c] for c in status.STATUS_CLASSES) in (0, pytest.approx(100))


def test_weather_grid_keys_are_unique(tables):
    assert tables.weather.groupBy("time", "lat", "long").count().where("count > 1").count() == 0


@pytest.mark.parametrize("name", ["P1_track", "U2_page", "C4_daily_consumption", "D6_redate_daily"])
def test_partitioning_does_not_change_results(spark, data_folder, name):
    query = driver.queries()[name]
    results = []
    for partitions, adaptive in (("1", "true"), ("13", "false")):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        try:
            results.append(sorted(query(spark, data_folder).collect(), key=repr))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
            spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert results[0] == results[1]


@pytest.mark.parametrize("name", ["P5_fleet_positions", "R4_engine_sensors", "T2_latest_speed", "U2_page"])
def test_results_hold_without_any_broadcast(spark, data_folder, monkeypatch, name):
    query = driver.queries()[name]
    expected = sorted(query(spark, data_folder).collect(), key=repr)
    monkeypatch.setattr(sizing, "BROADCAST_ROWS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        frame = query(spark, data_folder)
        assert "BroadcastHashJoin" not in plan(frame)
        assert sorted(frame.collect(), key=repr) == expected
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


# Skew


def test_one_vessel_with_most_rows_stays_split(spark):
    """A vessel with nearly all rows: windows run per hour, never per vessel."""
    hot = spark.range(0, 60_000).selectExpr(
        "id",
        "cast(case when id % 50 = 0 then id % 7 + 2 else 1 end as bigint) as vessel_id",
        "timestamp_ntz'2024-01-05' + make_dt_interval(0, 0, cast(id % 10000 as int)) as nr_time",
        "cast(case when id % 3 = 0 then id % 90 end as decimal(9,4)) as latitude",
        "cast(case when id % 3 = 0 then id % 180 end as decimal(9,4)) as longitude",
        "cast(case when id % 3 = 1 then id % 360 end as decimal(9,4)) as course",
    )
    found = positions.track(hot, at("05 00:00"), at("12 00:00"))
    text = plan(found)
    big_windows = re.findall(r"windowspecdefinition\((vessel_id.*?), nr_time", text)
    assert len(big_windows) == 2 and all("track_slice" in keys for keys in big_windows)
    expected = (
        hot.where("latitude is not null")
        .select("vessel_id", "nr_time", "latitude", "longitude", "course")
        .distinct()
        .count()
    )
    assert found.count() == expected


def test_the_grid_of_a_fleet_is_built_by_many_tasks(spark):
    vessels = spark.range(1000).coalesce(1)
    grid = spine(vessels, at("05 00:00"), at("12 00:00"), 60)
    sizes = [r["count"] for r in grid.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and sum(sizes) == 1000 * (7 * 24 + 1)
    assert max(sizes) < 2 * sum(sizes) / len(sizes)


def test_copies_are_collapsed_before_the_shuffle(spark):
    copies = spark.range(0, 50_000).selectExpr(
        "id",
        "cast(1 as bigint) as vessel_id",
        "timestamp_ntz'2024-01-05' as nr_time",
        "cast(1 as decimal(9,4)) as latitude",
        "cast(2 as decimal(9,4)) as longitude",
        "cast(3 as decimal(9,4)) as course",
    )
    found = positions.track(copies, at("05 00:00"), at("06 00:00"))
    assert [tuple(r)[2:] for r in found.collect()] == [(1.0, 2.0, 3.0)]


# Plans


def test_newest_images_are_limited_before_the_shuffle(tables):
    text = plan(fleet_ops.newest_images(tables.image))
    assert text.index("Final") < text.index("Exchange") < text.index("Partial")


def test_no_query_uses_python_or_a_nested_loop_over_facts(spark, data_folder):
    for name, query in inv.queries().items():
        text = plan(query(spark, data_folder))
        assert "Python" not in text and "ArrowEval" not in text, name
        assert "BroadcastNestedLoopJoin BuildRight, LeftOuter" not in text, name


@pytest.mark.parametrize("ident", ["P1", "P2", "P4", "R5", "C2", "C3"])
def test_latest_rows_are_found_without_sorting_the_facts(spark, data_folder, ident):
    found = [q for name, q in inv.queries().items() if name.startswith(f"{ident}_")]
    assert found
    for query in found:
        text = plan(query(spark, data_folder))
        assert "HashAggregate" in text and "SortAggregate" not in text


def test_daily_consumption_aggregates_before_the_weather_join(tables):
    text = plan(consumption.daily_consumption(tables.interp, tables.weather, inv.START, inv.END))
    join = text.index("LeftOuter")
    assert "partial_count(1)" in text[join:]


# Recent rows first


def scans(frame) -> int:
    return len(re.findall(r"Scan parquet|FileScan", frame._jdf.queryExecution().executedPlan().toString()))


def test_recent_first_gives_the_same_answers(tables):
    t, since = tables, at("30 20:00")
    pairs = [
        (positions.latest_position, (t.interp,)),
        (positions.latest_ais, (t.ais, t.vessel)),
        (series.latest_speed, (t.interp, t.vessel)),
        (weather.latest_weather, (t.unified, t.weather)),
        (weather.weather_resistance, (t.interp, t.weather)),
        (status.latest_status, (t.vps, t.position_status, t.gis_point, t.gis_point_type)),
    ]
    for operator, arguments in pairs:
        named = {} if t.vessel in arguments else {"vessel": t.vessel}
        whole = sorted(operator(*arguments, **named).collect(), key=repr)
        quick = sorted(operator(*arguments, **named, since=since).collect(), key=repr)
        assert quick == whole, operator.__name__
        assert whole
    whole, quick = (
        sorted(snapshot.last_positive_run_hours(t.unified, None, t.vessel, s).collect(), key=repr)
        for s in (None, since)
    )
    assert quick == whole and whole
    names = (t.vessel, t.customer, t.fleet_type, t.interp, t.ais, t.vps, t.position_status)
    whole, quick = (
        sorted(positions.fleet_positions(*names, since=s).collect(), key=repr)
        for s in (None, since)
    )
    assert quick == whole
    window = (at("09 00:00"), at("10 00:00"))
    whole, quick = (
        sorted(positions.track(t.interp, *window, vessel=t.vessel, since=s).collect(), key=repr)
        for s in (None, at("08 22:00"))
    )
    assert quick == whole


def test_recent_first_skips_the_archive_when_all_reported(spark, tmp_path):
    readings = [
        {"id": i, "vessel_id": i % 3, "nr_time": at(f"{5 + i:02d} 00:00"), "latitude": i, "longitude": 1, "course": 1}
        for i in range(9)
    ]
    table(spark, "interp", readings).write.parquet(str(tmp_path / "interp"))
    interp = spark.read.parquet(str(tmp_path / "interp"))
    found = positions.latest_position(interp, None, fleet(spark, 0, 1, 2), at("10 00:00"))
    assert [r["lat"] for r in found.orderBy("vessel_id").collect()] == [6.0, 7.0, 8.0]
    frame = found.orderBy("vessel_id")
    before = scans(frame)
    frame.collect()
    final = frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(re.findall("FileScan parquet", final)) < before
    with pytest.raises(ValueError):
        positions.latest_position(interp, since=at("10 00:00"))


def test_page_reads_only_its_own_instants(tables):
    text = plan(
        reports.page(
            tables.interp, tables.device, tables.canbus, tables.vessel, inv.START, inv.END, 1, 20
        )
    )
    assert "LeftSemi" in text


def test_fixture_tables_reject_unknown_names(spark, data_folder):
    with pytest.raises(AttributeError):
        FixtureTables(spark, data_folder).no_such_table


def test_composites_survive_a_vessel_without_data(spark, tables):
    t = tables
    found = snapshot.vessel_snapshot(
        t.vessel, t.interp, t.unified, t.ais, t.weather, t.device, t.engine, t.canbus, t.vps,
        t.position_status, t.gis_point, t.gis_point_type, inv.AS_OF, inv.FRESH_MINUTES, [99],
    )
    row = found.collect()[0]
    assert row["vessel_id"] == 99 and row["position"] is None and row["status"] is None
