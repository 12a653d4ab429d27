"""Rollups against the operators over the facts, and loads that are repeated or break off."""

from __future__ import annotations

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tests.frames import at, fleet, table
from wakeline.operators import consumption, deident, reports, rollups, series
from wakeline.plans import loads as batches

START, END = at("03 10:07"), at("06 17:31")


def telemetry(spark, name, n=400, seed=1):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        row = {"id": k, "vessel_id": rng.choice((1, 1, 2, None)), "nr_time": at("02") + timedelta(seconds=rng.randrange(6 * 86400))}
        for c in ("average_speed_gps", "speed_through_water", "me1_consumption", "me2_consumption", "ae1_consumption",
                  "ae1_energy_produced", "me1_run_hours", "me3_run_hours", "latitude", "longitude"):
            if rng.random() < 0.7:
                row[c] = round(rng.uniform(0, 20), 2)
        rows.append(row)
    # Rows at one instant, at midnight and on the window's ends.
    for k, moment in enumerate((at("04"), at("04"), at("06"), START, END, END)):
        rows.append({"id": n + k, "vessel_id": 1, "nr_time": moment, "me1_run_hours": k, "me1_consumption": k, "average_speed_gps": k})
    return table(spark, name, rows)


def same(a, b):
    read = lambda f: sorted(map(repr, f.select(*sorted(f.columns)).collect()))
    assert a.schema.names == b.schema.names
    assert read(a) == read(b)


@pytest.fixture(scope="module")
def facts(spark):
    interp = telemetry(spark, "interp").cache()
    unified = telemetry(spark, "unified", seed=2).cache()
    weather = table(spark, "weather", [
        {"time": at("04") + timedelta(hours=h), "lat": x / 10, "long": 1.0, "beaufourt": h % 7, "dss": x % 5}
        for h in range(0, 48, 5) for x in range(0, 200, 3)
    ])
    return interp, unified, weather, fleet(spark, 1, 2, 3)


WINDOWS = [(START, END), (at("03"), at("06")), (at("04 10:01"), at("04 10:05"))]


@pytest.mark.parametrize("start,end", WINDOWS)
def test_series_and_run_hours(facts, start, end):
    interp, unified, _, vessel = facts
    for minutes in (6, 60):
        args = (interp, vessel, start, end, minutes)
        same(rollups.speed_series(rollups.SPEED.build(interp), *args), series.speed_series(*args))
    same(rollups.main_series(rollups.MAIN_FUEL.build(interp), *args), series.main_series(*args))
    same(rollups.aux_series(rollups.AUX_FUEL.build(interp), *args, [1]), series.aux_series(*args, [1]))
    hours = rollups.RUN_HOURS.build(unified)
    args = (unified, start, end, None, vessel)
    same(rollups.run_hour_delta(hours, *args), consumption.run_hour_delta(*args))
    same(rollups.last_run_hours(hours, *args), consumption.last_run_hours(*args))


def test_daily_answers(spark, facts):
    interp, _, weather, vessel = facts
    args = (interp, weather, START, END, None, vessel)
    same(rollups.daily_consumption(rollups.DAILY.build(interp), *args), consumption.daily_consumption(*args))
    fuel = table(spark, "total_fuel", [{"vessel_id": 1 + k % 2, "date_hour": at("03") + timedelta(hours=k), "consumption": k} for k in range(60)])
    days = (date(2024, 1, 3), date(2024, 1, 4))
    same(rollups.daily_fuel(rollups.FUEL_DAY.build(fuel), fuel, *days), reports.daily_fuel(fuel, *days))
    same(rollups.daily_fuel(rollups.FUEL_DAY.build(fuel), fuel), reports.daily_fuel(fuel))


def test_whole_periods_come_from_the_states(facts):
    interp, *_ = facts
    states = rollups.SPEED.build(interp).limit(0)
    found = rollups.SPEED.window(states, interp, START, END)
    # Without states only the two ends are left.
    assert {r["period"] for r in found.collect()} <= {at("03 10:06"), at("06 17:30")}
    assert found.count() > 0


def test_bins_have_to_be_made_of_periods(facts):
    interp, _, _, vessel = facts
    with pytest.raises(ValueError, match="7 minutes"):
        rollups.speed_series(rollups.SPEED.build(interp), interp, vessel, START, END, 7)
    with pytest.raises(ValueError, match="divide"):
        rollups.Rollup("x", "interp", "nr_time", ("vessel_id",), 7, {})


def test_late_and_repeated_loads(spark, facts, tmp_path):
    interp, _, _, vessel = facts
    root = str(tmp_path)
    args = (vessel, START, END, 60)
    assert batches.read_rollup(spark, root, rollups.SPEED).count() == 0
    assert batches.refresh(spark, root, rollups.SPEED) == 0
    # Three loads out of order, each with rows of many days; one comes twice.
    parts = [interp.where(F.col("id") % 3 == k) for k in (2, 0, 1)]
    seen = interp.limit(0)
    for k, part in enumerate(parts):
        assert batches.append_batch(part, root, "interp", f"load-{k}")
        assert not batches.append_batch(part, root, "interp", f"load-{k}")
        touched = part.select(F.to_date("nr_time")).distinct().count()
        assert batches.refresh(spark, root, rollups.SPEED) == touched
        assert batches.refresh(spark, root, rollups.SPEED) == 0
        seen = seen.unionByName(part)
        stored = batches.read_batches(spark, root, "interp")
        assert stored.count() == seen.count()
        states = batches.read_rollup(spark, root, rollups.SPEED)
        same(rollups.speed_series(states, stored, *args), series.speed_series(seen, *args))
    # A late row touches one day alone.
    late = interp.limit(1).withColumns({"id": F.lit(9999).cast("bigint"), "nr_time": F.lit(at("04 03:00"))})
    batches.append_batch(late, root, "interp", "late")
    assert batches.pending_days(spark, root, rollups.SPEED).count() == 1
    assert batches.refresh(spark, root, rollups.SPEED) == 1


def test_a_load_that_breaks_off(spark, facts, tmp_path, monkeypatch):
    interp, *_ = facts
    root = str(tmp_path)
    first, second = interp.where("id < 100"), interp.where("id >= 100")
    batches.append_batch(first, root, "interp", "a")

    def stop(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as broken:
        broken.setattr(batches, "publish", stop)
        with pytest.raises(KeyboardInterrupt):
            batches.append_batch(second.limit(50), root, "interp", "b")
    # Staged rows are not seen, and the second try replaces them.
    assert batches.read_batches(spark, root, "interp").count() == first.count()
    assert batches.append_batch(second, root, "interp", "b")
    assert batches.read_batches(spark, root, "interp").count() == interp.count()
    # A refresh that broke off before its note is done again, with the same states.
    batches.refresh(spark, root, rollups.RUN_HOURS)
    batches.refresh(spark, root, rollups.SPEED)
    once = sorted(map(repr, batches.read_rollup(spark, root, rollups.SPEED).collect()))
    with monkeypatch.context() as broken:
        broken.setattr(batches, "_log", lambda s, p: s.createDataFrame([], batches._LOG) if "_rolled" in p else _real(s, p))
        batches.refresh(spark, root, rollups.SPEED)
    assert sorted(map(repr, batches.read_rollup(spark, root, rollups.SPEED).collect())) == once
    assert not batches.append_batch(interp.limit(0), root, "interp", "a")
    assert batches.append_batch(interp.limit(0), root, "interp", "none")
    assert batches.read_batches(spark, root, "interp").count() == interp.count()
    with pytest.raises(ValueError, match="batch id"):
        batches.append_batch(first, root, "interp", "../x")


_real = batches._log


def test_vessel_ids_go_on(spark, tmp_path):
    root = str(tmp_path)
    listed = spark.createDataFrame([(k, 9_100_000 + k, f"N{k}") for k in (3, 1, 2)], "line int, imo long, name string")
    assert batches.append_vessels(listed, root, "line", {"customer_id": 1}, "one")
    assert not batches.append_vessels(listed, root, "line", {"customer_id": 1}, "one")
    assert batches.append_vessels(listed.where("line < 3"), root, "line", {"customer_id": 2}, "two")
    found = batches.read_batches(spark, root, "vessel").orderBy("id").collect()
    first = deident.FIRST_IMPORT_ID
    assert [(r["id"], r["imo"], r["customer_id"]) for r in found] == [
        (first, 9_100_001, 1), (first + 1, 9_100_002, 1), (first + 2, 9_100_003, 1),
        (first + 3, 9_100_001, 2), (first + 4, 9_100_002, 2),
    ]
