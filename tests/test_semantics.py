"""The decided semantics, one small case each."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.frames import at, fleet, rows, table
from wakeline.functions import times
from wakeline.functions.weather import added_resistance
from wakeline.operators import fleet as fleet_ops
from wakeline.operators import (
    alerts,
    consumption,
    deident,
    links,
    positions,
    reports,
    series,
    snapshot,
    status,
    weather,
)

# Time


def test_time_bin_uses_the_origin(spark):
    frame = spark.createDataFrame(
        [(at("05 00:20"),), (datetime(2022, 12, 31, 23, 59),)], "t timestamp_ntz"
    )
    seven = [r[0] for r in frame.select(times.time_bin("t", 7)).collect()]
    for moment, found in zip([at("05 00:20"), datetime(2022, 12, 31, 23, 59)], seven):
        assert found <= moment < found + timedelta(minutes=7)
        assert (found - times.BIN_ORIGIN) % timedelta(minutes=7) == timedelta(0)
        assert times.floor_to_grid(moment, 7) == found


def test_time_bin_ignores_the_session_zone(spark):
    frame = spark.createDataFrame([(datetime(2024, 3, 10, 2, 30),)], "t timestamp_ntz")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        found = frame.select(
            times.hour_of("t").alias("h"), times.epoch_seconds(F.col("t")).alias("s")
        ).collect()[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert found["h"] == datetime(2024, 3, 10, 2)
    assert found["s"] == 1710037800


def test_moments_may_be_epoch_seconds():
    assert times.as_datetime(1704412800) == at("05 00:00")
    assert times.default_window(at("08 00:00"))[0] == at("01 00:00")


# Track


def track(spark, readings, start="05 00:00", end="06 00:00", **options):
    interp = table(spark, "interp", readings)
    return rows(
        positions.track(interp, at(start), at(end), **options), "timestamp", "lat", "direction"
    )


def point(i, t, lat=None, course=None, long=1, vessel=1):
    return {
        "id": i,
        "vessel_id": vessel,
        "nr_time": at(t),
        "latitude": lat,
        "longitude": long if lat is not None else None,
        "course": course,
    }


def test_track_prefers_the_earlier_of_two_equally_near(spark):
    found = track(
        spark,
        [point(1, "05 10:00", course=10), point(2, "05 10:02", course=20), point(3, "05 10:01", 5)],
    )
    assert found == [(at("05 10:01"), 5.0, 10.0)]


def test_track_reaches_over_slices_in_both_directions(spark):
    readings = [
        point(1, "05 01:00", course=10),
        point(2, "05 08:00", 1),
        point(3, "05 16:00", 2),
        point(4, "05 20:00", course=90),
    ]
    expected = [(at("05 08:00"), 1.0, 10.0), (at("05 16:00"), 2.0, 90.0)]
    assert track(spark, readings) == expected
    assert track(spark, readings, slice_minutes=7) == expected
    assert track(spark, readings, slice_minutes=100_000) == expected


def test_track_uses_the_last_course_before_the_window_only(spark):
    readings = [
        point(1, "04 20:00", course=33),
        point(2, "04 22:00", course=44),
        point(3, "05 01:00", 1),
        point(4, "06 01:00", course=99),
    ]
    assert track(spark, readings) == [(at("05 01:00"), 1.0, 44.0)]


def test_track_without_any_heading_reads_zero(spark):
    assert track(spark, [point(1, "05 01:00", 1)]) == [(at("05 01:00"), 1.0, 0.0)]


def test_track_takes_the_highest_id_among_headings_of_one_instant(spark):
    readings = [
        point(7, "05 02:00", course=70),
        point(8, "05 02:00", course=80),
        point(9, "05 01:59", 1),
        point(10, "05 02:01", 2),
    ]
    assert [r[2] for r in track(spark, readings)] == [80.0, 80.0]


def test_track_collapses_identical_points_and_needs_both_coordinates(spark):
    half = point(4, "05 03:00", 9, 1)
    half["longitude"] = None
    readings = [point(1, "05 01:00", 1, 5), point(2, "05 01:00", 1, 5), point(3, "05 01:00", 1, 6), half]
    assert track(spark, readings) == [(at("05 01:00"), 1.0, 6.0)] * 2


def test_latest_position_falls_back_to_the_latest_course(spark):
    interp = table(
        spark,
        "interp",
        [
            point(1, "05 01:00", 1, 11),
            point(2, "05 02:00", 2),
            point(3, "05 02:00", 3),
            point(4, "05 01:30", course=22),
            point(5, "05 01:00", 7, vessel=2),
        ],
    )
    found = rows(positions.latest_position(interp), "vessel_id", "lat", "direction")
    assert found == [(1, 3.0, 22.0), (2, 7.0, 0.0)]


def test_latest_ais_by_mmsi_without_imo(spark):
    vessel = fleet(spark, 1, 2).withColumn("imo", F.when(F.col("id") == 1, F.col("imo")))
    ais = table(
        spark,
        "ais",
        [
            {"id": 1, "vessel_id": 1, "report_datetime": at("05 01:00"), "latitude": 1, "longitude": 1},
            {"id": 2, "vessel_id": 2, "report_datetime": at("05 01:00"), "latitude": 2, "longitude": 1},
            {"id": 3, "vessel_id": 2, "report_datetime": at("05 02:00"), "latitude": 3},
        ],
    )
    found = rows(positions.latest_ais(ais, vessel), "id_type", "id_number", "lat")
    assert found == [("imo", 9000001, 1.0), ("mmsi", 533000002, 2.0)]


def test_fleet_positions_one_row_per_source(spark):
    vessel = fleet(spark, 1, 2)
    customer = spark.createDataFrame([(1, "ACME")], "id long, name string")
    kinds = spark.createDataFrame([(0, "offshore")], "id long, name string")
    states = spark.createDataFrame([(1, "port", "")], "id long, name string, description string")
    interp = table(spark, "interp", [point(1, "05 01:00", 1), point(2, "05 01:00", 2)])
    ais = table(
        spark,
        "ais",
        [{"id": 1, "vessel_id": 1, "report_datetime": at("05 03:00"), "latitude": 9, "longitude": 9}],
    )
    reported = table(
        spark, "vps", [{"id": 1, "vessel_id": 1, "report_datetime": at("05 01:00"), "status": 1}]
    )
    found = positions.fleet_positions(vessel, customer, kinds, interp, ais, reported, states)
    assert rows(found, "vessel_id", "source", "lat", "direction", "position_status") == [
        (1, "ais", 9.0, None, "None"),
        (1, "internal", 2.0, 0.0, "port"),
        (2, None, None, None, "None"),
    ]
    folded = positions.fold_sources(found)
    assert rows(folded, "vessel_id", "position.lat", "ais_position.lat", "position_status") == [
        (1, 2.0, 9.0, "port"),
        (2, None, None, "None"),
    ]
    nobody = positions.fleet_positions(
        vessel, customer, kinds, interp, ais, reported, states, "OTHER"
    )
    assert nobody.count() == 0


# Series


def fuel(i, t, vessel=1, **values):
    return {"id": i, "vessel_id": vessel, "nr_time": at(t), **values}


def test_series_fill_gaps_and_centre(spark):
    interp = table(
        spark,
        "interp",
        [
            fuel(1, "05 00:10", me1_consumption=30),
            fuel(2, "05 00:50", me1_consumption=30, me2_consumption=60),
            fuel(3, "05 02:00", me3_consumption=6),
            fuel(4, "05 01:00", ae1_consumption=6),
        ],
    )
    found = series.main_series(interp, fleet(spark, 1, 2), at("05 00:00"), at("05 02:00"))
    assert found.count() == 2 * 3 * 4
    assert rows(found.where("vessel_id = 1 and engine = 'total'"), "timestamp", "fuel_cons") == [
        (at("05 00:30"), 2.0),
        (at("05 01:30"), 0.0),
        (at("05 02:30"), 0.1),
    ]
    assert found.where("vessel_id = 2").agg(F.sum("fuel_cons")).collect()[0][0] == 0


def test_off_grid_start_still_meets_its_bins(spark):
    interp = table(spark, "interp", [fuel(1, "05 00:40", average_speed_gps=10)])
    found = series.speed_series(interp, fleet(spark, 1), at("05 00:17"), at("05 02:00"), 60)
    assert rows(found, "timestamp", "sog", "stw") == [
        (at("05 00:00"), 10.0, 0.0),
        (at("05 01:00"), 0.0, 0.0),
        (at("05 02:00"), 0.0, 0.0),
    ]


def test_one_minute_bins_are_centred_on_the_half_minute(spark):
    interp = table(spark, "interp", [fuel(1, "05 00:00", ae2_consumption=3, ae2_energy_produced=4)])
    found = series.aux_series(interp, fleet(spark, 1), at("05 00:00"), at("05 00:00"), 1)
    assert rows(found.where("engine = 'ae2'"), "timestamp", "fuel_cons", "power") == [
        (datetime(2024, 1, 5, 0, 0, 30), 3.0, 4.0)
    ]


def test_spine_is_the_same_in_chunks(spark, monkeypatch):
    from wakeline.functions import spine as grid

    vessel, window = fleet(spark, 1, 2), (at("05 00:03"), at("06 00:00"), 6)
    whole = rows(grid.spine(vessel, *window), "vessel_id", "bin")
    monkeypatch.setattr(grid, "CHUNK_POINTS", 17)
    assert rows(grid.spine(vessel, *window), "vessel_id", "bin") == whole
    assert len(whole) == 2 * 241
    assert grid.spine(vessel, at("06 00:00"), at("05 00:00"), 60).count() == 0


def test_latest_speed_averages_its_bin(spark):
    interp = table(
        spark,
        "interp",
        [
            fuel(1, "05 00:00", average_speed_gps=1),
            fuel(2, "05 00:10", average_speed_gps=4),
            fuel(3, "05 00:10", average_speed_gps=8),
            fuel(4, "05 00:11"),
        ],
    )
    found = series.latest_speed(interp, fleet(spark, 1))
    assert rows(found, "timestamp", "sog", "stw") == [(at("05 00:10"), 6.0, None)]


def devices(spark):
    return table(
        spark,
        "device",
        [
            {"device_id": 1, "vessel_id": 1, "engine_id": 1, "device_type_id": 1, "label_name": "ME1", "is_active": True},
            {"device_id": 2, "vessel_id": 1, "engine_id": 2, "device_type_id": 4, "label_name": "ME2", "is_active": True},
            {"device_id": 3, "vessel_id": 1, "engine_id": 3, "device_type_id": 2, "label_name": "AE1", "is_active": True},
            {"device_id": 4, "vessel_id": 1, "device_type_id": 3, "label_name": "NMEA", "is_active": True},
            {"device_id": 5, "vessel_id": 1, "device_type_id": 1, "label_name": "SPARE", "is_active": True},
            {"device_id": 6, "vessel_id": 1, "engine_id": 4, "device_type_id": 1, "label_name": "ME3", "is_active": False},
        ],
    )


def engines(spark):
    return table(
        spark,
        "engine",
        [
            {"id": i, "vessel_id": 1, "type": kind, "label": kind, "running_hours": hours}
            for i, kind, hours in ((1, "ME1", 100), (2, "ME2", 0), (3, "AE1", 50), (4, "ME3", 10))
        ],
    )


def canbus(i, device, t, **values):
    return {"id": i, "device_id": device, "message_datetime": at(t), **values}


def test_engine_params_belong_to_the_asked_engine(spark):
    interp = table(spark, "interp", [fuel(1, "05 00:00", me1_consumption=3), fuel(2, "05 00:01")])
    bus = table(spark, "canbus", [canbus(1, 1, "05 00:00", me_rpm=700), canbus(2, 2, "05 00:00", me_rpm=900)])
    window = (at("05 00:00"), at("05 01:00"))
    found = series.engine_params(interp, bus, devices(spark), "ME1", ["rpm", "cons"], *window)
    assert rows(found, "param", "timestamp", "value") == [
        ("cons", at("05 00:00"), 3.0),
        ("cons", at("05 00:01"), None),
        ("rpm", at("05 00:00"), 700.0),
    ]
    none = series.engine_params(interp, bus, devices(spark), "AE1", ["rpm", "cons"], *window)
    assert none.count() == 0
    with pytest.raises(ValueError):
        series.engine_params(interp, bus, devices(spark), "ME1", ["torque"], *window)


def test_engine_playback_keeps_every_row(spark):
    interp = table(spark, "interp", [fuel(i, f"05 00:{i:02d}", me1_consumption=i) for i in range(40)])
    bus = table(spark, "canbus", [canbus(i, 1, f"05 00:{i:02d}", me_rpm=i) for i in range(0, 60, 2)])
    found = series.engine_playback(
        interp, bus, devices(spark), engines(spark), "me1", at("05 00:00"), at("05 01:00")
    )
    assert found.count() == 30
    assert found.where("fuel_cons = rpm").count() == 20
    assert found.where("fuel_cons is null").count() == 10


# Snapshot


def test_most_complete_row_then_newest(spark):
    interp = table(
        spark,
        "interp",
        [
            fuel(1, "05 00:00", me1_consumption=1, ae1_consumption=1, latitude=1),
            fuel(2, "05 00:01", me1_consumption=1, ae1_consumption=1, latitude=2),
            fuel(3, "05 00:02", me1_consumption=1, ae1_consumption=0, latitude=3),
            fuel(4, "05 00:20", me1_consumption=1, ae1_consumption=1, latitude=4),
            fuel(5, "04 00:00", me1_consumption=1, vessel=2),
        ],
    )
    fresh = snapshot.fresh(interp, at("05 00:15"), 16)
    found = snapshot.most_complete(fresh)
    assert rows(found, "vessel_id", "timestamp", "score") == [(1, at("05 00:01"), 3)]
    assert snapshot.fresh(interp, at("05 00:15")).count() == 2


def test_engine_real_time_falls_back_on_run_hours(spark):
    interp = table(spark, "interp", [fuel(1, "05 00:00", me1_consumption=1, ae1_consumption=0)])
    unified = table(
        spark,
        "unified",
        [
            fuel(1, "04 00:00", me2_run_hours=70),
            fuel(2, "04 01:00", me2_run_hours=0),
            fuel(3, "04 02:00", me1_run_hours=5, vessel=2),
        ],
    )
    bus = table(spark, "canbus", [canbus(1, 1, "05 00:00", me_rpm=1), canbus(2, 1, "05 00:00", me_rpm=2)])
    found = snapshot.engine_real_time(
        interp, unified, devices(spark), engines(spark), bus, at("05 00:10")
    )
    chosen = found.where("engine in ('me1', 'me2', 'ae1')")
    assert rows(chosen, "vessel_id", "engine", "is_running", "rpm", "running_hour", "running_hours_timestamp") == [
        (1, "ae1", False, None, None, None),
        (1, "me1", True, 2.0, 100.0, None),
        (1, "me2", False, None, 70.0, at("04 00:00")),
        (2, "me1", False, None, 5.0, at("04 02:00")),
    ]


# Status


def states(spark):
    names = ["port", "offshore ops", "awaiting_data", "drydock"]
    return spark.createDataFrame(
        [(i, n, n) for i, n in enumerate(names)], "id long, name string, description string"
    )


def test_utilisation_shares(spark):
    reports_ = [(1, 0), (1, 1), (1, 1), (1, 2), (1, 3), (2, 3)]
    vps = table(
        spark,
        "vps",
        [
            {"id": i, "vessel_id": v, "status": s, "report_datetime": at("05 00:00")}
            for i, (v, s) in enumerate(reports_)
        ],
    )
    found = status.utilisation(vps, states(spark), at("05 00:00"), at("05 00:00"))
    assert rows(found, "vessel_id", "port", "offshore_ops", "awaiting_data", "other") == [
        (1, 25.0, 50.0, 25.0, 0.0),
        (2, 0.0, 0.0, 0.0, 0.0),
    ]


def test_latest_status_needs_a_point_and_data(spark):
    vps = table(
        spark,
        "vps",
        [
            {"id": 1, "vessel_id": 1, "status": 0, "report_datetime": at("05 00:00"), "gis_point_id": 1},
            {"id": 2, "vessel_id": 1, "status": 1, "report_datetime": at("05 00:00"), "gis_point_id": 1},
            {"id": 3, "vessel_id": 1, "status": 2, "report_datetime": at("05 01:00"), "gis_point_id": 1},
            {"id": 4, "vessel_id": 1, "status": 0, "report_datetime": at("05 02:00")},
            {"id": 5, "vessel_id": 1, "status": 0, "report_datetime": at("05 03:00"), "gis_point_id": 7},
        ],
    )
    points = table(spark, "gis_point", [{"id": 1, "name": "P", "gis_point_type_id": 1}])
    kinds = table(spark, "gis_point_type", [{"id": 1, "name": "oil"}])
    found = status.latest_status(vps, states(spark), points, kinds)
    assert rows(found, "timestamp", "status_name", "gis_point_type") == [
        (at("05 00:00"), "offshore ops", "oil")
    ]


# Weather


def test_weather_joins_on_rounded_cell_and_hour(spark):
    unified = table(
        spark,
        "unified",
        [
            fuel(1, "05 10:59", latitude=1.25, longitude=-1.25),
            fuel(2, "05 11:00", latitude=1.25, longitude=-1.25),
            fuel(3, "05 10:30", latitude=1.34, longitude=-1.34),
        ],
    )
    grid = table(
        spark, "weather", [{"id": 1, "time": at("05 10:00"), "lat": 1.3, "long": -1.3, "beaufourt": 4, "dss": 2}]
    )
    assert rows(weather.latest_weather(unified, grid), "timestamp", "beaufourt") == [(at("05 10:00"), 4)]
    along = weather.weather_history(unified, grid, at("05 10:40"), at("05 12:00"))
    assert rows(along, "nr_time") == [(at("05 10:59"),)]


@pytest.mark.parametrize(
    ("values", "exact", "expected"),
    [
        ((2.0, 10.0, 3.0, 20.0, 10.0), False, 2**1.1 * 1.0 + 3**1.5 * math.cos(10 * 3.414 / 180)),
        ((2.0, 10.0, 3.0, 200.0, 10.0), False, 2**1.1),
        ((2.0, 0.0, 3.0, 20.0, 10.0), False, None),
        ((2.0, None, 3.0, 20.0, 10.0), False, None),
        ((2.0, 350.0, 3.0, 350.0, 0.0), False, None),
        ((2.0, 355.0, 3.0, 180.0, 5.0), False, 0.0),
        ((2.0, 355.0, 3.0, 180.0, 5.0), True, 2**1.1 * 0.9848077530),
    ],
)
def test_added_resistance(spark, values, exact, expected):
    frame = spark.createDataFrame([values], "a double, b double, c double, d double, e double")
    found = frame.select(added_resistance(*[F.col(c) for c in "abcde"], exact)).collect()[0][0]
    assert found == (None if expected is None else pytest.approx(expected, abs=1e-6))


# Links


def test_links_defaults_and_groups(spark):
    heard = table(
        spark,
        "device_status",
        [
            {"device_id": 1, "latest_timestamp": at("05 00:00")},
            {"device_id": 2, "latest_timestamp": at("06 00:00")},
            {"device_id": 5, "latest_timestamp": at("07 00:00")},
            {"device_id": 6, "latest_timestamp": at("09 00:00")},
        ],
    )
    nmea = table(
        spark,
        "nmea",
        [
            {"id": 1, "device_id": 4, "message_datetime": at("05 01:00"), "latitude": 1},
            {"id": 2, "device_id": 6, "message_datetime": at("05 02:00"), "speed_over_ground": 1},
        ],
    )
    found = links.vessel_links(fleet(spark, 1, 2), devices(spark), engines(spark), heard, nmea)
    first, second = (r.asDict() for r in found.orderBy("vessel_id").collect())

    def seconds(text):
        return int((at(text) - datetime(1970, 1, 1)).total_seconds())

    # The engineless device counts for canbus and online, the inactive one for nothing.
    assert first["me1"] == seconds("05 00:00") and first["me2"] == seconds("06 00:00")
    assert first["canbus"] == first["online"] == seconds("07 00:00")
    assert (first["ae1"], first["nmea"], first["maic"]) == (0, 0, 0)
    assert (first["me3"], first["ae2"], first["ae3"]) == (-1, -1, -1)
    assert (first["position"], first["speed"]) == (seconds("05 01:00"), seconds("05 02:00"))
    assert second["online"] == second["me1"] == 0 and second["me2"] == -1


def test_empty_links_only_for_customers_without_any(spark):
    vessel = fleet(spark, 1, 2, 3, 4).withColumn(
        "customer_id", F.when(F.col("id") <= 2, 1).otherwise(2).cast("long")
    ).withColumn("is_active", F.col("id") != 4)
    customer = spark.createDataFrame([(1, "A"), (2, "B")], "id long, name string")
    found = links.empty_links(vessel, customer, devices(spark))
    assert rows(found, "vessel_id", "label", "dt") == [
        (3, label, 0) for label in ("canbus", "maic", "nmea", "online")
    ]
    heard = table(spark, "device_status", [])
    every = links.fleet_links(vessel, customer, devices(spark), engines(spark), heard, with_empty=True)
    assert rows(every, "vessel_id") == [(1,), (3,)]


# Alerts


def test_alert_text_and_severity(spark):
    alert = table(
        spark,
        "alert",
        [
            {"id": 1, "vessel_id": 1, "device_id": 1, "alert_type_id": 1, "alert_datetime": at("05 00:00")},
            {"id": 2, "vessel_id": 1, "device_id": 99, "alert_type_id": 1, "alert_datetime": at("05 00:00")},
        ],
    )
    kinds = table(spark, "alert_type", [{"id": 1, "severity": 3, "description": "hot"}])
    found = alerts.alerts(alert, fleet(spark, 1), kinds, devices(spark))
    assert rows(found, "type", "text") == [("warning", "hot :: ME1")]
    scale = spark.range(0, 7).select(alerts.severity_name(F.col("id")).alias("n"))
    assert [r.n for r in scale.collect()] == ["", "critical", "warning", "warning", "info", "info", None]


# Consumption


def test_speed_bands_include_their_upper_edge(spark):
    edges = [0, 5, 5.1, 7.5, 10, 12, 14, 16, 18, 20, 20.1, -1]
    unified = table(
        spark,
        "unified",
        [fuel(i, "05 00:00", average_speed_gps=s, me1_consumption=60) for i, s in enumerate(edges)],
    )
    found = consumption.consumption_by_speed(unified, at("05 00:00"), at("05 00:00"))
    counts = {r["interval"]: (r["count"], r["consumption"]) for r in found.collect()}
    assert counts["0-5"] == (2, 2.0) and counts["5-7.5"] == (2, 2.0) and counts["20+"] == (1, 1.0)
    assert sum(n for n, _ in counts.values()) == len(edges) - 1


def test_run_hours_first_and_last(spark):
    unified = table(
        spark,
        "unified",
        [
            fuel(1, "05 00:00", me1_run_hours=10.25),
            fuel(2, "05 01:00"),
            fuel(3, "05 02:00", me1_run_hours=12.5, me2_run_hours=7),
            fuel(4, "06 00:00", me1_run_hours=99),
        ],
    )
    window = (at("05 00:00"), at("05 12:00"))
    delta = consumption.run_hour_delta(unified, *window)
    assert rows(delta, "me1_run_hours", "me2_run_hours", "me3_run_hours") == [(2.25, 0.0, 0.0)]
    last = consumption.last_run_hours(unified, *window)
    assert rows(last, "me1_run_hours", "me1_run_hours_timestamp", "me3_run_hours") == [
        (12.5, at("05 02:00"), None)
    ]


def test_daily_consumption_includes_the_end_midnight_and_weights_weather(spark):
    here = {"latitude": 1.0, "longitude": 1.0}
    interp = table(
        spark,
        "interp",
        [
            fuel(1, "05 00:10", me1_consumption=60, ae3_consumption=60, **here),
            fuel(2, "05 00:20", me1_consumption=60, **here),
            fuel(3, "05 01:10", ae1_consumption=60, ae2_consumption=60, **here),
            fuel(4, "05 02:10"),
            fuel(5, "06 00:00"),
            fuel(6, "06 00:01"),
        ],
    )
    grid = table(
        spark,
        "weather",
        [
            {"id": 1, "time": at("05 00:00"), "lat": 1, "long": 1, "beaufourt": 1, "dss": 1},
            {"id": 2, "time": at("05 01:00"), "lat": 1, "long": 1, "beaufourt": 4, "dss": 1},
        ],
    )
    found = consumption.daily_consumption(interp, grid, at("05 00:00"), at("06 18:00"))
    assert rows(found, "date", "sum_cons_me_total", "sum_cons_ae_total", "wind_scale", "wave_scale") == [
        (at("05 00:00").date(), 2.0, 2.0, 2.0, 1.0),
        (at("06 00:00").date(), 0.0, 0.0, None, None),
    ]


# Reports


def test_unified_is_half_open_and_not_multiplied(spark):
    interp = table(
        spark,
        "interp",
        [fuel(1, "05 00:00"), fuel(2, "05 23:59"), fuel(3, "06 00:00"), fuel(4, "05 00:00", vessel=2)],
    )
    bus = table(spark, "canbus", [canbus(1, 1, "05 00:00", me_rpm=7), canbus(2, 1, "05 00:00", me_rpm=9)])
    found = reports.unified_dataset(interp, devices(spark), bus, at("05 10:00"), at("06 10:00"))
    assert rows(found, "id", "me1_rpm", "me2_rpm") == [(1, 9.0, None), (2, None, None)]


def test_pages_make_up_the_whole_set(spark):
    readings = [fuel(i, f"0{5 + i % 2} {i % 24:02d}:{i % 60:02d}") for i in range(103)]
    interp = table(spark, "interp", readings)
    bus = table(spark, "canbus", [canbus(1, 1, "05 00:00", me_rpm=7)])
    window = (at("05 00:00"), at("07 00:00"))
    seen = []
    for number in range(1, 13):
        found = reports.page(interp, devices(spark), bus, fleet(spark, 1), *window, number, 10)
        got = found.orderBy("row_index").collect()
        seen += [(r["nr_time"], r["id"]) for r in got]
        for r in got:
            assert (r["total_rows"], r["total_pages"], r["page_offset"]) == (103, 10, (number - 1) * 10)
    assert seen == sorted(((r["nr_time"], r["id"]) for r in readings), reverse=True)
    with pytest.raises(ValueError):
        reports.page(interp, devices(spark), bus, fleet(spark, 1), *window, 1, 0)


def test_noon_report_defaults(spark):
    fuel_rows = table(
        spark, "total_fuel", [{"id": 1, "vessel_id": 1, "date_hour": at("05 03:00"), "consumption": 1.5}]
    )
    nmea = table(
        spark,
        "nmea",
        [
            {"id": i, "device_id": 4, "message_datetime": at("05 01:00"), "wind_speed": w, "reference": r, "wind_speed_units": u}
            for i, (w, r, u) in enumerate([(3, "T", "M"), (9, "T", "M"), (20, "R", "M"), (30, "T", "N")])
        ],
    )
    bus = table(
        spark,
        "canbus",
        [canbus(1, 1, "05 00:00", me_running_hour=10), canbus(2, 1, "05 09:00", me_running_hour=14)],
    )
    kinds = engines(spark).withColumn("type", F.when(F.col("id") == 1, "ME_PORT").otherwise("x"))
    day = at("05 00:00").date()
    found = reports.noon_report(
        fleet(spark, 1, 2), fuel_rows, nmea, bus, devices(spark), kinds, day, day
    )
    assert rows(found, "vessel_id", "total_consumption", "wind_speed", "p_hours", "c_hours") == [
        (1, "1.5000", "3.0-9.0 MPS", 4.0, 0.0),
        (2, "N/A", "N/A", 0.0, 0.0),
    ]


# De-identification


def test_redate_ends_at_now(spark):
    frame = spark.createDataFrame([(n,) for n in (30, 10, 20)], "Log_No long")
    daily = deident.redate(frame, "Log_No", at("15 12:00"))
    assert rows(daily, "Log_No", "timestamp") == [
        (10, at("13 12:00")),
        (20, at("14 12:00")),
        (30, at("15 12:00")),
    ]
    minutes = deident.redate(frame, "Log_No", at("15 12:00"), "minute")
    assert rows(minutes, "Log_No", "timestamp")[0] == (10, at("15 11:56"))


def test_numbering_over_many_slices(spark):
    frame = spark.range(0, 500).withColumn("n", F.col("id") * 1000)
    found = deident.redate(frame, "n", at("15 12:00"), "minute").orderBy("n").collect()
    gaps = {(b["timestamp"] - a["timestamp"]) for a, b in zip(found, found[1:])}
    assert gaps == {timedelta(minutes=1)}


def test_jitter_is_bounded_and_repeatable(spark):
    frame = spark.range(0, 200).selectExpr(
        "id as vessel_id", "timestamp_ntz'2024-01-01' as timestamp", "cast(null as double) as lat",
        "1.0D as long", "0.0D as direction",
    )
    once = deident.jitter(frame, at("15 12:00"), 7, 10, 10, 540)
    again = deident.jitter(frame.repartition(5), at("15 12:00"), 7, 10, 10, 540)
    columns = ("vessel_id", "timestamp", "lat", "long", "direction")
    assert rows(once, *columns) == rows(again, *columns)
    for r in once.collect():
        assert timedelta(0) <= at("15 12:00") - r["timestamp"] < timedelta(seconds=540)
        assert 0 <= r["lat"] < 1 and 1 <= r["long"] < 2 and 0 <= r["direction"] < 360
    other = deident.jitter(frame, at("15 12:00"), 8, 10, 10, 540)
    assert rows(once, *columns) != rows(other, *columns)


def test_image_paths(spark):
    frame = spark.createDataFrame(
        [("/media/c1/vessel/1/main.png",), ("short",), (None,), ("/media/c1",)], "image_url string"
    )
    found = [r[0] for r in deident.rewrite_image_path(frame, "a$1\\b").collect()]
    assert found == ["/media/a$1\\b/vessel/1/main.png", "short", None, "/media/a$1\\b"]


def test_clone_and_import(spark):
    listed = fleet(spark, 5, 3).withColumn("company_id", F.lit("x"))
    clones = deident.clone_template(
        deident.template_row(listed, "id"), "demo", [(8800001, 1, "One"), (8800002, 2, "Two")]
    )
    assert clones.count() == 2
    assert {r["id"] for r in clones.select("id").collect()} == {3}
    assert rows(clones.where("imo = 8800002"), "name", "company_id") == [("Two", "demo")]
    source = spark.createDataFrame(
        [(2, 91, "b", "secret"), (1, 90, "a", "secret")], "line long, imo long, name string, remark string"
    )
    found = deident.import_vessels(source, "line", {"customer_id": 6})
    assert found.columns == ["id", "imo", "name", "customer_id"]
    assert rows(found, "id", "imo", "customer_id") == [(2000, 90, 6), (2001, 91, 6)]


def test_alias_and_pseudonym(spark):
    frame = spark.createDataFrame([(1, 5), (2, 6)], "id long, imo long")
    mapping = spark.createDataFrame([(5, 50)], "alias long, real long")
    assert rows(deident.resolve_alias(frame, mapping), "id", "imo") == [(1, 50), (2, 6)]
    names = spark.createDataFrame(
        [(5, "OSV 1", 55, 56)], "imo long, new_name string, new_imo long, new_mmsi long"
    )
    full = frame.withColumns({"name": F.lit("real"), "mmsi": F.lit(1)})
    assert rows(deident.pseudonymise(full, names, "demo"), "id", "name", "imo", "mmsi", "company_id") == [
        (1, "OSV 1", 55, 56, "demo")
    ]


def test_redating_keeps_rows_without_order_or_key(spark):
    frame = spark.createDataFrame([(1, 1), (2, None), (None, 1)], "n int, k int")
    assert deident.redate(frame, "n", at("15 12:00")).count() == 3
    by_key = deident.redate(frame, "n", at("15 12:00"), keys=["k"])
    assert by_key.count() == 3
    last = by_key.filter("k = 1 and n is null").collect()
    assert len(last) == 1 and last[0]["timestamp"] == at("15 12:00")


def test_wide_jitter_reaches_its_bound(spark):
    bound = 30 * 86400
    numbers = spark.range(3000).select(
        deident.jitter_number(F.col("id") * 977, 7, "time", bound).alias("n")
    )
    low, high, count = numbers.agg(F.min("n"), F.max("n"), F.count_distinct("n")).first()
    assert 0 <= low < bound // 50 and bound - bound // 50 < high < bound and count > 2500
    with pytest.raises(ValueError):
        deident.jitter_number(F.lit(1), 7, "time", 10**13)


def test_info_as_variant(spark):
    texts = [
        '{"maker": {"name": "X", "year": 1999}, "decks": [{"no": 7}, {"no": 8}]}',
        '{"maker": {"name": 5}, "draft": 3.5}',
        "not json",
        None,
    ]
    engines = spark.createDataFrame(
        [(1, "ME_CENTRE", f"ME{k}", t) for k, t in enumerate(texts)],
        "vessel_id int, type string, label string, additional_info string",
    )
    found = fleet_ops.engines(engines, fleet(spark, 1))
    paths = {"year": ("$.maker.year", "int"), "name": ("$.maker.name", "string"), "deck": ("$.decks[1].no", "int")}
    assert rows(fleet_ops.info_values(found, paths), "label", "year", "name", "deck") == [
        ("ME0", 1999, "X", 8),
        ("ME1", None, "5", None),
        ("ME2", None, None, None),
        ("ME3", None, None, None),
    ]
    shape = fleet_ops.info_shape(found)
    assert "maker" in shape and "draft" in shape and "decks" in shape


def test_links_look_at_recent_reports_first(spark):
    device = table(spark, "device", [
        {"device_id": d, "vessel_id": v, "device_type_id": 3, "label_name": "NMEA", "is_active": True}
        for d, v in ((1, 1), (2, 1), (3, 2), (4, 3))
    ])
    nmea = table(spark, "nmea", [
        {"device_id": 1, "message_datetime": at("14 10:00"), "latitude": 1, "speed_over_ground": 2},
        {"device_id": 2, "message_datetime": at("03 10:00"), "latitude": 1},
        {"device_id": 2, "message_datetime": at("14 11:00"), "speed_over_ground": 2},
        {"device_id": 3, "message_datetime": at("02 10:00"), "longitude": 1, "speed_over_ground": 3},
        {"device_id": 9, "message_datetime": at("14 10:00"), "latitude": 1},
    ])
    engine = table(spark, "engine", [])
    heard = table(spark, "device_status", [])
    vessel = fleet(spark, 1, 2, 3)
    whole = links.vessel_links(vessel, device, engine, heard, nmea)
    recent = links.vessel_links(vessel, device, engine, heard, nmea, since=at("13"))
    assert rows(whole, *whole.columns) == rows(recent, *whole.columns)
    one = links.vessel_links(vessel.where("id = 2"), device, engine, heard, nmea, limit=True, since=at("13"))
    assert rows(one, *whole.columns) == [r for r in rows(whole, *whole.columns) if r[0] == 2]
