"""Reading and writing: lake, CSV, noon log, database options, shared folder."""

from __future__ import annotations

import re
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from tests.frames import at, rows, table
from wakeline.functions.times import within
from wakeline.operators import deident, reports, series, weather
from wakeline.plans.routes import FleetService
from wakeline.schemas import FACT_TIMES, TABLES
from wakeline.sources import jdbc
from wakeline.sources.documents import read_json_documents, read_json_lists
from wakeline.sources.lake import Lake, append_rows, write_fact
from wakeline.sources.noon import NOON_COLUMNS, NOON_SCHEMA, read_noon_csv
from wakeline.sources.shared import new_path, shared_folder


@pytest.fixture(scope="module")
def lake(spark, tables, tmp_path_factory):
    """The fixture tables written as a lake."""
    root = str(tmp_path_factory.mktemp("lake"))
    for name, schema in TABLES.items():
        frame = getattr(tables, name)
        typed = frame.select(
            *[
                (F.col(f.name) if f.name in frame.columns else F.lit(None))
                .cast(f.dataType)
                .alias(f.name)
                for f in schema.fields
            ]
        )
        append_rows(typed, root, name)
    return Lake(spark, root)


def physical(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_wide_row_has_57_columns_of_measurements():
    wide = [c for c in TABLES["interp"].names if c not in ("id", "vessel_id")]
    assert len(TABLES["interp"].names) == 61 or len(wide) >= 55
    assert set(FACT_TIMES) <= set(TABLES)


def test_windows_prune_day_folders_and_columns(lake):
    found = series.main_series(lake.interp, lake.vessel, at("05 00:00"), at("06 00:00"), 60, [3])
    scan = next(s for s in physical(found).split("\n") if "FileScan parquet" in s and "me1_consumption" in s)
    assert re.search(r"PartitionFilters: \[[^\]]*day#\d+ >= 2024-01-05", scan)
    assert "EqualTo(vessel_id,3)" in scan or "In(vessel_id" in scan
    assert "GreaterThanOrEqual(nr_time" in scan
    assert "average_speed_gps" not in scan and "ae1_consumption" not in scan


def test_lake_gives_the_same_answers_as_the_fixtures(lake, tables):
    window = (at("05 00:00"), at("07 00:00"))
    for source in ("interp",):
        ours = series.vessel_playback(getattr(lake, source), *window)
        theirs = series.vessel_playback(getattr(tables, source), *window)
        assert rows(ours, *ours.columns) == rows(theirs, *ours.columns)
    with pytest.raises(AttributeError):
        lake.no_such_table


def test_append_adds_rows(spark, lake, tmp_path):
    root = str(tmp_path)
    first = table(spark, "total_fuel", [{"id": 1, "vessel_id": 1, "date_hour": at("05 00:00")}])
    write_fact(first, root, "total_fuel")
    append_rows(first.withColumn("id", F.lit(2).cast("long")), root, "total_fuel")
    assert rows(Lake(spark, root).total_fuel, "id", "day") == [
        (1, at("05 00:00").date()),
        (2, at("05 00:00").date()),
    ]


def test_csv_export_reads_back(spark, tables, tmp_path):
    data = reports.unified_dataset(
        tables.interp, tables.device, tables.canbus, at("05 00:00"), at("06 00:00")
    )
    path = str(tmp_path / "csv")
    reports.export_csv(data, path)
    back = reports.read_export(spark, path, data.schema)
    assert rows(back, *data.columns) == rows(data, *data.columns)
    assert back.count() > 0


def test_export_parts_by_number_are_newest_first(spark, tables, tmp_path):
    data = reports.unified_dataset(
        tables.interp, tables.device, tables.canbus, at("05 00:00"), at("09 00:00")
    )
    path = str(tmp_path / "csv")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        reports.export_csv(data, path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    manifest = spark.read.json(f"{path}/_manifest").orderBy("vessel_id", "number").collect()
    assert len(manifest) > len({r["vessel_id"] for r in manifest})
    found: dict = {}
    for r in manifest:
        part = spark.read.option("header", True).csv(r["file"])
        # One file, in the order it was written.
        lines = part.select("nr_time", "id").collect()
        assert len(lines) == r["rows"] and lines[0]["nr_time"] >= lines[-1]["nr_time"]
        found.setdefault(r["vessel_id"], []).extend((x["nr_time"], int(x["id"])) for x in lines)
    for vessel_id, lines in found.items():
        assert lines == sorted(lines, reverse=True), vessel_id
    assert sum(map(len, found.values())) == data.count()
    empty = str(tmp_path / "empty")
    reports.export_csv(data.limit(0), empty)
    assert reports.read_export(spark, empty, data.schema).count() == 0


def test_noon_csv_and_its_speeds(spark, tmp_path):
    def line(number, stw, state="NaN"):
        known = {"Log_No": number, "Datetime_UTC": "14-03-2024", "Load_Condition": state, "STW": stw, "DSS": state}
        return ",".join(str(known.get(c, "")) for c in NOON_COLUMNS)

    path = tmp_path / "noon.csv"
    path.write_text("\n".join([",".join(NOON_COLUMNS), line(1, 12.8), line(2, "NaN"), line(3, "", 4)]))
    noon = read_noon_csv(spark, str(path))
    assert noon.schema == NOON_SCHEMA and len(NOON_SCHEMA) == 43
    assert [r[0] for r in noon.orderBy("Log_No").select("Load_Condition").collect()] == [None, None, "4"]
    assert rows(noon, "Log_No", "STW", "DSS") == [(1, 12.8, None), (2, None, None), (3, None, 4.0)]
    empty = spark.createDataFrame([], "vessel_id long, timestamp timestamp_ntz, sog double, stw double")
    found = deident.append_noon_speed(empty, noon, 7, at("15 12:00"))
    assert rows(found, "vessel_id", "timestamp", "sog") == [
        (7, at("15 11:56"), 12.8),
        (7, at("15 11:57"), None),
        (7, at("15 11:58"), None),
    ]


def test_database_ranges_cover_the_window_once():
    predicates = jdbc.range_predicates("t", at("05 00:00"), at("07 12:00"), timedelta(days=1))
    assert predicates == [
        "t >= '2024-01-05 00:00:00' and t < '2024-01-06 00:00:00'",
        "t >= '2024-01-06 00:00:00' and t < '2024-01-07 00:00:00'",
        "t >= '2024-01-07 00:00:00' and t <= '2024-01-07 12:00:00'",
    ]
    assert set(jdbc.DATABASE_TABLES) == set(TABLES)


def test_window_on_a_frame_without_day_folders(spark):
    frame = table(spark, "ais", [{"id": 1, "report_datetime": at("05 00:00")}])
    assert within(frame, "report_datetime", at("05 00:00"), at("05 00:00")).count() == 1
    assert within(frame, "report_datetime", None, at("05 00:00"), half_open=True).count() == 0


def test_shared_folder_is_the_sessions(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    assert new_path(spark, "x") != new_path(spark, "x")


# Every route over the lake


@pytest.fixture(scope="module")
def service(lake):
    return FleetService(lake, at("15 12:00"), fresh_minutes=1440, recent_days=3)


IMO = 9000003


@pytest.mark.parametrize(
    "ask",
    [
        lambda s: s.vessel_position(IMO),
        lambda s: s.vessel_position(IMO, latest=True),
        lambda s: s.vessel_position(IMO, source="ais"),
        lambda s: s.vessel_position(IMO, source="ais", latest=True),
        lambda s: s.vessel_speed(IMO, interval=30),
        lambda s: s.vessel_alerts(IMO),
        lambda s: s.vessel_links(IMO),
        lambda s: s.vessel_real_time(IMO),
        lambda s: s.vessel_playback(IMO),
        lambda s: s.vessel_utilisation(IMO),
        lambda s: s.weather_resistance(IMO),
        lambda s: s.vessel_details(IMO),
        lambda s: s.consumption_histogram(IMO, at("05 00:00"), at("12 00:00")),
        lambda s: s.propulsion_metrics(IMO),
        lambda s: s.propulsion_metrics_daily(IMO),
        lambda s: s.aux_engines(IMO),
        lambda s: s.main_engines(IMO, at("05 00:00"), at("06 00:00"), 6),
        lambda s: s.engine_real_time(IMO, "ME1"),
        lambda s: s.engine_playback(IMO, "ME1"),
        lambda s: s.engine_data(IMO, "ME1", ["rpm", "cons"]),
        lambda s: s.noon_report(IMO),
        lambda s: s.unified_page(IMO, page=2, page_size=5),
        lambda s: s.consumption_summary(IMO),
        lambda s: s.client_summary(IMO),
    ],
)
def test_vessel_routes_answer_for_their_vessel(service, ask):
    found = ask(service)
    if "vessel_id" in found.columns:
        assert {r["vessel_id"] for r in found.select("vessel_id").distinct().collect()} == {3}
    else:
        assert found.count() > 0


def test_fleet_routes(service):
    assert service.fleet_kpis("ASIA").count() == 5
    assert service.fleet_vessels("ASIA").count() == 5
    assert service.fleet_position("ASIA").count() == 5
    assert service.fleet_links("NOLINKS").count() == 1
    assert service.map_points(["oil"]).count() > 0
    assert service.device_pictures("D1").count() == 8


def test_routes_check_their_arguments(service):
    with pytest.raises(ValueError):
        service.vessel_speed(IMO, interval=7)
    with pytest.raises(ValueError):
        service.vessel_position(IMO, source="radar")


def test_download(service, spark, tmp_path):
    service.download_unified(IMO, str(tmp_path / "out"), at("05 00:00"), at("06 00:00"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() > 0


def test_a_noon_log_is_appended_to_the_speeds(service, spark):
    noon = spark.createDataFrame([(1, 9.5)], "Log_No long, STW double")
    found = service.vessel_speed(IMO, noon=noon)
    assert found.where("sog = 9.5 and timestamp = timestamp_ntz'2024-01-15 11:58:00'").count() == 1


def test_json_documents_are_read_and_redated(spark, tmp_path):
    (tmp_path / "a.json").write_text(
        '[{"Log_No": 1, "STW": 10.5, "Port": "A"}, {"Log_No": 2, "STW": null}, {"Log_No": 3}]'
    )
    found = read_json_documents(spark, str(tmp_path), "Log_No bigint, STW double")
    dated = deident.redate(found, "Log_No", at("15 12:00"), "day")
    assert rows(dated, "Log_No", "STW", "timestamp") == [
        (1, 10.5, at("13 12:00")),
        (2, None, at("14 12:00")),
        (3, None, at("15 12:00")),
    ]
    (tmp_path / "b.json").write_text("[{not json")
    with pytest.raises(Exception, match="MALFORMED"):
        read_json_documents(spark, str(tmp_path), "Log_No bigint").collect()


def test_aliases_answer_for_real_numbers(spark, tables):
    imo = tables.vessel.where("imo is not null").agg(F.min("imo")).collect()[0][0]
    aliases = spark.createDataFrame([(12345, imo)], "alias bigint, real bigint")
    service = FleetService(tables, at("15 12:00"), aliases=aliases)
    plain = FleetService(tables, at("15 12:00"))
    assert service.vessel_ids(12345) == service.vessel_ids(imo) == plain.vessel_ids(imo) != []
    assert plain.vessel_ids(12345) == []


def test_recent_weather_opens_recent_days(lake):
    whole = weather.latest_weather(lake.unified, lake.weather, vessel=lake.vessel)
    recent = weather.latest_weather(lake.unified, lake.weather, vessel=lake.vessel, since=at("12 10:30"))
    assert rows(recent, *whole.columns) == rows(whole, *whole.columns) != []
    scans = [s for s in physical(recent).split("\n") if "FileScan parquet" in s and "beaufourt" in s]
    assert any(re.search(r"PartitionFilters: \[[^\]]*day#\d+ >= 2024-01-12", s) for s in scans)


def test_json_lists_in_byte_ranges(spark, tmp_path):
    """Braces, quotes and escapes in strings, nested documents, and documents larger than a range."""
    import json
    import random

    rng = random.Random(2)
    odd = ["}", "{", '"', "\\", '\\"}', "[{", "é}", "x", "},{", "\n", "\u2028"]

    def text():
        return "".join(rng.choice(odd) for _ in range(rng.randrange(12)))

    documents = []
    for k in range(6000):
        document = {"no": k, "note": text(), "parts": [{"name": text(), "size": k / 7} for _ in range(rng.randrange(3))]}
        if k % 1500 == 7:
            document["note"] = "}{\"" * 40_000
        if k % 11 == 0:
            del document["note"]
        documents.append(document)
    for name, part, shape in (("a", documents[:4000], {"indent": 1}), ("b", documents[4000:], {"separators": (",", ":")}), ("c", [], {})):
        (tmp_path / f"{name}.json").write_text(json.dumps(part, ensure_ascii=False, **shape))
    schema = "no bigint, note string, parts array<struct<name: string, size: double>>, missing int"
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        found = read_json_lists(spark, str(tmp_path), schema)
        ranges = found.rdd.getNumPartitions()
        got = found.orderBy("no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert ranges > 20
    assert got == read_json_documents(spark, str(tmp_path), schema).orderBy("no").collect()
    assert len(got) == 6000
    (tmp_path / "d.json").write_text('[{"no": 1}, {"no": 2')
    with pytest.raises(ValueError, match="MALFORMED"):
        read_json_lists(spark, str(tmp_path), schema)
