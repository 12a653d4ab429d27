"""Every operator over the fixture tables, under its inventory id.

Each entry takes a session and a test-data folder and returns a frame with the
column names its oracle uses. Measures are rounded to six digits at this edge
only; nested records are laid out flat.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.functions.frames import flattened, rounded
from wakeline.operators import (
    alerts,
    consumption,
    deident,
    demo,
    fleet,
    links,
    positions,
    reports,
    rollups,
    series,
    snapshot,
    status,
    weather,
)
from wakeline.sources.fixtures import FixtureTables, fixture_tables
from wakeline.sources.noon import NOON_COLUMNS, parse_noon_lines
from wakeline.sources.shared import new_path

START = datetime(2024, 1, 5)
OFF_GRID_START = datetime(2024, 1, 5, 0, 17)
END = datetime(2024, 1, 12)
AS_OF = datetime(2024, 1, 15, 12)
FRESH_MINUTES = 1440
FIRST_DAY, LAST_DAY = date(2024, 1, 4), date(2024, 1, 13)
JITTER_SEED = 42
DEMO_FLEET = ((8800001, 244000001, "Demo One"), (8800002, 244000002, "Demo's Two"), (8800003, 244000003, "Demo Three"))
PAGE, PAGE_SIZE = 2, 20

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def _query(name: str) -> Callable[[Callable[[FixtureTables], DataFrame]], Query]:
    def register(build: Callable[[FixtureTables], DataFrame]) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return rounded(flattened(build(fixture_tables(spark, folder))))

        run.__doc__ = build.__doc__
        _QUERIES[name] = run
        return run

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


# Positions and tracks


@_query("P1_track")
def _(t):
    return positions.track(t.interp, START, END)


@_query("P2_latest_position")
def _(t):
    return positions.latest_position(t.interp, vessel=t.vessel)


@_query("P3_ais_track")
def _(t):
    return positions.ais_track(t.ais, START, END, vessel=t.vessel)


@_query("P4_latest_ais")
def _(t):
    return positions.latest_ais(t.ais, t.vessel)


def _fleet_positions(t, customer_name=None):
    return positions.fleet_positions(
        t.vessel,
        t.customer,
        t.fleet_type,
        t.interp,
        t.ais,
        t.vps,
        t.position_status,
        customer_name,
    )


@_query("P5_fleet_positions")
def _(t):
    return _fleet_positions(t)


@_query("P5_fleet_positions_one_customer")
def _(t):
    return _fleet_positions(t, "ASIA")


@_query("P6_fold_sources")
def _(t):
    return positions.fold_sources(_fleet_positions(t))


# Binned series and playback


@_query("T1_speed_series")
def _(t):
    return series.speed_series(t.interp, t.vessel, START, END, 60)


@_query("T1_speed_series_off_grid")
def _(t):
    return series.speed_series(t.interp, t.vessel, OFF_GRID_START, END, 7)


@_query("T2_latest_speed")
def _(t):
    return series.latest_speed(t.interp, t.vessel)


@_query("T3_aux_series")
def _(t):
    return series.aux_series(t.interp, t.vessel, START, END, 60)


@_query("T4_main_series")
def _(t):
    return series.main_series(t.interp, t.vessel, START, END, 60)


@_query("T4_main_series_6_minutes")
def _(t):
    return series.main_series(t.interp, t.vessel, START, END, 6)


@_query("T5_engine_params")
def _(t):
    return series.engine_params(
        t.interp, t.canbus, t.device, "ME2", ["rpm", "fot", "lot", "cons"], START, END
    )


@_query("T6_vessel_playback")
def _(t):
    return series.vessel_playback(t.interp, START, END, vessel=t.vessel)


@_query("T7_engine_playback")
def _(t):
    return series.engine_playback(t.interp, t.canbus, t.device, t.engine, "ME2", START, END)


# Real-time snapshot


def _best(t):
    return snapshot.most_complete(snapshot.fresh(t.interp, AS_OF, FRESH_MINUTES))


@_query("R1_fresh")
def _(t):
    return snapshot.fresh(t.interp, AS_OF, FRESH_MINUTES)


@_query("R2_most_complete")
def _(t):
    return _best(t)


@_query("R3_by_engine")
def _(t):
    return snapshot.by_engine(_best(t))


@_query("R4_engine_sensors")
def _(t):
    window = (snapshot.fresh_since(AS_OF, FRESH_MINUTES), AS_OF)
    return snapshot.engine_sensors(_best(t), t.device, t.engine, t.canbus, None, *window)


@_query("R5_last_positive_run_hours")
def _(t):
    return snapshot.last_positive_run_hours(t.unified)


@_query("R6_is_running")
def _(t):
    return t.interp.select(
        "id",
        "vessel_id",
        *[
            snapshot.is_running(F.col(f"{e}_consumption")).alias(f"{e}_is_running")
            for e in snapshot.ENGINES
        ],
    )


@_query("R6_engine_real_time")
def _(t):
    return snapshot.engine_real_time(
        t.interp, t.unified, t.device, t.engine, t.canbus, AS_OF, FRESH_MINUTES
    )


@_query("R7_vessel_snapshot")
def _(t):
    return snapshot.vessel_snapshot(
        t.vessel,
        t.interp,
        t.unified,
        t.ais,
        t.weather,
        t.device,
        t.engine,
        t.canbus,
        t.vps,
        t.position_status,
        t.gis_point,
        t.gis_point_type,
        AS_OF,
        FRESH_MINUTES,
    )


@_query("R8_vessel_playback_bundle")
def _(t):
    return snapshot.vessel_playback_bundle(
        t.interp,
        t.unified,
        t.ais,
        t.weather,
        t.vps,
        t.position_status,
        t.gis_point,
        t.gis_point_type,
        START,
        END,
    )


# Status and utilisation


@_query("S1_latest_status")
def _(t):
    return status.latest_status(
        t.vps, t.position_status, t.gis_point, t.gis_point_type, vessel=t.vessel
    )


@_query("S2_status_history")
def _(t):
    return status.status_history(
        t.vps, t.position_status, t.gis_point, t.gis_point_type, START, END, vessel=t.vessel
    )


@_query("S3_utilisation")
def _(t):
    return status.utilisation(t.vps, t.position_status, START, END, vessel=t.vessel)


# Weather


@_query("W1_latest_weather")
def _(t):
    return weather.latest_weather(t.unified, t.weather, vessel=t.vessel)


@_query("W2_weather_history")
def _(t):
    return weather.weather_history(t.unified, t.weather, START, END, vessel=t.vessel)


@_query("W3_weather_resistance")
def _(t):
    return weather.weather_resistance(t.interp, t.weather, vessel=t.vessel)


@_query("W4_added_resistance")
def _(t):
    return weather.resistance_track(t.interp, t.weather)


@_query("W4_added_resistance_exact")
def _(t):
    return weather.resistance_track(t.interp, t.weather, exact=True)


# Links


@_query("L1_vessel_links")
def _(t):
    return links.vessel_links(t.vessel, t.device, t.engine, t.device_status, t.nmea)


@_query("L2_fleet_links")
def _(t):
    return links.fleet_links(t.vessel, t.customer, t.device, t.engine, t.device_status)


@_query("L3_last_per_label")
def _(t):
    return links.last_per_label(links.link_rows(t.device, t.engine, t.device_status))


@_query("L4_empty_links")
def _(t):
    return links.empty_links(t.vessel, t.customer, t.device)


@_query("L4_fleet_links_with_empty")
def _(t):
    return links.fleet_links(
        t.vessel, t.customer, t.device, t.engine, t.device_status, with_empty=True
    )


# Alerts


@_query("A1_alerts")
def _(t):
    return alerts.alerts(t.alert, t.vessel, t.alert_type, t.device)


@_query("A2_severity_name")
def _(t):
    kinds = t.alert_type.select(F.col("id").alias("alert_type_id"), "severity")
    return t.alert.join(kinds, "alert_type_id").select(
        "id", "severity", alerts.severity_name(F.col("severity")).alias("severity_name")
    )


# Consumption and run hours


@_query("C1_consumption_by_speed")
def _(t):
    return consumption.consumption_by_speed(t.unified, START, END, vessel=t.vessel)


@_query("C2_run_hour_delta")
def _(t):
    return consumption.run_hour_delta(t.unified, START, END, vessel=t.vessel)


@_query("C3_last_run_hours")
def _(t):
    return consumption.last_run_hours(t.unified, START, END, vessel=t.vessel)


@_query("C4_daily_consumption")
def _(t):
    return consumption.daily_consumption(t.interp, t.weather, START, END, vessel=t.vessel)


@_query("C5_customer_daily")
def _(t):
    return consumption.customer_daily(t.customer_unified, t.weather, START, END, vessel=t.vessel)


# Reports


@_query("N1_daily_fuel")
def _(t):
    return reports.daily_fuel(t.total_fuel, vessel=t.vessel)


@_query("N2_daily_wind")
def _(t):
    return reports.daily_wind(t.nmea, t.device)


@_query("N3_daily_engine_hours")
def _(t):
    return reports.daily_engine_hours(t.canbus, t.device, t.engine)


@_query("N4_noon_report")
def _(t):
    return reports.noon_report(
        t.vessel, t.total_fuel, t.nmea, t.canbus, t.device, t.engine, FIRST_DAY, LAST_DAY
    )


def _unified_dataset(t):
    return reports.unified_dataset(t.interp, t.device, t.canbus, START, END)


@_query("U1_unified_dataset")
def _(t):
    return _unified_dataset(t)


@_query("U2_page")
def _(t):
    return reports.page(
        t.interp, t.device, t.canbus, t.vessel, START, END, PAGE, PAGE_SIZE
    )


@_query("U3_export_csv")
def _(t):
    """Written as CSV to the shared folder and read back."""
    data = rounded(_unified_dataset(t))
    spark = data.sparkSession
    path = new_path(spark, "unified-csv")
    reports.export_csv(data, path)
    return reports.read_export(spark, path, data.schema)


# The same answers from states added up before


@_query("T1_speed_series_rolled")
def _(t):
    """A start off the grid of bins and of periods, so the ends come from the facts."""
    states = rollups.SPEED.build(t.interp)
    return rollups.speed_series(states, t.interp, t.vessel, OFF_GRID_START, END, 30)


@_query("T3_aux_series_rolled")
def _(t):
    return rollups.aux_series(rollups.AUX_FUEL.build(t.interp), t.interp, t.vessel, START, END, 60)


@_query("T4_main_series_rolled")
def _(t):
    return rollups.main_series(rollups.MAIN_FUEL.build(t.interp), t.interp, t.vessel, START, END, 60)


@_query("C2_run_hour_delta_rolled")
def _(t):
    states = rollups.RUN_HOURS.build(t.unified)
    return rollups.run_hour_delta(states, t.unified, START, END, vessel=t.vessel)


@_query("C4_daily_consumption_rolled")
def _(t):
    states = rollups.DAILY.build(t.interp)
    return rollups.daily_consumption(states, t.interp, t.weather, START, END, vessel=t.vessel)


@_query("N2_daily_wind_rolled")
def _(t):
    return rollups.daily_wind(rollups.WIND_DAY.build(t.nmea), t.nmea, t.device)


# Fleet, reference data and images


@_query("F1_fleet_kpis")
def _(t):
    return _fleet_kpis(t)


@_query("F1_fleet_kpis_one_customer")
def _(t):
    return _fleet_kpis(t, "ASIA")


def _fleet_kpis(t, customer_name=None):
    return fleet.fleet_kpis(
        t.vessel,
        t.customer,
        t.interp,
        t.unified,
        t.ais,
        t.weather,
        t.device,
        t.engine,
        t.device_status,
        t.nmea,
        t.vps,
        t.position_status,
        t.gis_point,
        t.gis_point_type,
        customer_name,
    )


@_query("F2_vessels")
def _(t):
    return fleet.vessels(t.vessel, t.customer, t.vessel_type, parse_info=False)


@_query("F3_engines")
def _(t):
    return fleet.engines(t.engine, t.vessel, parse_info=False)


@_query("F2_vessels_parsed")
def _(t):
    listed = fleet.vessels(t.vessel, t.customer, t.vessel_type)
    return fleet.info_values(listed, {"info_built": ("$.built", "int")})


@_query("F3_engines_parsed")
def _(t):
    return fleet.info_values(fleet.engines(t.engine, t.vessel), {"info_no": ("$.no", "string")})


@_query("F4_gis_points")
def _(t):
    return fleet.gis_points(t.gis_point, t.gis_point_type)


@_query("F4_gis_points_by_type")
def _(t):
    return fleet.gis_points(t.gis_point, t.gis_point_type, ["port", "oil"])


@_query("F5_newest_images")
def _(t):
    return fleet.newest_images(t.image)


# De-identification and loading


def _reports_with_identity(t):
    owners = t.vessel.select(
        F.col("id").alias("vessel_id"),
        "imo",
        "mmsi",
        "name",
        F.col("customer_id").cast("string").alias("company_id"),
    )
    return t.ais.select("id", "vessel_id", F.col("report_datetime").alias("timestamp")).join(
        owners, "vessel_id"
    )


@_query("D1_resolve_alias")
def _(t):
    aliased = t.vessel.where("fleet_type_id = 0")
    mapping = aliased.selectExpr("900000 + id as alias", "9000000 + id as real")
    kinds = t.vessel.selectExpr("id as vessel_id", "fleet_type_id")
    asked = t.ais.join(kinds, "vessel_id").selectExpr(
        "id", "case when fleet_type_id = 0 then 900000 else 9000000 end + vessel_id as imo"
    )
    return deident.resolve_alias(asked, mapping)


@_query("D2_pseudonymise")
def _(t):
    mapping = t.vessel.where("vessel_type_id = 1").selectExpr(
        "imo",
        "concat('OSV ', id) as new_name",
        "imo - 8000000 as new_imo",
        "mmsi - 500000000 as new_mmsi",
    )
    return deident.pseudonymise(_reports_with_identity(t), mapping, "demo", "offshore")


def _demo(t):
    mapping = t.vessel.where("vessel_type_id = 1 and imo is not null").selectExpr(
        "imo",
        "concat('OSV ', id) as new_name",
        "imo - 8000000 as new_imo",
        "mmsi - 500000000 as new_mmsi",
    )
    return demo.DemoCustomer("demo", mapping, DEMO_FLEET, seed=JITTER_SEED)


@_query("D2_demo_kpis")
def _(t):
    return demo.demo_kpis(_fleet_kpis(t), _demo(t), AS_OF)


@_query("D2_demo_positions")
def _(t):
    return demo.demo_positions(positions.fold_sources(_fleet_positions(t)), _demo(t), AS_OF)


@_query("D2_demo_vessels")
def _(t):
    return demo.demo_vessels(
        fleet.vessels(t.vessel, t.customer, t.vessel_type, parse_info=False), _demo(t)
    )


@_query("D3_jitter_days")
def _(t):
    reports_ = t.interp.selectExpr(
        "id", "vessel_id", "nr_time as timestamp", "0.0D as lat", "0.0D as long", "0.0D as direction"
    )
    moved = deident.jitter(reports_, AS_OF, JITTER_SEED, 1, 1, 30 * 86400, key="id")
    return moved.select("id", "timestamp")


@_query("D6_redate_missing")
def _(t):
    return deident.redate(
        t.interp.selectExpr(
            "id",
            "case when id % 7 <> 0 then vessel_id end as vessel_id",
            "case when id % 5 <> 0 then nr_time end as nr_time",
        ),
        "nr_time",
        AS_OF,
        keys=["vessel_id"],
        ties=["id"],
    )


@_query("D3_jitter")
def _(t):
    reports_ = t.interp.selectExpr(
        "id",
        "vessel_id",
        "nr_time as timestamp",
        "cast(latitude as double) as lat",
        "cast(longitude as double) as long",
        "cast(course as double) as direction",
    )
    return deident.jitter(reports_, AS_OF, JITTER_SEED, 25, 110, 4 * 3600, key="id")


@_query("D4_clone_template")
def _(t):
    listed = _reports_with_identity(t).withColumn("fleet_type", F.lit("offshore"))
    listed = listed.withColumns({c: F.col(c).cast("bigint") for c in ("imo", "mmsi")})
    clones = deident.clone_template(deident.template_row(listed, "id"), "demo", DEMO_FLEET)
    return listed.unionByName(clones)


@_query("D5_rewrite_image_path")
def _(t):
    paths = t.image.selectExpr(
        "id",
        "case when id % 10 <> 3 then concat('/media/', device_serial, '/', image, '.png') end"
        " as image_url",
    )
    return deident.rewrite_image_path(paths, "demo")


@_query("D6_redate_daily")
def _(t):
    rows = t.customer_unified.select("id", "vessel_id", "nr_time")
    return deident.redate(rows, "nr_time", AS_OF, "day", ["vessel_id"], ["id"])


@_query("D6_redate_minute")
def _(t):
    return deident.redate(t.interp.select("id", "vessel_id"), "id", AS_OF, "minute")


def noon_lines(customer_unified: DataFrame) -> DataFrame:
    """A noon log in text form out of the customer's rows: one line per row."""
    known = {
        "Log_No": F.col("id").cast("string"),
        "Datetime_UTC": F.date_format("nr_time", "dd-MM-yyyy"),
        "Load_Condition": F.lit("L"),
        "STW": F.when(F.col("id") % 3 == 0, F.coalesce(F.col("speed_through_water").cast("string"), F.lit("NaN")))
        .otherwise(F.coalesce(F.col("speed_through_water").cast("string"), F.lit(""))),
        "AER_Condition": F.lit("Sea"),
    }
    fields = [known.get(name, F.lit("NaN")) for name in NOON_COLUMNS]
    return customer_unified.select(F.concat_ws(",", *fields).alias("line"))


@_query("D7_append_noon_speed")
def _(t):
    speeds = series.speed_series(t.interp, t.vessel, START, END, 60)
    noon = parse_noon_lines(noon_lines(t.customer_unified))
    return deident.append_noon_speed(speeds, noon, 99, AS_OF)


def _listed_vessels(t):
    return t.gis_point.selectExpr(
        "id as line_no",
        "9500000 + id as imo",
        "540000000 + id as mmsi",
        "name",
        "cast(1000 + id % 700 as double) as dwt",
        "cast(10 + id % 7 as double) as service_speed",
        "description as owner_remark",
    )


IMPORT_CONSTANTS = {"customer_id": 6, "vessel_type_id": 13, "fuel_type_id": 1}


@_query("D8_import_vessels")
def _(t):
    return deident.import_vessels(_listed_vessels(t), "line_no", IMPORT_CONSTANTS)


@_query("D8_append_vessels")
def _(t):
    """The vessel table with the list appended, ids going on behind its largest one."""
    added = deident.import_vessels(_listed_vessels(t), "line_no", IMPORT_CONSTANTS, existing=t.vessel)
    shared = ["id", "imo", "mmsi", "name", "customer_id"]
    return t.vessel.select(shared).unionByName(added.select(shared))
