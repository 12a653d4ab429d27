"""Explicit schemas of the input tables, so nothing is inferred at read time."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "id": T.LongType(),
    "number": T.DoubleType(),
    "decimal": T.DecimalType(18, 4),
    "degrees": T.DecimalType(9, 4),
    "int": T.IntegerType(),
    "text": T.StringType(),
    "flag": T.BooleanType(),
    "time": T.TimestampNTZType(),
}


def _table(**columns: str) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in columns.items()])


# The columns of a telemetry row.
_WIDE = {
    "vessel_id": "id",
    "nr_time": "time",
    "nr_type": "text",
    "longitude": "degrees",
    "latitude": "degrees",
    "distance": "number",
    "average_speed_gps": "degrees",
    "distance_through_water": "number",
    "course": "degrees",
    "me1_run_hours": "decimal",
    "me1_consumption": "decimal",
    "me1_fuel_type": "number",
    "me1_power_at_shaft": "number",
    "me2_run_hours": "decimal",
    "me2_consumption": "decimal",
    "me2_fuel_type": "number",
    "me2_power_at_shaft": "number",
    "me3_run_hours": "decimal",
    "me3_consumption": "decimal",
    "me3_fuel_type": "number",
    "me3_power_at_shaft": "number",
    "ae1_run_hours": "decimal",
    "ae1_consumption": "decimal",
    "ae1_fuel_type": "number",
    "ae1_energy_produced": "decimal",
    "ae2_run_hours": "decimal",
    "ae2_consumption": "decimal",
    "ae2_fuel_type": "number",
    "ae2_energy_produced": "decimal",
    "ae3_run_hours": "decimal",
    "ae3_consumption": "decimal",
    "ae3_fuel_type": "number",
    "ae3_energy_produced": "decimal",
    "ae4_run_hours": "decimal",
    "ae4_consumption": "decimal",
    "ae4_fuel_type": "number",
    "ae4_energy_produced": "decimal",
    "wind_direction": "number",
    "wind_strength": "number",
    "sea_state": "number",
    "sea_state_direction": "number",
    "current_direction": "number",
    "current_strength": "number",
    "ballast_water": "number",
    "cargo_tonns": "number",
    "draft_forward": "number",
    "draft_aft": "number",
    "draft_middle": "number",
    "destination_port": "number",
    "departure_port": "number",
    "eta_next_port": "number",
    "charter_speed_order": "number",
    "boiler_consumption": "number",
    "boiler_fuel_type": "number",
    "reporting_period": "number",
    "update_datetime": "time",
    "speed_through_water": "degrees",
}

# Table and column names of the input.
TABLES = {
    "interp": _table(id="id", **_WIDE),
    "unified": _table(id="id", **_WIDE),
    "customer_unified": _table(id="id", **_WIDE),
    "ais": _table(
        id="id",
        vessel_id="id",
        report_datetime="time",
        latitude="degrees",
        longitude="degrees",
        course="degrees",
    ),
    "nmea": _table(
        id="id",
        device_id="id",
        message_datetime="time",
        latitude="number",
        longitude="number",
        speed_over_ground="number",
        wind_speed="number",
        reference="text",
        wind_speed_units="text",
    ),
    "canbus": _table(
        id="id",
        device_id="id",
        message_datetime="time",
        me_rpm="number",
        me_engine_load="number",
        me_fuel_temp="number",
        me_oil_temp="number",
        me_exhaust_gas_temp_left="number",
        me_exhaust_gas_temp_right="number",
        me_running_hour="number",
    ),
    "weather": _table(
        id="id",
        time="time",
        lat="degrees",
        long="degrees",
        beaufourt="int",
        dss="int",
        wind_direction="number",
        wave_direction="number",
        current_direction="number",
        wind_speed="number",
        wave_height="number",
        current_speed="number",
    ),
    "vps": _table(
        id="id",
        vessel_id="id",
        report_datetime="time",
        status="id",
        distance="number",
        gis_point_id="id",
    ),
    "total_fuel": _table(id="id", vessel_id="id", date_hour="time", consumption="decimal"),
    "alert": _table(
        id="id",
        vessel_id="id",
        device_id="id",
        alert_datetime="time",
        alert_type_id="id",
        latitude="number",
        longitude="number",
    ),
    "device_status": _table(device_id="id", latest_timestamp="time"),
    "image": _table(id="id", device_serial="text", image="text", create_datetime="time"),
    "vessel": _table(
        id="id",
        imo="id",
        mmsi="id",
        name="text",
        customer_id="id",
        fleet_type_id="id",
        vessel_type_id="id",
        is_active="flag",
        dwt="number",
        service_speed="number",
        flag="text",
        image="text",
        additional_info="text",
    ),
    "customer": _table(id="id", name="text"),
    "vessel_type": _table(id="id", name="text", family="text"),
    "fleet_type": _table(id="id", name="text"),
    "device": _table(
        device_id="id",
        vessel_id="id",
        engine_id="id",
        device_type_id="id",
        label_name="text",
        is_active="flag",
    ),
    "engine": _table(
        id="id",
        vessel_id="id",
        type="text",
        label="text",
        running_hours="number",
        additional_info="text",
    ),
    "alert_type": _table(id="id", severity="int", description="text"),
    "position_status": _table(id="id", name="text", description="text"),
    "gis_point": _table(
        id="id",
        name="text",
        description="text",
        gis_point_type_id="id",
        lat="number",
        long="number",
    ),
    "gis_point_type": _table(id="id", name="text"),
}

# The time column of each fact table, by which it is laid out in day folders.
FACT_TIMES = {
    "interp": "nr_time",
    "unified": "nr_time",
    "customer_unified": "nr_time",
    "ais": "report_datetime",
    "nmea": "message_datetime",
    "canbus": "message_datetime",
    "weather": "time",
    "vps": "report_datetime",
    "total_fuel": "date_hour",
    "alert": "alert_datetime",
    "image": "create_datetime",
}
