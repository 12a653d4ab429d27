"""The input tables straight from a database, read in parallel.

A fact table is read in time ranges, one task each: the bounds become
predicates on the indexed time column, so the database filters before it sends.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession

from wakeline.functions.times import Moment, as_datetime
from wakeline.schemas import FACT_TIMES, TABLES

# The database name of each input table.
DATABASE_TABLES = {
    "interp": "core.interpolated_data",
    "unified": "core.unified_data",
    "customer_unified": "core.customer_unified_data",
    "ais": "core.ais_report_data",
    "nmea": "core.nmea_report_data",
    "canbus": "core.canbus_report_data",
    "weather": "core.weather_data",
    "vps": "core.vessel_position_status",
    "total_fuel": "core.total_fuel_consumption",
    "alert": "core.alert",
    "device_status": "core.device_status",
    "image": "core.image_capture_from_cctv",
    "vessel": "core.vessel",
    "customer": "core.customer",
    "vessel_type": "core.vessel_type",
    "fleet_type": "core.fleet_type",
    "device": "core.device",
    "engine": "core.engine",
    "alert_type": "core.alert_type",
    "position_status": "core.position_status",
    "gis_point": "core.gis_point",
    "gis_point_type": "core.gis_point_type",
}


def time_ranges(start: Moment, end: Moment, step: timedelta) -> Iterator[tuple[datetime, datetime]]:
    """Half-open ranges that cover ``start`` to ``end`` without overlap."""
    low, last = as_datetime(start), as_datetime(end)
    while low <= last:
        high = low + step
        yield low, high
        low = high


def range_predicates(column: str, start: Moment, end: Moment, step: timedelta) -> list[str]:
    """One predicate per task; the last one ends with ``end`` itself."""
    last = as_datetime(end)
    predicates = []
    for low, high in time_ranges(start, end, step):
        upper = f"{column} < '{high}'" if high <= last else f"{column} <= '{last}'"
        predicates.append(f"{column} >= '{low}' and {upper}")
    return predicates


def read_table(
    spark: SparkSession,
    url: str,
    table: str,
    start: Moment | None = None,
    end: Moment | None = None,
    step: timedelta = timedelta(days=1),
    properties: dict[str, str] | None = None,
) -> DataFrame:
    """A table of the database under its column names here."""
    options = {"fetchsize": "10000", "preferTimestampNTZ": "true", **(properties or {})}
    source = DATABASE_TABLES[table]
    if table in FACT_TIMES:
        if start is None or end is None:
            raise ValueError("a fact table is read for a window: give start and end")
        predicates = range_predicates(FACT_TIMES[table], start, end, step)
        frame = spark.read.jdbc(url, source, predicates=predicates, properties=options)
    else:
        frame = spark.read.jdbc(url, source, properties=options)
    wanted = [f for f in TABLES[table].fields if f.name in frame.columns]
    return frame.select(*[frame[f.name].cast(f.dataType).alias(f.name) for f in wanted])
