"""Noon report and unified data set."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wakeline.functions.frames import number, pick_vessels
from wakeline.functions.sizing import broadcast_if_small
from wakeline.functions.slices import slice_offsets, time_slice
from wakeline.functions.times import Moment, as_datetime, day_of, within

# Device types, the wind readings that count, report engine types
# and the telemetry engines whose rpm is shown.
NMEA_DEVICE_TYPE = 3
ENGINE_DEVICE_TYPE = 1
TRUE_WIND, METRES_PER_SECOND = "T", "M"
COUNTED_WIND = f"reference = '{TRUE_WIND}' and wind_speed_units = '{METRES_PER_SECOND}'"
NOON_ENGINES = {"c_hours": "ME_CENTRE", "p_hours": "ME_PORT", "s_hours": "ME_STBD"}
RPM_LABELS = ("ME1", "ME2", "ME3")
TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"


def _days(frame: DataFrame, moment: str, first: date | None, last: date | None) -> DataFrame:
    """Rows of the days ``first`` to ``last``, both included."""
    after = None if last is None else as_datetime(last) + timedelta(days=1)
    start = None if first is None else as_datetime(first)
    return within(frame, moment, start, after, half_open=True)


def daily_fuel(
    total_fuel: DataFrame,
    first: date | None = None,
    last: date | None = None,
    vessel_ids: Iterable[int] | None = None,
    vessel: DataFrame | None = None,
) -> DataFrame:
    """Hourly consumption added up per vessel and day."""
    sums = (
        _days(pick_vessels(total_fuel, vessel_ids), "date_hour", first, last)
        .groupBy("vessel_id", day_of("date_hour", "day"))
        .agg(F.sum("consumption").alias("total_consumption"))
    )
    return pick_vessels(sums, None, vessel)


def daily_wind(
    nmea: DataFrame,
    device: DataFrame,
    first: date | None = None,
    last: date | None = None,
    vessel_ids: Iterable[int] | None = None,
) -> DataFrame:
    """Range of the true wind per vessel and day, also as ``min-max MPS`` text.

    Readings are reduced per device and day before the device table is joined.
    """
    per_device = (
        _days(nmea, "message_datetime", first, last)
        .where(COUNTED_WIND)
        .groupBy("device_id", day_of("message_datetime", "day"))
        .agg(F.min("wind_speed").alias("low"), F.max("wind_speed").alias("high"))
    )
    return wind_of_devices(per_device, device, vessel_ids)


def wind_of_devices(
    per_device: DataFrame, device: DataFrame, vessel_ids: Iterable[int] | None = None
) -> DataFrame:
    """N2 from the range ``low`` to ``high`` of each device and day."""
    anemometers = pick_vessels(device, vessel_ids).where(
        F.col("device_type_id") == NMEA_DEVICE_TYPE
    )
    return (
        per_device.join(anemometers.select("device_id", "vessel_id"), "device_id")
        .groupBy("vessel_id", "day")
        .agg(number(F.min("low")).alias("min_wind"), number(F.max("high")).alias("max_wind"))
        .withColumn(
            "wind_speed",
            F.concat(
                F.col("min_wind").cast("string"),
                F.lit("-"),
                F.col("max_wind").cast("string"),
                F.lit(" MPS"),
            ),
        )
    )


def daily_engine_hours(
    canbus: DataFrame,
    device: DataFrame,
    engine: DataFrame,
    first: date | None = None,
    last: date | None = None,
    vessel_ids: Iterable[int] | None = None,
) -> DataFrame:
    """Run hours gained per vessel, day and engine type; 0 when never read."""
    per_device = (
        _days(canbus, "message_datetime", first, last)
        .groupBy("device_id", day_of("message_datetime", "day"))
        .agg(F.min("me_running_hour").alias("low"), F.max("me_running_hour").alias("high"))
    )
    return hours_of_devices(per_device, device, engine, vessel_ids)


def hours_of_devices(
    per_device: DataFrame,
    device: DataFrame,
    engine: DataFrame,
    vessel_ids: Iterable[int] | None = None,
) -> DataFrame:
    """N3 from the run hours ``low`` to ``high`` of each device and day."""
    sensors = device.where(F.col("device_type_id") == ENGINE_DEVICE_TYPE).select(
        "device_id", F.col("engine_id").alias("id")
    )
    owners = pick_vessels(engine, vessel_ids).select("id", "vessel_id", "type")
    return (
        per_device.join(sensors.join(owners, "id"), "device_id")
        .groupBy("vessel_id", "day", "type")
        .agg(
            number(F.coalesce(F.max("high") - F.min("low"), F.lit(0))).alias("run_hours")
        )
    )


def noon_report(
    vessel: DataFrame,
    total_fuel: DataFrame,
    nmea: DataFrame,
    canbus: DataFrame,
    device: DataFrame,
    engine: DataFrame,
    first: date,
    last: date,
    vessel_ids: Iterable[int] | None = None,
) -> DataFrame:
    """One row per vessel and day: fuel total, wind range and run hours per engine.

    Missing text reads 'N/A', missing hours 0.
    """
    fuel = daily_fuel(total_fuel, first, last, vessel_ids)
    wind = daily_wind(nmea, device, first, last, vessel_ids)
    hours = (
        daily_engine_hours(canbus, device, engine, first, last, vessel_ids)
        .groupBy("vessel_id", "day")
        .pivot("type", list(NOON_ENGINES.values()))
        .agg(F.max("run_hours"))
    )
    days = F.sequence(F.lit(as_datetime(first).date()), F.lit(as_datetime(last).date()))
    asked = pick_vessels(vessel, vessel_ids, key="id").select(
        F.col("id").alias("vessel_id"),
        F.col("name").alias("vessel_name"),
        F.explode(days).alias("day"),
    )
    keys = ["vessel_id", "day"]
    return (
        asked.join(fuel, keys, "left")
        .join(wind, keys, "left")
        .join(hours, keys, "left")
        .select(
            "vessel_id",
            "vessel_name",
            F.col("day").alias("report_date"),
            F.coalesce(F.col("total_consumption").cast("string"), F.lit("N/A")).alias(
                "total_consumption"
            ),
            F.coalesce("wind_speed", F.lit("N/A")).alias("wind_speed"),
            *[
                F.coalesce(F.col(kind), F.lit(0.0)).alias(name)
                for name, kind in NOON_ENGINES.items()
            ],
        )
    )


def _midnights(start: Moment, end: Moment) -> tuple[Moment, Moment]:
    return as_datetime(as_datetime(start).date()), as_datetime(as_datetime(end).date())


def _reporting_rows(
    interp: DataFrame, start: Moment, end: Moment, vessel_ids: Iterable[int] | None
) -> DataFrame:
    """Telemetry of the days from ``start`` up to, not including, ``end``."""
    first, after = _midnights(start, end)
    return within(pick_vessels(interp, vessel_ids), "nr_time", first, after, half_open=True)


def _equipped(rows: DataFrame, device: DataFrame) -> DataFrame:
    """Leave out vessels without any device."""
    return rows.join(device.select("vessel_id"), "vessel_id", "left_semi")


def _with_rpm(
    rows: DataFrame,
    canbus: DataFrame,
    device: DataFrame,
    start: Moment,
    end: Moment,
    vessel_ids: Iterable[int] | None,
    instants: DataFrame | None = None,
) -> DataFrame:
    """Add ``me1_rpm`` to ``me3_rpm`` read at the row's own time.

    The CAN bus is reduced to one row per (vessel, time) first, so telemetry is
    never multiplied by devices. ``instants`` names the (vessel, time) pairs that
    matter when they are few.
    """
    first, after = _midnights(start, end)
    main = pick_vessels(device, vessel_ids).where(F.col("label_name").isin(*RPM_LABELS))

    def rpm(label: str) -> Column:
        value = F.when(F.col("label_name") == label, F.col("me_rpm"))
        return F.max(value).alias(f"{label.lower()}_rpm")

    readings = (
        within(canbus, "message_datetime", first, after, half_open=True)
        .withColumnRenamed("message_datetime", "nr_time")
        .join(main.select("device_id", "vessel_id", "label_name"), "device_id")
    )
    if instants is not None:
        readings = readings.join(instants, ["vessel_id", "nr_time"], "left_semi")
    readings = readings.groupBy("vessel_id", "nr_time").agg(*[rpm(c) for c in RPM_LABELS])
    return rows.join(readings, ["vessel_id", "nr_time"], "left").select(
        *[f"{label.lower()}_rpm" for label in RPM_LABELS], *[rows[c] for c in rows.columns]
    )


def unified_dataset(
    interp: DataFrame,
    device: DataFrame,
    canbus: DataFrame,
    start: Moment,
    end: Moment,
    vessel_ids: Iterable[int] | None = None,
) -> DataFrame:
    """Telemetry rows with the main engines' rpm read at the same time.

    Whole days, from the start date up to but not including the end date.
    """
    rows = _equipped(_reporting_rows(interp, start, end, vessel_ids), device).drop("day")
    return _with_rpm(rows, canbus, device, start, end, vessel_ids)


def page(
    interp: DataFrame,
    device: DataFrame,
    canbus: DataFrame,
    vessel: DataFrame,
    start: Moment,
    end: Moment,
    page_number: int = 1,
    page_size: int = 20,
    vessel_ids: Iterable[int] | None = None,
) -> DataFrame:
    """One page of each vessel's unified data set, newest first, with totals.

    Rows are counted per (vessel, hour) and the counts added up from the newest
    hour down, which tells the hours the page falls in. Those are counted again per
    minute, and only the minutes of the page are ordered and joined to the CAN bus;
    depth of the page and length of the history cost nothing more. On a table in
    ``day`` folders the second and third reading open the days of those hours only.
    """
    if page_size < 1 or page_number < 1:
        raise ValueError("page number and page size must be greater than 0")
    offset = (page_number - 1) * page_size
    rows = _reporting_rows(interp, start, end, vessel_ids).withColumns(
        {"page_slice": time_slice("nr_time"), "page_minute": time_slice("nr_time", 1)}
    )
    on_it = (F.col("rows_before") < offset + page_size) & (
        F.col("rows_before") + F.col("slice_rows") > offset
    )
    counted = slice_offsets(rows, ["vessel_id"], "page_slice", descending=True).where(on_it)
    # A page overlaps at most ``page_size`` hours of a vessel with devices, and as many minutes.
    hours = broadcast_if_small(
        _equipped(counted, device)
        .withColumnRenamed("rows_before", "hours_before")
        .drop("slice_rows")
        .withColumns({"day": day_of("page_slice")} if "day" in rows.columns else {}),
        device,
        page_size,
    )
    keys = ["vessel_id", "page_slice", *(["day"] if "day" in rows.columns else [])]
    in_hours = rows.join(hours, keys).drop("day")
    # Minutes are counted within their hour, which the hour's own count then places.
    minutes = (
        slice_offsets(in_hours, ["vessel_id", "hours_before", "page_slice"], "page_minute", descending=True)
        .withColumn("rows_before", F.col("hours_before") + F.col("rows_before"))
        .where(on_it)
        .select("vessel_id", "page_minute", F.col("rows_before").alias("minutes_before"))
    )
    candidates = in_hours.join(
        broadcast_if_small(minutes, device, page_size), ["vessel_id", "page_minute"]
    )
    newest_down = Window.partitionBy("vessel_id", "page_minute").orderBy(
        F.col("nr_time").desc(), F.col("id").desc()
    )
    on_page = (
        candidates.withColumn("row_index", F.row_number().over(newest_down) - 1 + F.col("minutes_before"))
        .where(F.col("row_index").between(offset, offset + page_size - 1))
        .drop("page_slice", "page_minute", "hours_before", "minutes_before")
    )
    instants = broadcast_if_small(on_page.select("vessel_id", "nr_time"), device, page_size)
    full = _with_rpm(on_page, canbus, device, start, end, vessel_ids, instants)
    return full.select(
        *[c for c in full.columns if c not in ("row_index", "total_rows")],
        F.col("row_index").cast("bigint").alias("row_index"),
        F.lit(page_number).alias("page_number"),
        F.lit(offset).alias("page_offset"),
        F.lit(page_size).alias("page_size"),
        F.col("total_rows").cast("bigint").alias("total_rows"),
        F.floor(F.col("total_rows") / page_size).alias("total_pages"),
    )


def export_csv(unified: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The unified data set as CSV with a header, one folder per vessel, newest first.

    Rows are dealt by ranges of (vessel, time), newest first, so a vessel of any size
    is spread over writers and the parts of its folder follow each other by
    name. ``_manifest`` in the same folder lists them: vessel, number, file, rows, and the
    newest and oldest time; parts put together by number are the vessel's whole data set.
    """
    order = [F.col("vessel"), F.col("nr_time").desc(), F.col("id").desc()]
    (
        unified.withColumn("vessel", F.col("vessel_id"))
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .write.mode(mode)
        .option("header", True)
        .option("timestampNTZFormat", TIME_FORMAT)
        .partitionBy("vessel")
        .csv(path)
    )
    parts = (
        _exported(unified.sparkSession, path, unified.schema)
        .groupBy("vessel_id", F.col("_metadata.file_path").alias("file"))
        .agg(F.count(F.lit(1)).alias("rows"), F.max("nr_time").alias("newest"), F.min("nr_time").alias("oldest"))
    )
    by_name = Window.partitionBy("vessel_id").orderBy(F.element_at(F.split("file", "/"), -1))
    # One row per file written.
    (
        parts.withColumn("number", F.row_number().over(by_name))
        .select("vessel_id", "number", "file", "rows", "newest", "oldest")
        .write.mode("overwrite")
        .json(f"{path}/_manifest")
    )


def _exported(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def read_export(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """An export's rows, in no order; the manifest gives that of its files."""
    return _exported(spark, path, schema).select(*schema.names)
