"""Binned and gap-filled series, and playback."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.functions.frames import long_rows, mean, number, pick_vessels, total_sql
from wakeline.functions.recent import recent_first
from wakeline.functions.sizing import broadcast_if_small
from wakeline.functions.spine import gap_fill
from wakeline.functions.times import Moment, floor_to_grid, time_bin, within

# Engine labels and parameter names with the columns they read.
MAIN_ENGINES = ("me1", "me2", "me3")
AUX_ENGINES = ("ae1", "ae2", "ae3")
CANBUS_PARAMS = {"rpm": "me_rpm", "fot": "me_fuel_temp", "lot": "me_oil_temp"}
FUEL_PARAM = "cons"
SENSOR_DEVICE_TYPES = (1, 4, 6)


def _any_present(columns: Iterable[str]) -> str:
    return f"coalesce({', '.join(columns)}) is not null"


def speed_series(
    interp: DataFrame,
    vessel: DataFrame,
    start: Moment,
    end: Moment,
    minutes: int = 60,
    vessel_ids: Iterable[int] | None = None,
) -> DataFrame:
    """Mean SOG and STW per bin, on a full grid where empty bins read 0."""
    rows = within(pick_vessels(interp, vessel_ids), "nr_time", start, end)
    bins = (
        rows.where(_any_present(["average_speed_gps", "speed_through_water"]))
        .groupBy("vessel_id", time_bin("nr_time", minutes).alias("bin"))
        .agg(mean("average_speed_gps", "sog"), mean("speed_through_water", "stw"))
    )
    asked = pick_vessels(vessel, vessel_ids, key="id")
    return gap_fill(bins, asked, start, end, minutes, ["sog", "stw"]).withColumnRenamed(
        "bin", "timestamp"
    )


def latest_speed(
    interp: DataFrame,
    vessel: DataFrame,
    minutes: int = 1,
    vessel_ids: Iterable[int] | None = None,
    since: Moment | None = None,
) -> DataFrame:
    """Mean SOG and STW of each vessel's newest bin.

    The newest bin per vessel comes first, so only its rows are averaged and no
    other bin is ever shuffled. ``since`` reads recent rows first, from the
    start of its bin.
    """
    if since is not None:
        since = floor_to_grid(since, minutes)
    return recent_first(
        pick_vessels(interp, vessel_ids),
        "nr_time",
        since,
        vessel,
        lambda rows: _newest_bin(rows, vessel, minutes),
    )


def _newest_bin(interp: DataFrame, vessel: DataFrame, minutes: int) -> DataFrame:
    rows = (
        interp.where(_any_present(["average_speed_gps", "speed_through_water"]))
        .withColumn("timestamp", time_bin("nr_time", minutes))
    )
    last_bins = rows.groupBy("vessel_id").agg(F.max("timestamp").alias("timestamp"))
    in_bin = rows.join(
        broadcast_if_small(pick_vessels(last_bins, None, vessel), vessel),
        ["vessel_id", "timestamp"],
        "left_semi",
    )
    return in_bin.groupBy("vessel_id", "timestamp").agg(
        mean("average_speed_gps", "sog"), mean("speed_through_water", "stw")
    )


def _fuel_bins(
    interp: DataFrame,
    vessel: DataFrame,
    start: Moment,
    end: Moment,
    minutes: int,
    vessel_ids: Iterable[int] | None,
    present: list[str],
    sums: dict[str, str],
) -> DataFrame:
    rows = within(pick_vessels(interp, vessel_ids), "nr_time", start, end)
    bins = (
        rows.where(_any_present(present))
        .groupBy("vessel_id", time_bin("nr_time", minutes).alias("bin"))
        .agg(*[F.expr(f"sum({value}) as {name}") for name, value in sums.items()])
    )
    asked = pick_vessels(vessel, vessel_ids, key="id")
    return gap_fill(bins, asked, start, end, minutes, list(sums))


def engine_rows(engine: str, minutes: int, rates: dict[str, str]) -> Column:
    """A series row of one engine: stamped at the bin's centre, sums per minute."""
    values = ", ".join(
        f"cast({engine}_{measure} as double) / {minutes} as {rate}"
        for measure, rate in rates.items()
    )
    return F.expr(
        f"struct('{engine}' as engine, bin + INTERVAL '{minutes * 30}' SECOND as timestamp, {values})"
    )


def aux_series(
    interp: DataFrame,
    vessel: DataFrame,
    start: Moment,
    end: Moment,
    minutes: int = 60,
    vessel_ids: Iterable[int] | None = None,
) -> DataFrame:
    """Fuel and energy per minute of each auxiliary engine and in total.

    Per bin, gap filled with 0, stamped at the bin centre; one row per engine.
    """
    fuel = [f"{e}_consumption" for e in AUX_ENGINES]
    energy = [f"{e}_energy_produced" for e in AUX_ENGINES]
    sums = {f"{e}_fuel": total_sql(c) for e, c in zip(AUX_ENGINES, fuel)}
    sums |= {f"{e}_energy": total_sql(c) for e, c in zip(AUX_ENGINES, energy)}
    sums |= {"total_fuel": total_sql(*fuel), "total_energy": total_sql(*energy)}
    bins = _fuel_bins(interp, vessel, start, end, minutes, vessel_ids, fuel, sums)
    rates = {"fuel": "fuel_cons", "energy": "power"}
    rows = [engine_rows(engine, minutes, rates) for engine in (*AUX_ENGINES, "total")]
    return long_rows(bins, ["vessel_id"], rows)


def main_series(
    interp: DataFrame,
    vessel: DataFrame,
    start: Moment,
    end: Moment,
    minutes: int = 60,
    vessel_ids: Iterable[int] | None = None,
) -> DataFrame:
    """T4: fuel per minute of each main engine and in total, as T3."""
    fuel = [f"{e}_consumption" for e in MAIN_ENGINES]
    sums = {f"{e}_fuel": total_sql(c) for e, c in zip(MAIN_ENGINES, fuel)}
    sums |= {"total_fuel": total_sql(*fuel)}
    bins = _fuel_bins(interp, vessel, start, end, minutes, vessel_ids, fuel, sums)
    rates = {"fuel": "fuel_cons"}
    rows = [engine_rows(engine, minutes, rates) for engine in (*MAIN_ENGINES, "total")]
    return long_rows(bins, ["vessel_id"], rows)


def engine_params(
    interp: DataFrame,
    canbus: DataFrame,
    device: DataFrame,
    engine: str,
    params: Sequence[str],
    start: Moment,
    end: Moment,
    vessel_ids: Iterable[int] | None = None,
) -> DataFrame:
    """T5: chosen parameters of one engine as ``vessel_id, engine, param, timestamp, value``.

    ``cons`` comes from telemetry, ``rpm``, ``fot`` and ``lot`` from the CAN bus
    of the devices labelled with that engine. Auxiliary engines give no rows.
    """
    unknown = set(params) - {*CANBUS_PARAMS, FUEL_PARAM}
    if unknown:
        raise ValueError(f"unknown parameters: {sorted(unknown)}")
    label = engine.upper()
    is_main = label.lower() in MAIN_ENGINES
    keep = ["vessel_id", "engine", "timestamp"]

    fuel_column = f"{label.lower()}_consumption" if is_main else "me1_consumption"
    fuel = within(pick_vessels(interp, vessel_ids), "nr_time", start, end).select(
        F.col("vessel_id").cast("bigint").alias("vessel_id"),
        F.lit(label).alias("engine"),
        F.lit(FUEL_PARAM).alias("param"),
        F.col("nr_time").alias("timestamp"),
        number(fuel_column, "value"),
    )
    if not is_main:
        return fuel.where(F.lit(False))
    frames = [fuel] if FUEL_PARAM in params else []
    sensors = [p for p in params if p in CANBUS_PARAMS]
    if sensors:
        fitted = pick_vessels(device, vessel_ids).where(F.col("label_name") == label)
        readings = (
            within(canbus, "message_datetime", start, end)
            .join(fitted.select("device_id", "vessel_id"), "device_id")
            .select(
                F.col("vessel_id").cast("bigint").alias("vessel_id"),
                F.lit(label).alias("engine"),
                F.col("message_datetime").alias("timestamp"),
                *[CANBUS_PARAMS[p] for p in sensors],
            )
        )
        rows = [
            F.struct(F.lit(p).alias("param"), number(CANBUS_PARAMS[p]).alias("value"))
            for p in sensors
        ]
        frames.append(long_rows(readings, keep, rows))
    if not frames:
        return fuel.where(F.lit(False))
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result


def playback_columns() -> list[Column]:
    """Telemetry under its short names."""
    columns = [
        F.expr("nr_time as timestamp"),
        number("longitude", "long"),
        number("latitude", "lat"),
        number("course", "direction"),
        number("average_speed_gps", "sog"),
        number("speed_through_water", "stw"),
    ]
    columns += [number(f"{e}_consumption", f"{e}_fuel_cons") for e in MAIN_ENGINES]
    for engine in AUX_ENGINES:
        columns.append(number(f"{engine}_consumption", f"{engine}_fuel_cons"))
        columns.append(number(f"{engine}_energy_produced", f"{engine}_power"))
    return columns


def vessel_playback(
    interp: DataFrame,
    start: Moment,
    end: Moment,
    vessel_ids: Iterable[int] | None = None,
    vessel: DataFrame | None = None,
) -> DataFrame:
    """Every telemetry row of the window under its short names."""
    rows = within(pick_vessels(interp, vessel_ids, vessel), "nr_time", start, end)
    return rows.select("vessel_id", *playback_columns())


def sensor_columns() -> list[Column]:
    """CAN bus readings under their short names."""
    return [
        number("me_rpm", "rpm"),
        number("me_engine_load", "engine_load"),
        number("me_fuel_temp", "fuel_temp"),
        number("me_exhaust_gas_temp_left", "exhaust_gas_temp_left"),
        number("me_exhaust_gas_temp_right", "exhaust_gas_temp_right"),
    ]


def sensor_devices(device: DataFrame, engine: DataFrame, label: str | None = None) -> DataFrame:
    """Active engine sensors (device types 1, 4, 6) with their engine's run hours."""
    sensors = device.where(
        F.col("device_type_id").isin(*SENSOR_DEVICE_TYPES) & F.col("is_active")
    )
    if label is not None:
        sensors = sensors.where(F.col("label_name") == label.upper())
    engines = engine.select(
        F.col("id").alias("engine_id"), number("running_hours", "running_hour")
    )
    return sensors.join(engines, "engine_id").select(
        "device_id", "vessel_id", F.col("label_name").alias("label"), "running_hour"
    )


def engine_playback(
    interp: DataFrame,
    canbus: DataFrame,
    device: DataFrame,
    engine_table: DataFrame,
    engine: str,
    start: Moment,
    end: Moment,
    vessel_ids: Iterable[int] | None = None,
) -> DataFrame:
    """CAN bus rows of one engine's devices with that engine's fuel at the same time."""
    name = engine.lower()
    fitted = pick_vessels(sensor_devices(device, engine_table, engine), vessel_ids)
    readings = (
        within(canbus, "message_datetime", start, end)
        .join(broadcast_if_small(fitted, device), "device_id")
        .select(
            "vessel_id",
            F.lit(engine.upper()).alias("engine"),
            F.col("message_datetime").alias("timestamp"),
            *sensor_columns(),
            "running_hour",
        )
    )
    fuel = (
        within(pick_vessels(interp, vessel_ids), "nr_time", start, end)
        .groupBy("vessel_id", F.col("nr_time").alias("timestamp"))
        .agg(number(F.max_by(f"{name}_consumption", "id")).alias("fuel_cons"))
    )
    return readings.join(fuel, ["vessel_id", "timestamp"], "left")
