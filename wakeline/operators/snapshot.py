"""Real-time snapshot and composites."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.functions.frames import long_rows, number, pick_vessels
from wakeline.functions.latest import latest_per, newest
from wakeline.functions.recent import recent_first
from wakeline.functions.sizing import broadcast_if_small
from wakeline.functions.times import (
    FRESH_MINUTES,
    Moment,
    as_datetime,
    at_instants,
    instant,
    within,
)
from wakeline.operators.positions import ais_track, latest_position, newest_ais, track
from wakeline.operators.series import (
    AUX_ENGINES,
    MAIN_ENGINES,
    playback_columns,
    sensor_columns,
    sensor_devices,
    vessel_playback,
)
from wakeline.operators.status import latest_status, status_history
from wakeline.operators.weather import latest_weather, weather_history

ENGINES = (*MAIN_ENGINES, *AUX_ENGINES)
SENSOR_VALUES = (
    "rpm",
    "engine_load",
    "fuel_temp",
    "exhaust_gas_temp_left",
    "exhaust_gas_temp_right",
)


def fresh_since(as_of: Moment, minutes: int) -> Moment:
    return as_datetime(as_of) - timedelta(minutes=minutes)


def fresh(
    interp: DataFrame,
    as_of: Moment,
    minutes: int = FRESH_MINUTES,
    vessel_ids: Iterable[int] | None = None,
) -> DataFrame:
    """Telemetry of the last ``minutes`` before ``as_of``, under its short names."""
    start = fresh_since(as_of, minutes)
    return (
        within(pick_vessels(interp, vessel_ids), "nr_time", start, as_of)
        .where(F.col("nr_time") > instant(start))
        .select("id", "vessel_id", *playback_columns())
    )


def completeness() -> Column:
    """0 to 3: main-engine fuel, auxiliary fuel and navigation, a point for each
    group with a value that is neither null nor zero."""
    groups = (
        [f"{e}_fuel_cons" for e in MAIN_ENGINES],
        [f"{e}_fuel_cons" for e in AUX_ENGINES],
        ["lat", "long", "sog", "direction"],
    )
    score = F.lit(0)
    for names in groups:
        filled = F.lit(False)
        for name in names:
            filled = filled | F.coalesce(F.col(name) != 0, F.lit(False))
        score = score + filled.cast("int")
    return score


def most_complete(fresh_rows: DataFrame) -> DataFrame:
    """R2: per vessel the fresh row with the highest completeness, newest on a tie."""
    scored = fresh_rows.withColumn("score", completeness())
    order = ("score", "timestamp", "id")
    values = [c for c in scored.columns if c not in ("vessel_id", *order)]
    # Few rows: only the fresh ones come here.
    best = scored.groupBy("vessel_id").agg(F.max(F.struct(*order, *values)).alias("best"))
    return best.select("vessel_id", "best.*").drop("id")


def by_engine(rows: DataFrame) -> DataFrame:
    """Flat telemetry columns regrouped to one row per engine."""
    structs = []
    for engine in ENGINES:
        power = f"{engine}_power"
        structs.append(
            F.struct(
                F.lit(engine).alias("engine"),
                F.col(f"{engine}_fuel_cons").alias("fuel_cons"),
                (F.col(power) if power in rows.columns else F.lit(None).cast("double")).alias(
                    "power"
                ),
            )
        )
    return long_rows(rows, ["vessel_id", "timestamp"], structs)


def engine_sensors(
    chosen: DataFrame,
    device: DataFrame,
    engine: DataFrame,
    canbus: DataFrame,
    label: str | None = None,
    start: Moment | None = None,
    end: Moment | None = None,
) -> DataFrame:
    """CAN bus readings of each engine sensor at its vessel's chosen instant.

    ``chosen`` has one row per vessel (``vessel_id, timestamp``); ``start`` and
    ``end`` bound those times when they are known, and so the CAN bus scan. A
    sensor that was silent then has null readings; several reports at one instant
    resolve to the highest id.
    """
    wanted = sensor_devices(device, engine, label).join(
        chosen.select("vessel_id", "timestamp"), "vessel_id"
    )
    instants = broadcast_if_small(
        wanted.select("device_id", F.col("timestamp").alias("message_datetime")), device
    )
    readings = latest_per(
        at_instants(
            within(canbus, "message_datetime", start, end),
            instants,
            ["device_id", "message_datetime"],
        ).select("id", "device_id", *sensor_columns()),
        ["device_id"],
        ["id"],
        SENSOR_VALUES,
    )
    return wanted.join(readings, "device_id", "left").select(
        "vessel_id", "device_id", "label", "timestamp", *SENSOR_VALUES, "running_hour"
    )


def last_positive_run_hours(
    unified: DataFrame,
    vessel_ids: Iterable[int] | None = None,
    vessel: DataFrame | None = None,
    since: Moment | None = None,
) -> DataFrame:
    """Per vessel and main engine the newest positive run hours and when they were read.

    ``since`` reads recent rows first; vessels of ``vessel`` with an engine that has
    none there are looked up in the whole history.
    """
    order = ("nr_time", "id")

    def find(rows: DataFrame) -> DataFrame:
        return rows.groupBy("vessel_id").agg(
            *[
                newest(e, order, (f"{e}_run_hours",), f"{e}_run_hours > 0")
                for e in MAIN_ENGINES
            ]
        )

    complete = F.expr(" and ".join(f"{e} is not null" for e in MAIN_ENGINES))
    found = recent_first(
        pick_vessels(unified, vessel_ids), "nr_time", since, vessel, find, complete
    )
    rows = [
        F.struct(
            F.lit(e).alias("engine"),
            number(f"{e}.{e}_run_hours", "running_hour"),
            F.col(f"{e}.nr_time").alias("running_hours_timestamp"),
        )
        for e in MAIN_ENGINES
    ]
    return long_rows(found, ["vessel_id"], rows).where(F.col("running_hour").isNotNull())


def is_running(fuel_cons: Column) -> Column:
    """Fuel consumption is known and above zero."""
    return F.coalesce(fuel_cons > 0, F.lit(False))


def engine_real_time(
    interp: DataFrame,
    unified: DataFrame,
    device: DataFrame,
    engine: DataFrame,
    canbus: DataFrame,
    as_of: Moment,
    minutes: int = FRESH_MINUTES,
    vessel_ids: Iterable[int] | None = None,
    vessel: DataFrame | None = None,
    since: Moment | None = None,
) -> DataFrame:
    """R1 to R6 together: one row per vessel and engine.

    Run hours come from the engine's sensor; missing or not positive, from the
    raw telemetry, with the time of that reading. A vessel without fresh
    telemetry still shows the latter for its main engines. ``since`` and ``vessel``
    are for those (see R5).
    """
    best = most_complete(fresh(interp, as_of, minutes, vessel_ids))
    window = (fresh_since(as_of, minutes), as_of)
    sensors = (
        engine_sensors(best, device, engine, canbus, None, *window)
        .withColumn("engine", F.lower("label"))
        .groupBy("vessel_id", "engine")
        .agg(F.max(F.struct("device_id", *SENSOR_VALUES, "running_hour")).alias("sensor"))
        .select("vessel_id", "engine", "sensor.*")
        .drop("device_id")
    )
    read = last_positive_run_hours(unified, vessel_ids, vessel, since).withColumnRenamed(
        "running_hour", "read_hours"
    )
    merged = (
        by_engine(best)
        .join(sensors, ["vessel_id", "engine"], "left")
        .join(read, ["vessel_id", "engine"], "full")
    )
    is_main = F.col("engine").isin(*MAIN_ENGINES)
    known = F.coalesce(F.col("running_hour") > 0, F.lit(False))
    return merged.select(
        "vessel_id",
        "engine",
        "timestamp",
        "fuel_cons",
        "power",
        is_running(F.col("fuel_cons")).alias("is_running"),
        *SENSOR_VALUES,
        F.when(is_main & ~known, F.coalesce("read_hours", F.lit(0.0)))
        .otherwise(F.col("running_hour"))
        .alias("running_hour"),
        F.when(is_main & ~known, F.col("running_hours_timestamp")).alias(
            "running_hours_timestamp"
        ),
    )


def _as_record(frame: DataFrame, name: str) -> DataFrame:
    values = [c for c in frame.columns if c != "vessel_id"]
    return frame.select("vessel_id", F.struct(*values).alias(name))


def vessel_snapshot(
    vessel: DataFrame,
    interp: DataFrame,
    unified: DataFrame,
    ais: DataFrame,
    weather: DataFrame,
    device: DataFrame,
    engine: DataFrame,
    canbus: DataFrame,
    vessel_status: DataFrame,
    position_status: DataFrame,
    gis_point: DataFrame,
    gis_point_type: DataFrame,
    as_of: Moment,
    minutes: int = FRESH_MINUTES,
    vessel_ids: Iterable[int] | None = None,
    since: Moment | None = None,
) -> DataFrame:
    """One nested record per vessel: fresh telemetry, engines, both positions,
    weather and status. Parts without data are null. ``since`` reads recent rows
    first."""
    asked = pick_vessels(vessel, vessel_ids, key="id")
    best = most_complete(fresh(interp, as_of, minutes, vessel_ids))
    engines = ("me1", "me2", "me3", "ae1", "ae2")
    by_label = F.lower("label")
    window = (fresh_since(as_of, minutes), as_of)
    sensors = (
        engine_sensors(best, device, engine, canbus, None, *window)
        .groupBy("vessel_id")
        .agg(
            *[
                F.max(
                    F.when(by_label == e, F.struct("device_id", *SENSOR_VALUES, "running_hour"))
                ).alias(f"{e}_sensor")
                for e in engines
            ]
        )
    )

    def engine_record(name: str) -> Column:
        fields = [F.col("timestamp"), F.col(f"{name}_fuel_cons").alias("fuel_cons")]
        if name in AUX_ENGINES:
            fields.append(F.col(f"{name}_power").alias("power"))
        else:
            fields += [
                F.col(f"{name}_sensor.{v}").alias(v) for v in (*SENSOR_VALUES, "running_hour")
            ]
        return F.struct(*fields).alias(name)

    current = best.join(sensors, "vessel_id", "left").select(
        "vessel_id",
        "timestamp",
        "lat",
        "long",
        "direction",
        "sog",
        "stw",
        *[engine_record(e) for e in engines],
    )
    # The last joins leave out what belongs to no vessel asked for; only a look at recent
    # rows first has to know them before.
    looked_for = None if since is None else asked
    own = latest_position(interp, vessel_ids, looked_for, since)
    other = newest_ais(pick_vessels(ais, vessel_ids), looked_for, since)
    sky = latest_weather(unified, weather, vessel_ids, looked_for, since)
    state = latest_status(
        vessel_status, position_status, gis_point, gis_point_type, vessel_ids, looked_for, since
    )
    return (
        asked.select(F.col("id").alias("vessel_id"))
        .join(current, "vessel_id", "left")
        .join(_as_record(own, "position"), "vessel_id", "left")
        .join(_as_record(other, "ais_position"), "vessel_id", "left")
        .join(_as_record(sky, "weather"), "vessel_id", "left")
        .join(_as_record(state, "status"), "vessel_id", "left")
    )


def vessel_playback_bundle(
    interp: DataFrame,
    unified: DataFrame,
    ais: DataFrame,
    weather: DataFrame,
    vessel_status: DataFrame,
    position_status: DataFrame,
    gis_point: DataFrame,
    gis_point_type: DataFrame,
    start: Moment,
    end: Moment,
    vessel_ids: Iterable[int] | None = None,
    vessel: DataFrame | None = None,
    since: Moment | None = None,
) -> DataFrame:
    """Telemetry, both tracks, weather and statuses of a window as one tagged frame.

    ``kind`` names the part; each part's values sit in the record of that name.
    ``since`` says where the course before the window is looked for first (see P1).
    """
    parts = {
        "engine": vessel_playback(interp, start, end, vessel_ids),
        "position": track(interp, start, end, vessel_ids, vessel, since=since),
        "ais_position": ais_track(ais, start, end, vessel_ids),
        "weather": weather_history(unified, weather, start, end, vessel_ids),
        "status": status_history(
            vessel_status, position_status, gis_point, gis_point_type, start, end, vessel_ids
        ),
    }
    bundle: DataFrame | None = None
    for kind, frame in parts.items():
        values = [c for c in frame.columns if c not in ("vessel_id", "timestamp")]
        tagged = frame.select(
            "vessel_id", F.lit(kind).alias("kind"), "timestamp", F.struct(*values).alias(kind)
        )
        bundle = (
            tagged if bundle is None else bundle.unionByName(tagged, allowMissingColumns=True)
        )
    return bundle
