"""Weather on the ship's path.

Telemetry meets the weather grid on hour and 0.1-degree cell. A ship sends many
rows from one cell in an hour, so wherever only the newest row matters the
telemetry is reduced to one row per (vessel, cell) on the map side before the
join; a ship that lies in port for a week costs one row per hour.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.functions.frames import number, pick_vessels
from wakeline.functions.latest import newest
from wakeline.functions.recent import recent_first
from wakeline.functions.times import Moment, floor_to_grid, within
from wakeline.functions.weather import CELL, KNOTS_PER_MPS, added_resistance, grid, with_cell

_DIRECTIONS = ("current_direction", "wave_direction", "wind_direction")
_SCALES = ("beaufourt", "dss")


def newest_on_grid(
    telemetry: DataFrame,
    weather: DataFrame,
    readings: Sequence[str],
    values: Sequence[str],
    vessel: DataFrame | None = None,
) -> DataFrame:
    """Per vessel the newest telemetry row that has weather.

    Columns: ``vessel_id, nr_time``, the telemetry ``readings``, ``wx_hour`` and
    the weather ``values``.
    """
    legs = (
        with_cell(telemetry)
        .where(F.col("wx_lat").isNotNull() & F.col("wx_long").isNotNull())
        .groupBy("vessel_id", *CELL)
        .agg(newest("seen", ("nr_time", "id"), ("id", *readings)))
    )
    return (
        pick_vessels(legs, None, vessel)
        .join(grid(weather, *values), list(CELL))
        .groupBy("vessel_id")
        .agg(F.max(F.struct("seen", "wx_hour", *values)).alias("newest"))
        .select(
            "vessel_id",
            "newest.seen.nr_time",
            *[f"newest.seen.{c}" for c in readings],
            "newest.wx_hour",
            *[f"newest.{c}" for c in values],
        )
    )


def _weather_fields() -> list[Column]:
    return [
        *[number(c, c) for c in _DIRECTIONS],
        *[F.col(c).cast("int").alias(c) for c in _SCALES],
    ]


def latest_weather(
    unified: DataFrame,
    weather: DataFrame,
    vessel_ids: Iterable[int] | None = None,
    vessel: DataFrame | None = None,
    since: Moment | None = None,
) -> DataFrame:
    """Weather at the newest telemetry row that has any.

    ``since`` reads recent rows first, and only the weather from then on for them.
    """
    values = [*_DIRECTIONS, *_SCALES]
    return recent_first(
        pick_vessels(unified, vessel_ids),
        "nr_time",
        since,
        vessel,
        lambda rows: newest_on_grid(rows, weather, [], values, vessel),
        find_recent=lambda rows: newest_on_grid(rows, _since(weather, since), [], values, vessel),
    ).select("vessel_id", F.col("wx_hour").alias("timestamp"), *_weather_fields())


def _since(weather: DataFrame, since: Moment | None) -> DataFrame:
    return weather if since is None else within(weather, "time", floor_to_grid(since, 60))


def _during(weather: DataFrame, start: Moment, end: Moment) -> DataFrame:
    return within(weather, "time", floor_to_grid(start, 60), end)


def weather_history(
    unified: DataFrame,
    weather: DataFrame,
    start: Moment,
    end: Moment,
    vessel_ids: Iterable[int] | None = None,
    vessel: DataFrame | None = None,
) -> DataFrame:
    """Weather of every telemetry row in the window that has any."""
    rows = within(pick_vessels(unified, vessel_ids, vessel), "nr_time", start, end)
    hours = grid(_during(weather, start, end), *_DIRECTIONS, *_SCALES)
    return (
        with_cell(rows)
        .select("vessel_id", "nr_time", *CELL)
        .join(hours, list(CELL))
        .select("vessel_id", F.col("wx_hour").alias("timestamp"), "nr_time", *_weather_fields())
    )


def weather_resistance(
    interp: DataFrame,
    weather: DataFrame,
    vessel_ids: Iterable[int] | None = None,
    vessel: DataFrame | None = None,
    exact: bool = False,
    since: Moment | None = None,
) -> DataFrame:
    """Wind, waves and current in knots at the newest matched row, with added resistance.

    ``since`` reads recent rows first.
    """
    values = [*_DIRECTIONS, *_SCALES, "wind_speed", "wave_height", "current_speed"]
    return recent_first(
        pick_vessels(interp, vessel_ids),
        "nr_time",
        since,
        vessel,
        lambda rows: newest_on_grid(rows, weather, ["course"], values, vessel),
        find_recent=lambda rows: newest_on_grid(
            rows, _since(weather, since), ["course"], values, vessel
        ),
    ).select(
        "vessel_id",
        F.col("nr_time").alias("timestamp"),
        number("course", "vessel_heading"),
        number("wind_direction", "wind_direction"),
        (number("wind_speed") * KNOTS_PER_MPS).alias("wind_speed"),
        number("wave_direction", "wave_direction"),
        number("wave_height", "wave_height"),
        number("current_direction", "current_direction"),
        (number("current_speed") * KNOTS_PER_MPS).alias("current_speed"),
        _resistance(exact),
    )


def _resistance(exact: bool) -> Column:
    return added_resistance(
        F.col("dss"),
        F.col("wave_direction"),
        F.col("beaufourt"),
        F.col("wind_direction"),
        F.col("course"),
        exact,
    ).alias("added_resistance")


def resistance_track(
    interp: DataFrame,
    weather: DataFrame,
    start: Moment | None = None,
    end: Moment | None = None,
    vessel_ids: Iterable[int] | None = None,
    vessel: DataFrame | None = None,
    exact: bool = False,
) -> DataFrame:
    """W4 along the whole track: added resistance of every telemetry row with weather."""
    rows = within(pick_vessels(interp, vessel_ids, vessel), "nr_time", start, end)
    if start is not None and end is not None:
        weather = _during(weather, start, end)
    hours = grid(weather, *_DIRECTIONS[1:], *_SCALES)
    return (
        with_cell(rows)
        .select("vessel_id", "id", "nr_time", "course", *CELL)
        .join(hours, list(CELL))
        .select("vessel_id", "id", F.col("nr_time").alias("timestamp"), _resistance(exact))
    )
