"""Weather-grid keys and the added-resistance formula, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.functions.times import hour_of

# Metres per second to knots, and the formula's own constants in
# place of pi.
KNOTS_PER_MPS = 1.9438
DEGREE_FACTOR = 3.414 / 180
HALF_TURN = 3.1414

CELL = ("wx_hour", "wx_lat", "wx_long")


def _tenth(degrees: str) -> Column:
    return F.expr(f"cast(round(cast({degrees} as decimal(9,4)), 1) as decimal(9,4))")


def with_cell(telemetry: DataFrame) -> DataFrame:
    """Add the grid cell of each row: its hour and lat/long rounded to 0.1 degree.

    Rounding is done on decimals (half away from zero).
    """
    return telemetry.withColumns(
        {
            "wx_hour": hour_of("nr_time"),
            "wx_lat": _tenth("latitude"),
            "wx_long": _tenth("longitude"),
        }
    )


def grid(weather: DataFrame, *values: str) -> DataFrame:
    """The weather table keyed by cell."""
    return weather.selectExpr(
        "time as wx_hour",
        "cast(lat as decimal(9,4)) as wx_lat",
        "cast(long as decimal(9,4)) as wx_long",
        *values,
    )


def relative_angle(heading: Column, direction: Column, exact: bool = False) -> Column:
    """Angle between heading and direction in radians.

    By default the published constant is used and the difference is not wrapped
    at 360 degrees; ``exact`` wraps it and uses pi.
    """
    gap = F.abs(heading - direction)
    if exact:
        gap = F.pmod(gap, F.lit(360.0))
        return F.least(gap, F.lit(360.0) - gap) * (math.pi / 180)
    return gap * F.lit(DEGREE_FACTOR)


def added_resistance(
    sea_state: Column,
    wave_direction: Column,
    beaufort: Column,
    wind_direction: Column,
    heading: Column,
    exact: bool = False,
) -> Column:
    """Added resistance in percent; null when an input is missing or zero.

    ``exact`` wraps angles, uses pi and takes zero as a value.
    """
    half_turn = math.pi if exact else HALF_TURN
    inputs = [c.cast("double") for c in (sea_state, wave_direction, beaufort, wind_direction, heading)]
    dss, wave, bf, wind, ship = inputs
    wave_angle = relative_angle(ship, wave, exact)
    wind_angle = relative_angle(ship, wind, exact)
    from_waves = F.when(
        wave_angle <= half_turn / 4, F.pow(dss, F.lit(1.1)) * F.cos(wave_angle)
    ).otherwise(0.0)
    from_wind = F.when(
        wind_angle <= half_turn / 2, F.cos(wind_angle) * F.pow(bf, F.lit(1.5))
    ).otherwise(0.0)
    known = F.lit(True)
    for value in inputs:
        known = known & (value.isNotNull() if exact else (value.isNotNull() & (value != 0)))
    return F.when(known, from_waves + from_wind)
