"""Time arithmetic on zone-less timestamps.

Everything here works on ``timestamp_ntz`` columns and never looks at the
session time zone, so results do not change with cluster settings.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The grid origin of every binned series, and the default window
# and freshness period.
BIN_ORIGIN = datetime(2023, 1, 1)
DEFAULT_WINDOW = timedelta(days=7)
FRESH_MINUTES = 15
SERIES_INTERVALS = (1, 6, 30, 60)

EPOCH = datetime(1970, 1, 1)
_MINUTE = timedelta(minutes=1)

Moment = datetime | date | int | float | str


def as_datetime(value: Moment) -> datetime:
    """A zone-less UTC datetime from a datetime, date, ISO string or epoch seconds."""
    if isinstance(value, str):
        value = datetime.fromisoformat(value)
    if isinstance(value, datetime):
        if value.tzinfo is not None:
            value = value.astimezone(timezone.utc).replace(tzinfo=None)
        return value
    if isinstance(value, date):
        return datetime(value.year, value.month, value.day)
    return EPOCH + timedelta(seconds=value)


def default_window(as_of: Moment) -> tuple[datetime, datetime]:
    """The window used when a caller names none: the seven days up to ``as_of``."""
    end = as_datetime(as_of)
    return end - DEFAULT_WINDOW, end


def instant(value: Moment) -> Column:
    """A ``timestamp_ntz`` literal."""
    return F.expr(instant_sql(value))


def instant_sql(value: Moment) -> str:
    return f"timestamp_ntz'{as_datetime(value)}'"


def minutes_interval(minutes: int) -> Column:
    return F.expr(f"INTERVAL '{int(minutes)}' MINUTE")


def check_interval(minutes: int) -> int:
    """Accept the published series intervals only."""
    if minutes not in SERIES_INTERVALS:
        raise ValueError(f"interval must be one of {SERIES_INTERVALS}, got {minutes}")
    return minutes


def floor_to_grid(value: Moment, minutes: int) -> datetime:
    """The grid point at or before ``value``."""
    steps = (as_datetime(value) - BIN_ORIGIN) // (minutes * _MINUTE)
    return BIN_ORIGIN + steps * minutes * _MINUTE


def time_bin(moment: str, minutes: int) -> Column:
    """Start of the ``minutes``-wide bin that holds a time, on the 2023-01-01 grid.

    ``moment`` is a column name or a SQL expression.

    Interval division truncates towards zero, so the arithmetic starts from a
    grid point three centuries before the origin; every real reading is later.
    """
    steps_back = (300 * 366 * 24 * 60) // minutes
    base = instant_sql(BIN_ORIGIN - steps_back * minutes * _MINUTE)
    step = f"INTERVAL '{int(minutes)}' MINUTE"
    return F.expr(f"{base} + {step} * (({moment} - {base}) div {step})")


def hour_of(moment: str) -> Column:
    return time_bin(moment, 60)


def day_of(moment: str, name: str = "day") -> Column:
    return F.expr(f"cast({moment} as date) as {name}")


def epoch_seconds(moment: Column) -> Column:
    """Whole seconds since 1970-01-01 as a bigint."""
    return F.call_function("div", moment - instant(EPOCH), F.expr("INTERVAL '1' SECOND"))


def at_instants(
    facts: DataFrame, instants: DataFrame, keys: list[str], how: str = "inner"
) -> DataFrame:
    """Join facts to a few exact instants; ``keys`` ends with the time column.

    On a table in ``day`` folders the day joins too, which lets Spark prune
    folders at run time.
    """
    if "day" in facts.columns:
        instants = instants.withColumn("day", day_of(keys[-1]))
        keys = [*keys, "day"]
    return facts.join(instants, keys, how)


def within(
    frame: DataFrame,
    moment: str,
    start: Moment | None = None,
    end: Moment | None = None,
    half_open: bool = False,
) -> DataFrame:
    """Rows with ``start <= moment <= end`` (``< end`` when half open).

    The bounds are literals, so they reach the parquet scan. A table laid out
    in ``day`` folders (see ``sources.lake``) is also pruned to those days.
    """
    bounds = []
    if start is not None:
        bounds.append(f"{moment} >= {instant_sql(start)}")
    if end is not None:
        bounds.append(f"{moment} {'<' if half_open else '<='} {instant_sql(end)}")
    if "day" in frame.columns:
        if start is not None:
            bounds.append(f"day >= date'{as_datetime(start).date()}'")
        if end is not None:
            bounds.append(f"day <= date'{as_datetime(end).date()}'")
    return frame.where(" and ".join(bounds)) if bounds else frame
