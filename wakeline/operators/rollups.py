"""Answers from states that were added up before.

A rollup keeps, for each key and period of a fact table, states that can be merged:
sums, counts, extremes, and the first and last value by time and id. Whole periods of
a window come from the states and only its ends from the facts, so a month of
telemetry costs its hours and not its rows. The answers are the same as those of the
operators over the facts.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.functions.frames import long_rows, number, pick_vessels
from wakeline.functions.latest import pick_sql
from wakeline.functions.spine import gap_fill
from wakeline.functions.times import Moment, as_datetime, day_of, floor_to_grid, time_bin, within
from wakeline.functions.weather import CELL, with_cell
from wakeline.operators import consumption, reports, series

_MINUTE = timedelta(minutes=1)
_DAY_MINUTES = 24 * 60


@dataclass(frozen=True)
class Rollup:
    """States of one fact table per ``keys`` and period of ``minutes`` (a divisor of a day).

    ``states`` has for each state the aggregate over rows and the one over states.
    Rows that ``keep`` leaves out never count. With ``cells`` the weather cell of a row
    is a key too.
    """

    name: str
    table: str
    moment: str
    keys: tuple[str, ...]
    minutes: int
    states: Mapping[str, tuple[str, str]]
    keep: str | None = None
    cells: bool = False

    def __post_init__(self) -> None:
        if _DAY_MINUTES % self.minutes:
            raise ValueError("a period has to divide a day")

    @property
    def by(self) -> list[str]:
        return [*self.keys, *(CELL if self.cells else ()), "period"]

    def build(self, facts: DataFrame) -> DataFrame:
        """``keys, period, states`` of some facts, each group once."""
        rows = facts if self.keep is None else facts.where(self.keep)
        rows = (with_cell(rows) if self.cells else rows).withColumn(
            "period", time_bin(self.moment, self.minutes)
        )
        return rows.groupBy(*self.by).agg(
            *[F.expr(f"{of_rows} as {name}") for name, (of_rows, _) in self.states.items()]
        )

    def merge(self, states: DataFrame, by: Sequence[str]) -> DataFrame:
        """States of several groups as one for each ``by``."""
        return states.groupBy(*by).agg(
            *[F.expr(f"{of_states} as {name}") for name, (_, of_states) in self.states.items()]
        )

    def window(
        self,
        states: DataFrame,
        facts: DataFrame,
        start: Moment | None = None,
        end: Moment | None = None,
        half_open: bool = False,
    ) -> DataFrame:
        """States that together stand for the facts from ``start`` to ``end``.

        Periods that lie in the window whole are taken as they are; what is left of it at
        either end is read from the facts.
        """
        step = self.minutes * _MINUTE
        first = last = None
        if start is not None:
            start = as_datetime(start)
            first = floor_to_grid(start, self.minutes)
            first = first if first == start else first + step
        if end is not None:
            end = as_datetime(end)
            last = floor_to_grid(end, self.minutes)
        if first is not None and last is not None and first >= last:
            return self.build(within(facts, self.moment, start, end, half_open))
        found = within(states, "period", first, last, half_open=True).select(*self.by, *self.states)
        ends = []
        if first is not None and first > start:
            ends.append(within(facts, self.moment, start, first, half_open=True))
        if last is not None and (last < end or not half_open):
            ends.append(within(facts, self.moment, last, end, half_open))
        for rows in ends:
            found = found.unionByName(self.build(rows))
        return found


def _sums(columns: Iterable[str]) -> dict[str, tuple[str, str]]:
    return {f"{c}_sum": (f"sum(coalesce({c}, 0))", f"sum({c}_sum)") for c in columns}


def _ends(columns: Iterable[str]) -> dict[str, tuple[str, str]]:
    """First and last known value of each column by time, then id."""
    found = {}
    for c in columns:
        for side, how in (("first", "min_by"), ("last", "max_by")):
            name = f"{c}_{side}"
            row = {"nr_time": "nr_time", "id": "id", "value": c}
            of_rows = pick_sql(how, ("nr_time", "id"), row, f"{c} is not null")
            state = {f: f"{name}.{f}" for f in row}
            of_states = pick_sql(how, (f"{name}.nr_time", f"{name}.id"), state, f"{name} is not null")
            found[name] = (of_rows, of_states)
    return found


def _present(columns: Iterable[str]) -> str:
    return f"coalesce({', '.join(columns)}) is not null"


_MAIN = tuple(f"{e}_consumption" for e in series.MAIN_ENGINES)
_AUX = tuple(f"{e}_consumption" for e in series.AUX_ENGINES)
_POWER = tuple(f"{e}_energy_produced" for e in series.AUX_ENGINES)
_HOURS = tuple(f"{e}_run_hours" for e in consumption.MAIN_ENGINES)
_SPEED_STATES = {
    "sog_sum": ("sum(average_speed_gps)", "sum(sog_sum)"),
    "sog_n": ("count(average_speed_gps)", "sum(sog_n)"),
    "stw_sum": ("sum(speed_through_water)", "sum(stw_sum)"),
    "stw_n": ("count(speed_through_water)", "sum(stw_n)"),
}
_RANGE = lambda c: {"low": (f"min({c})", "min(low)"), "high": (f"max({c})", "max(high)")}

SPEED = Rollup(
    "speed", "interp", "nr_time", ("vessel_id",), 6, _SPEED_STATES,
    _present(("average_speed_gps", "speed_through_water")),
)
MAIN_FUEL = Rollup("main_fuel", "interp", "nr_time", ("vessel_id",), 6, _sums(_MAIN), _present(_MAIN))
AUX_FUEL = Rollup(
    "aux_fuel", "interp", "nr_time", ("vessel_id",), 6, _sums((*_AUX, *_POWER)), _present(_AUX)
)
RUN_HOURS = Rollup("run_hours", "unified", "nr_time", ("vessel_id",), _DAY_MINUTES, _ends(_HOURS))
DAILY = Rollup(
    "daily", "interp", "nr_time", ("vessel_id",), _DAY_MINUTES, consumption.daily_states(), cells=True
)
FUEL_DAY = Rollup(
    "fuel_day", "total_fuel", "date_hour", ("vessel_id",), _DAY_MINUTES,
    {"total_consumption": ("sum(consumption)", "sum(total_consumption)")},
)
WIND_DAY = Rollup(
    "wind_day", "nmea", "message_datetime", ("device_id",), _DAY_MINUTES, _RANGE("wind_speed"),
    reports.COUNTED_WIND,
)
HOURS_DAY = Rollup(
    "hours_day", "canbus", "message_datetime", ("device_id",), _DAY_MINUTES, _RANGE("me_running_hour")
)
ALL = {r.name: r for r in (SPEED, MAIN_FUEL, AUX_FUEL, RUN_HOURS, DAILY, FUEL_DAY, WIND_DAY, HOURS_DAY)}


def _bins(
    rollup: Rollup,
    states: DataFrame,
    facts: DataFrame,
    start: Moment,
    end: Moment,
    minutes: int,
    vessel_ids: Iterable[int] | None,
) -> DataFrame:
    """States per vessel and bin of ``minutes``, which has to be a number of periods."""
    if minutes % rollup.minutes:
        raise ValueError(f"bins of {minutes} minutes are not made of periods of {rollup.minutes}")
    parts = rollup.window(pick_vessels(states, vessel_ids), pick_vessels(facts, vessel_ids), start, end)
    return rollup.merge(parts.withColumn("bin", time_bin("period", minutes)), ["vessel_id", "bin"])


def speed_series(
    states: DataFrame,
    interp: DataFrame,
    vessel: DataFrame,
    start: Moment,
    end: Moment,
    minutes: int = 60,
    vessel_ids: Iterable[int] | None = None,
) -> DataFrame:
    """T1 from the states of ``SPEED``."""
    bins = _bins(SPEED, states, interp, start, end, minutes, vessel_ids).selectExpr(
        "vessel_id",
        "bin",
        "cast(sog_sum as double) / sog_n as sog",
        "cast(stw_sum as double) / stw_n as stw",
    )
    asked = pick_vessels(vessel, vessel_ids, key="id")
    return gap_fill(bins, asked, start, end, minutes, ["sog", "stw"]).withColumnRenamed(
        "bin", "timestamp"
    )


def _engine_series(
    rollup: Rollup,
    engines: Sequence[str],
    measures: Mapping[str, tuple[str, str]],
    states: DataFrame,
    interp: DataFrame,
    vessel: DataFrame,
    start: Moment,
    end: Moment,
    minutes: int,
    vessel_ids: Iterable[int] | None,
) -> DataFrame:
    """Rows per engine; ``measures`` has for each rate the column's ending and the sum's name."""
    sums = {}
    for column, name in measures.values():
        for engine in engines:
            sums[f"{engine}_{name}"] = f"{engine}_{column}_sum"
        sums[f"total_{name}"] = " + ".join(f"{engine}_{column}_sum" for engine in engines)
    bins = _bins(rollup, states, interp, start, end, minutes, vessel_ids).selectExpr(
        "vessel_id", "bin", *[f"{value} as {name}" for name, value in sums.items()]
    )
    asked = pick_vessels(vessel, vessel_ids, key="id")
    grid = gap_fill(bins, asked, start, end, minutes, list(sums))
    rates = {name: rate for rate, (_, name) in measures.items()}
    rows = [series.engine_rows(engine, minutes, rates) for engine in (*engines, "total")]
    return long_rows(grid, ["vessel_id"], rows)


def main_series(
    states: DataFrame,
    interp: DataFrame,
    vessel: DataFrame,
    start: Moment,
    end: Moment,
    minutes: int = 60,
    vessel_ids: Iterable[int] | None = None,
) -> DataFrame:
    """T4 from the states of ``MAIN_FUEL``."""
    measures = {"fuel_cons": ("consumption", "fuel")}
    return _engine_series(
        MAIN_FUEL, series.MAIN_ENGINES, measures, states, interp, vessel, start, end, minutes, vessel_ids
    )


def aux_series(
    states: DataFrame,
    interp: DataFrame,
    vessel: DataFrame,
    start: Moment,
    end: Moment,
    minutes: int = 60,
    vessel_ids: Iterable[int] | None = None,
) -> DataFrame:
    """T3 from the states of ``AUX_FUEL``."""
    measures = {"fuel_cons": ("consumption", "fuel"), "power": ("energy_produced", "energy")}
    return _engine_series(
        AUX_FUEL, series.AUX_ENGINES, measures, states, interp, vessel, start, end, minutes, vessel_ids
    )


def _run_hours(
    states: DataFrame,
    unified: DataFrame,
    start: Moment,
    end: Moment,
    vessel_ids: Iterable[int] | None,
    vessel: DataFrame | None,
) -> DataFrame:
    parts = RUN_HOURS.window(pick_vessels(states, vessel_ids), pick_vessels(unified, vessel_ids), start, end)
    return pick_vessels(RUN_HOURS.merge(parts, ["vessel_id"]), None, vessel)


def run_hour_delta(
    states: DataFrame,
    unified: DataFrame,
    start: Moment,
    end: Moment,
    vessel_ids: Iterable[int] | None = None,
    vessel: DataFrame | None = None,
) -> DataFrame:
    """C2 from the states of ``RUN_HOURS``."""
    found = _run_hours(states, unified, start, end, vessel_ids, vessel)
    return found.select(
        "vessel_id",
        *[number(f"round(coalesce({c}_last.value - {c}_first.value, 0), 2)", c) for c in _HOURS],
    )


def last_run_hours(
    states: DataFrame,
    unified: DataFrame,
    start: Moment,
    end: Moment,
    vessel_ids: Iterable[int] | None = None,
    vessel: DataFrame | None = None,
) -> DataFrame:
    """C3 from the states of ``RUN_HOURS``."""
    columns = []
    for c in _HOURS:
        columns.append(number(f"round({c}_last.value, 2)", c))
        columns.append(F.expr(f"{c}_last.nr_time as {c}_timestamp"))
    return _run_hours(states, unified, start, end, vessel_ids, vessel).select("vessel_id", *columns)


def daily_consumption(
    states: DataFrame,
    interp: DataFrame,
    weather: DataFrame,
    start: Moment,
    end: Moment,
    vessel_ids: Iterable[int] | None = None,
    vessel: DataFrame | None = None,
) -> DataFrame:
    """C4 from the states of ``DAILY``."""
    first, last = consumption.day_bounds(start, end)
    cells = DAILY.window(pick_vessels(states, vessel_ids), pick_vessels(interp, vessel_ids), first, last)
    cells = cells.withColumn("date", day_of("period", "date"))
    return consumption.daily_of_cells(cells, weather, first, last, vessel)


def _days(rollup: Rollup, states: DataFrame, facts: DataFrame, first: date | None, last: date | None):
    """Whole days, both ends included, with ``day`` in place of the period."""
    after = None if last is None else as_datetime(last) + timedelta(days=1)
    found = rollup.window(states, facts, first, after, half_open=True)
    return found.withColumn("day", day_of("period", "day")).drop("period")


def daily_fuel(
    states: DataFrame,
    total_fuel: DataFrame,
    first: date | None = None,
    last: date | None = None,
    vessel_ids: Iterable[int] | None = None,
    vessel: DataFrame | None = None,
) -> DataFrame:
    """N1 from the states of ``FUEL_DAY``."""
    parts = _days(FUEL_DAY, pick_vessels(states, vessel_ids), pick_vessels(total_fuel, vessel_ids), first, last)
    return pick_vessels(FUEL_DAY.merge(parts, ["vessel_id", "day"]), None, vessel)


def daily_wind(
    states: DataFrame,
    nmea: DataFrame,
    device: DataFrame,
    first: date | None = None,
    last: date | None = None,
    vessel_ids: Iterable[int] | None = None,
) -> DataFrame:
    """N2 from the states of ``WIND_DAY``."""
    return reports.wind_of_devices(_days(WIND_DAY, states, nmea, first, last), device, vessel_ids)


def daily_engine_hours(
    states: DataFrame,
    canbus: DataFrame,
    device: DataFrame,
    engine: DataFrame,
    first: date | None = None,
    last: date | None = None,
    vessel_ids: Iterable[int] | None = None,
) -> DataFrame:
    """N3 from the states of ``HOURS_DAY``."""
    parts = _days(HOURS_DAY, states, canbus, first, last)
    return reports.hours_of_devices(parts, device, engine, vessel_ids)
