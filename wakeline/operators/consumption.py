"""Consumption and run hours."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.functions.frames import number, pick_vessels, total_sql
from wakeline.functions.latest import newest, oldest
from wakeline.functions.times import Moment, as_datetime, day_of, floor_to_grid, within
from wakeline.functions.weather import CELL, grid, with_cell

# Upper edges (inclusive) and names of the speed bands.
SPEED_BANDS = (
    (5, "0-5"),
    (7.5, "5-7.5"),
    (10, "7.5-10"),
    (12, "10-12"),
    (14, "12-14"),
    (16, "14-16"),
    (18, "16-18"),
    (20, "18-20"),
    (None, "20+"),
)
MAIN_ENGINES = ("me1", "me2", "me3")
AUX_ENGINES = ("ae1", "ae2", "ae3", "ae4")
_MAIN_FUEL = tuple(f"{e}_consumption" for e in MAIN_ENGINES)
_AUX_FUEL = ("ae1_consumption", "ae2_consumption")
_ORDER = ("nr_time", "id")


def speed_band(speed: Column) -> Column:
    """Name of the band; null for negative or missing speeds."""
    chain = F.when((speed < 0) | speed.isNull(), F.lit(None).cast("string"))
    for edge, name in SPEED_BANDS:
        chain = chain.otherwise(name) if edge is None else chain.when(speed <= edge, F.lit(name))
    return chain


def consumption_by_speed(
    unified: DataFrame,
    start: Moment,
    end: Moment,
    vessel_ids: Iterable[int] | None = None,
    vessel: DataFrame | None = None,
) -> DataFrame:
    """Rows and main-engine fuel per speed-over-ground band; ``band`` numbers them by speed."""
    rows = within(pick_vessels(unified, vessel_ids), "nr_time", start, end)
    bands = (
        rows.where(F.col("average_speed_gps") >= 0)
        .groupBy("vessel_id", speed_band(F.col("average_speed_gps")).alias("interval"))
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.expr(f"cast(sum({total_sql(*_MAIN_FUEL)}) as double) / 60 as consumption"),
        )
    )
    names = F.array(*[F.lit(name) for _, name in SPEED_BANDS])
    return pick_vessels(bands, None, vessel).select(
        "vessel_id",
        (F.array_position(names, F.col("interval")) - 1).cast("int").alias("band"),
        "interval",
        "count",
        "consumption",
    )


def run_hour_delta(
    unified: DataFrame,
    start: Moment,
    end: Moment,
    vessel_ids: Iterable[int] | None = None,
    vessel: DataFrame | None = None,
) -> DataFrame:
    """Last minus first known run hours of each main engine, 0 when there are none."""
    aggregates = []
    for engine in MAIN_ENGINES:
        column = f"{engine}_run_hours"
        known = f"{column} is not null"
        aggregates.append(newest(f"{engine}_last", _ORDER, (column,), known))
        aggregates.append(oldest(f"{engine}_first", _ORDER, (column,), known))
    found = (
        within(pick_vessels(unified, vessel_ids), "nr_time", start, end)
        .groupBy("vessel_id")
        .agg(*aggregates)
    )
    deltas = [
        number(
            f"round(coalesce({e}_last.{e}_run_hours - {e}_first.{e}_run_hours, 0), 2)",
            f"{e}_run_hours",
        )
        for e in MAIN_ENGINES
    ]
    return pick_vessels(found, None, vessel).select("vessel_id", *deltas)


def last_run_hours(
    unified: DataFrame,
    start: Moment,
    end: Moment,
    vessel_ids: Iterable[int] | None = None,
    vessel: DataFrame | None = None,
) -> DataFrame:
    """Last known run hours of each main engine in the window, with their time."""
    found = (
        within(pick_vessels(unified, vessel_ids), "nr_time", start, end)
        .groupBy("vessel_id")
        .agg(
            *[
                newest(e, _ORDER, (f"{e}_run_hours",), f"{e}_run_hours is not null")
                for e in MAIN_ENGINES
            ]
        )
    )
    columns = []
    for engine in MAIN_ENGINES:
        columns.append(number(f"round({engine}.{engine}_run_hours, 2)", f"{engine}_run_hours"))
        columns.append(F.expr(f"{engine}.nr_time as {engine}_run_hours_timestamp"))
    return pick_vessels(found, None, vessel).select("vessel_id", *columns)


def day_bounds(start: Moment, end: Moment) -> tuple[Moment, Moment]:
    """Midnights of the two dates; the end date's midnight is included."""
    return as_datetime(as_datetime(start).date()), as_datetime(as_datetime(end).date())


def daily_consumption(
    interp: DataFrame,
    weather: DataFrame,
    start: Moment,
    end: Moment,
    vessel_ids: Iterable[int] | None = None,
    vessel: DataFrame | None = None,
) -> DataFrame:
    """C4: per vessel and day run hours, mean speeds, fuel and weather scales.

    Telemetry is aggregated per (vessel, day, weather cell) before it meets the
    grid, and the partial results are combined per day afterwards; the weather
    averages are weighted with the rows of the cell. The join moves a few cells
    per vessel-hour in place of every row.
    """
    first, last = day_bounds(start, end)
    rows = within(pick_vessels(interp, vessel_ids), "nr_time", first, last)
    cells = (
        with_cell(rows)
        .groupBy("vessel_id", day_of("nr_time", "date"), *CELL)
        .agg(*[F.expr(f"{of_rows} as {name}") for name, (of_rows, _) in daily_states().items()])
    )
    return daily_of_cells(cells, weather, first, last, vessel)


_DAILY_HOURS = tuple(f"{e}_run_hours" for e in (*MAIN_ENGINES, *AUX_ENGINES))
_DAILY_FUELS = (*_MAIN_FUEL, *_AUX_FUEL)
_DAILY_SPEEDS = {"avg_sog": "average_speed_gps", "avg_stw": "speed_through_water"}


def daily_states() -> dict[str, tuple[str, str]]:
    """What C4 adds up per (vessel, day, cell): each as SQL over rows, and over such states."""
    states = {"cell_rows": ("count(1)", "sum(cell_rows)")}
    for column in _DAILY_HOURS:
        states[f"{column}_max"] = (f"max({column})", f"max({column}_max)")
        states[f"{column}_min"] = (f"min({column})", f"min({column}_min)")
    for name, column in _DAILY_SPEEDS.items():
        states[f"{name}_sum"] = (f"sum({column})", f"sum({name}_sum)")
        states[f"{name}_n"] = (f"count({column})", f"sum({name}_n)")
    for column in _DAILY_FUELS:
        states[f"{column}_sum"] = (f"sum(coalesce({column}, 0))", f"sum({column}_sum)")
    return states


def daily_of_cells(
    cells: DataFrame,
    weather: DataFrame,
    first: Moment,
    last: Moment,
    vessel: DataFrame | None = None,
) -> DataFrame:
    """C4 from its states per (vessel, date, weather cell)."""
    matched = pick_vessels(cells, None, vessel).join(
        grid(within(weather, "time", floor_to_grid(first, 60), last), "beaufourt", "dss"),
        list(CELL),
        "left",
    )
    final = []
    for column in _DAILY_HOURS:
        final.append(number(f"max({column}_max) - min({column}_min)", column))
    for name in _DAILY_SPEEDS:
        average = f"cast(sum({name}_sum) as double) / nullif(sum({name}_n), 0)"
        final.append(F.expr(f"{average} as {name}"))

    def per_hour(name: str, *columns: str) -> Column:
        fuel = " + ".join(f"{c}_sum" for c in columns)
        return F.expr(f"cast(sum({fuel}) as double) / 60 as {name}")

    for engine in MAIN_ENGINES:
        final.append(per_hour(f"sum_cons_{engine}", f"{engine}_consumption"))
    final.append(per_hour("sum_cons_me_total", *_MAIN_FUEL))
    for column in _AUX_FUEL:
        final.append(per_hour(f"sum_cons_{column[:3]}", column))
    final.append(per_hour("sum_cons_ae_total", *_AUX_FUEL))
    for name, column in {"wind_scale": "beaufourt", "wave_scale": "dss"}.items():
        weighted = f"sum({column} * cell_rows)"
        weight = f"sum(case when {column} is not null then cell_rows end)"
        final.append(number(f"ceil({weighted} / {weight})", name))
    return matched.groupBy("vessel_id", "date").agg(*final)


def customer_daily(
    customer_unified: DataFrame,
    weather: DataFrame,
    start: Moment,
    end: Moment,
    vessel_ids: Iterable[int] | None = None,
    vessel: DataFrame | None = None,
) -> DataFrame:
    """The customer's own daily figures row by row, missing values as 0."""
    first, last = day_bounds(start, end)
    rows = within(pick_vessels(customer_unified, vessel_ids, vessel), "nr_time", first, last)
    columns = {"avg_sog": "average_speed_gps", "avg_stw": "speed_through_water"}
    columns |= {f"sum_hours_{e}": f"{e}_run_hours" for e in MAIN_ENGINES}
    columns |= {f"sum_cons_{e}": f"{e}_consumption" for e in MAIN_ENGINES}
    columns |= {f"sum_hours_{e}": f"{e}_run_hours" for e in AUX_ENGINES[:2]}
    columns |= {f"sum_cons_{e}": f"{e}_consumption" for e in AUX_ENGINES[:2]}
    needed = sorted(set(columns.values()))
    matched = (
        with_cell(rows)
        .select("vessel_id", "id", "nr_time", *CELL, *needed)
        .join(
            grid(within(weather, "time", floor_to_grid(first, 60), last), "beaufourt", "dss"),
            list(CELL),
            "left",
        )
    )
    return matched.select(
        "vessel_id",
        "id",
        day_of("nr_time", "date"),
        *[number(f"coalesce({c}, 0)", name) for name, c in columns.items()],
        number(total_sql(*_MAIN_FUEL), "sum_cons_me_total"),
        number(total_sql(*_AUX_FUEL), "sum_cons_ae_total"),
        number("ceil(coalesce(beaufourt, 0))", "wind_scale"),
        number("ceil(coalesce(dss, 0))", "wave_scale"),
    )
