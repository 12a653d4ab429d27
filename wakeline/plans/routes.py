"""The questions a fleet service asks, one method each, answered by the operators.

A method takes an IMO number or a customer name and a window, as the service's
callers do, and returns a frame in presentation order. ``tables`` is anything
with the input tables as attributes (a ``Lake``, fixtures, your own frames).
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.functions.frames import newest_first
from wakeline.functions.times import (
    FRESH_MINUTES,
    Moment,
    as_datetime,
    check_interval,
    default_window,
)
from wakeline.operators import (
    alerts,
    consumption,
    deident,
    demo,
    fleet,
    links,
    positions,
    reports,
    series,
    snapshot,
    status,
    weather,
)


class FleetService:
    """Per-vessel and per-customer queries as of a given moment."""

    def __init__(
        self,
        tables,
        as_of: Moment,
        fresh_minutes: int = FRESH_MINUTES,
        recent_days: int | None = None,
        aliases: DataFrame | None = None,
        demo_customer: demo.DemoCustomer | None = None,
    ):
        """``recent_days`` makes latest-state queries read that many days before they
        turn to the whole history; answers do not change. ``aliases`` has one row per
        ``alias`` number with the ``real`` one that answers for it. Fleet questions of
        ``demo_customer`` are answered with another's vessels under invented names."""
        self.tables = tables
        self.aliases = aliases
        self.demo = demo_customer
        self.as_of = as_datetime(as_of)
        self.fresh_minutes = fresh_minutes
        self.since = None if recent_days is None else self.as_of - timedelta(days=recent_days)

    # Who and when

    def vessel_ids(self, imo: int) -> list[int]:
        """Ids behind an IMO number or an alias of it, as literals that reach the fact scans."""
        vessel = self.tables.vessel
        asked = vessel.sparkSession.range(1).select(F.lit(imo).cast("bigint").alias("imo"))
        if self.aliases is not None:
            asked = deident.resolve_alias(asked, self.aliases)
        found = vessel.join(asked, "imo", "left_semi").select("id").distinct()
        return [row["id"] for row in found.collect()]

    def _fleet(self, ids: list[int]) -> DataFrame:
        return self.tables.vessel.where(F.col("id").isin(ids))

    def _window(self, start: Moment | None, end: Moment | None) -> tuple[Moment, Moment]:
        week_ago, now = default_window(self.as_of)
        return (week_ago if start is None else start), (now if end is None else end)

    def _state_tables(self) -> tuple[DataFrame, ...]:
        t = self.tables
        return t.vps, t.position_status, t.gis_point, t.gis_point_type

    # Vessel

    def vessel_position(
        self,
        imo: int,
        start: Moment | None = None,
        end: Moment | None = None,
        latest: bool = False,
        source: str = "internal",
    ) -> DataFrame:
        t, ids = self.tables, self.vessel_ids(imo)
        window = self._window(start, end)
        if source == "internal":
            if latest:
                return positions.latest_position(t.interp, ids, self._fleet(ids), self.since)
            since = None
            if self.since is not None:
                since = as_datetime(window[0]) - (self.as_of - self.since)
            points = positions.track(t.interp, *window, ids, self._fleet(ids), since=since)
            return points.orderBy("vessel_id", "timestamp")
        if source == "ais":
            if latest:
                return positions.latest_ais(t.ais, self._fleet(ids), ids, self.since)
            return newest_first(positions.ais_track(t.ais, *window, ids))
        raise ValueError("source must be 'internal' or 'ais'")

    def vessel_speed(
        self,
        imo: int,
        start: Moment | None = None,
        end: Moment | None = None,
        interval: int = 60,
        noon: DataFrame | None = None,
    ) -> DataFrame:
        """Speed series; ``noon`` appends a noon log's speeds to it."""
        t, ids = self.tables, self.vessel_ids(imo)
        window = self._window(start, end)
        result = series.speed_series(t.interp, t.vessel, *window, check_interval(interval), ids)
        if noon is not None and ids:
            result = deident.append_noon_speed(result, noon, ids[0], self.as_of)
        return newest_first(result)

    def vessel_alerts(self, imo: int) -> DataFrame:
        t = self.tables
        log = alerts.alerts(t.alert, t.vessel, t.alert_type, t.device, self.vessel_ids(imo))
        return newest_first(log, "time")

    def vessel_links(self, imo: int) -> DataFrame:
        t = self.tables
        return links.vessel_links(
            t.vessel,
            t.device,
            t.engine,
            t.device_status,
            t.nmea,
            self.vessel_ids(imo),
            since=self.since,
        )

    def vessel_real_time(self, imo: int) -> DataFrame:
        t = self.tables
        return snapshot.vessel_snapshot(
            t.vessel,
            t.interp,
            t.unified,
            t.ais,
            t.weather,
            t.device,
            t.engine,
            t.canbus,
            *self._state_tables(),
            self.as_of,
            self.fresh_minutes,
            self.vessel_ids(imo),
            self.since,
        )

    def vessel_playback(
        self, imo: int, start: Moment | None = None, end: Moment | None = None
    ) -> DataFrame:
        t = self.tables
        bundle = snapshot.vessel_playback_bundle(
            t.interp,
            t.unified,
            t.ais,
            t.weather,
            *self._state_tables(),
            *self._window(start, end),
            self.vessel_ids(imo),
            t.vessel,
            self.since,
        )
        return bundle.orderBy("vessel_id", "kind", F.col("timestamp").desc())

    def vessel_utilisation(
        self, imo: int, start: Moment | None = None, end: Moment | None = None
    ) -> DataFrame:
        t = self.tables
        return status.utilisation(
            t.vps, t.position_status, *self._window(start, end), self.vessel_ids(imo)
        )

    def weather_resistance(self, imo: int, exact: bool = False) -> DataFrame:
        t, ids = self.tables, self.vessel_ids(imo)
        return weather.weather_resistance(
            t.interp, t.weather, ids, self._fleet(ids), exact, self.since
        )

    def vessel_details(self, imo: int) -> DataFrame:
        return fleet.engines(self.tables.engine, self.tables.vessel, self.vessel_ids(imo))

    def consumption_histogram(self, imo: int, start: Moment, end: Moment) -> DataFrame:
        return consumption.consumption_by_speed(
            self.tables.unified, start, end, self.vessel_ids(imo)
        )

    def propulsion_metrics(
        self, imo: int, start: Moment | None = None, end: Moment | None = None
    ) -> DataFrame:
        return consumption.run_hour_delta(
            self.tables.unified, *self._window(start, end), self.vessel_ids(imo)
        )

    def propulsion_metrics_daily(
        self, imo: int, start: Moment | None = None, end: Moment | None = None
    ) -> DataFrame:
        return consumption.last_run_hours(
            self.tables.unified, *self._window(start, end), self.vessel_ids(imo)
        )

    # Engines

    def aux_engines(
        self, imo: int, start: Moment | None = None, end: Moment | None = None, interval: int = 60
    ) -> DataFrame:
        t, window = self.tables, self._window(start, end)
        return series.aux_series(
            t.interp, t.vessel, *window, check_interval(interval), self.vessel_ids(imo)
        ).orderBy("vessel_id", "engine", "timestamp")

    def main_engines(
        self, imo: int, start: Moment | None = None, end: Moment | None = None, interval: int = 60
    ) -> DataFrame:
        t, window = self.tables, self._window(start, end)
        return series.main_series(
            t.interp, t.vessel, *window, check_interval(interval), self.vessel_ids(imo)
        ).orderBy("vessel_id", "engine", "timestamp")

    def engine_real_time(self, imo: int, engine: str | None = None) -> DataFrame:
        t, ids = self.tables, self.vessel_ids(imo)
        rows = snapshot.engine_real_time(
            t.interp,
            t.unified,
            t.device,
            t.engine,
            t.canbus,
            self.as_of,
            self.fresh_minutes,
            ids,
            self._fleet(ids),
            self.since,
        )
        return rows if engine is None else rows.where(F.col("engine") == engine.lower())

    def engine_playback(
        self, imo: int, engine: str, start: Moment | None = None, end: Moment | None = None
    ) -> DataFrame:
        t = self.tables
        rows = series.engine_playback(
            t.interp,
            t.canbus,
            t.device,
            t.engine,
            engine,
            *self._window(start, end),
            self.vessel_ids(imo),
        )
        return newest_first(rows)

    def engine_data(
        self,
        imo: int,
        engine: str,
        params: Sequence[str],
        start: Moment | None = None,
        end: Moment | None = None,
    ) -> DataFrame:
        t = self.tables
        rows = series.engine_params(
            t.interp,
            t.canbus,
            t.device,
            engine,
            params,
            *self._window(start, end),
            self.vessel_ids(imo),
        )
        return rows.orderBy("vessel_id", "param", F.col("timestamp").desc())

    # Fleet

    def _shown(self, customer: str | None) -> str | None:
        """The customer whose fleet answers: the demo customer shows another's."""
        return self.demo.source if self._is_demo(customer) else customer

    def _is_demo(self, customer: str | None) -> bool:
        return self.demo is not None and customer == self.demo.name

    def fleet_kpis(self, customer: str | None = None) -> DataFrame:
        t = self.tables
        rows = fleet.fleet_kpis(
            t.vessel,
            t.customer,
            t.interp,
            t.unified,
            t.ais,
            t.weather,
            t.device,
            t.engine,
            t.device_status,
            t.nmea,
            *self._state_tables(),
            self._shown(customer),
            self.since,
        )
        return demo.demo_kpis(rows, self.demo, self.as_of) if self._is_demo(customer) else rows

    def fleet_vessels(self, customer: str | None = None) -> DataFrame:
        t = self.tables
        rows = fleet.vessels(t.vessel, t.customer, t.vessel_type, self._shown(customer))
        return demo.demo_vessels(rows, self.demo) if self._is_demo(customer) else rows

    def fleet_position(self, customer: str | None = None) -> DataFrame:
        t = self.tables
        per_source = positions.fleet_positions(
            t.vessel,
            t.customer,
            t.fleet_type,
            t.interp,
            t.ais,
            t.vps,
            t.position_status,
            self._shown(customer),
            self.since,
        )
        rows = positions.fold_sources(per_source)
        if self._is_demo(customer):
            rows = demo.demo_positions(rows, self.demo, self.as_of)
        return rows.orderBy("vessel_id")

    def fleet_links(self, customer: str | None = None) -> DataFrame:
        t = self.tables
        return links.fleet_links(
            t.vessel, t.customer, t.device, t.engine, t.device_status, customer, with_empty=True
        ).orderBy("vessel_id")

    # Reports

    def noon_report(self, imo: int, day: date | None = None) -> DataFrame:
        """The report of one day; by default the day before."""
        t = self.tables
        day = (self.as_of - timedelta(days=1)).date() if day is None else day
        return reports.noon_report(
            t.vessel,
            t.total_fuel,
            t.nmea,
            t.canbus,
            t.device,
            t.engine,
            day,
            day,
            self.vessel_ids(imo),
        )

    def unified_page(
        self,
        imo: int,
        start: Moment | None = None,
        end: Moment | None = None,
        page: int = 1,
        page_size: int = 20,
    ) -> DataFrame:
        t = self.tables
        rows = reports.page(
            t.interp,
            t.device,
            t.canbus,
            t.vessel,
            *self._window(start, end),
            page,
            page_size,
            self.vessel_ids(imo),
        )
        return rows.orderBy("vessel_id", "row_index")

    def download_unified(
        self, imo: int, path: str, start: Moment | None = None, end: Moment | None = None
    ) -> None:
        t = self.tables
        rows = reports.unified_dataset(
            t.interp, t.device, t.canbus, *self._window(start, end), self.vessel_ids(imo)
        )
        reports.export_csv(rows, path)

    def consumption_summary(
        self, imo: int, start: Moment | None = None, end: Moment | None = None
    ) -> DataFrame:
        t = self.tables
        rows = consumption.daily_consumption(
            t.interp, t.weather, *self._window(start, end), self.vessel_ids(imo)
        )
        return rows.orderBy("vessel_id", "date")

    def client_summary(
        self, imo: int, start: Moment | None = None, end: Moment | None = None
    ) -> DataFrame:
        t = self.tables
        rows = consumption.customer_daily(
            t.customer_unified, t.weather, *self._window(start, end), self.vessel_ids(imo)
        )
        return rows.orderBy("vessel_id", "date")

    # Reference data

    def map_points(self, types: Sequence[str] | None = None) -> DataFrame:
        t = self.tables
        return fleet.gis_points(t.gis_point, t.gis_point_type, types).orderBy("gis_point_type_id")

    def device_pictures(self, serial: str) -> DataFrame:
        images = self.tables.image.where(F.col("device_serial") == serial)
        return fleet.newest_images(images).orderBy("position")
