"""Vessel positions and tracks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.functions.frames import number, pick_vessels
from wakeline.functions.latest import latest_per, newest, pick
from wakeline.functions.recent import recent_first
from wakeline.functions.sizing import broadcast_if_small
from wakeline.functions.slices import split_dense, time_slice
from wakeline.functions.times import EPOCH, Moment, at_instants, instant, instant_sql, within

_LOCATED = ("latitude", "longitude")
LOCATED = "latitude is not null and longitude is not null"
HEADED = "course is not null"

# A heading as a struct that orders by time; the rank puts the higher id last
# for ``max`` and first for ``min``.
_UP = f"case when {HEADED} then struct(nr_time as at, id as rank, course) end"
_DOWN = f"case when {HEADED} then struct(nr_time as at, -id as rank, course) end"
_UP_FIELDS = {"at": "nr_time", "rank": "id", "course": "course"}
_DOWN_FIELDS = {**_UP_FIELDS, "rank": "-id"}


def _last_heading() -> Column:
    return pick("max_by", "last_heading", ("nr_time", "id"), _UP_FIELDS, HEADED)


def _first_heading() -> Column:
    return pick("min_by", "first_heading", ("nr_time", "-id"), _DOWN_FIELDS, HEADED)


def track(
    interp: DataFrame,
    start: Moment,
    end: Moment,
    vessel_ids: Iterable[int] | None = None,
    vessel: DataFrame | None = None,
    slice_minutes: int = 60,
    since: Moment | None = None,
) -> DataFrame:
    """Every distinct located point in the window with the heading nearest in time.

    Headings come from the window and from the last course before it; a vessel
    without any heading reads 0. Of two equally near headings the earlier wins,
    of two at one instant the one with the higher id.

    Identical points are collapsed on the map side. Nearest headings are then
    found per (vessel, slice) with two running windows, one upwards and one
    downwards in time, and the last and first heading of the neighbouring slices
    are carried in from a summary with one row per (vessel, slice). A slice is an
    hour, or a part of one where a vessel has more points than a task should hold, so
    no task ever holds a whole vessel or a crowded hour. ``since`` says where to look first for the last course
    before the window; only vessels without one there are searched further back.
    """
    telemetry = pick_vessels(interp, vessel_ids)

    marks = (
        within(telemetry, "nr_time", start, end)
        .where(f"({LOCATED}) or {HEADED}")
        .withColumn("track_slice", time_slice("nr_time", slice_minutes))
        .groupBy("vessel_id", "track_slice", "nr_time", "latitude", "longitude", "course")
        .agg(F.max("id").alias("id"))
    )
    marks = pick_vessels(marks, None, vessel)
    marks = split_dense(marks, ["vessel_id"], "track_slice", "nr_time")

    # Headings that cross slice boundaries. The last one before the window is
    # entered as a slice of its own, ahead of all others.
    edges = marks.groupBy("vessel_id", "track_slice").agg(_last_heading(), _first_heading())
    earlier = within(telemetry, "nr_time", None, start, half_open=True)
    opening = recent_first(
        earlier.where(HEADED),
        "nr_time",
        since,
        vessel,
        lambda rows: rows.groupBy("vessel_id").agg(_last_heading()),
    ).select(
        "vessel_id",
        instant(EPOCH).alias("track_slice"),
        "last_heading",
        F.lit(None).cast(edges.schema["first_heading"].dataType).alias("first_heading"),
    )
    slices = Window.partitionBy("vessel_id")
    neighbours = edges.unionByName(opening).select(
        "vessel_id",
        "track_slice",
        F.max("last_heading")
        .over(slices.orderBy("track_slice").rowsBetween(Window.unboundedPreceding, -1))
        .alias("carried_back"),
        F.min("first_heading")
        .over(
            slices.orderBy(F.col("track_slice").desc()).rowsBetween(Window.unboundedPreceding, -1)
        )
        .alias("carried_ahead"),
    )

    # Both frames run from the edge of the slice to the current instant (peers
    # included), so each is one pass over sorted rows.
    in_slice = Window.partitionBy("vessel_id", "track_slice")
    upwards = in_slice.orderBy("nr_time").rangeBetween(Window.unboundedPreceding, 0)
    downwards = in_slice.orderBy(F.col("nr_time").desc()).rangeBetween(Window.unboundedPreceding, 0)
    points = marks.select(
        "vessel_id",
        "track_slice",
        "nr_time",
        *_LOCATED,
        F.expr(f"max({_UP})").over(upwards).alias("back"),
        F.expr(f"min({_DOWN})").over(downwards).alias("ahead"),
    ).where(LOCATED)

    nearest = points.join(neighbours, ["vessel_id", "track_slice"]).selectExpr(
        "vessel_id",
        "nr_time",
        *_LOCATED,
        "coalesce(back, carried_back) as back",
        "coalesce(ahead, carried_ahead) as ahead",
    )
    gap_back = f"nr_time - coalesce(back.at, {instant_sql(EPOCH)})"
    take_back = f"ahead is null or {gap_back} <= ahead.at - nr_time"
    heading = f"case when {take_back} then coalesce(back.course, 0) else ahead.course end"
    return nearest.select(
        "vessel_id",
        F.col("nr_time").alias("timestamp"),
        number("latitude", "lat"),
        number("longitude", "long"),
        number(heading, "direction"),
    )


def newest_fix(interp: DataFrame) -> DataFrame:
    """Per vessel the newest located row (``point``) and the newest course (``heading``)."""
    return interp.groupBy("vessel_id").agg(*fix_aggregates())


def fix_aggregates() -> list[Column]:
    order = ("nr_time", "id")
    return [
        newest("point", order, (*_LOCATED, "course"), LOCATED),
        newest("heading", order, ("course",), HEADED),
    ]


def fix_values() -> list[Column]:
    """Time, place and heading out of ``point`` and ``heading``."""
    return [
        F.expr("point.nr_time as timestamp"),
        number("point.latitude", "lat"),
        number("point.longitude", "long"),
        number("coalesce(point.course, heading.course, 0)", "direction"),
    ]


def fix_columns(fixes: DataFrame) -> DataFrame:
    return fixes.where("point is not null").select("vessel_id", *fix_values())


def latest_position(
    interp: DataFrame,
    vessel_ids: Iterable[int] | None = None,
    vessel: DataFrame | None = None,
    since: Moment | None = None,
) -> DataFrame:
    """Newest located row per vessel.

    The heading is that row's course, else the vessel's latest course, else 0.
    Both are found in one pass. ``since`` reads recent rows first.
    """
    found = recent_first(
        pick_vessels(interp, vessel_ids),
        "nr_time",
        since,
        vessel,
        newest_fix,
        F.col("point").isNotNull() & F.col("heading").isNotNull(),
    )
    return fix_columns(pick_vessels(found, None, vessel))


def ais_track(
    ais: DataFrame,
    start: Moment,
    end: Moment,
    vessel_ids: Iterable[int] | None = None,
    vessel: DataFrame | None = None,
) -> DataFrame:
    """Located AIS reports in the window."""
    reports = within(pick_vessels(ais, vessel_ids, vessel), "report_datetime", start, end)
    return reports.where(LOCATED).select(
        "vessel_id",
        F.col("report_datetime").alias("timestamp"),
        number("latitude", "lat"),
        number("longitude", "long"),
        number("course", "direction"),
    )


def latest_ais(
    ais: DataFrame,
    vessel: DataFrame,
    vessel_ids: Iterable[int] | None = None,
    since: Moment | None = None,
) -> DataFrame:
    """Newest located AIS report per vessel, with the number it is looked up by.

    That is the IMO number, or the MMSI for a vessel without one. ``since``
    reads recent rows first.
    """

    newest_report = newest_ais(pick_vessels(ais, vessel_ids), vessel, since)
    has_imo = F.coalesce(F.col("imo"), F.lit(0)) != 0
    numbers = vessel.select(
        F.col("id").alias("vessel_id"),
        F.when(has_imo, "imo").otherwise("mmsi").alias("id_type"),
        F.when(has_imo, F.col("imo")).otherwise(F.col("mmsi")).cast("bigint").alias("id_number"),
    )
    return newest_report.join(numbers, "vessel_id").select(
        "vessel_id", "id_type", "id_number", "timestamp", "lat", "long", "direction"
    )


def newest_ais(
    ais: DataFrame, vessel: DataFrame | None = None, since: Moment | None = None
) -> DataFrame:
    """Newest located AIS report per vessel id; ``vessel`` is needed with ``since``."""

    def find(reports: DataFrame) -> DataFrame:
        order = ["report_datetime", "id"]
        return latest_per(reports, ["vessel_id"], order, [*_LOCATED, "course"], LOCATED)

    return recent_first(ais, "report_datetime", since, vessel, find).select(
        "vessel_id",
        F.col("report_datetime").alias("timestamp"),
        number("latitude", "lat"),
        number("longitude", "long"),
        number("course", "direction"),
    )


def fleet_positions(
    vessel: DataFrame,
    customer: DataFrame,
    fleet_type: DataFrame,
    interp: DataFrame,
    ais: DataFrame,
    vessel_status: DataFrame,
    position_status: DataFrame,
    customer_name: str | None = None,
    since: Moment | None = None,
) -> DataFrame:
    """P5: newest position per vessel from own data and from AIS, one row per source.

    Carries the name of the status reported at exactly that time ('None' when
    there is none); a vessel without positions has one row at 1970-01-01.
    Facts of a named customer are limited to its vessels before they are aggregated.
    ``since`` reads recent rows first.
    """
    owners = customer.select(F.col("id").alias("customer_id"), F.col("name").alias("customer"))
    if customer_name is not None:
        owners = owners.where(F.col("customer") == customer_name)
    kinds = fleet_type.select(F.col("id").alias("fleet_type_id"), F.col("name").alias("fleet_type"))
    fleet = (
        vessel.join(owners, "customer_id")
        .join(kinds, "fleet_type_id")
        .select(F.col("id").alias("vessel_id"), "fleet_type", "imo", "mmsi", "name")
    )

    asked, mine = vessel, None
    if customer_name is not None:
        asked = mine = fleet.select(F.col("vessel_id").alias("id"))

    def newest_from(facts: DataFrame, moment: str, source: str, course: Column) -> DataFrame:
        def find(rows: DataFrame) -> DataFrame:
            order, values = [moment, "id"], [*_LOCATED, "course"]
            return latest_per(rows, ["vessel_id"], order, values, LOCATED)

        return recent_first(pick_vessels(facts, None, mine), moment, since, asked, find).select(
            "vessel_id",
            F.lit(source).alias("source"),
            F.col(moment).alias("timestamp"),
            number("latitude", "lat"),
            number("longitude", "long"),
            number(course, "direction"),
        )

    own = newest_from(interp, "nr_time", "internal", F.coalesce(F.col("course"), F.lit(0)))
    seen = pick_vessels(
        own.unionByName(newest_from(ais, "report_datetime", "ais", F.col("course"))), None, asked
    )

    # Statuses reported at those instants: at most two instants per vessel asked for.
    instants = broadcast_if_small(
        seen.select("vessel_id", F.col("timestamp").alias("report_datetime")).distinct(), asked, 2
    )
    at_instant = latest_per(
        at_instants(vessel_status, instants, ["vessel_id", "report_datetime"]),
        ["vessel_id", "report_datetime"],
        ["id"],
        ["status"],
    )
    names = at_instant.join(
        position_status.select(F.col("id").alias("status"), F.col("name").alias("status_name")),
        "status",
    ).select("vessel_id", F.col("report_datetime").alias("timestamp"), "status_name")

    return (
        fleet.join(seen, "vessel_id", "left")
        .join(names, ["vessel_id", "timestamp"], "left")
        .select(
            "vessel_id",
            "fleet_type",
            "imo",
            "mmsi",
            "name",
            F.coalesce(F.col("timestamp"), instant(EPOCH)).alias("timestamp"),
            "source",
            "lat",
            "long",
            "direction",
            F.coalesce("status_name", F.lit("None")).alias("position_status"),
        )
    )


def fold_sources(positions: DataFrame) -> DataFrame:
    """One row per vessel out of P5's one per source.

    The status is the own-data row's, else the AIS row's.
    """
    point = F.struct("timestamp", "lat", "long", "direction")
    status = F.struct("position_status")
    is_own, is_ais = F.col("source") == "internal", F.col("source") == "ais"
    return (
        positions.groupBy("vessel_id", "fleet_type", "imo", "mmsi", "name")
        .agg(
            F.max(F.when(is_own, point)).alias("position"),
            F.max(F.when(is_ais, point)).alias("ais_position"),
            F.max(F.when(is_own, status)).alias("own_status"),
            F.max(status).alias("any_status"),
        )
        .select(
            "vessel_id",
            "name",
            "imo",
            "mmsi",
            "fleet_type",
            "position",
            "ais_position",
            F.coalesce("own_status", "any_status")["position_status"].alias("position_status"),
        )
    )
