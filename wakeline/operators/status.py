"""Position status and utilisation."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.functions.frames import number, pick_vessels
from wakeline.functions.latest import newest
from wakeline.functions.recent import recent_first
from wakeline.functions.times import Moment, within

# The reported status classes, and the one that is no status yet.
STATUS_CLASSES = (
    "port",
    "anchorage",
    "underway",
    "awaiting_data",
    "offshore_ops",
    "offshore_stby",
    "other",
)
AWAITING = "awaiting_data"


def _described(
    rows: DataFrame,
    position_status: DataFrame,
    gis_point: DataFrame,
    gis_point_type: DataFrame,
) -> DataFrame:
    """Inner join to the dimensions; rows awaiting data or without a point drop out."""
    statuses = position_status.where(F.col("name") != AWAITING).select(
        F.col("id").alias("status"),
        F.col("name").alias("status_name"),
        F.col("description").alias("status_description"),
    )
    kinds = gis_point_type.select(
        F.col("id").alias("gis_point_type_id"), F.col("name").alias("gis_point_type")
    )
    points = gis_point.join(kinds, "gis_point_type_id").select(
        F.col("id").alias("gis_point_id"),
        F.col("name").alias("gis_point_name"),
        F.col("description").alias("gis_point_description"),
        "gis_point_type",
    )
    # Free text has no bound by rows, so how to join is left to the sizes that Spark sees.
    return rows.join(statuses, "status").join(points, "gis_point_id")


_FIELDS = (
    "status_name",
    "status_description",
    "distance",
    "gis_point_name",
    "gis_point_description",
    "gis_point_type",
)


def latest_status(
    vessel_status: DataFrame,
    position_status: DataFrame,
    gis_point: DataFrame,
    gis_point_type: DataFrame,
    vessel_ids: Iterable[int] | None = None,
    vessel: DataFrame | None = None,
    since: Moment | None = None,
) -> DataFrame:
    """Newest described status per vessel.

    Reports are first reduced to the newest per (vessel, status, point) on the
    map side, so the dimension joins see that short list and not the fact table.
    ``since`` reads recent rows first.
    """

    def find(rows: DataFrame) -> DataFrame:
        reduced = (
            rows.where(F.col("gis_point_id").isNotNull())
            .groupBy("vessel_id", "status", "gis_point_id")
            .agg(newest("report", ("report_datetime", "id"), ("id", "distance")))
        )
        return _newest_described(
            pick_vessels(reduced, None, vessel), position_status, gis_point, gis_point_type
        )

    return recent_first(
        pick_vessels(vessel_status, vessel_ids), "report_datetime", since, vessel, find
    )


def _newest_described(
    reduced: DataFrame,
    position_status: DataFrame,
    gis_point: DataFrame,
    gis_point_type: DataFrame,
) -> DataFrame:
    described = _described(reduced, position_status, gis_point, gis_point_type).select(
        "vessel_id",
        "report.report_datetime",
        "report.id",
        "report.distance",
        *[c for c in _FIELDS if c != "distance"],
    )
    return (
        described.groupBy("vessel_id")
        .agg(F.max(F.struct("report_datetime", "id", *_FIELDS)).alias("newest"))
        .select(
            "vessel_id",
            F.col("newest.report_datetime").alias("timestamp"),
            *[
                number(f"newest.{c}").alias(c) if c == "distance" else F.col(f"newest.{c}")
                for c in _FIELDS
            ],
        )
    )


def status_history(
    vessel_status: DataFrame,
    position_status: DataFrame,
    gis_point: DataFrame,
    gis_point_type: DataFrame,
    start: Moment,
    end: Moment,
    vessel_ids: Iterable[int] | None = None,
    vessel: DataFrame | None = None,
) -> DataFrame:
    """Described statuses in the window."""
    rows = within(pick_vessels(vessel_status, vessel_ids, vessel), "report_datetime", start, end)
    return _described(rows, position_status, gis_point, gis_point_type).select(
        "vessel_id",
        F.col("report_datetime").alias("timestamp"),
        *[number(c, c) if c == "distance" else F.col(c) for c in _FIELDS],
    )


def utilisation(
    vessel_status: DataFrame,
    position_status: DataFrame,
    start: Moment,
    end: Moment,
    vessel_ids: Iterable[int] | None = None,
    vessel: DataFrame | None = None,
) -> DataFrame:
    """S3: share of reports per status class in percent of the seven classes' total.

    Other classes are ignored; a vessel with none of the seven has zeros.
    """
    counts = (
        within(pick_vessels(vessel_status, vessel_ids), "report_datetime", start, end)
        .groupBy("vessel_id", "status")
        .agg(F.count(F.lit(1)).alias("reports"))
    )
    names = position_status.select(
        F.col("id").alias("status"), F.replace("name", F.lit(" "), F.lit("_")).alias("status_name")
    )
    wide = (
        pick_vessels(counts, None, vessel)
        .join(names, "status")
        .groupBy("vessel_id")
        .pivot("status_name", list(STATUS_CLASSES))
        .agg(F.sum("reports"))
        .na.fill(0)
    )
    seven = sum((F.col(c) for c in STATUS_CLASSES[1:]), F.col(STATUS_CLASSES[0]))
    return wide.select(
        "vessel_id",
        *[
            F.when(seven > 0, F.col(c) * F.lit(100.0) / seven).otherwise(0.0).alias(c)
            for c in STATUS_CLASSES
        ],
    )
