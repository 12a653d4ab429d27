"""Data-link freshness (L1 to L4)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.functions.frames import pick_vessels
from wakeline.functions.recent import recent_first
from wakeline.functions.times import EPOCH, Moment, epoch_seconds, instant

# Device types per link, engine links, and what a link reads when
# the vessel has no such device (-1: not fitted).
LINKED_TYPES = (1, 2, 3, 4, 6, 7)
ENGINE_TYPES = (1, 2, 4, 6, 7)
NMEA_TYPES = (3,)
CANBUS_TYPES = (1, 4, 6)
MAIC_TYPES = (2, 7)
ENGINE_LABELS = ("me1", "me2", "me3", "ae1", "ae2", "ae3")
NOT_FITTED = ("me2", "me3", "ae2", "ae3")
GROUP_LABELS = ("online", "nmea", "noon", "canbus", "maic")
EMPTY_LABELS = ("nmea", "canbus", "online", "maic")


def link_rows(
    device: DataFrame,
    engine: DataFrame,
    device_status: DataFrame,
    vessel_ids: Iterable[int] | None = None,
) -> DataFrame:
    """``vessel_id, label, dt``: every link each active device stands for.

    A device counts for its engine's label (or ``nmea``), for its group and for
    ``online``, so one pass over the devices gives all of them. ``dt`` is epoch
    seconds, 0 when the device was never heard.
    """
    engines = engine.select(F.col("id").alias("engine_id"), F.lower("type").alias("engine_label"))
    heard = device_status.groupBy("device_id").agg(F.max("latest_timestamp").alias("heard_at"))
    kind = F.col("device_type_id")
    labels = F.array(
        F.when(kind.isin(*ENGINE_TYPES), F.col("engine_label")).when(
            kind.isin(*NMEA_TYPES), F.lit("nmea")
        ),
        F.when(kind.isin(*CANBUS_TYPES), F.lit("canbus")),
        F.when(kind.isin(*MAIC_TYPES), F.lit("maic")),
        F.lit("online"),
    )
    return (
        pick_vessels(device, vessel_ids)
        .where(F.col("is_active") & kind.isin(*LINKED_TYPES))
        .join(engines, "engine_id", "left")
        .join(heard, "device_id", "left")
        .select(
            "vessel_id",
            F.explode(F.array_compact(labels)).alias("label"),
            epoch_seconds(F.coalesce("heard_at", instant(EPOCH))).alias("dt"),
        )
    )


def last_per_label(links: DataFrame) -> DataFrame:
    """L3: one time per (vessel, label), the latest."""
    return links.groupBy("vessel_id", "label").agg(F.max("dt").alias("dt"))


def _wide(links: DataFrame) -> DataFrame:
    return (
        links.groupBy("vessel_id")
        .pivot("label", [*GROUP_LABELS, *ENGINE_LABELS])
        .agg(F.max("dt"))
    )


def _with_defaults(frame: DataFrame) -> DataFrame:
    names = ("online", "nmea", "noon", "canbus", "maic", "position", "speed", *ENGINE_LABELS)
    return frame.select(
        "vessel_id",
        *[F.coalesce(F.col(c), F.lit(-1 if c in NOT_FITTED else 0)).alias(c) for c in names],
    )


def vessel_links(
    vessel: DataFrame,
    device: DataFrame,
    engine: DataFrame,
    device_status: DataFrame,
    nmea: DataFrame,
    vessel_ids: Iterable[int] | None = None,
    limit: bool = False,
    since: Moment | None = None,
) -> DataFrame:
    """L1: last-seen time of each link, for every vessel, in epoch seconds.

    NMEA reports are reduced per device before the device table is joined. Vessels
    named by id limit the scan to their devices, and so do those of ``vessel`` with
    ``limit``. ``since`` reads recent reports first; only devices without a place or
    a speed there are looked up in the whole archive.
    """
    owners = pick_vessels(device, vessel_ids, vessel if limit else None).select(
        "device_id", "vessel_id"
    )
    if limit or vessel_ids is not None:
        nmea = nmea.join(owners.select("device_id"), "device_id", "left_semi")
    seen = recent_first(
        nmea,
        "message_datetime",
        since,
        owners.select("device_id").distinct(),
        seen_by_device,
        F.col("placed_at").isNotNull() & F.col("moving_at").isNotNull(),
        key="device_id",
        id_column="device_id",
    )
    return links_of_seen(vessel, device, engine, device_status, seen, vessel_ids)


def seen_by_device(nmea: DataFrame) -> DataFrame:
    """``device_id, placed_at, moving_at``: the last report with a place, and with a speed.

    Two maxima that can be kept up to date by a stream (``streaming.live``).
    """
    placed = F.col("latitude").isNotNull() | F.col("longitude").isNotNull()
    moving = F.col("speed_over_ground").isNotNull()
    return nmea.groupBy("device_id").agg(
        F.max(F.when(placed, F.col("message_datetime"))).alias("placed_at"),
        F.max(F.when(moving, F.col("message_datetime"))).alias("moving_at"),
    )


def links_of_seen(
    vessel: DataFrame,
    device: DataFrame,
    engine: DataFrame,
    device_status: DataFrame,
    seen_devices: DataFrame,
    vessel_ids: Iterable[int] | None = None,
) -> DataFrame:
    """L1 from ``seen_by_device``."""
    owners = pick_vessels(device, vessel_ids).select("device_id", "vessel_id")
    seen = (
        seen_devices.join(owners, "device_id")
        .groupBy("vessel_id")
        .agg(
            epoch_seconds(F.max("placed_at")).alias("position"),
            epoch_seconds(F.max("moving_at")).alias("speed"),
        )
    )
    asked = pick_vessels(vessel, vessel_ids, key="id").select(F.col("id").alias("vessel_id"))
    links = _wide(link_rows(device, engine, device_status, vessel_ids))
    return _with_defaults(
        asked.join(links, "vessel_id", "left").join(seen, "vessel_id", "left")
    )


def _of_customer(vessel: DataFrame, customer: DataFrame, customer_name: str | None) -> DataFrame:
    owners = customer if customer_name is None else customer.where(F.col("name") == customer_name)
    return vessel.join(owners.select(F.col("id").alias("customer_id")), "customer_id", "left_semi")


def fleet_links(
    vessel: DataFrame,
    customer: DataFrame,
    device: DataFrame,
    engine: DataFrame,
    device_status: DataFrame,
    customer_name: str | None = None,
    with_empty: bool = False,
) -> DataFrame:
    """L2: link freshness of each vessel that has any linked device, one column per link.

    ``with_empty`` adds the vessels of customers without any link (L4).
    """
    fleet = _of_customer(vessel, customer, customer_name)
    links = pick_vessels(link_rows(device, engine, device_status), None, fleet)
    if with_empty:
        links = links.unionByName(
            empty_links(vessel, customer, device, customer_name)
        )
    return _with_defaults(
        _wide(links).withColumns({"position": F.lit(0), "speed": F.lit(0)})
    )


def empty_links(
    vessel: DataFrame,
    customer: DataFrame,
    device: DataFrame,
    customer_name: str | None = None,
) -> DataFrame:
    """L4: for customers without a single link, four links at time 0 per active vessel."""
    fleet = _of_customer(vessel, customer, customer_name)
    linked = device.where(
        F.col("is_active") & F.col("device_type_id").isin(*LINKED_TYPES)
    ).select(F.col("vessel_id").alias("id"))
    linked_customers = fleet.join(linked, "id", "left_semi").select("customer_id")
    return (
        fleet.where(F.col("is_active"))
        .join(linked_customers, "customer_id", "left_anti")
        .select(
            F.col("id").alias("vessel_id"),
            F.explode(F.array(*[F.lit(c) for c in EMPTY_LABELS])).alias("label"),
            F.lit(0).cast("bigint").alias("dt"),
        )
    )
