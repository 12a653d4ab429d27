"""Fleet roll-up, reference data and the image index."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wakeline.functions.frames import mean, number, pick_vessels
from wakeline.functions.recent import recent_first
from wakeline.functions.sizing import broadcast_if_small
from wakeline.functions.times import Moment, floor_to_grid, time_bin
from wakeline.operators.links import vessel_links
from wakeline.operators.positions import fix_aggregates, fix_values, newest_ais
from wakeline.operators.status import latest_status
from wakeline.operators.weather import latest_weather

IMAGES_PER_DEVICE = 8


def fleet_kpis(
    vessel: DataFrame,
    customer: DataFrame,
    interp: DataFrame,
    unified: DataFrame,
    ais: DataFrame,
    weather: DataFrame,
    device: DataFrame,
    engine: DataFrame,
    device_status: DataFrame,
    nmea: DataFrame,
    vessel_status: DataFrame,
    position_status: DataFrame,
    gis_point: DataFrame,
    gis_point_type: DataFrame,
    customer_name: str | None = None,
    since: Moment | None = None,
) -> DataFrame:
    """speed, weather, links, both positions and status of every vessel, one row each.

    Every part is a per-vessel aggregate, so the joins move one row per vessel. Speed
    and position come from one pass over the telemetry. Facts of a named customer are
    limited to its vessels before they are aggregated; without one the last
    join leaves out what belongs to no vessel. ``since`` reads recent rows first.
    """
    owners = customer if customer_name is None else customer.where(F.col("name") == customer_name)
    fleet = vessel.join(
        owners.select(F.col("id").alias("customer_id")), "customer_id", "left_semi"
    )
    mine = None if customer_name is None else fleet
    # Only a look at recent rows first has to know which vessels to look for.
    asked = None if since is None else fleet

    def own(facts: DataFrame) -> DataFrame:
        return pick_vessels(facts, None, mine)

    motion = latest_motion(own(interp), fleet, since=since)
    parts = {
        "weather": latest_weather(own(unified), weather, vessel=asked, since=since),
        "links": vessel_links(
            fleet, device, engine, device_status, nmea, limit=mine is not None, since=since
        ),
        "ais_position": newest_ais(own(ais), asked, since),
        "position_status": latest_status(
            own(vessel_status),
            position_status,
            gis_point,
            gis_point_type,
            vessel=asked,
            since=since,
        ),
    }
    result = fleet.select(F.col("id").alias("vessel_id"), "name", "imo", "mmsi").join(
        motion, "vessel_id", "left"
    )
    for name, frame in parts.items():
        values = [c for c in frame.columns if c != "vessel_id"]
        result = result.join(
            frame.select("vessel_id", F.struct(*values).alias(name)), "vessel_id", "left"
        )
    return result.select("vessel_id", "name", "imo", "mmsi", "speed", *parts, "position")


def latest_motion(
    interp: DataFrame,
    vessel: DataFrame,
    minutes: int = 1,
    since: Moment | None = None,
) -> DataFrame:
    """Records ``speed`` (T2) and ``position`` (P2) per vessel, found together.

    One aggregate gives the newest point, the newest course and the newest bin with
    a speed; only the rows of that bin are read again.
    """
    present = "coalesce(average_speed_gps, speed_through_water) is not null"

    def find(rows: DataFrame) -> DataFrame:
        binned = rows.withColumn("bin", time_bin("nr_time", minutes))
        heads = pick_vessels(
            binned.groupBy("vessel_id").agg(
                *fix_aggregates(), F.expr(f"max(case when {present} then bin end) as bin")
            ),
            None,
            vessel,
        )
        bins = heads.where("bin is not null").select("vessel_id", "bin")
        speeds = (
            binned.where(present)
            .join(broadcast_if_small(bins, vessel), ["vessel_id", "bin"], "left_semi")
            .groupBy("vessel_id", F.col("bin").alias("timestamp"))
            .agg(mean("average_speed_gps", "sog"), mean("speed_through_water", "stw"))
            .select("vessel_id", F.struct("timestamp", "sog", "stw").alias("speed"))
        )
        return heads.drop("bin").join(speeds, "vessel_id", "left")

    if since is not None:
        since = floor_to_grid(since, minutes)
    known = F.col("point").isNotNull() & F.col("heading").isNotNull() & F.col("speed").isNotNull()
    found = recent_first(interp, "nr_time", since, vessel, find, known)
    shown = F.when(F.col("point").isNotNull(), F.struct(*fix_values()))
    return found.select("vessel_id", "speed", shown.alias("position"))


def vessels(
    vessel: DataFrame,
    customer: DataFrame,
    vessel_type: DataFrame,
    customer_name: str | None = None,
    parse_info: bool = True,
) -> DataFrame:
    """the vessel list; ``additional_info`` as a variant unless left as JSON text.

    Text that is not JSON reads as null. See ``info_values`` for what is inside.
    """
    owners = customer.select(F.col("id").alias("customer_id"), F.col("name").alias("company_id"))
    if customer_name is not None:
        owners = owners.where(F.col("company_id") == customer_name)
    kinds = vessel_type.select(
        F.col("id").alias("vessel_type_id"), F.col("name").alias("type"), "family"
    )
    return (
        vessel.join(owners, "customer_id")
        .join(kinds, "vessel_type_id")
        .select(
            F.col("id").alias("vessel_id"),
            "name",
            "company_id",
            "imo",
            "flag",
            "type",
            "family",
            F.col("image").alias("image_url"),
            number("dwt", "dwt"),
            number("service_speed", "service_speed"),
            _info(parse_info),
        )
    )


def _info(parse: bool):
    info = F.col("additional_info")
    return (F.try_parse_json(info) if parse else info).alias("additional_info")


def info_values(
    frame: DataFrame, values: Mapping[str, tuple[str, str]], column: str = "additional_info"
) -> DataFrame:
    """Values out of a variant column as columns of their own, in its place.

    ``values`` has for each new column the path (``$.engine.maker``, ``$.decks[0]``) and
    the type; what is missing or of another kind is null.
    """
    found = [
        F.try_variant_get(F.col(column), path, kind).alias(name)
        for name, (path, kind) in values.items()
    ]
    return frame.select(*[c for c in frame.columns if c != column], *found)


def info_shape(frame: DataFrame, column: str = "additional_info") -> str:
    """The type that all values of a variant column share, as text; keys in some rows count."""
    return frame.agg(F.schema_of_variant_agg(column)).first()[0]


def engines(
    engine: DataFrame,
    vessel: DataFrame,
    vessel_ids: Iterable[int] | None = None,
    parse_info: bool = True,
) -> DataFrame:
    """engine details per vessel."""
    return pick_vessels(engine, vessel_ids, vessel).select(
        "vessel_id", "type", "label", _info(parse_info)
    )


def gis_points(
    gis_point: DataFrame, gis_point_type: DataFrame, types: Sequence[str] | None = None
) -> DataFrame:
    """points of the named types, or all of them."""
    kinds = gis_point_type.select(
        F.col("id").alias("gis_point_type_id"), F.col("name").alias("gis_point_type")
    )
    if types is not None:
        kinds = kinds.where(F.col("gis_point_type").isin(list(types)))
    return gis_point.join(kinds, "gis_point_type_id").select(
        "gis_point_type_id",
        "gis_point_type",
        F.col("name").alias("gis_point_name"),
        F.col("description").alias("gis_point_description"),
        number("lat", "lat"),
        number("long", "long"),
    )


def newest_images(images: DataFrame, n: int = IMAGES_PER_DEVICE) -> DataFrame:
    """the newest ``n`` images per device serial.

    ``row_number() <= n`` is limited on the map side too, so a busy camera sends
    ``n`` rows per task and not its whole history.
    """
    newest_down = Window.partitionBy("device_serial").orderBy(
        F.col("create_datetime").desc(), F.col("id").desc()
    )
    return (
        images.withColumn("position", F.row_number().over(newest_down))
        .where(F.col("position") <= n)
        .select("device_serial", "position", "id", "image", "create_datetime")
    )
