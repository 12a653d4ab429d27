"""De-identification and loading as data jobs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.functions.slices import number_rows
from wakeline.functions.times import Moment, instant

# The columns an imported vessel may have and the first id it gets.
IMPORT_COLUMNS = (
    "id",
    "imo",
    "mmsi",
    "vessel_type_id",
    "fuel_type_id",
    "customer_id",
    "name",
    "is_noon_report_link",
    "is_canbus_link",
    "is_nmea_link",
    "alert_active_since",
    "dwt",
    "service_speed",
    "image",
    "is_active",
    "fleet_type_id",
)
FIRST_IMPORT_ID = 2000

# Modulus and multipliers of the repeatable jitter.
_JITTER_PRIME = 1_000_003
_JITTER_FACTORS = {"time": 613, "lat": 727, "long": 839, "heading": 947}
_JITTER_HIGHER = 7_621


def resolve_alias(frame: DataFrame, mapping: DataFrame, column: str = "imo") -> DataFrame:
    """Replace alias ids by real ones; ids without a mapping stay.

    ``mapping`` has one row per ``alias`` with its ``real`` id.
    """
    lookup = mapping.select(F.col("alias").alias(column), F.col("real").alias("real_id"))
    return (
        frame.join(lookup, column, "left")
        .withColumn(column, F.coalesce("real_id", column))
        .select(*frame.columns)
    )


def pseudonymise(
    frame: DataFrame,
    mapping: DataFrame,
    company: str,
    fleet_type: str | None = None,
    key: str = "imo",
) -> DataFrame:
    """Keep mapped vessels only and replace name, IMO, MMSI and company.

    ``mapping`` has one row per real ``imo`` with ``new_name, new_imo, new_mmsi``.
    """
    identities = mapping.select(F.col("imo").alias(key), "new_name", "new_imo", "new_mmsi")
    replaced: dict[str, Column] = {
        "name": F.col("new_name"),
        key: F.col("new_imo"),
        "mmsi": F.col("new_mmsi"),
        "company_id": F.lit(company),
    }
    if fleet_type is not None:
        replaced["fleet_type"] = F.lit(fleet_type)
    kept = [c for c in frame.columns if c not in replaced]
    return frame.join(identities, key).select(
        *kept, *[value.alias(name) for name, value in replaced.items()]
    )


def jitter_number(key: Column, seed: int, purpose: str, bound: int) -> Column:
    """A repeatable number in ``[0, bound)`` from a key and a seed.

    Bounds over the prime take a second mixed number as the higher digit; the
    largest bound is the square of the prime.
    """
    if not 0 < bound <= _JITTER_PRIME**2:
        raise ValueError(f"a jitter bound is from 1 to {_JITTER_PRIME**2}")
    spread = F.pmod(key, F.lit(_JITTER_PRIME)) * _JITTER_FACTORS[purpose]
    mixed = F.pmod(spread + (seed * 7919) % _JITTER_PRIME, F.lit(_JITTER_PRIME)).cast("bigint")
    if bound > _JITTER_PRIME:
        higher = F.pmod(mixed * _JITTER_HIGHER + 1, F.lit(_JITTER_PRIME))
        mixed = mixed + higher * F.lit(_JITTER_PRIME).cast("bigint")
    return F.pmod(mixed, F.lit(bound)).cast("bigint")


def jitter(
    positions: DataFrame,
    as_of: Moment,
    seed: int,
    d_lat: int,
    d_long: int,
    max_back_seconds: int,
    key: str = "vessel_id",
) -> DataFrame:
    """D3: move positions by a bounded, repeatable amount.

    The time becomes ``as_of`` minus less than ``max_back_seconds``, lat and
    long grow by less than ``d_lat`` and ``d_long`` tenths, the heading is any
    tenth of a degree. Missing coordinates start from 0. The numbers come from
    the key and the seed, so they do not depend on partitioning.
    """
    base = F.col(key).cast("bigint")
    back = jitter_number(base, seed, "time", max_back_seconds)
    moved = {
        "timestamp": instant(as_of) - back * F.expr("INTERVAL '1' SECOND"),
        "direction": jitter_number(base, seed, "heading", 3600) / 10.0,
        "lat": F.coalesce("lat", F.lit(0.0)) + jitter_number(base, seed, "lat", d_lat) / 10.0,
        "long": F.coalesce("long", F.lit(0.0)) + jitter_number(base, seed, "long", d_long) / 10.0,
    }
    return positions.withColumns(moved)


def template_row(frame: DataFrame, order: str = "vessel_id") -> DataFrame:
    """The first row of a frame, the pattern for synthetic ones."""
    return frame.orderBy(order).limit(1)


def clone_template(
    template: DataFrame,
    company: str,
    identities: Sequence[tuple[int, int, str]],
    fleet_type: str = "merchant",
) -> DataFrame:
    """One copy of each template row per listed identity (IMO, MMSI, name)."""
    listed = F.array(
        *[
            F.struct(
                F.lit(imo).cast("bigint").alias("imo"),
                F.lit(mmsi).cast("bigint").alias("mmsi"),
                F.lit(name).alias("name"),
            )
            for imo, mmsi, name in identities
        ]
    )
    replaced = {
        "imo": F.col("identity.imo"),
        "mmsi": F.col("identity.mmsi"),
        "name": F.col("identity.name"),
        "company_id": F.lit(company),
        "fleet_type": F.lit(fleet_type),
    }
    kept = [c for c in template.columns if c not in replaced]
    present = {n: v for n, v in replaced.items() if n in template.columns}
    return (
        template.withColumn("identity", F.explode(listed))
        .select(*kept, *[value.alias(name) for name, value in present.items()])
    )


def rewrite_image_path(frame: DataFrame, company: str, column: str = "image_url") -> DataFrame:
    """Replace the third part of a slash-separated path; empty paths stay."""
    parts = F.split(F.col(column), "/")
    rest = F.slice(parts, 4, F.greatest(F.size(parts) - 3, F.lit(0)))
    rewritten = F.array_join(F.concat(F.slice(parts, 1, 2), F.array(F.lit(company)), rest), "/")
    return frame.withColumn(
        column, F.when(F.size(parts) >= 3, rewritten).otherwise(F.col(column))
    )


def redate(
    frame: DataFrame,
    order: str,
    as_of: Moment,
    step: str = "day",
    keys: Sequence[str] = (),
    ties: Sequence[str] = (),
    output: str = "timestamp",
) -> DataFrame:
    """Re-date a data set so that consecutive rows end at ``as_of``.

    Row ``i`` of ``n`` gets ``as_of - (n - 1 - i)`` days, or with
    ``step='minute'`` ``as_of - (n + 1 - i)`` minutes. ``keys`` split the frame
    into data sets of their own; ``order`` is a timestamp or a sequence number,
    ``ties`` order equal ones; rows without an order come last. Rows are numbered slice by slice
    (see ``functions.slices``), never all in one task.
    """
    if step not in ("day", "minute"):
        raise ValueError("step must be 'day' or 'minute'")
    numbered = number_rows(frame, keys, order, ties)
    steps_back = F.col("total_rows") - F.col("row_index") + (-1 if step == "day" else 1)
    length = F.expr("INTERVAL '1' DAY" if step == "day" else "INTERVAL '1' MINUTE")
    return (
        numbered.withColumn(output, instant(as_of) - steps_back * length)
        .drop("row_index", "total_rows")
    )


def append_noon_speed(
    series: DataFrame, noon: DataFrame, vessel_id: int, as_of: Moment
) -> DataFrame:
    """Append a noon log's speed through water to a speed series, re-dated by minute."""
    dated = redate(noon, "Log_No", as_of, step="minute")
    speed = dated.select(
        F.lit(vessel_id).cast(series.schema["vessel_id"].dataType).alias("vessel_id"),
        "timestamp",
        F.nanvl(F.col("STW"), F.lit(None).cast("double")).alias("sog"),
        F.lit(None).cast("double").alias("stw"),
    )
    return series.select("vessel_id", "timestamp", "sog", "stw").unionByName(speed)


def import_vessels(
    listed: DataFrame,
    order: str,
    constants: Mapping[str, object],
    allow: Sequence[str] = IMPORT_COLUMNS,
    first_id: int = FIRST_IMPORT_ID,
    existing: DataFrame | None = None,
) -> DataFrame:
    """The allowed columns of a vessel list, constants set, ids counted from ``first_id``.

    ``order`` is the sequence number that fixes the counting order. With an
    ``existing`` vessel table ids go on behind its largest one, if it has any.
    """
    numbered = number_rows(listed, (), order)
    first = F.lit(first_id)
    if existing is not None:
        first = F.coalesce(existing.agg(F.max("id") + 1).scalar(), first)
    given = [c for c in listed.columns if c in allow and c not in constants and c != "id"]
    return numbered.select(
        (first + F.col("row_index")).cast("bigint").alias("id"),
        *given,
        *[F.lit(value).alias(name) for name, value in constants.items()],
    )
