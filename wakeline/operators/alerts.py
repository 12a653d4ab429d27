"""Alert log (A1, A2)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.functions.frames import number, pick_vessels

# The name of each severity.
SEVERITY_NAMES = {0: "", 1: "critical", 2: "warning", 3: "warning", 4: "info", 5: "info"}


def severity_name(severity: Column) -> Column:
    """A2: name of a severity; null for a number that has none."""
    chain: Column | None = None
    for value, name in SEVERITY_NAMES.items():
        hit = severity == value
        chain = F.when(hit, F.lit(name)) if chain is None else chain.when(hit, F.lit(name))
    return chain


def alerts(
    alert: DataFrame,
    vessel: DataFrame,
    alert_type: DataFrame,
    device: DataFrame,
    vessel_ids: Iterable[int] | None = None,
) -> DataFrame:
    """A1: alerts with vessel, severity and text; those without a known device drop out."""
    names = vessel.select(F.col("id").alias("vessel_id"), F.col("name").alias("vessel_name"))
    kinds = alert_type.select(F.col("id").alias("alert_type_id"), "severity", "description")
    text = F.when(
        F.col("label_name").isNotNull(),
        F.concat(F.coalesce("description", F.lit("")), F.lit(" :: "), F.col("label_name")),
    ).otherwise(F.col("description"))
    return (
        pick_vessels(alert, vessel_ids)
        .join(names, "vessel_id")
        .join(kinds, "alert_type_id")
        .join(device.select("device_id", "label_name"), "device_id")
        .select(
            "vessel_id",
            F.col("severity").cast("int").alias("severity"),
            severity_name(F.col("severity")).alias("type"),
            "vessel_name",
            F.col("alert_datetime").alias("time"),
            number("latitude", "lat"),
            number("longitude", "long"),
            text.alias("text"),
        )
    )
