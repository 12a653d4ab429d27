"""Gap filling: a regular time grid per vessel, and what was measured on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.functions.times import Moment, as_datetime, floor_to_grid, instant, minutes_interval

# Grid points built from one row. The vessel table is one small file, so its
# (vessel, chunk) pairs are spread over tasks before they are expanded.
CHUNK_POINTS = 10_080


def spine(
    vessel: DataFrame, start: Moment, end: Moment, minutes: int, key: str = "vessel_id"
) -> DataFrame:
    """``key, bin`` for every vessel and every grid point from ``start`` to ``end``.

    ``start`` is floored to the grid, so a start off the grid still lines up
    with the bins. The pairs go to as many tasks as the session's shuffles have; a
    number that is given is not coalesced, although the pairs themselves are few.
    """
    first, last = floor_to_grid(start, minutes), as_datetime(end)
    step, chunk_step = minutes_interval(minutes), minutes_interval(minutes * CHUNK_POINTS)
    owners = vessel.select(F.col("id").alias(key))
    if last < first:
        return owners.select(key, instant(first).alias("bin")).where(F.lit(False))
    tasks = int(vessel.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    starts = owners.select(
        key, F.explode(F.sequence(instant(first), instant(last), chunk_step)).alias("chunk")
    ).repartition(tasks, key, "chunk")
    chunk_end = F.least(F.col("chunk") + chunk_step - step, instant(last))
    return starts.select(key, F.explode(F.sequence("chunk", chunk_end, step)).alias("bin"))


def gap_fill(
    measured: DataFrame,
    vessel: DataFrame,
    start: Moment,
    end: Moment,
    minutes: int,
    values: list[str],
    key: str = "vessel_id",
) -> DataFrame:
    """``key, bin`` + ``values`` on the whole grid; bins without data read 0.

    ``measured`` is already one row per (vessel, bin), so the join moves bins,
    not readings.
    """
    grid = spine(vessel, start, end, minutes, key)
    return grid.join(measured, [key, "bin"], "left").select(
        key, "bin", *[F.coalesce(F.col(v), F.lit(0)).alias(v) for v in values]
    )
