"""Broadcasts behind a size check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows a broadcast side may hold. The frames hinted here have a handful of
# fixed-width columns, so this stays around 20 MB.
BROADCAST_ROWS = 200_000


def broadcast_if_small(frame: DataFrame, dimension: DataFrame, rows_per_key: int = 1) -> DataFrame:
    """Hint ``frame`` for broadcast when ``dimension`` proves that it is small.

    The caller guarantees that ``frame`` holds at most ``rows_per_key`` rows per
    row of ``dimension`` (say, one latest time per vessel). Catalyst cannot see
    that bound through an aggregate over a large fact table. The check counts at
    most one row over the bound of the dimension; beyond it the frame is
    returned as it is and the join runs as a shuffle join.
    """
    allowed = BROADCAST_ROWS // max(1, rows_per_key)
    if dimension.select(F.lit(1)).limit(allowed + 1).count() <= allowed:
        return F.broadcast(frame)
    return frame
