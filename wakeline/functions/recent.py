"""Latest-state queries that read recent days first."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.functions.sizing import broadcast_if_small
from wakeline.functions.times import Moment, within

Find = Callable[[DataFrame], DataFrame]


def recent_first(
    facts: DataFrame,
    moment: str,
    since: Moment | None,
    vessel: DataFrame | None,
    find: Find,
    complete: Column | None = None,
    find_recent: Find | None = None,
    key: str = "vessel_id",
    id_column: str = "id",
) -> DataFrame:
    """``find(facts)`` per vessel, looking at rows from ``since`` on first.

    ``find`` gives one row per ``vessel_id`` that the newest rows decide; ``find_recent``
    does the same for rows from ``since`` on, where that can be said with less reading.
    Facts of another ``key`` name the ``id_column`` of their own table, given as ``vessel``. What
    it finds among recent rows is final (where ``complete``); only the vessels
    of ``vessel`` it leaves open are looked up in the whole history. When none
    is left open, the adaptive plan drops the second read before it starts, so
    a fleet that reports costs a few day folders and not the archive. The
    result is the same as without ``since``.
    """
    if since is None:
        return find(facts)
    if vessel is None:
        raise ValueError("since needs the vessel table, to know which vessels to look for")
    wanted = vessel.select(F.col(id_column).alias(key))
    recent = (find_recent or find)(within(facts, moment, since))
    if complete is not None:
        recent = recent.where(complete)
    open_vessels = wanted.join(recent.select(key), key, "left_anti")
    rest = find(facts.join(broadcast_if_small(open_vessels, vessel), key, "left_semi"))
    return recent.unionByName(rest)
