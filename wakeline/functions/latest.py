"""Latest and earliest row per key as hash aggregates.

Time and id are packed into one decimal, and ``max_by`` / ``min_by`` keep each
value beside it. Such a buffer has a fixed width, so Spark aggregates in a hash
table on the map side; a ``max`` of a struct would sort the whole scan first. A
vessel that holds a third of the table costs one row per task. Ties on time go to
the higher id. Text columns have no fixed width: join them after the aggregate.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.functions.times import EPOCH, instant_sql

# Wider than the range of a bigint id, so times never run into each other.
_ID_RANGE = "20000000000000000000BD"
# What a missing time or id counts as: less than any real one.
_NO_TIME, _NO_ID = "-1000000000000000000L", "-9223372036854775807L"


def packed(order: Sequence[str]) -> str:
    """SQL for one number that orders like (time, id), or like a single id; missing ones first."""
    ident = f"cast(coalesce({order[-1]}, {_NO_ID}) as decimal(20, 0))"
    if len(order) == 1:
        return ident
    moment, _ = order
    micros = f"({moment} - {instant_sql(EPOCH)}) div interval '0.000001' second"
    time = f"cast(coalesce({micros}, {_NO_TIME}) as decimal(19, 0))"
    return f"cast({time} * {_ID_RANGE} + {ident} as decimal(38, 0))"


def pick(
    how: str, name: str, order: Sequence[str], fields: Mapping[str, str], keep: str | None = None
) -> Column:
    """Aggregate ``name``: a struct of ``fields`` (SQL by name) of the first or last row.

    ``how`` is ``max_by`` or ``min_by``; null if no row satisfies ``keep``.
    """
    return F.expr(f"{pick_sql(how, order, fields, keep)} as {name}")


def pick_sql(
    how: str, order: Sequence[str], fields: Mapping[str, str], keep: str | None = None
) -> str:
    """``pick`` as SQL text; names in ``order`` may be fields of structs."""
    only = "" if keep is None else f" filter (where {keep})"
    key = packed(order)
    cells = ", ".join(f"{how}({value}, {key}){only} as {field}" for field, value in fields.items())
    return f"case when count(*){only} > 0 then struct({cells}) end"


def newest(
    name: str, order: Sequence[str], values: Sequence[str], keep: str | None = None
) -> Column:
    """Aggregate ``name``: time + ``values`` of the newest row that satisfies ``keep``.

    ``order`` is time and id, or an id alone; the id itself is kept only as one of
    ``values``, since each field is a comparison per row.
    """
    return pick("max_by", name, order, {c: c for c in (*order[:-1], *values)}, keep)


def oldest(
    name: str, order: Sequence[str], values: Sequence[str], keep: str | None = None
) -> Column:
    return pick("min_by", name, order, {c: c for c in (*order[:-1], *values)}, keep)


def latest_per(
    frame: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: Sequence[str],
    keep: str | None = None,
) -> DataFrame:
    """One row per key: ``keys``, the time of ``order`` and ``values`` of the newest row."""
    if keep is not None:
        frame = frame.where(keep)
    return (
        frame.groupBy(*keys)
        .agg(newest("newest", order, values))
        .select(*keys, "newest.*")
    )
