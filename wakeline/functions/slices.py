"""Cutting long sequences into slices that fit one task, and counting through them.

A window over ``partitionBy(vessel)`` puts a vessel's whole history in one
task. The operators that need order therefore work per (vessel, slice), and carry
what crosses a slice boundary through a summary with one row per (vessel, slice).
A time slice is one clock hour, and an hour with more rows than one task should
hold is cut again at borders that its own counts per second give. Where rows are
numbered, slices are numbers, and their counts are added up in two levels: within
groups of slices side by side, and over the groups, of which there are at most
``1 << GROUP_BITS`` however long the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.functions.times import EPOCH, instant_sql, time_bin

SLICE_MINUTES = 60
SLICE_VALUES = 100_000
#: Rows of a time slice from which it is cut again.
SLICE_ROWS = 50_000
#: Slice numbers have twice these bits: the upper ones name the group.
GROUP_BITS = 24
# Half of the numbers are for rows with an order, the rest for rows without one.
_HALF = 1 << (2 * GROUP_BITS - 1)
_QUARTER = _HALF >> 1
#: Slices that rows with neither an order nor a tie are dealt to.
DEALT = 1 << 16


def time_slice(moment: str, minutes: int = SLICE_MINUTES) -> Column:
    return time_bin(moment, minutes)


def slice_offsets(
    frame: DataFrame, keys: Sequence[str], slice_col: str, descending: bool = False
) -> DataFrame:
    """Per (keys, slice): rows in it, rows in the slices before it, rows in all.

    For slices that the calendar bounds: one key's slices are one window.
    """
    sizes = frame.groupBy(*keys, slice_col).agg(F.count(F.lit(1)).alias("slice_rows"))
    whole = Window.partitionBy(*keys)
    column = F.col(slice_col)
    order = column.desc_nulls_last() if descending else column.asc_nulls_last()
    earlier = whole.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(
        *keys,
        slice_col,
        "slice_rows",
        F.coalesce(F.sum("slice_rows").over(earlier), F.lit(0)).alias("rows_before"),
        F.sum("slice_rows").over(whole).alias("total_rows"),
    )


def split_dense(
    frame: DataFrame, keys: Sequence[str], slice_col: str, moment: str, rows: int | None = None
) -> DataFrame:
    """Slices with more than ``rows`` rows cut at borders of their own; the others stay.

    ``slice_col`` is a start time, and a part's new slice is the time it starts at,
    so slices keep their order. Rows of a dense slice are counted per second; seconds
    in a row go to one part until it holds ``rows``, so a part holds
    ``rows`` and one second more at most. Counts are exact and do not depend on the
    order they are added in, so every use of the frame sees the same borders.
    """
    most = rows or SLICE_ROWS
    by = [*keys, slice_col]
    dense = frame.groupBy(*by).count().where(F.col("count") > most).drop("count")
    epoch, one = instant_sql(EPOCH), "INTERVAL '1' SECOND"
    second = F.expr(f"{epoch} + {one} * (({moment} - {epoch}) div {one})")
    seconds = (
        frame.join(dense, by, "left_semi").groupBy(*by, second.alias("second_start")).count()
    )
    earlier = Window.partitionBy(*by).orderBy("second_start").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("count").over(earlier), F.lit(0))
    borders = (
        seconds.withColumn("part", F.floor(before / most))
        .groupBy(*by, "part")
        .agg(F.min("second_start").alias("part_start"))
        .where("part > 0")
        .groupBy(*by)
        .agg(F.array_sort(F.collect_list("part_start")).alias("part_starts"))
    )
    passed = F.expr(f"filter(part_starts, b -> b <= {moment})")
    return (
        frame.join(borders, by, "left")
        .withColumn(slice_col, F.coalesce(F.element_at(F.when(F.size(passed) > 0, passed), -1), slice_col))
        .drop("part_starts")
    )


def _number(frame: DataFrame, column: str) -> Column:
    """A slice number that rises with a time or a number, clamped to the quarter on either side of 0."""
    kind = frame.schema[column].dataType.typeName()
    if kind.startswith(("timestamp", "date")):
        moment = f"cast(`{column}` as timestamp_ntz)"
        # Truncation towards zero would merge the minutes around the epoch, which keeps the order.
        value = F.expr(f"({moment} - {instant_sql(EPOCH)}) div INTERVAL '1' MINUTE")
    else:
        value = F.floor(F.col(f"`{column}`") / SLICE_VALUES).cast("bigint")
        if kind in ("double", "float"):
            value = F.when(F.isnan(f"`{column}`"), F.lit(_QUARTER)).otherwise(value)
    return F.greatest(F.lit(-_QUARTER), F.least(F.lit(_QUARTER - 1), value))


def slice_number(frame: DataFrame, order: str, ties: Sequence[str]) -> Column:
    """Slice of a row, rising with its place: rows with an order, then those without.

    Rows without an order are sliced by their first tie, and those that have none
    either are dealt by a hash of the row.
    """
    row = F.xxhash64(*[F.col(f"`{c}`") for c in frame.columns])
    loose = F.lit(_HALF) + F.pmod(row, F.lit(DEALT if len(ties) < 2 else 1))
    if ties:
        tie = F.lit(_HALF + DEALT + _QUARTER // 2) + F.floor(_number(frame, ties[0]) / 4)
        loose = F.when(F.col(f"`{ties[0]}`").isNull(), loose).otherwise(tie)
    placed = _number(frame, order) + F.lit(_QUARTER)
    return F.when(F.col(f"`{order}`").isNull(), loose).otherwise(placed).cast("bigint")


def running_counts(sizes: DataFrame, keys: Sequence[str], number: str) -> DataFrame:
    """``sizes(keys, number, slice_rows)`` with rows before each slice and rows in all.

    Two levels: a window within each group of slices, and one over the groups of a
    key. Neither holds more than ``1 << GROUP_BITS`` rows of one key.
    """
    grouped = sizes.withColumn("slice_group", F.shiftright(number, GROUP_BITS))
    groups = grouped.groupBy(*keys, "slice_group").agg(F.sum("slice_rows").alias("group_rows"))
    above = Window.partitionBy(*keys)
    earlier = above.orderBy("slice_group").rowsBetween(Window.unboundedPreceding, -1)
    starts = groups.select(
        *[F.col(k).alias(f"{k}_of_group") for k in keys],
        F.col("slice_group").alias("group_number"),
        F.coalesce(F.sum("group_rows").over(earlier), F.lit(0)).alias("group_before"),
        F.sum("group_rows").over(above).alias("total_rows"),
    )
    same = [grouped[k].eqNullSafe(starts[f"{k}_of_group"]) for k in keys]
    within = (
        Window.partitionBy(*keys, "slice_group")
        .orderBy(number)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        grouped.withColumn("in_group", F.coalesce(F.sum("slice_rows").over(within), F.lit(0)))
        .join(starts, [*same, F.col("slice_group") == F.col("group_number")])
        .select(
            *keys, number, (F.col("group_before") + F.col("in_group")).alias("rows_before"), "total_rows"
        )
    )


def number_rows(
    frame: DataFrame, keys: Sequence[str], order: str, ties: Sequence[str] = ()
) -> DataFrame:
    """Add ``row_index`` (from 0) and ``total_rows`` within ``keys``.

    Rows are ordered by ``order``, a time or a number, then by ``ties``; rows without
    an order come last. Only rows of one slice are ever sorted together, and the
    running count over slices supplies the rest. A null key is a key like any other:
    no row is dropped.
    """
    sliced = frame.withColumn("row_slice", slice_number(frame, order, ties))
    sizes = sliced.groupBy(*keys, "row_slice").agg(F.count(F.lit(1)).alias("slice_rows"))
    by = [*keys, "row_slice"]
    offsets = running_counts(sizes, keys, "row_slice").withColumnsRenamed(
        {c: f"{c}_of_slice" for c in by}
    )
    in_slice = Window.partitionBy(*by).orderBy(*[F.col(f"`{c}`") for c in (order, *ties)])
    ranked = sliced.withColumn("slice_index", F.row_number().over(in_slice))
    same = [ranked[c].eqNullSafe(offsets[f"{c}_of_slice"]) for c in keys]
    same.append(ranked["row_slice"] == offsets["row_slice_of_slice"])
    return (
        ranked.join(offsets, same)
        .drop(*[f"{c}_of_slice" for c in by])
        .withColumn("row_index", F.col("rows_before") + F.col("slice_index") - 1)
        .drop("row_slice", "slice_index", "rows_before")
    )
