"""Small helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def pick_vessels(
    frame: DataFrame,
    vessel_ids: Iterable[int] | None = None,
    vessel: DataFrame | None = None,
    key: str = "vessel_id",
) -> DataFrame:
    """Keep the named vessels, and only rows of vessels listed in ``vessel``."""
    if vessel_ids is not None:
        frame = frame.where(F.col(key).isin(list(vessel_ids)))
    if vessel is not None:
        frame = frame.join(vessel.select(F.col("id").alias(key)), key, "left_semi")
    return frame


def number(value: Column | str, name: str | None = None) -> Column:
    """A measure at the output edge, from a column or a SQL expression: double."""
    column = F.expr(f"cast({value} as double)") if isinstance(value, str) else value.cast("double")
    return column if name is None else column.alias(name)


def mean(column: str, name: str) -> Column:
    """Average from an exact decimal sum, as double; null over no values."""
    return F.expr(f"cast(sum({column}) as double) / count({column}) as {name}")


def total_sql(*columns: str) -> str:
    """SQL for the sum of several columns row by row, nulls as zero."""
    return " + ".join(f"coalesce({c}, 0)" for c in columns)


def long_rows(frame: DataFrame, keep: Sequence[str], rows: Sequence[Column]) -> DataFrame:
    """Unpivot: each of ``rows`` (structs of one shape) becomes a row of its own."""
    return frame.select(*keep, F.explode(F.array(*rows)).alias("entry")).select(*keep, "entry.*")


def _name(*parts: str) -> str:
    return ".".join(f"`{part}`" for part in parts)


def rounded(frame: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column; decimals become doubles first."""
    columns = []
    for field in frame.schema.fields:
        column = _name(field.name)
        if isinstance(field.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            column = f"round(cast({column} as double), {digits}) as {column}"
        columns.append(column)
    return frame.selectExpr(*columns)


def flattened(frame: DataFrame) -> DataFrame:
    """Nested records as ``record_field`` columns."""
    columns = []
    for field in frame.schema.fields:
        if isinstance(field.dataType, T.StructType):
            columns += [
                f"{_name(field.name, inner)} as {_name(f'{field.name}_{inner}')}"
                for inner in field.dataType.names
            ]
        else:
            columns.append(_name(field.name))
    return frame.selectExpr(*columns)


def newest_first(frame: DataFrame, moment: str = "timestamp", key: str = "vessel_id") -> DataFrame:
    """Presentation order of the series: by vessel, newest first.

    A range-partitioned sort; ask for it only where the order is read.
    """
    return frame.orderBy(F.col(key), F.col(moment).desc())
