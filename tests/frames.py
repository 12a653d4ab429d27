"""Small input tables for the unit tests."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal

from pyspark.sql import types as T

from wakeline.schemas import TABLES


def at(text: str) -> datetime:
    """``'05 10:30'`` is 2024-01-05 10:30."""
    return datetime.fromisoformat(f"2024-01-{text}")


def table(spark, name, rows):
    """Rows given as dicts; columns that are left out are null."""
    schema = TABLES[name]

    def value(field, row):
        given = row.get(field.name)
        if given is None:
            return None
        if isinstance(field.dataType, T.DecimalType):
            return Decimal(str(given))
        if isinstance(field.dataType, T.DoubleType):
            return float(given)
        return given

    unknown = {k for row in rows for k in row} - set(schema.names)
    assert not unknown, unknown
    data = [tuple(value(f, row) for f in schema.fields) for row in rows]
    return spark.createDataFrame(data, schema)


def fleet(spark, *ids):
    return table(
        spark,
        "vessel",
        [
            {
                "id": i,
                "imo": 9000000 + i,
                "mmsi": 533000000 + i,
                "name": f"V{i}",
                "customer_id": 1,
                "fleet_type_id": 0,
                "vessel_type_id": 0,
                "is_active": True,
            }
            for i in ids
        ],
    )


def rows(frame, *columns):
    """Collected rows as sorted tuples of the named columns."""
    found = [tuple(r) for r in frame.select(*columns).collect()]
    return sorted(found, key=lambda row: [(value is not None, value) for value in row])
