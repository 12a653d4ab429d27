"""Parquet tables: facts in day folders, dimensions as plain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wakeline.functions.times import day_of
from wakeline.schemas import FACT_TIMES, TABLES


def write_fact(
    frame: DataFrame,
    root: str,
    table: str,
    mode: str = "errorifexists",
    target: str | None = None,
) -> None:
    """Write a fact table in ``day`` folders, rows of one entity next to each other.

    ``target`` is the folder under ``root``, by default the table's name.

    Range partitioning by (day, entity, time) samples the data, so a busy day or
    vessel is cut into several files and a quiet one shares a file.
    """
    moment = FACT_TIMES[table]
    entity = next((c for c in ("vessel_id", "device_id") if c in frame.columns), None)
    order = ["day", *([entity] if entity else []), moment]
    (
        frame.withColumn("day", day_of(moment))
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .write.mode(mode)
        .partitionBy("day")
        .parquet(f"{root}/{target or table}")
    )


def append_rows(frame: DataFrame, root: str, table: str) -> None:
    """Append to a table of the lake."""
    if table in FACT_TIMES:
        write_fact(frame, root, table, "append")
    else:
        frame.write.mode("append").parquet(f"{root}/{table}")


class Lake:
    """The input tables under one root: ``lake.interp``, ``lake.vessel`` and so on.

    Facts carry their ``day`` folder as a column; a window given to an operator
    prunes folders through it. Folders are listed once per table; open the lake
    anew to see files that came later.
    """

    def __init__(self, spark: SparkSession, root: str):
        self._spark = spark
        self._root = root.rstrip("/")
        self._frames: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in TABLES:
            raise AttributeError(name)
        if name not in self._frames:
            schema = TABLES[name]
            if name in FACT_TIMES:
                schema = T.StructType([*schema.fields, T.StructField("day", T.DateType())])
            self._frames[name] = self._spark.read.schema(schema).parquet(f"{self._root}/{name}")
        return self._frames[name]
