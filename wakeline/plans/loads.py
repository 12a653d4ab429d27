"""Appends that can be repeated, and rollups that follow them.

A load has a batch id. Its rows are staged in a folder of that batch, in day folders
as any fact, and are seen by readers only once the batch is published: one small file
that names the batch and the days it touched. A load that broke off is done again
under its id and replaces what it had staged; one that was published is left alone.
The published days are also the log that tells a rollup which days to add up anew
when late or out-of-order rows come.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wakeline.functions.times import day_of
from wakeline.operators.deident import FIRST_IMPORT_ID, import_vessels
from wakeline.operators.rollups import Rollup
from wakeline.schemas import FACT_TIMES, TABLES
from wakeline.sources.lake import write_fact

_NAME = re.compile(r"[A-Za-z0-9_-]+")
_LOG = T.StructType([T.StructField("day", T.DateType()), T.StructField("batch", T.StringType())])


def _log(spark: SparkSession, path: str) -> DataFrame:
    """The rows (day, batch) under a log folder; none where it is not there yet."""
    try:
        return spark.read.schema(_LOG).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _LOG)


def _note(frame: DataFrame, path: str) -> None:
    """Log rows as one file, which is there whole or not at all."""
    frame.coalesce(1).write.mode("errorifexists").parquet(path)


def published(spark: SparkSession, root: str, table: str) -> DataFrame:
    """``(day, batch)`` of all batches that readers see; the day is null for tables without days."""
    return _log(spark, f"{root}/_published/{table}")


def stage(frame: DataFrame, root: str, table: str, batch: str) -> None:
    """Write a batch where no reader looks; what an earlier try left there is replaced."""
    if not _NAME.fullmatch(batch):
        raise ValueError("a batch id is made of letters, digits, - and _")
    target = f"{table}/batch={batch}"
    if table in FACT_TIMES:
        write_fact(frame, root, table, "overwrite", target)
    else:
        frame.write.mode("overwrite").parquet(f"{root}/{target}")


def publish(spark: SparkSession, root: str, table: str, batch: str) -> None:
    """Let readers see a staged batch."""
    if table in FACT_TIMES:
        staged = spark.read.parquet(f"{root}/{table}/batch={batch}")
        days = staged.select(F.col("day").cast("date").alias("day")).distinct()
    else:
        days = spark.createDataFrame([(None,)], "day date")
    _note(days, f"{root}/_published/{table}/batch={batch}")


def append_batch(frame: DataFrame, root: str, table: str, batch: str) -> bool:
    """Stage and publish; whether that was needed. A published batch is a no-op.

    One loader at a time works on a batch id. An empty frame publishes a batch without days.
    """
    spark = frame.sparkSession
    if published(spark, root, table).where(F.col("batch") == batch).limit(1).count():
        return False
    stage(frame, root, table, batch)
    if table in FACT_TIMES and not frame.limit(1).count():
        _note(spark.createDataFrame([(None,)], "day date"), f"{root}/_published/{table}/batch={batch}")
    else:
        publish(spark, root, table, batch)
    return True


def read_batches(spark: SparkSession, root: str, table: str) -> DataFrame:
    """The rows of all published batches; facts carry their ``day``."""
    schema = TABLES[table]
    if table in FACT_TIMES:
        schema = T.StructType([*schema.fields, T.StructField("day", T.DateType())])
    # One name per load, so the list grows with the loads and not with the rows.
    log = published(spark, root, table)
    kept = log.where("day is not null") if table in FACT_TIMES else log
    names = sorted(r["batch"] for r in kept.select("batch").distinct().collect())
    if not names:
        return spark.createDataFrame([], schema)
    whole = T.StructType([*schema.fields, T.StructField("batch", T.StringType())])
    paths = [f"{root}/{table}/batch={name}" for name in names]
    return spark.read.schema(whole).option("basePath", f"{root}/{table}").parquet(*paths).drop("batch")


def pending_days(spark: SparkSession, root: str, rollup: Rollup) -> DataFrame:
    """``(day, batch)`` published since the rollup was last brought up to date."""
    done = _log(spark, f"{root}/_rolled/{rollup.name}").select("batch").distinct()
    return published(spark, root, rollup.table).join(done, "batch", "left_anti").select("day", "batch")


def refresh(spark: SparkSession, root: str, rollup: Rollup) -> int:
    """Add up anew every day that a batch touched since the last time; how many they were.

    A day is computed whole from all published rows and replaces its former states, so
    it does not matter in which order batches came, nor whether a refresh that
    broke off is done again: batches are noted as done only at the end.
    """
    log = pending_days(spark, root, rollup).collect()
    if not log:
        return 0
    days = sorted({r["day"] for r in log if r["day"] is not None})
    if days:
        facts = read_batches(spark, root, rollup.table).where(F.col("day").isin(days))
        (
            rollup.build(facts)
            .withColumn("day", day_of("period", "day"))
            .repartition("day")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("day")
            .parquet(f"{root}/rollup_{rollup.name}")
        )
    names = sorted({r["batch"] for r in log})
    note = spark.createDataFrame([(None, n) for n in names], _LOG)
    note.coalesce(1).write.mode("append").partitionBy("batch").parquet(f"{root}/_rolled/{rollup.name}")
    return len(days)


def read_rollup(spark: SparkSession, root: str, rollup: Rollup) -> DataFrame:
    """The states of a rollup, with their ``day``; none before the first refresh."""
    empty = rollup.build(spark.createDataFrame([], TABLES[rollup.table]))
    schema = T.StructType([*empty.schema.fields, T.StructField("day", T.DateType())])
    try:
        return spark.read.schema(schema).parquet(f"{root}/rollup_{rollup.name}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def append_vessels(
    listed: DataFrame, root: str, order: str, constants: Mapping[str, object], batch: str
) -> bool:
    """A vessel list as a batch of the vessel table, ids continued from its largest one."""
    existing = read_batches(listed.sparkSession, root, "vessel")
    rows = import_vessels(listed, order, constants, first_id=FIRST_IMPORT_ID, existing=existing)
    return append_batch(rows, root, "vessel", batch)
