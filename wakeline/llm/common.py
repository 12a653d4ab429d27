"""What the training-data operators share."""

from __future__ import annotations

import string
from collections.abc import Iterator
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wakeline.sources.shared import shared_folder


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables, through Spark's reader so that any store works."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


Batch = TypeVar("Batch")


def given_back(batches: Iterator[Batch]) -> Iterator[Batch]:
    """The same batches; what Arrow keeps for later ones goes back to the system after each.

    Spark's Python workers live on between tasks, and each would keep as much as its
    largest batches took, beside the other workers of the executor.
    """
    for batch in batches:
        yield batch
        del batch
        pa.default_memory_pool().release_unused()
    pa.default_memory_pool().release_unused()


def settle(frame: DataFrame) -> DataFrame:
    """The frame with its lineage cut by a reliable checkpoint in the shared folder."""
    context = frame.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(frame.sparkSession))
    return frame.checkpoint(eager=True)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is.

    ``lower`` also changes letters beyond ASCII, so it serves only texts without any.
    """
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def free_name(taken: list[str], wanted: str) -> str:
    """A column name that no other has, in either case."""
    lower = {c.lower() for c in taken}
    while wanted.lower() in lower:
        wanted += "_"
    return wanted


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def rank_within(
    frame: DataFrame,
    key: str,
    order: list[str],
    counts: dict[int, int],
    slice_rows: int | None = None,
) -> DataFrame:
    """Add ``rank_``, gapless from 0 within each value of ``key``.

    Rows of one key are dealt by a hash of ``order`` into slices of about
    ``slice_rows`` rows (at least 512, and no more than 65,536 slices in all);
    ranks count through the slices, and by ``order`` within one. So a key may
    hold any share of the rows. ``key`` is a small non-negative number whose
    values have a bound of their own; ``counts`` has the rows of each. ``frame``
    is read twice and has to be settled.
    """
    size = slice_rows or max(512, sum(counts.values()) // 65536)
    widths = [(int(k), -(-n // size)) for k, n in counts.items() if n > size]
    wide = frame.sparkSession.createDataFrame(widths or [(-1, 1)], f"`{key}` bigint, width_ bigint")
    frame = frame.join(F.broadcast(wide), key, "left")
    width = F.coalesce(F.col("width_"), F.lit(1))
    dealt = frame.withColumn("slice_", F.pmod(F.xxhash64(*order), width)).drop("width_")
    starts = (
        dealt.groupBy(key, "slice_")
        .agg(F.count(F.lit(1)).alias("n_"))
        .withColumn(
            "start_",
            F.sum("n_").over(Window.partitionBy(key).orderBy("slice_")) - F.col("n_"),
        )
        .drop("n_")
    )
    numbered = dealt.withColumn(
        "rank_",
        F.row_number().over(Window.partitionBy(key, "slice_").orderBy(*order)).cast("long") - 1,
    )
    return (
        numbered.join(starts, [key, "slice_"])
        .withColumn("rank_", F.col("rank_") + F.col("start_"))
        .drop("slice_", "start_")
    )
