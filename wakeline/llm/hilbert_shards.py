"""Sharding along a Hilbert curve.

Several metadata dimensions are quantised, cells are sorted by their index on the
curve, and the sorted rows are cut into runs. Neighbours on the curve are near in
every dimension, so each shard covers a small box and a filter on any dimension
skips most shards.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.llm.common import partitions, rank_within, settle

#: Bits of each dimension; the cells are at most 2 ** (dimensions * BITS).
BITS = 5


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """Distance along the Hilbert curve of integer points, one row each.

    The transpose form: undo the excess rotations from the highest bit down, Gray
    encode, then interleave the bits.
    """
    x = points.astype(np.int64).copy()
    dims = x.shape[1]
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for d in range(dims):
            high = (x[:, d] & bit) != 0
            swap = np.where(high, 0, (x[:, 0] ^ x[:, d]) & low)
            x[:, 0] ^= np.where(high, low, swap)
            x[:, d] ^= swap if d else 0
    for d in range(1, dims):
        x[:, d] ^= x[:, d - 1]
    flip = np.zeros(len(x), dtype=np.int64)
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[:, -1] & (1 << level), (1 << level) - 1, 0)
    x ^= flip[:, None]
    index = np.zeros(len(x), dtype=np.int64)
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            index = (index << 1) | ((x[:, d] >> level) & 1)
    return index


def hashed(column: Column) -> Column:
    """A text dimension as one of ``2 ** BITS`` values; null is a value of its own kind."""
    return F.pmod(F.xxhash64(column), F.lit(1 << BITS)).cast("int")


def magnitude(column: Column) -> Column:
    """A size dimension on a scale of powers of the square root of two."""
    return F.least(F.floor(2 * F.log2(F.greatest(column, F.lit(1)))), F.lit((1 << BITS) - 1)).cast(
        "int"
    )


def hilbert_shards(
    rows: DataFrame, dimensions: list[Column], order: list[str], shards: int
) -> DataFrame:
    """Add ``shard`` and ``slot``: runs of the curve whose counts differ by one at most.

    ``dimensions`` are integers from 0 to ``2 ** BITS - 1``; ``order`` settles the
    order within a cell and may hold nulls and repeats (equal rows are
    interchangeable). Slots count gapless from 0 within a shard. The histogram of
    cells is the only thing that the driver sees; its size is bounded by ``BITS``
    and the number of dimensions. A hot cell is numbered in slices, so it may
    hold any share of the rows. An empty table gives an empty result.
    """
    cells = 1 << (BITS * len(dimensions))
    if cells > 1 << 18:
        raise ValueError("too many cells: take fewer dimensions")
    cell = F.lit(0)
    for dimension in dimensions:
        cell = cell * (1 << BITS) + dimension
    rows = settle(rows.withColumn("cell_", cell.cast("int")))
    found = rows.groupBy("cell_").count().collect()
    ids = np.array([r["cell_"] for r in found], dtype=np.int64)
    sizes = np.array([r["count"] for r in found], dtype=np.int64)
    shifts = BITS * np.arange(len(dimensions) - 1, -1, -1)
    along = np.argsort(hilbert_index((ids[:, None] >> shifts) & ((1 << BITS) - 1), BITS))
    starts = np.zeros(cells, dtype=np.int64)
    starts[ids[along]] = np.cumsum(sizes[along]) - sizes[along]
    total = int(sizes.sum())
    base, longer = divmod(total, shards)
    ranked = rank_within(rows, "cell_", order, dict(zip(ids.tolist(), sizes.tolist())))
    first = rows.sparkSession.createDataFrame(
        [(int(c), int(starts[c])) for c in ids] or [(0, 0)], "cell_ int, first_ bigint"
    )
    placed = ranked.join(F.broadcast(first), "cell_").withColumn(
        "place_", F.col("first_") + F.col("rank_")
    )
    edge = longer * (base + 1)
    shard = F.when(F.col("place_") < edge, F.floor(F.col("place_") / (base + 1))).otherwise(
        longer + F.floor((F.col("place_") - edge) / max(base, 1))
    )
    placed = placed.withColumn("shard", shard.cast("int"))
    begin = F.col("shard") * base + F.least(F.col("shard"), F.lit(longer))
    return placed.withColumn("slot", (F.col("place_") - begin).cast("long")).drop(
        "cell_", "first_", "rank_", "place_"
    )


def write_shards(sharded: DataFrame, path: str, shards: int) -> None:
    """One folder per shard, rows in curve order, so that file statistics prune well.

    Rows are dealt by ranges of (shard, slot) to ``shards`` tasks at least, so a large shard
    is several files, each a run of the curve.
    """
    tasks = max(shards, partitions(sharded.sparkSession))
    (
        sharded.repartitionByRange(tasks, "shard", "slot")
        .sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard")
        .parquet(path)
    )


def shard_documents(documents: DataFrame, shards: int = 24) -> DataFrame:
    """Documents placed by source, language and size.

    Returns doc_id, size (UTF-8 bytes plus 8), text_crc32, shard and slot. A null
    text has no bytes and checksum 0; nulls in doc_id, source and lang are values
    like any other.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text).alias("text_crc32"),
        hashed(F.col("source")).alias("source_"),
        hashed(F.col("lang")).alias("lang_"),
    ).withColumn("size_", magnitude(F.col("size")))
    dimensions = [F.col("source_"), F.col("lang_"), F.col("size_")]
    return hilbert_shards(rows, dimensions, ["doc_id", "text_crc32"], shards).drop(
        "source_", "lang_", "size_"
    )
