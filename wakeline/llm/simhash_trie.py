"""Near-duplicates by SimHash fingerprints and a binary trie self-join.

The sorted fingerprints are the leaves of a binary trie. Two subtrees are walked
down together with the number of bits in which their prefixes differ; a pair of
nodes is dropped as soon as that number exceeds the budget. The trie is cut into
subtrees of bounded size; a task walks one of them against itself and the later
ones whose prefixes are near enough.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wakeline.llm.common import given_back, settle
from wakeline.llm.components import connected, local_components

BITS = 64
BUDGET = 2
#: Shingles whose bits are counted at a time.
CHUNK = 1 << 16
#: Fingerprints of a subtree: at least so many, about so many subtrees where that is
#: less than the most, and at most so many however many subtrees it takes.
LEAST_LEAF, LEAVES, MOST_LEAF = 256, 4096, 1 << 15
#: Node pairs of a walk held at a time, and the pair size compared leaf by leaf.
FRONTIER, DIRECT = 1 << 18, 16


def fingerprint(text: str | None, words_each: int = 3, seed: int = 42) -> int:
    """Bits set in over half of the XXH64 of the word shingles; 0 without words.

    A-Z count as a-z; words are split at ASCII white space; a text of fewer words
    is one shingle.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < words_each:
        shingles = iter([b" ".join(words)])
        total = 1
    else:
        shingles = map(b" ".join, zip(*(islice(words, k, None) for k in range(words_each))))
        total = len(words) - words_each + 1
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, dtype=np.int64)
    while part := [digest(s, seed) for s in islice(shingles, CHUNK)]:
        bytes_ = np.array(part, dtype=">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(bytes_, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > total).tobytes(), "big")


def fingerprints(documents: DataFrame, *carried: Column) -> DataFrame:
    """``(doc_id, fp)`` and the carried columns; fp is the fingerprint as a signed long."""
    frame = documents.select(
        F.col("text").cast("string").alias("text"), F.col("doc_id").cast("bigint").alias("doc_id"), *carried
    )
    kept = frame.schema.fields[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(text.as_py()) for text in batch.column(0)]
            signed = pa.array(np.array(found, dtype=np.uint64).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], signed], [*batch.schema.names[1:], "fp"]
            )

    schema = T.StructType([*kept, T.StructField("fp", T.LongType())])
    return frame.mapInArrow(lambda batches: given_back(run(batches)), schema)


def walk(
    own: np.ndarray, other: np.ndarray, budget: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of two sorted uint64 arrays that differ in at most ``budget`` bits."""
    if not len(own) or not len(other):
        return
    stack = [(0, np.array([[0, len(own), 0, len(other), 0]], dtype=np.int64))]
    while stack:
        depth, nodes = stack.pop()
        if len(nodes) > FRONTIER:
            half = len(nodes) // 2
            stack += [(depth, nodes[:half]), (depth, nodes[half:])]
            continue
        a0, a1, b0, b1, differ = nodes.T
        small = ((a1 - a0) * (b1 - b0) <= DIRECT) | (depth == BITS)
        if small.any():
            widths = (b1 - b0)[small]
            sizes = (a1 - a0)[small] * widths
            which = np.repeat(np.arange(len(sizes)), sizes)
            at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            left = a0[small][which] + at // widths[which]
            right = b0[small][which] + at % widths[which]
            near = np.bitwise_count(own[left] ^ other[right]) <= budget
            if near.any():
                yield left[near], right[near]
            nodes = nodes[~small]
            if not len(nodes):
                continue
            a0, a1, b0, b1, differ = nodes.T
        bit = np.uint64(1 << (BITS - 1 - depth))
        keep = np.uint64(((1 << depth) - 1) << (BITS - depth))
        a_mid = np.clip(np.searchsorted(own, (own[a0] & keep) | bit), a0, a1)
        b_mid = np.clip(np.searchsorted(other, (other[b0] & keep) | bit), b0, b1)
        children = np.concatenate(
            [
                np.stack([a0, a_mid, b0, b_mid, differ], 1),
                np.stack([a_mid, a1, b_mid, b1, differ], 1),
                np.stack([a0, a_mid, b_mid, b1, differ + 1], 1),
                np.stack([a_mid, a1, b0, b_mid, differ + 1], 1),
            ]
        )
        held = (children[:, 1] > children[:, 0]) & (children[:, 3] > children[:, 2])
        children = children[held & (children[:, 4] <= budget)]
        if len(children):
            stack.append((depth + 1, children))


def cut_trie(fps: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint subtrees that hold all of ``fps`` and at most ``most`` each.

    As arrays of first leaf (uint64, sorted) and depth. Counts come from the
    cluster eight bits at a time and only below prefixes that hold too much, so
    what the driver sees grows with the number of subtrees.
    """
    nodes: list[tuple[int, int]] = []
    heavy: list[int] = [0]
    for depth in range(8, BITS + 1, 8):
        prefix = F.shiftrightunsigned("fp", BITS - depth) if depth < BITS else F.col("fp")
        rows = fps
        if depth > 8:
            parents = fps.sparkSession.createDataFrame(
                [(p if p < 1 << 63 else p - (1 << 64),) for p in heavy], "above bigint"
            )
            rows = fps.join(
                F.broadcast(parents), F.shiftrightunsigned("fp", BITS - depth + 8) == F.col("above")
            )
        counts: dict[int, int] = {}
        for r in rows.groupBy(prefix.alias("prefix")).count().collect():
            counts[r["prefix"] % (1 << 64)] = r["count"]
        by_parent: dict[int, dict[int, int]] = {}
        for p, n in counts.items():
            by_parent.setdefault(p >> 8, {})[p & 255] = n
        heavy = []
        for parent, below in by_parent.items():
            grown = np.zeros(257, dtype=np.int64)
            for k, n in below.items():
                grown[k + 1] = n
            grown = np.cumsum(grown)
            open_ = [(0, 8)]
            while open_:
                low, free = open_.pop()
                held = grown[low + (1 << free)] - grown[low]
                if not held:
                    continue
                if held <= most or depth - free == BITS:
                    nodes.append((((parent << 8) | low) << (BITS - depth), depth - free))
                elif free == 0:
                    heavy.append((parent << 8) | low)
                else:
                    half = 1 << (free - 1)
                    open_ += [(low, free - 1), (low + half, free - 1)]
        if not heavy:
            break
    nodes.sort()
    first = np.array([n[0] for n in nodes], dtype=np.uint64)
    return first, np.array([n[1] for n in nodes], dtype=np.int64)


def near_nodes(
    first: np.ndarray, depth: np.ndarray, budget: int, asked: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """For each asked subtree the earlier-or-same subtrees it may link to: offsets and indices."""
    shift = (np.uint64(BITS) - depth.astype(np.uint64)) % np.uint64(BITS)
    mask = np.where(depth == 0, np.uint64(0), (~np.uint64(0) >> shift) << shift)
    offsets, found = [0], []
    for k in asked.tolist():
        both = mask[: k + 1] & mask[k]
        near = np.flatnonzero(np.bitwise_count((first[: k + 1] ^ first[k]) & both) <= budget)
        found.append(near)
        offsets.append(offsets[-1] + len(near))
    return np.array(offsets), np.concatenate(found) if found else np.zeros(0, dtype=np.int64)


def trie_links(fps: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints, as stars: enough for components.

    ``fps(fp)`` has to be distinct and settled. Each subtree goes to its own task
    key and to those of the earlier subtrees it is near to, so a task holds at most
    ``MOST_LEAF`` fingerprints of some hundred subtrees. It emits one link
    per fingerprint at most, to the smallest one that it reaches there, so a
    dense cluster costs rows by its size and not by its pairs. The driver knows the
    subtrees' first leaves, 16 bytes for each.
    """
    total = fps.count()
    first, depth = cut_trie(fps, min(MOST_LEAF, max(LEAST_LEAF, total // LEAVES)))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            own, node = np.unique(np.searchsorted(first, fp, side="right") - 1, return_inverse=True)
            offsets, targets = near_nodes(first, depth, budget, own)
            sizes = offsets[node + 1] - offsets[node]
            which = np.repeat(np.arange(len(fp)), sizes)
            at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            unit = targets[offsets[node][which] + at]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(unit.astype(np.int32)),
                    pa.array(unit == own[node][which]),
                    pa.array(fp[which].view(np.int64)),
                ],
                ["unit", "own", "fp"],
            )

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        order = np.argsort(frame["fp"].to_numpy().view(np.uint64))
        fp = frame["fp"].to_numpy().view(np.uint64)[order]
        own = np.flatnonzero(frame["own"].to_numpy()[order])
        label = np.arange(len(fp))
        for left, right in walk(fp[own], fp, budget):
            left = own[left]
            # Links already within one component say nothing new.
            new = label[left] != label[right]
            if new.any():
                label = local_components(
                    len(fp),
                    np.concatenate([np.arange(len(fp)), left[new]]),
                    np.concatenate([label, right[new]]),
                )
        moved = np.flatnonzero(label != np.arange(len(fp)))
        signed = fp.view(np.int64)
        return pd.DataFrame({"a": signed[moved], "b": signed[label[moved]]})

    return (
        fps.select("fp")
        .mapInArrow(route, "unit int, own boolean, fp bigint")
        .groupBy("unit")
        .applyInPandas(join, "a bigint, b bigint")
    )


def linked(rows: DataFrame, budget: int) -> DataFrame:
    """``(fp, least, root)`` of settled ``rows(doc_id, fp)``: distinct fingerprints and their component."""
    nodes = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected(trie_links(nodes.select("fp"), budget))
    return nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )


def near_groups(documents: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Every row with its fingerprint and component: doc_id, fp, component_id.

    Fingerprints link at ``budget`` differing bits or fewer; component_id is the
    smallest doc_id reachable. Equal fingerprints are one node, so groups of
    copies cost nothing in the join. Null and blank texts share fingerprint 0.
    Repeated rows stay; a null doc_id counts as no id, so a component of such rows
    alone has a null id. An empty table gives an empty result.
    """
    rows = settle(fingerprints(documents))
    named = linked(rows, budget)
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    labelled = named.join(ids, "root").select("fp", "component_id")
    return rows.join(labelled, "fp").select("doc_id", "fp", "component_id")


def keep_one(documents: DataFrame, budget: int = BUDGET) -> DataFrame:
    """One row of each component, with all its columns.

    It is the row of the smallest doc_id (a null one comes last), then of the
    smallest hash of the row's columns (those that can be hashed, so not maps), so
    every run keeps the same one. Repeated rows are copies like any other and go;
    different texts under one doc_id are judged one by one. Texts without words,
    null ones included, are one group. Names of extra columns do not matter. An
    empty table gives an empty result.
    """
    columns = [F.col(f"`{c}`") for c in documents.columns]
    plain = [
        F.col(f"`{f.name}`") for f in documents.schema if "map<" not in f.dataType.simpleString()
    ]
    mark = F.xxhash64(*plain)
    rows = settle(fingerprints(documents, mark.alias("mark")))
    place = F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "mark")
    # Copies share a fingerprint, so a large group is one row before it is joined.
    of_prints = rows.groupBy("fp").agg(F.min(place).alias("place"))
    firsts = (
        of_prints.join(linked(rows, budget).select("fp", "root"), "fp")
        .groupBy("root")
        .agg(F.min("place").alias("place"))
        .select(F.col("place.doc_id").alias("first_id"), F.col("place.mark").alias("first_mark"))
    )
    held = documents.select(
        F.struct(*columns).alias("row"),
        F.col("doc_id").cast("bigint").alias("own_id"),
        mark.alias("own_mark"),
    )
    same = F.col("own_id").eqNullSafe(F.col("first_id")) & (F.col("own_mark") == F.col("first_mark"))
    return (
        held.join(firsts, same, "left_semi")
        .dropDuplicates(["own_id", "own_mark"])
        .select(*[F.col(f"row.`{c}`").alias(c) for c in documents.columns])
    )
