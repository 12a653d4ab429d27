"""Nearest neighbours by a hierarchical k-means tree, best bin first.

A tree of centres is fitted on a bounded sample; every vector is filed in a leaf.
A query walks the tree with a priority queue, nearest centre first, and visits as
many leaves as calibration asks for: the visits are widened until queries with
known neighbours find the wanted share of them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.llm.common import settle

#: Vectors the tree is fitted on, at most; also bounded by SAMPLE_NUMBERS in all.
SAMPLE_ROWS, SAMPLE_NUMBERS = 20_000, 8_000_000
BRANCH, MOST_LEAVES, LEAF_ROWS = 8, 4096, 256
#: Queries whose neighbours are found exactly, and the share that has to be found.
CALIBRATION, RECALL = 64, 0.95
#: Queries that one task scores them for, about.
ASKED_ROWS = 4096
#: Vectors that one task scores: leaves that follow each other, or a part of a large leaf.
CELL_ROWS = 4096


@dataclass
class Tree:
    """Centres per inner node; children are nodes or, below zero, leaves (~leaf)."""

    centres: list[np.ndarray] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    leaves: int = 0

    def file(self, unit: np.ndarray) -> np.ndarray:
        """Leaf of each unit vector: the nearest centre at every step."""
        leaf = np.zeros(len(unit), dtype=np.int32)
        stack = [(0, np.arange(len(unit)))] if self.centres else []
        while stack:
            node, rows = stack.pop()
            near = (unit[rows] @ self.centres[node].T).argmax(axis=1)
            for k, child in enumerate(self.children[node]):
                part = rows[near == k]
                if child < 0:
                    leaf[part] = ~child
                elif len(part):
                    stack.append((child, part))
        return leaf

    def visits(
        self, unit: np.ndarray, most: int, sizes: dict[int, int] | None = None, need: int = 0
    ) -> list[int]:
        """The first ``most`` leaves for one query, best bin first; more until they hold ``need``."""
        if not self.centres:
            return [0]
        queue, order, held = [(-2.0, 0)], [], 0
        while queue and (len(order) < most or held < need):
            _, node = heapq.heappop(queue)
            if node < 0:
                order.append(~node)
                held += sizes.get(~node, 0) if sizes else 0
                continue
            for near, child in zip(self.centres[node] @ unit, self.children[node]):
                heapq.heappush(queue, (-float(near), child))
        return order


def _k_means(unit: np.ndarray, k: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    centres = unit[rng.choice(len(unit), k, replace=False)]
    for _ in range(8):
        near = (unit @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, unit)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 1e-9, sums / np.maximum(norms, 1e-9), centres)
    return centres, (unit @ centres.T).argmax(axis=1)


def grow(sample: np.ndarray, leaf_rows: int) -> Tree:
    """A tree whose leaves hold about ``leaf_rows`` sample vectors; one leaf if that is all."""
    tree, rng = Tree(), np.random.default_rng(11)
    if len(sample) <= max(leaf_rows, BRANCH):
        tree.leaves = 1
        return tree

    def node(rows: np.ndarray) -> int:
        if len(rows) <= leaf_rows or len(rows) < 2 * BRANCH:
            tree.leaves += 1
            return ~(tree.leaves - 1)
        centres, near = _k_means(sample[rows], BRANCH, rng)
        held = [k for k in range(BRANCH) if (near == k).any()]
        if len(held) < 2:
            tree.leaves += 1
            return ~(tree.leaves - 1)
        here = len(tree.centres)
        tree.centres.append(centres[held])
        tree.children.append([])
        tree.children[here] = [node(rows[near == k]) for k in held]
        return here

    node(np.arange(len(sample)))
    return tree


def usable(vectors: DataFrame) -> DataFrame:
    """``(row, vec_id, v)``: every row whose vector is there, finite and not zero, as doubles.

    Rows that are null or hold null or non-finite components take no part, nor do
    rows without an id. ``row`` numbers the rows, so that repeated ids stay apart.
    """
    v = F.col("embedding").cast("array<double>")
    rows = settle(
        vectors.select(F.col("vec_id").cast("bigint"), v.alias("v"))
        .filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
        .filter(F.coalesce(F.forall("v", lambda x: x.isNotNull()), F.lit(False)))
        .filter(F.forall("v", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))))
        .filter(F.exists("v", lambda x: x != 0))
    )
    # The rows of a checkpoint keep their places, so the numbers stay when a task is done again.
    return rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v")


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """``(number, vec_id, v, held)``: each vector once, with its smallest id and its first rows.

    ``held`` has the ``k + 1`` rows of the smallest ids: no query needs more of equal
    vectors, one of which may be its own row. The limit holds in every task before
    rows move, so copies of one vector cost little. ``number`` is the first row's.
    """
    copies = Window.partitionBy("v").orderBy("vec_id", "row")
    held = (
        rows.withColumn("nth", F.row_number().over(copies))
        .filter(F.col("nth") <= k + 1)
        .groupBy("v")
        .agg(F.array_sort(F.collect_list(F.struct("vec_id", "row"))).alias("held"))
    )
    return held.select(F.expr("held[0].row as number"), F.expr("held[0].vec_id as vec_id"), "v", "held")


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64, copy=False)


def normal(v: np.ndarray) -> np.ndarray:
    """Unit vectors; scaled by the largest component first, so no square overflows."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each pair of rows, the same for equal pairs wherever they stand."""
    a = a / np.abs(a).max(axis=1, keepdims=True)
    b = b / np.abs(b).max(axis=1, keepdims=True)
    norms = np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1))
    return (a * b).sum(axis=1) / norms


def best_of(
    asked: np.ndarray,
    q: np.ndarray,
    numbers: np.ndarray,
    ids: np.ndarray,
    v: np.ndarray,
    k: int,
    open_: np.ndarray | None = None,
    group: np.ndarray | None = None,
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its ``k`` nearest of a block: largest cosine, then smaller id, then number.

    With ``open_`` and ``group`` a query sees only vectors of groups that are open to
    it. A matrix product finds who is in reach of the k-th place; only they are
    scored pair by pair. Gives the query, places in the block, and scores.
    """
    unit_q, unit_v = normal(q), normal(v)
    for start in range(0, len(q), 256):
        rough = unit_q[start : start + 256] @ unit_v.T
        if open_ is not None:
            rough[~open_[start : start + 256][:, group]] = -np.inf
        for row, query, own in zip(rough, q[start : start + 256], asked[start : start + 256]):
            edge = np.partition(row, -k)[-k] if len(row) > k else -2.0
            close = np.flatnonzero((row >= edge - 1e-9) & (row > -np.inf))
            scores = cosine(np.broadcast_to(query, (len(close), len(query))), v[close])
            first = np.lexsort((numbers[close], ids[close], -scores))[:k]
            yield int(own), close[first], scores[first]


FOUND = "query bigint, number bigint, vec_id bigint, score double"


def _frame(
    found: list[tuple[int, np.ndarray, np.ndarray]], numbers: np.ndarray, ids: np.ndarray
) -> pd.DataFrame:
    places = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
    return pd.DataFrame(
        {
            "query": np.repeat([f[0] for f in found], [len(f[1]) for f in found]).astype(np.int64),
            "number": numbers[places],
            "vec_id": ids[places],
            "score": np.concatenate([f[2] for f in found]) if found else np.zeros(0),
        }
    )


def ranked(found: DataFrame, k: int) -> DataFrame:
    nearest = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "number")
    return found.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k)


def exact(vectors: DataFrame, asked: np.ndarray, q: np.ndarray, k: int) -> DataFrame:
    """Brute force for a bounded set of queries, in blocks over all vectors."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                numbers, ids = frame["number"].to_numpy(), frame["vec_id"].to_numpy()
                yield _frame(list(best_of(asked, q, numbers, ids, matrix(frame["v"]), k)), numbers, ids)

    return ranked(vectors.select("number", "vec_id", "v").mapInPandas(run, FOUND), k)


@dataclass
class Index:
    """A fitted tree, every vector with its leaf, the leaves' sizes, and the visits needed."""

    tree: Tree
    filed: DataFrame
    sizes: dict[int, int]
    visits: int
    recall: float


def build(vectors: DataFrame, queries: DataFrame, k: int, recall: float = RECALL) -> Index:
    """Fit, file all of ``vectors(number, vec_id, v)`` and calibrate. None of it may be empty.

    Vectors are distinct and of one length. Calibration asks ``queries`` for their
    ``k`` nearest, themselves included.
    """
    count, dims = vectors.count(), len(vectors.first()["v"])
    rows = max(BRANCH, min(SAMPLE_ROWS, SAMPLE_NUMBERS // dims))
    by_hash = [F.xxhash64("v"), F.col("number")]
    sample = normal(matrix(vectors.select("number", "v").orderBy(*by_hash).limit(rows).toPandas()["v"]))
    leaves = min(MOST_LEAVES, max(1, count // LEAF_ROWS))
    tree = grow(sample, max(4, len(sample) // leaves))

    def file(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            if len(frame):
                frame["leaf"] = tree.file(normal(matrix(frame["v"])))
            else:
                frame["leaf"] = np.zeros(0, np.int32)
            yield frame

    kept = vectors.select("number", "vec_id", "v")
    filed = settle(kept.mapInPandas(file, "number bigint, vec_id bigint, v array<double>, leaf int"))
    sizes = {r["leaf"]: r["count"] for r in filed.groupBy("leaf").count().collect()}
    known = queries.select("number", "v").orderBy(*by_hash).limit(CALIBRATION).toPandas()
    if not len(known):
        return Index(tree, filed, sizes, 1, 1.0)
    asked, q = np.arange(len(known)), matrix(known["v"])
    truth = exact(filed, asked, q, k)
    homes = truth.join(filed.select("number", "leaf"), "number").select("query", "leaf").collect()
    order = [{leaf: at for at, leaf in enumerate(tree.visits(u, tree.leaves))} for u in normal(q)]
    needed = np.sort([order[r["query"]][r["leaf"]] + 1 for r in homes])
    visits = int(needed[int(np.ceil(recall * len(needed))) - 1]) if len(needed) else 1
    found = float((needed <= visits).mean()) if len(needed) else 1.0
    return Index(tree, filed, sizes, visits, found)


def cells_of(sizes: dict[int, int], leaves: int) -> dict[int, tuple[int, int]]:
    """First cell and number of cells of each leaf: small leaves share one, large ones have several."""
    cells, at, held = {}, 0, 0
    for leaf in range(leaves):
        n = sizes.get(leaf, 0)
        if n > CELL_ROWS:
            at, held = at + (held > 0), 0
            cells[leaf] = (at, -(-n // CELL_ROWS))
            at += cells[leaf][1]
        elif n:
            if held + n > CELL_ROWS:
                at, held = at + 1, 0
            cells[leaf] = (at, 1)
            held += n
    return cells


def search(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest vectors found for each of ``queries(query, v)``: query, rank, number, score.

    A query meets the leaves that it visits in cells of bounded size, so a leaf may
    hold any share of the vectors and a cell gives ``k`` rows for a query at most. The
    queries of a busy cell are dealt to parts, each with the cell's vectors, so a
    task holds at most ``CELL_ROWS`` vectors and about ``ASKED_ROWS`` queries.
    Every visited vector is scored; nothing is cut before the last rank.
    """
    tree, visits, sizes = index.tree, index.visits, index.sizes
    cells = cells_of(sizes, tree.leaves)

    def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), 64):
                part = frame.iloc[start : start + 64]
                row, cell, leaves = [], [], []
                for n, u in enumerate(normal(matrix(part["v"]))):
                    seen: dict[int, list[int]] = {}
                    for leaf in tree.visits(u, visits, sizes, k):
                        first, count = cells.get(leaf, (0, 0))
                        for c in range(first, first + count):
                            seen.setdefault(c, []).append(leaf)
                    row += [n] * len(seen)
                    cell += seen
                    leaves += seen.values()
                out = part.iloc[row].copy()
                out["cell"], out["leaves"] = np.array(cell, np.int32), leaves
                yield out

    def score(members: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        numbers, ids = members["number"].to_numpy(), members["vec_id"].to_numpy()
        if not len(members) or not len(asked):
            return _frame([], numbers, ids)
        names, group = np.unique(members["leaf"].to_numpy(), return_inverse=True)
        open_ = np.stack([np.isin(names, leaves) for leaves in asked["leaves"]])
        q, v = matrix(asked["v"]), matrix(members["v"])
        best = best_of(asked["query"].to_numpy(), q, numbers, ids, v, k, open_, group)
        return _frame(list(best), numbers, ids)

    spark = index.filed.sparkSession
    asked = settle(queries.mapInPandas(route, "query bigint, v array<double>, cell int, leaves array<int>"))
    # One number per cell, of which there is one for some CELL_ROWS vectors.
    busy = {r["cell"]: -(-r["count"] // ASKED_ROWS) for r in asked.groupBy("cell").count().collect()}

    def parts() -> DataFrame:
        return spark.createDataFrame(sorted(busy.items()) or [(-1, 1)], "cell int, parts bigint")

    # At most one row per leaf, and MOST_LEAVES bounds those.
    homes = spark.createDataFrame(
        [(leaf, first, count) for leaf, (first, count) in cells.items()],
        "leaf int, first_cell int, cells int",
    )
    members = (
        index.filed.join(F.broadcast(homes), "leaf")
        .select(
            "number",
            "vec_id",
            "v",
            "leaf",
            (F.col("first_cell") + F.pmod(F.xxhash64("v"), F.col("cells"))).cast("int").alias("cell"),
        )
        .join(parts(), "cell")
        .withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    )
    dealt = asked.join(parts(), "cell").withColumn("part", F.pmod(F.xxhash64("query"), F.col("parts")))
    found = members.groupBy("cell", "part").cogroup(dealt.groupBy("cell", "part")).applyInPandas(score, FOUND)
    return ranked(found, k)


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, recall: float = RECALL) -> DataFrame:
    """The ``k`` nearest neighbours of each query row among all other rows of its length.

    ``vectors`` has vec_id and embedding; ``is_query`` is a condition on vec_id. See
    ``usable`` for the rows that take part. Every row is a candidate for all others,
    also for those under the same id or with the same vector, and a query row
    gets results of its own. Ties go to the smaller vec_id. With fewer candidates than
    ``k`` all are returned; without vectors the result is empty. Vectors of each
    length have an index of their own.
    """
    rows = usable(vectors)
    found = None
    for r in rows.groupBy(F.size("v").alias("n")).count().orderBy("n").collect():
        part = _nearest_of_length(rows.filter(F.size("v") == r["n"]), is_query, k, recall)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.sparkSession.createDataFrame(
            [], "query_id bigint, rank int, vec_id bigint, score double"
        )
    return found


def _nearest_of_length(rows: DataFrame, is_query: Column, k: int, recall: float) -> DataFrame:
    """Equal vectors are one in the search and one query; rows come back at the end."""
    vectors = settle(distinct_vectors(rows, k))
    asked = rows.filter(is_query)
    wanted = vectors.join(asked.select("v").distinct(), "v", "left_semi")
    # A query's own row may be among what is found, so one more is searched for.
    index = build(vectors, wanted, k + 1, recall)
    near = search(index, wanted.select(F.col("number").alias("query"), "v"), k + 1)
    others = near.join(vectors.select("number", "held"), "number").select(
        "query", "score", F.explode("held").alias("other")
    )
    owners = asked.join(vectors.select(F.col("number").alias("query"), "v"), "v").select(
        "query", F.col("vec_id").alias("query_id"), F.col("row").alias("own")
    )
    first = Window.partitionBy("own").orderBy(F.desc("score"), "other.vec_id", "other.row")
    return (
        owners.join(others, "query")
        .filter(F.col("own") != F.col("other.row"))
        .withColumn("rank", F.row_number().over(first))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", F.col("other.vec_id").alias("vec_id"), "score")
    )
