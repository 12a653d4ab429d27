"""Connected components by smallest reachable node."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm.common import settle


def local_components(size: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each of ``size`` nodes, for links within one task."""
    label = np.arange(size)
    while len(left):
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, label[left], low)
        np.minimum.at(label, label[right], low)
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        label = label[label]
        if (label == before).all():
            break
        open_ = label[left] != label[right]
        if not open_.any():
            done = label[label]
            while (done != label).any():
                label, done = done, done[done]
            break
    return label


def connected(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``links(a, b)``; root is the smallest reachable.

    Each round gives every node the smallest label among its neighbours' and then
    the label of that label, so long chains halve. Minima are aggregated before
    the shuffle and the joins on a busy label are ones that adaptive execution
    splits. Every round is checkpointed; it ends when no label changed.
    """
    both = settle(
        links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).filter("a <> b").distinct()
    )
    labels = settle(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select(
            "node", F.least("node", "near").alias("root")
        )
    )
    for _ in range(rounds):
        near = (
            both.join(labels, both["b"] == labels["node"])
            .groupBy("a")
            .agg(F.min("root").alias("near"))
        )
        hooked = labels.join(near, labels["node"] == near["a"]).select(
            "node", F.col("root").alias("was"), F.least("root", "near").alias("root")
        )
        up = labels.select(F.col("node").alias("up_node"), F.col("root").alias("up_root"))
        moved = settle(
            hooked.join(up, hooked["root"] == up["up_node"], "left").select(
                "node",
                "was",
                F.least("root", F.coalesce("up_root", "root")).alias("root"),
            )
        )
        labels = moved.select("node", "root")
        if not moved.filter("root <> was").limit(1).count():
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")
