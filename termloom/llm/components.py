"""Connected components of links, by contraction."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import Cuts

#: Links that one task joins; more are contracted over the cluster until no more than that are left.
LOCAL = 1 << 20


def joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some links, and of each the smallest node of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        high, low = np.maximum(label[u], label[v]), np.minimum(label[u], label[v])
        open_ = high != low
        if not open_.any():
            return nodes, nodes[label]
        np.minimum.at(label, high[open_], low[open_])
        while (label != (up := label[label])).any():
            label = up


def _in_one_task(edges: DataFrame) -> DataFrame:
    """(node, p) of at most LOCAL links."""
    import pyarrow as pa

    def run(batches):
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if parts:
            nodes, least = joined(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(least)], names=["node", "p"])

    return edges.select("a", "b").repartition(1).mapInArrow(run, "node long, p long")


def _contracted(edges: DataFrame, cuts: Cuts) -> DataFrame:
    """(node, p): every node hung on its smallest neighbour, and these trees flattened by doubling."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    parent = cuts.cut(both.groupBy("a").agg(F.min("b").alias("p")).select(F.col("a").alias("node"), F.least("a", "p").alias("p")))
    while True:
        up = parent.select(F.col("node").alias("p"), F.col("p").alias("q"))
        jumped = cuts.cut(parent.join(up, "p").select("node", F.col("q").alias("p"), (F.col("q") != F.col("p")).alias("moved")))
        moved = not jumped.filter("moved").isEmpty()
        cuts.drop(parent)
        parent = jumped
        if not moved:
            return parent.select("node", "p")


def components(links: DataFrame, cuts: Cuts, local: int = LOCAL) -> DataFrame:
    """(node, label) for each node of `links` (a, b), a written table; the label is the smallest node of its component.

    More than `local` links are contracted, in rounds, to links between roots; what is left is joined in one
    task. All tables stay distributed and are written to the shared folder each step. Links to a node
    may be any number: the sums that find the smallest neighbour are made before the shuffle, and the
    joins read plain tables, whose large partitions Spark can split.
    """
    edges, labels, own = links.select("a", "b").filter(F.col("a") != F.col("b")), None, False
    while n := edges.count():
        root = cuts.cut(_in_one_task(edges)) if n <= local else _contracted(edges, cuts)
        if labels is None:
            labels = cuts.cut(root.select("node", F.col("p").alias("label"))) if n > local else root.withColumnRenamed("p", "label")
        else:
            found = cuts.cut(labels.join(root.select(F.col("node").alias("label"), "p"), "label", "left").select("node", F.coalesce("p", "label").alias("label")))
            cuts.drop(labels)
            labels = found
        if n <= local:
            return labels
        end = lambda c: root.select(F.col("node").alias(c), F.col("p").alias(f"{c}_root"))  # noqa: E731, B023
        rest = cuts.cut(edges.join(end("a"), "a").join(end("b"), "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).filter(F.col("a") != F.col("b")).distinct())
        if own:
            cuts.drop(edges)
        edges, own = rest, True
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
