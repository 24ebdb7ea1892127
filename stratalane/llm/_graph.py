"""Connected components by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import stash


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars (node, smallest node of its component), without the centres, of one batch of links."""
    if not len(u):
        return u, v
    nodes, codes = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = codes[: len(u)], codes[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        while True:
            hop = new[new]
            if (hop == new).all():
                break
            new = hop
        if (new == label).all():
            break
        label = new
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]


#: So many links, 16 bytes each, are solved in one task; each round over more of them costs the driver five jobs.
AT_ONCE = 1 << 19


def _solved(batches: Iterator) -> Iterator:
    import pyarrow as pa

    parts = [forest(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches]
    u, v = forest(*(np.concatenate([p[k] for p in parts]) for k in (0, 1))) if parts else (np.zeros(0, np.int64),) * 2
    yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """(u, v) links of longs to (node, root): root is the smallest node that can be reached.

    Nodes without a link don't appear. Each round is written to the shared folder; hubs are met by
    pre-aggregated minima, so that no task ever holds the neighbours of a node together. Up to AT_ONCE
    links are solved by one task instead, whatever their shape.
    """
    low, high = F.least("u", "v"), F.greatest("u", "v")
    edges = stash(edges.where("u <> v").select(high.alias("u"), low.alias("v")).distinct(), "links")
    before = None
    while True:
        state = edges.select(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before or not state[0]:
            break
        before = state
        if state[0] <= AT_ONCE:
            edges = stash(edges.coalesce(1).mapInArrow(_solved, "u long, v long"), "links")
            break
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stash(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stash(large, "large")
        least = stash(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        edges = stash(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "links")
    nodes = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return nodes.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
