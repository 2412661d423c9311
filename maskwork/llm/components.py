"""Connected components of an edge table by alternating large-star and small-star rounds.

Edges stay in DataFrames; nothing is collected. Before each round the edges of every partition
are contracted by a local union-find to a forest, which shortens long chains and thins hubs.
Each round's edges are checkpointed, so a lost executor costs one round at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

SLICE = 1 << 20


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for every node that isn't its root; roots are the smallest nodes."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        while not np.array_equal(new, again := new[new]):
            new = again
        if np.array_equal(new, label):
            break
        label = new
    (moved,) = np.nonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0
    for b in batches:
        held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
        n += b.num_rows
        if n > SLICE:
            held = [forest(*map(np.concatenate, zip(*held)))]
            if (n := len(held[0][0])) > SLICE // 2:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], names=["u", "v"])
                held, n = [], 0
    if n:
        u, v = forest(*map(np.concatenate, zip(*held)))
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges, which has two long columns; smallest node names the component."""
    a, b = edges.columns
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").mapInArrow(_contract, "u long, v long")
    e, mark = cut(e.distinct()), None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark or not now[0]:
            break
        mark = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(least.filter("m < u").select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(down.select("u", F.col("m").alias("v"))).filter("u <> v").mapInArrow(_contract, "u long, v long").distinct())
    least = e.groupBy("u").agg(F.min("v").alias("component"))
    roots = least.select(F.col("component").alias("node")).distinct()
    return cut(least.select(F.col("u").alias("node"), "component").unionByName(roots.select("node", F.col("node").alias("component"))))
