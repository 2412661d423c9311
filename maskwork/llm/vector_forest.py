"""Near-duplicate vectors by a forest of random-projection trees with spill overlap.

Equal vectors of a label are one node with a count. TREES trees are fitted on a bounded sample:
every split projects on a random direction and cuts at the sample's median; what lies within
SPILL link distances of it goes to both children. The projections of two linked vectors differ
by a normal variate of at most a link distance, however deep the node and however tight its
group, so few pairs are parted at a level. A node whose children would cost as much to compare
as itself (a tight group) is not split. All vectors are routed to their leaves; inside each (label, tree, leaf) vectors are compared by matrix products
in double precision. A pair that meets in several leaves is counted in the first of them only,
which both sides can tell from their leaf lists, so that counts and a union-find forest leave
each leaf, never pairs. A leaf with more than BLOCK vectors is compared in blocks: an exact way,
with each task bounded.

Fitted sample: at most SAMPLE_PER_LEAF vectors a leaf and about SAMPLE_BYTES, leaves of about
LEAF_ROWS rows, at most MAX_LEAVES leaves. Every vector is routed and compared. Tests measure recall by brute force.

Defined results: null, zero, empty and non-finite vectors, vectors with null components, and
rows with null label or id link with nothing (a similarity of just the threshold links) and are components of their own; vectors of
different lengths are never compared (more than MAX_WIDTHS lengths are an error); repeated rows are copies with similarity 1; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut
from .components import components, forest

TREES = 6
SPILL = 0.75
LEAF_ROWS = 4096
SAMPLE_PER_LEAF = 64
MAX_LEAVES = 4096
MAX_WIDTHS = 1000
#: Bytes of all samples together, in doubles: what the driver holds, whatever the vectors' length.
SAMPLE_BYTES = 128 << 20
BLOCK = 4096


def reach(threshold: float) -> float:
    """Half the width of the band that goes to both children; links are at most sqrt(2 - 2 threshold) apart."""
    return SPILL * float(np.sqrt(max(0.0, 2 - 2 * threshold)))


def fit_tree(sample: np.ndarray, depth: int, seed: int, band: float) -> dict[int, tuple[float, float]]:
    """Low and high cut of every node that is split; node 1 is the root, 2n and 2n + 1 the children of n.

    Depth first: what is held at a time is one path, less than three times the sample.
    """
    cuts, todo = {}, [(1, 0, sample)]
    while todo:
        node, level, rows = todo.pop()
        if level == depth or not len(rows):
            continue
        p = rows @ direction(seed, node, sample.shape[1])
        lo, hi = np.median(p) - band, np.median(p) + band
        left, right = p <= hi, p >= lo
        if left.mean() ** 2 + right.mean() ** 2 >= 1:
            continue
        cuts[node] = (float(lo), float(hi))
        todo += [(2 * node, level + 1, rows[left]), (2 * node + 1, level + 1, rows[right])]
    return cuts


def direction(seed: int, node: int, width: int) -> np.ndarray:
    return np.random.default_rng([seed, node, width]).standard_normal(width)


def leaves(rows: np.ndarray, cuts: dict[int, tuple[float, float]], depth: int, seed: int) -> list[list[int]]:
    """The leaves of every row, ascending."""
    at, ends = {1: np.arange(len(rows))}, {}
    for _ in range(depth):
        below = {}
        for node, i in at.items():
            if node not in cuts:
                ends[node] = i
                continue
            lo, hi = cuts[node]
            p = rows[i] @ direction(seed, node, rows.shape[1])
            below[2 * node], below[2 * node + 1] = i[p <= hi], i[p >= lo]
        at = below
    ends |= at
    out: list[list[int]] = [[] for _ in rows]
    for node, i in sorted(ends.items()):
        for k in i.tolist():
            out[k].append(node)
    return out


def unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    v /= np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _route(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    """A row for every node and leaf, with the leaf lists of all trees."""
    depth, width, trees = model.value
    for whole in batches:
        for s in range(0, whole.num_rows, 2048):
            b = whole.slice(s, 2048)
            v = b.column("v")
            sizes = np.diff(v.offsets.to_numpy())
            rows = np.zeros((b.num_rows, width))
            fits = sizes == width
            flat = v.flatten().to_numpy(zero_copy_only=False)
            starts = v.offsets.to_numpy()[:-1] - v.offsets.to_numpy()[0]
            if fits.any():
                rows[fits] = unit(flat[starts[fits][:, None] + np.arange(width)])
            found = [leaves(rows, cuts, depth, t) for t, cuts in enumerate(trees)]
            lists = [[x[i] for x in found] for i in range(b.num_rows)]
            take, tree, leaf = [], [], []
            for i, own in enumerate(lists):
                for t, at in enumerate(own):
                    for x in at:
                        take.append(i), tree.append(t), leaf.append(x)
            got = b.take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*(got.column(c) for c in ("node", "label", "n", "v")), pa.array(tree, pa.int32()), pa.array(leaf, pa.int32()), pa.array([lists[i] for i in take], pa.list_(pa.list_(pa.int32())))],
                names=["node", "label", "n", "v", "tree", "leaf", "lists"],
            )


def _compare(table: pa.Table, limit: float) -> pa.Table:
    """Of one block pair of one leaf: node, links counted here, and the root of its links here."""
    out = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])
    t = table.combine_chunks()
    node, n, tree, leaf = (t.column(c).to_numpy() for c in ("node", "n", "tree", "leaf"))
    block, x, y = (t.column(c).to_numpy() for c in ("block", "x", "y"))
    now, here = int(tree[0]), int(leaf[0])
    vectors = unit(np.stack(t.column("v").to_numpy(zero_copy_only=False)))
    lists = t.column("lists").to_pylist()
    padded = []
    for k in range(now + 1):
        w = max(len(own[k]) for own in lists)
        padded.append(np.array([own[k] + [0] * (w - len(own[k])) for own in lists]))
    first, second = np.flatnonzero(block == x), np.flatnonzero(block == y)
    links, tops, bottoms = np.zeros(len(node), np.int64), [], []
    for i in range(0, len(first), 512):
        f = first[i : i + 512]
        r, c = np.nonzero(vectors[f] @ vectors[second].T >= limit)
        p, q = f[r], second[c]
        once = p < q if x[0] == y[0] else node[p] != node[q]
        p, q = p[once], q[once]
        if not len(p):
            continue
        a, b = forest(node[p], node[q])
        tops.append(a), bottoms.append(b)
        for k, own in enumerate(padded):  # pairs that met before, in an earlier tree or leaf, are not counted again
            met = np.zeros(len(p), bool)
            for u in range(own.shape[1]):
                for w in range(own.shape[1]):
                    same = (own[p, u] == own[q, w]) & (own[p, u] > 0)
                    met |= same & (own[p, u] < here) if k == now else same
            p, q = p[~met], q[~met]
            if not len(p):
                break
        np.add.at(links, p, n[q])
        np.add.at(links, q, n[p])
    if tops:
        a, b = forest(np.concatenate(tops), np.concatenate(bottoms))
        root = dict(zip(a.tolist(), b.tolist()))
    else:
        root = {}
    keep = [i for i in range(len(node)) if links[i] or int(node[i]) in root]
    return pa.table([node[keep], links[keep], np.array([root.get(int(node[i]), int(node[i])) for i in keep], np.int64)], schema=out)


def link(df: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", trees: int = TREES, leaf_rows: int = LEAF_ROWS, block: int = BLOCK) -> DataFrame:
    """One row per row of df: id, n_links, component_id, kept."""
    spark = bounded_batches(df).sparkSession
    v = F.col(vector_col).cast("array<double>")
    good = F.coalesce(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = df.select(F.col(id_col).alias("_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"), good.alias("good"))
    groups = rows.filter("good").groupBy("label", "v").agg(F.min("_id").alias("low"), F.count("*").alias("n"))
    nodes = cut(groups.withColumn("node", F.monotonically_increasing_id()))
    sizes = nodes.groupBy(F.size("v").alias("width")).count().limit(MAX_WIDTHS + 1).collect()
    if len(sizes) > MAX_WIDTHS:
        raise ValueError(f"more than {MAX_WIDTHS} lengths of vectors")
    parts = []
    for width, count in sizes:
        depth = min(MAX_LEAVES.bit_length() - 1, max(0, int(np.ceil(np.log2(count / leaf_rows)))))
        share = min(1.0, SAMPLE_PER_LEAF * (1 << depth) / count, SAMPLE_BYTES / (8 * width * len(sizes)) / count)
        own = nodes.filter(F.size("v") == width)
        picked = own.filter(F.pmod(F.xxhash64("node"), F.lit(1 << 20)) < share * (1 << 20)).select("v").toArrow() if depth else None
        sample = unit(np.stack(picked.column("v").to_numpy())) if depth and picked.num_rows else np.zeros((0, width))
        fitted = [fit_tree(sample, depth, t, reach(threshold)) for t in range(trees if depth else 1)]
        model = spark.sparkContext.broadcast((depth, width, fitted))  # two numbers for each of at most MAX_LEAVES nodes a tree
        label = nodes.schema["label"].dataType.simpleString()
        kind = nodes.schema["v"].dataType.simpleString()
        parts.append(own.select("node", "label", "n", "v").mapInArrow(partial(_route, model=model), f"node long, label {label}, n long, v {kind}, tree int, leaf int, lists array<array<int>>").withColumn("width", F.lit(width)))
    if parts:
        routed = parts[0]
        for p in parts[1:]:
            routed = routed.unionByName(p)
        where = ["label", "width", "tree", "leaf"]
        counts = cut(routed.groupBy(*where).agg(F.count("*").alias("rows")).filter(F.col("rows") > block))
        blocks = F.coalesce(F.ceil(F.col("rows") / block), F.lit(1)).cast("int")
        placed = routed.join(F.broadcast(counts), where, "left") if not counts.isEmpty() and counts.count() < 20_000 else routed.join(counts, where, "left")
        placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        placed = placed.withColumn("x", F.least("block", "other")).withColumn("y", F.greatest("block", "other")).drop("rows", "other")
        run = lambda table: _compare(table, threshold)
        found = cut(placed.groupBy(*where, "x", "y").applyInArrow(run, "node long, links long, root long"))
    else:
        found = spark.createDataFrame([], "node long, links long, root long")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    comps = components(found.filter("node <> root").select("node", "root"))
    known = nodes.join(links, "node", "left").join(comps, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
    known = cut(known)
    names = known.groupBy("comp").agg(F.min("low").alias("component_id"))
    known = cut(known.join(names, "comp").select("label", "v", "n", "links", "component_id"))
    out = rows.join(known.withColumnsRenamed({"label": "_l", "v": "_v"}), F.col("good") & (F.col("label") == F.col("_l")) & (F.col("v") == F.col("_v")), "left")
    component = F.coalesce("component_id", "_id")
    return out.select(F.col("_id").alias(id_col), F.when(F.col("n").isNull(), F.lit(0).cast("long")).otherwise(F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("_id") == component, F.lit(True)).alias("kept"))

