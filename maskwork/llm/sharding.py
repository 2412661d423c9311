"""Sharding by a hierarchical weighted hash tree.

Every document descends region, rack and shard levels. At a node each child draws an exponential
variate -ln(u)/weight from the hash of (child, id), its weight being the sum of the weights below
it, and the least draw is taken: children are chosen in proportion to their weights, with as many
draws as the nodes on the way have children, not one for every shard.

When weights change, a child whose weight is the same draws as before. A document therefore leaves
a node only for a child that got heavier, or because its own got lighter: movement is confined to
subtrees whose weights change, and inside one whose own children keep their weights nothing moves.

Law `key`: the document's id and the shard count alone decide. Shards up to BASE fill racks and
regions; every further shard is a region of its own, so that one more shard leaves all other
weights as they are and takes rows only into itself.

Slots number the documents of a shard without gaps, in hash order, from two-level totals.

Defined results: a null id hashes as the empty string; null text has size 16 and the CRC of no
bytes; very long texts count whole; equal draws (2**-48 likely) go to the smaller number; repeated
rows get slots of their own; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucket_digits, cut, hash_order, with_running_total

BASE = 40


@dataclass(frozen=True)
class Shard:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def tree(shards: int, racks_per_region: int = 4, shards_per_rack: int = 5, base: int = BASE) -> list[Shard]:
    """Shards 0 to shards-1: the first `base` fill racks and regions in order, each other one is alone in its region."""
    out = [Shard(i // (shards_per_rack * racks_per_region), i // shards_per_rack, i) for i in range(min(shards, base))]
    for i in range(base, shards):
        out.append(Shard(out[-1].region + 1, out[-1].rack + 1, i))
    return out


def draw(name: Column, id_text: Column, weight: Column) -> Column:
    """Exponential draw of one child: 48 bits of md5("name/id") as u in (0, 1)."""
    bits = F.conv(F.substring(F.md5(F.concat(name, F.lit("/"), id_text).cast("binary")), 1, 12), 16, 10).cast("double")
    return -F.log((bits + 0.5) / float(1 << 48)) / weight


def child(level: str, id_text: Column, children: dict[int, dict[int, float]], parent: Column | None) -> Column:
    """The child of `parent` with the least draw. children: by parent, the weight of every child.

    Only the parent's own children draw, whatever the size of the level.
    """
    places = {p: k for k, p in enumerate(children)}
    lists = F.array(*(F.array(*(F.struct(F.lit(c).alias("child"), F.lit(float(w)).alias("weight")) for c, w in own.items())) for own in children.values()))
    at = F.lit(1) if parent is None else F.element_at(F.array(*(F.lit(places.get(p, -1) + 1) for p in range(max(places) + 1))), parent + 1)
    drawn: Callable[[Column], Column] = lambda c: F.struct(draw(F.concat(F.lit(level), c["child"].cast("string")), id_text, c["weight"]), c["child"])
    return F.array_min(F.transform(F.element_at(lists, at), drawn))["child"]


def levels(leaves: list[Shard]) -> list[dict[int, dict[int, float]]]:
    """For each level, by parent, the weights of its children: sums of the shards' below."""
    out: list[dict[int, dict[int, float]]] = [{}, {}, {}]
    for s in leaves:
        if s.weight > 0:
            for own, (parent, node) in zip(out, [(0, s.region), (s.region, s.rack), (s.rack, s.shard)]):
                weights = own.setdefault(parent, {})
                weights[node] = weights.get(node, 0.0) + s.weight
    return out


def descend(d: DataFrame, leaves: list[Shard], out: str) -> DataFrame:
    """Add out, the shard of column _id, level by level."""
    node = None
    for k, (name, children) in enumerate(zip(("region", "rack", "shard"), levels(leaves))):
        d = d.withColumn(step := out if name == "shard" else f"_{out}_{name}", child(name, F.col("_id"), children, node))
        node = F.col(step)
    return d


def assign(df: DataFrame, leaves: list[Shard], grown: list[Shard] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")
    d = df.select(F.col(f"`{id_col}`").alias("_doc"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    d = d.withColumn("_id", F.coalesce(F.col("_doc").cast("string"), F.lit("")))
    d = descend(d, leaves, "shard")
    d = descend(d, grown, "grown_shard") if grown else d.withColumn("grown_shard", F.lit(None).cast("int"))
    d = cut(d.select("_doc", "size", "text_crc32", "shard", "grown_shard", hash_order(F.col("_doc")).alias("_order")))
    d = d.withColumn("_bucket", F.substring("_order", 1, bucket_digits(d.count())))
    d = with_running_total(d, "shard", ["_order", "size", "text_crc32"], "_bucket", F.lit(1), "slot")
    return d.select(F.col("_doc").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long"), "grown_shard")
