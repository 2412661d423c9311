"""N-gram Jaccard join by parity sketches.

A document is the set of 64-bit hashes of its word shingles; equal sets are one node, named by a
64-bit signature. For Jaccard similarity T and the smaller set of size a, the symmetric
difference has at most a(1-T)/T members. Sets meet in schemes, one per size band of ratio 1/T:
a set takes part in the scheme of its own band and of the band below, so that any two sets that
may link share a scheme. In a scheme with bound d the hashes are dealt into d + 1 + t segments
and XORed together there: a sketch of 64 parity bits per segment. A token of the symmetric
difference upsets one segment, so the number of differing segments bounds the difference from
below, and linked sets agree on at least t + 1 segments (pigeonhole). Each set drops its t
commonest segments, those with fewest tokens, in one order that all sets share; the rarest
agreeing segment then stays on both sides. So each set publishes d + 1 keys and no link is lost.

Keys travel as packed blobs (40 bits a key; a false meeting costs one verification), one per task and hash partition, and are sorted with numpy there.
Of the sets under one key only a star is verified first, around the set that meets most others
under all its keys (in a group of near copies, their common original): the work is linear in the
group. Verified links make components; then only keys whose sets still lie in different
components are looked at again, pair by pair, under the Hamming bound of a second parity sketch
of about two bits a member, in blocks of bounded size, and what passes is verified. A linked pair
is thus either verified or already connected, and components are exact.

Verification intersects the whole hash sets.

Defined results: null and empty texts have an empty set, no links and themselves as component;
similarity of just num/den links; with fewer words than a shingle, the whole word sequence is the one member; repeated rows are
copies of one node (component_id: smallest id, null ids only where no other is there); very long
texts are hashed whole; an empty table gives no rows; extra columns are ignored by
`link_components` and kept by `keep_one`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import as_bytes, blobs, pieces, release
from .common import bounded_batches, cut, hot_keys, maybe_broadcast, split_join, spread_join, text_key, without_rows
from .components import components

SPARE = 0.25
LEAST_BITS, MOST_BITS = 512, 1 << 14
FLUSH_KEYS = 1 << 20
BLOCK = 512
#: Bytes of text whose keys one task sorts, and the most such parts. Keys of so much text take
#: about 12 MB as they travel and eight times that while they are sorted.
PART_BYTES = 24 << 20
MOST_PARTS = 100_000
TABLE_LIMIT = 300_000
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= TABLE_LIMIT:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = Hashes()


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _A
    h = (h ^ (h >> np.uint64(29))) * _B
    return h ^ (h >> np.uint64(32))


def shingles(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; words are cut at ASCII white space, A-Z lowered."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    size = min(k, len(w))
    h = np.full(len(w) - size + 1, size, np.uint64)
    for i in range(size):
        h = mixed(h + w[i : len(w) - size + 1 + i])
    return np.unique(h)


def signature(s: np.ndarray) -> int:
    return int(np.bitwise_xor.reduce(mixed(s ^ _B)) ^ np.uint64(len(s))) if len(s) else 0


@cache
def bands(num: int, den: int) -> np.ndarray:
    """Upper ends of the size bands for similarity num/den."""
    ends = [1]
    while ends[-1] < 1 << 31:
        ends.append(max(ends[-1] + 1, ends[-1] * den // num))
    return np.array(ends)


def scheme_keys(s: np.ndarray, num: int, den: int) -> np.ndarray:
    """The keys that set s publishes in its two schemes."""
    ends = bands(num, den)
    own = int(np.searchsorted(ends, len(s)))
    out = []
    for j in {own, max(own - 1, 0)}:
        d = int(ends[j]) * (den - num) // num
        spare = int(SPARE * (d + 1)) if d else 0
        n = d + 1 + spare
        at = ((s >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)  # s ascends, and so does at
        starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        parity = np.zeros(n, np.uint64)
        parity[at[starts]] = np.bitwise_xor.reduceat(mixed(s), starts)
        count = np.bincount(at, minlength=n)
        key = mixed(parity ^ mixed(np.arange(n, dtype=np.uint64) + np.uint64(j << 40)))
        if spare:
            rank = (np.minimum(count, 63).astype(np.uint64) << np.uint64(58)) | (key >> np.uint64(6))
            key = key[np.argpartition(rank, spare)[spare:]]
        out.append(key)
    return np.concatenate(out)


def parity_bits(s: np.ndarray) -> bytes:
    """Parity bits: every member flips one, so the Hamming distance is at most the difference.

    The number of bits is a power of two; XORing the halves gives the sketch of half as many.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (2 * len(s) - 1).bit_length()))
    flips = np.bincount((mixed(s ^ _A) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8)).tobytes()


def folded(sketch: bytes, size: int) -> np.ndarray:
    """A sketch XOR-folded to size bytes, as 64-bit words."""
    x = np.frombuffer(sketch, np.uint64)
    while len(x) * 8 > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


OUT = "kind int, id long, key long, a long, b long, part int, blob binary"


def _rows(kind: int, n: int, **columns) -> pa.RecordBatch:
    nulls = {"id": pa.int64(), "key": pa.int64(), "a": pa.int64(), "b": pa.int64(), "part": pa.int32(), "blob": pa.binary()}
    arrays = [pa.array(columns[k], type=t) if k in columns else pa.nulls(n, t) for k, t in nulls.items()]
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *arrays], names=["kind", *nulls])


def _sketch(batches: Iterator[pa.RecordBatch], k: int, num: int, den: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Kind 0: a document's id, key, set size (a) and signature (b). Kind 1: a blob of keys for one part."""
    held: dict[int, np.ndarray] = {}
    waiting = 0

    def flush() -> Iterator[pa.RecordBatch]:
        sigs = np.fromiter(held, np.int64, len(held))
        owner = np.repeat(np.arange(len(sigs)), [len(x) for x in held.values()])
        keys = np.concatenate(list(held.values()))
        part = ((keys >> np.uint64(48)) * np.uint64(parts) >> np.uint64(16)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(parts + 1))
        found, packed = [], []
        for p in range(parts):
            if len(o := order[cuts[p] : cuts[p + 1]]):
                who, n = np.unique(owner[o], return_counts=True)
                five = np.ascontiguousarray(keys[o]).view(np.uint8).reshape(-1, 8)[:, :5]
                found.append(p)
                packed.append(np.int64(len(who)).tobytes() + sigs[who].tobytes() + n.astype(np.uint32).tobytes() + five.tobytes())
        for i in range(0, len(found), 8):
            yield _rows(1, len(found[i : i + 8]), part=found[i : i + 8], blob=packed[i : i + 8])

    for b in pieces(batches, "text"):
        ids, sizes, sigs = b.column("id"), [], []
        for t in as_bytes(b.column("text")):
            s = shingles(t, k)
            sig = np.uint64(signature(s)).astype(np.int64)
            sizes.append(len(s))
            sigs.append(sig)
            if len(s) and int(sig) not in held:
                held[int(sig)] = keys = scheme_keys(s, num, den)
                waiting += len(keys)
        where = xxhash.xxh32_intdigest(np.int64(sigs[0]).tobytes())
        yield _rows(0, b.num_rows, id=ids, key=b.column("key"), a=np.array(sizes, np.int64), b=np.array(sigs, np.int64), part=(np.arange(b.num_rows, dtype=np.int64) + where) % parts)
        if waiting >= FLUSH_KEYS:
            yield from flush()
            held.clear()
            waiting = 0
    if held:
        yield from flush()
    _hashes.clear()
    release()


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passes kind 0 on. Kind 2: two sets alone under a key. Kind 3: set b is one of three or more of bucket a."""
    by_part: dict[int, list[bytes]] = {}
    for b in batches:
        kinds = b.column("kind").to_numpy()
        if (docs := b.filter(pa.array(kinds == 0))).num_rows:
            yield docs
        for p, x in zip(*(b.filter(pa.array(kinds == 1)).column(c).to_pylist() for c in ("part", "blob"))):
            by_part.setdefault(p, []).append(x)
    while by_part:
        _, held = by_part.popitem()
        keys, who = [], []
        for x in held:
            n = int(np.frombuffer(x, np.int64, 1)[0])
            sigs, counts = np.frombuffer(x, np.int64, n, 8), np.frombuffer(x, np.uint32, n, 8 + 8 * n)
            five = np.frombuffer(x, np.uint8, offset=8 + 12 * n).reshape(-1, 5)
            wide = np.zeros((len(five), 8), np.uint8)
            wide[:, :5] = five
            keys.append(wide.view(np.uint64).ravel())
            owner = np.repeat(np.arange(n), counts)
            who.append(sigs[owner])
        keys, who = np.concatenate(keys), np.concatenate(who)
        order = np.argsort(keys, kind="stable")
        keys, who = keys[order], who[order]
        same = keys[1:] == keys[:-1]
        live = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        keys, who = keys[live], who[live]
        if not len(keys):
            continue
        order = np.lexsort((who, keys))
        keys, who = keys[order], who[order]
        new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (who[1:] != who[:-1])])
        keys, who = keys[new], who[new]  # one set sent by several tasks is one
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(keys)]]))
        leader = np.repeat(who[starts], sizes)
        two = np.repeat(sizes == 2, sizes)
        pairs = np.unique(np.stack([leader, who], 1)[two & (leader != who)], axis=0)
        for i in range(0, len(pairs), 1 << 16):
            yield _rows(2, len(pairs[i : i + (1 << 16)]), a=pairs[i : i + (1 << 16), 0], b=pairs[i : i + (1 << 16), 1])
        # Buckets of three sets or more; those with the same sets are one, named by a hash of them.
        names = np.add.reduceat(mixed(who.view(np.uint64)), starts)
        _, once = np.unique(names, return_index=True)
        keep = np.zeros(len(starts), bool)
        keep[once] = True
        keep &= sizes > 2
        rows = np.repeat(keep, sizes)
        name = np.repeat(names, sizes)[rows].view(np.int64)
        member = who[rows]
        for i in range(0, len(member), 1 << 16):
            yield _rows(3, len(member[i : i + (1 << 16)]), a=name[i : i + (1 << 16)], b=member[i : i + (1 << 16)])
    release()


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches, "text", 1 << 20):
        found = [shingles(t, k) for t in as_bytes(b.column("text"))]
        sig = np.array([signature(s) for s in found], np.uint64).view(np.int64)
        hit = sig == b.column("sig").to_numpy()
        s = [x for x, y in zip(found, hit) if y]
        yield pa.RecordBatch.from_arrays([pa.array(sig[hit]), blobs([parity_bits(x) for x in s]), blobs([x.tobytes() for x in s])], names=["sig", "bits", "members"])
    _hashes.clear()
    release()


def _verify(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        linked = []
        x, y = b.column("x"), b.column("y")
        for i in range(b.num_rows):
            s, t = np.frombuffer(x[i].as_buffer(), np.uint64), np.frombuffer(y[i].as_buffer(), np.uint64)
            if min(len(s), len(t)) * den < max(len(s), len(t)) * num:
                linked.append(False)
                continue
            both = np.concatenate([s, t])
            both.sort(kind="stable")
            common = int((both[1:] == both[:-1]).sum())
            linked.append(den * common >= num * (len(s) + len(t) - common))
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(linked))
    release()


def _cross(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Pairs of one block of one bucket, of different components, that the bit sketches allow. Rows come sorted by (bucket, x, y)."""

    def pairs(group: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = pa.Table.from_batches(group)
        sig, comp, n = (g.column(c).to_numpy() for c in ("sig", "comp", "n"))
        side, at, x, y = (g.column(c).to_numpy() for c in ("block", "block", "x", "y"))
        sketches = g.column("bits").to_pylist()
        size = min(map(len, sketches))
        bits = np.stack([folded(x, size) for x in sketches])
        first = np.flatnonzero(at == x)
        second = np.flatnonzero(at == y)
        del side
        for i in range(0, len(first), 256):
            f = first[i : i + 256]
            differ = np.bitwise_count(bits[f][:, None, :] ^ bits[second][None, :, :]).sum(2, dtype=np.int64)
            small, large = np.minimum(n[f][:, None], n[second][None, :]), np.maximum(n[f][:, None], n[second][None, :])
            ok = (comp[f][:, None] != comp[second][None, :]) & (den * small >= num * large) & (differ * (den + num) <= (small + large) * (den - num))
            r, c = np.nonzero(ok)
            p, q = sig[f[r]], sig[second[c]]
            if len(p):
                found = np.unique(np.stack([np.minimum(p, q), np.maximum(p, q)], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    held: list[pa.RecordBatch] = []
    now = None
    for b in batches:
        mark = np.stack([b.column(c).to_numpy() for c in ("bucket", "x", "y")], 1)
        starts = np.flatnonzero(np.concatenate([[True], (mark[1:] != mark[:-1]).any(1)])) if len(mark) else []
        for i, j in zip(starts, [*starts[1:], len(mark)]):
            if now != (key := tuple(mark[i])):
                if held:
                    yield from pairs(held)
                held, now = [], key
            held.append(b.slice(i, j - i))
    if held:
        yield from pairs(held)


def linked(df: DataFrame, k: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """One row per row of df: id, key (`text_key`), n_shingles and component, a number that linked rows share."""
    spark = bounded_batches(df).sparkSession
    text = F.col(f"`{text_col}`")
    slim = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_key(text).alias("key"), text.alias("text"))
    octets = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # A set's signature is sent to each part that it has keys in: no more parts than memory asks for.
    parts = min(MOST_PARTS, max(1, -(-octets // PART_BYTES), min(spark.sparkContext.defaultParallelism, octets >> 20)))
    sketched = slim.mapInArrow(partial(_sketch, k=k, num=num, den=den, parts=parts), OUT)
    met = cut(sketched.repartition(parts, "part").mapInArrow(_meet, OUT).drop("part", "blob"))
    docs = met.filter("kind = 0").select("id", "key", F.col("a").alias("n_shingles"), F.col("b").alias("sig"))
    members = cut(met.filter("kind = 3").select(F.col("a").alias("bucket"), F.col("b").alias("sig")).distinct())
    total = members.count()
    sizes = cut(members.groupBy("bucket").agg(F.count("*").alias("rows")))
    hot = cut(hot_keys(sizes, "rows", total))
    sized = spread_join(members, sizes, ["bucket"], hot)
    popular = cut(sized.groupBy("sig").agg(F.sum("rows").alias("met"), F.count("*").alias("buckets")))
    busy = spread_join(members, popular, ["sig"], hot_keys(popular, "buckets", total))
    hubs = cut(busy.groupBy("bucket").agg(F.max_by("sig", F.struct("met", "sig")).alias("a")))
    around = spread_join(members, hubs, ["bucket"], hubs.join(F.broadcast(hot.select("bucket")), "bucket")).filter("a <> sig").select("a", F.col("sig").alias("b"))
    ordered = around.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    stars = cut(met.filter("kind = 2").select("a", "b").unionByName(ordered).distinct())

    needed = stars.select(F.col("a").alias("sig")).union(stars.select("b")).distinct()
    each = cut(docs.groupBy("sig").agg(F.min("id").alias("chosen_id"), F.count("*").alias("rows")))
    at = cut(each.join(needed, "sig", "left_semi").select("chosen_id", "sig"))
    sets = slim.join(maybe_broadcast(at, at.count()), F.col("id").eqNullSafe(F.col("chosen_id"))).select("sig", "text").mapInArrow(partial(_sets, k=k), "sig long, bits binary, members binary")
    sets = cut(sets.dropDuplicates(["sig"]))

    def verified(pairs: DataFrame) -> DataFrame:
        n = pairs.count()
        with_x = split_join(pairs, sets.select(F.col("sig").alias("a"), F.col("members").alias("x")), "a", n)
        with_y = split_join(with_x, sets.select(F.col("sig").alias("b"), F.col("members").alias("y")), "b", n, pairs)
        return with_y.select("a", "b", "x", "y").mapInArrow(partial(_verify, num=num, den=den), "a long, b long")

    edges = cut(verified(stars))
    comps = components(edges)
    hot_sigs = comps.withColumnRenamed("node", "sig").join(F.broadcast(hot_keys(popular, "buckets", total).select("sig")), "sig")
    placed = spread_join(members, comps.withColumnRenamed("node", "sig"), ["sig"], hot_sigs).withColumn("comp", F.coalesce("component", "sig")).drop("component")
    split = placed.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("rows")).filter("lo <> hi")
    split = cut(split.select("bucket", "rows"))
    open_rows = cut(spread_join(placed, split, ["bucket"], hot_keys(split, "rows", total)).filter("rows is not null"))
    if not open_rows.isEmpty():
        blocks = F.ceil(F.col("rows") / BLOCK).cast("int")
        r = open_rows.join(sets.select("sig", "bits"), "sig").withColumn("block", F.pmod(F.xxhash64("sig"), blocks).cast("int"))
        r = r.join(docs.select("sig", F.col("n_shingles").alias("n")).dropDuplicates(["sig"]), "sig")
        r = r.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        r = r.select("bucket", "sig", "comp", "n", "bits", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
        r = r.repartition(parts, "bucket", "x", "y").sortWithinPartitions("bucket", "x", "y")
        crossed = cut(r.mapInArrow(partial(_cross, num=num, den=den), "a long, b long").distinct())
        edges = edges.unionByName(verified(crossed))
        comps = components(edges)
    named = comps.withColumnRenamed("node", "sig")
    copied = hot_keys(each, "rows", docs.count()).select("sig")
    nodes = spread_join(docs, named, ["sig"], named.join(F.broadcast(copied), "sig")).withColumn("component", F.coalesce("component", "sig"))
    return cut(nodes.select("id", "key", "n_shingles", "component"))


def link_components(df: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: id, n_shingles, component_id. Links: den * intersection >= num * union."""
    nodes = linked(df, k, num, den, id_col, text_col)
    groups = nodes.filter("n_shingles > 0").groupBy("component").agg(F.min("id").alias("component_id"), F.count("*").alias("rows"))
    groups = cut(groups.filter("rows > 1"))
    out = spread_join(nodes, groups, ["component"], hot_keys(groups, "rows", nodes.count()))
    own = F.when((F.col("n_shingles") == 0) | F.col("rows").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", own.alias("component_id"))


def keep_one(df: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of linked rows: that with the smallest id (null last), then the smallest text key.

    Rows are told apart by id and text, so an id on several texts or a null id loses no other row;
    of rows that repeat both, one stays. All columns are kept.
    """
    rows = linked(df, k, num, den, id_col, text_col).filter("n_shingles > 0")
    place = F.struct(F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col("key").alias("key"))
    groups = cut(rows.groupBy("component").agg(F.min(place).alias("best"), F.count("*").alias("rows")).filter("rows > 1"))
    found = spread_join(rows, groups, ["component"], hot_keys(groups, "rows", rows.count())).filter("rows is not null")
    whole = ~(F.col("id").eqNullSafe(F.col("best.id")) & (F.col("key") == F.col("best.key")))
    named = found.groupBy("id", "key", whole.alias("whole")).agg(F.count("*").alias("n"))
    return without_rows(df, cut(named.filter("whole or n > 1").select("id", "key", "whole")), id_col, text_col)
