"""Line dedup by pairwise alignment.

Every line is hashed (without surrounding white space; blank lines are 0). Two documents are
aligned with patience diff, gaps without unique lines by a longest common subsequence, and aligned
common blocks of MIN_WORDS words or more are deleted from the later document. The result is that
of aligning every document with every earlier one, of which most alignments need not be made:

Candidates share a window: a run of lines that reaches MIN_WORDS words and doesn't without its
last, or without its first line. Every line of an aligned block lies in such a window inside the
block, so only lines in windows that an earlier document holds can go. Each document meets the
first holder of each of its windows. Windows that still have lines left then meet further
earlier holders, nearest first and GROWTH times as many in each round, until their lines are
deleted or no earlier holder is left. Documents with the lines of an earlier one go whole and are
nobody's candidate. `partners` are the documents met that had blocks deleted.

The earlier document is that with the smaller id (null last), then the smaller text hash. Rows
that repeat id and text are one document and are cut alike.

Defined results: null text stays null and has no lines; empty texts are one blank line; blank
lines alone are never deleted; a whole copy becomes an empty text; very long texts are worked
through whole; an empty table gives no rows; `remove_repeats` keeps all columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrowtext import as_bytes, lists, pieces
from .common import bounded_batches, cut, hot_keys, packed, spread_join, text_key

MIN_WORDS = 8
GROWTH = 8
LCS_BITS = 1 << 28
BASE = 0x9E3779B97F4A7C15


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches, "text"):
        hashes, words, counts = [], [], []
        for t in as_bytes(b.column("text")):
            own = (t or b"").split(b"\n")
            counts.append(len(own))
            for x in own:
                n = len(x.split())
                words.append(n)
                hashes.append((xxhash.xxh3_64_intdigest(x.strip()) >> 1) if n else 0)
        n = np.array(counts)
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("sig"), lists(np.array(hashes, np.int64), n, pa.int64()), lists(np.array(words, np.int32), n, pa.int32())], names=["id", "sig", "hashes", "words"])


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned (i, j) with a[i] == b[j], both ascending."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, i2, j, j2 = todo.pop()
        while i < i2 and j < j2 and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < i2 and j < j2 and a[i2 - 1] == b[j2 - 1]:
            i2, j2 = i2 - 1, j2 - 1
            out.append((i2, j2))
        if i == i2 or j == j2:
            continue
        left, right = {}, {}
        for k in range(i, i2):
            left[a[k]] = -1 if a[k] in left else k
        for k in range(j, j2):
            right[b[k]] = -1 if b[k] in right else k
        unique = [(k, right[h]) for h, k in left.items() if h and k >= 0 and right.get(h, -1) >= 0]
        unique.sort()
        anchors = rising(unique) or [(i + x, j + y) for x, y in common(a[i:i2], b[j:j2])]
        p, q = i, j
        for x, y in [*anchors, (i2, j2)]:
            if (p, q, x, y) != (i, j, i2, j2) and p < x and q < y:
                todo.append((p, x, q, y))
            p, q = x + 1, y + 1
        out.extend(anchors)
    return sorted(out)


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest subsequence of pairs whose second members rise."""
    from bisect import bisect_left

    tails, ends, back = [], [], {}
    for k, (_, y) in enumerate(pairs):
        at = bisect_left(tails, y)
        back[k] = ends[at - 1] if at else -1
        tails[at : at + 1] = [y]
        ends[at : at + 1] = [k]
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def common(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """A longest common subsequence without blank lines, bit-parallel."""
    both = {h for h in a if h} & set(b)
    left, right = ([k for k, h in enumerate(x) if h in both] for x in (a, b))
    return [(left[i], right[j]) for i, j in _common([a[k] for k in left], [b[k] for k in right])] if both else []


def _rows(a: list[int], b: list[int]) -> Iterator[int]:
    """For every line of a, bits of b: 0 where the common subsequence grows."""
    at: dict[int, int] = {}
    for j, h in enumerate(b):
        at[h] = at.get(h, 0) | 1 << j
    full = v = (1 << len(b)) - 1
    for h in a:
        u = v & at.get(h, 0)
        v = ((v + u) | (v - u)) & full
        yield v


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    for v in _rows(a, b):
        pass
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")
    return np.concatenate([[0], np.cumsum(1 - bits[: len(b)].astype(np.int64))])


def _common(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    if len(a) > 1 and len(a) * len(b) > LCS_BITS:  # halves of a, so that rows held stay bounded
        half = len(a) // 2
        at = int((_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]).argmax())
        return _common(a[:half], b[:at]) + [(half + i, at + j) for i, j in _common(a[half:], b[at:])]
    rows, out, i, j = list(_rows(a, b)), [], len(a), len(b)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
            if not i or rows[i - 1] >> (j - 1) & 1:
                j -= 1
                out.append((i, j))
    return out[::-1]


def blocks(a: list[int], b: list[int], words: list[int], least: int = MIN_WORDS) -> list[int]:
    """Lines of b in aligned common blocks of enough words."""
    out, run = [], []
    for i, j in [*patience(a, b), (-9, -9)]:
        if run and (i, j) != (run[-1][0] + 1, run[-1][1] + 1):
            if sum(words[y] for _, y in run) >= least:
                out += [y for _, y in run]
            run = []
        run.append((i, j))
    return out


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        node, first, found = [], [], []
        for x, i, p, q, w in zip(*(b.column(c).to_pylist() for c in ("later", "first_id", "p", "q", "words"))):
            if gone := blocks(p, q, w):
                node.append(x), first.append(i), found.append(gone)
        if node:
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(first, pa.int64()), pa.array(found, pa.list_(pa.int32()))], names=["node", "first_id", "gone"])


def windows(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, first line, end and hash of every window of a batch with columns hashes and words; lines count over the batch."""
    h, words = (b.column(c).flatten().to_numpy().astype(np.uint64 if c == "hashes" else np.int64) for c in ("hashes", "words"))
    counts = np.diff(b.column("hashes").offsets.to_numpy())
    row = np.repeat(np.arange(len(counts)), counts)
    ends = np.cumsum(counts)
    total = np.concatenate([[0], np.cumsum(words)])
    lines = np.arange(len(h))
    to = np.searchsorted(total, total[:-1] + MIN_WORDS, "left")
    since = np.searchsorted(total, total[1:] - MIN_WORDS, "right") - 1
    fits, fits_back = to <= ends[row], since >= (ends - counts)[row]
    span = np.unique(np.concatenate([np.stack([lines[fits], to[fits]], 1), np.stack([since[fits_back], lines[fits_back] + 1], 1)]), axis=0)
    forth, back = np.full(len(h) + 1, BASE, np.uint64), np.full(len(h) + 1, pow(BASE, -1, 1 << 64), np.uint64)
    forth[0] = back[0] = 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * np.cumprod(forth)[:-1], dtype=np.uint64)])
    s, e = span[:, 0], span[:, 1]
    key = (sums[e] - sums[s]) * np.cumprod(back)[s] + (e - s).astype(np.uint64) * np.uint64(BASE)
    return row[s], s, e, key.view(np.int64)


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct windows of every document."""
    for b in batches:
        row, _, _, key = windows(b)
        own = np.unique(np.stack([row, key], 1), axis=0)
        if len(own):
            got = b.select(["id", "sig", "node"]).take(pa.array(own[:, 0]))
            yield pa.RecordBatch.from_arrays([pa.array(own[:, 1]), *got.columns], names=["w", "id", "sig", "node"])


def _left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the windows asked, those that have lines left."""
    for b in batches:
        row, s, e, key = windows(b)
        counts = np.diff(b.column("hashes").offsets.to_numpy())
        starts = np.cumsum(counts) - counts
        left = np.ones(int(counts.sum()), np.int64)
        for at, gone in zip(starts.tolist(), b.column("gone").to_pylist()):
            left[at + np.array(gone or [], np.int64)] = 0
        total = np.concatenate([[0], np.cumsum(left)])
        some = total[e] > total[s]
        asked = [set(x) for x in b.column("asked").to_pylist()]
        node = b.column("node").to_pylist()
        found = {(node[r], k) for r, k in zip(row[some].tolist(), key[some].tolist()) if k in asked[r]}
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["node", "w"])


def deletions(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """All documents (node, id, sig, hashes, words, seq) and those to cut (node, gone, partners)."""
    slim = bounded_batches(df).select(F.col(f"`{id_col}`").cast("long").alias("id"), text_key(F.col(f"`{text_col}`")).alias("sig"), F.col(f"`{text_col}`").alias("text")).mapInArrow(_lines, "id long, sig long, hashes array<long>, words array<int>")
    docs = cut(slim.dropDuplicates(["id", "sig"]).withColumn("node", F.monotonically_increasing_id()).withColumn("seq", F.xxhash64("hashes")))
    place = F.struct(F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col("sig").alias("sig"), F.col("node").alias("node"))
    heads = docs.filter(F.aggregate("words", F.lit(0).cast("long"), lambda a, n: a + n) >= MIN_WORDS).select("seq", place.alias("place"), F.size("hashes").alias("n"))
    again = heads.groupBy("seq").agg(F.min("place").alias("first"), F.count("*").alias("df")).filter("df > 1")
    copies = heads.join(again, "seq").filter("place.node <> first.node")
    found = cut(copies.select(F.col("place.node").alias("node"), F.col("first.id").alias("first_id"), F.sequence(F.lit(0), F.col("n") - 1).alias("gone")))

    alone = docs.join(found.select("node"), "node", "left_anti").select("node", "id", "sig", "hashes", "words")
    held = alone.mapInArrow(_held, "w long, id long, sig long, node long").select("w", place.alias("place"))
    owners = cut(held.groupBy("w").agg(F.min("place").alias("least"), F.count("*").alias("df")).filter("df > 1").select("w", F.col("least.node").alias("first"), "df"))
    total = owners.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    shared = cut(spread_join(held, owners, ["w"], hot_keys(owners, "df", total)).filter("first is not null").select("w", "place", "first"))
    lines = docs.select(F.col("node").alias("b"), F.col("hashes").alias("q"), "words")
    first = docs.select(F.col("node").alias("a"), F.col("id").alias("first_id"), F.col("hashes").alias("p"))

    def aligned(pairs: DataFrame) -> DataFrame:
        both = pairs.distinct().join(first, "a").join(lines, "b")
        return cut(both.select(F.col("b").alias("later"), "first_id", "p", "q", "words").mapInArrow(_align, "node long, first_id long, gone array<int>"))

    def left(cases: DataFrame) -> DataFrame:
        asked = cases.groupBy("node").agg(F.collect_set("w").alias("asked"))
        gone = found.groupBy("node").agg(F.flatten(F.collect_list("gone")).alias("gone"))
        return cut(alone.join(asked, "node").join(gone, "node", "left").select("node", "hashes", "words", "asked", "gone").mapInArrow(_left, "node long, w long"))

    later = shared.filter("place.node <> first").select("w", F.col("place.node").alias("node"), "first")
    found = found.unionByName(aligned(later.select(F.col("first").alias("a"), F.col("node").alias("b"))))
    rest = left(later.select("w", "node"))
    if not rest.isEmpty():
        rank = F.row_number().over(Window.partitionBy("w").orderBy("place")) - 1
        holders = cut(shared.join(rest.select("w").distinct(), "w", "left_semi").select("w", F.col("place.node").alias("a"), rank.alias("k")))
        own = holders.select("w", F.col("a").alias("node"), F.col("k").alias("own"))
        near, far = 1, 1
        while not (cases := cut(rest.join(own, ["w", "node"]).filter(F.col("own") > near))).isEmpty():  # holder 0 is met
            size = far - near + 1
            reach = F.sequence(F.floor(F.greatest(F.lit(1), F.col("own") - far) / size), F.floor((F.col("own") - near) / size))
            asking = cases.withColumn("part", F.explode(reach)).withColumnRenamed("node", "b")
            met = asking.join(holders.withColumn("part", F.floor(F.col("k") / size)), ["w", "part"]).filter(F.col("k") > 0).filter((F.col("own") - F.col("k")).between(near, far))
            found = found.unionByName(aligned(met.select("a", "b")))
            near, far = far + 1, far * GROWTH
            rest = left(cases.filter(F.col("own") > near).select("w", "node"))
    gone = found.groupBy("node").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone"), F.array_sort(F.collect_set("first_id")).alias("partners"))
    return docs, cut(gone)


ADDED = ("n_lines", "n_removed", "removed_words", "partners")


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of df, the cleaned text in place of the old, and n_lines, n_removed, removed_words, partners.

    These replace columns of the same names; all others are kept, whatever their names.
    """
    docs, gone = deletions(df, id_col, text_col)
    removed = F.aggregate("gone", F.lit(0).cast("long"), lambda a, i: a + F.element_at("words", i + 1))
    cuts = gone.join(docs, "node").select(F.col("id").alias("_cid"), F.col("sig").alias("_csig"), "gone", removed.alias("removed"), "partners")
    text = F.col(f"_row.`{text_col}`")
    own = packed(df).withColumns({"_id": F.col(f"_row.`{id_col}`").cast("long"), "_sig": text_key(text)})
    out = own.join(cuts, F.col("_id").eqNullSafe(F.col("_cid")) & (F.col("_sig") == F.col("_csig")), "left")
    lines = F.split(text, "\n", -1)
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "gone"), lambda i: F.get(lines, i))
    cleaned = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(left, "\n")).alias(text_col)
    columns = [cleaned if c == text_col else F.col(f"_row.`{c}`") for c in df.columns if c not in ADDED]
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    added = [count(F.size(lines)), count(F.size("gone")), count(F.col("removed")), F.coalesce("partners", F.array().cast("array<long>"))]
    return out.select(*columns, *(c.alias(n) for c, n in zip(added, ADDED)))


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with repeated blocks deleted from later documents."""
    cleaned = report(packed(df, id_col, text_col), id_col, text_col)
    return cleaned.select(*(F.col(f"`{c}`") if c == text_col else F.col(f"_row.`{c}`") for c in df.columns))
