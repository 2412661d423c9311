"""Token files: frequency-ranked ids in byte-aligned variable-length coding.

Ids are replaced by their rank in the corpus (most frequent first, ties by id). A block codes its
ranks in two streams: control bytes with four 2-bit lengths each (1 to 4 bytes, first value in
the low bits), and the little-endian value bytes. Decoding looks the control bytes up in a table
of lengths and gathers the values with numpy.

A token file is a folder of two Parquet tables, so that any store Spark reaches can hold it:
  ranks   one row: ids BINARY, the uint32 ids in rank order
  blocks  part, block, first (ids of the part before this block), doc_ids, lengths, control, data
Parts are ranges of doc_id; parts, blocks, and documents inside blocks ascend by doc_id (null
first), rows of one id by the hash of their ids.

Defined results: null text counts as empty and is coded as the end id alone; every row, repeated
ones too, is a document; an empty table gives a file without blocks. Extra columns are ignored.
The literal of an added token (such as <|endoftext|>) in a text is coded as the words it is made
of, or, with literal=False, as that token: the library's own default.
"""

from __future__ import annotations

import os
import uuid
from array import array
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrowtext import as_bytes, blobs, pieces
from .common import bounded_batches, cut, maybe_broadcast, shuffle_partitions

END_ID = 0
BLOCK_IDS = 1 << 18
TABLE_LIMIT = 600_000
JOINED = 256
#: Fixed value: the library's word pattern. On texts of the bytes below, `word_starts` finds the same words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

END, LETTER, DIGIT, SIGN, SPACE, ODD = 0, 1, 2, 3, 5, 255
#: Kind of every byte; 4 is white space other than the space. Two-byte letters are U+00C0 to U+027F.
KIND = np.full(256, ODD, np.uint8)
KIND[33:127] = SIGN
KIND[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), *range(0xC3, 0xCA)]] = LETTER
KIND[48:58] = DIGIT
KIND[[9, 10, 11, 12, 13]] = 4
KIND[32] = SPACE
KIND[0] = END
KIND[ord("'")] = ODD
MIX = np.random.default_rng(20).integers(0, 1 << 64, 256, dtype=np.uint64)
BASE = 0x9E3779B97F4A7C15


def is_plain(raw: bytes) -> bool:
    """Whether a text has only bytes whose words `word_starts` knows: no apostrophes, controls, or rarer characters."""
    return not KINDS_ODD.intersection(raw) and b"\xc3\x97" not in raw and b"\xc3\xb7" not in raw


KINDS_ODD = frozenset([0, *np.flatnonzero(KIND == ODD).tolist()])


def word_starts(kind: np.ndarray) -> np.ndarray:
    """Where words start in plain texts that each end with a zero byte, which is a word too.

    A word is a run of letters, digits or signs with the single space before it; a run of white
    space before a word gives its last character away, and is a word if anything is left.
    """
    run = np.minimum(kind, 4)
    change = np.empty(len(run), bool)
    change[0] = True
    np.not_equal(run[1:], run[:-1], out=change[1:])
    before = np.empty(len(run), np.uint8)
    before[0], before[1:] = END, kind[:-1]
    start = change & (before != SPACE)
    start |= change & (run == 4)
    start |= kind == END
    last = change[1:] & (run[:-1] == 4) & (run[1:] != END)
    start[:-1] |= last
    return np.flatnonzero(start)


@cache
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse, modulo 2**64."""
    forth, back = np.full(n, BASE, np.uint64), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
    forth[0] = back[0] = 1
    return np.cumprod(forth), np.cumprod(back)


class Words:
    """Ids of distinct words, by a 64-bit hash of their bytes; the library encodes each word once.

    Words of letters are encoded many in one text with line ends between, which no such word
    holds and which always are words of their own; the ids are cut at theirs.
    """

    def __init__(self, tokenizer_file: str, literal: bool = True) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(tokenizer_file)
        self.lib.encode_special_tokens = literal
        self.added = [] if literal else [t.content.encode() for t in self.lib.get_added_tokens_decoder().values()]
        self.code = "H" if self.lib.get_vocab_size() <= 1 << 16 else "I"
        self.width = array(self.code).itemsize
        self.table: dict[int, bytes] = {}
        probe = "A word's  two\n\n (so 12,x_) café\t z "
        self.safe = self.plain(probe) == b"".join(map(self.plain, regex.findall(PATTERN, probe)))
        gap = self.lib.encode("\n", add_special_tokens=False).ids
        self.gap = gap[0] if len(gap) == 1 else None
        self.end = array(self.code, [END_ID]).tobytes()

    def plain(self, text: str) -> bytes:
        return array(self.code, self.lib.encode(text, add_special_tokens=False).ids).tobytes()

    def encode_words(self, words: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(words)
        letters = [k for k, w in enumerate(words) if w.lstrip(" ").isalpha()] if self.gap is not None else []
        for i in range(0, len(letters), JOINED * 64):
            parts = [letters[j : j + JOINED] for j in range(i, min(i + JOINED * 64, len(letters)), JOINED)]
            for part, e in zip(parts, self.lib.encode_batch_fast(["\n".join(words[k] for k in p) for p in parts], add_special_tokens=False)):
                raw = array(self.code, e.ids).tobytes()
                cuts = (np.flatnonzero(np.frombuffer(raw, f"<u{self.width}") == self.gap) * self.width).tolist()
                if len(cuts) != len(part) - 1:
                    continue
                at = 0
                for k, cut in zip(part, [*cuts, len(raw)]):
                    out[k] = raw[at:cut]
                    at = cut + self.width
        return [self.plain(w) if x is None else x for w, x in zip(words, out)]

    def encode_plain(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain texts that each end with a zero byte, end ids included, and how many each has."""
        data = np.frombuffer(raw, np.uint8)
        kind = KIND[data]
        starts = word_starts(kind)
        forth, back = powers(1 << max(12, (len(data) - 1).bit_length()))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(MIX[data] * forth[: len(data)], out=sums[1:])
        ends = np.append(starts[1:], len(data))
        code = (sums[ends] - sums[starts]) * back[starts]
        inverse, distinct = pd.factorize(code)
        first = np.empty(len(distinct), np.int64)
        first[inverse[::-1]] = np.arange(len(code) - 1, -1, -1)
        keys = distinct.tolist()
        found = list(map(self.table.get, keys))
        new = [k for k, x in enumerate(found) if x is None]
        if new:
            if len(self.table) + len(new) > TABLE_LIMIT:
                self.table.clear()
            a, b = starts[first[new]].tolist(), ends[first[new]].tolist()
            words = [raw[x:y] for x, y in zip(a, b)]
            coded = self.encode_words([w.decode() for w in words])
            for k, w, ids in zip(new, words, coded):
                self.table[keys[k]] = found[k] = self.end if w == b"\0" else ids
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // self.width
        flat = np.frombuffer(b"".join(found), f"<u{self.width}")
        places = np.cumsum(sizes) - sizes
        n = sizes[inverse]
        total = np.cumsum(n)
        ids = flat[np.repeat(places[inverse] - (total - n), n) + np.arange(total[-1])]
        bounds = total[np.flatnonzero(data[starts] == 0)]
        return ids, np.diff(bounds, prepend=0)

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """Ids of each UTF-8 text, and the end id."""
        texts = [t or b"" for t in texts]
        plain = [self.safe and is_plain(t) and not any(x in t for x in self.added) for t in texts]
        out = [b"" if p else self.plain(t.decode()) + self.end for t, p in zip(texts, plain)]
        if any(plain):
            ids, sizes = self.encode_plain(b"".join(t + b"\0" for t, p in zip(texts, plain) if p))
            raw, at = ids.tobytes(), 0
            for k, n in zip([k for k, p in enumerate(plain) if p], (sizes * self.width).tolist()):
                out[k] = raw[at : at + n]
                at += n
        return out


@cache
def word_table(tokenizer_file: str, literal: bool) -> Words:
    return Words(tokenizer_file, literal)


def _tokenise(batches: Iterator[pa.RecordBatch], tokenizer_file: str, literal: bool, width: int, vocab: int) -> Iterator[pa.RecordBatch]:
    """Rows of doc_id and ids, and at the end one row that counts the task's ids."""
    table, total = word_table(tokenizer_file, literal), np.zeros(vocab, np.int64)
    names = ["doc_id", "ids", "counts"]
    for b in pieces(batches, "text", 1 << 21):
        ids = table.encode(as_bytes(b.column(1)))
        total += np.bincount(np.frombuffer(b"".join(ids), f"<u{width}"), minlength=vocab)
        yield pa.RecordBatch.from_arrays([b.column(0), blobs(ids), pa.nulls(len(ids), pa.binary())], names=names)
    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), blobs([total.tobytes()])], names=names)


def _count(batches: Iterator[pa.RecordBatch], vocab: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(vocab, np.int64)
    for b in batches:
        for x in b.column(0).to_pylist():
            total += np.frombuffer(x, np.int64)
    (at,) = np.nonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["id", "n"])


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of non-negative values below 2**32."""
    v = values.astype("<u4")
    n = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    codes = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    codes[: len(v)] = n - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    used = np.arange(4, dtype=np.uint8) < n[:, None]
    return control.tobytes(), v.view(np.uint8).reshape(-1, 4)[used].tobytes()


#: For each control byte, the lengths of its four values.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + np.uint8(1)


def unpack(control: bytes, data: bytes, count: int) -> np.ndarray:
    n = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:count]
    d = np.frombuffer(data + b"\0\0\0", np.uint8)
    at = np.cumsum(n, dtype=np.int64) - n
    out = d[at].astype(np.uint32)
    for k in (1, 2, 3):
        (more,) = np.nonzero(n > k)
        if not len(more):
            break
        out[more] |= d[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _blocks(batches: Iterator[pa.RecordBatch], width: int, ranks: bytes) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    order = np.frombuffer(ranks, "<u4")
    rank = np.zeros(int(order.max(initial=0)) + 1, np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    part, block, first = TaskContext.get().partitionId(), 0, 0
    ids: list = []
    held: list[np.ndarray] = []

    def close() -> pa.RecordBatch:
        nonlocal block, first, ids, held
        lengths = np.array([len(x) for x in held], np.int64)
        control, data = pack(np.concatenate(held))
        out = [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([first], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())), blobs([control]), blobs([data])]
        block, first, ids, held = block + 1, first + int(lengths.sum()), [], []
        return pa.RecordBatch.from_arrays(out, names=["part", "block", "first", "doc_ids", "lengths", "control", "data"])

    waiting = 0
    for b in batches:
        for doc_id, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            ids.append(doc_id)
            held.append(rank[np.frombuffer(x, f"<u{width}")])
            waiting += len(held[-1])
            if waiting >= BLOCK_IDS:
                yield close()
                waiting = 0
    if held:
        yield close()


def _read(batches: Iterator[pa.RecordBatch], ranks: bytes) -> Iterator[pa.RecordBatch]:
    order = np.frombuffer(ranks, "<u4")
    for b in batches:
        for r in range(b.num_rows):
            first, doc_ids, lengths, control, data, offset = (b.column(k)[r].as_py() for k in range(6))
            lengths = np.array(lengths, np.int64)
            values = order[unpack(control, data, int(lengths.sum()))]
            ends = np.cumsum(lengths)
            starts = ends - lengths
            for i in range(0, len(doc_ids), 1024):
                s, e = starts[i : i + 1024], ends[i : i + 1024]
                parts = [values[x:y].tobytes() for x, y in zip(s.tolist(), e.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids[i : i + 1024], pa.int64()), pa.array(s + first + offset), blobs(parts)], names=["doc_id", "start", "ids_le"])


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new folder in the shared checkpoint folder."""
    cut(spark.range(0))
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{kind}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def write_tokens(df: DataFrame, path: str, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", literal: bool = True) -> None:
    """Encode every text of df and write a token file to path."""
    spark = bounded_batches(df).sparkSession
    table = word_table(tokenizer_file, literal)
    width, vocab = table.width, table.lib.get_vocab_size() + 1
    raw = f"{path}/raw"
    slim = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    slim.mapInArrow(partial(_tokenise, tokenizer_file=tokenizer_file, literal=literal, width=width, vocab=vocab), "doc_id long, ids binary, counts binary").write.option("compression", "zstd").parquet(raw)
    written = spark.read.schema("doc_id long, ids binary, counts binary").parquet(raw)
    rows = written.filter("ids is not null").select("doc_id", "ids")
    counted = written.filter("counts is not null").select("counts").mapInArrow(partial(_count, vocab=vocab), "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    order = [r.id for r in sorted(counted.collect(), key=lambda r: (-r.n, r.id))]  # at most one row per entry of the vocabulary
    ranks = np.array(order, "<u4").tobytes()
    spark.createDataFrame([(bytearray(ranks),)], "ids binary").coalesce(1).write.parquet(f"{path}/ranks")
    parts = shuffle_partitions(spark)
    ranged = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("ids"))
    ranged.mapInArrow(partial(_blocks, width=width, ranks=ranks), "part int, block int, first long, doc_ids array<long>, lengths array<long>, control binary, data binary").write.option("compression", "zstd").parquet(f"{path}/blocks")
    remove(spark, raw)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it) and ids_le (its ids as little-endian uint32)."""
    ranks = bytes(spark.read.parquet(f"{path}/ranks").first().ids)
    blocks = spark.read.schema("part int, block int, first long, doc_ids array<long>, lengths array<long>, control binary, data binary").parquet(f"{path}/blocks")
    ends = blocks.select("part", (F.col("first") + F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("end")).groupBy("part").agg(F.max("end").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut(ends.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset")))
    placed = blocks.join(maybe_broadcast(offsets, offsets.count()), "part")
    return placed.select("first", "doc_ids", "lengths", "control", "data", "offset").mapInArrow(partial(_read, ranks=ranks), "doc_id long, start long, ids_le binary")
