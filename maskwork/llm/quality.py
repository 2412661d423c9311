"""Quality classifier: logistic regression on hashed word n-grams, trained by FTRL-proximal.

A text becomes a sparse vector of hashed 1- and 2-grams of its tokens (runs of letters and
digits, or of other visible characters, lower-cased; a token that repeats the one before counts
as a repeat mark, so that repetition generalises over words). Values are square roots of counts,
scaled to length 1. Scores are the logistic function of the sparse dot product.

Training takes at most about MAX_TRAIN labelled rows, a documented bound: rows whose hash lies
under the share that gives so many. Features are made on all executors; one task runs the
updates in hash order and returns the 2**BITS weights, whose size is fixed.

Defined results: null and empty texts have no features and score the bias; labels other than 0
and 1 and nulls are not learned from; without training rows every score is 0.5; a document that
has several labels is learned from with each; a very long text is scored whole; repeated rows are scored
alike; an empty table gives no rows. `score` keeps the columns asked for.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowtext import as_bytes, lists, pieces, release
from .common import bounded_batches

BITS = 20
MAX_TRAIN = 16_000
EPOCHS = 2
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.05, 0.5
TABLE_LIMIT = 300_000
TOKEN = re.compile(rb"[a-z0-9\x80-\xff]+|[^\x00-\x20a-z0-9\x80-\xff]+")
_M = np.uint64(0x9E3779B97F4A7C15)


class Hashes(dict):
    def __missing__(self, token: bytes) -> int:
        if len(self) >= TABLE_LIMIT:
            self.clear()
        self[token] = h = xxhash.xxh3_64_intdigest(token)
        return h


_hashes = Hashes()
_BIAS = np.zeros(1, np.int32)


def features(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers, ascending, and values. Bucket 0 is the bias."""
    tokens = TOKEN.findall((text or b"").lower())
    if not tokens:
        return _BIAS, np.ones(1, np.float32)
    h = np.fromiter(map(_hashes.__getitem__, tokens), np.uint64, len(tokens))
    same = np.concatenate([[False], h[1:] == h[:-1]])
    h = np.where(same, _M, h)
    pair = (h[1:] ^ (h[:-1] * _M)) * _M
    code = (np.concatenate([h * _M, pair]) >> np.uint64(64 - BITS)).astype(np.int32)
    code, n = np.unique(np.maximum(code, 1), return_counts=True)
    v = np.sqrt(n.astype(np.float32))
    v /= np.sqrt((v * v).sum())
    return np.concatenate([_BIAS, code]), np.concatenate([np.ones(1, np.float32), v])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches, "text"):
        found = [features(t) for t in as_bytes(b.column("text"))]
        n = np.array([len(x) for x, _ in found])
        yield pa.RecordBatch.from_arrays([b.column("place"), b.column("label"), lists(np.concatenate([x for x, _ in found]), n, pa.int32()), lists(np.concatenate([x for _, x in found]), n, pa.float32())], names=["place", "label", "at", "value"])
    _hashes.clear()
    release()


def ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights after FTRL-proximal updates over rows of (label, buckets, values)."""
    z, s = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weights(z: np.ndarray, s: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(s)) / ALPHA + L2))

    for _ in range(epochs):
        for label, at, value in rows:
            zi, si = z[at], s[at]
            w = weights(zi, si)
            p = 1 / (1 + np.exp(-np.clip(w @ value, -35, 35)))
            g = (p - label) * value
            grown = si + g * g
            z[at] = zi + g - (np.sqrt(grown) - np.sqrt(si)) / ALPHA * w
            s[at] = grown
    return weights(z, s).astype(np.float32)


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for b in batches:
        for k in range(b.num_rows):
            rows.append((b.column("label")[k].as_py(), b.column("at")[k].values.to_numpy(), b.column("value")[k].values.to_numpy()))
    yield pa.RecordBatch.from_arrays([pa.array([ftrl(rows).tobytes()], pa.binary())], names=["weights"])


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_TRAIN) -> np.ndarray:
    bounded_batches(df)
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("label")).filter("label in (0, 1) and _id is not null")
    place = F.md5(F.col("_id").cast("string").cast("binary"))
    n = known.count()
    if n > max_rows:
        known = known.filter(F.conv(F.substring(place, 1, 12), 16, 10).cast("double") < max_rows / n * float(1 << 48))
    joined = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(known, "_id").select(place.alias("place"), "label", "text")
    made = joined.mapInArrow(_extract, "place string, label int, at array<int>, value array<float>")
    one = made.repartition(1).sortWithinPartitions("place", "label").mapInArrow(_fit, "weights binary")  # at most about max_rows rows
    got = one.first()
    return np.frombuffer(bytes(got.weights), np.float32) if got else np.zeros(1 << BITS, np.float32)


def _score(batches: Iterator[pa.RecordBatch], weights, text_col: str, keep: list[str]) -> Iterator[pa.RecordBatch]:
    w = weights.value
    for b in pieces(batches, text_col):
        found = [features(t) for t in as_bytes(b.column(text_col))]
        first = np.concatenate([[0], np.cumsum([len(x) for x, _ in found])[:-1]])
        dots = np.add.reduceat(w[np.concatenate([x for x, _ in found])] * np.concatenate([v for _, v in found]), first, dtype=np.float64)
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(1 / (1 + np.exp(-np.clip(dots, -35, 35))))], names=[*keep, "score"])
    _hashes.clear()
    release()


def score(df: DataFrame, weights: np.ndarray, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df's columns (or those in keep) and score. Only the text is looked at."""
    keep = [c for c in (keep if keep is not None else df.columns) if c != "score"]
    shared = bounded_batches(df).sparkSession.sparkContext.broadcast(weights)
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField("score", T.DoubleType())])
    return df.select(*dict.fromkeys([*keep, text_col])).mapInArrow(partial(_score, weights=shared, text_col=text_col, keep=keep), schema)
