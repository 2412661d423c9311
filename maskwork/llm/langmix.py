"""Language identification by multilingual mixture inference.

Training counts hashed byte trigrams (lower case, white space, digits and ASCII punctuation as
spaces) per language over all training rows. For a document, every word gets a likelihood under
every language; expectation-maximisation estimates the document's language proportions. The
language set is chosen by penalised likelihood: the best 1, 2, 3 and so on languages are each
refitted, and the set with the largest log-likelihood minus PENALTY * size * log(words) wins. From
size TRIED on, a document stops at the first size that is no better. The predicted
language has the largest proportion in that set, and the proportion is the score.

The model holds BUCKETS + 1 floats a language, for at most MAX_LANGUAGES languages, so its size
is bounded; more languages are an error, never a silent cut.

Defined results: null text or text without a letter is `und` with score 0, as is everything when
nothing was learned; rows with null lang are predicted but not learned from; a very long text is
scored whole; repeated rows count each time; of equal proportions the language that sorts first is
taken; an empty table gives no rows. `classify` keeps all
columns of its input; `lang_pred` and `score` replace columns of those names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowtext import as_bytes, pieces, release
from .common import bounded_batches

BUCKETS = 1 << 16
MAX_LANGUAGES = 256
ROUNDS = 8
PENALTY = 2.0
TRIED = 3

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[:128] = [ord(chr(i).lower()) if chr(i).isalpha() else 32 for i in range(128)]


def _grams(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram buckets of all texts, where each word starts, and the words before each text."""
    joined = _LOWER[np.frombuffer(b"".join(b" " + (t or b"") + b"   " for t in texts), np.uint8)]
    sizes = np.array([len(t or b"") + 4 for t in texts])
    a, b, c = joined[:-2].astype(np.uint32), joined[1:-1].astype(np.uint32), joined[2:].astype(np.uint32)
    code = (((a << 16 | b << 8 | c) * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int32)
    code[(a == 32) & (b == 32)] = BUCKETS
    starts = np.flatnonzero((a == 32) & (b != 32))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    return code, starts, np.searchsorted(starts, bounds)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for b in pieces(batches, "text", 1 << 20):
        langs, texts = b.column("lang").to_pylist(), as_bytes(b.column("text"))
        for lang in set(langs):
            code, _, _ = _grams([t for t, x in zip(texts, langs) if x == lang])
            total[lang] = total.get(lang, 0) + np.bincount(code, minlength=BUCKETS + 1)[:BUCKETS]
    for lang, n in total.items():
        (at,) = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.int64))], names=["lang", "gram", "n"])
    release()


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages, sorted, and the log-probability of each bucket (last row: 0) by language."""
    rows = bounded_batches(df).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter("lang is not null and text is not null")
    names = [r.lang for r in rows.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect()]
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not names:
        return [], np.zeros((BUCKETS + 1, 0), np.float32)
    names.sort()
    counts = np.zeros((BUCKETS, len(names)))
    found = rows.mapInArrow(_count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    got = found.toArrow().to_pydict()  # at most BUCKETS rows a language
    counts[np.array(got["gram"], np.int64), np.searchsorted(names, got["lang"]) if got["gram"] else []] = got["n"]
    counts += 0.5
    return names, np.vstack([np.log(counts / counts.sum(0)), np.zeros(len(names))]).astype(np.float32)


def _fit(like: np.ndarray, owner: np.ndarray, first: np.ndarray, n: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihood (up to each word's best) of every document. like: by word."""
    share = allowed / allowed.sum(1, keepdims=True)
    for _ in range(ROUNDS):
        joint = like * share[owner]
        total = joint.sum(1, keepdims=True)
        np.maximum(total, 1e-300, out=total)
        joint /= total
        share = np.add.reduceat(joint, first, axis=0) / n[:, None]
    total = np.log(np.maximum((like * share[owner]).sum(1), 1e-300))
    return share, np.add.reduceat(total, first)


def proportions(texts: list[bytes | None], table: np.ndarray) -> np.ndarray:
    """For each text, the proportions of the languages in its chosen set; zeros without words."""
    langs = table.shape[1]
    out = np.zeros((len(texts), langs))
    code, starts, cuts = _grams(texts)
    words = np.diff(cuts)
    (live,) = np.nonzero(words)
    if not langs or not len(live):
        return out
    n = words[live]
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    by_word = np.add.reduceat(table[code], starts, axis=0, dtype=np.float64)
    like = np.exp(np.maximum(by_word - by_word.max(1, keepdims=True), -600))
    owner = np.repeat(np.arange(len(live)), n)
    every, _ = _fit(like, owner, first, n, np.ones((len(live), langs)))
    ranking = np.argsort(-every, axis=1, kind="stable")
    best, best_value = np.zeros_like(every), np.full(len(live), -np.inf)
    at = np.arange(len(live))
    for size in range(1, langs + 1):
        allowed = np.zeros((len(at), langs))
        np.put_along_axis(allowed, ranking[at, :size], 1.0, axis=1)
        share, value = _fit(like, owner, first, n, allowed)
        value -= PENALTY * size * np.log(n + 1)
        better = value > best_value[at]
        best[at[better]], best_value[at[better]] = share[better], value[better]
        if size < TRIED:
            continue
        if not better.any():
            break
        if not better.all():
            like, at, n = like[np.repeat(better, n)], at[better], n[better]
            owner, first = np.repeat(np.arange(len(at)), n), np.concatenate([[0], np.cumsum(n)[:-1]])
    out[live] = best
    return out


def _classify(batches: Iterator[pa.RecordBatch], model, text_col: str, keep: list[str]) -> Iterator[pa.RecordBatch]:
    names, table = model.value
    for b in pieces(batches, text_col, 1 << 19):
        raw = as_bytes(b.column(text_col))
        share = proportions(raw, table)
        pred, score = [], []
        for t, row in zip(raw, share):
            known = t is not None and names and row.any() and any(map(str.isalpha, t.decode("utf-8", "replace")))
            pred.append(names[int(row.argmax())] if known else "und")
            score.append(min(1.0, float(row.max())) if known else 0.0)
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*keep, "lang_pred", "score"])
    release()


def classify(df: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df's columns (or those in keep), lang_pred and score. Only the text is looked at."""
    keep = [c for c in (keep if keep is not None else df.columns) if c not in ("lang_pred", "score")]
    shared = bounded_batches(df).sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return df.select(*dict.fromkeys([*keep, text_col])).mapInArrow(partial(_classify, model=shared, text_col=text_col, keep=keep), schema)


def held_out(doc_id: Column) -> Column:
    """Fold of a document: crc32 of its id in decimal, modulo 4, is 2. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
