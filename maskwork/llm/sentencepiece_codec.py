"""SentencePiece encoding and decoding through a table of distinct chunks.

Where no piece of the vocabulary holds a white-space marker behind another character, merges
cannot cross the place before a run of markers. Each distinct marked word is then segmented once
by the library, kept in a table, and the ids of a text are the joined ids of its words, in order.
The table lives for one task and is emptied at TABLE_LIMIT entries, so its memory is bounded; it needs no shuffle and can be rebuilt anywhere if an executor is lost. Models whose
pieces cross markers, or whose normaliser changes texts, are encoded text by text instead.

Decoding is the library's decode(ids).

Defined results: null text counts as empty and has no ids; very long texts are encoded whole;
repeated rows are encoded alike; empty tables give no rows. Input columns are kept, except that
`ids` and `decoded` replace columns of those names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .arrowtext import lists, pieces, release
from .common import bounded_batches

TABLE_LIMIT = 150_000
MARK = "▁"
RUNS = re.compile(" +[^ ]*")


class Chunks(dict):
    """marked word, without its first marker -> ids as bytes of int32."""

    def __init__(self, model_file: str) -> None:
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=model_file)
        names = [self.lib.id_to_piece(i) for i in range(self.lib.get_piece_size())]
        probe = "  Aﬁ　 b\t c "
        plain = self.lib.normalize(probe) == MARK + probe.replace(" ", MARK)
        lone = self.lib.piece_to_id(MARK)
        self.safe = plain and lone != self.lib.unk_id() and not any(MARK in x.lstrip(MARK) for x in names)
        self.lone = np.int32(lone).tobytes()

    def split(self, text: str) -> list[str]:
        """The keys of text's chunks: every chunk is one marker and its key, with spaces for more markers."""
        text = text.replace(MARK, " ")
        words = text.split(" ")
        return [x[1:] for x in RUNS.findall(" " + text)] if "" in words else words

    def learn(self, keys: list[str]) -> None:
        if new := [k for k in dict.fromkeys(keys) if k not in self]:
            if len(self) + len(new) > TABLE_LIMIT:
                self.clear()
                new = list(dict.fromkeys(keys))
            for k, ids in zip(new, self.lib.encode(new, num_threads=1)):
                self[k] = np.array(ids, np.int32).tobytes() if k else self.lone

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, np.int32)
        if not self.safe:
            return np.array(self.lib.encode(text), np.int32)
        keys = self.split(text)
        try:
            found = b"".join(map(self.__getitem__, keys))
        except KeyError:
            self.learn(keys)
            found = b"".join(map(self.__getitem__, keys))
        return np.frombuffer(found, np.int32)


@cache
def chunk_table(model_file: str) -> Chunks:
    return Chunks(model_file)


def _run(batches: Iterator[pa.RecordBatch], model_file: str, text_col: str, keep: list[str], decode: bool) -> Iterator[pa.RecordBatch]:
    table = chunk_table(model_file)
    for b in pieces(batches, text_col):
        ids = [table.encode(t or "") for t in b.column(text_col).to_pylist()]
        flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
        out = [b.column(c) for c in keep] + [lists(flat, np.array([len(x) for x in ids]), pa.int32())]
        if decode:
            out.append(pa.array([table.lib.decode(x.tolist()) if len(x) else "" for x in ids], type=pa.string()))
        yield pa.RecordBatch.from_arrays(out, names=[*keep, "ids", *["decoded"] * decode])
    table.clear()
    release()


def encode(df: DataFrame, model_file: str, text_col: str = "text", decode: bool = True, keep: list[str] | None = None) -> DataFrame:
    """df's columns (or those in keep), ids array<int>, and with decode the decoded string."""
    keep = [c for c in (keep if keep is not None else df.columns) if c not in ("ids", "decoded")]
    need = list(dict.fromkeys([*keep, text_col]))
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField("ids", T.ArrayType(T.IntegerType()))] + [T.StructField("decoded", T.StringType())] * decode)
    return bounded_batches(df).select(*need).mapInArrow(partial(_run, model_file=model_file, text_col=text_col, keep=keep, decode=decode), schema)
