"""The operators as SQL functions: after `register(spark)`

select mask_regions(array('fr'), text), mask_check('luhn', value), mask_call('process', request) ...
select d.doc_id, s.* from documents d, lateral mask_spans(d.text) s
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.validators import CHECKS, check
from ..operators.engine import Document, candidates_of
from ..operators.ledger import Ledger, anonymise, restore
from ..operators.review import settle
from ..sources.rules import bundled
from . import api


def _spans(text: str, regions: list[str] | None = None) -> tuple[Document, list]:
    doc = Document(text)
    return doc, settle(text, candidates_of(text, bundled(regions), (), None), doc.size)


def _check(names: pa.Array, values: pa.Array) -> pa.Array:
    return pa.array([None if v is None else n in CHECKS and check(n, v) for n, v in zip(names.to_pylist(), values.to_pylist())], pa.bool_())


def _call(names: pa.Array, requests: pa.Array) -> pa.Array:
    return pa.array([None if r is None else api.call(n, r) for n, r in zip(names.to_pylist(), requests.to_pylist())], pa.string())


def _anonymize(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else anonymise(t, _spans(t)[1], Ledger())[0] for t in texts.to_pylist()], pa.string())


def _restore(texts: pa.Array, mappings: pa.Array) -> pa.Array:
    return pa.array([None if t is None else restore(t, Ledger().load((m["original"], m["placeholder"], m["type"]) for m in own or ())) for t, own in zip(texts.to_pylist(), mappings.to_pylist())], pa.string())


def _regions(tags: pa.Array, texts: pa.Array) -> pa.Array:
    return pa.array([api.region_names(own or [], t or "") for own, t in zip(tags.to_pylist(), texts.to_pylist())], pa.list_(pa.string()))


class SpanTable:
    """Rows of a text's spans."""

    def eval(self, text: str) -> Iterator[tuple]:
        if text is not None:
            doc, found = _spans(text)
            for s in doc.write(found):
                yield s["type"], s["value"], s["start"], s["end"], s["confidence"], s["detector"], s["source"], s["enabled"]


def register(spark: SparkSession) -> None:
    text = T.StringType()
    spark.udf.register("mask_check", F.arrow_udf(_check, T.BooleanType()))
    spark.udf.register("mask_call", F.arrow_udf(_call, text))
    spark.udf.register("mask_anonymize", F.arrow_udf(_anonymize, text))
    spark.udf.register("mask_restore", F.arrow_udf(_restore, text))
    spark.udf.register("mask_regions", F.arrow_udf(_regions, T.ArrayType(text)))
    spark.udtf.register("mask_spans", F.udtf(SpanTable, returnType="type string, value string, start int, end int, confidence double, detector string, source string, enabled boolean"))
