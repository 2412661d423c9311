"""The operators over DataFrames: detect, process, merge, anonymize, restore, chunk, regions, languages.

Each adds columns to a table of documents and leaves the rest alone. Full rule packs and the
heuristics that walk a text from left to right run in one Arrow pass over (text, model spans,
earlier mappings); no operator here shuffles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import asdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import OffsetIndex
from ..sources.rules import Rule, RuleSelection, bundled
from ..sources.schema import ENTITY_TYPES, MAPPINGS, PRIORITIES, RANGES, REPLACEMENTS, SPANS, InvalidArgument, Unsupported, entity_type
from .chunks import chunks
from .ledger import Ledger, anonymise
from .ledger import restore as restore_text
from .review import Policy, merge as merge_spans, settle
from .scan import ListIndex, Span, dictionary_spans, list_spans, rule_spans

Detector = Callable[[str], Iterable[Span]]


class Document:
    """A text with its offsets, and spans to and from their outer form."""

    def __init__(self, text: str, unit: str = "utf8") -> None:
        self.text, self.unit, self.index = text, unit, OffsetIndex(text)

    def size(self, s: Span) -> int:
        return int(self.index.u8[s.end] - self.index.u8[s.start])

    def out(self, point: int) -> int:
        return point if self.unit == "codepoint" else int((self.index.u8 if self.unit == "utf8" else self.index.u16)[point])

    def bounds(self, start: int, end: int, what: str) -> tuple[int, int]:
        if end <= start:
            raise InvalidArgument(f"{what} has invalid range {start}..{end}")
        a, b = self.index.point(start, self.unit), self.index.point(end, self.unit)
        total = self.out(len(self.text))
        for at, k in ((start, a), (end, b)):
            if at > total:
                raise InvalidArgument(f"{what} offset {at} is out of bounds")
            if k < 0:
                raise InvalidArgument(f"{what} offset {at} is not a character boundary")
        return a, b

    def read(self, spans: Iterable[dict] | None, strict: bool = True) -> list[Span]:
        out = []
        for i, d in enumerate(spans or ()):
            a, b = self.bounds(d["start"], d["end"], f"detection {i}")
            kind = entity_type(d["type"])
            if kind is None or d["source"] not in PRIORITIES:
                raise InvalidArgument(f"detection {i} has unknown type {d['type']!r} or source {d['source']!r}; types are {', '.join(ENTITY_TYPES)}")
            if strict and d.get("value") is not None and d["value"] != self.text[a:b]:
                raise InvalidArgument(f"detection {i} value is not the text at {d['start']}..{d['end']}")
            out.append(Span(kind, a, b, d["confidence"], d["detector"], d["source"], d["enabled"] is not False))
        return out

    def write(self, spans: Iterable[Span]) -> list[dict]:
        return [asdict(s) | {"value": self.text[s.start : s.end], "start": self.out(s.start), "end": self.out(s.end)} for s in spans]


def _null(column: str | None, kind: T.DataType) -> Column:
    return F.col(column) if column else F.lit(None).cast(kind)


def _rows(*columns: pa.Array) -> Iterable[tuple]:
    return zip(*(c.to_pylist() for c in columns))


_SPANS_PA = pa.list_(pa.struct([("type", pa.string()), ("value", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("confidence", pa.float64()), ("detector", pa.string()), ("source", pa.string()), ("enabled", pa.bool_())]))
_MAPPINGS_PA = pa.list_(pa.struct([("original", pa.string()), ("placeholder", pa.string()), ("type", pa.string())]))
_REPLACEMENTS_PA = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("placeholder", pa.string())]))
_RANGES_PA = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_ANON = T.StructType([T.StructField("text", T.StringType()), T.StructField("mappings", MAPPINGS), T.StructField("replacements", REPLACEMENTS)])
_ANON_PA = pa.struct([("text", pa.string()), ("mappings", _MAPPINGS_PA), ("replacements", _REPLACEMENTS_PA)])


def candidates_of(text: str, rules: Sequence[Rule], dictionary: Iterable[str], lists: ListIndex | None, detectors: Iterable[Detector] = ()) -> list[Span]:
    """Spans of all detectors, in order: rules, dictionary, lists, plug-ins."""
    out = rule_spans(text, rules) + dictionary_spans(text, dictionary)
    if lists:
        out += list_spans(text, lists)
    for d in detectors:
        out += d(text)
    return out


#: Names of all lists that one detect may hold: they are broadcast. Longer lists are joined (`native.list_frame`).
MOST_NAMES = 1_000_000


def finder(spark: SparkSession, *, regions: Iterable[str] | None = None, selection: RuleSelection | None = None, rules: Sequence[Rule] | None = None, dictionary: Iterable[str] = (), never_hide: Iterable[str] = (), lists: Iterable[tuple[str, Sequence[str]]] = (), detectors: Iterable[Detector] = (), policy: Policy | None = None, raw: bool = False, offset_unit: str = "utf8") -> Callable[[str, list[dict] | None], tuple[Document, list[Span]]]:
    """What detect does with one text and its model spans."""
    rules = list(bundled(regions, selection) if rules is None else rules)
    dictionary, never_hide, detectors, policy = list(dictionary), list(never_hide), list(detectors), policy or Policy()
    lists = [(kind, list(names)) for kind, names in lists]
    if (n := sum(len(names) for _, names in lists)) > MOST_NAMES:
        raise InvalidArgument(f"{n} names in lists; join more than {MOST_NAMES} with native.list_frame")
    index = spark.sparkContext.broadcast(ListIndex(lists)) if lists else None

    def find(text: str, model: list[dict] | None) -> tuple[Document, list[Span]]:
        doc = Document(text, offset_unit)
        found = candidates_of(text, rules, dictionary, index.value if index else None, detectors) + doc.read(model)
        if raw:
            return doc, found
        if message := policy.check(doc.out(len(text)), lambda at: doc.index.point(at, offset_unit) >= 0):
            raise InvalidArgument(message)
        ranges = None if policy.ranges is None else [(doc.index.point(a, offset_unit), doc.index.point(b, offset_unit)) for a, b in policy.ranges]
        return doc, settle(text, found, doc.size, never_hide, policy, ranges)

    return find


def hidden(doc: Document, spans: Iterable[Span], previous: list[dict] | None) -> dict:
    """The anonymized struct of one text."""
    ledger = Ledger().load((m["original"], m["placeholder"], m["type"]) for m in previous or ())
    new, done = anonymise(doc.text, [s for s in spans if s.enabled], ledger)
    return {"text": new, "mappings": ledger.mappings(), "replacements": [{"start": doc.out(a), "end": doc.out(b), "placeholder": p} for a, b, p in done]}


def detect(df: DataFrame, text_col: str = "text", *, model_col: str | None = None, out: str = "spans", **options) -> DataFrame:
    """df with the spans that count in each text (with raw: all candidates). Null text has none.

    options: regions, selection, rules, dictionary, never_hide, lists, detectors, policy, raw, offset_unit (see `finder`).
    """
    find = finder(df.sparkSession, **options)

    def one(text: str | None, model: list[dict] | None) -> list[dict] | None:
        if text is None:
            return None
        doc, found = find(text, model)
        return doc.write(found)

    def batch(texts: pa.Array, models: pa.Array) -> pa.Array:
        return pa.array([one(*r) for r in _rows(texts, models)], _SPANS_PA)

    return df.withColumn(out, F.arrow_udf(batch, SPANS)(F.col(text_col), _null(model_col, SPANS)))


def anonymize(df: DataFrame, text_col: str = "text", spans_col: str = "spans", previous_col: str | None = None, offset_unit: str = "utf8", out: str = "anonymized") -> DataFrame:
    """df with a struct of the anonymized text, the mappings (earlier ones first) and the replacements."""

    def one(text: str | None, spans: list[dict] | None, previous: list[dict] | None) -> dict | None:
        if text is None:
            return None
        doc = Document(text, offset_unit)
        return hidden(doc, doc.read([s for s in spans or () if s["enabled"] is not False]), previous)

    def batch(texts: pa.Array, spans: pa.Array, previous: pa.Array) -> pa.Array:
        return pa.array([one(*r) for r in _rows(texts, spans, previous)], _ANON_PA)

    return df.withColumn(out, F.arrow_udf(batch, _ANON)(F.col(text_col), F.col(spans_col), _null(previous_col, MAPPINGS)))


def process(df: DataFrame, text_col: str = "text", previous_col: str | None = None, model_col: str | None = None, **options) -> DataFrame:
    """detect and anonymize in one pass over the texts: df with spans and anonymized."""
    find = finder(df.sparkSession, **options)

    def one(text: str | None, model: list[dict] | None, previous: list[dict] | None) -> dict:
        if text is None:
            return {"spans": None, "anonymized": None}
        doc, found = find(text, model)
        return {"spans": doc.write(found), "anonymized": hidden(doc, found, previous)}

    def batch(texts: pa.Array, models: pa.Array, previous: pa.Array) -> pa.Array:
        return pa.array([one(*r) for r in _rows(texts, models, previous)], pa.struct([("spans", _SPANS_PA), ("anonymized", _ANON_PA)]))

    kind = T.StructType([T.StructField("spans", SPANS), T.StructField("anonymized", _ANON)])
    got = df.withColumn("_processed", F.arrow_udf(batch, kind)(F.col(text_col), _null(model_col, SPANS), _null(previous_col, MAPPINGS)))
    return got.withColumns({"spans": F.col("_processed.spans"), "anonymized": F.col("_processed.anonymized")}).drop("_processed")


def merge(df: DataFrame, text_col: str = "text", spans_col: str = "spans", offset_unit: str = "utf8", out: str = "merged") -> DataFrame:
    """Spans after a reviewer's changes: overlaps resolved, enabled values found elsewhere in the text."""

    def batch(texts: pa.Array, spans: pa.Array) -> pa.Array:
        got = []
        for text, own in _rows(texts, spans):
            doc = Document(text or "", offset_unit)
            got.append(None if text is None else doc.write(merge_spans(text, doc.read(own), doc.size)))
        return pa.array(got, _SPANS_PA)

    return df.withColumn(out, F.arrow_udf(batch, SPANS)(F.col(text_col), F.col(spans_col)))


def restore(df: DataFrame, text_col: str = "text", mappings_col: str = "mappings", out: str = "restored") -> DataFrame:
    """Placeholders, also altered ones, replaced by their originals."""

    def batch(texts: pa.Array, mappings: pa.Array) -> pa.Array:
        got = [None if t is None else restore_text(t, Ledger().load((m["original"], m["placeholder"], m["type"]) for m in own or ())) for t, own in _rows(texts, mappings)]
        return pa.array(got, pa.string())

    return df.withColumn(out, F.arrow_udf(batch, T.StringType())(F.col(text_col), F.col(mappings_col)))


def chunk(df: DataFrame, text_col: str = "text", taken_col: str | None = None, offset_unit: str = "utf8", out: str = "chunks") -> DataFrame:
    """One-tap chunks of each text outside the taken ranges."""

    def batch(texts: pa.Array, taken: pa.Array) -> pa.Array:
        got = []
        for text, own in _rows(texts, taken):
            if text is None:
                got.append(None)
                continue
            doc = Document(text, offset_unit)
            ranges = [doc.bounds(r["start"], r["end"], f"taken {i}") for i, r in enumerate(own or ())]
            got.append([{"start": doc.out(a), "end": doc.out(b)} for a, b in chunks(text, ranges)])
        return pa.array(got, _RANGES_PA)

    return df.withColumn(out, F.arrow_udf(batch, RANGES)(F.col(text_col), _null(taken_col, RANGES)))


#: Rule regions of a language, and those taken when none is known.
REGIONS = {
    "zh": ["cn"], "en": ["us", "gb", "ie"], "fr": ["fr", "be", "ch"], "es": ["es"], "de": ["de", "at", "ch"], "it": ["it", "ch"], "pt": ["pt"], "nl": ["nl", "be"],
    "pl": ["pl"], "sv": ["se"], "no": ["no"], "nb": ["no"], "nn": ["no"], "da": ["dk"], "fi": ["fi"], "ja": ["jp"], "hi": [],
}
DEFAULT_REGIONS = ["us", "gb", "fr", "es"]


def regions_of(languages: Column, text: Column) -> Column:
    """Sorted rule regions for language tags; Han script adds China unless Japanese is named."""
    primary = F.transform(languages, lambda t: F.lower(F.regexp_extract(t, r"\A[^-_]*", 0)))
    table = F.create_map(*(x for k, v in REGIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))))
    known = F.filter(primary, lambda t: t.isin(list(REGIONS)))
    found = F.flatten(F.transform(known, lambda t: F.element_at(table, t)))
    base = F.when(F.size(known) == 0, F.array(*map(F.lit, DEFAULT_REGIONS))).otherwise(found)
    china = F.when(text.rlike(r"\p{IsHan}") & ~F.array_contains(primary, "ja"), F.array(F.lit("cn"))).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.concat(base, china)))


def regions(df: DataFrame, languages_col: str, text_col: str = "text", out: str = "regions") -> DataFrame:
    return df.withColumn(out, regions_of(F.col(languages_col), F.coalesce(F.col(text_col), F.lit(""))))


def languages(df: DataFrame, text_col: str = "text", identify: Callable[[str], Sequence[str]] | None = None, out: str = "languages") -> DataFrame:
    """ISO-639-1 codes by a plugged-in identifier, most likely first."""
    if identify is None:
        raise Unsupported("language identification needs an identifier: pass identify=")

    def batch(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else list(identify(t)) for t in texts.to_pylist()], pa.list_(pa.string()))

    return df.withColumn(out, F.arrow_udf(batch, T.ArrayType(T.StringType()))(F.col(text_col)))
