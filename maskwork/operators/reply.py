"""Which document a reply answers: an inverted index with rarity weights, by joins.

Texts are indexed row by row (labels, words, words around each label); all matching is joins and
aggregations over the exploded index, so the number of documents and replies may be large.
"""

from __future__ import annotations

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.schema import ALIASES, ENTITY_TYPES
from .ledger import MANGLED, canonical, utf16

_WORD = regex.compile(r"[\p{L}\p{N}]{3,}")
_LABEL = regex.compile(r"[a-z]+(?:_[a-z]+)*_[0-9]+")
#: How far a label's context reaches, in UTF-16 units and words; when another document fits better.
BEFORE_UNITS, BEFORE_WORDS, AFTER_UNITS, AFTER_WORDS = 40, 3, 25, 2
BETTER_FACTOR, BETTER_MARGIN = 2.0, 3.0

INDEX = T.StructType([T.StructField("labels", T.ArrayType(T.StringType())), T.StructField("words", T.ArrayType(T.StringType())), T.StructField("contexts", T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("words", T.ArrayType(T.StringType()))])))])
_INDEX_PA = pa.struct([("labels", pa.list_(pa.string())), ("words", pa.list_(pa.string())), ("contexts", pa.list_(pa.struct([("label", pa.string()), ("words", pa.list_(pa.string()))])))])


def label(candidate: str) -> str | None:
    """person_1 for [PERSON_1], [person 1] or PERSON_1; None for what is no numbered label."""
    form = canonical(candidate)
    return form if form and _LABEL.fullmatch(form) else None


def words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def _reach(text: str, at: int, units: int, step: int) -> int:
    """The place at most so many UTF-16 units from at, backwards or forwards, between whole characters."""
    while at > 0 if step < 0 else at < len(text):
        width = utf16(text[at - 1] if step < 0 else text[at])
        if width > units:
            break
        units -= width
        at += step
    return at


def index_text(text: str) -> dict:
    """Labels, words outside labels, and the words around each label, in reading order."""
    spans = [(name, m.start(), m.end()) for m in MANGLED.finditer(text) if (name := label(m[0]))]
    plain, at = [], 0
    for _, a, b in spans:
        plain += [text[at:a], " " * (b - a)]
        at = b
    bare = "".join(plain) + text[at:]
    around: dict[str, list[str]] = {}
    for name, a, b in spans:
        own = around.setdefault(name, [])
        own += words(bare[_reach(bare, a, BEFORE_UNITS, -1) : a])[-BEFORE_WORDS:]
        own += words(bare[b : _reach(bare, b, AFTER_UNITS, 1)])[:AFTER_WORDS]
    return {"labels": list(around), "words": list(dict.fromkeys(words(bare))), "contexts": [{"label": k, "words": list(dict.fromkeys(v))} for k, v in around.items()]}


def _index_batch(texts: pa.Array) -> pa.Array:
    return pa.array([index_text(t or "") for t in texts.to_pylist()], _INDEX_PA)


def _label_batch(names: pa.Array) -> pa.Array:
    return pa.array([[x for n in own or () if (x := label(n))] for own in names.to_pylist()], pa.list_(pa.string()))


def with_index(df: DataFrame, text_col: str) -> DataFrame:
    return df.withColumn("_index", F.arrow_udf(_index_batch, INDEX)(F.col(text_col)))


def reply_check(replies: DataFrame, candidates: DataFrame) -> DataFrame:
    """replies (reply_id, reply, id) against candidates (id, ord, text, placeholders).

    Returns reply_id, unknown, invented and better_match for every reply. Labels that no document
    issues, or whose number is above the document's highest, were invented; of documents that fit
    equally well the first by ord wins.
    """
    docs = with_index(candidates, "text").withColumn("_labels", F.arrow_udf(_label_batch, T.ArrayType(T.StringType()))(F.col("placeholders")))
    r = with_index(replies, "reply").join(candidates.select(F.col("id").alias("_known")).distinct(), F.col("id") == F.col("_known"), "left")
    live = r.filter(F.col("_known").isNotNull() & (F.size("_index.labels") > 0))
    n = candidates.agg(F.count("*").alias("n"))

    doc_words = docs.select(F.col("id").alias("doc"), F.explode("_index.words").alias("word"))
    rarity = doc_words.groupBy("word").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).select("word", F.log((F.col("n") + 1.0) / (F.col("df") + 1.0)).alias("idf"))  # n is one row
    reply_words = live.select("reply_id", F.posexplode("_index.words").alias("at", "word"))
    shared = reply_words.join(rarity, "word").join(doc_words, "word").groupBy("reply_id", "doc").agg(F.array_sort(F.collect_list(F.struct("at", "idf"))).alias("w"))
    shared = shared.select("reply_id", "doc", "w")

    contexts = lambda d, key: d.select(F.col(key), F.explode("_index.contexts").alias("c")).select(key, F.col("c.label").alias("label"), F.explode("c.words").alias("word"))
    near = contexts(live, "reply_id").join(contexts(docs, "id").withColumnRenamed("id", "doc"), ["label", "word"]).groupBy("reply_id", "doc").agg(F.count("*").alias("near"))
    score = shared.join(near, ["reply_id", "doc"], "full").select("reply_id", "doc", F.aggregate(F.coalesce("w", F.array().cast("array<struct<at:int,idf:double>>")), F.coalesce("near", F.lit(0)).cast("double"), lambda a, x: a + x["idf"]).alias("score"))

    doc_labels = docs.select(F.col("id").alias("doc"), F.explode(F.array_distinct("_labels")).alias("label"))
    reply_labels = live.select("reply_id", "id", F.posexplode("_index.labels").alias("at", "label"), F.size("_index.labels").alias("all"))
    hits = reply_labels.join(doc_labels, "label").groupBy("reply_id", "doc").agg(F.count("*").alias("hits"))
    fits = score.join(hits, ["reply_id", "doc"], "full").join(live.select("reply_id", "id", F.size("_index.labels").alias("all")), "reply_id")
    fits = fits.select("reply_id", "id", "doc", F.coalesce("score", F.lit(0.0)).alias("score"), (F.col("all") - F.coalesce("hits", F.lit(0))).alias("missing"), "all")
    own = live.select("reply_id", "id").join(fits.filter("doc = id").select("reply_id", F.col("score").alias("own_score"), F.col("missing").alias("own_missing")), "reply_id", "left")
    own = own.join(live.select("reply_id", F.size("_index.labels").alias("all")), "reply_id").select("reply_id", F.coalesce("own_score", F.lit(0.0)).alias("own_score"), F.coalesce("own_missing", F.col("all")).alias("own_missing"))
    other = fits.filter("doc <> id").join(own, "reply_id").join(candidates.select(F.col("id").alias("doc"), "ord"), "doc")
    good = ((F.col("missing") < F.col("own_missing")) & (F.col("score") >= F.col("own_score"))) | ((F.col("missing") <= F.col("own_missing")) & (F.col("score") >= BETTER_FACTOR * F.col("own_score")) & (F.col("score") - F.col("own_score") >= BETTER_MARGIN))
    better = other.filter(good).groupBy("reply_id").agg(F.min_by("doc", F.struct((-F.col("score")).alias("s"), F.col("ord"))).alias("better_match"))

    kind, number = F.regexp_extract("label", r"\A(.*)_[0-9]+\z", 1), F.regexp_extract("label", r"([0-9]+)\z", 1)
    count = F.coalesce(number.try_cast("decimal(38,0)"), F.lit("9" * 38).cast("decimal(38,0)"))
    highest = doc_labels.withColumn("of", kind).groupBy("doc", "of").agg(F.max(count).alias("highest"))
    missing = reply_labels.join(doc_labels, (F.col("id") == doc_labels["doc"]) & (reply_labels["label"] == doc_labels["label"]), "left_anti").withColumn("kind", kind).withColumn("number", count)
    missing = missing.join(highest, (F.col("id") == F.col("doc")) & (F.col("kind") == F.col("of")), "left")
    issued = F.upper(F.col("kind")).isin([*ENTITY_TYPES, *ALIASES])
    invented = ~issued | ((F.coalesce("highest", F.lit(0)) > 0) & (F.col("number") > F.col("highest")))
    told = missing.select("reply_id", "at", F.concat(F.lit("["), F.upper("label"), F.lit("]")).alias("shown"), invented.alias("made_up"))
    pick = lambda made: F.transform(F.array_sort(F.collect_list(F.when(F.col("made_up") == made, F.struct("at", "shown")))), lambda x: x["shown"])
    listed = told.groupBy("reply_id").agg(pick(False).alias("unknown"), pick(True).alias("invented"))
    none = F.array().cast("array<string>")
    return replies.select("reply_id").join(listed, "reply_id", "left").join(better, "reply_id", "left").select("reply_id", F.coalesce("unknown", none).alias("unknown"), F.coalesce("invented", none).alias("invented"), "better_match")


def word_rarity(docs: DataFrame, key: str, text_col: str) -> DataFrame:
    """word, df and idf over the words of three letters or more of all texts."""
    from ..functions.text import words_of

    n = docs.agg(F.count("*").alias("n"))
    held = docs.select(key, F.explode(F.array_distinct(words_of(F.col(text_col)))).alias("word"))
    return held.groupBy("word").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).select("word", "df", F.log((F.col("n") + 1.0) / (F.col("df") + 1.0)).alias("idf"))

