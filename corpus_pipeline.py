"""From raw documents to token ids: five stages, each written as Parquet and read by the next.

Defined results, stage by stage. Null, empty and letterless texts: dropped by language_id; one group
of equal texts in exact_dedup (which deletes white space first); linked with nothing in ngram_join;
of size 0, so never taken, if without words, in mixing; no ids in sentencepiece. Null or repeated
ids: rows are told apart by id and text in both dedup stages, which keep one row a group (exact: most
code points, then smallest id; near: smallest id; null last); repeated rows are separate documents
elsewhere. Very long texts are worked on whole. Null sources are a source of their own, last in
order. Empty tables give no rows. All but the last stage keep every column, whatever its name; the
last returns doc_id, lang, source, n_tokens, ids and round_trip.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwork.llm import exact_dedup, langmix, mixture, ngram_join, queries, sentencepiece_codec, tokenfile
from maskwork.llm.common import packed, unpacked


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language was found; the model learns from the rows that name theirs."""
    model = langmix.train(docs.filter(~langmix.held_out(F.col("doc_id"))))
    found = langmix.classify(packed(docs, "text"), model, keep=["_row"])
    return unpacked(found.filter("lang_pred <> 'und'"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_duplicates(docs)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group linked by 5-word shingles at 0.8."""
    return ngram_join.keep_one(docs, k=5, num=80, den=100)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each pass of the mix over a document, in training order."""
    return unpacked(mixture.training_stream(packed(docs, "doc_id", "text", "source")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every row's text, and whether decoding them gives the text back."""
    coded = sentencepiece_codec.encode(docs.select("doc_id", "lang", "source", "text"), queries.vocabulary(queries.PIECES))
    same = F.coalesce(F.col("decoded") == F.coalesce("text", F.lit("")), F.lit(False))
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("ngram_join", keep_one_of_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: Language inference and SentencePiece have no SQL form; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = tokenfile.shared_path(spark, name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
