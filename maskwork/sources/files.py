"""Readers of texts, detections, mappings and rule packs, and writers of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rules import Rule, parse_pack
from .schema import MAPPING, SPAN, InvalidArgument, entity_type_column



def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as documents: doc_id (the file) and text."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), F.col("value").alias("text"))


def read_documents(spark: SparkSession, path: str, kind: str = "parquet", id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Documents of any format that Spark reads; only the two columns are scanned."""
    return spark.read.format(kind).options(**options).load(path).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def _listed(spark: SparkSession, path: str, field: str, item: T.StructType) -> DataFrame:
    """Per file the items of a JSON array, or of the array under `field` of an object."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), F.col("value").alias("json"))
    bare = F.from_json("json", T.ArrayType(item))
    inside = F.from_json("json", T.StructType([T.StructField(field, T.ArrayType(item))]))[field]
    return raw.select("doc_id", F.when(F.ltrim("json").startswith("["), bare).otherwise(inside).alias(field))


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and detections; `enabled` defaults to true and aliases of types are resolved."""
    found = _listed(spark, path, "detections", SPAN)
    fix = lambda d: F.struct(entity_type_column(d["type"]).alias("type"), *(d[f.name].alias(f.name) for f in SPAN.fields[1:-1]), F.coalesce(d["enabled"], F.lit(True)).alias("enabled"))
    return found.withColumn("detections", F.transform("detections", fix))


def read_mappings(spark: SparkSession, path: str) -> DataFrame:
    return _listed(spark, path, "mappings", MAPPING)


def read_rule_packs(spark: SparkSession, path: str) -> list[Rule]:
    """Rules of all packs under a path; packs are few and are compiled on the driver."""
    return [r for row in spark.read.text(path, wholetext=True).collect() for r in parse_pack(row.value)]


def envelope(**columns: Column) -> Column:
    """A JSON object with schema_version 1."""
    return F.to_json(F.struct(F.lit(1).alias("schema_version"), *(c.alias(k) for k, c in columns.items())))


def tsv_lines(spans: Column) -> Column:
    """start, end, type, value, confidence with three decimals, and detector, one span a line."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws("\t", s["start"].cast("string"), s["end"].cast("string"), s["type"], s["value"], F.format_string("%.3f", s["confidence"]), s["detector"])), "\n")


def write_detections(df: DataFrame, path: str, kind: str = "json", key: str = "doc_id", spans: str = "spans", mode: str = "errorifexists") -> None:
    """json: one envelope a line. tsv: one span a line, after its document. Other formats: the table as it is."""
    if kind == "json":
        df.select(F.col(key), F.lit(1).alias("schema_version"), F.col(spans).alias("detections")).write.mode(mode).json(path)
    elif kind == "tsv":
        rows = df.select(F.col(key), F.explode(spans).alias("s"))
        rows.select(key, "s.start", "s.end", "s.type", "s.value", F.format_string("%.3f", "s.confidence").alias("confidence"), "s.detector").write.mode(mode).csv(path, sep="\t")
    elif kind in ("parquet", "orc"):
        df.select(key, spans).write.mode(mode).format(kind).save(path)
    else:
        raise InvalidArgument(f"unknown format {kind!r}; expected json, tsv, parquet or orc")


