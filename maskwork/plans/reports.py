"""Counts of what was found, by type, language, source and document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_type(df: DataFrame, group: str, key: str = "doc_id", spans: str = "spans") -> DataFrame:
    """Spans and documents for every combination of group and type, with totals as 'all'."""
    rows = df.select(key, group, F.explode(F.transform(spans, lambda s: s["type"])).alias("type"))
    return rows.cube(group, "type").agg(F.count("*").alias("spans"), F.countDistinct(key).alias("documents")).select(F.coalesce(group, F.lit("all")).alias(group), F.coalesce("type", F.lit("all")).alias("type"), "spans", "documents")


def by_document(df: DataFrame, group: str, spans: str = "spans") -> DataFrame:
    """Documents, those with spans, and spans by group. Aggregated before the shuffle."""
    n = F.size(spans)
    return df.groupBy(group).agg(F.count("*").alias("documents"), F.count(F.when(n > 0, 1)).alias("affected"), F.sum(n).cast("long").alias("spans"))
