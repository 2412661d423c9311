"""Exact dedup by a tree merge of sorted digest runs (DataFrame operations only).

Every input partition is one run. A run holds, for each digest, the best row so far and the
number of rows. In each round runs meet in groups of 2**ROUND_BITS (binomial exchange: run r
goes to r >> ROUND_BITS) and are merged by a sort aggregate on (run, digest); the shuffle is by
(run, digest), so that no task holds a whole run, and a digest that a third of all rows share
arrives once per run. Digests are verified by length and by a second, independent hash: rows
whose SHA-256 is equal but whose verifiers differ stay apart.

A digest with more rows than a partition's share is joined back by broadcast (no more of them than
partitions), so that its rows don't meet in one task.

Defined results: null text counts as empty; very long texts are hashed whole; all empty texts are one group. Of equal texts the
row with most code points in the original text stays, then the smallest id (null last), then
the smallest hash of the original text, then the earliest repeated row; rows are told apart by id
and text, so exactly one row of a group stays whatever ids repeat. Empty tables give no rows. Extra columns are ignored by
`duplicate_groups` and kept by `drop_duplicates`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, cut, hot_keys, spread_join, text_key, without_rows

ROUND_BITS = 4
KEY = ["_sha", "_bytes", "_check"]


def normalised(text):
    return F.translate(F.coalesce(text, F.lit("")), ASCII_SPACE, "")


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Slim rows: id, code points and key of the original, SHA-256 of the normalised text and two verifiers."""
    text = F.col(f"`{text_col}`")
    return (
        df.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.length(text), F.lit(0)).alias("_len"), text_key(text).alias("_key"), normalised(text).alias("_norm"))
        .select("_id", "_len", "_key", F.sha2(F.col("_norm").cast("binary"), 256).alias("_sha"), F.octet_length("_norm").alias("_bytes"), F.xxhash64("_norm").alias("_check"))
        .withColumn("_row", F.monotonically_increasing_id())
    )


def tree_merge(rows: DataFrame, runs: int) -> DataFrame:
    """KEY, best (the row that stays) and n, from slim rows whose column _run numbers their run."""
    best = F.struct((-F.col("_len")).alias("len"), F.col("_id").isNull().alias("no_id"), F.col("_id").alias("id"), F.col("_key").alias("key"), F.col("_row").alias("row"))
    merged = rows.groupBy("_run", *KEY).agg(F.min(best).alias("best"), F.count("*").alias("n"))
    while runs > 1:
        runs = (runs + (1 << ROUND_BITS) - 1) >> ROUND_BITS
        merged = merged.withColumn("_run", F.shiftright("_run", ROUND_BITS)).groupBy("_run", *KEY).agg(F.min("best").alias("best"), F.sum("n").alias("n"))
    return merged.drop("_run")


def decided(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The slim rows with best and n of their group; both null for a row without a copy."""
    slim = cut(digests(df, id_col, text_col))
    runs = max(1, slim.rdd.getNumPartitions())
    merged = tree_merge(slim.withColumn("_run", F.spark_partition_id()), runs)
    groups = cut(merged.filter("n > 1"))  # a row without a copy needs no partner
    return spread_join(slim, groups, KEY, hot_keys(groups, "n", slim.count()))


def duplicate_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: id, keep_id, group_size, kept, text_sha256."""
    return decided(df, id_col, text_col).select(
        F.col("_id").alias(id_col),
        F.when(F.col("n").isNull(), F.col("_id")).otherwise(F.col("best.id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).alias("group_size"),
        (F.col("n").isNull() | (F.col("best.row") == F.col("_row"))).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def drop_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df without its dropped rows, all columns kept."""
    dropped = decided(df, id_col, text_col).filter("n is not null and best.row <> _row")
    other = ~(F.col("_id").eqNullSafe(F.col("best.id")) & (F.col("_key") == F.col("best.key")))
    gone = cut(dropped.select(F.col("_id").alias("id"), F.col("_key").alias("key"), other.alias("whole")).distinct())
    return without_rows(df, gone, id_col, text_col)
