"""Mixing sources to target weights along a time-varying curriculum (DataFrame operations only).

Targets: sources in code-point order (null last) weigh 1, 2, 3, repeating; they share
`total_share` of all words, but none takes more than `cap` times its own words: the excess goes
to the others by weight until none is above (water filling, solved in closed form by one sort
of the sources).

Curriculum: source s has the weight 1 + a(2t - 1) at training time t in [0, 1]. Its integral
t + a(t*t - t), times the target, is the cumulative demand for the source's words; inverting it
at the place of a document in its source's stream gives the document's training position. The
stream runs through the documents in a fixed hash order, again and again for repeats. Documents
are range-sorted by position.

A source may hold any part of all rows: places in a stream come from two-level running totals,
never from one task per source.

Defined results: null text has size 0; documents of size 0 are never taken; an empty table gives
no rows; repeated rows are separate documents, ordered by size and text (of rows alike in all that,
any may come first); very long texts count whole. Extra columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_digits, cut, hash_order, kept, maybe_broadcast, packed, shuffle_partitions, unpacked, with_running_total, words_of

WEIGHTS = (1, 2, 3)
SLOPES = (-0.5, 0.0, 0.5)


def source_targets(sizes: DataFrame, cap: int = 3, total_share: float = 1.0) -> DataFrame:
    """From (_source, source_size): adds _sid, weight, slope and target. One row per source."""
    by_name = Window.orderBy(F.col("_source").asc_nulls_last())
    s = sizes.withColumn("_sid", F.row_number().over(by_name) - 1)
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("_sid") % len(values) + 1).cast("int"))
    s = s.withColumn("weight", pick(WEIGHTS).cast("long")).withColumn("slope", pick(SLOPES))
    s = s.withColumn("_limit", F.lit(cap) * F.col("source_size")).withColumn("_at", F.col("_limit") / F.col("weight"))
    order = Window.orderBy("_at", "_sid")
    s = (
        s.withColumn("_all", F.sum("source_size").over(Window.partitionBy()) * F.lit(total_share))
        .withColumn("_full", F.coalesce(F.sum("_limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("_rest", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_level", (F.col("_all") - F.col("_full")) / F.col("_rest"))
    )
    # Sources are full in order of _at; the level is that of the first source that isn't.
    level = F.max(F.when(F.col("_level") <= F.col("_at"), F.col("_level"))).over(Window.partitionBy())
    return s.withColumn("target", F.least(F.col("_limit").cast("double"), level * F.col("weight"))).select("_source", "_sid", "slope", "source_size", "target")


def _mixed(df: DataFrame, id_col: str, text_col: str, source_col: str, cap: int, size_col: str | None) -> DataFrame:
    """df packed in _row, with _doc, size, source_size, target, taken and positions."""
    own = lambda c: F.col(f"_row.`{c}`")
    d = packed(df).select("_row", own(id_col).alias("_doc"), own(source_col).alias("_own"), (own(size_col) if size_col else words_of(own(text_col))).alias("size"))
    sizes = cut(d.groupBy(F.col("_own").alias("_source")).agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows")))
    n_sources, n_rows = sizes.agg(F.count("*"), F.coalesce(F.sum("_rows"), F.lit(0))).first()
    targets = cut(source_targets(sizes.drop("_rows"), cap))
    d = d.withColumn("_order", hash_order(F.col("_doc"))).withColumn("_bucket", F.substring("_order", 1, bucket_digits(n_rows)))
    d = d.withColumn("_tie", F.crc32(F.coalesce(own(text_col), F.lit("")).cast("binary")) if text_col in df.columns else F.lit(0))
    d = d.join(maybe_broadcast(targets, n_sources), F.col("_own").eqNullSafe(F.col("_source")))
    d = with_running_total(d, "_sid", ["_order", "size", "_tie"], "_bucket", F.col("size"), "_before")
    want, whole = F.col("_want"), F.col("source_size")
    passes = F.when(F.col("size") > 0, F.floor((want - F.col("_before") - 1) / whole) + 1).otherwise(0)
    y = lambda j: (j * whole + F.col("_before")) / want
    a = F.col("slope")
    invert = lambda v: 2 * v / ((1 - a) + F.sqrt((1 - a) * (1 - a) + 4 * a * v))
    d = d.withColumn("_want", F.round("target").cast("long")).withColumn("_q", F.when(whole > 0, F.floor(want / whole)).otherwise(F.lit(0)))
    d = d.withColumn("taken", F.col("_q") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), want - F.col("_q") * whole - F.col("_before"))))
    d = d.withColumn("_passes", passes)
    d = d.withColumn("positions", F.when(F.col("_passes") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("_passes") - 1), lambda j: invert(y(j)))).otherwise(F.array().cast("array<double>")))
    return d.select("_row", "_doc", "size", "source_size", "target", "taken", "positions")


ADDED = ("size", "source_size", "target", "taken", "positions")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cap: int = 3, size_col: str | None = None, sort: bool = True) -> DataFrame:
    """df with size, source_size, target, taken and positions (one for each, perhaps partial, pass).

    These replace columns of the same names; all others are kept, whatever their names.
    """
    d = _mixed(df, id_col, text_col, source_col, cap, size_col)
    if sort:  # by the first position; documents that aren't taken come last
        d = d.withColumn("_first", F.coalesce(F.try_element_at("positions", F.lit(1)), F.lit(2.0)))
        d = d.repartitionByRange(shuffle_partitions(df.sparkSession), "_first", "_doc").sortWithinPartitions("_first", "_doc")
    return d.select(*kept(d, *ADDED), *ADDED)


def training_stream(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The columns of df, one row per pass that the mix makes over a document, in training order.

    The last pass over a source may end inside a document; that document is then in it whole.
    """
    rows = _mixed(df, id_col, text_col, source_col, 3, None).select("_row", "_doc", F.explode("positions").alias("_position"))
    return unpacked(rows.repartitionByRange(shuffle_partitions(df.sparkSession), "_position", "_doc").sortWithinPartitions("_position", "_doc"))
