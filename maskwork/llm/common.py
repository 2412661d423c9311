"""What the operators of this subpackage share: checkpoints, words, and distributed running totals."""

from __future__ import annotations

import math
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
ASCII_SPACE = " \t\n\x0b\x0c\r"

#: Tables of a few short columns may be broadcast up to so many rows (tens of MB); above it a
#: shuffled join does the same.
BROADCAST_ROWS = 200_000


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; only a local master may do without, with a temporary folder."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="ckpt-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Arrow batches sent to Python hold at most so many bytes, which bounds the workers' memory.
BATCH_BYTES = 16 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """df, whose session from now on sends Python no batches larger than BATCH_BYTES (one row at least)."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(df.sparkSession._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()) > BATCH_BYTES:
        df.sparkSession.conf.set(key, f"{BATCH_BYTES}b")
    return df


def packed(df: DataFrame, *keys: str) -> DataFrame:
    """keys and, in the struct _row, all columns of df: other columns then clash with nothing."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row"), *(F.col(f"`{k}`") for k in keys))


def unpacked(df: DataFrame) -> DataFrame:
    return df.select("_row.*")


def kept(df: DataFrame, *new: str) -> list[Column]:
    """The columns of a packed frame's _row, without those that `new` ones replace."""
    return [F.col(f"_row.`{f.name}`") for f in df.schema["_row"].dataType.fields if f.name not in new]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast df only when its counted rows are within the bound."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def hot_keys(counts: DataFrame, column: str, total: int) -> DataFrame:
    """The keys of counts that hold more than a partition's share of total rows: fewer than there are shuffle partitions."""
    return counts.filter(F.col(column) > total / shuffle_partitions(counts.sparkSession))


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame) -> DataFrame:
    """Left join with right, unique by keys and without nulls there; rows of hot keys don't meet in one task.

    hot has some rows of right, no more than shuffle partitions (`hot_keys`), and is broadcast.
    Rows that it serves go to the shuffled join under salts, where they find nothing.
    """
    values = [c for c in right.columns if c not in keys]
    n = shuffle_partitions(left.sparkSession)
    served = F.broadcast(hot.select(*keys, F.struct(*values).alias("_hot")))
    salt = F.when(F.col("_hot").isNull(), F.lit(0)).otherwise(1 + F.pmod(F.monotonically_increasing_id(), F.lit(n))).cast("int")
    left = left.join(served, keys, "left").withColumn("_salt", salt)
    right = right.select(*keys, F.lit(0).alias("_salt"), F.struct(*values).alias("_cold"))
    out = left.join(right, [*keys, "_salt"], "left").withColumn("_found", F.coalesce("_hot", "_cold"))
    return out.select(*(c for c in out.columns if c not in ("_hot", "_cold", "_salt", "_found")), *(F.col(f"_found.{c}").alias(c) for c in values))


def split_join(left: DataFrame, right: DataFrame, key: str, rows: int, counted: DataFrame | None = None) -> DataFrame:
    """Inner join with right, unique by key and wide; a key that many of left's rows hold is split.

    rows is the number of left's rows; counted, where given, has left's keys at less cost. Keys with
    more than a partition's share of rows are dealt under as many salts as they have such shares,
    and right's row is sent once to each: all copies together are fewer than twice the partitions.
    """
    n = shuffle_partitions(left.sparkSession)
    share = max(64, rows // n)
    hot = cut((left if counted is None else counted).groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > share).select(key, F.ceil(F.col("_n") / share).cast("int").alias("_salts")))
    salts = F.coalesce("_salts", F.lit(1))
    left = left.join(F.broadcast(hot), key, "left").withColumn("_salt", F.pmod(F.monotonically_increasing_id(), salts).cast("int")).drop("_salts")
    right = right.join(F.broadcast(hot), key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return left.join(right, [key, "_salt"]).drop("_salt")


def text_key(text: Column) -> Column:
    """A 64-bit hash of a text; null counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def without_rows(df: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """df without the rows named in gone (id, key of the text, whole); all columns kept.

    Where `whole` is false, one of the rows that repeat the id and the text stays.
    """
    d = packed(df).withColumn("_id", F.col(f"_row.`{id_col}`")).withColumn("_key", text_key(F.col(f"_row.`{text_col}`")))
    named = maybe_broadcast(gone.select(F.col("id").alias("_gid"), F.col("key").alias("_gkey"), "whole"), gone.count())
    marked = d.join(named, F.col("_id").eqNullSafe(F.col("_gid")) & (F.col("_key") == F.col("_gkey")), "left")
    stay = marked.filter("whole is null")
    if not gone.filter("not whole").isEmpty():
        stay = stay.unionByName(marked.filter("not whole").dropDuplicates(["_id", "_key"]))
    return unpacked(stay)


def words_of(text: Column) -> Column:
    """Number of words of text; null has none."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))), F.lit(0)).cast("long")


def hash_order(doc_id: Column) -> Column:
    """A fixed pseudo-random order of documents: md5 of the id in decimal (empty for null)."""
    return F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def bucket_digits(rows: int, per_bucket: int = 4096) -> int:
    """Hex digits of hash_order that make buckets of about per_bucket rows; 256 buckets at least."""
    return max(2, math.ceil(math.log(max(rows, 1) / per_bucket, 16))) if rows > per_bucket else 2


def with_running_total(df: DataFrame, key: str, order: list[str], bucket: str, value: Column, out: str) -> DataFrame:
    """Add out: the total of value over the rows of the same key that come before, by (bucket, order).

    Two levels: totals of (key, bucket) are summed first, so that no task holds a whole key;
    a window then runs inside each bucket. key and bucket must not be null.
    """
    df = df.withColumn("_value", value.cast("long"))
    totals = df.groupBy(key, bucket).agg(F.sum("_value").alias("_total"))
    before = Window.partitionBy(key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(key, bucket, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(key, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.join(offsets, [key, bucket])
        .withColumn(out, F.col("_offset") + F.coalesce(F.sum("_value").over(inside), F.lit(0)))
        .drop("_value", "_offset")
    )
