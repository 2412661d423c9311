"""The opN_ queries and, where DuckDB SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, langmix, line_dedup, mixture, ngram_join, quality, sentencepiece_codec, sharding, tokenfile, vector_forest

SHARDS = 40
#: Vocabulary files are read where they are installed and never copied.
TOKENIZER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_parity_sketch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_components(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op2_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), sharding.tree(SHARDS), sharding.tree(SHARDS + 1))


def op3_ranked_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenfile.shared_path(spark, "tokens")
    tokenfile.write_tokens(table(spark, sf_dir, "documents"), path, vocabulary(TOKENIZER), literal=False)
    ids = F.col("ids_le")
    return tokenfile.read_tokens(spark, path).select("doc_id", "start", (F.octet_length(ids) / 4).cast("long").alias("n_tokens"), F.crc32(ids).alias("ids_crc32"))


def op4_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    slim = docs.select("doc_id", "source", mixture.words_of(F.col("text")).alias("size"))
    mixed = mixture.mix(slim, size_col="size")
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.round(F.try_element_at("positions", F.lit(1)), 9).alias("position"))


def op5_patience_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.report(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_lines", "n_removed", "removed_words", "partners", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op6_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_forest.link(table(spark, sf_dir, "embeddings"))


def op7_mixture_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langmix.train(docs.filter(~langmix.held_out(F.col("doc_id"))))
    slim = docs.select("doc_id", langmix.held_out(F.col("doc_id")).alias("held_out"), "text")
    return langmix.classify(slim, model, keep=["doc_id", "held_out"])


def op8_ftrl_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").filter(~langmix.held_out(F.col("doc_id")))
    weights = quality.train(docs, labels)
    slim = docs.select("doc_id", langmix.held_out(F.col("doc_id")).alias("held_out"), "text")
    return quality.score(slim, weights, keep=["doc_id", "held_out"]).withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op9_tree_merge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(table(spark, sf_dir, "documents"))


def op10_sentencepiece_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = sentencepiece_codec.encode(table(spark, sf_dir, "documents"), vocabulary(PIECES), keep=["doc_id"])
    digits = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(digits.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


QUERIES = {f.__name__: f for f in (op1_parity_sketch_join, op2_hash_tree_sharding, op3_ranked_token_file, op4_curriculum_mix, op5_patience_line_dedup, op6_projection_forest, op7_mixture_language_id, op8_ftrl_quality, op9_tree_merge_dedup, op10_sentencepiece_chunks)}

ORACLES = {
    "op1_parity_sketch_join": r"""
with recursive d as (
  select row_number() over () k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents
), s as materialized (
  select distinct k, array_to_string(w[i : i + 3], ' ') g from (select k, w, unnest(range(1, greatest(len(w) - 2, 2))) i from d where len(w) > 0)
), n as materialized (
  select k, count(*) n, bit_xor(hash(g)) x from s group by k
), c as materialized (  -- equal sets are one node
  select k, n, min(k) over (partition by n, x) node from n
), t as materialized (
  select s.k, s.g, c.n from s join c on s.k = c.k and c.k = c.node
), p as materialized (
  select a.k a, b.k b from t a join t b on a.g = b.g and a.k < b.k group by a.k, b.k, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))
), e as materialized (
  select a, b from p union all select b, a from p
), r as (
  select node a, node z from c union select e.b, r.z from r join e on e.a = r.a
), m as (
  select a node, min(z) z from r group by a
), o as (
  select d.k, doc_id, c.n, m.z from d left join c on c.k = d.k left join m on m.node = c.node
)
select doc_id, coalesce(n, 0)::bigint n_shingles, case when n is null then doc_id else min(doc_id) over (partition by z) end component_id from o
""",
    "op6_projection_forest": r"""
with recursive v as (
  select row_number() over () k, vec_id, label, list_transform(embedding, lambda x: x::double) e from embeddings
), g as materialized (
  select * from v where vec_id is not null and label is not null and len(e) > 0
    and list_bool_and(list_transform(e, lambda x: x is not null and isfinite(x))) and list_bool_or(list_transform(e, lambda x: x <> 0))
), p as materialized (
  select a.k, b.k l from g a join g b on a.label = b.label and len(a.e) = len(b.e) and a.k <> b.k and list_cosine_similarity(a.e, b.e) >= 0.93
), r as (
  select k, vec_id c from g union select p.k, r.c from r join p on p.l = r.k
), m as (
  select k, min(c) c from r group by k
), n as (
  select k, count(*) n from p group by k
)
select vec_id, coalesce(n, 0)::bigint n_links, coalesce(c, vec_id) component_id, coalesce(vec_id = coalesce(c, vec_id), true) kept
from v left join m using (k) left join n using (k)
""",
    "op2_hash_tree_sharding": r"""
with crc as (
  select list_transform(range(256), lambda n: list_reduce([n::bigint, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end)) t
), d as (
  select row_number() over () k, doc_id, coalesce(doc_id::varchar, '') i, octet_length(encode(coalesce(text, ''))) + 16 size,
         xor(list_reduce([4294967295] || list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::bigint), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) c
  from documents, crc
), w as (
  select 'region' || n lab, n, 20.0::double weight, null::bigint parent from range(2) r(n)
  union all select 'region2', 2, 1.0, null
  union all select 'rack' || n, n, 5.0, n // 4 from range(8) r(n)
  union all select 'shard' || n, n, 1.0, n // 5 from range(40) r(n)
), v as (
  select k, lab, n, parent, -ln((('0x' || substr(md5(lab || '/' || i), 1, 12))::bigint + 0.5) / 281474976710656) / weight x from d, w
), r as (
  select k, arg_min(n, (x, n)) filter (n < 2) region, arg_min(n, (x, n)) grown from v where lab like 'region%' group by k
), q as (
  select r.k, region, grown, arg_min(n, (x, n)) rack from r join v on r.k = v.k and v.lab like 'rack%' and v.parent = region group by all
), s as (
  select q.k, region, grown, arg_min(n, (x, n)) shard from q join v on q.k = v.k and v.lab like 'shard%' and v.parent = rack group by all
), g as (
  select q.k, arg_min(n, (x, n)) shard from
    (select r.k, grown, arg_min(n, (x, n)) rack from r join v on r.k = v.k and v.lab like 'rack%' and v.parent = grown group by all) q
    join v on q.k = v.k and v.lab like 'shard%' and v.parent = rack group by all
)
select doc_id, size::bigint size, c text_crc32, 'key' law, s.shard::int shard,
       row_number() over (partition by s.shard order by md5(i), size, c) - 1 slot, coalesce(g.shard, 40)::int grown_shard
from d join s using (k) left join g using (k)
""",
    "op9_tree_merge_dedup": r"""
with d as (
  select doc_id, coalesce(length(text), 0) n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) s from documents
), r as (
  select *, first_value(doc_id) over w keep_id, count(*) over (partition by s) g, row_number() over w k from d
  window w as (partition by s order by n desc, doc_id nulls last)
)
select doc_id, keep_id, g::bigint group_size, k = 1 kept, s text_sha256 from r
""",
    "op4_curriculum_mix": r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint size,
         md5(coalesce(doc_id::varchar, '')) h from documents
), s0 as (
  select source, sum(size)::bigint z, row_number() over (order by source nulls last) - 1 i from d group by source
), s1 as (
  select *, (1 + i % 3)::bigint w, [-0.5, 0.0, 0.5][1 + (i % 3)::int]::double a, 3 * z lim, (3 * z)::double / (1 + i % 3) r from s0
), s2 as (
  select *, (sum(z) over () - coalesce(sum(lim) over (order by r, i rows between unbounded preceding and 1 preceding), 0))::double
         / sum(w) over (order by r, i rows between current row and unbounded following) lv from s1
), s3 as (
  select *, least(lim::double, max(case when lv <= r then lv end) over () * w) target from s2
), p as (
  select d.*, z, a, target, round(target)::bigint t,
         coalesce(sum(size) over (partition by i order by h, size rows between unbounded preceding and 1 preceding), 0)::bigint b
  from d join s3 on d.source is not distinct from s3.source
), q as (
  select *, case when z > 0 then t // z else 0 end k from p
), y as (
  select *, k * size + greatest(0, least(size, t - k * z - b)) taken, case when t > 0 then b::double / t end v from q
)
select doc_id, size, z source_size, target, taken::bigint taken,
       case when size > 0 and b < t then round(2 * v / ((1 - a) + sqrt((1 - a) * (1 - a) + 4 * a * v)), 9) end position
from y
""",
}
