"""The queries over the test tables and, where DuckDB SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.validators import check_column, entropy_column
from ..operators import engine, native, reply
from ..operators.review import Policy
from ..sources import files, name_lists, rules
from ..sources.schema import priority
from ..streaming import conversations
from . import api, reports, sheets


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs_of(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", *columns)


RULES = {r.id.partition(":")[2]: r for r in native.PLAIN_RULES}
TERMS = ["idiot", "moron", "clown", "the", "une", "más", "für", "avec"]


def _detect_one(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = docs_of(spark, sf_dir).withColumn("spans", native.rule_spans(F.col("text"), RULES[name]))
        return native.long_spans(d, ["doc_id"]).select("doc_id", "type", "value", "start", "end", "confidence", "source")

    query.__name__ = f"detect_{name}"
    return query


def detect_all(spark, sf_dir):
    d = native.detect_frame(docs_of(spark, sf_dir), out="spans")
    return native.long_spans(d, ["doc_id"]).select("doc_id", "type", "value", "start", "end", "confidence", "detector", "source")


def resolve_overlaps(spark, sf_dir):
    d = native.detect_frame(docs_of(spark, sf_dir)).withColumn("spans", native.resolve(F.col("candidates")))
    return native.long_spans(d, ["doc_id"]).select("doc_id", "type", "value", "start", "end", "detector", priority(F.col("source")).alias("priority"))


def policy_spans(spark, sf_dir):
    """E-mails stay readable, addresses of hosts are off, and only the first 2000 bytes are protected."""
    ranges = F.array(F.struct(F.lit(0).alias("start"), F.lit(2000).alias("end")))
    d = native.detect_frame(docs_of(spark, sf_dir)).withColumn("spans", native.resolve(native.apply_policy(F.col("candidates"), {"EMAIL": "keep", "IP": "off"}, ranges)))
    return native.long_spans(d, ["doc_id"]).select("doc_id", "type", "value", "start", "end", "enabled")


def anonymize_documents(spark, sf_dir):
    d = native.anonymise_frame(docs_of(spark, sf_dir))
    return d.select("doc_id", "anonymized", F.size("spans").cast("long").alias("n_spans"))


def placeholder_numbers(spark, sf_dir):
    d = native.detect_frame(docs_of(spark, sf_dir)).withColumn("spans", native.resolve(F.col("candidates")))
    return native.numbered(native.long_spans(d, ["doc_id"]), "doc_id").select("doc_id", "value", "type", "placeholder")


def mapping_entries(spark, sf_dir):
    d = native.anonymise_frame(docs_of(spark, sf_dir))
    return native.long_rows(d, ["doc_id"], "mappings").withColumn("ord", F.col("ord").cast("long"))


def restore_documents(spark, sf_dir):
    d = native.anonymise_frame(docs_of(spark, sf_dir))
    return d.select("doc_id", native.restore_exact(F.col("anonymized"), F.col("mappings")).alias("restored"))


def checksum_numbers(spark, sf_dir):
    """Every run of 9 to 16 digits with what the number checks say."""
    names = ["luhn", "aba", "nhs", "npi", "bsn", "pesel"]
    d = docs_of(spark, sf_dir).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\b[0-9]{9,16}\b"), F.lit(0))).alias("value"))
    return d.select("doc_id", "value", *(check_column(n, F.col("value")).alias(n) for n in names))


def secret_entropy(spark, sf_dir):
    d = docs_of(spark, sf_dir).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[0-9a-f]{40}"), F.lit(0))).alias("value"))
    return d.select("doc_id", "value", F.round(entropy_column(F.col("value")), 9).alias("bits"))


def text_lengths(spark, sf_dir):
    t = F.col("text")
    return docs_of(spark, sf_dir).select("doc_id", F.octet_length(t).cast("long").alias("utf8"), F.length(t).cast("long").alias("points"), tx.utf16_length(t).cast("long").alias("utf16"), tx.has_cjk(t).alias("cjk"), tx.has_han(t).alias("han"))


def offset_conversion(spark, sf_dir):
    """Byte offset of every line's end in UTF-16 units, and back, over whole texts."""
    ends = F.transform(tx.line_ranges(F.col("text")), lambda x: x["end"])
    d = docs_of(spark, sf_dir).select("doc_id", "text", ends.alias("utf8"))
    d = d.withColumn("utf16", tx.convert_offsets(F.col("text"), F.col("utf8"), "utf8", "utf16"))
    d = d.withColumn("back", tx.convert_offsets(F.col("text"), F.col("utf16"), "utf16", "utf8"))
    last = F.element_at("utf8", -1)
    there = tx.utf8_to_utf16(F.col("text"), last)
    d = d.select("doc_id", F.arrays_zip("utf8", "utf16", "back").alias("ends"), there.cast("long").alias("last_utf16"))
    return native.long_rows(d, ["doc_id", "last_utf16"], "ends").select("doc_id", F.col("ord").cast("long"), F.col("utf8").cast("long"), F.col("utf16").cast("long"), F.col("back").cast("long"), "last_utf16")


def ocr_zeros(spark, sf_dir):
    """Texts with every zero read as O, and repaired again."""
    d = docs_of(spark, sf_dir).select("doc_id", F.replace("text", F.lit("0"), F.lit("O")).alias("t"))
    return d.select("doc_id", F.md5(tx.zeros_for_os(F.col("t")).cast("binary")).alias("digest"))


def word_counts(spark, sf_dir):
    w = tx.words_of(F.col("text"))
    return docs_of(spark, sf_dir).select("doc_id", F.size(w).cast("long").alias("words"), F.size(tx.unique(w)).cast("long").alias("distinct_words"))


def line_table(spark, sf_dir):
    d = docs_of(spark, sf_dir).select("doc_id", F.posexplode(tx.line_ranges(F.col("text"))).alias("ord", "l"))
    return d.select("doc_id", F.col("ord").cast("long"), F.col("l.start").cast("long").alias("start"), F.col("l.end").cast("long").alias("end"), F.md5(F.col("l.value").cast("binary")).alias("digest"))


def figure_lines(spark, sf_dir):
    """Rows of figures in the lines of an order: what a table of amounts looks like."""
    line = F.concat_ws(" ", F.col("l_quantity").cast("decimal(12,2)").cast("string"), F.col("l_extendedprice").cast("decimal(12,2)").cast("string"))
    orders = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("t"))
    return orders.select("l_orderkey", F.size(tx.figure_rows(F.col("t"))).cast("long").alias("n_rows"))


def regions_by_language(spark, sf_dir):
    d = docs_of(spark, sf_dir, "lang")
    return d.select("doc_id", F.array_join(engine.regions_of(F.array("lang"), F.col("text")), ",").alias("regions"))


def dictionary_words(spark, sf_dir):
    terms = spark.createDataFrame([(t,) for t in TERMS], "term string")
    return native.dictionary_frame(docs_of(spark, sf_dir), terms).select("doc_id", "term", "n")


def dictionary_spans(spark, sf_dir):
    d = engine.detect(docs_of(spark, sf_dir), rules=[], dictionary=TERMS, raw=True)
    return native.long_spans(d, ["doc_id"]).groupBy("doc_id", F.lower("value").alias("value")).agg(F.count("*").alias("n"))


def name_list_spans(spark, sf_dir):
    """First two words of every benchmark passage as names, found by an equi-join on runs of words."""
    names = table(spark, sf_dir, "benchmark").select(F.regexp_extract("text", r"\A([\p{L}\p{N}]+ [\p{L}\p{N}]+)", 1).alias("name")).filter("name <> ''").distinct().withColumn("kind", F.lit("COMPANY"))
    return native.list_frame(docs_of(spark, sf_dir), names, "doc_id", most_words=2)


def pii_cube(spark, sf_dir):
    return reports.by_type(native.anonymise_frame(docs_of(spark, sf_dir, "lang")), "lang")


def pii_documents(spark, sf_dir):
    return reports.by_document(native.anonymise_frame(docs_of(spark, sf_dir, "lang", "source")), "source")


def label_exposure(spark, sf_dir):
    """Spans of labelled documents by quality and toxicity."""
    d = native.anonymise_frame(docs_of(spark, sf_dir)).select("doc_id", F.size("spans").alias("n"))
    return d.join(table(spark, sf_dir, "labels"), "doc_id").groupBy("quality", "toxic").agg(F.count("*").alias("documents"), F.sum("n").alias("spans"))


def page_emails(spark, sf_dir):
    d = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("html", "<[^>]*>", " ").alias("text"))
    d = d.withColumn("spans", native.detect(F.col("text"), [RULES["email"], RULES["ipv4"], RULES["phone"]]))
    return native.long_spans(d, ["page_id"]).groupBy("page_id", "type").agg(F.count("*").alias("n"))


def conversation_rarity(spark, sf_dir):
    turns = F.array_sort(F.collect_list(F.struct("turn", "text")))
    d = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda t: t["text"]), "\n").alias("text"))
    return reply.word_rarity(d, "conv_id", "text").select("word", "df", F.round("idf", 9).alias("idf"))


def span_envelopes(spark, sf_dir):
    """One tab-separated report and one JSON object per document with spans."""
    d = native.detect_frame(docs_of(spark, sf_dir)).withColumn("spans", native.resolve(F.col("candidates"))).filter(F.size("spans") > 0)
    return d.select("doc_id", files.tsv_lines(F.col("spans")).alias("report"), F.get_json_object(files.envelope(spans=F.col("spans")), "$.schema_version").alias("version"))


def rule_inventory(spark, sf_dir):
    return rules.rules_frame(spark).groupBy("region", "type", "source").agg(F.count("*").alias("rules"))


def policy_ranges(spark, sf_dir):
    """Why the range from byte 1 to 3 cannot be used in a document, if it cannot."""
    bad = native.range_error(F.col("text"), F.array(F.struct(F.lit(1).alias("start"), F.lit(3).alias("end"))))
    return docs_of(spark, sf_dir).select("doc_id", bad.alias("problem"))


def clean_names(spark, sf_dir):
    """Customer and supplier names as a company list would keep them."""
    n = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name")).union(table(spark, sf_dir, "supplier").select("s_name"))
    return n.select("name", name_lists.shape_ok(name_lists.clean(F.col("name")), F.lit(0)).alias("kept"))


# Not expressible in DuckDB's SQL: look-arounds, heuristics that walk a text, keyed state.


def process_full_rules(spark, sf_dir):
    d = engine.process(docs_of(spark, sf_dir, "lang"), regions=["us", "gb", "fr", "de", "es"])
    return d.select("doc_id", F.size("spans").alias("n_spans"), "anonymized.text", F.size("anonymized.mappings").alias("n_mappings"))


def round_trip_full(spark, sf_dir):
    d = engine.process(docs_of(spark, sf_dir), regions=["us"]).select("doc_id", "text", F.col("anonymized.text").alias("hidden"), "anonymized.mappings")
    return engine.restore(d, "hidden").select("doc_id", (F.col("restored") == F.col("text")).alias("same"))


def native_against_arrow(spark, sf_dir):
    """Spans that only one of the two detectors finds: none."""
    d = docs_of(spark, sf_dir)
    keep = lambda x: native.long_spans(x, ["doc_id"]).select("doc_id", "type", "value", "start", "end", "detector", "source")
    a = keep(native.detect_frame(d, out="spans"))
    b = keep(engine.detect(d, rules=native.PLAIN_RULES, raw=True))
    return a.exceptAll(b).withColumn("side", F.lit("native")).unionByName(b.exceptAll(a).withColumn("side", F.lit("arrow")))


def review_chunks(spark, sf_dir):
    d = engine.chunk(engine.detect(docs_of(spark, sf_dir), regions=[]), taken_col=None)
    return d.select("doc_id", F.size("chunks").alias("n_chunks"))


def review_merge(spark, sf_dir):
    d = engine.merge(engine.detect(docs_of(spark, sf_dir), regions=["us"]))
    return d.select("doc_id", F.size("merged").alias("n_spans"))


def reply_matches(spark, sf_dir):
    """Each conversation's last turn, anonymized as in its conversation, against all conversations."""
    turns = conversations.anonymize_table(table(spark, sf_dir, "conversations"), regions=["us"])
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"])
    docs = turns.groupBy("conv_id").agg(F.array_join(ordered, "\n").alias("text"), F.max_by("text", "turn").alias("last"))
    placed = F.regexp_extract_all("text", F.lit(r"\[[A-Z_]+_[0-9]+\]"), F.lit(0))
    docs = docs.select(F.col("conv_id").cast("string").alias("id"), F.col("conv_id").alias("ord"), "text", F.array_distinct(placed).alias("placeholders"), "last")
    return reply.reply_check(docs.select(F.col("id").alias("reply_id"), F.col("last").alias("reply"), "id"), docs.drop("last"))


def conversation_state(spark, sf_dir):
    return conversations.anonymize_table(table(spark, sf_dir, "conversations"), regions=[])


def json_calls(spark, sf_dir):
    request = F.to_json(F.struct(F.lit(1).alias("schema_version"), "text", F.array(F.lit("us")).alias("regions")))
    return docs_of(spark, sf_dir).select("doc_id", F.size(F.from_json(api.call_column("process", request), "mappings array<struct<original:string>>")["mappings"]).alias("n"))


def policy_full(spark, sf_dir):
    d = engine.detect(docs_of(spark, sf_dir), regions=["us"], policy=Policy.parse({"EMAIL": "keep", "CARD": "off"}), never_hide=["token"], dictionary=["idiot"])
    return native.long_spans(d, ["doc_id"]).groupBy("type", "source", "enabled").agg(F.count("*").alias("n"))


_DETECT = [_detect_one(n) for n in ("email", "ipv4", "card", "phone", "token", "long_number")]
_SQLED = [detect_all, resolve_overlaps, policy_spans, anonymize_documents, placeholder_numbers, mapping_entries, restore_documents, checksum_numbers, secret_entropy, text_lengths, offset_conversion, ocr_zeros, word_counts, line_table, figure_lines, regions_by_language, dictionary_words, dictionary_spans, name_list_spans, pii_cube, pii_documents, label_exposure, page_emails, conversation_rarity, span_envelopes, policy_ranges, clean_names]
_SHEETS = [sheets.value_checks, sheets.pack_examples, rule_inventory]
_OTHER = [process_full_rules, round_trip_full, native_against_arrow, review_chunks, review_merge, reply_matches, conversation_state, json_calls, policy_full]
QUERIES = {f.__name__: f for f in [*_DETECT, *_SQLED, *_SHEETS, *_OTHER]}


# SQL ---------------------------------------------------------------------------------------


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _octets(xs: str) -> str:
    return f"coalesce(list_sum(list_transform({xs}, lambda x: strlen(x))), 0)"


#: What the rule finds, for an engine without look-behind and possessive runs.
_PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"}


def _matches(name: str, source: str, key: str) -> str:
    """Common table expression with the accepted matches of one plain rule."""
    r = RULES[name]
    p = _q(_PATTERNS.get(name, r.pattern))
    kind = f"'{r.type}'" if r.source != "rule" else "'NUMBER'"
    return f"""
select {key}, {kind} as type, v as value, ({_octets("gs[1:i]")} + {_octets("ms[1:i-1]")})::int as start,
       ({_octets("gs[1:i]")} + {_octets("ms[1:i]")})::int as "end", {r.confidence}::double as confidence,
       '{r.id}' as detector, '{r.source}' as source, {list(RULES).index(name)} * 100000 + i as ord
from (select {key}, ms, gs, unnest(ms) v, generate_subscripts(ms, 1) i
      from (select {key}, regexp_extract_all(text, {p}) ms, string_split_regex(text, {p}) gs from {source}))
where {_CONDITIONS.get(name, "true")}"""


_DIGIT_LIST = "list_transform(string_split(v, ''), lambda x: x::int)"
_LUHN = "list_sum(list_transform(list_reverse({d}), lambda x, i: case when i % 2 = 0 then case when x > 4 then 2 * x - 9 else 2 * x end else x end)) % 10 = 0"
_ENTROPY = "round(list_sum(list_transform(list_distinct(string_split({v}, '')), lambda c: -(len(list_filter(string_split({v}, ''), lambda y: y = c)) / length({v})::double) * log2(len(list_filter(string_split({v}, ''), lambda y: y = c)) / length({v})::double))), 9)"
_CONDITIONS = {
    "card": _LUHN.format(d=_DIGIT_LIST),
    "ipv4": "list_bool_and(list_transform(string_split(v, '.'), lambda x: x::int < 256))",
    "token": _ENTROPY.format(v="v[10:49]") + " >= 3.0 and regexp_matches(v, '[a-f]')",
}
_ALL = " union all ".join(f"({_matches(n, 'documents', 'doc_id')})" for n in RULES)
_WITH_SPANS = f"with recursive c as materialized ({_ALL})"
_PRIORITY = "case source when 'validatedRule' then 30 when 'strongRule' then 25 else 10 end"


def _greedy(source: str) -> str:
    """Tables that keep, span by span in rank order, what overlaps nothing kept before."""
    return f"""
rk as materialized (select *, {_PRIORITY} as priority, row_number() over (partition by doc_id order by {_PRIORITY} desc, "end" - start desc, floor(confidence * 1000000) desc, start, ord) k from {source}),
g as (
  select doc_id, k, [struct_pack(a := start, b := "end")] kept, true good from rk where k = 1
  union all
  select g.doc_id, rk.k,
         case when list_bool_or(list_transform(g.kept, lambda x: x.a < rk."end" and rk.start < x.b)) then g.kept else list_append(g.kept, struct_pack(a := rk.start, b := rk."end")) end,
         not list_bool_or(list_transform(g.kept, lambda x: x.a < rk."end" and rk.start < x.b))
  from g join rk on rk.doc_id = g.doc_id and rk.k = g.k + 1
),
s as materialized (select rk.* from rk join g using (doc_id, k) where good)"""


_RESOLVED = f"{_WITH_SPANS}, {_greedy('c')}"
#: First uses, numbered by type.
_NUMBERED = f"""{_RESOLVED},
f as (select doc_id, value, arg_min(type, start) as type, min(start) as first from s group by doc_id, value),
n as materialized (select *, '[' || type || '_' || row_number() over (partition by doc_id, type order by first) || ']' as placeholder from f)"""
_PIECES = f"""{_NUMBERED},
p as (select s.doc_id, s.start, s."end", n.placeholder, coalesce(lag(s."end") over (partition by s.doc_id order by s.start), 0) as before,
             row_number() over (partition by s.doc_id order by s.start desc) as back from s join n using (doc_id, value)),
j as (select p.doc_id, string_agg(decode(encode(text)[before + 1 : start]) || placeholder, '' order by start) as head, max(p."end") as last, count(*) as n_spans from p join documents using (doc_id) group by p.doc_id),
a as materialized (select d.doc_id, case when j.doc_id is null then text else head || decode(encode(text)[last + 1 :]) end as anonymized, coalesce(n_spans, 0)::bigint as n_spans, text from documents d left join j using (doc_id))"""

def _weights(w: list[int], d: str = _DIGIT_LIST) -> str:
    return "(" + " + ".join(f"{d}[{i + 1}] * {x}" for i, x in enumerate(w) if x) + ")"


ORACLES = {f"detect_{n}": f"select doc_id, type, value, start, \"end\", confidence, source from ({_matches(n, 'documents', 'doc_id')})" for n in RULES}
ORACLES |= {
    "detect_all": f'{_WITH_SPANS} select doc_id, type, value, start, "end", confidence, detector, source from c',
    "resolve_overlaps": f'{_RESOLVED} select doc_id, type, value, start, "end", detector, priority from s',
    "policy_spans": f"""{_WITH_SPANS}, v as (select * from c where type <> 'IP' and start < 2000 and "end" > 0), {_greedy('v')}
select doc_id, type, value, start, "end", type <> 'EMAIL' as enabled from s""",
    "anonymize_documents": f"{_PIECES} select doc_id, anonymized, n_spans from a",
    "placeholder_numbers": f"{_NUMBERED} select doc_id, value, type, placeholder from n",
    "mapping_entries": f"{_NUMBERED} select doc_id, row_number() over (partition by doc_id order by first) - 1 as ord, value as original, placeholder, type from n",
    "restore_documents": "select doc_id, text as restored from documents",
    "checksum_numbers": f"""
with m as (select doc_id, unnest(regexp_extract_all(text, '\\b[0-9]{{9,16}}\\b')) v from documents)
select doc_id, v as value, {_LUHN.format(d=_DIGIT_LIST)} as luhn,
  case when length(v) = 9 then {_weights([3, 7, 1, 3, 7, 1, 3, 7, 1])} % 10 = 0 else false end as aba,
  case when length(v) = 10 then (11 - {_weights([10, 9, 8, 7, 6, 5, 4, 3, 2])} % 11) % 11 = {_DIGIT_LIST}[10] else false end as nhs,
  case when length(v) = 10 then {_LUHN.format(d="list_transform(string_split('80840' || v, ''), lambda x: x::int)")} else false end as npi,
  case when length(v) = 9 then {_weights([9, 8, 7, 6, 5, 4, 3, 2, -1])} > 0 and {_weights([9, 8, 7, 6, 5, 4, 3, 2, -1])} % 11 = 0 else false end as bsn,
  case when length(v) = 11 then (10 - {_weights([1, 3, 7, 9, 1, 3, 7, 9, 1, 3])} % 10) % 10 = {_DIGIT_LIST}[11] else false end as pesel
from m""",
    "secret_entropy": f"with m as (select doc_id, unnest(regexp_extract_all(text, '[0-9a-f]{{40}}')) v from documents) select doc_id, v as value, {_ENTROPY.format(v='v')} as bits from m",
    "text_lengths": r"""
select doc_id, strlen(text)::bigint as utf8, length(text)::bigint as points, (length(text) + len(regexp_extract_all(text, '[\x{10000}-\x{10FFFF}]')))::bigint as utf16,
  regexp_matches(text, '[\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{AC00}-\x{D7AF}]') as cjk, regexp_matches(text, '\p{Han}') as han from documents""",
    "offset_conversion": rf"""
with l as (select doc_id, text, string_split(text, chr(10)) ls from documents),
u as (select doc_id, ls, list_transform(ls, lambda x: length(x) + len(regexp_extract_all(x, '[\x{{10000}}-\x{{10FFFF}}]'))) us, generate_subscripts(ls, 1) i from l)
select doc_id, i - 1 as ord, ({_octets('ls[1:i]')} + i - 1)::bigint as utf8, (list_sum(us[1:i]) + i - 1)::bigint as utf16, ({_octets('ls[1:i]')} + i - 1)::bigint as back, (list_sum(us) + len(us) - 1)::bigint as last_utf16 from u""",
    "ocr_zeros": r"""
with recursive w as (
  select doc_id, replace(text, '0', 'O') t from documents
), m as (
  select doc_id, t, regexp_extract_all(t, '[\p{L}\p{N}]+') ms, string_split_regex(t, '[\p{L}\p{N}]+') gs from w
)
select doc_id, md5(array_to_string(list_transform(gs, lambda g, i: g || coalesce(case when regexp_matches(ms[i], '^[0-9oO]*[0-9][0-9oO]*$') then translate(ms[i], 'oO', '00') else ms[i] end, '')), '')) as digest from m""",
    "word_counts": r"""
select doc_id, len(w)::bigint as words, len(list_distinct(w))::bigint as distinct_words
from (select doc_id, list_transform(regexp_extract_all(text, '[\p{L}\p{N}]{3,}'), lambda x: lower(x)) w from documents)""",
    "line_table": f"""
select doc_id, i - 1 as ord, ({_octets('ls[1:i-1]')} + i - 1)::bigint as start, ({_octets('ls[1:i]')} + i - 1)::bigint as "end", md5(v) as digest
from (select doc_id, ls, unnest(ls) v, generate_subscripts(ls, 1) i from (select doc_id, string_split(text, chr(10)) ls from documents))""",
    "figure_lines": "select l_orderkey, case when count(*) >= 3 then count(*) else 0 end::bigint as n_rows from lineitem group by l_orderkey",
    "regions_by_language": r"""
select doc_id, array_to_string(list_sort(list_concat(case lang when 'en' then ['us','gb','ie'] when 'fr' then ['fr','be','ch'] when 'de' then ['de','at','ch'] when 'es' then ['es'] else ['us','gb','fr','es'] end,
  case when regexp_matches(text, '\p{Han}') then ['cn'] else [] end)), ',') as regions from documents""",
    "pii_cube": f"""{_RESOLVED}
select coalesce(lang, 'all') as lang, coalesce(type, 'all') as type, count(*)::bigint as spans, count(distinct doc_id)::bigint as documents
from s join documents using (doc_id) group by cube (lang, type)""",
    "pii_documents": f"""{_RESOLVED}, k as (select doc_id, count(*) n from s group by doc_id)
select source, count(*)::bigint as documents, count(k.n)::bigint as affected, coalesce(sum(k.n), 0)::bigint as spans from documents left join k using (doc_id) group by source""",
    "label_exposure": f"""{_RESOLVED}, k as (select doc_id, count(*) n from s group by doc_id)
select quality, toxic, count(*)::bigint as documents, sum(coalesce(n, 0))::bigint as spans from documents join labels using (doc_id) left join k using (doc_id) group by quality, toxic""",
    "page_emails": "with q as (select page_id, regexp_replace(html, '<[^>]*>', ' ', 'g') as text from pages) select page_id, type, count(*)::bigint as n from ("
    + " union all ".join(f"({_matches(n, 'q', 'page_id')})" for n in ("email", "ipv4", "phone"))
    + ") group by page_id, type",
    "conversation_rarity": r"""
with d as (select distinct conv_id, lower(unnest(regexp_extract_all(text, '[\p{L}\p{N}]{3,}'))) as word from conversations)
select word, count(*)::bigint as df, round(ln(((select count(distinct conv_id) from conversations) + 1.0) / (count(*) + 1.0)), 9) as idf from d group by word""",
    "span_envelopes": f"""{_RESOLVED}
select doc_id, string_agg(start || chr(9) || "end" || chr(9) || type || chr(9) || value || chr(9) || printf('%.3f', confidence) || chr(9) || detector, chr(10) order by start) as report, '1' as version from s group by doc_id""",
    "policy_ranges": r"""
with o as (
  select doc_id, strlen(text) n, list_transform(range(0, 4), lambda k: strlen(left(text, k))) as cuts from documents
)
select doc_id, case when n < 3 then 'range 0 [1, 3) is outside the text (' || n || ' bytes)'
  when not (list_contains(cuts, 1) and list_contains(cuts, 3)) then 'range 0 [1, 3) is not on UTF-8 character boundaries' end as problem from o""",
    "clean_names": r"""
with n as (select c_name as name from customer union all select s_name from supplier)
select name, name <> '' and not regexp_matches(name, '[:/]') and length(name) between 3 and 120 and regexp_matches(name, '\p{L}') and name <> lower(name)
  and not regexp_matches(name, '^\S+\.[a-z]{2,}$') and not (len(regexp_extract_all(name, '\p{L}+')) = 1 and name = upper(name) and length(name) <= 3) as kept from n""",
}
ORACLES["dictionary_words"] = r"""
with w as (select doc_id, translate(lower(unnest(regexp_extract_all(text, '[\p{L}\p{N}]+'))), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy') as f from documents),
t as (select unnest(%s) as term)
select doc_id, term, count(*)::bigint as n from w join t on f = translate(term, 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy') group by doc_id, term""" % (TERMS,)
ORACLES["dictionary_spans"] = r"""
with w as (select doc_id, lower(unnest(regexp_extract_all(text, '[\p{L}\p{N}]+'))) as value from documents),
t as (select unnest(%s) as term)
select doc_id, value, count(*)::bigint as n from w join t on translate(value, 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy') = translate(term, 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy') group by doc_id, value""" % (TERMS,)
ORACLES["name_list_spans"] = rf"""
with t as (select distinct regexp_extract(text, '^([\p{{L}}\p{{N}}]+ [\p{{L}}\p{{N}}]+)', 1) as name from benchmark),
m as (select doc_id, regexp_extract_all(text, '[\p{{L}}\p{{N}}]+') ms, string_split_regex(text, '[\p{{L}}\p{{N}}]+') gs from documents),
u as (select doc_id, ms, gs, generate_subscripts(ms, 1) i from m),
r as (select doc_id, ms[i] || gs[i + 1] || ms[i + 1] as value, ({_octets("gs[1:i]")} + {_octets("ms[1:i-1]")})::int as start, ({_octets("gs[1:i+1]")} + {_octets("ms[1:i+1]")})::int as "end" from u where i < len(ms) and gs[i + 1] = ' ')
select doc_id, 'COMPANY' as type, value, start, "end" from r join t on value = name where name <> ''"""
ORACLES |= {"value_checks": sheets.VALUE_CHECKS_SQL, "pack_examples": sheets.PACK_EXAMPLES_SQL, "rule_inventory": sheets.RULE_INVENTORY_SQL}
