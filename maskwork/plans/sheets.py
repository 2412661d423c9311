"""Queries over made-up values: every check, and the rule packs, held against SQL.

The values are computed from keys by expressions that read the same in Spark and DuckDB, so that
both engines judge the same strings by ways of their own.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.validators import ALNUM, CHECKS, FINNISH_LETTERS, IRISH_LETTERS, ITALIAN_ODD, SPANISH_LETTERS, check_column
from ..operators import engine, native
from ..sources import rules

#: Digits and capitals drawn from the hash of an order's key.
DRAWN = {
    "d": "translate(md5('d' || o_orderkey), 'abcdef', '012345')",
    "x": "md5('x' || o_orderkey)",
    "l": "translate(md5('l' || o_orderkey), '0123456789abcdef', 'ABCDEFGHJKLMNPRS')",
    "m": "translate(md5('m' || o_orderkey), '0123456789abcdef', 'TWXYZVKLMNPQRSAB')",
}
_D = {n: f"substr(d, 1, {n})" for n in (9, 10, 11, 16)}
#: A value of the format that each check is for.
VALUES = {
    "aba": _D[9], "ahv": "'756' || substr(d, 1, 10)", "belgianNrn": _D[11], "bsn": _D[9],
    "codiceFiscale": "substr(l, 1, 6) || substr(d, 1, 2) || substr(l, 7, 1) || substr(d, 3, 2) || substr(l, 8, 1) || substr(d, 5, 3) || substr(m, 1, 1)",
    "cups": "'ES' || substr(d, 1, 16) || substr(m, 1, 2)", "dNummer": _D[11], "dea": "'A' || substr(l, 1, 1) || substr(d, 1, 7)", "dni": "substr(d, 1, 8) || substr(m, 1, 1)",
    "fodselsnummer": _D[11], "hetu": "substr(d, 1, 6) || '-' || substr(d, 7, 3) || upper(substr(x, 1, 1))", "highEntropyToken": "substr(l, 1, 16) || substr(x, 1, 16) || substr(m, 1, 16)",
    "ibanMod97": "'GB' || substr(d, 1, 20)", "ipOctets": "substr(d, 1, 2) || '.' || substr(d, 3, 3) || '.' || substr(d, 6, 1) || '.' || substr(d, 7, 3)", "luhn": _D[16], "nhs": _D[10],
    "nif": _D[9], "nino": "substr(m, 1, 2) || substr(d, 1, 6) || 'A'", "nip": _D[10], "nir": "'1' || substr(d, 1, 14)", "npi": _D[10], "partitaIva": "'IT' || substr(d, 1, 11)",
    "personnummer": "substr(d, 1, 6) || '-' || substr(d, 7, 4)", "pesel": _D[11], "plIdCard": "substr(l, 1, 3) || substr(d, 1, 6)", "pps": "substr(d, 1, 7) || substr(m, 1, 1)",
    "regon": "case when o_orderkey % 2 = 0 then substr(d, 1, 9) else substr(d, 1, 14) end", "samordningsnummer": "substr(d, 1, 6) || '-' || substr(d, 7, 4)", "secretAssignment": "'key = \"' || substr(x, 1, 20)",
    "steuerId": _D[11], "svnr": _D[10], "ukDrivingLicence": "substr(l, 1, 5) || substr(d, 1, 6) || substr(l, 6, 2) || substr(d, 7, 1) || substr(l, 8, 2)",
}


def value_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The made-up values that each of the 32 checks accepts."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", *(F.expr(x).alias(n) for n, x in DRAWN.items()))
    valued = orders.select("o_orderkey", *(F.expr(VALUES[n]).alias(f"_{n}") for n in CHECKS))
    judged = F.array(*(F.struct(F.lit(n).alias("check"), F.col(f"_{n}").alias("value"), check_column(n, F.col(f"_{n}")).alias("ok")) for n in CHECKS))
    return native.long_rows(valued.select("o_orderkey", judged.alias("judged")), ["o_orderkey"], "judged").filter("ok").select("o_orderkey", "check", "value")


def _at(i: int, v: str = "v") -> str:
    return f"substr({v}, {i}, 1)::bigint"


def _sum(weights: list[int], start: int = 1, v: str = "v") -> str:
    return "(" + " + ".join(f"{_at(start + i, v)} * {w}" for i, w in enumerate(weights) if w) + ")"


def _luhn(v: str) -> str:
    return f"list_sum(list_transform(list_reverse(string_split({v}, '')), lambda c, i: case when i % 2 = 1 then c::bigint when c::bigint > 4 then 2 * c::bigint - 9 else 2 * c::bigint end)) % 10 = 0"


def _entropy(v: str) -> str:
    n = f"len(list_filter(string_split({v}, ''), lambda y: y = c)) / length({v})::double"
    return f"list_sum(list_transform(list_distinct(string_split({v}, '')), lambda c: -({n}) * log2({n})))"


def _place(i: int) -> str:
    return f"(strpos('{ALNUM}', substr(v, {i}, 1)) - 1)"


_EVEN = " + ".join(f"case when {_place(i)} < 10 then {_place(i)} else {_place(i)} - 10 end" for i in range(2, 16, 2))
_ODD = " + ".join(f"{ITALIAN_ODD}[{_place(i)} + 1]" for i in range(1, 16, 2))
_BARE = "replace(v, '-', '')"
_LETTER = lambda letters, n: f"substr('{letters}', (({n}) + 1)::int, 1)"
CONDITIONS = {
    "aba": f"{_sum([3, 7, 1] * 3)} % 10 = 0",
    "ahv": f"(10 - {_sum([1, 3] * 6)} % 10) % 10 = {_at(13)}",
    "belgianNrn": "97 - substr(v, 1, 9)::bigint % 97 = substr(v, 10, 2)::bigint or 97 - (substr(v, 1, 9)::bigint + 2000000000) % 97 = substr(v, 10, 2)::bigint",
    "bsn": f"{_sum([9, 8, 7, 6, 5, 4, 3, 2, -1])} > 0 and {_sum([9, 8, 7, 6, 5, 4, 3, 2, -1])} % 11 = 0",
    "codiceFiscale": f"({_EVEN} + {_ODD}) % 26 = ascii(substr(v, 16, 1)) - 65",
    "cups": f"{_LETTER(SPANISH_LETTERS, 'substr(v, 3, 16)::bigint % 529 // 23')} = substr(v, 19, 1) and {_LETTER(SPANISH_LETTERS, 'substr(v, 3, 16)::bigint % 529 % 23')} = substr(v, 20, 1)",
    "dNummer": "substr(v, 1, 2)::int between 41 and 71",
    "dea": f"{_sum([1, 2, 1, 2, 1, 2], 3)} % 10 = {_at(9)}",
    "dni": f"{_LETTER(SPANISH_LETTERS, 'substr(v, 1, 8)::bigint % 23')} = substr(v, 9, 1)",
    "fodselsnummer": f"substr(v, 1, 2)::int <= 40 and (11 - {_sum([3, 7, 6, 1, 8, 9, 4, 5, 2])} % 11) % 11 = {_at(10)} and (11 - {_sum([5, 4, 3, 2, 7, 6, 5, 4, 3, 2])} % 11) % 11 = {_at(11)}",
    "hetu": f"{_LETTER(FINNISH_LETTERS, '(substr(v, 1, 6) || substr(v, 8, 3))::bigint % 31')} = substr(v, 11, 1)",
    "highEntropyToken": f"regexp_matches(v, '[a-z]') and regexp_matches(v, '[A-Z]') and regexp_matches(v, '[0-9]') and length(v) between 40 and 256 and {_entropy('v')} >= 4.5",
    "ibanMod97": "(substr(v, 5) || '1611' || substr(v, 3, 2))::hugeint % 97 = 1",
    "ipOctets": "list_bool_and(list_transform(string_split(v, '.'), lambda x: x::int < 256))",
    "luhn": _luhn("v"),
    "nhs": f"(11 - {_sum([10, 9, 8, 7, 6, 5, 4, 3, 2])} % 11) % 11 = {_at(10)}",
    "nif": f"regexp_matches(v, '^[125689]') and case when {_sum([9, 8, 7, 6, 5, 4, 3, 2])} % 11 < 2 then 0 else 11 - {_sum([9, 8, 7, 6, 5, 4, 3, 2])} % 11 end = {_at(9)}",
    "nino": "not regexp_matches(v, '^[DFIQUV]') and not regexp_matches(v, '^.[DFIOQUV]') and substr(v, 1, 2) not in ('BG', 'GB', 'NK', 'KN', 'TN', 'NT', 'ZZ')",
    "nip": f"{_sum([6, 5, 7, 2, 3, 4, 5, 6, 7])} % 11 = {_at(10)}",
    "nir": "97 - substr(v, 1, 13)::bigint % 97 = substr(v, 14, 2)::bigint",
    "npi": _luhn("('80840' || v)"),
    "partitaIva": _luhn("substr(v, 3)"),
    "personnummer": f"substr(v, 5, 2)::int < 61 and {_luhn(_BARE)}",
    "pesel": f"(10 - {_sum([1, 3, 7, 9, 1, 3, 7, 9, 1, 3])} % 10) % 10 = {_at(11)}",
    "plIdCard": f"({_place(1)} * 7 + {_place(2)} * 3 + {_place(3)} + {_sum([7, 3, 1, 7, 3], 5)}) % 10 = {_at(4)}",
    "pps": f"{_LETTER(IRISH_LETTERS, _sum([8, 7, 6, 5, 4, 3, 2]) + ' % 23')} = substr(v, 8, 1)",
    "regon": f"case when length(v) = 9 then {_sum([8, 9, 2, 3, 4, 5, 6, 7])} % 11 % 10 = {_at(9)} else {_sum([2, 4, 8, 5, 0, 9, 7, 3, 6, 1, 2, 4, 8])} % 11 % 10 = substr(v || '00000', 14, 1)::bigint end",
    "samordningsnummer": "substr(v, 5, 2)::int >= 61",
    "secretAssignment": f"regexp_matches(substr(v, 8), '[a-f]') and {_entropy('substr(v, 8)')} >= 3.0",
    "steuerId": f"substr(v, 1, 1) <> '0' and (11 - list_reduce([10::bigint] || list_transform(string_split(substr(v, 1, 10), ''), lambda c: c::bigint), lambda p, c: (case when (c + p) % 10 = 0 then 10 else (c + p) % 10 end) * 2 % 11)) % 10 = {_at(11)}",
    "svnr": f"substr(v, 1, 1) <> '0' and {_sum([3, 7, 9, 0, 5, 8, 4, 2, 1, 6])} % 11 = {_at(4)}",
    "ukDrivingLicence": "(substr(v, 7, 2)::int between 1 and 12 or substr(v, 7, 2)::int between 51 and 62) and substr(v, 9, 2)::int between 1 and 31",
}
VALUE_CHECKS_SQL = f"with o as (select o_orderkey, {', '.join(f'{x} as {n}' for n, x in DRAWN.items())} from orders)" + " union all ".join(
    f""" select o_orderkey, '{n}' as "check", v as value from (select o_orderkey, {VALUES[n]} as v from o) where {CONDITIONS[n]}""" for n in CHECKS
)


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


#: Every example of every rule, as it is and with its digits moved on by 1 to 9.
_EXAMPLES = [(f"{r.id}/{k}", e) for r in rules.bundled() for k, e in enumerate(r.examples)]
_TURNED = "translate(example, '0123456789', substr('01234567890123456789', (turn + 1)::int, 10))"


def _portable(r: rules.Rule) -> bool:
    """Whether RE2 reads the rule alike: no look-around, back-reference or check."""
    return not r.check and not any(x in r.pattern for x in ("(?=", "(?!", "(?<", r"\1"))


def pack_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rules of all packs find in all packs' examples, with every turn of their digits.

    Texts beyond ASCII meet the rules without word boundaries only: those are where RE2 differs.
    """
    turns = spark.read.parquet(f"{sf_dir}/nation.parquet").select((F.col("n_nationkey") % 10).cast("int").alias("turn")).distinct()
    sheet = spark.createDataFrame(_EXAMPLES, "id string, example string").hint("broadcast").crossJoin(turns).select("id", "turn", F.expr(_TURNED.replace("::int", "")).alias("text"))
    plain = [r for r in rules.bundled() if _portable(r)]
    found = native.long_spans(engine.detect(sheet, rules=plain, raw=True), ["id", "turn", "text"])
    bounded = [r.id for r in plain if r"\b" in r.pattern]
    return found.filter(~F.col("text").rlike(r"[^\x00-\x7f]") | ~F.col("detector").isin(bounded)).groupBy("id", "turn", F.col("detector").alias("rule"), "type", "value").agg(F.count("*").alias("n"))


def _found(r: rules.Rule) -> str:
    flags = "".join(f for f in r.flags if f in "ims")
    pattern = (f"(?{flags})" if flags else "") + re.sub(r"\\u([0-9A-Fa-f]{4})", r"\\x{\1}", r.pattern)
    weak = r.source == "rule" and r.type in ("ID", "CARD", "OTHER", "PHONE")
    kind = f"case when regexp_full_match(v, '[0-9 ./-]+') then 'NUMBER' else '{r.type}' end" if weak else f"'{r.type}'"
    words = " where not regexp_matches(t, '[^\\x00-\\x7f]')" if r"\b" in r.pattern else ""
    return f"select id, turn, '{r.id}' as rule, {kind} as type, v from (select id, turn, unnest(regexp_extract_all(t, {_quoted(pattern)})) v from sheet{words}) where v <> ''"


PACK_EXAMPLES_SQL = (
    f"with e(id, example) as (values {', '.join(f'({_quoted(i)}, {_quoted(e)})' for i, e in _EXAMPLES)}), turns as (select distinct (n_nationkey % 10)::int as turn from nation), "
    f"sheet as materialized (select id, turn, {_TURNED} as t from e, turns) select id, turn, rule, type, v as value, count(*)::bigint as n from (" + " union all ".join(_found(r) for r in rules.bundled() if _portable(r)) + ") group by all"
)

RULE_INVENTORY_SQL = (
    "with r(region, type, confidence, checked) as (values "
    + ", ".join(f"('{r.region}', '{r.type}', {r.confidence}, {str(bool(r.check)).lower()})" for r in rules.bundled())
    + ") select region, type, case when checked then 'validatedRule' when confidence >= 0.8 then 'strongRule' else 'rule' end as source, count(*)::bigint as rules from r group by all"
)
