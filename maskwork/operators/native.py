"""Operators as Spark expressions only: they stay in the JVM and read as SQL.

Rules with plain patterns, overlap resolution, defaults, policies, numbering, anonymising and
restoring. Full rule packs, whose many patterns one Arrow pass handles faster, are in `engine`.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.text import UNICODE, octet_slice
from ..functions.validators import check_column
from ..sources.demands import demand
from ..sources.rules import Rule
from ..sources.schema import MAPPINGS, SPANS, priority

_NUMERIC = ["ID", "CARD", "OTHER", "PHONE"]

#: Rules that the JVM searches in time linear in the text: runs are bounded, or possessive and entered at their first character.
PLAIN_RULES = [
    Rule("plain:email", "plain", "EMAIL", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", "", 0.95),
    Rule("plain:ipv4", "plain", "IP", r"\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b", "", 0.9, "ipOctets"),
    Rule("plain:card", "plain", "CARD", r"\b[0-9]{16}\b", "", 0.9, "luhn"),
    Rule("plain:phone", "plain", "PHONE", r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}", "", 0.85),
    Rule("plain:token", "plain", "SECRET", r'token = "[0-9a-f]{40}', "", 0.9, "secretAssignment"),
    Rule("plain:long_number", "plain", "OTHER", r"\b[0-9]{9,19}\b", "", 0.4),
]


def java_pattern(rule: Rule) -> str:
    """A rule's pattern in the dialect of java.util.regex."""
    flags = "".join(f for f in rule.flags if f in "ims")
    body = rule.pattern if "m" in flags else rule.pattern.replace("$", r"\z")
    return f"{UNICODE[:-1]}{flags})(?:{body})"


def span(kind: Column, value: Column, start: Column, end: Column, confidence: float, detector: str, source: str) -> Column:
    return F.struct(kind.alias("type"), value.alias("value"), start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(float(confidence)).alias("confidence"), F.lit(detector).alias("detector"), F.lit(source).alias("source"), F.lit(True).alias("enabled"))


def rule_type(rule: Rule, value: Column) -> Column:
    """Weak rules for numbers call a bare figure NUMBER."""
    if rule.source == "rule" and rule.type in _NUMERIC:
        return F.when(value.rlike(r"\A[0-9 ./-]+\z"), "NUMBER").otherwise(rule.type)
    return F.lit(rule.type)


def may_hold_tab(rule: Rule) -> bool:
    """Whether a match may cross a cell: the pattern has something that takes tabs."""
    return bool(regex.search(r"\\[sStTDWVhxup]|\[\^|\t|(?<!\\)\.", rule.pattern))


def rule_spans(text: Column, rule: Rule, view: Column | None = None) -> Column:
    """Accepted matches of one rule with byte offsets.

    Searched is `view` (text, or `zeros_for_os` of it, which has the same offsets). Where all
    matches from left to right are accepted, they are the result. Where one is rejected, all
    starts are tried: a rejected candidate gives way to the next place, an accepted one moves the
    cursor to its end. A text with tabs is searched again with its cells closed.
    """
    hay, asked = text if view is None else view, demand(rule.pattern, False)
    gate = F.lit(True)  # what costs less than the search and is false for most texts
    if 0 < len(asked.strings) <= 8 and "i" not in rule.flags:
        gate = reduce(or_, (hay.contains(x) for x in sorted(asked.strings)))
    first = _searched(text, hay, rule, view is not None)
    if may_hold_tab(rule):
        fresh = lambda found: F.concat(found, _searched(text, tx.cell_view(hay), rule, True, found))
        first = F.get(F.transform(F.array(first), lambda found: F.when(text.contains("\t"), fresh(found)).otherwise(found)), F.lit(0))
    return F.when(gate, first).otherwise(F.array().cast(SPANS))


def _searched(text: Column, hay: Column, rule: Rule, other: bool, seen: Column | None = None) -> Column:
    """Accepted matches in hay that were not seen before; with other, their values are those of text at the same bytes."""
    pattern, none = java_pattern(rule), F.array().cast(SPANS)
    value = lambda m: octet_slice(text, m["start"], m["end"]) if other else m["value"]

    def good(m):
        ok = ~m["value"].contains("\t") & ~m["value"].contains("\x01")
        if seen is not None:
            ok = ok & ~F.exists(seen, lambda s: (s["start"] == m["start"]) & (s["end"] == m["end"]))
        return ok & check_column(rule.check, value(m)) if rule.check else ok

    def hit(m):
        v = value(m)
        return span(rule_type(rule, v), v, m["start"], m["end"], rule.confidence, rule.id, rule.source)

    def accepted(found):
        return F.when(F.forall(found, good), F.transform(found, hit)).otherwise(_from_all_starts(hay, pattern, good, hit))

    # An array of one binds the matches to a name: they are looked for once.
    return F.when(hay.rlike(pattern), F.get(F.transform(F.array(tx.find_all(hay, pattern)), accepted), F.lit(0))).otherwise(none)


def _from_all_starts(hay: Column, pattern: str, good, hit) -> Column:
    """Every place where the pattern matches is a candidate: hay is cut before each, and cuts have no width."""
    pieces = F.transform(F.split(hay, f"(?={pattern})", -1), F.octet_length)
    lengths = F.when(hay.rlike(rf"\A(?={pattern})"), F.concat(F.array(F.lit(0)), pieces)).otherwise(pieces)
    found = F.regexp_extract_all(hay, F.lit(f"(?=({pattern}))"), F.lit(1))
    pairs = F.zip_with(F.slice(lengths, F.lit(1), F.size(found)), found, lambda n, m: F.struct(n.alias("n"), m.alias("m")))
    begin = F.struct(F.lit(0).alias("at"), F.lit(0).alias("cursor"), F.array().cast(SPANS).alias("out"))

    def step(a, x):
        s = (a["at"] + x["n"]).cast("int")
        m = F.struct(x["m"].alias("value"), s.alias("start"), (s + F.octet_length(x["m"])).cast("int").alias("end"))
        taken = F.filter(F.array(m), lambda m: (m["start"] >= a["cursor"]) & (m["value"] != "") & good(m))
        return F.struct(s.alias("at"), F.coalesce(F.get(taken, F.lit(0))["end"], a["cursor"]).alias("cursor"), F.concat(a["out"], F.transform(taken, hit)).alias("out"))

    return F.aggregate(pairs, begin, step)["out"]


def detect(text: Column, rules: Iterable[Rule] = PLAIN_RULES, view: Column | None = None) -> Column:
    """Candidate spans of all rules, rule by rule. Texts without digits meet only rules that demand none."""
    rules, none = list(rules), F.array().cast(SPANS)
    asking = [r for r in rules if demand(r.pattern, False).digits]
    found = lambda some: F.concat(none, *(rule_spans(text, r, view) for r in some))
    if not asking:
        return found(rules)
    digit = r"(?U)\d" if any(r"\d" in r.pattern for r in asking) else "[0-9]"
    return F.when((text if view is None else view).rlike(digit), found(rules)).otherwise(found([r for r in rules if r not in asking]))


def detect_frame(df: DataFrame, text_col: str = "text", rules: Iterable[Rule] = PLAIN_RULES, out: str = "candidates") -> DataFrame:
    """df with the candidate spans of all rules, found where o and O in figures count as zeros."""
    viewed = df.withColumn("_view", tx.zeros_for_os(F.col(text_col)))
    return viewed.withColumn(out, detect(F.col(text_col), rules, F.col("_view"))).drop("_view")


def resolve(spans: Column) -> Column:
    """The better span of any two that overlap: priority, length, confidence, start, given order."""
    ranked = F.array_sort(
        F.transform(
            spans,
            lambda s, i: F.struct((-priority(s["source"])).alias("p"), (s["start"] - s["end"]).alias("l"), (-F.floor(s["confidence"] * 1_000_000)).alias("c"), s["start"].alias("a"), i.alias("i"), s.alias("s")),
        )
    )
    free = lambda kept, s: ~F.exists(kept, lambda k: (s["start"] < k["end"]) & (k["start"] < s["end"]))
    kept = F.aggregate(ranked, F.array().cast(SPANS), lambda kept, r: F.when(free(kept, r["s"]), F.concat(kept, F.array(r["s"]))).otherwise(kept))
    return by_start(kept)


def by_start(spans: Column) -> Column:
    ordered = F.array_sort(F.transform(spans, lambda s, i: F.struct(s["start"].alias("a"), i.alias("i"), s.alias("s"))))
    return F.transform(ordered, lambda r: r["s"])


def changed(s: Column, **values: Column) -> Column:
    return F.struct(*(values.get(f, s[f]).alias(f) for f in ("type", "value", "start", "end", "confidence", "detector", "source", "enabled")))


BIRTH = r"(?iU)(?:born|date of birth|birth date|birthdate|birthday|d\.o\.b\.|dob|né\(e\) le|née le|né le|naissance|nacido|nacida|nacimiento|f\. nac\.)(?:[^0-9\n]{0,20}|[ \t:\r]*\n[ \t:\r\n]*)\z"


def follows_birth_label(text: Column, start: Column) -> Column:
    """Whether a date that starts at a byte offset stands behind a birth label."""
    before = F.right(octet_slice(text, F.lit(0), start), F.lit(80))
    return before.rlike(BIRTH) | before.rlike(r"(?s)NE LE.{0,20}\z")


def with_defaults(text: Column, spans: Column, rows: Column | None = None) -> Column:
    """Dates of birth told from dates; dates, amounts and weak figures inside rows of figures disabled."""
    born = F.transform(F.filter(spans, lambda s: (s["type"] == "DATE") & follows_birth_label(text, s["start"])), lambda s: F.trim(s["value"]))

    def one(s):
        birth = (s["type"] == "DATE") & F.array_contains(born, F.trim(s["value"]))
        off = s["type"].isin("DATE", "AMOUNT")
        if rows is not None:
            off = off | ((s["type"] == "NUMBER") & s["source"].isin("model", "rule") & F.exists(rows, lambda r: (r["start"] <= s["start"]) & (s["end"] <= r["end"])))
        return changed(s, type=F.when(birth, "BIRTH_DATE").otherwise(s["type"]), enabled=s["enabled"] & (birth | ~off))

    return F.transform(spans, one)


def apply_policy(spans: Column, types: dict[str, str] | Column | None = None, ranges: Column | None = None) -> Column:
    """hide enables, keep disables, off drops before overlaps are resolved; spans outside the ranges go."""
    action = lambda s: F.lit(None).cast("string")
    if isinstance(types, dict) and types:
        table = F.create_map(*(F.lit(x) for pair in types.items() for x in pair))
        action = lambda s: F.try_element_at(table, s["type"])
    elif isinstance(types, Column):
        action = lambda s: F.try_element_at(types, s["type"])
    trusted = lambda s: s["source"].isin("dictionary", "manual")
    keep = lambda s: trusted(s) | F.coalesce(action(s) != "off", F.lit(True))
    out = F.filter(spans, keep)
    if ranges is not None:
        out = F.filter(out, lambda s: F.exists(ranges, lambda r: (r["start"] < s["end"]) & (s["start"] < r["end"])))
    return F.transform(out, lambda s: F.when(trusted(s) | action(s).isNull(), s).otherwise(changed(s, enabled=action(s) == "hide")))


def range_error(text: Column, ranges: Column) -> Column:
    """What is wrong with the first bad range; null if nothing is."""
    n = F.octet_length(text)
    broken = lambda at: ~F.is_valid_utf8(octet_slice(text, F.lit(0), at)) | (F.octet_length(octet_slice(text, F.lit(0), at)) != at)

    def one(r, i):
        name = lambda tail: F.concat(F.lit("range "), i.cast("string"), F.lit(" ["), r["start"].cast("string"), F.lit(", "), r["end"].cast("string"), F.lit(") "), tail)
        return F.when(r["start"] >= r["end"], name(F.lit("is empty; start must be less than end"))).when(r["end"] > n, name(F.concat(F.lit("is outside the text ("), n.cast("string"), F.lit(" bytes)")))).when(broken(r["start"]) | broken(r["end"]), name(F.lit("is not on UTF-8 character boundaries")))

    first = F.try_element_at(F.filter(F.transform(ranges, one), lambda m: m.isNotNull()), F.lit(1))
    return F.when(F.size(ranges) == 0, "ranges is empty; omit it to process the whole text").otherwise(first)


_EDGES = r"[\p{IsWhite_Space},;]"


def replaced_spans(spans: Column) -> Column:
    """Enabled spans that will be replaced, in order, without separators at their edges."""

    def trimmed(s):
        lead = F.octet_length(F.regexp_extract(s["value"], rf"\A{_EDGES}*", 0))
        inner = F.regexp_replace(s["value"], rf"\A{_EDGES}+|{_EDGES}+\z", "")
        return F.struct(s["type"].alias("type"), inner.alias("value"), (s["start"] + lead).cast("int").alias("start"), (s["start"] + lead + F.octet_length(inner)).cast("int").alias("end"), s["start"].alias("from"), s["end"].alias("to"))

    every = F.filter(F.transform(by_start(F.filter(spans, lambda s: s["enabled"])), trimmed), lambda s: s["value"] != "")
    kind = "array<struct<type:string,value:string,start:int,end:int,from:int,to:int>>"
    start = F.struct(F.lit(0).alias("cursor"), F.array().cast(kind).alias("out"))
    step = lambda a, s: F.when(s["from"] >= a["cursor"], F.struct(s["to"].alias("cursor"), F.concat(a["out"], F.array(s)).alias("out"))).otherwise(a)
    return F.aggregate(every, start, step)["out"]


def new_mappings(replaced: Column) -> Column:
    """Entries in order of first use. For texts without earlier entries and without PERSON spans."""
    values = F.transform(replaced, lambda s: s["value"])
    firsts = F.filter(replaced, lambda s, i: F.array_position(values, s["value"]) == i + 1)
    number = lambda f, i: F.size(F.filter(F.slice(firsts, F.lit(1), i + 1), lambda g: g["type"] == f["type"]))
    return F.transform(firsts, lambda f, i: F.struct(f["value"].alias("original"), F.concat(F.lit("["), f["type"], F.lit("_"), number(f, i).cast("string"), F.lit("]")).alias("placeholder"), f["type"].alias("type"))).cast(MAPPINGS)


def anonymise(text: Column, replaced: Column, mappings: Column) -> Column:
    """Text with the replaced spans as placeholders."""
    by_value = F.map_from_entries(F.transform(mappings, lambda m: F.struct(m["original"], m["placeholder"])))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda a, s: F.struct(s["end"].alias("at"), F.concat(a["out"], octet_slice(text, a["at"], s["start"]), F.element_at(by_value, s["value"])).alias("out"))
    done = F.aggregate(replaced, start, step)
    return F.when(F.size(replaced) == 0, text).otherwise(F.concat(done["out"], octet_slice(text, done["at"], F.octet_length(text))))


def restore_exact(text: Column, mappings: Column) -> Column:
    """Placeholders replaced by their longest originals, longest placeholder first."""
    tokens = F.array_sort(F.transform(mappings, lambda m: F.struct((-F.octet_length(m["placeholder"])).alias("l"), m["placeholder"].alias("p"), (-F.length(m["original"])).alias("o"), m["original"].alias("v"))))
    return F.aggregate(tokens, text, lambda t, m: F.replace(t, m["p"], m["v"]))


def anonymise_frame(df: DataFrame, text_col: str = "text", rules: Iterable[Rule] = PLAIN_RULES, policy: dict[str, str] | None = None) -> DataFrame:
    """df with spans, mappings and anonymized, by plain rules only: one projection after another, no shuffle."""
    text = F.col(text_col)
    out = detect_frame(df, text_col, rules).withColumn("candidates", with_defaults(text, F.col("candidates")))
    out = out.withColumn("spans", resolve(apply_policy(F.col("candidates"), policy))).withColumn("_replaced", replaced_spans(F.col("spans")))
    out = out.withColumn("mappings", new_mappings(F.col("_replaced")))
    return out.withColumn("anonymized", anonymise(text, F.col("_replaced"), F.col("mappings"))).drop("_replaced", "candidates")


def long_rows(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """One row per element of an array of structs: keys, ord and the struct's fields.

    The outer form keeps Spark from pushing "not empty" below the projections that make the array,
    where each would be computed once more inside the next.
    """
    rows = df.select(*keys, F.posexplode_outer(column).alias("ord", "s"))
    return rows.filter("ord is not null").select(*keys, "ord", "s.*")


def long_spans(df: DataFrame, keys: list[str], spans: str = "spans") -> DataFrame:
    """One row per span."""
    return long_rows(df, keys, spans)


def numbered(df: DataFrame, key: str, kind: str = "type", value: str = "value", start: str = "start") -> DataFrame:
    """Placeholders of a long table of spans by window numbering: values by first use within key and type."""
    first = df.groupBy(key, value).agg(F.min_by(kind, start).alias(kind), F.min(start).alias("first"))
    number = F.row_number().over(Window.partitionBy(key, kind).orderBy("first"))
    return first.withColumn("placeholder", F.concat(F.lit("["), F.col(kind), F.lit("_"), number.cast("string"), F.lit("]")))


def dictionary_frame(df: DataFrame, terms: DataFrame, text_col: str = "text", term_col: str = "term") -> DataFrame:
    """Occurrences of single-word terms by an equi-join on folded words: df's columns, term, n."""
    fold = lambda c: F.translate(F.lower(c), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    words = df.select(*(c for c in df.columns if c != text_col), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("_w"))
    counted = words.withColumn("_w", fold(F.col("_w"))).groupBy(*(c for c in words.columns)).agg(F.count("*").alias("n"))
    return counted.join(terms.select(F.col(term_col).alias("term"), fold(F.col(term_col)).alias("_w")), "_w").drop("_w")


def list_frame(df: DataFrame, names: DataFrame, key: str, text_col: str = "text", most_words: int = 4) -> DataFrame:
    """Exact occurrences of names (name, kind), which are runs of up to most_words words.

    The runs of every text meet the names in one equi-join; offsets are computed for hits only.
    """
    word = r"[\p{IsAlphabetic}\p{N}]+"
    m, g = F.col("m"), F.col("g")
    cut = lambda d: d.withColumn("m", F.regexp_extract_all(F.col(text_col), F.lit(word), F.lit(0))).withColumn("g", F.split(text_col, word, -1))

    def runs(n: int):
        parts = lambda i: [x for k in range(n) for x in ((F.get(g, i + k),) if k else ()) + (F.get(m, i + k),)]
        every = F.transform(F.sequence(F.lit(0), F.size(m) - n), lambda i: F.struct(i.alias("i"), F.concat(*parts(i)).alias("value")))
        return F.when(F.size(m) >= n, every).otherwise(F.array().cast("array<struct<i:int,value:string>>"))

    found = cut(df.select(key, text_col)).select(F.col(key).alias("_key"), F.explode(F.concat(*(runs(n) for n in range(1, most_words + 1)))).alias("r"))
    hits = found.select("_key", "r.i", "r.value").join(names.select(F.col("name").alias("value"), F.col("kind").alias("type")), "value")
    octets = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + F.octet_length(x))
    placed = cut(df.select(key, text_col).join(hits, F.col(key) == F.col("_key")))
    start = octets(F.slice("g", F.lit(1), F.col("i") + 1)) + octets(F.slice("m", F.lit(1), F.col("i")))
    return placed.select(key, "type", "value", start.alias("start"), (start + F.octet_length("value")).cast("int").alias("end"))
