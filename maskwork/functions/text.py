"""Text views, offsets and matches as Spark columns.

Offsets are half-open UTF-8 byte offsets unless a name says otherwise. Patterns are in the dialect
of java.util.regex; UNICODE makes its classes Unicode-aware and keeps line ends to `\\n`.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNICODE = "(?dU)"
ALNUM = r"[\p{IsAlphabetic}\p{N}]"
CJK = "[぀-ヿ㐀-鿿가-힯]"

MATCHES = T.ArrayType(T.StructType([T.StructField("value", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def octet_slice(text: Column, start: Column, end: Column) -> Column:
    """Text between two byte offsets."""
    return F.substring(text.cast("binary"), start + 1, end - start).cast("string")


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def utf8_to_utf16(text: Column, offset: Column, strict: bool = False) -> Column:
    """UTF-16 offset of a byte offset; null (or an error) outside the text or inside a character."""
    head = F.substring(text.cast("binary"), F.lit(1), offset)
    good = (offset >= 0) & (offset <= F.octet_length(text)) & F.is_valid_utf8(head.cast("string")) & (F.octet_length(F.make_valid_utf8(head.cast("string"))) == offset)
    found = F.when(good, utf16_length(head.cast("string")))
    return F.when(found.isNull() & text.isNotNull(), F.raise_error(F.concat(F.lit("offset is not on a character boundary: "), offset.cast("string"))).cast("int")).otherwise(found) if strict else found


def utf16_to_utf8(text: Column, offset: Column, strict: bool = False) -> Column:
    """Byte offset of a UTF-16 offset; null (or an error) outside the text or inside a surrogate pair."""
    start = F.struct(F.lit(0).alias("u16"), F.lit(0).alias("u8"), F.lit(None).cast("int").alias("hit"))
    chars = F.concat(F.when(F.length(text) > 0, F.split(text, "")).otherwise(F.array().cast("array<string>")), F.array(F.lit("")))

    def step(a, c):
        hit = F.coalesce(a["hit"], F.when(a["u16"] == offset, a["u8"]))
        return F.struct((a["u16"] + utf16_length(c)).alias("u16"), (a["u8"] + F.octet_length(c)).cast("int").alias("u8"), hit.alias("hit"))

    found = F.aggregate(chars, start, step)["hit"]
    return F.when(found.isNull() & text.isNotNull(), F.raise_error(F.concat(F.lit("offset is not on a character boundary: "), offset.cast("string"))).cast("int")).otherwise(found) if strict else found


class OffsetIndex:
    """Offsets of one Python string, indexed once: code points, bytes and UTF-16 units."""

    def __init__(self, text: str) -> None:
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.u8 = np.concatenate([[0], np.cumsum(1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))])
        self.u16 = np.concatenate([[0], np.cumsum(1 + (code > 0xFFFF))])

    def point(self, offset: int, unit: str = "utf8") -> int:
        """Code point at an offset; -1 outside the text or inside a character."""
        if unit == "codepoint":
            return offset if 0 <= offset < len(self.u8) else -1
        at = self.u8 if unit == "utf8" else self.u16
        k = bisect_left(at, offset)
        return k if k < len(at) and at[k] == offset else -1

    def convert(self, offset: int, unit: str, to: str) -> int:
        k = self.point(offset, unit)
        return -1 if k < 0 else k if to == "codepoint" else int((self.u8 if to == "utf8" else self.u16)[k])


def _convert_batch(texts: pa.Array, offsets: pa.Array, unit: pa.Array, to: pa.Array) -> pa.Array:
    out = []
    for t, o, u, v in zip(texts.to_pylist(), offsets.to_pylist(), unit.to_pylist(), to.to_pylist()):
        index = OffsetIndex(t or "")
        out.append(None if o is None else [index.convert(x, u, v) for x in o])
    return pa.array(out, pa.list_(pa.int32()))


def convert_offsets(text: Column, offsets: Column, unit: str, to: str) -> Column:
    """Many offsets of one text from one unit to another; -1 where there is none."""
    return F.arrow_udf(_convert_batch, "array<int>")(text, offsets, F.lit(unit), F.lit(to))


def find_all(text: Column, pattern: str) -> Column:
    """Non-overlapping, non-empty matches with byte offsets: array of (value, start, end)."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    none = F.array().cast(MATCHES)
    start = F.struct(F.lit(0).cast("int").alias("at"), none.alias("out"))

    def step(a, x):
        s = (a["at"] + F.octet_length(x["g"])).cast("int")
        e = (s + F.octet_length(x["m"])).cast("int")
        return F.struct(e.alias("at"), F.concat(a["out"], F.array(F.struct(x["m"].alias("value"), s.alias("start"), e.alias("end")))).alias("out"))

    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct(g.alias("g"), m.alias("m")))
    return F.when(text.rlike(pattern), F.aggregate(pairs, start, step)["out"]).otherwise(none)


def zeros_for_os(text: Column) -> Column:
    """o and O inside runs of digits read as 0; the text keeps its length."""
    run = rf"{UNICODE}(?<!{ALNUM})[0-9oO]*[0-9][0-9oO]*(?!{ALNUM})"
    gaps, found = F.split(text, run, -1), F.regexp_extract_all(text, F.lit(run), F.lit(0))
    fixed = F.transform(found, lambda m: F.translate(m, "oO", "00"))
    woven = F.array_join(F.zip_with(gaps, F.concat(fixed, F.array(F.lit(""))), lambda g, m: F.concat(g, m)), "")
    return F.when(text.rlike(r"[0-9][oO]|[oO][0-9]"), woven).otherwise(text)


def cell_view(text: Column) -> Column:
    """Tabs as U+0001, so that no match crosses a cell."""
    return F.translate(text, "\t", "\x01")


def has_cjk(text: Column) -> Column:
    return text.rlike(CJK)


def has_han(text: Column) -> Column:
    return text.rlike(r"\p{IsHan}")


def word_ranges(text: Column) -> Column:
    """Maximal runs of alphanumeric characters."""
    return find_all(text, rf"{UNICODE}{ALNUM}+")


def words_of(text: Column) -> Column:
    """Lower-cased runs of three letters and numbers or more."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]{3,}"), F.lit(0)), F.lower)


def unique(values: Column) -> Column:
    return F.array_distinct(values)


#: Characters that do not count at the edges of a value.
EDGES = r"[\p{IsWhite_Space}!-/:-@\[-`{-~、。，；：！？]"
PLAIN_EDGES = r"[\p{IsWhite_Space}!-/:-@\[-`{-~]"


def normalised(value: Column) -> Column:
    return F.lower(F.regexp_replace(value, rf"\A{EDGES}+|{EDGES}+\z", ""))


def trimmed_range(value: Column) -> Column:
    """(start, end) of what is left without white space and ASCII punctuation at the edges; null if nothing is."""
    lead = F.octet_length(F.regexp_extract(value, rf"\A{PLAIN_EDGES}*", 0))
    tail = F.octet_length(F.regexp_extract(value, rf"{PLAIN_EDGES}*\z", 0))
    return F.when(lead < F.octet_length(value), F.struct(lead.cast("int").alias("start"), (F.octet_length(value) - tail).cast("int").alias("end")))


def line_ranges(text: Column) -> Column:
    """All lines with byte offsets: array of (value, start, end)."""
    start = F.struct(F.lit(0).cast("int").alias("at"), F.array().cast(MATCHES).alias("out"))

    def step(a, line):
        e = (a["at"] + F.octet_length(line)).cast("int")
        return F.struct((e + 1).alias("at"), F.concat(a["out"], F.array(F.struct(line.alias("value"), a["at"].alias("start"), e.alias("end")))).alias("out"))

    return F.aggregate(F.split(text, "\n", -1), start, step)["out"]


def line_at(text: Column, offset: Column) -> Column:
    """The line that holds a byte offset."""
    head, tail = octet_slice(text, F.lit(0), offset), octet_slice(text, offset, F.octet_length(text))
    return F.concat(F.substring_index(head, "\n", -1), F.substring_index(tail, "\n", 1))


#: Words and signs by which lines of figures are told from accounts.
FIGURE = r"[+\-−]?[€$£]?\d+(?:[.,]\d+)+\s?%?"
ACCOUNT_WORDS = "account|acct|compte|cuenta|iban|bic|swift|phone|tel|mobile|passport|client|customer|policy|member|ref|reference|contract|number|numero|id"


def figure_rows(text: Column) -> Column:
    """Lines with two decimal figures or more and no account word, if there are three such lines."""
    is_row = lambda x: (F.size(F.regexp_extract_all(x["value"], F.lit(f"(?U){FIGURE}"), F.lit(0))) >= 2) & ~x["value"].rlike(rf"(?iU)\b({ACCOUNT_WORDS})\b")
    rows = F.filter(line_ranges(text), is_row)
    return F.when(F.size(rows) >= 3, rows).otherwise(F.array().cast(MATCHES))
