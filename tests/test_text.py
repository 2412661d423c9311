from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from maskwork.functions import text as tx
from maskwork.operators.review import figure_rows

TEXT = "a😀é张 b"


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("x")).first().x


@pytest.mark.parametrize("utf8,utf16", [(0, 0), (1, 1), (5, 3), (7, 4), (10, 5), (12, 7), (2, None), (6, None), (13, None), (-1, None)])
def test_offsets_between_bytes_and_units(spark, utf8, utf16):
    assert one(spark, TEXT, tx.utf8_to_utf16(F.col("t"), F.lit(utf8))) == utf16
    if utf16 is not None:
        assert one(spark, TEXT, tx.utf16_to_utf8(F.col("t"), F.lit(utf16))) == utf8
    assert tx.OffsetIndex(TEXT).convert(utf8, "utf8", "utf16") == (-1 if utf16 is None else utf16)


def test_no_offset_inside_a_surrogate_pair(spark):
    assert one(spark, TEXT, tx.utf16_to_utf8(F.col("t"), F.lit(2))) is None
    assert tx.OffsetIndex(TEXT).convert(2, "utf16", "utf8") == -1
    with pytest.raises(Exception, match="character boundary"):
        one(spark, TEXT, tx.utf8_to_utf16(F.col("t"), F.lit(2), strict=True))
    assert one(spark, TEXT, tx.convert_offsets(F.col("t"), F.array(F.lit(0), F.lit(2), F.lit(5)), "utf8", "utf16")) == [0, -1, 3]


def test_find_all_and_words(spark):
    got = one(spark, "x: 张三, y1 😀 z", tx.word_ranges(F.col("t")))
    assert [(m.value, m.start, m.end) for m in got] == [("x", 0, 1), ("张三", 3, 9), ("y1", 11, 13), ("z", 19, 20)]
    assert one(spark, "Der ÄRGER of 2024 is", tx.words_of(F.col("t"))) == ["der", "ärger", "2024"]


def test_zeros_for_letters(spark):
    for text, want in [("Bad o224 507 o832 So", "Bad 0224 507 0832 So"), ("oo", "oo"), ("1O", "10"), ("é1O", "é1O"), ("", "")]:
        assert one(spark, text, tx.zeros_for_os(F.col("t"))) == want


def test_views_scripts_edges(spark):
    assert one(spark, "a\tb", tx.cell_view(F.col("t"))) == "a\x01b"
    assert one(spark, "カ", tx.has_cjk(F.col("t"))) and not one(spark, "カ", tx.has_han(F.col("t"))) and one(spark, "々", tx.has_han(F.col("t")))
    assert one(spark, " (Foo。 ", tx.normalised(F.col("t"))) == "foo"
    r = one(spark, " (Foé). ", tx.trimmed_range(F.col("t")))
    assert (r.start, r.end) == (2, 6)
    assert one(spark, " .. ", tx.trimmed_range(F.col("t"))) is None


def test_lines_and_figures(spark):
    got = one(spark, "é\n\nb", tx.line_ranges(F.col("t")))
    assert [(m.value, m.start, m.end) for m in got] == [("é", 0, 2), ("", 3, 3), ("b", 4, 5)]
    assert one(spark, "é\nbc\nd", tx.line_at(F.col("t"), F.lit(4))) == "bc"
    table = "a 1.5 2.5\nb 1.5 2,5\nref 1.5 2.5\nc 1.0 2.0 3.0"
    assert len(one(spark, table, tx.figure_rows(F.col("t")))) == 3 == len(figure_rows(table))
    assert one(spark, "a 1.5 2.5\nb 1.5 2,5", tx.figure_rows(F.col("t"))) == []
