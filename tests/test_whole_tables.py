"""Queries that read whole tables, against what the rows must give."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folio.plans import QUERIES
from folio.sources import frames

VALUES = [(1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")]


def roman(n):
    out, left = "", n
    for v, s in VALUES:
        out, left = out + s * (left // v), left % v
    return out if 1 <= n <= 3999 else str(n)


def latin(n):
    out = ""
    while n > 0:
        out, n = chr(97 + (n - 1) % 26) + out, (n - 1) // 26
    return out


@pytest.fixture
def tables(spark, tmp_path):
    def write(name, rows, shape):
        spark.createDataFrame(rows, shape).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def test_all_numbers(spark, tables):
    sf = tables("part", [(k, k % 50 + 1) for k in range(20_000)], "p_partkey long, p_size int")
    got = {r.n: r for r in QUERIES["format_number"](spark, sf).collect()}
    assert sorted(got) == list(range(1, 20_001))
    assert all((r.digit, r.roman_lower, r.roman_upper, r.latin_lower, r.latin_upper) == (str(n), roman(n), roman(n).upper(), latin(n), latin(n).upper()) for n, r in got.items())
    text = {r.p_partkey: r.text for r in QUERIES["page_number_text"](spark, sf).collect()}
    assert len(text) == 20_000 and [text[k] for k in (1, 2, 3, 4, 24, 49)] == ["- II -", "- * -", "- 4 -", "- ⑤ -", "- 25 -", "- L -"]


def test_all_fonts(spark, tables):
    rows = [(1, 7, "odd", 1.0), (2, 7, "view", 95.0), (3, 8, "view", 0.1), (4, 9, "view", 5.0)]
    sf = tables("events", rows, "event_id long, user_id long, event_type string, value double")
    assert {r.user_id: r.reasons for r in QUERIES["font_rule"](spark, sf).collect()} == {7: ["font_not_allowed", "font_substituted"], 8: ["font_missing"], 9: []}


def test_whole_list_items(spark, tables):
    long = "a text of more than twenty characters"
    sf = tables("conversations", [(1, 0, "user", long), (1, 1, "assistant", long + "é")], "conv_id long, turn long, role string, text string")
    assert [r.line.strip() for r in QUERIES["list_items"](spark, sf).orderBy("ord").collect()] == [f"1. {long}", f"- {long}é"]


def test_all_markup(spark, tables):
    sf = tables("documents", [(1, "a & b\n<c> d"), (2, "é\n- -\n*x"), (3, ""), (4, "a\x01b")], "doc_id long, text string")
    found = {r.doc_id: (r.tag, r.text) for r in QUERIES["html_fragments"](spark, sf).collect()}
    assert found == {1: ("p", "a & b <c> d"), 2: ("p", "é - - *x"), 3: ("p", ""), 4: (None, None)}
    kinds = sorted((r.doc_id, r.ord, r.kind) for r in QUERIES["markdown_blocks"](spark, sf).collect())
    assert kinds == [(1, 0, "heading"), (1, 1, "bullet"), (2, 0, "heading"), (2, 1, "rule"), (2, 2, "quote"), (3, 0, "heading"), (4, 0, "heading")]


def test_gradient_positions_are_decimals(spark, tables):
    sf = tables("part", [(1, 3), (5, 2), (6, 4), (7, 1)], "p_partkey long, p_size int")
    found = QUERIES["gradient_blocks"](spark, sf).orderBy("p_partkey")
    assert found.schema["places"].dataType.simpleString() == "array<decimal(3,2)>"
    assert [(r.places and list(map(str, r.places)), r.colors) for r in found.collect()] == [(None, None), (["0.00", "0.25", "1.00"], [1, 5, 7]), (["0.00", "1.00"], [1, 6]), (["0.00", "1.00"], [1, 7])]


def test_rewritten_records_meet_in_their_row(spark, tables, capsys):
    sf = tables("documents", [(0, "a\nb"), (1, "a\n\n" + "가" * 50_000), (2, None), (3, ""), (4, "x")], "doc_id long, text string")
    found = QUERIES["record_rewrite"](spark, sf)
    assert sorted(map(tuple, found.collect())) == [(0, False, 1), (1, True, 0), (2, True, 0), (3, True, 0), (4, False, 1)]
    found.explain()
    assert "Join" not in capsys.readouterr().out


def test_large_batches_are_taken_in_pieces(spark):
    rows = spark.range(0, 20, 1, 1).select("id", F.encode(F.repeat(F.lit("x"), 200_000), "UTF-8").alias("data"))
    found = frames.map_column(rows, lambda given: pa.array([len(given)] * len(given), pa.int64()), "data", "together", "bigint").select("id", "together").collect()
    assert sorted(r.id for r in found) == list(range(20)) and max(r.together for r in found) < 10
    assert frames.map_column(rows.limit(0), lambda given: pa.array(given, pa.binary()), "data", "again", "binary").count() == 0


def test_ink_bounds_are_floats(spark, tables):
    more, less = 0.15000002, -0.15000002  # the next floats
    rows = [(1, [0.15, more, 0.0, less]), (2, [more, -0.15, 0.0, 0.0]), (3, [0.15, less, 0.0, 0.0]), (4, [more, less, 0.15, -0.15])]
    sf = tables("embeddings", rows, "vec_id long, embedding array<float>")
    found = {r.id: r.share for r in QUERIES["roi_precision"](spark, sf).collect()}
    assert found == {1: 0.0, 2: 0.0, 4: 1.0}


def test_letters_beyond_four(spark, tables):
    ns = [18_278, 18_279, 475_254, 475_255, 1_200_000, 12_356_630, 12_356_631, 2**32 - 1]
    sf = tables("part", [(n - 1, 1) for n in ns], "p_partkey long, p_size int")
    found = {r.n: (r.latin_lower, r.latin_upper) for r in QUERIES["format_number"](spark, sf).collect()}
    assert found == {n: (latin(n), latin(n).upper()) for n in ns} and found[475_255][1] == "AAAAA"
