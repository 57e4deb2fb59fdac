"""Core operators on literal frames, sources on hostile bytes, folds as streams."""

import random

import pytest
from pyspark.sql import functions as F

from folio.functions import numbers, text
from folio.operators import grid, ledger, lookup, numbering, template
from folio.operators import text as ops
from folio.sources import compound, frames, markup, packages, records


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def paras(spark, *texts):
    return spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc_id long, para_idx long, text string")


def test_numerals(spark):
    df = spark.createDataFrame([(n,) for n in (1, 14, 15, 28, 29, 85, 27, 703, 3999, 4000)], "n long")
    got = {r.n: r for r in df.select("n", *(numbers.format_number(F.col("n"), F.lit(s)).alias(s) for s in numbers.SYSTEMS)).collect()}
    assert [got[n].syllable for n in (1, 14, 15, 28, 29, 85)] == ["가", "하", "거", "허", "고", "85"]
    assert (got[14].circled_syllable, got[15].circled_syllable, got[27].latin_upper, got[703].latin_lower) == ("㉻", "거", "AA", "aaa")
    assert (got[3999].roman_upper, got[4000].roman_lower, got[15].consonant, got[1].circled) == ("MMMCMXCIX", "4000", "ㄱ", "①")


def test_dates_and_lengths(spark):
    one = spark.range(1)
    r = one.select(numbers.filetime_iso(F.lit(0)).alias("none"), numbers.filetime_korean(F.lit(134_026_795_700_000_000)).alias("k"), text.utf16_length(F.lit("𝕏가")).alias("w"), text.hyperlink_url(F.lit(r"http\:a\;b;1;0")).alias("u"), text.is_heading(F.lit("개요 3")).alias("h")).first()
    assert (r.none, r.w, r.u, r.h) == (None, 3, "http:a;b", 3) and "요일 오" in r.k
    ok = one.select(*(numbers.is_iso_date(F.lit(s)).alias(f"c{i}") for i, s in enumerate(("2024-02-29", "2023-02-29", "0000-01-01", "2024-2-9")))).first()
    assert tuple(ok) == (True, False, False, False)


def test_replace_never_matches_inserted_text(spark):
    out = ops.replace_text(paras(spark, "aa a", "b", "a"), "a", "aa")
    assert [r[2] for r in rows(out.select("doc_id", "para_idx", "text"), "para_idx")] == ["aaaa aa", "b", "aa"]
    first = ops.replace_text(paras(spark, "b", "a a", "a"), "a", "x", every=False)
    assert [r[2] for r in rows(first.select("doc_id", "para_idx", "text"), "para_idx")] == ["b", "x a", "a"]


def test_delete_keeps_the_only_paragraph(spark):
    assert [r[2] for r in rows(ops.delete_matching(paras(spark, "ax", "bx"), "x"))] == ["bx"]
    assert [r[2] for r in rows(ops.insert_after_first(paras(spark, "a", "b", "b"), "b", "new"), "para_idx")] == ["a", "b", "new", "b"]


def test_placeholders_and_blanks(spark):
    found = ops.placeholders(paras(spark, "{{ b }} {{a.x}} {{bad name}} {{}}", "{{a.x}}"))
    assert rows(found.select("name", "n", "ord"), "ord") == [("b", 1, 1), ("a.x", 2, 2)]
    assert rows(ops.collapse_blanks(paras(spark, "", " ", "a", "", "", "b")).select("para_idx", "new_idx"), "para_idx") == [(0, 0), (2, 1), (3, 2), (5, 3)]


def test_markers_reset(spark):
    df = spark.createDataFrame([(1, i, lv, t) for i, (lv, t) in enumerate([(1, "a"), (2, "b"), (2, "1. c"), (1, "d"), (3, "e"), (2, "f")])], "doc_id long, ord long, level long, text string")
    assert [r[0] for r in rows(numbering.list_markers(df).orderBy("ord").select("marker"))] == ["1.", "1.1.", "1.2.", "2.", "2.1.1.", "2.1."]
    assert [r[0] for r in rows(numbering.outline_markers(df).orderBy("ord").select("marker"))] == ["1.", "가.", "나.", "2.", "1)", "가."]
    assert [r[0] for r in rows(numbering.heading_numbers(df).orderBy("ord").select("number"))] == ["1.", "1-1.", None, "2.", "2-1-1.", "2-1."]


def cells(spark, *c):
    return spark.createDataFrame([(1, *x) for x in c], "table_id long, row_idx long, col_idx long, row_span int, col_span long, text string")


def test_grid_merge_then_split_is_whole(spark):
    base = cells(spark, (0, 0, 1, 1, "a"), (0, 1, 1, 1, ""), (1, 0, 1, 1, "c"), (1, 1, 1, 1, "d"))
    merged = grid.merge_cells(base, 0, 0, 1, 1)
    assert rows(merged) == [(1, 0, 0, 2, 2, "a\nc\nd")]
    assert grid.invariants(merged).first().valid and grid.split_cells(merged).count() == 4
    bad = grid.invariants(cells(spark, (0, 0, 1, 2, "a"), (0, 1, 1, 1, "b"), (1, 0, 1, 1, "c"))).first()
    assert (bad.overlaps, bad.gaps, bad.valid) == (1, 1, False)
    crossing = cells(spark, (0, 0, 1, 2, "a"), (1, 0, 1, 1, "b"), (1, 1, 1, 1, "c"))
    assert rows(grid.merge_cells(crossing, 0, 0, 1, 0), "row_idx", "col_idx") == rows(crossing, "row_idx", "col_idx")


def test_grid_add_then_delete_column(spark):
    base = cells(spark, (0, 0, 1, 2, "a"), (1, 0, 1, 1, "b"), (1, 1, 1, 1, "c"))
    wide = grid.insert_column(base, 1)
    assert grid.invariants(wide).first().valid
    assert rows(grid.delete_column(wide, 1), "row_idx", "col_idx") == rows(base, "row_idx", "col_idx")
    assert grid.invariants(grid.add_rows(base, 1, 2)).first().n_rows == 4
    assert rows(grid.delete_row(cells(spark, (0, 0, 1, 1, "x")), 0)) == [(1, 0, 0, 1, 1, "x")]
    assert grid.csv(base).first().csv == "a,\nb,c"


def test_lookups(spark):
    styles = spark.createDataFrame([(1, None, 10), (2, 1, None), (3, 2, None), (4, 5, None), (5, 4, 1)], "id long, parent long, size int")
    assert rows(lookup.inherit(styles, ["size"]), "id") == [(1, 10, False), (2, 10, False), (3, 10, False), (4, 1, True), (5, 1, True)]
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 9)], "p int, at int")
    right = spark.createDataFrame([(1, 2, "a"), (1, 5, "b"), (1, 9, "c")], "p int, at int, v string")
    assert rows(lookup.asof(left, right, "p", "at", "v").select("p", "at", "v"), "p", "at") == [(1, 1, None), (1, 5, "b"), (2, 9, None)]
    spans = spark.createDataFrame([(1, 0, 25), (1, 20, 30)], "p int, start long, end long")
    points = spark.createDataFrame([(1, 24), (1, 30)], "p int, at long")
    assert rows(lookup.interval_join(points, spans, "p", "at", 10).select("at", "start"), "start") == [(24, 0), (24, 20)]


def test_ledger(spark):
    a, b = spark.createDataFrame([("x",)] * 3 + [("y",)], "k string"), spark.createDataFrame([("x",), ("z",)], "k string")
    assert rows(ledger.removed(a, b, "k"), "k") == [("x", 2), ("y", 1)]
    issues = spark.createDataFrame([("c", i, d) for i, d in enumerate("abcdea")], "code string, ord long, detail string")
    r = ledger.issue_buckets(issues).first()
    assert (r["count"], len(r.samples), r.complete) == (6, 4, False)


def test_templates(spark):
    values = spark.createDataFrame([(1, '{"n": 5, "s": "x"}'), (2, '{"n": "5"}'), (3, '{"n": 50, "s": null}')], "key long, data string")
    found = template.validate(values, [{"name": "n", "type": "number", "max": 10}, {"name": "s", "type": "string", "required": True}])
    assert rows(found, "key", "name") == [(2, "n", "type_mismatch"), (2, "s", "required_missing"), (3, "n", "above_maximum"), (3, "s", "required_missing")]
    with pytest.raises(ValueError, match="unknown edits"):
        template.plan([("paint", {})])


def test_compound_files():
    rng = random.Random(1)
    for _ in range(20):
        own = {f"/{rng.choice(['A', 'B/C'])}/S{i}": rng.randbytes(rng.choice([0, 1, 64, 4095, 4096, 70000])) for i in range(rng.randint(1, 9))}
        data = compound.write_streams(own)
        assert compound.read_streams(data) == dict(sorted(own.items()))
        for cut in (0, 100, 600, len(data) // 2):
            try:
                compound.read_streams(data[:cut])
            except (compound.CompoundError, Exception) as e:
                assert not isinstance(e, MemoryError)


def test_records():
    for size in (0, 1, 0xFFE, 0xFFF, 70000):
        data = records.encode_record(67, 3, b"x" * size)
        assert len(data) == size + (8 if size >= 0xFFF else 4)
        assert records.scan(data) == [(0, 67, 3, b"x" * size, None)]
    assert records.scan(data[:-1])[0][4] == "truncated"
    with pytest.raises(ValueError, match="cut off"):
        records.scan(data[:-1], strict=True)
    assert records.parents([0, 1, 2, 1, 5, 0]) == [-1, 0, 1, 0, 3, -1]
    assert records.plain(records.encode_text("a\tb\nc😀")) == "a\tb\nc😀"
    with pytest.raises(ValueError, match="limit"):
        records.inflate(records.deflate(bytes(10000)), 100)


def test_packages_refuse_what_breaks_limits():
    data = packages.write_sections([["a", "", " b <&> "]])
    assert packages.read_sections(data) == [["a", "", " b <&> "]] and packages.intact(data)
    for limits in ({"entries": 1}, {"entry_bytes": 5}, {"total_bytes": 10}, {"xml_bytes": 3}):
        with pytest.raises(packages.PackageError):
            packages.read_sections(data, packages.LIMITS | limits)
    with pytest.raises(packages.PackageError):
        packages.read_sections(packages.zipped([("../x", "y" * 10)]))
    assert packages.read_sections(packages.replace_in_package(data, "a", "aa")) == [["aa", "", " b <&> "]]


def test_folio_source(spark, tmp_path):
    from folio.sources.docir import FolioSource

    spark.dataSource.register(FolioSource)
    out = str(tmp_path / "docs")
    for kind in frames.WRITERS:
        df = spark.createDataFrame([(f"{kind}{i}", ["a", f"b{i}"]) for i in range(3)], "name string, paragraphs array<string>")
        df.write.format("folio").option("kind", kind).mode("append").save(out)
    (tmp_path / "docs" / "junk.bin").write_bytes(b"PK junk")
    got = spark.read.format("folio").load(out)
    assert got.where("error is null").count() == 24 and got.where("error is not null").count() == 1
    assert {r.format for r in got.where("error is null").collect()} == set(frames.WRITERS)


def test_markup():
    md = "# T #\n\npara\nmore\n- a\n  - b\n1. c\n> q\n```x\n# no\n```\n---\n| a | b\\|c |\n|---|:-:|\n| 1 | 2 |"
    assert markup.markdown_blocks(md) == [("heading", 1, "T"), ("paragraph", 0, "para more"), ("bullet", 0, "a"), ("bullet", 1, "b"), ("ordered", 0, "c"), ("quote", 0, "q"), ("code", 0, "# no"), ("rule", 0, ""), ("row", 0, "a\tb|c"), ("row", 1, "1\t2")]
    assert markup.fragment_blocks("<p>a <b>b</b></p><h2>c</h2>") == [("p", "a b"), ("h2", "c")]
    for bad in ("<p>a", "<script/>", "<p>a</b></p>"):
        with pytest.raises(ValueError, match="."):
            markup.fragment_blocks(bad)
    assert markup.place_spans([[(1, 2), (2, 1)], [(1, 1), (1, 1)]]) == [(0, 0, 1, 2), (0, 2, 2, 1), (1, 0, 1, 1), (1, 1, 1, 1)]
    for bad in ([[(2, 1)]], [[(1, 0)]], [[(1, 1), (2, 1)], [(1, 2)]]):
        with pytest.raises(ValueError, match="span"):
            markup.place_spans(bad)


def test_streams_equal_tables(spark, tmp_path):
    from folio.streaming.folds import event_ledger, list_counters, stream_table

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(500)
    src = str(tmp_path / "e")
    events.repartition(2).write.parquet(src)
    q = event_ledger(stream_table(spark, src, 10), "10 minutes").writeStream.format("memory").queryName("ledger").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(rows(spark.table("ledger"))) == sorted(rows(event_ledger(events, "10 minutes")))
    heads = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 2, 2), (1, 3, 1)], "doc_id long, ord long, level int")
    path = str(tmp_path / "h")
    heads.coalesce(1).write.parquet(path)
    q = list_counters(stream_table(spark, path)).writeStream.format("memory").queryName("markers").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.marker for r in spark.table("markers").orderBy("ord").collect()] == ["1.", "1.1.", "1.2.", "2."]


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).limit(1).count() == 1


def test_protected_sections():
    import hashlib

    from folio.sources import distribution, properties

    key, block = bytes(range(16)), bytes.fromhex("00112233445566778899aabbccddeeff")
    assert distribution.encrypt(key, block).hex() == "69c4e0d86a7b0430d8cdb78070b4c55a"
    assert distribution.decrypt(key, distribution.encrypt(key, block * 3)) == block * 3
    body = records.body_stream(["a", "é"])
    sealed = distribution.seal_section(body, 77, hashlib.sha1(b"k").hexdigest())
    assert records.stream_paragraphs(distribution.open_section(sealed)) == ["a", "é"]
    for bad in (b"", sealed[:100], sealed[:261], b"\0" * 300):
        with pytest.raises(ValueError, match="."):
            distribution.open_section(bad)
    meta = {"title": "제목", "author": "é", "create_time": 134026795700000000}
    assert properties.read(properties.write(meta)) == meta and properties.read(b"") == properties.read(b"\xfe\xff") == {}
