"""Operators whose results SQL does not tell, against plain loops."""

import hashlib
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from folio.operators import controls, evidence, grid, layout, template
from folio.plans import QUERIES
from folio.sources import frames, packages, records

SF = "/root/testdata/sf0.001"


def extents_by_hand(cells, n, at, span, size):
    h = [0] * n
    for c in cells:
        if c[span] <= 1:
            h[c[at]] = max(h[c[at]], c[size])
    for c in sorted((c for c in cells if c[span] > 1), key=lambda c: (c["row_idx"], c["col_idx"])):
        own = range(c[at], min(c[at] + c[span], n))
        open_ = [i for i in own if h[i] == 0]
        if open_:
            rest = max(c[size] - sum(h[i] for i in own), 0)
            for i in open_:
                h[i] = rest // len(open_)
            h[open_[-1]] = rest - rest // len(open_) * (len(open_) - 1)
    rest = max(sum(h) // n, 1) if sum(h) > 0 else grid.ROW_HEIGHT
    return [x or rest for x in h]


def test_row_heights_equal_a_loop(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for t in range(60):
        n = rng.randint(1, 6)
        own = [{"table_id": t, "row_idx": r, "col_idx": c, "row_span": rng.choice([1, 1, 2, 3]), "height": rng.choice([0, 100, 250, 777])} for r in range(n) for c in range(rng.randint(1, 3))]
        rows += [dict(x, n=n) for x in own]
        want[t] = extents_by_hand(own, n, "row_idx", "row_span", "height")
    df = spark.createDataFrame(rows, "table_id long, row_idx long, col_idx long, row_span int, height long, n long")
    got = {}
    for r in grid.extents(df, "row_idx", "row_span", "height", "n").orderBy("table_id", "idx").collect():
        got.setdefault(r.table_id, []).append(r.extent)
    assert got == want
    assert grid.extents(df.limit(0), "row_idx", "row_span", "height", "n").count() == 0


def wrapped_by_hand(text, columns):
    import re

    done, line = [], ""
    for word in re.findall(r" *[^ ]+", text):
        if len(line) + len(word) <= columns:
            line += word
            continue
        if line:
            done.append(line)
        bare = word.lstrip(" ")
        cuts = [bare[i : i + columns] for i in range(0, max(len(bare), 1), columns)]
        done += cuts[:-1]
        line = cuts[-1]
    return done if done and not line else [*done, line]


def test_wrapped_words_equal_a_loop(spark):
    rng = random.Random(2)
    texts = ["", " ", "one", "a" * 25, *(" ".join("x" * rng.randint(1, 14) for _ in range(rng.randint(1, 9))).replace("x x", "x  x") for _ in range(80))]
    df = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "doc_id long, para_idx long, text string")
    got = {}
    for r in layout.wrap_words(df, 10).orderBy("doc_id", "line").collect():
        got.setdefault(r.doc_id, []).append(r.text)
    assert [got[i] for i in range(len(texts))] == [wrapped_by_hand(t, 10) for t in texts]
    with pytest.raises(ValueError, match="unknown alignment"):
        layout.align(layout.wrap_words(df, 10), "middle", 5.0)


def test_table_pages_equal_a_loop(spark):
    rows = spark.createDataFrame([(t, r, 1 + (t * 7 + r * 3) % 5) for t in range(20) for r in range(t)], "table_id long, row_idx long, height long")
    want = []
    for t in range(20):
        heights = [1 + (t * 7 + r * 3) % 5 for r in range(t)]
        if not heights:
            continue
        page, used, any_, out = 0, heights[0], False, []
        for r in range(1, t):
            if any_ and used + heights[r] > 9:
                page, used = page + 1, heights[0]
            out.append((t, r, page, used, False))
            used, any_ = used + heights[r], True
        want += [(t, 0, p, 0, p > 0) for p in range(page + 1)] + out
    got = [(r.table_id, r.row_idx, r.page, r.y, r.repeated) for r in layout.table_rows(rows, 9, 1).collect()]
    assert sorted(got) == sorted(want)


def test_document_digest_equals_json_lines(spark):
    got = {r.doc_id: r.digest for r in QUERIES["document_digest"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        rows = [{"para_idx": i, "text": t} for i, t in enumerate((r.text or "").split("\n"))]
        text = "[" + ",".join(json.dumps(x, ensure_ascii=False, separators=(",", ":")) for x in rows) + "]"
        assert got[r.doc_id] == hashlib.sha256(text.encode()).hexdigest()


def test_values_are_filled_once_and_all(spark):
    df = spark.createDataFrame([(1, 0, "{{a}} {{ b }} {{c}}"), (1, 1, "no {a} name")], "doc_id long, para_idx long, text string")
    full = template.fill_all(df, {"a": "{{b}}", "b": "$1\\", "c": ""})
    assert [r.text for r in full.orderBy("para_idx").collect()] == ["{{b}} $1\\ ", "no {a} name"]
    for values in ({"a": "1", "b": "2"}, {"a": "1", "b": "2", "c": "3", "d": "4"}):
        with pytest.raises(ValueError, match="not filled"):
            template.fill_all(df, values)
    assert template.fill_all(df, {}, partial=True).count() == 2


def test_written_rows_are_compared_with_what_is_read(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "id long, text string")
    evidence.verify(df, df)
    with pytest.raises(ValueError, match="written rows differ"):
        evidence.verify(df, df.distinct())


def test_fields_keep_their_places(spark):
    paras = spark.createDataFrame([(1, 0, "name: ada, town: x; end"), (1, 1, "none here"), (2, 0, "end")], "doc_id long, para_idx long, text string")
    held = spark.createDataFrame(
        [(1, 0, 0, "%clk", "who", None, 6, 9), (1, 0, 1, "%clk", "where", None, 17, 18), (1, 0, 2, "bokm", "b", None, 19, 19), (1, 1, 0, "head", "who", None, 0, 4)],
        "doc_id long, para_idx long, ctrl_idx int, ctrl_id string, name string, command string, start int, end int",
    )
    done, moved = controls.set_field(paras, held, "who", "grace hopper")
    assert {(r.doc_id, r.para_idx): (r.text, r.filled) for r in done.collect()} == {(1, 0): ("name: grace hopper, town: x; end", 1), (1, 1): ("none here", 0), (2, 0): ("end", 0)}
    assert [r.value for r in controls.list_fields(done, moved).orderBy("start").collect()] == ["grace hopper", "x"]
    again, moved = controls.set_field(done.drop("filled"), moved, "where", "")
    assert again.orderBy("doc_id", "para_idx").first().text == "name: grace hopper, town: ; end"
    linked, after = controls.create_hyperlink(again.drop("filled"), moved, "end", "http://x/;", "HERE")
    assert [r.text for r in linked.orderBy("doc_id", "para_idx").collect()] == ["name: grace hopper, town: ; endHERE", "none here", "endHERE"]
    link = after.where("ctrl_id = '%hlk'").orderBy("doc_id").collect()
    command = r"http\://x/\;;1;0;0;"
    assert [(r.ctrl_idx, r.start, r.end, r.command) for r in link] == [(3, 31, 35, command), (0, 3, 7, command)]
    marked, after = controls.create_bookmark(linked, after, "name", "top")
    assert [r.value for r in controls.list_fields(marked, after).where("doc_id = 1").orderBy("ctrl_idx").collect()] == ["grace hopper", "", "HERE"]
    assert controls.list_bookmarks(after).count() == 2 and controls.list_fields(paras, held.limit(0)).count() == 0
    assert len(controls.FIELD_IDS) == 33


def test_forests_and_tables_of_records():
    body = records.body_stream(["a", "b"])
    found = records.scan(records.inflate(body))
    up = records.parents([r[2] for r in found])
    assert records.serialize([(p, t, d) for (_, t, _, d, _), p in zip(found, up, strict=True)]) == records.inflate(body)
    assert records.count_under([-1, 0, 1, 0, -1]) == [4, 2, 1, 1, 1]
    rows = [[("a", 2, 1), ("b\tc", 1, 2)], [("", 1, 1), ("𝕏", 1, 1)]]
    flat = b"".join(records.encode_record(t, v, d) for v, t, d in records.write_table(rows))
    table = records.read_tables(flat)[0]
    assert (table["rows"], table["cols"]) == (2, 3)
    assert [(c["row"], c["col"], c["row_span"], c["col_span"]) for c in table["cells"]] == [(0, 0, 2, 1), (0, 1, 1, 2), (1, 1, 1, 1), (1, 2, 1, 1)]
    assert [c["paragraphs"] for c in table["cells"]][2:] == [[""], ["𝕏"]]
    for cut in range(0, len(flat), 7):
        records.read_tables(flat[:cut])


def test_broken_streams_of_tables_are_rows(spark):
    df = spark.createDataFrame([(1, b"\xff\xff"), (2, None)], "k long, content binary")
    rows = frames.read_cells(df, "content").collect()
    assert len(rows) == 2 and rows[0].error and all(r.text is None for r in rows)
    assert all(r.error for r in frames.gate(df).collect())


def test_issue_totals_with_state(spark, tmp_path):
    from folio.streaming.folds import issue_totals, stream_table

    batches = [[(1, "a", f"d{i}") for i in range(3)], [(1, "a", f"d{i}") for i in range(2, 9)] + [(2, "b", "x")], [(1, "c", None)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "key long, code string, detail string").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    for i in range(3):
        for f in (tmp_path / "in" / str(i)).glob("*.parquet"):
            f.rename(tmp_path / "in" / f"{i}.parquet")
    for name, most in (("issues_all", 100), ("issues_few", 5)):
        source = stream_table(spark, str(tmp_path / "in"))
        q = issue_totals(source, most).writeStream.format("memory").queryName(name).outputMode("update").trigger(availableNow=True).start()
        q.awaitTermination()
    best = {(r.key, r.code): r for r in spark.table("issues_all").orderBy("count").collect()}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert {k: r["count"] for k, r in best.items()} == {(1, "a"): 10, (2, "b"): 1, (1, "c"): 1}
    assert best[1, "a"].samples == sorted(digest(f"d{i}") for i in range(4)) and not best[1, "a"].complete and best[1, "a"].recorded
    few = {(r.key, r.code): r for r in spark.table("issues_few").orderBy("count", F.col("recorded").desc()).collect()}
    assert few[1, "a"]["count"] == 5 and not few[1, "a"].recorded and (1, "c") not in few


def test_picture_sizes(spark):
    df = spark.createDataFrame([(100, 50, None), (2000, 999, None), (0, 5, None), (10, 10, 12.5)], "w long, h long, mm double")
    rows = df.select(controls.picture_size(F.col("w"), F.col("h"), 42520, F.col("mm"), F.col("mm")).alias("s")).collect()
    assert [tuple(r.s) for r in rows] == [(7500, 3750), (42520, round(999 * 75 * 42520 / 150000)), (0, 375), (math.floor(12.5 * 7200 / 25.4 + 0.5),) * 2]


def test_tables_inside_tables():
    inner = [{"row": 0, "col": 0, "row_span": 1, "col_span": 1, "text": "deep"}]
    outer = [{"row": 0, "col": 0, "row_span": 1, "col_span": 2, "text": "a\nb"}, {"row": 1, "col": 1, "row_span": 1, "col_span": 1, "text": " <x> "}]
    data = packages.write_tables([outer, inner])
    assert [[(c["row"], c["col"], c["col_span"], c["text"]) for c in t] for t in packages.read_tables(data)] == [[(0, 0, 2, "a\nb"), (1, 1, 1, " <x> ")], [(0, 0, 1, "deep")]]
    nested = packages.table_xml(inner)
    xml = f'<hs:sec xmlns:hs="{packages.SECTION_NS}" xmlns:hp="{packages.PARA_NS}"><hp:p><hp:run><hp:t>before</hp:t>{packages.table_xml(outer).replace("<hp:run><hp:t", f"<hp:run>{nested}<hp:t", 1)}<hp:t>after</hp:t></hp:run></hp:p></hs:sec>'
    data = packages.zipped([("mimetype", packages.MIMETYPE), ("Contents/section0.xml", xml)])
    assert [[c["text"] for c in t] for t in packages.read_tables(data)] == [["a\nb", " <x> "], ["deep"]]
    assert sorted(packages.read_sections(data)[0]) == sorted(["beforeafter", "a", "deep", "b", " <x> "])
    assert packages.structure(data) == [{"paragraphs": 5, "tables": 2, "pictures": 0, "chars": 22}]
    assert packages.manifest(packages.write_tables([])) == [("section0", "Contents/section0.xml")]


def test_list_counters_refuse_what_comes_late(spark, tmp_path):
    from folio.streaming.folds import list_counters, stream_table

    for i, rows in enumerate([[(1, 5, 1)], [(1, 2, 1)]]):
        spark.createDataFrame(rows, "doc_id long, ord long, level long").coalesce(1).write.parquet(f"{tmp_path}/w/{i}")
        next((tmp_path / "w" / str(i)).glob("*.parquet")).rename(tmp_path / f"{i}.parquet")
    q = list_counters(stream_table(spark, f"{tmp_path}/*.parquet")).writeStream.format("memory").queryName("late").outputMode("append").trigger(availableNow=True).start()
    with pytest.raises(Exception, match="comes after"):
        q.awaitTermination()


def test_shell(capsys):
    from folio.__main__ import main

    assert main(["list"]) == 0 and "set_field" in capsys.readouterr().out.split()
    assert main(["run", "no_such", "x"]) == 2 and main([]) == 2


def test_drawings_of_the_subset_only():
    from folio.sources.drawing import DrawingError, canonical_svg, read_gradient

    root = '<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 1 1">{}</svg>'
    assert canonical_svg(root.format(" <g><line y2='-0.0' x1='1e3' stroke='#ffaa00'/></g>")) == '<svg viewBox="0 0 1 1" xmlns="http://www.w3.org/2000/svg"><g><line stroke="#FFAA00" x1="1000" y2="0"/></g></svg>'
    bad = ["<text>x</text>", "<rect onclick='x'/>", "<rect fill='url(#a)'/>", "<circle r='0'/>", "<rect width='-1'/>", "<polygon points='1 2 3 4 5'/>", "<rect x='nan'/>", "<rect x='1e9'/>", "words", "<!--x-->", "<?x?>", "<svg/>", "<rect", "<![CDATA[x]]>", "<g>" * 40 + "</g>" * 40]
    for inside in bad:
        with pytest.raises(DrawingError):
            canonical_svg(root.format(inside))
    for text in ("", "<g/>", '<?xml version="1.0"?>' + root.format(""), "<!DOCTYPE svg>" + root.format(""), '<svg viewBox="0 0 1 1"/>', root.format("") + root.format(""), root.format(" " * (1 << 20))):
        with pytest.raises(DrawingError):
            canonical_svg(text)
    assert read_gradient(b"") is None and read_gradient(b"\1" + bytes(20)) is None


def test_byte_windows_never_cut_characters(spark):
    from folio.operators.text import byte_window

    text = "aé日😀z"
    raw = text.encode()
    df = spark.createDataFrame([(text,), ("",), (None,)], "t string")
    for offset in range(len(raw) + 2):
        for most in (1, 2, 3, 4, 5, 20):
            got = [r.w for r in df.select(byte_window(F.col("t"), offset, most).alias("w")).collect()] if (offset + most) % 5 == 0 else None
            if got is None:
                continue
            whole = offset <= len(raw) and (offset == len(raw) or raw[offset] & 0xC0 != 0x80)
            end = min(offset + most, len(raw))
            while whole and end > offset and end < len(raw) and raw[end] & 0xC0 == 0x80:
                end -= 1
            assert (got[0].text if got[0] else None) == (raw[offset:end].decode() if whole else None), (offset, most)
            assert got[2] is None
