"""Hostile bytes, session settings, data that looks like a template, and rewrites that copy."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from folio.functions import numbers as fn
from folio.operators import ledger, lookup, template
from folio.sources import frames, packages


def test_hostile_bytes_are_rows_with_an_error(spark):
    good = packages.write_sections([["a", "b"]])
    df = spark.createDataFrame([(1, good), (2, good[:40]), (3, b""), (4, None), (5, b"\xff" * 3000)], "doc_id long, content binary")
    for found, column in ((frames.zip_entries(df), "entries"), (frames.streams(df), "streams"), (frames.scan_records(df, "content"), "records")):
        rows = {r.doc_id: r for r in found.collect()}
        assert len(rows) == 5 and all((r[column] is None) == (r.error is not None) for r in rows.values())
    assert {r.doc_id for r in frames.zip_entries(df).where("error is null").collect()} == {1}


def test_packages_of_all_kinds_keep_the_limits():
    def bomb(name, manifest=None):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr(name, b"<a>" + b" " * 3_000_000 + b"</a>")
            if manifest:
                z.writestr("META-INF/manifest.xml", manifest)
        return out.getvalue()

    for name, read in (("word/document.xml", packages.read_docx), ("content.xml", packages.read_odt), ("Contents/section0.xml", packages.read_sections)):
        with pytest.raises(packages.PackageError):
            read(bomb(name))
    plain = packages.write_sections([["text about encryption-data"]], title="encryption")
    assert packages.read_sections(plain) == [["text about encryption-data"]]
    sealed = packages.zipped([("mimetype", packages.MIMETYPE), ("META-INF/manifest.xml", '<m:manifest xmlns:m="urn:x"><m:file-entry><m:encryption-data/></m:file-entry></m:manifest>')])
    with pytest.raises(packages.PackageError, match="encrypted"):
        packages.read_sections(sealed)


def test_rewrites_copy_what_they_do_not_change():
    data = packages.write_sections([["one old thing"], ["nothing here"]], title="old")
    changed = packages.replace_in_package(data, "old", "much newer & longer")
    assert packages.read_sections(changed) == [["one much newer & longer thing"], ["nothing here"]] and packages.intact(changed)
    assert packages.metadata(changed) == {"title": "old"} and packages.replace_in_package(data, "absent", "x") == data
    with zipfile.ZipFile(io.BytesIO(data)) as a, zipfile.ZipFile(io.BytesIO(changed)) as b:
        assert [x.filename for x in a.infolist()] == [x.filename for x in b.infolist()]
        for x, y in zip(a.infolist(), b.infolist(), strict=True):
            if x.filename != "Contents/section0.xml":
                assert data[x.header_offset : x.header_offset + 30 + x.compress_size] == changed[y.header_offset : y.header_offset + 30 + y.compress_size]


@pytest.mark.parametrize("zone", ["UTC", "Asia/Seoul", "America/St_Johns"])
def test_file_times_in_any_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        ft = spark.createDataFrame([(125_911_584_000_000_000,), (0,), (125_911_584_000_000_000 + 3_661 * 10_000_000,)], "ft long")
        rows = ft.select(fn.filetime_iso(F.col("ft")).alias("iso"), fn.filetime_korean(F.col("ft")).alias("ko")).collect()
        assert [r.iso for r in rows] == ["2000-01-01T00:00:00Z", None, "2000-01-01T01:01:01Z"]
        assert rows[0].ko == "2000년 1월 1일 토요일 오전 9:00:00" and rows[1].ko is None
        again = ft.select("ft", fn.iso_to_filetime(fn.filetime_iso(F.col("ft"))).alias("again")).where("ft <> 0").collect()
        assert all(r.ft == r.again for r in again)
        bad = spark.createDataFrame([("2000-02-30T00:00:00Z",), ("x",), (None,)], "s string").select(fn.iso_to_filetime(F.col("s")).alias("f")).collect()
        assert [r.f for r in bad] == [None] * 3
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_values_are_no_templates(spark):
    scalars = spark.createDataFrame([(1, "${no}", 7)], "key long, name string, no long")
    items = spark.createDataFrame([], "key long, at long, item string")
    out = template.expand(scalars, items, [template.Node("Dear ${name}, ${no} ${other}")], "key", "at", ["name", "no"]).collect()
    assert [r.text for r in out] == ["Dear ${no}, 7 ${other}"]


def test_interval_join_of_long_spans(spark):
    spans = [(1, 0, 10_000_000), (1, 5, 6), (1, 100, 100), (2, -50, 50), (1, 999, 70_001)]
    points = [(p, k) for p in (1, 2) for k in (-50, 0, 5, 6, 49, 50, 999, 70_000, 70_001, 9_999_999, 10_000_000)]
    got = lookup.interval_join(spark.createDataFrame(points, "part long, at long"), spark.createDataFrame(spans, "part long, start long, end long"), "part", "at", 10)
    want = sorted((p, k, s, e) for p, k in points for q, s, e in spans if p == q and s <= k < e)
    assert sorted((r.part, r.at, r.start, r.end) for r in got.collect()) == want


def test_overlaps_by_strips_equal_all_pairs(spark):
    import random

    rng = random.Random(1)
    boxes = [(p, i, rng.randint(0, 3) * 10.0, x, x + rng.choice([0.0, 1.0, 5.0, 80.0])) for p in (1, 2) for i in range(40) for x in [rng.uniform(-50, 100)]]
    got = lookup.overlaps(spark.createDataFrame(boxes, "page long, item long, y double, x0 double, x1 double"), "page", 0.5).collect()
    want = []
    for p, i, y, a, b in boxes:
        for q, j, z, c, d in boxes:
            inner = min(b, d) - max(a, c)
            if p == q and i < j and y != z and inner > 0 and inner >= 0.5 * min(b - a, d - c):
                want.append((p, i, j))
    assert sorted((r.page, r.item_a, r.item_b) for r in got) == sorted(want)


def test_manifest_of_a_part_is_hashed_in_blocks(spark):
    df = spark.range(3500).select((F.col("id") % 2).alias("part"), "id", F.sha2(F.col("id").cast("string"), 256).alias("d"), F.lit(2).alias("size"))
    rows = ledger.manifest(df, "part", "id", "d", "size").collect()
    assert [(r.artifacts, r.bytes) for r in rows] == [(1750, 3500)] * 2 and len({r.manifest for r in rows}) == 2
    again = ledger.manifest(df.repartition(7), "part", "id", "d", "size").collect()
    assert {tuple(r) for r in again} == {tuple(r) for r in rows}
