"""Queries that write documents into containers and read them back."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from ..functions.text import escape_xml
from ..sources import frames, markup, records
from .registry import cells, paras, query, table

_TEXTS = "select doc_id, para_idx, regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g') as text from paras"


def _round(kind: str):
    def run(spark, sf):
        return frames.paragraphs(frames.read_files(frames.to_files(paras(spark, sf), kind)), "doc_id")

    return run


for _kind in frames.WRITERS:
    query(f"{_kind}_roundtrip", _TEXTS, ("paras",))(_round(_kind))


@query("package_entries", "select doc_id, unnest(['mimetype', 'version.xml', 'Contents/section0.xml', 'Contents/content.hpf']) as name, unnest([0, 1, 2, 3]) as idx from documents")
def package_entries(spark, sf):
    found = frames.zip_entries(frames.to_files(paras(spark, sf), "hwpx"))
    return found.select("doc_id", F.explode("entries").alias("e")).select("doc_id", "e.name", "e.idx")


@query("package_validate", "select doc_id, doc_id % 3 <> 0 as valid, doc_id % 3 <> 0 as type_first, case when doc_id % 3 <> 0 then 1 else 0 end::bigint as sections from documents")
def package_validate(spark, sf):
    """Every third package is of another kind, whose entries are not the ones that must be there."""
    docs = paras(spark, sf)
    other = F.col("doc_id") % 3 == 0
    found = frames.zip_entries(frames.to_files(docs.where(~other), "hwpx").unionByName(frames.to_files(docs.where(other), "docx")))
    each = found.select("doc_id", F.explode("entries").alias("e")).select("doc_id", "e.name", "e.idx")
    per = each.groupBy("doc_id").agg(F.collect_set("name").alias("n"), F.min_by("name", "idx").alias("first"), F.count_if(F.col("name").rlike("^Contents/section[0-9]+\\.xml$")).alias("sections"))
    missing = F.array_except(F.array(*map(F.lit, ("mimetype", "version.xml", "Contents/content.hpf"))), "n")
    return per.select("doc_id", ((F.size(missing) == 0) & (F.col("sections") > 0)).alias("valid"), (F.col("first") == "mimetype").alias("type_first"), "sections")


@query("compound_streams", "select doc_id, unnest(['/BodyText/Section0', '/FileHeader']) as name from documents")
def compound_streams(spark, sf):
    return frames.streams(frames.to_files(paras(spark, sf), "hwp5")).select("doc_id", F.explode("streams.name").alias("name"))


@query("record_scan", """select doc_id, unnest([para_idx * 2, para_idx * 2 + 1]) as idx, unnest([66, 67]) as tag, unnest([0, 1]) as level, unnest([22, 2 * length(text) + 2]) as size, unnest([-1, para_idx * 2]) as parent from paras""", ("paras",))
def record_scan(spark, sf):
    body = frames.streams(frames.to_files(paras(spark, sf), "hwp5")).select("doc_id", F.filter("streams", lambda s: s["name"] == "/BodyText/Section0")[0]["data"].alias("data"))
    return frames.scan_records(body, "data").select("doc_id", F.explode("records").alias("r")).select("doc_id", "r.idx", "r.tag", "r.level", "r.size", "r.parent")


@query("broken_containers", "select doc_id, case when doc_id % 3 = 0 then 'unknown format' else 'broken' end as error from documents")
def broken_containers(spark, sf):
    """Cut-off files of two kinds and files of none: each becomes a row with an error, no task fails."""
    docs = paras(spark, sf)
    cut = lambda kind: frames.to_files(docs, kind).withColumn("content", F.substring("content", 1, 30))
    k = F.col("doc_id") % 3
    files = cut("hwpx").where(k == 1).unionByName(cut("hwp5").where(k == 2)).unionByName(table(spark, sf, "documents").where(k == 0).select("doc_id", F.col("text").cast("binary").alias("content")))
    return frames.read_files(files).select("doc_id", F.when(k == 0, F.col("error")).when(F.col("error").isNotNull(), "broken").alias("error"))


@query("markdown_blocks", """select doc_id, para_idx as ord, case when para_idx % 3 = 0 then 'heading' when para_idx % 3 = 2 then 'quote' when regexp_matches(text, '^[ \\t]*(-[ \\t]*){2,}$') then 'rule' else 'bullet' end as kind from paras""", ("paras",))
def markdown_blocks(spark, sf):
    """All lines, empty ones and those that begin with marks or accents too."""
    markup.register(spark)
    k = F.col("para_idx") % 3
    lines = paras(spark, sf).withColumn("md", F.concat(F.when(k == 0, "# ").when(k == 1, "- ").otherwise("> "), "text"))
    lines.createOrReplaceTempView("folio_md_all_lines")
    return spark.sql("select doc_id, para_idx as ord, b.kind from folio_md_all_lines, lateral md_blocks(md) b")


@query("html_fragments", """select doc_id, case when not regexp_matches(t, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]') then 'p' end as tag, case when not regexp_matches(t, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]') then trim(regexp_replace(t, '[\\s\\x{85}\\pZ]+', ' ', 'g')) end as text
from (select doc_id, coalesce(text, '') as t from documents)""")  # fmt: skip
def html_fragments(spark, sf):
    """All documents, escaped; one with characters that XML has not is a row that was refused."""
    markup.register(spark)
    docs = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("<p>"), escape_xml(F.coalesce("text", F.lit(""))), F.lit("</p>")).alias("html"))
    docs.createOrReplaceTempView("folio_all_fragments")
    return spark.sql("select doc_id, b.tag, b.text from folio_all_fragments, lateral html_blocks(html) b")


@query("html_rejects", "select page_id, page_id % 2 = 1 as refused from pages")
def html_rejects(spark, sf):
    """Whole raw pages, which are no fragments, and the same pages as the escaped text of one."""
    markup.register(spark)
    clean = F.regexp_replace(F.coalesce("html", F.lit("")), "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\ufffe\\uffff]", "")
    html = F.when(F.col("page_id") % 2 == 1, F.concat(F.lit("<main>"), clean)).otherwise(F.concat(F.lit("<p>"), escape_xml(clean), F.lit("</p>")))
    table(spark, sf, "pages").select("page_id", html.alias("html")).createOrReplaceTempView("folio_pages")
    return spark.sql("select page_id, bool_or(b.error is not null) refused from folio_pages, lateral html_blocks(html) b group by page_id")


query("distribution_decrypt", _TEXTS, ("paras",))(_round("distribution"))


@query("summary_info", "select doc_id, nullif(left(lang, 20), '') as title, source as author, case when n_chars > 0 then n_chars end as create_time from documents")
def summary_info(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("title"), F.col("source").alias("author"), F.col("n_chars").alias("create_time"))
    sets = frames.property_sets(docs, ["title", "author", "create_time"]).select("doc_id", "content")
    return frames.summaries(sets, "content").select("doc_id", "summary.title", "summary.author", "summary.create_time")


@query("para_text_decode", """with t as (select conv_id, turn, replace(text, chr(10), ' ') as text from conversations)
select conv_id, turn, length(text) + 2 as elements, length(text) + 9 as units, count(*) over () * 0 + 1 as inline from t""")  # fmt: skip
def para_text_decode(spark, sf):
    """A tab control of eight units, the text, and the paragraph end."""
    body = F.concat(F.unhex(F.lit("09000000000000000000000000000900")), F.encode(F.replace("text", F.lit("\n"), F.lit(" ")), "UTF-16LE"), F.unhex(F.lit("0D00")))
    found = frames.decode_texts(table(spark, sf, "conversations").select("conv_id", "turn", body.alias("data")), "data")
    last = F.element_at("elements", -1)["at"] + 1
    return found.select("conv_id", "turn", F.size("elements").cast("long").alias("elements"), last.cast("long").alias("units"), F.size(F.filter("elements", lambda e: e["kind"] == "inline")).cast("long").alias("inline"))


@query("record_dump", """select doc_id, unnest([para_idx * 2, para_idx * 2 + 1]) as idx, unnest(['PARA_HEADER', 'PARA_TEXT']) as name, unnest([2, 1]) as nodes, unnest([44, 4 * length(text) + 4]) as digits from paras""", ("paras",))
def record_dump(spark, sf):
    body = frames.streams(frames.to_files(paras(spark, sf), "hwp5")).select("doc_id", F.filter("streams", lambda s: s["name"] == "/BodyText/Section0")[0]["data"].alias("data"))
    return frames.dump(body, "data").select("doc_id", "idx", "name", "nodes", F.length("payload").alias("digits"))


@query("record_rewrite", "select doc_id, doc_id % 4 <> 0 as same, case when doc_id % 4 = 0 then 1 else 0 end as errors from documents")
def record_rewrite(spark, sf):
    """Streams read as forests and written again, each met with what it was in its own row; every fourth one is cut off."""
    k = F.col("doc_id") % 4
    body = frames.streams(frames.to_files(paras(spark, sf), "hwp5")).select("doc_id", F.filter("streams", lambda s: s["name"] == "/BodyText/Section0")[0]["data"].alias("data"))
    given = body.select("doc_id", F.col("data").alias("whole"), F.when(k == 0, F.unhex(F.lit("FFFF"))).otherwise(F.col("data")).alias("data"))
    again = frames.rewrite_records(given, "data").select("doc_id", "error", F.struct("stream", "whole").alias("both"))
    met = frames.map_column(again, lambda rows: pa.array([x["stream"] == records.inflate(x["whole"]) for x in rows], pa.bool_()), "both", "same", "boolean")
    return met.select("doc_id", "same", F.when(F.col("error").isNotNull(), 1).otherwise(0).alias("errors"))


@query("table_records", "select table_id, 0 as table, row_idx, col_idx, row_span, col_span, 1000 * col_span as width, 500 as height, text from cells", ("cells",))
def table_records(spark, sf):
    """Tables written as records of body streams and read again, spans and sizes included."""
    return frames.read_cells(frames.table_streams(cells(spark, sf)), "content").drop("error")


@query("header_gate", "select doc_id, case when doc_id % 3 = 0 then null when doc_id % 3 = 1 then '5.0.3.0' else '5.0.3.0' end as version, case when doc_id % 3 = 1 then 'compressed' when doc_id % 3 = 2 then 'compressed,distribution' end as flags, case when doc_id % 3 = 0 then null else true end as readable, case when doc_id % 3 = 0 then 1 else 0 end as errors from documents")
def header_gate(spark, sf):
    """Plain and distribution files, and packages, which have no such header."""
    docs, k = paras(spark, sf), F.col("doc_id") % 3
    files = frames.to_files(docs.where(k == 1), "hwp5").unionByName(frames.to_files(docs.where(k == 2), "distribution")).unionByName(frames.to_files(docs.where(k == 0), "hwpx"))
    return frames.gate(files).select("doc_id", "version", F.array_join("flags", ",").alias("flags"), "readable", F.when(F.col("error").isNotNull(), 1).otherwise(0).alias("errors"))


@query("preview_text", "select conv_id, turn, text from conversations")
def preview_text(spark, sf):
    """Previews as UTF-16 with and without a mark, and as UTF-8."""
    k, t = F.col("turn") % 3, F.col("text")
    raw = F.when(k == 0, F.concat(F.unhex(F.lit("FFFE")), F.encode(t, "UTF-16LE"))).when(k == 1, F.encode(t, "UTF-16LE")).otherwise(F.encode(t, "UTF-8"))
    docs = table(spark, sf, "conversations").select("conv_id", "turn", raw.alias("raw"))
    return docs.select("conv_id", "turn", frames.previews(docs, "raw").alias("text"))


@query("package_tables", "select table_id, 0 as table, row_idx, col_idx, row_span, col_span, 1000 * col_span as width, 500 * row_span as height, text from cells", ("cells",))
def package_tables(spark, sf):
    """Tables written into packages and read again, spans and sizes included."""
    return frames.package_cells(frames.packages_of(cells(spark, sf))).drop("error")


@query("package_structure", "select doc_id, 0 as section, count(*) as paragraphs, 0 as tables, 0 as pictures, cast(sum(length(regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g'))) as bigint) as chars from paras group by doc_id", ("paras",))
def package_structure(spark, sf):
    return frames.structures(frames.to_files(paras(spark, sf), "hwpx")).drop("error")


@query("archive_limits", "select doc_id, doc_id % 2 = 0 and count(*) < 200 as kept from paras group by doc_id having count(*) < 200", ("paras",))
def archive_limits(spark, sf):
    """Archives of three and of four entries against a limit of three."""
    docs = paras(spark, sf)
    short = docs.join(docs.groupBy("doc_id").count().where("count < 200").select("doc_id"), "doc_id", "left_semi")
    files = frames.to_files(short.where("doc_id % 2 = 0"), "docx").unionByName(frames.to_files(short.where("doc_id % 2 = 1"), "hwpx"))
    return frames.limited(files, {"entries": 3}).select("doc_id", "kept")


@query("package_replace", "select doc_id, para_idx, replace(regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g'), 'an', '<and>') as text from paras", ("paras",))
def package_replace(spark, sf):
    """A text replaced inside packages, then read again."""
    files = frames.replaced(frames.to_files(paras(spark, sf), "hwpx"), "an", "<and>")
    return frames.paragraphs(frames.read_files(files.drop("error")), "doc_id")


@query("place_spans", "select table_id, row_idx, col_idx, row_span, col_span from cells", ("cells",))
def place_spans(spark, sf):
    """Cells of HTML rows, which say spans but no columns, put into their first free slots."""
    rows = cells(spark, sf).groupBy("table_id", "row_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("col_idx", "row_span", "col_span"))), lambda x: F.struct(x["row_span"].cast("int").alias("r"), x["col_span"].cast("int").alias("c"))).alias("spans"))
    per = rows.groupBy("table_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", "spans"))), lambda x: x["spans"]).alias("rows"))
    kind = pa.list_(pa.struct([("row_idx", pa.int64()), ("col_idx", pa.int64()), ("row_span", pa.int64()), ("col_span", pa.int64())]))
    names = ("row_idx", "col_idx", "row_span", "col_span")
    put = lambda tables: pa.array([[dict(zip(names, p, strict=True)) for p in markup.place_spans([[(s["r"], s["c"]) for s in row] for row in t])] for t in tables], kind)
    found = frames.map_column(per, put, "rows", "places", "array<struct<row_idx: bigint, col_idx: bigint, row_span: bigint, col_span: bigint>>")
    return found.select("table_id", F.explode("places").alias("p")).select("table_id", "p.*")


@query("svg_canonical", """select p_partkey, case when p_size % 5 < 3 then concat('<svg viewBox="0 0 ', p_size, ' 10.5" xmlns="http://www.w3.org/2000/svg"><rect fill="#AB12EF" height="2" width="', p_size, '"/></svg>') end as svg, p_size % 5 >= 3 as refused from part""")
def svg_canonical(spark, sf):
    """Drawings of the subset, and ones with a script or a comment."""
    s = F.col("p_size")
    inside = F.when(s % 5 == 3, "<script>x</script>").when(s % 5 == 4, "<!-- x -->").otherwise(F.concat(F.lit("\n <rect width='+"), s, F.lit(".00' fill='#ab12ef' height='2e0'> </rect>")))
    text = F.concat(F.lit("<svg xmlns='http://www.w3.org/2000/svg' viewBox='0,0 "), s, F.lit(" 10.50'>"), inside, F.lit("</svg>"))
    found = frames.canonical_drawings(table(spark, sf, "part").select("p_partkey", text.alias("text")), "text")
    return found.select("p_partkey", "svg", F.col("error").isNotNull().alias("refused"))


def _int32(n):
    digits = F.lpad(F.hex(F.when(n < 0, n + 4294967296).otherwise(n)), 8, "0")
    return F.unhex(F.concat(*(F.substring(digits, 7 - 2 * i, 2) for i in range(4))))


@query("gradient_blocks", """select p_partkey, case when p_size % 4 <> 3 then p_size % 2 = 0 end as radial, case when p_size % 4 <> 3 then p_size * -1.0::double end as angle, case when p_size % 4 <> 3 then 255 end as step, case when p_size % 4 = 3 then null when p_size % 4 = 2 then [0.0, 0.25, 1.0] else [0.0, 1.0] end as places, case when p_size % 4 = 3 then null when p_size % 4 = 2 then [1, p_partkey, 7] else [1, p_partkey] end as colors from part""")
def gradient_blocks(spark, sf):
    """Blocks of two and of three colours, the latter with positions, and cut-off ones; positions are decimals, as the SQL's literals are."""
    s, p = F.col("p_size").cast("long"), F.col("p_partkey")
    head = F.concat(F.unhex(F.when(s % 2 == 0, "02").otherwise("01")), _int32(-s), _int32(F.lit(50).cast("long")), _int32(F.lit(50).cast("long")), _int32(F.lit(255).cast("long")))
    one = lambda n: _int32(F.lit(n).cast("long"))
    two = F.concat(head, one(2), one(1), _int32(p))
    three = F.concat(head, one(3), one(0), one(200), one(50), one(1), one(7), _int32(p))
    block = F.when(s % 4 == 3, F.substring(two, 1, 20)).when(s % 4 == 2, three).otherwise(two)
    found = frames.gradients(table(spark, sf, "part").select("p_partkey", block.alias("block")), "block")
    g = F.col("gradient")
    return found.select("p_partkey", "gradient.radial", "gradient.angle", "gradient.step", F.transform(g["stops"], lambda x: x["at"].cast("decimal(3,2)")).alias("places"), F.transform(g["stops"], lambda x: x["color"]).alias("colors"))
