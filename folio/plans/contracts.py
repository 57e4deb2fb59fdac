"""Queries over names, selections, specifications and evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contracts as op
from .registry import query, table

_STEM = "regexp_replace(regexp_extract(url, '([^/\\\\]*)$', 1), '\\.[^.]*$', '')"


@query("stem_collisions", f"select {_STEM} as stem, count(*) as n from pages group by 1 having count(*) > 1")
def stem_collisions(spark, sf):
    return op.collisions(table(spark, sf, "pages"), "url")


@query("section_entries", "select p_partkey, case when p_partkey % 3 <> 0 then p_partkey end as idx from part")
def section_entries(spark, sf):
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("Contents/x"), "p_partkey", F.lit(".xml"))).otherwise(F.concat(F.lit("Contents/section"), "p_partkey", F.lit(".xml")))
    return table(spark, sf, "part").select("p_partkey", op.section_index(name).cast("long").alias("idx"))


@query("page_selection", "select p_partkey, unnest(case when p_size % 3 = 0 then range(1, p_size + 1) when p_size % 3 = 1 then range(2, least(5, p_size) + 1) else range(7, least(7, p_size) + 1) end) as page from part")
def page_selection(spark, sf):
    spec = F.when(F.col("p_size") % 3 == 0, "all").when(F.col("p_size") % 3 == 1, "2-5").otherwise("7")
    return table(spark, sf, "part").select("p_partkey", F.explode(op.page_selection(spec, F.col("p_size"))).alias("page")).withColumn("page", F.col("page").cast("long"))


@query("root_namespaces", "select lang as part, concat('p', doc_id % 3) as prefix, arg_min(concat('urn:', doc_id), doc_id) as uri from documents group by all")
def root_namespaces(spark, sf):
    xml = F.concat(F.lit("<sec xmlns:p"), F.col("doc_id") % 3, F.lit('="urn:'), "doc_id", F.lit('">'))
    return op.namespaces(table(spark, sf, "documents").select(F.col("lang").alias("part"), "doc_id", xml.alias("xml")), "part", "doc_id", "xml")


@query("css_rules", "select doc_id, name, body from (select doc_id, unnest(['cs1', 'ps2']) as name, unnest([concat('color: ', lang), concat('size: ', n_chars)]) as body from documents)")
def css_rules(spark, sf):
    css = F.concat(F.lit(".cs1 { color: none } .ps2{size: "), "n_chars", F.lit("} .cs1 {color: "), "lang", F.lit(" } .other {x: y}"))
    return op.style_rules(table(spark, sf, "documents").select("doc_id", css.alias("css")), "doc_id", "css")


@query("external_references", "select page_id, case when regexp_matches(html, '(href|src)=\"https?:') then true when page_id % 2 = 0 then false end as external from pages")
def external_references(spark, sf):
    targets = F.regexp_extract_all("html", F.lit(r'(?:href|src)="([^"]*)"'), 1)
    return table(spark, sf, "pages").select("page_id", op.external_reference(targets, F.col("page_id") % 2 == 0).alias("external"))


@query("edit_specs", "select o_orderkey, o_orderstatus as old, o_orderpriority as new, o_custkey % 7 as row_idx, concat(o_orderstatus, '=', o_orderkey) as text from orders")
def edit_specs(spark, sf):
    replace = op.parse_replace(F.concat("o_orderstatus", F.lit("=>"), "o_orderpriority"))
    cell = op.parse_cell(F.concat_ws(":", F.col("o_orderkey"), F.col("o_custkey") % 7, F.concat(F.lit("2="), "o_orderstatus", F.lit("="), "o_orderkey")))
    return table(spark, sf, "orders").select("o_orderkey", replace.alias("r"), cell.alias("c")).select("o_orderkey", "r.old", "r.new", F.col("c.row_idx").cast("long").alias("row_idx"), "c.text")


@query("apply_meta", "select doc_id, case when doc_id % 3 = 0 then concat('T', doc_id) when doc_id % 3 = 1 then null else source end as title from documents")
def apply_meta(spark, sf):
    k = F.col("doc_id") % 3
    spec = F.when(k == 0, F.concat(F.lit("title=T"), "doc_id")).when(k == 1, "title=").otherwise("author=x")
    return table(spark, sf, "documents").select("doc_id", op.apply_meta(F.col("source"), "title", spec).alias("title"))


@query("font_rule", """select user_id, list_sort(list_filter([case when bool_or(event_type not in ('view', 'click', 'purchase', 'signup')) then 'font_not_allowed' end, case when bool_or(value > 90) then 'font_substituted' end, case when bool_or(value < 0.3) then 'font_missing' end], lambda x: x is not null)) as reasons from events group by 1""")
def font_rule(spark, sf):
    fonts = table(spark, sf, "events").select("user_id", F.col("event_type").alias("name"), (F.col("value") > 90).alias("substituted"), (F.col("value") < 0.3).alias("missing"))
    return op.font_rule(fonts, "user_id", ["view", "click", "purchase", "signup"])


@query("corpus_gate", "select doc_id, count(*) * 2 as runs, doc_id % 3 <> 0 and count(distinct text) <= 1 as deterministic from documents group by 1")
def corpus_gate(spark, sf):
    """Two runs of a case, a document; the second one of every third differs."""
    docs = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    again = docs.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    runs = docs.unionByName(again).select("doc_id", F.sha2("text", 256).alias("digest"))
    return op.two_runs(runs, "doc_id", "digest")


@query("delete_objects", "select event_id, user_id, event_type from events e where not exists (select 1 from (select user_id, min(event_id) as first from events where event_type = 'error' group by 1) f where f.user_id = e.user_id and f.first = e.event_id)")
def delete_objects(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    chosen = events.where("event_type = 'error'").groupBy("user_id").agg(F.min("event_id").alias("event_id"))
    return op.delete_objects(events, chosen, ["user_id", "event_id"])


@query("fill_tables", "select o_custkey as table_id, 2 + row_number() over (partition by o_custkey order by o_orderkey) - 1 as row_idx, o_orderstatus as c0, cast(o_orderkey as varchar) as c1, greatest(0, 2 + count(*) over (partition by o_custkey) - 5) as grown from orders")
def fill_tables(spark, sf):
    """Data rows from row 2 of tables of five rows; tables grow by what does not fit."""
    from ..operators import grid

    return grid.fill_rows(table(spark, sf, "orders"), "o_custkey", ["o_orderkey"], ["o_orderstatus", "o_orderkey"], 2, 5)


@query("document_info", "select source, count(*) as documents, list(distinct lang order by lang) as langs, max(n_chars) as longest, arg_max(doc_id, n_chars * 1000000 - doc_id) as longest_id from documents group by 1")
def document_info(spark, sf):
    return op.document_info(table(spark, sf, "documents"), "source", "lang", "n_chars", "doc_id")


@query("edit_grammars", """select p_partkey, case when p_size % 2 = 0 then concat('a:', p_brand) end as find, case when p_size % 2 = 0 then cast(p_size as varchar) end as bold, case when p_size % 3 = 0 then concat('dir/', p_brand, '.png') else concat('dir/x@', p_size, 'by2.png') end as path,
case when p_size % 3 = 0 then p_size * 1.0::double end as width, case when p_size % 3 = 0 then 2.5::double end as height, case when p_size % 5 <> 0 then p_size end as table_id, case when p_size % 5 = 1 then 'keep' when p_size % 5 <> 0 then 'blank' end as mode from part""")  # fmt: skip
def edit_grammars(spark, sf):
    s = F.col("p_size")
    form = F.when(s % 2 == 0, F.concat(F.lit("a:"), "p_brand", F.lit(":bold="), s, F.lit(",size=3"))).otherwise("no properties")
    image = F.when(s % 3 == 0, F.concat(F.lit("dir/"), "p_brand", F.lit(".png@"), s, F.lit(" x 2.5"))).otherwise(F.concat(F.lit("dir/x@"), s, F.lit("by2.png")))
    clone = F.concat(s, F.when(s % 5 == 0, F.lit("=> ")).otherwise(F.lit(" => spot")), F.when(s % 5 == 1, F.lit("=>keep")).otherwise(F.lit("")))
    rows = table(spark, sf, "part").select("p_partkey", op.parse_char_format(form).alias("f"), op.parse_image_size(image).alias("i"), op.parse_clone_table(clone).alias("c"))
    return rows.select("p_partkey", "f.find", F.col("f.props")["bold"].alias("bold"), "i.path", "i.width", "i.height", "c.table_id", "c.mode")
