"""Queries over templates, contracts and edit plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import template as op
from .registry import paras, query, table


def _customers(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), (F.col("c_acctbal") > 4000).alias("rich"))


@query("template_expand", """with c as (select c_custkey as key, c_name as name, c_acctbal > 4000 as rich from customer), o as (select o_custkey as key, o_orderkey as no, o_orderstatus as status, row_number() over (partition by o_custkey order by o_orderkey) as sub from orders)
select key, 0 as ord, 0 as sub, concat('Dear ', name, ',') as text from c union all select key, 1, 0, 'Thank you.' from c where rich union all select key, 2, 0, 'Hello.' from c where not rich
union all select o.key, 3, sub, concat('Order ', no, ' for ', name, ': ', status) from o join c on o.key = c.key""")  # fmt: skip
def template_expand(spark, sf):
    items = table(spark, sf, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("no"), F.col("o_orderstatus").alias("status"))
    nodes = [op.Node("Dear ${name},"), op.Node("Thank you.", when="rich"), op.Node("Hello.", when="rich", negate=True), op.Node("Order ${no} for ${name}: ${status}", each=True)]
    return op.expand(_customers(spark, sf), items, nodes, "key", "no", ["name", "no", "status"])


@query("template_regions", """with c as (select c_custkey as key, c_name as name from customer), o as (select o_custkey as key, o_orderkey as no from orders)
select key, 0 as ord, 1 as blocks, length(name) as chars from c union all select o.key, 1, count(*), cast(sum(length(cast(no as varchar))) as bigint) from o join c on c.key = o.key group by o.key""")  # fmt: skip
def template_regions(spark, sf):
    items = table(spark, sf, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("no"))
    return op.regions(op.expand(_customers(spark, sf), items, [op.Node("${name}"), op.Node("${no}", each=True)], "key", "no", ["name", "no"]), "key")


@query("variable_issues", """with k as (select event_id as key, cast(json_extract(props, '$.k') as int) as k from events)
select key, 'k' as name, case when k < 10 then 'below_minimum' else 'above_maximum' end as code from k where k < 10 or k > 90 union all select key, 'title', 'required_missing' from k""")  # fmt: skip
def variable_issues(spark, sf):
    values = table(spark, sf, "events").select(F.col("event_id").alias("key"), F.col("props").alias("data"))
    return op.validate(values, [{"name": "k", "type": "number", "required": True, "min": 10, "max": 90}, {"name": "title", "type": "string", "required": True}, {"name": "note", "type": "string", "default": ""}])


@query("unknown_fields", "select event_id, list_sort(list_filter(json_keys(d), lambda x: x not in ('k'))) as unknown from (select event_id, concat(left(props, length(props) - 1), ', \"x', event_id % 3, '\": 1}') as d from events)")
def unknown_fields(spark, sf):
    d = F.concat(F.expr("left(props, length(props) - 1)"), F.lit(', "x'), F.col("event_id") % 3, F.lit('": 1}'))
    return table(spark, sf, "events").select("event_id", op.unknown_fields(d, ["k"]).alias("unknown"))


@query("variable_defaults", "select event_id, cast(json_extract(props, '$.k') as bigint) as k, 'none' as note from events")
def variable_defaults(spark, sf):
    p = F.col("props")
    return table(spark, sf, "events").select("event_id", op.with_default(p, "$.k", "bigint", -1).alias("k"), op.with_default(p, "$.note", "string", "none").alias("note"))


@query("edit_plan", """with r as (select doc_id, para_idx, replace(text, 'of', 'OF') as text from paras), f as (select doc_id, min(para_idx) as spot from r where contains(text, 'OF') group by doc_id),
i as (select r.doc_id, case when para_idx > spot then para_idx + 1 else para_idx end as para_idx, text from r left join f on f.doc_id = r.doc_id union all select doc_id, spot + 1, 'added' from f),
m as (select *, contains(text, 'que') as hit, sum(case when contains(text, 'que') then 0 else 1 end) over (partition by doc_id) as rest, max(para_idx) over (partition by doc_id) as last from i)
select doc_id, row_number() over (partition by doc_id order by para_idx) - 1 as para_idx, text from m where not hit or (rest = 0 and para_idx = last)""", ("paras",))  # fmt: skip
def edit_plan(spark, sf):
    return op.apply(paras(spark, sf), [("delete", {"pattern": "que"}), ("insert_after", {"anchor": "OF", "text": "added"}), ("replace", {"old": "of", "new": "OF"})])


@query("edit_effects", "select doc_id, cast(sum(case when contains(text, 'ing') then 1 else 0 end) as bigint) as gone, cast(sum(case when contains(text, 'ing') then 1 else 0 end) as bigint) as new from paras group by doc_id", ("paras",))
def edit_effects(spark, sf):
    before = paras(spark, sf)
    return op.effects(before, op.apply(before, [("replace", {"old": "ing", "new": "I\u0001G"})]))


@query("contract_cast", "select event_id, cast(json_extract(props, '$.k') as int) as k from events")
def contract_cast(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k int", {"mode": "FAILFAST"})["k"].alias("k"))


@query("json_roundtrip", "select doc_id, text, lang from documents")
def json_roundtrip(spark, sf):
    packed = table(spark, sf, "documents").select(F.to_json(F.struct("doc_id", "lang", F.base64(F.encode("text", "UTF-8")).alias("data"))).alias("j"))
    x = packed.select(F.from_json("j", "doc_id long, lang string, data string").alias("x"))
    return x.select("x.doc_id", F.decode(F.unbase64("x.data"), "UTF-8").alias("text"), "x.lang")


@query("certify", """with s as (select doc_id, count(*) as paragraphs, count(*) filter (where contains(text, 'http')) as links, sum(length(text)) as chars from paras group by doc_id),
r as (select doc_id, 'structure' as id, case when paragraphs >= 2 then 'passed' else 'failed' end as status, paragraphs as observed from s union all select doc_id, 'links', case when links = 0 then 'passed' else 'failed' end, links from s
union all select s.doc_id, 'quality', case when quality = 1 then 'passed' else 'failed' end, coalesce(quality, 0) from s left join labels l on l.doc_id = s.doc_id)
select doc_id, count(*) as rules, count(*) filter (where status = 'failed') as failed, case when bool_or(status = 'failed') then 'failed' else 'passed' end as status from r group by doc_id""", ("paras",))  # fmt: skip
def certify(spark, sf):
    """Rules of all documents at once: one aggregate, one lookup, rules as an array of structs."""
    stats = paras(spark, sf).groupBy("doc_id").agg(F.count("*").alias("paragraphs"), F.count_if(F.col("text").contains("http")).alias("links"))
    facts = stats.join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return op.certify(facts, "doc_id", {"structure": F.col("paragraphs") >= 2, "links": F.col("links") == 0, "quality": F.col("quality") == 1})


@query("spec_issues", """with b as (select l_orderkey as table_id, l_linenumber as row_idx, count(*) as cells from lineitem group by all), t as (select table_id, max(cells) as widest, min(cells) as narrowest, count(*) as n_rows from b group by 1)
select table_id, 'ragged_rows' as code from t where widest <> narrowest union all select table_id, 'too_many_rows' from t where n_rows > 5""")  # fmt: skip
def spec_issues(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("table_id"), "l_linenumber").agg(F.count("*").alias("cells"))
    return op.grid_issues(rows, "table_id", "cells", 5)


@query("windows_tumbling", "select time_bucket(interval '10 minutes', ts) as start, event_type, count(*) as n from events group by all")
def windows_tumbling(spark, sf):
    from ..streaming.folds import event_ledger

    return event_ledger(table(spark, sf, "events"), "10 minutes")


@query("windows_session", """with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval '30 minutes' then 0 else 1 end as new from events), s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as sid from g)
select user_id, min(ts) as start, count(*) as n from s group by user_id, sid""")  # fmt: skip
def windows_session(spark, sf):
    from ..streaming.folds import sessions

    return sessions(table(spark, sf, "events"), "30 minutes").select("user_id", "start", "n")


@query("string_issues", "select event_id as key, 'name' as name, case when length(event_type) < 5 then 'too_short' when length(event_type) > 7 then 'too_long' end as code from events where length(event_type) not between 5 and 7 union all select event_id, 'kind', 'not_a_value' from events where event_type not in ('view', 'click')")
def string_issues(spark, sf):
    data = table(spark, sf, "events").select(F.col("event_id").alias("key"), F.to_json(F.struct(F.col("event_type").alias("name"), F.col("event_type").alias("kind"))).alias("data"))
    return op.validate(data, [{"name": "name", "type": "string", "min_length": 5, "max_length": 7}, {"name": "kind", "type": "enum", "values": ["view", "click"]}])


@query("scalar_text", "select event_id, case event_id % 4 when 0 then event_type when 1 then cast(event_id as varchar) when 2 then 'true' end as text from events")
def scalar_text(spark, sf):
    e = F.col("event_id") % 4
    json = F.when(e == 0, F.concat(F.lit('{"v": "'), "event_type", F.lit('"}'))).when(e == 1, F.concat(F.lit('{"v": '), "event_id", F.lit("}"))).when(e == 2, '{"v": true}').otherwise('{"v": [1]}')
    return table(spark, sf, "events").select("event_id", op.scalar_text(F.variant_get(F.parse_json(json), "$.v", "variant")).alias("text"))


@query("rich_blocks", """with b as (select doc_id, para_idx * 10 as ord, text from paras where para_idx % 3 <> 1 union all select q.doc_id, q.para_idx * 10 + k, concat(k, text) from (select doc_id, para_idx, text, unnest(range(0, para_idx % 4)) as k from paras where para_idx % 3 = 1) q)
select doc_id, row_number() over (partition by doc_id order by ord) - 1 as ord, text from b""", ("paras",))  # fmt: skip
def rich_blocks(spark, sf):
    """Every third paragraph is a slot for none to three blocks."""
    p, i = paras(spark, sf), F.col("para_idx")
    blocks = p.select("doc_id", i.alias("ord"), "text", F.when(i % 3 == 1, F.concat(F.lit("s"), i)).alias("slot"))
    rich = p.where(i % 3 == 1).select("doc_id", F.concat(F.lit("s"), i).alias("slot"), "text", F.explode(F.sequence(F.lit(0), (i % 4).cast("int"))).alias("k")).where((F.col("k") < F.regexp_extract("slot", "[0-9]+", 0).cast("int") % 4))
    return op.splice(blocks, rich.withColumn("text", F.concat("k", "text")), "doc_id")


@query("expansion_budgets", """with n as (select doc_id, count(*) as nodes, cast(sum(octet_length(encode(text))) as bigint) as bytes from paras group by 1) select doc_id, 'nodes_exceeded' as code, nodes as used from n where nodes > 12 union all select doc_id, 'bytes_exceeded', bytes from n where bytes > 2000 union all select doc_id, 'items_exceeded', nodes from n where nodes > 30""", ("paras",))
def expansion_budgets(spark, sf):
    p = paras(spark, sf).select("doc_id", "text")
    return op.budget_issues(p, p.select("doc_id"), "doc_id", {"nodes": 12, "bytes": 2000, "items": 30})


@query("binding_safety", """with n as (select event_id, concat('/sections/0/', case event_id % 6 when 0 then 'blocks/3/text' when 1 then 'blocks/3' when 2 then 'id' when 3 then 'blocks/2/rows/1' when 4 then 'header/odd/0' else 'styles/0' end, '?', event_id) as pointer, list_extract(['value', 'if', 'each', 'other'], cast(event_id // 6 % 4 + 1 as int)) as node from events)
select pointer, code from (select split_part(pointer, '?', 1) as pointer, case when node = 'value' and event_id % 6 in (2, 3, 5) then 'binding_target' when node in ('if', 'each') and event_id % 6 in (0, 2, 5) then 'control_context' when node = 'other' then 'unknown_node' end as code from n) where code is not null""")  # fmt: skip
def binding_safety(spark, sf):
    e = F.col("event_id")
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))
    pointer = F.concat(F.lit("/sections/0/"), pick(["blocks/3/text", "blocks/3", "id", "blocks/2/rows/1", "header/odd/0", "styles/0"], e % 6))
    return op.binding_issues(table(spark, sf, "events").select(pointer.alias("pointer"), pick(["value", "if", "each", "other"], F.floor(e / 6) % 4).alias("node")))


@query("fill_all", "select doc_id, para_idx, case when para_idx % 2 = 0 then concat('{{b}} or ', text, ' {{c}}') else text end as text from paras", ("paras",))
def fill_all(spark, sf):
    """A value that looks like a name stays as it is; names without a value stay, as this fill is partial."""
    text = F.when(F.col("para_idx") % 2 == 0, F.concat(F.lit("{{ a }}"), "text", F.lit(" {{c}}"))).otherwise(F.col("text"))
    return op.fill_all(paras(spark, sf).withColumn("text", text), {"a": "{{b}} or ", "b": "never"}, partial=True)


@query("missing_values", "select distinct doc_id, 'c' as name from paras where para_idx % 2 = 1 union all select null, 'b'", ("paras",))
def missing_values(spark, sf):
    text = F.when(F.col("para_idx") % 2 == 1, F.lit("{{a}} {{ c }}")).otherwise(F.regexp_replace("text", "[{}]", ""))
    return op.missing_values(paras(spark, sf).withColumn("text", text), {"a": "1", "b": "2"})
