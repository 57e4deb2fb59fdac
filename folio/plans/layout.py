"""Queries over layout, runs and bytes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import layout as op
from ..operators import styling as st
from .registry import paras, query, table

_LINES = "l as (select doc_id, para_idx, i as line, substr(text, i * 80 + 1, 80) as text from paras, unnest(range(0, greatest(cast(ceil(length(text) / 80) as bigint), 1))) as t(i)), g as (select *, row_number() over (partition by doc_id order by para_idx, line) - 1 as n from l)"


def _paged(spark, sf):
    return op.paginate(op.lines(paras(spark, sf), 80), 40)


@query("line_breaks", f"with {_LINES} select doc_id, para_idx, line, text from l", ("paras",))
def line_breaks(spark, sf):
    return op.lines(paras(spark, sf), 80)


@query("display_items", f"with {_LINES} select doc_id, n // 40 as page, n % 40 as item, 'glyphs' as kind, 0.0::double as x, (n % 40) * 12.0::double as y, length(text) * 6.0::double as w, 12.0::double as h, text from g where text <> ''", ("paras",))
def display_items(spark, sf):
    return op.display_items(_paged(spark, sf))


@query("count_pages", f"with {_LINES} select doc_id, max(n // 40) + 1 as pages from g group by 1", ("paras",))
def count_pages(spark, sf):
    return op.count_pages(_paged(spark, sf))


@query("render_svg", f"""with {_LINES} select doc_id, n // 40 as page, concat('<svg>', string_agg(concat('<text x="0" y="', (n % 40) * 12, '">', replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '</text>'), '' order by n), '</svg>') as svg from g where text <> '' group by 1, 2""", ("paras",))
def render_svg(spark, sf):
    return op.page_svg(op.display_items(_paged(spark, sf)))


@query("diagnose_pages", f"with {_LINES} select doc_id, n // 40 as page, count(*) as items, count(*) filter (where length(text) * 6.0 > 420.0 or (n % 40) * 12.0 + 12.0 > 470.0) as outside from g where text <> '' group by 1, 2", ("paras",))
def diagnose_pages(spark, sf):
    return op.diagnose(op.display_items(_paged(spark, sf)), 420.0, 470.0)


@query("justify", f"with {_LINES}, m as (select *, max(line) over (partition by doc_id, para_idx) as last, length(text) - length(replace(text, ' ', '')) as gaps from l) select doc_id, para_idx, line, case when line = last or gaps = 0 then 0.0::double else round((90 - length(text)) / gaps, 6) end as stretch from m", ("paras",))
def justify(spark, sf):
    return op.justify(op.lines(paras(spark, sf), 80), 90)


@query("keep_together", """with recursive paras as (select doc_id, i - 1 as para_idx, p[i] as text from (select doc_id, string_split(text, chr(10)) as p from documents), unnest(range(1, len(p) + 1)) as t(i)), b as (select doc_id, para_idx as ord, 1 + length(text) // 80 as height from paras), f as (select doc_id, ord, 0::bigint as page, 0::bigint as y, height as used from b where ord = 0
union all select b.doc_id, b.ord, case when f.used + b.height > 40 then f.page + 1 else f.page end, case when f.used + b.height > 40 then 0 else f.used end, case when f.used + b.height > 40 then b.height else f.used + b.height end from f join b on b.doc_id = f.doc_id and b.ord = f.ord + 1)
select doc_id, ord, page, y from f""", ())  # fmt: skip
def keep_together(spark, sf):
    blocks = paras(spark, sf).select("doc_id", F.col("para_idx").alias("ord"), (1 + F.floor(F.length("text") / 80)).alias("height"))
    return op.keep_together(blocks, 40)


@query("inline_marks", """select conv_id as doc_id, string_agg(case when trim(text, ' ') = '' then text else concat(case when turn % 3 = 0 then '**' else '' end, case when role = 'user' then '*' else '' end, text, case when role = 'user' then '*' else '' end, case when turn % 3 = 0 then '**' else '' end, ' ') end, '' order by turn) as md
from (select conv_id, turn, role, trim(regexp_replace(text, '\\s+', ' ', 'g')) as text from conversations) group by conv_id""")  # fmt: skip
def inline_marks(spark, sf):
    one = F.concat(F.trim(F.regexp_replace("text", r"\s+", " ")), F.lit(" "))
    runs = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), one.alias("text"), (F.col("turn") % 3 == 0).alias("bold"), (F.col("role") == "user").alias("italic"), F.lit(False).alias("strike"))
    return st.mark_runs(runs)


@query("set_char_format", "with s as (select doc_id, para_idx as ord, unnest(string_split(replace(replace(text, 'tion', chr(1) || 'tion' || chr(1)), chr(1) || chr(1), chr(1)), chr(1))) as text from paras) select doc_id, ord, text, case when text = 'tion' then 7 else 0 end as shape from s where text <> ''", ("paras",))
def set_char_format(spark, sf):
    runs = paras(spark, sf).select("doc_id", F.col("para_idx").alias("ord"), "text", F.lit(0).alias("shape"))
    return st.restyle(runs, "tion", 7).select("doc_id", "ord", "text", "shape")


@query("set_para_align", "select p_partkey, (p_partkey & ~28) | 12 as attr, ((p_partkey % 2) | (p_size << 21) | ((p_partkey % 4) << 3)) as placement from part")
def set_para_align(spark, sf):
    a = F.col("p_partkey")
    return table(spark, sf, "part").select(a, st.set_alignment(a, 3).alias("attr"), st.placement_bits(a % 2, F.col("p_size").cast("long"), a % 4).alias("placement"))


@query("image_size", "select p_partkey, p_size as w, p_partkey as h from part")
def image_size(spark, sf):
    data = F.unhex(F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), F.lpad(F.hex("p_size"), 8, "0"), F.lpad(F.hex("p_partkey"), 8, "0")))
    return table(spark, sf, "part").select("p_partkey", st.png_size(data).alias("s")).select("p_partkey", "s.w", "s.h")


@query("gradients", "select p_partkey, cast(round(10 + (200 - 10) * (p_size / 50.0::double)) as int) as red, round(greatest(0.0, least(255.0, (p_size * 5 - 128) * (1 + 20 / 100.0::double) + 128 + 10 * 2.55::double)), 6) as bright from part")
def gradients(spark, sf):
    size = F.col("p_size")
    return table(spark, sf, "part").select("p_partkey", st.interpolate(F.lit(10), F.lit(200), size / 50.0).alias("red"), F.round(st.brightness(size * 5, F.lit(10), F.lit(20)), 6).alias("bright"))


@query("matrix_multiply", "select p_partkey, [s * 2.0::double, 0.0::double, 0.0::double, s * 3.0::double, s * k + 1.0::double, s * 4.0::double + k] as m from (select p_partkey, p_size::double as s, p_partkey::double as k from part)")
def matrix_multiply(spark, sf):
    s, k = F.col("p_size").cast("double"), F.col("p_partkey").cast("double")
    d = lambda x: F.lit(x).cast("double")
    rows = table(spark, sf, "part").select("p_partkey", F.array(s, d(0), d(0), s, d(1), k).alias("a"), F.array(d(2), d(0), d(0), d(3), k, d(4)).alias("b"))
    return rows.select("p_partkey", st.multiply("a", "b").alias("m"))


@query("tab_stops", "select p_partkey, case when p_size < 12 then 12.0::double when p_size < 30 then 30.0::double else floor(p_size / 8.0) * 8.0 + 8.0 end as stop from part")
def tab_stops(spark, sf):
    return table(spark, sf, "part").select("p_partkey", st.next_tab(F.col("p_size").cast("double"), F.array(F.lit(12.0), F.lit(30.0)), 8.0).alias("stop"))


@query("equation_tokens", "select o_orderkey, len(regexp_extract_all(s, '([A-Za-z]+|[0-9]+(?:\\.[0-9]+)?|[{}^_~`#&]|[^\\sA-Za-z0-9{}])', 1)) as n, concat('$', s, '$') as md from (select o_orderkey, concat('{', o_custkey, ' over ', o_orderkey, '}^2 + sqrt {', replace(o_orderpriority, ' ', '_'), '}') as s from orders)")
def equation_tokens(spark, sf):
    s = F.concat(F.lit("{"), "o_custkey", F.lit(" over "), "o_orderkey", F.lit("}^2 + sqrt {"), F.replace("o_orderpriority", F.lit(" "), F.lit("_")), F.lit("}"))
    return table(spark, sf, "orders").select("o_orderkey", F.size(st.equation_tokens(s)).cast("long").alias("n"), st.equation_markdown(s, F.lit(False), F.lit(False)).alias("md"))


@query("preset_aliases", "select n_nationkey, case n_nationkey % 6 when 0 then 'official' when 1 then 'report' when 2 then 'plan' when 3 then 'press' when 4 then 'minutes' end as profile from nation")
def preset_aliases(spark, sf):
    names = F.array(*map(F.lit, ("GongMun", "보고서", "사업계획", "보도자료", "회의록", "unknown")))
    return table(spark, sf, "nation").select("n_nationkey", st.profile(F.element_at(names, (F.col("n_nationkey") % 6 + 1).cast("int"))).alias("profile"))


@query("html_document", """select doc_id, concat('<body>', string_agg(case when para_idx = 0 then concat('<h1>', e, '</h1>') else concat('<p>', e, '</p>') end, '' order by para_idx), '</body>') as html, arg_min(text, para_idx) as title
from (select doc_id, para_idx, text, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') as e from paras) group by doc_id""", ("paras",))  # fmt: skip
def html_document(spark, sf):
    return op.page_body(paras(spark, sf), "doc_id", {0: "h1"})


@query("list_items", """select conv_id as doc_id, turn as ord, concat(repeat('  ', cast(length(text) % 3 as int)), case when role = 'user' then concat(turn + 1, '. ') else '- ' end, text) as line, coalesce(lag(role) over (partition by conv_id order by turn) <> role, false) as breaks from conversations""")
def list_items(spark, sf):
    marker = F.when(F.col("role") == "user", F.concat(F.col("turn") + 1, F.lit(". "))).otherwise("- ")
    line = F.concat(F.repeat(F.lit("  "), (F.length("text") % 3).cast("int")), marker, "text")
    before = F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), line.alias("line"), F.coalesce(before != F.col("role"), F.lit(False)).alias("breaks"))


@query("align_modes", """with l as (select conv_id as doc_id, turn as para_idx, i as line, substr(text, i * 30 + 1, 30) as text, i = (greatest(length(text), 1) - 1) // 30 as last from conversations, unnest(range(0, (greatest(length(text), 1) - 1) // 30 + 1)) as t(i)),
m as (select *, length(text) as n, greatest(40.0::double - length(text), 0) as slack, length(rtrim(text, ' ')) as visible, length(rtrim(text, ' ')) - length(replace(rtrim(text, ' '), ' ', '')) as spaces from l)
select doc_id, para_idx, line, round(slack, 6) as right, round(slack / 2, 6) as center, case when last or n < 2 then 0 else round(least(slack, greatest(n, 1)) / case when spaces > 0 then spaces else greatest(visible - 1, 1) end, 6) end as justify,
case when n < 1 then 0 else round(slack / greatest(n, 1), 6) end as distribute, case when n < 2 then 0 else round(slack / greatest(visible - 1, 1), 6) end as divide from m""")  # fmt: skip
def align_modes(spark, sf):
    rows = op.lines(table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("para_idx"), "text"), 30)
    keys = ["doc_id", "para_idx", "line"]
    made = [op.align(rows, k, 40.0).select(*keys, F.col("shift" if k in ("right", "center") else "gain").alias(k)) for k in ("right", "center", "justify", "distribute", "divide")]
    out = made[0]
    for m in made[1:]:
        out = out.join(m, keys)
    return out


@query("wrap_words")
def wrap_words(spark, sf):
    """Held by a test against a loop over words."""
    return op.wrap_words(paras(spark, sf), 40)


@query("table_pages")
def table_pages(spark, sf):
    """Orders as tables with a header row on each page; held by a test against a loop over rows."""
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("table_id"), (F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")) - 1).alias("row_idx"), (1 + F.col("l_partkey") % 4).alias("height"))
    return op.table_rows(rows, 8, 1)
