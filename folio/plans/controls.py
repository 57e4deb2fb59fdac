"""Queries over controls: the first word of a paragraph is a field of some kind, the end of every fourth one a bookmark."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import controls as op
from .registry import paras, query, table

_IDS = ", ".join(f"'{x}'" for x in op.FIELD_IDS)
_LABELS = "map {" + ", ".join(f"'{k}': '{n}'" for k, (_, n) in op.FIELD_KINDS.items()) + "}"
_TYPES = "map {" + ", ".join(f"'{k}': '{t}'" for k, (t, _) in op.FIELD_KINDS.items()) + "}"
_WORD = "case when instr(text, ' ') > 0 then instr(text, ' ') - 1 else length(text) end"
_CONTROLS = f"""controls as (select doc_id, para_idx, 0 as ctrl_idx, list_extract([{_IDS}, 'head'], cast(para_idx % {len(op.FIELD_IDS) + 1} + 1 as int)) as ctrl_id, concat('f', para_idx % 3) as name, concat('c', doc_id) as command, 0 as start, {_WORD} as "end" from paras
union all select doc_id, para_idx, 1, 'bokm', concat('b', para_idx), null, length(text), length(text) from paras where para_idx % 4 = 0)"""


def controls(spark, sf):
    """The stand-in relation."""
    p = paras(spark, sf)
    ids = F.array(*map(F.lit, [*op.FIELD_IDS, "head"]))
    word = F.when(F.instr("text", " ") > 0, F.instr("text", " ") - 1).otherwise(F.length("text"))
    i = F.col("para_idx")
    fields = p.select("doc_id", "para_idx", F.lit(0).alias("ctrl_idx"), F.element_at(ids, (i % (len(op.FIELD_IDS) + 1) + 1).cast("int")).alias("ctrl_id"), F.concat(F.lit("f"), i % 3).alias("name"), F.concat(F.lit("c"), "doc_id").alias("command"), F.lit(0).alias("start"), word.alias("end"))
    marks = p.where(i % 4 == 0).select("doc_id", "para_idx", F.lit(1).alias("ctrl_idx"), F.lit(op.BOOKMARK).alias("ctrl_id"), F.concat(F.lit("b"), i).alias("name"), F.lit(None).cast("string").alias("command"), F.length("text").alias("start"), F.length("text").alias("end"))
    return fields.unionByName(marks)


@query("list_fields", f"""with {_CONTROLS} select c.doc_id, c.para_idx, ctrl_idx, coalesce({_LABELS}[ctrl_id], '필드') as kind, ctrl_id, name, command, substr(text, start + 1, "end" - start) as value from controls c join paras p on p.doc_id = c.doc_id and p.para_idx = c.para_idx where ctrl_id in ({_IDS})""", ("paras",))
def list_fields(spark, sf):
    return op.list_fields(paras(spark, sf), controls(spark, sf))


@query("field_kinds", f"with {_CONTROLS}, k as (select ctrl_id, count(*) as n from controls where ctrl_id in ({_IDS}) group by 1) select ctrl_id, n, coalesce({_TYPES}[ctrl_id], 'UNKNOWN') as type, coalesce({_LABELS}[ctrl_id], '필드') as label, case when coalesce({_TYPES}[ctrl_id], 'UNKNOWN') = 'UNKNOWN' then '%unk' else ctrl_id end as again from k", ("paras",))
def field_kinds(spark, sf):
    counts = controls(spark, sf).groupBy("ctrl_id").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(op.field_kinds(spark)), "ctrl_id").select("ctrl_id", "n", "type", "label", op.field_id(F.col("type")).alias("again"))


@query("list_bookmarks", f"with {_CONTROLS} select doc_id, para_idx, ctrl_idx, name from controls where ctrl_id = 'bokm'", ("paras",))
def list_bookmarks(spark, sf):
    return op.list_bookmarks(controls(spark, sf))


@query("set_field", f"""with {_CONTROLS}, m as (select doc_id, para_idx, "end" as e from controls where name = 'f1' and ctrl_id in ({_IDS}))
select p.doc_id, p.para_idx, case when e is null then text else concat('새 값', substr(text, e + 1)) end as text, case when e is null then 0 else 1 end as filled, b.start as mark from paras p left join m on m.doc_id = p.doc_id and m.para_idx = p.para_idx
left join (select c.doc_id, c.para_idx, c.start + case when m.e is null then 0 else 3 - m.e end as start from controls c left join m on m.doc_id = c.doc_id and m.para_idx = c.para_idx where ctrl_id = 'bokm') b on b.doc_id = p.doc_id and b.para_idx = p.para_idx""", ("paras",))  # fmt: skip
def set_field(spark, sf):
    """Texts, and where each bookmark is afterwards."""
    done, moved = op.set_field(paras(spark, sf), controls(spark, sf), "f1", "새 값")
    marks = moved.where(F.col("ctrl_id") == op.BOOKMARK).select("doc_id", "para_idx", F.col("start").alias("mark"))
    return done.join(marks, ["doc_id", "para_idx"], "left")


_FIRST = """first as (select doc_id, min(para_idx) as para_idx from paras where contains(text, 'the') group by 1), spot as (select p.doc_id, p.para_idx, instr(text, 'the') + 2 as at from paras p join first f on f.doc_id = p.doc_id and f.para_idx = p.para_idx)"""


def _created(shown: str, ctrl_id: str, name: str, command: str) -> str:
    return f"""with {_CONTROLS}, {_FIRST} select p.doc_id, p.para_idx, case when s.at is null then text else concat(substr(text, 1, s.at), '{shown}', substr(text, s.at + 1)) end as text,
case when s.at is not null then '{ctrl_id}' end as ctrl_id, case when s.at is not null then {name} end as name, case when s.at is not null then {command} end as command, s.at as start, s.at + {len(shown)} as "end", case when s.at is not null then (select count(*) from controls c where c.doc_id = p.doc_id and c.para_idx = p.para_idx) end as ctrl_idx
from paras p left join spot s on s.doc_id = p.doc_id and s.para_idx = p.para_idx"""


def _with_new(spark, sf, made):
    """Every paragraph, with the new control where it got one."""
    before = controls(spark, sf)
    done, after = made(paras(spark, sf), before)
    new = after.join(before.select("doc_id", "para_idx", "ctrl_idx"), ["doc_id", "para_idx", "ctrl_idx"], "left_anti")
    return done.join(new, ["doc_id", "para_idx"], "left").withColumn("ctrl_idx", F.col("ctrl_idx").cast("long"))


@query("create_field", _created("값", "%clk", "'n'", "null"), ("paras",))
def create_field(spark, sf):
    return _with_new(spark, sf, lambda p, c: op.create_field(p, c, "the", "n", "값"))


@query("create_hyperlink", _created("link", "%hlk", "null", r"'http\://a.example/x\;y;1;0;0;'"), ("paras",))
def create_hyperlink(spark, sf):
    return _with_new(spark, sf, lambda p, c: op.create_hyperlink(p, c, "the", "http://a.example/x;y", "link"))


@query("create_bookmark", _created("", "bokm", "'here'", "null"), ("paras",))
def create_bookmark(spark, sf):
    return _with_new(spark, sf, lambda p, c: op.create_bookmark(p, c, "the", "here"))


@query("text_options", "select doc_id, string_agg(text, chr(10) order by para_idx) as body, string_agg(text, chr(10) order by para_idx) filter (where para_idx % 7 <> 3) as with_hidden from (select * from paras where para_idx % 7 <> 3) group by doc_id", ("paras",))
def text_options(spark, sf):
    """Every seventh paragraph in a header, the next in a hidden comment: without both, and with comments."""
    k = F.col("para_idx") % 7
    rows = paras(spark, sf).withColumn("container", F.when(k == 3, op.HEADER_FOOTER))
    joined = lambda df, name: df.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("para_idx", "text"))), lambda x: x["text"]), "\n").alias(name))
    return joined(op.text_options(rows, "container"), "body").join(joined(op.text_options(rows, "container", hidden=True), "with_hidden"), "doc_id")


_NOTED = "noted as (select doc_id, para_idx, case when para_idx % 5 = 1 then concat(text, '[^n', para_idx, '] and [^none]') when para_idx % 5 = 3 then concat('[^n', para_idx - 2, ']: ', text) else text end as text from paras)"


@query("note_join", f"""with {_NOTED}, r as (select doc_id, para_idx, unnest([0, 1]) as k, unnest([concat('n', para_idx), 'none']) as label from noted where para_idx % 5 = 1), b as (select doc_id, concat('n', para_idx - 2) as label, regexp_replace(text, '^[ \\t]+', '') as body from paras where para_idx % 5 = 3)
select r.doc_id, r.para_idx, k, r.label, body from r left join b on b.doc_id = r.doc_id and b.label = r.label""", ("paras",))  # fmt: skip
def note_join(spark, sf):
    i = F.col("para_idx")
    text = F.when(i % 5 == 1, F.concat("text", F.lit("[^n"), i, F.lit("] and [^none]"))).when(i % 5 == 3, F.concat(F.lit("[^n"), i - 2, F.lit("]: "), "text")).otherwise(F.col("text"))
    return op.notes(paras(spark, sf).withColumn("text", text))


@query("fill_parts", """with q as (select doc_id, para_idx, case when para_idx % 4 = 1 then ' {{terms}} ' when para_idx % 4 = 2 then concat(text, ' {{terms}}') else text end as text from paras),
e as (select doc_id, para_idx, unnest(case when para_idx % 4 = 1 then ['First.', 'Second.'] else [text] end) as text, unnest(case when para_idx % 4 = 1 then [0, 1] else [0] end) as k, case when para_idx % 4 = 2 then 'anchor_not_alone' end as error from q)
select doc_id, row_number() over (partition by doc_id order by para_idx, k) - 1 as para_idx, text, error from e""", ("paras",))  # fmt: skip
def fill_parts(spark, sf):
    i = F.col("para_idx")
    text = F.when(i % 4 == 1, " {{terms}} ").when(i % 4 == 2, F.concat("text", F.lit(" {{terms}}"))).otherwise(F.col("text"))
    parts = spark.createDataFrame([("terms", 1, "Second."), ("terms", 0, "First."), ("other", 0, "No.")], "name string, ord int, text string")
    return op.insert_parts(paras(spark, sf).withColumn("text", text), parts)


@query("set_page_def", "select p_partkey, 59528 as width, p_size * 100 as height, 8504 as margin_left, p_size * 10 as margin_top, (p_size | 1) as attr from part")
def set_page_def(spark, sf):
    sections = table(spark, sf, "part").select("p_partkey", F.lit(0).alias("width"), (F.col("p_size") * 100).alias("height"), F.lit(0).alias("margin_left"), (F.col("p_size") * 10).alias("margin_top"), F.col("p_size").alias("attr"))
    return op.page_definitions(sections, width=59528, margins={"left": 8504}, landscape=True)


@query("picture_size", """select p_partkey, case when p_size % 3 = 0 then cast(round(p_size * 7200 / 25.4) as bigint) when p_partkey * 75 > 42520 then 42520 else p_partkey * 75 end as width,
case when p_size % 3 = 0 then cast(round(2 * p_size * 7200 / 25.4) as bigint) when p_partkey * 75 > 42520 then cast(round(p_size * 75 * (42520.0::double / (p_partkey * 75))) as bigint) else p_size * 75 end as height from part""")  # fmt: skip
def picture_size(spark, sf):
    mm = F.when(F.col("p_size") % 3 == 0, F.col("p_size").cast("double"))
    size = op.picture_size(F.col("p_partkey"), F.col("p_size"), 42520, mm, mm * 2)
    return table(spark, sf, "part").select("p_partkey", size.alias("s")).select("p_partkey", "s.width", "s.height")
