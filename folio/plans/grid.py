"""Queries over table grids."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import grid as op
from .registry import cells, query, table

C = ("cells",)
_SPLIT = "s as (select table_id, row_idx, c as col_idx, case when c = col_idx then text else '' end as text from cells, unnest(range(col_idx, col_idx + col_span)) as t(c))"
_LINES = lambda cell, sep: f"l as (select table_id, row_idx, string_agg({cell}, '{sep}' order by col_idx) as line from s group by all)"


@query("build_grid", "select table_id, row_idx, c as col_idx, row_idx as a_row, col_idx as a_col from cells, unnest(range(col_idx, col_idx + col_span)) as t(c)", C)
def build_grid(spark, sf):
    return op.slots(cells(spark, sf)).drop("text")


@query("table_invariants", """with s as (select table_id, row_idx, c, count(*) as n from cells, unnest(range(col_idx, col_idx + col_span)) as t(c) group by all)
select table_id, max(row_idx) + 1 as n_rows, max(c) + 1 as n_cols, cast(sum(case when n > 1 then 1 else 0 end) as bigint) as overlaps, (max(row_idx) + 1) * (max(c) + 1) - count(*) as gaps, sum(case when n > 1 then 1 else 0 end) = 0 and (max(row_idx) + 1) * (max(c) + 1) = count(*) as valid from s group by table_id""", C)  # fmt: skip
def table_invariants(spark, sf):
    return op.invariants(cells(spark, sf))


@query("set_cell", "select table_id, row_idx, col_idx, row_span, col_span, case when row_idx = 0 and col_idx = 0 then 'SET' else text end as text from cells", C)
def set_cell(spark, sf):
    base = cells(spark, sf)
    changes = base.select("table_id").distinct().select("table_id", F.lit(0).cast("long").alias("row_idx"), F.lit(0).cast("long").alias("col_idx"), F.lit("SET").alias("new_text"))
    return op.set_cells(base, changes)


@query("delete_table_row", """with n as (select table_id, max(row_idx) + 1 as n_rows from cells group by 1) select cells.table_id, case when n_rows > 1 and row_idx > 1 then row_idx - 1 else row_idx end as row_idx, col_idx, row_span, col_span, text
from cells join n on n.table_id = cells.table_id where n_rows = 1 or row_idx <> 1""", C)  # fmt: skip
def delete_table_row(spark, sf):
    return op.delete_row(cells(spark, sf), 1)


@query("add_table_rows", """select table_id, case when row_idx >= 1 then row_idx + 2 else row_idx end as row_idx, col_idx, 1::bigint as row_span, col_span, text from cells
union all select table_id, r, col_idx, 1, col_span, '' from cells, unnest([1, 2]) as t(r) where row_idx = 0""", C)  # fmt: skip
def add_table_rows(spark, sf):
    return op.add_rows(cells(spark, sf), 1, 2)


@query("delete_table_column", "select table_id, row_idx, case when col_idx > 1 then col_idx - 1 else col_idx end as col_idx, row_span, case when col_idx <= 1 and col_idx + col_span > 1 then col_span - 1 else col_span end as col_span, text from cells where not (col_idx = 1 and col_span = 1)", C)
def delete_table_column(spark, sf):
    return op.delete_column(cells(spark, sf), 1)


@query("add_table_column", """select table_id, row_idx, case when col_idx >= 2 then col_idx + 1 else col_idx end as col_idx, row_span, case when col_idx < 2 and col_idx + col_span > 2 then col_span + 1 else col_span end as col_span, text from cells
union all select table_id, row_idx, 2, 1, 1, '' from cells group by table_id, row_idx having max(case when col_idx < 2 and col_idx + col_span > 2 then 1 else 0 end) = 0""", C)  # fmt: skip
def add_table_column(spark, sf):
    return op.insert_column(cells(spark, sf), 2)


@query("merge_cells", """with m as (select *, row_idx <= 1 and col_idx <= 2 as meets, max(case when row_idx <= 1 and col_idx <= 2 and col_idx + col_span > 3 then 1 else 0 end) over (partition by table_id) as bad, sum(case when row_idx <= 1 and col_idx <= 2 then row_span * col_span else 0 end) over (partition by table_id) as area from cells)
select table_id, row_idx, col_idx, row_span, col_span, text from m where not (bad = 0 and area = 6 and meets)
union all select table_id, 0, 0, 2, 3, coalesce(string_agg(text, chr(10) order by row_idx, col_idx) filter (where text <> ''), '') from m where bad = 0 and area = 6 and meets group by table_id""", C)  # fmt: skip
def merge_cells(spark, sf):
    return op.merge_cells(cells(spark, sf), 0, 0, 1, 2)


@query("split_cell", f"with {_SPLIT} select * from s", C)
def split_cell(spark, sf):
    return op.split_cells(cells(spark, sf))


@query("column_widths", """with o as (select table_id, col_idx, max(length(text)) as w from cells where col_span = 1 group by all), n as (select table_id, max(col_idx + col_span) as n_cols from cells group by 1),
g as (select table_id, unnest(range(0, n_cols)) as col_idx from n)
select g.table_id, g.col_idx, cast(coalesce(w, floor(avg(w) over (partition by g.table_id)), 0) as bigint) as width from g left join o on o.table_id = g.table_id and o.col_idx = g.col_idx""", C)  # fmt: skip
def column_widths(spark, sf):
    return op.column_widths(cells(spark, sf))


@query("table_flags", "select table_id, bool_or(col_span > 1 or row_span > 1) as has_span, bool_or(contains(text, chr(10))) as has_block from cells group by 1", C)
def table_flags(spark, sf):
    return op.flags(cells(spark, sf))


@query("write_csv", f"with {_SPLIT}, {_LINES('text', ',')} select table_id, string_agg(line, chr(10) order by row_idx) as csv from l group by 1", C)
def write_csv(spark, sf):
    return op.csv(cells(spark, sf))


@query("write_gfm_table", f"""with {_SPLIT}, {_LINES("concat(' ', replace(text, '|', '\\|'), ' |')", '')} select table_id, string_agg(concat('|', line, case when row_idx = 0 then concat(chr(10), '|', repeat(' --- |', 4)) else '' end), chr(10) order by row_idx) as md from l group by 1""", C)
def write_gfm_table(spark, sf):
    return op.markdown(cells(spark, sf))


@query("write_html_table", """with l as (select table_id, row_idx, concat('<tr>', string_agg(concat('<td', case when col_span > 1 then concat(' colspan="', col_span, '"') else '' end, '>', text, '</td>'), '' order by col_idx), '</tr>') as line from cells group by all)
select table_id, concat('<table>', chr(10), string_agg(line, chr(10) order by row_idx), chr(10), '</table>') as html from l group by 1""", C)  # fmt: skip
def write_html_table(spark, sf):
    return op.html(cells(spark, sf))


@query("clone_table", "select table_id, row_idx, col_idx, row_span, col_span, text from cells union all select table_id + (select max(table_id) from cells) + 1, row_idx, col_idx, row_span, col_span, '' from cells", C)
def clone_table(spark, sf):
    return op.clone(cells(spark, sf), keep_text=False)


@query("row_major_sort", "select table_id, list(col_idx order by row_idx, col_idx) as cols from cells group by 1", C)
def row_major_sort(spark, sf):
    return cells(spark, sf).groupBy("table_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", "col_idx"))), lambda x: x["col_idx"]).alias("cols"))


@query("pivot_rows", "select table_id, row_idx, max(text) filter (where col_idx = 0) as c0, max(text) filter (where col_idx = 1) as c1, max(text) filter (where col_idx = 2) as c2, max(text) filter (where col_idx = 3) as c3 from cells group by all", C)
def pivot_rows(spark, sf):
    wide = cells(spark, sf).groupBy("table_id", "row_idx").pivot("col_idx", [0, 1, 2, 3]).agg(F.max("text"))
    return wide.toDF("table_id", "row_idx", "c0", "c1", "c2", "c3")


@query("add_table", "select o_custkey as table_id, r as row_idx, c as col_idx, 1 as row_span, 1 as col_span, 42520 // w as width, case when c = 0 then cast(o_orderkey as varchar) when c <= o_orderkey % 3 then concat(o_orderstatus, c) else '' end as text from (select *, unnest(range(0, w)) as c from (select *, 1 + max(o_orderkey % 3) over (partition by o_custkey) as w, row_number() over (partition by o_custkey order by o_orderkey) - 1 as r from orders))")
def add_table(spark, sf):
    """Orders as ragged rows of one to three texts, customers as tables."""
    place = (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).cast("long")
    more = F.transform(F.sequence(F.lit(1), F.lit(2)), lambda i: F.when(i <= F.col("o_orderkey") % 3, F.concat("o_orderstatus", i)))
    texts = F.concat(F.array(F.col("o_orderkey").cast("string")), F.array_compact(more))
    return op.add_tables(table(spark, sf, "orders").select(F.col("o_custkey").alias("table_id"), place.alias("row_idx"), texts.alias("texts")))


@query("row_heights")
def row_heights(spark, sf):
    """Heights by the length of texts, every third cell over two rows; held by a test against a plain fold."""
    c = cells(spark, sf).withColumn("row_span", F.when((F.col("row_idx") + F.col("col_idx")) % 3 == 0, 2).otherwise(1)).withColumn("height", F.length("text") * 100)
    rows = c.withColumn("n_rows", F.max("row_idx").over(Window.partitionBy("table_id")) + 1)
    return op.extents(rows, "row_idx", "row_span", "height", "n_rows").select("table_id", F.col("idx").alias("row_idx"), F.col("extent").alias("height"))
