"""Table-grid algebra over cells (table_id, row_idx, col_idx, row_span, col_span, text).

A table's slots are exploded from spans; checks and edits are joins and aggregates by table, all tables at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import gfm_cell, quote_csv

ROW = ("table_id", "row_idx")


def slots(cells: DataFrame) -> DataFrame:
    """Every slot that a cell covers, with the cell's own place as anchor."""
    rows = F.sequence(F.col("row_idx"), F.col("row_idx") + F.col("row_span") - 1)
    cols = F.sequence(F.col("col_idx"), F.col("col_idx") + F.col("col_span") - 1)
    out = cells.select("table_id", F.col("row_idx").alias("a_row"), F.col("col_idx").alias("a_col"), "text", F.explode(rows).alias("row_idx"), cols.alias("_c"))
    return out.select("table_id", "row_idx", F.explode("_c").alias("col_idx"), "a_row", "a_col", "text")


def shape(cells: DataFrame) -> DataFrame:
    return cells.groupBy("table_id").agg(F.max(F.col("row_idx") + F.col("row_span")).alias("n_rows"), F.max(F.col("col_idx") + F.col("col_span")).alias("n_cols"), F.count("*").alias("n_cells"))


def invariants(cells: DataFrame) -> DataFrame:
    """Overlapping and missing slots of each table, and whether it is valid."""
    per = slots(cells).groupBy("table_id", "row_idx", "col_idx").count().groupBy("table_id").agg(F.count("*").alias("filled"), F.sum((F.col("count") > 1).cast("long")).alias("overlaps"))
    out = shape(cells).join(per, "table_id").withColumn("gaps", F.col("n_rows") * F.col("n_cols") - F.col("filled"))
    return out.select("table_id", "n_rows", "n_cols", "overlaps", "gaps", ((F.col("overlaps") == 0) & (F.col("gaps") == 0)).alias("valid"))


def set_cells(cells: DataFrame, changes: DataFrame) -> DataFrame:
    """Texts of anchors replaced by changes (table_id, row_idx, col_idx, new_text)."""
    return cells.join(changes, ["table_id", "row_idx", "col_idx"], "left").withColumn("text", F.coalesce("new_text", "text")).drop("new_text")


def delete_row(cells: DataFrame, row: int) -> DataFrame:
    """Without one row where no span crosses it; a table of one row stays whole."""
    over = Window.partitionBy("table_id")
    crosses = ((F.col("row_idx") < row) & (F.col("row_idx") + F.col("row_span") > row)) | ((F.col("row_idx") == row) & (F.col("row_span") > 1))
    marked = cells.withColumn("_rows", F.max(F.col("row_idx") + F.col("row_span")).over(over)).withColumn("_bad", F.max(crosses.cast("int")).over(over))
    able = (F.col("_rows") > 1) & (F.col("_bad") == 0)
    moved = marked.where(~able | (F.col("row_idx") != row)).withColumn("row_idx", F.when(able & (F.col("row_idx") > row), F.col("row_idx") - 1).otherwise(F.col("row_idx")))
    return moved.drop("_rows", "_bad")


def add_rows(cells: DataFrame, at: int, count: int) -> DataFrame:
    """Empty rows before row `at`; cells that cross the boundary grow, the new slots take the columns of the row before."""
    grows = (F.col("row_idx") < at) & (F.col("row_idx") + F.col("row_span") > at)
    moved = cells.withColumn("row_span", (F.col("row_span") + F.when(grows, count).otherwise(0)).cast("long")).withColumn("row_idx", (F.col("row_idx") + F.when(F.col("row_idx") >= at, count).otherwise(0)).cast("long"))
    donor = cells.where((F.col("row_idx") + F.col("row_span") == at)).withColumn("row_idx", F.explode(F.sequence(F.lit(at).cast("long"), F.lit(at + count - 1).cast("long"))))
    return moved.select(cells.columns).unionByName(donor.withColumn("row_span", F.lit(1).cast("long")).withColumn("text", F.lit("")).select(cells.columns))


def delete_column(cells: DataFrame, col: int) -> DataFrame:
    """Without one column: spans that cross it shrink, cells of that column alone go, later ones move; the last column stays."""
    wide = F.max(F.col("col_idx") + F.col("col_span")).over(Window.partitionBy("table_id")) > 1
    marked = cells.withColumn("_able", wide)
    covers = F.col("_able") & (F.col("col_idx") <= col) & (F.col("col_idx") + F.col("col_span") > col)
    kept = marked.where(~(covers & (F.col("col_span") == 1)))
    span = F.when(covers, F.col("col_span") - 1).otherwise(F.col("col_span"))
    return kept.withColumn("_s", span).withColumn("col_idx", F.when(F.col("_able") & (F.col("col_idx") > col), F.col("col_idx") - 1).otherwise(F.col("col_idx"))).withColumn("col_span", F.col("_s")).drop("_s", "_able")


def insert_column(cells: DataFrame, at: int) -> DataFrame:
    """An empty column before column `at`; spans across the boundary grow instead."""
    grows = (F.col("col_idx") < at) & (F.col("col_idx") + F.col("col_span") > at)
    moved = cells.withColumn("_g", grows).withColumn("col_span", F.col("col_span") + F.col("_g").cast("int")).withColumn("col_idx", F.when(F.col("col_idx") >= at, F.col("col_idx") + 1).otherwise(F.col("col_idx")))
    per = cells.groupBy(*ROW).agg(F.max(grows.cast("int")).alias("_g")).where("_g = 0")
    new = per.select("table_id", "row_idx", F.lit(at).cast("long").alias("col_idx"), F.lit(1).alias("row_span"), F.lit(1).cast("long").alias("col_span"), F.lit("").alias("text"))
    return moved.drop("_g").select(cells.columns).unionByName(new.select(cells.columns))


def merge_cells(cells: DataFrame, r1: int, c1: int, r2: int, c2: int) -> DataFrame:
    """The rectangle's cells into its first, texts that are not empty joined in row order; tables where a cell crosses the edge stay."""
    inside = F.col("row_idx").between(r1, r2) & F.col("col_idx").between(c1, c2)
    meets = (F.col("row_idx") <= r2) & (F.col("row_idx") + F.col("row_span") > r1) & (F.col("col_idx") <= c2) & (F.col("col_idx") + F.col("col_span") > c1)
    whole = inside & (F.col("row_idx") + F.col("row_span") <= r2 + 1) & (F.col("col_idx") + F.col("col_span") <= c2 + 1)
    over = Window.partitionBy("table_id")
    marked = cells.withColumn("_in", meets).withColumn("_bad", F.max((meets & ~whole).cast("int")).over(over))
    marked = marked.withColumn("_full", F.sum(F.when(meets, F.col("row_span") * F.col("col_span")).otherwise(0)).over(over) == (r2 - r1 + 1) * (c2 - c1 + 1))
    able = (F.col("_bad") == 0) & F.col("_full")
    rest = marked.where(~(able & F.col("_in"))).select(cells.columns)
    texts = F.transform(F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("row_idx", "col_idx", "text")))), lambda x: x["text"])
    merged = marked.where(able & F.col("_in")).groupBy("table_id").agg(F.array_join(texts, "\n").alias("text"))
    merged = merged.select("table_id", F.lit(r1).cast("long").alias("row_idx"), F.lit(c1).cast("long").alias("col_idx"), F.lit(r2 - r1 + 1).alias("row_span"), F.lit(c2 - c1 + 1).cast("long").alias("col_span"), "text")
    return rest.unionByName(merged.select(cells.columns))


def split_cells(cells: DataFrame) -> DataFrame:
    """Spans to single cells; the text stays in the first."""
    own = (F.col("row_idx") == F.col("a_row")) & (F.col("col_idx") == F.col("a_col"))
    return slots(cells).select("table_id", "row_idx", "col_idx", F.when(own, F.col("text")).otherwise("").alias("text"))


def column_widths(cells: DataFrame) -> DataFrame:
    """Widest text of unspanned cells of each column; columns without one take the table's average."""
    own = cells.where("col_span = 1").groupBy("table_id", "col_idx").agg(F.max(F.length("text")).alias("w"))
    grid = shape(cells).select("table_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_cols") - 1)).alias("col_idx"))
    average = F.floor(F.avg("w").over(Window.partitionBy("table_id")))
    return grid.join(own, ["table_id", "col_idx"], "left").select("table_id", "col_idx", F.coalesce(F.col("w"), average, F.lit(0)).cast("long").alias("width"))


def flags(cells: DataFrame) -> DataFrame:
    return cells.groupBy("table_id").agg(F.bool_or((F.col("col_span") > 1) | (F.col("row_span") > 1)).alias("has_span"), F.bool_or(F.col("text").contains("\n")).alias("has_block"))


def _by_row(cells: DataFrame, text, separator: str) -> DataFrame:
    row = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col_idx", text.alias("t")))), lambda x: x["t"]), separator)
    return cells.groupBy(*ROW).agg(row.alias("line"))


def csv(cells: DataFrame) -> DataFrame:
    """CSV of each table: a merged cell's text at its anchor, its other slots empty."""
    lines = _by_row(split_cells(cells), quote_csv(F.col("text")), ",")
    return lines.groupBy("table_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", "line"))), lambda x: x["line"]), "\n").alias("csv"))


def markdown(cells: DataFrame) -> DataFrame:
    """Pipe rows of each table; the rule follows the first."""
    lines = _by_row(split_cells(cells), F.concat(F.lit(" "), gfm_cell(F.col("text")), F.lit(" |")), "")
    ruled = lines.join(shape(cells).select("table_id", "n_cols"), "table_id")
    full = F.concat(F.lit("|"), "line", F.when(F.col("row_idx") == 0, F.concat(F.lit("\n|"), F.repeat(F.lit(" --- |"), F.col("n_cols").cast("int")))).otherwise(""))
    return ruled.withColumn("line", full).groupBy("table_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", "line"))), lambda x: x["line"]), "\n").alias("md"))


def html(cells: DataFrame) -> DataFrame:
    attribute = lambda name, c: F.when(F.col(c) > 1, F.concat(F.lit(f' {name}="'), c, F.lit('"'))).otherwise("")
    cell = F.concat(F.lit("<td"), attribute("colspan", "col_span"), attribute("rowspan", "row_span"), F.lit(">"), F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit("</td>"))
    lines = _by_row(cells, cell, "").withColumn("line", F.concat(F.lit("<tr>"), "line", F.lit("</tr>")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", "line"))), lambda x: x["line"]), "\n")
    return lines.groupBy("table_id").agg(F.concat(F.lit("<table>\n"), body, F.lit("\n</table>")).alias("html"))


def clone(cells: DataFrame, keep_text: bool) -> DataFrame:
    """A copy of each table under new ids above the largest, blank or with its texts."""
    copy = cells.withColumn("table_id", F.col("table_id") + cells.select(F.max("table_id")).scalar() + 1)
    return cells.unionByName(copy if keep_text else copy.withColumn("text", F.lit("")))


#: Width of the text body in units, which a new table's columns share; what a row takes whose height nothing says.
BODY_WIDTH, ROW_HEIGHT = 42_520, 1_700


def extents(cells: DataFrame, at: str, span: str, size: str, count: int | str, fallback: int = ROW_HEIGHT) -> DataFrame:
    """table_id, idx, extent of each row or column: the largest unspanned cell; spanned cells, in order of their places, share what they need
    among those still unknown, the last one with the remainder; what is unknown then takes the average, or the fallback.

    One fold a table over its spanned cells; `count` is a column with the number of rows or columns, or that number.
    """
    n = F.col(count) if isinstance(count, str) else F.lit(count)
    one = F.struct(F.col(at).cast("long").alias("at"), F.col(span).cast("long").alias("span"), F.col(size).cast("long").alias("size"))
    per = cells.groupBy("table_id").agg(F.max(n).cast("int").alias("_n"), F.collect_list(F.when(F.col(span) <= 1, one)).alias("_single"), F.array_sort(F.collect_list(F.when(F.col(span) > 1, F.struct("row_idx", "col_idx", one.alias("c"))))).alias("_wide"))
    known = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: F.coalesce(F.array_max(F.transform(F.filter("_single", lambda c: c["at"] == i), lambda c: c["size"])), F.lit(0).cast("long")))

    def spread(h, w):
        c = w["c"]
        covered = lambda i: (i >= c["at"]) & (i < c["at"] + c["span"])
        places = F.sequence(F.lit(0), F.col("_n") - 1)
        open_ = F.filter(places, lambda i: covered(i) & (F.element_at(h, i + 1) == 0))
        taken = F.aggregate(F.filter(places, covered), F.lit(0).cast("long"), lambda s, i: s + F.element_at(h, i + 1))
        rest = F.greatest(c["size"] - taken, F.lit(0).cast("long"))
        each = F.floor(rest / F.greatest(F.size(open_), F.lit(1))).cast("long")
        share = lambda i: F.when(i == F.array_max(open_), rest - each * (F.size(open_) - 1)).otherwise(each)
        return F.transform(h, lambda x, i: F.when(F.array_contains(open_, i), share(i)).otherwise(x))

    filled = F.aggregate("_wide", known, spread)
    total = F.aggregate("_h", F.lit(0).cast("long"), lambda s, x: s + x)
    rest = F.when(total > 0, F.greatest(F.floor(total / F.col("_n")), F.lit(1))).otherwise(fallback)
    out = per.withColumn("_h", filled).withColumn("_rest", rest.cast("long"))
    return out.select("table_id", F.posexplode(F.transform("_h", lambda x: F.when(x == 0, F.col("_rest")).otherwise(x))).alias("idx", "extent")).withColumn("idx", F.col("idx").cast("long"))


def add_tables(rows: DataFrame) -> DataFrame:
    """Cells of new tables from ragged rows (table_id, row_idx, texts): as many columns as the widest row, missing texts empty, columns of one width."""
    widest = F.greatest(F.max(F.size("texts")).over(Window.partitionBy("table_id")), F.lit(1))
    each = rows.withColumn("_n", widest).withColumn("col_idx", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    text = F.coalesce(F.get("texts", F.col("col_idx")), F.lit(""))
    return each.select("table_id", "row_idx", F.col("col_idx").cast("long").alias("col_idx"), F.lit(1).alias("row_span"), F.lit(1).alias("col_span"), F.floor(BODY_WIDTH / F.col("_n")).cast("int").alias("width"), text.alias("text"))


def fill_rows(data: DataFrame, table: str, order: list[str], columns: list[str], header: int, size: int) -> DataFrame:
    """Rows of data put below a table's header rows: table, row_idx, the columns as texts c0, c1 .., and by how many rows the table of `size` grows."""
    over = Window.partitionBy(table)
    place = header + F.row_number().over(over.orderBy(*order)) - 1
    grown = F.greatest(F.lit(0), header + F.count("*").over(over) - size)
    return data.select(F.col(table).alias("table_id"), place.cast("long").alias("row_idx"), *(F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(columns)), grown.cast("long").alias("grown"))
