"""Counters in document order: list markers, heading numbers, note numbers, page numbers.

Rows are (doc_id, ord, level, ...). A counter of level L counts rows of level L since the last row of a smaller level;
two windows over one sort give it, so a document is one exchange and one sort however many levels it has.

A document is one group and so one task: its rows are read in order. Documents, not corpora, bound what a task sorts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import format_number

MAX_LEVEL = 10
#: Numeral system, text before and after, of the eight outline levels.
OUTLINE = (("digit", "", "."), ("syllable", "", "."), ("digit", "", ")"), ("syllable", "", ")"), ("digit", "(", ")"), ("syllable", "(", ")"), ("circled", "", ""), ("circled_syllable", "", ""))


def _so_far(*part: str) -> Window:
    return Window.partitionBy(*part).orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def counters(rows: DataFrame, part: tuple[str, ...] = ("doc_id",), levels: int = 3) -> DataFrame:
    """rows with c1 ... cN: each level's counter after the row; deeper counters are 0 again after a row above them."""
    out = rows
    for k in range(1, levels + 1):
        reset = F.coalesce(F.max(F.when(F.col("level") < k, F.col("ord"))).over(_so_far(*part)), F.lit(-1))
        out = out.withColumn(f"_r{k}", reset)
    for k in range(1, levels + 1):
        over = Window.partitionBy(*part, f"_r{k}").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        out = out.withColumn(f"c{k}", F.sum((F.col("level") == k).cast("long")).over(over))
    return out.drop(*(f"_r{k}" for k in range(1, levels + 1)))


def list_markers(rows: DataFrame, levels: int = 3) -> DataFrame:
    """Markers 1., 1.1. and so on; a level that no row has opened counts as 1."""
    counted = counters(rows, levels=levels)
    shown = [F.greatest(F.col(f"c{k}"), F.lit(1)).cast("string") for k in range(1, levels + 1)]
    marker = F.coalesce(*(F.when(F.col("level") == k, F.concat(F.concat_ws(".", *shown[:k]), F.lit("."))) for k in range(1, levels + 1)))
    return counted.withColumn("marker", marker)


def apply_template(template: Column, shown: list[Column]) -> Column:
    """^K in a template becomes level K's counter."""
    for k in range(len(shown), 0, -1):
        template = F.replace(template, F.lit(f"^{k}"), shown[k - 1])
    return template


def outline_markers(rows: DataFrame, levels: int = 3) -> DataFrame:
    counted = counters(rows, levels=levels)
    marker = F.coalesce(*(F.when(F.col("level") == k, F.concat(F.lit(OUTLINE[k - 1][1]), format_number(F.greatest(F.col(f"c{k}"), F.lit(1)), F.lit(OUTLINE[k - 1][0])), F.lit(OUTLINE[k - 1][2]))) for k in range(1, levels + 1)))
    return counted.withColumn("marker", marker)


def heading_numbers(rows: DataFrame) -> DataFrame:
    """1., 1-1., 1-1-1. for three levels; none where the text begins with a number of its own."""
    own = F.regexp_extract(F.ltrim("text"), r"^([0-9]+[.)-])", 1) != ""
    counted = counters(rows)
    number = F.when(~own, F.coalesce(*(F.when(F.col("level") == k, F.concat(F.concat_ws("-", *(F.greatest(F.col(f"c{i}"), F.lit(1)).cast("string") for i in range(1, k + 1))), F.lit("."))) for k in (1, 2, 3))))
    return counted.withColumn("number", number)


def note_numbers(anchors: DataFrame, *part: str) -> DataFrame:
    """1-based numbers of notes by kind in anchor order, a document (or a section with more keys) at a time."""
    return anchors.withColumn("number", F.row_number().over(Window.partitionBy(*part).orderBy("ord")).cast("long"))


def nth(rows: DataFrame, part: str, *order: str) -> DataFrame:
    """0-based place in document order."""
    return rows.withColumn("nth", (F.row_number().over(Window.partitionBy(part).orderBy(*order)) - 1).cast("long"))


def page_numbers(pages: DataFrame) -> DataFrame:
    """Numbers of pages (doc_id, ord, restart): a restart sets the number, later pages count on from it."""
    at = F.coalesce(F.max(F.when(F.col("restart").isNotNull(), F.col("ord"))).over(_so_far("doc_id")), F.lit(-1))
    base = F.coalesce(F.last("restart", ignorenulls=True).over(_so_far("doc_id")), F.lit(1))
    out = pages.withColumn("_at", at).withColumn("_base", base)
    n = F.row_number().over(Window.partitionBy("doc_id", "_at").orderBy("ord")) - 1
    return out.withColumn("page_no", (F.col("_base") + n).cast("long")).drop("_at", "_base")


def compact_runs(runs: DataFrame) -> DataFrame:
    """Shape runs (doc_id, ord, shape) without those that repeat the one before."""
    before = F.lag("shape").over(Window.partitionBy("doc_id").orderBy("ord"))
    return runs.withColumn("_b", before).where(F.col("_b").isNull() | (F.col("_b") != F.col("shape"))).drop("_b")


def palette(rows: DataFrame, shape: str, order: Column) -> DataFrame:
    """A dense id of each distinct shape, by first appearance: the shapes are few once they are grouped."""
    first = rows.groupBy(shape).agg(F.min(order).alias("first"), F.count("*").alias("uses"))
    return first.withColumn("id", (F.row_number().over(Window.orderBy("first", shape)) - 1).cast("long"))


def prefix_sums(rows: DataFrame, part: str, order: str, value: str) -> DataFrame:
    over = Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum(value).over(over), F.lit(0)))
