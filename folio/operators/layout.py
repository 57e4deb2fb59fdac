"""Fixed-advance layout: lines, pages, display items, page SVG and diagnostics, all in the plan.

Every character has one advance, so a paragraph's lines are slices of its text and a document's pages follow from a running
count of lines. Proportional fonts need a shaper, which is not part of this engine.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.text import escape_xml
from ..workers import importable


def lines(paras: DataFrame, columns: int) -> DataFrame:
    """doc_id, para_idx, line, text: slices of `columns` code points; an empty paragraph is one empty line."""
    n = F.greatest(F.ceil(F.length("text") / columns), F.lit(1)).cast("int")
    each = paras.select("doc_id", "para_idx", "text", F.explode(F.sequence(F.lit(0), n - 1)).alias("line"))
    return each.select("doc_id", "para_idx", F.col("line").cast("long").alias("line"), F.substring("text", F.col("line") * columns + 1, F.lit(columns)).alias("text"))


def paginate(rows: DataFrame, per_page: int) -> DataFrame:
    """rows with page and row on the page, both from 0: a running count of a document's lines."""
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("para_idx", "line")) - 1
    return rows.withColumn("_n", n).withColumn("page", F.floor(F.col("_n") / per_page)).withColumn("page_row", (F.col("_n") % per_page).cast("long")).drop("_n")


def keep_together(rows: DataFrame, per_page: int) -> DataFrame:
    """Pages of blocks (doc_id, ord, height) that are not cut: a block that does not fit begins a page.

    A document's blocks come sorted to one task and are placed as they stream by; what is held is a page and a height.
    """
    importable(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, page, used = None, 0, 0
        for batch in batches:
            pages, tops = [], []
            for doc, height in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if (doc,) != open_:
                    open_, page, used = (doc,), 0, 0
                if used > 0 and used + height > per_page:
                    page, used = page + 1, 0
                pages.append(page)
                tops.append(used)
                used += height
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pages, pa.int64()), pa.array(tops, pa.int64())], names=["doc_id", "ord", "page", "y"])

    one = rows.select("doc_id", F.col("ord").cast("long").alias("ord"), F.col("height").cast("long").alias("height"))
    shape = StructType([one.schema["doc_id"], *(StructField(n, LongType()) for n in ("ord", "page", "y"))])
    return one.repartition("doc_id").sortWithinPartitions("doc_id", "ord").mapInArrow(run, shape)


def display_items(paged: DataFrame, advance: float = 6.0, leading: float = 12.0) -> DataFrame:
    """Glyph runs with their boxes in points; empty lines draw nothing."""
    drawn = paged.where(F.col("text") != "")
    return drawn.select("doc_id", "page", F.col("page_row").alias("item"), F.lit("glyphs").alias("kind"), F.lit(0.0).alias("x"), (F.col("page_row") * leading).alias("y"), (F.length("text") * advance).alias("w"), F.lit(leading).alias("h"), "text")


def page_svg(items: DataFrame) -> DataFrame:
    """One SVG string a page, items in order."""
    item = F.concat(F.lit('<text x="'), F.col("x").cast("int"), F.lit('" y="'), F.col("y").cast("int"), F.lit('">'), escape_xml(F.col("text")), F.lit("</text>"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item", item.alias("s")))), lambda x: x["s"]), "")
    return items.groupBy("doc_id", "page").agg(F.concat(F.lit("<svg>"), body, F.lit("</svg>")).alias("svg"))


def diagnose(items: DataFrame, width: float, height: float) -> DataFrame:
    """Items beyond the page, by page."""
    out = (F.col("x") < 0) | (F.col("y") < 0) | (F.col("x") + F.col("w") > width) | (F.col("y") + F.col("h") > height)
    return items.groupBy("doc_id", "page").agg(F.count("*").alias("items"), F.count_if(out).alias("outside"))


def count_pages(paged: DataFrame) -> DataFrame:
    return paged.groupBy("doc_id").agg((F.max("page") + 1).alias("pages"))


def justify(widths: DataFrame, measure: int) -> DataFrame:
    """Slack of each line (doc_id, para_idx, line, text) shared by its gaps; the last line of a paragraph is not stretched."""
    gaps = F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))
    last = F.col("line") == F.max("line").over(Window.partitionBy("doc_id", "para_idx"))
    slack = F.lit(measure) - F.length("text")
    return widths.select("doc_id", "para_idx", "line", F.when(last | (gaps == 0), 0.0).otherwise(F.round(slack / gaps, 6)).alias("stretch"))


#: Kinds of alignment, by their codes.
ALIGNMENTS = ("justify", "left", "right", "center", "distribute", "divide")


def wrap_words(paras: DataFrame, columns: int) -> DataFrame:
    """doc_id, para_idx, line, text: words put on lines of at most `columns` code points, greedily; a longer word is cut. A line's end has no spaces.

    One fold a paragraph over its words; runs of spaces inside a line stay.
    """
    words = F.regexp_extract_all("text", F.lit(r"( *[^ ]+)"), 1)
    room = F.lit(columns)
    begun = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc, word):
        bare = F.ltrim(word)
        fits = F.length(acc["open"]) + F.length(word) <= room
        cuts = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length(bare) / columns).cast("int"), F.lit(1)) - 1), lambda i: F.substring(bare, i * columns + 1, room))
        closed = F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"])))
        moved = F.struct(F.concat(closed, F.slice(cuts, F.lit(1), F.size(cuts) - 1)).alias("done"), F.element_at(cuts, -1).alias("open"))
        return F.when(fits, F.struct(acc["done"].alias("done"), F.concat(acc["open"], word).alias("open"))).otherwise(moved)

    lines = F.aggregate(words, begun, step, lambda acc: F.when((F.size(acc["done"]) > 0) & (acc["open"] == ""), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))
    return paras.select("doc_id", "para_idx", F.posexplode(lines).alias("line", "text")).withColumn("line", F.col("line").cast("long"))


def align(lines: DataFrame, kind: str, measure: float, advance: float = 1.0) -> DataFrame:
    """shift of each line (doc_id, para_idx, line, text), and what each stretched gap gains, by kind of alignment.

    justify gives a paragraph's lines but the last their slack, at most their own width, by the spaces before the last visible character, or by all gaps if there are
    none; distribute shares it among all characters, the last one too, divide among those before the last visible one.
    """
    natural = F.length("text") * advance
    slack = F.greatest(F.lit(measure) - natural, F.lit(0.0))
    visible = F.length(F.rtrim("text"))  # characters up to the last visible one
    spaces = F.length(F.rtrim("text")) - F.length(F.replace(F.rtrim("text"), F.lit(" "), F.lit("")))
    last = F.col("line") == F.max("line").over(Window.partitionBy("doc_id", "para_idx"))
    gaps = F.greatest(visible - 1, F.lit(1))
    none = F.lit(0.0)
    n = F.length("text")
    shift = {"right": slack, "center": slack / 2}.get(kind, none)
    share = {
        "justify": F.when(last | (n < 2), none).otherwise(F.least(slack, F.greatest(natural, F.lit(1.0))) / F.when(spaces > 0, spaces).otherwise(gaps)),
        "distribute": F.when(n < 1, none).otherwise(slack / F.greatest(n, F.lit(1))),
        "divide": F.when(n < 2, none).otherwise(slack / gaps),
    }.get(kind, none)
    if kind not in ALIGNMENTS:
        raise ValueError(f"unknown alignment {kind}")
    return lines.select("doc_id", "para_idx", "line", F.round(shift, 6).alias("shift"), F.round(share, 6).alias("gain"))


def page_body(blocks: DataFrame, key: str, tags: dict[int, str], other: str = "p") -> DataFrame:
    """One HTML body a document of its paragraphs (para_idx, text) in order, and the first one's text as title."""
    tag = F.lit(other)
    for i, name in tags.items():
        tag = F.when(F.col("para_idx") == i, name).otherwise(tag)
    block = F.concat(F.lit("<"), tag, F.lit(">"), escape_xml(F.col("text")), F.lit("</"), tag, F.lit(">"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("para_idx", block.alias("b")))), lambda x: x["b"]), "")
    return blocks.groupBy(key).agg(F.concat(F.lit("<body>"), body, F.lit("</body>")).alias("html"), F.min_by("text", "para_idx").alias("title"))


def table_rows(rows: DataFrame, per_page: int, header: int) -> DataFrame:
    """page and y of a table's rows (table_id, row_idx, height): header rows stand on every page, a row that does not fit begins a page.

    One fold a table; a row higher than a page has one of its own. repeated marks header rows of later pages.
    """
    listed = F.array_sort(F.collect_list(F.struct(F.col("row_idx").cast("long").alias("row_idx"), F.col("height").cast("long").alias("height"))))
    per = rows.groupBy("table_id").agg(listed.alias("_r"))
    heads, body = F.filter("_r", lambda r: r["row_idx"] < header), F.filter("_r", lambda r: r["row_idx"] >= header)
    high = F.aggregate(heads, F.lit(0).cast("long"), lambda s, r: s + r["height"])
    begun = F.struct(F.lit(0).cast("long").alias("page"), F.col("_h").alias("used"), F.lit(False).alias("any"), F.array().cast("array<struct<row_idx: bigint, page: bigint, y: bigint>>").alias("out"))

    def step(acc, r):
        over = acc["any"] & (acc["used"] + r["height"] > per_page)
        page, y = acc["page"] + F.when(over, F.lit(1)).otherwise(0), F.when(over, F.col("_h")).otherwise(acc["used"])
        return F.struct(page.cast("long").alias("page"), (y + r["height"]).alias("used"), F.lit(True).alias("any"), F.concat(acc["out"], F.array(F.struct(r["row_idx"].alias("row_idx"), page.cast("long").alias("page"), y.alias("y")))).alias("out"))

    placed = per.withColumn("_h", high).withColumn("_o", F.aggregate(body, begun, step)["out"])
    pages = F.sequence(F.lit(0).cast("long"), F.coalesce(F.array_max(F.transform("_o", lambda o: o["page"])), F.lit(0).cast("long")))
    tops = F.transform(heads, lambda r, i: F.struct(r["row_idx"].alias("row_idx"), F.aggregate(F.slice(heads, F.lit(1), i), F.lit(0).cast("long"), lambda s, x: s + x["height"]).alias("y")))
    repeated = F.flatten(F.transform(pages, lambda p: F.transform(tops, lambda t: F.struct(t["row_idx"].alias("row_idx"), p.alias("page"), t["y"].alias("y")))))
    out = placed.select("table_id", F.explode(F.concat(repeated, "_o")).alias("x")).select("table_id", "x.*")
    return out.withColumn("repeated", (F.col("row_idx") < header) & (F.col("page") > 0))
