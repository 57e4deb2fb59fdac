"""Search, assembly and text edits over paragraphs (doc_id, para_idx, text).

What needs a document's order is one window by document, so one document is one task; the rest is projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import utf16_length


def _in_order():
    return Window.partitionBy("doc_id").orderBy("para_idx")


def _so_far():
    return _in_order().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def grep(paras: DataFrame, pattern: str, ignore_case: bool = False) -> DataFrame:
    """Trimmed paragraphs that hold a substring; a filter of the scan, nothing is exchanged."""
    text = F.trim("text")
    inside = F.lower(text).contains(pattern.lower()) if ignore_case else text.contains(pattern)
    return paras.select("doc_id", "para_idx", text.alias("text")).where(inside)


def grep_capped(paras: DataFrame, pattern: str, cap: int = 200) -> DataFrame:
    """The first `cap` matches of each document with its total and whether some are left out."""
    found = grep(paras, pattern)
    total = F.count("*").over(Window.partitionBy("doc_id"))
    return found.withColumn("total", total).withColumn("n", F.row_number().over(_in_order())).where(F.col("n") <= cap).select("doc_id", "para_idx", "total", (F.col("total") > cap).alias("truncated"))


def find_first(paras: DataFrame, pattern: str) -> DataFrame:
    """First place of a substring in each paragraph, in code points and in UTF-16 units."""
    at = F.instr("text", pattern)
    return paras.withColumn("at", at).where("at > 0").select("doc_id", "para_idx", (F.col("at") - 1).cast("long").alias("char_at"), utf16_length(F.substring("text", F.lit(1), (F.col("at") - 1).cast("int"))).cast("long").alias("wchar_at"))


def placeholders(paras: DataFrame) -> DataFrame:
    """{{name}} slots of a document with counts, in the order of their first appearance."""
    each = paras.select("doc_id", "para_idx", F.posexplode(F.regexp_extract_all("text", F.lit(r"\{\{(.*?)\}\}"), 1)).alias("k", "raw"))
    each = each.withColumn("name", F.trim("raw")).where(F.col("name").rlike(r"^[\p{L}\p{N}._-]+$"))
    found = each.groupBy("doc_id", "name").agg(F.count("*").alias("n"), F.min(F.struct("para_idx", "k")).alias("first"))
    return found.select("doc_id", "name", "n", F.row_number().over(Window.partitionBy("doc_id").orderBy("first")).cast("long").alias("ord"))


def fill(paras: DataFrame, values: dict[str, str]) -> DataFrame:
    """{{name}} replaced by values, one after the other; what was put in is filled again by later names only."""
    text = F.col("text")
    for k, v in values.items():
        text = F.replace(text, F.lit("{{" + k + "}}"), F.lit(v))
    return paras.withColumn("text", text)


def replace_text(paras: DataFrame, old: str, new: str, every: bool = True) -> DataFrame:
    """Each occurrence, left to right, never inside what was put in; or a document's first only. n counts replacements."""
    n = ((F.length("text") - F.length(F.replace("text", F.lit(old), F.lit("")))) / len(old)).cast("long")
    out = paras.withColumn("n", n)
    if every:
        return out.withColumn("text", F.replace("text", F.lit(old), F.lit(new)))
    before = F.coalesce(F.sum("n").over(_so_far()), F.lit(0)) - F.col("n")
    at = F.instr("text", old)
    once = F.concat(F.substring("text", F.lit(1), at - 1), F.lit(new), F.substring("text", at + len(old), F.length("text")))
    first = (before == 0) & (F.col("n") > 0)
    return out.withColumn("first", first).withColumn("text", F.when(F.col("first"), once).otherwise(F.col("text"))).withColumn("n", F.col("first").cast("long")).drop("first")


def offsets(paras: DataFrame, separator: int = 1) -> DataFrame:
    """Start and end of each paragraph in its document's joined text, code points; and the UTF-16 start."""
    n, w = F.length("text") + separator, utf16_length(F.col("text")) + separator
    return paras.select("doc_id", "para_idx", (F.sum(n).over(_so_far()) - n).alias("start"), (F.sum(n).over(_so_far()) - separator).alias("end"), (F.sum(w).over(_so_far()) - w).alias("wchar_start"))


def collapse_blanks(paras: DataFrame) -> DataFrame:
    """Runs of blank lines become one; each line that stays gets its new place and how many went before it."""
    blank = F.trim("text") == ""
    drop = (blank & F.coalesce(F.lag(blank).over(_in_order()), F.lit(False))).cast("long")
    marked = paras.withColumn("drop", drop).withColumn("gone", F.sum("drop").over(_so_far()))
    return marked.where("drop = 0").select("doc_id", "para_idx", (F.col("para_idx") - F.col("gone")).alias("new_idx"), "gone")


def assemble(paras: DataFrame, separator: str = "\n") -> DataFrame:
    """A document's text from its paragraphs in order; empty paragraphs add no second separator."""
    kept = paras.where(F.col("text") != "")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("para_idx", "text"))), lambda x: x["text"]), separator)
    return kept.groupBy("doc_id").agg(joined.alias("text"))


def window(segments: DataFrame, low: int, high: int) -> DataFrame:
    """Segments (start, end) that meet [low, high)."""
    return segments.where((F.col("start") < high) & (F.col("end") > low))


def delete_matching(paras: DataFrame, pattern: str) -> DataFrame:
    """Paragraphs without the matching ones; where all match, the last stays."""
    hit = F.col("text").contains(pattern)
    over = Window.partitionBy("doc_id")
    marked = paras.withColumn("hit", hit).withColumn("left", F.sum((~F.col("hit")).cast("long")).over(over)).withColumn("last", F.max("para_idx").over(over))
    kept = marked.where(~F.col("hit") | ((F.col("left") == 0) & (F.col("para_idx") == F.col("last"))))
    return kept.select("doc_id", (F.row_number().over(_in_order()) - 1).cast("long").alias("para_idx"), "text")


def insert_after_first(paras: DataFrame, anchor: str, text: str, before: bool = False) -> DataFrame:
    """A new paragraph beside each document's first one that holds the anchor; later ones move by one."""
    first = F.min(F.when(F.col("text").contains(anchor), F.col("para_idx"))).over(Window.partitionBy("doc_id"))
    marked = paras.withColumn("at", first)
    shift = (F.col("para_idx") >= F.col("at")) if before else (F.col("para_idx") > F.col("at"))
    own = F.struct((F.col("para_idx") + F.coalesce(shift, F.lit(False)).cast("long")).alias("para_idx"), F.col("text").alias("text"))
    new = F.struct((F.col("at") + (0 if before else 1)).alias("para_idx"), F.lit(text).alias("text"))
    both = F.when(F.col("para_idx") == F.col("at"), F.array(own, new)).otherwise(F.array(own))
    return marked.select("doc_id", F.explode(both).alias("x")).select("doc_id", "x.*")


def semantic_stats(paras: DataFrame) -> DataFrame:
    return paras.groupBy("doc_id").agg(F.count("*").alias("paragraphs"), F.sum(F.length("text")).alias("chars"), F.sum((F.trim("text") == "").cast("long")).alias("blank"))


def digest(paras: DataFrame) -> DataFrame:
    """SHA-256 of a document's paragraphs, each framed by its length."""
    frame = F.concat(F.octet_length("text"), F.lit(":"), F.col("text"))
    return paras.groupBy("doc_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("para_idx", frame.alias("f")))), lambda x: x["f"]), ""), 256).alias("digest"))


def byte_window(text: Column, offset: int, most: int) -> Column:
    """offset, text, returned, total and truncated of at most so many UTF-8 bytes from an offset; the end moves back to a character's end. Null where the offset is inside a character or behind the text."""
    raw = F.encode(text, "UTF-8")
    total = F.octet_length(raw)
    inside = lambda at: (at < total) & F.hex(F.substring(raw, at + 1, F.lit(1))).rlike("^[89AB]")
    end = F.least(F.lit(offset + most), total)
    for _ in range(3):
        end = F.when((end > offset) & inside(end), end - 1).otherwise(end)
    out = F.struct(F.lit(offset).alias("offset"), F.decode(F.substring(raw, F.lit(offset + 1), end - offset), "UTF-8").alias("text"), (end - offset).alias("returned"), total.alias("total"), (end < total).alias("truncated"))
    return F.when((F.lit(offset) <= total) & ~inside(F.lit(offset)), out)


def write_markdown(blocks: DataFrame) -> DataFrame:
    """doc_id, md from blocks (doc_id, ord, kind, level, text, target): headings, list items, quotes, code, links, tables as they are, notes; a blank line between blocks, none between items of a list."""
    t, level = F.col("text"), F.coalesce(F.col("level"), F.lit(1)).cast("int")
    one = (
        F.when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), F.least(F.greatest(level, F.lit(1)), F.lit(6))), F.lit(" "), t))
        .when(F.col("kind") == "item", F.concat(F.repeat(F.lit("  "), level - 1), F.lit("- "), t)).when(F.col("kind") == "quote", F.concat(F.lit("> "), F.replace(t, F.lit("\n"), F.lit("\n> "))))
        .when(F.col("kind") == "code", F.concat(F.lit("```\n"), t, F.lit("\n```"))).when(F.col("kind") == "link", F.concat(F.lit("["), t, F.lit("]("), "target", F.lit(")")))
        .when(F.col("kind") == "note", F.concat(F.lit("[^"), "target", F.lit("]: "), t)).otherwise(t)
    )
    before = F.lag("kind").over(Window.partitionBy("doc_id").orderBy("ord"))
    gap = F.when(before.isNull(), "").when((before == "item") & (F.col("kind") == "item"), "\n").otherwise("\n\n")
    lines = blocks.select("doc_id", "ord", F.concat(gap, one).alias("line"))
    return lines.groupBy("doc_id").agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), ""), F.lit("\n")).alias("md"))


def page_path(base: Column, page: Column, pages: Column) -> Column:
    """stem-N.ext of a page, or the path itself where there is one page only."""
    named = base.rlike(r"^(.*[^/])\.([^./]+)$")
    numbered = F.when(named, F.concat(F.regexp_extract(base, r"^(.*[^/])\.([^./]+)$", 1), F.lit("-"), page, F.lit("."), F.regexp_extract(base, r"^(.*[^/])\.([^./]+)$", 2))).otherwise(F.concat(base, F.lit("-"), page))
    return F.when(pages > 1, numbered).otherwise(base)
