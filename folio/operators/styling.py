"""Runs and their marks, paragraph bits, matrices and colours, bytes of images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks from the outermost, as (flag, opening, closing).
MARKS = (("bold", "**", "**"), ("italic", "*", "*"), ("strike", "~~", "~~"))


def mark_runs(runs: DataFrame) -> DataFrame:
    """Markdown of each document's runs (doc_id, ord, text, bold, italic, strike): white space moves out of marks, blank runs lose them."""
    core = F.regexp_extract("text", r"^\s*(.*?)\s*$", 1)
    lead, tail = F.regexp_extract("text", r"^(\s*)", 1), F.regexp_extract("text", r"(\s*)$", 1)
    out = core
    for flag, a, b in reversed(MARKS):
        out = F.when(F.coalesce(flag, F.lit(False)), F.concat(F.lit(a), out, F.lit(b))).otherwise(out)
    text = F.when(core == "", F.col("text")).otherwise(F.concat(lead, out, tail))
    return runs.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", text.alias("t")))), lambda x: x["t"]), "").alias("md"))


def restyle(runs: DataFrame, pattern: str, shape: int) -> DataFrame:
    """Runs (doc_id, ord, text, shape) cut at each match of a plain pattern, whose pieces get another shape."""
    parts = F.split("text", "(?<=\\Q" + pattern + "\\E)|(?=\\Q" + pattern + "\\E)")
    each = runs.select("doc_id", "ord", "shape", F.posexplode(parts).alias("piece", "text")).where(F.col("text") != "")
    return each.withColumn("shape", F.when(F.col("text") == pattern, shape).otherwise(F.col("shape")))


def set_alignment(attr: Column, align: int) -> Column:
    """Bits 2 to 4 of a paragraph's attributes."""
    return attr.bitwiseAND(F.lit(~(7 << 2))).bitwiseOR(F.lit(align << 2))


def placement_bits(inline: Column, wrap: Column, relative: Column) -> Column:
    return inline.cast("int").bitwiseOR(F.shiftleft(wrap, 21)).bitwiseOR(F.shiftleft(relative, 3))


def interpolate(low: Column, high: Column, t: Column) -> Column:
    """A colour channel between two, rounded."""
    return F.round(low + (high - low) * t).cast("int")


def brightness(c: Column, bright: Column, contrast: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(255.0), (c - 128) * (1 + contrast / 100.0) + 128 + bright * 2.55))


def multiply(a: str, b: str) -> Column:
    """Product of two 2x3 matrices kept as arrays [a, b, c, d, e, f]."""
    at = lambda m, i: F.col(m)[i]
    return F.array(
        at(a, 0) * at(b, 0) + at(a, 2) * at(b, 1), at(a, 1) * at(b, 0) + at(a, 3) * at(b, 1), at(a, 0) * at(b, 2) + at(a, 2) * at(b, 3),
        at(a, 1) * at(b, 2) + at(a, 3) * at(b, 3), at(a, 0) * at(b, 4) + at(a, 2) * at(b, 5) + at(a, 4), at(a, 1) * at(b, 4) + at(a, 3) * at(b, 5) + at(a, 5),
    )


def png_size(content: Column) -> Column:
    """Width and height in a PNG's first chunk, null for other bytes."""
    number = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("long")
    return F.when(F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A", F.struct(number(17).alias("w"), number(21).alias("h")))


def next_tab(at: Column, stops: Column, interval: float) -> Column:
    """The first stop beyond a place, else the next multiple of the interval."""
    later = F.array_min(F.filter(stops, lambda s: s > at + 0.01))
    return F.coalesce(later, F.floor(at / interval) * interval + interval)


def equation_tokens(script: Column) -> Column:
    """Words, numbers, braces and single marks of an equation script."""
    return F.regexp_extract_all(script, F.lit(r"([A-Za-z]+|[0-9]+(?:\.[0-9]+)?|[{}^_~`#&]|[^\sA-Za-z0-9{}])"), 1)


def equation_markdown(script: Column, block: Column, html: Column) -> Column:
    return F.when(html, F.concat(F.lit("<code>"), script, F.lit("</code>"))).when(block, F.concat(F.lit("$$\n"), script, F.lit("\n$$"))).otherwise(F.concat(F.lit("$"), script, F.lit("$")))


#: Names and aliases of the document profiles.
PROFILES = {
    "official": ("official", "gian", "gongmun", "기안", "기안문", "공문", "공문서"), "report": ("report", "bogoseo", "보고", "보고서"), "plan": ("plan", "계획", "계획서", "사업계획", "사업계획서"),
    "notice": ("notice", "공고", "공고문", "고시"), "minutes": ("minutes", "회의록", "회의기록"), "press": ("press", "보도", "보도자료"),
}


def profile(name: Column) -> Column:
    """Canonical profile of a name or alias, ASCII case aside; null if unknown."""
    low = F.lower(name)
    out = F.lit(None).cast("string")
    for canonical, aliases in PROFILES.items():
        out = F.when(low.isin(*aliases), canonical).otherwise(out)
    return out
