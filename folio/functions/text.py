"""Lengths, escapes and cleaning of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def utf16_length(c: Column) -> Column:
    """UTF-16 units: code points outside the first plane count twice."""
    return F.length(c) + (F.length(F.regexp_replace(c, "[^\\x{10000}-\\x{10FFFF}]", "")))


def escape_xml(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def quote_csv(c: Column) -> Column:
    """RFC 4180: quotes only around fields that need them."""
    return F.when(c.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def gfm_cell(c: Column) -> Column:
    """A pipe-table cell: bars escaped, line breaks to spaces."""
    return F.replace(F.replace(c, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]*>", "")


def hyperlink_url(command: Column) -> Column:
    """The target of a link command: up to the first semicolon that no backslash precedes, escapes removed."""
    return F.regexp_replace(F.regexp_extract(command, r"^((?:\\.|[^;\\])*)", 1), r"\\(.)", "$1")


def image_kind(content: Column) -> Column:
    """Extension by the first bytes: png, jpg, gif, bmp or bin."""
    head = F.hex(F.substring(content, 1, 8))
    return F.when(head == "89504E470D0A1A0A", "png").when(head.startswith("FFD8FF"), "jpg").when(head.startswith("47494638"), "gif").when(head.startswith("424D"), "bmp").otherwise("bin")


def file_format(content: Column) -> Column:
    """Container by magic bytes, the name's ending not looked at; null where unknown."""
    return F.when(F.hex(F.substring(content, 1, 8)) == "D0CF11E0A1B11AE1", "hwp5").when(F.hex(F.substring(content, 1, 2)) == "504B", "hwpx")


def is_heading(style: Column) -> Column:
    """Level 1 to 6 of an outline style's name, else null."""
    n = F.regexp_extract(style, r"^개요 +([0-9]+)$", 1)
    return F.when((n != "") & n.cast("int").between(1, 6), n.cast("int"))


def safe_relative(path: Column) -> Column:
    """Whether a path is relative and never climbs."""
    return ~path.rlike(r"^(/|[A-Za-z]:)") & ~path.rlike(r"(^|[/\\])\.\.([/\\]|$)") & (path != "") & ~path.contains("\x00")
