"""Markdown and HTML fragments as blocks."""

from __future__ import annotations

import re
from html import unescape
from xml.etree import ElementTree

from pyspark.sql.functions import udtf

from ..workers import importable

_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})\s*(\S*)")
_HEADING = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_ITEM = re.compile(r"^(\s*)([-*+]|\d{1,9}[.)])[ \t]+(.*)$")
_RULE = re.compile(r"^ {0,3}([-*_])[ \t]*(?:\1[ \t]*){2,}$")
_BARS = re.compile(r"^\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$")


def split_bars(line: str) -> list[str]:
    parts = re.split(r"(?<!\\)\|", line.strip().removeprefix("|").removesuffix("|"))
    return [p.strip().replace("\\|", "|") for p in parts]


def markdown_blocks(text: str) -> list[tuple[str, int, str]]:
    """(kind, level, text) of each block: heading, paragraph, bullet, ordered, quote, code, rule, row."""
    out: list[tuple[str, int, str]] = []
    lines, i, open_ = text.split("\n"), 0, []

    def flush() -> None:
        if open_:
            out.append(("paragraph", 0, " ".join(x.strip() for x in open_)))
            open_.clear()

    while i < len(lines):
        line = lines[i]
        if m := _FENCE.match(line):
            flush()
            body = []
            i += 1
            while i < len(lines) and not lines[i].strip().startswith(m[1]):
                body.append(lines[i])
                i += 1
            out.append(("code", 0, "\n".join(body)))
        elif not line.strip():
            flush()
        elif m := _HEADING.match(line):
            flush()
            out.append(("heading", len(m[1]), m[2] or ""))
        elif _RULE.match(line):
            flush()
            out.append(("rule", 0, ""))
        elif "|" in line and i + 1 < len(lines) and "-" in lines[i + 1] and _BARS.match(lines[i + 1]) and not open_:
            out.append(("row", 0, "\t".join(split_bars(line))))
            i += 2
            while i < len(lines) and "|" in lines[i] and lines[i].strip():
                out.append(("row", 1, "\t".join(split_bars(lines[i]))))
                i += 1
            continue
        elif m := _ITEM.match(line):
            flush()
            out.append(("bullet" if m[2] in "-*+" else "ordered", len(m[1].expandtabs(4)) // 2, m[3]))
        elif line.lstrip().startswith(">"):
            flush()
            out.append(("quote", 0, line.lstrip()[1:].strip()))
        else:
            open_.append(line)
        i += 1
    flush()
    return out


#: Elements that the strict fragment reader takes.
FRAGMENT_TAGS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "table", "thead", "tbody", "tr", "td", "th", "b", "strong", "i", "em", "u", "s", "del", "sup", "sub", "a", "br", "span", "div", "blockquote", "pre", "code", "img", "hr", "section"}


def place_spans(rows: list[list[tuple[int, int]]]) -> list[tuple[int, int, int, int]]:
    """(row, col, row_span, col_span) of cells given by spans: each takes its row's first free slot; overlaps and overruns raise."""
    taken: set[tuple[int, int]] = set()
    out = []
    for r, cells in enumerate(rows):
        c = 0
        for rs, cs in cells:
            if rs < 1 or cs < 1 or r + rs > len(rows):
                raise ValueError("span is out of the table")
            while (r, c) in taken:
                c += 1
            own = {(r + i, c + j) for i in range(rs) for j in range(cs)}
            if own & taken:
                raise ValueError("spans overlap")
            taken |= own
            out.append((r, c, rs, cs))
            c += cs
    return out


def fragment_blocks(html: str) -> list[tuple[str, str]]:
    """(tag, text) of the blocks of a strict XHTML fragment; unknown elements and broken markup raise ValueError."""
    try:
        root = ElementTree.fromstring(f"<div>{html}</div>")
    except ElementTree.ParseError as e:
        raise ValueError(str(e)) from e
    out = []
    for e in root.iter():
        if e.tag not in FRAGMENT_TAGS:
            raise ValueError(f"unknown element {e.tag}")
        if e.tag in ("p", "li", "td", "th", "pre", "blockquote") or re.fullmatch("h[1-6]", e.tag):
            out.append((e.tag, " ".join("".join(e.itertext()).split())))
    return out


@udtf(returnType="ord int, kind string, level int, text string", useArrow=True)
class MarkdownBlocks:
    """SELECT * FROM docs, LATERAL md_blocks(text)."""

    def eval(self, text: str):
        for i, (kind, level, body) in enumerate(markdown_blocks(text or "")):
            yield i, kind, level, body


@udtf(returnType="ord int, tag string, text string, error string", useArrow=True)
class FragmentBlocks:
    """SELECT * FROM pages, LATERAL html_blocks(html); a fragment that is refused is one row with its error."""

    def eval(self, html: str):
        try:
            for i, (tag, text) in enumerate(fragment_blocks(html or "")):
                yield i, tag, text, None
        except ValueError as e:
            yield -1, None, None, str(e)[:200]


def register(spark) -> None:
    importable(spark)
    spark.udtf.register("md_blocks", MarkdownBlocks)
    spark.udtf.register("html_blocks", FragmentBlocks)
