"""Tagged records of a body stream, paragraph text with its control characters, raw-deflate streams."""

from __future__ import annotations

import struct
import zlib

PARA_HEADER, PARA_TEXT = 66, 67
#: Control codes that take one unit; those that take eight and carry a control of their own.
CHAR_CONTROLS = (0, 10, 13, 24, 25, 26, 27, 28, 29, 30, 31)
EXTENDED_CONTROLS = (1, 2, 3, 11, 12, 14, 15, 16, 17, 18, 21, 22, 23)


def inflate(data: bytes, limit: int = 1 << 28) -> bytes:
    """Raw deflate, refused beyond limit."""
    d = zlib.decompressobj(-15)
    out = d.decompress(data, limit)
    if d.unconsumed_tail:
        raise ValueError("inflated stream exceeds the limit")
    return out + d.flush()


def deflate(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    return c.compress(data) + c.flush()


def encode_record(tag: int, level: int, data: bytes) -> bytes:
    size = len(data)
    if size >= 0xFFF:
        return struct.pack("<II", tag | level << 10 | 0xFFF << 20, size) + data
    return struct.pack("<I", tag | level << 10 | size << 20) + data


def scan(data: bytes, strict: bool = False) -> list[tuple[int, int, int, bytes, str | None]]:
    """(idx, tag, level, payload, warning) of each record; a cut-off one keeps what is there, or raises if strict."""
    out, at = [], 0
    while at + 4 <= len(data):
        head = struct.unpack_from("<I", data, at)[0]
        at += 4
        size = head >> 20
        if size == 0xFFF and at + 4 <= len(data):
            size = struct.unpack_from("<I", data, at)[0]
            at += 4
        payload = data[at : at + size]
        warning = "truncated" if len(payload) < size else None
        if warning and strict:
            raise ValueError("record is cut off")
        out.append((len(out), head & 0x3FF, head >> 10 & 0x3FF, payload, warning))
        at += size
    return out


def parents(levels: list[int]) -> list[int]:
    """Index of each record's parent, -1 for roots; a level deeper than the open ones is taken one below the last."""
    stack: list[int] = []
    out = []
    for i, level in enumerate(levels):
        del stack[min(level, len(stack)) :]
        out.append(stack[-1] if stack else -1)
        stack.append(i)
    return out


def decode_text(data: bytes) -> list[tuple[int, str, int | None, str | None]]:
    """(unit offset, kind, control code, character) of each element: text, char, inline or extended control."""
    units = struct.unpack(f"<{len(data) // 2}H", data[: len(data) // 2 * 2])
    out, i = [], 0
    while i < len(units):
        u = units[i]
        if u >= 32:
            if 0xD800 <= u < 0xDC00 and i + 1 < len(units) and 0xDC00 <= units[i + 1] < 0xE000:
                out.append((i, "text", None, chr(0x10000 + (u - 0xD800 << 10) + units[i + 1] - 0xDC00)))
                i += 2
                continue
            out.append((i, "text", None, chr(u) if not 0xD800 <= u < 0xE000 else "�"))
            i += 1
        elif u in CHAR_CONTROLS:
            out.append((i, "char", u, None))
            i += 1
        else:
            out.append((i, "extended" if u in EXTENDED_CONTROLS else "inline", u, None))
            i += 8
    return out


def plain(data: bytes) -> str:
    """Text of a paragraph: line breaks and tabs stay, its end and other controls go."""
    return "".join(c if kind == "text" else "\n" if code == 10 else "\t" if code == 9 else "" for _, kind, code, c in decode_text(data))


def encode_text(text: str) -> bytes:
    parts = []
    for piece in text.split("\t"):
        parts.append(piece.replace("\n", "\n").encode("utf-16-le", "surrogatepass"))
    tab = struct.pack("<8H", 9, 0, 0, 0, 0, 0, 0, 9)
    return tab.join(parts) + struct.pack("<H", 13)


def body_stream(paragraphs: list[str]) -> bytes:
    """A deflated section of header and text records."""
    raw = b"".join(encode_record(PARA_HEADER, 0, struct.pack("<I", len(t)) + bytes(18)) + encode_record(PARA_TEXT, 1, encode_text(t)) for t in paragraphs)
    return deflate(raw)


def body_paragraphs(stream: bytes, limit: int = 1 << 28) -> list[str]:
    return stream_paragraphs(inflate(stream, limit))


def stream_paragraphs(stream: bytes) -> list[str]:
    """Texts of the paragraphs of an inflated record stream."""
    out: list[str] = []
    for _, tag, _, payload, _ in scan(stream):
        if tag == PARA_HEADER:
            out.append("")
        elif tag == PARA_TEXT and out:
            out[-1] = plain(payload)
    return out


def serialize(records: list[tuple[int, int, bytes]]) -> bytes:
    """A stream of records (parent, tag, payload), parents first, each level its depth in the forest."""
    depth: list[int] = []
    for parent, _, _ in records:
        depth.append(depth[parent] + 1 if parent >= 0 else 0)
    return b"".join(encode_record(tag, level, data) for (_, tag, data), level in zip(records, depth, strict=True))


def count_under(parent: list[int]) -> list[int]:
    """How many records each one is the root of, itself included; parents come first."""
    sizes = [1] * len(parent)
    for i in range(len(parent) - 1, -1, -1):
        if parent[i] >= 0:
            sizes[parent[i]] += sizes[i]
    return sizes


# Tags of controls, list headers and tables; names of tags in listings.
CTRL_HEADER, LIST_HEADER, TABLE = 71, 72, 77
TAG_NAMES = {66: "PARA_HEADER", 67: "PARA_TEXT", 68: "PARA_CHAR_SHAPE", 69: "PARA_LINE_SEG", 71: "CTRL_HEADER", 72: "LIST_HEADER", 73: "PAGE_DEF", 77: "TABLE"}


def write_table(rows: list[list[tuple[str, int, int]]], level: int = 1) -> list[tuple[int, int, bytes]]:
    """Records (level, tag, payload) of a table whose rows hold (text, row span, column span); cells stand at the first free column of their row."""
    taken: set[tuple[int, int]] = set()
    cells = []
    for r, row in enumerate(rows):
        c = 0
        for text, high, wide in row:
            while (r, c) in taken:
                c += 1
            taken |= {(r + i, c + j) for i in range(high) for j in range(wide)}
            cells.append((r, c, high, wide, text))
    columns = max((c for _, c in taken), default=-1) + 1
    head = struct.pack("<IHHH", 0, len(rows), columns, 0) + b"\0" * 8 + b"".join(struct.pack("<H", len(row)) for row in rows) + struct.pack("<H", 1)
    out = [(level - 1, CTRL_HEADER, b" lbt"), (level, TABLE, head)]
    for r, c, high, wide, text in cells:
        out.append((level, LIST_HEADER, struct.pack("<HIHHHHHII4HH", 1, 0, 0, c, r, wide, high, 1000 * wide, 500 * high, 0, 0, 0, 0, 1)))
        out += [(level, PARA_HEADER, struct.pack("<I", len(text) + 1) + b"\0" * 18), (level + 1, PARA_TEXT, text.encode("utf-16-le") + b"\r\0")]
    return out


def read_tables(data: bytes) -> list[dict]:
    """Tables of a record stream: rows, columns and the cells with place, spans, size and paragraphs. A cell that is cut off is left out, with a warning."""
    found = scan(data)
    up = parents([r[2] for r in found])
    out: list[dict] = []
    cell = None
    for (_, tag, _level, payload, _), parent in zip(found, up, strict=True):
        if tag == TABLE:
            rows, columns = struct.unpack_from("<HH", payload, 4) if len(payload) >= 8 else (0, 0)
            out.append({"rows": rows, "cols": columns, "cells": [], "warnings": [], "parent": parent})
            cell = None
        elif out and tag == LIST_HEADER and parent == out[-1]["parent"]:
            if len(payload) < 24:
                out[-1]["warnings"].append("cell header is cut off")
                cell = None
                continue
            c, r, wide, high = struct.unpack_from("<4H", payload, 8)
            width, height = struct.unpack_from("<2I", payload, 16)
            cell = {"row": r, "col": c, "row_span": high, "col_span": wide, "width": width, "height": height, "paragraphs": []}
            out[-1]["cells"].append(cell)
        elif cell is not None and tag == PARA_TEXT:
            cell["paragraphs"].append("".join(e[3] or "" for e in decode_text(payload)))
        elif out and parent < out[-1]["parent"]:
            cell = None
    for t in out:
        del t["parent"]
    return out
