"""Summary property sets: six texts and two raw times."""

from __future__ import annotations

import struct

# Property ids, and the type codes of wide strings and times.
TEXTS = {2: "title", 3: "subject", 4: "author", 5: "keywords", 6: "description", 8: "last_saved_by"}
TIMES = {12: "create_time", 13: "modify_time"}
WIDE, TIME = 0x1F, 0x40
_FORMAT = bytes.fromhex("60b6a29f6110d411b4c6006097c09d8c")


def read(data: bytes) -> dict[str, str | int]:
    """What can be read of a property set; anything cut off or unknown is left out."""
    out: dict[str, str | int] = {}
    try:
        order, sections = struct.unpack_from("<H22xI", data)
        if order != 0xFFFE or not sections:
            return out
        base = struct.unpack_from("<I", data, 44)[0]
        n = struct.unpack_from("<I", data, base + 4)[0]
        for i in range(min(n, len(data) // 8)):
            pid, at = struct.unpack_from("<II", data, base + 8 + i * 8)
            try:
                kind, count = struct.unpack_from("<II", data, base + at)
                if pid in TEXTS and kind == WIDE:
                    text = data[base + at + 8 : base + at + 8 + 2 * count].decode("utf-16-le", "replace").split("\0")[0]
                    out |= {TEXTS[pid]: text} if text else {}
                elif pid in TIMES and kind == TIME:
                    value = struct.unpack_from("<Q", data, base + at + 4)[0]
                    out |= {TIMES[pid]: value} if value else {}
            except struct.error:
                continue
    except struct.error:
        pass
    return out


def write(values: dict[str, str | int]) -> bytes:
    names = {v: k for k, v in (TEXTS | TIMES).items()}
    items = sorted((names[k], v) for k, v in values.items() if v)
    table, body, at = b"", b"", 8 + 8 * len(items)
    for pid, value in items:
        if isinstance(value, str):
            raw = value.encode("utf-16-le") + b"\0\0"
            one = struct.pack("<II", WIDE, len(raw) // 2) + raw + bytes(-len(raw) % 4)
        else:
            one = struct.pack("<IQ", TIME, value)
        table += struct.pack("<II", pid, at)
        body, at = body + one, at + len(one)
    section = struct.pack("<II", at, len(items)) + table + body
    return struct.pack("<HHI16xI", 0xFFFE, 0, 0x00020006, 1) + _FORMAT + struct.pack("<I", 48) + section
