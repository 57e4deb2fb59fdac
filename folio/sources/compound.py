"""Compound files: streams in sectors chained by an allocation table, small ones in a mini stream."""

from __future__ import annotations

import struct

MAGIC = bytes.fromhex("D0CF11E0A1B11AE1")
FREE, END, FAT_SECTOR = 0xFFFFFFFF, 0xFFFFFFFE, 0xFFFFFFFD
SECTOR, MINI, CUTOFF = 512, 64, 4096


class CompoundError(ValueError):
    """A compound file that can't be read."""


def _chain(table: list[int], start: int, limit: int) -> list[int]:
    out, at = [], start
    while at < END - 1:
        if at >= len(table) or len(out) > limit:
            raise CompoundError("broken sector chain")
        out.append(at)
        at = table[at]
    return out


def read_streams(data: bytes, max_bytes: int = 1 << 30) -> dict[str, bytes]:
    """Path to bytes of every stream; raises CompoundError on broken files or more than max_bytes in all."""
    if data[:8] != MAGIC or len(data) < SECTOR:
        raise CompoundError("not a compound file")
    shift, mini_shift = struct.unpack_from("<HH", data, 30)
    size = 1 << shift
    n_fat, first_dir, cutoff, first_mini, n_mini, first_difat, n_difat = _header(data)
    sector = lambda i: data[(i + 1) * size : (i + 2) * size]
    ints = lambda raw: list(struct.unpack(f"<{len(raw) // 4}I", raw[: len(raw) // 4 * 4]))
    difat = [x for x in struct.unpack_from("<109I", data, 76) if x < FAT_SECTOR]
    at = first_difat
    for _ in range(n_difat):
        more = ints(sector(at))
        difat += [x for x in more[:-1] if x < FAT_SECTOR]
        at = more[-1]
    fat = [x for s in difat[:n_fat] for x in ints(sector(s))]
    limit = len(data) // size + 1
    join = lambda start: b"".join(sector(s) for s in _chain(fat, start, limit))
    directory = join(first_dir)
    entries = []
    for i in range(0, len(directory), 128):
        e = directory[i : i + 128]
        n = struct.unpack_from("<H", e, 64)[0]
        left, right, child = struct.unpack_from("<III", e, 68)
        start, length = struct.unpack_from("<IQ", e, 116)
        entries.append((e[: max(n - 2, 0)].decode("utf-16-le", "replace"), e[66], left, right, child, start, length))
    mini_fat = [x for s in _chain(fat, first_mini, limit) for x in ints(sector(s))] if n_mini else []
    mini = join(entries[0][5]) if entries and entries[0][5] < END else b""
    out: dict[str, bytes] = {}
    total = 0
    stack, seen = [(entries[0][4], "")] if entries else [], set()
    while stack:
        i, path = stack.pop()
        if i >= len(entries) or i in seen:
            continue
        seen.add(i)
        name, kind, left, right, child, start, length = entries[i]
        stack += [(left, path), (right, path)]
        if kind == 1:
            stack.append((child, f"{path}/{name}"))
        elif kind == 2:
            total += length
            if total > max_bytes:
                raise CompoundError("streams exceed the limit")
            if length < cutoff:
                raw = b"".join(mini[s << mini_shift : (s + 1) << mini_shift] for s in _chain(mini_fat, start, len(mini_fat))) if length else b""
            else:
                raw = join(start)
            if len(raw) < length:
                raise CompoundError("stream is cut off")
            out[f"{path}/{name}"] = raw[:length]
    return dict(sorted(out.items()))


def _header(data: bytes) -> tuple[int, ...]:
    n_fat, first_dir = struct.unpack_from("<II", data, 44)
    cutoff, first_mini, n_mini, first_difat, n_difat = struct.unpack_from("<IIIII", data, 56)
    return n_fat, first_dir, cutoff, first_mini, n_mini, first_difat, n_difat


def write_streams(streams: dict[str, bytes]) -> bytes:
    """A version-3 file of streams by path ("/Dir/Name"), the same bytes for the same streams."""
    nodes: list[dict] = [{"name": "Root Entry", "kind": 5, "kids": {}, "data": b""}]
    for path in sorted(streams):
        at, parts = nodes[0], path.strip("/").split("/")
        for i, name in enumerate(parts):
            if name not in at["kids"]:
                nodes.append({"name": name, "kind": 2 if i == len(parts) - 1 else 1, "kids": {}, "data": b""})
                at["kids"][name] = len(nodes) - 1
            at = nodes[at["kids"][name]]
        at["data"] = streams[path]
    sectors: list[bytes] = []
    fat: list[int] = []

    def put(raw: bytes) -> int:
        if not raw:
            return END
        first, n = len(sectors), -(-len(raw) // SECTOR)
        sectors.extend(raw[i * SECTOR : (i + 1) * SECTOR].ljust(SECTOR, b"\0") for i in range(n))
        fat.extend([*range(first + 1, first + n), END])
        return first

    mini, mini_fat = b"", []
    for n in nodes[1:]:
        n["start"] = END
        if n["kind"] == 2 and len(n["data"]) >= CUTOFF:
            n["start"] = put(n["data"])
        elif n["kind"] == 2 and n["data"]:
            k = -(-len(n["data"]) // MINI)
            n["start"] = len(mini_fat)
            mini += n["data"].ljust(k * MINI, b"\0")
            mini_fat += [*range(len(mini_fat) + 1, len(mini_fat) + k), END]
    nodes[0]["start"] = put(mini)
    table = b"".join(struct.pack("<I", x) for x in mini_fat)
    first_mini = put(table.ljust(-(-len(table) // SECTOR) * SECTOR, b"\xff")) if table else END
    raw = b""
    right = {}
    for n in nodes:
        kids = sorted(n["kids"].items(), key=lambda x: (len(x[0].encode("utf-16-le")), x[0].upper()))
        n["child"] = kids[0][1] if kids else FREE
        right.update({a: b for (_, a), (_, b) in zip(kids, kids[1:], strict=False)})
    for i, n in enumerate(nodes):
        name = n["name"].encode("utf-16-le") + b"\0\0"
        length = len(mini) if i == 0 else len(n["data"])
        raw += name.ljust(64, b"\0") + struct.pack("<HBBIII", len(name), n["kind"], 1, FREE, right.get(i, FREE), n["child"]) + bytes(36) + struct.pack("<IQ", n["start"] if n["kind"] != 1 else 0, length)
    empty = bytes(64) + struct.pack("<HBBIII", 0, 0, 0, FREE, FREE, FREE) + bytes(48)
    while len(raw) % SECTOR:
        raw += empty
    first_dir = put(raw)
    n_fat = 1
    while n_fat * (SECTOR // 4) < len(fat) + n_fat:
        n_fat += 1
    if n_fat > 109:
        raise CompoundError("too large for one header")
    first_fat = len(sectors)
    fat += [FAT_SECTOR] * n_fat
    fat += [FREE] * (n_fat * (SECTOR // 4) - len(fat))
    sectors += [struct.pack("<128I", *fat[i * 128 : (i + 1) * 128]) for i in range(n_fat)]
    difat = [*range(first_fat, first_fat + n_fat)]
    header = MAGIC + bytes(16) + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + bytes(6) + struct.pack("<IIIIIIIIII", 0, n_fat, first_dir, 0, CUTOFF, first_mini, -(-len(table) // SECTOR), END, 0, difat[0])
    return header + struct.pack("<108I", *(difat[1:] + [FREE] * (108 - len(difat) + 1))) + b"".join(sectors)
