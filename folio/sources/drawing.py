"""Drawings in documents: a closed subset of SVG made canonical, and gradient blocks of shape records."""

from __future__ import annotations

import struct
from decimal import Decimal
from xml.parsers import expat

#: Bounds of a drawing: bytes, elements, depth, characters of a list of numbers, and the greatest number.
MOST_BYTES, MOST_ELEMENTS, MOST_DEPTH, MOST_DIGITS, GREATEST = 1 << 20, 4096, 32, 65_536, 1_000_000
# Elements and their attributes; what else stands in a drawing is refused.
PAINT = ["stroke", "stroke-width", "stroke-dasharray"]
ELEMENTS = {
    "svg": ["xmlns", "width", "height", "viewBox"], "g": [], "rect": ["x", "y", "width", "height", "fill", *PAINT], "ellipse": ["cx", "cy", "rx", "ry", "fill", *PAINT],
    "circle": ["cx", "cy", "r", "fill", *PAINT], "line": ["x1", "y1", "x2", "y2", *PAINT], "polyline": ["points", "fill", *PAINT], "polygon": ["points", "fill", *PAINT],
}
NAMESPACE = "http://www.w3.org/2000/svg"
#: How many numbers an attribute may have; others have one.
COUNTS = {"viewBox": (4, 4), "points": (4, 4096), "stroke-dasharray": (1, 64)}


class DrawingError(ValueError):
    """A drawing that is not of the subset."""


def _numbers(value: str, least: int, most: int) -> list[float]:
    if len(value) > MOST_DIGITS:
        raise DrawingError("numbers are too long")
    try:
        found = [float(x) + 0.0 for x in value.replace(",", " ").split()]
    except ValueError as e:
        raise DrawingError("no number") from e
    if not least <= len(found) <= most or not all(abs(x) <= GREATEST for x in found):
        raise DrawingError("too few, too many or too great numbers")
    return found


def _plain(x: float) -> str:
    text = format(Decimal(repr(x if x else 0.0)), "f")
    return text.rstrip("0").rstrip(".") if "." in text else text


def _attribute(name: str, key: str, value: str) -> str:
    if key == "xmlns":
        if value != NAMESPACE:
            raise DrawingError("another namespace")
        return value
    if key in ("fill", "stroke"):
        if value == "none":
            return value
        if len(value) != 7 or value[0] != "#" or any(c not in "0123456789abcdefABCDEF" for c in value[1:]):
            raise DrawingError("no colour")
        return value.upper()
    found = _numbers(value, *COUNTS.get(key, (1, 1)))
    if key == "points" and len(found) % 2:
        raise DrawingError("points come in pairs")
    if (key in ("width", "height", "stroke-width", "stroke-dasharray") and min(found) < 0) or (key in ("r", "rx", "ry") and found[0] <= 0) or (key == "viewBox" and min(found[2:]) <= 0):
        raise DrawingError(f"{key} of {name} is too small")
    return " ".join(map(_plain, found))


def canonical_svg(data: str) -> str:
    """The drawing with sorted attributes, plain numbers and upper-case colours; DrawingError for anything outside the subset. An element without content is closed at once."""
    if len(data.encode()) > MOST_BYTES:
        raise DrawingError("too many bytes")
    out: list[str] = []
    open_: list[str] = []
    seen = 0

    def start(name: str, attributes: list[str]) -> None:
        nonlocal seen
        seen += 1
        if name not in ELEMENTS or (name == "svg") != (seen == 1) or seen > MOST_ELEMENTS or len(open_) >= MOST_DEPTH:
            raise DrawingError(f"element {name}")
        given = dict(zip(attributes[::2], attributes[1::2], strict=True))
        if other := sorted(set(given) - set(ELEMENTS[name])):
            raise DrawingError(f"attribute {other[0]}")
        if name == "svg" and not {"xmlns", "viewBox"} <= set(given):
            raise DrawingError("a root has its namespace and a viewBox")
        made = "".join(f' {k}="{_attribute(name, k, v)}"' for k, v in sorted(given.items()))
        out.append(f"<{name}{made}>")
        open_.append(name)

    def end(name: str) -> None:
        open_.pop()
        if out[-1].startswith(f"<{name}") and out[-1][len(name) + 1] in " >" and not out[-1].endswith("/>"):
            out[-1] = out[-1][:-1] + "/>"
        else:
            out.append(f"</{name}>")

    def text(value: str) -> None:
        if value.strip(" \t\r\n"):
            raise DrawingError("text")

    def refuse(*_: object) -> None:
        raise DrawingError("a comment, declaration or instruction")

    parser = expat.ParserCreate()
    parser.ordered_attributes = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, text
    parser.CommentHandler = parser.ProcessingInstructionHandler = parser.StartDoctypeDeclHandler = parser.XmlDeclHandler = parser.StartCdataSectionHandler = refuse
    try:
        parser.Parse(data, True)
    except expat.ExpatError as e:
        raise DrawingError(str(e)) from e
    return "".join(out)


def read_gradient(data: bytes, at: int = 0) -> tuple[dict, int] | None:
    """A gradient block (kind, angle, centre, step, stops) and its bytes; null where it is cut off or has no 1 to 16 colours.

    With more than two colours their positions follow, scaled by the greatest; two stand at the ends.
    """
    try:
        kind, angle, x, y, step, n = struct.unpack_from("<B5i", data, at)
        if not 1 <= n <= 16:
            return None
        end = at + 21
        places = [i / (max(n, 2) - 1) for i in range(n)]
        if n > 2:
            raw = struct.unpack_from(f"<{n}i", data, end)
            places, end = [min(max(p / max(1, *raw), 0.0), 1.0) for p in raw], end + 4 * n
        colors = struct.unpack_from(f"<{n}I", data, end)
    except struct.error:
        return None
    stops = sorted(zip(places, colors, strict=True), key=lambda s: s[0])
    return {"radial": kind == 2, "angle": float(angle), "center_x": x, "center_y": y, "step": step, "stops": [{"at": p, "color": c} for p, c in stops]}, end + 4 * n - at
