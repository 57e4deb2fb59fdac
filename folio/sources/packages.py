"""Zip packages: listings with limits, section XML to paragraphs and back, and other office formats."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from xml.etree import ElementTree
from xml.sax.saxutils import escape, unescape

#: Default ceilings of a package: entries, bytes of one entry, bytes in all, XML bytes, ratio.
LIMITS = {"entries": 4096, "entry_bytes": 512 << 20, "total_bytes": 2 << 30, "xml_bytes": 64 << 20, "ratio": 1000}
_STAMP = (1980, 1, 1, 0, 0, 0)
# Names of the paragraph namespace and the package type.
PARA_NS = "http://www.hancom.co.kr/hwpml/2011/paragraph"
SECTION_NS = "http://www.hancom.co.kr/hwpml/2011/section"
MIMETYPE = "application/hwp+zip"
_BAD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿\ud800-\udfff]")


class PackageError(ValueError):
    """A package that breaks a limit or can't be read."""


def xml_text(text: str) -> str:
    """Escaped, without characters that XML has no form for; a carriage return stays as a reference."""
    return escape(_BAD.sub("", text), {"\r": "&#13;"})


def entries(data: bytes) -> list[tuple[int, str, int, int]]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return [(i, x.filename, x.file_size, x.compress_size) for i, x in enumerate(z.infolist())]


def check(data: bytes, limits: dict[str, int] = LIMITS) -> None:
    """Raise PackageError before anything is inflated."""
    rows = entries(data)
    names = [r[1] for r in rows]
    if len(rows) > limits["entries"] or len(set(names)) != len(names) or sum(r[2] for r in rows) > limits["total_bytes"]:
        raise PackageError("too many entries, repeated names or too many bytes")
    if any(size > limits["entry_bytes"] or size > limits["ratio"] * max(packed, 1) or name.startswith("/") or ".." in name.split("/") for _, name, size, packed in rows):
        raise PackageError("an entry breaks a limit")


def part(z: zipfile.ZipFile, name: str, limits: dict[str, int] = LIMITS) -> ElementTree.Element:
    """The root of an XML entry that keeps the limit."""
    if z.getinfo(name).file_size > limits["xml_bytes"]:
        raise PackageError(f"{name} is too large")
    return ElementTree.fromstring(z.read(name))


def encrypted(z: zipfile.ZipFile, limits: dict[str, int] = LIMITS) -> bool:
    """Whether the manifest has an element that says how an entry is encrypted."""
    return "META-INF/manifest.xml" in z.namelist() and any(x.tag.rsplit("}", 1)[-1] == "encryption-data" for x in part(z, "META-INF/manifest.xml", limits).iter())


def intact(data: bytes) -> bool:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return z.testzip() is None


def zipped(files: list[tuple[str, str | bytes]], stored: str = "mimetype") -> bytes:
    """A package with fixed times, the type entry first and stored."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in files:
            info = zipfile.ZipInfo(name, _STAMP)
            info.compress_type = zipfile.ZIP_STORED if name == stored else zipfile.ZIP_DEFLATED
            z.writestr(info, content)
    return out.getvalue()


def write_sections(sections: list[list[str]], title: str = "") -> bytes:
    files: list[tuple[str, str | bytes]] = [("mimetype", MIMETYPE), ("version.xml", '<?xml version="1.0" encoding="UTF-8"?><version major="5" minor="1"/>')]
    for i, paragraphs in enumerate(sections):
        body = "".join(f'<hp:p id="{k}" styleIDRef="0"><hp:run charPrIDRef="0"><hp:t xml:space="preserve">{xml_text(t)}</hp:t></hp:run></hp:p>' for k, t in enumerate(paragraphs))
        files.append((f"Contents/section{i}.xml", f'<?xml version="1.0" encoding="UTF-8"?><hs:sec xmlns:hs="{SECTION_NS}" xmlns:hp="{PARA_NS}">{body}</hs:sec>'))
    files.append(("Contents/content.hpf", f'<?xml version="1.0" encoding="UTF-8"?><package xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>{xml_text(title)}</dc:title></metadata></package>'))
    return zipped(files)


def _paragraph_texts(p: ElementTree.Element) -> list[str]:
    """A paragraph's own text, then those of the paragraphs inside it, as in cells."""
    own, inner, nodes = [], [], [p]
    while nodes:
        for x in nodes.pop():
            if x.tag == f"{{{PARA_NS}}}t":
                own.append("".join(x.itertext()))
            elif x.tag == f"{{{PARA_NS}}}tbl":
                inner += [text for q in _cell_paragraphs(x) for text in _paragraph_texts(q)]
            else:
                nodes.append(x)
    return ["".join(own), *inner]


def _inside(node: ElementTree.Element, name: str, stop: str) -> list[ElementTree.Element]:
    """Elements of a name under a node in order, not those inside a `stop`."""
    out = []
    for x in node:
        if x.tag == f"{{{PARA_NS}}}{name}":
            out.append(x)
        elif x.tag != f"{{{PARA_NS}}}{stop}":
            out += _inside(x, name, stop)
    return out


def _cell_paragraphs(table: ElementTree.Element) -> list[ElementTree.Element]:
    return [p for cell in _inside(table, "tc", "tbl") for p in _inside(cell, "p", "tbl")]


def table_xml(cells: list[dict]) -> str:
    """A table element of cells (row, col, row_span, col_span, text); a text's lines are its paragraphs."""
    rows: dict[int, list[dict]] = {}
    for c in sorted(cells, key=lambda c: (c["row"], c["col"])):
        rows.setdefault(c["row"], []).append(c)
    paragraph = lambda t: f'<hp:p><hp:run><hp:t xml:space="preserve">{xml_text(t)}</hp:t></hp:run></hp:p>'
    cell = lambda c: (
        f'<hp:tc><hp:subList>{"".join(map(paragraph, c["text"].split(chr(10))))}</hp:subList><hp:cellAddr colAddr="{c["col"]}" rowAddr="{c["row"]}"/>'
        f'<hp:cellSpan colSpan="{c["col_span"]}" rowSpan="{c["row_span"]}"/><hp:cellSz width="{1000 * c["col_span"]}" height="{500 * c["row_span"]}"/></hp:tc>'
    )
    high = max((c["row"] + c["row_span"] for c in cells), default=0)
    wide = max((c["col"] + c["col_span"] for c in cells), default=0)
    return f'<hp:tbl rowCnt="{high}" colCnt="{wide}">{"".join("<hp:tr>" + "".join(map(cell, r)) + "</hp:tr>" for r in rows.values())}</hp:tbl>'


def write_tables(tables: list[list[dict]]) -> bytes:
    """A package whose one section has a paragraph for each table."""
    body = "".join(f'<hp:p id="{i}" styleIDRef="0"><hp:run charPrIDRef="0">{table_xml(t)}</hp:run></hp:p>' for i, t in enumerate(tables))
    section = f'<?xml version="1.0" encoding="UTF-8"?><hs:sec xmlns:hs="{SECTION_NS}" xmlns:hp="{PARA_NS}">{body}</hs:sec>'
    manifest = '<?xml version="1.0" encoding="UTF-8"?><opf:package xmlns:opf="http://www.idpf.org/2007/opf/"><opf:manifest><opf:item id="section0" href="Contents/section0.xml"/></opf:manifest></opf:package>'
    return zipped([("mimetype", MIMETYPE), ("version.xml", '<?xml version="1.0" encoding="UTF-8"?><version major="5" minor="1"/>'), ("Contents/section0.xml", section), ("Contents/content.hpf", manifest)])


def _sections(data: bytes, limits: dict[str, int]) -> list[ElementTree.Element]:
    check(data, limits)
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if encrypted(z, limits):
            raise PackageError("encrypted")
        names = sorted((n for n in z.namelist() if re.fullmatch(r"Contents/section\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        return [part(z, n, limits) for n in names]


def read_tables(data: bytes, limits: dict[str, int] = LIMITS) -> list[list[dict]]:
    """Cells (row, col, spans, width, height, text) of every table of a package in order, nested ones after the one that holds them."""
    out = []
    number = lambda x, name, key, other: int((x.find(f"{{{PARA_NS}}}{name}") if x.find(f"{{{PARA_NS}}}{name}") is not None else {}).get(key, other))
    for root in _sections(data, limits):
        for table in root.iter(f"{{{PARA_NS}}}tbl"):
            cells = []
            for c in _inside(table, "tc", "tbl"):
                text = "\n".join(_paragraph_texts(p)[0] for p in _inside(c, "p", "tbl"))
                cells.append({"row": number(c, "cellAddr", "rowAddr", 0), "col": number(c, "cellAddr", "colAddr", 0), "row_span": number(c, "cellSpan", "rowSpan", 1), "col_span": number(c, "cellSpan", "colSpan", 1), "width": number(c, "cellSz", "width", 0), "height": number(c, "cellSz", "height", 0), "text": text})
            out.append(cells)
    return out


def structure(data: bytes, limits: dict[str, int] = LIMITS) -> list[dict]:
    """Paragraphs, tables, pictures and characters of each section, no text kept."""
    count = lambda root, name: sum(1 for _ in root.iter(f"{{{PARA_NS}}}{name}"))
    return [{"paragraphs": count(r, "p"), "tables": count(r, "tbl"), "pictures": count(r, "pic"), "chars": sum(len("".join(t.itertext())) for t in r.iter(f"{{{PARA_NS}}}t"))} for r in _sections(data, limits)]


def manifest(data: bytes) -> list[tuple[str, str]]:
    """(id, href) of the items that a package lists."""
    check(data)
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = part(z, "Contents/content.hpf")
    return [(x.get("id", ""), x.get("href", "")) for x in root.iter() if x.tag.rsplit("}", 1)[-1] == "item"]


def read_sections(data: bytes, limits: dict[str, int] = LIMITS) -> list[list[str]]:
    """Paragraph texts by section, sections in numeric order; broken or oversized packages raise PackageError."""
    try:
        check(data, limits)
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = sorted((n for n in z.namelist() if re.fullmatch(r"Contents/section\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
            if encrypted(z, limits):
                raise PackageError("encrypted")
            out = []
            for n in names:
                root = part(z, n, limits)
                out.append([text for p in root.findall(f"{{{PARA_NS}}}p") for text in _paragraph_texts(p)])
            return out
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, NotImplementedError, EOFError) as e:
        raise PackageError(str(e)) from e


def metadata(data: bytes) -> dict[str, str]:
    check(data)
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if "Contents/content.hpf" not in z.namelist():
            return {}
        root = part(z, "Contents/content.hpf")
    return {x.tag.rsplit("}", 1)[1]: x.text or "" for x in root.iter() if x.tag.startswith("{http://purl.org/dc/elements/1.1/}")}


def replace_in_package(data: bytes, old: str, new: str) -> bytes:
    """Text of sections replaced; every other entry, and a section without the text, keeps its bytes as they are packed."""
    check(data)
    changed = {}
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for n in z.namelist():
            if re.fullmatch(r"Contents/section\d+\.xml", n):
                raw = z.read(n)
                text = re.sub(r"(<hp:t[^>]*>)(.*?)(</hp:t>)", lambda m: m[1] + xml_text(unescape(m[2], {"&#13;": "\r"}).replace(old, new)) + m[3], raw.decode(), flags=re.S).encode()
                if text != raw:
                    changed[n] = text
    return rewritten(data, changed)


def rewritten(data: bytes, changed: dict[str, bytes]) -> bytes:
    """The package with the changed entries packed anew in their places; local headers, data and directory records of the others are copied."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        infos, directory = z.infolist(), z.start_dir
    ends = dict(zip(sorted(x.header_offset for x in infos), [*sorted(x.header_offset for x in infos)[1:], directory], strict=True))
    out, records, at = bytearray(), bytearray(), directory
    for info in infos:
        sizes = [int.from_bytes(data[at + k : at + k + 2], "little") for k in (28, 30, 32)]
        record = bytearray(data[at : at + 46 + sum(sizes)])
        at += len(record)
        record[42:46] = len(out).to_bytes(4, "little")
        if info.filename in changed:
            text = changed[info.filename]
            packed = text if info.compress_type == zipfile.ZIP_STORED else zlib.compress(text, wbits=-15)
            crc, size, full = (x.to_bytes(4, "little") for x in (zlib.crc32(text), len(packed), len(text)))
            record[8:10] = (info.flag_bits & ~8).to_bytes(2, "little")  # sizes stand in the header, not behind the data
            record[16:28] = crc + size + full
            name = record[46 : 46 + sizes[0]]
            out += b"PK\x03\x04" + record[6:16] + crc + size + full + len(name).to_bytes(2, "little") + b"\0\0" + name + packed
        else:
            out += data[info.header_offset : ends[info.header_offset]]
        records += record
    tail = bytearray(data[at:])
    if tail[:4] != b"PK\x05\x06":
        raise PackageError("a directory that can't be copied")
    tail[12:20] = len(records).to_bytes(4, "little") + len(out).to_bytes(4, "little")
    return bytes(out + records + tail)


_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def write_docx(paragraphs: list[str]) -> bytes:
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{xml_text(t)}</w:t></w:r></w:p>' for t in paragraphs)
    return zipped([
        ("[Content_Types].xml", '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'),
        ("_rels/.rels", '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'),
        ("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{_W}"><w:body>{body}</w:body></w:document>'),
    ])


def read_docx(data: bytes) -> list[str]:
    check(data)
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = part(z, "word/document.xml")
    return ["".join(t.text or "" for t in p.iter(f"{{{_W}}}t")) for p in root.iter(f"{{{_W}}}p")]


_TEXT = "urn:oasis:names:tc:opendocument:xmlns:text:1.0"


def write_odt(paragraphs: list[str]) -> bytes:
    spaces = lambda t: re.sub(" +", lambda m: f'<text:s text:c="{len(m[0])}"/>' if len(m[0]) > 1 else " ", re.sub("^ | $", '<text:s text:c="1"/>', xml_text(t).replace("\t", "<text:tab/>")))
    body = "".join(f"<text:p>{spaces(t)}</text:p>" for t in paragraphs)
    return zipped([
        ("mimetype", "application/vnd.oasis.opendocument.text"),
        ("content.xml", f'<?xml version="1.0" encoding="UTF-8"?><office:document-content xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:text="{_TEXT}"><office:body><office:text>{body}</office:text></office:body></office:document-content>'),
        ("META-INF/manifest.xml", '<?xml version="1.0" encoding="UTF-8"?><manifest:manifest xmlns:manifest="urn:oasis:names:tc:opendocument:xmlns:manifest:1.0"><manifest:file-entry manifest:full-path="/" manifest:media-type="application/vnd.oasis.opendocument.text"/></manifest:manifest>'),
    ])


def read_odt(data: bytes) -> list[str]:
    check(data)
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if encrypted(z):
            raise PackageError("encrypted")
        root = part(z, "content.xml")

    def text(e) -> str:
        own = " " * int(e.get(f"{{{_TEXT}}}c", "1")) if e.tag == f"{{{_TEXT}}}s" else "\t" if e.tag == f"{{{_TEXT}}}tab" else e.text or ""
        return own + "".join(text(c) + (c.tail or "") for c in e)

    return [text(p) for p in root.iter(f"{{{_TEXT}}}p")]
