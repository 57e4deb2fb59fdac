"""Containers as binary columns: documents to files and back, Arrow batches all the way.

A document is one row on both sides, so that what a task holds is one batch of documents. Broken containers give a row with
an error and no paragraphs; no task fails on them.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..workers import importable
from . import compound, distribution, drawing, packages, properties, records


def _write_compound(paragraphs: list[str]) -> bytes:
    head = b"HWP Document File".ljust(32, b"\0") + (0x05000300).to_bytes(4, "little") + (1).to_bytes(4, "little")
    return compound.write_streams({"/FileHeader": head.ljust(256, b"\0"), "/BodyText/Section0": records.body_stream(paragraphs)})


def _read_compound(data: bytes) -> list[str]:
    streams = compound.read_streams(data)
    head = streams.get("/FileHeader", b"")
    if not head.startswith(b"HWP Document File"):
        raise compound.CompoundError("no file header")
    flags = int.from_bytes(head[36:40], "little")
    if flags & 0x112:
        raise compound.CompoundError("encrypted or managed")
    top = "/ViewText/Section" if flags & 4 else "/BodyText/Section"
    bodies = sorted((n for n in streams if n.startswith(top)), key=lambda n: int(n[len(top) :] or 0))
    if flags & 4:
        return [p for n in bodies for p in records.stream_paragraphs(distribution.open_section(streams[n], bool(flags & 1)))]
    return [p for n in bodies for p in records.body_paragraphs(streams[n])]


def _write_distribution(paragraphs: list[str]) -> bytes:
    head = b"HWP Document File".ljust(32, b"\0") + (0x05000300).to_bytes(4, "little") + (5).to_bytes(4, "little")
    body = records.body_stream(paragraphs)
    sealed = distribution.seal_section(body, len(body), hashlib.sha1(body).hexdigest())
    return compound.write_streams({"/FileHeader": head.ljust(256, b"\0"), "/ViewText/Section0": sealed})


WRITERS: dict[str, Callable[[list[str]], bytes]] = {"hwpx": lambda p: packages.write_sections([p]), "hwp5": _write_compound, "docx": packages.write_docx, "odt": packages.write_odt}
READERS: dict[str, Callable[[bytes], list[str]]] = {"hwpx": lambda d: [p for s in packages.read_sections(d) for p in s], "hwp5": _read_compound, "docx": packages.read_docx, "odt": packages.read_odt}


def sniff(data: bytes) -> str | None:
    if data[:8] == compound.MAGIC:
        return "hwp5"
    if data[:2] == b"PK":
        try:
            names = {n for _, n, _, _ in packages.entries(data)}
        except Exception:
            return None
        return "docx" if "word/document.xml" in names else "odt" if "content.xml" in names else "hwpx"
    return None


#: Bytes of a batch whose rows are Python objects at once, and of an Arrow batch to a worker where the session sets no other bound; one row at least.
PIECE_BYTES, BATCH_BYTES = 1 << 20, 1 << 22


def map_column(df: DataFrame, f: Callable[[list], pa.Array], column: str, out: str, kind: str) -> DataFrame:
    """df with a column made from another one, a piece of a batch at a time. The bound of batches stays with the session, as plans run later."""
    importable(df.sparkSession)
    if df.sparkSession.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = max(1, batch.num_rows * PIECE_BYTES // max(1, batch.nbytes))
            for b in (batch.slice(i, n) for i in range(0, max(1, batch.num_rows), n)):
                yield pa.RecordBatch.from_arrays([*b.columns, f(b.column(b.schema.get_field_index(column)).to_pylist())], names=[*b.schema.names, out])

    from pyspark.sql.types import StructType

    return df.mapInArrow(run, StructType([*df.schema.fields, *StructType.fromDDL(f"{out} {kind}").fields]))


def to_files(paras: DataFrame, kind: str) -> DataFrame:
    """doc_id, content: each document's paragraphs (doc_id, para_idx, text) as a file of `kind`, or of "distribution"."""
    write = _write_distribution if kind == "distribution" else WRITERS[kind]
    one = paras.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("para_idx", "text"))), lambda x: x["text"]).alias("paragraphs"))
    return map_column(one, lambda rows: pa.array([write([t or "" for t in p]) for p in rows], pa.binary()), "paragraphs", "content", "binary").select("doc_id", "content")


def read_files(files: DataFrame) -> DataFrame:
    """files (.., content) with format, paragraphs and error; what can't be read has an error and no paragraphs."""

    def read(rows: list) -> pa.Array:
        out = []
        for data in rows:
            kind = sniff(data or b"")
            try:
                out.append({"format": kind, "paragraphs": READERS[kind](data), "error": None} if kind else {"format": None, "paragraphs": [], "error": "unknown format"})
            except Exception as e:  # hostile files must not fail a task
                out.append({"format": kind, "paragraphs": [], "error": str(e)[:200] or type(e).__name__})
        return pa.array(out, pa.struct([("format", pa.string()), ("paragraphs", pa.list_(pa.string())), ("error", pa.string())]))

    return map_column(files, read, "content", "doc", "struct<format: string, paragraphs: array<string>, error: string>").select(*[c for c in files.columns if c != "content"], "doc.*")


def paragraphs(read: DataFrame, *keys: str) -> DataFrame:
    return read.select(*keys, F.posexplode("paragraphs").alias("para_idx", "text")).withColumn("para_idx", F.col("para_idx").cast("long"))


def _guarded(df: DataFrame, read: Callable[[bytes], list], column: str, out: str, kind: pa.DataType, ddl: str) -> DataFrame:
    """df with `out` and error instead of a binary column; hostile bytes give null and what was wrong, no task fails on them."""

    def each(rows: list) -> pa.Array:
        made = []
        for data in rows:
            try:
                made.append({"value": read(data or b""), "error": None})
            except Exception as e:
                made.append({"value": None, "error": str(e)[:200] or type(e).__name__})
        return pa.array(made, pa.struct([("value", kind), ("error", pa.string())]))

    found = map_column(df, each, column, "_read", f"struct<value: {ddl}, error: string>").drop(column)
    return found.withColumn(out, F.col("_read.value")).withColumn("error", F.col("_read.error")).drop("_read")


def zip_entries(files: DataFrame) -> DataFrame:
    kind = pa.list_(pa.struct([("idx", pa.int32()), ("name", pa.string()), ("size", pa.int64()), ("packed", pa.int64())]))
    read = lambda data: [dict(zip(("idx", "name", "size", "packed"), e, strict=True)) for e in packages.entries(data)]
    return _guarded(files, read, "content", "entries", kind, "array<struct<idx: int, name: string, size: bigint, packed: bigint>>")


def streams(files: DataFrame) -> DataFrame:
    kind = pa.list_(pa.struct([("name", pa.string()), ("data", pa.binary())]))
    read = lambda data: [{"name": n, "data": s} for n, s in compound.read_streams(data).items()]
    return _guarded(files, read, "content", "streams", kind, "array<struct<name: string, data: binary>>")


def scan_records(df: DataFrame, column: str) -> DataFrame:
    """Records of a deflated body stream with their parents."""

    kind = pa.list_(pa.struct([("idx", pa.int32()), ("tag", pa.int32()), ("level", pa.int32()), ("size", pa.int64()), ("parent", pa.int32()), ("warning", pa.string())]))

    def read(data: bytes) -> list:
        found = records.scan(records.inflate(data))
        up = records.parents([r[2] for r in found])
        return [{"idx": i, "tag": t, "level": v, "size": len(p), "parent": q, "warning": w} for (i, t, v, p, w), q in zip(found, up, strict=True)]

    return _guarded(df, read, column, "records", kind, "array<struct<idx: int, tag: int, level: int, size: bigint, parent: int, warning: string>>")


def summaries(df: DataFrame, column: str) -> DataFrame:
    """Property sets as structs of texts and raw times; a null or broken one has nulls."""
    names = [*properties.TEXTS.values(), *properties.TIMES.values()]
    kind = pa.struct([(n, pa.string() if n in properties.TEXTS.values() else pa.int64()) for n in names])
    ddl = "struct<" + ", ".join(f"{n}: {'string' if n in properties.TEXTS.values() else 'bigint'}" for n in names) + ">"

    def read(rows: list) -> pa.Array:
        return pa.array([{n: None for n in names} | properties.read(x or b"") for x in rows], kind)

    return map_column(df, read, column, "summary", ddl).drop(column)


def property_sets(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with a property set made of the named columns."""
    packed = df.withColumn("_p", F.to_json(F.struct(*columns)))
    return map_column(packed, lambda rows: pa.array([properties.write(json.loads(x)) for x in rows], pa.binary()), "_p", "content", "binary").drop("_p")


def decode_texts(df: DataFrame, column: str) -> DataFrame:
    """Elements of paragraph texts: unit offset, kind, control code, character."""

    def read(rows: list) -> pa.Array:
        kind = pa.list_(pa.struct([("at", pa.int32()), ("kind", pa.string()), ("code", pa.int32()), ("ch", pa.string())]))
        return pa.array([[dict(zip(("at", "kind", "code", "ch"), e, strict=True)) for e in records.decode_text(x or b"")] for x in rows], kind)

    return map_column(df, read, column, "elements", "array<struct<at: int, kind: string, code: int, ch: string>>").drop(column)


def dump(df: DataFrame, column: str) -> DataFrame:
    """Records as rows with their tags' names, payloads in hex, and how many records each one is the root of."""
    found = scan_payloads(df, column)
    names = F.create_map(*(F.lit(x) for kv in records.TAG_NAMES.items() for x in kv))
    each = found.select(*[c for c in df.columns if c != column], "error", F.explode_outer("records").alias("r"))
    return each.select(*[c for c in df.columns if c != column], "error", "r.idx", "r.tag", F.coalesce(names[F.col("r.tag")], F.concat(F.lit("TAG_"), "r.tag")).alias("name"), "r.level", "r.nodes", F.hex("r.data").alias("payload"))


def scan_payloads(df: DataFrame, column: str) -> DataFrame:
    kind = pa.list_(pa.struct([("idx", pa.int32()), ("tag", pa.int32()), ("level", pa.int32()), ("nodes", pa.int32()), ("data", pa.binary())]))

    def read(data: bytes) -> list:
        found = records.scan(records.inflate(data))
        nodes = records.count_under(records.parents([r[2] for r in found]))
        return [{"idx": i, "tag": t, "level": v, "nodes": n, "data": p} for (i, t, v, p, _), n in zip(found, nodes, strict=True)]

    return _guarded(df, read, column, "records", kind, "array<struct<idx: int, tag: int, level: int, nodes: int, data: binary>>")


def rewrite_records(df: DataFrame, column: str) -> DataFrame:
    """A body stream read as a forest of records and written again, levels from depths: what was well formed has the same bytes."""

    def again(data: bytes) -> bytes:
        found = records.scan(records.inflate(data), strict=True)
        up = records.parents([r[2] for r in found])
        return records.serialize([(q, t, p) for (_, t, _, p, _), q in zip(found, up, strict=True)])

    return _guarded(df, again, column, "stream", pa.binary(), "binary")


def table_streams(cells: DataFrame) -> DataFrame:
    """table_id, content: each table's cells (row_idx, col_idx, row_span, col_span, text) as records of a body stream."""
    one = cells.groupBy("table_id", "row_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("col_idx", "text", "row_span", "col_span"))), lambda x: F.struct(x["text"].alias("t"), x["row_span"].alias("r"), x["col_span"].alias("c"))).alias("line"))
    per = one.groupBy("table_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", "line"))), lambda x: x["line"]).alias("rows"))

    def write(tables: list) -> pa.Array:
        return pa.array([records.deflate(b"".join(records.encode_record(tag, level, data) for level, tag, data in records.write_table([[(x["t"], x["r"], x["c"]) for x in row] for row in rows]))) for rows in tables], pa.binary())

    return map_column(per, write, "rows", "content", "binary").drop("rows")


def read_cells(streams_: DataFrame, column: str) -> DataFrame:
    """Cells of the tables in body streams: table (its place in the stream), row_idx, col_idx, spans, size and text; broken streams have an error."""
    kind = pa.list_(pa.struct([("table", pa.int32()), ("row_idx", pa.int64()), ("col_idx", pa.int64()), ("row_span", pa.int32()), ("col_span", pa.int32()), ("width", pa.int64()), ("height", pa.int64()), ("text", pa.string())]))

    def read(data: bytes) -> list:
        names = ("row", "col", "row_span", "col_span", "width", "height")
        return [dict(zip(("row_idx", "col_idx", *names[2:]), (c[n] for n in names), strict=True)) | {"table": i, "text": "\n".join(c["paragraphs"])} for i, t in enumerate(records.read_tables(records.inflate(data))) for c in t["cells"]]

    found = _guarded(streams_, read, column, "cells", kind, "array<struct<table: int, row_idx: bigint, col_idx: bigint, row_span: int, col_span: int, width: bigint, height: bigint, text: string>>")
    keys = [c for c in streams_.columns if c != column]
    return found.select(*keys, "error", F.explode_outer("cells").alias("c")).select(*keys, "error", "c.*")


def gate(files: DataFrame) -> DataFrame:
    """Header facts of compound files: version, the flags that are set, and whether a body can be read; others have an error."""
    kind = pa.struct([("version", pa.string()), ("flags", pa.list_(pa.string())), ("readable", pa.bool_())])

    def read(data: bytes) -> dict:
        head = compound.read_streams(data).get("/FileHeader", b"")
        if len(head) < 40 or not head.startswith(b"HWP Document File"):
            raise compound.CompoundError("no file header")
        bits = int.from_bytes(head[36:40], "little")
        flags = [name for i, name in FLAGS.items() if bits >> i & 1]
        return {"version": ".".join(str(x) for x in reversed(head[32:36])), "flags": flags, "readable": not bits & 0x112 and head[35] == 5}

    found = _guarded(files, read, "content", "head", kind, "struct<version: string, flags: array<string>, readable: boolean>")
    return found.select(*[c for c in files.columns if c != "content"], "head.*", "error")


# Bits of the file header.
FLAGS = {0: "compressed", 1: "encrypted", 2: "distribution", 3: "script", 4: "drm", 5: "xml_template", 6: "history", 7: "signed", 8: "certificate_encrypted", 9: "signature_spare", 10: "certificate_drm", 11: "ccl"}


def previews(df: DataFrame, column: str) -> Column:
    """The text of a preview stream: UTF-16 with or without its mark, or UTF-8; no body is parsed."""
    raw = F.col(column)
    marked = F.hex(F.substring(raw, 1, 2)) == "FFFE"
    wide = (F.octet_length(raw) % 2 == 0) & (marked | (F.hex(F.substring(raw, 2, 1)) == "00") | F.try_validate_utf8(F.decode(raw, "ISO-8859-1")).isNull())
    return F.when(marked, F.decode(F.substring(raw, 3, 1 << 30), "UTF-16LE")).when(wide, F.decode(raw, "UTF-16LE")).otherwise(F.decode(raw, "UTF-8"))


def packages_of(cells: DataFrame) -> DataFrame:
    """table_id, content: each table's cells as a package with one table."""
    names = {"row": "row_idx", "col": "col_idx", "row_span": "row_span", "col_span": "col_span", "text": "text"}
    per = cells.groupBy("table_id").agg(F.collect_list(F.struct(*(F.col(c).alias(k) for k, c in names.items()))).alias("cells"))
    return map_column(per, lambda rows: pa.array([packages.write_tables([cells]) for cells in rows], pa.binary()), "cells", "content", "binary").drop("cells")


def package_cells(files: DataFrame) -> DataFrame:
    """Cells of the tables of packages: table (its place in the package), row_idx, col_idx, spans, size and text; what can't be read has an error."""
    kind = pa.list_(pa.struct([("table", pa.int32()), ("row", pa.int64()), ("col", pa.int64()), ("row_span", pa.int32()), ("col_span", pa.int32()), ("width", pa.int64()), ("height", pa.int64()), ("text", pa.string())]))
    read = lambda data: [c | {"table": i} for i, t in enumerate(packages.read_tables(data)) for c in t]
    found = _guarded(files, read, "content", "cells", kind, "array<struct<table: int, row: bigint, col: bigint, row_span: int, col_span: int, width: bigint, height: bigint, text: string>>")
    keys = [c for c in files.columns if c != "content"]
    return found.select(*keys, "error", F.explode_outer("cells").alias("c")).select(*keys, "error", "c.*").withColumnsRenamed({"row": "row_idx", "col": "col_idx"})


def structures(files: DataFrame) -> DataFrame:
    """Counts of each section of packages, without their text."""
    kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("paragraphs", "tables", "pictures", "chars")]))
    found = _guarded(files, packages.structure, "content", "sections", kind, "array<struct<paragraphs: bigint, tables: bigint, pictures: bigint, chars: bigint>>")
    keys = [c for c in files.columns if c != "content"]
    return found.select(*keys, "error", F.posexplode_outer("sections").alias("section", "s")).select(*keys, "error", "section", "s.*")


def limited(files: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Whether each package keeps the limits, before anything is inflated."""

    def read(data: bytes) -> bool:
        packages.check(data, packages.LIMITS | limits)
        return True

    found = _guarded(files, read, "content", "kept", pa.bool_(), "boolean")
    return found.withColumn("kept", F.coalesce("kept", F.lit(False)))


def replaced(files: DataFrame, old: str, new: str) -> DataFrame:
    """Packages with a text replaced in their sections, other entries as they are packed; broken ones have an error."""
    return _guarded(files, lambda data: packages.replace_in_package(data, old, new), "content", "content_", pa.binary(), "binary").withColumnRenamed("content_", "content")


def canonical_drawings(df: DataFrame, column: str) -> DataFrame:
    """df with svg, the canonical form of the drawing in a text column, or error."""
    raw = df.withColumn("_raw", F.encode(F.col(column), "UTF-8"))
    return _guarded(raw, lambda data: drawing.canonical_svg(data.decode()), "_raw", "svg", pa.string(), "string")


def gradients(df: DataFrame, column: str) -> DataFrame:
    """df with gradient in place of a binary column: what its block says, null where it says nothing."""
    stop = pa.struct([("at", pa.float64()), ("color", pa.int64())])
    kind = pa.struct([("radial", pa.bool_()), ("angle", pa.float64()), ("center_x", pa.int64()), ("center_y", pa.int64()), ("step", pa.int64()), ("stops", pa.list_(stop))])
    read = lambda rows: pa.array([(drawing.read_gradient(x or b"") or (None, 0))[0] for x in rows], kind)
    return map_column(df, read, column, "gradient", "struct<radial: boolean, angle: double, center_x: bigint, center_y: bigint, step: bigint, stops: array<struct<at: double, color: bigint>>>").drop(column)
