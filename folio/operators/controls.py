"""Controls of paragraphs: fields, links and bookmarks as ranges of the text that they show.

controls: doc_id, para_idx, ctrl_idx, ctrl_id, name, command, start, end (code points; a point has start = end). Ranges of one
paragraph do not overlap. Joins are by document and paragraph, so that a document's rows meet once.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Field controls with the type and the label that they have in files; others of the list are "UNKNOWN", "필드".
FIELD_KINDS = {
    "%clk": ("CLICK_HERE", "누름틀"), "%fmu": ("FORMULA", "계산식"), "%hlk": ("HYPERLINK", "하이퍼링크"), "%mmg": ("MAIL_MERGE", "메일머지"),
    "%dte": ("DATE", "날짜"), "%ddt": ("DOCUMENT_DATE", "문서날짜"), "%xrf": ("CROSS_REF", "상호참조"), "%bmk": ("BOOKMARK", "책갈피"),
    "%pat": ("PATH", "파일경로"), "%smr": ("SUMMARY", "문서요약"), "%usr": ("USER_INFO", "사용자정보"), "%toc": ("TABLEOFCONTENTS", "차례"),
    "%cpr": ("UNKNOWN", "개인정보보호"), "%unk": ("UNKNOWN", "알수없음"),
}
REVISIONS = [
    "%sig", "%spl", "%%mr", "%%*d", "%%*a", "%%*C", "%%*S", "%%*T", "%%*P", "%%*L", "%%*c", "%%*h", "%%*A", "%%*i", "%%*t", "%%*r", "%%*l", "%%*n", "%%*e",
]
FIELD_IDS = [*FIELD_KINDS, *REVISIONS]
#: Names of types that files also use.
OTHER_TYPES = {"CROSS_REFERENCE": "%xrf", "FILE_PATH": "%pat"}
BOOKMARK = "bokm"
#: Containers that plain text leaves out unless asked: codes of headers and footers, and of hidden comments.
HEADER_FOOTER, HIDDEN = 16, 15
KEYS = ["doc_id", "para_idx"]


def _lookup(table: dict[str, str], key: Column, other: str) -> Column:
    return F.coalesce(F.create_map(*map(F.lit, chain(*table.items())))[key], F.lit(other))


def is_field(ctrl_id: Column) -> Column:
    return ctrl_id.isin(FIELD_IDS)


def field_type(ctrl_id: Column) -> Column:
    return _lookup({k: t for k, (t, _) in FIELD_KINDS.items()}, ctrl_id, "UNKNOWN")


def field_label(ctrl_id: Column) -> Column:
    return _lookup({k: n for k, (_, n) in FIELD_KINDS.items()}, ctrl_id, "필드")


def field_id(kind: Column) -> Column:
    """The control of a type in a file; unknown types have one of their own."""
    return _lookup({t: k for k, (t, _) in FIELD_KINDS.items() if t != "UNKNOWN"} | OTHER_TYPES, kind, "%unk")


def field_kinds(spark: SparkSession) -> DataFrame:
    """The dimension: ctrl_id, type, label of every field control."""
    ids = spark.createDataFrame([(x,) for x in FIELD_IDS], "ctrl_id string")
    return ids.select("ctrl_id", field_type(F.col("ctrl_id")).alias("type"), field_label(F.col("ctrl_id")).alias("label"))


def list_fields(paras: DataFrame, controls: DataFrame) -> DataFrame:
    """Every field with its label, name, command and the text that it shows, in document order by para_idx and start."""
    fields = controls.where(is_field(F.col("ctrl_id")))
    value = F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start"))
    return fields.join(paras, KEYS).select(*KEYS, "ctrl_idx", field_label(F.col("ctrl_id")).alias("kind"), "ctrl_id", "name", "command", value.alias("value"))


def list_bookmarks(controls: DataFrame) -> DataFrame:
    return controls.where(F.col("ctrl_id") == BOOKMARK).select(*KEYS, "ctrl_idx", F.coalesce("name", F.lit("")).alias("name"))


def set_field(paras: DataFrame, controls: DataFrame, name: str, value: str) -> tuple[DataFrame, DataFrame]:
    """paras (text, filled) and controls after every field of a name shows a value: a paragraph's fields are spliced in one fold, later ranges move."""
    mine = is_field(F.col("ctrl_id")) & F.coalesce(F.col("name") == name, F.lit(False))
    grown = F.when(mine, len(value) - (F.col("end") - F.col("start"))).otherwise(0)
    before = F.coalesce(F.sum(grown).over(Window.partitionBy(*KEYS).orderBy("start", "end", "ctrl_idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    moved = controls.withColumn("_m", before).withColumn("_g", grown)
    moved = moved.withColumn("start", F.col("start") + F.col("_m")).withColumn("end", F.col("end") + F.col("_m") + F.col("_g")).select(controls.columns)
    spans = controls.where(mine).groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_s"))
    begun = F.struct(F.lit("").alias("out"), F.lit(0).cast(controls.schema["end"].dataType).alias("at"))
    fold = F.aggregate(
        "_s", begun,
        lambda s, x: F.struct(F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, x["start"] - s["at"]), F.lit(value)).alias("out"), x["end"].alias("at")),
        lambda s: F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, F.length("text"))),
    )
    done = paras.join(spans, KEYS, "left")
    return done.select(*KEYS, F.when(F.col("_s").isNotNull(), fold).otherwise(F.col("text")).alias("text"), F.greatest(F.coalesce(F.size("_s"), F.lit(0)), F.lit(0)).alias("filled")), moved


def _insert(paras: DataFrame, controls: DataFrame, anchor: str, shown: str, ctrl_id: str, name: str | None, command: str | None) -> tuple[DataFrame, DataFrame]:
    """A control behind the first match of the anchor in each document; documents without one stay as they are."""
    at = F.instr("text", anchor)
    first = paras.where(at > 0).groupBy("doc_id").agg(F.min(F.struct("para_idx", (at - 1 + len(anchor)).alias("at"))).alias("_x")).select("doc_id", "_x.para_idx", F.col("_x.at").alias("_at"))
    joined = paras.join(first, KEYS, "left")
    text = F.when(F.col("_at").isNotNull(), F.concat(F.substring(F.col("text"), F.lit(1), F.col("_at")), F.lit(shown), F.substring(F.col("text"), F.col("_at") + 1, F.length("text")))).otherwise(F.col("text"))
    met = controls.join(first, KEYS, "left")
    behind = F.coalesce(F.col("start") >= F.col("_at"), F.lit(False))
    around = F.coalesce((F.col("start") < F.col("_at")) & (F.col("end") >= F.col("_at")) & (F.col("end") > F.col("start")), F.lit(False))
    grow = F.lit(len(shown))
    moved = met.withColumn("end", F.col("end") + F.when(behind | (around & (F.col("end") > F.col("_at"))), grow).otherwise(0)).withColumn("start", F.col("start") + F.when(behind, grow).otherwise(0)).drop("_at")
    index = F.coalesce(F.col("_n"), F.lit(0)).cast(controls.schema["ctrl_idx"].dataType)
    last = controls.groupBy(*KEYS).agg((F.max("ctrl_idx") + 1).alias("_n"))
    new = first.join(last, KEYS, "left").select(
        *KEYS, index.alias("ctrl_idx"), F.lit(ctrl_id).alias("ctrl_id"), F.lit(name).cast("string").alias("name"), F.lit(command).cast("string").alias("command"),
        F.col("_at").cast(controls.schema["start"].dataType).alias("start"), (F.col("_at") + len(shown)).cast(controls.schema["end"].dataType).alias("end"),
    )
    return joined.select(*KEYS, text.alias("text")), moved.select(controls.columns).unionByName(new.select(controls.columns))


def create_field(paras: DataFrame, controls: DataFrame, anchor: str, name: str, value: str = "") -> tuple[DataFrame, DataFrame]:
    return _insert(paras, controls, anchor, value, "%clk", name, None)


def link_command(url: str) -> str:
    """The command of a link: backslashes, semicolons and colons escaped."""
    return "".join(f"\\{c}" if c in "\\;:" else c for c in url) + ";1;0;0;"


def create_hyperlink(paras: DataFrame, controls: DataFrame, anchor: str, url: str, shown: str) -> tuple[DataFrame, DataFrame]:
    return _insert(paras, controls, anchor, shown, "%hlk", None, link_command(url))


def create_bookmark(paras: DataFrame, controls: DataFrame, anchor: str, name: str) -> tuple[DataFrame, DataFrame]:
    return _insert(paras, controls, anchor, "", BOOKMARK, name, None)


def text_options(paras: DataFrame, container: str, header_footer: bool = False, hidden: bool = False) -> DataFrame:
    """Paragraphs of the body, and of those containers that are asked for; container is null in the body."""
    out = [code for code, wanted in ((HEADER_FOOTER, header_footer), (HIDDEN, hidden)) if not wanted]
    return paras.where(F.col(container).isNull() | ~F.col(container).isin(out)) if out else paras


def notes(paras: DataFrame) -> DataFrame:
    """Each reference [^label] with the body of its definition, a line "[^label]: body" anywhere in the document; null where there is none.

    A label that is defined again keeps its first definition.
    """
    definition = r"^\[\^([^\]]+)\]:[ \t]*(.*)$"
    is_definition = F.col("text").rlike(definition)
    references = paras.where(~is_definition).select(*KEYS, F.posexplode(F.regexp_extract_all("text", F.lit(r"\[\^([^\]]+)\]"), 1)).alias("k", "label"))
    bodies = paras.where(is_definition).select("doc_id", "para_idx", F.regexp_extract("text", definition, 1).alias("label"), F.regexp_extract("text", definition, 2).alias("body"))
    first = bodies.groupBy("doc_id", "label").agg(F.min_by("body", "para_idx").alias("body"))
    return references.join(first, ["doc_id", "label"], "left").select(*KEYS, "k", "label", "body")


def insert_parts(paras: DataFrame, parts: DataFrame) -> DataFrame:
    """doc_id, para_idx, text, error: a paragraph that is "{{name}}" and nothing else gives way to the blocks of part `name` (name, ord, text).

    A part's name inside other text is refused: error "anchor_not_alone", the paragraph stays. Order is numbered anew.
    """
    anchor = F.regexp_extract(F.trim("text"), r"^\{\{([^{}]+)\}\}$", 1)
    names = parts.select(F.col("name").alias("_name")).distinct()
    held = parts.groupBy(F.col("name").alias("_name")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]).alias("_blocks"))
    inside = paras.select(*KEYS, F.explode(F.regexp_extract_all("text", F.lit(r"\{\{([^{}]+)\}\}"), 1)).alias("_name")).join(names, "_name", "left_semi").select(*KEYS).distinct().withColumn("_in", F.lit(True))
    met = paras.withColumn("_name", anchor).join(held, "_name", "left").join(inside, KEYS, "left")
    error = F.when(F.col("_blocks").isNull() & F.col("_in"), "anchor_not_alone")
    each = met.select("doc_id", "para_idx", error.alias("error"), F.posexplode(F.coalesce("_blocks", F.array("text"))).alias("_k", "text"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("para_idx", "_k")) - 1
    return each.select("doc_id", place.cast("long").alias("para_idx"), "text", "error")


def page_definitions(sections: DataFrame, width: int | None = None, height: int | None = None, margins: dict[str, int] | None = None, landscape: bool | None = None) -> DataFrame:
    """sections (width, height, margin_*, attr) with what is given set in all of them; the lowest bit of attr is the orientation."""
    given = {"width": width, "height": height} | {f"margin_{k}": v for k, v in (margins or {}).items()}
    out = sections.withColumns({k: F.lit(v).cast(sections.schema[k].dataType) for k, v in given.items() if v is not None})
    if landscape is None:
        return out
    attr = F.col("attr").bitwiseOR(F.lit(1)) if landscape else F.col("attr").bitwiseAND(F.lit(~1))
    return out.withColumn("attr", attr.cast(sections.schema["attr"].dataType))


def picture_size(pixels_wide: Column, pixels_high: Column, widest: int, mm_wide: Column | None = None, mm_high: Column | None = None) -> Column:
    """width and height in units of a picture: as given in mm, else of its pixels at 96 dpi, scaled down to the widest."""
    w, h = F.floor(pixels_wide * 7200 / 96).cast("long"), F.floor(pixels_high * 7200 / 96).cast("long")
    scaled = F.round(h * (F.lit(float(widest)) / w)).cast("long")
    natural = F.struct(F.when(w > widest, F.lit(widest).cast("long")).otherwise(w).alias("width"), F.when(w > widest, scaled).otherwise(h).alias("height"))
    if mm_wide is None or mm_high is None:
        return natural
    units = lambda mm: F.round(mm * 7200 / 25.4).cast("long")
    return F.when(mm_wide.isNotNull() & mm_high.isNotNull(), F.struct(units(mm_wide).alias("width"), units(mm_high).alias("height"))).otherwise(natural)
