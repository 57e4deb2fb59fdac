"""Typed templates, contracts in JSON, and ordered edits."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import text as edits

#: JSON types of a variable's declared type; nothing is coerced.
TYPES = {"string": ("STRING",), "number": ("BIGINT", "DOUBLE", "DECIMAL"), "bool": ("BOOLEAN",), "date": ("STRING",), "enum": ("STRING",), "list": ("ARRAY",)}


def unknown_fields(json: Column, allowed: list[str]) -> Column:
    """Keys of a JSON object that a closed contract does not know, sorted."""
    return F.array_sort(F.array_except(F.coalesce(F.json_object_keys(json), F.array().cast("array<string>")), F.array(*map(F.lit, allowed))))


def json_type(json: Column, path: str) -> Column:
    """Type of the value at a path of a JSON text, null where there is none."""
    value = F.try_parse_json(json)
    return F.regexp_extract(F.schema_of_variant(F.try_variant_get(value, path, "variant")), "^[A-Z]+", 0)


def validate(values: DataFrame, variables: list[dict]) -> DataFrame:
    """Issues of each row's JSON `data` against variables (name, type, required, default, min, max, pattern, min_length, max_length, values): key, name, code."""
    checks = []
    for v in variables:
        path, name = f"$.{v['name']}", v["name"]
        parsed = F.try_parse_json("data")
        kind = F.regexp_extract(F.schema_of_variant(F.try_variant_get(parsed, path, "variant")), "^[A-Z]+", 0)
        absent = F.try_variant_get(parsed, path, "variant").isNull() | (kind == "VOID")
        code = F.when(absent, F.lit("required_missing") if v.get("required") and "default" not in v else F.lit(None)).when(~kind.isin(*TYPES[v["type"]]), "type_mismatch")
        if v["type"] == "number":
            number = F.try_variant_get(parsed, path, "double")
            code = code.when(number < v["min"], "below_minimum") if "min" in v else code
            code = code.when(number > v["max"], "above_maximum") if "max" in v else code
        if v["type"] in ("string", "enum") and "pattern" in v:
            code = code.when(~F.try_variant_get(parsed, path, "string").rlike(v["pattern"]), "pattern_mismatch")
        if v["type"] in ("string", "enum"):
            size = F.length(F.try_variant_get(parsed, path, "string"))
            code = code.when(size < v["min_length"], "too_short") if "min_length" in v else code
            code = code.when(size > v["max_length"], "too_long") if "max_length" in v else code
            code = code.when(~F.try_variant_get(parsed, path, "string").isin(v["values"]), "not_a_value") if "values" in v else code
        checks.append(F.struct(F.lit(name).alias("name"), code.alias("code")))
    return values.select("key", F.explode(F.array(*checks)).alias("i")).select("key", "i.*").where("code is not null")


def with_default(data: Column, path: str, kind: str, default) -> Column:
    """The value at a path, or the default where the key is missing or null."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(data), path, kind), F.lit(default))


@dataclass(frozen=True)
class Node:
    """A template node: a text with ${field} slots; `when` names a boolean field; `each` repeats over the items."""

    text: str
    when: str | None = None
    negate: bool = False
    each: bool = False


def expand(scalars: DataFrame, items: DataFrame, nodes: list[Node], key: str, order: str, fields: list[str]) -> DataFrame:
    """key, ord, sub, text of each block: `each` nodes are joined with the key's items, `if` nodes filtered, slots filled.

    scalars has a row a key, items any number; both bring columns that the slots name. Items are joined once, whatever
    the number of nodes.
    """

    def filled(node: Node) -> Column:
        parts = re.split(r"(\$\{[^}]*\})", node.text)  # slots of the template alone: what a value holds is never one
        return F.concat(*(F.coalesce(F.col(x[2:-1]).cast("string"), F.lit("")) if x[:2] == "${" and x[2:-1] in fields else F.lit(x) for x in parts))

    def blocks(chosen: list[tuple[int, Node]]) -> Column:
        made = []
        for i, node in chosen:
            block = F.struct(F.lit(i).alias("ord"), filled(node).alias("text"))
            cond = F.coalesce(F.col(node.when), F.lit(False)) if node.when else F.lit(True)
            made.append(F.when(~cond if node.negate else cond, block))
        return F.array_compact(F.array(*made))

    single = [(i, n) for i, n in enumerate(nodes) if not n.each]
    repeated = [(i, n) for i, n in enumerate(nodes) if n.each]
    out = scalars.select(key, F.lit(0).cast("long").alias("sub"), F.explode(blocks(single)).alias("b")) if single else None
    if repeated:
        place = F.row_number().over(Window.partitionBy(key).orderBy(order)).cast("long")
        more = items.withColumn("sub", place).join(scalars, key).select(key, "sub", F.explode(blocks(repeated)).alias("b"))
        out = out.unionByName(more) if out is not None else more
    return out.select(key, "b.ord", "sub", "b.text")


def regions(expanded: DataFrame, key: str) -> DataFrame:
    """Blocks that each node gave, by key."""
    return expanded.groupBy(key, "ord").agg(F.count("*").alias("blocks"), F.sum(F.length("text")).alias("chars"))


#: Edits run in this order whatever order they are given in.
ORDER = ("replace", "replace_first", "fill", "insert_after", "delete")


def plan(operations: list[tuple[str, dict]]) -> list[tuple[str, dict]]:
    """Operations in their fixed order; those of one kind keep theirs. Unknown kinds raise."""
    unknown = [k for k, _ in operations if k not in ORDER]
    if unknown:
        raise ValueError(f"unknown edits {unknown}")
    return sorted(operations, key=lambda x: ORDER.index(x[0]))


def apply(paras: DataFrame, operations: list[tuple[str, dict]]) -> DataFrame:
    """Paragraphs after all operations, one plan that Spark runs at once."""
    own = ["doc_id", "para_idx", "text"]
    steps: dict[str, Callable[[DataFrame, dict], DataFrame]] = {
        "replace": lambda d, a: edits.replace_text(d, a["old"], a["new"]).select(own),
        "replace_first": lambda d, a: edits.replace_text(d, a["old"], a["new"], every=False).select(own),
        "fill": lambda d, a: edits.fill(d, a["values"]),
        "insert_after": lambda d, a: edits.insert_after_first(d, a["anchor"], a["text"]),
        "delete": lambda d, a: edits.delete_matching(d, a["pattern"]),
    }
    return reduce(lambda d, o: steps[o[0]](d, o[1]), plan(operations), paras)


def effects(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paragraph texts that went and came, counted a document: the multiset difference both ways."""
    signed = before.select("doc_id", "text", F.lit(-1).alias("d")).unionByName(after.select("doc_id", "text", F.lit(1).alias("d")))
    net = signed.groupBy("doc_id", F.xxhash64("text").alias("h")).agg(F.sum("d").alias("n"))
    return net.groupBy("doc_id").agg(F.sum(F.greatest(-F.col("n"), F.lit(0))).alias("gone"), F.sum(F.greatest("n", F.lit(0))).alias("new"))


# Keys of a document whose values a binding may give.
BINDING_TARGETS = [
    "text", "value", "title", "author", "subject", "keywords", "description", "script", "width_mm", "height_mm", "margin_left_mm", "margin_right_mm", "margin_top_mm", "margin_bottom_mm",
    "margin_header_mm", "margin_footer_mm", "gutter_mm", "font_size_pt", "bold", "italic", "underline", "strike", "color", "background", "spacing_before_pt", "spacing_after_pt",
    "line_height_percent", "keep_with_next", "start",
]
#: Nodes and bytes of an expansion, rounds of one, and items of a list.
LIMITS = {"nodes": 250_000, "bytes": 16 << 20, "iterations": 100_000, "items": 10_000}


def scalar_text(value: Column) -> Column:
    """The text of a JSON scalar, a VARIANT: strings as they are, numbers and booleans as written; null for other values."""
    kind = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
    return F.when(kind == "STRING", F.try_variant_get(value, "$", "string")).when(kind.isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "BOOLEAN"), F.to_json(value))


def splice(blocks: DataFrame, rich: DataFrame, key: str) -> DataFrame:
    """Blocks (key, ord, text, slot) where one whose slot names a value gives way to that value's blocks (key, slot, k, text), none of which may be there.

    Order is numbered anew; blocks without a slot stay.
    """
    held = rich.groupBy(key, "slot").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda x: x["text"]).alias("_rich"))
    met = blocks.join(held, [key, "slot"], "left")
    own = F.when(F.col("slot").isNull(), F.array("text")).otherwise(F.coalesce("_rich", F.array().cast("array<string>")))
    each = met.select(key, "ord", F.posexplode(own).alias("_k", "text"))
    return each.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("ord", "_k")) - 1).cast("long").alias("ord"), "text")


def budget_issues(expanded: DataFrame, items: DataFrame, key: str, limits: dict[str, int] = LIMITS) -> DataFrame:
    """key, code, used for each limit that an expansion (key, text) or its lists (key) break; nothing is cut, the expansion is refused."""
    nodes = expanded.groupBy(key).agg(F.count("*").alias("nodes"), F.sum(F.octet_length("text")).alias("bytes"))
    rounds = items.groupBy(key).agg(F.count("*").alias("items"))
    used = nodes.join(rounds, key, "full")
    broken = F.array_compact(F.array(*(F.when(F.coalesce(n, F.lit(0)) > limits[n], F.struct(F.lit(f"{n}_exceeded").alias("code"), F.col(n).alias("used"))) for n in ("nodes", "bytes", "items"))))
    return used.select(key, F.explode(broken).alias("i")).select(key, "i.*")


def binding_issues(nodes: DataFrame) -> DataFrame:
    """pointer and code of bindings (pointer, node, region) that are not safe: a value may stand only under a key of BINDING_TARGETS or as a block, if and each only
    as a block or a row, and no part of a pointer above may be bound."""
    parts = F.split("pointer", "/")
    last, before = F.element_at(parts, -1), F.try_element_at(parts, F.lit(-2))
    listed = last.rlike("^[0-9]+$")
    blocks = before.isin("blocks") | (before.isin("default", "first", "odd", "even") & F.try_element_at(parts, F.lit(-3)).isin("header", "footer"))
    rows = before == "rows"
    code = (
        F.when((F.col("node") == "value") & ~(last.isin(BINDING_TARGETS) | (listed & blocks)), "binding_target")
        .when(F.col("node").isin("if", "each") & ~(listed & (blocks | rows)), "control_context").when(~F.col("node").isin("value", "if", "each"), "unknown_node")
    )
    return nodes.select("pointer", code.alias("code")).where("code is not null")


def missing_values(paras: DataFrame, values: dict[str, str]) -> DataFrame:
    """doc_id, name of each {{name}} that no value fills, and of each value that no text names (doc_id null)."""
    named = paras.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\{\{\s*([^{}]+?)\s*\}\}"), 1)).alias("name")).distinct()
    given = paras.sparkSession.createDataFrame([(k,) for k in values], "name string")
    unfilled = named.join(F.broadcast(given), "name", "left_anti").select("doc_id", "name")
    unused = F.broadcast(given).join(named.select("name").distinct(), "name", "left_anti").select(F.lit(None).cast(paras.schema["doc_id"].dataType).alias("doc_id"), "name")
    return unfilled.unionByName(unused)


def fill_all(paras: DataFrame, values: dict[str, str], partial: bool = False) -> DataFrame:
    """Every {{name}} filled in one pass, so that a value is never filled again; a name without a value, or a value without a name, raises unless partial."""
    if not partial and (found := missing_values(paras, values).limit(3).collect()):
        raise ValueError(f"not filled: {found}")
    if not values:
        return paras
    names = "|".join(re.escape(k) for k in sorted(values, key=len, reverse=True))
    pattern = r"\{\{\s*(?:" + names + r")\s*\}\}"
    found = F.regexp_extract_all("text", F.lit(pattern), 0)
    table = F.create_map(*(F.lit(x) for kv in values.items() for x in kv))
    pieces = F.split("text", pattern, -1)
    put = lambda slot: table[F.trim(F.substring(slot, F.lit(3), F.length(slot) - 4))]
    joined = F.array_join(F.zip_with(pieces, F.transform(found, put), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return paras.withColumn("text", F.when(F.size(found) > 0, joined).otherwise(F.col("text")))


def grid_issues(rows: DataFrame, table: str, cells: str, most: int) -> DataFrame:
    """Codes of tables whose rows (table, number of cells) differ in length or are too many."""
    per = rows.groupBy(table).agg(F.max(cells).alias("w"), F.min(cells).alias("n"), F.count("*").alias("rows"))
    codes = F.array_compact(F.array(F.when(F.col("w") != F.col("n"), "ragged_rows"), F.when(F.col("rows") > most, "too_many_rows")))
    return per.select(table, F.explode(codes).alias("code"))


def certify(facts: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """Number of rules, of those that failed, and the status of each row of facts; a rule without a verdict has failed."""
    rule = lambda name, ok: F.struct(F.lit(name).alias("id"), F.when(F.coalesce(ok, F.lit(False)), "passed").otherwise("failed").alias("status"))
    out = facts.withColumn("rules", F.array(*(rule(*x) for x in rules.items())))
    failed = F.size(F.filter("rules", lambda r: r["status"] == "failed")).cast("long")
    return out.select(key, F.size("rules").cast("long").alias("rules"), failed.alias("failed"), F.when(failed > 0, "failed").otherwise("passed").alias("status"))
