"""Small contracts: names, selections, edit specifications, namespaces, style rules, evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stem(path: Column) -> Column:
    """File name without folder and last ending."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"\.[^.]*$", "")


def collisions(paths: DataFrame, path: str) -> DataFrame:
    return paths.groupBy(stem(F.col(path)).alias("stem")).agg(F.count("*").alias("n")).where("n > 1")


def section_index(name: Column) -> Column:
    """Number of a section entry, null for other names."""
    return F.regexp_extract(name, r"^Contents/section([0-9]+)\.xml$", 1).try_cast("int")


def page_selection(spec: Column, total: Column) -> Column:
    """Pages of "all", "n" or "a-b" (b cut to the total), from 1; null where the selection is out of range."""
    low, high = F.regexp_extract(spec, r"^([0-9]+)", 1).try_cast("int"), F.regexp_extract(spec, r"-([0-9]+)$", 1).try_cast("int")
    last = F.least(F.coalesce(high, low), total)
    return F.when(spec == "all", F.sequence(F.lit(1), total)).when((low >= 1) & (low <= total) & (last >= low), F.sequence(low, last))


def namespaces(roots: DataFrame, part: str, order: str, xml: str) -> DataFrame:
    """Namespace declarations of root elements; of one prefix the first counts."""
    each = roots.select(part, order, F.posexplode(F.regexp_extract_all(xml, F.lit(r'xmlns:([A-Za-z][\w.-]*)="([^"]*)"'), 0)).alias("k", "d"))
    each = each.withColumn("prefix", F.regexp_extract("d", r"xmlns:([^=]+)=", 1)).withColumn("uri", F.regexp_extract("d", r'"([^"]*)"', 1))
    return each.groupBy(part, "prefix").agg(F.min_by("uri", F.struct(order, "k")).alias("uri"))


def style_rules(css: DataFrame, part: str, text: str) -> DataFrame:
    """Rules of the classes .csN and .psN; of one class the last counts."""
    rule = r"\.((?:cs|ps)[0-9]+)\s*\{([^}]*)\}"
    each = css.select(part, F.posexplode(F.regexp_extract_all(text, F.lit(rule), 0)).alias("k", "r"))
    return each.withColumn("name", F.regexp_extract("r", rule, 1)).groupBy(part, "name").agg(F.max_by(F.trim(F.regexp_extract("r", rule, 2)), "k").alias("body"))


def external_reference(targets: Column, complete: Column) -> Column:
    """Whether any target leaves the package; null where none does and the listing is not complete."""
    leaves = F.exists(targets, lambda t: t.rlike("(?i)^(https?|ftp|file|mailto):"))
    return F.when(leaves, True).when(complete, False)


def parse_replace(spec: Column) -> Column:
    at = F.instr(spec, "=>")
    return F.when(at > 0, F.struct(F.substring(spec, F.lit(1), at - 1).alias("old"), F.substring(spec, at + 2, F.length(spec)).alias("new")))


def parse_cell(spec: Column) -> Column:
    """table:row:column=text."""
    pattern = r"^([0-9]+):([0-9]+):([0-9]+)=([\s\S]*)$"
    part = lambda i: F.regexp_extract(spec, pattern, i)
    return F.when(spec.rlike(pattern), F.struct(part(1).cast("int").alias("table_id"), part(2).cast("int").alias("row_idx"), part(3).cast("int").alias("col_idx"), part(4).alias("text")))


def apply_meta(value: Column, key: str, spec: Column) -> Column:
    """A field after "key=value"; an empty value clears it, other keys leave it."""
    return F.when(F.substring_index(spec, "=", 1) == key, F.nullif(F.regexp_replace(spec, "^[^=]*=", ""), F.lit(""))).otherwise(value)


def font_rule(fonts: DataFrame, part: str, allowed: list[str]) -> DataFrame:
    """Sorted reasons of a document's fonts (name, substituted, missing)."""
    bad = ~F.col("name").isin(allowed)
    reasons = F.array(F.when(F.bool_or(bad), "font_not_allowed"), F.when(F.bool_or("substituted"), "font_substituted"), F.when(F.bool_or("missing"), "font_missing"))
    return fonts.groupBy(part).agg(F.array_sort(F.array_compact(reasons)).alias("reasons"))


def two_runs(runs: DataFrame, case: str, digest: str) -> DataFrame:
    """Whether the runs of each case gave one digest."""
    return runs.groupBy(case).agg(F.count("*").alias("runs"), (F.count_distinct(digest) == 1).alias("deterministic"))


def parse_char_format(spec: Column) -> Column:
    """find:prop=value,..: what is looked for, and a map of the properties; the last colon before a property parts them."""
    pattern = r"^([\s\S]+):([a-z_]+=[^=,]*(?:,[a-z_]+=[^=,]*)*)$"
    return F.when(spec.rlike(pattern), F.struct(F.regexp_extract(spec, pattern, 1).alias("find"), F.str_to_map(F.regexp_extract(spec, pattern, 2), F.lit(","), F.lit("=")).alias("props")))


def parse_image_size(spec: Column) -> Column:
    """path@WxH in mm; a tail that is no size belongs to the path."""
    number = r"[ ]*([0-9]+(?:\.[0-9]+)?)[ ]*"
    pattern = f"^([\\s\\S]*)@{number}[xX]{number}$"
    part = lambda i: F.regexp_extract(spec, pattern, i)
    sized = spec.rlike(pattern)
    return F.struct(F.when(sized, part(1)).otherwise(spec).alias("path"), F.when(sized, part(2)).cast("double").alias("width"), F.when(sized, part(3)).cast("double").alias("height"))


def parse_clone_table(spec: Column) -> Column:
    """table=>anchor[=>blank|keep]; null for other texts."""
    parts = F.split(spec, "=>", 3)
    at = lambda i: F.trim(F.coalesce(F.get(parts, F.lit(i)), F.lit("")))
    mode = F.when(at(2) == "", "blank").otherwise(at(2))
    good = at(0).rlike("^[0-9]+$") & (at(1) != "") & mode.isin("blank", "keep")
    return F.when(good, F.struct(at(0).cast("int").alias("table_id"), at(1).alias("anchor"), mode.alias("mode")))


def delete_objects(objects: DataFrame, chosen: DataFrame, keys: list[str]) -> DataFrame:
    """objects without the chosen ones."""
    return objects.join(chosen.select(*keys).distinct(), keys, "left_anti").select(objects.columns)


def document_info(docs: DataFrame, part: str, kind: str, size: str, name: str) -> DataFrame:
    """Documents, kinds, the largest size and its document, ties by the smallest name, of each part."""
    longest = F.max_by(name, F.struct(size, -F.col(name)))
    return docs.groupBy(part).agg(F.count("*").alias("documents"), F.array_sort(F.collect_set(kind)).alias(f"{kind}s"), F.max(size).alias("longest"), longest.alias("longest_id"))
