"""Hashes, reports and checks over issues, findings and artifacts of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: what a canonical hash of issues begins with.
ISSUE_DOMAIN = "hwp-render-typed-issues-v1\0"
# Severities of a report.
SEVERITIES = ["info", "warning", "incomplete", "fatal"]


def le64(n: Column) -> Column:
    """Eight bytes of a whole number, the lowest first."""
    digits = F.lpad(F.hex(n.cast("long")), 16, "0")
    return F.unhex(F.concat(*(F.substring(digits, 15 - 2 * i, 2) for i in range(8))))


def framed(text: Column) -> Column:
    """The UTF-8 bytes of a text behind their number."""
    raw = F.encode(text, "UTF-8")
    return F.concat(le64(F.octet_length(raw)), raw)


def issue_hash(issues: DataFrame, part: str) -> DataFrame:
    """One digest for each part of its issues (code, severity, stage, count, complete, samples), in order of code, severity and stage.

    Every field is framed by its length, so that no two lists have the same bytes.
    """
    samples = F.aggregate("samples", F.unhex(F.lit("")), lambda out, x: F.concat(out, framed(x)))
    one = F.concat(framed(F.col("code")), framed(F.col("severity")), framed(F.col("stage")), le64(F.col("count")), F.unhex(F.when(F.col("complete"), "01").otherwise("00")), le64(F.size("samples")), samples)
    listed = F.array_sort(F.collect_list(F.struct("code", "severity", "stage", one.alias("b"))))
    whole = F.aggregate(listed, F.encode(F.lit(ISSUE_DOMAIN), "UTF-8"), lambda out, x: F.concat(out, x["b"]))
    return issues.groupBy(part).agg(F.count("*").alias("issues"), F.sha2(whole, 256).alias("digest"))


def document_digest(paras: DataFrame, columns: list[str]) -> DataFrame:
    """One digest a document over its rows in order, each as canonical JSON: the named columns in their order, nulls left out, no blanks."""
    line = F.to_json(F.struct(*columns))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("para_idx", line.alias("j")))), lambda x: x["j"])
    return paras.groupBy("doc_id").agg(F.sha2(F.concat(F.lit("["), F.array_join(listed, ","), F.lit("]")), 256).alias("digest"))


def bounded_findings(findings: DataFrame, page: str, order: list[str], limit: int = 1024) -> DataFrame:
    """The first findings of each page, up to the limit, with how many there are in all and whether all are there."""
    over = Window.partitionBy(page)
    ranked = findings.withColumn("total", F.count("*").over(over)).withColumn("_k", F.row_number().over(over.orderBy(*order)))
    return ranked.where(F.col("_k") <= limit).withColumn("complete", F.col("total") <= limit).drop("_k")


def normalized_issues(reports: DataFrame, key: str, column: str) -> DataFrame:
    """Issues of JSON reports as counts alone: codes in safe letters, known severities (others are warnings), no negative counts; paths and details never pass."""
    parsed = F.try_parse_json(column)
    issues = F.coalesce(F.try_variant_get(parsed, "$.render.issues", "array<variant>"), F.try_variant_get(parsed, "$.issues", "array<variant>"))
    each = reports.select(key, F.explode(issues).alias("i"))
    get = lambda path, kind: F.try_variant_get("i", path, kind)
    severity = F.lower(F.coalesce(get("$.severity", "string"), F.lit("warning")))
    is_text = F.schema_of_variant(F.try_variant_get("i", "$.code", "variant")) == "STRING"
    rows = each.where(is_text).select(key, F.regexp_replace(F.lower(get("$.code", "string")), "[^a-z0-9_.-]", "_").alias("code"), F.when(severity.isin(SEVERITIES), severity).otherwise("warning").alias("severity"), F.coalesce(get("$.count", "long"), F.lit(1)).alias("count"))
    return rows.where("count >= 0").groupBy(key, "code", "severity").agg(F.sum("count").alias("count"))


def font_rows(lines: DataFrame, key: str, column: str) -> DataFrame:
    """Rows of a font listing: name, type, encoding, three yes or no columns and an object number; lines of another form are no rows."""
    pattern = r"^(\S.*?)[ ]{2,}(\S.*?)[ ]{2,}(\S+)[ ]+(yes|no)[ ]+(yes|no)[ ]+(yes|no)[ ]+([0-9]+)[ ]+([0-9]+)[ ]*$"
    part = lambda i: F.regexp_extract(column, pattern, i)
    flag = lambda i: part(i) == "yes"
    return lines.where(F.col(column).rlike(pattern)).select(key, part(1).alias("name"), part(2).alias("type"), flag(4).alias("embedded"), flag(5).alias("subset"), flag(6).alias("unicode"))


def case_scores(pages: DataFrame, fonts: DataFrame, case: str) -> DataFrame:
    """Whether a case counts: pages (side ours or oracle, page, text) and fonts (side, embedded, subset, unicode, substituted) of both sides.

    Reasons in fixed order: page_count_delta, font_substitution, pdf_font_contract. Texts are compared page by page, as far as both sides have pages.
    """
    side = lambda s: F.count_if(F.col("side") == s)
    both = pages.groupBy(case, "page").agg(F.max(F.when(F.col("side") == "ours", F.col("text"))).alias("a"), F.max(F.when(F.col("side") == "oracle", F.col("text"))).alias("b"), side("ours").alias("x"), side("oracle").alias("y"))
    met = (F.col("x") > 0) & (F.col("y") > 0)
    text = both.groupBy(case).agg(
        F.sum("x").alias("ours"), F.sum("y").alias("oracle"), F.count_if(met).alias("compared"), F.count_if(met & F.col("a").eqNullSafe(F.col("b"))).alias("equal"),
        F.min(F.when(met & ~F.col("a").eqNullSafe(F.col("b")), F.col("page"))).alias("first_diff"),
    )
    good = fonts.groupBy(case).agg(F.bool_and(F.col("embedded") & F.col("subset") & F.col("unicode")).alias("contract"), F.bool_or("substituted").alias("substituted"))
    out = text.join(good, case, "left")
    reasons = F.array(F.when(F.col("ours") != F.col("oracle"), "page_count_delta"), F.when(F.coalesce("substituted", F.lit(False)), "font_substitution"), F.when(~F.coalesce("contract", F.lit(True)), "pdf_font_contract"))
    return out.select(case, "ours", "oracle", "compared", "equal", "first_diff", F.array_compact(reasons).alias("reasons")).withColumn("scored", F.size("reasons") == 0)


def preservation_budget(events: DataFrame, part: str, limits: dict[str, int]) -> DataFrame:
    """passed or failed for each part: counts of each disposition against its limit; one without a limit may be any number."""
    over = F.array_compact(F.array(*(F.when(F.sum(F.when(F.col("disposition") == k, F.col("count")).otherwise(0)) > v, F.lit(k)) for k, v in limits.items())))
    return events.groupBy(part).agg(over.alias("over")).select(part, F.when(F.size("over") == 0, "passed").otherwise("failed").alias("status"), "over")


def receipts(rows: DataFrame, artifacts: DataFrame, key: str, days: int) -> DataFrame:
    """status of each artifact (key, sha256, checked on): attested by a receipt (key, sha256, opened, day) of the same bytes that opened and is not older than `days`; else stale, failed, mismatch or missing."""
    met = artifacts.join(rows.withColumnRenamed("sha256", "_sha"), key, "left")
    rank = F.when(F.col("_sha").isNull(), 0).when(F.col("_sha") != F.col("sha256"), 1).when(~F.col("opened"), 2).when(F.date_diff("checked", "day") > days, 3).otherwise(4)
    best = met.groupBy(key).agg(F.max(rank).alias("r"))
    return best.select(key, F.element_at(F.array(*map(F.lit, ("missing", "mismatch", "failed", "stale", "attested"))), F.col("r") + 1).alias("status"))


def verified(expected: DataFrame, reread: DataFrame) -> DataFrame:
    """Rows that one side has more often than the other, with `extra` above 0 for expected ones; empty if what was written reads back the same."""
    signed = expected.withColumn("_d", F.lit(1)).unionByName(reread.withColumn("_d", F.lit(-1)))
    return signed.groupBy(*expected.columns).agg(F.sum("_d").alias("extra")).where("extra <> 0")


def verify(expected: DataFrame, reread: DataFrame) -> None:
    """Raise if what was written does not read back the same."""
    if found := verified(expected, reread).limit(3).collect():
        raise ValueError(f"written rows differ: {found}")


def requests(lines: DataFrame, column: str, tools: list[str], longest: int = 1 << 20) -> DataFrame:
    """Request lines as rows: id, method, tool and the error code of what can't be served; works on streams as well.

    -32700 no JSON or too long, -32600 no request, -32601 unknown method, -32602 unknown tool; null code: to be served.
    """
    text = F.col(column)
    parsed = F.try_parse_json(column)
    get = lambda path: F.try_variant_get(parsed, path, "string")
    method, tool = get("$.method"), get("$.params.name")
    code = (
        F.when((F.octet_length(text) > longest) | parsed.isNull(), -32700).when(~F.coalesce(get("$.jsonrpc") == "2.0", F.lit(False)) | method.isNull(), -32600)
        .when(~method.isin("initialize", "ping", "tools/list", "tools/call", "notifications/initialized"), -32601).when((method == "tools/call") & ~F.coalesce(tool.isin(tools), F.lit(False)), -32602)
    )
    return lines.withColumns({"id": get("$.id"), "method": method, "tool": F.when(method == "tools/call", tool), "code": code})


def render_report(issues: DataFrame, pages: DataFrame, part: str) -> DataFrame:
    """One JSON report a part: status, pages, counts of issues by severity, and the issues in order of code."""
    listed = F.array_sort(F.collect_list(F.struct("code", "severity", "count")))
    total = lambda s: F.coalesce(F.sum(F.when(F.col("severity") == s, F.col("count"))), F.lit(0)).alias(s)
    per = issues.groupBy(part).agg(listed.alias("issues"), *(total(s) for s in SEVERITIES))
    status = F.when(F.coalesce("fatal", F.lit(0)) > 0, "failed").when(F.coalesce("incomplete", F.lit(0)) > 0, "incomplete").when(F.coalesce("warning", F.lit(0)) > 0, "warnings").otherwise("ok")
    counted = pages.groupBy(part).agg(F.count("*").alias("pages")).join(per, part, "left")
    empty = F.array().cast(issues_type)
    return counted.select(part, status.alias("status"), F.to_json(F.struct(status.alias("status"), "pages", F.coalesce("issues", empty).alias("issues"))).alias("report"))


issues_type = "array<struct<code: string, severity: string, count: bigint>>"
