"""Queries over issues, findings, reports and request lines; events stand in for issues, documents for pages and artifacts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence as op
from .registry import paras, query, table

_ISSUES = """issues as (select user_id, event_type as code, case when event_type = 'error' then 'fatal' when event_type = 'view' then 'info' else 'warning' end as severity, count(*) as count,
list_sort(list(distinct props))[1:4] as samples, count(distinct props) <= 4 as complete from events group by all)"""


def issues(spark, sf):
    kind = F.when(F.col("event_type") == "error", "fatal").when(F.col("event_type") == "view", "info").otherwise("warning")
    rows = table(spark, sf, "events").groupBy("user_id", F.col("event_type").alias("code"), kind.alias("severity"))
    held = rows.agg(F.count("*").alias("count"), F.slice(F.array_sort(F.collect_set("props")), 1, 4).alias("samples"), (F.count_distinct("props") <= 4).alias("complete"))
    return held.withColumn("stage", F.lit("layout"))


def _le(n: str) -> str:
    return "unhex(concat(" + ", ".join(f"substr(lpad(format('{{:x}}', {n}::bigint), 16, '0'), {15 - 2 * i}, 2)" for i in range(8)) + "))"


def _frame(t: str) -> str:
    return f"({_le(f'octet_length(encode({t}))')} || encode({t}))"


@query("issue_hash", f"""with {_ISSUES}, b as (select user_id, code, severity, hex({_frame('code')} || {_frame('severity')} || {_frame("'layout'")} || {_le('count')} || unhex(case when complete then '01' else '00' end) || {_le('len(samples)')}) || coalesce(list_aggregate(list_transform(samples, lambda x: hex({_frame('x')})), 'string_agg', ''), '') as h from issues)
select user_id, count(*) as issues, sha256(encode('hwp-render-typed-issues-v1') || unhex('00') || unhex(string_agg(h, '' order by code, severity))) as digest from b group by user_id""")  # fmt: skip
def issue_hash(spark, sf):
    return op.issue_hash(issues(spark, sf), "user_id")


@query("document_digest")
def document_digest(spark, sf):
    """Held by a test against a digest made line by line; JSON escapes differ between engines."""
    return op.document_digest(paras(spark, sf), ["para_idx", "text"])


@query("bounded_findings", "select user_id, event_id, total, total <= 20 as complete from (select user_id, event_id, count(*) over (partition by user_id) as total, row_number() over (partition by user_id order by event_id) as k from events) where k <= 20")
def bounded_findings(spark, sf):
    return op.bounded_findings(table(spark, sf, "events").select("user_id", "event_id"), "user_id", ["event_id"], 20)


@query("normalized_issues", """select event_id, regexp_replace(lower(concat(event_type, ' ', user_id, '/x')), '[^a-z0-9_.-]', '_', 'g') as code, case event_id % 3 when 0 then 'fatal' else 'warning' end as severity, cast(event_id % 5 as bigint) + 1 as count from events where event_id % 7 <> 0
union all select event_id, 'b' as code, 'info' as severity, 2 as count from events""")  # fmt: skip
def normalized_issues(spark, sf):
    """Reports with an odd code, an unknown severity, a negative count, a code that is no text, and two rows of one issue."""
    e = F.col("event_id")
    code = F.concat("event_type", F.lit(" "), "user_id", F.lit("/x"))
    severity = F.when(e % 3 == 0, "FATAL").when(e % 3 == 1, "strange")
    first = F.struct(code.alias("code"), severity.alias("severity"), F.when(e % 7 == 0, F.lit(-1).cast("long")).otherwise(e % 5 + 1).alias("count"), F.lit("/home/x").alias("path"))
    one = F.struct(F.lit("B").alias("code"), F.lit("info").alias("severity"), F.lit(1).cast("long").alias("count"), F.lit("/home/y").alias("path"))
    report = F.concat(F.lit('{"render": {"issues": [{"code": 5}, '), F.to_json(first), F.lit(", "), F.to_json(one), F.lit(", "), F.to_json(one), F.lit("]}}"))
    return op.normalized_issues(table(spark, sf, "events").select("event_id", report.alias("report")), "event_id", "report")


@query("font_rows", "select p_partkey, concat('ABCDEF+', p_name) as name, 'CID TrueType' as type, p_size % 2 = 0 as embedded, p_size % 3 = 0 as subset, true as unicode from part where p_size % 5 <> 0")
def font_rows(spark, sf):
    """A fifth of the lines are of another form."""
    yes = lambda c: F.when(c, "yes").otherwise("no")
    s = F.col("p_size")
    line = F.concat(F.lit("ABCDEF+"), "p_name", F.lit("   CID TrueType      Identity-H       "), yes(s % 2 == 0), F.lit(" "), yes(s % 3 == 0), F.lit(" yes     "), "p_partkey", F.lit("  0"))
    lines = table(spark, sf, "part").select("p_partkey", F.when(s % 5 == 0, F.concat(F.lit("name  "), "p_name")).otherwise(line).alias("line"))
    return op.font_rows(lines, "p_partkey", "line")


@query("case_scores", """with o as (select conv_id, turn, case when turn % 3 = 1 then concat(text, ' ') else text end as text, turn <> 2 as there from conversations), x as (select c.conv_id, count(*) as ours, count(*) filter (where there) as oracle,
count(*) filter (where there) as compared, count(*) filter (where there and c.text = o.text) as equal, min(c.turn) filter (where there and c.text <> o.text) as first_diff from conversations c join o on o.conv_id = c.conv_id and o.turn = c.turn group by 1)
select *, list_filter([case when ours <> oracle then 'page_count_delta' end, case when conv_id % 4 = 0 then 'font_substitution' end, case when conv_id % 5 = 0 then 'pdf_font_contract' end], lambda r: r is not null) as reasons, ours = oracle and conv_id % 4 <> 0 and conv_id % 5 <> 0 as scored from x""")  # fmt: skip
def case_scores(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("page"), "text")
    other = c.where("page <> 2").withColumn("text", F.when(F.col("page") % 3 == 1, F.concat("text", F.lit(" "))).otherwise(F.col("text")))
    pages = c.withColumn("side", F.lit("ours")).unionByName(other.withColumn("side", F.lit("oracle")))
    k = F.col("conv_id")
    fonts = c.select("conv_id").distinct().select("conv_id", F.lit("ours").alias("side"), F.lit(True).alias("embedded"), (k % 5 != 0).alias("subset"), F.lit(True).alias("unicode"), (k % 4 == 0).alias("substituted"))
    return op.case_scores(pages, fonts, "conv_id")


@query("preservation_budget", """with s as (select user_id, cast(sum(case when event_type = 'error' then 1 else 0 end) as bigint) as dropped, count(*) filter (where event_type = 'view') as changed from events group by 1)
select user_id, case when dropped > 2 or changed > 40 then 'failed' else 'passed' end as status, list_filter([case when dropped > 2 then 'dropped' end, case when changed > 40 then 'changed' end], lambda x: x is not null) as over from s""")  # fmt: skip
def preservation_budget(spark, sf):
    kind = F.when(F.col("event_type") == "error", "dropped").when(F.col("event_type") == "view", "changed").otherwise("kept")
    rows = table(spark, sf, "events").select("user_id", kind.alias("disposition"), F.lit(1).alias("count"))
    return op.preservation_budget(rows, "user_id", {"dropped": 2, "changed": 40})


@query("receipts", "select doc_id, case doc_id % 6 when 0 then 'missing' when 1 then 'mismatch' when 2 then 'failed' when 3 then 'stale' else 'attested' end as status from documents")
def receipts(spark, sf):
    """Artifacts without a receipt, with one of other bytes, of a failure, an old one, a good one, and a good one beside a bad one."""
    docs = table(spark, sf, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"), F.lit("2026-03-01").cast("date").alias("checked"))
    k = F.col("doc_id") % 6
    rows = docs.where(k != 0).select("doc_id", F.when(k == 1, "other").otherwise(F.col("sha256")).alias("sha256"), (k != 2).alias("opened"), F.when(k == 3, "2025-01-01").otherwise("2026-02-20").cast("date").alias("day"))
    bad = docs.where(k == 5).select("doc_id", F.lit("other").alias("sha256"), F.lit(False).alias("opened"), F.lit("2020-01-01").cast("date").alias("day"))
    return op.receipts(rows.unionByName(bad), docs, "doc_id", 30)


@query("verify_written", "select doc_id, para_idx, text, 1::bigint as extra from paras where doc_id % 10 = 3 and para_idx = 0 union all select doc_id, para_idx, concat(text, '!'), -1 from paras where doc_id % 10 = 3 and para_idx = 0", ("paras",))
def verify_written(spark, sf):
    """Paragraphs written as packages and read again; the first one of every tenth document is changed on the way."""
    from ..sources import frames

    clean = paras(spark, sf).withColumn("text", F.regexp_replace("text", "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]", ""))
    sent = clean.withColumn("text", F.when((F.col("doc_id") % 10 == 3) & (F.col("para_idx") == 0), F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    reread = frames.paragraphs(frames.read_files(frames.to_files(sent, "hwpx")), "doc_id")
    return op.verified(clean, reread)


@query("requests", """select event_id, case when event_id % 6 = 0 then null else cast(event_id as varchar) end as id, case event_id % 6 when 0 then null when 1 then null when 2 then 'rename' else 'tools/call' end as method,
case event_id % 6 when 3 then event_type when 4 then 'no_such' when 5 then null end as tool, case event_id % 6 when 0 then -32700 when 1 then -32600 when 2 then -32601 when 3 then null else -32602 end as code from events""")  # fmt: skip
def requests(spark, sf):
    e = F.col("event_id")
    body = (
        F.when(e % 6 == 1, F.lit("")).when(e % 6 == 2, F.lit(', "method": "rename"')).when(e % 6 == 3, F.concat(F.lit(', "method": "tools/call", "params": {"name": "'), "event_type", F.lit('"}')))
        .when(e % 6 == 4, F.lit(', "method": "tools/call", "params": {"name": "no_such"}')).otherwise(F.lit(', "method": "tools/call"'))
    )
    line = F.when(e % 6 == 0, F.lit('{"jsonrpc": "2.0", ')).otherwise(F.concat(F.lit('{"jsonrpc": "2.0", "id": '), e, body, F.lit("}")))
    lines = table(spark, sf, "events").select("event_id", line.alias("line"))
    return op.requests(lines, "line", ["view", "click", "purchase", "signup", "error"]).drop("line")


@query("render_report", f"""with {_ISSUES}, p as (select user_id, count(*) as pages, count(*) filter (where event_type = 'error') as fatal, count(*) filter (where event_type not in ('error', 'view')) as warning from events group by 1),
s as (select user_id, pages, case when fatal > 0 then 'failed' when warning > 0 then 'warnings' else 'ok' end as status from p), i as (select user_id, string_agg(concat('{{"code":"', code, '","severity":"', severity, '","count":', count, '}}'), ',' order by code) as l from issues group by 1)
select s.user_id, status, concat('{{"status":"', status, '","pages":', pages, ',"issues":[', l, ']}}') as report from s join i on i.user_id = s.user_id""")  # fmt: skip
def render_report(spark, sf):
    return op.render_report(issues(spark, sf), table(spark, sf, "events"), "user_id")
