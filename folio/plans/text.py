"""Queries over paragraphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import text as op
from .registry import paras, query, table


@query("paragraphs_shred", "select doc_id, para_idx, text, length(text) as n_chars from paras", ("paras",))
def paragraphs_shred(spark, sf):
    return paras(spark, sf).select("doc_id", "para_idx", "text", F.length("text").cast("long").alias("n_chars"))


@query("grep", "select doc_id, para_idx, trim(text, ' ') as text from paras where contains(trim(text, ' '), 'License')", ("paras",))
def grep(spark, sf):
    return op.grep(paras(spark, sf), "License")


@query("grep_ignore_case", "select doc_id, para_idx, trim(text, ' ') as text from paras where contains(lower(trim(text, ' ')), 'the the')", ("paras",))
def grep_ignore_case(spark, sf):
    return op.grep(paras(spark, sf), "The The", ignore_case=True)


@query("grep_capped", """with m as (select doc_id, para_idx, count(*) over (partition by doc_id) as total, row_number() over (partition by doc_id order by para_idx) as n from paras where contains(trim(text, ' '), 'the'))
select doc_id, para_idx, total, total > 5 as truncated from m where n <= 5""", ("paras",))  # fmt: skip
def grep_capped(spark, sf):
    return op.grep_capped(paras(spark, sf), "the", 5)


@query("find_match", "select doc_id, para_idx, instr(text, 'tion') - 1 as char_at, instr(text, 'tion') - 1 as wchar_at from paras where instr(text, 'tion') > 0", ("paras",))
def find_match(spark, sf):
    return op.find_first(paras(spark, sf), "tion")


_SLOTS = "regexp_replace(text, '(the|de|und) ', '{{ \\1.x }} ', 'g')"


def _slotted(spark, sf):
    return paras(spark, sf).withColumn("text", F.regexp_replace("text", "(the|de|und) ", "{{ $1.x }} "))


@query("scan_placeholders", f"""with e as (select doc_id, para_idx, unnest(regexp_extract_all({_SLOTS}, '\\{{\\{{(.*?)\\}}\\}}', 1)) as raw, generate_subscripts(regexp_extract_all({_SLOTS}, '\\{{\\{{(.*?)\\}}\\}}', 1), 1) as k from paras),
g as (select doc_id, trim(raw) as name, count(*) as n, min(para_idx * 1000000 + k) as first from e where regexp_matches(trim(raw), '^[\\p{{L}}\\p{{N}}._-]+$') group by 1, 2)
select doc_id, name, n, row_number() over (partition by doc_id order by first) as ord from g""", ("paras",))  # fmt: skip
def scan_placeholders(spark, sf):
    return op.placeholders(_slotted(spark, sf))


@query("fill_placeholders", "select doc_id, para_idx, replace(replace(replace(text, 'the ', '{{a}}{{b}}'), '{{a}}', 'A'), '{{b}}', 'B') as text from paras", ("paras",))
def fill_placeholders(spark, sf):
    return op.fill(paras(spark, sf).withColumn("text", F.replace("text", F.lit("the "), F.lit("{{a}}{{b}}"))), {"a": "A", "b": "B"})


@query("replace_all", "select doc_id, para_idx, replace(text, 'an', 'and an') as text, cast((length(text) - length(replace(text, 'an', ''))) // 2 as bigint) as n from paras", ("paras",))
def replace_all(spark, sf):
    return op.replace_text(paras(spark, sf), "an", "and an")


@query("replace_first", """with f as (select doc_id, min(para_idx) as spot from paras where contains(text, 'an') group by doc_id)
select p.doc_id, para_idx, case when para_idx = spot then concat(left(text, instr(text, 'an') - 1), 'X', substr(text, instr(text, 'an') + 2)) else text end as text, case when para_idx = spot then 1 else 0 end as n
from paras p left join f on f.doc_id = p.doc_id""", ("paras",))  # fmt: skip
def replace_first(spark, sf):
    return op.replace_text(paras(spark, sf), "an", "X", every=False)


@query("markdown_segments", """select doc_id, para_idx, cast(sum(length(text) + 1) over w - length(text) - 1 as bigint) as start, cast(sum(length(text) + 1) over w - 1 as bigint) as "end", cast(sum(length(text) + 1) over w - length(text) - 1 as bigint) as wchar_start
from paras window w as (partition by doc_id order by para_idx)""", ("paras",))  # fmt: skip
def markdown_segments(spark, sf):
    return op.offsets(paras(spark, sf))


@query("read_window", """with s as (select doc_id, para_idx, cast(sum(length(text) + 1) over w - length(text) - 1 as bigint) as start, cast(sum(length(text) + 1) over w - 1 as bigint) as stop from paras window w as (partition by doc_id order by para_idx))
select doc_id, para_idx, start, stop as "end" from s where start < 2000 and stop > 1000""", ("paras",))  # fmt: skip
def read_window(spark, sf):
    return op.window(op.offsets(paras(spark, sf)), 1000, 2000).select("doc_id", "para_idx", "start", "end")


_BLANKED = "select doc_id, para_idx, case when length(text) % 3 = 0 then '' else text end as text from paras"


@query("blank_cleanup", f"""with b as ({_BLANKED}), m as (select *, case when trim(text) = '' and coalesce(trim(lag(text) over w) = '', false) then 1 else 0 end as d from b window w as (partition by doc_id order by para_idx)),
g as (select *, cast(sum(d) over (partition by doc_id order by para_idx) as bigint) as gone from m) select doc_id, para_idx, para_idx - gone as new_idx, gone from g where d = 0""", ("paras",))  # fmt: skip
def blank_cleanup(spark, sf):
    return op.collapse_blanks(paras(spark, sf).withColumn("text", F.when(F.length("text") % 3 == 0, "").otherwise(F.col("text"))))


@query("plain_text", "select doc_id, string_agg(text, chr(10) order by para_idx) as text from paras where text <> '' group by doc_id", ("paras",))
def plain_text(spark, sf):
    return op.assemble(paras(spark, sf))


@query("delete_paragraph", """with m as (select *, contains(text, 'the') as hit, sum(case when contains(text, 'the') then 0 else 1 end) over (partition by doc_id) as rest, max(para_idx) over (partition by doc_id) as last from paras)
select doc_id, row_number() over (partition by doc_id order by para_idx) - 1 as para_idx, text from m where not hit or (rest = 0 and para_idx = last)""", ("paras",))  # fmt: skip
def delete_paragraph(spark, sf):
    return op.delete_matching(paras(spark, sf), "the")


@query("insert_paragraph", """with f as (select doc_id, min(para_idx) as spot from paras where contains(text, 'the') group by doc_id)
select p.doc_id, case when para_idx > spot then para_idx + 1 else para_idx end as para_idx, text from paras p left join f on f.doc_id = p.doc_id
union all select doc_id, spot + 1, 'NEW' from f""", ("paras",))  # fmt: skip
def insert_paragraph(spark, sf):
    return op.insert_after_first(paras(spark, sf), "the", "NEW")


@query("semantic_stats", "select doc_id, count(*) as paragraphs, cast(sum(length(text)) as bigint) as chars, cast(sum(case when trim(text) = '' then 1 else 0 end) as bigint) as blank from paras group by doc_id", ("paras",))
def semantic_stats(spark, sf):
    return op.semantic_stats(paras(spark, sf))


@query("semantic_digest", "select doc_id, sha256(string_agg(concat(strlen(text), ':', text), '' order by para_idx)) as digest from paras group by doc_id", ("paras",))
def semantic_digest(spark, sf):
    return op.digest(paras(spark, sf))


@query("escapes", """select doc_id, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') as xml,
case when regexp_matches(text, '[",\\r\\n]') then concat('"', replace(text, '"', '""'), '"') else text end as csv, replace(replace(text, '|', '\\|'), chr(10), ' ') as cell from documents""")  # fmt: skip
def escapes(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", fn.escape_xml(t).alias("xml"), fn.quote_csv(t).alias("csv"), fn.gfm_cell(t).alias("cell"))


@query("strip_tags", "select page_id, regexp_replace(html, '<[^>]*>', '', 'g') as text from pages")
def strip_tags(spark, sf):
    return table(spark, sf, "pages").select("page_id", fn.strip_tags(F.col("html")).alias("text"))


@query("hyperlink_url", "select page_id, regexp_replace(regexp_extract(concat(replace(url, '/', '\\/'), ';1;0'), '^((?:\\\\.|[^;\\\\])*)', 1), '\\\\(.)', '\\1', 'g') as url from pages")
def hyperlink_url(spark, sf):
    return table(spark, sf, "pages").select("page_id", fn.hyperlink_url(F.concat(F.replace("url", F.lit("/"), F.lit("\\/")), F.lit(";1;0"))).alias("url"))


@query("html_tag_census", """select lower(tag) as tag, count(*) as n, count(distinct page_id) as pages from (select page_id, unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1)) as tag from pages) group by 1""")
def html_tag_census(spark, sf):
    each = table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<([a-zA-Z][a-zA-Z0-9]*)"), 1)).alias("tag"))
    return each.groupBy(F.lower("tag").alias("tag")).agg(F.count("*").alias("n"), F.count_distinct("page_id").alias("pages"))


@query("magic_bytes", """select doc_id, case lang when 'en' then 'hwp5' when 'de' then 'hwpx' end as format, case lang when 'fr' then 'png' when 'es' then 'jpg' else 'bin' end as image from documents""")
def magic_bytes(spark, sf):
    head = F.unhex(F.when(F.col("lang") == "en", "D0CF11E0A1B11AE100").when(F.col("lang") == "de", "504B0304").when(F.col("lang") == "fr", "89504E470D0A1A0A00").when(F.col("lang") == "es", "FFD8FFE0").otherwise("00"))
    return table(spark, sf, "documents").select("doc_id", fn.file_format(head).alias("format"), fn.image_kind(head).alias("image"))


@query("text_required", """select doc_id, contains(text, 'License') as licensed, length(text) >= 500 as long_enough, len(string_split(text, chr(10))) >= 3 as paragraphs from documents""")
def text_required(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", t.contains("License").alias("licensed"), (F.length(t) >= 500).alias("long_enough"), (F.size(F.split(t, "\n")) >= 3).alias("paragraphs"))


@query("determinism", """select lang, count(*) as documents, count(distinct sha256(coalesce(text, ''))) as digests, count(*) filter (where doc_id % 100 = 7) = 0 as equal from documents group by lang""")
def determinism(spark, sf):
    """Two runs of one digest over all documents, compared as sets; the second run differs in one of a hundred."""
    docs = table(spark, sf, "documents").select("lang", "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    other = docs.withColumn("text", F.when(F.col("doc_id") % 100 == 7, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    runs = [d.select("lang", "doc_id", F.sha2("text", 256).alias("d")) for d in (docs, other)]
    both = runs[0].join(runs[1].withColumnRenamed("d", "e"), ["lang", "doc_id"])
    return both.groupBy("lang").agg(F.count("*").alias("documents"), F.count_distinct("d").alias("digests"), F.bool_and(F.col("d") == F.col("e")).alias("equal"))


@query("csv_document", """select doc_id, string_agg(case when regexp_matches(text, '[",\\r\\n]') then concat('"', replace(text, '"', '""'), '"') else text end, chr(10) order by para_idx) as csv from paras group by doc_id""", ("paras",))
def csv_document(spark, sf):
    quoted = paras(spark, sf).withColumn("text", fn.quote_csv(F.col("text")))
    return quoted.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("para_idx", "text"))), lambda x: x["text"]), "\n").alias("csv"))


@query("paths_contained", """select page_id, not (regexp_matches(p, '^(/|[A-Za-z]:)') or regexp_matches(p, '(^|[/\\\\])\\.\\.([/\\\\]|$)') or p = '') as safe from (select page_id, concat(case when page_id % 4 = 0 then '/' when page_id % 4 = 1 then '../' else '' end, regexp_extract(url, '/([^/?#]*)', 1)) as p from pages)""")
def paths_contained(spark, sf):
    k = F.col("page_id") % 4
    p = F.concat(F.when(k == 0, "/").when(k == 1, "../").otherwise(""), F.regexp_extract("url", "/([^/?#]*)", 1))
    return table(spark, sf, "pages").select("page_id", fn.safe_relative(p).alias("safe"))


@query("byte_window", """with d as (select doc_id, text, hex(encode(text)) as h, octet_length(encode(text)) as total from documents where text is not null),
e as (select *, least(60, total) as e0 from d), f as (select *, e0 - case when e0 < total and substr(h, e0 * 2 + 1, 1) in ('8', '9', 'A', 'B') then case when substr(h, e0 * 2 - 1, 1) in ('8', '9', 'A', 'B') then case when substr(h, e0 * 2 - 3, 1) in ('8', '9', 'A', 'B') then 3 else 2 end else 1 end else 0 end as e1 from e)
select doc_id, case when total >= 10 and not (total > 10 and substr(h, 21, 1) in ('8', '9', 'A', 'B')) then decode(unhex(substr(h, 21, (e1 - 10) * 2))) end as text, case when total >= 10 and not (total > 10 and substr(h, 21, 1) in ('8', '9', 'A', 'B')) then e1 - 10 end as returned,
case when total >= 10 and not (total > 10 and substr(h, 21, 1) in ('8', '9', 'A', 'B')) then e1 < total end as truncated from f union all select doc_id, null, null, null from documents where text is null""")  # fmt: skip
def byte_window(spark, sf):
    """Fifty bytes from the tenth of every text."""
    return table(spark, sf, "documents").select("doc_id", op.byte_window(F.col("text"), 10, 50).alias("w")).select("doc_id", "w.text", "w.returned", "w.truncated")


_KINDS = ["heading", "item", "item", "quote", "code", "link", "note", "plain"]


@query("write_markdown", f"""with b as (select doc_id, para_idx, text, list_extract([{", ".join(f"'{k}'" for k in _KINDS)}], cast(para_idx % 8 + 1 as int)) as kind, para_idx % 3 + 1 as level from paras),
l as (select doc_id, para_idx, kind, lag(kind) over (partition by doc_id order by para_idx) as before, case kind when 'heading' then concat(repeat('#', cast(level as int)), ' ', text) when 'item' then concat(repeat('  ', cast(level - 1 as int)), '- ', text) when 'quote' then concat('> ', text) when 'code' then concat('```', chr(10), text, chr(10), '```') when 'link' then concat('[', text, '](t', para_idx, ')') when 'note' then concat('[^t', para_idx, ']: ', text) else text end as line from b)
select doc_id, concat(string_agg(concat(case when before is null then '' when before = 'item' and kind = 'item' then chr(10) else concat(chr(10), chr(10)) end, line), '' order by para_idx), chr(10)) as md from l group by doc_id""", ("paras",))  # fmt: skip
def write_markdown(spark, sf):
    i = F.col("para_idx")
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (i % 8 + 1).cast("int"))
    return op.write_markdown(paras(spark, sf).select("doc_id", i.alias("ord"), kind.alias("kind"), (i % 3 + 1).alias("level"), "text", F.concat(F.lit("t"), i).alias("target")))


@query("page_paths", "select doc_id, para_idx + 1 as page, case when n > 1 then concat('out.d/', lang, '-', para_idx + 1, case when doc_id % 2 = 0 then '.png' else '' end) else concat('out.d/', lang, case when doc_id % 2 = 0 then '.png' else '' end) end as path from (select p.doc_id, para_idx, lang, count(*) over (partition by p.doc_id) as n from paras p join documents d on d.doc_id = p.doc_id)", ("paras",))
def page_paths(spark, sf):
    base = F.concat(F.lit("out.d/"), "lang", F.when(F.col("doc_id") % 2 == 0, ".png").otherwise(""))
    docs = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), base.alias("base"))
    lines = docs.select("doc_id", "base", F.size(F.split("text", "\n")).alias("n"), F.posexplode(F.split("text", "\n")).alias("k", "line"))
    return lines.select("doc_id", (F.col("k") + 1).cast("long").alias("page"), op.page_path(F.col("base"), F.col("k") + 1, F.col("n")).alias("path"))
