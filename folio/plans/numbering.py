"""Queries over counters and numerals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as fn
from ..operators import numbering as op
from .registry import heads, query, table

_COUNT = """with r as (select *, coalesce(max(case when level < 2 then ord end) over w, -1) as r2, coalesce(max(case when level < 3 then ord end) over w, -1) as r3 from heads window w as (partition by doc_id order by ord)),
c as (select *, greatest(sum(case when level = 1 then 1 else 0 end) over (partition by doc_id order by ord), 1) as n1, greatest(sum(case when level = 2 then 1 else 0 end) over (partition by doc_id, r2 order by ord), 1) as n2,
greatest(sum(case when level = 3 then 1 else 0 end) over (partition by doc_id, r3 order by ord), 1) as n3 from r) """


@query("list_markers", _COUNT + "select doc_id, ord, case level when 1 then concat(n1, '.') when 2 then concat(n1, '.', n2, '.') else concat(n1, '.', n2, '.', n3, '.') end as marker from c", ("heads",))
def list_markers(spark, sf):
    return op.list_markers(heads(spark, sf)).select("doc_id", "ord", "marker")


@query("list_templates", _COUNT + "select doc_id, ord, case level when 1 then concat('제', n1, '조') when 2 then concat('(', n1, '-', n2, ')') else concat(n3, ' of ', n2) end as marker from c", ("heads",))
def list_templates(spark, sf):
    counted = op.counters(heads(spark, sf))
    template = F.when(F.col("level") == 1, "제^1조").when(F.col("level") == 2, "(^1-^2)").otherwise("^3 of ^2")
    return counted.select("doc_id", "ord", op.apply_template(template, [F.greatest(F.col(f"c{k}"), F.lit(1)).cast("string") for k in (1, 2, 3)]).alias("marker"))


def _syllable(n: str) -> str:
    return "case when (x - 1) // 14 < 6 then chr(cast(44032 + list_extract([0, 2, 3, 5, 6, 7, 9, 11, 12, 14, 15, 16, 17, 18], cast((x - 1) % 14 + 1 as int)) * 588 + list_extract([0, 4, 8, 13, 18, 20], cast((x - 1) // 14 + 1 as int)) * 28 as int)) else cast(x as varchar) end".replace("(x - 1)", f"({n} - 1)").replace("cast(x as", f"cast({n} as")


@query("outline_markers", _COUNT + f"select doc_id, ord, case level when 1 then concat(n1, '.') when 2 then concat({_syllable('n2')}, '.') else concat(n3, ')') end as marker from c", ("heads",))
def outline_markers(spark, sf):
    return op.outline_markers(heads(spark, sf)).select("doc_id", "ord", "marker")


@query("heading_numbers", _COUNT + "select doc_id, ord, case when regexp_matches(ltrim(text), '^[0-9]+[.)-]') then null else case level when 1 then concat(n1, '.') when 2 then concat(n1, '-', n2, '.') else concat(n1, '-', n2, '-', n3, '.') end end as number from c", ("heads",))
def heading_numbers(spark, sf):
    return op.heading_numbers(heads(spark, sf)).select("doc_id", "ord", "number")


@query("note_numbers", "select doc_id, ord, role, row_number() over (partition by doc_id, role order by ord) as number from heads", ("heads",))
def note_numbers(spark, sf):
    return op.note_numbers(heads(spark, sf), "doc_id", "role").select("doc_id", "ord", "role", "number")


@query("nth_table", "select o_orderkey, o_custkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) - 1 as nth from orders")
def nth_table(spark, sf):
    return op.nth(table(spark, sf, "orders"), "o_custkey", "o_orderdate", "o_orderkey").select("o_orderkey", "o_custkey", "nth")


@query("page_numbers", """with p as (select conv_id as doc_id, turn as ord, case when length(text) % 5 = 0 then length(text) % 50 end as restart from conversations),
m as (select *, coalesce(max(case when restart is not null then ord end) over (partition by doc_id order by ord), -1) as mark from p),
b as (select *, coalesce(max(restart) over (partition by doc_id, mark), 1) as base from m)
select doc_id, ord, base + row_number() over (partition by doc_id, mark order by ord) - 1 as page_no from b""")  # fmt: skip
def page_numbers(spark, sf):
    n = F.length("text")
    pages = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), F.when(n % 5 == 0, n % 50).alias("restart"))
    return op.page_numbers(pages).select("doc_id", "ord", "page_no")


@query("compact_runs", "with b as (select user_id as doc_id, event_id as ord, event_type as shape, lag(event_type) over (partition by user_id order by event_id) as before from events) select doc_id, ord, shape from b where before is null or before <> shape")
def compact_runs(spark, sf):
    runs = table(spark, sf, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("ord"), F.col("event_type").alias("shape"))
    return op.compact_runs(runs)


@query("palette", "with g as (select p_type, min(p_partkey) as first, count(*) as uses from part group by p_type) select p_type, uses, row_number() over (order by first, p_type) - 1 as id from g")
def palette(spark, sf):
    return op.palette(table(spark, sf, "part"), "p_type", F.col("p_partkey")).select("p_type", "uses", "id")


@query("prefix_sums", "select o_custkey, o_orderkey, cast(coalesce(sum(cast(o_totalprice as bigint)) over (partition by o_custkey order by o_orderkey rows between unbounded preceding and 1 preceding), 0) as bigint) as \"offset\" from (select o_custkey, o_orderkey, floor(o_totalprice) as o_totalprice from orders)")
def prefix_sums(spark, sf):
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.floor("o_totalprice").alias("w"))
    return op.prefix_sums(rows, "o_custkey", "o_orderkey", "w").select("o_custkey", "o_orderkey", "offset")


def _numerals() -> str:
    x = "n"
    syllable = _syllable("n")
    roman = "case when n > 3999 then cast(n as varchar) else concat(list_extract(['', 'm', 'mm', 'mmm'], cast(n // 1000 + 1 as int)), list_extract(['', 'c', 'cc', 'ccc', 'cd', 'd', 'dc', 'dcc', 'dccc', 'cm'], cast(n // 100 % 10 + 1 as int)), list_extract(['', 'x', 'xx', 'xxx', 'xl', 'l', 'lx', 'lxx', 'lxxx', 'xc'], cast(n // 10 % 10 + 1 as int)), list_extract(['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'], cast(n % 10 + 1 as int))) end"
    latin = "case when n <= 26 then chr(cast(64 + n as int)) when n <= 702 then concat(chr(cast(64 + (n - 1) // 26 as int)), chr(cast(65 + (n - 1) % 26 as int))) when n <= 18278 then concat(chr(cast(64 + ((n - 1) // 26 - 1) // 26 as int)), chr(cast(65 + ((n - 1) // 26 - 1) % 26 as int)), chr(cast(65 + (n - 1) % 26 as int))) else concat(chr(cast(64 + (((n - 1) // 26 - 1) // 26 - 1) // 26 as int)), chr(cast(65 + (((n - 1) // 26 - 1) // 26 - 1) % 26 as int)), chr(cast(65 + ((n - 1) // 26 - 1) % 26 as int)), chr(cast(65 + (n - 1) % 26 as int))) end"
    return f"""select {x}, cast(n as varchar) as digit, {syllable} as syllable, substr('ㄱㄴㄷㄹㅁㅂㅅㅇㅈㅊㅋㅌㅍㅎ', cast((n - 1) % 14 + 1 as int), 1) as consonant, case when n <= 20 then chr(cast(9311 + n as int)) else cast(n as varchar) end as circled,
    case when n <= 14 then chr(cast(12909 + n as int)) else {syllable} end as circled_syllable, {latin} as latin_upper, lower({latin}) as latin_lower, upper({roman}) as roman_upper, {roman} as roman_lower
    from (select distinct p_partkey + 1 as n from part)"""


@query("format_number", _numerals())
def format_number(spark, sf):
    """All rows of part, Roman numerals beyond 3999 included."""
    n = table(spark, sf, "part").select((F.col("p_partkey") + 1).alias("n")).distinct()
    return n.select("n", *(fn.format_number(F.col("n"), s).alias(s) for s in fn.SYSTEMS))


@query("page_number_text", """select p_partkey, concat('- ', case p_size % 4 when 0 then cast(p_size as varchar) when 1 then case when p_size between 1 and 20 then chr(cast(9311 + p_size as int)) else cast(p_size as varchar) end
when 2 then concat(list_extract(['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'], cast(p_size // 10 + 1 as int)), list_extract(['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'], cast(p_size % 10 + 1 as int))) else '*' end, ' -') as text from part""")  # fmt: skip
def page_number_text(spark, sf):
    code = F.when(F.col("p_size") % 4 == 3, 7).otherwise(F.col("p_size") % 4)
    return table(spark, sf, "part").select("p_partkey", fn.page_number(F.col("p_size"), code, F.lit("*"), F.lit("- "), F.lit(" -")).alias("text"))


@query("filetime", """with e as (select event_id, (cast(floor(epoch(ts)) as bigint) + 11644473600) * 10000000 as ft, to_timestamp(floor(epoch(ts)))::timestamp as t from (select event_id, ts from events))
select event_id, strftime(make_timestamp(cast((ft // 10000000 - 11644473600) * 1000000 as bigint)), '%Y-%m-%dT%H:%M:%SZ') as iso, ft as again from e""")  # fmt: skip
def filetime(spark, sf):
    ft = ((F.unix_timestamp("ts") + fn.EPOCH) * 10_000_000).alias("ft")
    rows = table(spark, sf, "events").select("event_id", ft).withColumn("iso", fn.filetime_iso(F.col("ft")))
    return rows.select("event_id", "iso", fn.iso_to_filetime(F.col("iso")).alias("again"))


@query("filetime_korean", """with k as (select o_orderkey, o_orderdate + interval (9 + o_orderkey % 24) hour as t from orders)
select o_orderkey, concat(year(t), '년 ', month(t), '월 ', day(t), '일 ', list_extract(['일', '월', '화', '수', '목', '금', '토'], dayofweek(t) + 1), '요일 ', case when hour(t) < 12 then '오전' else '오후' end, ' ', case when hour(t) % 12 = 0 then 12 else hour(t) % 12 end, strftime(t, ':%M:%S')) as text from k""")  # fmt: skip
def filetime_korean(spark, sf):
    ft = (F.unix_timestamp("o_orderdate") + fn.EPOCH + (F.col("o_orderkey") % 24) * 3600) * 10_000_000
    return table(spark, sf, "orders").select("o_orderkey", fn.filetime_korean(ft).alias("text"))


@query("iso_date", "select event_id, s, regexp_matches(s, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') and left(s, 4) <> '0000' and try_cast(s as date) is not null as ok from (select event_id, concat(lpad(cast(1995 + event_id % 30 as varchar), case when event_id % 7 = 0 then 5 else 4 end, '0'), '-', lpad(cast(1 + event_id % 13 as varchar), 2, '0'), '-', lpad(cast(1 + event_id % 31 as varchar), 2, '0')) as s from events)")
def iso_date(spark, sf):
    k = F.col("event_id")
    year = F.when(k % 7 == 0, F.lpad((1995 + k % 30).cast("string"), 5, "0")).otherwise((1995 + k % 30).cast("string"))
    s = F.concat_ws("-", year, F.lpad((1 + k % 13).cast("string"), 2, "0"), F.lpad((1 + k % 31).cast("string"), 2, "0"))
    return table(spark, sf, "events").select("event_id", s.alias("s")).withColumn("ok", fn.is_iso_date(F.col("s")))


@query("civil_dates", "select o_orderkey, date_diff('day', date '1601-01-01', cast(o_orderdate as date)) as days, dayofweek(o_orderdate) as weekday from orders")
def civil_dates(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.date_diff(F.to_date("o_orderdate"), F.lit("1601-01-01").cast("date")).cast("long").alias("days"), (F.dayofweek("o_orderdate") - 1).cast("long").alias("weekday"))


@query("units", "select p_partkey, p_partkey / 100.0 as pt, round(p_partkey * 25.4 / 7200.0, 6) as mm, round(p_partkey * 96.0 / 7200.0, 6) as px from (select p_partkey * 1.0::double as p_partkey from part)")
def units(spark, sf):
    u = F.col("p_partkey").cast("double")
    return table(spark, sf, "part").select(u.alias("p_partkey"), fn.to_points(u).alias("pt"), F.round(fn.to_mm(u), 6).alias("mm"), F.round(fn.to_pixels(u), 6).alias("px"))


@query("colors", "with c as (select p_partkey, case when p_size = 50 then 4294967295 else p_partkey * 7919 % 16777216 end as c from part) select p_partkey, case when c <> 4294967295 then format('#{:02X}{:02X}{:02X}', c & 255, (c >> 8) & 255, (c >> 16) & 255) end as hex, c as again from c")
def colors(spark, sf):
    c = F.when(F.col("p_size") == 50, F.lit(0xFFFFFFFF)).otherwise(F.col("p_partkey") * 7919 % 16777216)
    rows = table(spark, sf, "part").select("p_partkey", fn.color_hex(c).alias("hex"))
    return rows.withColumn("again", F.coalesce(fn.parse_color(F.col("hex")), F.lit(0xFFFFFFFF)))


@query("bit_flags", "select l_orderkey, l_linenumber, count(*) as n, cast(sum((l_partkey & 1)) as bigint) as bold, cast(sum((l_partkey >> 1) & 1) as bigint) as italic, cast(sum((l_partkey >> 2) & 7) as bigint) as kind from lineitem group by all")
def bit_flags(spark, sf):
    a = F.col("l_partkey")
    return table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.sum(fn.flag(a, 0).cast("long")).alias("bold"), F.sum(fn.flag(a, 1).cast("long")).alias("italic"), F.sum(fn.bits(a, 2, 3)).alias("kind"))


@query("border_widths", "select p_partkey, case when p_size <= 15 then list_extract([0.1, 0.12, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 1.0, 1.5, 2.0, 3.0, 4.0, 5.0], p_size + 1)::double else 0.12::double end as mm from part")
def border_widths(spark, sf):
    return table(spark, sf, "part").select("p_partkey", fn.border_mm(F.col("p_size")).alias("mm"))


@query("record_headers", "with v as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_partkey * 1048583 + l_suppkey * 4093) % 4294967296 as v from lineitem) select v, count(*) as n, v & 1023 as tag, (v >> 10) & 1023 as level, (v >> 20) & 4095 as size, ((v >> 20) & 4095) = 4095 as extended from v group by v")
def record_headers(spark, sf):
    v = (F.col("l_partkey") * 1048583 + F.col("l_suppkey") * 4093) % 4294967296
    return table(spark, sf, "lineitem").groupBy(v.alias("v")).count().select("v", F.col("count").alias("n"), fn.record_header(F.col("v")).alias("h")).select("v", "n", "h.*")
