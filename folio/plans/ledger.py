"""Queries over ledgers, rules, lookups and rasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ledger as op
from ..operators import lookup as look
from ..operators import raster
from .registry import cells, paras, query, table


@query("multiset_difference", """with a as (select lang, sha256(text) as h, count(*) as n from documents group by all), b as (select lang, sha256(text) as h, count(*) as n from (select distinct lang, text from documents) group by all)
select a.lang, a.h, a.n - coalesce(b.n, 0) as removed from a left join b on a.lang = b.lang and a.h = b.h where a.n > coalesce(b.n, 0)""")  # fmt: skip
def multiset_difference(spark, sf):
    docs = table(spark, sf, "documents").select("lang", F.sha2("text", 256).alias("h"))
    return op.removed(docs, docs.distinct(), "h", "lang")


@query("except_all", "select lang, source from documents except all select lang, source from (select lang, source, row_number() over (partition by lang, source) as n from documents) where n <= 3")
def except_all(spark, sf):
    from pyspark.sql import Window

    docs = table(spark, sf, "documents").select("lang", "source")
    few = docs.withColumn("n", F.row_number().over(Window.partitionBy("lang", "source").orderBy("lang"))).where("n <= 3").drop("n")
    return docs.exceptAll(few)


_EVENTS = "select event_type as code, case when value < 5 then 'style' else 'control' end as resource, case when event_id % 3 = 0 then 'removed' when event_id % 3 = 1 then 'changed' else 'opaque' end as disposition, 1 as count from events"


def _events(spark, sf):
    k = F.col("event_id") % 3
    return table(spark, sf, "events").select(F.col("event_type").alias("code"), F.when(F.col("value") < 5, "style").otherwise("control").alias("resource"), F.when(k == 0, "removed").when(k == 1, "changed").otherwise("opaque").alias("disposition"), F.lit(1).cast("long").alias("count"))


@query("ledger_merge", f"select code, resource, disposition, cast(sum(count) as bigint) as count from ({_EVENTS} union all {_EVENTS}) group by all")
def ledger_merge(spark, sf):
    return op.merge_events(_events(spark, sf), _events(spark, sf))


@query("ledger_status", f"select code, case when sum(case when disposition = 'removed' then 1 else 0 end) = 0 then 'clean' else 'lossy' end as status from ({_EVENTS}) group by code")
def ledger_status(spark, sf):
    return _events(spark, sf).groupBy("code").agg(F.when(F.count_if(F.col("disposition") == "removed") == 0, "clean").otherwise("lossy").alias("status"))


@query("container_diff", """with o as (select doc_id, case when length(text) % 2 = 0 then sha256(text) else sha256(concat(text, 'x')) end as h from documents where length(text) % 7 <> 0)
select cast(d.doc_id as varchar) as name, case when o.h is null then 'removed' else 'changed' end as status from documents d left join o on o.doc_id = d.doc_id where o.h is null or o.h <> sha256(d.text)""")  # fmt: skip
def container_diff(spark, sf):
    docs = table(spark, sf, "documents")
    name, n = F.col("doc_id").cast("string").alias("name"), F.length("text")
    new = docs.where(n % 7 != 0).select(name, F.when(n % 2 == 0, F.sha2("text", 256)).otherwise(F.sha2(F.concat("text", F.lit("x")), 256)).alias("hash"))
    return op.container_diff(docs.select(name, F.sha2("text", 256).alias("hash")), new)


@query("issue_buckets", """with p as (select event_type as code, sha256(props) as h, count(*) as n, min(event_id) as first from events group by all), k as (select *, row_number() over (partition by code order by first, h) as k from p)
select code, cast(sum(n) as bigint) as count, list(h order by h) filter (where k <= 4) as samples, max(k) <= 4 as complete from k group by code""")  # fmt: skip
def issue_buckets(spark, sf):
    return op.issue_buckets(table(spark, sf, "events").select(F.col("event_type").alias("code"), F.col("event_id").alias("ord"), F.col("props").alias("detail")))


@query("font_coverage", "select count(*) filter (where event_type = 'view') as matched, count(*) filter (where event_type = 'click') as substituted, count(*) filter (where event_type = 'error') as missing from events")
def font_coverage(spark, sf):
    buckets = table(spark, sf, "events").groupBy(F.col("event_type").alias("code")).count()
    return op.coverage(buckets, {"matched": "view", "substituted": "click", "missing": "error"})


@query("count_rule", "select user_id, count(*) as observed, list_filter([case when count(*) < 180 then 'below_minimum' end, case when count(*) > 205 then 'above_maximum' end], lambda x: x is not null) as reasons from events group by user_id")
def count_rule(spark, sf):
    per = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("observed"))
    return per.select("user_id", "observed", op.count_rule(F.col("observed"), 180, 205).alias("reasons"))


@query("presence_rule", "select d.doc_id, case when quality is null or quality = 1 then 'failed' else 'passed' end as deny, case when quality = 1 then 'passed' else 'failed' end as require from documents d left join labels l on l.doc_id = d.doc_id")
def presence_rule(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    present = F.col("quality") == 1
    return rows.select("doc_id", op.presence_rule(present, "deny").alias("deny"), op.presence_rule(present, "require").alias("require"))


@query("named_set_rule", """with s as (select user_id, list(distinct event_type) as n from events group by 1)
select user_id, list_filter([case when len(list_filter(n, lambda x: x not in ('view', 'click', 'purchase'))) > 0 then 'not_allowed' end, case when not (list_contains(n, 'view') and list_contains(n, 'click')) then 'required_missing' end], lambda x: x is not null) as reasons from s""")  # fmt: skip
def named_set_rule(spark, sf):
    return op.named_set_rule(table(spark, sf, "events"), "user_id", "event_type", ["view", "click", "purchase"], ["view", "click"])


@query("overall_status", """select doc_id, case when f then 'failed' when m = 'disabled' or o = 'passed' then 'passed' when m = 'required' and o = 'unavailable' then 'partial' when m = 'optional' and o = 'failed' then 'partial' when m = 'optional' and o = 'unavailable' then 'passed' else 'failed' end as status
from (select doc_id, n_chars % 5 = 0 as f, list_extract(['disabled', 'optional', 'required'], cast(doc_id % 3 + 1 as int)) as m, list_extract(['passed', 'failed', 'unavailable', 'not_run'], cast(n_chars % 4 + 1 as int)) as o from documents)""")  # fmt: skip
def overall_status(spark, sf):
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))
    n, d = F.col("n_chars"), F.col("doc_id")
    return table(spark, sf, "documents").select("doc_id", op.overall_status(n % 5 == 0, pick(["disabled", "optional", "required"], d % 3), pick(["passed", "failed", "unavailable", "not_run"], n % 4)).alias("status"))


@query("package_limits", "select source, list_filter([case when count(*) > 50 then 'entries' end, case when max(n_chars) > 20000 then 'entry_bytes' end, case when sum(n_chars) > 100000 then 'total_bytes' end, case when max(n_chars / greatest(doc_id, 1)) > 1000 then 'ratio' end], lambda x: x is not null) as broken from documents group by source")
def package_limits(spark, sf):
    return op.budget(table(spark, sf, "documents"), "source", "n_chars", "doc_id", {"entries": 50, "entry_bytes": 20000, "total_bytes": 100000, "ratio": 1000})


@query("issue_truncation", "with r as (select *, row_number() over w as n, sum(length(props)) over (partition by user_id order by event_id rows unbounded preceding) as b from events window w as (partition by user_id order by event_id)) select user_id, event_id from r where n <= 100 and b <= 700")
def issue_truncation(spark, sf):
    rows = table(spark, sf, "events").withColumn("size", F.length("props"))
    return op.capped(rows, "user_id", "event_id", "size", 100, 700).select("user_id", "event_id")


@query("rule_composition", "with e(code, k) as (values ('view', 1), ('click', 2), ('signup', 3), ('render', 4)), o as (select event_type as code, row_number() over (order by event_type) as k from (select distinct event_type from events)) select coalesce(e.code, o.code) as code, e.k as expected, o.k as observed from e full join o on e.code = o.code")
def rule_composition(spark, sf):
    from pyspark.sql import Window

    want = spark.createDataFrame([("view", 1), ("click", 2), ("signup", 3), ("render", 4)], "code string, expected int")
    have = table(spark, sf, "events").select(F.col("event_type").alias("code")).distinct().withColumn("observed", F.row_number().over(Window.orderBy("code")).cast("long"))
    return want.join(have, "code", "full").select("code", "expected", "observed")


@query("artifact_manifest", """select source, cast(sum(n) as bigint) as artifacts, cast(sum(b) as bigint) as bytes, sha256(string_agg(h, ',' order by block)) as manifest
from (select source, doc_id // 1000 as block, count(*) as n, sum(n_chars) as b, sha256(string_agg(concat(doc_id, ':', sha256(coalesce(text, ''))), ',' order by doc_id)) as h from documents group by all) group by source""")  # fmt: skip
def artifact_manifest(spark, sf):
    docs = table(spark, sf, "documents").withColumn("digest", F.sha2(F.coalesce("text", F.lit("")), 256))
    return op.manifest(docs, "source", "doc_id", "digest", "n_chars")


@query("document_stats", """select p.doc_id, count(*) as paragraphs, count(*) filter (where contains(text, 'http')) as links, count(*) filter (where contains(text, '@')) as addresses, max(quality) as quality from paras p left join labels l on l.doc_id = p.doc_id group by p.doc_id""", ("paras",))
def document_stats(spark, sf):
    per = paras(spark, sf).groupBy("doc_id").agg(F.count("*").alias("paragraphs"), F.count_if(F.col("text").contains("http")).alias("links"), F.count_if(F.col("text").contains("@")).alias("addresses"))
    return per.join(table(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality")), "doc_id", "left")


@query("used_styles", "select o_custkey, list(distinct o_orderpriority order by o_orderpriority) as used from orders group by 1")
def used_styles(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("used"))


@query("dimension_lookup", "select l_orderkey, l_linenumber, p_brand, s_name, count(*) as n from lineitem left join part on p_partkey = l_partkey left join supplier on s_suppkey = l_suppkey group by all")
def dimension_lookup(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    wide = lines.join(table(spark, sf, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"), "left").join(table(spark, sf, "supplier").select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"), "left")
    return wide.groupBy("l_orderkey", "l_linenumber", "p_brand", "s_name").agg(F.count("*").alias("n"))


@query("asof_shape", """with v as (select user_id, ts, max(event_id) as shape from events where event_type = 'view' group by all), p as (select event_id, user_id, ts from events where event_type = 'purchase')
select p.event_id, p.user_id, v.shape from p asof left join v on p.user_id = v.user_id and p.ts >= v.ts""")  # fmt: skip
def asof_shape(spark, sf):
    events = table(spark, sf, "events")
    right = events.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("shape"))
    return look.asof(events.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), right, "user_id", "ts", "shape").select("event_id", "user_id", "shape")


@query("hyperlink_ranges", """with s as (select user_id, cast(floor(epoch(ts)) as bigint) as start, cast(floor(epoch(ts)) as bigint) + 3600 as "end" from events where event_type = 'signup'), p as (select event_id, user_id, cast(floor(epoch(ts)) as bigint) as pos from events where event_type = 'click')
select p.event_id, s.start from p join s on p.user_id = s.user_id and pos >= s.start and pos < s."end" """)  # fmt: skip
def hyperlink_ranges(spark, sf):
    events = table(spark, sf, "events").withColumn("at", F.unix_timestamp("ts"))
    spans = events.where("event_type = 'signup'").select("user_id", F.col("at").alias("start"), (F.col("at") + 3600).alias("end"))
    return look.interval_join(events.where("event_type = 'click'").select("event_id", "user_id", "at"), spans, "user_id", "at", 3600).select("event_id", "start")


@query("collisions", """with b as (select source as page, doc_id as item, n_chars % 17 as y, (doc_id * 37) % 1000 as x0, (doc_id * 37) % 1000 + 20 + n_chars % 60 as x1 from documents)
select a.page, a.item as item_a, b.item as item_b, least(a.x1, b.x1) - greatest(a.x0, b.x0) as overlap from b a join b on a.page = b.page and a.item < b.item and a.y <> b.y where least(a.x1, b.x1) - greatest(a.x0, b.x0) > 0 and least(a.x1, b.x1) - greatest(a.x0, b.x0) >= 0.25 * least(a.x1 - a.x0, b.x1 - b.x0)""")  # fmt: skip
def collisions(spark, sf):
    x0 = F.col("doc_id") * 37 % 1000
    boxes = table(spark, sf, "documents").select(F.col("source").alias("page"), F.col("doc_id").alias("item"), (F.col("n_chars") % 17).alias("y"), x0.alias("x0"), (x0 + 20 + F.col("n_chars") % 60).alias("x1"))
    return look.overlaps(boxes, "page", 0.25)


@query("control_link", """with a as (select event_id, user_id, row_number() over (partition by user_id order by event_id) as k from events where event_type = 'click'), c as (select event_id as control, user_id, row_number() over (partition by user_id order by event_id) as k from events where event_type = 'view')
select a.event_id, a.user_id, control from a left join c on a.user_id = c.user_id and a.k = c.k""")  # fmt: skip
def control_link(spark, sf):
    events = table(spark, sf, "events")
    controls = events.where("event_type = 'view'").select("user_id", F.col("event_id").alias("control"))
    return look.ordinal_link(events.where("event_type = 'click'").select("event_id", "user_id"), controls, ("user_id",), "event_id", "control").select("event_id", "user_id", "control")


@query("style_inheritance", """with recursive s as (select p_partkey as id, case when p_partkey % 16 <> 0 then p_partkey - 1 end as parent, case when p_size > 30 then p_size end as font, case when p_partkey % 5 = 0 then p_brand end as face from part),
w as (select id, parent, font, face from s union all select w.id, s.parent, coalesce(w.font, s.font), coalesce(w.face, s.face) from w join s on s.id = w.parent)
select id, font, face, false as cycle from w where parent is null""")  # fmt: skip
def style_inheritance(spark, sf):
    k = F.col("p_partkey")
    styles = table(spark, sf, "part").select(k.alias("id"), F.when(k % 16 != 0, k - 1).alias("parent"), F.when(F.col("p_size") > 30, F.col("p_size")).alias("font"), F.when(k % 5 == 0, F.col("p_brand")).alias("face"))
    return look.inherit(styles, ["font", "face"])


@query("font_resolution", """with c as (select c_custkey as id, c_name as want, c_mktsegment as class from customer), e as (select concat('Customer#', lpad(cast(s_suppkey * 7 as varchar), 9, '0')) as want, s_name as choice from supplier)
select id, coalesce(e.choice, concat('any ', class)) as choice, case when e.choice is null then 1 else 0 end as tier from c left join e on e.want = c.want""")  # fmt: skip
def font_resolution(spark, sf):
    requests = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("want"), "c_mktsegment")
    exact = table(spark, sf, "supplier").select(F.concat(F.lit("Customer#"), F.lpad((F.col("s_suppkey") * 7).cast("string"), 9, "0")).alias("want"), F.col("s_name").alias("choice"), F.lit(0).alias("ord"))
    fallback = requests.select("want", F.concat(F.lit("any "), "c_mktsegment").alias("choice"), F.lit(0).alias("ord"))
    return look.resolve(requests, [exact, fallback], "want", "ord").select("id", "choice", "tier")


@query("part_merge", """with t as (select s_suppkey as id, s_name as name from supplier), o as (select max(id) + 1 as o from t), p as (select c_custkey as id, concat('Supplier#', lpad(cast(c_custkey * 3 as varchar), 9, '0')) as name from customer)
select id, name from t union all select p.id + o, case when t.name is not null then concat(p.name, '_', p.id + o) else p.name end from p cross join o left join t on t.name = p.name""")  # fmt: skip
def part_merge(spark, sf):
    target = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    part = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("Supplier#"), F.lpad((F.col("c_custkey") * 3).cast("string"), 9, "0")).alias("name"))
    return look.merge_palettes(target, part, "name")


@query("binary_resolve", "select o_orderkey, s_name as entry from orders left join supplier on lower(format('SUPPLIER#{:09d}', o_custkey % 150)) = lower(s_name)")
def binary_resolve(spark, sf):
    wanted = table(spark, sf, "orders").select("o_orderkey", F.lower(F.format_string("SUPPLIER#%09d", F.col("o_custkey") % 150)).alias("k"))
    return wanted.join(table(spark, sf, "supplier").select(F.lower("s_name").alias("k"), F.col("s_name").alias("entry")), "k", "left").select("o_orderkey", "entry")


@query("first_by_order", "select o_custkey, arg_min(o_orderpriority, o_orderkey) as priority from orders group by 1")
def first_by_order(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.min_by("o_orderpriority", "o_orderkey").alias("priority"))


@query("raster_diff", """with p as (select a.vec_id as id, a.embedding as a, b.embedding as b from embeddings a join embeddings b on b.vec_id = a.vec_id + 1), e as (select id, unnest(a) as x, unnest(b) as y from p)
select id, round(avg(abs(x::double - y::double)), 5) as mae, avg(case when abs(x - y) > 0.2::float then 1 else 0 end) as bad_ratio from e group by id""")  # fmt: skip
def raster_diff(spark, sf):
    rows = table(spark, sf, "embeddings")
    pairs = rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("a")).join(rows.select((F.col("vec_id") - 1).alias("id"), F.col("embedding").alias("b")), "id")
    pairs = pairs.withColumn("a", F.expr("transform(a, x -> double(x))")).withColumn("b", F.expr("transform(b, x -> double(x))"))
    return raster.difference(pairs, "a", "b", 0.2).select("id", F.round("mae", 5).alias("mae"), "bad_ratio")


@query("ink_profile", "with e as (select vec_id as id, unnest(embedding) as v, generate_subscripts(embedding, 1) - 1 as i from embeddings) select id, i // 8 as y, cast(sum(case when v > 0 then 1 else 0 end) as bigint) as ink from e group by all")
def ink_profile(spark, sf):
    return raster.ink_profile(table(spark, sf, "embeddings").withColumnRenamed("vec_id", "id"), "embedding", 8)


_PROFILES = "select user_id as id, cast(floor(epoch(ts)) as bigint) // 86400 as k, count(*) filter (where event_type = 'view') as a, count(*) filter (where event_type = 'click') as b from events group by all"


@query("best_lag", f"""with p as ({_PROFILES}), s as (select x.id, y.k - x.k as lag, sum(x.a * y.b) / count(*) as score from p x join p y on x.id = y.id and y.k - x.k between -5 and 5 group by all)
select id, lag from (select *, row_number() over (partition by id order by score desc, lag) as n from s) where n = 1""")  # fmt: skip
def best_lag(spark, sf):
    day = F.floor(F.unix_timestamp("ts") / 86400)
    profiles = table(spark, sf, "events").groupBy(F.col("user_id").alias("id"), day.alias("k")).agg(F.count_if(F.col("event_type") == "view").alias("a"), F.count_if(F.col("event_type") == "click").alias("b"))
    return raster.best_lag(profiles, 5).select("id", F.col("lag").cast("long").alias("lag"))


@query("roi_precision", """with e as (select vec_id as id, unnest(embedding) as v, generate_subscripts(embedding, 1) - 1 as i from embeddings), p as (select id, i % 8 as x, i // 8 as y, v from e),
a as (select id, x, y from p where v > 0.15), b as (select id, x, y from p where v < -0.15)
select a.id, avg(case when exists (select 1 from b where b.id = a.id and abs(b.x - a.x) <= 1 and abs(b.y - a.y) <= 1) then 1.0::double else 0.0::double end) as share from a group by a.id""")  # fmt: skip
def roi_precision(spark, sf):
    """Bounds are floats, as the pixels and the SQL's comparisons are: a pixel of just 0.15 is no ink on either side."""
    pixels = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.posexplode("embedding").alias("i", "v"))
    at = pixels.select("id", (F.col("i") % 8).alias("x"), F.floor(F.col("i") / 8).alias("y"), "v")
    return raster.tolerant_share(at.where("v > 0.15F").select("id", "x", "y"), at.where("v < -0.15F").select("id", "x", "y"), 1)


@query("media_box_delta", "with p as (select a.vec_id as id, a.embedding as a, b.embedding as b from embeddings a join embeddings b on b.vec_id = a.vec_id + 1) select id, list_max(list_transform(list_zip(a, b), lambda x: abs(x[1] - x[2])))::double as delta from p")
def media_box_delta(spark, sf):
    rows = table(spark, sf, "embeddings")
    pairs = rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("a")).join(rows.select((F.col("vec_id") - 1).alias("id"), F.col("embedding").alias("b")), "id")
    return pairs.select("id", raster.bounds_delta("a", "b").cast("double").alias("delta"))


@query("image_naming", "select source, sha256(text) as h, row_number() over (partition by source order by min(doc_id)) as n from documents group by source, sha256(text)")
def image_naming(spark, sf):
    from pyspark.sql import Window

    first = table(spark, sf, "documents").groupBy("source", F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("first"))
    return first.select("source", "h", F.row_number().over(Window.partitionBy("source").orderBy("first")).cast("long").alias("n"))


@query("corpus_rollup", "select lang, source, count(*) as documents, cast(sum(n_chars) as bigint) as chars from documents group by rollup (lang, source)")
def corpus_rollup(spark, sf):
    return table(spark, sf, "documents").rollup("lang", "source").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"))


@query("unchanged_paragraphs", "with n as (select doc_id, para_idx, case when length(text) % 4 = 0 then concat(text, '!') else text end as text from paras) select p.doc_id, count(*) filter (where p.text = n.text) as unchanged, count(*) as total from paras p join n on p.doc_id = n.doc_id and p.para_idx = n.para_idx group by 1", ("paras",))
def unchanged_paragraphs(spark, sf):
    p = paras(spark, sf)
    edited = p.select("doc_id", "para_idx", F.xxhash64(F.when(F.length("text") % 4 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("new"))
    both = p.select("doc_id", "para_idx", F.xxhash64("text").alias("old")).join(edited, ["doc_id", "para_idx"])
    return both.groupBy("doc_id").agg(F.count_if(F.col("old") == F.col("new")).alias("unchanged"), F.count("*").alias("total"))
