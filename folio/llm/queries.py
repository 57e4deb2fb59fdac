"""Queries over the synthetic tables, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_output import token_digests, write_token_files

    files = write_token_files(table(spark, sf_dir, "documents"), Scratch(spark, "tokens"), _vocabulary("byte_bpe_50k.json"))
    return token_digests(files)


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import format_conversations

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    out = format_conversations(rows.unionByName(probe), _vocabulary("byte_bpe_50k.json"))
    return out.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


OP1_SQL = r"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
           union all select -7, i, case i when 0 then 'user' else 'assistant' end, '\### Assistant: </turn> ok' from range(0, 2) as t(i)),
e as (select *, length(replace(replace(role, '\', '\\'), '<|', '<\|')) as r, length(replace(replace(text, '\', '\\'), '<|', '<\|')) as n from c)
select conv_id, count(*) as n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' order by turn, role, text)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
       cast(13 + sum(r + 13 + n + 13) as bigint) as formatted_chars
from e group by conv_id
"""


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of two tokenizer versions: estimates come first and are revised, then copies of a text go but for the first."""
    from .rollup import TokenRollup, token_counts

    scratch = Scratch(spark, "rollup")
    versions = {"byte_bpe_50k": _vocabulary("byte_bpe_50k.json"), "word_bpe_49k": _vocabulary("word_bpe_49k.json")}
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    copy, guess = F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("copy"), F.expr("(length(coalesce(text, '')) + 3) div 4").alias("guess")
    counts = scratch.write(token_counts(docs, versions).select("doc_id", "source", "lang", copy, guess, *versions), "counts")
    first = counts.groupBy("copy").agg(F.min_by(F.struct("source", "lang", *versions), F.struct("doc_id", "source", "lang")).alias("x")).select("x.*")
    change = lambda df, op, version, tokens, old="null": df.selectExpr(f"'{op}' op", "source", "lang", f"'{version}' tokenizer_version", f"{tokens} tokens", f"cast({old} as long) old_tokens")
    rollup = TokenRollup(spark, f"{scratch.path}/state")
    one, two = versions
    revised = change(counts, "revise", one, one, "guess")
    rollup.commit("1-estimates", change(counts, "insert", one, "guess"))
    rollup.commit("2-revised", revised)
    rollup.commit("2-revised", revised)  # a batch that is sent again changes nothing
    rollup.commit("3-second", change(counts, "insert", two, two))
    rollup.compact()
    both = lambda df, op: change(df, op, one, one).unionByName(change(df, op, two, two))
    rollup.commit("4-copies", both(counts, "delete").unionByName(both(first, "insert")))
    return rollup.totals()


def op5_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_model import fit_folds, held_out, score

    docs = table(spark, sf_dir, "documents")
    model = fit_folds(docs, table(spark, sf_dir, "labels"))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import find_secrets

    return find_secrets(table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op8_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .set_join import SetJoin

    return SetJoin(table(spark, sf_dir, "documents")).members()


OP8_SQL = r"""
with recursive d as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (select distinct doc_id, array_to_string(w[i : i + 3], ' ') as sh from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.sh = b.sh and a.doc_id <> b.doc_id group by all),
l as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 85 * (a.n + b.n - c)),
r(doc_id, low) as (select doc_id, doc_id from d union select r.doc_id, l.y from r join l on l.x = r.low)
select r.doc_id, coalesce(any_value(n.n), 0) as n_shingles, min(low) as component_id from r left join n on n.doc_id = r.doc_id group by r.doc_id
"""


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_wrappers import extract_text

    return extract_text(table(spark, sf_dir, "pages"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("dk")


OP10_SQL = r"""
with d as (select doc_id, row_number() over () as k, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents),
b as (select item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from benchmark),
bw as (select distinct item_id, least(len(w), 10) as n, array_to_string(w[i : i + 9], ' ') as win from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from b where len(w) > 0)),
sizes as (select distinct n from bw),
dw as (select k, n, i, array_to_string(w[i : i + n - 1], ' ') as win from (select k, w, n, unnest(range(1, len(w) - n + 2)) as i from d, sizes where len(w) >= n)),
occ as (select distinct k, i, dw.n, dw.win, item_id from dw join bw on dw.win = bw.win and dw.n = bw.n),
hit as (select k, count(distinct p) as n_hit from (select k, unnest(range(i, i + n)) as p from occ) group by k),
its as (select k, count(distinct item_id) as n_items, array_to_string(list_sort(list_distinct(list(cast(item_id as varchar)))), ',') as ids from occ group by k)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, n_hit is not null as contaminated
from d left join hit on hit.k = d.k left join its on its.k = d.k
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat": op1_chat,
    "op2_packing": op2_packing,
    "op3_quality_rules": op3_quality_rules,
    "op4_token_rollup": op4_token_rollup,
    "op5_quality_model": op5_quality_model,
    "op6_secrets": op6_secrets,
    "op7_token_output": op7_token_output,
    "op8_set_join": op8_set_join,
    "op9_html": op9_html,
    "op10_decontamination": op10_decontamination,
}
ORACLE_SQL: dict[str, str] = {"op1_chat": OP1_SQL, "op8_set_join": OP8_SQL, "op10_decontamination": OP10_SQL}
