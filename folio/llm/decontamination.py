"""Benchmark decontamination: a positional inverted index of the documents' words that tests hold.

DataFrame operations only. Postings are written once; a phrase starts from the list of its rarest word, other lists are
intersected at their offsets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, free_name

WINDOW_WORDS = 10
#: Rows of a side up to which it is broadcast; counted first, beyond it the join is shuffled. A row is under 100 bytes.
BROADCAST_ROWS = 500_000
#: Bytes of the terms up to which they are broadcast.
BROADCAST_BYTES = 64 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: str = "text"):
    """Words of a text, A-Z in lower case: runs of digits, a-z and characters beyond ASCII; null has none."""
    t = F.coalesce(F.col(text), F.lit(""))
    lowered = F.when(F.length(t) == F.octet_length(t), F.lower(t)).otherwise(F.translate(t, _UPPER, _LOWER))
    return F.array_remove(F.split(lowered, _BETWEEN), "")


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if it is counted to have at most so many rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def item_windows(items: DataFrame, n: int = WINDOW_WORDS) -> DataFrame:
    """item_id, wid, terms: n consecutive words each, all words of a shorter item; items without words have none."""
    w = items.select("item_id", words().alias("w")).where(F.size("w") > 0)
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (n - 1))))
    return w.select("item_id", "w", at.alias("i")).select("item_id", F.slice("w", F.col("i"), n).alias("terms")).select("item_id", F.xxhash64(F.array_join("terms", " ")).alias("wid"), "terms").distinct()


def mark(word: str):
    """A byte that stands for a word; no word is 0."""
    return F.when(F.col(word) == "", 0).otherwise(F.pmod(F.xxhash64(word), F.lit(255)) + 1).cast("short")


class PositionalIndex:
    """Postings (dk, pos, tid, before, after) of the words in a vocabulary, positions from 0, written to the shared folder.

    before and after are the marks of the neighbouring words: a list is thinned by them where it is read.

    dk names a row of docs by doc_id and text; rows that repeat both share it. Each row also leaves a posting of the empty
    term at -1 with its number of words, so that the documents need no second reading.
    """

    def __init__(self, docs: DataFrame, vocabulary: DataFrame):
        self.scratch = Scratch(docs.sparkSession, "postings")
        terms = vocabulary.select("term").distinct()
        self.terms = self.scratch.write(terms.select("term", F.xxhash64("term").alias("tid")), "terms")
        own = self.terms.unionByName(docs.sparkSession.sql("select '' as term, 0L as tid"))
        size = self.terms.agg(F.count("*"), F.sum(F.octet_length("term"))).first()
        if size[0] <= BROADCAST_ROWS and (size[1] or 0) <= BROADCAST_BYTES:
            own = F.broadcast(own)
        rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))).alias("dk"), words().alias("w"))
        none = F.array(F.lit(""))
        trios = F.arrays_zip(F.concat(none, F.col("w")).alias("term"), F.concat(F.col("w"), none).alias("after"), F.concat(none, none, F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0)))).alias("before"))
        each = rows.select("doc_id", "dk", F.size("w").alias("n_words"), F.posexplode(trios).alias("p", "x")).select("doc_id", "dk", "n_words", "p", "x.term", "x.before", "x.after")
        found = each.join(own, "term").select(
            "dk", F.when(F.col("tid") == 0, F.col("doc_id")).alias("doc_id"), F.when(F.col("tid") == 0, F.col("n_words")).alias("n_words"), (F.col("p") - 1).alias("pos"), "tid",
            F.when(F.col("tid") != 0, mark("before")).alias("before"), F.when(F.col("tid") != 0, mark("after")).alias("after"),
        )
        self.postings = self.scratch.write(found, "postings")

    def documents(self) -> DataFrame:
        return self.postings.where("tid = 0").select("dk", "doc_id", "n_words")

    def lists(self) -> DataFrame:
        return self.postings.where("tid <> 0").select("dk", "pos", "tid")

    def frequencies(self) -> DataFrame:
        return self.lists().groupBy("tid").agg(F.count("*").alias("df"))

    def _ranked(self, phrases: DataFrame) -> DataFrame:
        """wid, n, off, tid, rank: the words of the phrases that can occur, from the rarest."""
        each = phrases.select("wid", "terms").dropDuplicates(["wid"]).select("wid", "terms", F.size("terms").alias("n"), F.posexplode("terms").alias("off", "term"))
        beside = lambda d: F.coalesce(F.get("terms", F.col("off") + d), F.lit(""))
        each = each.select("wid", "n", "off", "term", beside(-1).alias("l"), beside(1).alias("r")).select("wid", "n", "off", F.xxhash64("term").alias("tid"), mark("l").alias("l"), mark("r").alias("r"))
        each = each.join(bounded(self.scratch.write(self.frequencies(), "frequencies")), "tid")
        by = Window.partitionBy("wid")
        return each.withColumn("known", F.count("*").over(by)).where("known = n").withColumn("rank", F.row_number().over(by.orderBy("df", "off"))).select("wid", "n", "off", "tid", "rank", "l", "r")

    def _candidates(self, ranked: DataFrame, adjacent: bool = True) -> DataFrame:
        """wid, n, dk, start: the offset-adjusted list of each phrase's rarest word, between the phrase's neighbours unless they may be apart."""
        first = bounded(ranked.where("rank = 1").select("wid", "n", "off", F.col("tid").alias("first"), "l", "r"))
        lists = self.postings.where("tid <> 0")
        fits = (F.col("tid") == F.col("first")) & (F.lit(not adjacent) | (F.col("l").isin(0) | (F.col("l") == F.col("before"))) & (F.col("r").isin(0) | (F.col("r") == F.col("after"))))
        found = lists.join(first, fits).select("dk", (F.col("pos") - F.col("off")).alias("start"), "wid", "n")
        if adjacent:
            found = found.where("start >= 0")
        return self.scratch.write(found.distinct(), "candidates")

    def phrases(self, phrases: DataFrame) -> DataFrame:
        """dk, start, n, wid of each exact occurrence of the phrases (wid, terms)."""
        ranked = self.scratch.write(self._ranked(phrases), "ranked")
        candidates = self._candidates(ranked)
        near = self.lists().join(bounded(candidates.select("dk").distinct()), "dk", "left_semi")
        near = self.scratch.write(near.distinct(), "near")
        found = candidates
        # the second rarest word's list thins the candidates before the rest are intersected
        second = bounded(ranked.where("rank = 2").select("wid", F.col("off").alias("off2"), F.col("tid").alias("tid2")))
        single = found.where("n = 1")
        pairs = found.where("n > 1").join(second, "wid").withColumn("pos", F.col("start") + F.col("off2")).join(near.withColumnRenamed("tid", "tid2"), ["dk", "pos", "tid2"], "left_semi").select("dk", "start", "wid", "n")
        rest = bounded(ranked.where("rank > 2").select("wid", "off", "tid"))
        wide = pairs.where("n > 2").join(rest, "wid").withColumn("pos", F.col("start") + F.col("off"))
        whole = wide.join(near, ["dk", "pos", "tid"], "left_semi").groupBy("dk", "start", "wid", "n").agg(F.count("*").alias("met")).where("met = n - 2")
        return single.select("dk", "start", "n", "wid").unionByName(pairs.where("n = 2").select("dk", "start", "n", "wid")).unionByName(whole.select("dk", "start", "n", "wid"))

    def proximity(self, phrases: DataFrame, slop: int) -> DataFrame:
        """dk, wid, near: where a phrase would start by its rarest word, with every other word of it at most slop words off its place; down to -slop at a document's start."""
        ranked = self.scratch.write(self._ranked(phrases), "ranked_near")
        candidates = self._candidates(ranked, adjacent=False)
        near = self.lists().join(bounded(candidates.select("dk").distinct()), "dk", "left_semi")
        at = candidates.join(bounded(ranked.where("rank > 1").select("wid", "off", "tid")), "wid")
        at = at.select("dk", "wid", "n", "start", "tid", "off", F.explode(F.sequence(F.col("start") + F.col("off") - slop, F.col("start") + F.col("off") + slop)).alias("pos"))
        met = at.join(near, ["dk", "pos", "tid"], "left_semi").groupBy("dk", "wid", "n", "start").agg(F.count_distinct("off").alias("met")).where("met = n - 1")
        lone = candidates.where("n = 1").select("dk", "wid", "start")
        return met.select("dk", "wid", "start").unionByName(lone).withColumnRenamed("start", "near")


def contamination(docs: DataFrame, items: DataFrame, n: int = WINDOW_WORDS) -> DataFrame:
    """A row for each row of docs: n_words, n_hit, n_items, items_sha256, contaminated, and its key dk.

    docs: doc_id, text; items: item_id, text; null texts have no words, other columns are not read. Items whose ids are
    null count as the item "". Repeated rows get a row each with the same result; items that share a window are all found;
    a long text is read whole, its postings lie in as many rows. Without items, or documents, nothing is hit.
    """
    return _contamination(docs, items, n)[0]


def _contamination(docs: DataFrame, items: DataFrame, n: int) -> tuple[DataFrame, PositionalIndex]:
    windows = item_windows(items, n)
    index = PositionalIndex(docs, windows.select(F.explode("terms").alias("term")))
    windows = index.scratch.write(windows, "windows")
    found = index.scratch.write(index.phrases(windows), "found")
    spans = found.select("dk", "start", (F.col("start") + F.col("n")).alias("end")).distinct()
    before = F.max("end").over(Window.partitionBy("dk").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    hit = spans.withColumn("before", before).groupBy("dk").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce("before", "start")))).alias("n_hit"))
    ids = found.select("dk", "wid").distinct().join(bounded(windows.select("wid", F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item")).distinct()), "wid")
    ids = ids.groupBy("dk").agg(F.collect_set("item").alias("items"))
    marks = index.scratch.write(hit.join(ids, "dk"), "hits")
    index.scratch.drop("near")
    index.scratch.drop("candidates")
    out = index.documents().join(marks, "dk", "left")
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    out = out.select(
        "doc_id", F.col("n_words").cast("long"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items_of).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array(items_of), ","), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"), "dk",
    )
    return out, index


def drop_contaminated(docs: DataFrame, items: DataFrame, n: int = WINDOW_WORDS) -> DataFrame:
    """docs without the rows that hold a test window.

    A null or empty text holds none and stays; equal rows go or stay together, whatever their number; columns other than
    doc_id and text pass through, whatever their names; a long text is read whole. Without items all rows stay; an empty
    table stays empty.
    """
    marked, index = _contamination(docs, items, n)
    bad = Scratch(docs.sparkSession, "contaminated").write(marked.where("contaminated").select("dk").distinct(), "dk")
    index.scratch.keep()
    index.scratch.free_shuffles()
    name = free_name(docs.columns, "dk")
    key = F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")))
    return docs.withColumn(name, key).join(bounded(bad.withColumnRenamed("dk", name)), name, "left_anti").select(*docs.columns)
