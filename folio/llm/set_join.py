"""Exact Jaccard self-join of word n-gram sets by universe partition and pigeonhole.

A set's shingles fall into m segments by hash. Two sets that link differ in at most H shingles, so with enough segments some
agree wholly (or but for one shingle). Which sets are compared is decided by keys of equal segments; each linked pair
shares a key, and each compared pair is verified on its whole sets.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import HELD, Scratch, alone, free_name, mix64, small_batches, strings

#: Rows of a side up to which it is broadcast, counted first; a row is two numbers.
BROADCAST_ROWS = 500_000
#: A key that so many classes hold is hot; a set skips its hot keys if its spare segments cover them.
HOT = 32
BITS = 1024
#: Tasks to which the rows of one component are dealt where component names are not broadcast.
SALTS = 16
#: Keys before a key by which a pair that was made already is told; any number is exact, more make fewer repeats.
KEYS_BEFORE = 12
#: Comparisons up to which the last pairs are made at once; more are made in slices of 64 parts, that end at these parts.
AT_ONCE, SLICES = 1_000_000, (1, 8, 64)
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_HAS_UPPER = re.compile("[A-Z]")
_U = np.uint64


@dataclass(frozen=True)
class Scheme:
    """Segments of one size band: m of them, whether one-deletion neighbours are indexed, and how many a set may skip."""

    m: int
    deletions: bool
    spare: int


class Bands:
    """Size bands such that sets of one linked pair lie in one band or in neighbouring ones; a set of band k uses the schemes k and k + 1."""

    def __init__(self, percent: int = 85):
        self.percent, self.edges = percent, [1]

    def band(self, n: int) -> int:
        while self.edges[-1] <= n:
            e = self.edges[-1]
            self.edges.append(max(e + 1, (e - 1) * 100 // self.percent + 1))
        return int(np.searchsorted(self.edges, n, "right")) - 1

    @lru_cache(maxsize=None)  # noqa: B019
    def scheme(self, k: int) -> Scheme:
        while len(self.edges) < k + 2:
            self.band(self.edges[-1])
        top, low = self.edges[k + 1] - 1, self.edges[max(k - 1, 0)]
        p = self.percent
        differ = (100 - p) * 2 * top // (100 + p)
        if differ == 0:
            return Scheme(1, False, 0)
        return min((self._allocate(differ, low, d) for d in (False, True)), key=lambda s: self._cost(s, low))

    @staticmethod
    def _allocate(differ: int, n: int, deletions: bool) -> Scheme:
        """The fewest segments whose thresholds (0, or 1 with deletions) cover `differ`, plus spare ones for those that stay empty."""
        need, spare = (math.ceil((differ + 1) / 2) if deletions else differ + 1), 1
        for _ in range(8):
            m = need + spare
            load = n / m
            thin = m * math.exp(-load) * (1 + load if deletions else 1)
            spare = math.ceil(thin + 2 * math.sqrt(thin)) + 1
        return Scheme(need + spare, deletions, spare)

    @staticmethod
    def _cost(s: Scheme, n: int) -> float:
        """Keys, and what chance agreements of small segments add: a shingle is taken to recur with odds 1 to 4 in like sets."""
        load = n / s.m
        keys = s.m + (n if s.deletions else 0)
        return keys * (1 + 1000 * 0.2 ** max(load - s.deletions, 0))


class _Hashes(dict):
    """Word, A-Z in lower case, to 64 bits; starts over once `limit` words are held."""

    def __init__(self, limit: int = 1_000_000):
        super().__init__({"": 0})
        self.limit = limit

    def __missing__(self, word: str) -> int:
        low = word.translate(_UPPER) if _HAS_UPPER.search(word) else word
        value = int.from_bytes(hashlib.blake2b(low.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") or 1
        if len(word) <= 64:
            if len(self) >= self.limit:
                self.clear()
                self[""] = 0
            self[word] = value
        return value


@lru_cache(maxsize=1)
def _hashes() -> _Hashes:
    return _Hashes()


HELD["hashes"] = _hashes.cache_clear


def shingles(text: str, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles; a shorter text's words are one shingle, no words none."""
    for c in "\t\n\v\f\r":
        if c in text:
            text = text.replace(c, " ")
    parts = text.split(" ")
    w = np.fromiter(map(_hashes().__getitem__, parts), np.uint64, len(parts))
    w = w[w != 0]
    if not len(w):
        return w
    size = min(n, len(w))
    odd = mix64(np.arange(1, size + 1, dtype=np.uint64)) | _U(1)
    total = np.zeros(len(w) - size + 1, np.uint64)
    for i in range(size):
        total += w[i : len(w) - size + 1 + i] * odd[i]
    return np.unique(mix64(total + _U(size)))


def keys(h: np.ndarray, k: int, scheme: Scheme) -> tuple[np.ndarray, int]:
    """Keys of the set's segments under scheme k, and the segments that it may yet skip (below 0: none is skipped)."""
    m = scheme.m
    segment = ((h >> _U(32)) * _U(m)) >> _U(32)
    order = np.argsort(segment, kind="stable")
    segment, value = segment[order], mix64(h ^ _U(0x9E3779B97F4A7C15))[order]
    starts = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
    sums, own = np.add.reduceat(value, starts), segment[starts]
    counts = np.diff(np.append(starts, len(segment)))
    own_salt = _U((k * 2 + 1) * 0x8CB92BA72F3D8DD7 & 0xFFFFFFFFFFFFFFFF)
    salt = lambda s: s * _U(0xD1B54A32D192ED03) + own_salt
    out = [sums + salt(own)]
    thin = m - len(own) + (int((counts == 1).sum()) if scheme.deletions else 0)
    skip = thin <= scheme.spare
    if scheme.deletions:
        use = np.repeat(counts > 1, counts) if skip else np.ones(len(segment), bool)
        out.append((np.repeat(sums, counts) - value + salt(segment))[use])
    if not skip:
        out.append(salt(np.setdiff1d(np.arange(m, dtype=np.uint64), own)))
    found = mix64(np.concatenate(out))
    return (np.unique(found) & ~_U(1)) | _U(k & 1), scheme.spare - thin


def class_key(h: np.ndarray) -> int:
    return int((mix64(h + _U(0x632BE59BD9B4E019)).sum(dtype=np.uint64) ^ _U(len(h))).astype(np.int64)) if len(h) else 0


def _index(n: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("hashes")
        bands = Bands(percent)
        for batch in batches:
            sizes, classes, bits, spare, lists = [], [], [], [[], []], []
            for text in strings(batch.column(1)):
                h = shingles(text, n)
                sizes.append(len(h))
                classes.append(class_key(h))
                bits.append(np.packbits(np.bincount((h & _U(BITS - 1)).astype(np.int64), minlength=BITS) & 1).view(np.int64))
                free, own = [0, 0], []
                if len(h):
                    k = bands.band(len(h))
                    for j in (k, k + 1):
                        found, free[j & 1] = keys(h, j, bands.scheme(j))
                        own.append(found)
                lists.append(np.concatenate(own).view(np.int64) if own else np.zeros(0, np.int64))
                for side in (0, 1):
                    spare[side].append(free[side])
            at = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
            sig = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int64)))
            wide = pa.ListArray.from_arrays(pa.array(np.arange(len(bits) + 1, dtype=np.int32) * (BITS // 64)), pa.array(np.concatenate(bits) if bits else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), wide, pa.array(spare[0], pa.int32()), pa.array(spare[1], pa.int32()), sig], names=["doc_id", "n", "ck", "bits", "spare0", "spare1", "sigs"])

    return run


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (sig, ck), sorted, to sig, ck, first and pos of each distinct class of the keys that two classes or more hold; what is held is one row."""
    last = first = None  # the open key's latest class and first class
    pos = 0
    for batch in batches:
        sig, ck = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(sig):
            continue
        same_key = np.concatenate([[last is not None and last[0] == sig[0]], sig[1:] == sig[:-1]])
        again = same_key & np.concatenate([[last is not None and last[1] == ck[0]], ck[1:] == ck[:-1]])
        keep = ~again
        sig, ck, same_key = sig[keep], ck[keep], same_key[keep]
        if not len(sig):
            continue
        run = np.cumsum(~same_key)
        starts = np.searchsorted(run, np.arange(run[0], run[-1] + 1))
        place = np.arange(len(sig)) - starts[run - run[0]]
        firsts = ck[starts][run - run[0]]
        if same_key[0]:  # the first run goes on from the batch before
            head = run == run[0]
            place[head] += pos + 1
            firsts[head] = first
        follow = place > 0
        heads = np.flatnonzero(place == 1)  # the first class is emitted once the second is seen
        out = [np.concatenate([sig[follow], sig[heads]]), np.concatenate([ck[follow], firsts[heads]]), np.concatenate([firsts[follow], firsts[heads]]), np.concatenate([place[follow], np.zeros(len(heads), np.int64)])]
        last, first, pos = (sig[-1], ck[-1]), firsts[-1], int(place[-1])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["sig", "ck", "first", "pos"])


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("hashes")
        for batch in batches:
            sets = [shingles(x, n) for x in strings(batch.column(1))]
            right = [class_key(h) == c for h, c in zip(sets, batch.column(0).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([h.tobytes() for h in sets], pa.binary())], names=["ck", "h"]).filter(pa.array(right, pa.bool_()))

    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                at = np.searchsorted(x, y)
                both = int((x[np.minimum(at, len(x) - 1)] == y).sum())
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """v, comp of every end of the edges (a, b): the smallest v that it reaches. Labels spread and jump until none changes."""
    both = edges.select(F.col("a").alias("v"), F.col("b").alias("u")).unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("u")))
    both = scratch.write(both.distinct(), f"{name}-edges")
    labels = scratch.write(both.groupBy("v").agg(F.least("v", F.min("u")).alias("comp")), f"{name}-0")
    step = 0
    while True:
        step += 1
        seen = both.join(bounded(labels.withColumnRenamed("v", "u")), "u").groupBy("v").agg(F.min("comp").alias("low"))
        low = labels.join(seen, "v").select("v", F.least("comp", "low").alias("next"), F.col("comp").alias("old"))
        up = labels.select(F.col("v").alias("next"), F.col("comp").alias("over"))
        new = scratch.write(low.join(bounded(up), "next", "left").select("v", F.least("next", "over").alias("comp"), "old"), f"{name}-{step}")
        if new.where("comp <> old").limit(1).count() == 0:
            return new.select("v", "comp")
        labels = new.select("v", "comp")


class SetJoin:
    """Links between documents whose sets of n-word shingles have a Jaccard similarity of percent / 100 or more.

    docs: doc_id, text (null: empty; other columns are not read). Documents with equal sets are one class; repeated rows
    stay rows of members(). A similarity that equals the bound links; a long text is one set, read whole; empty sets link
    with nothing; an empty table has no members. Classes and shingles are told apart by 64-bit hashes.
    """

    def __init__(self, docs: DataFrame, n: int = 4, percent: int = 85, hot: int = HOT):
        self.hot = hot
        small_batches(docs.sparkSession)
        self.docs, self.n, self.percent = docs.select(F.col("doc_id").cast("long"), "text"), n, percent
        self.scratch = Scratch(docs.sparkSession, "sets")
        write, rows = self.scratch.write, "doc_id long, n long, ck long, bits array<long>, spare0 int, spare1 int, sigs array<long>"
        self.index = write(self.docs.mapInArrow(_index(n, percent), rows), "index")
        exploded = self.index.where("n > 0").select(F.explode("sigs").alias("sig"), "ck").repartition("sig").sortWithinPartitions("sig", "ck")
        self.buckets = write(exploded.mapInArrow(_buckets, "sig long, ck long, first long, pos long"), "buckets")
        self.scratch.free_shuffles()
        self.classes = self.index.select("ck", "n", "bits", "spare0", "spare1").dropDuplicates(["ck"])

    def _cool(self) -> DataFrame:
        """Buckets without the hot keys of the sets whose spare segments cover all of theirs: those share another key with whatever they link to."""
        hot = self.scratch.write(self.buckets.where(F.col("pos") == self.hot).select("sig").distinct(), "hot")
        held = self.buckets.join(bounded(hot), "sig", "left_semi").select("sig", "ck").withColumn("side", F.col("sig").bitwiseAND(F.lit(1)))
        per = held.groupBy("ck", "side").agg(F.count("*").alias("hot"))
        free = self.classes.select("ck", F.posexplode(F.array("spare0", "spare1")).alias("side", "spare")).where("spare > 0")
        skips = self.scratch.write(per.join(free.withColumn("side", F.col("side").cast("long")), ["ck", "side"]).where("hot <= spare").select("ck", "side"), "skips")
        gone = self.scratch.write(held.join(bounded(skips), ["ck", "side"], "left_semi").select("sig", "ck"), "gone")
        return self.buckets.select("sig", "ck").join(bounded(gone), ["sig", "ck"], "left_anti")

    def _near(self, x: str = "x", y: str = "y"):
        """Whether sizes, and the parity bits of two sets, allow a link; both bounds hold for every linked pair."""
        both = F.col(f"{x}.n") + F.col(f"{y}.n")
        p = self.percent
        return (F.least(f"{x}.n", f"{y}.n") * 100 >= F.greatest(f"{x}.n", f"{y}.n") * p) & (self._differ(x, y) * (100 + p) <= both * (100 - p))

    @staticmethod
    def _differ(x: str = "x", y: str = "y"):
        """Parity bits in which two sets differ: at most as many as shingles that only one has."""
        return F.expr(" + ".join(f"bit_count({x}.bits[{i}] ^ {y}.bits[{i}])" for i in range(BITS // 64)))

    def _linked(self, pairs: DataFrame, sets: DataFrame, name: str) -> DataFrame:
        """Of the pairs (a, b), those whose sets link."""
        left = pairs.join(sets.select(F.col("ck").alias("a"), F.col("h").alias("ha")), "a")
        whole = left.join(sets.select(F.col("ck").alias("b"), F.col("h").alias("hb")), "b").select("a", "b", "ha", "hb")
        return self.scratch.write(whole.mapInArrow(_verify(self.percent), "a long, b long"), f"{name}-links")

    def _sets_of(self, classes: DataFrame, name: str) -> DataFrame:
        """The sets of classes (ck), each read once from its class's text."""
        who = self.index.select("ck", "doc_id").join(bounded(classes), "ck", "left_semi").groupBy("ck").agg(F.min("doc_id").alias("doc_id"))
        who = bounded(self.scratch.write(who.withColumnRenamed("doc_id", "who"), f"{name}-who"))
        texts = self.docs.join(who, F.col("doc_id").eqNullSafe(F.col("who")))
        return self.scratch.write(texts.select("ck", "text").mapInArrow(_sets(self.n), "ck long, h binary").dropDuplicates(["ck"]), f"{name}-sets")

    def _verified(self, pairs: DataFrame, name: str) -> DataFrame:
        pairs = self.scratch.write(pairs, f"{name}-pairs")
        ends = pairs.select(F.col("a").alias("ck")).unionByName(pairs.select(F.col("b").alias("ck"))).distinct()
        out = self._linked(pairs, self._sets_of(ends, name), name)
        self.scratch.drop(f"{name}-sets")
        return out

    def _split(self, held: DataFrame, name: str) -> DataFrame:
        """Of sig, ck, comp, the buckets that hold more than one component."""
        split = held.groupBy("sig").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("sig")
        return self.scratch.write(held.join(bounded(split), "sig", "left_semi"), name)

    def _heads(self, held: DataFrame, facts: DataFrame, turn: int) -> DataFrame:
        """Pairs (a, b) of each class with the likest head of its buckets in another component; a bucket's head changes with the turn."""
        heads = held.groupBy("sig").agg(F.min_by(F.struct("ck", "comp"), F.struct(F.xxhash64("ck", F.lit(turn)), "ck")).alias("head"))
        met = held.join(bounded(heads), "sig").where("comp <> head.comp").select("ck", F.col("head.ck").alias("head")).distinct()
        x, y = facts.alias("x"), facts.alias("y")
        near = met.join(x, F.col("x.ck") == met["ck"]).join(y, F.col("y.ck") == met["head"]).where(self._near())
        return near.groupBy(met["ck"]).agg(F.min_by(met["head"], F.struct(self._differ(), met["head"])).alias("b")).select(F.col("ck").alias("a"), "b")

    def class_components(self) -> DataFrame:
        """v, comp for the classes that link with another.

        First each class meets the class at the head of the bucket with which it shares most keys. Then, turn by turn, the
        buckets that hold several components get other heads, which their classes meet, as long as that joins an eighth of
        the components; at last every pair of one bucket that is not yet in one component is compared. Where those are
        many, a small part of them, dealt by hash, comes first: components that many pairs link are one after it, and the
        rest of their pairs is never made. Links are told as links of components, so that many like sets leave few of them.
        """
        write = self.scratch.write
        facts = self.classes.select("ck", "n", "bits")
        star = self.buckets.where("pos > 0").groupBy("ck", "first").agg(F.count("*").alias("shared"))
        best = star.groupBy("ck").agg(F.max_by("first", F.struct("shared", "first")).alias("first"))
        best = write(best, "star")
        x, y = facts.alias("x"), facts.alias("y")
        pairs = best.join(x, F.col("x.ck") == best["ck"]).join(y, F.col("y.ck") == best["first"]).where(self._near()).select(best["first"].alias("a"), best["ck"].alias("b"))
        comps = components(self._verified(pairs, "star"), self.scratch, "star")
        self.scratch.free_shuffles()
        held = self._cool().join(comps.withColumnRenamed("v", "ck"), "ck", "left").select("sig", "ck", F.coalesce("comp", "ck").alias("comp"))
        held = self._split(write(held, "cool"), "open")
        facts = write(facts.join(bounded(held.select("ck").distinct()), "ck", "left_semi"), "open-facts")
        turn, left = 0, held.select("comp").distinct().count()
        joined = left
        while joined * 8 >= left > 0:
            turn += 1
            links = self._verified(self._heads(held, facts, turn), f"turn{turn}")
            comps, held, joined = self._contract(comps, held, links, f"turn{turn}")
            left = held.select("comp").distinct().count()
        if not left:
            return comps
        many = held.groupBy("sig").count().agg(F.sum(F.expr("count * (count - 1) div 2"))).first()[0] > AT_ONCE
        low = 0
        for high in SLICES if many else SLICES[-1:]:
            links = self._verified(self._rest(held, facts, low, high), f"rest{high}")
            comps, held, _ = self._contract(comps, held, links, f"rest{high}")
            low = high
        return comps

    def _rest(self, held: DataFrame, facts: DataFrame, low: int, high: int) -> DataFrame:
        """Pairs (a, b) of one bucket and two components, of the parts from low to high - 1; a pair is in one part."""
        # a pair is made at the smallest key that both hold: elsewhere some of the keys before it is theirs too
        before = F.collect_list("sig").over(Window.partitionBy("ck").orderBy("sig").rowsBetween(-KEYS_BEFORE, -1))
        part = F.pmod(F.xxhash64("ck"), F.lit(SLICES[-1]))
        still = self.scratch.write(held.withColumn("before", before).withColumn("part", part).join(facts, "ck"), f"last{high}")
        x, y = still.alias("x"), still.alias("y")
        own = (F.col("x.part") + F.col("y.part")) % SLICES[-1]
        meet = (F.col("x.sig") == F.col("y.sig")) & (F.col("x.comp") < F.col("y.comp")) & (own >= low) & (own < high)
        return x.join(y, meet & self._near() & ~F.arrays_overlap("x.before", "y.before")).select(F.col("x.ck").alias("a"), F.col("y.ck").alias("b")).distinct()

    def _contract(self, comps: DataFrame, held: DataFrame, links: DataFrame, name: str) -> tuple[DataFrame, DataFrame, int]:
        """Components, and the buckets that still hold several, after the links of classes (a, b); and how many components are gone."""
        of = bounded(held.select("ck", "comp").distinct())
        edges = links.join(of.withColumnsRenamed({"ck": "a", "comp": "x"}), "a").join(of.withColumnsRenamed({"ck": "b", "comp": "y"}), "b").where("x <> y")
        edges = self.scratch.write(edges.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), f"{name}-joined")
        if edges.limit(1).count() == 0:
            return comps, held, 0
        merged = components(edges, self.scratch, name).select(F.col("v").alias("comp"), F.col("comp").alias("next"))
        gone = merged.where("comp <> next").count()
        merged = bounded(merged)
        renamed = lambda df: df.join(merged, "comp", "left").withColumn("comp", F.coalesce("next", "comp")).drop("next")
        alone = merged.select(F.col("comp").alias("v")).join(comps, "v", "left_anti").select("v", F.col("v").alias("comp"))
        comps = self.scratch.write(renamed(comps.unionByName(alone)).select("v", "comp"), f"{name}-comps")
        return comps, self._split(renamed(held).select("sig", "ck", "comp"), f"{name}-open"), gone

    def members(self) -> DataFrame:
        """doc_id, n_shingles, component_id of every row; an empty set is its own component."""
        comps = self.class_components()
        rows = self.index.select("doc_id", "n", "ck").join(comps.withColumnRenamed("v", "ck"), "ck", "left").select("doc_id", "n", F.coalesce("comp", "ck").alias("comp"))
        rows = self.scratch.write(rows, "rows")
        self.scratch.keep("rows")
        self.scratch.free_shuffles()
        low = rows.where("n > 0").groupBy("comp").agg(F.min("doc_id").alias("low"), F.count("*").alias("rows")).where("rows > 1").select("comp", "low")
        low = self.scratch.write(low, "low")
        if low.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
            out = rows.join(F.broadcast(low), "comp", "left")
        else:  # a large component's rows are dealt to many tasks
            salted = low.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            out = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, ["comp", "salt"], "left")
        return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("low", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_first(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """docs with the row of the smallest doc_id of each component only; of rows with equal doc_id and text one stays.

    Documents with different texts under one doc_id that head their components all stay, as do rows without doc_id, and
    those without words. Columns other than doc_id and text pass through, whatever their names; a long text is one set as
    any other; an empty table stays empty.
    """
    joined = SetJoin(docs, n, percent)
    first = free_name(docs.columns, "first")
    rows = joined.scratch.write(joined.members(), "members")
    ids = joined.scratch.write(rows.where("doc_id <=> component_id").select(F.col("doc_id").alias(first)).distinct(), "first")
    repeated = rows.groupBy("doc_id").count().where("count > 1").limit(1).count() > 0
    joined.scratch.keep("first")
    joined.scratch.free_shuffles()
    kept = docs.join(bounded(ids), docs["doc_id"].cast("long").eqNullSafe(ids[first]), "left_semi")
    return kept.dropDuplicates(["doc_id", "text"]) if repeated else kept
