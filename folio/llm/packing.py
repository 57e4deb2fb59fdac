"""Lexical retrieval packing: each shard's BM25 index fills a seed document's window with its unused neighbours."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, alone, mix64, small_batches
from .encoding import encoder

#: A shard ends with the document that brings it to so many tokens or documents, which bound its index and plan.
SHARD_TOKENS, SHARD_DOCS = 4_000_000, 100_000
#: Tokens whose postings are made at once.
BLOCK_TOKENS = 500_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def places(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Min-hash of each document's pairs of neighbouring ids, without its last one, the end; of its id if it has one, 0 if none."""
    starts = np.cumsum(sizes) - sizes
    own = ids.astype(np.uint64)
    pairs = mix64(own * np.uint64(1 << 20) + np.append(own[1:], np.uint64(0)))
    pairs[starts + sizes - 1] = np.iinfo(np.uint64).max
    pairs[(starts + sizes - 2)[sizes > 2]] = np.iinfo(np.uint64).max
    one = starts[sizes == 2]
    pairs[one] = mix64(own[one] + np.uint64(1 << 50))
    low = np.minimum.reduceat(pairs, starts) >> np.uint64(1)
    return np.where(sizes > 1, low, np.uint64(0)).astype(np.int64)


def _tokenize(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("encoder")
        enc = encoder(path)
        for batch in batches:
            at = 0
            for ids, sizes in enc.parts(batch.column(1), end_id):
                ends = np.concatenate([[0], np.cumsum(sizes)]) * enc.dtype.itemsize
                packed = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(sizes)), pa.array(places(ids, sizes)), pa.array(sizes), packed], names=["doc_id", "place", "n", "ids"])
                at += len(sizes)

    return run


class Bm25:
    """Inverted index of one shard over token ids: document d has the ids from at[d] to at[d + 1] - 1, the last of which, the end, is no term."""

    def __init__(self, ids: np.ndarray, at: np.ndarray, k1: float = 1.2, b: float = 0.75):
        n = self.n = len(at) - 1
        terms, owners, counts = [], [], []
        cuts = np.unique([0, *np.searchsorted(at, np.arange(BLOCK_TOKENS, at[-1], BLOCK_TOKENS)), n])
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            owner = np.repeat(np.arange(low, high), np.diff(at[low : high + 1]))
            key = owner << 32 | ids[at[low] : at[high]]
            key, count = np.unique(np.delete(key, at[low + 1 : high + 1] - 1 - at[low]), return_counts=True)
            terms.append((key & 0xFFFFFFFF).astype(ids.dtype))
            owners.append((key >> 32).astype(np.int32))
            counts.append(count.astype(np.float32))
        term, owner, tf = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (terms, owners, counts))
        del terms, owners, counts
        df = np.bincount(term, minlength=1)
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        length = np.diff(at) - 1
        norm = k1 * (1 - b + b * length / max(float(length.mean()) if n else 1.0, 1.0))
        weight = idf[term].astype(np.float32) * tf * np.float32(k1 + 1) / (tf + norm.astype(np.float32)[owner])
        self.own, self.own_at = term, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])
        order = np.argsort(term, kind="stable")
        self.term = term[order]
        #: Owner and weight side by side in eight bytes, so that lists are joined once.
        self.posts = np.stack([owner[order].astype(np.int32), weight[order].astype(np.float32).view(np.int32)], 1).view(np.int64)[:, 0]
        self._lists(len(df))

    def _lists(self, terms: int) -> None:
        self.at = np.concatenate([[0], np.cumsum(np.bincount(self.term, minlength=terms))])

    def forget(self, free: np.ndarray) -> None:
        """Leave only the postings of free documents; weights stay what they are."""
        keep = free[self.posts.view(np.int32)[::2]]
        self.term, self.posts = self.term[keep], self.posts[keep]
        self._lists(len(self.at) - 1)

    def ranked(self, doc: int, free: np.ndarray) -> np.ndarray:
        """Free documents other than doc that share a term with it, best first, ties by place."""
        own = self.own[self.own_at[doc] : self.own_at[doc + 1]]
        low, high = self.at[own], self.at[own.astype(np.int64) + 1]
        own = np.flatnonzero(high - low > 0)
        if not len(own):
            return own
        posts = np.concatenate([self.posts[a:b] for a, b in zip(low[own].tolist(), high[own].tolist(), strict=True)])
        owner, weight = posts.view(np.int32)[::2], posts.view(np.float32)[1::2]
        if len(owner) * 4 < self.n:
            found, owner = np.unique(owner, return_inverse=True)
            score = np.bincount(owner, weight)
        else:
            score = np.bincount(owner, weight, self.n)
            found = np.flatnonzero(score)
            score = score[found]
        keep = free[found] & (found != doc)
        return found[keep][np.argsort(-score[keep], kind="stable")]


def plan(ids: np.ndarray, at: np.ndarray, window: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece; the last tokens go to sequences of powers of two, so nothing is padded."""
    index = Bm25(ids, at)
    size = np.diff(at).tolist()
    free, held, indexed = np.ones(len(size), bool), len(size), len(size)
    left = int(at[-1])
    sequence, offset, doc, start, cursor = 0, 0, -1, 0, 0
    room = min(window, 1 << (left.bit_length() - 1)) if left else 0
    queue: Iterator[int] = iter(())
    seed = -1

    def neighbours(d: int) -> Iterator[int]:
        nonlocal indexed
        if held * 2 < indexed:
            index.forget(free)
            indexed = held
        return iter(index.ranked(d, free).tolist())

    while left:
        if doc < 0:
            doc, start = next((d for d in queue if free[d]), -1), 0
            if doc < 0:
                while not free[cursor]:
                    cursor += 1
                doc, seed = cursor, cursor
                queue = iter(()) if size[doc] >= room - offset else neighbours(doc)
            free[doc] = False
            held -= 1
        take = min(size[doc] - start, room - offset)
        yield doc, start, take, sequence, offset
        start, offset, left = start + take, offset + take, left - take
        done = start == size[doc]
        if offset == room:
            sequence, offset = sequence + 1, 0
            room = min(window, 1 << (left.bit_length() - 1)) if left else 0
            if done:
                queue = iter(())
            elif size[doc] - start < room:  # what the cut left over is the next window's seed
                seed, queue = doc, neighbours(doc)
        if done:
            doc = -1


def _pack(window: int, dtype: str, shard_tokens: int):
    def shard(names: list[pa.Array], ids: list[np.ndarray], sizes: list[np.ndarray], base: int) -> Iterator[tuple[pa.RecordBatch, int]]:
        """Pieces of one shard, and the sequences up to the last of them."""
        doc_id, tokens = pa.concat_arrays(names).to_pylist(), np.concatenate(sizes)
        flat, at = np.concatenate(ids), np.concatenate([[0], np.cumsum(tokens)])
        names.clear(), ids.clear(), sizes.clear()
        rows: list[tuple[int, int, int, int, int]] = []

        def emit() -> tuple[pa.RecordBatch, int]:
            crc = [zlib.crc32(flat[at[d] + a : at[d] + a + n].astype("<u4").tobytes()) for d, a, n, _, _ in rows]
            d, a, n, s, o = (list(x) for x in zip(*rows, strict=True))
            columns = [[doc_id[x] for x in d], a, n, crc, [int(tokens[x]) for x in d], [base + x for x in s], o]
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]), base + s[-1] + 1

        for row in plan(flat, at, window):
            rows.append(row)
            if len(rows) == 10_000:
                yield emit()
        if rows:
            yield emit()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()
        names, ids, sizes, tokens, docs, base = [], [], [], 0, 0, TaskContext.get().partitionId() << 32
        width = np.dtype(dtype).itemsize
        for batch in batches:
            column = batch.column(1)
            ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] // width
            flat, at = np.frombuffer(column.buffers()[2] or b"", dtype, int(ends[-1]) if len(column) else 0), 0
            while at < len(column):  # up to the document that fills the shard
                to = min(at + SHARD_DOCS - docs, at + 1 + int(np.searchsorted(ends[at + 1 :], ends[at] + shard_tokens - tokens)), len(column))
                names.append(batch.column(0).slice(at, to - at))
                ids.append(flat[ends[at] : ends[to]].copy())
                sizes.append(np.diff(ends[at : to + 1]).astype(np.int64))
                tokens, docs, at = tokens + int(ends[to] - ends[at]), docs + to - at, to
                if tokens >= shard_tokens or docs >= SHARD_DOCS:
                    for out, base in shard(names, ids, sizes, base):  # noqa: B020
                        yield out
                    tokens = docs = 0
        if docs:
            yield from (out for out, _ in shard(names, ids, sizes, base))

    return run


def pack(docs: DataFrame, tokenizer: str, window: int = 4096, end_id: int = 2, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Pieces of the documents' ids (text null: empty; end_id last) in sequences of at most `window` tokens.

    Documents go in order of a min-hash of id pairs, so that likely neighbours, copies first, are near; runs of them with
    shard_tokens tokens, or SHARD_DOCS documents, are shards, whatever their sizes: a group of copies of any size is cut,
    and a longer text is a shard's last. Each document is a row: repeated rows are packed as often, ties go by doc_id and
    ids. Nothing is dropped or padded: a shard's end goes to sequences of powers of two. Columns other than doc_id and text
    are not read; an empty table gives no pieces.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "packing")
    dtype = encoder(tokenizer).dtype.str
    tokens = scratch.write(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_tokenize(tokenizer, end_id), "doc_id long, place long, n long, ids binary"), "ids")
    total = tokens.agg(F.sum("n")).first()[0] or 0
    parts = max(1, math.ceil(total / shard_tokens))
    placed = tokens.repartitionByRange(parts, "place", "doc_id", "n").sortWithinPartitions("place", "doc_id", "n", "ids")
    return placed.select("doc_id", "ids").mapInArrow(_pack(window, dtype, shard_tokens), PIECES)
