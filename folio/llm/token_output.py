"""Token-ID output: Parquet list columns in ascending document order, written and read by Spark."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, small_batches
from .encoding import encoder

#: Row groups of 16 MB, pages of at most 64 KB and 500 rows with column indexes; ids are dictionary-encoded, offsets delta-encoded.
FORMAT = {
    "parquet.block.size": str(16 << 20), "parquet.page.size": str(64 << 10), "parquet.page.row.count.limit": "500",
    "parquet.enable.dictionary": "true", "parquet.dictionary.page.size": str(1 << 20), "parquet.writer.version": "PARQUET_2_0",
}
_SCHEMA = "doc_id long, shard int, shard_start long, n_tokens long, ids array<int>"
_ARROW = pa.schema([("doc_id", pa.int64()), ("shard", pa.int32()), ("shard_start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard, before = encoder(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            at = 0
            for ids, n in enc.parts(batch.column(1), end_id):
                ends = np.cumsum(n)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(n)), pa.array(np.full(len(n), shard, np.int32)), pa.array(before + ends - n), pa.array(n), lists], schema=_ARROW)
                before, at = before + int(ends[-1]), at + len(n)

    return run


def write_token_files(docs: DataFrame, scratch: Scratch, tokenizer: str, end_id: int = 2, table: str = "tokens") -> DataFrame:
    """Encode doc_id and text (null: empty), append end_id, write one sorted file a range of doc_id; returns the files' table.

    shard is the file's place in ascending doc_id order, shard_start the ids before the document in its file. Rows that
    repeat a doc_id stay, ordered by a hash of their texts, then by text. A null doc_id comes first; a long text is one row,
    encoded whole. Other columns of docs are not read; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    keys = ("doc_id", F.xxhash64("text"))
    sorted_docs = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(*keys).sortWithinPartitions(*keys, "text")
    return scratch.write(sorted_docs.mapInArrow(_encode(tokenizer, end_id), _SCHEMA), table, **FORMAT)


def with_starts(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Add start, the ids of all documents before each one, to rows of the files: sums a file, read from its counts alone, then a running sum over the few file rows."""
    sums = files.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    base = sums.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    return rows.join(base, "shard").withColumn("start", F.col("base") + F.col("shard_start"))


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(4)
        at = lists.offsets.to_numpy()
        ids = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
        crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(crc, pa.int64())], names=["doc_id", "shard", "shard_start", "n_tokens", "ids_crc32"])


def token_digests(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids as little-endian 32-bit integers, from the written files."""
    rows = files.select("doc_id", "shard", "shard_start", "n_tokens", "ids").mapInArrow(_checksums, "doc_id long, shard int, shard_start long, n_tokens long, ids_crc32 long")
    return with_starts(rows, files).select("doc_id", "start", "n_tokens", "ids_crc32")


def read_tokens(files: DataFrame, low: int, high: int) -> DataFrame:
    """Ids of the documents with low <= doc_id < high; the filter prunes files, row groups and pages."""
    return files.where((F.col("doc_id") >= low) & (F.col("doc_id") < high)).select("doc_id", "ids")
