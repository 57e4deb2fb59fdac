"""Token counts kept up to date by signed changes: additive totals by source, language and tokenizer version."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import small_batches
from .encoding import encoder

KEYS = ("source", "lang", "tokenizer_version")
SCHEMA = "source string, lang string, tokenizer_version string, docs long, tokens long"


def signed(changes: DataFrame) -> DataFrame:
    """Changes to signed deltas, one row a key.

    changes: op (insert, delete or revise), the keys, tokens, and old_tokens for a revision. Null keys are keys of their
    own, null counts are 0, other ops are refused by an error. Repeated rows count as often as they stand; other columns are
    not read; no changes give no rows. The map side adds up first, so a hot key is a few rows.
    """
    op, now, old = F.col("op"), F.coalesce("tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
    bad = F.raise_error(F.concat(F.lit("unknown op "), F.coalesce(op, F.lit("null"))))
    docs = F.when(op == "insert", 1).when(op == "delete", -1).when(op == "revise", 0).otherwise(bad.cast("int"))
    tokens = F.when(op == "insert", now).when(op == "delete", -now).otherwise(now - old)
    return changes.groupBy(*KEYS).agg(F.sum(docs).cast("long").alias("docs"), F.sum(tokens).cast("long").alias("tokens"))


class TokenRollup:
    """Committed batches of deltas under one folder.

    A batch's deltas are written first; then a marker, written aside and renamed to the batch's name, which works once only,
    names them. Committing a batch again, after a crash or a lost executor at any point, changes nothing. compact() writes
    the sum of the committed deltas and then, renamed likewise, a base that names it and the batches in it; deltas of the
    base before that are deleted, as readers may still have its own open.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        conf = spark._jsc.hadoopConfiguration()
        where = self._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = where.getFileSystem(conf)
        self._files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.makeQualified(where).toUri(), conf)

    def _at(self, name: str):
        return self._fs.makeQualified(self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}"))

    def _names(self, folder: str) -> list[str]:
        if not self._fs.exists(self._at(folder)):
            return []
        return sorted(status.getPath().getName() for status in self._fs.listStatus(self._at(folder)))

    def _read(self, name: str) -> list[str]:
        stream = self._fs.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode().split("\n")
        finally:
            stream.close()

    def _write(self, name: str, lines: list[str]) -> None:
        stream = self._fs.create(self._at(name), False)
        try:
            stream.write("\n".join(lines).encode())
        finally:
            stream.close()

    def _publish(self, name: str, lines: list[str]) -> bool:
        """Make a whole file under its name, if there is none."""
        aside = f"staging/{uuid.uuid4().hex}"
        self._write(aside, lines)
        self._fs.mkdirs(self._at(name).getParent())
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        try:
            self._files.rename(self._at(aside), self._at(name), options)
        except Exception as e:  # another attempt was first
            if "FileAlreadyExists" not in str(e):
                raise
            self._fs.delete(self._at(aside), False)
            return False
        return True

    def _base(self) -> tuple[int, str | None, dict[str, str]]:
        """The newest base: its number, the folder of its sums, and the folder of each batch in it."""
        names = self._names("bases")
        if not names:
            return 0, None, {}
        data, *lines = self._read(f"bases/{names[-1]}")
        return int(names[-1]), data, dict(x.split("\t") for x in lines)

    def _pending(self, held: dict[str, str]) -> dict[str, str]:
        """Batch to folder of the batches that are not in a base; only their markers are opened."""
        return {name: self._read(f"commits/{name}")[0] for name in self._names("commits") if name not in held}

    def committed(self) -> set[str]:
        return {unquote(name) for name in self._names("commits")}

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch of changes once; False if it is there already."""
        marker = f"commits/{quote(batch, safe='')}"
        if self._fs.exists(self._at(marker)):
            return False
        data = f"deltas/{uuid.uuid4().hex}"
        signed(changes).write.parquet(f"{self.path}/{data}")
        if self._publish(marker, [data]):
            return True
        self._fs.delete(self._at(data), True)
        return False

    def compact(self) -> None:
        """Sum the committed deltas into one table; totals() stay the same at every moment."""
        number, before, held = self._base()
        pending = self._pending(held)
        if not pending:
            return
        data = f"deltas/{uuid.uuid4().hex}"
        self._sums(before, pending).write.parquet(f"{self.path}/{data}")
        if self._publish(f"bases/{number + 1:08d}", [data, *(f"{name}\t{folder}" for name, folder in sorted((held | pending).items()))]):
            older = [self._read(f"bases/{number - 1:08d}")[0]] if number > 1 else []
            for folder in {*held.values(), *older}:
                self._fs.delete(self._at(folder), True)
        else:
            self._fs.delete(self._at(data), True)

    def _sums(self, base: str | None, pending: dict[str, str]) -> DataFrame:
        names = sorted({*pending.values(), *([base] if base else [])})
        rows = self.spark.read.schema(SCHEMA).parquet(*(f"{self.path}/{d}" for d in names)) if names else self.spark.createDataFrame([], SCHEMA)
        return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))

    def totals(self) -> DataFrame:
        """Additive totals of all committed batches; keys whose documents and tokens are all gone are left out."""
        _, base, held = self._base()
        return self._sums(base, self._pending(held)).where("docs <> 0 or tokens <> 0")


def token_counts(docs: DataFrame, tokenizers: dict[str, str]) -> DataFrame:
    """docs with a column for each tokenizer version, name to file: the ids of text (null: empty) by the library's plain call.

    Other columns pass through; a version's name must differ from theirs. Repeated rows are counted each; a long text is
    counted whole; an empty table stays empty.
    """
    small_batches(docs.sparkSession)
    at = [c.lower() for c in docs.columns].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [pa.array(np.concatenate([n for _, n in encoder(path).parts(batch.column(at))] or [np.zeros(0, np.int64)])) for path in tokenizers.values()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *counts], names=[*batch.schema.names, *tokenizers])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *(StructField(name, LongType()) for name in tokenizers)]))
