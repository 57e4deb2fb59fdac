"""Folds over events, the same code for tables and streams; and list counters with state."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workers import importable


def _watermarked(events: DataFrame, late: str) -> DataFrame:
    """A stream's event times need a zone; without one they are taken in the session's."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def event_ledger(events: DataFrame, size: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Events (ts, event_type) counted by window; on a stream, rows later than `late` are dropped and windows close after it."""
    rows = _watermarked(events, late)
    return rows.groupBy(F.window("ts", size, slide or size).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").cast(events.schema["ts"].dataType).alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """Runs of a user's events with less than `gap` between them."""
    rows = _watermarked(events, late)
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def stream_table(spark, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream with the folder's schema."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def list_counters(rows: DataFrame, levels: int = 3) -> DataFrame:
    """doc_id, ord, marker for paragraphs (doc_id, ord, level) that arrive in document order, batch by batch.

    State is a document's counters and the last place seen; a row adds one to its level and clears the deeper ones. A row
    that comes after one of a later place fails the stream, as markers that were sent can't be taken back.
    """

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        counts, last = (list(state.get[0]), state.get[1]) if state.exists else ([0] * levels, None)
        rows = pd.concat(list(batches)).sort_values("ord")
        if last is not None and len(rows) and rows["ord"].iloc[0] < last:
            raise ValueError(f"paragraph {rows['ord'].iloc[0]} of document {key[0]} comes after {last}")
        out = []
        for o, level in zip(rows["ord"], rows["level"], strict=True):
            counts[level - 1] += 1
            counts[level:] = [0] * (levels - level)
            out.append((key[0], o, ".".join(str(max(c, 1)) for c in counts[:level]) + "."))
        state.update((counts, int(rows["ord"].iloc[-1])))
        yield pd.DataFrame(out, columns=["doc_id", "ord", "marker"])

    importable(rows.sparkSession)
    return rows.groupBy("doc_id").applyInPandasWithState(step, "doc_id long, ord long, marker string", "counts array<int>, last long", "append", "NoTimeout")


#: Issues and infos that are recorded, and samples of each code.
MOST_ISSUES, MOST_SAMPLES = 10_000, 4


def issue_totals(issues: DataFrame, most: int = MOST_ISSUES, samples: int = MOST_SAMPLES) -> DataFrame:
    """key, code, count, sample hashes (the first distinct ones, sorted), whether they are all, and whether all issues were recorded, after each batch of issues (key, code, detail).

    State is one key's counts and samples, so it stays small however many issues come; what is over the limit only clears `recorded`.
    """

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        total, held = (state.get[0], json.loads(state.get[1])) if state.exists else (0, {})
        whole = held.pop("", True)
        for code, detail in pd.concat(list(batches))[["code", "detail"]].itertuples(index=False):
            if total >= most:
                whole = False
                continue
            total += 1
            digest = hashlib.sha256((detail or "").encode()).hexdigest()
            count, seen, complete = held.get(code, (0, [], True))
            if digest not in seen:
                if len(seen) < samples:
                    seen = sorted([*seen, digest])
                else:
                    complete = False
            held[code] = (count + 1, seen, complete)
        state.update((total, json.dumps(held | {"": whole})))
        rows = [(key[0], code, count, seen, complete, whole) for code, (count, seen, complete) in held.items()]
        yield pd.DataFrame(rows, columns=["key", "code", "count", "samples", "complete", "recorded"])

    importable(issues.sparkSession)
    shape = "key long, code string, count long, samples array<string>, complete boolean, recorded boolean"
    return issues.groupBy("key").applyInPandasWithState(step, shape, "total long, held string", "update", "NoTimeout")
