"""Ledgers, multiset differences, issue buckets and rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Names of one block of a manifest.
BLOCK = 1000

#: Distinct samples that an issue bucket keeps: the first seen, shown in order of value.
SAMPLES = 4


def removed(source: DataFrame, output: DataFrame, key: str, *part: str) -> DataFrame:
    """How many of each key source has more often than output; counts are made before the join, so a hot key is a row a side."""
    a = source.groupBy(*part, key).agg(F.count("*").alias("a"))
    b = output.groupBy(*part, key).agg(F.count("*").alias("b"))
    return a.join(b, [*part, key], "left").select(*part, key, (F.col("a") - F.coalesce("b", F.lit(0))).alias("removed")).where("removed > 0")


def merge_events(*ledgers: DataFrame) -> DataFrame:
    """Events (code, resource, disposition, count) of several ledgers, summed."""
    out = ledgers[0]
    for other in ledgers[1:]:
        out = out.unionByName(other)
    return out.groupBy("code", "resource", "disposition").agg(F.sum("count").alias("count"))


def container_diff(source: DataFrame, output: DataFrame) -> DataFrame:
    """Entries (name, hash) that are gone or changed."""
    both = source.join(output.withColumnRenamed("hash", "new"), "name", "left")
    return both.select("name", F.when(F.col("new").isNull(), "removed").when(F.col("new") != F.col("hash"), "changed").alias("status")).where("status is not null")


def issue_buckets(issues: DataFrame) -> DataFrame:
    """Issues (code, ord, detail) by code: count, hashes of the first SAMPLES distinct details, whether those are all."""
    per = issues.groupBy("code", F.sha2("detail", 256).alias("h")).agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    rank = F.row_number().over(Window.partitionBy("code").orderBy("first", "h"))
    kept = per.withColumn("k", rank)
    return kept.groupBy("code").agg(F.sum("n").alias("count"), F.array_sort(F.collect_list(F.when(F.col("k") <= SAMPLES, F.col("h")))).alias("samples"), (F.max("k") <= SAMPLES).alias("complete"))


def coverage(buckets: DataFrame, codes: dict[str, str]) -> DataFrame:
    """Counts of some codes as columns of one row."""
    return buckets.agg(*(F.coalesce(F.sum(F.when(F.col("code") == c, F.col("count"))), F.lit(0)).alias(name) for name, c in codes.items()))


def count_rule(observed: Column, low: int | None, high: int | None) -> Column:
    """Reasons of a count out of bounds."""
    reasons = [F.when(observed < low, "below_minimum")] if low is not None else []
    reasons += [F.when(observed > high, "above_maximum")] if high is not None else []
    return F.array_compact(F.array(*reasons)) if reasons else F.array().cast("array<string>")


def presence_rule(present: Column, mode: str) -> Column:
    """Status under deny, require or allow; an unknown presence fails both."""
    if mode == "allow":
        return F.lit("passed")
    return F.when(present.isNull(), "failed").when(present == (mode == "require"), "passed").otherwise("failed")


def named_set_rule(observed: DataFrame, part: str, name: str, allowed: list[str], required: list[str]) -> DataFrame:
    """Reasons for names that are not allowed, and for required ones that lack, a row for each part."""
    own = observed.groupBy(part).agg(F.collect_set(name).alias("_n"))
    ok, must = F.array(*map(F.lit, allowed)), F.array(*map(F.lit, required))
    reasons = F.array_compact(F.array(F.when(F.size(F.array_except("_n", ok)) > 0, "not_allowed"), F.when(F.size(F.array_except(must, "_n")) > 0, "required_missing")))
    return own.select(part, reasons.alias("reasons"))


def overall_status(local_failed: Column, mode: Column, oracle: Column) -> Column:
    return (
        F.when(local_failed, "failed").when((mode == "disabled") | (oracle == "passed"), "passed").when((mode == "required") & (oracle == "unavailable"), "partial")
        .when((mode == "optional") & (oracle == "failed"), "partial").when((mode == "optional") & (oracle == "unavailable"), "passed").otherwise("failed")
    )


def budget(entries: DataFrame, part: str, size: str, packed: str, limits: dict[str, float]) -> DataFrame:
    """Limits that a container's entries break: entries, entry_bytes, total_bytes, ratio."""
    facts = entries.groupBy(part).agg(F.count("*").alias("entries"), F.max(size).alias("entry_bytes"), F.sum(size).alias("total_bytes"), F.max(F.col(size) / F.greatest(F.col(packed), F.lit(1))).alias("ratio"))
    return facts.select(part, F.array_compact(F.array(*(F.when(F.col(k) > v, k) for k, v in limits.items()))).alias("broken"))


def capped(rows: DataFrame, part: str, order: str, size: str, count: int, total: int) -> DataFrame:
    """The first rows of each part while they are at most `count` and their sizes at most `total`."""
    over = Window.partitionBy(part).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(over)).withColumn("_b", F.sum(size).over(over.rowsBetween(Window.unboundedPreceding, 0))).where((F.col("_n") <= count) & (F.col("_b") <= total)).drop("_n", "_b")


def manifest(artifacts: DataFrame, part: str, name: str, digest: str, size: str) -> DataFrame:
    """artifacts, bytes and a digest of each part's artifacts (whole number `name`, their digest, size).

    Names are hashed in blocks of BLOCK and the blocks' hashes once more, so that no task holds all artifacts of a part.
    """
    joined = lambda key, value: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda x: x["v"]), ",")
    line = F.concat(F.col(name), F.lit(":"), F.col(digest)).alias("v")
    blocks = artifacts.groupBy(part, F.floor(F.col(name) / BLOCK).alias("_b")).agg(F.count("*").alias("_n"), F.sum(size).alias("_s"), F.sha2(joined(name, line), 256).alias("v"))
    return blocks.groupBy(part).agg(F.sum("_n").alias("artifacts"), F.sum("_s").alias("bytes"), F.sha2(joined("_b", F.col("v")), 256).alias("manifest"))
