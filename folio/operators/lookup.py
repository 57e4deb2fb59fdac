"""Joins that documents need: dimensions, as-of, intervals, inheritance, ordinals, prioritised resolution, remapped merges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Widths of the buckets that spans are cut by.
SPAN_LEVELS = 5


def asof(left: DataFrame, right: DataFrame, part: str, at: str, value: str) -> DataFrame:
    """left with the value of right's last row at or before it: both sides are one sorted stream by part, no rows are paired.

    Ties: of right's rows at one place the largest value counts.
    """
    a = left.withColumn("_side", F.lit(1)).withColumn("_v", F.lit(None).cast(right.schema[value].dataType))
    b = right.groupBy(part, at).agg(F.max(value).alias("_v")).withColumn("_side", F.lit(0))
    over = Window.partitionBy(part).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = a.unionByName(b, allowMissingColumns=True)
    return both.withColumn(value, F.last("_v", ignorenulls=True).over(over)).where("_side = 1").drop("_side", "_v")


def interval_join(points: DataFrame, spans: DataFrame, part: str, at: str, width: int) -> DataFrame:
    """points in [start, end) of spans of the same part, which are cut by buckets, so that the join has keys.

    A span takes the first of the widths width, 16 width, 256 width .. with which it needs 17 buckets at most, so that a
    long one is a few rows; a point has a row for each width.
    """
    widths = [width * 16**k for k in range(SPAN_LEVELS)]
    size = F.col("end") - F.col("start")
    level = reduce(lambda out, k: F.when(size <= 16 * widths[k], k).otherwise(out), reversed(range(SPAN_LEVELS - 1)), F.lit(SPAN_LEVELS - 1))
    wide = F.element_at(F.array(*(F.lit(w).cast("long") for w in widths)), level + 1)
    cut = spans.where(size > 0).withColumn("_w", wide).withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / F.col("_w")), F.floor((F.col("end") - 1) / F.col("_w")))))
    keyed = points.withColumn("_w", F.explode(F.array(*(F.lit(w).cast("long") for w in widths)))).withColumn("_b", F.floor(F.col(at) / F.col("_w")))
    return keyed.join(cut, [part, "_w", "_b"]).where((F.col(at) >= F.col("start")) & (F.col(at) < F.col("end"))).drop("_b", "_w")


def overlaps(boxes: DataFrame, page: str, share: float) -> DataFrame:
    """Pairs of boxes (item, y, x0, x1) of one page on different lines whose widths overlap by a share of the smaller.

    Boxes meet in strips of x as wide as the page's mean box; a pair is made in the strip where the later one begins, so once.
    """
    mean = boxes.groupBy(page).agg(F.greatest(F.avg(F.col("x1") - F.col("x0")), F.lit(1e-9)).alias("_w"))
    strips = F.sequence(F.floor(F.col("x0") / F.col("_w")), F.greatest(F.floor(F.col("x0") / F.col("_w")), F.floor(F.col("x1") / F.col("_w"))))
    cut = boxes.join(mean, page).withColumn("_s", F.explode(strips))
    a, b = cut.alias("a"), cut.alias("b")
    inner = F.least("a.x1", "b.x1") - F.greatest("a.x0", "b.x0")
    small = F.least(F.col("a.x1") - F.col("a.x0"), F.col("b.x1") - F.col("b.x0"))
    first = F.col("a._s") == F.floor(F.greatest("a.x0", "b.x0") / F.col("a._w"))
    on = (F.col(f"a.{page}") == F.col(f"b.{page}")) & (F.col("a._s") == F.col("b._s")) & first & (F.col("a.item") < F.col("b.item")) & (F.col("a.y") != F.col("b.y")) & (inner >= small * share) & (inner > 0)
    return a.join(b, on).select(F.col(f"a.{page}").alias(page), F.col("a.item").alias("item_a"), F.col("b.item").alias("item_b"), inner.alias("overlap"))


def ordinal_link(anchors: DataFrame, controls: DataFrame, part: tuple[str, ...], order: str, control_order: str) -> DataFrame:
    """The k-th anchor with the k-th control of the same keys; what finds none keeps null."""
    k = lambda df, o: df.withColumn("_k", F.row_number().over(Window.partitionBy(*part).orderBy(o)))
    return k(anchors, order).join(k(controls, control_order), [*part, "_k"], "left").drop("_k")


def inherit(styles: DataFrame, properties: list[str], depth: int = 16) -> DataFrame:
    """Styles (id, parent, properties) with what they lack from the nearest ancestor that has it; `cycle` marks loops and chains over `depth`.

    Chains are followed by doubling: after k joins each row knows 2^k ancestors.
    """
    out = styles.select("id", F.col("parent").alias("_up"), *properties)
    steps = max(1, (depth - 1).bit_length())
    for _ in range(steps):
        up = out.select(F.col("id").alias("_up"), F.col("_up").alias("_next"), *(F.col(p).alias(f"_{p}") for p in properties))
        out = out.join(up, "_up", "left").select("id", F.col("_next").alias("_up"), *(F.coalesce(p, f"_{p}").alias(p) for p in properties))
    return out.select("id", *properties, F.col("_up").isNotNull().alias("cycle"))


def resolve(requests: DataFrame, candidates: list[DataFrame], key: str, order: str) -> DataFrame:
    """The first candidate list (key, choice, order) that has a request decides; within it the smallest order."""
    ranked = candidates[0].withColumn("_p", F.lit(0))
    for i, c in enumerate(candidates[1:], 1):
        ranked = ranked.unionByName(c.withColumn("_p", F.lit(i)))
    best = ranked.groupBy(key).agg(F.min_by(F.struct("choice", F.col("_p").alias("tier")), F.struct("_p", order, "choice")).alias("_x"))
    return requests.join(best, key, "left").select(requests["*"], F.col("_x.choice").alias("choice"), F.col("_x.tier").alias("tier"))


def merge_palettes(target: DataFrame, part: DataFrame, name: str) -> DataFrame:
    """part's rows (id, name, ...) behind target's: ids move by target's size, names that clash get a suffix."""
    size = target.select(F.coalesce(F.max("id") + 1, F.lit(0))).scalar()
    taken = target.select(name).distinct().withColumn("_t", F.lit(True))
    moved = part.withColumn("id", F.col("id") + size).join(taken, name, "left")
    moved = moved.withColumn(name, F.when(F.col("_t"), F.concat(name, F.lit("_"), F.col("id"))).otherwise(F.col(name)))
    return target.unionByName(moved.select(target.columns))


def top_by(rows: DataFrame, part: str, score: Column, order: str, value: str) -> DataFrame:
    """The value with the best score of each part, ties by the smallest order; one partial aggregate."""
    return rows.groupBy(part).agg(F.max_by(value, F.struct(score, (-F.col(order)).alias("o"))).alias(value))
