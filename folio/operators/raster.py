"""Rasters as rows of pixel arrays: difference, ink, shifts and tolerant precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def luma(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def difference(pairs: DataFrame, a: str, b: str, tolerance: float) -> DataFrame:
    """Mean absolute error, share of pixels beyond tolerance, and ink ratio of pixel arrays; arrays stay in their rows."""
    d = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    total = lambda c: F.aggregate(c, F.lit(0.0).cast("double"), lambda s, x: s + x.cast("double"))
    over = F.size(F.filter(d, lambda x: x > tolerance)) / F.size(a)
    ink = lambda c: F.size(F.filter(c, lambda x: x > 0.25)).cast("double")
    return pairs.select("id", (total(d) / F.size(a)).alias("mae"), over.alias("bad_ratio"), F.when(ink(b) > 0, ink(a) / ink(b)).alias("ink_ratio"))


def ink_profile(rasters: DataFrame, pixels: str, width: int) -> DataFrame:
    """Dark pixels of each row of a raster."""
    each = rasters.select("id", F.posexplode(pixels).alias("i", "v"))
    return each.groupBy("id", F.floor(F.col("i") / width).alias("y")).agg(F.sum((F.col("v") > 0).cast("long")).alias("ink"))


def best_lag(profiles: DataFrame, reach: int) -> DataFrame:
    """The shift of profile b against a, id by id, that has the highest mean product; the smallest shift wins ties. Rows: (id, k, a, b)."""
    a = profiles.select("id", "k", "a")
    b = profiles.select("id", F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("lag"), "k", "b").withColumn("k", F.col("k") - F.col("lag"))
    scores = a.join(b, ["id", "k"]).groupBy("id", "lag").agg((F.sum(F.col("a") * F.col("b")) / F.count("*")).alias("score"))
    return scores.groupBy("id").agg(F.max_by("lag", F.struct("score", (-F.col("lag")).alias("o"))).alias("lag"))


def tolerant_share(ink: DataFrame, other: DataFrame, radius: int) -> DataFrame:
    """Share of ink pixels (id, x, y) that have a pixel of the other within a square radius; 1 where there is no ink.

    The other side's pixels are spread over their neighbourhood, so the join is on equal keys.
    """
    around = F.sequence(F.lit(-radius), F.lit(radius))
    near = other.select("id", "x", "y", F.explode(around).alias("dx")).select("id", "x", "y", "dx", F.explode(around).alias("dy")).select("id", (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y")).distinct()
    met = ink.join(near.withColumn("hit", F.lit(1)), ["id", "x", "y"], "left")
    return met.groupBy("id").agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count("*")).alias("share"))


def bounds_delta(a: str, b: str) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))
