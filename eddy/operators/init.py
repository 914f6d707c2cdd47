"""Model initialisation (CLU1 random, CLU2 k-means, CLU3 streaming k-means).

The random initialiser draws q centroids uniformly inside the data's bounding
box. To let a SQL oracle reproduce the draw, the uniform number is the head of
a hash that both engines have:

    u(i, d) = first 13 hex digits of md5("seed,i,d"), as a number / 16^13
    centroid(i, d) = lo_d + u(i, d) * (hi_d - lo_d)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Hex digits of the hash that make a draw (52 bits: exact as a double).
HEX_DIGITS = 13


def uniform_expr(i, d: int, seed: int):
    digest = F.md5(F.concat_ws(",", F.lit(str(seed)), i.cast("string"), F.lit(str(d))).cast("binary"))
    return F.conv(F.substring(digest, 1, HEX_DIGITS), 16, 10).cast("bigint").cast("double") / F.lit(float(16 ** HEX_DIGITS))


def bounding_box(points: DataFrame, dims: int, features: str = "features") -> list[tuple[float, float]]:
    """Per-dimension min and max: one global aggregate (partial agg map-side)."""
    aggs = []
    for d in range(dims):
        aggs += [F.min(F.col(features)[d]).alias(f"lo{d}"), F.max(F.col(features)[d]).alias(f"hi{d}")]
    row = points.agg(*aggs).first()
    return [(row[f"lo{d}"], row[f"hi{d}"]) for d in range(dims)]


def random_centers(spark: SparkSession, q: int, box: list[tuple[float, float]], seed: int) -> DataFrame:
    """q centroids (mc_id 0..q-1) uniform in the box, reproducible in SQL."""
    i = F.col("id")
    coords = [F.lit(lo) + uniform_expr(i, d, seed) * F.lit(hi - lo) for d, (lo, hi) in enumerate(box)]
    return spark.range(q).select(F.col("id").alias("mc_id"), F.array(*coords).alias("centroid"))


def unit_centers(spark: SparkSession, q: int, dims: int, seed: int) -> DataFrame:
    """The reference's draw in [0,1)^d, for standardised data."""
    return random_centers(spark, q, [(0.0, 1.0)] * dims, seed)
