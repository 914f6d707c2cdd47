"""Clustering-feature (CF) aggregates: AGG1-AGG5, AGG7, AGG8, JOI10, FLT2.

A CF row is (keys..., mc_id, n, cf1x, cf2x, cf1t, cf2t, last_tick). Every
field is additive except last_tick (max), so folding, merging and windowing
are plain `groupBy().agg(sum)`: partial aggregation happens map-side and the
shuffle carries one row per (partition, key).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dim_sums, pack

CF_COLS = ["n", "cf1x", "cf2x", "cf1t", "cf2t", "last_tick"]

# Above this dimension one `sum` per dimension makes a generated method too
# large for codegen; wide vectors are summed in long form instead.
WIDE_DIMS = 16


def cf_aggregate(assigned: DataFrame, keys: list[str], dims: int, features: str = "features",
                 tick: str = "tick") -> DataFrame:
    """AGG1/AGG3: per key the count, per-dimension sums of x and x^2 and the
    time sums. One `sum` per dimension keeps the whole thing in codegen."""
    sq = F.transform(features, lambda x: x * x)
    t = F.col(tick).cast("bigint")
    if dims > WIDE_DIMS:
        return _cf_aggregate_wide(assigned, keys, features, sq, t)
    agg = (assigned
           .select(*keys, F.col(features).alias("_x"), sq.alias("_x2"), t.alias("_t"))
           .groupBy(*keys)
           .agg(F.count(F.lit(1)).alias("n"),
                *dim_sums("_x", dims, "_s1"),
                *dim_sums("_x2", dims, "_s2"),
                F.sum("_t").alias("cf1t"),
                F.sum(F.col("_t") * F.col("_t")).alias("cf2t"),
                F.max("_t").alias("last_tick")))
    return agg.select(*keys, "n", pack("_s1", dims).alias("cf1x"), pack("_s2", dims).alias("cf2x"),
                      "cf1t", "cf2t", "last_tick")


def _cf_aggregate_wide(assigned: DataFrame, keys: list[str], features: str, sq, t) -> DataFrame:
    """Wide vectors: exploded to (key, dimension, x) and summed per (key,
    dimension) with map-side partial aggregation (exact, in codegen), then the
    key x dims result (model-sized) is regrouped into arrays."""
    e = assigned.select(*keys, t.alias("_t"), F.posexplode(features).alias("_d", "_x"))
    per_dim = e.groupBy(*keys, "_d").agg(
        F.count(F.lit(1)).alias("n"), F.sum("_x").alias("_s1"), F.sum(F.col("_x") * F.col("_x")).alias("_s2"),
        F.sum("_t").alias("cf1t"), F.sum(F.col("_t") * F.col("_t")).alias("cf2t"), F.max("_t").alias("last_tick"))
    agg = per_dim.groupBy(*keys).agg(
        F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("_d", "_s1", "_s2"))).alias("_v"),
        F.max("cf1t").alias("cf1t"), F.max("cf2t").alias("cf2t"), F.max("last_tick").alias("last_tick"))
    return agg.select(*keys, "n", F.transform("_v", lambda r: r["_s1"]).alias("cf1x"),
                      F.transform("_v", lambda r: r["_s2"]).alias("cf2x"), "cf1t", "cf2t", "last_tick")


def cf_sum(cf: DataFrame, keys: list[str], dims: int, ids: bool = False) -> DataFrame:
    """Fold CF rows by key (JOI10 upsert, AGG2, AGG4): sums, max of last_tick.
    With ids=True also concatenates the lineage id arrays sorted (AGG8)."""
    aggs = [F.sum("n").alias("n"),
            *[F.sum(F.col("cf1x")[i]).alias(f"_s1_{i}") for i in range(dims)],
            *[F.sum(F.col("cf2x")[i]).alias(f"_s2_{i}") for i in range(dims)],
            F.sum("cf1t").alias("cf1t"), F.sum("cf2t").alias("cf2t"),
            F.max("last_tick").alias("last_tick")]
    if ids:
        aggs.append(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"))
    out = cf.groupBy(*keys).agg(*aggs)
    cols = [*keys, "n", pack("_s1", dims).alias("cf1x"), pack("_s2", dims).alias("cf2x"),
            "cf1t", "cf2t", "last_tick"]
    if ids:
        cols.append("ids")
    return out.select(*cols)


def drop_empty(cf: DataFrame) -> DataFrame:
    """FLT2."""
    return cf.where(F.col("n") > 0)


def tick_totals(points: DataFrame, tick: str = "tick") -> DataFrame:
    """AGG5/FLT4: batch size per non-empty tick and the running total N."""
    from pyspark.sql import Window
    per_tick = points.groupBy(tick).agg(F.count(F.lit(1)).alias("batch_n"))
    # per_tick has one row per tick (bounded by the number of ticks)
    w = Window.orderBy(tick).rowsBetween(Window.unboundedPreceding, 0)
    return per_tick.withColumn("total_n", F.sum("batch_n").over(w))


def weights(mcs: DataFrame, group: list[str]) -> DataFrame:
    """AGG7: n / sum(n) over the n > 0 rows of each model group."""
    from pyspark.sql import Window
    w = Window.partitionBy(*group)
    pos = drop_empty(mcs)
    return pos.withColumn("weight", F.col("n").cast("double") / F.sum("n").over(w).cast("double"))
