"""Macro clustering on micro-cluster models (CLU4-CLU7, CLU9, CLU10, AGG7).

Micro-cluster centroids weighted by n stand for the points they summarise.
The k-means family runs `pyspark.ml` with `weightCol="n"`: that is the exact
expectation of the reference's weighted resampling. The sampled form is kept
(`weighted_draws`) and is deterministic: draw k of group g uses

    u(g, k) = ((k * DRAW_MUL_K + g * DRAW_MUL_G + seed) mod DRAW_MOD) / DRAW_MOD

and picks the first micro-cluster (mc_id order) whose cumulative n reaches
u * N. One Lloyd step and one streaming-k-means step are DataFrame programs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.points import tick_list
from .cf import drop_empty
from .nearest import _matrix

MAX_GROUPS = 100_000   # model groups (ticks, runs) handled by one sampling call

# Fixed values of the deterministic draw (shared with the oracle SQL).
DRAW_MUL_K = 7919
DRAW_MUL_G = 104729
DRAW_MOD = 1000003


def draw_u(k, g, seed: int) -> F.Column:
    return ((k * F.lit(DRAW_MUL_K) + g * F.lit(DRAW_MUL_G) + F.lit(seed)) % F.lit(DRAW_MOD)).cast("double") \
        / F.lit(float(DRAW_MOD))


def weighted_draws(mcs: DataFrame, group: str, num: int, seed: int) -> DataFrame:
    """CLU4: `num` weighted draws of micro-clusters per group -> (group, draw, mc_id).

    Each group's cumulative n (an exact integer prefix sum over at most q
    micro-clusters) becomes one sorted interval array; the draws are spread
    over tasks and look their value up in the broadcast array (first interval
    end >= u * N), so no window or task ever holds all draws of a group.
    """
    live = drop_empty(mcs).select(group, "mc_id", "n")
    w = Window.partitionBy(group).orderBy("mc_id").rowsBetween(Window.unboundedPreceding, 0)
    cum = live.withColumn("cum_n", F.sum("n").over(w))          # per group: at most q rows
    intervals = cum.groupBy(group).agg(
        F.array_sort(F.collect_list(F.struct("cum_n", "mc_id"))).alias("iv"),
        F.sum("n").alias("total"))
    draws = (intervals.select(group, "total")
             .withColumn("draw", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(num - 1).cast("bigint"))))
             .repartition(group, "draw")
             .withColumn("_v", draw_u(F.col("draw"), F.col(group), seed) * F.col("total").cast("double")))
    hit = F.filter("iv", lambda s: s["cum_n"].cast("double") >= F.col("_v"))
    picked = F.coalesce(F.element_at(hit, 1)["mc_id"], F.element_at("iv", 1)["mc_id"])
    # one row per group holding at most q interval ends: fetched with a bound
    # check and broadcast back
    iv_rows = intervals.select(group, "iv").limit(MAX_GROUPS + 1).collect()
    if len(iv_rows) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} model groups")
    iv = mcs.sparkSession.createDataFrame(iv_rows, intervals.select(group, "iv").schema)
    return (draws.join(F.broadcast(iv), group)
            .select(group, "draw", picked.alias("mc_id")))


def initial_centers(mcs: DataFrame, group: str, k: int) -> DataFrame:
    """k start centers per group: the k heaviest micro-clusters (ties by mc_id)."""
    w = Window.partitionBy(group).orderBy(F.col("n").desc(), F.col("mc_id"))
    return (drop_empty(mcs).withColumn("center_id", F.row_number().over(w) - 1)
            .where(F.col("center_id") < k)
            .select(group, F.col("center_id").cast("bigint").alias("center_id"), "centroid", F.col("n").alias("w")))


def _assign_to_centers(mcs: DataFrame, centers: DataFrame, group: str, dims: int) -> DataFrame:
    """Nearest center (first center_id wins ties) of every micro-cluster centroid,
    one model group per cogroup call (both sides bounded by q)."""
    schema = T.StructType([mcs.schema[group], T.StructField("mc_id", T.LongType()),
                           T.StructField("center_id", T.LongType())])

    def fn(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if len(left) == 0 or len(right) == 0:
            return pd.DataFrame(columns=[f.name for f in schema.fields])
        right = right.sort_values("center_id").reset_index(drop=True)
        c = _matrix(right["centroid"], dims)
        x = _matrix(left["centroid"], dims)
        acc = None
        for d in range(dims):
            diff = x[:, None, d] - c[None, :, d]
            acc = diff * diff if acc is None else acc + diff * diff
        pos = np.argmin(acc, axis=1)
        return pd.DataFrame({group: left[group].to_numpy(), "mc_id": left["mc_id"].to_numpy(),
                             "center_id": right["center_id"].to_numpy()[pos]})

    return (mcs.select(group, "mc_id", "centroid").groupBy(group)
            .cogroup(centers.select(group, "center_id", "centroid").groupBy(group))
            .applyInPandas(fn, schema))


def lloyd_step(mcs: DataFrame, group: str, k: int, dims: int) -> DataFrame:
    """One weighted Lloyd iteration (CLU5, one step): centers move to
    sum(cf1x) / sum(n) of their micro-clusters; empty centers stay put."""
    live = drop_empty(mcs)
    cen = initial_centers(live, group, k)
    asg = _assign_to_centers(live, cen, group, dims)
    sums = (live.join(asg, [group, "mc_id"]).groupBy(group, "center_id")
            .agg(F.sum("n").alias("n"), *[F.sum(F.col("cf1x")[d]).alias(f"_s{d}") for d in range(dims)]))
    out = cen.join(sums, [group, "center_id"], "left")
    newc = [F.when(F.col("n").isNotNull(), F.col(f"_s{d}") / F.col("n")).otherwise(F.col("centroid")[d])
            for d in range(dims)]
    return out.select(group, "center_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
                      F.array(*newc).alias("center"))


def streaming_kmeans_step(mcs: DataFrame, group: str, k: int, dims: int, decay: float = 1.0) -> DataFrame:
    """CLU6: one StreamingKMeans update in "batches" units.

    Start centers: the k heaviest micro-clusters with weight n/N; the batch is
    every micro-cluster centroid with multiplicity n. Per center with m > 0:
    w' = w*decay + m, lambda = m / max(w', 1e-16),
    c' = (1 - lambda) * c + (lambda / m) * sum(x)   (sum(x) = sum of cf1x).
    """
    live = drop_empty(mcs)
    order = Window.partitionBy(group).orderBy(F.col("n").desc(), F.col("mc_id"))
    cen = (live.withColumn("_N", F.sum("n").over(Window.partitionBy(group)))
           .withColumn("center_id", (F.row_number().over(order) - 1).cast("bigint"))
           .where(F.col("center_id") < k)
           .select(group, "center_id", "centroid",
                   (F.col("n").cast("double") / F.col("_N").cast("double")).alias("w")))
    asg = _assign_to_centers(live, cen, group, dims)
    sums = (live.join(asg, [group, "mc_id"]).groupBy(group, "center_id")
            .agg(F.sum("n").alias("m"), *[F.sum(F.col("cf1x")[d]).alias(f"_s{d}") for d in range(dims)]))
    j = cen.join(sums, [group, "center_id"], "left")
    m = F.col("m").cast("double")
    w2 = F.col("w") * F.lit(decay) + m
    lam = m / F.greatest(w2, F.lit(1e-16))
    newc = [F.when(F.col("m") > 0, (F.lit(1.0) - lam) * F.col("centroid")[d] + (lam / m) * F.col(f"_s{d}"))
            .otherwise(F.col("centroid")[d]) for d in range(dims)]
    return j.select(group, "center_id", F.when(F.col("m") > 0, w2).otherwise(F.col("w") * F.lit(decay)).alias("weight"),
                    F.array(*newc).alias("center"))


# ------------------------------------------------------------ pyspark.ml

def _vectors(mcs: DataFrame) -> DataFrame:
    from pyspark.ml.functions import array_to_vector
    return drop_empty(mcs).withColumn("_v", array_to_vector("centroid")).withColumn("_w", F.col("n").cast("double"))


def ml_centers(mcs: DataFrame, group: str, k: int, algo: str = "kmeans", seed: int = 42,
               max_iter: int = 20, parallel: int = 8) -> DataFrame:
    """CLU5/CLU7/CLU9: weighted k-means or bisecting k-means per model group.

    The model table (bounded by q rows per group) is checkpointed once; each
    group's fit is a pyspark.ml job and the fits run as concurrent Spark jobs
    from a small thread pool, so the ticks of a sweep share the cluster.
    """
    from concurrent.futures import ThreadPoolExecutor

    from pyspark.ml.clustering import BisectingKMeans, KMeans

    from ..config import cut_lineage
    spark = mcs.sparkSession
    data = cut_lineage(_vectors(mcs).select(group, "_v", "_w"))
    keys = tick_list(data, group)                # number of model groups (ticks)

    def fit(key):
        part = data.where(F.col(group) == key)
        if algo == "kmeans":
            est = KMeans(k=k, maxIter=max_iter, seed=seed, featuresCol="_v", weightCol="_w")
        else:
            est = BisectingKMeans(k=k, maxIter=max_iter, seed=seed, featuresCol="_v", weightCol="_w")
        centers = est.fit(part).clusterCenters()
        return [(key, i, [float(x) for x in c]) for i, c in enumerate(centers)]

    with ThreadPoolExecutor(max_workers=max(1, min(parallel, len(keys)))) as pool:
        rows = [r for part in pool.map(fit, keys) for r in part]
    schema = T.StructType([T.StructField(group, mcs.schema[group].dataType), T.StructField("center_id", T.LongType()),
                           T.StructField("center", T.ArrayType(T.DoubleType()))])
    return spark.createDataFrame(rows, schema)
