"""k-means for all groups at once: Lloyd rounds, k-means|| seeding, bisecting (CLU2, CLU5, CLU7, CLU9).

Input rows are (keys..., id, features, w, sx): a point of weight w and its weighted feature sums, a
micro-cluster as (mc_id, centroid, n, cf1x) or a plain point. A round is one job for the groups of all
keys: the centers of a group (at most k) stand in one row, which meets the group's points; the nearest
is found by column expressions; sums by (group, center) are combined before the exchange. A group stops
by its own movement, and its points leave the next rounds. The table of centers is broadcast while it
is at most `CENTER_BYTES`, else joined. Ties go to the smaller center id; a center without points stays.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import work_dir
from .cf import drop_empty
from .init import uniform_expr

CENTER_BYTES = 32_000_000
OVERSAMPLING = 2            # candidates a seeding round draws, in units of k
SEED_ROUNDS = 3
SEED_TRIES = 8              # draws of k out of the candidates, the cheapest counts


def mc_points(mcs: DataFrame, keys: list[str]) -> DataFrame:
    """The micro-clusters with n > 0 as weighted points."""
    return drop_empty(mcs).select(*keys, F.col("mc_id").alias("id"), F.col("centroid").alias("features"),
                                  F.col("n").cast("double").alias("w"), F.col("cf1x").alias("sx"))


def plain_points(points: DataFrame, keys: list[str], id_col: str = "point_id") -> DataFrame:
    return points.select(*keys, F.col(id_col).alias("id"), "features", F.lit(1.0).alias("w"), F.col("features").alias("sx"))


def _kept(df: DataFrame) -> DataFrame:
    path = work_dir(df.sparkSession, "kmeans")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def squared(x, c, dims: int):
    acc = None
    for d in range(dims):
        sq = (x[d] - c[d]) * (x[d] - c[d])
        acc = sq if acc is None else acc + sq
    return acc


def pack(centers: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, cs): the centers (center_id, center) of a group in one row."""
    return centers.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("center_id", "center"))).alias("cs"))


def _meet(points: DataFrame, packed: DataFrame, keys: list[str], k: int, dims: int) -> DataFrame:
    most = max(1, CENTER_BYTES // (k * (dims * 8 + 24)))
    small = packed.select(*keys).limit(most + 1).count() <= most
    return points.join(F.broadcast(packed) if small else packed, keys)


def nearest(cs: str, dims: int, x: str = "features"):
    """struct(d2, center_id) of the nearest of the packed centers."""
    return F.array_min(F.transform(cs, lambda c: F.struct(squared(F.col(x), c["center"], dims).alias("d2"), c["center_id"].alias("center_id"))))


def lloyd(points: DataFrame, centers: DataFrame, keys: list[str], dims: int, rounds: int = 20, tol: float = 1e-4) -> DataFrame:
    """(keys, center_id, n, center): at most `rounds` weighted Lloyd rounds from `centers` (keys,
    center_id, center). n is the weight that the last round gave the center; a group is done when no
    center moves by more than `tol`."""
    k = centers.groupBy(*keys).count().agg(F.max("count")).first()[0]
    if k is None:
        return centers.select(*keys, "center_id", F.lit(0.0).alias("n"), "center")
    cur = _kept(centers.select(*keys, "center_id", "center", F.lit(0.0).alias("n"), F.lit(False).alias("done")))
    for _ in range(rounds):
        todo = cur.where(~F.col("done"))
        met = _meet(points, pack(todo, keys), keys, k, dims).withColumn("center_id", nearest("cs", dims)["center_id"])
        sums = met.groupBy(*keys, "center_id").agg(F.sum("w").alias("m"), *[F.sum(F.col("sx")[d]).alias(f"_s{d}") for d in range(dims)])
        moved = todo.join(sums, keys + ["center_id"], "left").withColumn("to", F.when(
            F.col("m").isNotNull(), F.array(*[F.col(f"_s{d}") / F.col("m") for d in range(dims)])).otherwise(F.col("center")))
        by = Window.partitionBy(*keys)                       # at most k rows
        after = moved.select(*keys, "center_id", F.col("to").alias("center"), F.coalesce("m", F.lit(0.0)).alias("n"),
                             (F.max(squared(F.col("to"), F.col("center"), dims)).over(by) <= tol * tol).alias("done"))
        cur = _kept(after.unionByName(cur.where("done")))
        if cur.where(~F.col("done")).isEmpty():
            break
    return cur.select(*keys, "center_id", "n", "center")


def heaviest(points: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k heaviest points of a group as centers, ties by id."""
    order = Window.partitionBy(*keys).orderBy(F.desc("w"), "id")
    return (points.withColumn("center_id", (F.row_number().over(order) - 1).cast("bigint")).where(F.col("center_id") < k)
            .select(*keys, "center_id", F.col("features").alias("center")))


def parallel_seeds(points: DataFrame, keys: list[str], k: int, dims: int, seed: int, rounds: int = SEED_ROUNDS,
                   oversampling: int = OVERSAMPLING) -> DataFrame:
    """k-means||: every round draws each point with probability l w d2 / sum(w d2) by a hash of its id, so
    that a run is repeatable; the drawn candidates (about rounds * l a group), weighted by the points
    nearest to them, are reduced to k by the best of some weighted k-means++ draws in one group function."""
    u = lambda r: uniform_expr(F.col("id"), r, seed)
    first = Window.partitionBy(*keys).orderBy(-F.log(F.greatest(u(0), F.lit(1e-300))) / F.col("w"), "id")
    chosen = _kept(points.withColumn("_r", F.row_number().over(first)).where("_r = 1")
                   .select(*keys, F.lit(0).cast("bigint").alias("center_id"), F.col("features").alias("center")))
    most = 1 + 4 * rounds * oversampling * k
    for r in range(1, rounds + 1):
        met = _meet(points, pack(chosen, keys), keys, most, dims).withColumn("_d", nearest("cs", dims)["d2"] * F.col("w"))
        total = met.groupBy(*keys).agg(F.sum("_d").alias("_t"))
        drawn = (met.join(total, keys).where((F.col("_t") > 0) & (u(r) * F.col("_t") < F.col("_d") * (oversampling * k)))
                 .select(*keys, F.col("features").alias("center")).distinct())
        order = Window.partitionBy(*keys).orderBy("center")
        base = chosen.groupBy(*keys).agg(F.max("center_id").alias("_b"))
        more = drawn.withColumn("_n", F.row_number().over(order)).join(base, keys).select(
            *keys, (F.col("_b") + F.col("_n")).alias("center_id"), "center")
        chosen = _kept(chosen.unionByName(more))
    weight = (_meet(points, pack(chosen, keys), keys, most, dims).withColumn("center_id", nearest("cs", dims)["center_id"])
              .groupBy(*keys, "center_id").agg(F.sum("w").alias("w")))
    schema = chosen.schema

    def reduce(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("center_id").reset_index(drop=True)
        x, w = np.stack(pdf["center"].to_list()), pdf["w"].to_numpy()
        rng, best, picked = np.random.default_rng(seed), np.inf, []
        for _ in range(SEED_TRIES):
            some = [int(rng.choice(len(x), p=w / w.sum()))]
            while len(some) < min(k, len(x)):
                d2 = ((x[:, None] - x[None, some]) ** 2).sum(2).min(1) * w
                if not d2.sum() > 0:
                    break
                some.append(int(rng.choice(len(x), p=d2 / d2.sum())))
            c = x[some]
            for _ in range(5):                                   # the cost after a few rounds over the candidates
                own = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
                c = np.array([np.average(x[own == i], axis=0, weights=w[own == i]) if (own == i).any() else c[i] for i in range(len(c))])
            cost = (((x[:, None] - c[None]) ** 2).sum(2).min(1) * w).sum()
            if cost < best:
                best, picked = cost, some
        out = pdf.iloc[picked][keys].reset_index(drop=True)
        out["center_id"], out["center"] = np.arange(len(picked)), [x[i].tolist() for i in picked]
        return out

    return chosen.join(weight, keys + ["center_id"]).groupBy(*keys).applyInPandas(reduce, schema)


def bisect(points: DataFrame, keys: list[str], k: int, dims: int, rounds: int = 20, tol: float = 1e-4) -> DataFrame:
    """Bisecting k-means of all groups: every level splits the heaviest divisible leaves of each group by a
    2-means that starts at the leaf's heaviest point and the point farthest from it, until k leaves.
    (keys, center_id, n, center); center ids go by the leaf's place in the tree."""
    leaf_keys = keys + ["leaf"]
    cur = _kept(points.withColumn("leaf", F.lit(1).cast("bigint")))
    while True:
        sizes = cur.groupBy(*leaf_keys).agg(F.sum("w").alias("m"), F.countDistinct("features").alias("kinds"))
        by = Window.partitionBy(*keys)
        order = by.orderBy(F.desc("m"), "leaf")
        ranked = sizes.withColumn("leaves", F.count(F.lit(1)).over(by)).where("kinds > 1").withColumn("r", F.row_number().over(order))
        split = _kept(ranked.where(F.col("r") <= k - F.col("leaves")).select(*leaf_keys))
        if split.isEmpty():
            break
        part = cur.join(split, leaf_keys, "left_semi")
        one = heaviest(part, leaf_keys, 1).select(*leaf_keys, F.col("center").alias("c0"))
        far = Window.partitionBy(*leaf_keys).orderBy(F.desc(squared(F.col("features"), F.col("c0"), dims)), "id")
        two = part.join(one, leaf_keys).withColumn("_r", F.row_number().over(far)).where("_r = 1")
        starts = two.select(*leaf_keys, F.explode(F.array(
            F.struct(F.lit(0).cast("bigint").alias("center_id"), F.col("c0").alias("center")),
            F.struct(F.lit(1).cast("bigint").alias("center_id"), F.col("features").alias("center")))).alias("s")).select(
            *leaf_keys, "s.center_id", "s.center")
        halves = pack(lloyd(part, starts, leaf_keys, dims, rounds, tol), leaf_keys)
        side = _meet(part, halves, leaf_keys, 2, dims).withColumn("leaf", F.col("leaf") * 2 + nearest("cs", dims)["center_id"]).drop("cs")
        cur = _kept(cur.join(split, leaf_keys, "left_anti").unionByName(side.select(*cur.columns)))
    sums = cur.groupBy(*leaf_keys).agg(F.sum("w").alias("n"), *[F.sum(F.col("sx")[d]).alias(f"_s{d}") for d in range(dims)])
    return sums.select(*keys, (F.row_number().over(Window.partitionBy(*keys).orderBy("leaf")) - 1).cast("bigint").alias("center_id"),
                       "n", F.array(*[F.col(f"_s{d}") / F.col("n") for d in range(dims)]).alias("center"))


def hash_draws(mcs: DataFrame, key: str, num: int, seed: int) -> DataFrame:
    """CLU4 without a period: (key, draw, mc_id), `num` draws a group by weight n. Draw i of a group takes
    the micro-cluster whose interval of the running sums of n holds u * N, u a hash of (seed, group, i). One
    ordered pass over a group's draws and interval ends (num + q rows) places them."""
    live = drop_empty(mcs).select(key, "mc_id", "n")
    ends = live.select(key, F.sum("n").over(Window.partitionBy(key).orderBy("mc_id")).cast("double").alias("v"),
                       F.lit(None).cast("bigint").alias("draw"), "mc_id")
    i = F.concat_ws(",", F.col(key).cast("string"), F.col("draw").cast("string"))
    draws = (live.groupBy(key).agg(F.sum("n").alias("_t"))
             .withColumn("draw", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(num - 1).cast("bigint"))))
             .select(key, ((F.lit(1.0) - uniform_expr(i, 0, seed)) * F.col("_t")).alias("v"), "draw", F.lit(None).cast("bigint").alias("mc_id")))
    # the last interval end at or above the draw
    down = Window.partitionBy(key).orderBy(F.desc("v"), F.asc_nulls_first("draw")).rowsBetween(Window.unboundedPreceding, 0)
    placed = ends.unionByName(draws).withColumn("mc_id", F.last("mc_id", ignorenulls=True).over(down))
    return placed.where(F.col("draw").isNotNull()).select(key, "draw", "mc_id")


def sampled_points(mcs: DataFrame, key: str, draws: int, seed: int) -> DataFrame:
    """CLU4 for CLU5: micro-clusters weighted by how often `draws` weighted draws hit them."""
    hits = hash_draws(mcs, key, draws, seed).groupBy(key, "mc_id").agg(F.count(F.lit(1)).cast("double").alias("w"))
    return mcs.join(hits, [key, "mc_id"]).select(key, F.col("mc_id").alias("id"), F.col("centroid").alias("features"), "w",
                                                 F.transform("centroid", lambda x: x * F.col("w")).alias("sx"))


def sampled_kmeans(mcs: DataFrame, key: str, k: int, dims: int, draws: int, seed: int, rounds: int = 20) -> DataFrame:
    """CLU5 as the reference runs it: `draws` weighted draws are the training set, k more of them the start."""
    points = _kept(sampled_points(mcs, key, draws, seed))
    start = hash_draws(mcs, key, k, seed + 1).join(mcs.select(key, "mc_id", "centroid"), [key, "mc_id"]).select(
        key, F.col("draw").alias("center_id"), F.col("centroid").alias("center"))
    return lloyd(points, start, [key], dims, rounds)


ALGORITHMS = ("kmeans", "bisecting", "merge")


def offline_centers(snaps: DataFrame, dims: int, algorithm: str, k: int = 5, start: int | None = None, end: int | None = None,
                    draws: int = 5000, seed: int = 42) -> DataFrame:
    """CLU9: (tick, center_id, n, center) of the snapshots (tick, mc_id, n, cf1x, cf2x, centroid) of ticks
    start to end, by sampled k-means, bisecting k-means or the macro merge; all ticks together."""
    some = snaps
    if start is not None:
        some = some.where(F.col("tick") >= start)
    if end is not None:
        some = some.where(F.col("tick") <= end)
    if algorithm == "kmeans":
        return sampled_kmeans(drop_empty(some), "tick", k, dims, draws, seed)
    if algorithm == "bisecting":
        return bisect(mc_points(some, ["tick"]), ["tick"], k, dims)
    if algorithm == "merge":
        from .merge import macro_merge
        return macro_merge(some.drop("centroid", "rmsd"), ["tick"], dims).select(
            "tick", F.col("new_cluster_id").alias("center_id"), F.col("n").cast("double").alias("n"), F.col("centroid").alias("center"))
    raise ValueError(f"unknown algorithm {algorithm!r}; one of {', '.join(ALGORITHMS)}")
