"""Model-level merges: STR10 overlap prune, STR6 capacity round, AGG8 pair
merge, CLU8 macro merge. All are keyed by the model group (tick, run, ...)
so every snapshot of a sweep is handled by one set of jobs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import cut_lineage
from .cf import cf_sum, drop_empty
from .graph import connected_components
from .nearest import closest_pair, nearest_other, overlap_pairs, refresh_info


def with_ids(mcs: DataFrame) -> DataFrame:
    return mcs if "ids" in mcs.columns else mcs.withColumn("ids", F.array(F.col("mc_id").cast("bigint")))


def follow_parents(parent: DataFrame, group: list[str]) -> DataFrame:
    """(group, mc_id, parent_id) forest with parent < child -> (group, mc_id, root_id).

    Pointer jumping: root := root(root) until nothing moves (log depth rounds).
    """
    keys = group + ["mc_id"]
    cur = cut_lineage(parent.select(*keys, F.col("parent_id").alias("root_id")))
    while True:
        up = F.coalesce(F.col("p._r"), F.col("c.root_id"))
        nxt = cut_lineage(
            cur.alias("c").join(cur.select(*group, F.col("mc_id").alias("_m"), F.col("root_id").alias("_r")).alias("p"),
                                [F.col(f"c.{g}") == F.col(f"p.{g}") for g in group] + [F.col("c.root_id") == F.col("p._m")],
                                "left")
            .select(*[F.col(f"c.{k}") for k in keys], up.alias("root_id"), (up != F.col("c.root_id")).alias("moved")))
        cur = nxt.drop("moved")
        if nxt.where("moved").limit(1).count() == 0:
            return cur


def merge_groups(mcs: DataFrame, mapping: DataFrame, group: list[str], dims: int,
                 target: str, tick: F.Column | None = None) -> DataFrame:
    """AGG8: fold every micro-cluster into `target` (NULL = itself); ids are
    concatenated and sorted, last_tick is the merge tick when given."""
    m = with_ids(mcs).join(mapping, group + ["mc_id"], "left")
    m = m.withColumn("_to", F.coalesce(F.col(target), F.col("mc_id")))
    merged = cf_sum(m.drop("mc_id").withColumnRenamed("_to", "mc_id"), group + ["mc_id"], dims, ids=True)
    if tick is not None:
        changed = m.where(F.col(target).isNotNull()).select(*group, F.col(target).alias("mc_id")).distinct() \
                   .withColumn("_merged", F.lit(True))
        merged = merged.join(changed, group + ["mc_id"], "left").withColumn(
            "last_tick", F.when(F.col("_merged"), tick).otherwise(F.col("last_tick"))).drop("_merged")
    return merged


def overlap_merge(mcs: DataFrame, group: list[str], dims: int, tick: F.Column | None = None) -> DataFrame:
    """STR10: drop empty clusters, then merge each cluster into the highest
    earlier one that overlaps it (dist <= that one's RMSD), transitively.

    Parents are chosen on the pre-merge table (documented deviation: the
    sequential form sees centroids already moved by earlier merges).
    """
    live = cut_lineage(drop_empty(mcs))          # model-sized, read twice below
    info = refresh_info(live, group, dims)
    pairs = overlap_pairs(info, group, dims)
    parent = pairs.groupBy(*group, "mc_id").agg(F.max("parent_id").alias("parent_id"))
    roots = follow_parents(parent, group)
    out = merge_groups(live, roots, group, dims, "root_id", tick)
    return refresh_info(out, group, dims)


def capacity_round(mcs: DataFrame, group: list[str], dims: int, tick: F.Column | None = None) -> DataFrame:
    """STR6, one round: per group merge the closest pair (b into a, a first)."""
    info = cut_lineage(refresh_info(drop_empty(mcs), group, dims))   # model-sized, read twice
    pair = closest_pair(info, group, dims).select(*group, F.col("b_id").alias("mc_id"), F.col("a_id").alias("into"))
    out = merge_groups(info.drop("centroid", "rmsd"), pair, group, dims, "into", tick)
    return refresh_info(out, group, dims)


def near_edges(info: DataFrame, group: list[str], dims: int) -> DataFrame:
    """Macro-merge edges: i -> its nearest other j (ties to the highest
    position), kept when dist <= rmsd_j (the target's RMSD)."""
    near = nearest_other(info, group, dims, tie="last")
    tgt = info.select(*group, F.col("mc_id").alias("near_id"), F.col("rmsd").alias("near_rmsd"))
    return (near.join(tgt, group + ["near_id"])
            .where(F.col("near_dist") <= F.col("near_rmsd"))
            .select(*group, F.col("mc_id").alias("src"), F.col("near_id").alias("dst")))


def macro_merge(mcs: DataFrame, group: list[str], dims: int) -> DataFrame:
    """CLU8: n > 0 -> RMSD -> near edges -> components -> group sums -> centroids.

    Returns (group, new_cluster_id, n, cf1x, centroid); new_cluster_id is the
    smallest member id of the component, or the micro-cluster's own id.
    """
    live = drop_empty(mcs)
    info = refresh_info(live, group, dims)
    info = cut_lineage(info)
    comps = connected_components(near_edges(info, group, dims), group)
    joined = info.join(comps, group + ["mc_id"], "left").withColumn(
        "new_cluster_id", F.coalesce("component_id", "mc_id"))
    sums = joined.groupBy(*group, "new_cluster_id").agg(
        F.sum("n").alias("n"), *[F.sum(F.col("cf1x")[i]).alias(f"_s{i}") for i in range(dims)])
    cf1x = F.array(*[F.col(f"_s{i}") for i in range(dims)])
    return sums.select(*group, "new_cluster_id", "n", cf1x.alias("cf1x"),
                       F.transform(cf1x, lambda x: x / F.col("n").cast("double")).alias("centroid"))


def capacity_merge(mcs: DataFrame, group: list[str], dims: int, q: int) -> DataFrame:
    """STR6 loop: merge until every model group holds at most q micro-clusters.

    Each round merges mutual nearest neighbours (an equi-join of the
    nearest-other table with itself on near_id = mc_id), closest first and at
    most count - q pairs per group. The globally closest pair is always
    mutual, so each round's first merge is the one the sequential rule picks;
    rounds shrink an over-full group quickly instead of one pair per pass.
    """
    from pyspark.sql import Window
    cur = cut_lineage(with_ids(drop_empty(mcs)).drop("centroid", "rmsd"))
    while True:
        sizes = cur.groupBy(*group).agg(F.count(F.lit(1)).alias("_size"))
        if sizes.where(F.col("_size") > q).limit(1).count() == 0:
            return refresh_info(cur, group, dims)
        info = refresh_info(cur, group, dims)
        near = nearest_other(info, group, dims, tie="first")
        x, y = near.alias("x"), near.alias("y")
        mutual = (x.join(y, [F.col(f"x.{g}") == F.col(f"y.{g}") for g in group]
                        + [F.col("x.near_id") == F.col("y.mc_id"), F.col("y.near_id") == F.col("x.mc_id")])
                  .where(F.col("x.mc_id") < F.col("y.mc_id"))
                  .select(*[F.col(f"x.{g}") for g in group], F.col("x.mc_id").alias("a"),
                          F.col("y.mc_id").alias("b"), F.col("x.near_dist").alias("dist")))
        order = Window.partitionBy(*group).orderBy("dist", "a", "b")
        chosen = (mutual.join(sizes, group).withColumn("_r", F.row_number().over(order))
                  .where(F.col("_r") <= F.col("_size") - F.lit(q))
                  .select(*group, F.col("b").alias("mc_id"), F.col("a").alias("into")))
        cur = cut_lineage(merge_groups(cur, chosen, group, dims, "into"))
