"""Registered queries without a SQL twin: the stateful online loop, the
stream runner, outlier compaction, k-means family and PCA. They are checked
by row counts here and by invariants in tests/."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ModelConfig, cut_lineage, work_dir
from ..operators import kmeans as KM
from ..operators import macro as M
from ..operators import pyramid as P
from ..operators.assign import assign_nearest, split_inliers
from ..operators.nearest import refresh_info
from ..operators.scale import pca_project
from ..sources.points import embedding_points, tick_list
from ..streaming.online import OnlineModel, file_source, replay, run_stream
from ..streaming.outliers import cell_of, cell_sums
from . import inputs as I
from .catalog import _with, register
from .q_events import EV_MODEL, _ev_model

# The online run of the reference: window 6 ticks, alpha = 2, l = 10, m = 20.
ONLINE_CFG = ModelConfig(q=20, dims=I.EV_DIMS, delta=I.EV_DELTA, m_last=20, scaling="batch", init_mode="random",
                         alpha=I.ALPHA, l=I.L_PARAM, seed=I.SEED)


def model_view(m: DataFrame, dims: int) -> DataFrame:
    ids = F.concat_ws(",", F.transform(F.array_sort("ids"), lambda x: x.cast("string")))
    return m.select("mc_id", "n", *[F.col("centroid")[d].alias(f"centroid_{d}") for d in range(dims)],
                    "rmsd", "cf1t", "cf2t", "last_tick", ids.alias("ids"))


@register("online_replay")
def q_online_replay(spark, sf_dir):
    """STR1/STR2/STR11 (+STR4-6, STR10): the whole events stream replayed tick
    by tick through the online model; returns the final window model."""
    m = replay(spark, I.ev_points(spark, sf_dir), ONLINE_CFG, work_dir(spark, "online"))
    return model_view(m.model(), I.EV_DIMS)


@register("unbounded_replay")
def q_unbounded_replay(spark, sf_dir):
    """VAR4: the same loop without the capacity cap (no closest-pair merges)."""
    cfg = ONLINE_CFG.replace(remove_expired=False)
    m = replay(spark, I.ev_points(spark, sf_dir), cfg, work_dir(spark, "unbounded"), unbounded=True)
    return model_view(m.model(), I.EV_DIMS)


@register("fixed_q_replay")
def q_fixed_q_replay(spark, sf_dir):
    """VAR1-VAR3 loop: the fixed-q model (absorb within t_factor*rmsd, new
    clusters reuse the slot of a stale cluster by recency stamp, else merge the
    closest kept pair), replayed over the whole events stream."""
    cfg = ONLINE_CFG.replace(variant="fixed", remove_expired=False, delta=2)
    m = replay(spark, I.ev_points(spark, sf_dir), cfg, work_dir(spark, "fixed-q"))
    return model_view(m.model(), I.EV_DIMS)


@register("file_stream")
def q_file_stream(spark, sf_dir):
    """SRC2/STR1: the events written as one Parquet file per tick and consumed
    by Structured Streaming, one model step per micro-batch."""
    base = work_dir(spark, "stream")
    pts = I.ev_points(spark, sf_dir)
    src = f"{base}/source"
    # one file per tick: the file stream replays them in name order
    pts.repartition("tick").write.partitionBy("tick").parquet(f"{base}/by-tick")
    ticks = tick_list(pts)
    for t in ticks:
        (spark.read.parquet(f"{base}/by-tick").where(F.col("tick") == t).drop("tick").coalesce(1)
         .write.mode("append").parquet(src))
    schema = spark.read.parquet(src).schema
    m = run_stream(spark, file_source(spark, src, schema), ONLINE_CFG, base)
    return model_view(m.model(), I.EV_DIMS)


@register("outlier_seed", _with(*EV_MODEL, I.nearest_sql("re", "ev_pts", "model", I.EV_DIMS, cp="m",
                                                         extra=", c.n, c.rmsd, c.m0, c.m1"))
          + """, o AS (SELECT *, CASE WHEN n = 1 THEN 2 * rmsd ELSE 2.0 * rmsd END AS radius FROM re),
w AS (SELECT *, CASE WHEN radius > 0 THEN radius ELSE 1.0 END AS width FROM o WHERE NOT dist <= radius)
SELECT mc_id, CAST(floor((x0 - m0) / width) AS BIGINT) AS cell_0, CAST(floor((x1 - m1) / width) AS BIGINT) AS cell_1,
       count(*) AS n, min(pid) AS first_pid, sum(x0) AS cf1x_0, sum(x1) AS cf1x_1,
       sum(x0 * x0) AS cf2x_0, sum(x1 * x1) AS cf2x_1
FROM w GROUP BY 1, 2, 3""")
def q_outlier_seed(spark, sf_dir):
    """STR5: outliers of the whole stream against the fixed-centroid model, summed in the finest cells."""
    pts, model = _ev_model(spark, sf_dir)
    near = split_inliers(assign_nearest(pts, model, I.EV_DIMS)).where(~F.col("is_in"))
    placed = near.join(model.select("mc_id", "centroid"), "mc_id")
    cell = cell_of(F.col("features"), F.col("centroid"), F.col("radius"), I.EV_DIMS)
    out = cell_sums(placed.withColumn("cell", cell), I.EV_DIMS, ["mc_id", "cell"])
    return out.select("mc_id", *I.flat(out, "cell", I.EV_DIMS), "n", "first_pid", *I.flat(out, "cf1x", I.EV_DIMS),
                      *I.flat(out, "cf2x", I.EV_DIMS))


def _li_models(spark, sf_dir) -> DataFrame:
    return refresh_info(I.li_deltas(spark, sf_dir), ["tick"], I.LI_DIMS)


def _centers_out(df: DataFrame, dims: int, group: str = "tick") -> DataFrame:
    return df.select(group, "center_id", *[F.col("center")[d].alias(f"center_{d}") for d in range(dims)])


@register("capacity_merge")
def q_capacity_merge(spark, sf_dir):
    """STR6 loop: every per-tick lineitem model compacted to at most 8
    micro-clusters by rounds of mutual-nearest merges."""
    from ..operators.merge import capacity_merge
    out = capacity_merge(I.li_deltas(spark, sf_dir), ["tick"], I.LI_DIMS, q=8)
    ids = F.concat_ws(",", F.transform(F.array_sort("ids"), lambda x: x.cast("string")))
    return out.select("tick", "mc_id", "n", *[F.col("centroid")[d].alias(f"centroid_{d}") for d in range(I.LI_DIMS)],
                      "rmsd", ids.alias("ids"))


@register("macro_kmeans")
def q_macro_kmeans(spark, sf_dir):
    """CLU5/CLU9: weighted k-means (k = 5, k-means|| seeds, at most 20 rounds) of every model, all ticks in one
    job a round."""
    points = KM.mc_points(cut_lineage(_li_models(spark, sf_dir)), ["tick"])
    seeds = KM.parallel_seeds(points, ["tick"], 5, I.LI_DIMS, I.SEED)
    return _centers_out(KM.lloyd(points, seeds, ["tick"], I.LI_DIMS), I.LI_DIMS)


@register("macro_bisecting")
def q_macro_bisecting(spark, sf_dir):
    """CLU7: weighted bisecting k-means (k = 5) of every model, all ticks in one job a round."""
    points = KM.mc_points(cut_lineage(_li_models(spark, sf_dir)), ["tick"])
    return _centers_out(KM.bisect(points, ["tick"], 5, I.LI_DIMS), I.LI_DIMS)


@register("sampled_kmeans")
def q_sampled_kmeans(spark, sf_dir):
    """CLU4/CLU5/CLU9: k-means (k = 5) over 5000 weighted draws of every model, started at five draws."""
    return _centers_out(KM.sampled_kmeans(cut_lineage(_li_models(spark, sf_dir)), "tick", 5, I.LI_DIMS, 5000, I.SEED), I.LI_DIMS)


@register("horizon_kmeans")
def q_horizon_kmeans(spark, sf_dir):
    """CLU10: horizon model (h = 70 ticks) at the last tick, then k-means k = 5."""
    deltas = I.ev_deltas(spark, sf_dir)
    ticks = deltas.select("tick").distinct()
    now = ticks.agg(F.max("tick")).first()[0]
    saved = P.retained(ticks, now, I.ALPHA, I.L_PARAM)
    req = spark.range(1).select(F.lit(now).cast("bigint").alias("tc"))
    t1, t2 = P.snapshot_pair(req, saved, 70).select("t1", "t2").first()
    snaps = P.snapshots_at(deltas, sorted({t1, t2}), I.EV_DIMS)
    hz = P.horizon(snaps.where(F.col("tick") == t1).drop("tick"), snaps.where(F.col("tick") == t2).drop("tick"),
                   t1, t2, 70, I.EV_DIMS).withColumn("tick", F.lit(now).cast("bigint"))
    info = refresh_info(hz.drop("new_ids"), ["tick"], I.EV_DIMS)
    return _centers_out(M.ml_centers(info, "tick", 5, "kmeans", I.SEED), I.EV_DIMS)


@register("pca_project")
def q_pca_project(spark, sf_dir):
    """PRJ2: embeddings projected on their top 2 principal components."""
    pts = embedding_points(spark, sf_dir)
    out = pca_project(pts, 2)
    return out.select("point_id", "label", F.col("pcs")[0].alias("pc_0"), F.col("pcs")[1].alias("pc_1"))


@register("init_kmeans")
def q_init_kmeans(spark, sf_dir):
    """CLU2: buffer ticks until 2000 points, k-means init (k = q, 10 iterations),
    then the online loop over the rest of the stream."""
    cfg = ONLINE_CFG.replace(init_mode="kmeans", min_init_points=2000)
    m = replay(spark, I.ev_points(spark, sf_dir), cfg, work_dir(spark, "init-kmeans"))
    return model_view(m.model(), I.EV_DIMS)


@register("init_streaming")
def q_init_streaming(spark, sf_dir):
    """CLU3: streaming k-means updates per tick until 2000 points, then init
    and the online loop over the rest of the stream."""
    cfg = ONLINE_CFG.replace(init_mode="streaming", min_init_points=2000)
    m = replay(spark, I.ev_points(spark, sf_dir), cfg, work_dir(spark, "init-streaming"))
    return model_view(m.model(), I.EV_DIMS)


__all__ = ["OnlineModel", "ONLINE_CFG"]
