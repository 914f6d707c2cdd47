"""Registered queries: embeddings searches, weights, sampling, macro steps,
offline sweep, initialisation and recency variants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import cut_lineage, work_dir
from ..operators import macro as M
from ..operators import pyramid as P
from ..operators.assign import assign_nearest
from ..operators.cf import cf_aggregate, cf_sum, drop_empty
from ..operators.init import bounding_box, random_centers
from ..operators.merge import macro_merge
from ..operators.nearest import nearest_other, nonzero_min_dist, refresh_info
from ..operators.recency import A, B, C, D as DCOEF, P_LOW, recency_keep, recency_stamp
from ..sources.points import embedding_points, parse_points, points_to_text, tick_list
from . import inputs as I
from .catalog import DENSE_CTES, LI_INFO_CTES, _with, register
from .q_events import EV_CF, LI_CF

E_DIMS = 64


# ------------------------------------------------------- embeddings (F3)

def _emb_info(spark, sf_dir) -> DataFrame:
    pts = embedding_points(spark, sf_dir).withColumn("g", F.lit(0).cast("bigint"))
    cf = cf_aggregate(pts.withColumn("tick", F.lit(0)).withColumnRenamed("label", "mc_id"), ["g", "mc_id"], E_DIMS)
    return refresh_info(cf, ["g"], E_DIMS)


EMB_CTES = [
    "emb AS (SELECT CAST(label AS BIGINT) AS mc_id, " + ", ".join(
        f"floor(CAST(embedding[{d + 1}] AS DOUBLE) * CAST(1000000 AS DOUBLE) + 0.5) AS x{d}" for d in range(E_DIMS))
    + " FROM embeddings)",
    "ecc AS (SELECT mc_id, count(*) AS n, " + ", ".join(f"sum(x{d}) / count(*) AS m{d}" for d in range(E_DIMS))
    + " FROM emb GROUP BY mc_id)",
]
EMB_DD = " + ".join(f"(a.m{d} - b.m{d}) * (a.m{d} - b.m{d})" for d in range(E_DIMS))


@register("nearest_other", _with(*EMB_CTES) + f"""SELECT mc_id, near_id, near_dist FROM (
  SELECT a.mc_id, b.mc_id AS near_id, sqrt({EMB_DD}) AS near_dist,
         row_number() OVER (PARTITION BY a.mc_id ORDER BY {EMB_DD}, b.mc_id DESC) AS rn
  FROM ecc a JOIN ecc b ON a.mc_id <> b.mc_id) t WHERE rn = 1""")
def q_nearest_other(spark, sf_dir):
    """JOI3: nearest other micro-cluster (one per label, 64 dims); ties to the
    highest position, as the offline scan runs last to first."""
    out = nearest_other(_emb_info(spark, sf_dir), ["g"], E_DIMS, tie="last")
    return out.select("mc_id", "near_id", "near_dist")


@register("nonzero_min_dist", _with(*EMB_CTES) + f"""SELECT a.mc_id,
       coalesce(sqrt(min(CASE WHEN ({EMB_DD}) <> 0 THEN ({EMB_DD}) END)), CAST('inf' AS DOUBLE)) AS min_nonzero_dist
FROM ecc a JOIN ecc b ON true GROUP BY a.mc_id""")
def q_nonzero_min_dist(spark, sf_dir):
    """AGG6: distance to the nearest centroid at non-zero distance."""
    out = nonzero_min_dist(_emb_info(spark, sf_dir), ["g"], E_DIMS)
    return out.select("mc_id", "min_nonzero_dist")


# ------------------------------------------------- weights and sampling

@register("mc_weights", _with(*LI_CF) + """SELECT tick, mc_id,
       CAST(n AS DOUBLE) / CAST(sum(n) OVER (PARTITION BY tick) AS DOUBLE) AS weight
FROM cf WHERE n > 0""")
def q_mc_weights(spark, sf_dir):
    """AGG7: n / sum(n) per model."""
    from ..operators.cf import weights
    return weights(I.li_deltas(spark, sf_dir), ["tick"]).select("tick", "mc_id", "weight")


NUM_DRAWS = 5000


@register("weighted_sample", _with(*LI_CF, f"""cw AS (
  SELECT tick, mc_id, sum(n) OVER (PARTITION BY tick ORDER BY mc_id ROWS UNBOUNDED PRECEDING) AS cum_n,
         sum(n) OVER (PARTITION BY tick) AS total
  FROM cf WHERE n > 0),
tot AS (SELECT DISTINCT tick, total FROM cw),
dr AS (SELECT t.tick, r.range AS draw,
              CAST((r.range * {M.DRAW_MUL_K} + t.tick * {M.DRAW_MUL_G} + {I.SEED}) % {M.DRAW_MOD} AS DOUBLE)
                / CAST({M.DRAW_MOD} AS DOUBLE) * CAST(t.total AS DOUBLE) AS v
       FROM tot t, range({NUM_DRAWS}) r),
pick AS (SELECT d.tick, d.draw, coalesce(
           (SELECT min(c.mc_id) FROM cw c WHERE c.tick = d.tick AND CAST(c.cum_n AS DOUBLE) >= d.v),
           (SELECT min(c.mc_id) FROM cw c WHERE c.tick = d.tick)) AS mc_id FROM dr d)""")
          + "SELECT tick, mc_id, count(*) AS draws FROM pick GROUP BY tick, mc_id")
def q_weighted_sample(spark, sf_dir):
    """CLU4: 5000 weighted draws of micro-clusters per model, counted."""
    d = M.weighted_draws(I.li_deltas(spark, sf_dir), "tick", NUM_DRAWS, I.SEED)
    return d.groupBy("tick", "mc_id").agg(F.count(F.lit(1)).alias("draws"))


K_MACRO = 5
LI_D = I.LI_DIMS
_CEN = f"""cen0 AS (
  SELECT tick, CAST(row_number() OVER (PARTITION BY tick ORDER BY n DESC, mc_id) - 1 AS BIGINT) AS center_id,
         n AS w, {', '.join(f'm{d} AS c{d}' for d in range(LI_D))}
  FROM info QUALIFY center_id < {K_MACRO}),
asg_c AS (
  SELECT i.tick, i.mc_id, i.n, {', '.join(f'i.s1_{d}' for d in range(LI_D))}, c.center_id,
         row_number() OVER (PARTITION BY i.tick, i.mc_id ORDER BY {' + '.join(f'(i.m{d} - c.c{d}) * (i.m{d} - c.c{d})' for d in range(LI_D))}, c.center_id) AS rn
  FROM info i JOIN cen0 c ON i.tick = c.tick),
sums AS (SELECT tick, center_id, CAST(sum(n) AS BIGINT) AS m, {', '.join(f'sum(s1_{d}) AS t{d}' for d in range(LI_D))}
         FROM asg_c WHERE rn = 1 GROUP BY tick, center_id)"""


@register("lloyd_step", _with(*LI_INFO_CTES, _CEN) + "SELECT c.tick, c.center_id, CAST(coalesce(s.m, 0) AS BIGINT) AS n, "
          + ", ".join(f"CASE WHEN s.m IS NULL THEN c.c{d} ELSE s.t{d} / s.m END AS center_{d}" for d in range(LI_D))
          + "\nFROM cen0 c LEFT JOIN sums s USING (tick, center_id)")
def q_lloyd_step(spark, sf_dir):
    """CLU5 (one iteration): weighted Lloyd step from the k heaviest clusters."""
    out = M.lloyd_step(refresh_info(I.li_deltas(spark, sf_dir), ["tick"], LI_D), "tick", K_MACRO, LI_D)
    return out.select("tick", "center_id", "n", *[F.col("center")[d].alias(f"center_{d}") for d in range(LI_D)])


def _lloyd_sql(rounds: int) -> str:
    d = range(LI_D)
    ctes = [f"""l0 AS (SELECT tick, center_id, CAST(0 AS DOUBLE) AS n, {', '.join(f'c{k}' for k in d)} FROM cen0)"""]
    for r in range(rounds):
        dd = " + ".join(f"(i.m{k} - c.c{k}) * (i.m{k} - c.c{k})" for k in d)
        ctes.append(f"""p{r} AS (SELECT i.tick, i.n, {', '.join(f'i.s1_{k}' for k in d)}, c.center_id,
         row_number() OVER (PARTITION BY i.tick, i.mc_id ORDER BY {dd}, c.center_id) AS rn FROM info i JOIN l{r} c ON i.tick = c.tick),
g{r} AS (SELECT tick, center_id, CAST(sum(n) AS DOUBLE) AS m, {', '.join(f'sum(s1_{k}) AS t{k}' for k in d)} FROM p{r} WHERE rn = 1 GROUP BY 1, 2),
l{r + 1} AS (SELECT c.tick, c.center_id, coalesce(g.m, 0) AS n, {', '.join(f'CASE WHEN g.m IS NULL THEN c.c{k} ELSE g.t{k} / g.m END AS c{k}' for k in d)}
  FROM l{r} c LEFT JOIN g{r} g USING (tick, center_id))""")
    return (_with(*DENSE_CTES, _CEN, *ctes) + f"SELECT tick, center_id, n, {', '.join(f'c{k} AS center_{k}' for k in d)} FROM l{rounds}")


@register("lloyd_rounds", _lloyd_sql(4))
def q_lloyd_rounds(spark, sf_dir):
    """CLU5: four weighted Lloyd rounds from the k heaviest clusters of every model, all ticks in one job a round."""
    from ..operators import kmeans as KM
    points = KM.mc_points(cut_lineage(refresh_info(I.li_deltas(spark, sf_dir, I.LI_Q_DENSE), ["tick"], LI_D)), ["tick"])
    out = KM.lloyd(points, KM.heaviest(points, ["tick"], K_MACRO), ["tick"], LI_D, rounds=4, tol=0.0)
    return out.select("tick", "center_id", "n", *[F.col("center")[d].alias(f"center_{d}") for d in range(LI_D)])


@register("streaming_kmeans_step", _with(*LI_INFO_CTES, _CEN, """ww AS (
  SELECT c.*, CAST(c.w AS DOUBLE) / CAST(sum(c.w) OVER (PARTITION BY c.tick) AS DOUBLE) AS w0 FROM cen0 c),
tt AS (SELECT tick, sum(n) AS total FROM info GROUP BY tick),
wz AS (SELECT ww.*, CAST(ww.w AS DOUBLE) / CAST(tt.total AS DOUBLE) AS wt FROM ww JOIN tt USING (tick)),
up AS (SELECT wz.*, s.m, """ + ", ".join(f"s.t{d}" for d in range(LI_D)) + """,
              wz.wt * 1.0 + CAST(s.m AS DOUBLE) AS w2 FROM wz LEFT JOIN sums s USING (tick, center_id))""")
          + "SELECT tick, center_id, CASE WHEN m > 0 THEN w2 ELSE wt * 1.0 END AS weight, "
          + ", ".join(f"CASE WHEN m > 0 THEN (1.0 - CAST(m AS DOUBLE) / greatest(w2, 1e-16)) * c{d} + "
                      f"(CAST(m AS DOUBLE) / greatest(w2, 1e-16) / CAST(m AS DOUBLE)) * t{d} ELSE c{d} END AS center_{d}"
                      for d in range(LI_D)) + " FROM up")
def q_streaming_kmeans_step(spark, sf_dir):
    """CLU6: one streaming k-means update (decay 1, batches) on each model."""
    out = M.streaming_kmeans_step(refresh_info(I.li_deltas(spark, sf_dir), ["tick"], LI_D), "tick", K_MACRO, LI_D)
    return out.select("tick", "center_id", "weight", *[F.col("center")[d].alias(f"center_{d}") for d in range(LI_D)])


# ------------------------------------------------------- offline sweep (CLU9)

def _sweep_sql() -> str:
    d = I.EV_DIMS
    dd = " + ".join(f"(a.m{k} - b.m{k}) * (a.m{k} - b.m{k})" for k in range(d))
    snap = f"""snap AS (
  SELECT s.tick, d.mc_id, CAST(sum(d.n) AS BIGINT) AS n, {', '.join(f'sum(d.s1_{k}) AS s1_{k}' for k in range(d))},
         {', '.join(f'sum(d.s2_{k}) AS s2_{k}' for k in range(d))}
  FROM (SELECT DISTINCT tick FROM ev_pts) s JOIN ecf d ON d.tick <= s.tick
  GROUP BY s.tick, d.mc_id)"""
    edges = f"""near AS (
  SELECT a.tick, a.mc_id AS src, b.mc_id AS dst, sqrt({dd}) AS dist, b.rmsd AS dst_rmsd,
         row_number() OVER (PARTITION BY a.tick, a.mc_id ORDER BY {dd}, b.mc_id DESC) AS rn
  FROM info a JOIN info b ON a.tick = b.tick AND a.mc_id <> b.mc_id),
edges AS (SELECT tick, src, dst FROM near WHERE rn = 1 AND dist <= dst_rmsd),
und AS (SELECT tick, src AS a, dst AS b FROM edges UNION SELECT tick, dst, src FROM edges),
reach(tick, a, b) AS (
  SELECT tick, a, a FROM und
  UNION SELECT r.tick, r.a, u.b FROM reach r JOIN und u ON r.tick = u.tick AND r.b = u.a),
comp AS (SELECT tick, a AS mc_id, min(b) AS component_id FROM reach GROUP BY tick, a)"""
    return ("WITH RECURSIVE " + ",\n".join(EV_CF + [snap, I.rmsd_sql("snap", d), edges]) + """
SELECT i.tick, coalesce(c.component_id, i.mc_id) AS new_cluster_id, CAST(sum(i.n) AS BIGINT) AS n, """
            + ", ".join(f"sum(i.s1_{k}) / sum(i.n) AS center_{k}" for k in range(d)) + """
FROM info i LEFT JOIN comp c ON i.tick = c.tick AND i.mc_id = c.mc_id GROUP BY ALL""")


@register("offline_sweep", _sweep_sql())
def q_offline_sweep(spark, sf_dir):
    """CLU9 (merge path): macro merge of the cumulative snapshot at every tick,
    all ticks in one set of jobs."""
    return sweep(spark, sf_dir)


def sweep(spark, sf_dir, start: int | None = None, end: int | None = None) -> DataFrame:
    """The sweep over ticks start to end (both inclusive; default all)."""
    deltas = cut_lineage(I.ev_deltas(spark, sf_dir))          # model-sized, read twice
    ticks = [t for t in tick_list(deltas) if (start is None or t >= start) and (end is None or t <= end)]
    snaps = P.snapshots_at(deltas, ticks, I.EV_DIMS).drop("ids")
    out = macro_merge(snaps, ["tick"], I.EV_DIMS)
    return out.select("tick", "new_cluster_id", "n", *[F.col("centroid")[k].alias(f"center_{k}")
                                                       for k in range(I.EV_DIMS)])


# ------------------------------------------------------------ init (CLU1)

def init_model(spark, pts: DataFrame, q: int, dims: int, seed: int) -> DataFrame:
    """CLU1: q uniform centroids in the batch's box -> assign -> CF -> refresh
    (empty clusters keep their start centroid for the singleton RMSD) -> drop
    empty clusters (D18)."""
    cen = random_centers(spark, q, bounding_box(pts, dims), seed)
    cf = cf_aggregate(assign_nearest(pts, cen, dims), ["mc_id"], dims)
    zero = F.array(*[F.lit(0.0)] * dims)
    full = (cen.join(cf, "mc_id", "left")
            .select(F.lit(0).alias("g"), "mc_id", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"),
                    F.coalesce("cf1x", zero).alias("cf1x"), F.coalesce("cf2x", zero).alias("cf2x"),
                    F.coalesce("cf1t", F.lit(0).cast("bigint")).alias("cf1t"),
                    F.coalesce("cf2t", F.lit(0).cast("bigint")).alias("cf2t"), "last_tick", "centroid"))
    return drop_empty(refresh_info(full, ["g"], dims)).drop("g")


def _init_sql(src_cte: str) -> str:
    d = I.EV_DIMS
    dd = " + ".join(f"(a.m{k} - b.m{k}) * (a.m{k} - b.m{k})" for k in range(d))
    s2 = " + ".join(f"s2_{k}" for k in range(d))
    s1 = " + ".join(f"s1_{k} * s1_{k}" for k in range(d))
    return _with(I.EV_POINTS_SQL, src_cte, I.assigned_sql("ia", "b1", d, I.EV_Q), f"""icf AS (
  SELECT c.mc_id, count(a.pid) AS n, {', '.join(f'coalesce(sum(a.x{k}), 0) AS s1_{k}' for k in range(d))},
         {', '.join(f'coalesce(sum(a.x{k} * a.x{k}), 0) AS s2_{k}' for k in range(d))},
         CAST(coalesce(sum(a.tick), 0) AS BIGINT) AS cf1t, CAST(coalesce(sum(a.tick * a.tick), 0) AS BIGINT) AS cf2t,
         max(a.tick) AS last_tick,
         {', '.join(f'CASE WHEN count(a.pid) > 0 THEN sum(a.x{k}) / count(a.pid) ELSE any_value(c.c{k}) END AS m{k}' for k in range(d))}
  FROM ia_cen c LEFT JOIN ia a ON a.mc_id = c.mc_id GROUP BY c.mc_id),
inz AS (SELECT a.mc_id, coalesce(sqrt(min(CASE WHEN ({dd}) <> 0 THEN ({dd}) END)), CAST('inf' AS DOUBLE)) AS nzd
        FROM icf a JOIN icf b ON true GROUP BY a.mc_id)""") + f"""SELECT i.mc_id, i.n, {', '.join(f'i.s1_{k} AS cf1x_{k}' for k in range(d))},
       {', '.join(f'i.s2_{k} AS cf2x_{k}' for k in range(d))}, i.cf1t, i.cf2t, i.last_tick,
       {', '.join(f'i.m{k} AS centroid_{k}' for k in range(d))},
       CASE WHEN i.n > 1 THEN sqrt(greatest(({s2}) / i.n - ({s1}) / (i.n * i.n), 0)) ELSE z.nzd END AS rmsd
FROM icf i JOIN inz z USING (mc_id) WHERE i.n > 0"""


INIT_SQL = _init_sql("b1 AS (SELECT * FROM ev_pts WHERE tick = 1)")


def _model_out(m: DataFrame, dims: int) -> DataFrame:
    return m.select("mc_id", "n", *I.flat(m, "cf1x", dims), *I.flat(m, "cf2x", dims), "cf1t", "cf2t", "last_tick",
                    *I.flat(m, "centroid", dims), "rmsd")


@register("init_random", INIT_SQL)
def q_init_random(spark, sf_dir):
    """CLU1: random initialisation on the first tick of the events stream."""
    pts = I.ev_points(spark, sf_dir).where(F.col("tick") == 1)
    return _model_out(init_model(spark, pts, I.EV_Q, I.EV_DIMS, I.SEED), I.EV_DIMS)


@register("init_from_file", INIT_SQL)
def q_init_from_file(spark, sf_dir):
    """SRC4: the first tick written as text lines, read back, parsed and used
    to initialise the model."""
    pts = I.ev_points(spark, sf_dir).where(F.col("tick") == 1)
    path = work_dir(spark, "init-points")
    points_to_text(pts).select("value").write.mode("overwrite").text(path)
    good, _bad = parse_points(spark.read.text(path), I.EV_DIMS)
    back = good.withColumn("tick", F.lit(1).cast("bigint"))
    return _model_out(init_model(spark, back, I.EV_Q, I.EV_DIMS, I.SEED), I.EV_DIMS)


# --------------------------------------------------------- recency (VAR1/2)

M_LAST = 20
REC_DELTA = 2


def _horner_sql(coefs, x: str) -> str:
    acc = repr(coefs[0])
    for c in coefs[1:]:
        acc = f"({acc} * {x} + {c!r})"
    return acc


def _inv_norm_sql(p: str) -> str:
    ql = f"sqrt(-2.0 * ln({p}))"
    qh = f"sqrt(-2.0 * ln(1.0 - {p}))"
    qc = f"({p} - 0.5)"
    r = f"({qc} * {qc})"
    lo = f"{_horner_sql(C, ql)} / ({_horner_sql(DCOEF, ql)} * {ql} + 1.0)"
    mid = f"{_horner_sql(A, r)} * {qc} / ({_horner_sql(B, r)} * {r} + 1.0)"
    hi = f"-{_horner_sql(C, qh)} / ({_horner_sql(DCOEF, qh)} * {qh} + 1.0)"
    return f"CASE WHEN {p} < {P_LOW!r} THEN {lo} WHEN {p} <= {1.0 - P_LOW!r} THEN {mid} ELSE {hi} END"


REC_CTE = f"""st AS (SELECT mc_id, CAST(sum(n) AS BIGINT) AS n, CAST(sum(cf1t) AS BIGINT) AS cf1t,
              CAST(sum(cf2t) AS BIGINT) AS cf2t FROM cf GROUP BY mc_id),
mu AS (SELECT mc_id, n, cf1t, cf2t, CAST(cf1t AS DOUBLE) / CAST(n AS DOUBLE) AS mean,
              1.0 - CAST({M_LAST} AS DOUBLE) / (2.0 * CAST(n AS DOUBLE)) AS p FROM st),
rc AS (SELECT mc_id, n, CASE WHEN n <= 0 THEN NULL WHEN n < {2 * M_LAST} THEN mean
              ELSE mean + sqrt(greatest(CAST(cf2t AS DOUBLE) / CAST(n AS DOUBLE) - mean * mean, 0.0)) * ({_inv_norm_sql('p')})
              END AS stamp FROM mu)"""


def _li_state(spark, sf_dir) -> DataFrame:
    return cf_sum(I.li_deltas(spark, sf_dir), ["mc_id"], LI_D)


@register("recency_stamp", _with(*LI_CF, REC_CTE) + "SELECT mc_id, n, stamp FROM rc")
def q_recency_stamp(spark, sf_dir):
    """VAR1: recency stamp of every micro-cluster of the folded lineitem model."""
    return recency_stamp(_li_state(spark, sf_dir), M_LAST).select("mc_id", "n", "stamp")


@register("recency_keep", _with(*LI_CF, REC_CTE) + f"""SELECT mc_id, n > 0 AND stamp >= (SELECT max(tick) FROM li_pts) - {REC_DELTA} AS keep
FROM rc""")
def q_recency_keep(spark, sf_dir):
    """VAR2: keep flag; a cluster may be deleted when stale or empty."""
    now = I.li_points(spark, sf_dir).agg(F.max("tick")).first()[0]
    return recency_keep(_li_state(spark, sf_dir), M_LAST, now, REC_DELTA).select("mc_id", "keep")
