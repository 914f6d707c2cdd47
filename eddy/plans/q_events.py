"""Registered queries over the events stream: parsing, assignment, split,
tick totals, sliding window, pyramidal snapshots, as-of, horizon, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import cut_lineage, work_dir
from ..operators import pyramid as P
from ..operators.assign import assign_nearest, split_inliers
from ..operators.cf import cf_aggregate, cf_sum, tick_totals
from ..operators.nearest import refresh_info
from ..operators.scale import standardize
from ..operators.window import window_state
from ..sources import snapshots as S
from ..sources.points import parse_points, points_to_text, tick_list
from . import inputs as I
from .catalog import _with, register

D = I.EV_DIMS
EV_CF = [I.EV_POINTS_SQL, I.assigned_sql("easg", "ev_pts", D, I.EV_Q), I.cf_sql("ecf", "easg", D)]


def _cf_cols(df: DataFrame, dims: int, tick: bool = True) -> list:
    return [*(["tick"] if tick else []), "mc_id", "n", *I.flat(df, "cf1x", dims), *I.flat(df, "cf2x", dims),
            "cf1t", "cf2t", "last_tick"]


def _cf_sql_cols(dims: int, src: str, tick: bool = True) -> str:
    s1 = ", ".join(f"{src}.s1_{d} AS cf1x_{d}" for d in range(dims))
    s2 = ", ".join(f"{src}.s2_{d} AS cf2x_{d}" for d in range(dims))
    t = f"{src}.tick, " if tick else ""
    return f"{t}{src}.mc_id, {src}.n, {s1}, {s2}, {src}.cf1t, {src}.cf2t, {src}.last_tick"


# ------------------------------------------------------------ points (SRC3)

@register("parse_points", _with(I.EV_POINTS_SQL, """txt AS (
  SELECT pid, tick, concat_ws(',', CAST(CAST(x0 AS BIGINT) AS VARCHAR), CAST(CAST(x1 AS BIGINT) AS VARCHAR)) AS value
  FROM ev_pts)""") + """SELECT pid AS point_id, tick, value,
       CAST(split_part(value, ',', 1) AS DOUBLE) AS f_0, CAST(split_part(value, ',', 2) AS DOUBLE) AS f_1
FROM txt""")
def q_parse_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC3: events printed as stream messages and parsed back to vectors."""
    text = points_to_text(I.ev_points(spark, sf_dir)).drop("features")
    good, _bad = parse_points(text, D)
    return good.select("point_id", "tick", "value", *I.flat(good, "features", D)).withColumnRenamed(
        "features_0", "f_0").withColumnRenamed("features_1", "f_1")


@register("scale_batch", _with(I.LI_POINTS_SQL, """st AS (
  SELECT tick, count(*) AS n, """ + ", ".join(
    f"sum(x{d}) AS a{d}, sum(x{d} * x{d}) AS b{d}" for d in range(I.LI_DIMS)) + """
  FROM li_pts GROUP BY tick),
ms AS (SELECT tick, """ + ", ".join(
    f"a{d} / n AS mean{d}, CASE WHEN n > 1 THEN sqrt(greatest((b{d} - a{d} * a{d} / n) / (n - 1), 0)) ELSE 0 END AS std{d}"
    for d in range(I.LI_DIMS)) + """ FROM st)""") + "SELECT p.tick, " + ", ".join(
    f"CASE WHEN ms.std{d} > 0 THEN (p.x{d} - ms.mean{d}) / ms.std{d} ELSE 0 END AS z_{d}" for d in range(I.LI_DIMS))
    + "\nFROM li_pts p JOIN ms USING (tick)")
def q_scale_batch(spark, sf_dir):
    """PRJ1/AGG10: z-score of every lineitem point within its tick."""
    z = standardize(I.li_points(spark, sf_dir), ["tick"], I.LI_DIMS)
    return z.select("tick", *[F.col("features")[d].alias(f"z_{d}") for d in range(I.LI_DIMS)])


# ------------------------------------------------------- assignment, split

@register("assign_nearest", _with(I.EV_POINTS_SQL, I.assigned_sql("easg", "ev_pts", D, I.EV_Q))
          + "SELECT pid AS point_id, tick, mc_id, dist FROM easg")
def q_assign_nearest(spark, sf_dir):
    """JOI1/JOI2/PRJ6/ORD2: nearest of the fixed centroids for every event point."""
    pts, box = I.ev_points_box(spark, sf_dir)
    a = assign_nearest(pts, I.centers_for(spark, pts, I.EV_Q, D, box), D)
    return a.select("point_id", "tick", "mc_id", "dist")


def _ev_model(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The events model: CF of all points per fixed centroid, with centroid/RMSD."""
    pts, box = I.ev_points_box(spark, sf_dir)
    cen = I.centers_for(spark, pts, I.EV_Q, D, box)
    cf = cf_aggregate(assign_nearest(pts, cen, D).withColumn("g", F.lit(0)), ["g", "mc_id"], D)
    return pts, refresh_info(cf, ["g"], D)


EV_MODEL = EV_CF[:2] + [
    """ecf AS (SELECT 0 AS g, mc_id, count(*) AS n, sum(x0) AS s1_0, sum(x1) AS s1_1,
           sum(x0 * x0) AS s2_0, sum(x1 * x1) AS s2_1 FROM easg GROUP BY mc_id)""",
    I.rmsd_sql("ecf", D, group="g", out="model"),
]


@register("inlier_outlier", _with(*EV_MODEL, I.nearest_sql("re", "ev_pts", "model", D, cp="m", extra=", c.n, c.rmsd"))
          + """SELECT pid AS point_id, tick, mc_id, dist,
       CASE WHEN n = 1 THEN 2 * rmsd ELSE 2.0 * rmsd END AS radius,
       dist <= CASE WHEN n = 1 THEN 2 * rmsd ELSE 2.0 * rmsd END AS is_in
FROM re""")
def q_inlier_outlier(spark, sf_dir):
    """FLT1: in-lier iff dist <= t_factor*rmsd (2*rmsd for singletons)."""
    pts, model = _ev_model(spark, sf_dir)
    a = split_inliers(assign_nearest(pts, model, D, t_factor=2.0))
    return a.select("point_id", "tick", "mc_id", "dist", "radius", "is_in")


@register("fixed_q_split", _with(*EV_MODEL, I.nearest_sql("re", "ev_pts", "model", D, cp="m", extra=", c.n, c.rmsd"))
          + """SELECT pid AS point_id, tick, mc_id, CASE WHEN dist <= rmsd THEN 'in' ELSE 'out' END AS route
FROM re""")
def q_fixed_q_split(spark, sf_dir):
    """VAR3 split: in-lier iff dist <= rmsd. What is out is then absorbed by a cluster born in the
    same tick (within t_factor * rmsd of it) or founds one: the model step's part."""
    pts, model = _ev_model(spark, sf_dir)
    # JOI2 threshold lookup folded into the assignment: radius = 1 * rmsd
    a = assign_nearest(pts, model, D, t_factor=1.0, plain=True)
    return a.select("point_id", "tick", "mc_id", F.when(F.col("dist") <= F.col("radius"), "in").otherwise("out").alias("route"))


@register("tick_totals", _with(I.EV_POINTS_SQL) + """SELECT tick, batch_n,
       CAST(sum(batch_n) OVER (ORDER BY tick ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total_n
FROM (SELECT tick, count(*) AS batch_n FROM ev_pts GROUP BY tick) t""")
def q_tick_totals(spark, sf_dir):
    """AGG5/FLT4: points per non-empty tick and the running total N."""
    return tick_totals(I.ev_points(spark, sf_dir))


LI_CF = [I.LI_POINTS_SQL, I.assigned_sql("asg", "li_pts", I.LI_DIMS, I.LI_Q), I.cf_sql("cf", "asg", I.LI_DIMS)]


@register("fold_state", _with(*LI_CF) + """SELECT mc_id, CAST(sum(n) AS BIGINT) AS n, """
          + ", ".join(f"sum(s1_{d}) AS cf1x_{d}" for d in range(I.LI_DIMS)) + ", "
          + ", ".join(f"sum(s2_{d}) AS cf2x_{d}" for d in range(I.LI_DIMS))
          + """, CAST(sum(cf1t) AS BIGINT) AS cf1t, CAST(sum(cf2t) AS BIGINT) AS cf2t, max(last_tick) AS last_tick
FROM cf GROUP BY mc_id""")
def q_fold_state(spark, sf_dir):
    """JOI10/AGG2: tick deltas folded into the model (upsert = additive sum)."""
    st = cf_sum(I.li_deltas(spark, sf_dir), ["mc_id"], I.LI_DIMS)
    return st.select(*_cf_cols(st, I.LI_DIMS, tick=False))


# --------------------------------------------------------- sliding window

@register("sliding_window_cf", _with(*EV_CF, f"""ends AS (SELECT DISTINCT tick AS end_tick FROM ev_pts),
win AS (
  SELECT e.end_tick AS tick, d.mc_id, CAST(sum(d.n) AS BIGINT) AS n,
         sum(d.s1_0) AS s1_0, sum(d.s1_1) AS s1_1, sum(d.s2_0) AS s2_0, sum(d.s2_1) AS s2_1,
         CAST(sum(d.cf1t) AS BIGINT) AS cf1t, CAST(sum(d.cf2t) AS BIGINT) AS cf2t, max(d.last_tick) AS last_tick
  FROM ecf d JOIN ends e ON e.end_tick >= d.tick AND e.end_tick < d.tick + {I.EV_DELTA}
  GROUP BY e.end_tick, d.mc_id)""") + f"SELECT {_cf_sql_cols(D, 'win')} FROM win")
def q_sliding_window_cf(spark, sf_dir):
    """STR4/WIN1/JOI8/VAR5: window model (last delta ticks) at every tick."""
    deltas = cut_lineage(I.ev_deltas(spark, sf_dir))          # model-sized, read twice
    last = deltas.agg(F.max("tick")).first()[0]
    w = window_state(deltas, I.EV_DELTA, D, last)
    return w.select(*_cf_cols(w, D))


# ------------------------------------------------------ pyramidal snapshots

def _order_sql(t: str, alpha: int = I.ALPHA, kmax: int = 40) -> str:
    return "(" + " + ".join(f"CASE WHEN {t} % {alpha ** k} = 0 THEN 1 ELSE 0 END" for k in range(1, kmax + 1)) + ")"


SAVED_SQL = f"""ticks AS (SELECT DISTINCT tick FROM ev_pts),
now_t AS (SELECT max(tick) AS now FROM ticks),
ordered AS (SELECT tick, CAST({_order_sql('tick')} AS BIGINT) AS snap_order FROM ticks),
saved AS (SELECT o.tick, o.snap_order FROM ordered o, now_t
          WHERE o.tick + {I.ALPHA ** I.SMALL_L + 1} * CAST(pow({I.ALPHA}, o.snap_order + 1) AS BIGINT) > now_t.now)"""


def _saved(spark, sf_dir, deltas: DataFrame | None = None) -> tuple[DataFrame, int, list[int]]:
    """Kept snapshot ticks at the last tick. The tick list comes from the
    model-sized deltas (every non-empty tick has one), not from the raw table."""
    all_ticks = tick_list(deltas) if deltas is not None else I.ev_ticks(spark, sf_dir)
    ticks = spark.createDataFrame([(t,) for t in all_ticks], "tick bigint")
    now = max(all_ticks)
    saved = P.retained(ticks, now, I.ALPHA, I.SMALL_L)
    return saved, now, tick_list(saved)          # O(alpha^l log T) ticks


@register("pyramid_retained", _with(I.EV_POINTS_SQL, SAVED_SQL) + "SELECT tick, snap_order FROM saved")
def q_pyramid_retained(spark, sf_dir):
    """STR7: snapshots kept at the last tick under alpha=2, l=2."""
    saved, _now, _ = _saved(spark, sf_dir)
    return saved.select("tick", "snap_order")


@register("expire_snapshots", _with(I.EV_POINTS_SQL, SAVED_SQL)
          + f"SELECT s.tick FROM saved s, now_t WHERE s.tick < now_t.now - {I.EV_DELTA - 1}")
def q_expire_snapshots(spark, sf_dir):
    """STR8/ORD3: every kept snapshot older than the window is dropped at once."""
    saved, now, _ = _saved(spark, sf_dir)
    return P.expired(saved, now, I.EV_DELTA).select("tick")


ASOF_SQL = f"""req AS (SELECT tick AS tc FROM ticks),
p1 AS (SELECT r.tc, (SELECT max(s.tick) FROM saved s WHERE s.tick <= r.tc) AS t1 FROM req r),
p2 AS (SELECT p1.tc, p1.t1,
              CASE WHEN p1.t1 IS NULL THEN NULL ELSE coalesce(
                (SELECT max(s.tick) FROM saved s WHERE s.tick <= p1.t1 - {I.HORIZON}),
                (SELECT min(s.tick) FROM saved s)) END AS t2 FROM p1)"""


@register("snapshot_asof", _with(I.EV_POINTS_SQL, SAVED_SQL, ASOF_SQL) + "SELECT tc, t1, t2 FROM p2")
def q_snapshot_asof(spark, sf_dir):
    """JOI9: (t1, t2) snapshot pair of every tick for horizon h."""
    saved, _now, _ = _saved(spark, sf_dir)
    req = I.ev_points(spark, sf_dir).select(F.col("tick").alias("tc")).distinct()
    return P.snapshot_pair(req, saved, I.HORIZON)


SNAP_SQL = """snap AS (
  SELECT s.tick, d.mc_id, CAST(sum(d.n) AS BIGINT) AS n, sum(d.s1_0) AS s1_0, sum(d.s1_1) AS s1_1,
         sum(d.s2_0) AS s2_0, sum(d.s2_1) AS s2_1, CAST(sum(d.cf1t) AS BIGINT) AS cf1t,
         CAST(sum(d.cf2t) AS BIGINT) AS cf2t, max(d.last_tick) AS last_tick
  FROM saved s JOIN ecf d ON d.tick <= s.tick GROUP BY s.tick, d.mc_id)"""


@register("horizon_cf", _with(*EV_CF, SAVED_SQL, ASOF_SQL, SNAP_SQL) + """,
pair AS (SELECT t1, t2 FROM p2 WHERE tc = (SELECT now FROM now_t))
SELECT a.mc_id,
       CASE WHEN b.mc_id IS NULL THEN a.n ELSE a.n - b.n END AS n,
       CASE WHEN b.mc_id IS NULL THEN a.s1_0 ELSE a.s1_0 - b.s1_0 END AS cf1x_0,
       CASE WHEN b.mc_id IS NULL THEN a.s1_1 ELSE a.s1_1 - b.s1_1 END AS cf1x_1,
       CASE WHEN b.mc_id IS NULL THEN a.s2_0 ELSE a.s2_0 - b.s2_0 END AS cf2x_0,
       CASE WHEN b.mc_id IS NULL THEN a.s2_1 ELSE a.s2_1 - b.s2_1 END AS cf2x_1,
       CASE WHEN b.mc_id IS NULL THEN a.cf1t ELSE a.cf1t - b.cf1t END AS cf1t,
       CASE WHEN b.mc_id IS NULL THEN a.cf2t ELSE a.cf2t - b.cf2t END AS cf2t,
       a.last_tick, CAST(a.mc_id AS VARCHAR) AS ids,
       CASE WHEN b.mc_id IS NULL THEN CAST(a.mc_id AS VARCHAR) ELSE '' END AS new_ids
FROM pair, snap a LEFT JOIN snap b ON b.tick = pair.t2 AND b.mc_id = a.mc_id AND a.n - b.n >= 0
WHERE a.tick = pair.t1""")
def q_horizon_cf(spark, sf_dir):
    """STR9/JOI7/SET1: model of the last h ticks at the last tick, by
    subtracting the lineage of snapshot t2 from snapshot t1."""
    deltas = cut_lineage(I.ev_deltas(spark, sf_dir))          # model-sized, reused below
    saved, now, saved_list = _saved(spark, sf_dir, deltas)
    req = spark.range(1).select(F.lit(now).cast("bigint").alias("tc"))
    t1, t2 = P.snapshot_pair(req, saved, I.HORIZON).select("t1", "t2").first()
    snaps = P.snapshots_at(deltas, [t1, t2], D)
    out = P.horizon(snaps.where(F.col("tick") == t1).drop("tick"), snaps.where(F.col("tick") == t2).drop("tick"),
                    t1, t2, I.HORIZON, D)
    txt = lambda c: F.concat_ws(",", F.transform(c, lambda x: x.cast("string")))
    return out.select(*_cf_cols(out, D, tick=False), txt("ids").alias("ids"), txt("new_ids").alias("new_ids"))


MERGED_SQL = """pair AS (SELECT t1, t2 FROM p2 WHERE tc = (SELECT now FROM now_t)),
now_m AS (
  SELECT mc_id - mc_id % 3 AS mc_id, sum(n) AS n, sum(s1_0) AS s1_0, sum(s1_1) AS s1_1, sum(s2_0) AS s2_0, sum(s2_1) AS s2_1,
         sum(cf1t) AS cf1t, sum(cf2t) AS cf2t, max(last_tick) AS last_tick, list_sort(list(mc_id)) AS ids
  FROM pair JOIN snap ON tick = t1 GROUP BY 1),
then_m AS (
  SELECT mc_id - mc_id % 3 AS mc_id, sum(n) AS n, sum(s1_0) AS s1_0, sum(s1_1) AS s1_1, sum(s2_0) AS s2_0, sum(s2_1) AS s2_1,
         sum(cf1t) AS cf1t, sum(cf2t) AS cf2t, list(mc_id) AS ids
  FROM pair JOIN snap ON tick = t2 AND mc_id % 3 <> 2 GROUP BY 1)"""


@register("horizon_lineage", _with(*EV_CF, SAVED_SQL, ASOF_SQL, SNAP_SQL, MERGED_SQL) + """
SELECT a.mc_id, CAST(a.n - coalesce(b.n, 0) AS BIGINT) AS n,
       a.s1_0 - coalesce(b.s1_0, 0) AS cf1x_0, a.s1_1 - coalesce(b.s1_1, 0) AS cf1x_1,
       a.s2_0 - coalesce(b.s2_0, 0) AS cf2x_0, a.s2_1 - coalesce(b.s2_1, 0) AS cf2x_1,
       CAST(a.cf1t - coalesce(b.cf1t, 0) AS BIGINT) AS cf1t, CAST(a.cf2t - coalesce(b.cf2t, 0) AS BIGINT) AS cf2t, a.last_tick,
       array_to_string(a.ids, ',') AS ids,
       array_to_string([x FOR x IN a.ids IF NOT coalesce(list_contains(b.ids, x), false)], ',') AS new_ids
FROM now_m a LEFT JOIN then_m b USING (mc_id)""")
def q_horizon_lineage(spark, sf_dir):
    """STR9/JOI7/SET1 with merged clusters: at the last tick three neighbours are one cluster, and
    every third one is taken as born after the earlier snapshot."""
    deltas = cut_lineage(I.ev_deltas(spark, sf_dir))          # model-sized, reused below
    saved, now, _ = _saved(spark, sf_dir, deltas)
    req = spark.range(1).select(F.lit(now).cast("bigint").alias("tc"))
    t1, t2 = P.snapshot_pair(req, saved, I.HORIZON).select("t1", "t2").first()
    snaps = P.snapshots_at(deltas, [t1, t2], D)
    root = F.col("mc_id") - F.col("mc_id") % 3
    merged = cf_sum(snaps.where(F.col("tick") == t1).drop("tick").withColumn("mc_id", root), ["mc_id"], D, ids=True)
    out = P.horizon(merged, snaps.where((F.col("tick") == t2) & (F.col("mc_id") % 3 != 2)).drop("tick"),
                    t1, t2, I.HORIZON, D)
    txt = lambda c: F.concat_ws(",", F.transform(c, lambda x: x.cast("string")))
    return out.select(*_cf_cols(out, D, tick=False), txt("ids").alias("ids"), txt("new_ids").alias("new_ids"))


@register("sliding_window_lineage", _with(*EV_CF, f"""ends AS (SELECT DISTINCT tick AS end_tick FROM ev_pts),
win AS (
  SELECT e.end_tick AS tick, d.mc_id - d.mc_id % 3 AS mc_id, CAST(sum(d.n) AS BIGINT) AS n,
         sum(d.s1_0) AS s1_0, sum(d.s1_1) AS s1_1, sum(d.s2_0) AS s2_0, sum(d.s2_1) AS s2_1,
         CAST(sum(d.cf1t) AS BIGINT) AS cf1t, CAST(sum(d.cf2t) AS BIGINT) AS cf2t, max(d.last_tick) AS last_tick
  FROM ecf d JOIN ends e ON e.end_tick >= d.tick AND e.end_tick < d.tick + {I.EV_DELTA}
  GROUP BY e.end_tick, d.mc_id - d.mc_id % 3)""") + f"SELECT {_cf_sql_cols(D, 'win')} FROM win")
def q_sliding_window_lineage(spark, sf_dir):
    """STR4/JOI8 with merged clusters: deltas of three neighbours count for their common root."""
    deltas = cut_lineage(I.ev_deltas(spark, sf_dir))
    last = deltas.agg(F.max("tick")).first()[0]
    members = deltas.select((F.col("mc_id") - F.col("mc_id") % 3).alias("mc_id"), F.col("mc_id").alias("member_id")).distinct()
    w = window_state(deltas, I.EV_DELTA, D, last, lineage_map=members)
    return w.select(*_cf_cols(w, D))


@register("online_centers", _with(*EV_CF, SAVED_SQL, SNAP_SQL)
          + "SELECT tick, mc_id, s1_0 / n AS center_0, s1_1 / n AS center_1 FROM snap WHERE n > 0")
def q_online_centers(spark, sf_dir):
    """STR12/PRJ4/SRC9: centers of every kept snapshot."""
    deltas = cut_lineage(I.ev_deltas(spark, sf_dir))
    _saved_df, _now, ticks = _saved(spark, sf_dir, deltas)
    snaps = P.snapshots_at(deltas, ticks, D)
    c = S.centers(snaps)
    return c.select("tick", "mc_id", *[F.col("center")[d].alias(f"center_{d}") for d in range(D)])


REPORT_LINE = """concat('ids=[', CAST(mc_id AS VARCHAR), '] cf2x=[', CAST(CAST(s2_0 / 8.0 AS DECIMAL(38,6)) AS VARCHAR), ',',
         CAST(CAST(s2_1 / 8.0 AS DECIMAL(38,6)) AS VARCHAR), '] cf1x=[', CAST(CAST(s1_0 / 8.0 AS DECIMAL(38,6)) AS VARCHAR), ',',
         CAST(CAST(s1_1 / 8.0 AS DECIMAL(38,6)) AS VARCHAR), '] cf2t=', CAST(cf2t AS VARCHAR), ' cf1t=', CAST(cf1t AS VARCHAR),
         ' n=', CAST(n AS VARCHAR))"""


@register("snapshot_report", _with(*EV_CF, SAVED_SQL, SNAP_SQL) + f"""SELECT tick, mc_id, n, {REPORT_LINE} AS line,
       CAST(sum(n) OVER (PARTITION BY tick) AS BIGINT) AS snapshot_n
FROM snap""")
def q_snapshot_report(spark, sf_dir):
    """SRC10: one text line per micro-cluster of every kept snapshot, plus the
    snapshot's total n; the sums are printed in eighths, so they are no integers."""
    deltas = cut_lineage(I.ev_deltas(spark, sf_dir))
    _saved_df, _now, ticks = _saved(spark, sf_dir, deltas)
    snaps = P.snapshots_at(deltas, ticks, D)
    eighths = {c: F.transform(c, lambda x: x / F.lit(8.0)) for c in ("cf1x", "cf2x")}
    return S.report(snaps.withColumns(eighths), digits=6).select("tick", "mc_id", "n", "line", "snapshot_n")


@register("snapshot_roundtrip", _with(*EV_CF, SAVED_SQL, SNAP_SQL, f"""win AS (
  SELECT s.tick, d.mc_id, CAST(sum(d.n) AS BIGINT) AS n, sum(d.s1_0) AS s1_0, sum(d.s1_1) AS s1_1,
         sum(d.s2_0) AS s2_0, sum(d.s2_1) AS s2_1, CAST(sum(d.cf1t) AS BIGINT) AS cf1t,
         CAST(sum(d.cf2t) AS BIGINT) AS cf2t, max(d.last_tick) AS last_tick
  FROM saved s JOIN ecf d ON d.tick <= s.tick AND d.tick > s.tick - {I.EV_DELTA} GROUP BY s.tick, d.mc_id)""")
          + f"""SELECT 'cumulative' AS kind, {_cf_sql_cols(D, 'snap')} FROM snap
UNION ALL SELECT 'window' AS kind, {_cf_sql_cols(D, 'win')} FROM win""")
def q_snapshot_roundtrip(spark, sf_dir):
    """SRC5-SRC8: cumulative and window snapshots written partitioned by
    (kind, tick) under the shared checkpoint folder, then read back."""
    deltas = cut_lineage(I.ev_deltas(spark, sf_dir))
    _saved_df, now, ticks = _saved(spark, sf_dir, deltas)
    cum = P.snapshots_at(deltas, ticks, D).drop("ids")
    win = window_state(deltas, I.EV_DELTA, D, now, ends=ticks)
    path = work_dir(spark, "snapshots")
    S.write_snapshots(cum, path, "cumulative")
    S.write_snapshots(win, path, "window")
    back = S.read_snapshots(spark, path)
    return back.select("kind", *_cf_cols(back, D))
