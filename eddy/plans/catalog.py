"""Registered queries (one per operator group of the inventory) and their SQL twins.

Each query takes (spark, sf_dir) and returns a DataFrame over the whole
tables. `ORACLE[name]` is the DuckDB statement that must return the same
rows; queries without an entry are checked by row count and invariants.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.assign import assign_nearest
from ..operators.cf import cf_aggregate
from ..operators.nearest import refresh_info
from . import inputs as I

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# ----------------------------------------------------------------- flagship

CF_BY_TICK_SQL = _with(
    I.LI_POINTS_SQL,
    I.assigned_sql("asg", "li_pts", I.LI_DIMS, I.LI_Q),
    I.cf_sql("cf", "asg", I.LI_DIMS),
    I.rmsd_sql("cf", I.LI_DIMS),
) + """SELECT tick, mc_id, n, s1_0 AS cf1x_0, s1_1 AS cf1x_1, s1_2 AS cf1x_2,
       s2_0 AS cf2x_0, s2_1 AS cf2x_1, s2_2 AS cf2x_2, cf1t, cf2t, last_tick,
       m0 AS centroid_0, m1 AS centroid_1, m2 AS centroid_2, rmsd
FROM info"""


@register("cf_by_tick", CF_BY_TICK_SQL)
def cf_by_tick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: lineitem points -> nearest of q fixed centroids (JOI1) -> CF per
    (tick, micro-cluster) (AGG1, AGG3, PRJ3) -> centroid and RMSD (PRJ4, PRJ5)."""
    pts = I.li_points(spark, sf_dir)
    cen = I.centers_for(spark, pts, I.LI_Q, I.LI_DIMS)
    cf = cf_aggregate(assign_nearest(pts, cen, I.LI_DIMS), ["tick", "mc_id"], I.LI_DIMS)
    info = refresh_info(cf, ["tick"], I.LI_DIMS)
    d = I.LI_DIMS
    return info.select("tick", "mc_id", "n", *I.flat(info, "cf1x", d), *I.flat(info, "cf2x", d),
                       "cf1t", "cf2t", "last_tick", *I.flat(info, "centroid", d), "rmsd")


# ------------------------------------------------- model-level (lineitem CF)

def _li_info(spark: SparkSession, sf_dir: str, q: int = I.LI_Q) -> DataFrame:
    """The per-tick models: lineitem CF per (tick, micro-cluster) with centroid and RMSD."""
    return refresh_info(I.li_deltas(spark, sf_dir, q), ["tick"], I.LI_DIMS)


def _info_ctes(q: int) -> list[str]:
    return [I.LI_POINTS_SQL, I.assigned_sql("asg", "li_pts", I.LI_DIMS, q), I.cf_sql("cf", "asg", I.LI_DIMS),
            I.rmsd_sql("cf", I.LI_DIMS)]


LI_INFO_CTES = _info_ctes(I.LI_Q)
DENSE_CTES = _info_ctes(I.LI_Q_DENSE)
LI_DD = " + ".join(f"(a.m{d} - b.m{d}) * (a.m{d} - b.m{d})" for d in range(I.LI_DIMS))


def _model_cols(df: DataFrame, dims: int, ids: bool = False) -> list:
    cols = ["tick", "mc_id", "n", *I.flat(df, "cf1x", dims), *I.flat(df, "cf2x", dims),
            "cf1t", "cf2t", "last_tick", *I.flat(df, "centroid", dims), "rmsd"]
    if ids:
        cols.append(F.concat_ws(",", F.transform("ids", lambda x: x.cast("string"))).alias("ids"))
    return cols


def _model_sql_cols(dims: int, src: str = "info") -> str:
    s1 = ", ".join(f"{src}.s1_{d} AS cf1x_{d}" for d in range(dims))
    s2 = ", ".join(f"{src}.s2_{d} AS cf2x_{d}" for d in range(dims))
    m = ", ".join(f"{src}.m{d} AS centroid_{d}" for d in range(dims))
    return f"{src}.tick, {src}.mc_id, {src}.n, {s1}, {s2}, {src}.cf1t, {src}.cf2t, {src}.last_tick, {m}, {src}.rmsd"


@register("overlap_pairs", _with(*DENSE_CTES) + f"""
SELECT a.tick, a.mc_id, b.mc_id AS parent_id, sqrt({LI_DD}) AS dist
FROM info a JOIN info b ON a.tick = b.tick AND b.mc_id < a.mc_id
WHERE sqrt({LI_DD}) <= b.rmsd""")
def q_overlap_pairs(spark, sf_dir):
    """JOI4: pairs (i, j) with j earlier and dist(c_i, c_j) <= rmsd_j."""
    from ..operators.nearest import overlap_pairs
    return overlap_pairs(_li_info(spark, sf_dir, I.LI_Q_DENSE), ["tick"], I.LI_DIMS)


@register("closest_pair", _with(*LI_INFO_CTES) + f"""
SELECT tick, a_id, b_id, dist FROM (
  SELECT a.tick, a.mc_id AS a_id, b.mc_id AS b_id, sqrt({LI_DD}) AS dist,
         row_number() OVER (PARTITION BY a.tick ORDER BY {LI_DD}, a.mc_id, b.mc_id) AS rn
  FROM info a JOIN info b ON a.tick = b.tick AND a.mc_id < b.mc_id) t
WHERE rn = 1""")
def q_closest_pair(spark, sf_dir):
    """JOI5: the closest pair of each model, first pair wins ties."""
    from ..operators.nearest import closest_pair
    return closest_pair(_li_info(spark, sf_dir), ["tick"], I.LI_DIMS)


def _merged_sql(mapping_cte: str, target: str) -> list[str]:
    """CTEs folding `info` rows into `{target}` (NULL = itself) -> `info2` with rmsd."""
    d = I.LI_DIMS
    s1 = ", ".join(f"sum(i.s1_{k}) AS s1_{k}" for k in range(d))
    s2 = ", ".join(f"sum(i.s2_{k}) AS s2_{k}" for k in range(d))
    return [mapping_cte, f"""grp AS (
  SELECT i.tick, coalesce(mp.{target}, i.mc_id) AS mc_id, CAST(sum(i.n) AS BIGINT) AS n, {s1}, {s2},
         CAST(sum(i.cf1t) AS BIGINT) AS cf1t, CAST(sum(i.cf2t) AS BIGINT) AS cf2t, max(i.last_tick) AS last_tick,
         array_to_string(list_sort(list(i.mc_id)), ',') AS ids
  FROM info i LEFT JOIN mp ON i.tick = mp.tick AND i.mc_id = mp.mc_id
  GROUP BY ALL)""", I.rmsd_sql("grp", d, out="info2")]


OVERLAP_MAP = f"""par AS (
  SELECT a.tick, a.mc_id, max(b.mc_id) AS parent_id
  FROM info a JOIN info b ON a.tick = b.tick AND b.mc_id < a.mc_id
  WHERE sqrt({LI_DD}) <= b.rmsd GROUP BY a.tick, a.mc_id),
chain(tick, mc_id, cur) AS (
  SELECT tick, mc_id, parent_id FROM par
  UNION SELECT c.tick, c.mc_id, p.parent_id FROM chain c JOIN par p ON c.tick = p.tick AND c.cur = p.mc_id),
mp AS (SELECT tick, mc_id, min(cur) AS root_id FROM chain GROUP BY tick, mc_id)"""


@register("overlap_merge", "WITH RECURSIVE " + ",\n".join(DENSE_CTES + _merged_sql(OVERLAP_MAP, "root_id"))
          + f"\nSELECT {_model_sql_cols(I.LI_DIMS, 'info2')}, info2.ids FROM info2")
def q_overlap_merge(spark, sf_dir):
    """STR10 + AGG8: each model's overlapping clusters folded into their roots."""
    from ..operators.merge import overlap_merge
    out = overlap_merge(I.li_deltas(spark, sf_dir, I.LI_Q_DENSE), ["tick"], I.LI_DIMS)
    return out.select(*_model_cols(out, I.LI_DIMS, ids=True))


CAPACITY_MAP = f"""mp AS (
  SELECT tick, b_id AS mc_id, a_id AS into_id FROM (
    SELECT a.tick, a.mc_id AS a_id, b.mc_id AS b_id,
           row_number() OVER (PARTITION BY a.tick ORDER BY {LI_DD}, a.mc_id, b.mc_id) AS rn
    FROM info a JOIN info b ON a.tick = b.tick AND a.mc_id < b.mc_id) t WHERE rn = 1)"""


@register("capacity_round", _with(*(LI_INFO_CTES + _merged_sql(CAPACITY_MAP, "into_id")))
          + f"SELECT {_model_sql_cols(I.LI_DIMS, 'info2')}, info2.ids FROM info2")
def q_capacity_round(spark, sf_dir):
    """STR6 (one round): the closest pair of each model is merged."""
    from ..operators.merge import capacity_round
    out = capacity_round(I.li_deltas(spark, sf_dir), ["tick"], I.LI_DIMS)
    return out.select(*_model_cols(out, I.LI_DIMS, ids=True))


NEAR_EDGES = f"""near AS (
  SELECT a.tick, a.mc_id AS src, b.mc_id AS dst, sqrt({LI_DD}) AS dist, b.rmsd AS dst_rmsd,
         row_number() OVER (PARTITION BY a.tick, a.mc_id ORDER BY {LI_DD}, b.mc_id DESC) AS rn
  FROM info a JOIN info b ON a.tick = b.tick AND a.mc_id <> b.mc_id),
edges AS (SELECT tick, src, dst FROM near WHERE rn = 1 AND dist <= dst_rmsd),
und AS (SELECT tick, src AS a, dst AS b FROM edges UNION SELECT tick, dst, src FROM edges),
reach(tick, a, b) AS (
  SELECT tick, a, a FROM und
  UNION SELECT r.tick, r.a, u.b FROM reach r JOIN und u ON r.tick = u.tick AND r.b = u.a),
comp AS (SELECT tick, a AS mc_id, min(b) AS component_id FROM reach GROUP BY tick, a)"""


@register("near_components", "WITH RECURSIVE " + ",\n".join(DENSE_CTES + [NEAR_EDGES])
          + "\nSELECT tick, mc_id, component_id FROM comp")
def q_near_components(spark, sf_dir):
    """AGG9/AGG11: components of the macro-merge edges (id = min member)."""
    from ..operators.graph import connected_components
    from ..operators.merge import near_edges
    info = _li_info(spark, sf_dir, I.LI_Q_DENSE)
    return connected_components(near_edges(info, ["tick"], I.LI_DIMS), ["tick"])


MACRO_SQL = "WITH RECURSIVE " + ",\n".join(DENSE_CTES + [NEAR_EDGES]) + """
SELECT i.tick, coalesce(c.component_id, i.mc_id) AS new_cluster_id, CAST(sum(i.n) AS BIGINT) AS n,
       """ + ", ".join(f"sum(i.s1_{d}) AS cf1x_{d}" for d in range(I.LI_DIMS)) + ",\n       " + \
    ", ".join(f"sum(i.s1_{d}) / sum(i.n) AS centroid_{d}" for d in range(I.LI_DIMS)) + """
FROM info i LEFT JOIN comp c ON i.tick = c.tick AND i.mc_id = c.mc_id
GROUP BY ALL"""


@register("macro_merge", MACRO_SQL)
def q_macro_merge(spark, sf_dir):
    """CLU8 (+JOI6, AGG4, PRJ7, FLT2/3): macro clusters of every model."""
    from ..operators.merge import macro_merge
    out = macro_merge(I.li_deltas(spark, sf_dir, I.LI_Q_DENSE), ["tick"], I.LI_DIMS)
    return out.select("tick", "new_cluster_id", "n", *I.flat(out, "cf1x", I.LI_DIMS),
                      *I.flat(out, "centroid", I.LI_DIMS))
from . import q_events  # noqa: E402,F401
from . import q_macro  # noqa: E402,F401
from . import q_online  # noqa: E402,F401
from . import q_keyed  # noqa: E402,F401
