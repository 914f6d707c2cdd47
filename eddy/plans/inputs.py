"""Standard derived inputs shared by the registered queries and their SQL twins.

Every input reads the driver's tables; nothing is synthesised. The SQL
fragments below are the DuckDB spelling of the same derivations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.assign import assign_nearest
from ..operators.cf import cf_aggregate
from ..operators.init import HEX_DIGITS, bounding_box, random_centers
from ..sources.points import events_points, lineitem_points

# Fixed parameters of the registered queries.
LI_DIMS = 3
EV_DIMS = 2
LI_Q = 16          # centroids over lineitem points
LI_Q_DENSE = 200   # so many that micro-clusters overlap: the merge queries
EV_Q = 12          # centroids over events points
SEED = 17
EV_DELTA = 6       # sliding window in ticks (the reference's run uses 6)
ALPHA = 2          # pyramidal schedule of the reference's run
L_PARAM = 10
SMALL_L = 2        # the method's default l, thins retention at 30 ticks
HORIZON = 7


def li_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineitem_points(spark, sf_dir)


def ev_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_points(spark, sf_dir)


def centers_for(spark: SparkSession, points: DataFrame, q: int, dims: int, box=None) -> DataFrame:
    return random_centers(spark, q, box if box is not None else bounding_box(points, dims), SEED)


def li_centers(spark, sf_dir):
    return centers_for(spark, li_points(spark, sf_dir), LI_Q, LI_DIMS)


def ev_points_box(spark: SparkSession, sf_dir: str):
    """Events points and their bounding box from the same per-day aggregate."""
    return events_points(spark, sf_dir, with_box=True)


def ev_ticks(spark: SparkSession, sf_dir: str) -> list[int]:
    """Ticks of the events stream: 1..number of distinct days (one aggregate)."""
    from ..sources.points import MAX_TICKS, table
    n = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day")).distinct().count()
    if n > MAX_TICKS:
        raise ValueError(f"more than {MAX_TICKS} distinct days")
    return list(range(1, n + 1))


def ev_centers(spark, sf_dir):
    pts, box = ev_points_box(spark, sf_dir)
    return centers_for(spark, pts, EV_Q, EV_DIMS, box)


def li_deltas(spark: SparkSession, sf_dir: str, q: int = LI_Q) -> DataFrame:
    """Per-tick CF of lineitem points assigned to q fixed centroids."""
    pts = li_points(spark, sf_dir)
    cen = centers_for(spark, pts, q, LI_DIMS)
    return cf_aggregate(assign_nearest(pts, cen, LI_DIMS), ["tick", "mc_id"], LI_DIMS)


def ev_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tick deltas of the events stream against the fixed centroids."""
    pts, box = ev_points_box(spark, sf_dir)
    cen = centers_for(spark, pts, EV_Q, EV_DIMS, box)
    return cf_aggregate(assign_nearest(pts, cen, EV_DIMS), ["tick", "mc_id"], EV_DIMS)


def flat(df: DataFrame, vec: str, dims: int) -> list:
    return [F.col(vec)[i].alias(f"{vec}_{i}") for i in range(dims)]


# ------------------------------------------------------------- SQL fragments

def centers_sql(name: str, q: int, dims: int, src: str) -> str:
    """CTEs `{name}_box` and `{name}_cen(mc_id, c0..)`: the deterministic uniform draw."""
    box = ", ".join(f"min(x{d}) AS lo{d}, max(x{d}) AS hi{d}" for d in range(dims))
    coords = ",\n    ".join(
        f"lo{d} + (CAST(CAST('0x' || substr(md5('{SEED},' || r.range || ',{d}'), 1, {HEX_DIGITS}) AS BIGINT) AS DOUBLE)"
        f" / {float(16 ** HEX_DIGITS)!r}) * (hi{d} - lo{d}) AS c{d}" for d in range(dims))
    return (f"{name}_box AS (SELECT {box} FROM {src}),\n"
            f"{name}_cen AS (SELECT r.range AS mc_id,\n    {coords}\n  FROM range({q}) r, {name}_box)")


def dist_sql(a: str, b: str, dims: int, pa: str = "x", pb: str = "c") -> str:
    return " + ".join(f"({a}.{pa}{d} - {b}.{pb}{d}) * ({a}.{pa}{d} - {b}.{pb}{d})" for d in range(dims))


LI_POINTS_SQL = """li_pts AS (
  SELECT row_number() OVER () AS pid,
         CAST(year(l_shipdate) - 1994 AS BIGINT) AS tick,
         CAST(l_quantity AS DOUBLE) AS x0,
         floor(l_discount * 100 + 0.5) AS x1,
         floor(l_tax * 100 + 0.5) AS x2
  FROM lineitem)"""

EV_POINTS_SQL = """ev_base AS (
  SELECT event_id AS pid, CAST(ts AS DATE) AS day, event_type,
         floor(value * 100 + 0.5) AS x0,
         CAST(hour(ts) AS DOUBLE) AS x1
  FROM events),
ev_days AS (SELECT day, CAST(dense_rank() OVER (ORDER BY day) AS BIGINT) AS tick
            FROM (SELECT DISTINCT day FROM ev_base) t),
ev_pts AS (SELECT b.pid, d.tick, b.event_type, b.x0, b.x1 FROM ev_base b JOIN ev_days d USING (day))"""


def nearest_sql(name: str, pts: str, cen: str, dims: int, cp: str = "c", extra: str = "") -> str:
    """CTE `{name}` = points of `pts` with the mc_id and dist of the nearest
    row of `cen` (centroid columns {cp}0..), first mc_id wins ties."""
    xs = ", ".join(f"p.x{d}" for d in range(dims))
    dd = dist_sql("p", "c", dims, pb=cp)
    return f"""{name}_d AS (
  SELECT p.pid, p.tick, {xs}, c.mc_id{extra}, {dd} AS d2,
         row_number() OVER (PARTITION BY p.pid ORDER BY {dd}, c.mc_id) AS rn
  FROM {pts} p, {cen} c),
{name} AS (SELECT * EXCLUDE (rn), sqrt(d2) AS dist FROM {name}_d WHERE rn = 1)"""


def assigned_sql(name: str, pts: str, dims: int, q: int) -> str:
    """CTEs `{name}_cen` and `{name}` = points with mc_id, dist (first wins ties)."""
    return centers_sql(name, q, dims, pts) + ",\n" + nearest_sql(name, pts, f"{name}_cen", dims)


def cf_sql(name: str, src: str, dims: int, keys: str = "tick, mc_id") -> str:
    s1 = ", ".join(f"sum(x{d}) AS s1_{d}" for d in range(dims))
    s2 = ", ".join(f"sum(x{d} * x{d}) AS s2_{d}" for d in range(dims))
    return f"""{name} AS (
  SELECT {keys}, count(*) AS n, {s1}, {s2},
         CAST(sum(tick) AS BIGINT) AS cf1t, CAST(sum(tick * tick) AS BIGINT) AS cf2t,
         max(tick) AS last_tick
  FROM {src} GROUP BY {keys})"""


def rmsd_sql(src: str, dims: int, group: str = "tick", out: str = "info") -> str:
    """CTE `{out}` = src + m{d} centroid, nzd and rmsd (n>1 formula, n=1 nearest non-zero)."""
    ms = ", ".join(f"s1_{d} / n AS m{d}" for d in range(dims))
    dd = " + ".join(f"(a.m{d} - b.m{d}) * (a.m{d} - b.m{d})" for d in range(dims))
    s2 = " + ".join(f"s2_{d}" for d in range(dims))
    s1 = " + ".join(f"s1_{d} * s1_{d}" for d in range(dims))
    gj = " AND ".join(f"a.{g} = b.{g}" for g in group.split(", "))
    return f"""{out}_c AS (SELECT *, {ms} FROM {src}),
{out}_nz AS (
  SELECT a.{group.replace(', ', ', a.')}, a.mc_id,
         coalesce(sqrt(min(CASE WHEN ({dd}) <> 0 THEN ({dd}) END)), CAST('inf' AS DOUBLE)) AS nzd
  FROM {out}_c a JOIN {out}_c b ON {gj}
  GROUP BY ALL),
{out} AS (
  SELECT c.*, CASE WHEN c.n > 1 THEN sqrt(greatest(({s2}) / c.n - ({s1}) / (c.n * c.n), 0))
                   WHEN c.n = 1 THEN z.nzd ELSE 0 END AS rmsd
  FROM {out}_c c JOIN {out}_nz z USING ({group}, mc_id))"""
